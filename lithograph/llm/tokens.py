"""Encoding of a corpus with a public tokenizer, by merge replay (see merge_replay).

Each task encodes its own slice of the rows; nothing is shuffled, broadcast or
collected. The vocabulary file must be readable at the same path everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default place of the vocabulary; every operator takes another as a parameter.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Characters encoded together at most, so that a task's arrays stay small however large its rows are.
SLICE_CHARS = 8_000_000


def slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of at most SLICE_CHARS bytes of text, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > SLICE_CHARS:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def token_ids(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """key and ids (array<int>) of each row, without special tokens.

    Null and empty texts have an empty list. Repeated rows stay repeated, an
    empty table gives an empty table, and other columns are ignored.
    """
    rows = df.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lithograph.llm.merge_replay import Encoder

        encoder = Encoder(vocabulary)
        for batch in slices(batches, 1):
            ids, offsets = encoder.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], names=["__key", "ids"])

    kind = rows.schema["__key"].dataType.simpleString()
    return rows.mapInArrow(encode, f"__key {kind}, ids array<int>").select(F.col("__key").alias(key), "ids")


def token_counts(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """key and n_tokens of each row; 0 for null and empty texts."""
    rows = df.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lithograph.llm.merge_replay import Encoder

        encoder = Encoder(vocabulary)
        for batch in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encoder.count(batch.column(1).to_pylist()), pa.int32())], names=["__key", "n_tokens"])

    kind = rows.schema["__key"].dataType.simpleString()
    return rows.mapInArrow(count, f"__key {kind}, n_tokens int").select(F.col("__key").alias(key), "n_tokens")
