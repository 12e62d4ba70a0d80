"""Work on pairs of a set of files and a person where most pairs exist: in blocks of sets, with numpy.

A busy file has most people, so the pairs of all sets grow with the square of
the tables. They are never shuffled: sets are spread over blocks, what is known
of a file goes once to each block that has a set with it, and a block finds and
writes the pairs of one set after another.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithograph.tables import checkpointed

#: Sets of a block, about.
BLOCK_SETS = 256
#: What a block gets; the columns mean something else for each kind of row.
_COLUMNS = {"key": "long", "name": "string", "other": "string", "file_id": "string", "longs": "array<long>", "more": "array<long>"}
SET, FILE, OWNER, AUTHORS, REVIEWS, PERSON, NEAR, MEMBERS = range(8)
#: Parts that the members of all crowds are packed in.
_PACKS = 64
Rows = dict[int, pa.Table]


def blocks_of(sets: DataFrame, key: str) -> tuple[int, Column]:
    """The number of blocks for that many sets, and the block of each."""
    blocks = max(1, math.ceil(sets.agg(F.count_distinct(key)).first()[0] / BLOCK_SETS))
    return blocks, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block")


def part(df: DataFrame, kind: int, **columns: Column) -> DataFrame:
    """Rows of one kind for the blocks that ``df`` names."""
    return df.select("block", F.lit(kind).alias("kind"), *[columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in _COLUMNS.items()])


def to_all(df: DataFrame, blocks: int) -> DataFrame:
    return df.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))


def answered(parts: list[DataFrame], blocks: int, answer: Callable[[Rows], Iterator[pa.RecordBatch]], shape: str) -> DataFrame:
    """What ``answer`` yields for the rows of each block by their kind."""
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)

    def told(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        kinds = table.column("kind").to_numpy()
        yield from answer({k: table.filter(pa.array(kinds == k)) for k in range(MEMBERS + 1)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            at = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if end > start:
                    if held and held[-1].column(0)[0].as_py() != at[start]:
                        yield from told(held)
                        held = []
                    held.append(batch.slice(start, end - start))
        if held:
            yield from told(held)

    return rows.repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(run, shape)


def lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists of a column, and where each list begins and the last one ends."""
    if not len(column):
        return np.empty(0, np.int64), np.zeros(1, np.int64)
    values = pa.concat_arrays(column.chunks)
    return values.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False))))


def overlap_parts(near: DataFrame, changed: DataFrame, files: DataFrame, blocks: int) -> list[DataFrame]:
    """The rows that ``Overlap`` needs: ``near`` (file_id, symbol_id) are the neighbours of a file, ``changed`` (symbol_id, person) who changed a symbol, ``files`` (block, file_id) what a block asks for."""
    changed = checkpointed(changed)
    # A set of people is known by its size and 128 bits of hashes. Symbols that the same people changed are one crowd.
    people = F.struct(F.count("*").alias("n"), *[F.bit_xor(F.xxhash64(F.lit(salt), "person")).alias(salt) for salt in ("a", "b")])
    numbered = checkpointed(changed.groupBy("symbol_id").agg(people.alias("crowd")).withColumn("symbol", F.monotonically_increasing_id()))
    symbols = numbered.join(numbered.groupBy(F.col("crowd").alias("c")).agg(F.min("symbol").alias("first")), F.col("crowd") == F.col("c")).select("symbol_id", "symbol", F.col("first").alias("crowd"))
    members = changed.join(symbols.where(F.col("symbol") == F.col("crowd")), "symbol_id")
    pairs = lambda one, two: F.collect_list(F.struct(F.col(one).alias("one"), F.col(two).alias("two"))).alias("pairs")
    packed = members.groupBy(F.pmod(F.xxhash64("person"), F.lit(_PACKS)).alias("pack")).agg(pairs("crowd", "person"))
    around = files.join(near.join(symbols, "symbol_id").groupBy("file_id").agg(pairs("symbol", "crowd")), "file_id")
    two = {"longs": F.col("pairs.one"), "more": F.col("pairs.two")}
    return [part(around, NEAR, file_id=F.col("file_id"), **two), part(to_all(packed, blocks), MEMBERS, **two)]


class Overlap:
    """Distinct symbols near the files of a set that each person of a block changed."""

    def __init__(self, rows: Rows, persons: np.ndarray) -> None:
        """``persons`` are the sorted numbers of all people of the block."""
        symbols, at = lists(rows[NEAR].column("longs"))
        crowds, _ = lists(rows[NEAR].column("more"))
        known, first, where = np.unique(symbols, return_index=True, return_inverse=True)
        numbers, self._crowd = np.unique(crowds[first], return_inverse=True)
        self._near = {f: where[at[i] : at[i + 1]] for i, f in enumerate(rows[NEAR].column("file_id").to_pylist())}
        crowd, person = (lists(rows[MEMBERS].column(c))[0] for c in ("longs", "more"))
        kept = np.isin(crowd, numbers) & np.isin(person, persons)
        crowd, person = np.searchsorted(numbers, crowd[kept]), np.searchsorted(persons, person[kept])
        order = np.argsort(crowd, kind="stable")
        self._crowds, self._persons = crowd[order], person[order]
        self._at = np.searchsorted(self._crowds, np.arange(len(numbers) + 1))
        self._symbols, self._size = len(known), len(persons)

    def of(self, files: list[str]) -> np.ndarray:
        """The count of each person for a set of files."""
        near = [self._near[f] for f in files if f in self._near]
        if not near:
            return np.zeros(self._size, np.int64)
        seen = np.zeros(self._symbols, bool)
        for x in near:
            seen[x] = True
        count = np.bincount(self._crowd[seen], minlength=len(self._at) - 1)
        there = np.flatnonzero(count)
        long = self._at[there + 1] - self._at[there]
        if 4 * long.sum() > len(self._crowds):
            return np.bincount(self._persons, weights=count[self._crowds], minlength=self._size).astype(np.int64)
        # Few members: only theirs are added.
        each = np.repeat(self._at[there] - np.cumsum(long) + long, long) + np.arange(long.sum())
        return np.bincount(self._persons[each], weights=np.repeat(count[there], long), minlength=self._size).astype(np.int64)
