"""Per-key results that a few heavy keys cannot unbalance, by dense accumulator arrays.

1. Every equal split of the input encodes its keys with a dictionary of its own
   and counts with ``numpy.bincount`` into a dense array. A key that holds a
   third of all rows is then one cell per split.
2. The arrays are cut into blocks by a hash of the key; a split sends at most
   one array per block.
3. Each block merges the splits' dictionaries into one and adds the arrays into
   a dense accumulator by scatter-add. The reduction reads cells, not rows.

Work per task follows the rows of a split and the distinct keys of a block,
never the rows of a key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct keys of a split after which its arrays are sent on, so that memory stays bounded.
SPLIT_KEYS = 400_000


def _encoded(columns: Sequence[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """A dense code for each row, and a row that stands for each code."""
    code = np.zeros(len(columns[0]), dtype=np.int64)
    for column in columns:
        d = column.dictionary_encode(null_encoding="encode")
        if isinstance(d, pa.ChunkedArray):
            d = d.combine_chunks()
        code = code * max(1, len(d.dictionary)) + d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if len(columns) > 1:
            _, code = np.unique(code, return_inverse=True)
    size = int(code.max()) + 1 if len(code) else 0
    stands = np.zeros(size, dtype=np.int64)
    stands[code[::-1]] = np.arange(len(code))[::-1]
    return code, stands


def key_counts(df: DataFrame, keys: Sequence[str], measure: str | None = None, blocks: int | None = None) -> DataFrame:
    """Rows per key as keys and n (and ``total``, the sum of the integer column ``measure``, if one is named).

    Rows with a null in a key do not count; a null measure adds nothing. An
    empty table gives an empty table. Other columns are ignored, whatever
    their names. ``blocks`` is the number of array blocks; by default four per
    shuffle partition.
    """
    keys = list(keys)
    blocks = blocks or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)],
        F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int").alias("__block"),
        (F.coalesce(F.col(measure).cast("long"), F.lit(0)) if measure else F.lit(0).cast("long")).alias("__m"),
    ).dropna(subset=names)
    kinds = [rows.schema[n].dataType.simpleString() for n in names]
    listed = ", ".join(f"{n} array<{k}>" for n, k in zip(names, kinds, strict=True))
    width = len(names)

    def send(table: pa.Table, n: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        block = table.column(width).to_numpy()
        order = np.argsort(block, kind="stable")
        at = np.flatnonzero(np.diff(block[order], prepend=-1))
        offsets = pa.array(np.append(at, len(order)), pa.int32())
        arrays = [pa.ListArray.from_arrays(offsets, table.column(i).combine_chunks().take(pa.array(order))) for i in range(width)]
        sums = [pa.ListArray.from_arrays(offsets, pa.array(x[order], pa.int64())) for x in (n, m)]
        return pa.RecordBatch.from_arrays([pa.array(block[order][at], pa.int32()), *arrays, *sums], names=["__block", *names, "__n", "__m"])

    def merged(tables: list[pa.Table], counts: list[np.ndarray], sums: list[np.ndarray]) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        table, n, m = pa.concat_tables(tables), np.concatenate(counts), np.concatenate(sums)
        code, stands = _encoded([table.column(i) for i in range(width)])
        dense, total = np.zeros(len(stands), dtype=np.int64), np.zeros(len(stands), dtype=np.int64)
        np.add.at(dense, code, n)
        np.add.at(total, code, m)
        return table.take(pa.array(stands)), dense, total

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        for batch in batches:
            if not batch.num_rows:
                continue
            code, stands = _encoded(batch.columns[:width])
            dense, total = np.bincount(code, minlength=len(stands)), np.zeros(len(stands), dtype=np.int64)
            if measure:
                np.add.at(total, code, batch.column(width + 1).to_numpy())
            for to, x in zip(held, (pa.Table.from_batches([batch.select(range(width + 1))]).take(pa.array(stands)), dense, total), strict=True):
                to.append(x)
            if sum(map(len, held[1])) > SPLIT_KEYS:
                kept = merged(*held)
                if len(kept[1]) > SPLIT_KEYS // 2:
                    yield send(*kept)
                    held = ([], [], [])
                else:
                    held = tuple([x] for x in kept)
        if held[0]:
            yield send(*merged(*held))

    def reduce(table: pa.Table) -> pa.Table:
        flat = pa.table([pc.list_flatten(table.column(n)) for n in names], names=names)
        code, stands = _encoded([flat.column(i) for i in range(width)])
        dense, total = np.zeros(len(stands), dtype=np.int64), np.zeros(len(stands), dtype=np.int64)
        np.add.at(dense, code, pc.list_flatten(table.column("__n")).to_numpy())
        np.add.at(total, code, pc.list_flatten(table.column("__m")).to_numpy())
        kept = flat.take(pa.array(stands))
        return pa.table([*kept.columns, pa.array(dense), pa.array(total)], names=[*names, "n", "__m"])

    parts = rows.mapInArrow(count, f"__block int, {listed}, __n array<long>, __m array<long>")
    out = parts.groupBy("__block").applyInArrow(reduce, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)) + ", n long, __m long")
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], "n", *([F.col("__m").alias("total")] if measure else []))


def heavy_keys(counts: DataFrame, share: float) -> DataFrame:
    """The rows of ``counts`` whose n is at least ``share`` of the sum of n.

    The bar is computed as a scalar inside the plan; nothing is collected.
    """
    whole = counts.select(F.sum("n").alias("__all")).scalar()
    return counts.where(F.col("n") >= F.lit(share) * whole)
