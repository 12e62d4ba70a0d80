"""Rolling totals over trailing periods, by segment trees per entity and time shard.

The time line is cut into shards of ``SHARD_DAYS`` days. For each entity and
shard one row holds a segment tree in heap order: node 1 is the whole shard,
node ``SHARD_DAYS + offset`` is one day, and only nodes that are not zero are
stored. Every node has the sum of the measure and the number of active days.

* A trailing period is answered from the few nodes that cover it, never from
  its single days; the covers are the same for all entities, so a batch of
  entities is answered with a few array additions per day.
* A late correction touches one leaf and its ancestors in one shard; all other
  shards stay as they are (``correct``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_DAYS = 64
_EPOCH = date(1970, 1, 1)
#: Cells of the dense node matrix that a task holds at once.
_CELLS = 4_000_000


def _day(value: date) -> int:
    return (value - _EPOCH).days


def _tree(offsets: np.ndarray, *leaves: np.ndarray) -> tuple[np.ndarray, ...]:
    """Nodes that are not zero of one shard's tree, with a sum for each measure."""
    dense = np.zeros((len(leaves), 2 * SHARD_DAYS), dtype=np.int64)
    for row, values in zip(dense, leaves, strict=True):
        np.add.at(row, SHARD_DAYS + offsets, values)
    width = SHARD_DAYS
    while width > 1:
        half = width // 2
        dense[:, half:width] = dense[:, width : 2 * width : 2] + dense[:, width + 1 : 2 * width : 2]
        width = half
    nodes = np.flatnonzero(dense.any(axis=0))
    return nodes, *dense[:, nodes]


def cover(low: int, high: int) -> list[int]:
    """Nodes of one shard's tree that together are exactly the days low..high (inclusive offsets)."""
    nodes, a, b = [], low + SHARD_DAYS, high + SHARD_DAYS + 1
    while a < b:
        if a & 1:
            nodes.append(a)
            a += 1
        if b & 1:
            b -= 1
            nodes.append(b)
        a //= 2
        b //= 2
    return nodes


def segment_trees(daily: DataFrame, keys: Sequence[str], day: str = "day", total: str = "total") -> DataFrame:
    """Trees of daily totals: keys, shard, nodes, sums, counts (active days); one row per entity and shard.

    ``daily`` may have several rows for one entity and day; they add up. Rows
    whose day or total is null are left out, null keys form an entity of their
    own, and an empty table gives an empty table. Other columns are ignored,
    whatever their names.
    """
    keys = list(keys)
    names = [f"__k{i}" for i in range(len(keys))]
    number = F.datediff(F.col(day).cast("date"), F.lit(_EPOCH))
    leaves = (
        daily.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], number.alias("__day"), F.col(total).cast("long").alias("__total"))
        .where(F.col("__day").isNotNull() & F.col("__total").isNotNull())
        .groupBy(*names, "__day").agg(F.sum("__total").alias("__total"))
        .withColumn("__shard", F.floor(F.col("__day") / SHARD_DAYS).cast("int"))
        .groupBy(*names, "__shard")
        .agg(F.collect_list(F.struct(F.pmod("__day", F.lit(SHARD_DAYS)).alias("o"), F.col("__total").alias("t"))).alias("__leaves"))
    )
    kinds = ", ".join(f"{n} {leaves.schema[n].dataType.simpleString()}" for n in names)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(names) + 1)
            bounds, flat = column.offsets.to_numpy(), column.values
            offsets, totals = flat.field("o").to_numpy(), flat.field("t").to_numpy()
            nodes, sums, counts, sizes = [], [], [], [0]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                n, s, c = _tree(offsets[a:b], totals[a:b], np.ones(b - a, dtype=np.int64))
                nodes.append(n.astype(np.int32)), sums.append(s), counts.append(c.astype(np.int32)), sizes.append(len(n))
            at = pa.array(np.cumsum(sizes), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x) if x else [], k)) for x, k in ((nodes, pa.int32()), (sums, pa.int64()), (counts, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names) + 1], *lists], names=[*names, "shard", "nodes", "sums", "counts"])

    trees = leaves.mapInArrow(build, f"{kinds}, shard int, nodes array<int>, sums array<long>, counts array<int>")
    return trees.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], "shard", "nodes", "sums", "counts")


def correct(trees: DataFrame, corrections: DataFrame, keys: Sequence[str], day: str = "day", total: str = "total") -> DataFrame:
    """``trees`` after late corrections: amounts to add to (or take from) days of entities.

    Only the leaf of a corrected day and its ancestors change; rows of other
    shards pass unchanged. Several corrections of a day add up first. A day's
    count follows its total: a day whose total becomes zero is no longer active,
    one that had none becomes active. Null days or amounts are left out.
    """
    keys = list(keys)
    delta = segment_trees(corrections, keys, day, total).select(*[F.col(k).alias(f"__c{i}") for i, k in enumerate(keys)], F.col("shard").alias("__shard"), F.col("nodes").alias("__nodes"), F.col("sums").alias("__sums"))
    on = F.col("shard") == F.col("__shard")
    for i, k in enumerate(keys):
        on = on & trees[k].eqNullSafe(F.col(f"__c{i}"))
    joined = trees.join(delta, on, "full_outer").select(
        *[F.when(F.col("__shard").isNull(), F.col(k)).otherwise(F.col(f"__c{i}")).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.coalesce("shard", "__shard").alias("shard"), "nodes", "sums", "counts", "__nodes", "__sums",
    )
    names = [f"__k{i}" for i in range(len(keys))]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            out: tuple[list, list, list] = ([], [], [])
            for i in range(batch.num_rows):
                cells = [batch.column(at[c])[i].as_py() for c in ("nodes", "sums", "counts", "__nodes", "__sums")]
                tree = {n: [s, c] for n, s, c in zip(cells[0] or [], cells[1] or [], cells[2] or [], strict=True)}
                for node, amount in zip(cells[3] or [], cells[4] or [], strict=True):
                    if node < SHARD_DAYS:
                        continue
                    leaf = tree.get(node, [0, 0])
                    turned = int(leaf[0] + amount != 0) - leaf[1]
                    while node:
                        s, c = tree.get(node, [0, 0])
                        tree[node] = [s + amount, c + turned]
                        node //= 2
                kept = sorted((n, *v) for n, v in tree.items() if any(v))
                for column, values in zip(out, zip(*kept, strict=True) if kept else ((), (), ()), strict=True):
                    column.append(list(values))
            lists = [pa.array(x, pa.list_(k)) for x, k in zip(out, (pa.int32(), pa.int64(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names) + 1], *lists], names=[*names, "shard", "nodes", "sums", "counts"])

    kinds = ", ".join(f"{n} {trees.schema[k].dataType.simpleString()}" for n, k in zip(names, keys, strict=True))
    done = joined.mapInArrow(apply, f"{kinds}, shard int, nodes array<int>, sums array<long>, counts array<int>")
    return done.where(F.size("nodes") > 0).select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], "shard", "nodes", "sums", "counts")


def trailing_totals(trees: DataFrame, keys: Sequence[str], windows: Sequence[int], end: date) -> DataFrame:
    """One row per entity: keys, first_day and, for each window n, total_n: the totals of the trailing n days.

    The arrays run from the entity's first active day to ``end``; days after
    ``end`` are not looked at, and an entity without an active day up to
    ``end`` has no row.
    """
    keys, windows = list(keys), list(windows)
    names = [f"__k{i}" for i in range(len(keys))]
    grouped = trees.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.struct("shard", "nodes", "sums").alias("__s")).groupBy(*names).agg(F.collect_list("__s").alias("__shards"))
    last = _day(end)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(names))
            if not batch.num_rows or not len(column.values):
                continue
            shards = column.values.field("shard").to_numpy()
            base = int(shards.min())
            count = last // SHARD_DAYS - base + 1
            if count <= 0:
                continue
            step = max(1, _CELLS // (count * 2 * SHARD_DAYS))
            for start in range(0, batch.num_rows, step):
                piece = batch.slice(start, step)
                yield from _answered(piece, names, windows, base, count, last)

    kinds = ", ".join(f"{n} {grouped.schema[n].dataType.simpleString()}" for n in names)
    totals = ", ".join(f"total_{w} array<long>" for w in windows)
    rows = grouped.mapInArrow(answer, f"{kinds}, first_day date, {totals}")
    return rows.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], "first_day", *[f"total_{w}" for w in windows])


def _answered(piece: pa.RecordBatch, names: list[str], windows: list[int], base: int, count: int, last: int) -> Iterator[pa.RecordBatch]:
    column, entities = piece.column(len(names)), piece.num_rows
    bounds = column.offsets.to_numpy()
    inner = column.values.slice(bounds[0], bounds[-1] - bounds[0])
    entity = np.repeat(np.arange(entities), np.diff(bounds))
    nodes = inner.field("nodes")
    at = nodes.offsets.to_numpy()
    row = np.repeat(entity, np.diff(at))
    shard = np.repeat(inner.field("shard").to_numpy() - base, np.diff(at))
    flat = nodes.values.to_numpy()[at[0] : at[-1]]
    sums = inner.field("sums").values.to_numpy()[at[0] : at[-1]]
    keep = shard < count
    tree = np.zeros((count * 2 * SHARD_DAYS, entities), dtype=np.int64)
    tree[shard[keep] * 2 * SHARD_DAYS + flat[keep], row[keep]] = sums[keep]
    days = last - base * SHARD_DAYS + 1
    first = np.full(entities, days, dtype=np.int64)
    leaf = keep & (flat >= SHARD_DAYS)
    np.minimum.at(first, row[leaf], shard[leaf] * SHARD_DAYS + flat[leaf] - SHARD_DAYS)
    alive = first < days
    if not alive.any():
        return
    mask = np.arange(days)[None, :] >= first[alive][:, None]
    offsets = pa.array(np.concatenate(([0], np.cumsum(days - first[alive]))), pa.int32())
    lists = []
    for window in windows:
        totals = np.empty((days, entities), dtype=np.int64)
        for d in range(days):
            low = max(0, d - window + 1)
            found = []
            for s in range(low // SHARD_DAYS, d // SHARD_DAYS + 1):
                a, b = max(low - s * SHARD_DAYS, 0), min(d - s * SHARD_DAYS, SHARD_DAYS - 1)
                found += [s * 2 * SHARD_DAYS + n for n in cover(a, b)]
            tree[found].sum(axis=0, out=totals[d])
        lists.append(pa.ListArray.from_arrays(offsets, pa.array(totals.T[alive][mask], pa.int64())))
    begun = pa.array((first[alive] + base * SHARD_DAYS).astype(np.int32), pa.int32()).cast(pa.date32())
    chosen = pa.array(np.flatnonzero(alive))
    yield pa.RecordBatch.from_arrays([*[c.take(chosen) for c in piece.columns[: len(names)]], begun, *lists], names=[*names, "first_day", *[f"total_{w}" for w in windows]])


def by_day(trailing: DataFrame, keys: Sequence[str], windows: Sequence[int]) -> DataFrame:
    """``trailing_totals`` with one row per entity and day: keys, day, total_n and average_n (per day) for each window."""
    names = [f"total_{w}" for w in windows]
    rows = trailing.select(*keys, "first_day", F.posexplode(F.arrays_zip(*names)).alias("__at", "__t"))
    return rows.select(*keys, F.date_add("first_day", F.col("__at")).alias("day"), *[F.col("__t")[n].alias(n) for n in names], *[(F.col("__t")[n] / F.lit(float(w))).alias(f"average_{w}") for n, w in zip(names, windows, strict=True)])


def rolling_totals(daily: DataFrame, keys: Sequence[str], windows: Sequence[int], end: date, day: str = "day", total: str = "total") -> DataFrame:
    """Totals and daily averages of trailing periods for each entity and day up to ``end``, days without activity included."""
    return by_day(trailing_totals(segment_trees(daily, keys, day, total), keys, windows, end), keys, windows)
