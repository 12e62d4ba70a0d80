"""Filling containers of fixed capacity, by bound-certified repacking.

Items are spread over partitions by a hash of their key and packed there by
best-fit decreasing. A lower bound from dual feasible functions certifies a
partition whose number of containers cannot be beaten. Partitions with a gap,
to the bound or of more than a quarter of a container in free room, release
their emptiest containers; the released items of ``EXCHANGE``
partitions meet in one group and are packed again, round after round, until
one group is left. A round keeps the older packing where it is not beaten.

What a task holds is bounded: about ``PARTITION_ITEMS`` items in the first
round and ``EXCHANGE * RELEASE`` containers of items in the later ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithograph.tables import checkpointed

PARTITION_ITEMS = 20_000
EXCHANGE = 16
#: Containers that a partition with a gap releases at most.
RELEASE = 64


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Containers that any packing of the sizes needs at least, from two families of dual feasible functions."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    weight = count * np.arange(capacity + 1)
    n, w = np.concatenate(([0], np.cumsum(count))), np.concatenate(([0], np.cumsum(weight)))
    e = np.arange(0, capacity // 2 + 1)
    # Sizes above capacity - e count as a whole container, those below e as nothing.
    large = n[capacity + 1] - n[capacity - e + 1]
    middle = w[capacity - e + 1] - w[e]
    best = int((large + -(-middle // capacity)).max())
    # Sizes are rounded to multiples of 1/k, down, unless (k + 1) of them fill containers exactly.
    x = np.arange(capacity + 1)
    for k in range(1, 65):
        whole, rest = np.divmod((k + 1) * x, capacity)
        value = np.where(rest == 0, x * k, whole * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item: largest items first, each into the fullest container it fits in.

    Open containers are kept by free room; a bit per room tells which exist, so
    the tightest fit is the lowest set bit from the size on.
    """
    placed = np.empty(len(sizes), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits = used = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = bits >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            container = by_room[room].pop()
            if not by_room[room]:
                bits ^= 1 << room
        else:
            room, container = capacity, used
            used += 1
        placed[i] = container
        if left := room - size:
            by_room[left].append(container)
            bits |= 1 << left
    return placed


def _repack(capacity: int, stage: int, final: bool) -> Callable[[pa.Table], pa.Table]:
    def pack(table: pa.Table) -> pa.Table:
        # Rows in a fixed order, so that a task that runs again gives the same containers.
        table = table.sort_by([("__key", "ascending"), ("piece", "ascending"), ("__row", "ascending")])
        group = table.column("__group")[0].as_py()
        sizes = table.column("n_tokens").to_numpy().astype(np.int64)
        placed = best_fit_decreasing(sizes, capacity)
        names = np.array([f"{stage}-{group}-{c}" for c in range(int(placed.max()) + 1)], dtype=object)[placed]
        bound = lower_bound(sizes, capacity)
        if stage:
            old, back = np.unique(table.column("container_id").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            if len(old) <= placed.max() + 1:
                placed, names = back, old.astype(object)[back]
        fill = np.bincount(placed, weights=sizes)
        free = np.zeros(len(fill), dtype=bool)
        # A certified count may still hide most of a free container behind its rounding.
        if not final and (len(fill) > bound or len(fill) * capacity - sizes.sum() > capacity // 4):
            loosest = np.argsort(fill, kind="stable")[:RELEASE]
            free[loosest[fill[loosest] < capacity]] = True
        columns = {"container_id": pa.array(names, pa.string()), "__free": pa.array(free[placed])}
        return pa.table([columns.get(c, table.column(c) if c in table.column_names else None) for c in ("__key", "piece", "n_tokens", "__row", "__part", "container_id", "__free")], names=["__key", "piece", "n_tokens", "__row", "__part", "container_id", "__free"])

    return pack


def pieces(sizes: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """__key, piece, n_tokens: items whole; those above the capacity in pieces, all but the last one full.

    Items without a size, or with none above 0, have no piece.
    """
    n = F.col(size).cast("long")
    items = sizes.select(F.col(key).alias("__key"), n.alias("__n")).where(F.col("__n") > 0)
    cut = items.select("__key", "__n", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / capacity).cast("int"))).alias("piece"))
    return cut.select("__key", "piece", F.least(F.lit(capacity), F.col("__n") - F.col("piece") * capacity).cast("int").alias("n_tokens"))


def pack(sizes: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """key, piece, n_tokens, container_id: every item in one container whose sizes sum to at most ``capacity``.

    Only items above the capacity are split, into pieces numbered from 0. Null
    and zero sizes are in no container; repeated rows are items of their own;
    an empty table gives an empty table. Other columns are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    items = checkpointed(pieces(sizes, key, size, capacity).withColumn("__row", F.monotonically_increasing_id()))
    parts = max(1, math.ceil(items.count() / PARTITION_ITEMS))
    kind = items.schema["__key"].dataType.simpleString()
    shape = f"__key {kind}, piece int, n_tokens int, __row long, __part int, container_id string, __free boolean"
    items = items.withColumn("__part", F.pmod(F.xxhash64("__key", "piece", "__row"), F.lit(parts)).cast("int")).withColumn("container_id", F.lit(None).cast("string"))
    rounds = 1 + math.ceil(math.log(parts, EXCHANGE)) if parts > 1 else 1
    sealed: list[DataFrame] = []
    for stage in range(rounds):
        final = stage == rounds - 1
        group = F.floor(F.col("__part") / EXCHANGE**stage).cast("int")
        packed = items.withColumn("__group", group).groupBy("__group").applyInArrow(_repack(capacity, stage, final), shape)
        if not final:
            packed = checkpointed(packed)  # read twice: the sealed rows here, the released ones in the next round
        sealed.append(packed.where(~F.col("__free")))
        items = packed.where("__free").drop("__free")
    done = sealed[0]
    for part in sealed[1:]:
        done = done.unionByName(part)
    return done.select(F.col("__key").alias(key), "piece", "n_tokens", "container_id")


def certificate(packed: DataFrame, capacity: int, size: str = "n_tokens") -> DataFrame:
    """One row: containers, lower_bound (for all items together), n_tokens and fill of a packing.

    The bound is computed from the histogram of sizes, which has at most
    ``capacity`` rows however many items there are.
    """
    histogram = packed.groupBy(F.col(size).cast("int").alias("__size")).agg(F.count("*").alias("__n"), F.lit(0).cast("long").alias("__c"))
    containers = packed.select("container_id").distinct().select(F.lit(None).cast("int").alias("__size"), F.lit(None).cast("long").alias("__n"), F.lit(1).cast("long").alias("__c"))
    counted = histogram.unionByName(containers.groupBy("__size", "__n").agg(F.sum("__c").alias("__c")))

    def bound(table: pa.Table) -> pa.Table:
        sizes = table.column("__size").to_pylist()
        counts = table.column("__n").to_pylist()
        used = sum(table.column("__c").to_pylist())
        known = [(s, n) for s, n in zip(sizes, counts, strict=True) if s is not None]
        total = sum(s * n for s, n in known)
        least = lower_bound(np.repeat([s for s, _ in known], [n for _, n in known]).astype(np.int64), capacity) if known else 0
        return pa.table({"containers": pa.array([used], pa.int64()), "lower_bound": pa.array([least], pa.int64()), "n_tokens": pa.array([total], pa.int64()), "fill": pa.array([total / (used * capacity) if used else None], pa.float64())})

    return counted.withColumn("__all", F.lit(0)).groupBy("__all").applyInArrow(bound, "containers long, lower_bound long, n_tokens long, fill double")
