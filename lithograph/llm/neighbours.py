"""The k most similar vectors of every vector: inverted file, product-quantised residuals, exact reranking.

1. Coarse centroids and the codebooks of the residuals are fitted on a bounded
   sample (``SAMPLE`` vectors, or ``PER_LIST`` for each list if that is more). The same sample tells how many lists a query
   must visit for the wanted recall.
2. Every vector enters the list of its nearest centroid, with its residual as
   one byte per ``SUB`` dimensions. What it finds in its own list is a bar that
   vectors of other lists must reach. As a query it visits its nearest lists.
3. A list and its queries meet in blocks of bounded size, so that a list that
   holds a third of all vectors is work for many tasks. In a block, asymmetric
   distances (query against codes) choose the candidates and exact similarities
   with the stored vectors rank them. Where the error of the codes leaves open
   whether better ones were missed, the query is compared with the whole block.
4. A task keeps the best of each query over its blocks, and the tasks' are merged.

Where only pairs of a least similarity are asked for (``close``), a list and its
visitors are compared whole, without codes, and each pair counts for both of its
vectors. A query then visits the lists whose centroids are nearly as similar to
it as the nearest one; how nearly, pairs of exactly the least similarity tell.

Vectors travel in half precision, which changes a similarity by less than
``HALF``; where that matters, ``exact`` computes it from the full vectors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithograph.tables import checkpointed

#: Vectors in the sample that centroids and codebooks are fitted on, about; PER_LIST for each list if that is more.
SAMPLE, PER_LIST = 30_000, 16
#: Lists at most: as many as a quarter of the root of 10^11 vectors. Beyond, lists grow.
MOST_LISTS = 1 << 16
#: Dimensions per code byte.
SUB = 2
#: Recall that the number of visited lists is chosen for, measured within the sample.
TARGET_RECALL = 0.94
#: Share of the pairs of exactly the least similarity that ``close`` must reach; of more similar ones it reaches more.
AT_LEAST_RECALL = 0.99
#: Vectors and queries of a block at most, about.
BLOCK_VECTORS, BLOCK_QUERIES = 8_000, 40_000
#: What half precision changes a similarity by at most: two roundings of 2^-11 each, and that of the sum.
HALF = 0.001
#: Cells of a matrix of distances, so that it stays in a core's cache.
_CELLS = 200_000


@dataclass(frozen=True)
class Index:
    """Centroids (lists x dim), codebooks (subspaces x codes x SUB), the number of lists a query visits, the recall measured in the sample, and each list's share of vectors and of queries."""

    centroids: np.ndarray
    codebooks: np.ndarray
    visits: int
    recall: float
    stored: np.ndarray
    visited: np.ndarray


def lists_of(count: int) -> int:
    """The number of lists for that many vectors."""
    return int(min(max(16, math.isqrt(max(count, 1)) // 3), MOST_LISTS))


def close_lists_of(count: int) -> int:
    """The number of lists for ``close``: its queries visit few, so they are smaller."""
    return int(min(max(16, math.isqrt(max(count, 1))), MOST_LISTS))


def _rows(width: int) -> int:
    """How many rows of a matrix of that width are taken at once, so that it has 32 MB at most, about."""
    return max(64, min(8192, (1 << 23) // max(1, width)))


def _means(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8, unit: bool = False) -> np.ndarray:
    centres = points[rng.choice(len(points), k, replace=False)].copy()
    step = _rows(k)
    for _ in range(rounds):
        half = (centres**2).sum(axis=1) / 2
        near = np.concatenate([(points[i : i + step] @ centres.T - half).argmax(axis=1) for i in range(0, len(points), step)])
        count = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, weights=points[:, d], minlength=k) for d in range(points.shape[1])], axis=1)
        full = count > 0
        centres[full] = total[full] / count[full, None]
        centres[~full] = points[rng.choice(len(points), int((~full).sum()))]
        if unit:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres.astype(np.float32)


def fit(sample: np.ndarray, count: int, k: int, target: float = TARGET_RECALL, seed: int = 7) -> Index:
    """An index for ``count`` vectors, fitted on a sample of them."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    lists = min(lists_of(count), max(1, len(sample) // 8))
    centroids = _means(sample, lists, rng, unit=True)
    near = np.concatenate([(sample[i : i + 8192] @ centroids.T).argmax(axis=1) for i in range(0, len(sample), 8192)])
    residual = (sample - centroids[near]).reshape(len(sample), dim // SUB, SUB)
    codes = min(256, len(sample))
    books = np.stack([_means(residual[:, m], codes, rng, rounds=5) for m in range(dim // SUB)])
    # The sample is thinner than the whole, so its nearest vectors are farther away: as many of
    # them are looked for as the k nearest of the whole would leave in the sample.
    k = min(len(sample), max(1, round(k * len(sample) / max(count, 1))))
    asked = rng.choice(len(sample), min(1000, len(sample)), replace=False)
    best = np.empty((len(asked), k), dtype=np.int64)
    for i in range(0, len(asked), 64):
        some = asked[i : i + 64]
        similar = sample[some] @ sample.T
        similar[np.arange(len(some)), some] = -2
        best[i : i + 64] = np.argpartition(similar, len(sample) - k, axis=1)[:, len(sample) - k :]
    order = np.argsort(-(sample[asked] @ centroids.T), axis=1)
    place = np.take_along_axis(np.argsort(order, axis=1), near[best], axis=1)
    # As many lists as the target needs, and at least the four nearest, where close copies lie.
    reached = np.cumsum(np.bincount(place.ravel(), minlength=lists)) / max(1, place.size)
    visits = int(min(lists, max(4, np.searchsorted(reached, target) + 1)))
    index = Index(centroids, books, visits, float(reached[visits - 1]), np.bincount(near, minlength=lists) / len(sample), np.empty(0))
    seen = np.zeros(lists)
    for i in range(0, len(sample), 8192):
        seen += np.bincount(_visits(sample[i : i + 8192], index).ravel(), minlength=lists)
    return replace(index, visited=seen / len(sample))


def usable(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """n (a row number), key and vec (unit vector, float32 bytes) of each key with a usable vector.

    Null vectors, those of another length or with a null, NaN or infinite entry
    and zero vectors are left out, as are null keys. A key with several vectors
    keeps one of them, the same in every run.
    """
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where(F.col("key").isNotNull() & (F.size("v") == dim))
    kind = rows.schema["key"].dataType.simpleString()

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            good = np.isfinite(x).all(axis=1)
            x[~good] = 0
            top = np.abs(x).max(axis=1)
            good &= top > 0
            x = x[good] / top[good, None]
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), _binary(x)], names=["key", "vec"])

    # Repeated keys are settled on the shorter unit vectors.
    units = rows.mapInArrow(unit, f"key {kind}, vec binary").groupBy("key").agg(F.min("vec").alias("vec"))
    return units.select(F.monotonically_increasing_id().alias("n"), "key", "vec")


def _binary(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * width), pa.py_buffer(x)])


def _matrix(column: pa.Array | pa.ChunkedArray, dtype: type, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    at = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(dtype).reshape(-1, width)


def _lists(x: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """The nearest list of each vector and the code of its residual."""
    near = (x @ index.centroids.T).argmax(axis=1)
    residual = x - index.centroids[near]
    codes = np.empty((len(x), len(index.codebooks)), dtype=np.uint8)
    for m, book in enumerate(index.codebooks):
        part = residual[:, m * SUB : (m + 1) * SUB]
        codes[:, m] = (part @ book.T - (book**2).sum(axis=1) / 2).argmax(axis=1)
    return near, codes


def _visits(x: np.ndarray, index: Index) -> np.ndarray:
    """The lists that each vector visits."""
    s = x @ index.centroids.T
    return np.argpartition(-s, min(index.visits, s.shape[1]) - 1, axis=1)[:, : index.visits].astype(np.int32)


def _best(row: np.ndarray, other: np.ndarray, true: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k most similar others of each row, rows in order and the best first."""
    order = np.lexsort((other, -true, row))
    row, other, true = row[order], other[order], true[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
    return row[kept], other[kept], true[kept]


def _decoded(codes: np.ndarray, lists: np.ndarray, index: Index) -> np.ndarray:
    return np.concatenate([book[codes[:, m]] for m, book in enumerate(index.codebooks)], axis=1) + index.centroids[lists]


def _bars(x: np.ndarray, k: int) -> np.ndarray:
    """For each vector of a block, how similar its k-th nearest in the block is; -2 where it has fewer."""
    bars = np.full(len(x), -2, dtype=np.float32)
    if len(x) > k:
        for i in range(0, len(x), step := max(1, _CELLS // len(x))):
            s = x[i : i + step] @ x.T
            s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
            bars[i : i + step] = np.partition(s, len(x) - k, axis=1)[:, len(x) - k]
    return bars


def _search(q: np.ndarray, qn: np.ndarray, d: np.ndarray, dn: np.ndarray, codes: np.ndarray, lists: np.ndarray, index: Index, k: int, bars: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of queries with the vectors found for them and their similarities, best first.

    ``bars`` are similarities that a vector must reach to matter to a query;
    without one (-2) the query is compared with the whole block.
    """
    # The sum of a query's table entries over a code is its product with the decoded code, so
    # the asymmetric distances of a block are one matrix product.
    decoded = _decoded(codes, lists, index)
    # What a code's similarity to a query of length one is off by at most.
    error = float(np.sqrt(((d - decoded) ** 2).sum(axis=1).max()))
    bars = np.full(len(q), -2, np.float32) if bars is None else bars
    found: tuple[list, list, list] = ([], [], [])
    step = max(1, _CELLS // max(1, len(d)))
    for start in range(0, len(q), step):
        part, bar = q[start : start + step], bars[start : start + step].copy()
        hits = []
        closed = np.flatnonzero(bar > -1)
        if len(closed):
            s = part[closed] @ decoded.T
            over = s >= (bar[closed] - error * np.linalg.norm(part[closed], axis=1))[:, None]
            # Queries for which much of the block is in doubt are cheaper compared with all of it.
            many = np.count_nonzero(over, axis=1) > max(k, len(d) // 16)
            over[many] = False
            row, col = np.divmod(np.flatnonzero(over), len(d))
            row = closed[row]
            hits.append((row, col, np.einsum("ij,ij->i", part[row], d[col])))
            closed = closed[~many]
        open_ = np.setdiff1d(np.arange(len(part)), closed)
        if len(open_):
            s = part[open_] @ d.T
            s[qn[start + open_][:, None] == dn] = -2
            keep = min(k, len(d))
            bar[open_] = np.maximum(bar[open_], np.partition(s, len(d) - keep, axis=1)[:, len(d) - keep])
            row, col = np.divmod(np.flatnonzero((s >= bar[open_][:, None]) & (s > -2)), len(d))
            hits.append((open_[row], col, s[row, col]))
        row, col, true = (np.concatenate(x) for x in zip(*hits, strict=True))
        good = (true >= bar[row]) & (qn[start + row] != dn[col])
        for to, x in zip(found, _best(row[good] + start, dn[col[good]], true[good], k), strict=True):
            to.append(x)
    return tuple(np.concatenate(x) if x else np.empty(0, t) for x, t in zip(found, (np.int64, np.int64, np.float32), strict=True))


#: Hits that a task holds before it keeps the best of each query.
_HELD = 2_000_000
_HITS = pa.schema([("n", pa.int64()), ("others", pa.binary()), ("similar", pa.binary())])


def _sample(vectors: DataFrame, count: int, lists: int, dim: int) -> np.ndarray:
    """The vectors that lists are fitted on, chosen by their keys."""
    buckets, wanted = 1 << 24, max(SAMPLE, PER_LIST * lists)
    sampled = vectors.where(F.pmod(F.xxhash64("key"), F.lit(buckets)) < math.ceil(buckets * min(1.0, wanted / count))).select("vec").toArrow()
    sample = _matrix(sampled.column(0), np.float32, dim)
    if not len(sample):
        sample = _matrix(vectors.select("vec").limit(1000).toArrow().column(0), np.float32, dim)
    # The order in which rows arrive differs from run to run; the index must not.
    return sample[np.lexsort(sample.T[:4])]


def _packed(n: np.ndarray, other: np.ndarray, similar: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(np.diff(n, prepend=n[0] - 1)) if len(n) else np.empty(0, np.int64)
    cut = np.append(at, len(n))
    parts = [pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((cut * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))]) for x in (other.astype(np.int64), similar.astype(np.float32))]
    return pa.RecordBatch.from_arrays([pa.array(n[at], pa.int64()), *parts], schema=_HITS)


def _flat(column: pa.ChunkedArray | pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, values.offset * 4)
    return np.frombuffer(values.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].view(dtype), (at - at[0]) // np.dtype(dtype).itemsize


def _merged(k: int, best: Callable = _best) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keeps the best of each query over the batches of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            other, at = _flat(batch.column(1), np.int64)
            kept.append((np.repeat(batch.column(0).to_numpy(), np.diff(at)), other, _flat(batch.column(2), np.float32)[0]))
            size += len(other)
            if size > _HELD:
                kept = [best(*map(np.concatenate, zip(*kept, strict=True)), k)]
                if len(kept[0][0]) > _HELD // 2:
                    yield _packed(*kept[0])
                    kept = []
                size = sum(len(x[0]) for x in kept)
        if kept:
            yield _packed(*best(*map(np.concatenate, zip(*kept, strict=True)), k))

    return run


def neighbours(vectors: DataFrame, k: int, dim: int, target: float = TARGET_RECALL) -> DataFrame:
    """n, other (row numbers of ``usable``, which must be checkpointed), similarity and rank of the k most similar others of each vector.

    ``last`` and ``before`` are the similarities at the ranks k and k - 1, -2
    where there are fewer; they tell how sure the last rank is.

    Fewer than k rows come only where fewer other vectors were visited. Equal
    vectors are neighbours of similarity 1. An empty table gives no rows.
    """
    count = vectors.count()
    shape = "n long, other long, similarity float, rank int, last float, before float"
    if not count:
        return vectors.sparkSession.createDataFrame([], shape)
    index = fit(_sample(vectors, count, lists_of(count), dim), count, k, target)
    d_blocks = [max(1, math.ceil(x * count / BLOCK_VECTORS)) for x in index.stored.tolist()]
    q_blocks = [max(1, math.ceil(x * count / BLOCK_QUERIES)) for x in index.visited.tolist()]
    base = np.concatenate(([0], np.cumsum(np.multiply(d_blocks, q_blocks)))).tolist()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), np.float32, dim)
            near, codes = _lists(x, index)
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), batch.column(0), _binary(x.astype(np.float16)), _binary(codes)], names=["list", "n", "vec", "code"])

    def visiting(stored: pa.Table) -> pa.Table:
        """The visits of the vectors of a block, with their bars; a little below, so that rounding loses nothing."""
        x = _matrix(stored.column("vec"), np.float16, dim)
        bars = _bars(x.astype(np.float32), k) - np.float32(1e-5)
        to = np.concatenate([_visits(x[i : i + 4096].astype(np.float32), index) for i in range(0, len(x), 4096)])
        row = np.repeat(np.arange(len(x)), to.shape[1])
        return pa.table({"list": pa.array(to.ravel(), pa.int32()), "n": stored.column("n").take(pa.array(row)), "query": _binary(x[row]), "bar": pa.array(bars[row], pa.float32())})

    rows = vectors.select("n", "vec")
    # One row per list.
    sizes = vectors.sparkSession.createDataFrame([(i, int(d), int(q), int(b)) for i, (d, q, b) in enumerate(zip(d_blocks, q_blocks, base[:-1], strict=True))], "list int, d int, q int, base int")
    placed = lambda df, own, all_: df.join(F.broadcast(sizes), "list").withColumn("own", F.pmod(F.xxhash64("n"), F.col(own)).cast("int")).withColumn("each", F.explode(F.sequence(F.lit(0), F.col(all_) - 1)))
    stored = rows.mapInArrow(listed, "list int, n long, vec binary, code binary")
    # A vector's own list comes first, in parts of bounded size; what it finds there goes with it.
    parts = stored.join(F.broadcast(sizes), "list").select("list", F.pmod(F.xxhash64("n"), F.col("d")).cast("int").alias("part"), "n", "vec")
    visits = parts.groupBy("list", "part").applyInArrow(visiting, "list int, n long, query binary, bar float")
    left = placed(visits, "q", "d").select((F.col("base") + F.col("each") * F.col("q") + F.col("own")).alias("block"), "n", "query", "bar")
    right = placed(stored, "d", "q").select((F.col("base") + F.col("own") * F.col("q") + F.col("each")).alias("block"), "list", "n", "vec", "code")
    def block(queries: pa.Table, stored: pa.Table) -> pa.Table:
        if not queries.num_rows or not stored.num_rows:
            return _HITS.empty_table()
        q = _matrix(queries.column("query"), np.float16, dim).astype(np.float32)
        d, codes = _matrix(stored.column("vec"), np.float16, dim).astype(np.float32), _matrix(stored.column("code"), np.uint8, dim // SUB)
        qn = queries.column("n").to_numpy()
        row, other, similar = _search(q, qn, d, stored.column("n").to_numpy(), codes, stored.column("list").to_numpy(), index, k, queries.column("bar").to_numpy())
        return pa.Table.from_batches([_packed(*_best(qn[row], other, similar, k))], _HITS)

    packed_shape = "n long, others binary, similar binary"
    found = left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(block, packed_shape).mapInArrow(_merged(k), packed_shape)
    # All hits of a query meet in one partition, where the same merge settles them.
    return found.repartition("n").mapInArrow(_settled(k), shape)


def _settled(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([b for b in batches if b.num_rows], _HITS)
        if not table.num_rows:
            return
        other, at = _flat(table.column(1), np.int64)
        n, other, similar = _best(np.repeat(table.column(0).combine_chunks().to_numpy(), np.diff(at)), other, _flat(table.column(2), np.float32)[0], k)
        place = np.arange(len(n)) - np.searchsorted(n, n, "left")
        # Similarity at the last place asked for and at the one before, -2 where there are fewer.
        ends = []
        for at_place in (k - 1, k - 2):
            there = place == at_place
            where = np.minimum(np.searchsorted(n[there], n), max(0, int(there.sum()) - 1))
            ends.append(np.where(n[there][where] == n, similar[there][where], np.float32(-2)) if there.any() else np.full(len(n), -2, np.float32))
        for i in range(0, len(n), 100_000):
            part = slice(i, i + 100_000)
            columns = (n[part], other[part], similar[part].astype(np.float32), place[part].astype(np.int32) + 1, ends[0][part].astype(np.float32), ends[1][part].astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["n", "other", "similarity", "rank", "last", "before"])

    return run


def _margin(sample: np.ndarray, centroids: np.ndarray, least: float, target: float = AT_LEAST_RECALL, seed: int = 7) -> float:
    """How much less similar than the nearest centroid those of the lists may be that a query visits.

    A pair is found if either of its vectors visits the list of the other.
    Pairs of exactly the least similarity are made of a vector of the sample
    and the direction from it to another one; ``target`` of them are found.
    Where the sample has enough real pairs and those need much less, as where
    all vectors are alike, the margin follows them.
    """
    rng = np.random.default_rng(seed)

    def needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        s, t = a @ centroids.T, b @ centroids.T
        i = np.arange(len(a))
        return np.minimum(s.max(axis=1) - s[i, t.argmax(axis=1)], t.max(axis=1) - t[i, s.argmax(axis=1)])

    one, two = (sample[rng.choice(len(sample), min(10_000, len(sample)), replace=False)] for _ in range(2))
    away = two - np.einsum("ij,ij->i", one, two)[:, None] * one
    length = np.linalg.norm(away, axis=1)
    one, away = one[length > 1e-3], (away / np.maximum(length, 1e-3)[:, None])[length > 1e-3]
    made, real = [np.zeros(1)], []
    step = _rows(len(centroids))
    for i in range(0, len(one), step):
        made.append(needed(one[i : i + step], least * one[i : i + step] + math.sqrt(1 - least**2) * away[i : i + step]))
    asked = rng.choice(len(sample), min(5_000, len(sample)), replace=False)
    for i in range(0, len(asked), 64):
        some = asked[i : i + 64]
        s = sample[some] @ sample.T
        s[np.arange(len(some)), some] = -2
        near = s.argmax(axis=1)
        good = s[np.arange(len(some)), near] >= least
        real.append(needed(sample[some[good]], sample[near[good]]))
    known = np.concatenate(real)
    margin = float(np.quantile(np.concatenate(made), target))
    return min(margin, 1.5 * float(known.max())) if len(known) >= 1000 else margin


def _best_once(row: np.ndarray, other: np.ndarray, true: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_best`` of pairs that may come twice."""
    order = np.lexsort((-true, other, row))
    row, other, true = row[order], other[order], true[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (other[1:] != other[:-1])
    return _best(row[new], other[new], true[new], k)


def _within(q: np.ndarray, qn: np.ndarray, d: np.ndarray, dn: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k most similar others of at least ``least`` of each vector on either side of a block."""
    found: list[tuple[np.ndarray, ...]] = []
    size, turned = 0, [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)]
    bars = np.full(len(d), least, dtype=np.float32)
    back: list[tuple[np.ndarray, ...]] = []
    step = max(1, _CELLS // max(1, len(d)))
    cells = np.empty((min(step, len(q)), len(d)), dtype=np.float32)
    for start in range(0, len(q), step):
        part = q[start : start + step]
        s = np.matmul(part, d.T, out=cells[: len(part)])
        some = np.flatnonzero(s.max(axis=1) >= np.float32(least))
        row, col = np.divmod(np.flatnonzero(s[some] >= np.float32(least)), len(d))
        row = some[row]
        own = qn[start + row] == dn[col]
        s[row[own], col[own]] = -2
        row, col = row[~own], col[~own]
        there, here = (row, col), (row, col)
        if len(row) > k * sum(s.shape):
            # Much of the block is close: only the best of each row and column go on.
            rows = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(s), -2, np.float32)
            there = np.nonzero(s >= np.maximum(rows, np.float32(least))[:, None])
            if len(s) > k:
                bars = np.maximum(bars, np.partition(s, len(s) - k, axis=0)[len(s) - k])
            here = np.nonzero(s >= bars)
        if len(there[0]):
            r, o, t = _best(there[0] + start, dn[there[1]], s[there], k)
            found.append((qn[r], o, t))
        if len(here[0]):
            back.append((here[1], qn[start + here[0]], s[here]))
            size += len(here[0])
        if size > _HELD:
            turned = _best(*map(np.concatenate, zip(turned, *back, strict=True)), k)
            back, size = [], 0
    if back:
        turned = _best(*map(np.concatenate, zip(turned, *back, strict=True)), k)
    return _best_once(*map(np.concatenate, zip((dn[turned[0]], *turned[1:]), *found, strict=True)), k)


def close(vectors: DataFrame, k: int, dim: int, least: float) -> DataFrame:
    """n, other, similarity, and how sure it is: the pairs of at least ``least`` whose ``other`` is among the k most similar of n.

    ``vectors`` is as for ``neighbours``. ``open`` rows are to be decided by
    the full vectors: they may be less similar than ``least``, and those that
    compete (``competes``) belong to the k most similar only if they are the
    ``free`` most similar of the competing ones of n. Others are sure.
    """
    count = vectors.count()
    shape = "n long, other long, similarity float, open boolean, competes boolean, free int"
    if not count:
        return vectors.sparkSession.createDataFrame([], shape)
    most = close_lists_of(count)
    sample = _sample(vectors, count, most, dim)
    centroids = _means(sample, min(most, max(1, len(sample) // 8)), np.random.default_rng(7), unit=True)
    margin = np.float32(_margin(sample, centroids, least))
    bar = least - HALF
    kept = 2 * k
    stored, visited = np.zeros(len(centroids)), np.zeros(len(centroids))
    step = _rows(len(centroids))
    for i in range(0, len(sample), step):
        s = sample[i : i + step] @ centroids.T
        stored += np.bincount(s.argmax(axis=1), minlength=len(centroids))
        visited += np.count_nonzero(s >= s.max(axis=1, keepdims=True) - margin, axis=0)
    d_blocks, q_blocks = (np.maximum(1, np.ceil(x / len(sample) * count / size)).astype(np.int64) for x, size in ((stored, BLOCK_VECTORS), (visited, BLOCK_QUERIES)))
    base = np.concatenate(([0], np.cumsum(d_blocks * q_blocks)))[:-1]

    def part(n: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """A part for each row number, evenly."""
        return ((n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts

    def spread(n: np.ndarray, lists: np.ndarray, own: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows for each part of the other side of a list: which row, its own part, the other's."""
        times = others[lists]
        row = np.repeat(np.arange(len(n)), times)
        return row, part(n, own[lists])[row], np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)

    def sent(n: np.ndarray, x: np.ndarray, block: np.ndarray, row: np.ndarray) -> Iterator[pa.RecordBatch]:
        x = x.astype(np.float16)
        for i in range(0, len(row), 20_000):
            some = row[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(block[i : i + 20_000]), pa.array(n[some]), _binary(x[some])], names=["block", "n", "vec"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n = _matrix(batch.column(1), np.float32, dim), batch.column(0).to_numpy()
            near = np.concatenate([(x[i : i + step] @ centroids.T).argmax(axis=1) for i in range(0, len(x), step)] or [np.empty(0, np.int64)])
            row, own, each = spread(n, near, d_blocks, q_blocks)
            yield from sent(n, x, base[near[row]] + own * q_blocks[near[row]] + each, row)

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, numbers = _matrix(batch.column(1), np.float32, dim), batch.column(0).to_numpy()
            for i in range(0, len(whole), step):
                x, n = whole[i : i + step], numbers[i : i + step]
                s = x @ centroids.T
                who, to = np.nonzero(s >= s.max(axis=1, keepdims=True) - margin)
                row, own, each = spread(n[who], to, q_blocks, d_blocks)
                yield from sent(n, x, base[to[row]] + each * q_blocks[to[row]] + own, who[row])

    def block(queries: pa.Table, stored: pa.Table) -> pa.Table:
        if not queries.num_rows or not stored.num_rows:
            return _HITS.empty_table()
        q, d = (_matrix(t.column("vec"), np.float16, dim).astype(np.float32) for t in (queries, stored))
        return pa.Table.from_batches([_packed(*_within(q, queries.column("n").to_numpy(), d, stored.column("n").to_numpy(), kept, bar))], _HITS)

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([b for b in batches if b.num_rows], _HITS)
        if not table.num_rows:
            return
        other, at = _flat(table.column(1), np.int64)
        n, other, similar = _best_once(np.repeat(table.column(0).to_numpy(), np.diff(at)), other, _flat(table.column(2), np.float32)[0], kept)
        first = np.searchsorted(n, n, "left")
        there = np.searchsorted(n, n, "right") - first
        # Similarities at the last place that counts and at the next, -2 where there are fewer.
        last, after = (np.where(there > p, similar[np.minimum(first + p, len(n) - 1)], np.float32(-2)) for p in (k - 1, k))
        inside = (np.arange(len(n)) - first < k) & (similar - after > 2 * HALF)
        free = k - np.bincount(first, weights=inside, minlength=len(n))[first].astype(np.int32)
        may = last - similar <= 2 * HALF
        columns = (n, other, similar, ~inside | (similar <= least + HALF), ~inside, free.astype(np.int32))
        for i in range(0, len(n), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000][may[i : i + 100_000]]) for c in columns], names=["n", "other", "similarity", "open", "competes", "free"])

    rows, packed_shape = vectors.select("n", "vec"), "n long, others binary, similar binary"
    left, right = (rows.mapInArrow(f, "block long, n long, vec binary").groupBy("block") for f in (asking, listed))
    found = left.cogroup(right).applyInArrow(block, packed_shape).mapInArrow(_merged(kept, _best_once), packed_shape)
    return found.repartition("n").mapInArrow(settled, shape)


def exact(pairs: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """``pairs`` of n and other with their keys, key and other_key, and the similarity of the full vectors. Other columns are kept."""
    one = vectors.select("n", "key", "vec")
    two = vectors.select(F.col("n").alias("other"), F.col("key").alias("other_key"), F.col("vec").alias("other_vec"))
    kept = [c for c in pairs.columns if c not in ("key", "other_key", "similarity")]
    joined = pairs.select(*kept).join(one, "n").join(two, "other").select("vec", "other_vec", *kept, "key", "other_key")
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema[2:]) + ", similarity double"

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_matrix(batch.column(c), np.float32, dim).astype(np.float64) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(np.einsum("ij,ij->i", a, b))], names=[*batch.schema.names[2:], "similarity"])

    return joined.mapInArrow(product, shape)
