"""Vector functions as column expressions, and exact search of a stated set of queries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items and queries of a block.
BLOCK_ITEMS, BLOCK_QUERIES = 20_000, 5_000


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector can be compared: not null, of ``dim`` numbers, and not all zero."""
    return F.coalesce((F.size(vector) == dim) & F.exists(vector, lambda x: x != 0), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    """The inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """The cosine similarity; null if either vector is null, all zero, or the lengths differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; 0 if both are empty or null."""
    one, two = F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))
    whole = F.size(F.array_union(one, two))
    return F.when(whole == 0, 0.0).otherwise(F.size(F.array_intersect(one, two)) / whole)


def blended(similarity: Column, overlap: Column) -> Column:
    """Score of a related change: 0.6 of the similarity above zero and 0.4 of the overlap."""
    return F.lit(0.6) * F.greatest(similarity, F.lit(0.0)) + F.lit(0.4) * overlap


def top_similar(queries: DataFrame, items: DataFrame, k: int, dim: int, key: str = "id", vector: str = "embedding", scope: Sequence[str] = ()) -> DataFrame:
    """query_id, item_id, similarity, rank: the k most similar items of each query, exactly.

    Queries and items meet in blocks: items are spread over blocks, each query
    goes to every one, a block keeps its best k, and the blocks' results are
    merged. ``scope`` names columns that must be equal. Unusable vectors take
    no part; ties go to the smaller item key.
    """
    scope = list(scope)
    one = queries.select(*scope, F.col(key).alias("query_id"), F.col(vector).cast("array<double>").alias("q")).where(usable(F.col("q"), dim))
    two = items.select(*scope, F.col(key).alias("item_id"), F.col(vector).cast("array<double>").alias("v")).where(usable(F.col("v"), dim))
    count = two.groupBy(*scope).agg(F.greatest(F.ceil(F.count("*") / BLOCK_ITEMS), F.lit(1)).cast("int").alias("blocks"))
    spread = lambda df: df.join(count, scope) if scope else df.withColumn("blocks", count.select("blocks").scalar())
    two = spread(two).withColumn("block", F.pmod(F.xxhash64("item_id"), F.col("blocks")).cast("int")).drop("blocks")
    one = spread(one).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    kind_q, kind_i = one.schema["query_id"].dataType.simpleString(), two.schema["item_id"].dataType.simpleString()

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": left.column("query_id").slice(0, 0), "item_id": right.column("item_id").slice(0, 0), "similarity": pa.array([], pa.float64())})
        right = right.sort_by("item_id")
        v = right.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        q = left.column("q").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        q = q / np.linalg.norm(q, axis=1, keepdims=True)
        rows, cols, values = [], [], []
        for start in range(0, len(q), 256):
            # Rounding makes equal vectors equal whatever the order of additions.
            s = np.round(q[start : start + 256] @ v.T, 9)
            keep = min(k, s.shape[1])
            # The k-th value and all its equals, then the smaller keys first: ties are settled the same way in every block.
            bar = -np.partition(-s, keep - 1, axis=1)[:, keep - 1]
            r, c = np.nonzero(s >= bar[:, None])
            order = np.lexsort((c, -s[r, c], r))
            r, c = r[order], c[order]
            first = np.arange(len(r)) - np.searchsorted(r, r, "left") < keep
            rows.append(start + r[first]), cols.append(c[first]), values.append(s[r[first], c[first]])
        return pa.table({"query_id": left.column("query_id").take(pa.array(np.concatenate(rows))), "item_id": right.column("item_id").take(pa.array(np.concatenate(cols))), "similarity": pa.array(np.concatenate(values))})

    groups = [*scope, "block"]
    found = one.groupBy(*groups).cogroup(two.groupBy(*groups)).applyInArrow(search, f"query_id {kind_q}, item_id {kind_i}, similarity double")
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("d"), "item_id"))), 1, k).alias("best"))
    rows = best.select("query_id", F.posexplode("best").alias("at", "b"))
    return rows.select("query_id", F.col("b.item_id").alias("item_id"), (-F.col("b.d")).alias("similarity"), (F.col("at") + 1).alias("rank"))
