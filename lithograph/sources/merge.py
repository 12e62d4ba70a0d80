"""Merges of rows into tables by key (SC9-SC15), and versions of a table set on shared storage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upserted(current: DataFrame, new: DataFrame, keys: Sequence[str], update: Sequence[str] = ()) -> DataFrame:
    """``current`` with the rows of ``new``: unknown keys are added, of known ones the columns ``update`` are replaced.

    Null keys equal each other. Rows of ``new`` that share a key count once
    (the least one). Columns and order are those of ``current``.
    """
    columns, keys = current.columns, list(keys)
    rest = [c for c in columns if c not in keys]
    fresh = new.select(*columns).groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__new")) if rest else new.select(*columns).distinct().withColumn("__new", F.struct(F.lit(1)))
    old = current.select(*[F.col(k).alias(f"__{k}") for k in keys], F.struct(*columns).alias("__old"))
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = same if on is None else on & same
    joined = old.join(fresh, on, "full_outer")
    out = []
    for c in columns:
        was, now = F.col("__old")[c], F.col(c) if c in keys else F.col("__new")[c]
        pick = F.when(F.col("__old").isNull(), now)
        if c in update:
            pick = pick.when(F.col("__new").isNotNull(), now)
        out.append(pick.otherwise(was).alias(c))
    return joined.select(*out)


def without(current: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """``current`` without the rows whose ``column`` is among the first column of ``gone``; one step of a cascade."""
    return current.join(gone.select(F.col(gone.columns[0]).alias(column)).distinct(), column, "left_anti").select(*current.columns)


def repositories_ensured(current: DataFrame, new: DataFrame) -> DataFrame:
    """Repositories with those of ``new`` that are missing; known ones (owner, name) stay as they are (SC9)."""
    return upserted(current, new, ["owner", "name"])


def bookmarked(repositories: DataFrame, heads: DataFrame) -> DataFrame:
    """Repositories with last_indexed_sha set from ``heads`` (id, head_sha) (SC15)."""
    rows = repositories.join(heads.select("id", "head_sha"), "id", "left")
    return rows.withColumn("last_indexed_sha", F.coalesce("head_sha", "last_indexed_sha")).select(*repositories.columns)


#: Versions after which the tables are written whole again.
COMPACT = 16


def save_changes(changes: Mapping[str, tuple[DataFrame, DataFrame]], root: str, version: int) -> None:
    """A version below ``root`` as what it changes: per table the keys that went and the rows that came. Older versions stay readable."""
    for name, (gone, new) in changes.items():
        gone.write.mode("overwrite").parquet(f"{root}/v{version:08d}/{name}/gone")
        new.write.mode("overwrite").parquet(f"{root}/v{version:08d}/{name}/new")


def save_whole(tables: Mapping[str, DataFrame], root: str, version: int) -> None:
    """The tables of a version written whole, so that readers of later versions need no change before it."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/whole{version:08d}/{name}")


def open_version(spark: SparkSession, root: str, version: int, keys: Mapping[str, Sequence[str]]) -> dict[str, DataFrame]:
    """The tables of a version: those last written whole, and the changes since."""
    return open_since(spark, root, version // COMPACT * COMPACT, version, keys)


def open_since(spark: SparkSession, root: str, base: int, version: int, keys: Mapping[str, Sequence[str]]) -> dict[str, DataFrame]:
    """The tables of a version from those of ``base``, written whole (or none for 0), and all changes since.

    A row counts unless its key went in a later version than the row came, so
    one join per table serves however many versions there are.
    """
    out = {}
    for name, key in keys.items():
        parts = [spark.read.parquet(f"{root}/whole{base:08d}/{name}").withColumn("__came", F.lit(base))] if base else []
        parts += [spark.read.parquet(f"{root}/v{v:08d}/{name}/new").withColumn("__came", F.lit(v)) for v in range(base + 1, version + 1)]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        gone = [spark.read.parquet(f"{root}/v{v:08d}/{name}/gone").select(*key, F.lit(v).alias("__went")) for v in range(base + 1, version + 1)]
        for n, part in enumerate(gone):
            gone[0] = part if not n else gone[0].unionByName(part)
        if gone:
            rows = rows.join(gone[0].groupBy(*key).agg(F.max("__went").alias("__went")), list(key), "left").where(F.col("__went").isNull() | (F.col("__went") <= F.col("__came")))
        out[name] = rows.drop("__came", "__went")
    return out


def files_recorded(current: DataFrame, seen: DataFrame) -> DataFrame:
    """Files (repository_id, path, content_hash) with those of ``seen`` added; of known ones only last_seen_sha moves on (SC10)."""
    return upserted(current, seen, ["repository_id", "path", "content_hash"], ["last_seen_sha"])


def symbols_recorded(current: DataFrame, seen: DataFrame) -> DataFrame:
    """Symbols (file_id, qualified_name, ast_hash) with those of ``seen`` added; known ones get the new signature and lines (SC12)."""
    return upserted(current, seen, ["file_id", "qualified_name", "ast_hash"], ["signature", "start_line", "end_line"])
