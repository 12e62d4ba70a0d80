"""The queries on general data problems: rolling totals (p1) and heavy keys (p6)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithograph.operators import dense_counts, rolling
from lithograph.tables import load, once

YEAR = 2024
WINDOWS = (7, 30)
HEAVY_SHARE = 0.01


def commits_per_path_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repository_id, path, day, total: distinct commits of 2024 that touched any version of the path."""
    commits = load(spark, sf_dir, "commits").select(F.col("id").alias("commit_id"), F.to_date("committed_at").alias("day")).where(F.year("day") == YEAR)
    touches = load(spark, sf_dir, "commit_modifies_file").select("commit_id", "file_id")
    files = load(spark, sf_dir, "files").select(F.col("id").alias("file_id"), "repository_id", "path").dropna().distinct()
    return (
        touches.join(commits, "commit_id").join(files, "file_id")
        .select("repository_id", "path", "day", "commit_id").distinct()
        .groupBy("repository_id", "path", "day").agg(F.count("*").alias("total"))
    )


def _trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["repository_id", "path"]
    trees = rolling.segment_trees(commits_per_path_day(spark, sf_dir), keys)
    return rolling.by_day(rolling.trailing_totals(trees, keys, WINDOWS, date(YEAR, 12, 31)), keys, WINDOWS)


def p1_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each path and day from its first commit to the year's end: commits and daily average of the trailing 7 and 30 days."""
    return _trailing(spark, sf_dir)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths and days on which the last 7 days are quiet though the last 30 saw at least 0.2 commits a day."""
    quiet = _trailing(spark, sf_dir).where((F.col("total_7") == 0) & (F.col("total_30") >= 6))
    return quiet.select("repository_id", "path", F.date_format("day", "yyyy-MM-dd").alias("quiet_date"))


def calls_per_callee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """callee_id, n: distinct call ids per callee."""
    calls = load(spark, sf_dir, "symbol_calls").select("id", "callee_id").where(F.col("id").isNotNull())
    return dense_counts.key_counts(once(calls, "id"), ["callee_id"])


def commits_per_file_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, author_id, n: distinct commits with an author per file and author."""
    authors = once(load(spark, sf_dir, "commits").select(F.col("id").alias("commit_id"), "author_id").where(F.col("author_id").isNotNull()), "commit_id")
    touches = load(spark, sf_dir, "commit_modifies_file").select("commit_id", "file_id").dropna().distinct()
    return dense_counts.key_counts(touches.join(authors, "commit_id"), ["file_id", "author_id"])


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All per-key results: field_name, key_id, author_id (null for callees), n."""
    calls = calls_per_callee(spark, sf_dir).select(F.lit("symbol_calls.callee_id").alias("field_name"), F.col("callee_id").alias("key_id"), F.lit(None).cast("string").alias("author_id"), "n")
    files = commits_per_file_author(spark, sf_dir).select(F.lit("commit_modifies_file.file_id").alias("field_name"), F.col("file_id").alias("key_id"), "author_id", "n")
    return calls.unionByName(files)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field_name, key_id of each key with at least 1 % of the rows of its field."""
    calls = dense_counts.heavy_keys(calls_per_callee(spark, sf_dir), HEAVY_SHARE).select(F.lit("symbol_calls.callee_id").alias("field_name"), F.col("callee_id").alias("key_id"))
    files = commits_per_file_author(spark, sf_dir).groupBy("file_id").agg(F.sum("n").alias("n"))
    files = dense_counts.heavy_keys(files, HEAVY_SHARE).select(F.lit("commit_modifies_file.file_id").alias("field_name"), F.col("file_id").alias("key_id"))
    return calls.unionByName(files)


QUERIES = {"p1_found": p1_found, "p1_rolling": p1_rolling, "p6_found": p6_found, "p6_counts": p6_counts}

_DAILY = """
touch AS (
  SELECT DISTINCT f.repository_id, f.path, CAST(c.committed_at AS DATE) AS day, c.id AS commit_id
  FROM commit_modifies_file m JOIN commits c ON c.id = m.commit_id JOIN files f ON f.id = m.file_id
  WHERE year(c.committed_at) = 2024),
daily AS (SELECT repository_id, path, day, count(*) AS n FROM touch GROUP BY ALL),
span AS (SELECT repository_id, path, min(day) AS first_day FROM daily GROUP BY ALL),
calendar AS (
  SELECT repository_id, path, CAST(unnest(generate_series(first_day, DATE '2024-12-31', INTERVAL 1 DAY)) AS DATE) AS day FROM span),
filled AS (
  SELECT repository_id, path, day, coalesce(n, 0) AS n FROM calendar LEFT JOIN daily USING (repository_id, path, day)),
rolled AS (
  SELECT repository_id, path, day,
    CAST(sum(n) OVER (PARTITION BY repository_id, path ORDER BY day ROWS 6 PRECEDING) AS BIGINT) AS total_7,
    CAST(sum(n) OVER (PARTITION BY repository_id, path ORDER BY day ROWS 29 PRECEDING) AS BIGINT) AS total_30
  FROM filled)
"""
_COUNTS = """
calls AS (SELECT callee_id, count(DISTINCT id) AS n FROM symbol_calls GROUP BY 1),
touch AS (
  SELECT DISTINCT m.commit_id, m.file_id, c.author_id
  FROM commit_modifies_file m JOIN commits c ON c.id = m.commit_id WHERE c.author_id IS NOT NULL),
authors AS (SELECT file_id, author_id, count(*) AS n FROM touch GROUP BY ALL),
touched AS (SELECT file_id, count(*) AS n FROM touch GROUP BY ALL)
"""
ORACLE = {
    "p1_rolling": f"WITH {_DAILY} SELECT repository_id, path, day, total_7, total_30, total_7 / 7.0 AS average_7, total_30 / 30.0 AS average_30 FROM rolled",
    "p1_found": f"WITH {_DAILY} SELECT repository_id, path, strftime(day, '%Y-%m-%d') AS quiet_date FROM rolled WHERE total_7 = 0 AND total_30 >= 6",
    "p6_counts": f"""WITH {_COUNTS}
SELECT 'symbol_calls.callee_id' AS field_name, callee_id AS key_id, CAST(NULL AS VARCHAR) AS author_id, n FROM calls
UNION ALL SELECT 'commit_modifies_file.file_id', file_id, author_id, n FROM authors""",
    "p6_found": f"""WITH {_COUNTS}
SELECT 'symbol_calls.callee_id' AS field_name, callee_id AS key_id FROM calls WHERE n >= 0.01 * (SELECT sum(n) FROM calls)
UNION ALL SELECT 'commit_modifies_file.file_id', file_id FROM touched WHERE n >= 0.01 * (SELECT sum(n) FROM touched)""",
}
