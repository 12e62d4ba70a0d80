"""Context packets of pull requests: related changes, decisions, history, linked issues and risk notes.

All functions take relations of pull requests and answer them together; one
pull request is a relation of one row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithograph.functions import text
from lithograph.functions.vector import blended, jaccard
from lithograph.operators import graph as q

POOL, RELATED, FLOOR, SAME_AUTHOR_OVERLAP = 10, 3, 0.15, 0.8
ADRS, PER_FILE, IN_ALL = 5, 5, 15
WINDOW_DAYS, CHURN, LARGE = 30, 20, 500


def related_prs(g: q.Graph, prs: DataFrame, k: int = RELATED, pool: int = POOL, dim: int = 64) -> DataFrame:
    """query_id and its related pull requests with similarity, overlap, score and rank.

    The pool of the most similar ones comes first; the pull request itself,
    those of its author with little overlap and low scores then drop out, so
    fewer than ``k`` are usual. ``prs`` has id, number, author_id, embedding.
    """
    # The pull request itself may be in the pool; it takes a place there and is dropped after.
    found = q.similar_prs(g, prs.select("id", "embedding"), pool, dim)
    compared = found.select("pull_request_id").unionByName(prs.select(F.col("id").alias("pull_request_id")))
    paths = q.files_touched_by_pr(g, compared).groupBy("pull_request_id").agg(F.collect_set("path").alias("paths"))
    asked = prs.select(F.col("id").alias("query_id"), F.col("number").alias("query_number"), F.col("author_id").alias("query_author")).join(paths.select(F.col("pull_request_id").alias("query_id"), F.col("paths").alias("query_paths")), "query_id", "left")
    authors = g["pull_requests"].select(F.col("id").alias("pull_request_id"), "author_id")
    rows = found.join(asked, "query_id").join(paths, "pull_request_id", "left").join(authors, "pull_request_id")
    rows = rows.withColumn("overlap", jaccard(F.col("query_paths"), F.col("paths"))).withColumn("score", blended(F.col("similarity"), F.col("overlap")))
    own = (F.col("query_number") == F.col("number")) | (F.col("author_id").eqNullSafe(F.col("query_author")) & F.col("author_id").isNotNull() & (F.col("overlap") < SAME_AUTHOR_OVERLAP))
    kept = rows.where(~own & (F.col("score") >= FLOOR)).withColumnRenamed("rank", "pool_rank")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "pool_rank"))
    return kept.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "pull_request_id", "number", "title", "similarity", "overlap", "score", "rank")


def relevant_adrs(g: q.Graph, prs: DataFrame, k: int = ADRS, dim: int = 64) -> DataFrame:
    """Accepted decision records with a title among the ``k`` most similar ones; the rest of the k is not filled up."""
    found = q.similar_adrs(g, prs.select("id", "embedding"), k, dim)
    return found.where((F.col("status") == "accepted") & (F.trim("title") != "")).select("query_id", "adr_id", "path", "title", "similarity", "rank")


def recent_history(g: q.Graph, changed: DataFrame, per_file: int = PER_FILE, in_all: int = IN_ALL) -> DataFrame:
    """The newest commits of each changed file, at most ``in_all`` per pull request in the order of its files.

    ``changed`` has pull_request_id, ordinal, repository_id, path. Unknown
    paths are skipped; a commit appears once for each file it touched.
    """
    files = changed.select("pull_request_id", "ordinal", "repository_id", "path").join(q.file_by_path(g, changed), ["repository_id", "path"])
    commits = q.recent_commits_touching(g, files.select("file_id"), per_file)
    rows = files.join(commits, "file_id").withColumn("place", F.row_number().over(W.partitionBy("pull_request_id").orderBy("ordinal", "rank")))
    return rows.where(F.col("place") <= in_all).select("pull_request_id", "path", "sha", text.first_line(F.col("message")).alias("title"), "login", "committed_at", "place")


def linked_issues(g: q.Graph, prs: DataFrame) -> DataFrame:
    """C4: references in each body with title and state of those known; unknown ones stay bare."""
    refs = prs.select(F.col("id").alias("pull_request_id"), "repository_id", F.posexplode(text.issue_refs(F.col("body"))).alias("place", "ref")).select("pull_request_id", "repository_id", "place", "ref.*")
    known = g["issues"].groupBy("repository_id", "number").agg(F.min_by(F.struct("title", "state"), "id").alias("i"))
    rows = refs.join(known, ["repository_id", "number"], "left")
    return rows.select("pull_request_id", "place", "kind", "identifier", "number", F.col("i.title").alias("title"), F.col("i.state").alias("state"))


def risk_notes(g: q.Graph, changed: DataFrame, now: Column, churn: int = CHURN, large: int = LARGE, days: int = WINDOW_DAYS) -> DataFrame:
    """pull_request_id, place, note: a large diff first, then per file reverts and churn of the last ``days`` days.

    ``changed`` has pull_request_id, ordinal, repository_id, path, patch. Bars
    are strict: exactly ``large`` lines or ``churn`` commits give no note.
    """
    since = now - F.make_dt_interval(F.lit(days))
    sizes = changed.groupBy("pull_request_id").agg(F.sum(text.diff_lines(F.col("patch"))).alias("lines"), F.count("*").alias("files")).where(F.col("lines") > large)
    # The sentences of the notes.
    big = sizes.select("pull_request_id", F.lit(-1).alias("ordinal"), F.lit(0).alias("kind"), F.format_string("Large PR: the diff touches %d lines across %d file(s).", "lines", "files").alias("note"))
    files = changed.select("pull_request_id", "ordinal", "repository_id", "path").join(q.file_by_path(g, changed), ["repository_id", "path"])
    asked = files.select("file_id")
    reverts = q.revert_commits_touching(g, since, asked).groupBy("file_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", text.short_sha(F.col("sha")).alias("s"))))), lambda x: x["s"]), ", ").alias("shas"))
    reverted = files.join(reverts, "file_id").select("pull_request_id", "ordinal", F.lit(1).alias("kind"), F.format_string(f"Recently reverted: %s was touched by %d revert commit(s) in the last {days} days (%s).", "path", "n", "shas").alias("note"))
    counts = q.commit_count_for_file_since(g, since, asked).where(F.col("n") > churn)
    churned = files.join(counts, "file_id").select("pull_request_id", "ordinal", F.lit(2).alias("kind"), F.format_string(f"High churn: %s had %d commits in the last {days} days.", "path", "n").alias("note"))
    notes = big.unionByName(reverted).unionByName(churned)
    return notes.withColumn("place", F.row_number().over(W.partitionBy("pull_request_id").orderBy("ordinal", "kind"))).select("pull_request_id", "place", "note")


def _listed(rows: DataFrame, key: str, place: str, name: str, *columns: str) -> DataFrame:
    packed = F.array_sort(F.collect_list(F.struct(place, F.struct(*columns).alias("x"))))
    return rows.groupBy(F.col(key).alias("pull_request_id")).agg(F.transform(packed, lambda x: x["x"]).alias(name))


def packets(g: q.Graph, prs: DataFrame, changed: DataFrame, now: Column, dim: int = 64, churn: int = CHURN) -> DataFrame:
    """pull_request_id and packet (JSON): the five sections and a narrative; empty sections are left out."""
    sections = {
        "related_prs": _listed(related_prs(g, prs, dim=dim), "query_id", "rank", "related_prs", "number", "title"),
        "related_adrs": _listed(relevant_adrs(g, prs, dim=dim), "query_id", "rank", "related_adrs", "path", "title"),
        "recent_commits": _listed(recent_history(g, changed), "pull_request_id", "place", "recent_commits", "sha", "title", "path", "login"),
        "linked_issues": _listed(linked_issues(g, prs), "pull_request_id", "place", "linked_issues", "kind", "identifier", "title", "state"),
        "risk_notes": _listed(risk_notes(g, changed, now, churn), "pull_request_id", "place", "risk_notes", "note"),
    }
    out = prs.select(F.col("id").alias("pull_request_id")).distinct()
    for section in sections.values():
        out = out.join(section, "pull_request_id", "left")
    sizes = [F.coalesce(F.size(n), F.lit(0)) for n in sections]
    out = out.withColumn("risk_notes", F.transform("risk_notes", lambda x: x["note"])).withColumn("narrative", F.nullif(text.fallback_narrative(*sizes), F.lit("")))
    return out.select("pull_request_id", F.to_json(F.struct(*sections, "narrative")).alias("packet"))
