"""The twenty graph queries, each over a relation of keys (or over all keys if none is given).

A graph is a mapping of table names to DataFrames (``lithograph.schemas``).
Where a query of one key would return nothing, its set form has no row, except
for counts, which are 0 for every key asked for. Null keys match nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithograph.functions.vector import top_similar
from lithograph.operators import blocks
from lithograph.tables import checkpointed

Graph = Mapping[str, DataFrame]
APPROVED = "APPROVED"


def _among(df: DataFrame, keys: DataFrame | None, column: str) -> DataFrame:
    return df if keys is None else df.join(keys.select(F.col(keys.columns[0]).alias(column)).distinct(), column, "left_semi")


def _symbol_refs(g: Graph, symbol: str) -> DataFrame:
    paths = g["files"].select(F.col("id").alias("file_id"), "path")
    return g["symbols"].join(paths, "file_id").select(F.col("id").alias(symbol), "qualified_name", "kind", "path", "start_line")


def callers_of(g: Graph, symbols: DataFrame | None = None) -> DataFrame:
    """Q1: callee_id and each symbol that calls it, once."""
    calls = _among(g["symbol_calls"].select("caller_id", "callee_id").distinct(), symbols, "callee_id")
    return calls.join(_symbol_refs(g, "caller_id"), "caller_id").select("callee_id", "caller_id", "qualified_name", "kind", "path", "start_line")


def callees_of(g: Graph, symbols: DataFrame | None = None) -> DataFrame:
    """Q2: caller_id and each symbol it calls, once."""
    calls = _among(g["symbol_calls"].select("caller_id", "callee_id").distinct(), symbols, "caller_id")
    return calls.join(_symbol_refs(g, "callee_id"), "callee_id").select("caller_id", "callee_id", "qualified_name", "kind", "path", "start_line")


def symbols_in_file(g: Graph, files: DataFrame | None = None) -> DataFrame:
    """Q3: symbols of each file with their ordinal by start line."""
    rows = _among(g["symbols"], files, "file_id").join(g["files"].select(F.col("id").alias("file_id"), "path"), "file_id")
    ordinal = F.row_number().over(W.partitionBy("file_id").orderBy("start_line", "qualified_name", "id")).alias("ordinal")
    return rows.select("file_id", F.col("id").alias("symbol_id"), "qualified_name", "kind", "path", "start_line", ordinal)


def _touching(g: Graph, files: DataFrame | None) -> DataFrame:
    touches = _among(g["commit_modifies_file"].select("commit_id", "file_id"), files, "file_id")
    commits = g["commits"].select(F.col("id").alias("commit_id"), "sha", "author_id", "message", "committed_at")
    return touches.join(commits, "commit_id")


def _logins(g: Graph) -> DataFrame:
    return g["persons"].select(F.col("id").alias("person_id"), F.col("github_login").alias("login"))


def recent_commits_touching(g: Graph, files: DataFrame | None = None, limit: int = 5) -> DataFrame:
    """Q4: the newest ``limit`` commits of each file with the author's login, if known."""
    newest = F.row_number().over(W.partitionBy("file_id").orderBy(F.desc("committed_at"), "sha"))
    rows = _touching(g, files).withColumn("rank", newest).where(F.col("rank") <= limit)
    return rows.join(_logins(g), F.col("author_id") == F.col("person_id"), "left").select("file_id", "sha", "message", "committed_at", "login", "rank")


def authors_of_file(g: Graph, since: Column, files: DataFrame | None = None) -> DataFrame:
    """Q5: commits since then per file and author; a file touched twice by a commit counts twice."""
    counts = _touching(g, files).where(F.col("committed_at") >= since).groupBy("file_id", F.col("author_id").alias("person_id")).agg(F.count("*").alias("n"))
    return counts.join(_logins(g), "person_id").select("file_id", "person_id", "login", "n")


def reviewers_of_file(g: Graph, since: Column, files: DataFrame | None = None) -> DataFrame:
    """Q6: distinct reviews since then, per file and reviewer, of pull requests whose commits touched the file."""
    reviews = g["reviews"].where(F.col("submitted_at") >= since).select(F.col("id").alias("review_id"), "pull_request_id", F.col("reviewer_id").alias("person_id"))
    touched = _among(g["commit_modifies_file"].select("commit_id", "file_id"), files, "file_id").join(g["pr_contains_commit"], "commit_id").select("pull_request_id", "file_id").distinct()
    counts = touched.join(reviews, "pull_request_id").groupBy("file_id", "person_id").agg(F.count_distinct("review_id").alias("n"))
    return counts.join(_logins(g), "person_id").select("file_id", "person_id", "login", "n")


def similar_prs(g: Graph, queries: DataFrame, k: int = 5, dim: int = 64) -> DataFrame:
    """Q7, Q8: the k most similar pull requests of each query (id, embedding), of any repository, with similarity and rank."""
    found = top_similar(queries, g["pull_requests"].select("id", "embedding"), k, dim)
    prs = g["pull_requests"].select(F.col("id").alias("item_id"), "number", "title", "state", "author_id")
    rows = found.join(prs, "item_id").join(_logins(g), F.col("author_id") == F.col("person_id"), "left")
    return rows.select("query_id", F.col("item_id").alias("pull_request_id"), "number", "title", "state", "login", "similarity", "rank")


def similar_adrs(g: Graph, queries: DataFrame, k: int = 5, dim: int = 64) -> DataFrame:
    """Q9: the k most similar decision records of each query, of any status."""
    found = top_similar(queries, g["adrs"].select("id", "embedding"), k, dim)
    adrs = g["adrs"].select(F.col("id").alias("item_id"), "path", "title", "status")
    return found.join(adrs, "item_id").select("query_id", F.col("item_id").alias("adr_id"), "path", "title", "status", "similarity", "rank")


def files_touched_by_pr(g: Graph, prs: DataFrame | None = None) -> DataFrame:
    """Q10: distinct paths that a pull request's commits touch."""
    contained = _among(g["pr_contains_commit"], prs, "pull_request_id")
    touched = contained.join(g["commit_modifies_file"].select("commit_id", "file_id"), "commit_id").select("pull_request_id", "file_id").distinct()
    return touched.join(g["files"].select(F.col("id").alias("file_id"), "path"), "file_id").select("pull_request_id", "path").distinct()


def revert_commits_touching(g: Graph, since: Column, files: DataFrame | None = None) -> DataFrame:
    """Q11: commits since then whose message begins with 'revert' in any case, with their order from the newest."""
    rows = _touching(g, files).where((F.col("committed_at") >= since) & F.lower("message").startswith("revert"))
    rank = F.row_number().over(W.partitionBy("file_id").orderBy(F.desc("committed_at"), "sha")).alias("rank")
    return rows.join(_logins(g), F.col("author_id") == F.col("person_id"), "left").select("file_id", "sha", "message", "committed_at", "login", rank)


def commit_count_for_file_since(g: Graph, since: Column, files: DataFrame | None = None) -> DataFrame:
    """Q12: touches since then per file, 0 for files without one."""
    keys = g["files"].select(F.col("id").alias("file_id")) if files is None else files.select(F.col(files.columns[0]).alias("file_id"))
    counts = _touching(g, files).where(F.col("committed_at") >= since).groupBy("file_id").agg(F.count("*").alias("n"))
    return keys.distinct().join(counts, "file_id", "left").select("file_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def issue_by_number(g: Graph, keys: DataFrame) -> DataFrame:
    """Q13: repository_id, number with the issue's id, title and state, null where there is none."""
    issues = g["issues"].groupBy("repository_id", "number").agg(F.min_by(F.struct("id", "title", "state"), "id").alias("i"))
    return keys.select("repository_id", "number").distinct().join(issues, ["repository_id", "number"], "left").select("repository_id", "number", F.col("i.id").alias("issue_id"), F.col("i.title").alias("title"), F.col("i.state").alias("state"))


def _each_person(g: Graph, persons: DataFrame | None) -> DataFrame:
    return (g["persons"].select(F.col("id").alias("person_id")) if persons is None else persons.select(F.col(persons.columns[0]).alias("person_id"))).distinct()


def open_prs_assigned_to(g: Graph, persons: DataFrame | None = None) -> DataFrame:
    """Q14: pull requests in the state 'open', so written, that a person wrote."""
    counts = g["pull_requests"].where(F.col("state") == "open").groupBy(F.col("author_id").alias("person_id")).agg(F.count("*").alias("n"))
    return _each_person(g, persons).join(counts, "person_id", "left").select("person_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def review_acceptance_rate(g: Graph, since: Column, persons: DataFrame | None = None) -> DataFrame:
    """Q15: approving and all reviews of a person since then."""
    counts = g["reviews"].where(F.col("submitted_at") >= since).groupBy(F.col("reviewer_id").alias("person_id")).agg(F.count_if(F.upper("state") == APPROVED).alias("approved"), F.count("*").alias("total"))
    zero = F.lit(0).cast("long")
    return _each_person(g, persons).join(counts, "person_id", "left").select("person_id", F.coalesce("approved", zero).alias("approved"), F.coalesce("total", zero).alias("total"))


def last_activity_at(g: Graph, persons: DataFrame | None = None) -> DataFrame:
    """Q16: a person's latest commit or review, null without one."""
    acts = g["commits"].select(F.col("author_id").alias("person_id"), F.col("committed_at").alias("at")).unionByName(g["reviews"].select(F.col("reviewer_id").alias("person_id"), F.col("submitted_at").alias("at")))
    return _each_person(g, persons).join(acts.groupBy("person_id").agg(F.max("at").alias("last_at")), "person_id", "left").select("person_id", "last_at")


def call_graph_overlap_counts(g: Graph, file_sets: DataFrame, since: Column) -> DataFrame:
    """Q17: for sets of files (set_id, file_id), distinct neighbours in the call graph that a person changed since then.

    Neighbours are callees and callers of the files' symbols; symbols of the
    files themselves are neighbours too if they call each other. Neighbours are
    found once per file, and sets meet them in blocks (``blocks``), where those
    that the same people changed are counted together: neither neighbours nor
    people are ever repeated for each set.
    """
    sets = file_sets.select("set_id", "file_id").where(F.col("set_id").isNotNull()).distinct()
    kind = sets.schema["set_id"].dataType.simpleString()
    sets = checkpointed(sets.select(F.col("set_id").cast("string"), "file_id"))
    count, block = blocks.blocks_of(sets, "set_id")
    placed = sets.select(block, "set_id", "file_id")
    near, touched = neighbours_changed(g, sets, since)
    people = checkpointed(_recent(g, since).select("person_id").distinct().withColumn("person", F.monotonically_increasing_id()))
    parts = [
        blocks.part(placed, blocks.FILE, name=F.col("set_id"), file_id=F.col("file_id")),
        blocks.part(blocks.to_all(people, count), blocks.PERSON, key=F.col("person"), name=F.col("person_id").cast("string")),
        *blocks.overlap_parts(near, touched.join(people, "person_id").select("symbol_id", "person"), placed.select("block", "file_id").distinct(), count),
    ]

    def answer(rows: blocks.Rows) -> Iterator[pa.RecordBatch]:
        persons = rows[blocks.PERSON].sort_by("key")
        names = persons.column("name").combine_chunks()
        overlap, files = blocks.Overlap(rows, persons.column("key").to_numpy()), defaultdict(list)
        for one, file in zip(rows[blocks.FILE].column("name").to_pylist(), rows[blocks.FILE].column("file_id").to_pylist(), strict=True):
            files[one].append(file)
        for one, of in files.items():
            n = overlap.of(of)
            there = np.flatnonzero(n)
            if len(there):
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(one, pa.string()), len(there)), names.take(pa.array(there)), pa.array(n[there])], names=["set_id", "person_id", "n"])

    found = blocks.answered(parts, count, answer, "set_id string, person_id string, n long")
    return found.select(F.col("set_id").cast(kind), F.col("person_id").cast(touched.schema["person_id"].dataType), "n")


def _recent(g: Graph, since: Column) -> DataFrame:
    """commit_id, person_id of the commits since then."""
    return g["commits"].where((F.col("committed_at") >= since) & F.col("author_id").isNotNull()).select(F.col("id").alias("commit_id"), F.col("author_id").alias("person_id"))


def neighbours_changed(g: Graph, sets: DataFrame, since: Column) -> tuple[DataFrame, DataFrame]:
    """file_id, symbol_id of the neighbours of each file of ``sets``, and symbol_id, person_id of who changed a symbol since then."""
    commits = _recent(g, since)
    changed = g["commit_modifies_symbol"].select("commit_id", "symbol_id").join(commits, "commit_id").select("symbol_id", "person_id").distinct()
    edges = g["symbol_calls"].select("caller_id", "callee_id").distinct()
    both = edges.select(F.col("caller_id").alias("id"), F.col("callee_id").alias("symbol_id")).unionByName(edges.select(F.col("callee_id").alias("id"), F.col("caller_id").alias("symbol_id")))
    own = _among(g["symbols"].select("id", "file_id").distinct(), sets.select("file_id"), "file_id")
    return both.join(own, "id").select("file_id", "symbol_id").distinct(), changed


def codeowners_for(g: Graph, paths: DataFrame | None = None) -> DataFrame:
    """Q18: touches of all time per path (of any repository) and author."""
    files = _among(g["files"].select(F.col("id").alias("file_id"), "path"), paths, "path")
    touches = g["commit_modifies_file"].select("commit_id", "file_id").join(g["commits"].select(F.col("id").alias("commit_id"), F.col("author_id").alias("person_id")), "commit_id")
    per_file = touches.groupBy("file_id", "person_id").agg(F.count("*").alias("n"))
    counts = per_file.join(files, "file_id").groupBy("path", "person_id").agg(F.sum("n").alias("n"))
    return counts.join(_logins(g), "person_id").select("path", "person_id", "login", "n")


def symbol_by_qualified_name(g: Graph, keys: DataFrame) -> DataFrame:
    """Q19: repository_id, name with the symbol of that qualified name, or else the only one whose name ends in it after a dot.

    Of several exact matches the least id is taken; several that end in the
    name are none. An underscore in a name stands for any character, as in
    LIKE; a percent sign, which no symbol's name has, only for itself. Every
    step is an equi-join: dotted endings are blanked out where a name of their
    length and repository has its underscores, and then meet that name.
    """
    names = keys.select("repository_id", "name").where(F.col("name").isNotNull()).distinct()
    symbols = g["symbols"].select("repository_id", F.col("id").alias("symbol_id"), "qualified_name")
    exact = symbols.groupBy("repository_id", F.col("qualified_name").alias("name")).agg(F.min_by(F.struct("symbol_id", "qualified_name"), "symbol_id").alias("s"))
    hit = names.join(exact, ["repository_id", "name"])
    missed = names.join(hit, ["repository_id", "name"], "left_anti").withColumn("mask", F.regexp_replace("name", "[^_]", "."))
    parts = F.split("qualified_name", r"\.")
    tails = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    endings = symbols.where(F.col("qualified_name").contains(".")).select("repository_id", "symbol_id", "qualified_name", F.explode(tails).alias("ending"))
    masks = missed.select("repository_id", "mask").distinct().withColumn("size", F.length("mask"))
    blanked = F.when(~F.col("mask").contains("_"), F.col("ending")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.col("size")), lambda i: F.when(F.substr("mask", i, F.lit(1)) == "_", "_").otherwise(F.substr("ending", i, F.lit(1)))), ""))
    open_ = endings.withColumn("size", F.length("ending")).where(F.col("size") > 0).join(masks, ["repository_id", "size"]).select("repository_id", "mask", blanked.alias("name"), "symbol_id", "qualified_name")
    matched = missed.join(open_, ["repository_id", "mask", "name"])
    only = matched.groupBy("repository_id", "name").agg(F.count_distinct("symbol_id").alias("n"), F.min(F.struct("symbol_id", "qualified_name")).alias("s")).where(F.col("n") == 1)
    return hit.select("repository_id", "name", "s.symbol_id", "s.qualified_name").unionByName(only.select("repository_id", "name", "s.symbol_id", "s.qualified_name"))


def file_by_path(g: Graph, keys: DataFrame | None = None) -> DataFrame:
    """Q20: repository_id, path with the id of its latest version: the one touched last, else the least id.

    With keys, only their files' touches are looked at.
    """
    files = g["files"].select(F.col("id").alias("file_id"), "repository_id", "path")
    touches = g["commit_modifies_file"].select("commit_id", "file_id")
    if keys is not None:
        files = files.join(keys.select("repository_id", "path").distinct(), ["repository_id", "path"], "left_semi")
        touches = _among(touches, files.select("file_id"), "file_id")
    latest = touches.join(g["commits"].select(F.col("id").alias("commit_id"), "committed_at"), "commit_id").groupBy("file_id").agg(F.max("committed_at").alias("at"))
    order = F.struct(F.col("at").isNull(), -F.unix_micros(F.col("at").cast("timestamp")), "file_id")
    return files.join(latest, "file_id", "left").groupBy("repository_id", "path").agg(F.min_by("file_id", order).alias("file_id"))
