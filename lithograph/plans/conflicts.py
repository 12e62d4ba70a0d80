"""Conflicts of pull requests with callers, decisions and conventions (C11), up to and after a judge.

What needs judgement is a relation of questions; a judge is a function from
that relation to verdicts and is passed in. Without one, only what can be
decided by rule is found.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithograph.functions.changes import VISIBLE, change, status_return_drift
from lithograph.operators import graph as q
from lithograph.sources.tree import caller_snippets
from lithograph.tables import checkpointed

CALLERS, ADRS = 10, 5
FINDING = "pull_request_id string, emitted long, kind string, severity string, title string, detail string, path string, line int, related_symbols array<string>, suggested_action string"
#: From questions to verdicts: adds is_conflict, severity, title, detail, suggested_action.
Judge = Callable[[DataFrame], DataFrame]


def changed_symbols(symbols: DataFrame) -> DataFrame:
    """Changed symbols with how they changed; one without sources is judged by its change_kind."""
    rows = symbols.withColumn("change", change(F.col("old_source"), F.col("new_source")))
    plain = F.when(F.col("change_kind").isin("added", "deleted", "body_only"), F.col("change_kind")).otherwise(F.lit("signature_change"))
    return rows.withColumn("classification", F.coalesce(F.col("change.classification"), plain))


def semantic_questions(g: q.Graph, symbols: DataFrame, limit: int = CALLERS, sources: DataFrame | None = None) -> DataFrame:
    """For every change that callers can notice, its first callers by name, at most ``limit``.

    ``symbols`` has pull_request_id, ordinal, repository_id, qualified_name,
    change_kind, old_source, new_source, file_path. With ``sources``
    (repository_id, path, content), each caller comes with its text.
    """
    # The names to look up and the questions both come from these rows: sources are compared once.
    noticed = checkpointed(changed_symbols(symbols).where(F.col("classification").isin(*VISIBLE)))
    found = q.symbol_by_qualified_name(g, noticed.select("repository_id", F.col("qualified_name").alias("name")))
    rows = noticed.join(found.select("repository_id", F.col("name").alias("qualified_name"), "symbol_id"), ["repository_id", "qualified_name"])
    callers = q.callers_of(g, found.select("symbol_id")).select(F.col("callee_id").alias("symbol_id"), "caller_id", F.col("qualified_name").alias("caller_name"), F.col("path").alias("caller_path"), F.col("start_line").alias("caller_line"))
    # A symbol's first callers are told before they meet its changes, so a hub is not repeated for each pull request.
    callers = callers.withColumn("first", F.row_number().over(W.partitionBy("symbol_id").orderBy("caller_name", "caller_id"))).where(F.col("first") <= limit).drop("first")
    asked = rows.join(callers, "symbol_id").withColumn("place", F.row_number().over(W.partitionBy("pull_request_id", "ordinal").orderBy("caller_name", "caller_id")))
    asked = asked.where(F.col("place") <= limit)
    shown = ["pull_request_id", "ordinal", "qualified_name", "file_path", "classification", "change", "caller_id", "caller_name", "caller_path", "caller_line", "place"]
    if sources is None:
        return asked.select(*shown)
    extent = g["symbols"].select(F.col("id").alias("caller_id"), "start_line", "end_line", "signature")
    return caller_snippets(asked.withColumn("path", F.col("caller_path")).join(extent, "caller_id"), sources).select(*shown, "snippet")


def architectural_questions(g: q.Graph, prs: DataFrame, k: int = ADRS, dim: int = 64) -> DataFrame:
    """The accepted ones among the k most similar decision records of each pull request (id, embedding)."""
    found = q.similar_adrs(g, prs, k, dim).where(F.col("status") == "accepted")
    return found.select(F.col("query_id").alias("pull_request_id"), "adr_id", "path", "title", "similarity", F.col("rank").alias("place"))


def convention_findings(files: DataFrame, module: str) -> DataFrame:
    """Warnings for new functions that report failure by a status tuple in a module of typed errors."""
    drift = status_return_drift(files, module)
    return drift.select(
        F.col("key").alias("pull_request_id"), F.lit(2_000_000_000).cast("long").alias("emitted"), F.lit("convention").alias("kind"), F.lit("warning").alias("severity"),
        F.concat(F.lit("Status tuple in "), "function_name").alias("title"), F.concat("path", F.lit("::"), "function_name", F.lit(" signals failure by "), "annotation", F.lit(", where its module raises typed errors.")).alias("detail"),
        "path", F.lit(None).cast("int").alias("line"), F.array("function_name").alias("related_symbols"), F.lit("Raise a typed error of the module instead.").alias("suggested_action"),
    )


def judged_findings(questions: DataFrame, judge: Judge, kind: str, path: str, line: str | None = None, symbol: str | None = None) -> DataFrame:
    """Findings of the questions whose verdict is a conflict. Callers that break are blocking; decisions never are."""
    verdicts = judge(questions).where(F.col("is_conflict"))
    severity = F.lit("blocking") if kind == "semantic" else F.when(F.col("severity").isin("warning", "info"), F.col("severity")).otherwise(F.lit("warning"))
    emitted = (F.col("ordinal").cast("long") if "ordinal" in questions.columns else F.lit(1_000_000_000).cast("long")) * 100 + F.col("place")
    return verdicts.select(
        "pull_request_id", emitted.alias("emitted"), F.lit(kind).alias("kind"), severity.alias("severity"), "title", "detail", F.col(path).alias("path"),
        (F.col(line) if line else F.lit(None)).cast("int").alias("line"), (F.array(symbol) if symbol else F.array().cast("array<string>")).alias("related_symbols"), "suggested_action",
    )


def asked_twice(judge: Judge) -> Judge:
    """``judge``, asked once more if it fails; its verdicts are kept, so that what they decide is not asked for again."""

    def twice(questions: DataFrame) -> DataFrame:
        kept = checkpointed(questions)
        try:
            return checkpointed(judge(kept))
        except Exception:  # noqa: BLE001 - whatever a judge fails with, it is asked again once
            return checkpointed(judge(kept))

    return twice


def first_of_each(findings: DataFrame) -> DataFrame:
    """One finding per pull request, kind, title and path: the one emitted first."""
    place = F.row_number().over(W.partitionBy("pull_request_id", "kind", "title", "path").orderBy("emitted", "detail"))
    return findings.withColumn("__n", place).where(F.col("__n") == 1).drop("__n")


def conflicts(g: q.Graph, prs: DataFrame, symbols: DataFrame, files: DataFrame, module: str, judge_callers: Judge | None = None, judge_decisions: Judge | None = None, dim: int = 64) -> DataFrame:
    """All findings of all pull requests (FINDING)."""
    found = convention_findings(files, module)
    if judge_callers:
        found = found.unionByName(judged_findings(semantic_questions(g, symbols), judge_callers, "semantic", "caller_path", "caller_line", "qualified_name"))
    if judge_decisions:
        found = found.unionByName(judged_findings(architectural_questions(g, prs, dim=dim), judge_decisions, "architectural", "path"))
    return first_of_each(found)
