"""Review payloads: findings of all analyses, context and reviewers in one JSON document each."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithograph.functions.text import summary_text

# Severities from the gravest; others come last.
SEVERITIES = ("blocking", "warning", "info")
TIMEOUT_S = 30.0


def severity_rank(severity: Column) -> Column:
    """Place of a severity; unknown and null ones come last."""
    out = F.lit(len(SEVERITIES))
    for rank, name in enumerate(SEVERITIES):
        out = F.when(severity == name, rank).otherwise(out)
    return out


def check_conclusion(findings: DataFrame) -> DataFrame:
    """pull_request_id, conclusion: 'action_required' if any finding is blocking, else 'neutral'."""
    blocking = F.coalesce(F.bool_or(F.col("severity") == "blocking"), F.lit(False))
    return findings.groupBy("pull_request_id").agg(F.when(blocking, "action_required").otherwise("neutral").alias("conclusion"))


def reviewer_order(reviewers: DataFrame) -> DataFrame:
    """``reviewers`` with place: those with a rank first, by it, the rest by score (C14)."""
    order = [F.col("rank").isNull(), F.col("rank"), F.desc(F.coalesce("score", F.lit(0.0))), F.col("login")]
    return reviewers.withColumn("place", F.row_number().over(W.partitionBy("pull_request_id").orderBy(*order)))


def payloads(prs: DataFrame, findings: DataFrame, context: DataFrame | None = None, reviewers: DataFrame | None = None, failed: DataFrame | None = None) -> DataFrame:
    """pull_request_id and review (JSON) of every pull request of ``prs``.

    ``findings`` as of conflicts; those of the kind 'reviewer_suggestion' are
    left out, equal ones (kind, title, path) count once, and they are ordered
    by severity and title. ``context`` has packet (JSON), ``reviewers`` login,
    score, rank, rationale, ``failed`` agent_name. Empty parts have no key.
    """
    kept = findings.where(F.col("kind") != "reviewer_suggestion")
    once = kept.withColumn("__n", F.row_number().over(W.partitionBy("pull_request_id", "kind", "title", "path").orderBy("emitted", "detail"))).where(F.col("__n") == 1)
    where = F.when(F.col("path").isNotNull(), F.array(F.struct("path", "line")))
    related = F.when(F.size("related_symbols") > 0, F.col("related_symbols"))
    body = F.struct("severity", "kind", "title", "detail", where.alias("locations"), related.alias("related_symbols"), F.nullif("suggested_action", F.lit("")).alias("suggested_action"))
    packed = F.array_sort(F.collect_list(F.struct(severity_rank(F.col("severity")).alias("r"), "title", "emitted", body.alias("x"))))
    grouped = once.groupBy("pull_request_id").agg(F.transform(packed, lambda x: x["x"]).alias("conflicts"), *[F.count_if(F.col("severity") == s).alias(f"__{s}") for s in SEVERITIES])
    out = prs.select(F.col("id").alias("pull_request_id")).distinct().join(grouped, "pull_request_id", "left")
    zero = F.lit(0).cast("long")
    parts = [summary_text(*[F.coalesce(f"__{s}", zero) for s in SEVERITIES]).alias("summary"), F.coalesce("conflicts", F.from_json(F.lit("[]"), grouped.schema["conflicts"].dataType)).alias("conflicts")]
    if context is not None:
        out = out.join(context.select("pull_request_id", F.parse_json("packet").alias("context")), "pull_request_id", "left")
        parts.append(F.col("context"))
    if reviewers is not None:
        row = F.struct("login", "score", "rank", "rationale")
        lists = reviewer_order(reviewers).groupBy("pull_request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", row.alias("x")))), lambda x: x["x"]).alias("suggested_reviewers"))
        out = out.join(lists, "pull_request_id", "left")
        parts.append(F.col("suggested_reviewers"))
    if failed is not None:
        out = out.join(failed.groupBy("pull_request_id").agg(F.sort_array(F.collect_set("agent_name")).alias("failed_agents")), "pull_request_id", "left")
        parts.append(F.col("failed_agents"))
    return out.select("pull_request_id", F.to_json(F.struct(*parts)).alias("review"))


@dataclass(frozen=True)
class Outcome:
    """What came of one analysis: its result, or why there is none."""

    name: str
    result: object | None
    error: str | None
    seconds: float


def coordinate(analyses: Mapping[str, Callable[[], object]], timeout: float = TIMEOUT_S) -> list[Outcome]:
    """Runs independent analyses side by side; one that fails or is late does not stop the others.

    Results are in the order of ``analyses``. Spark jobs of a late analysis are
    not waited for.
    """
    pool = ThreadPoolExecutor(max_workers=max(1, len(analyses)))
    begun = time.monotonic()
    futures = {name: pool.submit(run) for name, run in analyses.items()}
    outcomes = []
    for name, future in futures.items():
        try:
            outcomes.append(Outcome(name, future.result(max(0.0, timeout - (time.monotonic() - begun))), None, time.monotonic() - begun))
        except Late:
            future.cancel()
            outcomes.append(Outcome(name, None, f"no result within {timeout:g} s", time.monotonic() - begun))
        except Exception as error:  # noqa: BLE001 - any failure of one analysis is kept apart from the others
            outcomes.append(Outcome(name, None, repr(error), time.monotonic() - begun))
    pool.shutdown(wait=False, cancel_futures=True)
    return outcomes
