"""Text functions, extraction and builds over whole tables, and the same as SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithograph.functions import text as tx
from lithograph.functions.extraction import extracted
from lithograph.operators import graph as q
from lithograph.plans import conflicts, context, payload, reviewers
from lithograph.plans.queries import CHURN, asked, changed_files, now, with_login
from lithograph.sources.merge import upserted
from lithograph.sources.views import graph, with_views
from lithograph.tables import checkpointed, once


def _sources(g: q.Graph) -> DataFrame:
    """repository_id, path, content of one version of each path: that of ``file_by_path``."""
    texts = once(g["source_texts"].select("file_id", "content"), "file_id")
    return q.file_by_path(g).join(texts, "file_id").select("repository_id", "path", "content")


def _versions(g: q.Graph) -> DataFrame:
    """file_id, repository_id, path, content of every text, each version of a path; the middle two are null for a file that isn't known."""
    files = once(g["files"].select(F.col("id").alias("file_id"), "repository_id", "path"), "file_id")
    return once(g["source_texts"].select("file_id", "content"), "file_id").join(files, "file_id", "left")


def _exploded(column: str) -> Callable[[q.Graph], DataFrame]:
    return lambda g: extracted(_versions(g)).select("file_id", "repository_id", "path", F.explode(column).alias("x")).select("file_id", "repository_id", "path", "x.*")


def _bodies(g: q.Graph) -> DataFrame:
    return g["adrs"].select("id", "path", "body").where(F.col("body").isNotNull())


def _upserted(g: q.Graph) -> DataFrame:
    """Issues known and issues seen, which overlap in part: unknown numbers are added, of known ones only the state is replaced."""
    issues = g["issues"].select(F.when(F.col("number") % 7 > 0, F.col("repository_id")).alias("repository_id"), F.when(F.col("number") % 5 > 0, F.col("number")).alias("number"))
    issues = issues.distinct()
    current = issues.where(F.coalesce(F.col("number") % 3, F.lit(1)) > 0).withColumns({"title": F.lit("known"), "state": F.lit("known")})
    seen = issues.where(F.coalesce(F.col("number") % 4, F.lit(1)) > 0).withColumns({"title": F.lit("seen"), "state": F.lit("seen")})
    return upserted(current, seen, ["repository_id", "number"], ["state"])


def _conventions(g: q.Graph, changed: DataFrame) -> DataFrame:
    """Convention findings of the pull requests of ``changed``."""
    texts = _sources(g).join(changed.select("repository_id", "path", "pull_request_id"), ["repository_id", "path"])
    return conflicts.convention_findings(texts.select(F.col("pull_request_id").alias("key"), "path", "content", F.lit(True).alias("changed")), "src/")


def _payloads(g: q.Graph) -> DataFrame:
    prs = asked(g)
    ids = prs.select(F.col("id").alias("pull_request_id"))
    changed = checkpointed(changed_files(g).join(ids, "pull_request_id", "left_semi"))
    found = _conventions(g, changed)
    ranked = reviewers.ranked(g, with_login(g).join(ids, F.col("id") == F.col("pull_request_id"), "left_semi"), changed, now())
    return payload.payloads(prs, found, context.packets(g, prs, changed, now(), churn=CHURN), ranked)


_PLANS: dict[str, Callable[[q.Graph], DataFrame]] = {
    "f1_decision_records": lambda g: _bodies(g).select("id", tx.is_adr(F.col("body")).alias("is_adr"), tx.adr_title(F.col("path"), F.col("body")).alias("title"), tx.adr_status(F.col("body")).alias("status")),
    "f6_first_lines": lambda g: g["commits"].select("id", tx.first_line(F.col("message")).alias("title"), tx.short_sha(F.col("sha")).alias("short_sha")),
    "f8_symbol_texts": lambda g: g["symbols"].select("id", tx.symbol_embed_text(F.col("kind"), F.col("signature"), F.col("qualified_name")).alias("embed_text")),
    "f9_pr_prose": lambda g: g["pull_requests"].select("id", tx.pr_prose(F.col("title"), F.col("body")).alias("prose")),
    "f16_languages": lambda g: g["files"].groupBy(tx.language_by_extension(F.col("path")).alias("language")).agg(F.count("*").alias("n")),
    "a11_diff_lines": lambda g: g["pull_requests"].select("id", tx.diff_lines(F.col("body")).cast("long").alias("n_lines")),
    "h1_hashes": lambda g: once(g["source_texts"].select("file_id", "content"), "file_id").where(F.col("content").isNotNull()).select("file_id", tx.content_hash(F.col("content")).alias("content_hash"), tx.embedding_key(F.lit("m"), F.col("content")).alias("embedding_key")),
    "is_bot_login": lambda g: g["persons"].select("id", reviewers.is_bot(F.col("github_login")).alias("is_bot")).distinct(),
    "sc10_upserted": _upserted,
    "x1_symbols": _exploded("symbols"),
    "x3_imports": _exploded("imports"),
    "x4_calls": _exploded("calls"),
    "c11_architectural": lambda g: conflicts.architectural_questions(g, asked(g).select("id", "embedding")).withColumn("similarity", F.round("similarity", 6)),
    "c13_payloads": _payloads,
    # Without the searches, over all pull requests.
    "x9_convention_findings": lambda g: _conventions(g, changed_files(g)),
    "c13_convention_payloads": lambda g: payload.payloads(g["pull_requests"], _conventions(g, changed_files(g))),
}


def _query(plan: Callable[[q.Graph], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plan(graph(spark, sf_dir))


QUERIES = {name: _query(plan) for name, plan in _PLANS.items()}

_STRIP = r"'^[\s]+|[\s]+$', '', 'g'"
_GOOD = "len(embedding) = 64 AND (list_max(embedding) <> 0 OR list_min(embedding) <> 0)"
_SQL = {
    "f1_decision_records": r"""SELECT id, regexp_matches(body, '(?mi)^[ \t]*Status:[ \t]*([^\r\n]*)') AND regexp_matches(body, '(?mi)^##[ \t]+(?:context|decision)\b') AS is_adr,
        CASE WHEN trim(regexp_extract(body, '(?m)^# +([^\r\n]+)', 1)) <> '' THEN trim(regexp_extract(body, '(?m)^# +([^\r\n]+)', 1)) ELSE replace(regexp_extract(path, '([^/]*?)(?:\.[^./]*)?$', 1), '-', ' ') END AS title,
        nullif(lower(regexp_extract(regexp_extract(body, '(?mi)^[ \t]*Status:[ \t]*([^\r\n]*)', 1), '^\W*(\w[\w-]*)', 1)), '') AS status FROM v_adrs WHERE body IS NOT NULL""",
    "f6_first_lines": rf"SELECT id, nullif(regexp_replace(regexp_extract(message, '[^\s][^\r\n]*'), {_STRIP}), '') AS title, substring(sha, 1, 7) AS short_sha FROM v_commits",
    "f8_symbol_texts": "SELECT id, kind || ' ' || coalesce(nullif(signature, ''), qualified_name) AS embed_text FROM v_symbols",
    "f9_pr_prose": "SELECT id, concat_ws(chr(10) || chr(10), nullif(trim(title), ''), nullif(trim(body), '')) AS prose FROM v_prs",
    "f16_languages": "SELECT CASE WHEN ends_with(path, '.py') THEN 'python' END AS language, count(*) AS n FROM v_files GROUP BY 1",
    "a11_diff_lines": r"SELECT id, len(regexp_extract_all(coalesce(body, ''), '(?m)^(?:\+(?:[^+]|\+[^+]|$)|-(?:[^-]|-[^-]|$))')) AS n_lines FROM v_prs",
    "h1_hashes": "SELECT DISTINCT file_id, sha256(content) AS content_hash, sha256('m' || chr(0) || content) AS embedding_key FROM source_texts WHERE content IS NOT NULL",
    "is_bot_login": "SELECT DISTINCT id, ends_with(github_login, '-bot') OR ends_with(github_login, '-actions') OR ends_with(github_login, '[bot]') AS is_bot FROM persons",
    "sc10_upserted": """WITH i AS (SELECT DISTINCT CASE WHEN number % 7 > 0 THEN repository_id END AS repository_id, CASE WHEN number % 5 > 0 THEN number END AS number FROM v_issues),
        b AS (SELECT *, coalesce(number % 3, 1) > 0 AS known, coalesce(number % 4, 1) > 0 AS seen FROM i)
        SELECT repository_id, number, CASE WHEN known THEN 'known' ELSE 'seen' END AS title, CASE WHEN seen THEN 'seen' ELSE 'known' END AS state FROM b WHERE known OR seen""",
    "c11_architectural": f"""WITH asked AS (SELECT id AS pull_request_id, CAST(embedding AS DOUBLE[]) AS qv FROM v_pull_requests WHERE number % 100 = 0 AND {_GOOD}),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY pull_request_id ORDER BY s DESC, id) AS place FROM (SELECT asked.*, i.*, round(list_cosine_similarity(qv, CAST(i.embedding AS DOUBLE[])), 9) AS s FROM asked, (SELECT * FROM v_adrs WHERE {_GOOD}) i))
        SELECT pull_request_id, id AS adr_id, path, title, round(s, 6) AS similarity, place FROM ranked WHERE place <= 5 AND status = 'accepted'""",
}
ORACLE = {name: with_views(sql) if "v_" in sql else sql for name, sql in _SQL.items()}
