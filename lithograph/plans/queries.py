"""The composite pipelines over whole tables, and the same as SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithograph.functions.changes import change, status_return_drift
from lithograph.functions.paths import OWNER_FILES, owner_rules, owners_of, owners_united
from lithograph.operators import graph as q
from lithograph.plans import conflicts, context, reviewers
from lithograph.sources.tree import caller_snippets, owner_file
from lithograph.sources.views import graph, with_views
from lithograph.tables import once

NOW = "2024-12-31 00:00:00"
CHURN = 5


def now():
    return F.expr(f"TIMESTAMP_NTZ '{NOW}'")


def changed_files(g: q.Graph) -> DataFrame:
    """Changed files of every pull request: the paths its commits touch, in the order of their names; the body stands for the patch."""
    paths = q.files_touched_by_pr(g).join(g["pull_requests"].select(F.col("id").alias("pull_request_id"), "repository_id", F.col("body").alias("patch")), "pull_request_id")
    ordinal = F.row_number().over(W.partitionBy("pull_request_id").orderBy("path")) - 1
    return paths.withColumn("ordinal", ordinal).select("pull_request_id", "ordinal", "repository_id", "path", "patch")


def with_login(g: q.Graph) -> DataFrame:
    logins = g["persons"].select(F.col("id").alias("author_id"), F.col("github_login").alias("author_login"))
    return g["pull_requests"].join(logins, "author_id", "left")


def owner_files(g: q.Graph) -> DataFrame:
    """repository_id, path, content of the repositories' owner files; one at a later place must not count."""
    lines = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    first = g["owner_lines"].groupBy("repository_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("content"))
    places = F.explode(F.array(F.struct(F.lit(OWNER_FILES[0]).alias("path"), F.col("content")), F.struct(F.lit(OWNER_FILES[2]).alias("path"), F.lit("* @nobody").alias("content"))))
    return first.select("repository_id", places.alias("f")).select("repository_id", "f.*")


def rules(g: q.Graph) -> DataFrame:
    """The owner rules of all repositories."""
    return owner_rules(owner_file(owner_files(g)))


def _signals(g: q.Graph) -> DataFrame:
    rows = reviewers.weighed(g, with_login(g), changed_files(g), now(), rules(g))
    return rows.select("pull_request_id", "login", "person_id", "is_team", "is_codeowner", F.round("authorship_share", 9).alias("authorship_share"), "recent_review_count", "call_graph_overlap", F.round("review_acceptance_rate", 9).alias("review_acceptance_rate"), "open_pr_load", "total_reviews")


def asked(g: q.Graph) -> DataFrame:
    """The stated query set of searches: numbers divisible by 100."""
    return g["pull_requests"].where(F.col("number") % 100 == 0)


def _related(g: q.Graph) -> DataFrame:
    rows = context.related_prs(g, asked(g))
    return rows.select("query_id", "pull_request_id", "number", "title", *[F.round(c, 6).alias(c) for c in ("similarity", "overlap", "score")], "rank")


# Two sources of a definition by a digit of a hash; SQL knows the labels they must get.
_BEFORE = {"23": None, "67": "def {n}(a) -> int:\n    return a\n", "89e": "def {n}(a):\n    if a:\n        raise ValueError\n    return a\n", "f": "def {n}(\n", "": "def {n}(a):\n    return a\n"}
_AFTER = {"01": None, "45": "def {n}(a, *, b: int = 1):\n    return a\n", "67": "def {n}(a) -> str:\n    return a\n", "89": "def {n}(a):\n    if a:\n        raise errors.Bad(a)\n    return a\n", "ab": "def {n}(a):\n    return a + 1\n", "cd": 'def {n}(a):\n    """Said."""\n    # more\n    return a\n', "e": "async def {n}(b):\n    return b\n", "": "def {n}(a):\n    return a\n"}


def _source(forms: dict[str, str | None], digit: Column, name: Column) -> Column:
    out = F.replace(F.lit(forms[""]), F.lit("{n}"), name)
    for digits, form in forms.items():
        if digits:
            out = F.when(digit.isin(*digits), F.lit(None) if form is None else F.replace(F.lit(form), F.lit("{n}"), name)).otherwise(out)
    return out


def _versions(symbols: DataFrame) -> DataFrame:
    """``symbols`` (id, qualified_name) with an old and a new source."""
    digit, name = F.substr(F.md5("id"), F.lit(1), F.lit(1)), F.element_at(F.split("qualified_name", r"\."), -1)
    return symbols.withColumns({"old_source": _source(_BEFORE, digit, name), "new_source": _source(_AFTER, digit, name)})


def _changes(g: q.Graph) -> DataFrame:
    rows = _versions(g["symbols"].where(F.col("kind").isin("function", "method")).select("id", "qualified_name")).withColumn("c", change(F.col("old_source"), F.col("new_source")))
    joined = lambda n: F.array_join(f"c.{n}", " ").alias(n)
    return rows.select("id", "c.classification", joined("all_changes"), "c.before_signature", "c.after_signature", joined("added_exceptions"), joined("removed_exceptions"))


def changed_symbols(g: q.Graph) -> DataFrame:
    """Every function of the files that a pull request changed, with an old and a new source."""
    files = changed_files(g).select("pull_request_id", "repository_id", "path")
    known = files.join(q.file_by_path(g, files), ["repository_id", "path"]).select("pull_request_id", F.col("path").alias("file_path"), "file_id")
    symbols = g["symbols"].where(F.col("kind").isin("function", "method")).select("id", "repository_id", "file_id", "qualified_name")
    rows = known.join(symbols, "file_id").withColumn("ordinal", F.row_number().over(W.partitionBy("pull_request_id").orderBy("id"))).withColumn("change_kind", F.lit("modified"))
    return _versions(rows).select("pull_request_id", "ordinal", "repository_id", "qualified_name", "change_kind", "old_source", "new_source", "file_path")


def _semantic(g: q.Graph) -> DataFrame:
    return conflicts.semantic_questions(g, changed_symbols(g)).select("pull_request_id", "ordinal", "qualified_name", "file_path", "classification", "caller_id", "caller_name", "caller_path", "caller_line", "place")


def _drift(g: q.Graph) -> DataFrame:
    """Status tuples in the changed files of pull requests, whose texts tell by a hash what their functions return."""
    digit, name = F.substr(F.md5("path"), F.lit(1), F.lit(1)), F.substr(F.md5("path"), F.lit(1), F.lit(6))
    status = F.concat(F.lit("def pay_"), name, F.lit("(x) -> "), F.when(digit < "2", "tuple[bool, str]").otherwise("tuple[int, list[str]]"), F.lit(":\n    return x\n"))
    text = F.when(digit < "4", status).when(digit < "8", F.lit("from app.exceptions import Bad\n")).otherwise(F.lit("def _x() -> tuple[bool, str]:\n    return x\n\ndef y() -> tuple[str, bool]:\n    return x\n"))
    other = F.substr(F.md5(F.concat("pull_request_id", "path")), F.lit(1), F.lit(1))
    files = changed_files(g).select(F.col("pull_request_id").alias("key"), "path", text.alias("content"), (other < "e").alias("changed"))
    return status_return_drift(files, "src/")


def _snippets(g: q.Graph) -> DataFrame:
    """Every symbol that calls another, with its text in the latest version of its path, else its signature."""
    callers = g["symbols"].join(g["symbol_calls"].select(F.col("caller_id").alias("id")).distinct(), "id", "left_semi").join(g["files"].select(F.col("id").alias("file_id"), "path"), "file_id")
    sources = q.file_by_path(g).join(once(g["source_texts"].select("file_id", "content"), "file_id"), "file_id").select("repository_id", "path", "content")
    return caller_snippets(callers.select("id", "repository_id", "path", "start_line", "end_line", "signature"), sources).select("id", "snippet")


_PLANS: dict[str, Callable[[q.Graph], DataFrame]] = {
    "c1_related_prs": _related,
    "c2_relevant_adrs": lambda g: context.relevant_adrs(g, asked(g)).withColumn("similarity", F.round("similarity", 6)),
    "c3_recent_history": lambda g: context.recent_history(g, changed_files(g)),
    "c4_linked_issues": lambda g: context.linked_issues(g, g["pull_requests"]).drop("place"),
    "c5_risk_notes": lambda g: context.risk_notes(g, changed_files(g), now(), churn=CHURN),
    "c6_packets": lambda g: context.packets(g, asked(g), changed_files(g).join(asked(g).select(F.col("id").alias("pull_request_id")), "pull_request_id", "left_semi"), now(), churn=CHURN),
    "f5_owners": lambda g: owners_of(g["files"].select("repository_id", "path"), rules(g)).withColumn("owners", F.array_join("owners", " ")),
    "a12_owners_united": lambda g: owners_united(changed_files(g), rules(g), "pull_request_id").withColumn("owners", F.array_join("owners", " ")),
    "c7_candidates": lambda g: reviewers.candidates(g, with_login(g), changed_files(g), now(), rules(g)),
    "c8_signals": _signals,
    "x6_changes": _changes,
    "x9_drift": _drift,
    "sc7_caller_snippets": _snippets,
    "c11_semantic": _semantic,
    "c10_reviewers": lambda g: reviewers.ranked(g, with_login(g), changed_files(g), now(), rules(g)),
}


def _query(plan: Callable[[q.Graph], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plan(graph(spark, sf_dir))


QUERIES = {name: _query(plan) for name, plan in _PLANS.items()}

_TOUCH = "FROM v_commit_modifies_file m JOIN v_commits c ON c.id = m.commit_id"
_NOW = f"TIMESTAMP '{NOW}'"
_BASE = f"""touched AS (SELECT DISTINCT x.pull_request_id, f.path FROM v_pr_contains_commit x JOIN v_commit_modifies_file m ON m.commit_id = x.commit_id JOIN v_files f ON f.id = m.file_id),
changed AS (SELECT t.pull_request_id, p.repository_id, t.path, p.body AS patch, row_number() OVER (PARTITION BY t.pull_request_id ORDER BY t.path) - 1 AS ordinal FROM touched t JOIN v_prs p ON p.id = t.pull_request_id),
latest AS (SELECT m.file_id, max(c.committed_at) AS at {_TOUCH} GROUP BY 1),
by_path AS (SELECT repository_id, path, id AS file_id FROM (SELECT f.*, row_number() OVER (PARTITION BY f.repository_id, f.path ORDER BY l.at DESC NULLS LAST, f.id) AS n FROM v_files f LEFT JOIN latest l ON l.file_id = f.id) WHERE n = 1),
known AS (SELECT k.*, b.file_id FROM changed k JOIN by_path b ON b.repository_id = k.repository_id AND b.path = k.path)"""


def _search(items: str) -> str:
    good = "len(embedding) = 64 AND (list_max(embedding) <> 0 OR list_min(embedding) <> 0)"
    return f"""asked AS (SELECT id AS query_id, number AS query_number, author_id AS query_author, CAST(embedding AS DOUBLE[]) AS qv FROM v_pull_requests WHERE number % 100 = 0 AND {good}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS pool_rank FROM (
  SELECT asked.*, i.*, round(list_cosine_similarity(qv, CAST(i.embedding AS DOUBLE[])), 9) AS s FROM asked, (SELECT * FROM {items} WHERE {good}) i))"""


# The last rule that matches; a pattern becomes a regular expression of its own here.
_OWNED = r"""said AS (SELECT repository_id, line_no, string_split_regex(trim(line), '\s+') AS words FROM v_owner_lines WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')),
parsed AS (SELECT repository_id, line_no, words[1] AS pattern, [w[2:] for w in words[2:] if starts_with(w, '@')] AS owners FROM said WHERE len(words) > 1),
below AS (SELECT *, regexp_replace(regexp_replace(pattern, '^/', ''), '/$', '/**') AS body FROM parsed WHERE len(owners) > 0),
free AS (SELECT *, CASE WHEN NOT starts_with(pattern, '/') AND NOT contains(body, '/') AND NOT starts_with(body, '**') THEN '**/' || body ELSE body END AS whole FROM below),
written AS (SELECT repository_id, line_no, owners, replace(replace(replace(replace(replace(replace(replace(whole, '.', '[.]'), '+', '[+]'), '**/', chr(1)), '**', chr(1)), '*', '[^/]*'), '?', '[^/]'), chr(1), '.*') AS regex FROM free),
owned AS (SELECT f.repository_id, f.path, arg_max(w.owners, w.line_no) AS owners FROM (SELECT DISTINCT repository_id, path FROM v_files) f JOIN written w ON w.repository_id = f.repository_id AND regexp_full_match(f.path, w.regex) GROUP BY 1, 2),
owns AS (SELECT DISTINCT k.pull_request_id, unnest(o.owners) AS login FROM changed k JOIN owned o ON o.repository_id = k.repository_id AND o.path = k.path)"""
_SIGNALS = f"""{_BASE},
{_OWNED},
authors AS (SELECT m.file_id, c.author_id AS person_id {_TOUCH} WHERE c.committed_at >= {_NOW} - INTERVAL 180 DAYS AND c.author_id IS NOT NULL GROUP BY ALL),
reviews AS (SELECT m.file_id, r.reviewer_id AS person_id, count(DISTINCT r.id) AS n FROM v_reviews r JOIN v_pr_contains_commit x ON x.pull_request_id = r.pull_request_id
  JOIN v_commit_modifies_file m ON m.commit_id = x.commit_id WHERE r.submitted_at >= {_NOW} - INTERVAL 180 DAYS GROUP BY ALL),
pool AS (SELECT DISTINCT k.pull_request_id, w.person_id FROM known k JOIN (SELECT file_id, person_id FROM authors UNION SELECT file_id, person_id FROM reviews) w ON w.file_id = k.file_id),
worked AS (SELECT o.pull_request_id, p.github_login AS login, min(p.id) AS person_id FROM pool o JOIN v_persons p ON p.id = o.person_id GROUP BY 1, 2),
logins AS (SELECT pull_request_id, login FROM worked UNION SELECT pull_request_id, login FROM owns),
active AS (SELECT person_id, max(seen) AS seen FROM (SELECT author_id AS person_id, committed_at AS seen FROM v_commits UNION ALL SELECT reviewer_id, submitted_at FROM v_reviews) GROUP BY 1),
candidates AS (SELECT o.pull_request_id, o.login, w.person_id, contains(o.login, '/') AS is_team FROM logins o LEFT JOIN worked w ON w.pull_request_id = o.pull_request_id AND w.login = o.login JOIN v_prs r ON r.id = o.pull_request_id
  LEFT JOIN v_persons a ON a.id = r.author_id LEFT JOIN active t ON t.person_id = w.person_id WHERE o.login IS DISTINCT FROM a.github_login
  AND NOT (ends_with(o.login, '-bot') OR ends_with(o.login, '-actions') OR ends_with(o.login, '[bot]')) AND (contains(o.login, '/') OR w.person_id IS NULL OR t.seen >= {_NOW} - INTERVAL 90 DAYS)),
paths AS (SELECT pull_request_id, count(DISTINCT path) AS n_paths FROM changed GROUP BY 1),
authored AS (SELECT k.pull_request_id, w.person_id, count(DISTINCT k.path) AS n, min(k.path) AS first_path FROM known k JOIN authors w ON w.file_id = k.file_id GROUP BY ALL),
reviewed AS (SELECT k.pull_request_id, w.person_id, CAST(sum(w.n) AS BIGINT) AS n FROM known k JOIN reviews w ON w.file_id = k.file_id GROUP BY ALL),
own AS (SELECT DISTINCT k.pull_request_id AS set_id, s.id AS symbol_id FROM known k JOIN v_symbols s ON s.file_id = k.file_id),
near AS (SELECT o.set_id, k.callee_id AS symbol_id FROM own o JOIN v_symbol_calls k ON k.caller_id = o.symbol_id UNION SELECT o.set_id, k.caller_id FROM own o JOIN v_symbol_calls k ON k.callee_id = o.symbol_id),
overlap AS (SELECT n.set_id, c.author_id AS person_id, count(DISTINCT n.symbol_id) AS n FROM near n JOIN v_commit_modifies_symbol z ON z.symbol_id = n.symbol_id JOIN v_commits c ON c.id = z.commit_id
  WHERE c.committed_at >= {_NOW} - INTERVAL 180 DAYS AND c.author_id IS NOT NULL GROUP BY ALL),
rate AS (SELECT reviewer_id AS person_id, sum(CASE WHEN upper(state) = 'APPROVED' THEN 1 ELSE 0 END) AS approved, count(*) AS total FROM v_reviews WHERE submitted_at >= {_NOW} - INTERVAL 180 DAYS GROUP BY 1),
load AS (SELECT author_id AS person_id, count(*) AS n FROM v_prs WHERE state = 'open' GROUP BY 1),
signals AS (SELECT c.*, x.login IS NOT NULL AS is_codeowner, a.first_path, coalesce(a.n / p.n_paths, 0.0) AS authorship_share, coalesce(r.n, 0) AS recent_review_count, coalesce(o.n, 0) AS call_graph_overlap,
  coalesce(t.approved / t.total, 0.0) AS review_acceptance_rate, coalesce(l.n, 0) AS open_pr_load, coalesce(t.total, 0) AS total_reviews
  FROM candidates c LEFT JOIN paths p ON p.pull_request_id = c.pull_request_id LEFT JOIN authored a ON a.pull_request_id = c.pull_request_id AND a.person_id = c.person_id
  LEFT JOIN reviewed r ON r.pull_request_id = c.pull_request_id AND r.person_id = c.person_id LEFT JOIN overlap o ON o.set_id = c.pull_request_id AND o.person_id = c.person_id
  LEFT JOIN rate t ON t.person_id = c.person_id LEFT JOIN load l ON l.person_id = c.person_id LEFT JOIN owns x ON x.pull_request_id = c.pull_request_id AND x.login = c.login)"""
_LABELS = """CASE WHEN d IN ('0', '1') THEN 'deleted' WHEN d IN ('2', '3') THEN 'added' WHEN d IN ('4', '5', 'e') THEN 'signature_change' WHEN d IN ('6', '7') THEN 'return_type_change'
  WHEN d IN ('8', '9') THEN 'exception_change' WHEN d IN ('a', 'b') THEN 'body_only' WHEN d IN ('c', 'd') THEN 'unchanged' END"""
_SQL = {
    "x6_changes": f"""WITH s AS (SELECT id, split_part(qualified_name, '.', -1) AS n, substr(md5(id), 1, 1) AS d FROM v_symbols WHERE kind IN ('function', 'method')),
c AS (SELECT id, n, d, {_LABELS} AS classification FROM s)
SELECT id, classification, CASE WHEN d = 'e' THEN 'signature_change exception_change body_only' WHEN d IN ('8', '9') THEN 'exception_change body_only' ELSE classification END AS all_changes,
  CASE WHEN d IN ('6', '7') THEN 'def ' || n || '(a) -> int' WHEN d NOT IN ('2', '3', 'f') THEN 'def ' || n || '(a)' END AS before_signature,
  CASE WHEN d IN ('4', '5') THEN 'def ' || n || '(a, *, b: int = 1)' WHEN d IN ('6', '7') THEN 'def ' || n || '(a) -> str' WHEN d = 'e' THEN 'async def ' || n || '(b)' WHEN d NOT IN ('0', '1', 'f') THEN 'def ' || n || '(a)' END AS after_signature,
  CASE WHEN d = 'f' THEN NULL WHEN d IN ('8', '9') THEN 'errors.Bad' ELSE '' END AS added_exceptions, CASE WHEN d = 'f' THEN NULL WHEN d IN ('8', '9', 'e') THEN 'ValueError' ELSE '' END AS removed_exceptions FROM c""",
    "x9_drift": f"""WITH {_BASE}, texts AS (SELECT pull_request_id AS key, path, substr(md5(path), 1, 1) AS d, substr(md5(pull_request_id || path), 1, 1) < 'e' AS changed FROM changed WHERE starts_with(path, 'src/')),
fits AS (SELECT key FROM texts GROUP BY 1 HAVING bool_or(d BETWEEN '4' AND '7') AND NOT bool_or(d < '4' AND NOT changed))
SELECT key, path, 'pay_' || substr(md5(path), 1, 6) AS function_name, CASE WHEN d < '2' THEN 'tuple[bool, str]' ELSE 'tuple[int, list[str]]' END AS annotation FROM texts JOIN fits USING (key) WHERE changed AND d < '4'""",
    "sc7_caller_snippets": f"""WITH {_BASE}, texts AS (SELECT b.repository_id, b.path, string_split_regex(t.content, '\\r\\n|\\n|\\r') AS lines FROM by_path b JOIN (SELECT file_id, min(content) AS content FROM source_texts GROUP BY 1) t ON t.file_id = b.file_id)
SELECT s.id, CASE WHEN t.lines IS NOT NULL AND len(t.lines) >= s.start_line THEN array_to_string(t.lines[s.start_line:greatest(s.end_line, s.start_line)], chr(10)) ELSE coalesce(s.signature, '') || chr(10) || '    ...' END AS snippet
FROM v_symbols s JOIN v_files f ON f.id = s.file_id LEFT JOIN texts t ON t.repository_id = s.repository_id AND t.path = f.path WHERE s.id IN (SELECT caller_id FROM v_symbol_calls)""",
    "c11_semantic": f"""WITH {_BASE}, s AS (SELECT k.pull_request_id, k.path AS file_path, s.id, s.repository_id, s.qualified_name, substr(md5(s.id), 1, 1) AS d, row_number() OVER (PARTITION BY k.pull_request_id ORDER BY s.id) AS ordinal
  FROM known k JOIN v_symbols s ON s.file_id = k.file_id WHERE s.kind IN ('function', 'method')),
c AS (SELECT *, coalesce({_LABELS}, 'signature_change') AS classification FROM s), exact AS (SELECT repository_id, qualified_name, min(id) AS symbol_id FROM v_symbols GROUP BY 1, 2),
calls AS (SELECT DISTINCT k.callee_id, x.id AS caller_id, x.qualified_name AS caller_name, f.path AS caller_path, x.start_line AS caller_line FROM v_symbol_calls k JOIN v_symbols x ON x.id = k.caller_id JOIN v_files f ON f.id = x.file_id),
placed AS (SELECT c.pull_request_id, c.ordinal, c.qualified_name, c.file_path, c.classification, k.caller_id, k.caller_name, k.caller_path, k.caller_line, row_number() OVER (PARTITION BY c.pull_request_id, c.ordinal ORDER BY k.caller_name, k.caller_id) AS place
  FROM c JOIN exact e ON e.repository_id = c.repository_id AND e.qualified_name = c.qualified_name JOIN calls k ON k.callee_id = e.symbol_id WHERE c.classification IN ('deleted', 'signature_change', 'return_type_change', 'exception_change'))
SELECT * FROM placed WHERE place <= 10""",
    "c1_related_prs": f"""WITH {_search('v_pull_requests')},
touched AS (SELECT DISTINCT x.pull_request_id, f.path FROM v_pr_contains_commit x JOIN v_commit_modifies_file m ON m.commit_id = x.commit_id JOIN v_files f ON f.id = m.file_id),
sets AS (SELECT pull_request_id, list(path) AS paths FROM touched GROUP BY 1),
scored AS (SELECT r.query_id, r.id AS pull_request_id, r.number, r.title, r.s AS similarity, r.pool_rank, r.author_id, r.query_author, r.query_number,
  coalesce(len(list_intersect(a.paths, b.paths)) / nullif(len(list_distinct(list_concat(a.paths, b.paths))), 0), 0.0) AS overlap
  FROM ranked r LEFT JOIN sets a ON a.pull_request_id = r.query_id LEFT JOIN sets b ON b.pull_request_id = r.id WHERE pool_rank <= 10),
final AS (SELECT *, 0.6 * greatest(similarity, 0.0) + 0.4 * overlap AS score FROM scored WHERE query_number <> number AND NOT coalesce(author_id = query_author AND overlap < 0.8, false)),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pool_rank) AS rank FROM final WHERE score >= 0.15)
SELECT query_id, pull_request_id, number, title, round(similarity, 6) AS similarity, round(overlap, 6) AS overlap, round(score, 6) AS score, rank FROM placed WHERE rank <= 3""",
    "c2_relevant_adrs": f"WITH {_search('v_adrs')} SELECT query_id, id AS adr_id, path, title, round(s, 6) AS similarity, pool_rank AS rank FROM ranked WHERE pool_rank <= 5 AND status = 'accepted' AND trim(title) <> ''",
    "c3_recent_history": f"""WITH {_BASE},
newest AS (SELECT m.file_id, c.*, row_number() OVER (PARTITION BY m.file_id ORDER BY c.committed_at DESC, c.sha) AS rank {_TOUCH}),
placed AS (SELECT k.pull_request_id, k.path, n.sha, n.message, n.author_id, n.committed_at, row_number() OVER (PARTITION BY k.pull_request_id ORDER BY k.ordinal, n.rank) AS place FROM known k JOIN newest n ON n.file_id = k.file_id WHERE n.rank <= 5)
SELECT r.pull_request_id, r.path, r.sha, nullif(regexp_extract(r.message, '[^\\s][^\\r\\n]*'), '') AS title, p.github_login AS login, r.committed_at, r.place FROM placed r LEFT JOIN v_persons p ON p.id = r.author_id WHERE place <= 15""",
    "c4_linked_issues": """WITH spread AS (SELECT id, repository_id, regexp_replace(body, '([^\\p{L}\\p{N}_])', '\\1\\1', 'g') AS b FROM v_prs), refs AS (
  SELECT id, repository_id, 'github' AS kind, unnest(regexp_extract_all(b, '(?i)(?:^|[^\\p{L}\\p{N}_])(?:fix(?:e[sd])?|clos(?:e[sd])?|resolv(?:e[sd])?)\\s*(?:[:\\-]{2})?\\s*##(\\d+)(?:[^\\p{L}\\p{N}_]|$)', 1)) AS x FROM spread
  UNION SELECT id, repository_id, 'external', unnest(list_transform(list_concat(regexp_extract_all(b, '(?i)(?:^|[^\\p{L}\\p{N}_])(?:fix(?:e[sd])?|clos(?:e[sd])?|resolv(?:e[sd])?)\\s*(?:[:\\-]{2})?\\s*([A-Z][A-Z0-9]+--\\d+)(?:[^\\p{L}\\p{N}_]|$)', 1),
    regexp_extract_all(b, '(?:^|[^\\p{L}\\p{N}_])([A-Z][A-Z0-9]+--\\d+)(?:[^\\p{L}\\p{N}_]|$)', 1)), lambda i: replace(i, '--', '-'))) FROM spread)
SELECT DISTINCT r.id AS pull_request_id, r.kind, CASE WHEN kind = 'github' THEN '#' || CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE x END AS identifier, CASE WHEN kind = 'github' THEN CAST(x AS INTEGER) END AS number, i.title, i.state
FROM refs r LEFT JOIN v_issues i ON i.repository_id = r.repository_id AND r.kind = 'github' AND i.number = TRY_CAST(r.x AS INTEGER)""",
    "c5_risk_notes": f"""WITH {_BASE},
lines AS (SELECT pull_request_id, count(*) AS files, CAST(sum(len(regexp_extract_all(coalesce(patch, ''), '(?m)^(?:\\+(?:[^+]|\\+[^+]|$)|-(?:[^-]|-[^-]|$))'))) AS BIGINT) AS n FROM changed GROUP BY 1),
reverts AS (SELECT m.file_id, c.sha, row_number() OVER (PARTITION BY m.file_id ORDER BY c.committed_at DESC, c.sha) AS rank {_TOUCH} WHERE c.committed_at >= {_NOW} - INTERVAL 30 DAYS AND lower(c.message) LIKE 'revert%'),
reverted AS (SELECT file_id, count(*) AS n, string_agg(substring(sha, 1, 7), ', ' ORDER BY rank) FILTER (rank <= 3) AS shas FROM reverts GROUP BY 1),
churn AS (SELECT m.file_id, count(*) AS n {_TOUCH} WHERE c.committed_at >= {_NOW} - INTERVAL 30 DAYS GROUP BY 1 HAVING count(*) > {CHURN}),
notes AS (SELECT pull_request_id, -1 AS ordinal, 0 AS kind, 'Large PR: the diff touches ' || n || ' lines across ' || files || ' file(s).' AS note FROM lines WHERE n > 500
  UNION ALL SELECT k.pull_request_id, k.ordinal, 1, 'Recently reverted: ' || k.path || ' was touched by ' || r.n || ' revert commit(s) in the last 30 days (' || r.shas || ').' FROM known k JOIN reverted r ON r.file_id = k.file_id
  UNION ALL SELECT k.pull_request_id, k.ordinal, 2, 'High churn: ' || k.path || ' had ' || r.n || ' commits in the last 30 days.' FROM known k JOIN churn r ON r.file_id = k.file_id)
SELECT pull_request_id, row_number() OVER (PARTITION BY pull_request_id ORDER BY ordinal, kind) AS place, note FROM notes""",
    "f5_owners": f"WITH {_BASE}, {_OWNED} SELECT repository_id, path, array_to_string(owners, ' ') AS owners FROM owned",
    "a12_owners_united": f"WITH {_BASE}, {_OWNED} SELECT pull_request_id, string_agg(login, ' ' ORDER BY login) AS owners FROM owns GROUP BY 1",
    "c7_candidates": f"WITH {_SIGNALS} SELECT * FROM candidates",
    "c8_signals": f"WITH {_SIGNALS} SELECT * EXCLUDE (first_path) REPLACE (round(authorship_share, 9) AS authorship_share, round(review_acceptance_rate, 9) AS review_acceptance_rate) FROM signals",
    "c10_reviewers": f"""WITH {_SIGNALS},
scored AS (SELECT *, round_even(0.0 + CASE WHEN is_codeowner THEN 0.3 ELSE 0.0 END + CASE WHEN authorship_share >= 0.2 THEN 0.25 ELSE 0.0 END + CASE WHEN recent_review_count >= 3 THEN 0.15 ELSE 0.0 END + CASE WHEN call_graph_overlap >= 1 THEN 0.1 ELSE 0.0 END
  + CASE WHEN review_acceptance_rate >= 0.7 THEN 0.1 ELSE 0.0 END + CASE WHEN open_pr_load < 3 THEN 0.1 ELSE 0.0 END + CASE WHEN open_pr_load > 8 THEN -0.2 ELSE 0.0 END, 4) AS score FROM signals),
placed AS (SELECT *, row_number() OVER (PARTITION BY pull_request_id ORDER BY score DESC, login) AS rank FROM scored WHERE score > 0)
SELECT pull_request_id, login, is_team, CAST(score AS DOUBLE) AS score, rank, CASE WHEN is_codeowner AND first_path IS NOT NULL THEN 'CODEOWNERS match for ' || first_path || '.' WHEN is_codeowner THEN 'CODEOWNERS match for the files touched by this PR.'
  WHEN authorship_share >= 0.2 THEN 'Authored ' || CAST(round_even(authorship_share * 100, 0) AS INTEGER) || '% of touched files in the last 6 months.'
  WHEN call_graph_overlap >= 1 THEN 'Recently modified ' || call_graph_overlap || CASE WHEN call_graph_overlap = 1 THEN ' symbol' ELSE ' symbols' END || ' that call into this PR''s code.'
  WHEN recent_review_count >= 3 AND total_reviews > 0 AND review_acceptance_rate >= 0.7 THEN 'Reviewed ' || recent_review_count || ' PRs in this area with a ' || CAST(round_even(review_acceptance_rate * 100, 0) AS INTEGER) || '% acceptance rate.'
  WHEN recent_review_count >= 3 THEN 'Reviewed ' || recent_review_count || ' PRs touching these files recently.'
  WHEN open_pr_load < 3 THEN 'Currently has capacity (' || open_pr_load || CASE WHEN open_pr_load = 1 THEN ' open PR' ELSE ' open PRs' END || ').'
  WHEN is_team THEN 'Listed as a team owner (' || login || ').' ELSE 'Surfaced by historical review activity near this PR.' END AS rationale FROM placed WHERE rank <= 3""",
}
ORACLE = {name: with_views(sql) for name, sql in _SQL.items()}
