"""The twenty graph queries over whole tables, and the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithograph.operators import graph as q
from lithograph.sources.views import graph, with_views

SINCE = "2024-07-01 00:00:00"
_S = f"TIMESTAMP '{SINCE}'"


def since() -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{SINCE}'")


def query_prs(g: q.Graph) -> DataFrame:
    """The stated query set of searches: pull requests whose number is divisible by 100."""
    return g["pull_requests"].where(F.col("number") % 100 == 0).select("id", "embedding")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("similarity", F.round("similarity", 6))


def _last_names(g: q.Graph) -> DataFrame:
    """Names to look up: the last part of every qualified name, the same with its second letter left open, and the whole."""
    last = F.element_at(F.split("qualified_name", r"\."), -1)
    names = F.explode(F.array(last, F.concat(F.substr(last, F.lit(1), F.lit(1)), F.lit("_"), F.substr(last, F.lit(3))), F.col("qualified_name")))
    return g["symbols"].select("repository_id", names.alias("name")).distinct()


def _pr_files(g: q.Graph) -> DataFrame:
    return g["pr_contains_commit"].join(g["commit_modifies_file"].select("commit_id", "file_id"), "commit_id").select(F.col("pull_request_id").alias("set_id"), "file_id").distinct()


def _issue_keys(g: q.Graph) -> DataFrame:
    """Numbers to look up: every pull request's own and the one after it."""
    prs = g["pull_requests"]
    return prs.select("repository_id", "number").unionByName(prs.select("repository_id", (F.col("number") + 1).alias("number"))).distinct()


_PLANS: dict[str, Callable[[q.Graph], DataFrame]] = {
    "q01_callers_of": q.callers_of,
    "q02_callees_of": q.callees_of,
    "q03_symbols_in_file": q.symbols_in_file,
    "q04_recent_commits": q.recent_commits_touching,
    "q05_authors_of_file": lambda g: q.authors_of_file(g, since()),
    "q06_reviewers_of_file": lambda g: q.reviewers_of_file(g, since()),
    "q07_similar_prs": lambda g: q.similar_prs(g, query_prs(g)).select("query_id", "pull_request_id", "number", "title", "state", "login", "rank"),
    "q08_similar_prs_scored": lambda g: _rounded(q.similar_prs(g, query_prs(g))),
    "q09_similar_adrs": lambda g: _rounded(q.similar_adrs(g, query_prs(g))),
    "q10_files_touched_by_pr": q.files_touched_by_pr,
    "q11_revert_commits": lambda g: q.revert_commits_touching(g, since()),
    "q12_commit_counts": lambda g: q.commit_count_for_file_since(g, since()),
    "q13_issue_by_number": lambda g: q.issue_by_number(g, _issue_keys(g)),
    "q14_open_prs": q.open_prs_assigned_to,
    "q15_acceptance": lambda g: q.review_acceptance_rate(g, since()),
    "q16_last_activity": q.last_activity_at,
    "q17_call_graph_overlap": lambda g: q.call_graph_overlap_counts(g, _pr_files(g), since()),
    "q18_codeowners_for": q.codeowners_for,
    "q19_symbol_by_name": lambda g: q.symbol_by_qualified_name(g, _last_names(g)),
    "q20_file_by_path": q.file_by_path,
}


def _query(plan: Callable[[q.Graph], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plan(graph(spark, sf_dir))


QUERIES = {name: _query(plan) for name, plan in _PLANS.items()}

_TOUCH = "FROM v_commit_modifies_file m JOIN v_commits c ON c.id = m.commit_id"
_AUTHOR = "LEFT JOIN v_persons p ON p.id = c.author_id"


def _search(items: str, columns: str, joins: str = "") -> str:
    return f"""WITH asked AS (SELECT id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM v_pull_requests WHERE number % 100 = 0 AND len(embedding) = 64 AND (list_max(embedding) <> 0 OR list_min(embedding) <> 0)),
items AS (SELECT *, CAST(embedding AS DOUBLE[]) AS v FROM {items} WHERE len(embedding) = 64 AND (list_max(embedding) <> 0 OR list_min(embedding) <> 0)),
scored AS (SELECT query_id, items.*, round(list_cosine_similarity(q, v), 9) AS s FROM asked, items),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM scored)
SELECT {columns} FROM ranked r {joins} WHERE rank <= 5"""


_SQL = {
    "q01_callers_of": "SELECT DISTINCT k.callee_id, s.id AS caller_id, s.qualified_name, s.kind, f.path, s.start_line FROM v_symbol_calls k JOIN v_symbols s ON s.id = k.caller_id JOIN v_files f ON f.id = s.file_id",
    "q02_callees_of": "SELECT DISTINCT k.caller_id, s.id AS callee_id, s.qualified_name, s.kind, f.path, s.start_line FROM v_symbol_calls k JOIN v_symbols s ON s.id = k.callee_id JOIN v_files f ON f.id = s.file_id",
    "q03_symbols_in_file": """SELECT s.file_id, s.id AS symbol_id, s.qualified_name, s.kind, f.path, s.start_line,
        row_number() OVER (PARTITION BY s.file_id ORDER BY s.start_line, s.qualified_name, s.id) AS ordinal FROM v_symbols s JOIN v_files f ON f.id = s.file_id""",
    "q04_recent_commits": f"""WITH r AS (SELECT m.file_id, c.*, row_number() OVER (PARTITION BY m.file_id ORDER BY c.committed_at DESC, c.sha) AS rank {_TOUCH})
        SELECT c.file_id, c.sha, c.message, c.committed_at, p.github_login AS login, c.rank FROM r c {_AUTHOR} WHERE rank <= 5""",
    "q05_authors_of_file": f"SELECT m.file_id, p.id AS person_id, p.github_login AS login, count(*) AS n {_TOUCH} JOIN v_persons p ON p.id = c.author_id WHERE c.committed_at >= {_S} GROUP BY ALL",
    "q06_reviewers_of_file": f"""SELECT m.file_id, p.id AS person_id, p.github_login AS login, count(DISTINCT r.id) AS n FROM v_reviews r JOIN v_persons p ON p.id = r.reviewer_id
        JOIN v_pr_contains_commit x ON x.pull_request_id = r.pull_request_id JOIN v_commit_modifies_file m ON m.commit_id = x.commit_id WHERE r.submitted_at >= {_S} GROUP BY ALL""",
    "q07_similar_prs": _search("v_pull_requests", "query_id, r.id AS pull_request_id, number, title, state, p.github_login AS login, rank", "LEFT JOIN v_persons p ON p.id = r.author_id"),
    "q08_similar_prs_scored": _search("v_pull_requests", "query_id, r.id AS pull_request_id, number, title, state, p.github_login AS login, round(s, 6) AS similarity, rank", "LEFT JOIN v_persons p ON p.id = r.author_id"),
    "q09_similar_adrs": _search("v_adrs", "query_id, r.id AS adr_id, path, title, status, round(s, 6) AS similarity, rank"),
    "q10_files_touched_by_pr": "SELECT DISTINCT x.pull_request_id, f.path FROM v_pr_contains_commit x JOIN v_commit_modifies_file m ON m.commit_id = x.commit_id JOIN v_files f ON f.id = m.file_id",
    "q11_revert_commits": f"""SELECT m.file_id, c.sha, c.message, c.committed_at, p.github_login AS login, row_number() OVER (PARTITION BY m.file_id ORDER BY c.committed_at DESC, c.sha) AS rank
        {_TOUCH} {_AUTHOR} WHERE c.committed_at >= {_S} AND lower(c.message) LIKE 'revert%'""",
    "q12_commit_counts": f"SELECT f.id AS file_id, coalesce(k.n, 0) AS n FROM v_files f LEFT JOIN (SELECT m.file_id, count(*) AS n {_TOUCH} WHERE c.committed_at >= {_S} GROUP BY 1) k ON k.file_id = f.id",
    "q13_issue_by_number": """SELECT k.repository_id, k.number, i.id AS issue_id, i.title, i.state FROM (
        SELECT repository_id, number FROM v_prs UNION SELECT repository_id, number + 1 FROM v_prs) k LEFT JOIN v_issues i ON i.repository_id = k.repository_id AND i.number = k.number""",
    "q14_open_prs": "SELECT p.id AS person_id, count(r.id) AS n FROM v_persons p LEFT JOIN v_prs r ON r.author_id = p.id AND r.state = 'open' GROUP BY 1",
    "q15_acceptance": f"""SELECT p.id AS person_id, CAST(coalesce(sum(CASE WHEN upper(r.state) = 'APPROVED' THEN 1 ELSE 0 END), 0) AS BIGINT) AS approved, count(r.id) AS total
        FROM v_persons p LEFT JOIN v_reviews r ON r.reviewer_id = p.id AND r.submitted_at >= {_S} GROUP BY 1""",
    "q16_last_activity": """SELECT p.id AS person_id, greatest(c.at, r.at) AS last_at FROM v_persons p
        LEFT JOIN (SELECT author_id, max(committed_at) AS at FROM v_commits GROUP BY 1) c ON c.author_id = p.id LEFT JOIN (SELECT reviewer_id, max(submitted_at) AS at FROM v_reviews GROUP BY 1) r ON r.reviewer_id = p.id""",
    "q17_call_graph_overlap": f"""WITH own AS (SELECT DISTINCT x.pull_request_id AS set_id, s.id AS symbol_id FROM v_pr_contains_commit x JOIN v_commit_modifies_file m ON m.commit_id = x.commit_id JOIN v_symbols s ON s.file_id = m.file_id),
        near AS (SELECT o.set_id, k.callee_id AS symbol_id FROM own o JOIN v_symbol_calls k ON k.caller_id = o.symbol_id UNION SELECT o.set_id, k.caller_id FROM own o JOIN v_symbol_calls k ON k.callee_id = o.symbol_id)
        SELECT n.set_id, c.author_id AS person_id, count(DISTINCT n.symbol_id) AS n FROM near n JOIN v_commit_modifies_symbol z ON z.symbol_id = n.symbol_id JOIN v_commits c ON c.id = z.commit_id
        WHERE c.committed_at >= {_S} AND c.author_id IS NOT NULL GROUP BY ALL""",
    "q18_codeowners_for": f"SELECT f.path, p.id AS person_id, p.github_login AS login, count(*) AS n {_TOUCH} JOIN v_files f ON f.id = m.file_id JOIN v_persons p ON p.id = c.author_id GROUP BY ALL",
    "q19_symbol_by_name": """WITH lasts AS (SELECT repository_id, split_part(qualified_name, '.', -1) AS name FROM v_symbols),
        names AS (SELECT repository_id, name FROM lasts UNION SELECT repository_id, substr(name, 1, 1) || '_' || substr(name, 3) FROM lasts UNION SELECT repository_id, qualified_name FROM v_symbols),
        hit AS (SELECT n.repository_id, n.name, min(s.id) AS symbol_id, n.name AS qualified_name FROM names n JOIN v_symbols s ON s.repository_id = n.repository_id AND s.qualified_name = n.name GROUP BY ALL),
        miss AS (SELECT * FROM names n WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.repository_id = n.repository_id AND h.name = n.name))
        SELECT * FROM hit UNION ALL SELECT m.repository_id, m.name, min(s.id), min(s.qualified_name) FROM miss m JOIN v_symbols s ON s.repository_id = m.repository_id AND s.qualified_name LIKE '%.' || m.name GROUP BY ALL HAVING count(*) = 1""",
    "q20_file_by_path": f"""WITH latest AS (SELECT m.file_id, max(c.committed_at) AS at {_TOUCH} GROUP BY 1),
        r AS (SELECT f.*, row_number() OVER (PARTITION BY f.repository_id, f.path ORDER BY l.at DESC NULLS LAST, f.id) AS n FROM v_files f LEFT JOIN latest l ON l.file_id = f.id) SELECT repository_id, path, id AS file_id FROM r WHERE n = 1""",
}
ORACLE = {name: with_views(sql) for name, sql in _SQL.items()}
