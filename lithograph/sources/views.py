"""The graph over a directory of test tables.

Tables that the directory lacks are derived from those it has; the definitions
are SQL that Spark and DuckDB read alike, so that both sides of a comparison
see the same rows. Rows delivered twice are one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

from lithograph.tables import load

#: In the order of their use. Names in braces are tables of the directory or views before.
VIEWS = {
    "v_persons": "SELECT DISTINCT id, github_login, name, email FROM {persons}",
    "v_files": "SELECT DISTINCT id, repository_id, path, language, content_hash FROM {files}",
    "v_symbols": "SELECT DISTINCT id, repository_id, file_id, qualified_name, kind, signature, ast_hash, start_line, end_line FROM {symbols}",
    "v_symbol_calls": "SELECT DISTINCT id, caller_id, callee_id, line, dynamic FROM {symbol_calls}",
    "v_commits": "SELECT DISTINCT id, repository_id, sha, author_id, message, committed_at FROM {commits}",
    "v_commit_modifies_file": "SELECT DISTINCT id, commit_id, file_id FROM {commit_modifies_file}",
    "v_adrs": "SELECT DISTINCT id, repository_id, path, title, status, body, embedding FROM {adrs}",
    "v_prs": "SELECT DISTINCT id, repository_id, number, title, body, state, author_id, head_sha, created_at FROM {pull_requests}",
    "v_vectors": "SELECT DISTINCT tag, vector FROM {embedding_results} WHERE kind = 'prose'",
    "v_pull_requests": "SELECT p.*, e.vector AS embedding FROM {v_prs} p LEFT JOIN {v_vectors} e ON e.tag = p.id",
    "v_pr_contains_commit": """SELECT DISTINCT p.id AS pull_request_id, c.id AS commit_id FROM {v_prs} p JOIN {v_commits} c
        ON c.repository_id = p.repository_id AND c.author_id = p.author_id AND c.committed_at <= p.created_at AND c.committed_at >= p.created_at - INTERVAL 14 DAYS""",
    "v_reviews": """SELECT p.id || ':' || q.id AS id, p.id AS pull_request_id, q.author_id AS reviewer_id, p.created_at + INTERVAL 1 DAY AS submitted_at,
          CASE WHEN q.state = 'open' THEN 'approved' WHEN lower(q.state) = 'merged' THEN 'APPROVED' ELSE 'CHANGES_REQUESTED' END AS state
        FROM {v_prs} p JOIN {v_prs} q ON q.repository_id = p.repository_id AND q.number = p.number + 1 WHERE q.author_id IS NOT NULL""",
    "v_issues": "SELECT id, repository_id, number, title, lower(state) AS state FROM {v_prs}",
    # Owner files of every repository: a default, kinds of files, and a line for each pair of directories in one of four forms.
    "v_owner_dirs": """SELECT repository_id, a, b, low, high, row_number() OVER (PARTITION BY repository_id ORDER BY a, b) AS n FROM (
          SELECT f.repository_id, split_part(f.path, '/', 1) AS a, split_part(f.path, '/', 2) AS b, min(p.github_login) AS low, max(p.github_login) AS high FROM {v_files} f
          JOIN {v_commit_modifies_file} m ON m.file_id = f.id JOIN {v_commits} c ON c.id = m.commit_id JOIN {v_persons} p ON p.id = c.author_id GROUP BY 1, 2, 3)""",
    "v_owner_lines": """SELECT id AS repository_id, 0 AS line_no, '# Owners of ' || name AS line FROM {repositories} UNION SELECT id, 1, '* @' || owner || '/maintainers' FROM {repositories}
        UNION SELECT id, 2, '*.sql @' || owner || '/data data@mail.example' FROM {repositories} UNION SELECT id, 3, '' FROM {repositories} UNION SELECT id, 4, '/docs/ docs@mail.example' FROM {repositories}
        UNION SELECT repository_id, 4 + n, CASE WHEN n % 4 = 0 THEN '/' || a || '/' || b || '/ @' || low || '  @' || high WHEN n % 4 = 1 THEN a || '/' || b || '/** @' || high
          WHEN n % 4 = 2 THEN '/' || a || '/' || b || '/*/m*.?? @' || low ELSE a || '/' || b || '/orphan' END FROM {v_owner_dirs}
        UNION SELECT id, 1000000, 'tracing.* @' || owner || '/tracing @nobody-knows' FROM {repositories}""",
    "v_commit_modifies_symbol": "SELECT DISTINCT m.commit_id, s.id AS symbol_id FROM {v_commit_modifies_file} m JOIN {v_symbols} s ON s.file_id = m.file_id",
}
VIEW_OF = {v[2:]: v for v in VIEWS if v not in ("v_prs", "v_vectors", "v_owner_dirs")}
#: Tables that are read as they are.
PLAIN = ("repositories", "source_texts")


class Tables(Mapping):
    """The graph's tables by name, each read or derived when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._spark, self._dir = spark, sf_dir
        self._known: dict[str, DataFrame] = {}

    def _need(self, name: str) -> DataFrame:
        if name not in self._known:
            sql = VIEWS.get(name)
            used = {k: self._need(k) for k in dict.fromkeys(re.findall(r"\{(\w+)\}", sql))} if sql else {}
            self._known[name] = self._spark.sql(sql, **used) if sql else load(self._spark, self._dir, name)
        return self._known[name]

    def __getitem__(self, table: str) -> DataFrame:
        if table not in VIEW_OF and table not in PLAIN:
            raise KeyError(table)
        return self._need(VIEW_OF.get(table, table))

    def __iter__(self) -> Iterator[str]:
        yield from (*VIEW_OF, *PLAIN)

    def __len__(self) -> int:
        return len(VIEW_OF) + len(PLAIN)


def graph(spark: SparkSession, sf_dir: str) -> Tables:
    """The graph over a directory of test tables."""
    return Tables(spark, sf_dir)


def with_views(sql: str) -> str:
    """A query over the views as plain SQL over the tables: the views it needs become common table expressions."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in needed and name in text:
                need(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    need(sql)
    plain = {n: re.sub(r"\{(\w+)\}", r"\1", VIEWS[n]) for n in sorted(needed, key=list(VIEWS).index)}
    body = sql.strip()
    ctes = ",\n".join(f"{n} AS ({s})" for n, s in plain.items())
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"
