"""Schemas of the graph's node and edge tables, and their check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = {
    "repositories": "id string, github_id long, owner string, name string, installation_id long, default_branch string, last_indexed_sha string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "persons": "id string, github_login string, github_id long, name string, email string",
    "files": "id string, repository_id string, path string, language string, content_hash string, first_seen_sha string, last_seen_sha string",
    "symbols": "id string, repository_id string, file_id string, qualified_name string, kind string, signature string, ast_hash string, start_line int, end_line int",
    "commits": "id string, repository_id string, sha string, author_id string, message string, committed_at timestamp_ntz",
    "pull_requests": "id string, repository_id string, number int, title string, body string, state string, author_id string, head_sha string, base_sha string, merged_at timestamp_ntz, created_at timestamp_ntz, embedding array<float>",
    "reviews": "id string, pull_request_id string, reviewer_id string, state string, body string, submitted_at timestamp_ntz",
    "review_comments": "id string, review_id string, file_id string, line int, body string, resolved boolean",
    "adrs": "id string, repository_id string, path string, title string, status string, body string, embedding array<float>",
    "issues": "id string, repository_id string, number int, title string, state string",
}
EDGES = {
    "symbol_calls": "id string, caller_id string, callee_id string, line int, dynamic boolean",
    "symbol_imports": "id string, importer_id string, imported_id string, kind string, lazy boolean, raw string",
    "commit_modifies_file": "id string, commit_id string, file_id string, change_kind string, prior_path string",
    "commit_modifies_symbol": "commit_id string, symbol_id string, change_kind string, details map<string,string>",
    "pr_contains_commit": "pull_request_id string, commit_id string",
    "pr_references_issue": "pull_request_id string, issue_id string",
    "file_references_adr": "file_id string, adr_id string",
}
TABLES = NODES | EDGES
#: What a change to a pull request's file or symbol looks like.
CHANGED_FILES = "pull_request_id string, ordinal int, path string, change_kind string, patch string, language string"
CHANGED_SYMBOLS = "pull_request_id string, ordinal int, qualified_name string, kind string, change_kind string, old_source string, new_source string, file_path string"


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with the table's columns, types and order; missing columns are null, further ones are dropped."""
    fields = [f.strip().split(" ", 1) for f in TABLES[table].replace("map<string,string>", "map<string;string>").split(",")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t.replace(";", ",")).alias(n) for n, t in fields])


def checked_vector(df: DataFrame, column: str, dim: int) -> DataFrame:
    """``df`` with vectors of another length, or with a null in them, made null."""
    good = (F.size(column) == dim) & ~F.exists(column, lambda x: x.isNull())
    return df.withColumn(column, F.when(good, F.col(column)))
