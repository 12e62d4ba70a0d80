"""Builds and incremental upkeep over whole tables, and the same as SQL.

The sources are written from the graph itself: every function of a file that
``symbols`` and ``symbol_calls`` know becomes a definition whose body makes its
calls, directly, by imported name, by alias or through a module. SQL tells what
a build must find in them without ever seeing a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithograph.operators import graph as q
from lithograph.sources import merge
from lithograph.sources.views import graph, with_views
from lithograph.streaming import build
from lithograph.tables import checkpointed

_LAST = r"\."


def _digit(column: str, at: int = 1) -> Column:
    """A hexadecimal digit of the hash of an id; the same in SQL."""
    return F.substr(F.md5(column), F.lit(at), F.lit(1))


def definitions(g: q.Graph, of: DataFrame | None = None) -> DataFrame:
    """repository_id, file_id, name, body, imports: one definition per file and function name, with the calls of all symbols of the name."""
    last = F.element_at(F.split("qualified_name", _LAST), -1)
    symbols = g["symbols"].select("id", "repository_id", "file_id", last.alias("name"), "kind").join(g["files"].select(F.col("id").alias("file_id")), "file_id", "left_semi")
    functions = symbols.where(F.col("kind").isin("function", "method"))
    calls = (g["symbol_calls"] if of is None else of).select(F.col("id").alias("call_id"), "caller_id", "callee_id", "dynamic")
    said = calls.join(g["symbols"].select(F.col("id").alias("callee_id"), last.alias("target")), "callee_id").join(functions.select(F.col("id").alias("caller_id"), "file_id", "name"), "caller_id")
    digit, target = _digit("call_id"), F.col("target")
    written = F.when(F.col("dynamic"), F.lit("(a or a)")).when(digit.between("4", "7"), F.concat(F.lit("z_"), target)).when(digit.between("8", "b"), F.concat(F.lit("mod."), target)).otherwise(target)
    imported = F.when(F.col("dynamic"), None).when(digit.between("4", "7"), F.concat(F.lit("from pkg.m import "), target, F.lit(" as z_"), target)).when(digit.between("8", "b"), F.lit("import pkg.mod")).when(digit >= "c", F.concat(F.lit("from pkg.m import "), target))
    bodies = said.groupBy("file_id", "name").agg(F.sort_array(F.collect_list(F.concat(F.lit("    "), written, F.lit("()\n")))).alias("lines"), F.collect_set(imported).alias("imports"))
    none = F.array().cast("array<string>")
    return functions.select("repository_id", "file_id", "name").distinct().join(bodies, ["file_id", "name"], "left").select("repository_id", "file_id", "name", F.array_join(F.coalesce("lines", none), "").alias("body"), F.coalesce("imports", none).alias("imports"))


def written_sources(g: q.Graph, of: DataFrame | None = None) -> DataFrame:
    """repository_id, file_id, path, content of every file that has functions."""
    head = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("imports")))), "\n")
    block = F.concat(F.lit("def "), "name", F.lit("(a):\n"), "body", F.lit("    return a\n"))
    texts = definitions(g, of).groupBy("repository_id", "file_id").agg(F.concat(head, F.lit("\n\n"), F.array_join(F.array_sort(F.collect_list(block)), "\n")).alias("content"))
    return texts.select("repository_id", "file_id", F.concat(F.lit("src/"), "file_id", F.lit(".py")).alias("path"), "content")


def _named(state: dict[str, DataFrame]) -> DataFrame:
    """symbol_id, file_id, name of a state's symbols, with the ids of the tables that the sources were written from."""
    files = state["files"].select(F.col("id").alias("hashed"), F.regexp_extract("path", r"^src/(.*)\.py$", 1).alias("file_id"))
    return state["symbols"].select(F.col("id").alias("symbol_id"), F.col("file_id").alias("hashed"), F.col("qualified_name").alias("name")).join(files, "hashed").drop("hashed")


def _edges(state: dict[str, DataFrame], calls: DataFrame | None = None) -> DataFrame:
    names = _named(state)
    one = names.select(F.col("symbol_id").alias("caller_id"), F.col("file_id").alias("caller_file"), F.col("name").alias("caller"))
    two = names.select(F.col("symbol_id").alias("callee_id"), F.col("file_id").alias("callee_file"), F.col("name").alias("callee"))
    return (state["symbol_calls"] if calls is None else calls).join(one, "caller_id").join(two, "callee_id").select("caller_file", "caller", "callee_file", "callee").distinct()


def _built(g: q.Graph) -> dict[str, DataFrame]:
    return build.full_build(checkpointed(written_sources(g)).drop("file_id"))


def _dropped(g: q.Graph) -> DataFrame:
    parsed = checkpointed(build.parsed_files(written_sources(g).drop("file_id")))
    return build.dropped(build.resolved_calls(parsed, build.symbols_of(parsed), parsed))


def _upkeep(g: q.Graph) -> tuple[dict[str, DataFrame], DataFrame]:
    """A build of all files but those that are added later, and the changes: deletions, edits that drop calls and add a function, and additions."""
    sources = checkpointed(written_sources(g)).withColumn("digit", _digit("file_id"))
    state = {name: checkpointed(df) for name, df in build.full_build(sources.where(F.col("digit") != "6").select("repository_id", "path", "content")).items()}
    fewer = written_sources(g, g["symbol_calls"].where(_digit("id", 2) < "8")).withColumn("digit", _digit("file_id"))
    added = F.concat("content", F.lit("\ndef added_"), F.substr(F.md5("file_id"), F.lit(1), F.lit(6)), F.lit("(a):\n    return a\n"))
    edited = fewer.where(F.col("digit").between("2", "5")).select("repository_id", "path", F.lit("M").alias("kind"), added.alias("content"))
    others = sources.where(F.col("digit").isin("0", "1", "6")).select("repository_id", "path", F.when(F.col("digit") == "6", "A").otherwise("D").alias("kind"), F.when(F.col("digit") == "6", F.col("content")).alias("content"))
    return state, checkpointed(edited.unionByName(others))


def _after(g: q.Graph) -> dict[str, DataFrame]:
    return build.applied(*_upkeep(g))


def _went(g: q.Graph) -> tuple[dict[str, DataFrame], dict[str, tuple[DataFrame, DataFrame]]]:
    state, changes = _upkeep(g)
    return state, build.changes_to(state, changes)


def _cascaded(g: q.Graph) -> DataFrame:
    state, parts = _went(g)
    gone, new = parts["symbols"]
    return _named(state).join(gone.join(new.select("id"), "id", "left_anti").withColumnRenamed("id", "symbol_id"), "symbol_id", "left_semi").select("file_id", "name")


def _lost(g: q.Graph) -> DataFrame:
    """Edges from files that did not change into symbols that went."""
    state, parts = _went(g)
    gone = state["symbol_calls"].join(parts["symbol_calls"][0], ["caller_id", "callee_id", "line"], "left_semi")
    return _edges(state, merge.without(gone, parts["symbols"][0], "caller_id"))


def _stats(g: q.Graph) -> DataFrame:
    state, changes = _upkeep(g)
    return build.change_stats(state, build.applied(state, changes))


def _recorded_files(g: q.Graph) -> DataFrame:
    """Files as first seen, then seen again at another commit with some contents changed: those get a row of their own."""
    first = g["files"].select("id", "repository_id", "path", "language", "content_hash", F.lit("s1").alias("first_seen_sha"), F.lit("s1").alias("last_seen_sha"))
    digit = _digit("id")
    current = first.where(digit != "0")
    seen = first.where(digit != "1").withColumns({"content_hash": F.when(digit < "4", F.concat(F.lit("new "), "content_hash")).otherwise(F.col("content_hash")), "first_seen_sha": F.lit("s2"), "last_seen_sha": F.lit("s2")})
    return merge.files_recorded(current, seen).select("repository_id", "path", "content_hash", "first_seen_sha", "last_seen_sha")


def _recorded_symbols(g: q.Graph) -> DataFrame:
    """Symbols of a build, then of the next one, in which some have another body and all have moved by a line."""
    first = g["symbols"].groupBy("file_id", "qualified_name", "ast_hash").agg(F.min("start_line").alias("start_line")).withColumns({"signature": F.lit("old"), "end_line": F.col("start_line")})
    digit = _digit("file_id")
    seen = first.where(digit != "1").select("file_id", "qualified_name", F.when(digit < "4", F.concat(F.lit("new "), "ast_hash")).otherwise(F.col("ast_hash")).alias("ast_hash"), (F.col("start_line") + 1).alias("start_line"), F.lit("new").alias("signature"), (F.col("end_line") + 1).alias("end_line"))
    return merge.symbols_recorded(first.where(digit != "0"), seen)


def _cached(g: q.Graph) -> DataFrame:
    """Embedding of the texts of all symbols and decision records, half of which are in the cache; per kind the texts, hits and misses."""
    from lithograph.functions import text as tx

    code = g["symbols"].select(F.col("id").alias("tag"), F.lit("code").alias("kind"), tx.symbol_embed_text(F.col("kind"), F.col("signature"), F.col("qualified_name")).alias("content"))
    pending = code.unionByName(g["adrs"].select(F.col("id").alias("tag"), F.lit("prose").alias("kind"), F.col("body").alias("content")))
    known = pending.where(F.substr(F.md5("content"), F.lit(1), F.lit(1)) < "8").select(tx.embedding_key(F.lit("m"), F.col("content")).alias("key")).distinct().withColumn("vector", F.array(F.lit(0.0).cast("float")))
    rows, _ = build.embedded(pending, known, lambda texts, model: [[float(len(t))] for t in texts], "m")
    return build.embedding_stats(rows)


_PLANS: dict[str, Callable[[q.Graph], DataFrame]] = {
    "i2_built_symbols": lambda g: _named(_built(g)).select("file_id", "name"),
    "i3_built_edges": lambda g: _edges(_built(g)),
    "i5_dropped_calls": _dropped,
    "i6_applied": lambda g: _named(_after(g)).select("file_id", "name"),
    "i7_edges_after": lambda g: _edges(_after(g)),
    "i8_cascade": _cascaded,
    "i9_lost_edges": _lost,
    "i10_embedding_stats": _cached,
    "a13_change_stats": _stats,
    "sc10_files_recorded": _recorded_files,
    "sc12_symbols_recorded": _recorded_symbols,
}


def _query(plan: Callable[[q.Graph], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plan(graph(spark, sf_dir))


QUERIES = {name: _query(plan) for name, plan in _PLANS.items()}

_WRITTEN = """fn AS (SELECT DISTINCT s.repository_id, s.file_id, split_part(s.qualified_name, '.', -1) AS name, substr(md5(s.file_id), 1, 1) AS digit FROM v_symbols s JOIN v_files f ON f.id = s.file_id WHERE s.kind IN ('function', 'method')),
said AS (SELECT k.id, c.repository_id, c.file_id, split_part(c.qualified_name, '.', -1) AS name, substr(md5(c.file_id), 1, 1) AS digit, k.dynamic, split_part(d.qualified_name, '.', -1) AS target,
  substr(md5(k.id), 1, 1) BETWEEN '4' AND 'b' AS apart, substr(md5(k.id), 2, 1) AS kept FROM v_symbol_calls k JOIN v_symbols c ON c.id = k.caller_id JOIN v_files f ON f.id = c.file_id JOIN v_symbols d ON d.id = k.callee_id WHERE c.kind IN ('function', 'method'))"""


def _resolved(name: str, index: str, calls: str) -> str:
    """Calls with the file of their callee: the own file if the target is written plainly, else the first of the repository that has the name."""
    return f"""{name} AS (SELECT c.*, CASE WHEN NOT c.dynamic THEN coalesce(o.file_id, l.file_id) END AS callee_file FROM ({calls}) c LEFT JOIN {index} o ON o.file_id = c.file_id AND o.name = c.target AND NOT c.apart
  LEFT JOIN (SELECT repository_id, name, min(file_id) AS file_id FROM {index} GROUP BY 1, 2) l ON l.repository_id = c.repository_id AND l.name = c.target)"""


_EDGE = "SELECT DISTINCT file_id AS caller_file, name AS caller, callee_file, target AS callee FROM"
_UPKEEP = f"""{_WRITTEN}, before AS (SELECT * FROM fn WHERE digit <> '6'),
after AS (SELECT * FROM fn WHERE digit NOT IN ('0', '1') UNION SELECT repository_id, file_id, 'added_' || substr(md5(file_id), 1, 6), digit FROM fn WHERE digit BETWEEN '2' AND '5'),
{_resolved('old_calls', 'before', "SELECT * FROM said WHERE digit <> '6'")},
{_resolved('new_calls', 'after', "SELECT * FROM said WHERE digit = '6' OR (digit BETWEEN '2' AND '5' AND kept < '8')")}"""
_GONE = "substr(md5(callee_file), 1, 1) IN ('0', '1')"
_SQL = {
    "i2_built_symbols": f"WITH {_WRITTEN} SELECT file_id, name FROM fn",
    "i3_built_edges": f"WITH {_WRITTEN}, {_resolved('r', 'fn', 'SELECT * FROM said')} {_EDGE} r WHERE callee_file IS NOT NULL",
    "i5_dropped_calls": f"WITH {_WRITTEN}, {_resolved('r', 'fn', 'SELECT * FROM said')} SELECT count(*) FILTER (dynamic) AS dynamic_calls_dropped, count(*) FILTER (NOT dynamic AND callee_file IS NULL) AS unresolved_calls_dropped FROM r",
    "i6_applied": f"WITH {_UPKEEP} SELECT file_id, name FROM after",
    "i7_edges_after": f"WITH {_UPKEEP} {_EDGE} (SELECT file_id, name, callee_file, target FROM old_calls WHERE callee_file IS NOT NULL AND digit > '6' AND NOT {_GONE} UNION ALL SELECT file_id, name, callee_file, target FROM new_calls WHERE callee_file IS NOT NULL) e",
    "i8_cascade": f"WITH {_UPKEEP} SELECT file_id, name FROM before WHERE digit IN ('0', '1')",
    "i9_lost_edges": f"WITH {_UPKEEP} {_EDGE} old_calls WHERE digit > '6' AND {_GONE}",
    "i10_embedding_stats": """WITH pending AS (SELECT id AS tag, 'code' AS kind, kind || ' ' || coalesce(nullif(signature, ''), qualified_name) AS content FROM v_symbols UNION ALL SELECT id, 'prose', body FROM v_adrs WHERE body IS NOT NULL)
        SELECT kind, count(*) AS n, count(*) FILTER (substr(md5(content), 1, 1) < '8') AS hits, count(*) FILTER (substr(md5(content), 1, 1) >= '8') AS misses FROM pending GROUP BY 1""",
    "a13_change_stats": f"""WITH {_UPKEEP}, edited AS (SELECT file_id, name, coalesce(bool_or(kept >= '8'), false) AS less FROM before LEFT JOIN said USING (file_id, name) WHERE before.digit BETWEEN '2' AND '5' GROUP BY 1, 2)
        SELECT count(DISTINCT file_id) FILTER (digit = '6') AS files_added, count(DISTINCT file_id) FILTER (digit IN ('0', '1')) AS files_removed, count(DISTINCT file_id) FILTER (digit BETWEEN '2' AND '5') AS files_changed, count(DISTINCT file_id) FILTER (digit > '6') AS files_unchanged,
        count(*) FILTER (digit = '6') + (SELECT count(*) FROM after WHERE starts_with(name, 'added_')) AS symbols_added, count(*) FILTER (digit IN ('0', '1')) AS symbols_removed, (SELECT count(*) FROM edited WHERE less) AS symbols_changed,
        count(*) FILTER (digit > '6') + (SELECT count(*) FROM edited WHERE NOT less) AS symbols_unchanged FROM fn""",
    "sc10_files_recorded": """WITH f AS (SELECT repository_id, path, content_hash, substr(md5(id), 1, 1) AS d FROM v_files), seen AS (SELECT repository_id, path, CASE WHEN d < '4' THEN 'new ' ELSE '' END || content_hash AS content_hash FROM f WHERE d <> '1')
        SELECT repository_id, path, content_hash, 's1' AS first_seen_sha, CASE WHEN EXISTS (SELECT 1 FROM seen s WHERE s.repository_id = f.repository_id AND s.path = f.path AND s.content_hash = f.content_hash) THEN 's2' ELSE 's1' END AS last_seen_sha FROM f WHERE d <> '0'
        UNION ALL SELECT DISTINCT repository_id, path, content_hash, 's2', 's2' FROM seen s WHERE NOT EXISTS (SELECT 1 FROM f WHERE d <> '0' AND s.repository_id = f.repository_id AND s.path = f.path AND s.content_hash = f.content_hash)""",
    "sc12_symbols_recorded": """WITH f AS (SELECT file_id, qualified_name, ast_hash, min(start_line) AS start_line, substr(md5(file_id), 1, 1) AS d FROM v_symbols GROUP BY ALL)
        SELECT file_id, qualified_name, ast_hash, start_line + CASE WHEN d >= '4' THEN 1 ELSE 0 END AS start_line, CASE WHEN d >= '4' THEN 'new' ELSE 'old' END AS signature, start_line + CASE WHEN d >= '4' THEN 1 ELSE 0 END AS end_line FROM f WHERE d <> '0'
        UNION ALL SELECT file_id, qualified_name, 'new ' || ast_hash, start_line + 1, 'new', start_line + 1 FROM f WHERE d < '4' AND d <> '1'""",
}
ORACLE = {name: with_views(sql) for name, sql in _SQL.items()}
