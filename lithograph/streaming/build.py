"""Building the graph of sources, and keeping it up with changes.

Both ways give the same tables: ids are hashes of natural keys (repository and
path; file and qualified name), so a symbol keeps its id while its text
changes, and a table holds the latest version of each path. Call edges are a
set keyed by caller, callee and line.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithograph.functions import text as tx
from lithograph.functions.extraction import extracted
from lithograph.sources import merge
from lithograph.sources.tree import adrs_among, in_adr_dir, with_order
from lithograph.tables import checkpointed

State = Mapping[str, DataFrame]
#: The tables of a state and their keys.
TABLES = {"files": ("id",), "symbols": ("id",), "symbol_calls": ("caller_id", "callee_id", "line"), "adrs": ("id",)}
SCHEMAS = {
    "files": "id string, repository_id string, path string, language string, content_hash string, file_order string",
    "symbols": "id string, repository_id string, file_id string, qualified_name string, kind string, signature string, ast_hash string, start_line int, end_line int",
    "symbol_calls": "caller_id string, callee_id string, line int, dynamic boolean",
    "adrs": "id string, repository_id string, path string, title string, status string, body string",
}


def hashed(*parts: Column) -> Column:
    """An id from a natural key."""
    return F.sha2(F.concat_ws("\u0000", *parts), 256)


def empty_state(spark: SparkSession) -> dict[str, DataFrame]:
    """A graph without rows."""
    return {name: spark.createDataFrame([], SCHEMAS[name]) for name in TABLES}


def parsed_files(sources: DataFrame) -> DataFrame:
    """Files (repository_id, path, content) with ids, hashes and what their texts hold; files of unknown languages are left out."""
    rows = sources.select("repository_id", "path", "content").where(F.col("path").isNotNull() & F.col("content").isNotNull())
    rows = with_order(rows.groupBy("repository_id", "path").agg(F.min("content").alias("content"))).withColumn("language", tx.language_by_extension(F.col("path"))).where(F.col("language").isNotNull())
    rows = rows.withColumn("id", hashed(F.col("repository_id"), F.col("path"))).withColumn("content_hash", tx.content_hash(F.col("content")))
    return extracted(rows, language="language")


def symbols_of(parsed: DataFrame) -> DataFrame:
    """Symbols of parsed files. Of several definitions of one name in a file the last one counts."""
    rows = parsed.select("repository_id", F.col("id").alias("file_id"), F.explode("symbols").alias("s")).select("repository_id", "file_id", "s.*")
    rest = F.struct("kind", "signature", "ast_hash", "start_line", "end_line")
    last = rows.groupBy("repository_id", "file_id", "qualified_name").agg(F.max_by(rest, F.struct("start_line", "end_line")).alias("d"))
    return last.select(hashed(F.col("file_id"), F.col("qualified_name")).alias("id"), "repository_id", "file_id", "qualified_name", "d.*")


def name_index(symbols: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols by (repository_id, name): of a qualified name the first file's, and by dotted ending if only one qualified name has it."""
    order = files.select(F.col("id").alias("file_id"), "file_order")
    exact = symbols.join(order, "file_id").groupBy("repository_id", F.col("qualified_name").alias("name")).agg(F.min_by("id", F.struct("file_order", "start_line")).alias("symbol_id"))
    parts = F.split("name", r"\.")
    tails = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    ends = exact.where(F.col("name").contains(".")).select("repository_id", "symbol_id", F.explode(tails).alias("ending"))
    only = ends.groupBy("repository_id", F.col("ending").alias("name")).agg(F.count("*").alias("n"), F.min("symbol_id").alias("symbol_id")).where(F.col("n") == 1).drop("n")
    return exact, only


def resolved_calls(parsed: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Every call of ``parsed`` with caller_id and callee_id, null where it cannot be resolved.

    A target is looked up in its own file, then by the imports in their order,
    then in the whole repository; there an exact name comes before a dotted
    ending that only one name has. Each step is an equi-join.
    """
    calls = parsed.select("repository_id", F.col("id").alias("file_id"), F.posexplode("calls").alias("call_no", "c")).select("repository_id", "file_id", "call_no", "c.*")
    exact, only = name_index(symbols, files)
    own = symbols.select("file_id", F.col("qualified_name").alias("name"), F.col("id").alias("symbol_id"))
    call = ["file_id", "call_no"]
    callers = own.select("file_id", F.col("name").alias("caller_qualified_name"), F.col("symbol_id").alias("caller_id"))
    calls = calls.join(callers, ["file_id", "caller_qualified_name"])
    still = calls.where(~F.col("dynamic"))
    # Only imports that bind the first part of the target, or the whole of it, are looked at.
    imports = parsed.select(F.col("id").alias("file_id"), F.explode("imports").alias("i")).withColumn("first", F.substring_index(tx.bound_name(F.col("i.kind"), F.col("i.module"), F.col("i.symbol"), F.col("i.alias")), ".", 1))
    bound = still.withColumn("first", F.substring_index("target_name", ".", 1)).select("repository_id", *call, "target_name", "first").join(imports, ["file_id", "first"]).select("repository_id", *call, F.col("i.place").alias("place"), tx.imported_name(F.col("i.kind"), F.col("i.module"), F.col("i.symbol"), F.col("i.alias"), F.col("target_name")).alias("name")).where(F.col("name").isNotNull())
    # One lookup serves both steps; the plain name comes after all imports.
    asked = bound.unionByName(still.select("repository_id", *call, F.lit(2_000_000_000).alias("place"), F.col("target_name").alias("name")))
    hits = asked.join(exact.withColumnRenamed("symbol_id", "by_name"), ["repository_id", "name"], "left").join(only.withColumnRenamed("symbol_id", "by_ending"), ["repository_id", "name"], "left")
    hits = hits.withColumn("found", F.coalesce("by_name", "by_ending")).where(F.col("found").isNotNull())
    far = hits.groupBy(*call).agg(F.min_by("found", "place").alias("far_id"))
    near = still.select(*call, F.col("target_name").alias("name")).join(own.withColumnRenamed("symbol_id", "near_id"), ["file_id", "name"]).select(*call, "near_id")
    rows = calls.join(near, call, "left").join(far, call, "left")
    return rows.select("repository_id", "file_id", "caller_id", F.when(~F.col("dynamic"), F.coalesce("near_id", "far_id")).alias("callee_id"), "line", "dynamic", "target_name")


def edges(resolved: DataFrame) -> DataFrame:
    """The call edges of resolved calls, each once."""
    return resolved.where(F.col("callee_id").isNotNull()).select("caller_id", "callee_id", "line", "dynamic").distinct()


def dropped(resolved: DataFrame) -> DataFrame:
    """One row: dynamic_calls_dropped, unresolved_calls_dropped (I5). Calls outside any known symbol are not counted."""
    return resolved.agg(F.count_if("dynamic").alias("dynamic_calls_dropped"), F.count_if(~F.col("dynamic") & F.col("callee_id").isNull()).alias("unresolved_calls_dropped"))


def adrs_of(sources: DataFrame) -> DataFrame:
    """Decision records among files (repository_id, path, content)."""
    rows = adrs_among(sources.select("repository_id", "path", "content").where(F.col("content").isNotNull()))
    return rows.select(hashed(F.col("repository_id"), F.col("path")).alias("id"), "repository_id", "path", "title", "status", F.col("content").alias("body")).dropDuplicates(["id"])


def full_build(sources: DataFrame) -> dict[str, DataFrame]:
    """The graph of all files (repository_id, path, content) (I1). Files are parsed once, whatever is read of the result."""
    parsed = checkpointed(parsed_files(sources))
    files = parsed.select("id", "repository_id", "path", "language", "content_hash", "file_order")
    symbols = symbols_of(parsed)
    return {"files": files, "symbols": symbols, "symbol_calls": edges(resolved_calls(parsed, symbols, files)), "adrs": adrs_of(sources)}


def changes_to(state: State, changes: DataFrame) -> dict[str, tuple[DataFrame, DataFrame]]:
    """What changes (repository_id, path, kind A/M/D, content) do to each table: the keys that go and the rows that come.

    One change per path is expected; of several the deletion, else the least
    text counts. Deleted files take their symbols and all edges of those with
    them; edges from files that did not change to symbols that went do not come
    back by themselves. A file that is no decision record any more loses its
    record; other files of unknown languages are ignored.
    """
    # What a batch changes is kept as it is computed: the tables read it several times, and later batches build on it.
    last = changes.where(F.col("path").isNotNull()).groupBy("repository_id", "path").agg(F.bool_or((F.col("kind") == "D") | F.col("content").isNull()).alias("gone"), F.min("content").alias("content"))
    touched = checkpointed(last.select(hashed(F.col("repository_id"), F.col("path")).alias("id"), "repository_id", "path", "gone", "content"))
    parsed = checkpointed(parsed_files(touched.where(~F.col("gone"))))
    ids = touched.select("id").distinct()
    new_files = parsed.select("id", "repository_id", "path", "language", "content_hash", "file_order")
    files = merge.without(state["files"], ids, "id").unionByName(new_files)
    kept = merge.without(state["symbols"], ids, "file_id")
    old_symbols = checkpointed(state["symbols"].join(ids.withColumnRenamed("id", "file_id"), "file_id", "left_semi").select("id"))
    new_symbols = symbols_of(parsed)
    # Edges out of changed files are made anew; edges into symbols that are no more go with them.
    removed = old_symbols.join(new_symbols.select("id"), "id", "left_anti")
    calls = state["symbol_calls"]
    key = list(TABLES["symbol_calls"])
    old_calls = checkpointed(calls.join(old_symbols.withColumnRenamed("id", "caller_id"), "caller_id", "left_semi").select(*key).unionByName(calls.join(removed.withColumnRenamed("id", "callee_id"), "callee_id", "left_semi").select(*key)).distinct())
    new_calls = checkpointed(edges(resolved_calls(parsed, kept.unionByName(new_symbols), files)))
    here = touched.where(in_adr_dir(F.col("path")))
    return {"files": (ids, new_files), "symbols": (old_symbols, new_symbols), "symbol_calls": (old_calls, new_calls), "adrs": (here.select("id").distinct(), adrs_of(here.where(~F.col("gone"))))}


def applied(state: State, changes: DataFrame) -> dict[str, DataFrame]:
    """The graph after changes, as ``changes_to`` tells them."""
    out = {}
    for name, (gone, new) in changes_to(state, changes).items():
        out[name] = state[name].join(gone, list(TABLES[name]), "left_anti").select(*new.columns).unionByName(new)
    return out


def change_stats(state: State, after: State) -> DataFrame:
    """One row: files and symbols added, changed, removed and unchanged between two states."""
    both = state["files"].select("id", F.col("content_hash").alias("old")).join(after["files"].select("id", F.col("content_hash").alias("new")), "id", "full_outer")
    names = state["symbols"].select("id", F.col("ast_hash").alias("old")).join(after["symbols"].select("id", F.col("ast_hash").alias("new")), "id", "full_outer")
    counts = lambda prefix: [F.count_if(F.col("old").isNull()).alias(f"{prefix}_added"), F.count_if(F.col("new").isNull()).alias(f"{prefix}_removed"), F.count_if(F.col("old") != F.col("new")).alias(f"{prefix}_changed"), F.count_if(F.col("old") == F.col("new")).alias(f"{prefix}_unchanged")]
    return both.agg(*counts("files")).join(names.agg(*counts("symbols")), F.lit(True))


def maintain(changes: DataFrame, root: str, checkpoint: str, trigger_once: bool = True):
    """A streaming query that applies batches of changes (batch_no, repository_id, path, kind, content) to the graph below ``root``.

    Each batch reads the newest version and writes what it changes as the next
    one, numbered by the batch, so a batch that runs again writes the same
    version again. Every COMPACT versions the tables are written whole.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = merge.open_version(spark, root, number, TABLES) if number else empty_state(spark)
        merge.save_changes(changes_to(state, batch), root, number + 1)
        if (number + 1) % merge.COMPACT == 0:
            # The changes just written end this stretch; they are read back rather than computed again.
            merge.save_whole(merge.open_since(spark, root, number + 1 - merge.COMPACT, number + 1, TABLES), root, number + 1)

    writer = changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if trigger_once else writer).start()


def embedded(pending: DataFrame, cache: DataFrame, provider: Callable[[list[str], str], list[list[float]]], model: str, batch: int = 100) -> tuple[DataFrame, DataFrame]:
    """Vectors of pending texts (tag, kind, content), and the cache (key, vector) with the new ones.

    Texts whose key is cached are not sent; equal texts are sent once, in
    batches of at most ``batch``. A provider that returns another number of
    vectors is an error. Null texts have no vector.
    """
    keyed = pending.where(F.col("content").isNotNull()).withColumn("key", tx.embedding_key(F.lit(model), F.col("content")))
    missing = keyed.select("key", "content").distinct().join(cache.select("key"), "key", "left_anti")

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                vectors = provider(part["content"].tolist(), model)
                if len(vectors) != len(part):
                    raise ValueError(f"{len(part)} texts were sent, {len(vectors)} vectors came back")
                yield pd.DataFrame({"key": part["key"].to_numpy(), "vector": [list(map(float, v)) for v in vectors]})

    fresh = missing.mapInPandas(ask, "key string, vector array<float>")
    whole = cache.select("key", "vector").unionByName(fresh)
    known = cache.select("key", F.lit(True).alias("cache_hit")).distinct()
    rows = keyed.join(whole, "key").join(known, "key", "left").select("tag", "kind", "vector", F.coalesce("cache_hit", F.lit(False)).alias("cache_hit"))
    return rows, whole


def embedding_stats(rows: DataFrame) -> DataFrame:
    """Texts, hits and misses per kind."""
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("cache_hit").alias("hits"), F.count_if(~F.col("cache_hit")).alias("misses"))
