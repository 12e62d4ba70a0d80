"""Owner rules: parsing, glob patterns as regular expressions, and the last rule that matches a path."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places of the owner file, the first existing one counts (SC5).
OWNER_FILES = (".github/CODEOWNERS", "docs/CODEOWNERS", "CODEOWNERS")
#: Paths of one repository that meet its rules in one block, about.
BLOCK_PATHS = 50_000


def owner_rules(files: DataFrame, key: str = "repository_id", text: str = "content") -> DataFrame:
    """key, line_no, pattern, owners, regex of each rule of each owner file.

    Blank lines, comments, lines without an owner and owners without ``@`` are
    left out; ``@`` is stripped. A null text has no rules.
    """
    lines = files.select(F.col(key), F.posexplode(F.split(F.col(text), r"\r\n|\n|\r")).alias("line_no", "line"))
    words = lines.withColumn("words", F.filter(F.split("line", r"\s+"), lambda w: w != "")).where((F.size("words") > 1) & ~F.get("words", F.lit(0)).startswith("#"))
    owners = F.transform(F.filter(F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(1))), lambda w: w.startswith("@")), lambda w: F.substr(w, F.lit(2)))
    rules = words.select(key, "line_no", F.get("words", F.lit(0)).alias("pattern"), owners.alias("owners")).where(F.size("owners") > 0)
    return rules.withColumn("regex", glob_regex(F.col("pattern")))


def glob_regex(pattern: Column) -> Column:
    """The regular expression of an owner pattern.

    A leading slash anchors, a trailing one means everything below, a pattern
    without a slash matches anywhere. ``**`` crosses directories and takes a
    following slash with it, ``*`` and ``?`` stay within one.
    """
    anchored = pattern.startswith("/")
    body = F.regexp_replace(F.regexp_replace(pattern, "^/", ""), "/$", "/**")
    free = ~anchored & ~body.contains("/") & ~body.startswith("**")
    body = F.when(free, F.concat(F.lit("**/"), body)).otherwise(body)
    quoted = F.regexp_replace(body, r"([.\\+^$(){}|\[\]])", r"\\$1")
    # Marks keep the wildcards apart while the longer one is written out.
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(quoted, r"\*\*/?", "\u0001"), r"\*", "\u0002"), r"\?", "\u0003")
    written = F.replace(F.replace(F.replace(marked, F.lit("\u0001"), F.lit(".*")), F.lit("\u0002"), F.lit("[^/]*")), F.lit("\u0003"), F.lit("[^/]"))
    return F.concat(F.lit("(?s)^(?:"), written, F.lit(")$"))


def owners_of(paths: DataFrame, rules: DataFrame, key: str = "repository_id") -> DataFrame:
    """``paths`` (key, path) with the owners of the last rule that matches; paths without one are left out.

    Paths of a repository meet its rules in blocks of about BLOCK_PATHS, so a
    repository that holds a third of all paths is work for many tasks. A block
    compiles each rule once and walks them from the last one, over the paths
    that none has matched yet. The rules of a repository are one file's lines.
    """
    asked = paths.select(key, "path").distinct().where(F.col(key).isNotNull() & F.col("path").isNotNull())
    blocks = asked.groupBy(key).agg(F.ceil(F.count("*") / BLOCK_PATHS).cast("int").alias("blocks"))
    left = asked.join(blocks, key).select(key, F.pmod(F.xxhash64("path"), F.col("blocks")).cast("int").alias("block"), "path")
    right = rules.join(blocks, key).select(key, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "line_no", "regex", "owners")
    kind = left.schema[key].dataType.simpleString()

    def walk(some: pa.Table, said: pa.Table) -> pa.Table:
        out = [some.select([key, "path"]).slice(0, 0).append_column("owners", pa.array([], pa.list_(pa.string())))]
        rest = some.select([key, "path"])
        said = said.sort_by([("line_no", "descending")])
        for pattern, owners in zip(said.column("regex").to_pylist(), said.column("owners").to_pylist(), strict=True):
            if not rest.num_rows:
                break
            hit = pc.match_substring_regex(rest.column("path"), pattern)
            found = rest.filter(hit)
            if found.num_rows:
                out.append(found.append_column("owners", pa.array([owners] * found.num_rows, pa.list_(pa.string()))))
                rest = rest.filter(pc.invert(hit))
        return pa.concat_tables(out)

    return left.groupBy(key, "block").cogroup(right.groupBy(key, "block")).applyInArrow(walk, f"{key} {kind}, path string, owners array<string>")


def owners_united(groups: DataFrame, rules: DataFrame, group: str, key: str = "repository_id") -> DataFrame:
    """group, owners (sorted, each once): the union of the owners of all paths of a group (A12); groups without one are left out."""
    owned = groups.select(group, key, "path").join(owners_of(groups, rules, key), [key, "path"])
    return owned.select(group, F.explode("owners").alias("owner")).groupBy(group).agg(F.sort_array(F.collect_set("owner")).alias("owners"))
