"""Reading working trees and changes: sources, decision records, owner files, diffs (SC1-SC7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithograph.functions import text as tx
from lithograph.functions.paths import OWNER_FILES

# Directories that hold no sources, and those of decision records.
SKIPPED = (".git", ".venv", "venv", "node_modules", "__pycache__", "dist", "build")
ADR_DIRS = ("docs/adr", "docs/architecture", "docs/decisions", ".adr")


def _read(spark: SparkSession, root: str, glob: str) -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/") + "/"
    full = F.regexp_replace("path", r"^file:/+", "/")
    # Bytes that are no UTF-8 give a null text and drop out. The reader skips files without a byte; they hold no symbols.
    return raw.select(F.substr(full, F.lit(len(base) + 1)).alias("path"), F.try_validate_utf8(F.col("content").cast("string")).alias("content")).where(F.col("content").isNotNull())


def source_files(spark: SparkSession, root: str, extension: str = ".py") -> DataFrame:
    """path, content, file_order of a tree's sources; the order is depth first, by name in each directory."""
    inside = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    rows = _read(spark, root, f"*{extension}").where(~F.arrays_overlap(inside, F.array(*[F.lit(d) for d in SKIPPED])))
    return with_order(rows)


def with_order(files: DataFrame) -> DataFrame:
    """``files`` with file_order, a value that sorts paths component by component."""
    return files.withColumn("file_order", F.regexp_replace("path", "/", "\u0001"))


def adr_files(spark: SparkSession, root: str) -> DataFrame:
    """path, content of decision records below the directories that hold them."""
    return adrs_among(_read(spark, root, "*.md"))


def in_adr_dir(path: Column) -> Column:
    """Whether a path, with either slash, is a Markdown file below a directory of decision records."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    below = F.lit(False)
    for directory in ADR_DIRS:
        below = below | clean.startswith(directory + "/")
    return below & clean.endswith(".md")


def adrs_among(files: DataFrame) -> DataFrame:
    """``files`` that are decision records by place and content, with title and status."""
    rows = files.where(in_adr_dir(F.col("path")) & tx.is_adr(F.col("content")))
    return rows.withColumn("title", tx.adr_title(F.col("path"), F.col("content"))).withColumn("status", tx.adr_status(F.col("content")))


def owner_file(files: DataFrame, key: str = "repository_id") -> DataFrame:
    """key, content of the owner file of each repository: the first place that has one."""
    place = F.array_position(F.array(*[F.lit(p) for p in OWNER_FILES]), F.col("path"))
    return files.where(F.col("path").isin(*OWNER_FILES) & F.col("content").isNotNull()).groupBy(key).agg(F.min_by("content", place).alias("content"))


def module_files(files: DataFrame, directory: str) -> DataFrame:
    """Python files below a directory; paths that leave the tree are not below it (SC6)."""
    return files.where(F.col("path").startswith(directory.rstrip("/") + "/") & F.col("path").endswith(".py") & ~F.col("path").contains("../"))


def diff_changes(diffs: DataFrame, key: str = "repository_id", text: str = "diff") -> DataFrame:
    """key, path, kind (A, M, D) of NUL-separated name-status diffs (SC4).

    A rename is a deletion and an addition, a copy an addition; other letters
    count as modified. A null diff has no change.
    """
    parts = F.split(F.col(text), "\u0000")
    # A record is a status with one path, or with two for renames and copies; the state is (status, old path, changes).
    empty = F.struct(F.lit("").alias("status"), F.lit("").alias("old"), F.array().cast("array<struct<path: string, kind: string>>").alias("out"))
    change = lambda path, kind: F.array(F.struct(path.alias("path"), kind.alias("kind")))

    def step(state: Column, word: Column) -> Column:
        letter = F.substring(state["status"], 1, 1)
        two = letter.isin("R", "C")
        moved = F.when(letter == "R", F.concat(change(state["old"], F.lit("D")), change(word, F.lit("A")))).otherwise(change(word, F.lit("A")))
        single = change(word, F.when(letter.isin("A", "D"), letter).otherwise(F.lit("M")))
        kept = lambda status, old, out: F.struct(status.alias("status"), old.alias("old"), out.alias("out"))
        return (
            F.when((state["status"] == "") & (word == ""), state)
            .when(state["status"] == "", kept(word, F.lit(""), state["out"]))
            .when(two & (state["old"] == ""), kept(state["status"], word, state["out"]))
            .when(two, kept(F.lit(""), F.lit(""), F.concat(state["out"], moved)))
            .otherwise(kept(F.lit(""), F.lit(""), F.concat(state["out"], single)))
        )

    return diffs.where(F.col(text).isNotNull()).select(key, F.explode(F.aggregate(parts, empty, step, lambda s: s["out"])).alias("c")).select(key, "c.path", "c.kind")


def caller_snippets(callers: DataFrame, sources: DataFrame, before: int = 0) -> DataFrame:
    """``callers`` (repository_id, path, start_line, end_line, signature) with ``snippet``: the lines of the symbol, else its signature (SC7)."""
    joined = callers.join(sources.select("repository_id", "path", F.split("content", r"\r\n|\n|\r").alias("__lines")), ["repository_id", "path"], "left")
    lines = F.slice("__lines", F.greatest(F.col("start_line") - before, F.lit(1)), F.greatest(F.col("end_line") - F.col("start_line") + 1 + before, F.lit(1)))
    found = F.col("__lines").isNotNull() & (F.size("__lines") >= F.col("start_line"))
    return joined.withColumn("snippet", F.when(found, F.array_join(lines, "\n")).otherwise(F.concat(F.coalesce("signature", F.lit("")), F.lit("\n    ...")))).drop("__lines")
