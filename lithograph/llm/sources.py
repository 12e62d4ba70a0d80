"""Telling hand-written source files from generated, minified, vendored and data files.

Each file gets layout statistics (longest and mean line, shares of white space
and of letters and digits, share of numeric literals, share of long encoded
runs, share of lines shaped like the line before). Thresholds are tuned per
language: they follow the statistics of that language's own files, kept within
fixed limits so that a language full of generated files cannot move them far.
The layout is joined by what the path and the leading comment say. All of it is
Spark expressions; no Python runs on the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithograph.tables import checkpointed

# Languages by file extension.
LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript",
    "css": "css", "scss": "css", "less": "css", "sql": "sql", "go": "go", "java": "java", "rs": "rust", "rb": "ruby", "c": "c", "h": "c", "cc": "c++", "cpp": "c++", "hpp": "c++",
    "cs": "c#", "php": "php", "kt": "kotlin", "swift": "swift", "scala": "scala", "sh": "shell", "html": "html", "xml": "xml", "json": "json", "yaml": "yaml", "yml": "yaml", "md": "markdown",
}
# Directories that hold copies of third-party code, as patterns of a path component.
VENDORED_DIRS = r"node_modules|bower_components|jspm_packages|_?vendor|vendored|third[_-]?party|externals?|extern|site-packages|dist-packages|Godeps|deps|Pods|Carthage"
# Directories and file names of generated code.
GENERATED_DIRS = r"__generated__|_?generated|autogen|auto_?generated|gen|\.gen|generated-sources"
GENERATED_NAMES = r"(?:_pb2(?:_grpc)?\.pyi?|\.pb(?:\.gw)?\.(?:go|cc|h)|_pb\.(?:js|d\.ts)|\.g\.(?:ts|dart|cs)|\.g\.i\.cs|\.generated\.\w+|\.gen\.\w+|[_-]generated\.\w+|_gen\.go|\.designer\.\w+)$|(?:^|/)zz_generated[._]\w[\w.]*$"
# File names of minified and bundled code.
MINIFIED_NAMES = r"[.-]min\.(?:js|css|mjs|cjs)$|\.(?:bundle|pack|chunk|umd\.min)\.(?:js|css|mjs)$|[.-][0-9a-f]{8,}\.(?:js|css|mjs)$"
# Sentences by which tools and importers sign files, looked for in the leading comment only.
GENERATED_HEADER = (
    r"(?i)auto-?generated|(?:automatically|machine)[- ](?:generated|produced|created|written)|code generated by|@generated\b|\bgenerated (?:by|from|with|using)\b"
    r"|\b(?:output|product) (?:of|from) [\w.-]+ v?\d|do not (?:edit|modify|change)|don't (?:edit|modify)|changes (?:will|may) be (?:lost|overwritten)"
    r"|maschinell erzeugt|automatisch (?:erzeugt|generiert)|généré automatiquement|ne pas modifier|generado automáticamente|no editar|自動生成|自动生成|автоматически сгенерирован"
)
VENDORED_HEADER = (
    r"(?i)vendored (?:copy|from|version)|third-party copy|\bcopy of [\w.-]+ \(?v?\d+\.\d+|\bimported from \S+ at (?:tag|commit|revision)|upstream-(?:version|commit|url)\s*:"
    r"|\(c\) the [\w.-]+ (?:contributors|authors|developers)|spdx-filecopyrighttext:\s*[\w.-]+ (?:maintainers|contributors|authors)"
)
MINIFIED_MARK = r"(?m)^\s*(?://|/\*)[#@] sourceMappingURL="
#: The whole comment at the top of a file, blocks up to their closing sign (or the end, if none) and lines; a docstring is code and not part of it.
#: What follows a closing sign on its line is read too. All parts are possessive, so a text is passed once, however long its comment.
_HEAD = r"^\ufeff?+(?:\s*+(?:/\*(?:[^*]++|\*(?!/))*+(?:\*/|\z)|<!--(?:[^-]++|-(?!->))*+(?:-->|\z)|(?://|#|--|\*|;)[^\n]*+(?:\n|\z)))++"
# Escaped bytes in a row, and runs of letters, digits and signs of base64; of the runs those count that have a digit and a small letter, as words and paths are shorter or have none.
_ESCAPED = r"(?:\\x[0-9a-fA-F]{2}){16,}+|(?:0x[0-9a-fA-F]{2},\s*+){16,}+"
_RUN = r"[A-Za-z0-9+/_]{56,}+={0,2}"
_NUMBER = r"(?<![\w.#])[-+]?(?:\d+\.\d+|\d+)(?:[eE][-+]?\d+)?(?![\w.])"

#: Lowest and highest values that tuning may give a threshold.
LIMITS = {"max_line": (200.0, 300.0), "mean_line": (90.0, 130.0), "space_share": (0.07, 0.11), "alnum_share": (0.9, 0.97), "number_share": (0.3, 0.5), "encoded_share": (0.3, 0.5), "same_shape_share": (0.75, 0.9)}


def surely(share: Column, count: Column) -> Column:
    """The lower bound of a share seen in ``count`` lines or characters, one standard error down (Wilson); short texts show less, none is left out."""
    n = F.greatest(count.cast("double"), F.lit(1.0))
    return (share + 0.5 / n - F.sqrt(F.greatest(share * (1 - share), F.lit(0.0)) / n + 0.25 / (n * n))) / (1 + 1 / n)


def language_of(path: Column, language: Column) -> Column:
    """The language by file extension, else the given one in lower case, else 'other'."""
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    given = F.lower(F.trim(language))
    return F.coalesce(F.try_element_at(names, extension), F.when(given.isin(*sorted(set(LANGUAGES.values()))), given), F.lit("other"))


def layout(df: DataFrame, content: str = "content") -> DataFrame:
    """``df`` with the layout statistics of its texts in the columns n_chars, n_lines and those of LIMITS."""
    text = F.col(content)
    chars = F.length(text)
    share = lambda kept: F.when(chars > 0, kept / chars).otherwise(0.0)
    removed = lambda pattern: chars - F.length(F.regexp_replace(text, pattern, ""))
    lines = F.filter(F.split(text, r"\r\n|\n|\r"), lambda x: F.trim(x) != "")
    lengths = F.transform(F.col("__lines"), F.length)
    count = F.size("__lines")
    shapes = F.transform(F.col("__lines"), lambda x: F.regexp_replace(F.regexp_replace(x, r"[A-Za-z_]+", "a"), r"a?[0-9]+(?:a?[0-9]*)*", "0"))
    same = F.zip_with(F.slice("__shapes", 1, F.greatest(count - 1, F.lit(0))), F.slice("__shapes", 2, F.greatest(count - 1, F.lit(0))), lambda a, b: F.when(a == b, 1).otherwise(0))
    return (
        df.withColumn("__lines", lines).withColumn("__shapes", shapes)
        .withColumn("n_chars", chars).withColumn("n_lines", count)
        .withColumn("max_line", F.coalesce(F.array_max(lengths), F.lit(0)).cast("double"))
        .withColumn("mean_line", F.when(count > 0, F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x) / count).otherwise(0.0))
        .withColumn("space_share", share(removed(r"\s+")))
        .withColumn("alnum_share", share(removed(r"[A-Za-z0-9]+")))
        .withColumn("number_share", share(removed(_NUMBER)))
        .withColumn("encoded_share", share(removed(_ESCAPED) + F.aggregate(F.filter(F.regexp_extract_all(text, F.lit(_RUN), 0), lambda x: x.rlike("[0-9]") & x.rlike("[a-z]")), F.lit(0), lambda a, x: a + F.length(x))))
        .withColumn("same_shape_share", F.when(count > 1, F.aggregate(same, F.lit(0), lambda a, x: a + x) / (count - 1)).otherwise(0.0))
        .drop("__lines", "__shapes")
    )


def thresholds(stats: DataFrame) -> DataFrame:
    """One row per language: the threshold of each statistic, the usual value and a multiple of its usual distance, within LIMITS.

    Usual value and distance are the median and the span from the median to the
    upper (for white space the lower) quartile over all files of the language.
    """
    cut = []
    for name, (low, high) in LIMITS.items():
        middle = F.percentile_approx(name, 0.5, 1000)
        far = F.percentile_approx(name, 0.25 if name == "space_share" else 0.75, 1000)
        factor = 3.0 if name == "space_share" else 5.0
        cut.append(F.least(F.greatest(middle + factor * (far - middle), F.lit(low)), F.lit(high)).alias(f"__{name}"))
    return stats.groupBy(F.col("lang").alias("__lang")).agg(*cut)


def signs(df: DataFrame, content: str = "content") -> DataFrame:
    """``df`` with what its texts show instead of the texts: layout, and what the leading comment says. Texts need no more than this scan."""
    head = F.regexp_extract(F.coalesce(F.col(content), F.lit("")), _HEAD, 0)
    return (
        layout(df, content).withColumn("__says_vendored", head.rlike(VENDORED_HEADER)).withColumn("__says_generated", head.rlike(GENERATED_HEADER))
        .withColumn("__maps", F.coalesce(F.col(content).rlike(MINIFIED_MARK), F.lit(False))).drop(content)
    )


def classified(df: DataFrame, path: str = "path", language: str = "language", content: str = "content") -> DataFrame:
    """``df`` without its text, with the layout columns, ``origin`` (generated, minified, vendored, data or hand_written) and ``evidence`` (path, header or layout, null for hand-written ones).

    A null or empty text is judged by its path alone; a null path by the text
    alone. Repeated rows get the same answer each; an empty table gives an
    empty table. The texts are read once: what they say is kept in a few
    columns before thresholds are taken.
    """
    return judged(signs(df, content), path, language)


def judged(shown: DataFrame, path: str = "path", language: str = "language") -> DataFrame:
    """``classified`` for rows whose texts ``signs`` has read; rows without signs are judged by their path."""
    stats = shown.withColumn("lang", language_of(F.col(path), F.col(language)))
    stats = checkpointed(stats)
    # One row per known language, so the broadcast has at most len(LANGUAGES) + 1 rows.
    tuned = stats.join(F.broadcast(thresholds(stats)), F.col("lang") == F.col("__lang"), "left")
    at = F.coalesce(F.col(path), F.lit(""))
    over = lambda name: F.col(name) > F.col(f"__{name}")
    share_over = lambda name, count: surely(F.col(name), F.col(count)) > F.col(f"__{name}")
    dense = F.col("space_share") < F.col("__space_share")
    data = F.coalesce(share_over("number_share", "n_chars") | share_over("encoded_share", "n_chars") | (over("alnum_share") & over("max_line")), F.lit(False))
    repeated = share_over("same_shape_share", "n_lines")
    squeezed = over("max_line") & over("mean_line") & dense
    mapped = F.col("__maps") & over("max_line")
    # In the order in which they count.
    ways = (
        ("vendored", "path", at.rlike(rf"(?i)(?:^|/)(?:{VENDORED_DIRS})/")), ("vendored", "header", F.coalesce("__says_vendored", F.lit(False))), ("generated", "header", F.coalesce("__says_generated", F.lit(False))),
        ("generated", "path", at.rlike(rf"(?:^|/)(?:{GENERATED_DIRS})/") | at.rlike(GENERATED_NAMES)), ("minified", "path", at.rlike(MINIFIED_NAMES)), ("minified", "layout", (squeezed & ~data) | mapped),
        ("data", "layout", data), ("generated", "layout", repeated),
    )
    verdict = F.struct(F.lit("hand_written").alias("origin"), F.lit(None).cast("string").alias("evidence"))
    for origin, evidence, holds in reversed(ways):
        verdict = F.when(holds, F.struct(F.lit(origin).alias("origin"), F.lit(evidence).alias("evidence"))).otherwise(verdict)
    out = tuned.withColumn("__verdict", verdict).withColumn("origin", F.col("__verdict.origin")).withColumn("evidence", F.col("__verdict.evidence"))
    return out.drop("__verdict", "__lang", "__says_vendored", "__says_generated", "__maps", *[f"__{n}" for n in LIMITS])
