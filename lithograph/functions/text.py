"""Text functions of the graph as column expressions (F1-F3, F6-F8, F12-F16), and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shape of a decision record and of references to issues. Word boundaries are those of all scripts.
ADR_STATUS = r"(?mi)^[ \t]*Status:[ \t]*([^\r\n]*)"
ADR_SECTION = r"(?mi)^##[ \t]+(?:context|decision)\b"
ISSUE_NUMBER = r"(?i)(?<![\p{L}\p{N}_])(?:fix(?:e[sd])?|clos(?:e[sd])?|resolv(?:e[sd])?)\s*[:\-]?\s*#(\d+)(?![\p{L}\p{N}_])"
ISSUE_EXTERNAL = r"(?i)(?<![\p{L}\p{N}_])(?:fix(?:e[sd])?|clos(?:e[sd])?|resolv(?:e[sd])?)\s*[:\-]?\s*([A-Z][A-Z0-9]+-\d+)(?![\p{L}\p{N}_])"
ISSUE_BARE = r"(?<![\p{L}\p{N}_])([A-Z][A-Z0-9]+-\d+)(?![\p{L}\p{N}_])"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
LANGUAGE_EXTENSIONS = {".py": "python"}


def is_adr(text: Column) -> Column:
    """Whether a text is a decision record: a status line and a context or decision section (F1). Null is not."""
    return F.coalesce(text.rlike(ADR_STATUS) & text.rlike(ADR_SECTION), F.lit(False))


def adr_title(path: Column, text: Column) -> Column:
    """The first top heading, else the file's stem with spaces for hyphens (F2)."""
    heading = F.trim(F.regexp_extract(text, r"(?m)^# +([^\r\n]+)", 1))
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1), "-", " ")
    return F.when(heading != "", heading).otherwise(stem)


def adr_status(text: Column) -> Column:
    """The first word of the status line in lower case, null without one (F2)."""
    word = F.lower(F.regexp_extract(F.regexp_extract(text, ADR_STATUS, 1), r"^\W*(\w[\w-]*)", 1))
    return F.when(word != "", word)


def issue_refs(body: Column) -> Column:
    """array<struct<kind, identifier, number>> of a body's references, each once, in the order number, verb, bare."""
    text = F.coalesce(body, F.lit(""))
    numbers = F.transform(F.regexp_extract_all(text, F.lit(ISSUE_NUMBER), 1), lambda n: F.struct(F.lit("github").alias("kind"), F.concat(F.lit("#"), n.try_cast("long").cast("string")).alias("identifier"), n.try_cast("int").alias("number")))
    external = F.concat(F.regexp_extract_all(text, F.lit(ISSUE_EXTERNAL), 1), F.regexp_extract_all(text, F.lit(ISSUE_BARE), 1))
    others = F.transform(external, lambda i: F.struct(F.lit("external").alias("kind"), i.alias("identifier"), F.lit(None).cast("int").alias("number")))
    return F.array_distinct(F.concat(numbers, others))


def first_line(text: Column) -> Column:
    """The first line that is not blank, stripped; null without one."""
    return F.try_element_at(F.filter(F.transform(F.split(text, LINE_ENDS), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""), F.lit(1))


def short_sha(sha: Column) -> Column:
    """The first seven characters of a commit's name."""
    return F.substring(sha, 1, 7)


def symbol_embed_text(kind: Column, signature: Column, qualified_name: Column) -> Column:
    """What is embedded for a symbol: its kind, and its signature or else its name (F8)."""
    return F.concat_ws(" ", kind, F.coalesce(F.nullif(signature, F.lit("")), qualified_name))


def pr_prose(title: Column, body: Column, files: Column | None = None) -> Column:
    """What is embedded for a pull request: title and body, and the changed files if given (F9). Empty parts are left out."""
    parts = [title, body] + ([F.array_join(F.transform(files, lambda f: F.concat(F.lit("- "), f)), "\n")] if files is not None else [])
    return F.array_join(F.filter(F.array(*[F.trim(F.coalesce(p, F.lit(""))) for p in parts]), lambda x: x != ""), "\n\n")


def diff_lines(patch: Column) -> Column:
    """Added and removed lines of a unified diff; file headers do not count, null has none."""
    lines = F.split(F.coalesce(patch, F.lit("")), LINE_ENDS)
    return F.size(F.filter(lines, lambda x: (x.startswith("+") | x.startswith("-")) & ~x.startswith("+++") & ~x.startswith("---")))


def counted_parts(*parts: tuple[Column, str]) -> Column:
    """'2 warning, 1 info' from counts and words; zero and null counts are left out."""
    return F.array_join(F.filter(F.array(*[F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {word}"))) for n, word in parts]), lambda x: x.isNotNull()), ", ")


def summary_text(blocking: Column, warning: Column, info: Column) -> Column:
    """The one-line summary of a review."""
    said = counted_parts((blocking, "blocking"), (warning, "warning"), (info, "info"))
    return F.when(said == "", F.lit("three checks ran and found nothing to flag.")).otherwise(F.concat(F.lit("flagged "), said, F.lit(".")))


def fallback_narrative(prs: Column, adrs: Column, commits: Column, issues: Column, notes: Column) -> Column:
    """What a context packet holds, in one sentence; empty for an empty packet."""
    said = counted_parts((prs, "related PR(s)"), (adrs, "accepted ADR(s)"), (commits, "recent commit(s)"), (issues, "linked issue(s)"), (notes, "risk note(s)"))
    return F.when(said == "", F.lit("")).otherwise(F.concat(F.lit("Packet assembled: "), said, F.lit(".")))


def bullets(items: Column) -> Column:
    """A list as lines with dashes, '(none)' for an empty or null one."""
    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, F.lit("(none)")).otherwise(F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"))


def bound_name(kind: Column, module: Column, symbol: Column, alias: Column) -> Column:
    """The name that an import binds: the alias, else the symbol, else the module's last part."""
    return F.when(kind == "from", F.coalesce(alias, symbol)).otherwise(F.coalesce(alias, F.element_at(F.split(module, r"\."), -1)))


def imported_name(kind: Column, module: Column, symbol: Column, alias: Column, target: Column) -> Column:
    """The name that a call's target means under an import, null if the import does not bind it."""
    bound = bound_name(kind, module, symbol, alias)
    inner = F.when(target.startswith(F.concat(bound, F.lit("."))), F.substr(target, F.length(bound) + 2))
    whole = F.when((kind == "from") & (target == bound), symbol)
    return F.coalesce(whole, inner)


def language_by_extension(path: Column) -> Column:
    """The language of a path that a parser exists for, else null (F16)."""
    out = F.lit(None).cast("string")
    for extension, language in LANGUAGE_EXTENSIONS.items():
        out = F.when(path.endswith(extension), F.lit(language)).otherwise(out)
    return out


def like_suffix(name: Column) -> Column:
    """The LIKE pattern of a dotted suffix; wildcards in the name stay wildcards."""
    return F.concat(F.lit("%."), name)


def content_hash(text: Column) -> Column:
    """SHA-256 of a file's text."""
    return F.sha2(text, 256)


def embedding_key(model: Column, content: Column) -> Column:
    """The key of a cached embedding: model and content with a zero byte between."""
    return F.sha2(F.concat(model, F.char(F.lit(0)), content), 256)
