"""Linking spellings of one person, as attribution over a noisy channel.

1. Rows that write the same personal address, in whatever notation, are one
   person. Addresses that hold their owner's name give the canonical forms, one
   per full name; how many rows use one is its prior. Two addresses of one
   domain are two people: a name they share is split by mailbox.
2. The channel is learned from the rows themselves: an address that spells out
   the given name, beside the name its owner typed, tells how often a given
   name is written as which nickname or typo.
3. Every row without such an address (none, a forwarding one, one without a
   name in it), and every form whose given name is an initial or no known name,
   is a variant. Its posterior over the forms with the same or a
   nearly same family name is prior times likelihood of family typo and of the
   given name being abbreviated, shortened or mistyped. It joins the form with
   the highest posterior if that is more likely than all others together.
4. Variants that no form explains are forms of their own by their full name.

Forms are reached by keys (the family name with one letter left out), never by
comparing all pairs; automation accounts take no part. Family names below
``FUZZY`` letters count too, but only as written: no slips, and as part of a
mailbox only between its separators or beside the given name or its initial.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithograph.tables import checkpointed, once

# Mailbox names that belong to a role, and domains that only forward.
ROLES = {"noreply", "no-reply", "donotreply", "ci", "cd", "build", "builds", "release", "releases", "deploy", "admin", "root", "ops", "devops", "dev", "support", "info", "team", "security", "bot", "bots", "automation", "git", "jenkins", "hello", "contact", "help", "office", "mail", "postmaster", "webmaster", "sysadmin", "infra", "actions"}
# Given names and their short forms.
NICKNAMES = {
    "alexander": "alex sasha sandy xander", "anthony": "tony ant", "benjamin": "ben benny", "christopher": "chris kit topher", "daniel": "dan danny", "dorothea": "dora thea dot", "eleonora": "nora ella leonora", "elizabeth": "beth liz lizzie eliza betty lisa",
    "frederick": "fred freddie freddy", "gabriela": "gaby gabi", "isabella": "bella isa", "jonathan": "jon jonny jo", "josephine": "jo josie", "katharina": "kat katja kathi", "leonard": "len leo lenny", "magdalena": "lena magda", "margaret": "maggie meg peggy", "maximilian": "max",
    "michael": "mike mick", "nicholas": "nick", "nikolai": "niko kolya", "penelope": "nell penny", "philippa": "pippa pip", "rebecca": "becca becky", "robert": "rob bob bobby", "rosalind": "rosa ros", "samuel": "sam", "stefan": "steff", "susanne": "susi sanne", "thaddeus": "tad thad",
    "theodore": "ted theo", "thomas": "tom", "valentina": "val tina", "victoria": "vicky tori", "wilhelmina": "mina willa", "william": "will bill billy", "zachary": "zach zack",
}
_NOREPLY = re.compile(r"(?:^|\.)users\.noreply\.|(?:^|\.)noreply\.")
_BOT = re.compile(r"(\[bot\]|-bot|-actions)$")
_NOTE = re.compile(r"\(.*?\)|\[.*?\]|\s[|–-]\s.*$|\|.*$|,\s*(?:ph\.?d|m\.?d|jr|sr|esq|m\.?sc|b\.?sc|ii|iii|iv)\.?\s*$", re.I)

#: Log likelihoods of the channel.
_SAME, _INITIAL, _TYPO, _UNSEEN_NICK = 0.0, -1.5, -3.5, -2.0
#: A variant joins a form only if its posterior among all candidates exceeds this.
POSTERIOR = 0.5
#: Letters from which a family name may have a slip and is looked for anywhere in a mailbox; letters of a family name at least.
FUZZY, LEAST = 4, 2


def plain(text: str) -> str:
    """Lower-case text without accents, marks of broken encodings mended."""
    if any(c in text for c in "ÃÅÄÂÐÑ"):
        for encoding in ("latin-1", "cp1252"):
            try:
                text = text.encode(encoding).decode("utf-8")
                break
            except UnicodeError:
                continue
    text = unicodedata.normalize("NFKD", text.replace("ß", "ss").replace("ø", "o").replace("ł", "l"))
    return "".join(c for c in text if not unicodedata.combining(c)).lower()


def tokens(name: str | None, login: str) -> tuple[str, str]:
    """The outer words of a name, in the order given name, family name where the writing shows it."""
    raw = re.sub(r"\s+", " ", _NOTE.sub(" ", (name or "").replace("\xa0", " "))).strip()
    if not raw or plain(raw) in ("unknown", "none", "null", "n/a") or plain(raw) == login:
        return "", ""
    if "," in raw:
        family, _, given = raw.partition(",")
        raw, ordered = f"{given.strip()} {family.strip()}", True
    else:
        raw, ordered = re.sub(r"(?<=[a-zà-ÿ])(?=[A-Z][a-zà-ÿ])(?!c)", " ", raw) if " " not in raw else raw, False
    words = raw.split(" ")
    if not ordered and len(words) > 1 and words[0].isupper() and len(words[0]) > 2 and not words[-1].isupper():
        words = [*words[1:], words[0]]
    # A double family name counts by its first part, the one also used alone.
    clean = [re.sub(r"[^\w]", "", plain(w.split("-")[0] if i else w)) for i, w in enumerate(words)]
    clean = [w for w in clean if w]
    if len(clean) < 2:
        return (clean[0] if clean else ""), ""
    return clean[0], clean[-1]


def address(email: str | None) -> tuple[str, str]:
    """Mailbox name and domain without display marks, tags and mail hosts; empty for none."""
    text = plain((email or "").strip().strip("<>").strip().removeprefix("mailto:"))
    text = re.sub(r"\s*[\[(]?\s*\b(?:at)\b\s*[\])]?\s*", "@", text) if "@" not in text else text
    box, _, domain = text.partition("@")
    if not box or not domain:
        return "", ""
    if _NOREPLY.search(domain):
        return "", ""
    return box.split("+")[0], re.sub(r"^(?:mail|smtp|mx)\.", "", domain)


def _parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for key, login, name, email in frame.itertuples(index=False):
            handle = plain(login or "").strip()
            if _BOT.search(handle):
                continue
            base = re.sub(r"\d+$", "", handle)
            box, domain = address(email)
            if box in ROLES:
                box = domain = ""
            first, last = tokens(name, handle)
            parts = [p for p in re.split(r"[-_.]", base) if p]
            rows.append((key, first, last, parts[0] if len(parts) == 2 else "", parts[1] if len(parts) == 2 else "", "".join(parts), re.sub(r"[^a-z0-9]", "", box), domain, [w for w in (re.sub(r"\d+$", "", p) for p in re.split(r"[^a-z0-9]+", box)) if w]))
        yield pd.DataFrame(rows, columns=["id", "first", "last", "part1", "part2", "handle", "box", "domain", "box_parts"])


def _within(word: Column, text: Column) -> Column:
    """Whether a word of FUZZY letters or more is part of a text."""
    return (F.length(word) >= FUZZY) & text.contains(word)


def _rest(text: Column, family: Column) -> Column:
    """What a mailbox or login has besides the family name."""
    bare = F.regexp_replace(text, r"\d+$", "")
    size = F.length(bare) - F.length(family)
    return F.when(F.length(family) == 0, F.lit("")).when(bare.startswith(family), F.substr(bare, F.length(family) + 1)).when(bare.endswith(family), F.substr(bare, F.lit(1), size)).otherwise(F.lit(""))


def people(df: DataFrame, key: str = "id", login: str = "github_login", name: str = "name", email: str = "email") -> DataFrame:
    """id, given, family, box, domain of each row that can be a person.

    Names, logins and mailboxes show the two words in any order; the word that
    more people share is the given name.
    """
    rows = once(df.select(F.col(key).alias("id"), F.col(login).cast("string").alias("login"), F.col(name).cast("string").alias("name"), F.col(email).cast("string").alias("email")).where(F.col("id").isNotNull()), "id")
    kind = rows.schema["id"].dataType.simpleString()
    parsed = checkpointed(rows.mapInPandas(_parsed, f"id {kind}, first string, last string, part1 string, part2 string, handle string, box string, domain string, box_parts array<string>"))
    # How many different initials the words beside a word have: given names stand beside many families.
    word_pairs = F.explode(F.array(*[F.struct(F.col(a).alias("word"), F.substr(b, F.lit(1), F.lit(1)).alias("beside")) for a, b in (("first", "last"), ("last", "first"), ("part1", "part2"), ("part2", "part1"))]))
    used = parsed.select(word_pairs.alias("w")).select("w.*").where((F.length("word") > 1) & (F.length("beside") > 0)).groupBy("word").agg(F.count_distinct("beside").alias("n"))
    for column in ("first", "last", "part1", "part2"):
        parsed = parsed.join(used.select(F.col("word").alias(column), F.col("n").alias(f"n_{column}")), column, "left")
    often = lambda c: F.coalesce(F.col(f"n_{c}"), F.lit(0))
    turned = (F.length("first") > 1) & (F.length("last") > 0) & (often("last") >= F.greatest(F.lit(3), 2 * often("first")))
    given = F.when(turned | (F.length("last") == 1), F.col("last")).otherwise(F.col("first"))
    family = F.when(turned | (F.length("last") == 1), F.col("first")).otherwise(F.col("last"))
    login_family = F.when(often("part1") > often("part2"), F.col("part2")).otherwise(F.col("part1"))
    rows = parsed.withColumn("family", F.when(F.length(family) > 0, family).otherwise(login_family)).withColumn("given", F.when(F.length(family) > 0, given).otherwise(F.lit("")))
    # The given name spelled out: by the mailbox, else by the name, else by the login.
    short = F.length("family").between(LEAST, FUZZY - 1)
    beside = F.when(F.col("part1") == F.col("family"), F.col("part2")).when(F.col("part2") == F.col("family"), F.col("part1")).otherwise(F.lit(""))
    login_given = F.when(short, beside).otherwise(_rest(F.col("handle"), F.col("family")))
    typed = F.when(F.length("given") > 0, F.col("given")).when(F.length(login_given) > 0, login_given).otherwise(F.lit(""))
    # A short family name is a part of the mailbox of its own, or the mailbox is made of it and the given name or its initial.
    bare, first = F.regexp_replace("box", r"\d+$", ""), F.substr(typed, F.lit(1), F.lit(1))
    apart = F.array_contains("box_parts", F.col("family"))
    joined = (F.length(typed) > 1) & ((bare == F.concat(typed, "family")) | (bare == F.concat("family", typed)))
    abridged = (F.length(typed) > 0) & ((bare == F.concat(first, "family")) | (bare == F.concat("family", first)))
    rest = F.when(apart, F.array_join(F.array_remove("box_parts", F.col("family")), "")).when(joined, typed).otherwise(F.lit(""))
    named = F.when(short, apart | joined | abridged).otherwise(_within(F.col("family"), F.col("box")))
    box_given = F.when(short, rest).otherwise(_rest(F.col("box"), F.col("family")))
    spelled = (F.length(box_given) > 2) | (short & (F.length(box_given) > 1) & (box_given == typed))
    return rows.select(
        "id", "box", "domain", "family", "handle",
        typed.alias("typed"),
        F.when(named & spelled, box_given).otherwise(F.lit("")).alias("box_given"),
        F.when(F.length(login_given) > 2, login_given).otherwise(F.lit("")).alias("login_given"),
        (F.length("given") > 0).alias("has_name"), named.alias("named"),
    )


def channel(rows: DataFrame) -> DataFrame:
    """typed, given, p: how often a given name, spelled out in the mailbox, is typed in another way."""
    seen = rows.where((F.length("box_given") > 2) & (F.length("typed") > 1)).select("typed", F.col("box_given").alias("given"))
    known = [(short, full) for full, shorts in NICKNAMES.items() for short in shorts.split()]
    prior = rows.sparkSession.createDataFrame(known, "typed string, given string")
    counted = seen.groupBy("typed", "given").agg(F.count("*").alias("n")).unionByName(prior.withColumn("n", F.lit(2).cast("long"))).groupBy("typed", "given").agg(F.sum("n").alias("n"))
    total = counted.groupBy("given").agg(F.sum("n").alias("all"))
    return counted.where((F.col("n") > 1) & (F.col("typed") != F.col("given"))).join(total, "given").select("typed", "given", F.log(F.col("n") / F.col("all")).alias("p"))


def _keys(word: Column) -> Column:
    """The word and all it becomes when one letter is left out: shared by words one slip apart. Words below FUZZY letters share theirs with none but themselves."""
    return F.when(F.length(word) < FUZZY, F.array(F.concat(F.lit("="), word))).otherwise(F.array_distinct(F.concat(F.array(word), F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1))))))


def linked(df: DataFrame, key: str = "id", login: str = "github_login", name: str = "name", email: str = "email") -> DataFrame:
    """id and person (the least id of the group) of every row that is not an automation account.

    Rows whose key is null are left out; rows that repeat a key count once (the
    least one). A row with neither a usable name nor address is a person of its
    own. Other columns are ignored; an empty table gives an empty table.
    """
    rows = checkpointed(people(df, key, login, name, email))
    nick = channel(rows)
    # 1. Addresses. The family name of an address is the one most of its rows write, if it is part of the mailbox.
    boxed = rows.where(F.length("box") > 0)
    votes = boxed.groupBy("box", "domain").agg(
        F.count("*").alias("size"), F.max("named").alias("named"),
        F.mode(F.when(F.col("named"), F.col("family")), True).alias("family"),
        F.mode(F.when(F.length("box_given") > 1, F.col("box_given")), True).alias("spelled"),
        F.mode(F.when(F.length("typed") > 1, F.col("typed")), True).alias("typed"),
        F.max(F.when(F.length("typed") == 1, F.col("typed"))).alias("initial"),
        F.mode(F.when(F.length("login_given") > 2, F.col("login_given")), True).alias("login_given"),
        F.mode(F.when(F.length("family") > 0, F.col("family")), True).alias("any_family"), F.min("id").alias("least"),
    )
    votes = votes.withColumn("given", F.coalesce("spelled", "typed", "login_given", "initial", F.lit("")))
    # A typed given name that is a known short form stands for its full name.
    full = nick.groupBy(F.col("typed").alias("short")).agg(F.max_by("given", "p").alias("whole"))
    votes = votes.join(full, F.col("given") == F.col("short"), "left").withColumn("whole", F.coalesce("whole", "given")).drop("short")
    votes = checkpointed(votes)
    # A spelling that three families use is a name and no slip; short forms of other names are left to the channel.
    written = rows.where(F.length("family") >= LEAST).select("family", F.explode(F.array("box_given", "typed")).alias("name")).where(F.length("name") > 2)
    names = written.groupBy("name").agg(F.count_distinct("family").alias("n")).where(F.col("n") > 2).join(full, F.col("name") == F.col("short"), "left_anti").select("name", F.lit(True).alias("is_name"))
    # A name that two addresses of one domain bear is known to be shared; it links nothing across domains.
    bearers = votes.where("named")
    shared = bearers.groupBy("family", "whole", "domain").agg(F.count_distinct("box").alias("n")).where(F.col("n") > 1).select("family", "whole", F.lit(True).alias("shared")).distinct()
    bearers = bearers.join(shared, ["family", "whole"], "left").withColumn("form", F.concat_ws(" ", F.when(F.col("shared"), F.col("box")), "whole", "family"))
    forms = (
        bearers.groupBy("form", "family", "whole").agg(F.sum("size").alias("size"), F.min("least").alias("person"), F.min("given").alias("given"), F.collect_set("domain").alias("domains"), F.max(F.col("spelled").isNotNull()).alias("spelled"))
        .join(names.select(F.col("name").alias("whole"), "is_name"), "whole", "left")
        .withColumn("canonical", (F.length("whole") > 1) & (F.col("spelled") | F.coalesce("is_name", F.lit(False))))
    )
    forms = checkpointed(forms)
    canonical = forms.where("canonical")
    # 2. Variants: rows and addresses without a name in the mailbox, and forms whose given name is no known name.
    none = F.array().cast("array<string>")
    nameless = votes.where(~F.col("named")).select(F.concat_ws("@", "box", "domain").alias("variant"), F.col("any_family").alias("family"), F.coalesce("typed", "login_given", "initial", F.lit("")).alias("typed"), "login_given", "least", none.alias("domains"))
    alone = rows.where(F.length("box") == 0).select(
        F.concat(F.lit("#"), F.col("id").cast("string")).alias("variant"), "family", "typed", F.when(F.length("login_given") > 2, F.col("login_given")).alias("login_given"), F.col("id").alias("least"), none.alias("domains"))
    unsure = forms.where(~F.col("canonical")).select(F.col("form").alias("variant"), "family", F.col("whole").alias("typed"), F.lit(None).cast("string").alias("login_given"), F.col("person").alias("least"), "domains")
    variants = nameless.unionByName(alone).unionByName(unsure).withColumn("typed", F.when((F.length("typed") <= 1) & F.col("login_given").isNotNull(), F.col("login_given")).otherwise(F.col("typed")))
    variants = checkpointed(variants)
    usable = variants.where((F.length("family") >= LEAST) & (F.length("typed") >= 1))
    # 3. Posterior over the forms that share a key of the family name and have no other address at the variant's domain.
    left = usable.select("variant", F.col("family").alias("v_family"), "typed", F.col("domains").alias("v_domains"), F.explode(_keys(F.col("family"))).alias("slip"))
    right = canonical.where(F.length("family") >= LEAST).select("person", "family", "whole", F.col("given").alias("form_given"), "size", "domains", F.explode(_keys(F.col("family"))).alias("slip"))
    pairs = left.join(right, "slip").where(~F.arrays_overlap("v_domains", "domains")).select("variant", "v_family", "typed", "person", "family", "whole", "form_given", "size").distinct()
    slips = F.levenshtein(F.col("v_family"), F.col("family"))
    initial = F.length("typed") == 1
    swapped = (F.levenshtein("typed", "whole") == 2) & (F.length("typed") == F.length("whole")) & (F.sort_array(F.split("typed", "")) == F.sort_array(F.split("whole", "")))
    likelihood = (
        F.when((F.col("typed") == F.col("whole")) | (F.col("typed") == F.col("form_given")), _SAME)
        .when(initial & F.col("whole").startswith(F.col("typed")), _INITIAL)
        .when(F.col("p").isNotNull(), F.greatest(F.col("p"), F.lit(-3.0)))
        # A spelling that several people use for themselves is a name, not a slip of another one.
        .when((F.length("typed") > 2) & ((F.levenshtein("typed", "whole") <= 1) | swapped) & ~F.col("is_name"), _TYPO)
        .when((F.length("typed") > 2) & F.col("whole").startswith(F.col("typed")) & ~F.col("is_name"), _UNSEEN_NICK)
        .when((F.length("typed") > 2) & F.col("whole").startswith(F.substr("typed", F.lit(1), F.lit(2))) & (F.length("typed") < F.length("whole")) & ~F.col("is_name"), 2 * _UNSEEN_NICK)
    )
    scored = (
        pairs.join(nick.withColumnRenamed("given", "whole"), ["typed", "whole"], "left").join(names.withColumnRenamed("name", "typed"), "typed", "left").withColumn("is_name", F.coalesce("is_name", F.lit(False)))
        .withColumn("score", F.log(F.col("size").cast("double")) + F.when(slips == 0, 0.0).otherwise(_TYPO) + likelihood).where(F.col("score").isNotNull())
        .groupBy("variant", "person").agg(F.max("score").alias("score"))
    )
    best = scored.groupBy("variant").agg(F.max_by("person", F.struct("score", "person")).alias("person"), F.max("score").alias("top"), F.sum(F.exp("score")).alias("mass"))
    attached = checkpointed(best.where(F.exp("top") > POSTERIOR * F.col("mass")).select("variant", "person"))
    # 4. The rest: forms by their full name.
    rest = variants.join(attached, "variant", "left_anti").join(full, F.col("typed") == F.col("short"), "left").withColumn("whole", F.coalesce("whole", "typed"))
    own = F.when((F.length("family") >= LEAST) & (F.length("whole") > 1) & (F.size("domains") == 0), F.concat_ws(" ", "whole", "family")).otherwise(F.col("variant"))
    grouped = rest.select("variant", "least", own.alias("form"))
    formed = grouped.join(grouped.groupBy("form").agg(F.min("least").alias("person")), "form").select("variant", "person")
    decided = attached.unionByName(formed).unionByName(canonical.select(F.col("form").alias("variant"), "person"))
    # Every row leads to its form or variant by one step, and from there to its person by another.
    by_address = votes.where(~F.col("named")).select("box", "domain", F.concat_ws("@", "box", "domain").alias("variant")).unionByName(bearers.select("box", "domain", F.col("form").alias("variant")))
    steps = boxed.join(by_address, ["box", "domain"]).select("id", "variant").unionByName(rows.where(F.length("box") == 0).select("id", F.concat(F.lit("#"), F.col("id").cast("string")).alias("variant")))
    return steps.join(decided, "variant").select("id", "person")


def pairs(links: DataFrame) -> DataFrame:
    """id_a, id_b (id_a < id_b) of all pairs of rows of one person. Groups are single people's accounts, so they stay small."""
    a, b = links.select(F.col("id").alias("id_a"), "person"), links.select(F.col("id").alias("id_b"), "person")
    return a.join(b, "person").where(F.col("id_a") < F.col("id_b")).select("id_a", "id_b")
