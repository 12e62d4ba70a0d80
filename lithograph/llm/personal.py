"""Personal information in free text, found by weak supervision and replaced by typed placeholders.

1. Patterns propose spans of five types, generously: wrong and overlapping ones too.
2. Labelers vote on each span: patterns of format, gazetteers (given names,
   common words and capitalised words that no one bears, all counted over the
   whole corpus) and context before and after. A labeler may abstain, and does
   where its gazetteer does not know a word. Spans and votes are computed once
   and kept.
3. Expectation-maximisation over the counts of all vote patterns estimates how
   reliable each labeler is, without any labelled text, and gives each pattern
   the probability that its spans are real.
4. Those probabilities train a logistic classifier over votes, shape and
   neighbouring words, on a bounded sample of spans; it decides every span. Of
   overlapping spans the most probable wins.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithograph.llm.identities import NICKNAMES
from lithograph.tables import checkpointed

TYPES = ("email", "phone", "id_number", "address", "name")
#: Spans in the sample that the classifier is trained on, about; statistics and decisions cover all spans.
SAMPLE_SPANS = 30_000
#: Share of all texts that must write a word, and share of all known names that must begin with one, for a gazetteer to
#: know it. By these shares a gazetteer has at most 1 / GIVEN_SHARE given names, and as many other words as a text has on
#: average, times 1 / WORD_SHARE, whatever the size of the corpus.
WORD_SHARE, GIVEN_SHARE = 5e-5, 1e-5
#: Observations that the belief in a labeler counts for, against the votes themselves.
BELIEF = 50.0
_BUCKETS = 1 << 14

_CAP = r"\p{Lu}[\p{Ll}\p{M}'’]+(?:-\p{Lu}[\p{Ll}\p{M}]+)*"
_TOWN = rf"(?:(?:New|San|Santa|Saint|St\.?|Bad|Los|Las|North|South|East|West|Port|Fort|Great|Upper|Lower|Little|Mount|Old|Le|La|El) )?{_CAP}"
# Words that end a street's name, and units within a house.
_STREET = r"(?:Road|Rd\.?|Street|St\.?|Lane|Ln\.?|Avenue|Ave\.?|Way|Close|Row|Terrace|Boulevard|Blvd\.?|Drive|Dr\.?|Court|Ct\.?|Place|Square|Crescent|Gardens|Hill|Parade|Grove|Mews|Walk)(?![\p{L}])"
_UNIT = r"(?:Flat|Apt\.?|Apartment|Unit|Suite|Room|Floor)"
# Frequent family names written in Han characters.
_HAN_FAMILIES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾萧田董潘袁蔡蒋余杜叶程苏魏吕丁沈姚卢姜崔钟谭陆汪范石廖贾韦夏傅方邹熊孟秦"
_PATTERNS = {
    "email": [
        r"[\p{L}\p{N}_%+-]+(?:\.[\p{L}\p{N}_%+-]+)*@[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}(?!\.?[\p{L}\p{N}@/-]|:[^\s:])",
        r"[\p{L}\p{N}_%+-]+(?:\.[\p{L}\p{N}_%+-]+)* ?[\[({] ?at ?[\])}] ?[\p{L}\p{N}-]+(?:(?:\.| ?[\[({] ?dot ?[\])}] ?)[\p{L}\p{N}-]+)+",
        r"[\p{L}\p{N}_%+-]+(?:(?:\.| dot )[\p{L}\p{N}_%+-]+)* at [\p{L}\p{N}-]+(?: dot [\p{L}\p{N}-]+)+",
    ],
    "phone": [
        r"(?<![\p{L}\p{N}.+/:-])(?:\+|00)\d{1,3}[ .-]?(?:\(0\) ?)?\(?\d{1,5}\)?(?:[ ./-]?\d{2,5}){1,5}(?![\p{L}\p{N}]|[.:/-]\p{N})",
        r"(?<![\p{L}\p{N}.+/:-])(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}(?![\p{L}\p{N}]|[.:/-]\p{N})",
        r"(?<![\p{L}\p{N}.+/:-])0\d(?:[ .]\d{2}){4}(?![\p{L}\p{N}]|[.:/-]\p{N})",
        r"(?<![\p{L}\p{N}.+/:-])0\d{2,4}[ /-]\d{3,4}[ -]?\d{3,5}(?![\p{L}\p{N}]|[.:/-]\p{N})",
        r"(?<![\p{L}\p{N}.+/:-]|\d )(?:\d{5} \d{5}|\d{2} \d{4} \d{4}|\d{3} \d{3} \d{2} \d{2}|\d{3} \d{2} \d{2} \d{2})(?![\p{L}\p{N}]|[ .:/-]\p{N})",
    ],
    "id_number": [
        r"(?<![\p{L}\p{N}.+/-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|[.-]\p{N})",
        r"(?<![\p{L}\p{N}.+/-]|\d )\d{3} \d{3} \d{3}(?![\p{L}\p{N}]|[ .-]\p{N})",
        r"(?<![\p{L}\p{N}/-])\p{Lu}{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![\p{L}\p{N}-])",
        r"(?<![\p{L}\p{N}/-])\p{Lu}{1,2}\d{6,8}(?![\p{L}\p{N}-])",
        r"(?<![\p{L}\p{N}.+/-])\d{2}-\d{6}-\p{Lu}(?![\p{L}\p{N}-])",
        r"(?<![\p{L}\p{N}.+/-])\d{8}-?\p{Lu}(?![\p{L}\p{N}-])",
        r"(?<![\p{L}\p{N}.+/-])(?:\d{3}\.\d{3}\.\d{3}-\d{2}|[XYZ]-?\d{7}-?\p{Lu}|\d{6}[-+A]\d{3}[\dA-Y])(?![\p{L}\p{N}]|[.-]\p{N})",
        r"(?<![\p{L}\p{N}.+/-]|\d )\d{4} \d{4} \d{4}(?![\p{L}\p{N}]|[ .-]\p{N})",
    ],
    "address": [
        rf"(?<![\p{{L}}\p{{N}}.-])(?:{_UNIT} \d+\p{{L}}?, )?\d{{1,5}}\p{{L}}?(?: (?:[NSEW]|North|South|East|West)\.?)?(?: {_CAP}){{1,3}}? {_STREET}(?:, {_UNIT} ?\d+\p{{L}}?)?(?:, {_TOWN}(?:,? \p{{Lu}}{{1,2}}\d{{1,2}}\p{{Lu}}? \d\p{{Lu}}{{2}}|, \p{{Lu}}{{2}} \d{{5}}(?:-\d{{4}})?)?)?",
        rf"{_CAP}(?<=straße|strasse|str|weg|allee|platz|gasse|ring|damm|ufer)\.? \d+ ?[a-z]?(?:, \d{{5}} {_TOWN})?",
        rf"(?<![\p{{L}}\p{{N}}.-])\d{{1,4}}(?: (?:bis|ter))?,? (?:rue|avenue|boulevard|impasse|quai|place|chemin|allée|cours)(?: (?:de la|de l['’]|des|du|de|d['’]))? ?{_CAP}(?: {_CAP})?(?:, \d{{5}} {_TOWN})?",
        rf"(?<![\p{{L}}\p{{N}}.-])(?:[Cc]alle|[Vv]ia|[Pp]laza|[Pp]iazza|[Aa]venida|[Rr]ua) (?:de(?:l| la)? |d[aeo]s? )?{_CAP},? \d+(?:, \d{{5}} {_TOWN})?",
        rf"(?<![\p{{L}}\p{{N}}.-])(?:ul|al|pl|os)\. {_CAP}(?: {_CAP})? \d+\p{{L}}?(?:/\d+)?(?:, \d{{2}}-\d{{3}} {_TOWN})?",
    ],
    "name": [
        rf"(?<![\p{{L}}\p{{N}}`@/._-])(?:{_CAP}|\p{{Lu}}\.)(?: \p{{Lu}}\.){{0,2}} {_CAP}(?![\p{{L}}\p{{N}}`@/_(])",
        rf"(?<![\p{{L}}\p{{N}}`@/._-]){_CAP}, (?:{_CAP}|\p{{Lu}}\.)(?: \p{{Lu}}\.)?(?![\p{{L}}\p{{N}}`@/_(])",
        rf"(?:(?<!\p{{Han}})|(?<=由|者|人|问|请|和|与|给|致))[{_HAN_FAMILIES}]\p{{Han}}{{1,2}}(?=\P{{Han}}|$|先生|女士|小姐|报告|提交|说|的|在|和|与|要)",
    ],
}
#: What every match of a type's patterns has, so that texts without it are not searched: a sign of each kind of address, digits, capitals or family names.
_NEEDS = {"email": regex.compile(r"@|\bat\b"), "phone": regex.compile(r"(?:\d\D{0,4}){8}"), "id_number": regex.compile(r"\d(?:\D?\d){5}"), "address": regex.compile(r"\d"), "name": regex.compile(rf"\p{{Lu}}|[{_HAN_FAMILIES}]")}
_COMPILED = [(t, [regex.compile(p) for p in ps]) for t, ps in _PATTERNS.items()]
# Words around a span that speak for or against its type.
_BEFORE = {
    "email": regex.compile(r"(?i)(?:<|\(|mailto:|e-?mail(?: address)?:?|user=|\bcc|\bbcc|\bping|\bto|\bfrom|\bby|,|\bcontact)\s*$"),
    "phone": regex.compile(r"(?i)(?:\b(?:call|tel|phone|mobile|fax|whatsapp|rang|ring|dial|sms|signal|cell|at|on)\b[^\p{L}\n]{0,4})$"),
    "id_number": regex.compile(r"(?i)(?:\b(?:ssn|cpf|pesel|aadhaar|nif|cf|bsn|nric|hetu|social security(?: number| no\.?)?|tin|tax (?:id|no\.?|number)|passport(?: no\.?| number)?|reisepass|ni(?:no)?(?: number| no\.?)?|national insurance(?: no\.?| number)?|dni|nie|id card|identity card(?: no\.?| number)?|ausweis|personalausweis|steuer-?id|licen[cs]e(?: no\.?)?|id(?: no\.?| number)?)[\s:#=.]*)$"),
    "address": regex.compile(r"(?i)(?:\b(?:to|at|in|ship|address|entry|ticket|lives?|office|on|fails|from|near)\b[^\p{L}\n]{0,4})$"),
    "name": regex.compile(r"(?i)(?:-by: ?|\b(?:reviewer|reported by|requested by|written by|reviewed by|signed by|per|from|customer|with|thanks to|rang|called|for|by|to|and|cc|user|author|assignee|dear|hi|hello|mr\.?|mrs\.?|ms\.?|dr\.?|ask|asked|told|met|meet|met with|call|email|tell|via)[ :]+|(?:作者|姓名|联系人|负责人|报告人|由|致|请|问|和|与|给)[ :：]*|; ?|^(?:[-*>] )?)$"),
}
_AFTER = {
    "email": regex.compile(r"^(?:[>),;.\s]|$)"),
    "phone": regex.compile(r"(?i)^(?:[\s.,;)\"']|$)"),
    "id_number": regex.compile(r"(?i)^(?:,? (?:for|from|in the|of)\b|[.,;\")]|\s|$)"),
    "address": regex.compile(r"^(?:[\s.,;)\"]|$)"),
    "name": regex.compile(r"(?i)^(?: ?[<(]|, \S+@|, \S+ [\[(]at| (?:wants?|asks|asked|says|said|wrote|reports?|reported|confirmed|agreed|noticed|found|saw|thinks|will|would|can|could|should|is|was|has|had|went|on|in|at|for|about|last) |先生|女士|小姐|[.:,;]|\s*$)"),
}
_AGAINST_BEFORE = {
    "email": regex.compile(r"(?i)(?://|[`@/]|ssh:|git clone )$"),
    "phone": regex.compile(r"(?i)\b(?:version|build|order|shard|page|section|trace|port|range|release|candidate|commit|seen|v|ip|host|row|line|run|job|ticket|#)[ :=#]*$"),
    "id_number": regex.compile(r"(?i)\b(?:version|build|order|shard|page|section|trace|port|range|release|candidate|commit|seen|v|row|rows|phone|tel|call)[ :=#]*$"),
    "address": regex.compile(r"(?i)\b(?:version|build|page|section|line|commit|release)[ :]*$"),
    "name": regex.compile(r"(?i)(?:\b(?:the|a|an|this|see|branch|module|class|package|product|service|section \S+|release|new|old|our|its|their) |[\d.]: )$"),
}
_AGAINST_AFTER = {
    "email": regex.compile(r"^(?::[^\s]|/|`)"),
    "phone": regex.compile(r"(?i)^ ?(?:rows|calls|ms|seconds|minutes|hours|days|times|%|px|kb|mb)\b"),
    "id_number": regex.compile(r"(?i)^ ?(?:rows|calls|ms|seconds|times|%)\b"),
    "address": regex.compile(r"(?i)^ ?(?:rows|calls|times)\b"),
    "name": regex.compile(r"(?i)^ (?:branch|notes|team|module|service|gateway|cache|owner|budget|release|api|library|package|build|project|queue|job|jobs|page|docs|guide|client|server|code)\b"),
}
_STRICT = {
    "email": regex.compile(r"(?i).+(?:@|\bat\b).+(?:\.|\bdot\b)[\])} ]*\p{L}{2,12}"),
    "phone": regex.compile(r"(?:\+|00)\d.*|\(\d{3}\).*|0.*|\d{3}([-.])\d{3}\1\d{4}"),
    "id_number": regex.compile(r"\d{3}-\d{2}-\d{4}|9\d{2} \d{3} \d{3}|\p{Lu}{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\p{Lu}{2}\d{7}|\d{2}-\d{6}-\p{Lu}|\d{3}\.\d{3}\.\d{3}-\d{2}"),
    "address": regex.compile(r".*(?:\d{5} \p{Lu}|\p{Lu}{2} \d{5}|\p{Lu}{1,2}\d{1,2} \d\p{Lu}{2}|(?:Flat|Apt|Road|Street|Lane|Avenue|Way|Close|Row|Terrace|Rd\.?|St\.?|Ave\.?|Blvd\.?).*|.*\d{2}-\d{3} .*)"),
    "name": regex.compile(r"\p{Lu}\. .*|.* \p{Lu}\. .*|.*, .*|\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}{4,}.*|\p{Han}{3}"),
}
# Formats that other numbers share: the labeler of formats abstains.
_LOOSE = {"phone": regex.compile(r"\d{5} \d{5}|\d{2} \d{4} \d{4}|\d{3} \d{3} \d{2} \d{2}|\d{3} \d{2} \d{2} \d{2}"), "id_number": regex.compile(r"[XYZ]-?\d{7}-?\p{Lu}|\d{6}[-+A]\d{3}[\dA-Y]|\d{4} \d{4} \d{4}"), "name": regex.compile(r"\p{Han}{2}")}
_GIVEN_BEFORE = regex.compile(r"(\p{Lu}[\p{Ll}\p{M}]+) $")
N_VOTES = 6


@dataclass(frozen=True)
class Gazetteers:
    """Given names, words that the corpus also writes in lower case, capitalised ones that are part of no known name, and family names."""

    given: frozenset[str]
    common: frozenset[str]
    public: frozenset[str] = frozenset()
    family: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Model:
    """Weights of the classifier by hashed feature."""

    gazetteers: Gazetteers
    weights: np.ndarray


def spans(text: str) -> list[tuple[str, int, int]]:
    """Proposed spans: type, start, end. Names also from every later word of a run of capitalised words."""
    found = set()
    for kind, patterns in _COMPILED:
        if not _NEEDS[kind].search(text):
            continue
        for pattern in patterns:
            for m in pattern.finditer(text, overlapped=kind == "name"):
                a, b = m.span()
                if kind == "phone" and not 8 <= sum(c.isdigit() for c in text[a:b]) <= 15:
                    continue
                found.add((kind, a, b))
    return sorted(found, key=lambda s: (s[1], s[2], s[0]))


def proposed(text: str, g: Gazetteers) -> list[tuple[str, int, int]]:
    """The spans of a text, but for names that begin with initials behind a given name: those are its middle."""
    found = []
    for kind, a, b in spans(text):
        if kind == "name" and text[a + 1 : a + 2] == "." and (word := _GIVEN_BEFORE.search(text[max(0, a - 40) : a])) and word[1] in g.given:
            continue
        found.append((kind, a, b))
    return found


def votes(text: str, span: tuple[str, int, int], g: Gazetteers) -> str:
    """A vote per labeler: + for, - against, 0 abstains. Labelers: format, context before, context after, context against, gazetteer, common words."""
    kind, a, b = span
    body, before, after = text[a:b], text[max(0, a - 40) : a], text[b : b + 30]
    line = before.rpartition("\n")[2]
    against = _AGAINST_BEFORE[kind].search(line) or _AGAINST_AFTER[kind].search(after)
    out = ["+" if _STRICT[kind].fullmatch(body) else "0" if kind in _LOOSE and _LOOSE[kind].fullmatch(body) else "-", "+" if _BEFORE[kind].search(line) else "0", "+" if _AFTER[kind].search(after) else "0", "-" if against else "0"]
    words = [w for w in regex.findall(r"\p{L}[\p{L}\p{M}'’-]*", body) if len(w) > 1]
    if kind == "name":
        first, last = (words[-1], words[0]) if "," in body else (words[0], words[-1])
        single = len(words) == 1  # initials with a family name
        known, turned = first in g.given, last in g.given
        # A first word that many texts have and no known name has speaks against; one that is just unknown says nothing.
        unknown = "-" if first in g.public else "0"
        gaz = ("-" if turned else "+" if last in g.family else "0") if single else "+" if known and not turned else "0" if known else "-" if turned else unknown
        # Words that few texts have are more often names than words that many have.
        out += [gaz, "-" if any(w.lower() in g.common for w in words) else "+" if single or first not in g.public else "0"]
    elif kind == "email":
        box = regex.split(r"[@\[(]| at ", body)[0].lower()
        out += ["+" if any(p.capitalize() in g.given for p in regex.findall(r"\p{L}+", box)) or "+" in box else "0", "0"]
    elif kind == "address":
        out += ["+" if regex.search(r"(?i)\b(?:flat|apt|straße|str\.|rue|quai|impasse|\w*weg|\w*allee|[a-z]+ (?:road|rd|street|st|lane|avenue|ave|way|close|row|terrace|blvd))\b", body) else "0", "0"]
    else:
        out += ["+" if words == [] or kind == "id_number" else "0", "0"]
    return "".join(out)


_WORD = regex.compile(r"\p{L}+|[^\p{L}\s]")
_SHAPES = [(regex.compile(p), c) for p, c in ((r"\p{N}+", "9"), (r"\p{Ll}+", "x"), (r"\p{Lu}+", "X"))]


@lru_cache(maxsize=1 << 16)
def _bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % _BUCKETS


@lru_cache(maxsize=1 << 12)
def _vote_buckets(kind: str, vote: str) -> tuple[int, ...]:
    return tuple(_bucket(f"{kind} {n}") for n in ("bias", f"v={vote}", *(f"v{i}={v}" for i, v in enumerate(vote))))


def features(text: str, span: tuple[str, int, int], vote: str) -> list[int]:
    """Hashed features of a span, each crossed with its type."""
    kind, a, b = span
    shape = body = text[a:b]
    for pattern, char in _SHAPES:
        shape = pattern.sub(char, shape)
    before, after = _WORD.findall(text[max(0, a - 30) : a])[-2:], _WORD.findall(text[b : b + 30])[:2]
    names = [f"{kind} s={shape[:24]}", f"{kind} l={min(len(body) // 8, 6)}", f"{kind} n={body.count(' ')}"]
    names += [f"{kind} b{i}={w.lower()}" for i, w in enumerate(reversed(before))] + [f"{kind} a{i}={w.lower()}" for i, w in enumerate(after)]
    return [*_vote_buckets(kind, vote), *map(_bucket, names)]


def estimate(patterns: dict[tuple[str, str], int], rounds: int = 80) -> dict[tuple[str, str], float]:
    """The probability that a span is real for each type and vote pattern, by expectation-maximisation.

    Labelers are taken as independent given the truth. Each has a rate of
    votes for, votes against and abstentions for real spans, and one for
    others, estimated together with the truth. BELIEF observations hold before
    any vote is seen: that real spans get more votes for and fewer against
    than usual, and others votes against half of the time. That keeps the two
    classes apart where nearly all spans are real; no labeler counts for less
    than chance.
    """
    out: dict[tuple[str, str], float] = {}
    for kind in {k for k, _ in patterns}:
        rows = [(v, n) for (k, v), n in sorted(patterns.items()) if k == kind]
        count = np.array([n for _, n in rows], dtype=float)
        said = np.array([[[c == way for way in "+-0"] for c in v] for v, _ in rows], dtype=float)
        p = 1 / (1 + np.exp(-(said[:, :, 0].sum(axis=1) - 2 * said[:, :, 1].sum(axis=1))))
        usual = np.einsum("n,nlw->lw", count, said) / count.sum()
        believed = np.stack([usual * [2.0, 0.25, 1.0] + 0.01, np.broadcast_to([0.15, 0.5, 0.35], usual.shape)])
        believed /= believed.sum(axis=2, keepdims=True)
        for _ in range(rounds):
            weight = np.stack([count * p, count * (1 - p)])
            prior = (weight[0].sum() + 0.5 * BELIEF) / (count.sum() + BELIEF)
            rate = (np.einsum("cn,nlw->clw", weight, said) + BELIEF * believed) / (weight.sum(axis=1)[:, None, None] + BELIEF)
            for way, sign in ((0, 1), (1, -1)):
                worse = sign * (rate[0, :, way] - rate[1, :, way]) < 0
                rate[:, worse, way] = rate[:, worse, way].mean(axis=0)
            odds = math.log(prior / (1 - prior)) + np.einsum("nlw,lw->n", said, np.log(rate[0] / rate[1]))
            p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        out |= {(kind, v): float(x) for (v, _), x in zip(rows, p, strict=True)}
    return out


def train(rows: list[np.ndarray], target: np.ndarray, epochs: int = 8, rate: float = 0.3, seed: int = 3) -> np.ndarray:
    """Weights of a logistic classifier, by stochastic gradients with adaptive rates, towards soft targets."""
    weights, square = np.zeros(_BUCKETS), np.full(_BUCKETS, 1e-3)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for start in range(0, len(rows), 256):
            batch = rng.integers(0, len(rows), 256) if start else rng.permutation(len(rows))[:256]
            size = np.array([len(rows[i]) for i in batch])
            flat = np.concatenate([rows[i] for i in batch])
            score = np.add.reduceat(weights[flat], np.concatenate(([0], np.cumsum(size)[:-1])))
            error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - target[batch]
            step = np.bincount(flat, weights=np.repeat(error, size), minlength=_BUCKETS) / len(batch) + 1e-6 * weights
            square += step**2
            weights -= rate * step / np.sqrt(square)
    return weights


def gazetteers(texts: DataFrame, text: str, names: DataFrame | None = None, name: str = "name") -> Gazetteers:
    """Gazetteers counted over all texts, and over a column of people's names if there is one."""
    said = F.explode(F.regexp_extract_all(F.col(text), F.lit(r"-by: (\p{Lu}[\p{Ll}]+ \p{Lu}[\p{Ll}]+) ?[<(]"), 1))
    pairs = texts.select(said.alias("n"))
    if names is not None:
        pairs = pairs.unionByName(names.select(F.trim(F.col(name)).alias("n")).where(F.col("n").rlike(r"^\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+$")))
    # A word is a given name if it stands before more different words than it follows.
    parts = pairs.select(F.split("n", " ")[0].alias("one"), F.split("n", " ")[1].alias("two"))
    sides = parts.select(F.col("one").alias("word"), F.substr("two", F.lit(1), F.lit(4)).alias("beside"), F.lit(1).alias("side")).unionByName(parts.select(F.col("two").alias("word"), F.substr("one", F.lit(1), F.lit(4)).alias("beside"), F.lit(-1).alias("side")))
    parts_of_names = checkpointed(sides.distinct().groupBy("word").agg(F.sum("side").alias("n"), F.count_if(F.col("side") > 0).alias("first")))
    heads = parts_of_names.agg(F.sum("first")).first()[0] or 0
    given = parts_of_names.where((F.col("n") > 0) & (F.col("n") >= GIVEN_SHARE * heads)).select("word")
    family = parts_of_names.where((F.col("n") < 0) & (-F.col("n") >= GIVEN_SHARE * heads)).select("word")
    # A word is common if texts write it in lower case more often than with a capital; one text says nothing.
    found = lambda pattern: F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), 1))
    low = F.transform(found(r"(?<![\p{L}\p{N}_.@/+-])(\p{Ll}{3,})(?![\p{L}\p{N}_@/-]| ?[\[(]at)"), lambda w: F.struct(w.alias("word"), F.lit(1).alias("n")))
    high = F.transform(found(r"(?<![\p{L}\p{N}_.@/-])(\p{Lu}\p{Ll}{2,})(?![\p{L}\p{N}_@/-])"), lambda w: F.struct(F.lower(w).alias("word"), F.lit(-1).alias("n")))
    words = texts.select(F.explode(F.concat(low, high)).alias("w")).groupBy("w.word").agg(F.count_if(F.col("w.n") > 0).alias("low"), F.count_if(F.col("w.n") < 0).alias("high"))
    floor = max(2.0, WORD_SHARE * texts.count())
    counted = checkpointed(words.where(F.greatest("low", "high") >= floor))
    common = counted.where((F.col("low") >= floor) & (F.col("low") - F.col("high") > 1)).select("word")
    borne = parts_of_names.select(F.lower("word").alias("word"))
    public = counted.where((F.col("high") >= floor) & (F.col("high") >= F.col("low"))).select("word").join(borne, "word", "left_anti")
    # The shares bound all four lists.
    known = {r[0] for r in given.collect()} | {w.capitalize() for full, short in NICKNAMES.items() for w in (full, *short.split())}
    return Gazetteers(frozenset(known), frozenset(r[0] for r in common.collect()), frozenset(r[0].capitalize() for r in public.collect()) - known, frozenset(r[0] for r in family.collect()))


_SPAN = "array<struct<kind: string, start: int, end: int, vote: string>>"


def marked(df: DataFrame, text: str, g: Gazetteers) -> DataFrame:
    """``df`` with ``__marks``, the proposed spans of each text and their votes; none for null and empty texts."""
    rows = df.withColumn("__marked_text", F.col(text).cast("string"))
    names = [f"__{i}" for i in range(len(df.columns))]
    rows = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names, strict=True)], "__marked_text")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("vote", pa.string())]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [[(k, a, b, votes(t, (k, a, b), g)) for k, a, b in proposed(t, g)] if t else [] for t in batch.column(len(names)).to_pylist()]
            flat = list(zip(*[m for found in marks for m in found], strict=True)) or [(), (), (), ()]
            inner = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(flat, kind.value_type, strict=True)], fields=list(kind.value_type))
            offsets = pa.array(np.cumsum([0, *map(len, marks)]), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.ListArray.from_arrays(offsets, inner)], names=[*names, "__marks"])

    shape = ", ".join([*(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names), f"__marks {_SPAN}"])
    out = rows.mapInArrow(look, shape)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True)], "__marks")


def fit(texts: DataFrame, text: str, g: Gazetteers) -> Model:
    """The span classifier for a corpus: votes of all spans, expectation-maximisation, training on a sample.

    ``texts`` may have their spans from ``marked``; else they are marked here.
    """
    rows = texts if "__marks" in texts.columns else checkpointed(marked(texts, text, g))
    rows = rows.select(F.col(text).alias("text"), "__marks")
    each = rows.select(F.explode("__marks").alias("m"))
    # At most 3 ** N_VOTES patterns for each type.
    patterns = {(r[0], r[1]): r[2] for r in each.groupBy("m.kind", "m.vote").count().collect()}
    real = estimate(patterns)
    # Spans are drawn one by one, by text and place, so that copies of a text share the sample with all others.
    share = 1 << 30
    keep = math.ceil(share * min(1.0, SAMPLE_SPANS / max(1, sum(patterns.values()))))
    drawn = F.filter("__marks", lambda m: F.pmod(F.xxhash64("text", m["kind"], m["start"], "__salt"), F.lit(share)) < keep)
    chosen = rows.withColumn("__salt", F.monotonically_increasing_id()).select("text", drawn.alias("__marks")).where(F.size("__marks") > 0)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells: tuple[list, list] = ([], [])
            for value, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for m in marks:
                    cells[0].append(features(value, (m["kind"], m["start"], m["end"]), m["vote"])), cells[1].append(real[(m["kind"], m["vote"])])
            yield pa.RecordBatch.from_arrays([pa.array(cells[0], pa.list_(pa.int32())), pa.array(cells[1], pa.float64())], names=["features", "target"])

    chosen = chosen.mapInArrow(sample, "features array<int>, target double").toArrow()
    if not chosen.num_rows:
        return Model(g, np.zeros(_BUCKETS))
    lists = [np.array(x, dtype=np.int32) for x in chosen.column("features").to_pylist()]
    order = sorted(range(len(lists)), key=lambda i: lists[i].tobytes())
    return Model(g, train([lists[i] for i in order], chosen.column("target").to_numpy()[order]))


def decide(text: str, model: Model, marks: list[tuple[str, int, int, str]] | None = None) -> list[tuple[str, int, int]]:
    """Spans of personal information in a text, none overlapping, from left to right; ``marks`` are its spans with votes, if known."""
    if marks is None:
        marks = [(*span, votes(text, span, model.gazetteers)) for span in proposed(text, model.gazetteers)]
    scored = []
    for kind, a, b, vote in marks:
        score = float(model.weights[features(text, (kind, a, b), vote)].sum())
        if score > 0:
            scored.append((score, (kind, a, b)))
    taken: list[tuple[str, int, int]] = []
    # Longer spans of other types hide names within them: a street is no person.
    for _, span in sorted(scored, key=lambda x: (x[1][0] == "name", -(x[1][2] - x[1][1]) if x[1][0] != "name" else 0, -x[0], x[1][1])):
        if all(span[2] <= a or span[1] >= b for _, a, b in taken):
            taken.append(span)
    return sorted(taken, key=lambda s: s[1])


def redacted(df: DataFrame, text: str, model: Model) -> DataFrame:
    """``df`` with ``spans`` (pii_type, start, end, found_text) and ``clean_text``, the text with a placeholder for each span.

    A placeholder is the type in capitals in square brackets. Null texts stay
    null with no spans, empty ones empty; the rest of a text is unchanged to
    the character. Spans known from ``marked`` are not looked for again.
    """
    given = df if "__marks" in df.columns else marked(df, text, model.gazetteers)
    columns = [c for c in given.columns if c != "__marks"]
    names = [f"__{i}" for i in range(len(columns))]
    rows = given.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)], F.col(text).cast("string").alias("__text"), "__marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("pii_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("found_text", pa.string())]))
        for batch in batches:
            found, clean = [], []
            for value, marks in zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True):
                taken = decide(value, model, [(m["kind"], m["start"], m["end"], m["vote"]) for m in marks]) if marks else []
                found.append([{"pii_type": k, "start": a, "end": b, "found_text": value[a:b]} for k, a, b in taken])
                parts, last = [], 0
                for k, a, b in taken:
                    parts += [value[last:a], f"[{k.upper()}]"]
                    last = b
                clean.append(None if value is None else "".join(parts) + value[last:])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(found, kind), pa.array(clean, pa.string())], names=[*names, "spans", "clean_text"])

    shape = ", ".join([*(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names), "spans array<struct<pii_type: string, start: int, end: int, found_text: string>>", "clean_text string"])
    out = rows.mapInArrow(run, shape)
    kept = [(n, c) for n, c in zip(names, columns, strict=True) if c not in ("spans", "clean_text")]
    return out.select(*[F.col(n).alias(c) for n, c in kept], "spans", "clean_text")
