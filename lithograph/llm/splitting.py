"""Cutting oversized texts at natural boundaries, by recursive bisection.

A text above the limit is cut at the strongest boundary near its middle, and
its halves again, until each core with its overlap is within the limit. The
overlap is taken from the end of the piece before, back to the start of a word.

Candidates for a cut are the starts of the tokenizer's words, graded by what
precedes them: a blank line, a line end, a sentence end, a clause end, white
space, nothing. Words longer than ``LONG_WORD`` tokens may also be cut inside,
between tokens that end a character; pieces that begin or end there are encoded
again, and cut once more if they came out above the limit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithograph.llm.merge_replay import Encoder
from lithograph.llm.tokens import VOCABULARY, slices

LONG_WORD = 24
#: A cut lies within this share of the part's length on either side of its middle.
NEAR = 0.2
_LINE = re.compile(r"\r\n|\n|\r")
_SPACE, _SPACED, _SENTENCE, _CLAUSE, _BARE, _LINES = 1, 2, 4, 8, 16, 5
_ENDS = [(re.compile(r".*[.!?…][\"'”’)\]]*", re.S), _SENTENCE), (re.compile(r".*[,;:]", re.S), _CLAUSE), (re.compile(r".*[。！？][」』”’）]*", re.S), _SENTENCE | _BARE), (re.compile(r".*[、，；：]", re.S), _CLAUSE | _BARE)]


def mark(word: str) -> int:
    """What a word tells about the boundaries beside it, as bits; line ends are counted up to 3 from bit 5 on.

    White space, a leading space, an end of a sentence or clause, and whether
    that end needs no white space after it.
    """
    if word.isspace():
        return _SPACE | min(3, len(_LINE.findall(word))) << _LINES
    bits = _SPACED if word[0] == " " else 0
    if not word[-1].isalnum():
        for pattern, bit in _ENDS:
            if pattern.fullmatch(word):
                bits |= bit
    return bits


def grades(marks: np.ndarray) -> np.ndarray:
    """The grade of the boundary before each word, and of the one at the end.

    A boundary counts behind all white space, before the word that follows; the
    line ends of the run and the word before it give the grade.
    """
    n = len(marks)
    out = np.zeros(n + 1, dtype=np.int8)
    if not n:
        return out
    space = (marks & _SPACE) > 0
    lines = np.concatenate(([0], np.cumsum(marks >> _LINES)))
    before = np.concatenate(([-1], np.maximum.accumulate(np.where(space, -1, np.arange(n)))))[:n]  # the last word that is no white space
    run = lines[:n] - lines[before + 1]
    said = np.where(before >= 0, marks[before], 0)
    apart = (before < np.arange(n) - 1) | ((marks & _SPACED) > 0)
    heard = apart | ((said & _BARE) > 0)
    grade = np.select([run > 1, run == 1, heard & ((said & _SENTENCE) > 0), heard & ((said & _CLAUSE) > 0), apart], [5, 4, 3, 2, 1], 0)
    out[:n] = np.where(space, 0, grade)
    return out


class _Text:
    """Candidates for cuts of one text: characters, tokens and grades before each, and whether it lies inside a word."""

    def __init__(self, text: str, words: np.ndarray, encoder: Encoder) -> None:
        self.text = text
        size = encoder.at[1:] - encoder.at[:-1]
        n = size[words]
        char = np.concatenate(([0], np.cumsum(encoder.chars[words])))
        token = np.concatenate(([0], np.cumsum(n)))
        grade = grades(encoder.marks[words])
        inner = np.zeros(len(char), dtype=bool)
        if (n > LONG_WORD).any():
            extra = []
            for i in np.flatnonzero(n > LONG_WORD).tolist():
                ids = encoder.ids[encoder.at[words[i]] : encoder.at[words[i] + 1]]
                raw = np.frombuffer(text[char[i] : char[i + 1]].encode("utf-8", "surrogatepass"), np.uint8)
                begins = (raw & 0xC0) != 0x80
                chars = np.concatenate(([0], np.cumsum(begins)))
                ends = np.cumsum(encoder.vocab.n_bytes[ids])[:-1]
                good = np.flatnonzero(begins[ends])
                extra.append(np.stack((char[i] + chars[ends[good]], token[i] + good + 1)))
            more = np.concatenate(extra, axis=1)
            char, token = np.concatenate((char, more[0])), np.concatenate((token, more[1]))
            grade = np.concatenate((grade, np.full(more.shape[1], -1, dtype=np.int8)))
            inner = np.concatenate((inner, np.ones(more.shape[1], dtype=bool)))
            order = np.argsort(char, kind="stable")
            char, token, grade, inner = char[order], token[order], grade[order], inner[order]
        self.char, self.token, self.grade, self.inner = char, token, grade, inner

    def overlap(self, a: int, overlap: int) -> int:
        """The candidate from which a piece with the core from ``a`` begins: the last one at least ``overlap`` tokens back."""
        return max(0, int(np.searchsorted(self.token, self.token[a] - overlap, "right")) - 1) if a else 0

    def middle(self, a: int, b: int) -> int | None:
        """The strongest candidate near the middle between a and b, the nearest of equals."""
        if b - a < 2:
            return None
        token = self.token
        mid, reach = (token[a] + token[b]) / 2, max(1.0, NEAR * (token[b] - token[a]))
        low = max(a + 1, int(np.searchsorted(token, mid - reach, "left")))
        high = min(b, int(np.searchsorted(token, mid + reach, "right")))
        if low >= high:  # one long token run around the middle: the candidate nearest to it
            low, high = a + 1, b
        span = slice(low, high)
        return low + int(np.lexsort((np.abs(token[span] - mid), -self.grade[span]))[0])

    def cut(self, a: int, b: int, limit: int, overlap: int) -> list[tuple[int, int]]:
        """Cores of the part between a and b, from left to right."""
        done, waiting = [], [(a, b)]
        while waiting:
            a, b = waiting.pop()
            if self.token[b] - self.token[a] <= limit - overlap and self.token[b] - self.token[self.overlap(a, overlap)] <= limit:
                done.append((a, b))
                continue
            middle = self.middle(a, b)
            if middle is None:
                done.append((a, b))
                continue
            waiting += [(middle, b), (a, middle)]
        return done


def _counted(text: _Text, cores: list[tuple[int, int]], overlap: int) -> tuple[list[str], list[int]]:
    """Texts to encode for the token count of each piece, and the tokens besides.

    From the start of a word on, a piece has the words of the whole text, but
    for white space at its end, which then forms one word. Only that end is
    encoded again, or the whole piece if it begins or ends inside a word.
    """
    strings, besides = [], []
    for a, b in cores:
        start = text.overlap(a, overlap)
        if text.inner[start] or text.inner[b]:
            strings.append(text.text[text.char[start] : text.char[b]])
            besides.append(0)
            continue
        last = b
        while last > start and text.text[text.char[last - 1] : text.char[last]].isspace():
            last -= 1
        strings.append(text.text[text.char[last] : text.char[b]])
        besides.append(int(text.token[last] - text.token[start]))
    return strings, besides


def split(texts: list[str], encoder: Encoder, limit: int, overlap: int) -> list[list[tuple[int, int, int, int, int]]]:
    """Pieces of each text above the limit: start, end (characters), tokens, tokens shared with the piece before, grade of the cut at the end."""
    words, offsets = encoder.words(texts)
    size = np.concatenate(([0], np.cumsum((encoder.at[1:] - encoder.at[:-1])[words])))[offsets]
    long = [i for i in range(len(texts)) if size[i + 1] - size[i] > limit]
    # The encoder may start a new dictionary in later calls, so all that depends on codes is read here.
    views = {i: _Text(texts[i], words[offsets[i] : offsets[i + 1]], encoder) for i in long}
    cores = {i: v.cut(0, len(v.char) - 1, limit, overlap) for i, v in views.items()}
    tokens: dict[int, dict[tuple[int, int], int]] = {i: {} for i in long}
    open_ = {i: list(c) for i, c in cores.items()}
    while open_:
        asked = {i: _counted(views[i], c, overlap) for i, c in open_.items()}
        counts = iter(encoder.count([s for strings, _ in asked.values() for s in strings]).tolist())
        again: dict[int, list[tuple[int, int]]] = {}
        for i, (_, besides) in asked.items():
            for core, beside in zip(open_[i], besides, strict=True):
                n = beside + next(counts)
                middle = views[i].middle(*core) if n > limit else None
                if middle is None:
                    tokens[i][core] = n
                else:
                    again.setdefault(i, []).extend(((core[0], middle), (middle, core[1])))
        open_ = again
    out: list[list[tuple[int, int, int, int, int]]] = [[] for _ in texts]
    for i, view in views.items():
        for (a, b), n in sorted(tokens[i].items()):
            start = view.overlap(a, overlap)
            out[i].append((int(view.char[start]), int(view.char[b]), n, int(view.token[a] - view.token[start]), int(view.grade[b])))
    return out


def split_texts(df: DataFrame, key: str, text: str, limit: int = 512, overlap: int = 64, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of every text above ``limit`` tokens: key, piece, start_char, end_char, n_tokens, overlap_tokens, cut_grade, piece_text.

    Pieces are numbered from 0 and cover the text; each has at most ``limit``
    tokens when encoded by itself and, but for the first, begins at least
    ``overlap`` tokens before the end of the one before, at the nearest start
    of a word (of a character in words of more than 24 tokens). cut_grade tells
    what the piece ends at: 5 blank line, 4 line end, 3 sentence, 2 clause,
    1 white space, 0 another word, -1 inside a long word. Texts within the
    limit, empty and null ones have no row; repeated rows are cut each; an
    empty table gives an empty table. Other columns are ignored.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half the limit")
    rows = df.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    kind = rows.schema["__key"].dataType.simpleString()
    numbers = ["piece", "start_char", "end_char", "n_tokens", "overlap_tokens", "cut_grade"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary, mark)
        for batch in slices(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = split(texts, encoder, limit, overlap)
            row = [i for i, p in enumerate(found) for _ in p]
            flat = [(k, *p) for pieces in found for k, p in enumerate(pieces)]
            columns = [pa.array([f[c] for f in flat], pa.int32()) for c in range(6)]
            strings = pa.array([texts[i][f[1] : f[2]] for i, f in zip(row, flat, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *columns, strings], names=["__key", *numbers, "piece_text"])

    shape = f"__key {kind}, {', '.join(f'{n} int' for n in numbers)}, piece_text string"
    return rows.mapInArrow(run, shape).select(F.col("__key").alias(key), *numbers, "piece_text")
