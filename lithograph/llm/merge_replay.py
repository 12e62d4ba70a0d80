"""Byte-pair encoding by replaying all merges over a slice of the corpus at once.

The distinct words of a slice are laid out as one array of tokens. An inverted
index leads from each merge rank to the positions whose token pair it joins.
Merges are applied in rank order, each to all its positions in one array
operation; only the pairs of the touched neighbours are looked up again and
put into the index. A merge can only create pairs of higher rank, because a
token is made before it is used, so one pass over the ranks is complete.

Words never interact, hence slices can be replayed apart: no shuffle, and no
table of all words of the corpus is ever needed.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex

# The public pattern that splits text into words before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _printable_bytes() -> dict[str, int]:
    """Characters by which vocabulary files of this kind write bytes: printable ones stand for themselves."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    shifted = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


class Vocabulary:
    """Merges of a byte-level BPE vocabulary file (the tokenizers library's JSON)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        ids = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([ids[a] for a, _ in merges], dtype=np.int64)
        right = np.array([ids[b] for _, b in merges], dtype=np.int64)
        keys = left << 32 | right
        order = np.argsort(keys)
        self.pairs, self.ranks = keys[order], order
        self.left, self.right = left, right
        self.joined = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
        self.byte_ids = np.zeros(256, dtype=np.int64)
        written = _printable_bytes()
        for char, byte in written.items():
            self.byte_ids[byte] = ids[char]
        #: Length in bytes of each token; every character of a written token is one byte.
        self.n_bytes = np.zeros(max(ids.values()) + 1, dtype=np.int64)
        for token, i in ids.items():
            self.n_bytes[i] = len(token)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge that joins each pair, or -1."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.ranks[at], -1)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once per process."""
    return Vocabulary(path)


def replay(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words, one after another, and the offsets of the words in them."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    size = int(lengths.sum())
    token = vocab.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    ends = np.cumsum(lengths)
    after = np.arange(1, size + 1)
    after[ends[lengths > 0] - 1] = -1
    before = np.arange(-1, size - 1)
    before[(ends - lengths)[lengths > 0]] = -1

    index: dict[int, list[np.ndarray]] = {}
    waiting: list[int] = []

    def enter(at: np.ndarray) -> None:
        rank = vocab.rank(token[at], token[after[at]])
        known = rank >= 0
        at, rank = at[known], rank[known]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        bounds = np.flatnonzero(np.diff(rank, prepend=-1, append=-1))
        for r, a, b in zip(rank[bounds[:-1]].tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if r in index:
                index[r].append(at[a:b])
            else:
                index[r] = [at[a:b]]
                heapq.heappush(waiting, r)

    enter(np.flatnonzero(after >= 0))
    while waiting:
        r = heapq.heappop(waiting)
        found = index.pop(r)
        at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
        left, right = vocab.left[r], vocab.right[r]
        follows = after[at]
        at = at[(token[at] == left) & (follows >= 0) & (token[follows] == right)]
        if not len(at):
            continue
        if left == right:  # a run of equal tokens joins from its left end, two by two
            at = np.sort(at)
            starts = np.flatnonzero(np.concatenate(([True], after[at[:-1]] != at[1:])))
            run = np.repeat(starts, np.diff(np.append(starts, len(at))))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
        gone = after[at]
        token[at] = vocab.joined[r]
        token[gone] = -1
        rest = after[gone]
        after[at] = rest
        before[rest[rest >= 0]] = at[rest >= 0]
        touched = before[at]
        enter(np.unique(np.concatenate((touched[touched >= 0], at[rest >= 0]))))
    alive = token >= 0
    counts = np.zeros(len(words) + 1, dtype=np.int64)
    if size:
        kept = np.concatenate(([0], np.cumsum(alive)))
        counts[1:] = kept[ends]
    return token[alive], counts


class _Codes(dict):
    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        return code


class Encoder:
    """Encodes texts slice by slice; words known from earlier slices are not replayed again."""

    #: Distinct words kept at most; beyond, the dictionary starts anew.
    MOST_WORDS = 1_000_000

    def __init__(self, path: str, mark: Callable[[str], int] | None = None) -> None:
        self.vocab = vocabulary(path)
        self.mark = mark
        self.find = regex.compile(PATTERN).findall
        self.start()

    def start(self) -> None:
        self.codes = _Codes()
        self.ids, self.at = np.empty(0, np.int32), np.zeros(1, np.int64)
        #: Characters of each word.
        self.chars = np.empty(0, np.int64)
        #: What ``mark`` says of each word.
        self.marks = np.empty(0, np.int64)

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the words of all texts, one after another, and the offsets of the texts in them."""
        if len(self.codes) > self.MOST_WORDS:
            self.start()
        code = self.codes.__getitem__
        parts = [np.fromiter(map(code, self.find(t)), np.int32) if t else np.empty(0, np.int32) for t in texts]
        offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))))
        known = len(self.at) - 1
        if len(self.codes) > known:
            strings = list(self.codes)[known:]
            ids, at = replay([w.encode("utf-8", "surrogatepass") for w in strings], self.vocab)
            self.chars = np.concatenate((self.chars, np.fromiter(map(len, strings), np.int64, len(strings))))
            if self.mark:
                self.marks = np.concatenate((self.marks, np.fromiter(map(self.mark, strings), np.int64, len(strings))))
            self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
            self.at = np.concatenate((self.at, self.at[-1] + at[1:]))
        return np.concatenate(parts) if parts else np.empty(0, np.int32), offsets

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the offsets of the texts in them. Null and empty texts have none."""
        words, offsets = self.words(texts)
        lengths = (self.at[1:] - self.at[:-1])[words]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        take = np.arange(ends[-1]) + np.repeat(self.at[:-1][words] - ends[:-1], lengths)
        return self.ids[take], ends[offsets]

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text."""
        words, offsets = self.words(texts)
        ends = np.concatenate(([0], np.cumsum((self.at[1:] - self.at[:-1])[words])))
        return np.diff(ends[offsets])
