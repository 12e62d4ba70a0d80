import base64
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lithograph.llm import merge_replay, packing, splitting, tokens

PLACE = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
pytestmark = pytest.mark.skipif(not os.path.exists(f"{PLACE}/byte_bpe_50k.json"), reason="no vocabulary files here")
VOCABULARY = f"{PLACE}/byte_bpe_50k.json"
ODD = [None, "", " ", "\n\n", "it's  a test\n\n  of words", "aaaaaaaaaaaaaaa" * 50, "日本語のテキスト。次の文。", "🙂🙃 e\u0301\u200d x\x1c\x85 y", "<|endoftext|>", "ab" * 4000, "word " * 900, "İstanbul ﬁ ١٢٣ 𝟘", "\ufeffb\r\nc\t\td"]


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    with open(f"{PLACE}/byte_bpe_50k.tiktoken", "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=merge_replay.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(texts):
    ids, at = merge_replay.Encoder(VOCABULARY).encode(texts)
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


def test_ids_equal_the_public_library(reference):
    assert encoded(ODD) == [reference.encode_ordinary(t or "") for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_any_text_equals_the_public_library(reference, texts):
    assert encoded(texts) == [reference.encode_ordinary(t) for t in texts]


def test_dictionary_starts_anew(reference, monkeypatch):
    monkeypatch.setattr(merge_replay.Encoder, "MOST_WORDS", 3)
    encoder = merge_replay.Encoder(VOCABULARY)
    for text in ("one two three four", "five six", "one"):
        assert encoder.encode([text])[0].tolist() == reference.encode_ordinary(text)


def test_token_ids(spark, reference, monkeypatch):
    monkeypatch.setattr(tokens, "SLICE_CHARS", 50)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(0, None, "y")], "doc_id long, text string, ids string")
    rows = tokens.token_ids(df, "doc_id", "text", VOCABULARY).collect()
    assert sorted((r.doc_id, r.ids) for r in rows) == sorted([(i, reference.encode_ordinary(t or "")) for i, t in enumerate(ODD)] + [(0, [])])
    assert tokens.token_ids(df.limit(0), "doc_id", "text", VOCABULARY).count() == 0
    counts = {r.doc_id: r.n_tokens for r in tokens.token_counts(df, "doc_id", "text", VOCABULARY).collect()}
    assert counts[5] == len(reference.encode_ordinary(ODD[5]))


def best_possible(sizes, capacity):
    """Containers of an optimal packing, by search."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= sizes[i]}.values():
            place(i + 1, [*rooms[:j], rooms[j] - sizes[i], *rooms[j + 1 :]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=8))
def test_bound_never_exceeds_the_optimum(sizes):
    array = np.array(sizes, dtype=np.int64)
    placed = packing.best_fit_decreasing(array, 20)
    assert all(array[placed == c].sum() <= 20 for c in set(placed.tolist()))
    assert packing.lower_bound(array, 20) <= best_possible(sizes, 20) <= len(set(placed.tolist()))


def test_bound_sees_items_that_do_not_pair():
    assert packing.lower_bound(np.full(10, 11), 20) == 10 and packing.lower_bound(np.full(9, 7), 20) == 5


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "PARTITION_ITEMS", 40)
    monkeypatch.setattr(packing, "EXCHANGE", 2)
    rng = np.random.default_rng(3)
    rows = [(int(i), int(n), "x") for i, n in enumerate(rng.integers(0, 90, 400))] + [(1000, None, "x"), (1001, 250, "x"), (1002, 100, "x"), (1002, 100, "x")]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, n long, piece string"), "doc_id", "n", 100)
    found = packed.collect()
    fill = {}
    for r in found:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
    assert max(fill.values()) <= 100
    assert sorted((r.doc_id, r.piece, r.n_tokens) for r in found) == sorted([(i, 0, n) for i, n, _ in rows if n and n <= 100] + [(1001, 0, 100), (1001, 1, 100), (1001, 2, 50)])
    seen = packing.certificate(packed, 100).first()
    assert seen.containers == len(fill) and seen.lower_bound <= len(fill) <= seen.lower_bound * 1.05 and seen.n_tokens == sum(fill.values())
    assert packing.pack(spark.createDataFrame([], "doc_id long, n long"), "doc_id", "n", 100).count() == 0
    with pytest.raises(ValueError):
        packing.pack(packed, "doc_id", "n_tokens", 0)


def test_split(spark, reference):
    texts = [*ODD, "One sentence here. " * 400, "para one\n\n" * 300, "x" * 5000, "🙂" * 900, "\n" * 3000, ("ab1" * 100 + " ") * 8]
    df = spark.createDataFrame([(i, t, "y") for i, t in enumerate(texts)], "doc_id long, text string, piece string")
    pieces = {}
    for r in splitting.split_texts(df, "doc_id", "text", 64, 8, VOCABULARY).orderBy("doc_id", "piece").collect():
        pieces.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(texts):
        own = pieces.get(i, [])
        assert bool(own) == (len(reference.encode_ordinary(text or "")) > 64)
        if own:
            assert own[0].start_char == 0 and own[-1].end_char == len(text) and [r.piece for r in own] == list(range(len(own)))
        for r in own:
            assert r.piece_text == text[r.start_char : r.end_char] and r.n_tokens == len(reference.encode_ordinary(r.piece_text)) <= 64
        for a, b in zip(own, own[1:]):
            assert a.start_char < b.start_char < a.end_char < b.end_char and b.overlap_tokens >= 8
    sentence = pieces[texts.index("One sentence here. " * 400)]
    assert {r.cut_grade for r in sentence[:-1]} == {3}
    assert splitting.split_texts(df.limit(0), "doc_id", "text", 64, 8, VOCABULARY).count() == 0
    with pytest.raises(ValueError):
        splitting.split_texts(df, "doc_id", "text", 64, 40, VOCABULARY)
