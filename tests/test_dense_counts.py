from collections import Counter

import pytest

from lithograph.operators import dense_counts
from lithograph.tables import once


@pytest.mark.parametrize("keys", [["k"], ["k", "j"]])
def test_counts_match_brute_force(spark, keys, monkeypatch):
    rows = [("hot", "x", 1, 0)] * 500 + [(f"k{i % 37}", f"j{i % 5}", i, 1) for i in range(400)] + [(None, "x", 1, 2), ("hot", None, None, 3)]
    df = spark.createDataFrame(rows, "k string, j string, m long, n int")
    found = {tuple(r[k] for k in keys): (r.n, r.total) for r in dense_counts.key_counts(df, keys, measure="m", blocks=3).collect()}
    good = [r for r in rows if r[0] is not None and (len(keys) == 1 or r[1] is not None)]
    count, total = Counter(), Counter()
    for r in good:
        count[r[: len(keys)]] += 1
        total[r[: len(keys)]] += r[2] or 0
    assert found == {k: (n, total[k]) for k, n in count.items()}


def test_small_splits_are_sent_on(spark, monkeypatch):
    monkeypatch.setattr(dense_counts, "SPLIT_KEYS", 10)
    df = spark.range(1000).selectExpr("id % 300 AS k")
    found = dense_counts.key_counts(df, ["k"]).collect()
    assert len(found) == 300 and sum(r.n for r in found) == 1000


def test_heavy_keys_and_empty(spark):
    df = spark.createDataFrame([("a",)] * 99 + [("b",)], "k string")
    counts = dense_counts.key_counts(df, ["k"])
    assert {r.k for r in dense_counts.heavy_keys(counts, 0.01).collect()} == {"a", "b"}
    assert {r.k for r in dense_counts.heavy_keys(counts, 0.011).collect()} == {"a"}
    assert dense_counts.heavy_keys(dense_counts.key_counts(df.limit(0), ["k"]), 0.01).count() == 0


def test_once(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 3), ("a", 2)], "id string, v int")
    assert sorted(map(tuple, once(df, "id").collect()), key=str) == [("a", 1), (None, 3)]
