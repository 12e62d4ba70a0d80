import numpy as np
import pytest

from lithograph.llm import neighbours
from lithograph.tables import checkpointed

DIM = 16


def rows(n, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, DIM))
    x = np.repeat(centres, 6, axis=0) + 0.15 * rng.normal(size=(n // 6 * 6, DIM))
    return [(f"k{i:04d}", (v * rng.uniform(0.5, 3)).tolist(), "x") for i, v in enumerate(x)]


def found(spark, data, k=5):
    df = spark.createDataFrame(data, "id string, v array<float>, vec string")
    vectors = checkpointed(neighbours.usable(df, "id", "v", DIM))
    names = {r.n: r.key for r in vectors.collect()}
    out = {}
    for r in neighbours.neighbours(vectors, k, DIM).collect():
        out.setdefault(names[r.n], []).append((r.similarity, names[r.other]))
    return out, vectors


def brute(data, k=5):
    keys = [r[0] for r in data]
    x = np.array([r[1] for r in data], dtype=np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, axis=1)[:, :k]
    return {keys[i]: {keys[j] for j in top[i]} for i in range(len(keys))}, s


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_VECTORS", 50)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 300)
    data = rows(1500)
    got, _ = found(spark, data)
    true, _ = brute(data)
    hits = sum(len(true[k] & {o for _, o in got.get(k, [])}) for k in true)
    assert hits / (5 * len(true)) >= 0.9
    assert all(k not in {o for _, o in v} and len(v) <= 5 for k, v in got.items())


def test_dense_cluster_is_ranked_exactly():
    rng = np.random.default_rng(3)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    # Half of the block is one cluster: mean and deviation put the bar above all of it.
    x = unit(np.concatenate((rng.normal(size=(400, DIM)), rng.normal(size=(1, DIM)) + 0.02 * rng.normal(size=(400, DIM)))))
    index = neighbours.fit(x, len(x), 5)
    lists, codes = neighbours._lists(x, index)
    n = np.arange(len(x))
    row, other, similarity = neighbours._search(x, n, x, n, codes, lists, index, 5)
    true = x @ x.T
    np.fill_diagonal(true, -2)
    assert np.bincount(row, minlength=len(x)).tolist() == [5] * len(x)
    assert np.allclose(similarity.reshape(-1, 5), -np.sort(-true, axis=1)[:, :5], atol=1e-5)
    assert (row != other).all()


def test_unusable_vectors_and_copies(spark):
    good = [1.0] * DIM
    data = [("a", good, "x"), ("b", [2.0] * DIM, "x"), ("a", good, "x"), ("c", None, "x"), ("d", [], "x"), ("e", [0.0] * DIM, "x"), ("f", [1.0] * 3, "x"), ("g", [float("nan")] + good[1:], "x"), ("h", [float("inf")] + good[1:], "x"), (None, good, "x"), ("i", [1.0, -1.0] * (DIM // 2), "x"), ("j", [None] + good[1:], "x")]
    got, vectors = found(spark, data)
    assert {r.key for r in vectors.collect()} == {"a", "b", "i"}
    assert got["a"][0][1] == "b" and got["a"][0][0] == pytest.approx(1, abs=1e-3) and len(got["i"]) == 2
    assert found(spark, data[3:4])[0] == {}


def test_exact(spark):
    _, vectors = found(spark, rows(60))
    n = {r.key: r.n for r in vectors.collect()}
    pairs = spark.createDataFrame([(n["k0000"], n["k0001"])], "n long, other long")
    row = neighbours.exact(pairs, vectors, DIM).first()
    assert (row.key, row.other_key) == ("k0000", "k0001") and row.similarity == pytest.approx(float(brute(rows(60))[1][0, 1]), abs=1e-6)


def close_pairs(spark, data, k, least):
    """Pairs of keys that ``close`` tells, the open ones decided by the full vectors."""
    vectors = checkpointed(neighbours.usable(spark.createDataFrame(data, "id string, v array<float>, vec string"), "id", "v", DIM))
    near = neighbours.close(vectors, k, DIM, least).collect()
    rows = {r.n: (r.key, np.frombuffer(r.vec, np.float32).astype(np.float64)) for r in vectors.collect()}
    found, competing = set(), {}
    for r in near:
        true = float(rows[r.n][1] @ rows[r.other][1])
        assert r.open or true >= least
        if r.competes:
            competing.setdefault((r.n, r.free), []).append((-true, r.other))
        elif true >= least:
            found.add((rows[r.n][0], rows[r.other][0]))
    for (n, free), others in competing.items():
        found |= {(rows[n][0], rows[o][0]) for true, o in sorted(others)[:free] if -true >= least}
    return found


def test_close_pairs_are_those_of_brute_force(spark, monkeypatch):
    # Small blocks, so that lists have several parts; clusters of 6 to 18, so that some have more than k members.
    monkeypatch.setattr(neighbours, "BLOCK_VECTORS", 40)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 150)
    data = rows(600) + [(f"m{k}", v, t) for k, v, t in rows(600, seed=1)] + [(f"o{k}", (np.array(v) + 0.02 * np.sin(np.arange(DIM) + i)).tolist(), t) for i, (k, v, t) in enumerate(rows(300, seed=1))]
    data = [(k, (np.array(v) + 1e-3 * np.cos(np.arange(DIM) * (i + 1))).tolist(), t) for i, (k, v, t) in enumerate(data)]
    top, s = brute(data)
    keys = [r[0] for r in data]
    at = {k: i for i, k in enumerate(keys)}
    expected = {(a, b) for a, others in top.items() for b in others if s[at[a], at[b]] >= 0.87}
    got = close_pairs(spark, data, 5, 0.87)
    assert len(expected) > 1000 and len(expected & got) >= 0.999 * len(expected) and len(got - expected) <= 0.001 * len(expected)


def test_close_pairs_where_all_are_close(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "_CELLS", 5_000)
    monkeypatch.setattr(neighbours, "_HELD", 2_000)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=DIM)
    data = [(f"k{i:03d}", (centre + 0.1 * rng.normal(size=DIM)).tolist(), "x") for i in range(500)]
    top, s = brute(data)
    assert s[~np.eye(500, dtype=bool)].min() > 0.87
    got = close_pairs(spark, data, 5, 0.87)
    assert len(got) == 2500 and len(got & {(a, b) for a, others in top.items() for b in others}) >= 0.95 * 2500


def test_queries_for_close_pairs_visit_few_lists(spark):
    """The search for the nearest of all, whatever their similarity, visits more than a fifth of the lists here."""
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(3000, 64)), 3, axis=0) + 0.15 * rng.normal(size=(9000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    index = neighbours.fit(x, len(x), 6)
    centroids = neighbours._means(x, neighbours.close_lists_of(len(x)), rng, unit=True)
    s = x @ centroids.T
    few = np.count_nonzero(s >= s.max(axis=1, keepdims=True) - neighbours._margin(x, centroids, 0.87), axis=1).mean()
    assert few <= 0.12 * len(centroids) and index.visits >= 0.2 * len(index.centroids)
    assert neighbours.close(spark.createDataFrame([], "n long, key string, vec binary"), 5, 64, 0.87).count() == 0
