from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lithograph.operators import graph as q
from tests.seed import R, graph, keys


@pytest.fixture(scope="module")
def g(spark):
    return graph(spark)


def ts(text):
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_callers_and_callees(spark, g):
    assert values(q.callers_of(g, keys(spark, "s", "pac")), "caller_id", "path") == [("shi", "src/desk/orders.py")]
    assert values(q.callees_of(g, keys(spark, "s", "pac")), "callee_id") == [("sta",)]
    assert values(q.callers_of(g), "callee_id", "caller_id") == [("pac", "shi"), ("sta", "pac")]


def test_symbols_in_file_are_in_order(spark, g):
    rows = q.symbols_in_file(g, keys(spark, "f", "B")).orderBy("ordinal").collect()
    assert [r.qualified_name for r in rows] == ["pack_crate", "_stack_box"]


def test_history(spark, g):
    files = keys(spark, "f", "B", "none")
    rows = q.recent_commits_touching(g, files, 2).orderBy("rank").collect()
    assert [(r.sha[0], r.login) for r in rows] == [("c", "ben"), ("b", "ada")]
    assert values(q.authors_of_file(g, ts("2026-01-01 00:00:00"), files), "login", "n") == [("ada", 2), ("ben", 1)]
    assert values(q.authors_of_file(g, ts("2026-02-15 00:00:00"), files), "login", "n") == [("ben", 1)]
    assert values(q.reviewers_of_file(g, ts("2026-01-01 00:00:00"), files), "login", "n") == [("cleo", 1)]
    assert values(q.revert_commits_touching(g, ts("2026-01-01 00:00:00"), files), "sha") == [("b" * 40,)]
    assert values(q.commit_count_for_file_since(g, ts("2026-02-01 00:00:00"), files), "file_id", "n") == [("B", 2), ("none", 0)]


def test_duplicate_touches_count_twice_and_authors_may_be_null(spark):
    g = graph(spark, commit_modifies_file=[dict(id="m9", commit_id="c", file_id="B")], commits=[dict(id="d", repository_id=R, sha="d" * 40, message="", committed_at=datetime(2026, 4, 1))])
    assert ("ben", 2) in values(q.authors_of_file(g, ts("2026-01-01 00:00:00")), "login", "n")
    assert values(q.reviewers_of_file(g, ts("2026-01-01 00:00:00")), "login", "n") == [("cleo", 1)]


def test_people(spark, g):
    assert values(q.open_prs_assigned_to(g), "person_id", "n") == [("ada", 0), ("ben", 1), ("cleo", 0)]
    more = [dict(id="v2", pull_request_id="p43", reviewer_id="cleo", state="CHANGES_REQUESTED", submitted_at=datetime(2026, 3, 16)), dict(id="v3", pull_request_id="p43", reviewer_id="cleo", state="approved", submitted_at=datetime(2026, 3, 17))]
    wider = graph(spark, reviews=more)
    assert values(q.review_acceptance_rate(wider, ts("2026-01-01 00:00:00"), keys(spark, "p", "cleo")), "approved", "total") == [(2, 3)]
    assert values(q.review_acceptance_rate(wider, ts("2026-04-01 00:00:00"), keys(spark, "p", "cleo")), "approved", "total") == [(0, 0)]
    seen = {r.person_id: r.last_at for r in q.last_activity_at(graph(spark, persons=[dict(id="idle", github_login="idle")])).collect()}
    assert seen == {"ada": datetime(2026, 2, 3), "ben": datetime(2026, 3, 4), "cleo": datetime(2026, 3, 6), "idle": None}


def test_overlap_counts_neighbours(spark):
    g = graph(spark, commit_modifies_symbol=[dict(commit_id="b", symbol_id="shi", change_kind="body_only")])
    sets = spark.createDataFrame([("s", "B")], "set_id string, file_id string")
    assert values(q.call_graph_overlap_counts(g, sets, ts("2026-01-01 00:00:00")), "person_id", "n") == [("ada", 1)]
    assert q.call_graph_overlap_counts(g, sets, ts("2026-02-04 00:00:00")).count() == 0


def test_overlap_of_many_sets_does_not_shuffle_their_people(spark, monkeypatch):
    monkeypatch.setattr("lithograph.operators.blocks.BLOCK_SETS", 2)
    people, symbols = [f"u{i}" for i in range(7)], [f"y{i}" for i in range(9)]
    calls = {(f"y{i}", f"y{i * j % 9}") for i in range(9) for j in range(1, 4)}
    changes = {(p, f"y{(n + k) % 9}") for n, p in enumerate(people) for k in range(n)}
    wanted = {f"s{n}": {f"F{i}" for i in range(3) if n >> i & 1} for n in range(8)}
    g = graph(
        spark, files=[dict(id=f"F{i}", repository_id=R, path=f"F{i}.py", content_hash="h") for i in range(3)], symbols=[dict(id=y, repository_id=R, file_id=f"F{i % 3}", qualified_name=y, kind="class", start_line=i) for i, y in enumerate(symbols)],
        symbol_calls=[dict(id=f"{a}{b}", caller_id=a, callee_id=b, line=1) for a, b in calls], commits=[dict(id=f"c{p}", repository_id=R, sha=p, author_id=p, message="", committed_at=datetime(2026, 3, 1)) for p in people], commit_modifies_symbol=[dict(commit_id=f"c{p}", symbol_id=y, change_kind="body_only") for p, y in changes],
    )
    expected = {}
    for one, files in wanted.items():
        own = {y for i, y in enumerate(symbols) if f"F{i % 3}" in files}
        near = {b for a, b in calls if a in own} | {a for a, b in calls if b in own}
        expected |= {(one, p): n for p in people if (n := sum((p, y) in changes for y in near))}
    found = q.call_graph_overlap_counts(g, spark.createDataFrame([(s, f) for s, fs in wanted.items() for f in fs], "set_id string, file_id string"), ts("2026-02-15 00:00:00"))
    assert {(r.set_id, r.person_id): r.n for r in found.collect()} == expected and len(expected) > 20
    assert "hashpartitioning(set_id" not in found._jdf.queryExecution().executedPlan().toString()


def test_lookups(spark):
    g = graph(spark, symbols=[dict(id="x1", repository_id=R, file_id="A", qualified_name="Invoice.total"), dict(id="x2", repository_id=R, file_id="A", qualified_name="Order.total"), dict(id="x3", repository_id=R, file_id="A", qualified_name="Order.getXit")], issues=[dict(id="i", repository_id=R, number=7, title="t", state="open")])
    names = spark.createDataFrame([(R, n) for n in ("pack_crate", "total", "getXit", "get_it", None)], "repository_id string, name string")
    # An underscore stands for any letter, as in LIKE.
    assert values(q.symbol_by_qualified_name(g, names), "name", "symbol_id") == [("getXit", "x3"), ("get_it", "x3"), ("pack_crate", "pac")]
    numbers = spark.createDataFrame([(R, 7), (R, 8)], "repository_id string, number int")
    assert [(r.number, r.title) for r in q.issue_by_number(g, numbers).orderBy("number").collect()] == [(7, "t"), (8, None)]
    assert values(q.codeowners_for(g, keys(spark, "p", "src/depot/crates.py")), "login", "n") == [("ada", 2), ("ben", 1)]
    assert values(q.files_touched_by_pr(g), "pull_request_id", "path") == [("p42", "src/depot/crates.py")]


def test_file_by_path_prefers_the_version_touched_last(spark):
    g = graph(spark, files=[dict(id="B0", repository_id=R, path="src/depot/crates.py", content_hash="h0")])
    assert dict((r.path, r.file_id) for r in q.file_by_path(g).collect())["src/depot/crates.py"] == "B"


def test_similarity_is_exact_and_ties_go_to_the_smaller_key(spark):
    prs = [dict(id=f"s{i}", repository_id=R, number=i, title="", state="open", embedding=v) for i, v in enumerate([[2.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [1.0, 1.0, 0.0, 0.0], None, [0.0] * 4, [1.0]])]
    g = graph(spark, pull_requests=prs, adrs=[dict(id="d1", repository_id=R, path="p", title="T", status="proposed", embedding=[1.0, 0.0, 0.0, 0.0])])
    asked = g["pull_requests"].where("id = 'p42'").select("id", "embedding")
    rows = q.similar_prs(g, asked, 3, dim=4).orderBy("rank").collect()
    assert [r.pull_request_id for r in rows] == ["p42", "s0", "s2"]
    assert rows[2].similarity == pytest.approx(2**-0.5, abs=1e-8)
    assert q.similar_adrs(g, asked, 5, dim=4).collect()[0].status == "proposed"


def test_empty_graph(spark, g):
    empty = {k: v.limit(0) for k, v in g.items()}
    assert q.callers_of(empty).count() == q.authors_of_file(empty, ts("2026-01-01 00:00:00")).count() == q.similar_prs(empty, empty["pull_requests"].select("id", "embedding"), 5, dim=4).count() == 0
