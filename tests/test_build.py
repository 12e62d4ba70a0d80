import random

import pytest

from lithograph.sources import merge
from lithograph.streaming import build

SHAPE = "repository_id string, path string, content string"
CHANGES = "repository_id string, path string, kind string, content string"
TREE = {"pkg/__init__.py": "", "pkg/a.py": "def foo():\n    return 1\n", "pkg/b.py": "from .a import foo\ndef bar():\n    return foo()\n"}


def sources(spark, tree):
    return spark.createDataFrame([("r", p, t) for p, t in tree.items()], SHAPE)


def edges(state):
    names = {r.id: r.qualified_name for r in state["symbols"].collect()}
    return sorted((names.get(r.caller_id), names.get(r.callee_id), r.line) for r in state["symbol_calls"].collect())


def changed(spark, state, *rows):
    return build.applied(state, spark.createDataFrame([("r", *row) for row in rows], CHANGES))


def test_full_build(spark):
    state = build.full_build(sources(spark, TREE))
    assert edges(state) == [("bar", "foo", 3)] and state["files"].count() == 3
    again = build.applied(state, sources(spark, TREE).selectExpr("repository_id", "path", "'M' AS kind", "content"))
    assert edges(again) == edges(state) and sorted(again["symbols"].collect()) == sorted(state["symbols"].collect())


def test_incremental(spark):
    state = build.full_build(sources(spark, TREE))
    before = {r.qualified_name: r.id for r in state["symbols"].collect()}
    after = changed(spark, state, ("pkg/b.py", "M", "from .a import foo\n\ndef bar():\n    return foo()\n"))
    assert {r.qualified_name: r.id for r in after["symbols"].collect()} == before and edges(after) == [("bar", "foo", 4)]
    gone = changed(spark, after, ("pkg/a.py", "D", None))
    assert edges(gone) == [] and {r.qualified_name for r in gone["symbols"].collect()} == {"bar"}
    # An edge from a file that did not change does not come back by itself.
    assert edges(changed(spark, gone, ("pkg/a.py", "A", TREE["pkg/a.py"]))) == []
    stats = build.change_stats(state, gone).first()
    assert (stats.files_removed, stats.files_changed, stats.files_unchanged, stats.symbols_removed) == (1, 1, 1, 1)
    assert edges(changed(spark, state, ("readme.txt", "A", "x"))) == edges(state)


def test_resolution_tiers(spark):
    tree = {
        "a.py": "def run(): pass\nclass K:\n    def only(self): pass\n    def twice(self): pass\nclass L:\n    def twice(self): pass\n",
        "b.py": "import a as z\nfrom q import missing as m, K\ndef run(): pass\ndef f(x):\n    run()\n    z.K.only()\n    x.twice()\n    K.only()\n    only()\n    twice()\n    x().y()\n    f()()\n    nope()\n",
    }
    files = build.parsed_files(sources(spark, tree))
    symbols = build.symbols_of(files)
    resolved = build.resolved_calls(files, symbols, files)
    paths = {r.id: (r.file_id, r.qualified_name) for r in symbols.collect()}
    here = {r.id: r.path for r in files.collect()}
    found = {(r.line, r.target_name): (here[paths[r.callee_id][0]], paths[r.callee_id][1]) if r.callee_id else None for r in resolved.collect()}
    assert found[(5, "run")] == ("b.py", "run") and found[(6, "z.K.only")] == ("a.py", "K.only") and found[(8, "K.only")] == ("a.py", "K.only")
    assert found[(9, "only")] == ("a.py", "K.only") and found[(10, "twice")] is None and found[(7, "x.twice")] is None and found[(13, "nope")] is None
    assert build.dropped(resolved).first().dynamic_calls_dropped == 1


def test_adrs_follow_their_files(spark):
    text = "# One\nStatus: accepted\n## Context\n"
    state = build.full_build(sources(spark, {"docs/adr/1.md": text}))
    assert [(r.title, r.status) for r in state["adrs"].collect()] == [("One", "accepted")]
    assert changed(spark, state, ("docs/adr/1.md", "M", "# One\n## Context\n"))["adrs"].count() == 0
    assert [r.status for r in changed(spark, state, ("docs/adr/1.md", "M", text.replace("accepted", "Superseded")))["adrs"].collect()] == ["superseded"]


@pytest.mark.parametrize("seed", [1, 2])
def test_incremental_equals_full(spark, seed):
    """Random edits that never delete a file others depend on end in the state of a full build."""
    rng = random.Random(seed)
    tree = {f"m{i}.py": f"def f{i}():\n    f{(i + 1) % 4}()\n" for i in range(4)}
    state = build.full_build(sources(spark, tree))
    edits = {}
    for _ in range(3):
        i = rng.randrange(4)
        edits[f"m{i}.py"] = f"# {rng.random()}\ndef f{i}():\n    f{rng.randrange(4)}()\n    g{rng.randrange(4)}()\ndef g{i}(): pass\n"
    edits = {p: t for p, t in (tree | edits).items()}
    after = changed(spark, state, *[(p, "M", t) for p, t in edits.items()])
    assert edges(after) == edges(build.full_build(sources(spark, edits)))


def test_stream(spark, tmp_path):
    for number, rows in enumerate([[("r", p, "A", t) for p, t in TREE.items()], [("r", "pkg/a.py", "D", None)]]):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.json(f"{tmp_path}/in/{number}")
        stream = spark.readStream.schema(CHANGES).json(f"{tmp_path}/in/*")
        build.maintain(stream, f"{tmp_path}/graph", f"{tmp_path}/check").awaitTermination()
    assert edges(merge.open_version(spark, f"{tmp_path}/graph", 1, build.TABLES)) == [("bar", "foo", 3)]
    assert edges(merge.open_version(spark, f"{tmp_path}/graph", 2, build.TABLES)) == []


def test_embedding_cache(spark):
    pending = spark.createDataFrame([("s1", "code", "x"), ("s2", "code", "x"), ("p", "prose", "y"), ("n", "prose", None)], "tag string, kind string, content string")
    none = spark.createDataFrame([], "key string, vector array<float>")
    rows, cache = build.embedded(pending, none, lambda texts, model: [[float(ord(t)), 0.0] for t in texts], "m", batch=1)
    assert sorted((r.tag, r.vector[0], r.cache_hit) for r in rows.collect()) == [("p", 121.0, False), ("s1", 120.0, False), ("s2", 120.0, False)] and cache.count() == 2
    again, _ = build.embedded(pending, cache, lambda texts, model: 1 / 0, "m")
    assert {(r.kind, r.hits, r.misses) for r in build.embedding_stats(again).collect()} == {("code", 2, 0), ("prose", 1, 0)}
    with pytest.raises(Exception, match="came back"):
        build.embedded(pending, none, lambda texts, model: [], "m")[0].collect()


def test_merges(spark):
    old = spark.createDataFrame([("a", 1, "x"), (None, 2, "y")], "k string, v int, w string")
    new = spark.createDataFrame([("a", 9, "z"), (None, 8, "q"), ("b", 7, "r"), ("b", 7, "r")], "k string, v int, w string")
    assert sorted(map(tuple, merge.upserted(old, new, ["k"], ["v"]).collect()), key=str) == [("a", 9, "x"), ("b", 7, "r"), (None, 8, "y")]
    assert merge.without(old, new.where("k = 'a'").select("k"), "k").count() == 1


def test_repositories_and_bookmarks(spark):
    shape = "id string, owner string, name string, last_indexed_sha string"
    old = spark.createDataFrame([("1", "a", "x", "s0")], shape)
    both = merge.repositories_ensured(old, spark.createDataFrame([("9", "a", "x", "new"), ("2", "a", "y", None)], shape))
    marked = merge.bookmarked(both, spark.createDataFrame([("2", "s1")], "id string, head_sha string"))
    assert sorted(map(tuple, marked.collect())) == [("1", "a", "x", "s0"), ("2", "a", "y", "s1")]


def test_upserts_of_full_builds(spark):
    files = spark.createDataFrame([("r", "a.py", "h1", "s1", "s1")], "repository_id string, path string, content_hash string, first_seen_sha string, last_seen_sha string")
    seen = spark.createDataFrame([("r", "a.py", "h1", "s2", "s2"), ("r", "a.py", "h2", "s2", "s2")], files.schema)
    assert sorted(map(tuple, merge.files_recorded(files, seen).collect())) == [("r", "a.py", "h1", "s1", "s2"), ("r", "a.py", "h2", "s2", "s2")]


def test_versions_are_kept_as_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merge, "COMPACT", 2)
    keys = {"t": ("k",)}
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    gone = lambda *k: spark.createDataFrame([(x,) for x in k], "k string")
    merge.save_changes({"t": (gone(), rows(("a", 1), ("b", 1)))}, str(tmp_path), 1)
    merge.save_changes({"t": (gone("a"), rows(("a", 2)))}, str(tmp_path), 2)
    merge.save_whole(merge.open_since(spark, str(tmp_path), 0, 2, keys), str(tmp_path), 2)
    merge.save_changes({"t": (gone("b"), rows(("c", 3)))}, str(tmp_path), 3)
    opened = [sorted(map(tuple, merge.open_version(spark, str(tmp_path), v, keys)["t"].collect())) for v in (1, 2, 3)]
    assert opened == [[("a", 1), ("b", 1)], [("a", 2), ("b", 1)], [("a", 2), ("c", 3)]]


def test_index_job(spark, tmp_path):
    from lithograph import index_job

    (tmp_path / "tree/pkg").mkdir(parents=True)
    for path, text in {"pkg/a.py": "def foo():\n    return 1\n", "pkg/b.py": "from .a import foo\ndef bar():\n    return foo()\n"}.items():
        (tmp_path / "tree" / path).write_text(text)
    given = ["--path", f"{tmp_path}/tree", "--owner", "o", "--name", "n", "--github-id", "1", "--out", f"{tmp_path}/graph"]
    assert index_job.run(spark, index_job.arguments([*given, "--head-sha", "abcdef1"])) == {"files": 2, "symbols": 2, "symbol_calls": 1, "adrs": 0}
    for wrong in (["--depth", "0"], ["--head-sha", "xyz"], ["--with-embeddings"]):
        with pytest.raises(SystemExit):
            index_job.arguments([*given, *wrong])
