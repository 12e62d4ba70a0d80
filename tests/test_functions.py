import pytest
from pyspark.sql import functions as F

from lithograph.functions import changes, extraction, paths, text, vector
from lithograph.sources import tree


def one(spark, expression, **columns):
    shape = ", ".join(f"{n} {'string' if not isinstance(v, (int, list)) else 'int' if isinstance(v, int) else 'array<string>'}" for n, v in columns.items()) or "x int"
    return spark.createDataFrame([tuple(columns.values()) or (1,)], shape).select(expression.alias("v")).first().v


@pytest.mark.parametrize("body, found", [
    ("Fixes #123", ["#123"]), ("See ACME-99", ["ACME-99"]), ("see acme-42", []), ("12 and 13", []), ("", []), (None, []),
    ("fix #1 fixed #2 fixes: #3 closes-#4 closed #5 resolves #6 resolved #7", ["#1", "#2", "#3", "#4", "#5", "#6", "#7"]),
    ("close #5", []), ("fixes utf-8", ["utf-8"]), ("Fixes #1, fixes #1, ACME-1 fixes ACME-1", ["#1", "ACME-1"]), ("GRA-1によると", []),
])
def test_issue_refs(spark, body, found):
    assert [r.identifier for r in one(spark, text.issue_refs(F.col("b")), b=body)] == found


def test_adr(spark):
    record = "# Use things\n\nStatus: **Accepted** since May\n\n## Context\nx"
    assert one(spark, text.is_adr(F.col("t")), t=record) and not one(spark, text.is_adr(F.col("t")), t="Status: x") and not one(spark, text.is_adr(F.col("t")), t=None)
    assert one(spark, text.adr_status(F.col("t")), t=record) == "accepted"
    assert one(spark, text.adr_title(F.col("p"), F.col("t")), p="docs/adr/adr-001-x.md", t=record) == "Use things"
    assert one(spark, text.adr_title(F.col("p"), F.col("t")), p="docs/adr/adr-001-x.md", t="Status: a") == "adr 001 x"


def test_small_texts(spark):
    assert one(spark, text.first_line(F.col("t")), t="\n \n  a b \nc") == "a b"
    assert one(spark, text.first_line(F.col("t")), t=" \n") is None
    assert one(spark, text.symbol_embed_text(F.col("k"), F.col("s"), F.col("q")), k="function", s="", q="m.f") == "function m.f"
    assert one(spark, text.diff_lines(F.col("p")), p="--- a\n+++ b\n@@\n+x\n-y\n z") == 2
    assert one(spark, text.bullets(F.col("l")), l=["a", "b"]) == "- a\n- b" and one(spark, text.bullets(F.col("l")), l=[]) == "(none)"
    assert one(spark, text.summary_text(F.lit(1), F.lit(2), F.lit(0))) == "flagged 1 blocking, 2 warning."
    assert one(spark, text.fallback_narrative(F.lit(0), F.lit(0), F.lit(0), F.lit(2), F.lit(0))) == "Packet assembled: 2 linked issue(s)."
    assert one(spark, text.language_by_extension(F.col("p")), p="a/b.py") == "python" and one(spark, text.language_by_extension(F.col("p")), p="a.go") is None


@pytest.mark.parametrize("kind, module, symbol, alias, target, name", [
    ("from", "m", "s", None, "s", "s"), ("from", "m", "s", "a", "a", "s"), ("from", "m", "s", None, "s.run", "run"), ("import", "a.b", None, None, "b.f", "f"), ("import", "a.b", None, "x", "x.f.g", "f.g"), ("import", "a.b", None, None, "a.f", None),
])
def test_imported_name(spark, kind, module, symbol, alias, target, name):
    columns = dict(k=kind, m=module, s=symbol, a=alias, t=target)
    assert one(spark, text.imported_name(*[F.col(c) for c in "kmsat"]), **columns) == name


@pytest.mark.parametrize("pattern, path, matches", [
    ("*.py", "a/b/c.py", True), ("*.py", "c.pyc", False), ("/src/*.py", "src/a.py", True), ("/src/*.py", "src/b/a.py", False), ("src/", "src/x/y.py", True), ("docs/", "a/docs/x", False),
    ("src/**", "src/a/b", True), ("**/test", "a/b/test", True), ("foo.py", "barfoo.py", True), ("a?.md", "ab.md", True), ("a+b", "a+b", True),
])
def test_owner_globs(spark, pattern, path, matches):
    assert one(spark, F.rlike(F.col("p"), paths.glob_regex(F.col("g"))), g=pattern, p=path) is matches


def test_owner_rules(spark):
    content = "# comment\n\n*.py @ada\nsrc/ @org/team mail@x.y\nnobody\nonly mail@x.y\n/src/a.py @ben @cleo\n"
    rules = paths.owner_rules(spark.createDataFrame([("r", content), ("s", None)], "repository_id string, content string"))
    asked = spark.createDataFrame([("r", "x.py"), ("r", "src/b.py"), ("r", "src/a.py"), ("r", "readme")], "repository_id string, path string")
    assert {r.path: r.owners for r in paths.owners_of(asked, rules).collect()} == {"x.py": ["ada"], "src/b.py": ["org/team"], "src/a.py": ["ben", "cleo"]}


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], ["a"], None)], "a array<float>, b array<float>, x array<string>, y array<string>")
    row = df.select(vector.cosine(F.col("a"), F.col("b")).alias("c"), vector.jaccard(F.col("x"), F.col("y")).alias("j"), vector.jaccard(F.col("y"), F.col("y")).alias("z")).first()
    assert row.c == pytest.approx(2**-0.5) and row.j == 0 and row.z == 0


SOURCE = '''
"""Doc."""
import os.path as p, sys
from .a import foo as f, bar
from b import *

LIMIT: int = 3
lower = 1

@deco(LIMIT)
async def top(a, b: int = (1), *, c=None) -> dict[str,
                                             int]:
    """Doc."""
    f(bar.baz(1))
    getattr(a, "b")()
    def inner():
        hidden()

class C(Base):
    X = 1
    def m(self): return self.n() # note
if True:
    def skipped(): pass
'''


def test_extraction(spark):
    df = spark.createDataFrame([("a", SOURCE), ("b", "def ("), ("c", None), ("d", "")], "path string, content string")
    rows = {r.path: r for r in extraction.extracted(df).collect()}
    found = rows["a"]
    assert [(s.qualified_name, s.kind) for s in found.symbols] == [("LIMIT", "constant"), ("top", "function"), ("C", "class"), ("C.X", "constant"), ("C.m", "method")]
    top = found.symbols[1]
    assert top.signature.startswith("top(a, b: int = (1), *, c=None) -> dict[str,") and top.signature.endswith("int]") and top.start_line == 11
    assert [(i.module, i.symbol, i.alias, i.kind) for i in found.imports] == [("os.path", None, "p", "import"), ("sys", None, None, "import"), (".a", "foo", "f", "from"), (".a", "bar", None, "from"), ("b", "*", None, "from")]
    assert [(c.caller_qualified_name, c.target_name, c.kind) for c in found.calls] == [("top", "f", "direct"), ("top", "bar.baz", "method"), ("top", 'getattr(a, "b")', "dynamic"), ("top", "getattr", "direct"), ("C.m", "self.n", "method")]
    assert not rows["b"].parsed and rows["b"].symbols == [] and not rows["c"].parsed and rows["d"].parsed


def test_hash_is_of_structure():
    import ast

    one = lambda s: extraction.ast_hash(ast.parse(s).body[0])
    base = one("def f(a):\n    return a + 1")
    assert base == one('def f( a ):  # c\n    "doc"\n    return (a + 1)')
    assert base != one("def g(a):\n    return a + 1") and base != one("def f(a):\n    return a + 2")


@pytest.mark.parametrize("before, after, label", [
    (None, "def f(): pass", "added"), ("def f(): pass", None, "deleted"), ("def f(a): pass", "def f(a, b=1): pass", "signature_change"), ("def f() -> int: pass", "def f() -> str: pass", "return_type_change"),
    ("def f(): pass", "def f(): raise x.Y('a')", "exception_change"), ("def f(): return 1", "def f(): return 2", "body_only"), ("def f():\n  'a'\n  return 1", "def f():\n  'b'\n  return 1", "unchanged"),
    ("def f(): pass", "class f: pass", "signature_change"), ("class C: a = 1", "class C: a = 2", "body_only"),
])
def test_change_labels(before, after, label):
    assert changes.classify(before, after)["classification"] == label


def test_change_details(spark):
    found = changes.classify("def f(a: int = 1, /, *, b) -> T: raise", "async def f(a=2): raise E")
    assert found["before_signature"] == "def f(a: int = 1, /, *, b) -> T" and found["after_signature"] == "async def f(a = 2)"
    assert found["added_exceptions"] == ["E"] and found["all_changes"][:2] == ["signature_change", "return_type_change"]
    df = spark.createDataFrame([("def f(): pass", "x = 1"), (None, None)], "a string, b string").select(changes.change(F.col("a"), F.col("b")).alias("c"))
    assert all(r.c.classification is None and r.c.error for r in df.collect())


def test_status_drift(spark):
    typed, status = "from .exceptions import E\ndef ok() -> int: ...", "def pay() -> tuple[bool, str]: ...\ndef _p() -> tuple[bool, str]: ...\ndef n() -> tuple[int, list[str]]: ...\ndef x() -> tuple[str, int]: ..."
    rows = [("k", "src/billing/a.py", typed, False), ("k", "src/billing/b.py", status, True), ("u", "src/billing/a.py", typed, False), ("u", "src/billing/b.py", status, True), ("u", "src/billing/c.py", "def old() -> tuple[bool, str]: ...", False), ("w", "src/billing/b.py", status, True), ("k", "lib/a.py", status, True)]
    found = changes.status_return_drift(spark.createDataFrame(rows, "key string, path string, content string, changed boolean"), "src/billing/")
    assert sorted((r.key, r.function_name) for r in found.collect()) == [("k", "n"), ("k", "pay")]


def test_diff_changes(spark):
    text_ = "M\0a.py\0R100\0old.py\0new.py\0A\0b.py\0D\0c.py\0T\0d.py\0C75\0e.py\0f.py\0"
    found = tree.diff_changes(spark.createDataFrame([("r", text_), ("s", ""), ("t", None)], "repository_id string, diff string"))
    assert [(r.path, r.kind) for r in found.collect()] == [("a.py", "M"), ("old.py", "D"), ("new.py", "A"), ("b.py", "A"), ("c.py", "D"), ("d.py", "M"), ("f.py", "A")]


def test_tree_scan(spark, tmp_path):
    for name, content in {"b.py": b"x = 1", "a/z.py": b"#", "a/b/c.py": b"y", "venv/v.py": b"", "bad.py": b"\xff\xfe", "docs/adr/one.md": b"# T\nStatus: Accepted\n## Decision\n", "docs/adr/no.md": b"x", "CODEOWNERS": b"* @a", "docs/CODEOWNERS": b"* @b"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    assert [r.path for r in tree.source_files(spark, str(tmp_path)).orderBy("file_order").collect()] == ["a/b/c.py", "a/z.py", "b.py"]
    assert [(r.path, r.title, r.status) for r in tree.adr_files(spark, str(tmp_path)).collect()] == [("docs/adr/one.md", "T", "accepted")]
    owners = spark.createDataFrame([("r", "CODEOWNERS", "* @a"), ("r", "docs/CODEOWNERS", "* @b")], "repository_id string, path string, content string")
    assert tree.owner_file(owners).first().content == "* @b"


def test_snippets_and_modules(spark):
    callers = spark.createDataFrame([("r", "a.py", 2, 3, "f(x)"), ("r", "b.py", 1, 1, "g()"), ("r", "a.py", 9, 9, None)], "repository_id string, path string, start_line int, end_line int, signature string")
    sources = spark.createDataFrame([("r", "a.py", "1\n2\n3\n4")], "repository_id string, path string, content string")
    assert sorted(r.snippet for r in tree.caller_snippets(callers, sources).collect()) == ["\n    ...", "2\n3", "g()\n    ..."]
    files = spark.createDataFrame([("src/a/x.py",), ("src/ab/x.py",), ("src/a/../../etc.py",), ("src/a/y.txt",)], "path string")
    assert [r.path for r in tree.module_files(files, "src/a").collect()] == ["src/a/x.py"]


def test_change_table(spark):
    from lithograph.schemas import TABLES, checked_vector, conform

    for table in TABLES:
        assert conform(spark.range(1), table).count() == 1
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],), (None,)], "v array<float>")
    assert [r.v for r in checked_vector(df, "v", 2).collect()] == [[1.0, 2.0], None, None]


def test_every_version_is_extracted(spark):
    from lithograph.functions import queries

    text = "import os\n\n\ndef f{0}():\n    g{0}()\n"
    g = {
        "files": spark.createDataFrame([("v1", "r", "a.py"), ("v2", "r", "a.py"), ("v2", "r", "a.py")], "id string, repository_id string, path string"),
        "source_texts": spark.createDataFrame([("v1", text.format(1)), ("v2", text.format(2)), ("v2", text.format(2)), ("v3", text.format(3)), ("v4", None)], "file_id string, content string"),
    }
    where = [("v1", "a.py"), ("v2", "a.py"), ("v3", None)]
    rows = {name: sorted((r.file_id, r.path, r[3:]) for r in queries._PLANS[name](g).collect()) for name in ("x1_symbols", "x3_imports", "x4_calls")}
    assert all([r[:2] for r in found] == where for found in rows.values())
    assert [r[2][0] for r in rows["x1_symbols"]] == ["f1", "f2", "f3"] and [r[2][1] for r in rows["x4_calls"]] == ["g1", "g2", "g3"]
