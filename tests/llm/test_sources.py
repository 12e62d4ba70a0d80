import pytest

from lithograph.llm import sources

CODE = "import os\nfrom x import y\n\n\ndef load(path, retries=3):\n    for n in range(retries):\n        with open(path) as f:\n            if f.read():\n                return n\n    raise ValueError('nothing there')\n\n\nclass Loader:\n    limit = 3\n\n    def run(self):\n        return load(self.path)\n"
MINIFIED = ";".join(f"var a{i}=b.c(d,{i});if(!a{i}){{return e}}" for i in range(60))
CASES = [
    ("src/a/load.py", "python", CODE, "hand_written"),
    ("src/a/writer.py", "python", CODE + '\nHEADER = "Code generated by tool. DO NOT EDIT."\n', "hand_written"),
    ("src/a/generated_reports.py", "Python", CODE, "hand_written"),
    ("src/a/doc.py", "python", '"""Writes files marked: do not edit."""\n' + CODE, "hand_written"),
    ("src/a/load.py", "python", "# Copyright us.\n#\n# Code generated by tool v1; DO NOT EDIT.\n" + CODE, "generated"),
    ("src/a/load_pb2.py", "python", CODE, "generated"),
    ("src/gen/load.py", None, CODE, "generated"),
    ("src/a/load.py", "python", "# Diese Datei wurde maschinell erzeugt, bitte nicht von Hand ändern.\n" + CODE, "generated"),
    ("src/a/table.py", "python", "t = {\n" + "".join(f"    ({i}, {i + 7}): ('shift', {i * 3}),\n" for i in range(40)) + "}\n", "generated"),
    ("web/node_modules/x/load.js", "javascript", CODE, "vendored"),
    ("src/a/load.py", "python", "# Vendored copy of thing 1.2; upstream fixes go to the thing project.\n" + CODE, "vendored"),
    ("src/a/app.js", "javascript", MINIFIED, "minified"),
    ("src/a/app.min.js", None, "", "minified"),
    ("src/a/weights.py", "text", "w = [\n" + ", ".join(f"{i / 7:.5f}" for i in range(200)).replace(", 1", ",\n 1") + "]\n", "data"),
    ("src/a/blob.ts", "typescript", "b = (\n" + "".join(f"  'Ab9{i:02d}" + "xY7+/q" * 11 + "'\n" for i in range(10)) + ")\n", "data"),
    ("src/a/none.py", "python", None, "hand_written"),
    ("src/a/empty.py", "python", "", "hand_written"),
    (None, None, CODE, "hand_written"),
    (None, None, None, "hand_written"),
]


@pytest.fixture(scope="module")
def judged(spark):
    df = spark.createDataFrame([(i, *c[:3], "clash") for i, c in enumerate(CASES)] + [(100 + i, f"src/{i}.py", "python", CODE, "clash") for i in range(20)], "id int, path string, language string, content string, max_line string")
    return {r.id: r for r in sources.classified(df.drop("max_line")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_origin(judged, i):
    assert judged[i].origin == CASES[i][3], CASES[i][:2]


def test_very_long_text_and_empty_table(spark):
    df = spark.createDataFrame([("a.py", "python", "x = 1\n" * 200_000), ("b.py", "python", "y" * 300_000)], "path string, language string, content string")
    assert sources.classified(df).count() == 2 and sources.classified(df.limit(0)).count() == 0


SIGN = "Code generated by tool v1; DO NOT EDIT.\n"
LICENCE = "".join("as is " * (1 + i % 3) + "licence\n" for i in range(90))
HEADS = [
    ("a.py", "".join(f"# {x}\n" for x in (LICENCE + SIGN).splitlines()) + CODE, "generated"),
    ("a.js", "/*\n" + LICENCE + "\n" + SIGN + "*/\n" + CODE, "generated"),
    ("a.html", "<!--\n" + LICENCE + "a -- b\n" + SIGN + "-->\n" + CODE, "generated"),
    ("a.c", "/* one */ /* two\n" + SIGN + "*/\n" + CODE, "generated"),
    ("a.css", "/*\n" + LICENCE + "*/\n/*\nVendored copy of thing 1.2\n*/\n" + CODE, "vendored"),
    ("a.js", "/*\n" + LICENCE + "*/\n" + CODE + "/* " + SIGN + "*/\n", "hand_written"),
    ("a.html", "<!-- one -->\n" + CODE + "<!--\n" + SIGN + "-->\n", "hand_written"),
    ("a.js", "/*\n" + "x * y\nx y z\n" * 50_000 + SIGN + "*/\n" + CODE, "generated"),
    ("a.py", "# x\n# x y\n" * 50_000 + "# " + SIGN + CODE, "generated"),
]


def test_whole_leading_comment(spark):
    df = spark.createDataFrame([(i, *h[:2], "") for i, h in enumerate(HEADS)] + [(100 + i, f"{i}.{e}", CODE, "") for i in range(20) for e in ("js", "html", "c", "css", "py")], "id int, path string, content string, language string")
    got = {r.id: r.origin for r in sources.classified(df).collect()}
    assert [got[i] for i in range(len(HEADS))] == [h[2] for h in HEADS]


def test_language(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a.PY", None), ("b", "JavaScript"), ("c.unknown", "klingon"), (None, None)], "p string, l string")
    assert [r[0] for r in df.select(sources.language_of(F.col("p"), F.col("l"))).collect()] == ["python", "javascript", "other", "other"]


def test_short_files_are_judged_by_what_they_surely_show(spark):
    texts = ["a = [" + ",".join(str(1000 + i) for i in range(24)) + "]\n", "PORT = 8080\n", "v" + "a1B2" * 20 + "\n", "x = 1\n", "for a, b in c:\n    d(a)\n"]
    df = spark.createDataFrame([(i, f"s/{i}.py", "python", t) for i, t in enumerate(texts)] + [(100 + i, f"src/{i}.py", "python", CODE) for i in range(20)], "id int, path string, language string, content string")
    got = {r.id: (r.origin, r.evidence) for r in sources.classified(df).collect()}
    assert [got[i] for i in range(5)] == [("data", "layout"), ("hand_written", None), ("data", "layout"), ("hand_written", None), ("hand_written", None)]


def test_runs_are_read_whole(spark):
    run = "A" * 400 + "b7" + "C" * 300
    df = spark.createDataFrame([("s/a.py", "python", f'x = "{run}"\n'), ("s/b.py", "python", "y" * 300_000)], "path string, language string, content string")
    shares = {r.path: r.encoded_share for r in sources.classified(df).collect()}
    assert shares["s/a.py"] > 0.9 and shares["s/b.py"] == 0
