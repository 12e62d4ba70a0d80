import os

import __spark_entry__ as entry
import pytest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", ["q06_reviewers_of_file", "q17_call_graph_overlap", "c10_reviewers", "p1_found", "p6_found"])
def test_queries_equal_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(DATA):
        path = f"{DATA}/{file}" + ("/*.parquet" if os.path.isdir(f"{DATA}/{file}") else "")
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    df = entry.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    clean = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted(str([clean(r[c]) for c in columns]) for r in df.collect()) == sorted(str([clean(v) for v in r]) for r in cursor.fetchall())
