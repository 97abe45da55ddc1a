import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_queries_have_sql():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 40


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables")
@pytest.mark.parametrize("name", ["bm25_topk", "tokens_standard", "multiprobe_diagnostics", "reindex_resource", "evaluate_graded"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    cur = c.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    df = entry.queries()[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    norm = lambda r: tuple(round(float(v), 6) if isinstance(v, float) else v for v in r)
    assert sorted((norm(r) for r in df.select(*names).collect()), key=str) == sorted((norm(r) for r in cur.fetchall()), key=str)
