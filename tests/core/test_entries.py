import math
import os

import pytest

from vellichor import entries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
SLOW = {"hybrid_search", "lexical_search", "retrieval_benchmark"}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}") if math.isfinite(v) else str(v)
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(set(entries.queries()) - SLOW))
def test_query(spark, duck, name):
    df = entries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    if name not in entries.oracle_sql():
        return
    rel = duck.sql(entries.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    assert got == sorted((tuple(plain(r[k]) for k in at) for r in rel.fetchall()), key=repr)
