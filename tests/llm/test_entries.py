import os

import pytest

from vellichor.llm import entries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["field_name", "term_value", "mark"], "p2_found": ["table_name", "row_key", "noise"], "p3_found": ["seq", "shape"], "p4_found": ["table_name", "row_key"],
    "p5_found": ["seq"], "p6_found": ["doc_id", "item_id"], "p8_found": ["doc_id"],
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(entries.queries()))
def test_query_runs(spark, name):
    df = entries.queries()[name](spark, SF)
    assert name not in COLUMNS or df.columns == COLUMNS[name]
    assert df.count() >= 0


def test_sql_has_queries():
    assert set(entries.oracle_sql()) <= set(entries.queries())
