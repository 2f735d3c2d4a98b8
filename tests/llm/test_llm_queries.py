"""Every query of the subpackage on the smallest tables, with the columns asked for."""

import pytest

from foliospark.llm import queries

COLUMNS = {
    "p1_found": ["field_name", "result_a", "result_b"], "p2_found": ["result_id"], "p3_found": ["result_id"], "p4_found": ["field_name", "row_id", "kind", "pii_text"], "p5_found": ["result_id", "noise"],
    "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "subject"],
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, tiny, name):
    df = queries.QUERIES[name](spark, tiny)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    rows = df.collect()
    assert rows
    if name.endswith("_found"):
        assert len(set(map(tuple, rows))) == len(rows)
