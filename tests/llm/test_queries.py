"""Every query of the subpackage runs over whole tables with the fixed columns."""

from __future__ import annotations

import pytest

from loomwork.llm.queries import QUERIES

COLUMNS = {
    "p1_found": ["file_id"], "p2_found": ["file_id", "label"], "p3_found": ["task_no", "unit_key"], "p4_found": ["kind", "key_a", "key_b"],
    "p5_found": ["name_a", "name_b"], "p6_found": ["doc_id"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "lang"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len({tuple(r) for r in rows}) == len(rows) > 0


def _sql():
    from loomwork.llm.queries import SQL

    return SQL


@pytest.mark.parametrize("name", sorted(_sql()))
def test_same_rows_as_sql(spark, name):
    from differential import compare

    assert compare(spark, name, QUERIES[name], _sql()[name]) > 0
