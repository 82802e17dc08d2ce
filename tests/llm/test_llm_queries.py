"""Registered queries against their SQL over the smallest tables."""

from __future__ import annotations

import os

import pytest
from conftest import SMALL
from same import rows_of, rows_of_sql

from phraseloom.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = queries.queries()[name](spark, SMALL)
    names, expected = rows_of_sql(duck, queries.oracle_sql()[name])
    assert sorted(df.columns) == names
    assert rows_of(df) == expected


COLUMNS = {
    "p1_found": ["first_rec_id", "in_field", "best_rec_id"], "p2_found": ["first_line_no", "line_no"], "p3_found": ["in_field", "item"],
    "p4_found": ["in_field", "key_a", "key_b"], "p6_found": ["in_field", "term", "mark"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    df = queries.queries()[name](spark, SMALL)
    assert df.columns == COLUMNS.get(name, df.columns)
    assert df.count() > 0
