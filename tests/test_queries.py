"""Every registered core query against its SQL, over the smallest tables."""

from __future__ import annotations

import os

import pytest
from conftest import SMALL
from same import rows_of, rows_of_sql

from phraseloom.plans import core_queries

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(core_queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = core_queries.queries()[name](spark, SMALL)
    names, expected = rows_of_sql(duck, core_queries.oracle_sql()[name])
    assert sorted(df.columns) == names
    assert rows_of(df) == expected


@pytest.mark.parametrize("name", sorted(set(core_queries.queries()) - set(core_queries.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert core_queries.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_core_does_not_need_the_subpackage():
    """No module outside the subpackage names it, but for the entry file, which may do without."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "phraseloom")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                assert "phraseloom.llm" not in open(os.path.join(folder, f), encoding="utf-8").read()
