"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import difference
from tests.conftest import DATA

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    assert difference(spark, duck, name, QUERIES[name], ORACLES[name], DATA) is None


def test_every_query_but_the_approximate_ones_has_sql():
    corpus = {name for name in QUERIES if name == "pipeline" or name.startswith("op")}
    assert set(QUERIES) - set(ORACLES) - corpus == {"vector_topk_ann", "vector_ann_recall"}


def test_entry_gives_recall(spark):
    rows = {r["k"]: r for r in entry.entry(spark).collect()}
    assert set(rows) == {5, 10} and rows[10]["n_queries"] > 0
