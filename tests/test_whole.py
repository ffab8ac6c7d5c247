"""Queries over neighbours ask for every row of their table."""

import pytest
from oracle import SF

from evalmill.plans import registry


@pytest.mark.parametrize("name", ["cosine_neighbours", "neighbour_exposure", "neighbour_labels", "neighbour_regression"])
def test_every_row_is_asked_for(spark, name):
    rows = registry.table(spark, SF, "embeddings").where("embedding is not null").select("vec_id").collect()
    asked = registry.queries()[name](spark, SF).select("query_id").distinct().collect()
    assert sorted(r[0] for r in asked) == sorted(r[0] for r in rows)


@pytest.mark.parametrize("name", ["shortcut_audit", "shortcut_metrics"])
def test_every_row_is_audited(spark, name):
    rows = registry.table(spark, SF, "embeddings").where("embedding is not null").count()
    assert {r.n_queries for r in registry.queries()[name](spark, SF).collect()} == {rows}
