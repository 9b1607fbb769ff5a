"""Every registered query of the library itself: against SQL where there is SQL, else that it gives rows of a stable schema."""

import pytest

from rasterloom.plans.queries import QUERIES, SQL
from tests.conftest import same_rows


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(name, spark, duck, sf_dir):
    same_rows(QUERIES[name](spark, sf_dir), duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(name, spark, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns and df.limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_triangles_take_thirty_stars(spark, sf_dir):
    assert QUERIES["j06_triangles"](spark, sf_dir).agg({"v0": "max", "v1": "max", "v2": "max"}).selectExpr("greatest(`max(v0)`, `max(v1)`, `max(v2)`)").first()[0] == 30
