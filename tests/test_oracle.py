"""Every registered query with an SQL twin gives the same rows in both engines."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, sf_dir, con):
    r = compare(QUERIES[name](spark, sf_dir), con, SQL[name])
    assert r["ok"], r.get("detail")
    assert not r["types"], r["types"]
    assert r["rows"] > 0


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["slide", "cancer_code", "scale", "n_tiles"]
    assert df.count() > 0
