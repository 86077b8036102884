"""Every query of the catalog against its SQL on the smallest tables."""

import os

import pytest

from lexigrid.plans.queries import QUERIES, SQL

from .util import SMALL, duck, plain

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), con.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_stored_postings_rank_as_the_scan(spark):
    assert plain(QUERIES["t3_postings"](spark, SMALL).toPandas()) == plain(QUERIES["t3_bm25"](spark, SMALL).toPandas())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns[:3] == ["query_id", "rel_path", "title"]
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
