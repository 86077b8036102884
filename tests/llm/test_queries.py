"""The pN_ queries on the smallest tables."""

import os

import pytest

from lexigrid.llm.queries import QUERIES, SQL

from ..util import SMALL, duck, plain

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
COLUMNS = {
    "p1_found": ["field", "item_a", "item_b"], "p2_found": ["query_id", "field"], "p3_found": ["keep_id", "copy_id"], "p4_found": ["field", "term", "mark"],
    "p5_found": ["query_id"], "p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "kind", "found"],
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    assert plain(QUERIES[name](spark, SMALL).toPandas()) == plain(duck().execute(SQL[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    rows = df.collect()
    assert COLUMNS.get(name, df.columns) == df.columns
    if name != "p6_ids":
        assert len(rows) == len({str(r) for r in rows})
    if name == "p6_roundtrip":
        assert all(r["lost"] == 0 for r in rows)
