"""p3 against brute force over reformatted bodies."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexigrid.llm import copies as copy
from lexigrid.llm.copies import copies, copy_classes, copy_counts, fields, fingerprint, form_of, same_fields

BASE = "SELECT a.x, SUM(b.y) AS total, CASE WHEN a.k > 3 THEN 'A, b' ELSE 'c' END AS f FROM dbo.t AS a JOIN u AS b ON a.id = b.id WHERE a.z <> 5 -- note\nORDER BY a.x"


def _vary(r, k):
    items = ["a.x", "SUM(b.y) AS total", "CASE WHEN a.k > 3 THEN 'A, b' ELSE 'c' END AS f"]
    r.shuffle(items)
    sep = r.choice([",", " ,\n", ", "])
    s = f"SELECT {sep.join(items)} FROM dbo.[t] AS a JOIN \"u\" AS b ON a.id=b.id WHERE (a.z<>5) -- note\nORDER BY a.x"
    s = r.choice([s, s.upper(), s.lower(), s.replace(" ", "  ", 3), "﻿" + s + ";\n"])
    return s


NEAR = [BASE.replace("<>", "<"), BASE.replace("'A, b'", "'A b'"), BASE.replace("note", "other"), BASE.replace("5", "6"), BASE.replace("ORDER BY a.x", "ORDER BY a.k"), BASE.replace("a.id = b.id", "b.id = a.id")]


def test_forms():
    r = random.Random(1)
    f = fingerprint(form_of(BASE))
    for k in range(60):
        v = form_of(_vary(r, k))
        assert fingerprint(v) == f and same_fields(v, form_of(BASE)), v
    assert all(fingerprint(form_of(x)) != f for x in NEAR)
    assert fields(None) is None and fields("") is None and fields("123 (;)") is None
    assert fields("SELECT DISTINCT TOP (10) b, a FROM t") == ("select distinct top 10 \x1d from t", ["b", "a"])
    assert form_of("SELECT a, a FROM t") != form_of("SELECT a FROM t") and not same_fields(form_of("SELECT a, a, b FROM t"), form_of("SELECT a, b, b FROM t"))


def test_equal_fingerprints_are_not_enough(spark, monkeypatch):
    """Bodies that only collide are classes of their own, in whole and in hot groups; a body without an equal one has none."""
    rows = [(k, f"a{k % 3}") for k in range(30)] + [(50, "single"), (60, "b"), (61, "B;")]
    df = spark.createDataFrame(rows, "id long, body string")
    want = {(k % 3, k) for k in range(3, 30)} | {(60, 61)}

    @F.pandas_udf("string")
    def collide(bodies):
        return bodies.map(lambda b: "same")

    @F.pandas_udf(copy.FORM)
    def formed(bodies):
        import pandas as pd

        return pd.DataFrame({"fp": ["same"] * len(bodies), "form": [form_of(b) for b in bodies]})

    monkeypatch.setattr(copy, "_fingerprints", collide)
    monkeypatch.setattr(copy, "_formed", formed)
    for hot in (1000, 7):
        monkeypatch.setattr(copy, "HOT", hot)
        assert {tuple(r) for r in copies(df).collect()} == want


@pytest.mark.parametrize("hot", [1000, 20])
def test_classes(spark, monkeypatch, hot):
    monkeypatch.setattr(copy, "HOT", hot)
    r = random.Random(2)
    rows = [(k, _vary(r, k)) for k in range(100, 160)] + [(k, x) for k, x in enumerate(NEAR)] + [(7, NEAR[0].upper()), (100, None), (50, ""), (51, "()"), (None, BASE)]
    rows += [(k, "same body") for k in range(1000, 1400)] + [(1000, "same body")] + [(2000, "x " * 20000), (2001, "X  " * 20000)]
    rows = [x for x in rows if x != (100, None)]
    want = defaultdict(set)
    for k, b in rows:
        if k is not None and (f := form_of(b)):
            want[tuple(sorted(f.partition("\x1e")[2].split("\x1f"))), f.partition("\x1e")[0]].add(k)
    pairs = {(min(x), c) for x in want.values() for c in x if c != min(x)}
    df = spark.createDataFrame(rows, "id long, body string").repartition(5)
    got = [tuple(x) for x in copies(df).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    assert {x["keep_id"]: x["copies"] for x in copy_counts(df).collect()} == {min(x): len(x) for x in want.values() if len(x) > 1}
    assert copy_classes(df.limit(0)).count() == 0
