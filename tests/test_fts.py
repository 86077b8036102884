"""Full-text search against stock SQLite FTS5 on random searches."""

import random
import sqlite3

import pytest

from lexigrid.functions.text import fold_tokens
from lexigrid.operators import fts

WORDS = "kiln Relatório order_id naïve tenant kilnAudit ship RÜCK rest. Sum: a.b total x7 Ångström café ação".split()


def _corpus(n=120, seed=3):
    r = random.Random(seed)
    text = lambda k: "".join(r.choice(WORDS) + r.choice([" ", " ", ", ", ". ", "\n"]) for _ in range(r.randint(0, k)))
    return [(i, text(4), text(8), text(60), text(5)) for i in range(1, n + 1)]


@pytest.fixture(scope="module")
def both(spark):
    rows = _corpus()
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(title, description, body, objects, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO t(rowid, title, description, body, objects) VALUES (?, ?, ?, ?, ?)", rows)
    df = spark.createDataFrame([("p", *r) for r in rows], "project string, query_id long, title string, description string, body string, objects string").cache()
    return con, df, {r[0]: r[3] for r in rows}


def _expected(con, text):
    match = " ".join(f'"{t}"*' for t in text.split())
    return {r[0]: (r[1], r[2]) for r in con.execute("SELECT rowid, bm25(t), snippet(t, 2, '[', ']', '...', 20) FROM t WHERE t MATCH ?", (match,))}


@pytest.mark.parametrize("seed", range(6))
def test_match_rank_and_snippet(both, seed):
    con, df, bodies = both
    r = random.Random(seed)
    text = " ".join(r.choice(["kil", "relat", "order_i", "sum", "a.b", "CAFE", "ship rest", "x7", "ac", "naive tenant", "kilnaudit", "--"]) for _ in range(r.randint(1, 3)))
    want = _expected(con, text) if any(fold_tokens(t) for t in text.split()) else {}
    got = {x["query_id"]: x["rank"] for x in fts.score(df, text).collect()}
    assert set(got) == set(want)
    for k, rank in got.items():
        assert abs(rank - want[k][0]) < 1e-9
        assert fts.snippet_of(bodies[k], fts.phrases(text)) == want[k][1]


def test_snippets_many(both):
    con, _, bodies = both
    r = random.Random(11)
    n = 0
    for _ in range(150):
        text = " ".join(r.choice(["kil", "relat", "order_i", "sum", "a.b", "caf", "ship", "x7", "aca", "naive", "tenant", "rest"]) for _ in range(r.randint(1, 3)))
        for k, (_, snippet) in _expected(con, text).items():
            n += 1
            assert fts.snippet_of(bodies[k], fts.phrases(text)) == snippet, (text, bodies[k])
    assert n > 1000


def test_postings_agree(both):
    _, df, _ = both
    index, stats = fts.postings(df).cache(), fts.statistics(df).cache()
    for text in ("kil relat", "order_i", "a.b caf", "ship ship", "x7 x", "rest.rest.r", "zz kil", ""):
        a = {r["query_id"]: round(r["rank"], 9) for r in fts.score(df, text).collect()}
        b = {r["query_id"]: round(r["rank"], 9) for r in fts.score_postings(index, stats, text).collect()}
        assert a == b
        assert bool(a) == (text not in ("zz kil", "")) or text.startswith("rest.")


def test_projects_have_their_own_statistics(both):
    _, df, _ = both
    two = df.unionByName(df.where("query_id % 3 = 0").withColumn("project", fts.F.lit("q")))
    a = {(r["project"], r["query_id"]): round(r["rank"], 9) for r in fts.score(two, "kil caf").collect()}
    b = {(r["project"], r["query_id"]): round(r["rank"], 9) for r in fts.score_postings(fts.postings(two), fts.statistics(two), "kil caf").collect()}
    assert a == b and {p for p, _ in a} == {"p", "q"}


def test_empty_and_malformed(both):
    _, df, _ = both
    for text in ("--", 'ki"ln', ""):
        assert fts.score(df, text).count() == 0
    assert fts.score(df.limit(0), "kil").count() == 0


def test_null_columns(spark):
    df = spark.createDataFrame([("p", 1, None, None, "kiln", None)], "project string, query_id long, title string, description string, body string, objects string")
    assert fts.score(df, "kiln").count() == 1
