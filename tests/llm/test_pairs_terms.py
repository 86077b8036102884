"""p1 and p4 against brute force, with edge cases and skew."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lexigrid.llm import pairs
from lexigrid.llm.pairs import item_pairs
from lexigrid.llm.terms import ngram_counts, plain_value, value_counts


def _brute(rows, least, share, lift):
    baskets = defaultdict(set)
    for b, i in rows:
        if b is not None and i is not None:
            baskets[b].add(str(i))
    n = len(baskets)
    one, two = Counter(), Counter()
    for items in baskets.values():
        one.update(items)
        two.update(combinations(sorted(items), 2))
    return {(a, b, k, one[a], one[b], n) for (a, b), k in two.items() if k >= least and k >= share * n and k * n >= lift * one[a] * one[b]}


def _got(df):
    return {(r["item_a"], r["item_b"], r["n_ab"], r["n_a"], r["n_b"], r["n"]) for r in df.collect()}


def test_pairs(spark):
    r = random.Random(1)
    rows = [(r.randint(1, 60), r.choice(["a", "b", "c", "d", "é", "z z", None] + [f"t{k}" for k in range(30)])) for _ in range(900)]
    rows += [(None, "a"), (999, "only"), (7, "a"), (7, "a")] + [(1000, f"t{k}") for k in range(30)]
    df = spark.createDataFrame(rows, "q long, i string")
    for least, share, lift in ((5, 1 / 500, 0), (2, 0.1, 1), (3, 0.0, 1.5), (5, 1 / 500, 3)):
        assert _got(item_pairs(df, "q", "i", least, share, lift)) == _brute(rows, least, share, lift)
    x = item_pairs(df, "q", "i", 2).first()
    assert abs(x["lift"] - x["n_ab"] * x["n"] / (x["n_a"] * x["n_b"])) < 1e-12


@pytest.mark.parametrize("small", [0, 64 << 20])
def test_long_baskets_are_cut(spark, monkeypatch, small):
    """Baskets around and far beyond a chunk, with and without a broadcast, against brute force."""
    monkeypatch.setattr(pairs, "CHUNK", 4)
    monkeypatch.setattr(pairs, "SMALL", small)
    r = random.Random(3)
    rows = [(b, f"t{r.randint(0, 25)}") for b, n in enumerate([1, 2, 3, 4, 5, 7, 8, 9, 12, 13, 20, 40, 40, 200]) for _ in range(n)]
    df = spark.createDataFrame(rows, "q long, i string")
    for least, share in ((1, 0.0), (2, 0.01)):
        assert _got(item_pairs(df, "q", "i", least, share, 0)) == _brute(rows, least, share, 0)


def test_one_basket_holds_a_third(spark):
    rows = [(0, f"t{k % 40}") for k in range(3000)] + [(1 + k // 3, f"t{(k * 7) % 40}") for k in range(6000)]
    df = spark.createDataFrame(rows, "q long, i string")
    assert _got(item_pairs(df, "q", "i", 5, 1 / 500, 0)) == _brute(rows, 5, 1 / 500, 0)


def test_no_pairs(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "q long, i string")
    assert item_pairs(df, "q", "i", 1).count() == 0 and item_pairs(df.limit(0), "q", "i").count() == 0


def _grams(rows, sigma):
    n, records = Counter(), defaultdict(set)
    for rec, seq in rows:
        seq = [t for t in seq or [] if t is not None]
        if rec is None:
            continue
        for p in range(len(seq)):
            for k in range(1, min(sigma, len(seq) - p) + 1):
                g = tuple(seq[p : p + k])
                n[g] += 1
                records[g].add(rec)
    return {(g, c, len(records[g])) for g, c in n.items()}


def test_ngrams(spark):
    r = random.Random(2)
    rows = [(r.choice([1, 1, 1] + list(range(20))), [r.choice("aaabcdé") for _ in range(r.randint(0, 12))]) for _ in range(150)] + [(3, None), (None, ["a"]), (4, [None, "a"])]
    df = spark.createDataFrame(rows, "r long, t array<string>")
    for sigma in (1, 2, 3, 5):
        got = {(tuple(x["gram"]), x["n"], x["records"]) for x in ngram_counts(df, "r", "t", sigma).collect()}
        assert got == _grams(rows, sigma)
        own = [(k, seq) for k, (_, seq) in enumerate(rows)]
        each = spark.createDataFrame(own, "r long, t array<string>")
        assert {(tuple(x["gram"]), x["n"], x["records"]) for x in ngram_counts(each, "r", "t", sigma, unique=True).collect()} == _grams(own, sigma)
    assert ngram_counts(df.limit(0), "r", "t", 2).count() == 0


def test_values(spark):
    rows = [(k % 50, "Hot ") for k in range(300)] + [(1, "rare"), (2, " RARE　"), (3, None), (4, "  "), (None, "x"), (9, "mid"), (10, "mid"), (11, "mid")]
    df = spark.createDataFrame(rows, "q long, v string")
    vocabulary = spark.createDataFrame([("unused",), ("mid",)], "term string")
    got = {r["term"]: (r["n"], r["records"], r["mark"]) for r in value_counts(df, "q", plain_value(F.col("v")), vocabulary).collect()}
    assert got == {"hot": (300, 50, "common"), "rare": (2, 2, "rare"), "mid": (3, 3, "common"), "unused": (0, 0, "rare")}


def test_blanks(spark):
    df = spark.createDataFrame([(" \tÁb c﻿ ",), ("",), ("　",), (None,)], "v string")
    assert [r[0] for r in df.select(plain_value(F.col("v"))).collect()] == ["áb c", None, None, None]
