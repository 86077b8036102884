"""Extra columns whose names the operators use inside."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lexigrid.llm import copies, garbled, leaks, pairs, personal, syntax, terms, tokens

NAMES = "b i c n f fp form m salt cell field text2 record suffix gram t term s kind found valid cause language first last rep part class keep_id item_id rank items p rest _r repaired chain".split()


def _more(df: DataFrame, *but: str) -> DataFrame:
    return reduce(lambda d, c: d.withColumn(c, F.lit("x")), [c for c in NAMES if c not in but and c not in df.columns], df)


def test_tags(spark):
    df = spark.createDataFrame([(q, t) for q in range(8) for t in ("a", "b")], "query_id long, tag string")
    assert pairs.item_pairs(_more(df), "query_id", "tag", 5, 1 / 500).count() == 1
    assert pairs.item_pairs(_more(df), "query_id", "tag", 5).count() == 1
    assert terms.value_counts(_more(df), "query_id", F.col("tag")).count() == 2
    assert terms.ngram_counts(_more(df).withColumn("seq", F.array("tag", "tag")), "query_id", "seq", 2).count() == 4


def test_files(spark):
    df = spark.createDataFrame([(1, "SELECT 'Ã¡' FROM t"), (2, "select  'Ã¡' from T;"), (3, "SELECT")], "id long, body string").withColumn("dialect", F.lit("tsql")).withColumn("project", F.lit("p"))
    df = _more(df)
    assert [tuple(r) for r in copies.copies(df).collect()] == [(1, 2)]
    assert sorted(r["query_id"] for r in garbled.garbled_fields(df, "id", ["body"]).collect()) == [1, 2]
    assert [r[0] for r in syntax.invalid_files(df).collect()] == [3] and syntax.invalid_rates(df).first()["invalid"] == 1


def test_documents(spark):
    words = " ".join(f"w{k}" for k in range(15))
    df = _more(spark.createDataFrame([(1, f"call +44 7700 900463 {words}")], "doc_id long, text string"))
    items = _more(spark.createDataFrame([(9, words)], "item_id long, text string"))
    assert [tuple(r) for r in leaks.leaked(df, items).collect()] == [(1, 9)]
    assert personal.personal_spans(df).count() == 1 and tokens.encoded(df).columns == ["doc_id", "ids"]
