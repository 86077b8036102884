"""Scalar functions."""

from pyspark.sql import functions as F

from lexigrid.functions import text as t


def _one(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(expression(F.col("x"))).collect()]


def test_tokens(spark):
    texts = ["customer_id a.b", "Relatório RELATÓRIO", None, "", "Κινήσεις ß ﬁle x7", "éte"]
    want = [["customer", "id", "a", "b"], ["relatorio", "relatorio"], [], [], ["κινήσεισ", "ß", "ﬁle", "x7"], ["ete"]]
    assert _one(spark, texts, t.tokens) == want
    assert [[w for w, _, _ in t.fold_tokens(x)] for x in texts if x] == [w for w, x in zip(want, texts) if x]


def test_fold(spark):
    assert _one(spark, ["ÁGIL Abc", None], t.ascii_fold) == ["ÁgIL abc".replace("I", "i").replace("L", "l"), None]


def test_params_and_template(spark):
    assert _one(spark, ["{{b}} {{a}} {{b}} {x} {{é}}", None, ""], t.template_params) == [["b", "a", "é"], [], []]
    params = F.create_map(F.lit("a"), F.lit("{{b}}"), F.lit("b"), F.lit("2"))
    assert _one(spark, ["{{a}}-{{b}}-{{c}}", "", "x{{a}}"], lambda c: t.apply_template(c, params)) == ["{{b}}-2-{{c}}", "", "x{{b}}"]


def test_filename(spark):
    assert _one(spark, [" My Query! ", "Ação_x  y", "!!!", ""], t.safe_filename) == ["my_query", "ação_x_y", "query", "query"]


def test_relative_date(spark):
    days = ["2026-06-15", "2026-06-14T10:00:00", "2026-06-12", "2026-06-01", "2026-03-01", "2024-06-01", "15/06/2026", "", None, "2026-06-20"]
    assert _one(spark, days, lambda c: t.relative_date(c, F.lit("2026-06-15").cast("date"))) == ["today", "yesterday", "3d", "2w", "3mo", "2y", "", "", "", "-5d"]


def test_tags(spark):
    assert _one(spark, ["#A, b a ##c#", ""], t.input_tags) == [["a", "b", "c"], []]
    assert _one(spark, [" A, b,,A ", ""], t.template_tags) == [["a", "b", "a"], []]


def test_occurrences(spark):
    assert _one(spark, ["ab AB abc a.b", None], lambda c: t.word_occurrences(c, "ab")) == [2, None]
    assert _one(spark, ["xx ab"], lambda c: t.first_occurrence(c, "AB")) == [4]
    assert _one(spark, ["a.b axb"], lambda c: t.word_occurrences(c, "a.b")) == [1]
    assert _one(spark, ["a a"], lambda c: t.word_occurrences(c, "a")) == [0]


def test_lexical(spark):
    df = spark.createDataFrame([("SELECT 'from 1' -- where 2\n/* and\n3 */ FROM t WHERE x = 42",)], "x string")
    assert df.select(*[c.alias(k) for k, c in t.lexical_counts(F.col("x")).items()]).first().asDict() == {"keywords": 3, "strings": 1, "numbers": 1, "comments": 2}


def test_small(spark):
    assert _one(spark, ["v1.10.2", "1.x", None], t.version_key) == [[1, 10, 2], [0], [0]]
    df = spark.createDataFrame([(1, 3), (0, 0)], "a int, b int")
    assert [r[0] for r in df.select(t.percent(F.col("a"), F.col("b"))).collect()] == [33, None]
    assert _one(spark, ["a", "b", "c"], lambda c: t.translated(c, {"a": "A"}, {"a": "x", "b": "B"})) == ["A", "B", "c"]
