"""The pN_ queries over the catalog tables, with the SQL of those that SQL can express."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.spread import spread
from ..sources.tables import table
from . import copies, garbled, leaks, pairs, personal, syntax, terms, tokens

TEXT_FIELDS = ["title", "description", "body"]


def _names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "query_objects").select("query_id", terms.plain_value(F.col("object_name")).alias("item"))


def _pairs(spark: SparkSession, d: str, lift: float, least: int = 5, share: float = 1 / 500) -> DataFrame:
    both = [("tag_id", table(spark, d, "query_tags").select("query_id", F.col("tag_id").cast("long").alias("item"))), ("object_name", _names(spark, d))]
    found = [pairs.item_pairs(df, "query_id", "item", least, share, lift).select(F.lit(f).alias("field"), "*") for f, df in both]
    return reduce(DataFrame.unionByName, found)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs in at least 5 queries and one in 500, at least three times as often as chance."""
    return _pairs(spark, d, 3).select("field", "item_a", "item_b")


def _lift(found: DataFrame) -> DataFrame:
    return found.select("field", "item_a", "item_b", "n_ab", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"), F.round("pmi", 6).alias("pmi"))


def p1_lift(spark: SparkSession, d: str) -> DataFrame:
    """All pairs with support, with counts, lift and pointwise mutual information."""
    return _lift(_pairs(spark, d, 0))


def p1_all_lift(spark: SparkSession, d: str) -> DataFrame:
    """The same for every pair in at least one query."""
    return _lift(_pairs(spark, d, 0, 1, 0))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.garbled_fields(table(spark, d, "queries"), "id", TEXT_FIELDS).select("query_id", "field")


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Each garbled field with its restored text and the wrong encodings, outermost first."""
    return garbled.garbled_fields(table(spark, d, "queries"), "id", TEXT_FIELDS)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies(table(spark, d, "queries"))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return copies.copy_counts(table(spark, d, "queries"))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    names = terms.value_counts(table(spark, d, "query_objects"), "query_id", terms.plain_value(F.col("object_name")))
    tags = table(spark, d, "tags").select("id", terms.plain_value(F.col("name")).alias("term"))
    used = table(spark, d, "query_tags").join(tags, F.col("tag_id") == F.col("id"))
    tagged = terms.value_counts(used, "query_id", F.col("term"), tags.select("term"))
    return names.select(F.lit("object_name").alias("field"), "*").unionByName(tagged.select(F.lit("name").alias("field"), "*"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d).where(F.col("mark").isNotNull()).select("field", "term", "mark")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every term with its occurrences, its number of queries and its mark."""
    return _counts(spark, d).select("field", "term", "n", "records", "mark")


def p4_title_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and queries of every n-gram of up to three title words."""
    one = table(spark, d, "queries").select("id", "title").distinct()
    words = F.filter(F.split(F.lower("title"), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    out = terms.ngram_counts(one.select("id", words.alias("words")), "id", "words", 3, unique=True)
    return out.select(F.array_join("gram", " ").alias("gram"), F.size("gram").alias("size"), "n", "records")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_files(table(spark, d, "queries"))


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_rates(table(spark, d, "queries"))


def p5_causes(spark: SparkSession, d: str) -> DataFrame:
    """Each invalid file with its cause and the language that it parses as, or else is meant as."""
    out = syntax.parsed_files(table(spark, d, "queries")).where(~F.col("valid"))
    return out.select(F.col("id").alias("query_id"), "dialect", "cause", "language").distinct()


def p5_grammars(spark: SparkSession, d: str) -> DataFrame:
    """Files per dialect and grammar that accepts them."""
    return syntax.grammar_counts(table(spark, d, "queries"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encoded(table(spark, d, "documents"))


def p6_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Documents, tokens and how many texts decoding doesn't give back (0), by source."""
    rows = spread(table(spark, d, "documents").select("source", "text")).select("source", "text", tokens.token_ids(F.col("text")).alias("ids"))
    lost = tokens.token_text(F.col("ids")) != F.coalesce("text", F.lit(""))
    return rows.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.size("ids")).alias("tokens"), F.sum(lost.cast("long")).alias("lost"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Each leaked test item with the number of documents that hold it."""
    return p7_found(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.personal_spans(table(spark, d, "documents"))


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every document with typed placeholders for its personal spans."""
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", personal.redacted(F.col("text")).alias("text"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_lift, p1_all_lift, p2_found, p2_repaired, p3_found, p3_counts, p4_found, p4_counts, p4_title_ngrams,
        p5_found, p5_rates, p5_causes, p5_grammars, p6_ids, p6_roundtrip, p7_found, p7_items, p8_found, p8_redacted,
    )
}

_PLAIN = r"nullif(regexp_replace(regexp_replace(lower({0}), '^[\s\x{{FEFF}}\p{{Z}}]+', ''), '[\s\x{{FEFF}}\p{{Z}}]+$', ''), '')"


def _pair_sql(lift: int) -> str:
    return f"""
WITH items AS (
  SELECT DISTINCT 'tag_id' AS field, query_id, CAST(CAST(tag_id AS BIGINT) AS VARCHAR) AS item FROM query_tags WHERE tag_id IS NOT NULL AND query_id IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'object_name', query_id, {_PLAIN.format("object_name")} FROM query_objects WHERE query_id IS NOT NULL AND {_PLAIN.format("object_name")} IS NOT NULL),
totals AS (SELECT field, count(DISTINCT query_id) AS n FROM items GROUP BY field),
singles AS (SELECT field, item, count(*) AS c FROM items GROUP BY field, item),
frequent AS (SELECT s.* FROM singles s JOIN totals t USING (field) WHERE s.c >= 5 AND 500 * s.c >= t.n),
kept AS (SELECT i.* FROM items i JOIN frequent USING (field, item)),
together AS (SELECT a.field, a.item AS item_a, b.item AS item_b, count(*) AS n_ab FROM kept a JOIN kept b ON a.field = b.field AND a.query_id = b.query_id AND a.item < b.item GROUP BY ALL)
SELECT p.field, p.item_a, p.item_b, p.n_ab, a.c AS n_a, b.c AS n_b, t.n
FROM together p JOIN totals t USING (field) JOIN singles a ON a.field = p.field AND a.item = p.item_a JOIN singles b ON b.field = p.field AND b.item = p.item_b
WHERE p.n_ab >= 5 AND 500 * p.n_ab >= t.n AND p.n_ab * t.n >= {lift} * a.c * b.c"""


_COUNTS = f"""
WITH spelled AS (
  SELECT 'object_name' AS field, query_id, {_PLAIN.format("object_name")} AS term FROM query_objects
  UNION ALL
  SELECT 'name', q.query_id, {_PLAIN.format("t.name")} FROM query_tags q JOIN tags t ON q.tag_id = t.id),
used AS (SELECT * FROM spelled WHERE term IS NOT NULL AND query_id IS NOT NULL),
totals AS (SELECT field, count(DISTINCT query_id) AS total FROM used GROUP BY field),
counts AS (SELECT field, term, count(*) AS n, count(DISTINCT query_id) AS records FROM used GROUP BY field, term),
everything AS (
  SELECT * FROM counts
  UNION ALL
  SELECT DISTINCT 'name', {_PLAIN.format("name")} AS term, 0, 0 FROM tags
  WHERE {_PLAIN.format("name")} IS NOT NULL AND {_PLAIN.format("name")} NOT IN (SELECT term FROM counts WHERE field = 'name'))
SELECT e.field, e.term, e.n, e.records, CASE WHEN e.records < 3 THEN 'rare' WHEN 20 * e.records > t.total THEN 'common' END AS mark
FROM everything e LEFT JOIN totals t USING (field)"""

_WORDS = r"list_filter(string_split_regex(lower(title), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
_NGRAMS = " UNION ALL ".join(
    f"SELECT id, array_to_string(w[p:p + {k - 1}], ' ') AS gram, {k} AS size FROM (SELECT id, w, unnest(range(1, len(w) + {2 - k})) AS p FROM words WHERE len(w) >= {k})" for k in (1, 2, 3)
)

SQL = {
    "p4_title_ngrams": f"WITH words AS (SELECT DISTINCT id, {_WORDS} AS w FROM queries), grams AS ({_NGRAMS}) SELECT gram, size, count(*) AS n, count(DISTINCT id) AS records FROM grams GROUP BY gram, size",
    "p1_found": f"SELECT field, item_a, item_b FROM ({_pair_sql(3)})",
    "p1_lift": f"SELECT field, item_a, item_b, n_ab, n_a, n_b, n, round(n_ab * n / (n_a * n_b), 6) AS lift, round(log2(n_ab * n / (n_a * n_b)), 6) AS pmi FROM ({_pair_sql(0)})",
    "p4_found": f"SELECT field, term, mark FROM ({_COUNTS}) WHERE mark IS NOT NULL",
    "p4_counts": _COUNTS,
}
