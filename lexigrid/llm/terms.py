"""p4: frequency of every distinct value or term.

Suffix-sorted n-gram counting.  A record is a sequence of terms; each position
emits the suffix that starts there, cut to ``sigma`` terms.  Suffixes are routed
by their first term, sorted in reverse lexicographic order, and one pass with a
stack emits the count and the number of records of every prefix, i.e. of every
n-gram.

Records are counted without sets: the suffixes of a record are sorted first, and
a suffix knows how many terms it shares with the one before it.  All its longer
prefixes are new to the record, so the records of an n-gram are the sum of these
marks.  Marks and occurrences add up, so equal suffixes are combined before they
are routed, and a hot first term is spread by its second.

Defined results: null and empty sequences and null terms emit nothing; a term
repeated in a record counts every time as occurrence and once as record.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

GRAMS = T.StructType([T.StructField("gram", T.ArrayType(T.StringType())), T.StructField("n", T.LongType()), T.StructField("records", T.LongType())])
# Blanks of any kind, and the byte order mark.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
# Fixed value: parts of a hot first term.
SPREAD = 32


def plain_value(c: Column) -> Column:
    """The value in lower case without blanks around it; null where nothing is left."""
    return F.nullif(F.lower(F.btrim(c.cast("string"), F.lit(BLANKS))), F.lit(""))


def _stacked(sigma: int):
    """Counts of all prefixes of suffixes that come in order; the only state is the stack of the current suffix."""

    def run(batches):
        import pandas as pd

        path: list[str] = []
        counts: list[int] = []
        records: list[int] = []
        out: list[tuple] = []

        def close(depth: int) -> None:
            while len(path) > depth:
                out.append((list(path), counts[-1], records.pop()))
                path.pop()
                n = counts.pop()
                if counts:
                    counts[-1] += n

        for b in batches:
            for s, n, new in zip(b["suffix"], b["n"].tolist(), b["new"]):
                same, most = 0, min(len(path), len(s))
                while same < most and path[same] == s[same]:
                    same += 1
                close(same)
                for t in s[same:]:
                    path.append(t)
                    counts.append(0)
                    records.append(0)
                counts[-1] += n
                for k in range(len(path)):
                    records[k] += int(new[k])
            yield pd.DataFrame(out, columns=GRAMS.names).astype({"n": "int64", "records": "int64"})
            out.clear()
        close(0)
        yield pd.DataFrame(out, columns=GRAMS.names).astype({"n": "int64", "records": "int64"})

    return run


def _marked(seq: DataFrame, sigma: int) -> DataFrame:
    """record, suffix, shared: each suffix of a record and how many first terms it shares with the one before it in order."""
    starts = F.sequence(F.lit(1), F.size("terms"))
    suffixes = seq.where(F.size("terms") > 0).select("record", F.array_sort(F.transform(starts, lambda p: F.slice("terms", p, F.lit(sigma)))).alias("s"))

    def shared(x: Column, i: Column) -> Column:
        before = F.get(F.col("s"), i - 1)
        differs = [(F.get(before, F.lit(k)) != F.get(x, F.lit(k))) | F.get(before, F.lit(k)).isNull() | F.get(x, F.lit(k)).isNull() for k in range(sigma)]
        steps = reduce(lambda c, k: c.when(differs[k], k), range(1, sigma), F.when((i == 0) | differs[0], 0))
        return F.struct(x.alias("suffix"), steps.otherwise(sigma).alias("shared"))

    return suffixes.select("record", F.explode(F.transform("s", shared)).alias("x")).select("record", "x.*")


def ngram_counts(df: DataFrame, record: str, terms: str, sigma: int = 1, unique: bool = False) -> DataFrame:
    """gram (array), n occurrences and records for every n-gram of up to sigma terms; no count is cut off.

    With ``unique`` each row of df is a record of its own, and nothing but combined
    suffixes is shuffled.  Otherwise a record may have several rows, and its
    n-grams are met by (n-gram, record) for the number of records.
    """
    seq = df.where(F.col(record).isNotNull()).select(F.col(record).alias("record"), F.filter(F.col(terms).cast("array<string>"), lambda t: t.isNotNull()).alias("terms"))
    marked = _marked(seq, sigma)
    new = F.array(*[F.count_if(F.col("shared") < k) for k in range(1, sigma + 1)])
    counts = _prefixes(marked.groupBy("suffix").agg(F.count("*").alias("n"), new.alias("new")), sigma)
    if unique:
        return counts
    longer = F.sequence(F.col("shared") + 1, F.size("suffix"))
    grams = marked.where(F.col("shared") < F.size("suffix")).select("record", F.explode(F.transform(longer, lambda k: F.slice("suffix", F.lit(1), k))).alias("gram")).distinct()
    return counts.drop("records").join(grams.groupBy("gram").agg(F.count("*").alias("records")), "gram")


def _prefixes(suffixes: DataFrame, sigma: int) -> DataFrame:
    """gram, n, records of all prefixes of (suffix, n, new); new has the records to which each prefix is new."""
    if sigma == 1:
        routed = suffixes.repartition(F.col("suffix")[0]).sortWithinPartitions(F.desc("suffix"))
        return routed.mapInPandas(_stacked(sigma), GRAMS)
    part = F.pmod(F.xxhash64(F.get("suffix", F.lit(1))), F.lit(SPREAD))
    routed = suffixes.withColumn("part", part).repartition(F.col("suffix")[0], "part").sortWithinPartitions(F.desc("suffix")).drop("part")
    parts = routed.mapInPandas(_stacked(sigma), GRAMS)
    # only first terms alone come in parts
    return parts.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("records").alias("records"))


def value_counts(df: DataFrame, record: str, value: Column, vocabulary: DataFrame | None = None, rare: int = 3, common: int = 20) -> DataFrame:
    """term, n, records, total, mark for every value; vocabulary (one column ``term``) adds terms that no record has, with 0.

    A record's values lie in many rows: they are met by (value, record) first,
    which makes one suffix of one term each.  mark is rare (records < rare),
    common (common * records > total) or null.  total is the number of records
    with any term.
    """
    rows = df.select(F.col(record).alias("record"), value.alias("t")).where(F.col("record").isNotNull() & F.col("t").isNotNull())
    total = rows.select("record").distinct().agg(F.count("*")).scalar()
    once = rows.groupBy("t", "record").agg(F.count("*").alias("n"))
    suffixes = once.groupBy("t").agg(F.sum("n").alias("n"), F.array(F.count("*")).alias("new")).select(F.array("t").alias("suffix"), "n", "new")
    counts = _prefixes(suffixes, 1).select(F.col("gram")[0].alias("term"), "n", "records")
    if vocabulary is not None:
        unused = vocabulary.where(F.col("term").isNotNull()).distinct().select("term", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("records"))
        counts = counts.unionByName(unused).groupBy("term").agg(F.sum("n").alias("n"), F.sum("records").alias("records"))
    mark = F.when(F.col("records") < rare, "rare").when(F.col("records") * common > F.col("total"), "common")
    return counts.withColumn("total", total).select("term", "n", "records", "total", mark.alias("mark"))
