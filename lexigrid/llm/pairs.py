"""p1: items that appear together.

Items are deduplicated per basket, items that can't reach the support are
dropped (a pair is never more frequent than its rarer item), ordered pairs are
emitted from each basket and counted with map-side combining; lift and PMI come
from the marginals.

A basket of more than CHUNK items is cut into chunks, and each pair of chunks is
a row of its own that is placed by its hash, so that the pairs of one long
basket come from many tasks and no row holds them all.

Defined results: null baskets and null items don't count; an item occurs in a
basket or not, however often; a basket with one item has no pair but counts in N.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# Items of one chunk of a long basket, and bytes of a list of items that is broadcast.
CHUNK, SMALL = 256, 64 << 20


def _ordered(rows: DataFrame) -> DataFrame:
    """item_a, item_b, each pair once: of the sorted array ``items`` with ``others``, all of which are larger, or with itself where that is null."""
    split = rows.select(F.posexplode("items").alias("p", "item_a"), "items", "others")
    rest = F.coalesce("others", F.slice("items", F.col("p") + 2, F.size("items")))
    return split.select("item_a", F.explode(rest).alias("item_b"))


def _emitted(kept: DataFrame) -> DataFrame:
    """All pairs of the baskets, where a basket's items fit a row by the support. Arrays are placed by their hash before pairs come of them."""
    baskets = kept.groupBy("b").agg(F.array_sort(F.collect_list("i")).alias("items")).where("size(items) > 1")
    count = F.ceil(F.size("items") / CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice("items", k * CHUNK + 1, F.lit(CHUNK)))
    one = baskets.select("b", chunks.alias("chunks")).select("b", F.posexplode("chunks").alias("k", "items"), "chunks")
    met = one.select("b", "k", "items", F.posexplode(F.slice("chunks", F.col("k") + 1, F.size("chunks"))).alias("m", "others"))
    return _ordered(met.select("items", F.when(F.col("m") > 0, F.col("others")).alias("others"), F.xxhash64("b", "k", "m").alias("h")).repartition("h"))


def _chunks(kept: DataFrame) -> DataFrame:
    """b, chunks, k, items: the items of each basket by hash in as many chunks as it needs."""
    sizes = kept.groupBy("b").agg(F.count("*").alias("size")).where("size > 1").select("b", F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks"))
    placed = kept.join(sizes, "b").select("b", "i", "chunks", F.pmod(F.xxhash64("i"), F.col("chunks")).cast("int").alias("k"))
    return placed.groupBy("b", "chunks", "k").agg(F.array_sort(F.collect_list("i")).alias("items"))


def _chunked(kept: DataFrame) -> DataFrame:
    """All pairs without a bound on a basket: chunks meet each other by a join on basket and both chunks."""
    rows = _chunks(kept)
    long = rows.where("chunks > 1")
    left = long.where("k < chunks - 1").select("b", "k", F.explode(F.sequence(F.col("k") + 1, F.col("chunks") - 1)).alias("m"), "items")
    right = long.where("k > 0").select("b", F.col("k").alias("m"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("k"), F.col("items").alias("others"))
    x = left.join(right, ["b", "k", "m"]).select(F.explode("items").alias("x"), "others").select("x", F.explode("others").alias("y"))
    own = _ordered(rows.select("items", F.when(F.lit(False), F.col("items")).alias("others")))
    return own.unionByName(x.select(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b")))


def _totals(rows: DataFrame) -> tuple[int, int]:
    """Number of baskets, and the bytes of all rows' items."""
    one = rows.groupBy("b").agg(F.sum(F.octet_length("i") + 64).alias("bytes")).agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    return one["n"], one["bytes"]


def item_pairs(
    df: DataFrame, basket: str, item: str, min_count: int = 5, min_share: float = 0.0, min_lift: float = 0.0
) -> DataFrame:
    """item_a, item_b (item_a < item_b), n_ab, n_a, n_b, n, lift, pmi of pairs in at least min_count baskets and min_share of all.

    With min_share > 0 at most (mean basket size) / min_share items survive the
    support filter, whatever the data's size: that bounds the length of a basket.
    The list of surviving items is broadcast only if it is below SMALL for sure:
    each of them stands in a share of all baskets, so that many copies of it are
    in the bytes of all rows.  Beyond that, and without a support share, it is
    joined by shuffle.  The totals come from a job of their own.
    """
    rows = df.where(F.col(basket).isNotNull() & F.col(item).isNotNull()).select(F.col(basket).alias("b"), F.col(item).cast("string").alias("i"))
    total, size = _totals(rows)
    one = rows.distinct()
    counts = one.groupBy("i").agg(F.count("*").alias("c")).where((F.col("c") >= min_count) & (F.col("c") >= min_share * total))
    emitted = _emitted if min_share > 0 else _chunked
    if min_share > 0 and size <= SMALL * min_share * max(1, total):
        # a short list, which one task can number in the order of the items; pairs are counted by number
        counts = F.broadcast(counts.withColumn("k", F.row_number().over(Window.orderBy("i"))))
        key = F.shiftleft(F.col("item_a").cast("long"), 32).bitwiseOR(F.col("item_b").cast("long"))
        pairs = emitted(one.join(counts, "i").select("b", F.col("k").alias("i"))).groupBy(key.alias("key")).agg(F.count("*").alias("n_ab"))
        pairs = pairs.select(F.shiftright("key", 32).cast("int").alias("a"), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"), "n_ab")
        a, b = counts.select(F.col("k").alias("a"), F.col("i").alias("item_a"), F.col("c").alias("n_a")), counts.select(F.col("k").alias("b"), F.col("i").alias("item_b"), F.col("c").alias("n_b"))
        by = ["a", "b"]
    else:
        pairs = emitted(one.join(counts, "i").select("b", "i")).groupBy("item_a", "item_b").agg(F.count("*").alias("n_ab"))
        a, b = counts.select(F.col("i").alias("item_a"), F.col("c").alias("n_a")), counts.select(F.col("i").alias("item_b"), F.col("c").alias("n_b"))
        by = ["item_a", "item_b"]
    pairs = pairs.where((F.col("n_ab") >= min_count) & (F.col("n_ab") >= min_share * total)).withColumn("n", F.lit(total).cast("long"))
    out = pairs.join(a, by[0]).join(b, by[1])
    lift = F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))
    # the threshold is compared in whole numbers when it is one
    reach = F.col("n_ab") * F.col("n") >= F.lit(int(min_lift) if float(min_lift).is_integer() else min_lift) * F.col("n_a") * F.col("n_b")
    return out.where(reach).select("item_a", "item_b", "n_ab", "n_a", "n_b", "n", lift.alias("lift"), F.log2(lift).alias("pmi"))
