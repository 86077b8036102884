"""The driver's tables in the shape of a catalog: repeated deliveries, spellings and formats made one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import ascii_fold
from ..operators.objects import dedupe, objects_text
from ..operators.search import Catalog
from ..sources.tables import table
from .spread import spread


def queries(spark: SparkSession, d: str) -> DataFrame:
    """One row per id; columns that a plan doesn't use are pruned before the shuffle."""
    return table(spark, d, "queries").dropDuplicates(["id"])


def links(spark: SparkSession, d: str) -> DataFrame:
    """query_id, tag: trimmed, lower case, each pair once."""
    tags = table(spark, d, "tags").select(F.col("id").alias("tag_id"), F.lower(F.trim("name")).alias("tag")).where("tag <> ''")
    return table(spark, d, "query_tags").join(tags, "tag_id").select("query_id", "tag").distinct()


def objects(spark: SparkSession, d: str) -> DataFrame:
    """query_id, object_type, object_name, object_key under the index's constraints."""
    return dedupe(table(spark, d, "query_objects").where("object_name <> ''"), ["query_id"])


def favorites(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "favorites").distinct()


def views(spark: SparkSession, d: str) -> DataFrame:
    """project, rel_path, viewed_at as timestamp; both formats of the log; rows without a time are left out."""
    iso = F.try_to_timestamp(F.substring("viewed_at", 1, 26), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    plain = F.try_to_timestamp("viewed_at", F.lit("yyyy-MM-dd HH:mm:ss"))
    log = table(spark, d, "recently_viewed").select("project", "rel_path", F.coalesce(iso, plain).alias("viewed_at"))
    return log.where("viewed_at is not null")


def fts(spark: SparkSession, d: str) -> DataFrame:
    """project, query_id and the four text columns; object names by type, then by name. Repeated deliveries are left in, as full-text search drops them where rows are narrow."""
    of = lambda kind: F.collect_list(F.when(F.col("object_type") == kind, F.col("object_name")))
    joined = objects(spark, d).groupBy("query_id").agg(*[of(k).alias(k) for k in ("table", "column")])
    none = F.array().cast("array<string>")
    shape = F.struct("table", "column", *[none.alias(k) for k in ("alias", "procedure", "function")])
    joined = joined.select("query_id", objects_text(shape).alias("objects"))
    base = spread(table(spark, d, "queries").select("project", "id", "title", "description", "body")).select("project", F.col("id").alias("query_id"), "title", F.coalesce("description", F.lit("")).alias("description"), "body")
    return base.join(joined, "query_id", "left").select("project", "query_id", "title", "description", "body", F.coalesce("objects", F.lit("")).alias("objects"))


def catalog(spark: SparkSession, d: str) -> Catalog:
    return Catalog(queries(spark, d), links(spark, d), objects(spark, d), favorites(spark, d), fts(spark, d))


def with_project(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    """Rows with query_id and the project of the query."""
    return rows.join(queries(spark, d).select(F.col("id").alias("query_id"), "project"), "query_id")


__all__ = ["ascii_fold", "catalog", "favorites", "fts", "links", "objects", "queries", "views", "with_project"]
