"""The driver's tables as a stored index, and as files of many projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import index
from ..operators.search import Catalog
from ..sources.shared import shared_folder
from ..sources.store import Store
from . import catalog as cat

_BUILT: dict[tuple[str, str], Catalog] = {}


def stored(spark: SparkSession, d: str) -> Catalog:
    """The catalog as index that was written to the shared folder; a session writes and opens it once for each set of tables."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _BUILT:
        store = Store(spark, shared_folder(spark))
        q = cat.queries(spark, d).select("project", "rel_path", "id", "title", "description", "file_mtime", "updated_at")
        tables = {"queries": q, "favorites": cat.favorites(spark, d), "fts": cat.fts(spark, d)}
        tables |= {"query_tags": cat.with_project(spark, d, cat.links(spark, d)), "query_objects": cat.with_project(spark, d, cat.objects(spark, d))}
        index.publish(store, tables)
        _BUILT[key] = index.catalog(store)
    return _BUILT[key]


class TableFiles:
    """Rows of a table as files: project, rel_path, file_mtime, file_size, content. A project may have lost all its files."""

    def __init__(self, rows: DataFrame, projects: list[str]):
        self.rows, self.projects = rows, projects

    def listed(self) -> DataFrame:
        return self.rows.select("project", "rel_path", "file_mtime", "file_size")

    def read(self, paths: DataFrame) -> DataFrame:
        return self.rows.join(paths.select(*index.KEY), index.KEY, "left_semi")

    def scan(self) -> DataFrame:
        return self.rows


def as_files(rows: DataFrame, tags: bool = False) -> DataFrame:
    """Files with a front matter of title, description and, by choice, the array ``tags``."""
    line = lambda key, value: F.concat(F.lit(f"\n{key}: "), value)

    def text(c: str) -> Column:
        """A JSON string is a YAML string, if controls are escaped; characters beyond U+FFFF stand as they are, as YAML has no pairs of escapes."""
        one = F.struct(F.coalesce(c, F.lit("")).alias("x"))
        ways = [F.to_json(one, {"writeNonAsciiCharacterAsCodePoint": how}) for how in ("true", "false")]
        return F.regexp_extract(F.when(F.col(c).rlike(r"[\x{10000}-\x{10FFFF}]"), ways[1]).otherwise(ways[0]), r"(?s)^\{\"x\":(.*)\}$", 1)

    parts = [F.lit("/* ---"), line("title", text("title")), line("description", text("description"))]
    if tags:
        parts.append(line("tags", F.to_json(F.coalesce("tags", F.array().cast("array<string>")))))
    content = F.encode(F.concat(*parts, F.lit("\n--- */\n\n"), F.coalesce("body", F.lit(""))), "UTF-8")
    return rows.select("project", "rel_path", F.coalesce("file_mtime", F.lit(0)).alias("file_mtime"), F.octet_length(content).cast("long").alias("file_size"), content.alias("content"))
