"""Search strings and search plans over the catalog's tables."""

from __future__ import annotations

import datetime
import re
import zoneinfo
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import ascii_fold
from . import fts

# Fixed value: the keys of filters; each is written key:value, after a blank or at the start.
KEYS = ("table", "col", "tag", "date")
SORTS = {
    "name_asc": [("lower(title)", True)],
    "name_desc": [("lower(title)", False)],
    "mtime_desc": [("file_mtime", False)],
    "mtime_asc": [("file_mtime", True)],
}


# Blanks as Python has them; Java doesn't count U+001C to U+001F. The class stands for itself in both.
_B = r"\s\x1C-\x1F"
_FILTER = rf"(?:^|[{_B}])({'|'.join(KEYS)}):([^{_B}]+)"


def parse(text: str) -> tuple[dict[str, list[str]], str]:
    """Filters by key and the free text that is left. Keys are case-sensitive."""
    found: dict[str, list[str]] = {k: [] for k in KEYS}
    free, at = [], 0
    for m in re.finditer(_FILTER, text):
        free.append(text[at : m.start()])
        at = m.end()
        found[m[1]].append(m[2])
    return found, "".join([*free, text[at:]]).strip()


def parse_column(c: Column) -> dict[str, Column]:
    """The same for a column of search strings: one array per key, and the free text."""
    form = "(?U)" + _FILTER
    pairs = F.arrays_zip(*[F.regexp_extract_all(c, F.lit(form), F.lit(g)).alias(name) for g, name in ((1, "k"), (2, "v"))])

    def of(key: str) -> Column:
        return F.transform(F.filter(pairs, lambda p: p["k"] == key), lambda p: p["v"])

    return {k: of(k) for k in KEYS} | {"free_text": F.regexp_replace(F.regexp_replace(c, form, ""), rf"(?U)^[{_B}]+|[{_B}]+$", "")}


def day_bounds(day: str, zone: datetime.tzinfo = datetime.timezone.utc) -> tuple[int, int] | None:
    """First and last second of a day written DD/MM/YYYY in a time zone; None if it is no such day."""
    try:
        d = datetime.datetime.strptime(day, "%d/%m/%Y")
    except ValueError:
        return None
    return int(d.replace(tzinfo=zone).timestamp()), int(d.replace(hour=23, minute=59, second=59, tzinfo=zone).timestamp())


def day_column(c: Column) -> tuple[Column, Column]:
    """The same for a column, in the session's time zone; null for no such day."""
    good = c.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$")
    at = lambda time: F.unix_seconds(F.when(good, F.try_to_timestamp(F.concat(c, F.lit(time)), F.lit("d/M/yyyy H:m:s"))))
    return at(" 0:0:0"), at(" 23:59:59")


def session_zone(spark: SparkSession) -> datetime.tzinfo:
    """The session's time zone, in which the days of a search are meant."""
    name = spark.conf.get("spark.sql.session.timeZone")
    offset = re.fullmatch(r"(?:GMT|UTC|UT)?([+-])(\d{1,2})(?::?(\d{2}))?", name)
    if not offset:
        return zoneinfo.ZoneInfo({"Z": "UTC"}.get(name, name))
    away = datetime.timedelta(hours=int(offset[2]), minutes=int(offset[3] or 0))
    return datetime.timezone(away if offset[1] == "+" else -away)


@dataclass
class Catalog:
    """Tables of one or many projects.

    queries: project, id, rel_path, title, description, body, file_mtime, updated_at, one row per id.
    links: query_id, tag.  objects: query_id, object_type, object_name, object_key.
    favorites: project, rel_path.  fts: project, query_id and the four text columns; rows may repeat.
    postings, statistics: the stored full-text index; without them free text is searched by a scan of fts.
    """

    queries: DataFrame
    links: DataFrame
    objects: DataFrame
    favorites: DataFrame
    fts: DataFrame
    postings: DataFrame | None = None
    statistics: DataFrame | None = None

    def of(self, project: str) -> "Catalog":
        """One project: the filter prunes partitions."""
        own = lambda df: df.where(F.col("project") == project) if df is not None and "project" in df.columns else df
        return Catalog(*map(own, (self.queries, self.links, self.objects, self.favorites, self.fts, self.postings, self.statistics)))

    def only(self, projects: list[str], ids: list[int]) -> "Catalog":
        """What belongs to some files, a list of bounded length: the filters prune partitions and row groups."""

        def few(df: DataFrame, key: str | None) -> DataFrame:
            df = df.where(F.col("project").isin(sorted(set(projects)))) if "project" in df.columns else df
            return df.where(F.col(key).isin(ids)) if key else df

        return Catalog(few(self.queries, "id"), few(self.links, "query_id"), few(self.objects, "query_id"), few(self.favorites, None), few(self.fts, "query_id"))

    def ranked(self, text: str) -> DataFrame:
        """project, query_id, rank of the files that hold all terms of a free text."""
        if self.postings is None or self.statistics is None:
            return fts.score(self.fts, text)
        return fts.score_postings(self.postings, self.statistics, text)


def matching(cat: Catalog, text: str) -> tuple[DataFrame, str]:
    """Narrow rows of the files that satisfy all filters of a search string, and its free text.

    Repeated keys are ANDed; a date that is none is dropped.  Each filter is a
    left semi join; the date reaches the scan.
    """
    filters, free = parse(text.strip())
    rows = cat.queries.select("project", "id", "rel_path", "title", "description", "file_mtime", "updated_at")
    for day in filters["date"]:
        bounds = day_bounds(day, session_zone(rows.sparkSession))
        if bounds:
            rows = rows.where(F.col("file_mtime").between(*bounds))
    for kind, key in (("table", "table"), ("column", "col")):
        for name in filters[key]:
            hit = cat.objects.where((F.col("object_type") == kind) & (F.col("object_key") == ascii_fold(F.lit(name))))
            rows = rows.join(hit.select(F.col("query_id").alias("id")), "id", "left_semi")
    for tag in filters["tag"]:
        hit = cat.links.where(ascii_fold(F.col("tag")) == ascii_fold(F.lit(tag)))
        rows = rows.join(hit.select(F.col("query_id").alias("id")), "id", "left_semi")
    return rows, free


def tags_of(links: DataFrame) -> DataFrame:
    """query_id, tags: sorted, each once; files without a tag have no row."""
    return links.groupBy("query_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def tables_of(objects: DataFrame) -> DataFrame:
    """query_id, tables: sorted names. A name that holds a comma is split, as names travel in one joined string."""
    names = objects.where("object_type = 'table'").groupBy("query_id").agg(F.array_sort(F.collect_list("object_name")).alias("tables"))
    return names.withColumn("tables", F.filter(F.split(F.array_join("tables", ","), ","), lambda t: t != ""))


def starred(rows: DataFrame, favorites: DataFrame) -> DataFrame:
    """Rows with is_favorite, by project and rel_path."""
    stars = favorites.select("project", "rel_path").distinct().withColumn("_star", F.lit(True))
    return rows.join(stars, ["project", "rel_path"], "left").withColumn("is_favorite", F.coalesce("_star", F.lit(False))).drop("_star")


def dress(cat: Catalog, rows: DataFrame) -> DataFrame:
    """Rows with tags, tables and favorite flag as arrays and booleans; rows is the small side."""
    ids = rows.select(F.col("id").alias("query_id"))
    tags = tags_of(cat.links.join(ids, "query_id", "left_semi")).withColumnRenamed("query_id", "id")
    tables = tables_of(cat.objects.join(ids, "query_id", "left_semi")).withColumnRenamed("query_id", "id")
    none = F.array().cast("array<string>")
    return (
        starred(rows.join(tags, "id", "left").join(tables, "id", "left"), cat.favorites)
        .select(
            F.col("id").alias("query_id"),
            "rel_path",
            "title",
            F.coalesce("description", F.lit("")).alias("description"),
            "snippet",
            "rank",
            F.coalesce("tags", none).alias("tags"),
            F.col("project").alias("folder"),
            F.coalesce("tables", none).alias("tables"),
            "updated_at",
            "is_favorite",
            F.coalesce("file_mtime", F.lit(0)).alias("file_mtime"),
        )
    )


# Fixed value: results of a limited search that are looked up by id instead of by a join.
TOP = 1000


def search(cat: Catalog, text: str, limit: int | None = None, sort: str | None = None) -> DataFrame:
    """Search results over all projects of the catalog, with ranks of each project's own index.

    Order: rank for free text, else newest first, then title; ``sort`` overrides
    it.  Ranking and limit come before the snippet and the lists.  With a limit
    of up to TOP the best rows are fetched at once, and bodies, tags and tables
    are then read for their ids alone; otherwise they come by joins.
    """
    rows, free = matching(cat, text)
    if free:
        rows = rows.join(cat.ranked(free).withColumnRenamed("query_id", "id"), ["project", "id"])
        order = [F.col("rank"), F.col("id")]
    else:
        rows = rows.withColumn("rank", F.lit(0.0))
        order = [F.desc("file_mtime"), F.col("title"), F.col("id")]
    if limit is not None:
        rows = rows.orderBy(*order).limit(limit)
        if limit <= TOP:
            best = rows.collect()
            rows = rows.sparkSession.createDataFrame(best, rows.schema)
            cat = cat.only([r["project"] for r in best], [r["id"] for r in best])
    if free:
        bodies = cat.fts.select("project", F.col("query_id").alias("id"), "body")
        rows = rows.join(bodies, ["project", "id"]).withColumn("snippet", fts.snippets(F.col("body"), free)).drop("body").dropDuplicates(["project", "id"])
    else:
        rows = rows.withColumn("snippet", F.lit(""))
    out = dress(cat, rows)
    final = [F.col("rank"), F.col("query_id")] if free else [F.desc("file_mtime"), F.col("title"), F.col("query_id")]
    return sorted_results(out, sort) if sort else out.orderBy(*final)


def sorted_results(results: DataFrame, sort: str) -> DataFrame:
    """One of the four orders of a result list; ties by query_id."""
    (expression, up), = SORTS[sort]
    c = F.expr(expression)
    return results.orderBy(c.asc() if up else c.desc(), "query_id")


def palette(results: DataFrame, text: str) -> DataFrame:
    """The second search: over results at hand, free text as one substring of title, path or a tag. col: has no effect."""
    filters, free = parse(text.strip())
    for key, column in (("table", "tables"), ("tag", "tags")):
        for v in filters[key]:
            results = results.where(_holds(column, v.lower()))
    for day in filters["date"]:
        bounds = day_bounds(day, session_zone(results.sparkSession))
        if bounds:
            results = results.where(F.col("file_mtime").between(*bounds))
    if free:
        needle = free.lower()
        results = results.where(F.lower("title").contains(needle) | F.lower("rel_path").contains(needle) | F.exists("tags", lambda t: F.lower(t).contains(needle)))
    return results


def _holds(column: str, value: str) -> Column:
    return F.exists(column, lambda t: F.lower(t) == value)


def chip_search(kind: str, value: str) -> str:
    """Search text of a chip; an alias becomes free text."""
    return f"{'col' if kind == 'column' else kind}:{value}"


def objects_of(objects: DataFrame, query_id: int) -> DataFrame:
    """One row: a map of the four types to sorted names."""
    one = objects.where(F.col("query_id") == query_id).groupBy("object_type").agg(F.array_sort(F.collect_list("object_name")).alias("names"))
    return one.agg(F.map_from_entries(F.collect_list(F.struct("object_type", "names"))).alias("m")).select(
        *[F.coalesce(F.try_element_at("m", F.lit(k)), F.array().cast("array<string>")).alias(k) for k in ("table", "column", "procedure", "function")]
    )


def id_of(queries: DataFrame, project: str, rel_path: str) -> DataFrame:
    """The id of a path; no row outside the project."""
    return queries.where((F.col("project") == project) & (F.col("rel_path") == rel_path)).select("id").distinct()
