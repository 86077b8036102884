"""Favorites, recent views, statistics and lists of tags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

RECENT = 20


def favorites(queries: DataFrame, stars: DataFrame) -> DataFrame:
    """Files marked as favorite; marks of paths that are gone drop out."""
    return queries.join(stars.select("project", "rel_path").distinct(), ["project", "rel_path"], "left_semi")


def is_favorite(stars: DataFrame, project: str, rel_path: str) -> bool:
    return not stars.where((F.col("project") == project) & (F.col("rel_path") == rel_path)).isEmpty()


def toggled(events: DataFrame, keys: list[str]) -> DataFrame:
    """State after toggle events: a key is set if it was toggled an odd number of times."""
    return events.groupBy(*keys).agg((F.count("*") % 2 == 1).alias("is_favorite"))


def toggle(stars: DataFrame, change: DataFrame) -> DataFrame:
    """Favorites after each given path changed its state once."""
    keys = ["project", "rel_path"]
    change, stars = change.select(*keys).distinct(), stars.select(*keys).distinct()
    return stars.join(change, keys, "left_anti").unionByName(change.join(stars, keys, "left_anti"))


def last_views(log: DataFrame, keys: list[str], at: str = "viewed_at") -> DataFrame:
    """Latest view of each key; views without a time don't count."""
    return log.where(F.col(at).isNotNull()).groupBy(*keys).agg(F.max(at).alias(at))


def top_recent(views: DataFrame, group: str, at: str = "viewed_at", n: int = RECENT, tie: str = "rel_path") -> DataFrame:
    """The n latest of each group. Rows are cut to n per task and group before the shuffle of a large group."""
    w = Window.partitionBy(group).orderBy(F.desc(at), tie)
    return views.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def recent(queries: DataFrame, views: DataFrame, limit: int = RECENT) -> DataFrame:
    """Files by latest view; views of files that are gone drop out."""
    out = queries.join(views.select("project", "rel_path", "viewed_at"), ["project", "rel_path"])
    return out.orderBy(F.desc("viewed_at"), "project", "rel_path").limit(limit)


def project_stats(queries: DataFrame, links: DataFrame, objects: DataFrame, stars: DataFrame) -> DataFrame:
    """Per project: files, tags in use, favorites (marks of lost paths included), different tables and columns without ASCII case.

    objects needs project; each count is one aggregate, joined on the project.
    """
    names = objects.groupBy("project").agg(
        F.countDistinct(F.when(F.col("object_type") == "table", F.col("object_key"))).alias("tables"),
        F.countDistinct(F.when(F.col("object_type") == "column", F.col("object_key"))).alias("columns"),
    )
    parts = [
        links.groupBy("project").agg(F.countDistinct("tag").alias("tags")),
        stars.select("project", "rel_path").distinct().groupBy("project").agg(F.count("*").alias("favorites")),
        names,
    ]
    out = queries.groupBy("project").agg(F.count("*").alias("queries"))
    for p in parts:
        out = out.join(p, "project", "left")
    return out.fillna(0)


def global_stats(queries: DataFrame, links: DataFrame, objects: DataFrame, stars: DataFrame) -> DataFrame:
    """Over all projects: sums of files and favorites; names as each project spells them (its smallest spelling), counted with case."""
    spelled = objects.where(F.col("object_type").isin("table", "column")).groupBy("project", "object_type", "object_key").agg(F.min("object_name").alias("name"))
    names = spelled.select("object_type", "name").distinct().agg(F.count_if(F.col("object_type") == "table").alias("tables"), F.count_if(F.col("object_type") == "column").alias("columns"))
    counts = [
        queries.agg(F.count("*").alias("queries"), F.countDistinct("project").alias("folders")),
        links.agg(F.countDistinct("tag").alias("tags")),
        stars.select("project", "rel_path").distinct().agg(F.count("*").alias("favorites")),
        names,
    ]
    rows = [c.select(F.explode(F.map_from_arrays(F.array(*[F.lit(x) for x in c.columns]), F.array(*[F.col(x).cast("long") for x in c.columns]))).alias("statistic", "value")) for c in counts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def all_tags(links: DataFrame) -> DataFrame:
    """Tags of all projects, each once, in order."""
    return links.select("tag").distinct().orderBy("tag")


def tags_by_project(links: DataFrame) -> DataFrame:
    """Tags of each project with the number of their files; links needs project."""
    return links.groupBy("project", "tag").agg(F.countDistinct("query_id").alias("queries"))


def file_counts(queries: DataFrame) -> DataFrame:
    """Files per project; a repeated id counts once."""
    return queries.groupBy("project").agg(F.countDistinct("id").alias("queries"))


def file_total(queries: DataFrame) -> DataFrame:
    """Files over all projects, in one row; 0 for none."""
    return queries.agg(F.countDistinct("id").alias("total"))


def recent_projects(views: DataFrame, n: int = 10, at: str = "viewed_at") -> DataFrame:
    """project, last_view of the n projects that were opened last; views without a time don't count."""
    return views.groupBy("project").agg(F.max(at).alias("last_view")).where("last_view is not null").orderBy(F.desc("last_view"), "project").limit(n)


def suggestions(tags: DataFrame, chosen: DataFrame, typed: str = "") -> DataFrame:
    """Tags that aren't chosen yet and contain the typed text, whatever its case."""
    left = tags.join(chosen, "tag", "left_anti")
    return left.where(F.lower("tag").contains(typed.lower())) if typed else left


# Rows of a group that one task may number, and the parts that a larger group is cut into.
WHOLE, CUTS = 100_000, 256


def numbered(df: DataFrame, group: list[str], order: str, name: str = "number") -> DataFrame:
    """Rows with their place, from 1, in the order of a numeric column without repetition within a group.

    A group of more than WHOLE rows is cut at quantiles of the column; the parts
    are numbered apart and shifted by the rows before them. Such groups are few
    (all rows / WHOLE at most), which bounds what is broadcast.
    """
    own = {g: f"_of_{g}" for g in group}
    same = lambda other: reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(o)) for g, o in other.items()])
    size = df.groupBy(*group).agg(F.count("*").alias("_n"), F.percentile_approx(order, [k / CUTS for k in range(1, CUTS)], 1000).alias("_at")).where(F.col("_n") > WHOLE)
    cut = df.join(F.broadcast(size.drop("_n").withColumnsRenamed(own)), same(own), "left")
    cut = cut.withColumn("_part", F.when(F.col("_at").isNull(), 0).otherwise(F.size(F.filter("_at", lambda x: x < F.col(order))))).drop("_at", *own.values())
    over = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = cut.groupBy(*group, "_part").agg(F.count("*").alias("_m")).withColumn("_shift", F.sum("_m").over(over)).where("_shift > 0").drop("_m")
    place = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(order))
    own |= {"_part": "_of__part"}
    out = cut.withColumn("_place", place).join(F.broadcast(shifts.withColumnsRenamed(own)), same(own), "left")
    return out.withColumn(name, F.col("_place") + F.coalesce("_shift", F.lit(0))).drop("_part", "_place", "_shift", *own.values())


def unique_names(df: DataFrame, stem: str, order: str, taken: DataFrame | None = None) -> DataFrame:
    """A free file name for each row of a batch: name.sql, name_1.sql, name_2.sql, ...; taken has project, file_name.

    The first row of each stem takes the plain name if it is free. The others
    are numbered by the given numeric column, over the numbers that are neither
    taken nor plain names of another stem.  No row is lost and no name repeated.
    """
    stems = df.groupBy("project", stem).agg(F.min(order).alias("_first"))
    used = stems.select("project", F.concat(F.col(stem), F.lit(".sql")).alias("file_name"))
    held = used if taken is None else used.unionByName(taken.select("project", "file_name")).distinct()
    form = r"^(.+)_([1-9][0-9]{0,8})\.sql$"
    numbers = held.select("project", F.regexp_extract("file_name", form, 1).alias(stem), F.regexp_extract("file_name", form, 2).alias("k")).where("k <> ''")
    numbers = numbers.join(stems.drop("_first"), ["project", stem], "left_semi").groupBy("project", stem).agg(F.array_sort(F.collect_list(F.col("k").cast("long"))).alias("_k"))
    if taken is not None:
        blocked = taken.select("project", F.regexp_replace("file_name", r"\.sql$", "").alias(stem), F.lit(True).alias("_blocked")).distinct()
        stems = stems.join(blocked, ["project", stem], "left")
    else:
        stems = stems.withColumn("_blocked", F.lit(None).cast("boolean"))
    rows = numbered(df, ["project", stem], order, "_r").join(stems, ["project", stem]).join(numbers, ["project", stem], "left")
    free = F.coalesce("_blocked", F.lit(False))
    r = F.col("_r") - F.when(free, 0).otherwise(1)
    # the r-th number that isn't held: each held number k, the i-th in order, shifts those from k - i + 1 on
    held_before = F.size(F.filter(F.coalesce("_k", F.array().cast("array<long>")), lambda k, i: k - i <= r))
    number = F.when(r == 0, "").otherwise(F.concat(F.lit("_"), (r + held_before).cast("string")))
    return rows.withColumn("file_name", F.concat(F.col(stem), number, F.lit(".sql"))).drop("_r", "_first", "_blocked", "_k")
