"""Maintenance of the index: expansion of files into tables, incremental diff, upsert, delete, full rebuild."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import FAVORITES
from ..sources.files import ProjectFiles, parsed
from ..sources.store import Store
from . import fts
from .objects import extracted, object_rows, objects_text
from .search import Catalog

KEY = ["project", "rel_path"]
CHILDREN = ("query_tags", "query_objects", "fts")
SORT = {"queries": ["id"]} | {name: ["query_id"] for name in CHILDREN}


def expand(files: DataFrame) -> dict[str, DataFrame]:
    """The tables that come of scanned files; ``publish`` adds those of the full-text index."""
    return split(parsed(files).withColumn("objects", extracted("body")))


def split(rows: DataFrame) -> dict[str, DataFrame]:
    """Tables of the index from parsed files with their extracted names."""
    links = rows.select("project", F.col("id").alias("query_id"), F.explode("tags").alias("tag"))
    return {
        "queries": rows.select(*KEY, "id", "title", "description", "body", "file_mtime", "file_size", "content_hash", "has_frontmatter", "created_at", "updated_at"),
        "query_tags": links,
        "query_objects": object_rows(rows),
        "fts": rows.select("project", F.col("id").alias("query_id"), "title", "description", "body", objects_text(F.col("objects")).alias("objects")),
    }


def publish(store: Store, tables: dict[str, DataFrame], projects: list[str] | None = None) -> None:
    """Write tables, and the postings and statistics that come of ``fts``, and make them current together.

    Postings are made from the rows of ``fts`` as they were written, so no text
    is parsed twice.  Of each table only the given projects are replaced, or all.
    """
    staged = {name: store.stage(name, df, SORT.get(name, ())) for name, df in tables.items()}
    if "fts" in staged:
        docs = store.staged("fts", staged["fts"])
        staged["postings"] = store.stage("postings", fts.postings(docs), fts.ORDER)
        staged["statistics"] = store.stage("statistics", fts.statistics(docs))
    store.commit(staged, projects)


def rebuild(store: Store, files: ProjectFiles) -> None:
    """Replace all tables of the files' projects; other projects, favorites and recent views stay as they are."""
    with _parsed(store, files.scan()) as rows:
        publish(store, split(rows), files.projects)


def catalog(store: Store, projects: list[str] | None = None) -> Catalog:
    """The stored index for searches, of some projects or of all."""
    read = lambda name: store.read(name, projects)
    stars = read("favorites")
    return Catalog(
        read("queries"), read("query_tags"), read("query_objects"), store.spark.createDataFrame([], FAVORITES) if stars is None else stars,
        read("fts"), read("postings"), read("statistics"),
    )


@contextmanager
def _parsed(store: Store, files: DataFrame):
    """Parsed rows of files, written once, as four tables come of them."""
    rows = parsed(files).withColumn("objects", extracted("body"))
    work = f"{store.root}/_work-{uuid.uuid4().hex[:12]}"
    try:
        rows.write.parquet(work)
        yield store.spark.read.schema(rows.schema).parquet(work)
    finally:
        store.folder.remove(work)


def diff(scanned: DataFrame, indexed: DataFrame, verify_hash: bool = False) -> DataFrame:
    """Each path of both sides with its action: skip, touch, replace, insert or delete.

    scanned needs project, rel_path, file_mtime, content_hash; the same mtime
    means skip without a look at the hash, unless verify_hash.  One full outer
    join on (project, rel_path); only paths, times and hashes are shuffled.
    """
    return _met(scanned, indexed).select(*KEY, "new_mtime", _action(verify_hash).alias("action"))


def _met(scanned: DataFrame, indexed: DataFrame) -> DataFrame:
    new = scanned.select(*KEY, F.col("file_mtime").alias("new_mtime"), F.col("content_hash").alias("new_hash"), F.lit(True).alias("there"))
    old = indexed.select(*KEY, F.col("file_mtime").alias("old_mtime"), F.col("content_hash").alias("old_hash"), F.lit(True).alias("known"))
    return new.join(old, KEY, "full_outer")


def _action(verify_hash: bool = False) -> Column:
    same_time = F.col("new_mtime").eqNullSafe(F.col("old_mtime"))
    same_hash = F.col("new_hash").eqNullSafe(F.col("old_hash"))
    return (
        F.when(F.col("there").isNull(), "delete")
        .when(F.col("known").isNull(), "insert")
        .when(same_time & (same_hash if verify_hash else F.lit(True)), "skip")
        .when(same_hash, "touch")
        .otherwise("replace")
    )


def changed_count(actions: DataFrame) -> int:
    """Inserted, replaced and deleted files; touches don't count."""
    return actions.where(F.col("action").isin("insert", "replace", "delete")).count()


def refresh(store: Store, files: ProjectFiles, verify_hash: bool = False) -> int:
    """Bring the index of the files' projects up to date; returns the number of changes. Other projects are neither read nor written.

    Times come first: bytes are read of new files and of those with another time
    only, once.  A file that vanishes while it is listed is left as the index has it.
    """
    if not store.compatible() or not set(files.projects) & set(store.projects()):
        rebuild(store, files)
        return store.read("queries", files.projects).count()
    listed = files.listed()
    return _apply(store, listed.where("file_mtime is not null"), listed, files, verify_hash)


def apply_batch(store: Store, files: ProjectFiles, modified: list[str], deleted: list[str]) -> int:
    """Apply the paths of one batch of change events: only these are looked at. A path that is no file (any more) and isn't deleted stays as it is."""
    if not store.compatible() or not set(files.projects) & set(store.projects()):
        return refresh(store, files)
    present = files.at([p for p in set(modified) - set(deleted) if p.endswith(".sql")]).where("file_mtime is not null")
    gone = store.spark.createDataFrame([(p,) for p in sorted(set(deleted))], "rel_path string")
    rest = store.read("queries", files.projects).select(*KEY).join(gone, "rel_path", "left_anti").unionByName(present.select(*KEY))
    return _apply(store, present, rest, files, True)


def _apply(store: Store, present: DataFrame, listed: DataFrame, files: ProjectFiles, verify_hash: bool) -> int:
    """Read the present files whose time (or, by choice, whose hash) may differ, and drop those of the index that aren't listed."""
    old = store.read("queries", files.projects)
    seen = present.join(old.select(*KEY, F.col("file_mtime").alias("old_mtime"), F.lit(True).alias("known")), KEY, "left")
    look = seen if verify_hash else seen.where(F.col("known").isNull() | ~F.col("file_mtime").eqNullSafe(F.col("old_mtime")))
    with _parsed(store, files.read(look)) as rows:
        met = _met(rows, old).where("there").withColumn("action", _action(verify_hash))
        fresh = rows.join(met.where("action in ('insert', 'replace')").select(*KEY), KEY, "left_semi")
        touched = met.where("action = 'touch'").select(*KEY, "new_mtime")
        lost = old.select(*KEY).join(listed.select(*KEY), KEY, "left_anti")
        counts = {r["action"]: r["count"] for r in met.groupBy("action").count().unionByName(lost.agg(F.lit("delete").alias("action"), F.count("*").alias("count"))).collect()}
        n = sum(counts.get(a, 0) for a in ("insert", "replace", "delete"))
        if not n and not counts.get("touch"):
            return 0
        gone = old.select(*KEY, "id").join(lost.unionByName(fresh.select(*KEY)), KEY, "left_semi").select("project", F.col("id").alias("query_id"))
        kept = old.join(gone.withColumnRenamed("query_id", "id"), ["project", "id"], "left_anti").join(touched, KEY, "left")
        new = split(fresh)
        out = {"queries": kept.withColumn("file_mtime", F.coalesce("new_mtime", "file_mtime")).select(*old.columns).unionByName(new["queries"])}
        if n:  # a touch changes no other table
            for name in CHILDREN:
                out[name] = store.read(name, files.projects).join(gone, ["project", "query_id"], "left_anti").unionByName(new[name])
        publish(store, out, files.projects)
    return n


def upsert(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """base with the rows of delta in place of those with equal keys."""
    return base.join(delta.select(*keys).distinct(), keys, "left_anti").unionByName(delta)


def delete(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """All tables without the files of the given paths; children go by the id of the file."""
    ids = tables["queries"].join(paths.select(*KEY).distinct(), KEY, "left_semi").select("project", F.col("id").alias("query_id"))
    out = {"queries": tables["queries"].join(paths.select(*KEY).distinct(), KEY, "left_anti")}
    for name in CHILDREN:
        if name in tables:
            out[name] = tables[name].join(ids, ["project", "query_id"], "left_anti")
    return out


def vocabulary(links: DataFrame) -> DataFrame:
    """Tags in use: one row per project and tag. Tags without a link don't appear."""
    return links.select("project", "tag").distinct()
