"""Snapshot store: tables of an index under one shared folder, by project.

A write adds new directories ``<table>/project=<name>/snap=<id>`` for the
projects it touches and then flips a pointer file that names the directory of
every project; all other projects stay as they are, by reference.  A directory
that may be read is never overwritten, so a write that dies leaves the old
snapshot whole.  Files are reached through Hadoop's file systems, so the folder
may lie on any that can rename.  One writer at a time.

Defined results: a table without rows of a project has no directory for it; a
table that was never written reads as None; an unreadable pointer counts as none.
"""

from __future__ import annotations

import json
import time
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schemas import FAVORITES, RECENT, SCHEMA_VERSION


class Folder:
    """The few file operations a store needs, on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)
        self.gateway = spark.sparkContext._gateway
        self.fs.mkdirs(self.path(root))

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def text(self, p: str) -> str | None:
        if not self.fs.exists(self.path(p)):
            return None
        stream = self.fs.open(self.path(p))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def replace(self, p: str, text: str) -> None:
        """Write a file beside p and rename it over p."""
        temp = f"{p}.{uuid.uuid4().hex[:8]}"
        out = self.fs.create(self.path(temp))
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.path(temp), self.path(p), how)

    def find(self, pattern: str) -> list[str]:
        """Full paths that match a glob, sorted."""
        return sorted(s.getPath().toString() for s in self.fs.globStatus(self.path(pattern)) or [])

    def remove(self, p: str) -> None:
        self.fs.delete(self.path(p), True)


class Store:
    """Named tables with a column ``project``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.folder = spark, root.rstrip("/"), Folder(spark, root)

    def meta(self) -> dict:
        """Content of the pointer; {} if there is none or it can't be read."""
        try:
            out = json.loads(self.folder.text(f"{self.root}/current.json") or "{}")
        except ValueError:
            return {}
        return out if isinstance(out, dict) else {}

    def compatible(self) -> bool:
        """Whether the snapshot has this schema version; if not, ``migrate`` or rebuild in full."""
        return self.meta().get("schema_version") == SCHEMA_VERSION

    def migrate(self) -> bool:
        """Version 1 had no favorites and recent views: they are added without rows. Whether the store is compatible afterwards."""
        meta = self.meta()
        if meta.get("schema_version") == "1":
            for name, schema in (("favorites", FAVORITES), ("recent", RECENT)):
                meta["tables"].setdefault(name, {"schema": schema.jsonValue(), "parts": {}})
            self._flip(meta | {"schema_version": SCHEMA_VERSION})
        return self.compatible()

    def projects(self, name: str = "queries") -> list[str]:
        return sorted(self.meta().get("tables", {}).get(name, {}).get("parts", {}))

    def read(self, name: str, projects: list[str] | None = None) -> DataFrame | None:
        """A table, or the directories of some projects only."""
        table = self.meta().get("tables", {}).get(name)
        return None if table is None else self._open(name, table, projects)

    def _open(self, name: str, table: dict, projects: list[str] | None = None) -> DataFrame:
        schema, parts = T.StructType.fromJson(table["schema"]), table["parts"]
        paths = [f"{self.root}/{name}/{p}" for k, p in parts.items() if projects is None or k in projects]
        if not paths:
            return self.spark.createDataFrame([], schema)
        full = T.StructType([*schema.fields, T.StructField("snap", T.StringType())])
        return self.spark.read.schema(full).option("basePath", f"{self.root}/{name}").parquet(*paths).select(*schema.names)

    def stage(self, name: str, df: DataFrame, sort: list[str] | tuple = ()) -> dict:
        """Write rows without making them current; the result goes to ``commit`` or ``staged``.

        Rows of a project meet in few files, sorted; a large project is split at run time.
        """
        snap = uuid.uuid4().hex[:12]
        rows = df.where(F.col("project").isNotNull()).withColumn("snap", F.lit(snap)).hint("rebalance", "project").sortWithinPartitions("project", "snap", *sort)
        rows.write.mode("append").partitionBy("project", "snap").parquet(f"{self.root}/{name}")
        parts = {}
        for p in self.folder.find(f"{self.root}/{name}/project=*/snap={snap}"):
            at = "/".join(p.rsplit("/", 2)[1:])
            parts[unquote(at.split("/")[0].removeprefix("project="))] = at
        return {"schema": df.schema.jsonValue(), "parts": parts}

    def staged(self, name: str, table: dict) -> DataFrame:
        return self._open(name, table)

    def commit(self, tables: dict[str, dict], projects: list[str] | None = None, **meta) -> None:
        """Make staged tables current together. Of each table only the given projects are replaced, or all of them; other tables stay."""
        now = self.meta()
        known = dict(now.get("tables", {}))
        for name, table in tables.items():
            old = known.get(name, {}).get("parts", {})
            kept = {} if projects is None else {k: v for k, v in old.items() if k not in projects}
            known[name] = {"schema": table["schema"], "parts": kept | table["parts"]}
        self._flip(now | meta | {"schema_version": SCHEMA_VERSION, "last_full_scan": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "tables": known})

    def write(self, tables: dict[str, DataFrame], projects: list[str] | None = None, **meta) -> None:
        self.commit({name: self.stage(name, df) for name, df in tables.items()}, projects, **meta)

    def _flip(self, meta: dict) -> None:
        self.folder.replace(f"{self.root}/current.json", json.dumps(meta, indent=1))

    def vacuum(self) -> int:
        """Remove directories that are no longer current; to be called when no reader uses them."""
        keep = {f"{name}/{p}" for name, t in self.meta().get("tables", {}).items() for p in t["parts"].values()}
        gone = 0
        for p in self.folder.find(f"{self.root}/*/project=*/snap=*"):
            if "/".join(p.rsplit("/", 3)[1:]) not in keep:
                self.folder.remove(p)
                gone += 1
        return gone

    def drop_project(self, project: str) -> None:
        """Take one project out of every table; nothing is rewritten."""
        meta = self.meta()
        for t in meta.get("tables", {}).values():
            t["parts"].pop(project, None)
        self._flip(meta)
