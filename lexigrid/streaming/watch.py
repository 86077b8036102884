"""Watching folders: change events, debounced batches, and their application to the index.

Events: project, path, op (created, modified, deleted, moved), dest, is_directory, ts.
A batch closes after 500 ms without an event of its project; the last event of a
path decides, so a file that is deleted and written again within a batch lives.
Events without a project, path or time are left out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..sources.files import INDEX_DIR, ProjectFiles
from ..sources.shared import shared_folder
from ..sources.ship import ship

DEBOUNCE = "500 milliseconds"


def _is_sql(path: str):
    return F.col(path).rlike(r"(?i)[^/]\.sql$") & ~F.array_contains(F.split(path, "/"), INDEX_DIR)


def changes(events: DataFrame) -> DataFrame:
    """project, path, op (modify or delete), ts: a move is a delete and a modify; folders and other files are left out."""
    moved = F.array(
        F.struct(F.col("path").alias("path"), F.lit("delete").alias("op")),
        F.struct(F.col("dest").alias("path"), F.lit("modify").alias("op")),
    )
    one = F.array(F.struct(F.col("path").alias("path"), F.when(F.col("op") == "deleted", "delete").otherwise("modify").alias("op")))
    rows = events.where(~F.coalesce("is_directory", F.lit(False))).select("project", "ts", F.explode(F.when(F.col("op") == "moved", moved).otherwise(one)).alias("e"))
    return rows.select("project", F.col("e.path").alias("path"), F.col("e.op").alias("op"), "ts").where(F.col("path").isNotNull() & _is_sql("path"))


def batches(rows: DataFrame, gap: str = DEBOUNCE, watermark: str | None = None) -> DataFrame:
    """project, start, end, modified, deleted: sorted paths of each batch by their last event.

    For a stream a watermark is needed, and a batch is emitted when it passes.
    Of events at the same instant a modification counts as the later.
    """
    width = _micros(gap)
    rows = rows.where(F.col("project").isNotNull() & F.col("path").isNotNull() & F.col("ts").isNotNull())
    out = _open_batches(rows.withWatermark("ts", watermark), width) if rows.isStreaming else _all_batches(rows, width)
    pick = lambda op: F.array_sort(F.transform(F.filter("paths", lambda p: p["op"] == op), lambda p: p["path"]))
    times = [F.timestamp_micros(c).alias(c) for c in ("start", "end")]
    return out.select("project", *times, pick("modify").alias("modified"), pick("delete").alias("deleted"))


def _micros(gap: str) -> int:
    """Microseconds of a text like 500 milliseconds or 2 hours."""
    n, unit = re.fullmatch(r"\s*(\d+)\s*([a-z]+?)s?\s*", gap.lower()).groups()
    return int(n) * {"microsecond": 1, "millisecond": 10**3, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6}[unit]


# Fixed value: cells of one block; neighbours are compared within blocks, and then blocks with each other.
BLOCK = 4096


def _all_batches(rows: DataFrame, width: int) -> DataFrame:
    """Batches of a finished log.

    Time is cut into cells as wide as the gap, so that all events of a cell are
    of one batch, and only the cell right before can belong to it too.  Cells
    come of a map-side combine; they are chained in blocks, and the blocks of a
    project by one row each, so that no task holds a project.  An event finds
    its batch by an equi-join on its cell.
    """
    us = F.unix_micros("ts")
    keyed = rows.select("project", "path", "op", us.alias("us"), F.floor(us / width).alias("cell"))
    cells = keyed.groupBy("project", "cell").agg(F.min("us").alias("lo"), F.max("us").alias("hi")).withColumn("block", F.floor(F.col("cell") / BLOCK))
    inside = Window.partitionBy("project", "block").orderBy("cell")
    across = Window.partitionBy("project").orderBy("block")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    tails = cells.groupBy("project", "block").agg(F.max("hi").alias("tail")).select("project", "block", F.lag("tail").over(across).alias("before"))
    marked = cells.join(tails, ["project", "block"]).withColumn("last", F.coalesce(F.lag("hi").over(inside), "before"))
    begins = F.when(F.col("last").isNull() | (F.col("lo") - F.col("last") > width), F.col("lo"))
    marked = marked.withColumn("own", F.last(begins, True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    carried = marked.groupBy("project", "block").agg(F.max("own").alias("own")).select("project", "block", F.last("own", True).over(before).alias("carried"))
    placed = marked.join(carried, ["project", "block"]).select("project", "cell", "hi", F.coalesce("own", "carried").alias("start"))
    last = keyed.join(placed.drop("hi"), ["project", "cell"]).groupBy("project", "start", "path").agg(F.max(F.struct("us", "op")).alias("last"))
    paths = last.groupBy("project", "start").agg(F.collect_list(F.struct("path", F.col("last.op").alias("op"))).alias("paths"))
    ends = placed.groupBy("project", "start").agg((F.max("hi") + width).alias("end"))
    return paths.join(ends, ["project", "start"])


def _open_batches(rows: DataFrame, width: int) -> DataFrame:
    """Batches of a stream. The state of a project is its open batches with one event, the last, for each path."""
    ship(rows.sparkSession)

    def step(key, frames, state):
        import pandas as pd

        held = json.loads(state.get[0]) if state.exists else []  # [start, end, {path: [us, op]}], apart from each other
        for f in frames:
            for us, path, op in zip(f["us"].tolist(), f["path"].tolist(), f["op"].tolist()):
                start, end, paths, rest = us, us + width, {path: [us, op]}, []
                for h in held:
                    if h[1] < start or h[0] > end:
                        rest.append(h)
                        continue
                    start, end = min(start, h[0]), max(end, h[1])
                    for p, e in h[2].items():
                        paths[p] = max(paths.get(p, e), e)
                held = [*rest, [start, end, paths]]
        mark = state.getCurrentWatermarkMs() * 1000
        done, held = [h for h in held if h[1] <= mark], [h for h in held if h[1] > mark]
        if held:
            state.update((json.dumps(held),))
            state.setTimeoutTimestamp(max(min(h[1] for h in held) // 1000, mark // 1000) + 1)
        elif state.exists:
            state.remove()
        out = [(key[0], start, end, [{"path": p, "op": e[1]} for p, e in paths.items()]) for start, end, paths in done]
        yield pd.DataFrame(out, columns=["project", "start", "end", "paths"])

    schema = "project string, start long, end long, paths array<struct<path: string, op: string>>"
    timed = rows.select("project", "path", "op", F.unix_micros("ts").alias("us"), "ts")
    return timed.groupBy("project").applyInPandasWithState(step, schema, "held string", "append", "EventTimeTimeout")


def follow(batched: DataFrame, apply: Callable[[str, list[str], list[str]], None], checkpoint: str | None = None):
    """Start a query that hands each closed batch of a stream to ``apply(project, modified, deleted)``, such as ``index.apply_batch``: only its paths are looked at."""

    def each(df: DataFrame, _: int) -> None:
        for r in df.orderBy("start").toLocalIterator():
            apply(r["project"], r["modified"], r["deleted"])

    return batched.writeStream.outputMode("append").option("checkpointLocation", checkpoint or shared_folder(batched.sparkSession)).foreachBatch(each).start()


def watch(spark: SparkSession, root: str, project: str, apply: Callable[[ProjectFiles], None], every: str = "500 milliseconds", checkpoint: str | None = None):
    """Start a query that at each tick hands the files of a folder to ``apply``, such as ``index.refresh``, which lists them and reads those with another time.

    A listing sees deletions, which a file stream doesn't.
    """
    files = ProjectFiles(spark, root, project)
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = ticks.writeStream.trigger(processingTime=every).foreachBatch(lambda _, __: apply(files))
    return writer.option("checkpointLocation", checkpoint or shared_folder(spark)).start()


class LatestOnly:
    """Runs searches so that a newer request cancels the older: each runs under its own job tag."""

    def __init__(self, spark: SparkSession):
        self.spark, self.generation = spark, 0

    def run(self, action: Callable[[], object]) -> object:
        """The result of the action; None if a newer request has come meanwhile."""
        if self.generation:
            self.spark.interruptTag(f"search-{self.generation}")
        self.generation += 1
        own = self.generation
        tag = f"search-{own}"
        self.spark.addTag(tag)
        try:
            out = action()
        finally:
            self.spark.removeTag(tag)
        return out if own == self.generation else None
