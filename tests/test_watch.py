"""Change events and debounced batches, in batch and as a stream."""

import time

from lexigrid.streaming import watch

SCHEMA = "project string, path string, op string, dest string, is_directory boolean, ts timestamp"


def _events(spark, rows):
    import datetime

    at = lambda ms: datetime.datetime(2026, 1, 1) + datetime.timedelta(milliseconds=ms)
    return spark.createDataFrame([("p", a, op, dest, False, at(ms)) for a, op, dest, ms in rows], SCHEMA)


ROWS = [
    ("a.sql", "created", None, 0),
    ("a.sql", "modified", None, 100),
    ("b.SQL", "deleted", None, 400),
    ("c.txt", "modified", None, 450),
    (".lexigrid/x.sql", "modified", None, 460),
    ("old.sql", "moved", "new.sql", 700),
    ("d.sql", "deleted", None, 3000),
    ("d.sql", "created", None, 3200),
    ("e.sql", "created", None, 3300),
    ("e.sql", "deleted", None, 3400),
]


def test_changes(spark):
    got = {(r["path"], r["op"]) for r in watch.changes(_events(spark, ROWS)).collect()}
    assert ("old.sql", "delete") in got and ("new.sql", "modify") in got and not any(p in ("c.txt", ".lexigrid/x.sql") for p, _ in got)


def test_batches(spark):
    got = [(r["modified"], r["deleted"]) for r in watch.batches(watch.changes(_events(spark, ROWS))).orderBy("start").collect()]
    assert got == [(["a.sql", "new.sql"], ["b.SQL", "old.sql"]), (["d.sql"], ["e.sql"])]
    assert watch.batches(watch.changes(_events(spark, ROWS[:1])).limit(0)).count() == 0


def _brute(rows, gap):
    """Batches one event at a time."""
    out = []
    for project in sorted({r[0] for r in rows}):
        held, last = None, None
        for _, path, op, at in sorted((r for r in rows if r[0] == project), key=lambda r: r[3]):
            if last is None or at - last > gap:
                held = {}
                out.append((project, held))
            held[path] = max(held.get(path, (at, op)), (at, op))
            last = at
    name = lambda held, op: sorted(p for p, (_, o) in held.items() if o == op)
    return sorted((p, name(h, "modify"), name(h, "delete")) for p, h in out)


def test_batches_as_one_by_one(spark, tmp_path, monkeypatch):
    """Random logs with long batches, events at cell and block edges and a project with most rows; as a stream in several files, out of order."""
    import datetime
    import random

    monkeypatch.setattr(watch, "BLOCK", 3)
    r = random.Random(4)
    rows = []
    for project, n in (("big", 400), ("small", 30), ("dense", 200)):
        at = 0
        for _ in range(n):
            at += r.choice([0, 1, 250, 499, 500, 501, 600, 1000, 1500] if project != "dense" else [1, 300, 500])
            rows.append((project, f"f{r.randint(0, 9)}.sql", r.choice(["modify", "delete"]), at))
    df = spark.createDataFrame([(p, f, op, datetime.datetime(2026, 1, 1) + datetime.timedelta(milliseconds=at)) for p, f, op, at in rows], "project string, path string, op string, ts timestamp")
    flat = lambda got: sorted((x["project"], x["modified"], x["deleted"]) for x in got)
    assert flat(watch.batches(df).collect()) == _brute(rows, 500)
    end = df.limit(0).unionByName(spark.createDataFrame([("end", "z.sql", "modify", datetime.datetime(2026, 1, 3))], df.schema))
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = watch.batches(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in")), watermark="1 day")
    q = stream.writeStream.format("memory").queryName("random_batches").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert flat(spark.table("random_batches").collect()) == _brute(rows, 500)


def test_follow(spark, tmp_path):
    """Events of a stream reach the index: a move takes the old path out and the new one in."""
    import os

    from lexigrid.operators import index
    from lexigrid.sources.files import ProjectFiles
    from lexigrid.sources.store import Store

    root = tmp_path / "p"
    root.mkdir()
    for name in ("a.sql", "old.sql", "d.sql"):
        (root / name).write_text(f"SELECT {name[0]} FROM t")
    store, files = Store(spark, str(tmp_path / "s")), ProjectFiles(spark, str(root), "p")
    index.refresh(store, files)
    os.rename(root / "old.sql", root / "new.sql")
    (root / "a.sql").write_text("SELECT changed FROM t")
    (root / "d.sql").unlink()
    events = _events(spark, [("a.sql", "modified", None, 0), ("old.sql", "moved", "new.sql", 10), ("d.sql", "deleted", None, 20), ("z.sql", "created", None, 60_000)])
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = watch.batches(watch.changes(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))), watermark="1 second")
    done = []
    q = watch.follow(stream, lambda project, modified, deleted: done.append((modified, deleted, index.apply_batch(store, files, modified, deleted))), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert done == [(["a.sql", "new.sql"], ["d.sql", "old.sql"], 4)]
    assert {(r["rel_path"], r["body"][:8]) for r in store.read("queries").collect()} == {("a.sql", "SELECT c"), ("new.sql", "SELECT o")}


def test_stream(spark, tmp_path):
    _events(spark, ROWS + [("z.sql", "created", None, 60_000)]).coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = watch.batches(watch.changes(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))), watermark="1 second")
    q = rows.writeStream.format("memory").queryName("batches").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [(r["modified"], r["deleted"]) for r in spark.table("batches").orderBy("start").collect()]
    assert got == [(["a.sql", "new.sql"], ["b.SQL", "old.sql"]), (["d.sql"], ["e.sql"])]  # the open session waits


def test_watch_lists_folder(spark, tmp_path):
    (tmp_path / "a.sql").write_text("SELECT 1")
    seen = []
    q = watch.watch(spark, str(tmp_path), "p", lambda files: seen.append(files.listed().count()))
    end = time.time() + 60
    while len(seen) < 2 and time.time() < end:
        time.sleep(0.3)
    q.stop()
    assert seen[:2] == [1, 1]


def test_latest_only(spark):
    runner = watch.LatestOnly(spark)
    assert runner.run(lambda: spark.range(5).count()) == 5
    assert runner.run(lambda: (setattr(runner, "generation", runner.generation + 1), 1)[1]) is None
