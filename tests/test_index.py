"""Full rebuild, incremental refresh, upsert and delete; statistics and collections."""

import os
import random

from lexigrid.operators import collections as c
from lexigrid.operators import index
from lexigrid.operators.search import search
from lexigrid.sources.files import ProjectFiles
from lexigrid.sources.store import Store


def _write(root, rel, text, mtime=None):
    p = root / rel
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)
    if mtime:
        os.utime(p, (mtime, mtime))


def _state(store, projects=None):
    rows = lambda name, *c: {tuple(r) for r in store.read(name, projects).select(*c).collect()}
    q = rows("queries", "project", "rel_path", "title", "body", "file_mtime")
    return q, rows("query_tags", "query_id", "tag"), rows("query_objects", "query_id", "object_type", "object_name"), rows("fts", "query_id", "objects"), rows("postings", "query_id", "field", "pos", "token", "d"), rows("statistics", "project", "n", "mean")


def _dirs(store, project):
    return {name: t["parts"].get(project) for name, t in store.meta()["tables"].items()}


def _text(k):
    return f"/* ---\ntitle: T{k}\ntags: [A, b{k % 3}]\n--- */\nSELECT c{k} FROM t{k % 4} x"


def test_projects_are_apart(spark, tmp_path):
    """A refresh or rebuild of one project neither changes nor rewrites another."""
    store = Store(spark, str(tmp_path / "s"))
    files = {p: ProjectFiles(spark, str(tmp_path / p), p) for p in ("one", "o'two x=%")}
    for p, f in files.items():
        for k in range(4):
            _write(tmp_path / p, f"q{k}.sql", _text(k), 1_700_000_000 + k)
        assert index.refresh(store, f) == 4
    assert store.projects() == sorted(files)
    other, dirs = _state(store, ["o'two x=%"]), _dirs(store, "o'two x=%")
    assert index.refresh(store, files["one"]) == 0
    _write(tmp_path / "one", "q1.sql", _text(9), 1_700_000_100)
    (tmp_path / "one" / "q2.sql").unlink()
    assert index.refresh(store, files["one"]) == 2
    index.rebuild(store, files["one"])
    assert _state(store, ["o'two x=%"]) == other and _dirs(store, "o'two x=%") == dirs
    assert len(_state(store)[0]) == 7
    before = _dirs(store, "one")
    os.utime(tmp_path / "one" / "q3.sql", (1_700_000_200,) * 2)
    assert index.refresh(store, files["one"]) == 0  # touched: only the table of files is written
    after = _dirs(store, "one")
    assert {n for n in before if before[n] != after[n]} == {"queries"}
    assert {r["project"] for r in search(index.catalog(store), "t").select("folder").withColumnRenamed("folder", "project").collect()} == set(files)
    store.drop_project("o'two x=%")
    assert store.projects() == ["one"] and len(_state(store)[0]) == 3


def test_bytes_are_read_of_changed_files_only(spark, tmp_path):
    root = tmp_path / "p"
    for k in range(3):
        _write(root, f"q{k}.sql", _text(k), 1_700_000_000)
    asked = []

    class Spy(ProjectFiles):
        def read(self, paths):
            asked.append(sorted(r["rel_path"] for r in paths.select("rel_path").collect()))
            return super().read(paths)

    store = Store(spark, str(tmp_path / "s"))
    index.refresh(store, ProjectFiles(spark, str(root), "p"))
    _write(root, "q1.sql", _text(5), 1_700_000_050)
    _write(root, "new.sql", _text(6), 1_700_000_050)
    _write(root, "q2.sql", _text(7), 1_700_000_000)  # the same second: not seen unless hashes are compared
    assert index.refresh(store, Spy(spark, str(root), "p")) == 2 and asked == [["new.sql", "q1.sql"]]
    assert index.refresh(store, ProjectFiles(spark, str(root), "p"), verify_hash=True) == 1


def test_vanished_file_stays(spark, tmp_path):
    root = tmp_path / "p"
    for k in range(2):
        _write(root, f"q{k}.sql", _text(k), 1_700_000_000)

    class Vanishing(ProjectFiles):
        def listed(self):
            return self.at(["q0.sql", "q1.sql", "never.sql"])

    store = Store(spark, str(tmp_path / "s"))
    index.refresh(store, ProjectFiles(spark, str(root), "p"))
    (root / "q1.sql").unlink()
    assert index.refresh(store, Vanishing(spark, str(root), "p")) == 0 and len(_state(store)[0]) == 2
    assert index.refresh(store, ProjectFiles(spark, str(root), "p")) == 1


def test_batch_of_events(spark, tmp_path):
    root = tmp_path / "p"
    for k in range(4):
        _write(root, f"q{k}.sql", _text(k), 1_700_000_000)
    store, files = Store(spark, str(tmp_path / "s")), ProjectFiles(spark, str(root), "p")
    index.refresh(store, files)
    _write(root, "q0.sql", _text(10), 1_700_000_000)
    _write(root, "n.sql", _text(11), 1_700_000_000)
    _write(root, "unnamed.sql", _text(12), 1_700_000_000)
    (root / "q1.sql").unlink()
    assert index.apply_batch(store, files, ["q0.sql", "n.sql", "q3.sql", "lost.sql"], ["q1.sql", "none.sql"]) == 3
    assert {r[1]: r[2] for r in _state(store)[0]} == {"q0.sql": "T10", "n.sql": "T11", "q2.sql": "T2", "q3.sql": "T3"}
    assert index.apply_batch(store, files, [], []) == 0


def test_migration_and_settings(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert not store.compatible() and not store.migrate() and store.read("queries") is None
    index.rebuild(store, ProjectFiles(spark, str(tmp_path / "none"), "p"))
    assert store.compatible() and store.read("queries").count() == 0
    store._flip(store.meta() | {"schema_version": "1"})
    assert not store.compatible() and store.migrate()
    assert store.read("favorites").count() == 0 and store.read("recent").columns == ["project", "rel_path", "viewed_at"]
    store.folder.replace(f"{store.root}/current.json", "{broken")
    assert store.meta() == {} and not store.compatible()


def test_refresh_equals_rebuild(spark, tmp_path):
    root, r = tmp_path / "files", random.Random(5)
    body = lambda k: f"/* ---\ntitle: T{k}\ntags: [A, b{k % 3}]\n--- */\nSELECT c{k} FROM t{k % 4} x"
    for k in range(12):
        _write(root, f"d{k % 3}/q{k}.sql", body(k), 1_700_000_000 + k)
    a = Store(spark, str(tmp_path / "a"))
    assert index.refresh(a, ProjectFiles(spark, str(root), "p")) == 12
    assert index.refresh(a, ProjectFiles(spark, str(root), "p")) == 0
    for turn in range(2):
        names = sorted(os.listdir(root / "d0")) + sorted(os.listdir(root / "d1"))
        _write(root, "d0/" + sorted(os.listdir(root / "d0"))[0], body(100 + turn), 1_700_001_000 + turn)
        gone = root / "d1" / sorted(os.listdir(root / "d1"))[0]
        gone.unlink()
        touched = root / "d2" / sorted(os.listdir(root / "d2"))[0]
        os.utime(touched, (1_700_002_000 + turn,) * 2)
        _write(root, f"new/n{turn}.sql", body(200 + r.randint(0, 9)), 1_700_003_000 + turn)
        assert names
        assert index.refresh(a, ProjectFiles(spark, str(root), "p")) == 3
        b = Store(spark, str(tmp_path / f"b{turn}"))
        index.rebuild(b, ProjectFiles(spark, str(root), "p"))
        assert _state(a) == _state(b)
    assert a.compatible() and a.meta()["last_full_scan"] and a.vacuum() > 0
    assert _state(a) == _state(b)
    a.drop_project("p")
    assert a.read("queries").count() == 0


def test_diff(spark):
    old = spark.createDataFrame([("p", "same", 1, "h"), ("p", "touch", 1, "h"), ("p", "edit", 1, "h"), ("p", "gone", 1, "h"), ("p", "late", 1, "h"), ("p", "none", None, "h")], "project string, rel_path string, file_mtime long, content_hash string")
    new = spark.createDataFrame([("p", "same", 1, "h"), ("p", "touch", 2, "h"), ("p", "edit", 2, "x"), ("p", "new", 1, "h"), ("p", "late", 1, "x"), ("p", "none", None, "h")], "project string, rel_path string, file_mtime long, content_hash string")
    got = {r["rel_path"]: r["action"] for r in index.diff(new, old).collect()}
    assert got == {"same": "skip", "touch": "touch", "edit": "replace", "gone": "delete", "new": "insert", "late": "skip", "none": "skip"}
    assert index.changed_count(index.diff(new, old)) == 3
    assert {r["rel_path"]: r["action"] for r in index.diff(new, old, True).collect()}["late"] == "replace"
    assert index.diff(new.limit(0), old.limit(0)).count() == 0


def test_delete_cascades(spark):
    q = spark.createDataFrame([("p", "a", 1), ("p", "b", 2)], "project string, rel_path string, id long")
    t = spark.createDataFrame([("p", 1, "x"), ("p", 2, "y")], "project string, query_id long, tag string")
    out = index.delete({"queries": q, "query_tags": t}, q.where("rel_path = 'a'"))
    assert [r["id"] for r in out["queries"].collect()] == [2] and [r["tag"] for r in out["query_tags"].collect()] == ["y"]


def test_collections(spark):
    q = spark.createDataFrame([("p", "a", 1), ("p", "b", 2)], "project string, rel_path string, id long")
    stars = spark.createDataFrame([("p", "a"), ("p", "a"), ("p", "lost")], "project string, rel_path string")
    assert [r["id"] for r in c.favorites(q, stars).collect()] == [1]
    assert c.is_favorite(stars, "p", "a") and not c.is_favorite(stars, "p", "b")
    after = c.toggle(stars, spark.createDataFrame([("p", "a"), ("p", "b")], "project string, rel_path string"))
    assert {r["rel_path"] for r in after.collect()} == {"lost", "b"}
    views = spark.createDataFrame([("p", f"f{k:02}", k) for k in range(30)] + [("p", "f00", 99), ("p", "none", None)], "project string, rel_path string, viewed_at long")
    last = c.last_views(views, ["project", "rel_path"])
    top = [r["rel_path"] for r in c.top_recent(last, "project").orderBy("viewed_at", ascending=False).collect()]
    assert len(top) == 20 and top[:2] == ["f00", "f29"] and "none" not in top
    tags = spark.createDataFrame([("b",), ("a",), ("b",)], "tag string")
    assert [r["tag"] for r in c.all_tags(tags).collect()] == ["a", "b"]
    assert [r["tag"] for r in c.suggestions(tags.distinct(), tags.where("tag = 'a'"), "B").collect()] == ["b"]
    names = spark.createDataFrame([("p", 1, "x"), ("p", 2, "x"), ("p", 3, "y")], "project string, id long, stem string")
    assert {r["file_name"] for r in c.unique_names(names, "stem", "id").collect()} == {"x.sql", "x_1.sql", "y.sql"}
    assert [tuple(r) for r in c.recent_projects(views.unionByName(views.where("viewed_at = 3").withColumn("project", c.F.lit("q")))).collect()] == [("p", 99), ("q", 3)]
    assert c.file_total(q.limit(0)).first()[0] == 0


def test_every_row_gets_a_free_name(spark, monkeypatch):
    """Against one row at a time: numbers that are taken or are plain names of other stems are passed over; large groups are cut."""
    monkeypatch.setattr(c, "WHOLE", 5)
    monkeypatch.setattr(c, "CUTS", 4)
    r = random.Random(8)
    stems = ["x"] * 6 + ["x_1", "x_2", "x_2", "x_1_1", "y", "y_3", "z"]
    rows = [(r.choice("ab"), k * 3, r.choice(stems)) for k in range(200)]
    taken = [("a", "x.sql"), ("a", "x_3.sql"), ("a", "x_1.sql"), ("b", "y_1.sql"), ("b", "free.sql")]
    df = spark.createDataFrame(rows, "project string, id long, stem string")
    for names in ([], taken):
        t = spark.createDataFrame(names, "project string, file_name string") if names else None
        got = {(x["project"], x["id"]): x["file_name"] for x in c.unique_names(df, "stem", "id", t).collect()}
        want, held = {}, set(names)
        first = {}
        for p, k, s in rows:
            if (p, s) not in first and (p, f"{s}.sql") not in held:
                first[p, s] = k
                want[p, k] = f"{s}.sql"
        held |= {(p, f"{s}.sql") for p, _, s in rows}
        for p, k, s in rows:
            n = 1
            if (p, k) not in want:
                while (p, f"{s}_{n}.sql") in held:
                    n += 1
                held.add((p, f"{s}_{n}.sql"))
                want[p, k] = f"{s}_{n}.sql"
        assert got == want and len(set((p, v) for (p, _), v in got.items())) == len(rows)
    three = spark.createDataFrame([("p", 1, "x"), ("p", 2, "x"), ("p", 3, "x_1")], df.schema)
    got = c.unique_names(three, "stem", "id", spark.createDataFrame([("p", "x.sql")], "project string, file_name string"))
    assert sorted(x["file_name"] for x in got.collect()) == ["x_1.sql", "x_2.sql", "x_3.sql"]


def test_stats(spark):
    q = spark.createDataFrame([("p", 1), ("p", 2), ("r", 3)], "project string, id long")
    links = spark.createDataFrame([("p", 1, "a"), ("p", 2, "a"), ("r", 3, "b")], "project string, query_id long, tag string")
    objs = spark.createDataFrame([("p", 1, "table", "T", "t"), ("r", 3, "table", "t", "t"), ("p", 1, "column", "c", "c")], "project string, query_id long, object_type string, object_name string, object_key string")
    stars = spark.createDataFrame([("p", "lost")], "project string, rel_path string")
    got = {r["project"]: r.asDict() for r in c.project_stats(q, links, objs, stars).collect()}
    assert got["p"] == {"project": "p", "queries": 2, "tags": 1, "favorites": 1, "tables": 1, "columns": 1} and got["r"]["favorites"] == 0
    total = {r["statistic"]: r["value"] for r in c.global_stats(q, links, objs, stars).collect()}
    assert total == {"queries": 3, "folders": 2, "tags": 2, "favorites": 1, "tables": 2, "columns": 1}
