"""Search strings, filters, orders and results."""

import datetime

import pytest

from lexigrid.operators import search as s

CORPUS = [
    (1, "silos.sql", "Silo levels", "Adds up what each silo holds", "SELECT held FROM farm.Silos", ["grain", "daily"], ["Silos"], ["held"]),
    (2, "belts.sql", "Belt plan", "Every belt", "SELECT belt_no, pace FROM farm.Belts", ["daily"], ["Belts"], ["belt_no", "pace"]),
    (3, "kilns.sql", "Kiln register", None, "SELECT label, heat FROM Kilns", ["register"], ["Kilns"], ["label", "heat"]),
]
NOON = int(datetime.datetime(2031, 5, 9, 12, tzinfo=datetime.timezone.utc).timestamp())


@pytest.fixture(scope="module")
def cat(spark):
    q = spark.createDataFrame(
        [("p", i, path, t, d, b, NOON + 86400 * (i - 1), None) for i, path, t, d, b, *_ in CORPUS],
        "project string, id long, rel_path string, title string, description string, body string, file_mtime long, updated_at string",
    )
    links = spark.createDataFrame([(r[0], t) for r in CORPUS for t in r[5]], "query_id long, tag string")
    objs = spark.createDataFrame(
        [(r[0], k, n, n.lower()) for r in CORPUS for k, ns in (("table", r[6]), ("column", r[7])) for n in ns], "query_id long, object_type string, object_name string, object_key string"
    )
    stars = spark.createDataFrame([("p", "belts.sql"), ("p", "gone.sql")], "project string, rel_path string")
    fts = spark.createDataFrame([("p", r[0], r[2], r[3], r[4], " ".join(r[6] + r[7])) for r in CORPUS], "project string, query_id long, title string, description string, body string, objects string")
    return s.Catalog(q, links, objs, stars, fts)


@pytest.mark.parametrize(
    "text, ids",
    [
        ("", [3, 2, 1]),
        ("silo", [1]),
        ("regist", [3]),
        ("tag:grain", [1]),
        ("tag:DAILY", [2, 1]),
        ("table:Silos", [1]),
        ("table:sILOS", [1]),
        ("col:pace", [2]),
        ("tag:daily silo", [1]),
        ("qqqnone", []),
        ("NOT NEAR", []),
        ("table:Belts table:Silos", []),
        ("table:farm.Belts", []),
        ("date:09/05/2031", [1]),
        ("date:9/5/2031 tag:daily", [1]),
        ("date:09/05/2031 date:10/05/2031", []),
        ("date:2031-05-09", [3, 2, 1]),
        ("  ", [3, 2, 1]),
        ("hel", [1]),
        ('si"lo', []),
    ],
)
def test_search(cat, text, ids):
    assert [r["query_id"] for r in s.search(cat, text).collect()] == ids


def test_result(cat):
    r = s.search(cat, "belt").first()
    assert (r["query_id"], r["tags"], r["tables"], r["is_favorite"], r["folder"], r["description"]) == (2, ["daily"], ["Belts"], True, "p", "Every belt")
    assert r["rank"] < 0 and r["snippet"] == "SELECT [belt]_no, pace FROM farm.[Belts]"
    assert s.search(cat, "").where("query_id = 3").first()["description"] == ""
    assert s.search(cat, "", limit=1).count() == 1


def test_stored_index_gives_the_same(spark, cat):
    index = s.Catalog(cat.queries, cat.links, cat.objects, cat.favorites, cat.fts, s.fts.postings(cat.fts), s.fts.statistics(cat.fts))
    for text in ("belt", "farm daily", "se la", "tag:daily se", 'a"b', "belt_n", "--"):
        for limit in (None, 1, 2):
            assert s.search(index, text, limit).collect() == s.search(cat, text, limit).collect()


def test_limited_search_looks_up_by_id(cat):
    plan = s.search(cat, "se", 2)._jdf.queryExecution().toString()
    assert "query_id" in plan and s.search(cat, "se", 2).count() == 2 and s.search(cat, "qqqnone", 2).count() == 0


def test_days_are_those_of_the_session(spark, cat):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name, away in (("America/Sao_Paulo", 3), ("+05:30", -5.5), ("UTC", 0)):
            spark.conf.set("spark.sql.session.timeZone", name)
            lo, hi = s.day_bounds("09/05/2031", s.session_zone(spark))
            assert (lo, hi) == (NOON - 43200 + away * 3600, NOON + 43199 + away * 3600)
            column = spark.createDataFrame([("09/05/2031",), ("31/02/2031",)], "d string")
            assert [tuple(r) for r in column.select(*s.day_column(s.F.col("d"))).collect()] == [(lo, hi), (None, None)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_sorts_and_palette(cat):
    everything = s.search(cat, "")
    order = lambda how: [r["query_id"] for r in s.sorted_results(everything, how).collect()]
    assert [order(x) for x in ("name_asc", "name_desc", "mtime_asc", "mtime_desc")] == [[2, 3, 1], [1, 3, 2], [1, 2, 3], [3, 2, 1]]
    ids = lambda text: sorted(r["query_id"] for r in s.palette(everything, text).collect())
    assert ids("elt") == [2] and ids("col:zzz") == [1, 2, 3] and ids("tag:Daily table:belts") == [2] and ids("ail") == [1, 2] and ids("date:10/05/2031") == [2]


def test_parse():
    assert s.parse("table:Belts tag:daily pace") == ({"table": ["Belts"], "col": [], "tag": ["daily"], "date": []}, "pace")
    assert s.parse("Table:x a:tag:y xtag:z") == ({"table": [], "col": [], "tag": [], "date": []}, "Table:x a:tag:y xtag:z")
    assert s.parse("col:a col:b")[0]["col"] == ["a", "b"]
    assert s.chip_search("column", "x") == "col:x" and s.chip_search("alias", "x") == "alias:x"


@pytest.mark.parametrize("day", ["2031-05-09", "tomorrow", "31/02/2031", "9/5/31", ""])
def test_no_day(day):
    assert s.day_bounds(day) is None


def test_day():
    lo, hi = s.day_bounds("09/05/2031")
    assert (lo, hi) == (NOON - 43200, NOON + 43199) and s.day_bounds("9/5/2031") == (lo, hi)


def test_objects_and_id(cat):
    assert s.objects_of(cat.objects, 2).first().asDict() == {"table": ["Belts"], "column": ["belt_no", "pace"], "procedure": [], "function": []}
    assert s.objects_of(cat.objects, 99).first()["table"] == []
    assert s.id_of(cat.queries, "p", "belts.sql").first()["id"] == 2
    assert s.id_of(cat.queries, "other", "belts.sql").count() == 0


def test_empty_catalog(cat):
    none = s.Catalog(*[df.limit(0) for df in (cat.queries, cat.links, cat.objects, cat.favorites, cat.fts)])
    assert s.search(none, "belt tag:x").count() == 0 and s.search(none, "").count() == 0


def test_one_project(cat):
    assert s.search(cat.of("p"), "belt").count() == 1 and s.search(cat.of("other"), "belt").count() == 0
