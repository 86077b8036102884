"""Names of tables, columns and aliases."""

import pytest

from lexigrid.operators.objects import dedupe, extract, extracted, live_objects, object_rows, objects_text

CASES = [
    # plain lists, schemas, aliases
    ("SELECT berth, draught FROM harbor.Vessels", {"Vessels"}, {"berth", "draught"}, set()),
    ("SELECT v.berth, m.grade FROM Vessels v JOIN Mooring m ON v.slip_no = m.slip", {"Vessels", "Mooring"}, {"berth", "grade", "slip_no", "slip"}, {"v", "m"}),
    ("SELECT * FROM harbor.Mooring", {"Mooring"}, set(), set()),
    ("SELECT * FROM [harbor].[Mooring]", {"Mooring"}, set(), set()),
    ("SELECT 7", set(), set(), set()),
    ("", set(), set(), set()),
    ("}} ?! ~~ {", set(), set(), set()),
    # common table expressions are no tables
    ("WITH late AS (SELECT slip FROM Mooring WHERE due < '2031-05-09') SELECT * FROM late JOIN Vessels w ON late.slip = w.slip_no", {"Mooring", "Vessels"}, {"slip", "due", "slip_no"}, {"w"}),
    ("WITH p AS (SELECT 4 AS n), r (m) AS (SELECT n FROM p) SELECT m FROM r", set(), {"n", "m"}, set()),
    # APPLY with a query of its own
    (
        "SELECT k.kiln_no, t.heat FROM works.Kilns AS k OUTER APPLY (SELECT TOP (3) heat FROM works.Firings f WHERE f.kiln_no = k.kiln_no ORDER BY f.lit_at) AS t",
        {"Kilns", "Firings"},
        {"kiln_no", "heat", "lit_at"},
        {"k", "f"},
    ),
    # changes
    ("INSERT INTO Ledger (entry) VALUES (12)", {"Ledger"}, set(), set()),
    ("UPDATE Silo SET level_cm=40 WHERE silo_no=3", {"Silo"}, {"level_cm", "silo_no"}, set()),
    ("DELETE FROM Traces WHERE seen_on < '2019-11-02'", {"Traces"}, {"seen_on"}, set()),
    # aliases of columns, inner queries, comments, casts, several statements
    ("SELECT g.load AS sum_load, MAX(h.tare) peak FROM gate g, hopper h -- FROM belt\nWHERE g.pin IN (SELECT pin FROM lock)", {"gate", "hopper", "lock"}, {"load", "tare", "pin"}, {"g", "h"}),
    ("SELECT CAST(mass AS decimal(9)), DATEADD(week, 2, due) FROM scale; SELECT q FROM other", {"scale"}, {"mass", "due"}, set()),
    ("SELECT /* a /* b */ z FROM none */ mass FROM scale WITH (NOLOCK)", {"scale"}, {"mass"}, set()),
    ("SELECT c.[net mass] FROM \"Grain Car\" c WHERE @lot = c.lot AND N'FROM x' = c.mark", {"Grain Car"}, {"net mass", "lot", "mark"}, {"c"}),
    ("SELECT top_load = g.load, gate.* FROM gate", {"gate"}, {"load", "*"}, set()),
]


@pytest.mark.parametrize("sql, tables, columns, aliases", CASES)
def test_extract(sql, tables, columns, aliases):
    got = extract(sql)
    assert (got["table"], got["column"], got["alias"]) == (tables, columns, aliases)
    assert got["procedure"] == got["function"] == set()


def test_never_raises():
    import random

    r = random.Random(1)
    words = "SELECT FROM ( ) , . JOIN ON a b [c] 'x' WITH AS CASE END = * ; TOP 1 CAST INSERT INTO VALUES".split()
    for _ in range(3000):
        extract(" ".join(r.choice(words) for _ in range(r.randint(1, 15))))
    assert extract(None)["table"] == set()


def test_rows_and_text(spark):
    df = spark.createDataFrame([("p", 1, "SELECT Id, ID, b FROM Zebra JOIN Alpha x ON 1 = 1"), ("p", 2, None)], "project string, id long, body string")
    df = df.withColumn("objects", extracted("body"))
    rows = {(r["query_id"], r["object_type"], r["object_name"], r["object_key"]) for r in object_rows(df).collect()}
    assert rows == {(1, "table", "Zebra", "zebra"), (1, "table", "Alpha", "alpha"), (1, "column", "ID", "id"), (1, "column", "b", "b")}
    texts = [r[0] for r in df.orderBy("id").select(objects_text(df["objects"])).collect()]
    assert texts == ["Alpha Zebra ID Id b x", ""]


def test_live_objects(spark):
    df = spark.createDataFrame([("p", 1, "SELECT v.a FROM Vessels v"), ("p", 2, None)], "project string, id long, body string")
    got = {r["id"]: (r["table"], r["alias"]) for r in live_objects(df).collect()}
    assert got == {1: (["Vessels"], ["v"]), 2: ([], [])}


def test_dedupe_folds_ascii_only(spark):
    rows = [(1, "table", "Ágil"), (1, "table", "ágil"), (1, "table", "b"), (1, "table", "B"), (1, "alias", "x"), (1, "table", None)]
    got = dedupe(spark.createDataFrame(rows, "query_id long, object_type string, object_name string"), ["query_id"])
    assert {r["object_name"] for r in got.collect()} == {"Ágil", "ágil", "B"}
