"""Whole results of the pN_ queries on small fixtures."""

from itertools import combinations

import pytest

from lexigrid.llm import pairs
from lexigrid.llm.garbled import SINGLE_AS, is_garbled
from lexigrid.llm.personal import redact
from lexigrid.llm.queries import QUERIES
from lexigrid.llm.sqlgrammar import check

from .test_garbled import CLEAN, _misread


def test_every_pair_has_a_lift(spark, tmp_path):
    baskets = {k: {f"t{k % 7}", f"t{k % 5}", f"u{k}"} for k in range(30)}
    rows = [(k, i) for k, items in baskets.items() for i in items]
    spark.createDataFrame(rows, "query_id long, object_name string").write.parquet(f"{tmp_path}/query_objects.parquet")
    spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "query_id long, tag_id long").write.parquet(f"{tmp_path}/query_tags.parquet")
    got = [(r["field"], r["item_a"], r["item_b"], r["n_ab"], r["n_a"], r["n_b"], r["n"]) for r in QUERIES["p1_all_lift"](spark, str(tmp_path)).collect()]
    both = {p for items in baskets.values() for p in combinations(sorted(items), 2)}
    has = lambda *items: sum(items_ >= set(items) for items_ in baskets.values())
    want = {("object_name", a, b, has(a, b), has(a), has(b), 30) for a, b in both} | {("tag_id", "1", "2", 1, 2, 1, 2)}
    assert set(got) == want and len(got) == len(want)


def test_no_row_holds_a_long_basket(spark):
    rows = [(0, f"t{k}") for k in range(1500)] + [(1, "t1"), (1, "t2"), (2, "t3")]
    kept = spark.createDataFrame(rows, "b long, i string")
    met = pairs._chunked(kept)
    assert met.count() == 1500 * 1499 // 2 + 1 == met.distinct().count() + 1
    assert pairs._chunks(kept).selectExpr("max(size(items))").first()[0] < 2 * pairs.CHUNK


VALID = [
    ("tsql", "CREATE VIEW v AS SELECT a FROM t"), ("tsql", "CREATE OR ALTER VIEW dbo.v (a, b) WITH SCHEMABINDING AS SELECT a, b FROM dbo.t WHERE a > 1 WITH CHECK OPTION"),
    ("tsql", "CREATE TABLE #t (id INT IDENTITY(1,1) NOT NULL PRIMARY KEY, a NVARCHAR(MAX) NULL DEFAULT (N'x'), b DECIMAL(10,2) CHECK (b > 0), c AS a + 'y' PERSISTED, CONSTRAINT fk FOREIGN KEY (a) REFERENCES o (id) ON DELETE CASCADE ON UPDATE SET NULL) ON [PRIMARY]"),
    ("tsql", "CREATE TABLE dbo.t (a int NOT NULL CONSTRAINT df DEFAULT getdate(), b date, CONSTRAINT pk PRIMARY KEY CLUSTERED (a ASC, b DESC) WITH (PAD_INDEX = OFF) ON [PRIMARY])\nGO\nSELECT 1"),
    ("tsql", "DROP TABLE IF EXISTS #t SELECT a INTO #t FROM o DROP TABLE #t"), ("tsql", "DROP TABLE #t\nCREATE TABLE #u (a int)\nINSERT INTO #u VALUES (1)\nCREATE INDEX ix ON #u (a) WITH (FILLFACTOR = 80)\nSELECT * FROM #u"),
    ("tsql", "ALTER TABLE t ADD a int NULL, b date"), ("tsql", "ALTER TABLE t WITH NOCHECK ADD CONSTRAINT c CHECK (a > 1)"), ("tsql", "ALTER TABLE t DROP COLUMN a, b"), ("tsql", "ALTER TABLE t ALTER COLUMN a nvarchar(50) NOT NULL"), ("tsql", "ALTER TABLE t DROP CONSTRAINT c SELECT 1"),
    ("tsql", "ALTER TABLE t ADD CONSTRAINT df DEFAULT (0) FOR a"), ("tsql", "ALTER TABLE t NOCHECK CONSTRAINT ALL"), ("tsql", "ALTER TABLE t SET (LOCK_ESCALATION = AUTO)"), ("tsql", "ALTER DATABASE d SET SINGLE_USER WITH ROLLBACK IMMEDIATE"),
    ("tsql", "GRANT SELECT, INSERT, EXECUTE ON dbo.t TO u SELECT 1"), ("tsql", "WAITFOR DELAY '00:00:01' SELECT 1"), ("tsql", "DROP INDEX IF EXISTS ix ON t"), ("tsql", "BULK INSERT t FROM 'f' WITH (FIRSTROW = 2)"), ("tsql", "BACKUP DATABASE d TO DISK = 'x' WITH INIT"),
    ("tsql", "CREATE PROCEDURE dbo.p @a int = 0, @b nvarchar(10) = NULL OUTPUT WITH RECOMPILE AS BEGIN SET NOCOUNT ON; SELECT @a; IF @a > 1 RETURN 1 END"), ("tsql", "CREATE PROC p AS SELECT 1\nGO\nEXEC p"),
    ("tsql", "CREATE FUNCTION f (@a int) RETURNS int WITH EXECUTE AS OWNER AS BEGIN DECLARE @x int = 1; RETURN @a + @x END"), ("tsql", "CREATE FUNCTION f () RETURNS TABLE AS RETURN (SELECT a FROM t)"),
    ("tsql", "CREATE TRIGGER tr ON t AFTER INSERT, UPDATE AS BEGIN UPDATE t SET a = 1 END"), ("tsql", "DECLARE c CURSOR LOCAL FAST_FORWARD FOR SELECT a FROM t OPEN c FETCH NEXT FROM c INTO @a WHILE @@FETCH_STATUS = 0 BEGIN PRINT @a FETCH NEXT FROM c INTO @a END CLOSE c DEALLOCATE c"),
    ("tsql", "MERGE INTO t AS x USING (SELECT 1 AS a) AS s ON x.a = s.a WHEN MATCHED AND s.a > 1 THEN UPDATE SET x.b = s.a WHEN NOT MATCHED BY TARGET THEN INSERT (a) VALUES (s.a) WHEN NOT MATCHED BY SOURCE THEN DELETE OUTPUT inserted.a;"),
    ("postgres", "MERGE INTO t USING s ON t.a = s.a WHEN MATCHED THEN DO NOTHING WHEN NOT MATCHED THEN INSERT (a) VALUES (s.a)"),
    ("postgres", "CREATE OR REPLACE VIEW v AS SELECT a FROM t"), ("postgres", "CREATE MATERIALIZED VIEW IF NOT EXISTS v AS SELECT a FROM t WITH NO DATA"), ("postgres", "EXPLAIN (ANALYZE, BUFFERS) SELECT 1"), ("postgres", "EXPLAIN ANALYZE SELECT 1"), ("postgres", "PREPARE p (int) AS SELECT $1"),
    ("postgres", "CREATE TABLE IF NOT EXISTS t (id bigint GENERATED ALWAYS AS IDENTITY PRIMARY KEY, a text NOT NULL DEFAULT 'x'::text, b timestamp with time zone DEFAULT now(), c int REFERENCES o (id) ON DELETE SET NULL, UNIQUE (a, b), EXCLUDE USING gist (a WITH =)) WITH (fillfactor = 70)"),
    ("postgres", "CREATE TEMP TABLE t AS SELECT 1"), ("postgres", "CREATE TABLE t (a, b) AS SELECT 1, 2"), ("postgres", "CREATE TABLE p PARTITION OF t FOR VALUES FROM (1) TO (2)"), ("postgres", "DROP TABLE IF EXISTS a, b CASCADE"), ("postgres", "ALTER TABLE t ADD COLUMN IF NOT EXISTS a int DEFAULT 0, DROP COLUMN b, ALTER COLUMN c SET NOT NULL"),
    ("postgres", "ALTER TABLE t OWNER TO u"), ("postgres", "DECLARE c CURSOR WITH HOLD FOR SELECT 1"), ("postgres", "CREATE FUNCTION f() RETURNS int LANGUAGE sql AS $$ SELECT 1 $$"), ("postgres", "CREATE INDEX CONCURRENTLY i ON t (lower(a)) WHERE b > 1"),
    ("sqlite", "CREATE TABLE t (a, b INTEGER PRIMARY KEY AUTOINCREMENT, c TEXT DEFAULT 'x' COLLATE NOCASE, d REAL CHECK (d > 0), FOREIGN KEY (a) REFERENCES o (id)) STRICT"), ("sqlite", "CREATE TABLE t AS SELECT 1"), ("sqlite", "CREATE TEMP VIEW IF NOT EXISTS v (a) AS SELECT 1"),
    ("sqlite", "CREATE TRIGGER g AFTER UPDATE OF a ON t FOR EACH ROW WHEN new.a > 1 BEGIN UPDATE t SET b = 1; SELECT 1; END"), ("sqlite", "EXPLAIN QUERY PLAN SELECT 1"), ("sqlite", "ALTER TABLE t RENAME COLUMN a TO b"), ("sqlite", "ALTER TABLE t ADD COLUMN c INTEGER NOT NULL DEFAULT 0"), ("sqlite", "DROP VIEW IF EXISTS v"),
]
INVALID = [
    ("tsql", "CREATE VIEW v AS SELECT FROM WHERE"), ("sqlite", "CREATE VIEW v AS SELECT FROM WHERE"), ("postgres", "CREATE VIEW v AS SELECT a FROM WHERE"), ("tsql", "CREATE TABLE t (a int,, b)"), ("postgres", "CREATE TABLE t (a int,, b int)"), ("sqlite", "CREATE TABLE t (a int,, b)"),
    ("tsql", "MERGE INTO t WHEN"), ("postgres", "MERGE INTO t WHEN"), ("tsql", "MERGE t USING s ON t.a = s.a WHEN MATCHED THEN INSERT (a) VALUES (1);"), ("tsql", "DROP TABLE #t SELECT a FROM WHERE"), ("tsql", "DROP TABLE #t\nSELECT a FROM t WHERE\nGO"), ("tsql", "CREATE PROC p AS BEGIN SELECT FROM t END"),
    ("tsql", "CREATE PROC p @a int AS"), ("tsql", "CREATE FUNCTION f (@a int) RETURNS int AS BEGIN RETURN @a + END"), ("postgres", "EXPLAIN SELECT a FROM"), ("sqlite", "EXPLAIN SELECT a FROM"), ("postgres", "PREPARE p AS SELEC 1"), ("tsql", "DECLARE c CURSOR FOR SELECT FROM t"),
    ("tsql", "WAITFOR DELAY '00:00:01' SELECT FROM t"), ("tsql", "GRANT SELECT ON t TO u SELECT FROM t"), ("postgres", "DROP TABLE a b"), ("sqlite", "ALTER TABLE t ADD"), ("tsql", "ALTER TABLE t ADD a int NOT"), ("sqlite", "CREATE TRIGGER g AFTER UPDATE ON t BEGIN SELECT FROM t; END"), ("postgres", "CREATE TABLE t (a int CHECK (a >))"),
]


@pytest.mark.parametrize("dialect, text", VALID)
def test_definitions_that_parse(dialect, text):
    assert check(text, dialect)[:2] == (True, "")


@pytest.mark.parametrize("dialect, text", INVALID)
def test_definitions_that_do_not_parse(dialect, text):
    assert not check(text, dialect)[0]


# The word of the test can't be written in these.
CYRILLIC = {"cp1251", "koi8_r", "cp866"}


@pytest.mark.parametrize("rest", ["-- não\n", "├── staging\n", "月次 一覧\n"])
@pytest.mark.parametrize("wrong", ["cp1252", "latin-1"])
def test_cyrillic_swap_of_a_part(rest, wrong):
    bad = _misread("описание", wrong, "cp1251")
    for text in (f"{rest}SELECT 1 -- {bad} x\n", f"{rest[:-1]} {bad} x"):
        assert is_garbled(text)[:2] == (True, text.replace(bad, "описание"))


@pytest.mark.parametrize("rest", ["-- não\n", "├── staging\n", "月次 一覧\n", "👩🏽‍💻 wrote it\n", "-- Größe – “held”\n"])
@pytest.mark.parametrize("wrong, meant", [p for p in SINGLE_AS if p[1] not in CYRILLIC])
def test_one_byte_swap_of_a_part(rest, wrong, meant):
    bad = _misread("descrição", wrong, meant)
    for text in (f"{rest}SELECT 1 -- {bad} x\n", f"{rest[:-1]} {bad} x"):
        assert is_garbled(text)[:2] == (True, text.replace(bad, "descrição"))


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_in_parts_stays(text):
    for other in CLEAN:
        both = f"{text}\n{other} {text}"
        assert is_garbled(both) == (False, both, "")


@pytest.mark.parametrize(
    "text, want",
    [
        ("Falei com Sr. Maria Clara de Souza Lima ontem", "Falei com Sr. [NAME] ontem"),
        ("Ana Paula da Silva Santos ligou", "[NAME] ligou"),
        ("Sr. Juan Carlos de la Cruz", "Sr. [NAME]"),
        ("Dear Maria Clara Souza Lima Santos Pereira, thanks", "Dear [NAME], thanks"),
        ("SRA. MARIA CLARA DE SOUZA LIMA SANTOS", "SRA. [NAME]"),
        ("Sr. J. P. Souza Lima Costa Neto", "Sr. [NAME]"),
        ("Dear Anna Smith The Report By Maria Clara Souza", "Dear [NAME] The Report By [NAME]"),
    ],
)
def test_names_of_any_length(text, want):
    assert redact(text) == want


DEEP = [
    ("tsql", "IF @a = 1 SELECT 1 " + "ELSE IF @a = 2 SELECT 2 " * 600 + "ELSE SELECT 3"),
    *[(d, "SELECT " + "(" * 600 + "1" + ")" * 600) for d in ("tsql", "postgres", "sqlite")],
    *[(d, "SELECT " + "CASE WHEN a = 1 THEN " * 300 + "1" + " END" * 300 + " FROM t") for d in ("tsql", "postgres", "sqlite")],
    ("tsql", "BEGIN " * 400 + "SELECT 1 " + "END " * 400),
]


@pytest.mark.parametrize("dialect, text", DEEP)
def test_deep_nesting_gets_an_answer(dialect, text):
    assert check(text, dialect)[:2] == (True, "")
    assert not check(text[:-1] if text[-1] == ")" else text + " WHERE )", dialect)[0]
