"""p5: dialects, SQLite's own parser as judge, and causes."""

import random
import sqlite3

import pytest

from lexigrid.llm.sqlgrammar import check, common_tokens, tokens
from lexigrid.llm.syntax import diagnose, invalid_files, invalid_rates, rank

T, P, S = "tsql", "postgres", "sqlite"
VALID = [
    ("", "*"), ("-- only\n/* notes */", "*"), ("SELECT 1", "*"), ("SELECT a.x, b.y AS z FROM t AS a JOIN u b ON a.id = b.id WHERE a.k IN (1, 2) AND b.n IS NOT NULL ORDER BY 1 DESC;", "*"),
    ("WITH a AS (SELECT 1 AS x) SELECT x FROM a UNION ALL SELECT 2", "*"), ("INSERT INTO t (a, b) VALUES (1, 'it''s'), (2, NULL)", "*"), ("UPDATE t SET a = a + 1 WHERE b BETWEEN 1 AND 2", "*"),
    ("DELETE FROM t WHERE x <> 'a'", "*"), ("SELECT CASE WHEN x > 1 THEN 'a' ELSE 'b' END, COUNT(*) FROM t GROUP BY x HAVING COUNT(1) > 3", "*"), ("﻿SELECT 1", "*"),
    ("SELECT TOP (10) [a].[b] FROM [dbo].[t] AS [a]\nGO\nSELECT 2\ngo", T), ("SET NOCOUNT ON; DECLARE @d date = '2024-01-01'; SELECT x = @d", T), ("/* a /* b */ c */ SELECT 1", T), ("/* a /* b */ c */ SELECT 1", P),
    ("SELECT 1 SELECT 2", T), ("SELECT a FROM t CROSS APPLY (SELECT TOP 1 b FROM u) AS v", T), ("IF @a > 1 BEGIN PRINT 'x' END ELSE PRINT 'y'", T), ("BEGIN TRY SELECT 1 END TRY BEGIN CATCH THROW; END CATCH", T),
    ("SELECT x::int, a[1], $$it's$$ FROM t LIMIT 5 OFFSET 2", P), ("SELECT DISTINCT ON (a) a FROM t WHERE b ILIKE 'x%' RETURNING", None), ("INSERT INTO t VALUES (1) ON CONFLICT (id) DO UPDATE SET a = 1 RETURNING *", P),
    ("SELECT EXTRACT(year FROM d), now() - INTERVAL '1 day', CAST('1' AS numeric(10, 2)) FROM t FETCH FIRST 3 ROWS ONLY", P), ("SELECT `a`, [b], \"c\" FROM t LIMIT 3, 4", S), ("INSERT OR REPLACE INTO t VALUES (1)", S),
    ("SELECT a == 1, b GLOB 'x*' FROM t NATURAL JOIN u", S), ("SELECT ROW_NUMBER() OVER (PARTITION BY a ORDER BY b ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM t", "*"), ("-- <<<<<<< in a note\nSELECT '\n=======\n'", "*"),
]
INVALID = [
    ("SELECT", T), ("SELECT a FROM", "*"), ("SELECT a FROM t WHERE", "*"), ("SELECT a, FROM t", "*"), ("SELECT 'open", "*"), ("SELECT (1", "*"), ("AND a = 1", "*"), ("JOIN t ON a = b", "*"), ("SELECT a FROM t GROUP", "*"),
    ("<<<<<<< HEAD\nSELECT 1\n=======\nSELECT 2\n>>>>>>> x", "*"), ("SELECT 1 /* open", T), ("SELECT 1 /* open", P), ("SELECT 1 LIMIT 5", T), ("SELECT TOP 5 a FROM t", P), ("SELECT TOP 5 a FROM t", S), ("SELECT [a] FROM t", P),
    ("SELECT 1 SELECT 2", P), ("SELECT 1 SELECT 2", S), ("SELECT 1\nGO\nSELECT 2", P), ("SELECT 1\nGO\nSELECT 2", S), ("/* a /* b */ c */ SELECT 1", S), ("SELECT a FROM t JOIN u AS b", T), ("SELECT a FROM t JOIN u AS b", P),
    ("<html><body>x</body></html>", "*"), ("{\"a\": 1}", "*"), ("name: x\nsteps:\n  - y", "*"), ("import os\nprint(1)", "*"), ("INSERT INTO t (a, b VALUES (1)", "*"), ("UPDATE t SET WHERE a = 1", "*"), ("SELECT CASE WHEN 1 = 1 THEN 2 FROM t", "*"),
    ("SELECT a FROM t WHERE b = 1 AND", "*"), ("SELECT a FROM t WHERE a.b", T), ("SELECT a b c FROM t", "*"), ("GO SELECT", P),
]


# Definitions, permissions, settings and maintenance, one statement in a row.
VALID += [
    (x, T)
    for x in """CREATE TABLE dbo.t (a int NOT NULL IDENTITY(1, 1) PRIMARY KEY, b nvarchar(max) NULL, c AS a + 1) WITH (DATA_COMPRESSION = PAGE) ON [PRIMARY]
CREATE UNIQUE NONCLUSTERED INDEX ix ON dbo.t (a ASC, b DESC) INCLUDE (c) WHERE a > 0 WITH (ONLINE = ON, FILLFACTOR = 80) ON fg
CREATE CLUSTERED COLUMNSTORE INDEX cx ON t
DROP INDEX IF EXISTS ix ON dbo.t, iy ON u
DROP PROCEDURE IF EXISTS dbo.p, dbo.r SELECT 1
GRANT SELECT, UPDATE (a, b) ON OBJECT::dbo.t TO reader, [writer] WITH GRANT OPTION
GRANT VIEW DEFINITION TO r
DENY EXECUTE ON SCHEMA::dbo TO public
REVOKE SELECT ON t FROM reader CASCADE
CREATE SCHEMA x AUTHORIZATION dbo
CREATE SEQUENCE dbo.s AS bigint START WITH 1 INCREMENT BY 2 NO CYCLE
CREATE TYPE dbo.list AS TABLE (id int NOT NULL)
CREATE SYNONYM a FOR db.dbo.b
CREATE USER u FOR LOGIN l WITH DEFAULT_SCHEMA = dbo
ALTER ROLE db_datareader ADD MEMBER u
ALTER INDEX ALL ON dbo.t REBUILD WITH (ONLINE = ON)
ALTER TABLE t ADD CONSTRAINT df DEFAULT (0) FOR a
ALTER TABLE t NOCHECK CONSTRAINT ALL
ALTER DATABASE CURRENT SET RECOVERY SIMPLE
OPEN c FETCH NEXT FROM c INTO @a, @b CLOSE c DEALLOCATE c
WAITFOR DELAY '00:00:05'
DBCC CHECKDB ('x') WITH NO_INFOMSGS
UPDATE STATISTICS dbo.t WITH FULLSCAN
SET TRANSACTION ISOLATION LEVEL READ UNCOMMITTED
BACKUP DATABASE d TO DISK = 'x.bak' WITH INIT
BULK INSERT t FROM 'x.csv' WITH (FIELDTERMINATOR = ',', FIRSTROW = 2)
CREATE PROCEDURE p @a int = 1 AS BEGIN SELECT @a FROM t END
DROP TABLE #a SELECT 1""".split("\n")
]
VALID += [
    (x, P)
    for x in """CREATE UNIQUE INDEX CONCURRENTLY IF NOT EXISTS ix ON s.t USING btree (lower(a) text_pattern_ops DESC NULLS LAST, b) INCLUDE (c) WITH (fillfactor = 70) WHERE b > 1
CREATE TABLE t (a int, b text) PARTITION BY RANGE (a)
CREATE TABLE t1 PARTITION OF t FOR VALUES FROM (1) TO (MAXVALUE_)
DROP FUNCTION IF EXISTS f(int, text), g CASCADE
GRANT SELECT, INSERT ON ALL TABLES IN SCHEMA public TO reader
GRANT ALL PRIVILEGES ON TABLE s.t TO GROUP g WITH GRANT OPTION
GRANT a TO b
REVOKE GRANT OPTION FOR SELECT ON t FROM PUBLIC CASCADE
CREATE FUNCTION f(a int, b text DEFAULT 'x') RETURNS TABLE(c int) LANGUAGE plpgsql STABLE AS $$ BEGIN RETURN; END $$
CREATE OR REPLACE PROCEDURE p(INOUT a int) LANGUAGE sql AS 'SELECT 1'
CREATE TRIGGER tr BEFORE INSERT OR UPDATE OF a, b ON t FOR EACH ROW WHEN (NEW.a > 1) EXECUTE FUNCTION f()
CREATE TYPE mood AS ENUM ('a', 'b')
ALTER TYPE mood ADD VALUE IF NOT EXISTS 'c' AFTER 'b'
CREATE DOMAIN d AS int CHECK (VALUE > 0)
CREATE EXTENSION IF NOT EXISTS pg_trgm WITH SCHEMA x
CREATE SEQUENCE IF NOT EXISTS s INCREMENT BY 1 OWNED BY t.a
CREATE ROLE r WITH LOGIN NOSUPERUSER PASSWORD 'x' VALID UNTIL '2030-01-01'
CREATE POLICY p ON t FOR SELECT TO r USING (a = 1)
ALTER TABLE t ALTER COLUMN a TYPE bigint USING a::bigint, ALTER b SET NOT NULL, DROP COLUMN IF EXISTS c CASCADE
ALTER TABLE t RENAME COLUMN a TO b
ALTER TABLE t OWNER TO r
ALTER TABLE t ENABLE ROW LEVEL SECURITY
ALTER INDEX ix RENAME TO iy
COMMENT ON COLUMN t.a IS 'x'
COPY t (a, b) FROM STDIN WITH (FORMAT csv, HEADER true)
COPY (SELECT 1) TO 'x.csv'
VACUUM (VERBOSE, ANALYZE) t
ANALYZE t (a, b)
REFRESH MATERIALIZED VIEW CONCURRENTLY v WITH NO DATA
SET search_path TO a, public
SET LOCAL TIME ZONE 'UTC'
SHOW ALL
DO LANGUAGE plpgsql $$ BEGIN END $$
CALL p(1, 'x')
LOCK TABLE t IN ACCESS EXCLUSIVE MODE NOWAIT
BEGIN ISOLATION LEVEL SERIALIZABLE, READ ONLY; ROLLBACK TO SAVEPOINT a; COMMIT AND CHAIN
TRUNCATE TABLE a, b RESTART IDENTITY CASCADE""".split("\n")
]
VALID += [
    (x, S)
    for x in """CREATE UNIQUE INDEX IF NOT EXISTS ix ON t (a COLLATE NOCASE DESC, lower(b)) WHERE a > 1
CREATE VIRTUAL TABLE t USING fts5(a, b)
PRAGMA journal_mode = WAL; PRAGMA main.table_info('t'); PRAGMA optimize
ATTACH DATABASE 'x.db' AS x; DETACH x
BEGIN IMMEDIATE; SAVEPOINT a; RELEASE SAVEPOINT a; ROLLBACK TRANSACTION TO a; END
DROP TRIGGER IF EXISTS main.tr
VACUUM INTO 'x.db'; REINDEX t; ANALYZE""".split("\n")
]
INVALID += [
    (x, "*")
    for x in """CREATE TABLE t a int
CREATE TABLE t (a b c d ,, )
DROP TABLE
DROP banana t
CREATE INDEX
CREATE INDEX ix ON t
CREATE INDEX ix t (a)
CREATE INDEX ix ON t (a b c d)
GRANT banana banana
GRANT SELECT ON t
GRANT SELECT t TO
MERGE INTO
CREATE PROCEDURE p AS BEGIN SELECT FROM WHERE END
CREATE VIEW v AS SELECT FROM WHERE
CREATE banana x
ALTER TABLE t banana
ALTER TABLE t ADD
ALTER banana x
CREATE""".split("\n")
]
INVALID += [(x, T) for x in ["CREATE DOMAIN d AS int", "FETCH NEXT c", "ALTER INDEX ix REBUILD", "CREATE TYPE t", "SET TRANSACTION ISOLATION LEVEL banana", "DROP TABLE #a SELECT FROM", "WAITFOR 5", "COPY t FROM 'x'"]]
INVALID += [(x, P) for x in ["CREATE FUNCTION f() RETURNS int", "CREATE TYPE m AS ENUM (a)", "COMMENT ON TABLE t", "SET x", "SET x =", "COPY t", "REFRESH VIEW v", "LOCK t IN banana MODE", "BEGIN banana banana", "CREATE TRIGGER t ON x", "VACUUM t (", "CREATE SYNONYM a FOR b", "REVOKE SELECT ON t TO"]]
INVALID += [(x, S) for x in ["PRAGMA", "PRAGMA a =", "ATTACH 'x'", "CREATE VIRTUAL TABLE t", "BEGIN banana", "GRANT SELECT ON t TO u", "CREATE SCHEMA x", "DROP SCHEMA x"]]


@pytest.mark.parametrize("text, dialect", VALID)
def test_valid(text, dialect):
    for d in (T, P, S) if dialect == "*" else (dialect,) if dialect else ():
        assert check(text, d)[0], (d, check(text, d))


@pytest.mark.parametrize("text, dialect", INVALID)
def test_invalid(text, dialect):
    for d in (T, P, S) if dialect == "*" else (dialect,):
        assert not check(text, d)[0], d


def test_sqlite_agrees():
    """Random token soup and cuts of valid statements: the same verdict as SQLite's parser."""
    con = sqlite3.connect(":memory:")
    r = random.Random(4)
    seeds = [t for t, d in VALID if d in ("*", S) and t.strip() and ";" not in t and "--" not in t and t.isascii()]
    n = wrong = 0
    for _ in range(4000):
        words = r.choice(seeds).split(" ")
        how = r.random()
        if how < 0.4:
            words = words[: r.randint(1, len(words))]
        elif how < 0.7 and len(words) > 2:
            del words[r.randrange(len(words))]
        elif len(words) > 2:
            a, b = r.randrange(len(words)), r.randrange(len(words))
            words[a], words[b] = words[b], words[a]
        text = " ".join(words)
        try:
            con.execute("EXPLAIN " + text)
            want = True
        except sqlite3.Error as e:
            want = not any(x in str(e) for x in ("syntax error", "unrecognized token", "incomplete input"))
        n += 1
        wrong += check(text, S)[0] != want
    assert wrong <= n // 200, (wrong, n)


def test_deep_and_long():
    assert check("SELECT " + "(" * 100 + "1" + ")" * 100, T)[0]
    assert not check("SELECT " + "(" * 5000 + "1", P)[0]
    assert check("SELECT " + ", ".join(f"c{k}" for k in range(20000)) + " FROM t", S)[0]
    assert tokens("SELECT 1", T)[0] == ["SELECT", "0"]


@pytest.mark.parametrize(
    "text, dialect, cause, language",
    [
        ("<html><body>x</body></html>", T, "wrong extension", "html"),
        ('{"a": [1, 2]}', P, "wrong extension", "json"),
        ("import os\n\nprint(os.name)\n", S, "wrong extension", "python"),
        ("SELECT TOP (5) [a] FROM t", P, "wrong extension", T),
        ("<<<<<<< HEAD\nSELECT 1\n=======\n>>>>>>> x", T, "conflict", T),
        ("SELECT a FROM t WHERE a =", T, "truncated", T),
        ("AND a.is_active = 5 ORDER BY a.b", T, "corrupt", T),
    ],
)
def test_causes(text, dialect, cause, language):
    assert diagnose(text, dialect)[:3] == (False, cause, language)


def test_rank_and_unknown_dialect():
    assert next(iter(rank("SELECT TOP 5 x FROM dbo.t"))) == T and next(iter(rank("<html></html>"))) == "html"
    assert diagnose("SELECT 1 LIMIT 2", None)[0] and not diagnose("SELECT 1 FROM", "mystery")[0] and diagnose(None, None)[0]


def test_common_tokens_are_those_of_each_dialect():
    r = random.Random(6)
    parts = ["a", "t1", "N", "x", " ", "\n", "'it''s'", "\"q\"", "1", "1.5", ".5", "1e3", "1.", "..", "-", "--c\n", "/* c */", "/* /* */", "=", "<>", "!=", "<", ">", "+", "*", "/", "(", ")", ",", ";", "$", "@v", "#t", "GO\n", "é", "_", "[b]", "::", "\u00a0"]
    n = 0
    for _ in range(30000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 9)))
        known = common_tokens(text)
        if known:
            n += 1
            assert all(tokens(text, d) == known for d in (T, P, S)), text
    assert n > 3000


def test_every_grammar_is_tried():
    """Also of valid files, and of languages without a token of theirs."""
    assert diagnose("SELECT a FROM t", T) == (True, "", T, [P, S, T]) and diagnose("SELECT a FROM t LIMIT 1", S)[3] == [P, S]
    assert diagnose("x = 1\ny = x", T)[1:] == ("wrong extension", "python", ["python"])
    assert diagnose("a;b\n1;2\n3;4", P)[1:3] == ("wrong extension", "csv")


@pytest.mark.parametrize("text", ["SELECT FROM t WHERE => 3", "SELECT a FROM (t WHERE b = 1", "const"])
def test_one_token_tells_no_language(text):
    assert diagnose(text, T)[1] in ("corrupt", "truncated")


def test_files(spark):
    rows = [(1, "p", T, "SELECT 1"), (2, "p", T, "SELECT"), (2, "p", T, "SELECT"), (3, "r", S, None), (4, "p", "TSQL", "GO"), (5, "r", P, "x" * 200000)]
    df = spark.createDataFrame(rows, "id long, project string, dialect string, body string")
    assert sorted(r[0] for r in invalid_files(df).collect()) == [2, 5]
    got = {(r["project"], r["dialect"]): (r["files"], r["invalid"], r["rate"]) for r in invalid_rates(df).collect()}
    assert got[("p", T)] == (2, 1, 0.5) and got[("r", S)] == (1, 0, 0.0) and got[("r", P)] == (1, 1, 1.0)
    assert invalid_files(df.limit(0)).count() == 0
