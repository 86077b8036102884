"""Names of tables, columns and aliases in a SQL text (T-SQL first, other dialects as far as they agree).

A tokenizer and one pass with a stack of clauses.  Only the first statement of a
script counts (statements end at a semicolon); names keep their spelling, without
qualifiers and marks; common table expressions are no tables; nothing is raised,
and text that is no SQL gives no names.  Procedures and functions are always empty.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import ascii_fold
from ..schemas import OBJECT_TYPES

_LEX = re.compile(
    r"(?P<blank>[\s﻿]+|--[^\r\n]*)|(?P<open>/\*)|(?P<text>[Nn]?'(?:[^']|'')*')|(?P<quoted>\[(?:[^\]]|\]\])+\]|\"(?:[^\"]|\"\")+\"|`[^`]+`)"
    r"|(?P<num>\d[\w.]*)|(?P<var>@@?[\w$#@]+)|(?P<word>#{0,2}[^\W\d][\w$#@]*)|(?P<op>[<>!]=|<>|::|\|\||[-+*/%&|^~=<>(),.;:])"
)
_EDGE = re.compile(r"/\*|\*/")
# Words that are no column or alias without quotes.
WORDS = set(
    "SELECT FROM WHERE GROUP BY HAVING ORDER ASC DESC AND OR NOT IN IS NULL LIKE BETWEEN EXISTS CASE WHEN THEN ELSE END AS ON USING JOIN INNER LEFT RIGHT FULL "
    "OUTER CROSS APPLY UNION ALL EXCEPT INTERSECT DISTINCT TOP PERCENT WITH TIES INSERT INTO VALUES UPDATE SET DELETE MERGE MATCHED OUTPUT OVER PARTITION ROWS "
    "RANGE UNBOUNDED PRECEDING FOLLOWING CURRENT ROW LIMIT OFFSET FETCH NEXT FIRST ONLY FOR OPTION DECLARE EXEC EXECUTE IF WHILE BEGIN RETURN PRINT GO CREATE "
    "ALTER DROP TABLE VIEW INDEX PROCEDURE FUNCTION TRIGGER DEFAULT COLLATE ESCAPE ANY SOME PIVOT UNPIVOT TABLESAMPLE RECURSIVE RETURNING LATERAL NATURAL "
    "TRUE FALSE ILIKE SIMILAR CAST TRY_CAST CONVERT TRY_CONVERT CURRENT_TIMESTAMP CURRENT_DATE CURRENT_TIME WITHIN FILTER WINDOW USE TRUNCATE GRANT".split()
)
# Functions whose first argument is a date part or a type.
_PART_FIRST = {"DATEADD", "DATEDIFF", "DATEDIFF_BIG", "DATEPART", "DATENAME", "DATETRUNC", "DATE_BUCKET", "CONVERT", "TRY_CONVERT"}
_JOINS = {"JOIN", "INNER", "LEFT", "RIGHT", "FULL", "OUTER", "CROSS", "NATURAL"}


def _tokens(sql: str) -> list[tuple[str, str, str]] | None:
    """(kind, capitals, name) of the first statement; None for text that is no SQL."""
    out, at = [], 0
    while at < len(sql):
        m = _LEX.match(sql, at)
        if not m:
            return None
        kind, s, at = m.lastgroup, m[0], m.end()
        if kind == "open":
            depth = 1
            while depth:
                c = _EDGE.search(sql, at)
                if not c:
                    return out
                depth += 1 if c[0] == "/*" else -1
                at = c.end()
        elif kind == "op" and s == ";":
            if out:
                break
        elif kind == "quoted":
            out.append(("name", "", s[1:-1].replace("]]", "]") if s[0] == "[" else s[1:-1].replace(s[0] * 2, s[0])))
        elif kind == "word":
            out.append(("word", s.upper(), s))
        elif kind != "blank":
            out.append((kind, s, s))
    return out


def extract(sql: str | None) -> dict[str, set[str]]:
    """table, column, alias, procedure, function: sets of names. Blank or null text gives empty sets."""
    found: dict[str, set[str]] = {k: set() for k in ("table", "column", "alias", "procedure", "function")}
    if not sql or not sql.strip():
        return found
    toks = _tokens(sql)
    if not toks:
        return found
    tables, columns, aliases, ctes = found["table"], found["column"], found["alias"], set()
    n = len(toks)
    cap = lambda i: toks[i][1] if i < n else ""
    kind = lambda i: toks[i][0] if i < n else ""

    def is_name(i: int) -> bool:
        return kind(i) == "name" or kind(i) == "word" and cap(i) not in WORDS

    def path(i: int) -> tuple[str, int]:
        """Last part of a dotted name and the index behind it."""
        last = toks[i][2]
        i += 1
        while cap(i) == "." and i + 1 < n:
            if cap(i + 1) == ".":
                i += 1
                continue
            if kind(i + 1) in ("name", "word"):
                last = toks[i + 1][2]
            elif cap(i + 1) == "*":
                last = "*"
            else:
                break
            i += 2
        return last, i

    def skip(i: int) -> int:
        """Index behind the bracket that opens at i."""
        depth = 0
        while i < n:
            depth += (cap(i) == "(") - (cap(i) == ")")
            i += 1
            if not depth:
                break
        return i

    i = 0
    mode, stack, ended = "expr", [], False  # mode: expr, table; ended: an operand is complete
    fresh = True  # at the start of a select item
    while i < n:
        k, c, s = toks[i]
        if k == "word" and c == "WITH" and (i == 0 or mode == "expr") and (is_name(i + 1) or cap(i + 1) == "RECURSIVE"):
            i += 1 + (cap(i + 1) == "RECURSIVE")
            while is_name(i):
                ctes.add(toks[i][2])
                i += 1
                if cap(i) == "(":
                    i = skip(i)
                if cap(i) != "AS":
                    break
                i += 1
                while cap(i) in ("NOT", "MATERIALIZED"):
                    i += 1
                break
            stack.append(("cte", "expr")) if cap(i) == "(" else None
            i += cap(i) == "("
            mode, ended, fresh = "expr", False, True
            continue
        if c == "(":
            if mode == "table":
                stack.append(("source", "after"))
                mode = "table" if cap(i + 1) not in ("SELECT", "WITH", "VALUES") else "expr"
            else:
                stack.append(("expr", mode))
                mode = "expr"
            ended = fresh = False
            i += 1
            continue
        if c == ")":
            was, back = stack.pop() if stack else ("expr", "expr")
            i += 1
            mode, ended = back, True
            if was == "cte":
                mode, ended = "expr", False
                if cap(i) == "," and is_name(i + 1):
                    ctes.add(toks[i + 1][2])
                    i += 2
                    if cap(i) == "(":
                        i = skip(i)
                    i += cap(i) == "AS"
                    if cap(i) == "(":
                        stack.append(("cte", "expr"))
                        i += 1
            elif was == "source":
                mode = "after"
                i += cap(i) == "AS"
                if is_name(i):  # alias of a derived table is no alias of a table
                    i += 1
                    if cap(i) == "(":
                        i = skip(i)
            continue
        if k == "word" and c in ("FROM", "JOIN", "APPLY", "USING", "INTO", "UPDATE", "MERGE") or k == "word" and c == "DELETE" and (is_name(i + 1) or cap(i + 1) == "TOP"):
            inner = stack and stack[-1][0] == "expr" and c in ("FROM", "USING") and mode == "expr" and ended and stack[-1][1] != "sub" and not _selects(toks, i)
            i += 1
            if inner:  # EXTRACT(x FROM y)
                ended = False
                continue
            if c in ("UPDATE", "DELETE") and cap(i) == "TOP":
                i = skip(i + 1) if cap(i + 1) == "(" else i + 2
                i += cap(i) == "FROM"
            mode, ended, insert = "table", False, c == "INTO"
            if c == "USING" and cap(i) == "(" and cap(i + 1) != "SELECT":
                i, mode = skip(i), "after"
                continue
            if insert and is_name(i):
                name, i = path(i)
                tables.add(name)
                if cap(i) == "(" and cap(i + 1) not in ("SELECT", "WITH"):
                    i = skip(i)
                mode = "expr"
            continue
        if mode == "table" and (k in ("name", "word") and c not in WORDS):
            name, i = path(i)
            if cap(i) == "(":
                i = skip(i)  # table function
                name = ""
            if name:
                tables.add(name)
            if cap(i) == "AS" and is_name(i + 1):
                i += 1
            if is_name(i) and cap(i) not in ("GO",):
                if name:
                    aliases.add(toks[i][2])
                i += 1
            if cap(i) == "WITH" and cap(i + 1) == "(" or cap(i) == "(" and cap(i + 1) == "NOLOCK":
                i = skip(i + (cap(i) == "WITH"))
            mode, ended = "after", True
            continue
        if k == "var":
            mode, ended, fresh = ("after" if mode == "table" else mode), True, False
            i += 1
            continue
        if c == ",":
            mode = "table" if mode == "after" else mode
            ended, fresh = False, True
            i += 1
            continue
        if k == "word" and c in WORDS:
            i += 1
            if c in ("WHERE", "ON", "HAVING", "BY", "SET", "WHEN", "SELECT", "OUTPUT", "RETURNING", "VALUES", "LIMIT", "OFFSET", "UNION", "EXCEPT", "INTERSECT", "GROUP", "ORDER"):
                mode = "expr"
            ended, fresh = c in ("END", "NULL"), c == "SELECT"
            if c == "TOP":
                i = skip(i) if cap(i) == "(" else i + 1
                fresh = True
            elif c in ("DISTINCT", "ALL"):
                fresh = True
            elif c == "AS":
                if stack and stack[-1][0] == "expr" and _casts(toks, i):
                    while i < n and cap(i) != ")":
                        i = skip(i) if cap(i) == "(" else i + 1
                elif is_name(i) or kind(i) == "text":
                    i += 1
                ended = True
            elif c in _PART_FIRST and cap(i) == "(":
                i = _after_first(toks, i)
                stack.append(("expr", mode))
                mode, ended = "expr", False
            elif c == "OPTION" and cap(i) == "(":
                i = skip(i)
            elif c == "COLLATE":
                i += 1
                ended = True
            continue
        if k in ("name", "word"):
            if mode == "after":
                i += 1
                continue
            if ended and cap(i + 1) not in (".", "("):
                i += 1  # alias without AS
                continue
            if fresh and cap(i + 1) == "=":
                i += 2  # alias = expression
                fresh = False
                continue
            name, j = path(i)
            if cap(j) == "(":
                if toks[j - 1][1] in _PART_FIRST:
                    i = _after_first(toks, j)
                    stack.append(("expr", mode))
                    ended = False
                else:
                    i, ended = j, False
            else:
                columns.add(name)
                i, ended = j, True
            fresh = False
            continue
        i += 1
        ended, fresh = k in ("num", "text"), False
    found["table"] = tables - ctes
    found["alias"] = aliases - ctes
    if not any(t[0] == "word" and t[1] in ("SELECT", "INSERT", "UPDATE", "DELETE", "MERGE", "WITH") for t in toks):
        return {k: set() for k in found}
    return found


def _selects(toks, i: int) -> bool:
    """Whether the bracket that holds token i begins with SELECT."""
    depth = 0
    for j in range(i - 1, -1, -1):
        c = toks[j][1]
        if c == ")":
            depth += 1
        elif c == "(":
            if not depth:
                return toks[j + 1][1] in ("SELECT", "WITH")
            depth -= 1
    return True


def _casts(toks, i: int) -> bool:
    """Whether the bracket that holds token i belongs to CAST."""
    depth = 0
    for j in range(i - 1, -1, -1):
        c = toks[j][1]
        if c == ")":
            depth += 1
        elif c == "(":
            if not depth:
                return j > 0 and toks[j - 1][1] in ("CAST", "TRY_CAST")
            depth -= 1
    return False


def _after_first(toks, i: int) -> int:
    """Index behind the first comma of the arguments that open at i."""
    depth = 0
    for j in range(i, len(toks)):
        c = toks[j][1]
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 1 or not depth:
            return j + 1
    return len(toks)


OBJECTS = T.StructType([T.StructField(k, T.ArrayType(T.StringType())) for k in ("table", "column", "alias", "procedure", "function")])


@F.pandas_udf(OBJECTS)
def extracted(bodies):
    """Sorted names of each type; Arrow batches, a repeated text is read once."""
    import pandas as pd

    seen: dict = {}
    for b in bodies:
        if b not in seen:
            try:
                seen[b] = tuple(sorted(v) for v in extract(b).values())
            except (IndexError, RecursionError):
                seen[b] = ([], [], [], [], [])
    return pd.DataFrame([seen[b] for b in bodies], columns=OBJECTS.names)


# Not deterministic to the optimizer: a filter on its result would otherwise run it twice.
extracted = extracted.asNondeterministic()


def live_objects(queries: DataFrame) -> DataFrame:
    """project, id and a sorted array for each type of names, read again from the bodies: aliases aren't stored, so an opened file gets them this way."""
    return queries.select("project", "id", extracted("body").alias("o")).select("project", "id", "o.*")


def objects_text(objects: Column) -> Column:
    """All names, type by type in order, joined by one blank: the text that full-text search sees."""
    return F.array_join(F.concat(*[F.array_sort(objects[k]) for k in OBJECTS.names]), " ")


def object_rows(df: DataFrame, objects: str = "objects") -> DataFrame:
    """project, query_id, object_type, object_name, object_key as the index stores them.

    Aliases are not stored, and of names that differ only in ASCII case the smallest stays.
    """
    def typed(kind: str) -> Column:
        return F.transform(F.col(f"{objects}.{kind}"), lambda x: F.struct(F.lit(kind).alias("object_type"), x.alias("object_name")))

    rows = df.select("project", F.col("id").alias("query_id"), F.explode(F.concat(*map(typed, OBJECT_TYPES))).alias("o")).select("project", "query_id", "o.*")
    return dedupe(rows, ["project", "query_id"])


def dedupe(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (keys, type, name without case): types outside the fixed four and null names vanish."""
    good = rows.where(F.col("object_type").isin(*OBJECT_TYPES) & F.col("object_name").isNotNull())
    return good.groupBy(*keys, "object_type", ascii_fold(F.col("object_name")).alias("object_key")).agg(F.min("object_name").alias("object_name")).select(*keys, "object_type", "object_name", "object_key")
