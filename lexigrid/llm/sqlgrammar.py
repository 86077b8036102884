"""Syntax check of SQL scripts in three dialects: a tokenizer and a predictive parser.

Only syntax counts; names are never looked up.  Queries, changes, tables, views,
T-SQL modules and SQLite triggers are here, other statements in
``sqldefinitions``.
"""

from __future__ import annotations

import re
import sys
import threading

from .sqldefinitions import Definitions

DIALECTS = ("tsql", "postgres", "sqlite")


# Fixed value: levels of nesting that the first parse follows.
CAP = 150
_DEEP = threading.Lock()


class Invalid(Exception):
    """Not a valid script; args: reason, token index."""


# Reserved words, which can't be names without quotes.
RESERVED = {
    "tsql": set(
        "ADD ALL ALTER AND ANY AS ASC AUTHORIZATION BACKUP BEGIN BETWEEN BREAK BROWSE BULK BY CASCADE CASE CHECK CHECKPOINT CLOSE CLUSTERED COALESCE "
        "COLLATE COLUMN COMMIT COMPUTE CONSTRAINT CONTAINS CONTAINSTABLE CONTINUE CONVERT CREATE CROSS CURRENT CURRENT_DATE CURRENT_TIME "
        "CURRENT_TIMESTAMP CURRENT_USER CURSOR DATABASE DBCC DEALLOCATE DECLARE DEFAULT DELETE DENY DESC DISK DISTINCT DISTRIBUTED DOUBLE DROP DUMP ELSE "
        "END ERRLVL ESCAPE EXCEPT EXEC EXECUTE EXISTS EXIT EXTERNAL FETCH FILE FILLFACTOR FOR FOREIGN FREETEXT FREETEXTTABLE FROM FULL FUNCTION GOTO "
        "GRANT GROUP HAVING HOLDLOCK IDENTITY IDENTITYCOL IDENTITY_INSERT IF IN INDEX INNER INSERT INTERSECT INTO IS JOIN KEY KILL LEFT LIKE LINENO LOAD "
        "MERGE NATIONAL NOCHECK NONCLUSTERED NOT NULL NULLIF OF OFF OFFSETS ON OPEN OPENDATASOURCE OPENQUERY OPENROWSET OPENXML OPTION OR ORDER OUTER OVER "
        "PERCENT PIVOT PLAN PRECISION PRIMARY PRINT PROC PROCEDURE PUBLIC RAISERROR READ READTEXT RECONFIGURE REFERENCES REPLICATION RESTORE RESTRICT "
        "RETURN REVERT REVOKE RIGHT ROLLBACK ROWCOUNT ROWGUIDCOL RULE SAVE SCHEMA SECURITYAUDIT SELECT SESSION_USER SET SETUSER SHUTDOWN SOME STATISTICS "
        "SYSTEM_USER TABLE TABLESAMPLE TEXTSIZE THEN TO TOP TRAN TRANSACTION TRIGGER TRUNCATE TRY_CONVERT TSEQUAL UNION UNIQUE UNPIVOT UPDATE UPDATETEXT "
        "USE USER VALUES VARYING VIEW WAITFOR WHEN WHERE WHILE WITH WRITETEXT".split()
    ),
    "postgres": set(
        "ALL ANALYSE ANALYZE AND ANY ARRAY AS ASC ASYMMETRIC BOTH CASE CAST CHECK COLLATE COLUMN CONSTRAINT CREATE CURRENT_CATALOG CURRENT_DATE "
        "CURRENT_ROLE CURRENT_TIME CURRENT_TIMESTAMP CURRENT_USER DEFAULT DEFERRABLE DESC DISTINCT DO ELSE END EXCEPT FALSE FETCH FOR FOREIGN FROM "
        "GRANT GROUP HAVING IN INITIALLY INTERSECT INTO LATERAL LEADING LIMIT LOCALTIME LOCALTIMESTAMP NOT NULL OFFSET ON ONLY OR ORDER PLACING PRIMARY "
        "REFERENCES RETURNING SELECT SESSION_USER SOME SYMMETRIC SYSTEM_USER TABLE THEN TO TRAILING TRUE UNION UNIQUE USER USING VARIADIC WHEN WHERE "
        "WINDOW WITH CROSS FULL INNER JOIN LEFT NATURAL OUTER RIGHT IS ISNULL LIKE ILIKE NOTNULL SIMILAR OVERLAPS TABLESAMPLE COLLATION CONCURRENTLY "
        "FREEZE VERBOSE BINARY AUTHORIZATION".split()
    ),
    "sqlite": set(
        "ADD ALL ALTER AND AS AUTOINCREMENT BETWEEN CASE CHECK COLLATE COMMIT CONSTRAINT CREATE DEFAULT DEFERRABLE DELETE DISTINCT DROP ELSE ESCAPE "
        "EXISTS FOREIGN FROM GROUP HAVING IN INDEX INSERT INTERSECT INTO IS ISNULL JOIN LIMIT NOT NOTHING NOTNULL NULL ON OR ORDER PRIMARY REFERENCES "
        "RETURNING SELECT SET TABLE THEN TO TRANSACTION UNION UNIQUE UPDATE USING VALUES WHEN WHERE EXCEPT CROSS FULL INNER LEFT NATURAL OUTER RIGHT "
        "WINDOW OVER FILTER".split()
    )
    - {"WINDOW", "OVER", "FILTER"},
}
# Words that begin a clause, so that they are no alias without AS.
NO_ALIAS = {
    "tsql": set(),
    "postgres": set("OVER FILTER WITHIN YEAR MONTH DAY HOUR MINUTE SECOND PRECISION VARYING WITHOUT CHAR CHARACTER".split()),
    "sqlite": set("WINDOW INDEXED OFFSET".split()),
}
# Words after which an expression may stand as a function although they are reserved.
CALLABLE = {
    "tsql": set("COALESCE NULLIF LEFT RIGHT CONVERT TRY_CONVERT CONTAINS FREETEXT UPDATE OPENROWSET OPENQUERY OPENXML CONTAINSTABLE FREETEXTTABLE IDENTITY".split()),
    "postgres": set("LEFT RIGHT LIKE".split()),
    "sqlite": set(),
}
NILADIC = set("CURRENT_DATE CURRENT_TIME CURRENT_TIMESTAMP CURRENT_USER SESSION_USER SYSTEM_USER USER LOCALTIME LOCALTIMESTAMP CURRENT_ROLE CURRENT_CATALOG".split())

BLANK = "\\s\\u0085\\u00a0\\u1680\\u180e\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff\\x1c-\\x1f"
WORD = "[^\\W\\d][\\w$#@]*"
_TOKEN = {
    "tsql": re.compile(
        f"(?P<blank>[{BLANK}]+|--[^\\r\\n]*)|(?P<open>/\\*)|(?P<text>[Nn]?'(?:[^']|'')*')|(?P<name>\\[(?:[^\\]]|\\]\\])+\\]|\"(?:[^\"]|\"\")+\")"
        f"|(?P<num>0[xX][0-9a-fA-F]*|(?:\\d+(?:\\.\\d*)?|\\.\\d+)(?:[eE][+-]?\\d+)?)|(?P<var>@@?[\\w$#@]+)|(?P<word>\\#{{1,2}}[\\w$#@]+|{WORD})"
        "|(?P<op><=|>=|<>|!=|!<|!>|\\+=|-=|\\*=|/=|%=|&=|\\|=|\\^=|::|[-+*/%&|^~=<>(),.;:])"
    ),
    "postgres": re.compile(
        f"(?P<blank>[{BLANK}]+|--[^\\r\\n]*)|(?P<open>/\\*)|(?P<text>[eE]'(?:[^'\\\\]|''|\\\\.)*'|(?:[bBxXnN]|[uU]&)?'(?:[^']|'')*'|(?P<tag>\\$(?:[^\\W\\d]\\w*)?\\$)(?:.|\\n)*?(?P=tag))"
        f"|(?P<name>(?:[uU]&)?\"(?:[^\"]|\"\")+\")|(?P<num>(?:0[xX][0-9a-fA-F_]+|(?:\\d[\\d_]*(?:\\.(?!\\.)\\d*)?|\\.\\d+)(?:[eE][+-]?\\d+)?)(?![^\\W\\d]))|(?P<var>\\$\\d+)|(?P<word>{WORD.replace('#@', '')})"
        "|(?P<op>::|:=|=>|\\.\\.|[-+*/<>=~!@#%^&|`?]+|[(),.;:\\[\\]])"
    ),
    "sqlite": re.compile(
        f"(?P<blank>[{BLANK}]+|--[^\\r\\n]*)|(?P<open>/\\*)|(?P<text>[xX]?'(?:[^']|'')*')|(?P<name>\\[[^\\]]*\\]|\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`)"
        f"|(?P<num>(?:0[xX][0-9a-fA-F]+|(?:\\d[\\d_]*(?:\\.\\d*)?|\\.\\d+)(?:[eE][+-]?\\d+)?)(?![\\w$]))|(?P<var>\\?\\d*|[:@#$][\\w$]+)|(?P<word>{WORD.replace('#@', '')})"
        "|(?P<op>\\|\\||->>|->|<<|>>|<=|>=|<>|!=|==|[-+*/%&|~=<>(),.;])"
    ),
}
_BLANKS = re.compile(f"(?:[{BLANK}]++|--[^\\r\\n]*+)*+")
# The same tokens with the blanks before them.
_FAST = {d: re.compile(_BLANKS.pattern + "(?:" + rx.pattern.split("|", 2)[2] + ")") for d, rx in _TOKEN.items()}
_GO_LINE = re.compile(r"(?i)(?:^|[\r\n])\s*go\b")
_MARK = {"text": "'", "name": '"', "num": "0", "var": "@", "tag": "'"}
_COMMENT = re.compile(r"/\*|\*/")
CONFLICT = re.compile(r"^(?:<{7}|>{7}|\|{7}|={7})(?![<>=|])(?=[ \t\r\n]|$)", re.M)
GO = re.compile(rf"[^\S\r\n]*GO(?:[^\S\r\n]+\d+)?[^\S\r\n]*;?[^\S\r\n]*(?:--[^\r\n]*)?(?=\r?\n|\r|$)", re.I)


def tokens(text: str, dialect: str) -> tuple[list[str], list[str]]:
    """(token, source) lists.  A token is an operator, a word in capitals, or one of the marks " (quoted name), ' (literal), 0 (number), @ (variable), \\n (GO).

    Raises Invalid for anything that is no token: an open literal, name or comment, a foreign character, a conflict marker.
    """
    if dialect == "tsql" and _GO_LINE.search(text) or CONFLICT.search(text):
        return _tokens_by_line(text, dialect)
    out, src, at, n, pg, rx = [], [], 0, len(text), dialect == "postgres", _FAST[dialect]
    while at < n:
        for m in rx.finditer(text, at):
            if m.start() != at:
                break
            kind = m.lastgroup
            at = m.end()
            if kind == "open":
                at = _comment_end(text, at, dialect, len(out))
                break
            s = m[kind] if kind != "tag" else m["text"]
            if kind == "word":
                out.append(s.upper())
            elif kind == "op":
                if pg and len(s) > 1:
                    short = _operator(s)
                    out.append(short)
                    src.append(short)
                    if len(short) < len(s):
                        at -= len(s) - len(short)
                        break
                    continue
                out.append(s)
            else:
                out.append(_MARK[kind])
            src.append(s)
        else:
            m = None
        if m is None or m.start() > at:
            at = _BLANKS.match(text, at).end()
            if at < n and not rx.match(text, at):
                raise Invalid("open" if text[at] in "'\"[`$" else "character", len(out))
    return out, src


# Tokens that all dialects read alike; a text with any other has to be read by each.
_ALIKE = re.compile(
    f"(?:[{BLANK}]++|--[^\\r\\n]*+|/\\*(?:[^*/]|\\*(?!/)|/(?!\\*))*+\\*/)*+(?:(?P<word>[^\\W\\d]\\w*+(?![$#@']))|(?P<op>[(),;]|\\.(?![\\d.])|(?:<=|>=|<>|!=|[-+*/=<>])(?![-+*/=<>~!@#%^&|`?]))"
    "|(?P<text>'(?:[^']|'')*+')|(?P<name>\"(?:[^\"]|\"\")++\")|(?P<num>(?:\\d++(?:\\.\\d*+)?|\\.\\d++)(?:[eE][+-]?\\d++)?(?![\\w.$])))"
)
_ALIKE_END = re.compile(f"(?:[{BLANK}]++|--[^\\r\\n]*+|/\\*(?:[^*/]|\\*(?!/)|/(?!\\*))*+\\*/)*+")


def common_tokens(text: str) -> tuple[list[str], list[str]] | None:
    """The tokens of a text that every dialect reads alike; None if it isn't such a text."""
    if CONFLICT.search(text) or _GO_LINE.search(text):
        return None
    out, src, at = [], [], 0
    for m in _ALIKE.finditer(text):
        if m.start() != at:
            return None
        at = m.end()
        kind = m.lastgroup
        s = m[kind]
        out.append(s.upper() if kind == "word" else s if kind == "op" else _MARK[kind])
        src.append(s)
    return (out, src) if _ALIKE_END.match(text, at).end() == len(text) else None


def _operator(s: str) -> str:
    """The PostgreSQL operator that a run of signs begins with: comments end it, and a trailing sign is another one."""
    if "--" in s or "/*" in s:
        return s[: min(k for k in (s.find("--"), s.find("/*")) if k >= 0)]
    if s[-1] in "+-" and not set(s) & set("~!@#%^&|`?") and s not in ("->",):
        return s.rstrip("+-") or s[0]
    return s


def _comment_end(text: str, at: int, dialect: str, seen: int) -> int:
    """Where the comment that was opened before ``at`` ends; comments nest but in SQLite, where an open one ends with the input."""
    depth = 1
    while depth:
        c = _COMMENT.search(text, at)
        if not c:
            if dialect != "sqlite":
                raise Invalid("open", seen)
            return len(text)
        depth += (dialect != "sqlite") if c[0] == "/*" else -1
        at = c.end()
    return at


def _tokens_by_line(text: str, dialect: str) -> tuple[list[str], list[str]]:
    """The same for a text with lines that count: GO and conflict markers."""
    rx, out, src, at, n = _TOKEN[dialect], [], [], 0, len(text)
    marks = {m.start() for m in CONFLICT.finditer(text)}
    line = True
    while at < n:
        if at in marks:
            raise Invalid("conflict", len(out))
        if dialect == "tsql" and line and (g := GO.match(text, at)):
            out.append("\n")
            src.append("GO")
            at = g.end()
            continue
        m = rx.match(text, at)
        if not m:
            raise Invalid("open" if text[at] in "'\"[`$" else "character", len(out))
        kind = m.lastgroup
        if kind == "blank":
            for k in marks:
                if at < k < m.end():
                    raise Invalid("conflict", len(out))
            line = "\n" in m[0] or "\r" in m[0] or line and m[0][0] != "-"
            at = m.end()
            if dialect == "tsql" and "\n" in m[0] and not m[0].endswith("\n"):
                at = m.start() + m[0].rindex("\n") + 1 if at > m.start() + m[0].rindex("\n") + 1 and GO.match(text, m.start() + m[0].rindex("\n") + 1) else at
            continue
        if kind == "open":
            at = _comment_end(text, m.end(), dialect, len(out))
            continue
        s = m[0]
        if kind == "op" and dialect == "postgres" and len(s) > 1:
            s = _operator(s)
        out.append(s.upper() if kind == "word" else s if kind == "op" else _MARK[kind])
        src.append(s)
        at += len(s)
        line = False
    return out, src


_COMPARE = {"=", "<>", "!=", "<", ">", "<=", ">=", "!<", "!>", "=="}
_BINARY = {
    "tsql": set("+ - * / % & | ^ ||".split()) - {"||"},
    "postgres": None,
    "sqlite": set("+ - * / % & | || << >> -> ->>".split()),
}
_JOIN = {"JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "NATURAL", "OUTER"}
_STATEMENT = set(
    "SELECT WITH INSERT UPDATE DELETE MERGE DECLARE SET IF WHILE BEGIN PRINT EXEC EXECUTE RETURN USE TRUNCATE DROP CREATE ALTER GRANT REVOKE DENY COMMIT ROLLBACK "
    "SAVE RAISERROR THROW WAITFOR GOTO BREAK CONTINUE OPEN CLOSE FETCH DEALLOCATE DBCC BACKUP RESTORE BULK KILL CHECKPOINT END ELSE".split()
)
_LOOSE = {
    "tsql": set("DROP CREATE ALTER GRANT REVOKE DENY BACKUP RESTORE BULK DBCC OPEN CLOSE FETCH DEALLOCATE WAITFOR KILL".split()),
    "postgres": set("DROP CREATE ALTER GRANT REVOKE COPY VACUUM ANALYZE ANALYSE EXPLAIN COMMENT DO CALL LOCK REINDEX CLUSTER REFRESH SECURITY LISTEN NOTIFY UNLISTEN PREPARE EXECUTE DEALLOCATE DISCARD RESET SHOW SAVEPOINT RELEASE IMPORT REASSIGN DECLARE FETCH CLOSE MOVE CHECKPOINT LOAD".split()) - {"IMPORT"},
    "sqlite": set("DROP CREATE ALTER PRAGMA ATTACH DETACH VACUUM ANALYZE REINDEX SAVEPOINT RELEASE EXPLAIN".split()),
}
# Further words of a column's definition; brackets may follow each.
_ATTRIBUTES = {
    "tsql": set("NULL IDENTITY ROWGUIDCOL SPARSE PERSISTED HIDDEN GENERATED ALWAYS AS ROW START END MASKED ENCRYPTED WITH ON FILESTREAM CLUSTERED NONCLUSTERED INDEX PRIMARY".split()) | {'"'},
    "postgres": set("NULL GENERATED ALWAYS BY AS IDENTITY STORED STORAGE COMPRESSION DEFERRABLE INITIALLY DEFERRED IMMEDIATE NO INHERIT INCLUDE WITH USING INDEX TABLESPACE ENFORCED PLAIN EXTERNAL EXTENDED MAIN PERIOD".split()),
    "sqlite": set("NULL GENERATED ALWAYS AUTOINCREMENT ASC DESC STORED VIRTUAL DEFERRABLE INITIALLY DEFERRED IMMEDIATE".split()),
}


class _Parser(Definitions):
    def __init__(self, toks: list[str], src: list[str], dialect: str):
        self.t, self.src, self.d, self.i = toks + [""] * 4, src + [""] * 4, dialect, 0
        self.ts, self.pg, self.lite = dialect == "tsql", dialect == "postgres", dialect == "sqlite"
        self.reserved, self.binary = RESERVED[dialect], _BINARY[dialect]
        self.no_alias, self.callable = NO_ALIAS[dialect], CALLABLE[dialect]
        self.deep, self.cap = 0, CAP

    # -- small steps ---------------------------------------------------------
    def fail(self, why: str = "syntax"):
        raise Invalid("end" if self.t[self.i] == "" else why, self.i)

    def at(self, *words: str) -> bool:
        return self.t[self.i] in words

    def take(self, word: str) -> bool:
        if self.t[self.i] == word:
            self.i += 1
            return True
        return False

    def need(self, word: str) -> None:
        if self.t[self.i] != word:
            self.fail()
        self.i += 1

    def is_name(self, t: str) -> bool:
        return t == '"' or t != "" and (t[0].isalpha() or t[0] in "_#") and t not in self.reserved

    def name(self) -> None:
        t = self.t[self.i]
        if not (self.is_name(t) or self.lite and (t == "'" or t in _JOIN and t != "JOIN")):  # SQLite takes literals and join words as names
            self.fail()
        self.i += 1

    def any_word(self) -> None:
        t = self.t[self.i]
        if not (t == '"' or t and (t[0].isalpha() or t[0] == "_")):
            self.fail()
        self.i += 1

    def path(self) -> None:
        """name, a.b, a.b.c; T-SQL also a..b."""
        if self.ts and self.take("@"):
            return
        self.name()
        while self.take("."):
            if self.ts and self.at("."):
                continue
            self.any_word() if self.pg else self.name()

    def names(self) -> None:
        self.need("(")
        self.name()
        while self.take(","):
            self.name()
        self.need(")")

    def begins_statement(self, first: int) -> bool:
        """Whether a word within a T-SQL statement begins another one, rather than being a clause of it."""
        before, t, after = self.t[self.i - 1 : self.i + 2] if self.t[self.i] else ("", "", "")
        if t not in _STATEMENT or t == "WITH" or before in ("ON", "WITH", ",", ".", "=", "FOR", "AS", "INSTEAD") or after in (".", "="):
            return False
        if t == "IF":
            return not (after == "EXISTS" and self.t[self.i + 2] != "(")
        if t == "SET":
            return before not in ("UPDATE", "DELETE") and after != "(" and not (self.t[first] == "ALTER" and self.t[first + 1] not in ("TABLE", "INDEX"))
        return not (t == "MERGE" and after == "RANGE")

    # -- expressions -----------------------------------------------------------
    # Each returns True for a condition, False for a value; only T-SQL tells them apart.
    def condition(self) -> None:
        if not self.expr() and self.ts:
            self.fail("no condition")

    def value(self) -> None:
        if self.expr() and self.ts:
            self.fail("no value")

    def expr(self) -> bool:
        self.deep += 1
        if self.deep > self.cap:
            raise Invalid("deep", self.i)
        c = self.conj()
        while self.take("OR"):
            if not (c and self.conj()) and self.ts:
                self.fail("no condition")
            elif not self.ts and not c:
                self.conj()
            c = True
        self.deep -= 1
        return c

    def conj(self) -> bool:
        c = self.negation()
        while self.take("AND"):
            d = self.negation()
            if self.ts and not (c and d):
                self.fail("no condition")
            c = True
        return c

    def negation(self) -> bool:
        if self.take("NOT"):
            while self.take("NOT"):
                pass
            if not self.predicate() and self.ts:
                self.fail("no condition")
            return True
        return self.predicate()

    def predicate(self) -> bool:
        c, compared = self.sum(), False
        while True:
            t = self.t[self.i]
            if t in _COMPARE:
                if self.ts and c or self.pg and compared:
                    self.fail()
                if t == "==" and not self.lite or t[0] == "!" and t != "!=" and not self.ts:
                    self.fail()
                self.i += 1
                if self.at("ANY", "ALL", "SOME") and self.t[self.i + 1] == "(":
                    self.i += 2
                    self.inner()
                    self.need(")")
                elif self.sum() and self.ts:
                    self.fail("no value")
                c = compared = True
                continue
            if t == "IS":
                if self.ts and c:
                    self.fail()
                self.i += 1
                self.take("NOT")
                if self.take("DISTINCT"):
                    self.need("FROM")
                    self.sum()
                elif self.lite:
                    self.sum()
                elif not (self.take("NULL") or self.pg and (self.take("TRUE") or self.take("FALSE") or self.take("UNKNOWN") or self.take("DOCUMENT") or self.take("NORMALIZED"))):
                    self.fail()
                c = True
                continue
            if not self.ts and t in ("ISNULL", "NOTNULL"):
                self.i += 1
                c = True
                continue
            start = self.i
            if t == "NOT":
                self.i += 1
                t = self.t[self.i]
                if self.lite and t == "NULL":
                    self.i += 1
                    c = True
                    continue
            if t == "IN":
                if self.ts and c:
                    self.fail()
                self.i += 1
                if self.lite and not self.at("("):
                    self.path()
                else:
                    self.need("(")
                    if not (self.lite and self.at(")")):
                        self.inner()
                    self.need(")")
                c = True
                continue
            if t == "BETWEEN":
                if self.ts and c:
                    self.fail()
                self.i += 1
                if self.pg and not self.take("SYMMETRIC"):
                    self.take("ASYMMETRIC")
                self.sum()
                self.need("AND")
                self.sum()
                c = True
                continue
            if t == "LIKE" or self.pg and t in ("ILIKE", "SIMILAR") or self.lite and t in ("GLOB", "REGEXP", "MATCH"):
                if self.ts and c:
                    self.fail()
                self.i += 1
                if t == "SIMILAR":
                    self.need("TO")
                self.sum()
                if self.take("ESCAPE"):
                    self.sum()
                c = True
                continue
            if start != self.i:
                self.fail()
            return c

    def sum(self) -> bool:
        c = self.unary()
        while True:
            t = self.t[self.i]
            if self.binary is not None:
                if t not in self.binary:
                    break
            elif not t or t[0] not in "-+*/<>=~!@#%^&|`?" or t in _COMPARE or t == "=>" or t == "'" or t == "@":
                if t == "OPERATOR" and self.pg and self.t[self.i + 1] == "(":
                    self.i += 2
                    while not self.at(")", ""):
                        self.i += 1
                    self.need(")")
                    self.unary()
                    continue
                break
            self.i += 1
            if (self.unary() or c) and self.ts:
                self.fail("no value")
            c = False
        return c

    def unary(self) -> bool:
        t = self.t[self.i]
        if t in ("-", "+", "~") or self.pg and t and t[0] in "-+~@|!" and t not in ("'", "@", "||"):
            self.i += 1
            self.unary()
            return False
        first = self.i
        c = self.primary()
        indexed = self.t[first] in ("(", "@") or self.t[self.i - 1] != ")" and self.t[first] not in ("0", "'", "CASE", "ARRAY")
        while True:
            if self.at("::") and self.pg:
                self.i += 1
                self.type()
            elif self.take("COLLATE"):
                self.path()
            elif self.pg and indexed and self.take("["):
                self.value() if not self.at(":") else None
                if self.take(":") and not self.at("]"):
                    self.value()
                self.need("]")
            elif self.at("AT") and self.t[self.i + 1] == "TIME" and not self.lite:
                self.i += 2
                if self.t[self.i] != "ZONE":
                    self.fail()
                self.i += 1
                self.unary()
            elif self.at("AT") and self.pg and self.t[self.i + 1] == "LOCAL":
                self.i += 2
            else:
                return c

    def primary(self) -> bool:
        t = self.t[self.i]
        nxt = self.t[self.i + 1] if t else ""
        if t in ("0", "@"):
            self.i += 1
            if t == "@" and self.ts and self.at(".") and self.t[self.i + 1] not in ("", "0"):
                self.i += 2
                self.call() if self.at("(") else None
            return False
        if t == "'":
            self.i += 1
            return False
        if t == "NULL" or not self.ts and t in ("TRUE", "FALSE") and nxt != "." or t == "DEFAULT" and (self.ts or self.pg):
            self.i += 1
            return False
        if t == "(":
            self.i += 1
            c = self.inner()
            self.need(")")
            if self.pg and self.at(".") :
                self.i += 1
                if not self.take("*"):
                    self.any_word()
            return c
        if t == "CASE":
            return self.case()
        if t == "EXISTS" and nxt == "(":
            self.i += 2
            self.query()
            self.need(")")
            return True
        if t in ("CAST", "TRY_CAST") and nxt == "(":
            self.i += 2
            self.value()
            self.need("AS")
            self.type()
            self.need(")")
            return False
        if t in ("CONVERT", "TRY_CONVERT") and self.ts and nxt == "(":
            self.i += 2
            self.type()
            self.need(",")
            self.value()
            if self.take(","):
                self.value()
            self.need(")")
            return False
        if t == "NEXT" and nxt == "VALUE" and self.ts:
            self.i += 2
            self.need("FOR")
            self.path()
            return False
        if self.pg:
            if t == "ARRAY" and nxt in ("[", "("):
                self.i += 1
                if self.take("["):
                    while not self.at("]"):
                        self.value() if not self.at("[") else self.brackets()
                        if not self.take(","):
                            break
                    self.need("]")
                else:
                    self.i += 1
                    self.query()
                    self.need(")")
                return False
            if t in ("INTERVAL", "DATE", "TIMESTAMP", "TIME", "TIMESTAMPTZ") and nxt == "'":
                self.i += 2
                while self.at("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND", "TO") and t == "INTERVAL":
                    self.i += 1
                return False
            if t in ("EXTRACT", "SUBSTRING", "TRIM", "POSITION", "OVERLAY") and nxt == "(":
                self.i += 2
                if t == "TRIM":
                    self.take("BOTH") or self.take("LEADING") or self.take("TRAILING")
                if not self.take("FROM"):
                    self.sum()
                while not self.at(")", ""):
                    if not (self.take("FROM") or self.take("FOR") or self.take("IN") or self.take(",") or self.take("PLACING")):
                        self.fail()
                    self.sum()
                self.need(")")
                return False
        if t in NILADIC and t in self.reserved | {"CURRENT_DATE", "CURRENT_TIME", "CURRENT_TIMESTAMP"} and nxt not in (".",):
            self.i += 1
            if self.pg and self.take("("):
                self.need("0")
                self.need(")")
            return False
        if t in self.callable and nxt == "(":
            self.i += 1
            self.call()
            return t in ("CONTAINS", "FREETEXT", "UPDATE") and self.ts
        if self.lite and t == "RAISE" and nxt == "(":
            self.i += 1
            self.brackets()
            return False
        if not self.is_name(t) and not (self.lite and t in _JOIN and t != "JOIN"):
            self.fail()
        self.i += 1
        while self.at("."):
            self.i += 1
            if self.ts and self.at("."):
                continue
            if self.pg and self.at("*"):
                self.i += 1
                return False
            self.any_word() if self.pg else self.name_or_function()
        if self.at("("):
            self.call()
        elif self.pg and self.at("'") and self.src[self.i - 1].isalpha() and t not in self.reserved:
            self.i += 1  # typed literal: type 'text'
        return False

    def name_or_function(self) -> None:
        self.name()

    def brackets(self) -> None:
        depth = 0
        while (t := self.t[self.i]) != "":
            self.i += 1
            depth += (t in "([") - (t in ")]")
            if not depth:
                return
        self.fail()

    def call(self) -> None:
        self.need("(")
        if self.take("*"):
            pass
        elif not self.at(")"):
            if not self.take("DISTINCT"):
                self.take("ALL")
            if self.pg:
                self.take("VARIADIC")
            self.argument()
            while self.take(","):
                if self.pg:
                    self.take("VARIADIC")
                self.argument()
            if self.at("ORDER") and not self.ts:
                self.order()
            if self.ts and self.at("AS", "USING", "FOR"):
                self.i += 1
                self.type()
        self.need(")")
        if self.at("WITHIN") and self.t[self.i + 1] == "GROUP":
            self.i += 2
            self.need("(")
            self.order()
            self.need(")")
        if not self.ts and self.at("FILTER") and self.t[self.i + 1] == "(":
            self.i += 2
            self.need("WHERE")
            self.condition()
            self.need(")")
        if self.at("IGNORE", "RESPECT") and self.t[self.i + 1] == "NULLS":
            self.i += 2
        if self.at("OVER") and (self.t[self.i + 1] == "(" or self.is_name(self.t[self.i + 1])):
            self.i += 1
            if self.take("("):
                self.window()
                self.need(")")
            else:
                self.name()

    def argument(self) -> None:
        if self.at("SELECT", "WITH") and not self.ts:
            if self.pg:
                self.fail()
            self.query()
            return
        if self.pg and self.is_name(self.t[self.i]) and self.t[self.i + 1] in ("=>", ":="):
            self.i += 2
        self.expr() if not self.ts else self.ts_argument()

    def ts_argument(self) -> None:
        if self.expr() and not self.at(","):  # IIF takes a condition first
            self.fail("no value")

    def window(self) -> None:
        if self.is_name(self.t[self.i]) and not self.at("PARTITION", "ROWS", "RANGE", "GROUPS"):
            self.name()
        if self.take("PARTITION"):
            self.need("BY")
            self.value()
            while self.take(","):
                self.value()
        if self.at("ORDER"):
            self.order()
        if self.at("ROWS", "RANGE", "GROUPS"):
            self.i += 1
            bound = 1 + self.take("BETWEEN")
            for k in range(bound):
                if k:
                    self.need("AND")
                if self.take("CURRENT"):
                    self.need("ROW")
                else:
                    if not self.take("UNBOUNDED"):
                        self.sum()
                    if not self.take("PRECEDING"):
                        self.need("FOLLOWING")
            if self.take("EXCLUDE"):
                self.any_word()
                self.take("ROW") or self.take("OTHERS")

    def case(self) -> bool:
        self.need("CASE")
        simple = not self.at("WHEN")
        if simple:
            self.value()
        if not self.at("WHEN"):
            self.fail()
        while self.take("WHEN"):
            self.value() if simple else self.condition()
            self.need("THEN")
            self.value()
        if self.take("ELSE"):
            self.value()
        self.need("END")
        return False

    def inner(self) -> bool:
        """What stands in brackets: a query, an expression or a list."""
        k = self.i
        while self.t[k] == "(":
            k += 1
        if self.t[k] in ("SELECT", "WITH") or self.t[k] == "VALUES" and not self.ts:
            if k == self.i:
                self.query()
                return False
            j, self_deep = self.i, self.deep
            try:
                self.query()
                if self.at(")"):
                    return False
            except Invalid:
                pass
            self.i, self.deep = j, self_deep
        c = self.expr()
        while self.take(","):
            c = False
            self.expr()
        return c

    def type(self) -> None:
        if not (self.is_name(self.t[self.i]) or self.at("DOUBLE", "NATIONAL", "TABLE")):
            self.fail()
        if self.at("DOUBLE", "NATIONAL", "CHARACTER", "BIT"):
            self.i += 1
            self.at("PRECISION", "VARYING", "CHARACTER", "CHAR") and self.any_word()
            self.take("VARYING")
        else:
            self.path()
            while self.lite and self.is_name(self.t[self.i]):
                self.name()
        if self.take("("):
            while True:
                if not (self.take("0") or self.take("MAX") or self.take("-") or self.take("'")):
                    self.fail()
                if not self.take(","):
                    break
            self.need(")")
        if self.pg:
            if self.at("WITH", "WITHOUT") and self.t[self.i + 1] == "TIME":
                self.i += 2
                self.need("ZONE")
            while self.take("["):
                self.take("0")
                self.need("]")

    # -- queries ---------------------------------------------------------------
    def order(self) -> None:
        self.need("ORDER")
        self.need("BY")
        while True:
            self.value()
            if not self.take("ASC") and not self.take("DESC") and self.pg and self.take("USING"):
                self.i += 1
            if not self.ts and self.take("NULLS"):
                if not self.take("FIRST"):
                    self.need("LAST")
            if not self.take(","):
                return

    def ctes(self) -> None:
        self.need("WITH")
        if not self.ts:
            self.take("RECURSIVE")
        while True:
            self.name()
            if self.at("("):
                self.names()
            self.need("AS")
            if not self.ts:
                self.take("NOT")
                self.take("MATERIALIZED")
            self.need("(")
            if self.at("INSERT", "UPDATE", "DELETE") and self.pg:
                self.dml()
            else:
                self.query()
            self.need(")")
            if not self.take(","):
                return

    def query(self) -> None:
        self.deep += 1
        if self.deep > self.cap:
            raise Invalid("deep", self.i)
        if self.at("WITH"):
            self.ctes()
            if self.at("INSERT", "UPDATE", "DELETE", "MERGE"):
                self.dml()
                self.deep -= 1
                return
        self.term()
        while self.at("UNION", "INTERSECT", "EXCEPT"):
            self.i += 1
            if not self.take("ALL") and not self.lite and not self.ts:
                self.take("DISTINCT")
            self.term()
        if self.at("ORDER"):
            self.order()
        self.tail()
        self.deep -= 1

    def tail(self) -> None:
        if self.ts:
            if self.take("OFFSET"):
                self.value()
                if not self.take("ROWS"):
                    self.need("ROW")
                self.fetch()
            if self.at("FOR") and self.t[self.i + 1] not in ("UPDATE", "READ"):
                self.i += 1
                if not self.at("XML", "JSON", "BROWSE", "SYSTEM_TIME"):
                    self.fail()
                self.i += 1
                while self.at(",") or self.is_name(self.t[self.i]):
                    self.i += 1
                    if self.at("("):
                        self.brackets()
            if self.take("OPTION"):
                if not self.at("("):
                    self.fail()
                self.brackets()
            return
        if self.lite:
            if self.take("LIMIT"):
                self.value()
                if self.take("OFFSET") or self.take(","):
                    self.value()
            return
        for _ in range(6):
            if self.take("LIMIT"):
                if not self.take("ALL"):
                    self.value()
            elif self.take("OFFSET"):
                self.value()
                self.take("ROWS") or self.take("ROW")
            elif self.at("FETCH"):
                self.fetch()
            elif self.take("FOR"):
                while not self.at("", ";", ")"):
                    self.any_word() if not self.take(",") else None
            else:
                break

    def fetch(self) -> None:
        if self.take("FETCH"):
            if not self.take("FIRST"):
                self.need("NEXT")
            if not self.at("ROW", "ROWS"):
                self.value()
            if not self.take("ROWS"):
                self.need("ROW")
            if not self.take("ONLY"):
                self.need("WITH")
                self.need("TIES")

    def term(self) -> None:
        if self.at("(") and not self.lite:
            self.i += 1
            self.query()
            self.need(")")
            return
        if self.at("VALUES") and not self.ts:
            self.i += 1
            self.rows()
            return
        if self.pg and self.take("TABLE"):
            self.path()
            return
        self.need("SELECT")
        if self.take("DISTINCT"):
            if self.pg and self.take("ON"):
                self.need("(")
                self.inner()
                self.need(")")
        else:
            self.take("ALL")
        if self.ts and self.take("TOP"):
            self.top()
        if not (self.pg and self.at("FROM", "WHERE", "", ";", ")", "UNION", "LIMIT", "ORDER", "GROUP", "INTO")):
            self.item()
            while self.take(","):
                self.item()
        if not self.lite and self.take("INTO"):
            if self.pg:
                while self.at("TEMP", "TEMPORARY", "UNLOGGED", "TABLE"):
                    self.i += 1
            self.path()
        if self.take("FROM"):
            self.sources()
        if self.take("WHERE"):
            self.condition()
        if self.take("GROUP"):
            self.need("BY")
            if not self.lite:
                self.take("ALL") or self.take("DISTINCT")
            while True:
                self.group()
                if not self.take(","):
                    break
            if self.ts and self.at("WITH") and self.t[self.i + 1] in ("ROLLUP", "CUBE"):
                self.i += 2
        if self.take("HAVING"):
            self.condition()
        if self.at("WINDOW"):
            self.i += 1
            while True:
                self.name()
                self.need("AS")
                self.need("(")
                self.window()
                self.need(")")
                if not self.take(","):
                    break

    def group(self) -> None:
        if not self.lite and self.at("GROUPING") and self.t[self.i + 1] == "SETS":
            self.i += 2
            self.brackets()
        elif self.at("(") and self.t[self.i + 1] == ")" and not self.lite:
            self.i += 2
        else:
            self.value()

    def top(self) -> None:
        if self.take("("):
            self.value()
            self.need(")")
        elif not self.take("0"):
            self.need("@")
        self.take("PERCENT")
        if self.at("WITH") and self.t[self.i + 1] == "TIES":
            self.i += 2

    def item(self) -> None:
        if self.take("*"):
            return
        k = self.i
        while self.is_name(self.t[k]) and self.t[k + 1] == ".":
            k += 2
        if k > self.i and self.t[k] == "*":
            self.i = k + 1
            return
        if self.ts and (self.t[self.i] == "@" or self.is_name(self.t[self.i]) or self.at("'")) and self.t[self.i + 1] in ("=", "+=", "-=", "*=", "/="):
            self.i += 2
        self.value()
        if self.take("AS"):
            if self.at("'") and not self.pg:
                self.i += 1
            else:
                self.any_word() if self.pg else self.name()
        elif self.is_name(self.t[self.i]) and self.t[self.i] not in self.no_alias or self.at("'") and not self.pg:
            self.i += 1

    def alias(self) -> bool:
        if self.take("AS"):
            self.name() if not (self.lite and self.take("'")) else None
        elif self.is_name(self.t[self.i]) and self.t[self.i] not in self.no_alias and not (self.pg and self.at("SET")):
            self.i += 1
        else:
            return False
        return True

    def sources(self) -> None:
        while True:
            self.joined()
            if not self.take(","):
                return

    def joined(self) -> None:
        self.source()
        while self.join():
            pass

    def join(self) -> bool:
        t = self.t[self.i]
        if t == "OUTER" and not (self.ts and self.t[self.i + 1] == "APPLY"):
            return False
        if t not in _JOIN:
            return False
        k, free = self.i, False
        if self.take("NATURAL"):
            if self.ts:
                self.fail()
            free = True
        if self.at("CROSS", "OUTER") and self.ts and self.t[self.i + 1] == "APPLY":
            self.i += 2
            self.source()
            return True
        if self.take("CROSS"):
            free = True
        elif self.take("INNER"):
            self.hint()
        elif self.at("LEFT", "RIGHT", "FULL"):
            self.i += 1
            self.take("OUTER")
            self.hint()
        self.need("JOIN")
        if self.i == k:
            self.fail()
        self.source()
        if free:
            if self.lite and self.take("ON"):
                self.condition()
            return True
        while not self.at("ON", "USING") and self.join():
            pass
        if self.take("ON"):
            self.condition()
        elif not self.ts and self.at("USING"):
            self.i += 1
            self.names()
            if self.pg and self.take("AS"):
                self.name()
        elif not self.lite:
            self.fail()
        return True

    def hint(self) -> None:
        if self.ts and self.at("HASH", "LOOP", "MERGE", "REMOTE"):
            self.i += 1

    def source(self) -> None:
        if self.pg:
            self.take("LATERAL")
            self.take("ONLY")
        if self.take("("):
            k = self.i
            while self.t[k] == "(":
                k += 1
            sub = self.t[k] in ("SELECT", "WITH", "VALUES")
            if sub and (k == self.i or not self.mixed()):
                if self.ts and self.at("VALUES"):
                    self.i += 1
                    self.rows()
                else:
                    self.query()
            else:
                sub = False
                self.joined()
                if self.lite:
                    while self.take(","):
                        self.joined()
            self.need(")")
            named = self.alias()
            if named and self.at("("):
                self.names()
            if sub and self.ts and not named:
                self.fail()
        else:
            self.path()
            if self.at("(") and not (self.ts and self.t[self.i + 1] in ("NOLOCK",)):
                self.call()
                if self.ts and self.at("WITH") and self.t[self.i + 1] == "(":
                    self.i += 1
                    self.brackets()
                if self.pg and self.at("WITH") and self.t[self.i + 1] == "ORDINALITY":
                    self.i += 2
            if self.ts and self.at("FOR") and self.t[self.i + 1] == "SYSTEM_TIME":
                self.i += 2
                while not self.at("", "AS", "WHERE", "JOIN", ")", ";", "INNER", "LEFT"):
                    self.i += 1
            if self.alias() and self.at("(") and (self.pg or self.ts and self.t[self.i + 1] not in ("NOLOCK",)):
                self.brackets() if self.pg else self.names()
            if self.lite:
                if self.at("INDEXED"):
                    self.i += 1
                    self.need("BY")
                    self.name()
                elif self.at("NOT") and self.t[self.i + 1] == "INDEXED":
                    self.i += 2
        if not self.lite and self.take("TABLESAMPLE"):
            if self.is_name(self.t[self.i]):
                self.i += 1
            if not self.at("("):
                self.fail()
            self.brackets()
        if self.ts:
            if self.at("WITH") and self.t[self.i + 1] == "(" or self.at("(") and self.t[self.i + 1] == "NOLOCK":
                self.take("WITH")
                self.brackets()
            while self.at("PIVOT", "UNPIVOT"):
                self.i += 1
                if not self.at("("):
                    self.fail()
                self.brackets()
                if not self.alias():
                    self.fail()

    def mixed(self) -> bool:
        """Whether brackets that begin with a bracketed query hold a join."""
        depth, k = 0, self.i
        while self.t[k] != "":
            depth += (self.t[k] == "(") - (self.t[k] == ")")
            if depth < 0:
                return False
            if depth == 0 and self.t[k] in _JOIN:
                return True
            k += 1
        return False

    def rows(self) -> None:
        while True:
            self.need("(")
            self.value()
            while self.take(","):
                self.value()
            self.need(")")
            if not self.take(","):
                return

    # -- statements --------------------------------------------------------------
    def output(self) -> None:
        if self.ts and self.take("OUTPUT"):
            self.item()
            while self.take(","):
                self.item()
            if self.take("INTO"):
                self.path()
                if self.at("("):
                    self.names()

    def returning(self) -> None:
        if not self.ts and self.take("RETURNING"):
            self.item()
            while self.take(","):
                self.item()

    def dml(self) -> None:
        t = self.t[self.i]
        self.i += 1
        if t == "MERGE":
            self.i -= 1
            if self.lite:
                self.fail()
            self.merge()
        elif t in ("INSERT", "REPLACE"):
            if self.lite and t == "INSERT" and self.take("OR"):
                if not self.at("REPLACE", "IGNORE", "ABORT", "FAIL", "ROLLBACK"):
                    self.fail()
                self.i += 1
            if self.ts and self.take("TOP"):
                self.top()
            if not self.take("INTO") and not self.ts:
                self.fail()
            self.path()
            if not self.ts and self.take("AS"):
                self.name()
            if self.ts and self.at("WITH") and self.t[self.i + 1] == "(":
                self.i += 1
                self.brackets()
            if self.at("(") and not (self.t[self.i + 1] in ("SELECT", "WITH")):
                self.need("(")
                self.column()
                while self.take(","):
                    self.column()
                self.need(")")
            self.output()
            if self.pg and self.take("OVERRIDING"):
                self.any_word()
                self.need("VALUE")
            if self.take("DEFAULT"):
                self.need("VALUES")
            elif self.at("VALUES"):
                self.i += 1
                self.rows()
                if self.lite or self.pg:
                    while self.at("UNION", "EXCEPT", "INTERSECT"):
                        self.i += 1
                        self.take("ALL")
                        self.term()
            elif self.ts and self.at("EXEC", "EXECUTE"):
                self.execute()
            else:
                self.query()
            if not self.ts and self.at("ON") and self.t[self.i + 1] == "CONFLICT":
                self.i += 2
                if self.at("("):
                    self.brackets()
                if self.take("WHERE"):
                    self.condition()
                if self.pg and self.at("ON"):
                    self.i += 1
                    self.need("CONSTRAINT")
                    self.name()
                self.need("DO")
                if not self.take("NOTHING"):
                    self.need("UPDATE")
                    self.need("SET")
                    self.assignments()
                    if self.take("WHERE"):
                        self.condition()
            self.returning()
        elif t == "UPDATE":
            if self.lite and self.take("OR"):
                self.any_word()
            if self.ts and self.take("TOP"):
                self.top()
            if self.pg:
                self.take("ONLY")
            self.path()
            if self.ts and self.at("WITH") and self.t[self.i + 1] == "(":
                self.i += 1
                self.brackets()
            if not self.ts and not self.at("SET"):
                self.alias()
            self.need("SET")
            self.assignments()
            self.output()
            if self.take("FROM"):
                self.sources()
            if self.take("WHERE"):
                if self.take("CURRENT"):
                    self.need("OF")
                    self.name()
                else:
                    self.condition()
            self.returning()
            if self.ts and self.take("OPTION"):
                self.brackets()
        else:
            if self.ts and self.take("TOP"):
                self.top()
            if not self.take("FROM") and not self.ts:
                self.fail()
            if self.pg:
                self.take("ONLY")
            self.path()
            if self.ts and self.at("WITH") and self.t[self.i + 1] == "(":
                self.i += 1
                self.brackets()
            if not self.ts:
                self.alias()
            self.output()
            if self.ts and self.take("FROM"):
                self.sources()
            if self.pg and self.take("USING"):
                self.sources()
            if self.take("WHERE"):
                if self.take("CURRENT"):
                    self.need("OF")
                    self.name()
                else:
                    self.condition()
            self.returning()
            if self.ts and self.take("OPTION"):
                self.brackets()

    def column(self) -> None:
        self.name()
        while self.take("."):
            self.any_word()
        if self.pg and self.at("["):
            self.brackets()

    def assignments(self) -> None:
        while True:
            if not self.ts and self.at("("):
                self.names()
                self.need("=")
                self.value()
            else:
                if self.ts and self.take("@"):
                    if self.t[self.i] in ("=",) and self.is_name(self.t[self.i + 1]) and self.t[self.i + 2] == "=":
                        self.i += 2
                else:
                    self.column()
                if self.ts and self.at("+=", "-=", "*=", "/=", "%=", "&=", "|=", "^="):
                    self.i += 1
                else:
                    self.need("=")
                self.value()
            if not self.take(","):
                return

    def execute(self) -> None:
        self.i += 1
        if self.take("("):
            self.value()
            self.need(")")
            return
        if self.at("@") and self.t[self.i + 1] == "=":
            self.i += 2
        self.path()
        if self.at(";", "", "\n") or self.t[self.i] in _STATEMENT:
            return
        while True:
            if self.at("@") and self.t[self.i + 1] == "=":
                self.i += 2
            if not (self.take("DEFAULT") or self.take("NULL")):
                self.take("-")
                if not (self.take("0") or self.take("'") or self.take("@")):
                    self.name()
            self.take("OUTPUT") or self.take("OUT")
            if not self.take(","):
                return

    def statement(self) -> None:
        self.deep += 1
        if self.deep > self.cap:
            raise Invalid("deep", self.i)
        t = self.t[self.i]
        if t in ("SELECT", "WITH", "(") or t in ("VALUES", "TABLE") and not self.ts:
            if t == "WITH" and self.ts and self.i and self.t[self.i - 1] not in (";", "\n", "BEGIN", "AS", "ELSE"):
                self.fail()
            if t == "(" and self.lite:
                self.fail()
            self.query()
        elif t == "UPDATE" and self.ts and self.t[self.i + 1] == "STATISTICS":
            self.i += 2
            self.path()
            if self.at("("):
                self.names()
            elif self.is_name(self.t[self.i]):
                self.name()
            if self.take("WITH"):
                self.setting()
                while not self.ends():
                    self.take(",") or self.take("=")
                    self.setting()
        elif t in ("INSERT", "UPDATE", "DELETE", "MERGE") or t == "REPLACE" and self.lite:
            self.dml()
        elif t in _LOOSE[self.d]:
            self.definition(t)
        elif t == "TRUNCATE" and not self.lite:
            self.i += 1
            if not self.take("TABLE") and self.ts:
                self.fail()
            self.paths() if self.pg else self.path()
            if self.pg:
                self.words("RESTART", "CONTINUE", "IDENTITY", "CASCADE", "RESTRICT")
            elif self.take("WITH"):
                self.brackets()
        elif t in ("BEGIN", "COMMIT", "ROLLBACK", "START", "END", "ABORT") and not self.ts:
            self.i += 1
            self.transaction(t)
        elif self.ts:
            self.ts_statement(t)
        elif self.pg and t == "SET":
            self.i += 1
            self.pg_set()
        else:
            self.fail()
        self.deep -= 1

    # -- definitions ---------------------------------------------------------------
    def cursor(self) -> None:
        """The rest of a T-SQL cursor, behind its name."""
        self.words("INSENSITIVE", "SCROLL")
        self.need("CURSOR")
        self.words("LOCAL", "GLOBAL", "FORWARD_ONLY", "SCROLL", "STATIC", "KEYSET", "DYNAMIC", "FAST_FORWARD", "READ_ONLY", "SCROLL_LOCKS", "OPTIMISTIC", "TYPE_WARNING")
        self.need("FOR")
        self.query()
        if self.take("FOR"):
            if self.take("READ"):
                self.need("ONLY")
            else:
                self.need("UPDATE")
                if self.take("OF"):
                    self.column()
                    while self.take(","):
                        self.column()

    def merge(self) -> None:
        self.need("MERGE")
        if self.ts and self.take("TOP"):
            self.top()
        if not self.take("INTO") and self.pg:
            self.fail()
        if self.pg:
            self.take("ONLY")
        self.path()
        if self.ts and self.at("WITH") and self.t[self.i + 1] == "(":
            self.i += 1
            self.brackets()
        if not self.at("USING"):
            self.alias()
        self.need("USING")
        self.joined()
        self.need("ON")
        self.condition()
        if not self.at("WHEN"):
            self.fail()
        while self.take("WHEN"):
            free = self.take("NOT")
            self.need("MATCHED")
            if self.take("BY") and not self.take("TARGET"):
                self.need("SOURCE")
                free = False
            if self.take("AND"):
                self.condition()
            self.need("THEN")
            if self.pg and self.take("DO"):
                self.need("NOTHING")
            elif free:
                self.need("INSERT")
                if self.at("("):
                    self.need("(")
                    self.column()
                    while self.take(","):
                        self.column()
                    self.need(")")
                if self.pg and self.take("OVERRIDING"):
                    self.any_word()
                    self.need("VALUE")
                if self.take("DEFAULT"):
                    self.need("VALUES")
                else:
                    self.need("VALUES")
                    self.need("(")
                    self.value()
                    while self.take(","):
                        self.value()
                    self.need(")")
            elif not self.take("DELETE"):
                self.need("UPDATE")
                self.need("SET")
                self.assignments()
        self.output()
        self.returning()
        if self.ts:
            if self.take("OPTION"):
                self.brackets()
            if not self.at(";"):  # T-SQL wants it after this statement alone
                self.fail()

    def view(self) -> None:
        self.exists()
        self.path()
        if self.at("("):
            self.names()
        if self.pg and self.take("USING"):
            self.name()
        if self.take("WITH"):
            self.brackets() if self.pg and self.at("(") else self.options()
        if self.pg and self.take("TABLESPACE"):
            self.name()
        self.need("AS")
        self.query()
        if not self.lite and self.take("WITH"):
            if self.pg and (self.at("DATA") or self.take("NO")):
                self.need("DATA")
            else:
                self.pg and self.words("CASCADED", "LOCAL")
                self.need("CHECK")
                self.need("OPTION")

    def options(self) -> None:
        """Options of a T-SQL module: words, EXECUTE AS somebody."""
        while True:
            if self.at("EXEC", "EXECUTE"):
                self.i += 1
                self.need("AS")
                if not self.take("'"):
                    self.any_word()
            elif self.at("RETURNS", "CALLED"):
                while self.at("RETURNS", "CALLED", "NULL", "ON", "INPUT"):
                    self.i += 1
            else:
                self.any_word()
                if self.take("="):
                    self.i += 1
            if not self.take(","):
                return

    def parameters(self) -> None:
        while True:
            self.need("@")
            self.take("AS")
            self.type()
            self.take("VARYING")
            self.take("NOT")
            self.take("NULL")
            if self.take("="):
                self.take("-") or self.take("+")
                if not (self.take("0") or self.take("'") or self.take("NULL") or self.take("DEFAULT")):
                    self.name()
            self.words("OUT", "OUTPUT", "READONLY")
            if not self.take(","):
                return

    def module(self, kind: str) -> None:
        """A T-SQL procedure, function or trigger; its statements run up to GO or the end."""
        self.path()
        if kind == "TRIGGER":
            self.need("ON")
            if self.take("ALL"):
                self.need("SERVER")
            else:
                self.path()
            if self.take("WITH"):
                self.options()
            if self.take("INSTEAD"):
                self.need("OF")
            elif not self.take("FOR"):
                self.need("AFTER")
            self.any_word()
            while self.take(","):
                self.any_word()
            if self.take("NOT"):
                self.need("FOR")
                self.need("REPLICATION")
        elif kind == "FUNCTION":
            self.need("(")
            if not self.at(")"):
                self.parameters()
            self.need(")")
            self.need("RETURNS")
            if self.take("@"):
                self.need("TABLE")
                self.elements()
            elif self.take("TABLE"):
                if self.at("("):
                    self.elements()
            else:
                self.type()
            if self.take("WITH"):
                self.options()
        else:
            if self.take(";"):
                self.need("0")
            wrapped = self.take("(")
            if self.at("@"):
                self.parameters()
            if wrapped:
                self.need(")")
            if self.take("WITH"):
                self.options()
            if self.take("FOR"):
                self.need("REPLICATION")
        if kind == "FUNCTION":
            self.take("AS")
        else:
            self.need("AS")
        if self.take("EXTERNAL"):
            self.need("NAME")
            self.path()
            return
        if self.at("", "\n"):
            self.fail()
        self.statements()

    def statements(self) -> None:
        """Statements up to GO or the end."""
        while not self.at("", "\n"):
            if not self.take(";"):
                self.statement()

    def lite_trigger(self) -> None:
        self.exists()
        self.path()
        if self.take("INSTEAD"):
            self.need("OF")
        else:
            self.words("BEFORE", "AFTER")
        if self.take("UPDATE"):
            if self.take("OF"):
                self.name()
                while self.take(","):
                    self.name()
        elif not self.take("DELETE"):
            self.need("INSERT")
        self.need("ON")
        self.name()
        if self.take("FOR"):
            self.need("EACH")
            self.need("ROW")
        if self.take("WHEN"):
            self.value()
        self.need("BEGIN")
        while True:
            if self.at("INSERT", "UPDATE", "DELETE", "REPLACE"):
                self.dml()
            else:
                self.query()
            self.need(";")
            if self.take("END"):
                return

    def table(self) -> None:
        """CREATE TABLE behind the word; options behind the columns by ``table_options``."""
        self.path()
        if self.pg and self.at("PARTITION", "OF"):
            self.take("PARTITION")
            self.need("OF")
            self.path()
            if self.at("("):
                self.brackets()
            self.take("DEFAULT") or self.bounds()
            self.ends() or self.table_options()
            return
        if self.ts and self.at("AS") and self.t[self.i + 1] in ("FILETABLE", "NODE", "EDGE"):
            self.i += 2
            self.ends() or self.table_options()
            return
        if self.at("(") and not (self.pg and self.table_names()):
            self.elements()
            if self.at(";", "", "\n") or self.ts and self.t[self.i] in _STATEMENT - {"WITH"}:
                return
            if self.lite:
                while True:
                    if self.take("WITHOUT"):
                        self.name()
                    else:
                        self.need("STRICT")
                    if not self.take(","):
                        return
            self.table_options()
            return
        if self.ts:
            self.fail()
        while self.pg and not self.at("", ";", "AS"):
            self.brackets() if self.at("(") else self.any_word()
        self.need("AS")
        if self.pg and self.take("EXECUTE"):
            self.do_execute()
            return
        self.query()
        if self.pg and self.take("WITH"):
            self.take("NO")
            self.need("DATA")

    def table_options(self) -> None:
        """What may follow the columns of a table."""
        while not self.ends():
            if self.take("WITH"):
                self.option_list()
            elif self.at("ON", "TEXTIMAGE_ON", "FILESTREAM_ON", "TABLESPACE", "USING"):
                self.i += 1
                if self.pg and self.take("COMMIT"):
                    self.chain("PRESERVE", "ROWS") or self.chain("DELETE", "ROWS") or self.need("DROP")
                    continue
                self.any_word()
                if self.at("("):
                    self.names()
            elif self.pg and self.take("INHERITS"):
                self.need("(")
                self.paths()
                self.need(")")
            elif self.pg and self.take("PARTITION"):
                self.need("BY")
                self.one("RANGE", "LIST", "HASH")
                self.need("(")
                self.value()
                while self.take(","):
                    self.value()
                self.need(")")
            elif self.pg and self.take("WITHOUT"):
                self.need("OIDS")
            elif self.ts and self.take("AS"):
                self.one("NODE", "EDGE")
            else:
                self.fail()

    def table_names(self) -> bool:
        """Names of columns in brackets before AS, without types."""
        k = self.i + 1
        while self.t[k] not in ("", ")"):
            if not (self.is_name(self.t[k]) and self.t[k + 1] in (",", ")")):
                return False
            k += 1 + (self.t[k + 1] == ",")
        if self.t[k] == ")" and k > self.i + 1:
            self.i = k + 1
            return True
        return False

    def elements(self) -> None:
        self.need("(")
        if self.pg and self.take(")"):
            return
        while True:
            self.element()
            if self.take(","):
                if self.ts and self.take(")"):  # T-SQL allows a last comma
                    return
            elif not self.at("CONSTRAINT", "PRIMARY", "UNIQUE", "CHECK", "FOREIGN") or self.pg:  # these need no comma
                break
        self.need(")")

    def element(self) -> None:
        """A column or a constraint of a table."""
        if self.at("CONSTRAINT", "PRIMARY", "UNIQUE", "CHECK", "FOREIGN", "EXCLUDE", "LIKE", "INDEX", "PERIOD") and self.t[self.i + 1] not in (",", ")"):
            if self.at("EXCLUDE", "LIKE", "INDEX", "PERIOD"):
                self.i += 1
                if self.at(",", ")"):
                    self.fail()
                self.rest()
                return
            self.attributes()
            return
        self.name()
        if self.ts and self.take("AS"):
            self.value()
        elif not (self.lite and not self.is_name(self.t[self.i])) and not (self.ts and self.at(",", ")") and self.src[self.i - 1].upper() == "TIMESTAMP"):
            self.type()
        self.attributes()

    def rest(self) -> None:
        """Any tokens up to the end of an element."""
        while not self.at("", ";", ",", ")"):
            if self.at("("):
                self.brackets()
            else:
                self.i += 1

    def attributes(self) -> None:
        """Constraints of a column or a table."""
        while not self.at("", ";", ",", ")"):
            t = self.t[self.i]
            if self.ts and (t == "FOR" or t in _STATEMENT - {"WITH"}):
                return
            self.i += 1
            if t == "CONSTRAINT":
                self.name()
                if self.at(",", ")", "", ";"):
                    self.fail()
            elif t == "CHECK":
                if self.ts:
                    if self.take("NOT"):
                        self.need("FOR")
                        self.need("REPLICATION")
                self.need("(")
                self.condition()
                self.need(")")
            elif t == "DEFAULT":
                self.default()
            elif t == "NOT":
                if self.take("FOR"):
                    self.need("REPLICATION")
                elif not self.at("DEFERRABLE", "VALID", "ENFORCED"):
                    self.need("NULL")
                else:
                    self.i += 1
            elif t == "PRIMARY":
                self.need("KEY")
                self.key()
            elif t == "UNIQUE":
                if self.pg and self.take("NULLS"):
                    self.take("NOT")
                    self.need("DISTINCT")
                self.key()
            elif t == "FOREIGN":
                self.need("KEY")
                if self.at("("):
                    self.names()
                if not self.at("REFERENCES"):
                    self.fail()
            elif t == "REFERENCES":
                self.path()
                if self.at("("):
                    self.names()
                while self.at("ON", "MATCH"):
                    if self.take("MATCH"):
                        self.any_word()
                        continue
                    self.i += 1
                    if not self.take("DELETE"):
                        self.need("UPDATE")
                    if self.take("NO"):
                        self.need("ACTION")
                    elif self.take("SET"):
                        if not self.take("NULL"):
                            self.need("DEFAULT")
                        if self.pg and self.at("("):
                            self.names()
                    elif not self.take("CASCADE"):
                        self.need("RESTRICT")
            elif t == "COLLATE":
                self.path()
            elif t == "AS" and not self.ts and not (self.pg and self.at("IDENTITY")):
                self.need("(")
                self.value()
                self.need(")")
                self.take("STORED") or self.take("VIRTUAL")
            elif t == "ON" and self.lite:
                self.need("CONFLICT")
                self.any_word()
            elif t in _ATTRIBUTES[self.d]:
                if self.at("("):
                    self.brackets()
            else:
                self.i -= 1
                self.fail()

    def key(self) -> None:
        """What may follow PRIMARY KEY and UNIQUE."""
        self.words("CLUSTERED", "NONCLUSTERED", "HASH", "ASC", "DESC")
        if self.at("("):
            self.need("(")
            while True:
                self.value() if self.lite else self.column()
                self.words("ASC", "DESC")
                if not self.take(","):
                    break
            self.need(")")

    def default(self) -> None:
        """A literal, a call or brackets; in T-SQL and PostgreSQL a value of a higher rank than comparison."""
        if self.lite:
            if self.take("("):
                self.value()
                self.need(")")
            else:
                self.take("-") or self.take("+")
                if not (self.take("0") or self.take("'")):
                    self.any_word()
        else:
            self.sum()

    def alter_table(self) -> None:
        if self.pg:
            self.take("ONLY")
        self.path()
        if self.pg:
            self.take("*")
        if self.ts and self.take("WITH"):
            if not self.take("CHECK"):
                self.need("NOCHECK")
        if self.at("", ";", "\n"):
            self.fail()
        while True:
            if self.take("ADD"):
                if not self.ts:
                    self.take("COLUMN")
                    self.exists()
                self.element()
                if self.ts and self.at("FOR"):
                    self.i += 1
                    self.name()
                    self.take("WITH") and self.need("VALUES")
            elif self.take("DROP"):
                self.take("COLUMN") or self.take("CONSTRAINT")
                self.exists()
                self.name()
                if self.pg:
                    self.words("CASCADE", "RESTRICT")
            elif self.ts and self.at("ALTER") and self.t[self.i + 1] == "COLUMN":
                self.i += 2
                self.name()
                if self.at("ADD", "DROP"):
                    self.i += 1
                    self.any_word()
                else:
                    self.type()
                    self.attributes()
            elif self.lite:
                self.need("RENAME")
                if not self.take("TO"):
                    self.take("COLUMN")
                    self.name()
                    self.need("TO")
                self.name()
            elif self.pg:
                self.action()
            elif self.at("CHECK", "NOCHECK"):
                self.i += 1
                self.need("CONSTRAINT")
                self.take("ALL") or self.name()
            elif self.at("ENABLE", "DISABLE"):
                self.i += 1
                self.one("TRIGGER", "CHANGE_TRACKING")
                self.ends() or self.take("ALL") or self.name()
            elif self.at("SWITCH", "REBUILD", "SET"):
                self.i += 1
                self.rest_of(self.i) if not self.ends() else None
            else:
                self.fail()
            if self.lite or not self.take(","):
                return
            if self.ts:
                # further elements of the same ADD or DROP stand without the word
                if not self.at("ADD", "DROP", "ALTER"):
                    while True:
                        self.take("COLUMN")
                        self.element() if not self.t[self.i + 1] in (",", ";", "", "\n") and self.t[self.i + 1] not in _STATEMENT else self.name()
                        if not self.take(","):
                            return

    def ts_statement(self, t: str) -> None:
        self.i += 1
        if t == "DECLARE":
            if self.is_name(self.t[self.i]):
                self.name()
                self.cursor()
                return
            while True:
                self.need("@")
                self.take("AS")
                if self.take("TABLE"):
                    if not self.at("("):
                        self.fail()
                    self.brackets()
                elif self.take("CURSOR"):
                    pass
                else:
                    self.type()
                if self.take("="):
                    self.value()
                if not self.take(","):
                    return
        elif t == "SET":
            if self.take("@"):
                if self.at("."):
                    self.i += 1
                    self.name()
                if not self.at("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^="):
                    self.fail()
                self.i += 1
                if self.at("CURSOR"):
                    self.cursor()
                else:
                    self.value()
            elif self.take("TRANSACTION"):
                self.modes()
            else:
                self.any_word()
                while self.at(",") or self.is_name(self.t[self.i]) and self.t[self.i] not in _STATEMENT:
                    self.i += 1
                if self.at("."):
                    self.i += 1
                    self.name()
                if not (self.take("ON") or self.take("OFF")):
                    self.take("-")
                    if not (self.take("0") or self.take("@") or self.take("'") or self.t[self.i - 2] != "SET"):
                        self.fail()
        elif t in ("IF", "WHILE"):
            self.condition()
            self.statement()
            while t == "IF":  # a ladder of ELSE IF needs no depth
                if self.at(";") and self.t[self.i + 1] == "ELSE":
                    self.i += 1
                if not self.take("ELSE"):
                    break
                if not self.take("IF"):
                    self.statement()
                    break
                self.condition()
                self.statement()
        elif t == "BEGIN":
            if self.at("TRAN", "TRANSACTION", "DISTRIBUTED"):
                self.i += 1
                self.take("TRAN") or self.take("TRANSACTION")
                if self.is_name(self.t[self.i]) or self.at("@"):
                    self.i += 1
                return
            kind = "TRY" if self.take("TRY") else "CATCH" if self.take("CATCH") else ""
            while not self.at("END", "", "\n"):
                if not self.take(";"):
                    self.statement()
            self.need("END")
            if kind:
                self.need(kind)
                if kind == "TRY":
                    self.take(";")
                    if not (self.at("BEGIN") and self.t[self.i + 1] == "CATCH"):
                        self.fail()
        elif t in ("COMMIT", "ROLLBACK", "SAVE"):
            self.take("TRAN") or self.take("TRANSACTION") or self.take("WORK")
            if self.is_name(self.t[self.i]) or self.at("@"):
                self.i += 1
        elif t == "PRINT":
            self.value()
        elif t in ("EXEC", "EXECUTE"):
            self.i -= 1
            self.execute()
        elif t == "RAISERROR":
            if not self.at("("):
                self.fail()
            self.brackets()
            if self.at("WITH"):
                self.i += 1
                self.name()
        elif t == "THROW":
            if not self.at(";", "", "\n", "END"):
                self.value()
                for _ in range(2):
                    self.need(",")
                    self.value()
        elif t == "RETURN":
            if not self.at(";", "", "\n", "END") and self.t[self.i] not in _STATEMENT:
                self.value()
        elif t in ("BREAK", "CONTINUE", "CHECKPOINT"):
            return
        elif t in ("USE", "GOTO"):
            self.name()
        else:
            self.i -= 1
            self.fail()

    def script(self) -> None:
        while not self.at(""):
            if self.take(";") or self.take("\n"):
                continue
            self.statement()
            if not self.at(";", "", "\n"):
                if not self.ts:
                    self.fail()
                if self.t[self.i] not in _STATEMENT or self.at("END", "ELSE"):
                    self.fail()


def check(text: str | None, dialect: str, known: tuple[list[str], list[str]] | None = None) -> tuple[bool, str, float]:
    """(valid, reason, share of the tokens that were read before the error); known are the text's ``common_tokens``.

    Null, empty and comment-only texts are valid.  An unknown dialect raises KeyError.
    """
    if not text:
        return True, "", 1.0
    try:
        toks, src = known or tokens(text, dialect)
    except Invalid as e:
        return False, e.args[0], 0.0
    try:
        try:
            _Parser(toks, src, dialect).script()
        except Invalid as e:
            if e.args[0] != "deep":
                raise
            _deep(toks, src, dialect)
        except RecursionError:
            _deep(toks, src, dialect)
    except Invalid as e:
        return False, e.args[0], e.args[1] / max(1, len(toks))
    return True, "", 1.0


def _deep(toks: list[str], src: list[str], dialect: str) -> None:
    """Parses a script with deep nesting in a thread of its own, whose stack suffices for as many levels as there are tokens."""
    failed: list[BaseException] = []

    def run() -> None:
        p = _Parser(toks, src, dialect)
        p.cap = len(toks) + 10
        try:
            p.script()
        except BaseException as e:
            failed.append(e)

    with _DEEP:
        limit, stack = sys.getrecursionlimit(), threading.stack_size(256 << 20)
        sys.setrecursionlimit(max(limit, 20 * len(toks) + 1000))
        try:
            thread = threading.Thread(target=run)
            thread.start()
            thread.join()
        finally:
            sys.setrecursionlimit(limit)
            threading.stack_size(stack)
    if failed:
        raise failed[0]
