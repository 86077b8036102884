"""Statements that define, permit, set and maintain: one production for each kind of object and dialect.

Rare kinds (see ``RARE``) are checked for their kind, a name and balanced
brackets; all others word by word.
"""

from __future__ import annotations

# Kinds of objects that DROP takes.
DROPPED = {
    "tsql": set("TABLE VIEW PROC PROCEDURE FUNCTION TRIGGER INDEX SCHEMA SEQUENCE TYPE SYNONYM USER LOGIN ROLE DATABASE STATISTICS DEFAULT RULE ASSEMBLY CREDENTIAL CERTIFICATE".split()),
    "postgres": set("TABLE VIEW PROCEDURE FUNCTION ROUTINE TRIGGER INDEX SCHEMA SEQUENCE TYPE DOMAIN EXTENSION USER ROLE GROUP DATABASE STATISTICS AGGREGATE POLICY RULE COLLATION SERVER PUBLICATION SUBSCRIPTION TABLESPACE LANGUAGE CAST OPERATOR CONVERSION".split()),
    "sqlite": set("TABLE VIEW INDEX TRIGGER".split()),
}
# Kinds of objects of which only kind, name and brackets are checked.
RARE = {
    "tsql": set("DATABASE LOGIN CERTIFICATE CREDENTIAL ENDPOINT PARTITION FULLTEXT XML ASSEMBLY QUEUE SERVICE EVENT SERVER SECURITY APPLICATION ASYMMETRIC SYMMETRIC MASTER EXTERNAL COLUMN RESOURCE WORKLOAD SPATIAL AVAILABILITY DEFAULT RULE AGGREGATE MESSAGE CONTRACT".split()),
    "postgres": set("DATABASE AGGREGATE CAST OPERATOR COLLATION CONVERSION SERVER PUBLICATION SUBSCRIPTION TABLESPACE LANGUAGE FOREIGN EVENT STATISTICS RULE TRANSFORM ACCESS TEXT DEFAULT LARGE SYSTEM CONSTRAINT TRUSTED PROCEDURAL".split()),
    "sqlite": set(),
}
# Kinds of objects with a rule of their own, besides tables, views, modules and indexes.
RULED = {
    "tsql": {"CREATE": set("SCHEMA SEQUENCE TYPE SYNONYM USER ROLE STATISTICS".split()), "ALTER": set("INDEX SCHEMA SEQUENCE ROLE USER AUTHORIZATION".split())},
    "postgres": {"CREATE": set("SCHEMA SEQUENCE TYPE DOMAIN EXTENSION ROLE GROUP USER FUNCTION PROCEDURE TRIGGER POLICY".split()), "ALTER": set("INDEX SCHEMA SEQUENCE ROLE USER".split())},
    "sqlite": {"CREATE": set(), "ALTER": set()},
}
# Words for the properties of a PostgreSQL function, and how many words follow each.
PROPERTIES = {"IMMUTABLE": 0, "STABLE": 0, "VOLATILE": 0, "STRICT": 0, "LEAKPROOF": 0, "WINDOW": 0, "COST": 1, "ROWS": 1, "SUPPORT": 1, "PARALLEL": 1, "LANGUAGE": 1}


class Definitions:
    """Part of the parser; uses its small steps and its rules for names, types, values and queries."""

    # -- steps ---------------------------------------------------------------------
    def words(self, *words: str) -> None:
        while self.at(*words):
            self.i += 1

    def one(self, *words: str) -> None:
        if not self.at(*words):
            self.fail()
        self.i += 1

    def chain(self, *words: str) -> bool:
        """All of these words in a row, if the first is there."""
        if not self.at(words[0]):
            return False
        for w in words:
            self.need(w)
        return True

    def ends(self) -> bool:
        return self.at("", ";", "\n") or self.ts and self.begins()

    def begins(self) -> bool:
        """Whether another T-SQL statement begins here."""
        return self.begins_statement(self.i)

    def exists(self) -> None:
        if self.at("IF"):
            self.i += 1
            self.take("NOT")
            self.need("EXISTS")

    def paths(self) -> None:
        self.path()
        while self.take(","):
            self.path()

    def literal(self) -> None:
        if self.take("-") or self.take("+"):
            self.need("0")
        else:
            self.one("'", "0", "@")

    def setting(self) -> None:
        """A literal, a word or a number as value of a setting."""
        if self.at("'", "0", "@", "-", "+"):
            self.literal()
        else:
            self.any_word()

    def option_list(self) -> None:
        """Bracketed options: words, each with a value or brackets of its own."""
        self.need("(")
        while True:
            self.setting()
            while not self.at(",", ")", ""):
                if self.at("("):
                    self.brackets()
                elif not self.take("="):
                    self.setting()
            if not self.take(","):
                break
        self.need(")")

    def rest_of(self, first: int) -> None:
        """A rare kind: anything with balanced brackets up to the end of the statement, but one word at least."""
        begun = self.i
        while not self.at("", ";", "\n") and not (self.ts and self.i > begun and self.begins_statement(first)):
            if self.at("(", "["):
                self.brackets()
            elif self.at(")", "]", ","):
                if not self.take(",") or self.ends():
                    self.fail()
            else:
                self.i += 1
        if self.i == begun:
            self.fail()

    def signature(self) -> None:
        """Types of a PostgreSQL routine in brackets, each perhaps with a mode and a name."""
        self.need("(")
        if not self.at(")"):
            while True:
                self.words("IN", "OUT", "INOUT", "VARIADIC")
                if self.take("*"):
                    pass
                elif self.is_name(self.t[self.i + 1]) and not self.at("DOUBLE", "CHARACTER", "BIT", "TIMESTAMP", "TIME", "INTERVAL", "NATIONAL", "SETOF") or self.t[self.i + 1] in ("DOUBLE", "NATIONAL"):
                    self.name()
                    self.take("SETOF")
                    self.type()
                else:
                    self.take("SETOF")
                    self.type()
                if self.take("DEFAULT") or self.take("="):
                    self.value()
                if not self.take(","):
                    break
        self.need(")")

    # -- the statements --------------------------------------------------------------
    def definition(self, t: str) -> None:
        first = self.i
        self.i += 1
        rule = getattr(self, f"do_{t.lower()}", None)
        if t in ("CREATE", "ALTER"):
            self.create_or_alter(t, first)
        elif t == "ANALYSE":
            self.do_analyze()
        elif t in ("GRANT", "REVOKE", "DENY"):
            self.permission(t)
        elif rule:
            rule()
        else:
            self.fail()

    def do_explain(self) -> None:
        if self.pg and self.at("(") and self.t[self.i + 1] not in ("SELECT", "WITH", "VALUES", "TABLE", "("):
            self.option_list()
        elif self.pg:
            self.words("ANALYZE", "ANALYSE", "VERBOSE")
        elif self.take("QUERY"):
            self.need("PLAN")
        self.statement()

    def do_prepare(self) -> None:
        if self.take("TRANSACTION"):
            self.need("'")
            return
        self.name()
        if self.take("("):
            self.type()
            while self.take(","):
                self.type()
            self.need(")")
        self.need("AS")
        self.statement()

    def do_declare(self) -> None:
        self.name()
        self.words("BINARY", "INSENSITIVE", "ASENSITIVE", "NO", "SCROLL")
        self.need("CURSOR")
        if self.at("WITH", "WITHOUT"):
            self.i += 1
            self.need("HOLD")
        self.need("FOR")
        self.query()

    def do_drop(self) -> None:
        self.pg and self.take("MATERIALIZED") and (self.at("VIEW") or self.fail())
        if self.pg and self.at("FOREIGN", "EVENT", "ACCESS", "TEXT", "OWNED", "USER"):
            if self.at("OWNED"):
                self.i += 1
                self.need("BY")
                self.paths()
                self.words("CASCADE", "RESTRICT")
                return
            self.i += self.t[self.i + 1] in ("TABLE", "TRIGGER", "SERVER", "DATA", "METHOD", "SEARCH")
        kind = self.t[self.i]
        if kind not in DROPPED[self.d]:
            self.fail()
        self.i += 1
        if self.pg:
            self.take("CONCURRENTLY")
        self.exists()
        if self.pg and kind in ("CAST", "OPERATOR"):
            self.rest_of(self.i)
            return
        while True:
            self.path()
            if self.pg and kind in ("FUNCTION", "PROCEDURE", "ROUTINE", "AGGREGATE") and self.at("("):
                self.signature()
            if self.take("ON"):  # of indexes and triggers
                self.chain("ALL", "SERVER") or self.take("DATABASE") or self.path()
            if self.lite or not self.take(","):
                break
        if self.ts and kind == "INDEX" and self.at("WITH"):
            self.i += 1
            self.option_list()
        if self.pg:
            self.words("CASCADE", "RESTRICT")

    def create_or_alter(self, t: str, first: int) -> None:
        if self.take("OR"):
            if not self.take("REPLACE"):
                self.need("ALTER")
        self.words("TEMP", "TEMPORARY", "LOCAL", "GLOBAL", "UNLOGGED", "RECURSIVE", "MATERIALIZED", "CONSTRAINT" if self.pg else "TEMP")
        kind = self.t[self.i]
        self.i += 1
        if kind == "VIEW" and (t == "CREATE" or self.ts):
            self.view()
        elif kind == "TABLE":
            self.exists()
            self.table() if t == "CREATE" else self.alter_table()
        elif kind == "VIRTUAL" and self.lite and t == "CREATE":
            self.virtual_table()
        elif self.ts and kind in ("PROC", "PROCEDURE", "FUNCTION", "TRIGGER"):
            self.module(kind)
        elif self.lite and kind == "TRIGGER" and t == "CREATE":
            self.lite_trigger()
        elif t == "CREATE" and kind in ("UNIQUE", "CLUSTERED", "NONCLUSTERED", "COLUMNSTORE", "INDEX"):
            self.i -= 1
            self.index()
        elif kind in RULED[self.d][t]:
            getattr(self, f"{t.lower()}_{kind.lower()}")()
        elif t == "ALTER" and self.pg and kind not in RARE["postgres"]:
            self.altered(kind)
        elif kind in RARE[self.d]:
            self.any_word() if not self.at("(", "'") else None
            if not self.at("", ";", "\n") and not (self.ts and self.begins_statement(first)):
                self.rest_of(first)
        else:
            self.i -= 1
            self.fail()

    def virtual_table(self) -> None:
        self.need("TABLE")
        self.exists()
        self.path()
        self.need("USING")
        self.name()
        if self.at("("):
            self.brackets()

    # -- indexes ---------------------------------------------------------------------
    def index(self) -> None:
        self.take("UNIQUE")
        if self.ts:
            self.words("CLUSTERED", "NONCLUSTERED")
        columns = self.ts and self.take("COLUMNSTORE")
        self.need("INDEX")
        if self.pg:
            self.take("CONCURRENTLY")
        self.exists()
        if not (self.pg and self.at("ON")):
            self.path()
        self.need("ON")
        if self.pg:
            self.take("ONLY")
        self.path()
        if self.pg and self.take("USING"):
            self.name()
        if not columns or self.at("("):
            self.need("(")
            while True:
                self.value()
                if self.pg and self.is_name(self.t[self.i]) and not self.at("NULLS"):  # operator class
                    self.path()
                    if self.at("("):
                        self.option_list()
                self.take("ASC") or self.take("DESC")
                if self.pg and self.take("NULLS"):
                    self.one("FIRST", "LAST")
                if not self.take(","):
                    break
            self.need(")")
        if not self.lite and self.take("INCLUDE"):
            self.names()
        if self.pg and self.take("NULLS"):
            self.take("NOT")
            self.need("DISTINCT")
        if self.pg and self.take("WITH"):
            self.option_list()
        if self.pg and self.take("TABLESPACE"):
            self.name()
        if self.take("WHERE"):
            self.condition()
        if self.ts:
            if self.take("WITH"):
                self.option_list()
            if self.take("ON"):
                self.name()
                if self.at("("):
                    self.names()

    def alter_index(self) -> None:
        if self.pg:
            self.altered("INDEX")
            return
        self.take("ALL") or self.name()
        self.need("ON")
        self.path()
        self.one("REBUILD", "REORGANIZE", "DISABLE", "SET", "RESUME", "PAUSE", "ABORT")
        if self.take("PARTITION"):
            self.need("=")
            self.take("ALL") or self.value()
        if self.take("WITH") or self.at("("):
            self.option_list()

    # -- schemas, sequences, types, users -----------------------------------------------
    def create_schema(self) -> None:
        self.exists()
        if not self.at("AUTHORIZATION"):
            self.name()
        if self.take("AUTHORIZATION"):
            self.any_word()
        while self.at("CREATE", "GRANT"):  # elements of the schema
            self.statement()

    def alter_schema(self) -> None:
        self.name()
        if self.ts:
            self.need("TRANSFER")
            self.object_of()
        else:
            self.action()

    def sequence(self, changes: bool = False) -> None:
        self.exists()
        self.path()
        begun = self.i
        while True:
            if self.take("AS"):
                self.type()
            elif self.take("START") or self.take("RESTART"):
                self.take("WITH")
                self.at("0", "-", "@") and self.literal()
            elif self.take("INCREMENT"):
                self.take("BY")
                self.literal()
            elif self.take("NO"):
                self.one("MINVALUE", "MAXVALUE", "CYCLE", "CACHE")
            elif self.at("MINVALUE", "MAXVALUE", "CACHE"):
                self.i += 1
                self.at("0", "-") and self.literal()
            elif self.take("CYCLE"):
                pass
            elif self.pg and self.take("OWNED"):
                self.need("BY")
                self.path()
            else:
                break
        if changes and begun == self.i:
            self.action()

    def create_sequence(self) -> None:
        self.sequence()

    def alter_sequence(self) -> None:
        self.sequence(True)

    def create_type(self) -> None:
        self.path()
        if self.ts:
            if self.take("FROM"):
                self.type()
                self.take("NOT")
                self.take("NULL")
            else:
                self.need("AS")
                self.need("TABLE")
                self.elements()
            return
        if self.ends():
            return
        if self.at("("):
            self.option_list()
            return
        self.need("AS")
        if self.take("ENUM"):
            self.need("(")
            if not self.at(")"):
                self.need("'")
                while self.take(","):
                    self.need("'")
            self.need(")")
        elif self.take("RANGE"):
            self.option_list()
        else:
            self.elements()

    def create_domain(self) -> None:
        self.path()
        self.take("AS")
        self.type()
        self.attributes()

    def create_synonym(self) -> None:
        self.path()
        self.need("FOR")
        self.path()

    def create_extension(self) -> None:
        self.exists()
        self.name()
        self.take("WITH")
        while self.at("SCHEMA", "VERSION", "CASCADE", "FROM"):
            self.i += 1
            if self.t[self.i - 1] != "CASCADE":
                self.setting()

    def create_role(self) -> None:
        self.name()
        if self.ts:
            if self.take("AUTHORIZATION"):
                self.any_word()
            return
        self.take("WITH")
        while not self.ends():
            if self.at("PASSWORD", "VALID", "CONNECTION", "IN", "ROLE", "ADMIN", "SYSID", "USER", "ENCRYPTED"):
                self.i += 1
                self.words("UNTIL", "LIMIT", "ROLE", "PASSWORD", "GROUP")
                self.literal() if self.at("'", "0", "-") else self.take("NULL") or self.paths()
            else:
                if self.src[self.i].upper().removeprefix("NO") not in ("SUPERUSER", "CREATEDB", "CREATEROLE", "INHERIT", "LOGIN", "REPLICATION", "BYPASSRLS"):
                    self.fail()
                self.i += 1

    create_group = create_role

    def create_user(self) -> None:
        if self.pg:
            if self.take("MAPPING"):
                self.need("FOR")
                self.any_word()
                self.need("SERVER")
                self.name()
                if self.take("OPTIONS"):
                    self.option_list()
                return
            self.create_role()
            return
        self.name()
        if self.at("FOR", "FROM"):
            self.i += 1
            if self.take("EXTERNAL"):
                self.need("PROVIDER")
            else:
                self.one("LOGIN", "CERTIFICATE")
                self.name()
        elif self.take("WITHOUT"):
            self.need("LOGIN")
        if self.take("WITH"):
            self.assigned()

    def assigned(self) -> None:
        """word = value, ..."""
        while True:
            self.any_word()
            self.need("=")
            self.setting()
            if not self.take(","):
                return

    def alter_role(self) -> None:
        if self.pg:
            self.take("ALL") or self.name()
            if self.at("SET", "RESET", "RENAME"):
                self.action()
            else:
                self.i -= 1
                self.create_role()
            return
        self.name()
        if self.take("WITH"):
            self.assigned()
        else:
            self.one("ADD", "DROP")
            self.need("MEMBER")
            self.name()

    def alter_user(self) -> None:
        if self.pg:
            self.alter_role()
            return
        self.name()
        self.need("WITH")
        self.assigned()

    def alter_authorization(self) -> None:
        self.need("ON")
        self.object_of()
        self.need("TO")
        self.chain("SCHEMA", "OWNER") or self.any_word()

    def object_of(self) -> None:
        """[class ::] name"""
        if self.t[self.i + 1] == "::":
            self.i += 2
        elif self.t[self.i + 1 : self.i + 3] and self.t[self.i + 2] == "::":
            self.i += 3
        self.path()

    def create_statistics(self) -> None:
        if self.pg:
            self.rest_of(self.i)
            return
        self.name()
        self.need("ON")
        self.path()
        self.names()
        if self.take("WHERE"):
            self.condition()
        if self.take("WITH"):
            self.setting()
            while not self.ends():
                self.take(",")
                self.setting()

    # -- PostgreSQL routines, triggers, policies ---------------------------------------------
    def routine(self, returns: bool) -> None:
        self.path()
        self.signature()
        if returns and self.take("RETURNS"):
            if self.take("TABLE"):
                self.signature()
            elif self.chain("NULL", "ON", "NULL", "INPUT"):
                pass
            else:
                self.take("SETOF")
                self.type()
        body = False
        while not self.ends():
            t = self.t[self.i]
            self.i += 1
            if t in PROPERTIES:
                for _ in range(PROPERTIES[t]):
                    self.setting()
            elif t == "NOT":
                self.need("LEAKPROOF")
            elif t in ("CALLED", "RETURNS"):
                self.take("NULL")
                self.need("ON")
                self.need("NULL")
                self.need("INPUT")
            elif t in ("SECURITY", "EXTERNAL"):
                self.take("SECURITY")
                self.one("DEFINER", "INVOKER")
            elif t == "SET":
                self.path()
                if self.take("FROM"):
                    self.need("CURRENT")
                else:
                    self.take("=") or self.need("TO")
                    self.setting()
                    while self.take(","):
                        self.setting()
            elif t == "TRANSFORM":
                self.rest_of(self.i)
            elif t == "AS" and not body:
                self.need("'")
                if self.take(","):
                    self.need("'")
                body = True
            elif t == "RETURN" and not body:
                self.value()
                body = True
            elif t == "BEGIN" and not body:
                self.need("ATOMIC")
                while not self.at("END", ""):
                    self.statement()
                    self.need(";")
                self.need("END")
                body = True
            else:
                self.i -= 1
                self.fail()
        if not body:
            self.fail()

    def create_function(self) -> None:
        self.routine(True)

    def create_procedure(self) -> None:
        self.routine(False)

    def create_trigger(self) -> None:
        self.name()
        if self.take("INSTEAD"):
            self.need("OF")
        else:
            self.one("BEFORE", "AFTER")
        while True:
            if self.take("UPDATE"):
                if self.take("OF"):
                    self.name()
                    while self.take(","):
                        self.name()
            else:
                self.one("INSERT", "DELETE", "TRUNCATE")
            if not self.take("OR"):
                break
        self.need("ON")
        self.path()
        if self.take("FROM"):
            self.path()
        self.take("NOT")
        self.take("DEFERRABLE")
        if self.take("INITIALLY"):
            self.one("IMMEDIATE", "DEFERRED")
        if self.take("REFERENCING"):
            while self.at("OLD", "NEW"):
                self.i += 1
                self.need("TABLE")
                self.take("AS")
                self.name()
        if self.take("FOR"):
            self.take("EACH")
            self.one("ROW", "STATEMENT")
        if self.take("WHEN"):
            self.need("(")
            self.condition()
            self.need(")")
        self.need("EXECUTE")
        self.one("FUNCTION", "PROCEDURE")
        self.path()
        self.call()

    def create_policy(self) -> None:
        self.name()
        self.need("ON")
        self.path()
        if self.take("AS"):
            self.one("PERMISSIVE", "RESTRICTIVE")
        if self.take("FOR"):
            self.one("ALL", "SELECT", "INSERT", "UPDATE", "DELETE")
        if self.take("TO"):
            self.any_word()
            while self.take(","):
                self.any_word()
        if self.take("USING"):
            self.need("(")
            self.condition()
            self.need(")")
        if self.chain("WITH", "CHECK"):
            self.need("(")
            self.condition()
            self.need(")")

    def altered(self, kind: str) -> None:
        """ALTER of a PostgreSQL object other than a table."""
        if kind not in DROPPED["postgres"] | {"VIEW"}:
            self.fail()
        self.exists()
        self.path()
        if self.at("("):
            self.signature()
        if self.take("ON"):
            self.path()
        if kind == "TYPE" and self.chain("ADD", "VALUE"):
            self.exists()
            self.need("'")
            if self.at("BEFORE", "AFTER"):
                self.i += 1
                self.need("'")
            return
        if kind == "TYPE" and self.chain("RENAME", "VALUE"):
            self.need("'")
            self.need("TO")
            self.need("'")
            return
        if kind in ("FUNCTION", "PROCEDURE", "ROUTINE", "EXTENSION", "POLICY", "DOMAIN", "TYPE", "TRIGGER", "GROUP", "DATABASE") and not self.at("RENAME", "OWNER"):
            self.rest_of(self.i)
            return
        self.action()

    def action(self) -> None:
        """What may be done to most PostgreSQL objects and to tables."""
        if self.take("RENAME"):
            if not self.take("TO"):
                self.take("COLUMN") or self.take("CONSTRAINT") or self.take("ATTRIBUTE")
                self.name()
                self.need("TO")
            self.name()
        elif self.take("OWNER"):
            self.need("TO")
            self.any_word()
        elif self.take("SET"):
            if self.take("SCHEMA") or self.take("TABLESPACE"):
                self.name()
            elif self.at("("):
                self.option_list()
            elif self.at("LOGGED", "UNLOGGED") or self.at("WITHOUT") and self.t[self.i + 1] in ("OIDS", "CLUSTER"):
                self.i += 1 + self.at("WITHOUT")
            elif self.chain("ACCESS", "METHOD"):
                self.any_word()
            else:
                self.path()
                self.take("=") or self.need("TO")
                self.setting()
                while self.take(","):
                    self.setting()
        elif self.take("RESET"):
            self.option_list() if self.at("(") else self.any_word()
        elif self.at("ENABLE", "DISABLE", "FORCE", "NO") and self.t[self.i + 1] in ("ROW", "TRIGGER", "RULE", "ALWAYS", "REPLICA", "FORCE", "INHERIT"):
            self.i += 1
            self.words("ALWAYS", "REPLICA", "FORCE")
            if self.take("ROW"):
                self.need("LEVEL")
                self.need("SECURITY")
            elif self.take("INHERIT"):
                self.path()
            else:
                self.one("TRIGGER", "RULE")
                self.any_word()
        elif self.take("VALIDATE"):
            self.need("CONSTRAINT")
            self.name()
        elif self.at("ATTACH", "DETACH"):
            joins = self.take("ATTACH") or not self.take("DETACH")
            self.need("PARTITION")
            self.path()
            if joins and not self.ends():
                self.take("DEFAULT") or self.bounds()
            self.words("CONCURRENTLY", "FINALIZE")
        elif self.take("CLUSTER"):
            self.need("ON")
            self.name()
        elif self.take("INHERIT"):
            self.path()
        elif self.take("REPLICA"):
            self.need("IDENTITY")
            self.rest_of(self.i)
        elif self.take("ALTER"):
            self.take("COLUMN") or self.take("CONSTRAINT")
            self.name()
            if self.take("TYPE") or self.t[self.i + 1] == "DATA" and self.chain("SET", "DATA", "TYPE"):
                self.type()
                if self.take("COLLATE"):
                    self.path()
                if self.take("USING"):
                    self.value()
            elif self.take("DROP"):
                self.chain("NOT", "NULL") or self.one("DEFAULT", "IDENTITY", "EXPRESSION")
                self.exists()
            elif self.take("SET"):
                if self.take("DEFAULT"):
                    self.value()
                elif self.at("("):
                    self.option_list()
                elif not self.chain("NOT", "NULL"):
                    self.one("STATISTICS", "STORAGE", "COMPRESSION", "GENERATED")
                    self.setting()
                    self.take("DEFAULT")
            elif self.take("RESET"):
                self.option_list()
            elif self.chain("ADD", "GENERATED"):
                self.rest_of(self.i)
            else:
                self.words("NOT", "DEFERRABLE", "INITIALLY", "IMMEDIATE", "DEFERRED")
        else:
            self.fail()

    def bounds(self) -> None:
        """Values of a partition."""
        self.need("FOR")
        self.need("VALUES")
        if self.take("WITH"):
            self.brackets()
            return
        ends = 1
        if not self.take("IN"):
            self.need("FROM")
            ends = 2
        for k in range(ends):
            if k:
                self.need("TO")
            self.need("(")
            self.value()
            while self.take(","):
                self.value()
            self.need(")")

    # -- permissions -----------------------------------------------------------------
    def permission(self, t: str) -> None:
        if t == "REVOKE":
            for w in ("GRANT", "ADMIN"):
                self.chain(w, "OPTION", "FOR")
        while True:
            self.any_word()
            while not self.at(",", "ON", "TO", "FROM", "(") and not self.ends():  # some permissions have several words
                self.granted_word()
            if self.at("("):
                self.names()
            if not self.take(","):
                break
        if self.take("ON"):
            if self.pg:
                if self.take("ALL"):
                    self.one("TABLES", "SEQUENCES", "FUNCTIONS", "PROCEDURES", "ROUTINES")
                    self.need("IN")
                    self.need("SCHEMA")
                elif self.t[self.i + 1] not in (".", ",", "TO", "FROM", "("):
                    self.one("TABLE", "SEQUENCE", "FUNCTION", "PROCEDURE", "ROUTINE", "SCHEMA", "DATABASE", "DOMAIN", "TYPE", "LANGUAGE", "TABLESPACE", "FOREIGN", "LARGE", "PARAMETER")
                    self.words("DATA", "WRAPPER", "SERVER", "OBJECT")
                self.path()
                if self.at("("):
                    self.signature()
                while self.take(","):
                    self.path()
                    if self.at("("):
                        self.signature()
            else:
                self.object_of()
                if self.at("("):
                    self.names()
        self.one("TO", "FROM") if t == "REVOKE" else self.need("TO")
        self.grantee()
        while self.take(","):
            self.grantee()
        if self.take("WITH"):
            self.one("GRANT", "ADMIN", "INHERIT", "SET")
            self.one("OPTION", "TRUE", "FALSE")
        if self.chain("GRANTED", "BY"):
            self.any_word()
        if self.ts and self.take("AS"):
            self.any_word()
        self.words("CASCADE", "RESTRICT")

    def granted_word(self) -> None:
        """A further word of a permission, such as VIEW DEFINITION."""
        if self.src[self.i].upper() not in (
            "ANY DEFINITION STATE CHANGE TRACKING OPTION DATABASE SCHEMA TABLE VIEW PROCEDURE FUNCTION TYPE LOGIN USER ROLE SERVER CONTROL PRIVILEGES SYSTEM CONNECTION REFERENCES SECURITY POLICY TRACE BULK OPERATIONS AUDIT CONNECT SQL".split()
        ):
            self.fail()
        self.i += 1

    def grantee(self) -> None:
        if self.pg and self.take("GROUP"):
            self.name()
        else:
            self.any_word()

    # -- cursors, maintenance, settings: T-SQL --------------------------------------------
    def handle(self) -> None:
        self.take("GLOBAL")
        self.take("@") or self.name()

    def do_open(self) -> None:
        self.handle()

    def do_close(self) -> None:
        self.pg and self.take("ALL") or self.handle()

    def do_deallocate(self) -> None:
        self.take("PREPARE")
        self.pg and self.take("ALL") or self.handle()

    def do_fetch(self) -> None:
        if self.at("NEXT", "PRIOR", "FIRST", "LAST", "FORWARD", "BACKWARD", "ABSOLUTE", "RELATIVE", "ALL", "0", "-"):
            if self.at("0", "-"):
                self.literal()
            else:
                self.i += 1
                self.at("0", "-", "@") and self.literal() or self.take("ALL")
            if not (self.pg and self.take("IN")):
                self.need("FROM") if self.ts else self.take("FROM")
        else:
            self.take("FROM") or self.pg and self.take("IN")
        self.handle()
        if self.ts and self.take("INTO"):
            self.need("@")
            while self.take(","):
                self.need("@")

    do_move = do_fetch

    def do_waitfor(self) -> None:
        self.one("DELAY", "TIME")
        self.one("'", "@")

    def do_kill(self) -> None:
        self.literal()

    def do_dbcc(self) -> None:
        self.any_word()
        if self.at("("):
            self.brackets()
        if self.take("WITH"):
            self.any_word()
            while self.take(","):
                self.any_word()

    def do_backup(self) -> None:
        self.one("DATABASE", "LOG")
        self.take("@") or self.name()
        first = self.i
        self.one("TO", "FROM")
        self.rest_of(first)

    do_restore = do_backup

    def do_bulk(self) -> None:
        self.need("INSERT")
        self.path()
        self.need("FROM")
        self.one("'", "@")
        if self.take("WITH"):
            self.option_list()

    # -- the same: PostgreSQL and SQLite ----------------------------------------------------
    def do_copy(self) -> None:
        if self.take("("):
            self.dml() if self.at("INSERT", "UPDATE", "DELETE") else self.query()
            self.need(")")
        else:
            self.path()
            if self.at("("):
                self.names()
        self.one("FROM", "TO")
        if self.take("PROGRAM"):
            self.need("'")
        else:
            self.one("'", "STDIN", "STDOUT")
        if self.take("WITH") and self.at("(") or self.at("("):
            self.option_list()
        elif not self.ends() and not self.at("WHERE"):
            while not self.ends() and not self.at("WHERE"):
                self.setting()
                self.take("AS")
                self.take(",")
        if self.take("WHERE"):
            self.condition()

    def do_vacuum(self) -> None:
        if self.lite:
            if not self.ends() and not self.at("INTO"):
                self.name()
            if self.take("INTO"):
                self.value()
            return
        self.option_list() if self.at("(") else self.words("FULL", "FREEZE", "VERBOSE", "ANALYZE", "ANALYSE")
        self.tables_with_columns()

    def do_analyze(self) -> None:
        if self.lite:
            self.ends() or self.path()
            return
        self.option_list() if self.at("(") else self.take("VERBOSE")
        self.tables_with_columns()

    def tables_with_columns(self) -> None:
        if self.ends():
            return
        while True:
            self.path()
            if self.at("("):
                self.names()
            if not self.take(","):
                return

    def do_reindex(self) -> None:
        if self.lite:
            self.ends() or self.path()
            return
        if self.at("("):
            self.option_list()
        self.one("INDEX", "TABLE", "SCHEMA", "DATABASE", "SYSTEM")
        self.take("CONCURRENTLY")
        self.path()

    def do_cluster(self) -> None:
        self.option_list() if self.at("(") else self.take("VERBOSE")
        if not self.ends():
            self.path()
            if self.take("USING"):
                self.name()

    def do_refresh(self) -> None:
        self.need("MATERIALIZED")
        self.need("VIEW")
        self.take("CONCURRENTLY")
        self.path()
        if self.take("WITH"):
            self.take("NO")
            self.need("DATA")

    def do_comment(self) -> None:
        self.need("ON")
        self.any_word()
        self.words("VIEW", "TABLE", "DATA", "WRAPPER", "TRIGGER", "METHOD", "SEARCH", "CONFIGURATION", "DICTIONARY")
        self.path()
        if self.at("("):
            self.signature()
        if self.take("ON"):
            self.take("DOMAIN")
            self.path()
        self.need("IS")
        self.one("'", "NULL")

    def do_do(self) -> None:
        if self.take("LANGUAGE"):
            self.name()
        self.need("'")
        if self.take("LANGUAGE"):
            self.name()

    def do_call(self) -> None:
        self.path()
        self.call()

    def do_lock(self) -> None:
        self.take("TABLE")
        self.take("ONLY")
        self.paths()
        if self.take("IN"):
            self.one("ACCESS", "ROW", "SHARE", "EXCLUSIVE")
            self.words("ROW", "SHARE", "UPDATE", "EXCLUSIVE")
            self.need("MODE")
        self.take("NOWAIT")

    def do_listen(self) -> None:
        self.name()

    def do_unlisten(self) -> None:
        self.take("*") or self.name()

    def do_notify(self) -> None:
        self.name()
        if self.take(","):
            self.need("'")

    def do_execute(self) -> None:
        self.name()
        if self.at("("):
            self.call()

    def do_discard(self) -> None:
        self.one("ALL", "PLANS", "SEQUENCES", "TEMP", "TEMPORARY")

    def do_reset(self) -> None:
        self.chain("SESSION", "AUTHORIZATION") or self.take("ALL") or self.setting_name()

    def do_show(self) -> None:
        self.chain("TIME", "ZONE") or self.take("ALL") or self.setting_name()

    def setting_name(self) -> None:
        self.any_word()
        while self.take("."):
            self.any_word()

    def do_savepoint(self) -> None:
        self.name()

    def do_release(self) -> None:
        self.take("SAVEPOINT")
        self.name()

    def do_reassign(self) -> None:
        self.need("OWNED")
        self.need("BY")
        self.paths()
        self.need("TO")
        self.any_word()

    def do_security(self) -> None:
        self.need("LABEL")
        self.rest_of(self.i)

    def do_checkpoint(self) -> None:
        pass

    def do_load(self) -> None:
        self.need("'")

    def do_pragma(self) -> None:
        self.path()
        if self.take("="):
            self.pragma_value()
        elif self.take("("):
            self.pragma_value()
            self.need(")")

    def pragma_value(self) -> None:
        if self.at("'", "0", "-", "+", "@"):
            self.literal()
        else:
            self.any_word()

    def do_attach(self) -> None:
        self.take("DATABASE")
        self.value()
        self.need("AS")
        self.value()

    def do_detach(self) -> None:
        self.take("DATABASE")
        self.value()

    def pg_set(self) -> None:
        """SET of PostgreSQL, behind the word."""
        self.words("SESSION", "LOCAL")
        if self.at("TRANSACTION", "CHARACTERISTICS"):
            self.i += 1
            self.modes()
        elif self.chain("AS", "TRANSACTION") or self.t[self.i - 1] == "SESSION" and self.at("AUTHORIZATION"):
            self.i += self.at("AUTHORIZATION")
            self.setting()
        elif self.chain("TIME", "ZONE"):
            self.setting() if not self.at("INTERVAL") else self.value()
        elif self.at("ROLE", "NAMES", "SCHEMA") and self.t[self.i + 1] not in ("=", "TO"):
            self.i += 1
            self.setting()
        elif self.take("CONSTRAINTS"):
            self.take("ALL") or self.paths()
            self.one("DEFERRED", "IMMEDIATE")
        else:
            self.setting_name()
            self.take("=") or self.need("TO")
            self.setting()
            while self.take(","):
                self.setting()

    def modes(self) -> None:
        """Modes of a transaction; one at least."""
        while True:
            if self.take("ISOLATION"):
                self.need("LEVEL")
                self.chain("REPEATABLE", "READ") or self.take("SERIALIZABLE") or self.take("SNAPSHOT") or (self.take("READ") and self.one("COMMITTED", "UNCOMMITTED")) or self.t[self.i - 1] in ("COMMITTED", "UNCOMMITTED") or self.fail()
            elif self.take("READ"):
                self.one("ONLY", "WRITE")
            elif self.take("NOT"):
                self.need("DEFERRABLE")
            elif not self.take("DEFERRABLE"):
                self.fail()
            if not self.take(",") and not self.at("ISOLATION", "READ", "NOT", "DEFERRABLE"):
                return

    def transaction(self, t: str) -> None:
        """BEGIN, START, COMMIT, END, ABORT and ROLLBACK of PostgreSQL and SQLite, behind the word."""
        if self.lite and t == "BEGIN":
            self.words("DEFERRED", "IMMEDIATE", "EXCLUSIVE")
        if t == "START":
            self.need("TRANSACTION")
        elif t in ("COMMIT", "ROLLBACK") and self.pg and self.take("PREPARED"):
            self.need("'")
            return
        else:
            self.take("TRANSACTION") or self.pg and self.take("WORK")
        if t in ("BEGIN", "START"):
            if self.pg and not self.ends():
                self.modes()
        else:
            if t == "ROLLBACK" and self.take("TO"):
                self.take("SAVEPOINT")
                self.name()
            elif self.pg and self.take("AND"):
                self.take("NO")
                self.need("CHAIN")
