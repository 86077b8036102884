"""p5: source files that do not parse.

Languages are ranked by their tokens in the file, and the file is parsed by all
supported grammars in that order.  A file is valid if the grammar of its dialect
is among those that accept it.  Of an invalid file, the first foreign grammar
that accepts it names its language (``wrong extension``); if none does, it is
corrupt: truncated, in conflict, or damaged.

JavaScript, C#, PowerShell, shell and Markdown have no grammar here. They are
told by tokens alone, and only of files that no grammar accepts: several tokens
of the language, more than of any SQL dialect, with brackets, quotes and block
words in order.

Defined results: null, empty and comment-only bodies are valid; an unknown or
null dialect is checked against all SQL dialects and valid if one accepts it.
"""

from __future__ import annotations

import ast
import json
import re
import warnings
from html.parser import HTMLParser
from xml.parsers import expat

from pyspark.sql import DataFrame, functions as F, types as T

from ..plans.spread import spread
from .sqlgrammar import BLANK, CONFLICT, DIALECTS, check, common_tokens

# Words and other tokens, in lower case, that speak for a language; each distinct one counts one.
EVIDENCE = {
    "tsql": ("go nvarchar nocount dbo getdate top apply varchar isnull datetime2", r"@\w+|\[\w+\]"),
    "postgres": ("ilike returning serial now json jsonb limit interval plpgsql", r"::\w+|\$\$"),
    "sqlite": ("pragma autoincrement rowid ifnull strftime limit glob", r"`\w+`"),
    "python": ("import def elif self print lambda yield none", r":\n\s+\w"),
    "javascript": ("const let function require module exports null undefined typeof", r"=>|===|`[^`]*\$\{"),
    "csharp": ("using namespace public private static void class string", r"\bget;|\bset;"),
    "powershell": ("param foreach write-host", r"\$\w+\s*=|\b(?:get|set|new|invoke|write|import|export|foreach)-\w+|-eq\b"),
    "shell": ("fi done echo esac then do", r"#!.*\bsh\b|\$\{?\w+|\bset -\w"),
    "html": ("html body div href", r"<(?:html|body|table|div|p|h\d|tr|td|head)\b|</(?:html|body|table|div|p)>|<!doctype"),
    "xml": ("xml xmlns", r"<\?xml|</[\w:.-]+>|/>|<[\w:.-]+\s+[\w:.-]+=\""),
    "json": ("", r"\"[\w ]+\"\s*:|[{\[]\s*\n|\n\s*[}\]]"),
    "yaml": ("", r"\n[\w-]+:(?:\s|$)|\n\s*- \w+"),
    "markdown": ("", r"(?:^|\n)#{1,6}\s|\n\s*[*-]\s|\n```|\]\([^)]+\)|\*\*\w"),
    "csv": ("", r"[;\t|](?=[\w\"-])"),
}
_EVIDENCE = {k: (frozenset(w.split()), re.compile(rx)) for k, (w, rx) in EVIDENCE.items()}
_WORDS = re.compile(r"[a-z]\w*(?:-\w+)?")


def rank(text: str) -> dict[str, int]:
    """All languages with the number of different tokens of theirs in the text, most first."""
    low = text.lower()
    words = set(_WORDS.findall(low))
    hits = {k: len(own & words) + len(set(rx.findall(low))) for k, (own, rx) in _EVIDENCE.items()}
    return dict(sorted(hits.items(), key=lambda x: (-x[1], x[0])))


class _Tags(HTMLParser):
    VOID = set("area base br col embed hr img input link meta source track wbr p li td tr th".split())

    def __init__(self):
        super().__init__()
        self.open, self.bad, self.seen = [], False, 0

    def handle_starttag(self, tag, attrs):
        self.seen += 1
        if tag not in self.VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.VOID:
            return
        if not self.open or self.open.pop() != tag:
            self.bad = True


def _html(text: str) -> bool:
    t = _Tags()
    t.feed(text)
    t.close()
    return bool(t.seen) and not t.bad and not t.open and text.lstrip()[:1] == "<"


def _xml(text: str) -> bool:
    try:
        expat.ParserCreate().Parse(text.strip().encode("utf-8", "replace"), True)
        return True
    except expat.ExpatError:
        return False


def _json(text: str) -> bool:
    try:
        return isinstance(json.loads(text), (dict, list))
    except ValueError:
        return False


def _python(text: str) -> bool:
    """More than bare names and literals, of which any word is one."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return any(not (isinstance(n, ast.Expr) and isinstance(n.value, (ast.Name, ast.Constant))) for n in ast.parse(text).body)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False


def _yaml(text: str) -> bool:
    """Several entries of a mapping or a list; null bytes and the like are no YAML."""
    import yaml

    # the events are enough, and the first one that is no collection ends the parse
    depth = entries = 0
    try:
        for e in yaml.parse(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
            if isinstance(e, (yaml.MappingStartEvent, yaml.SequenceStartEvent)):
                entries += depth == 1
                depth += 1
            elif isinstance(e, (yaml.MappingEndEvent, yaml.SequenceEndEvent)):
                depth -= 1
            elif isinstance(e, (yaml.ScalarEvent, yaml.AliasEvent)):
                if not depth:
                    return False
                entries += depth == 1
    except (yaml.YAMLError, ValueError, RecursionError):
        return False
    return entries > 1


def _csv(text: str) -> bool:
    lines = [x for x in text.strip().splitlines() if x.strip()]
    return len(lines) > 1 and any(n and all(x.count(d) == n for x in lines) for d in ",;\t|" for n in [lines[0].count(d)])


_BRACKETED = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|//[^\n]*|(?<!\S)#[^\n]*|/\*.*?\*/|([{\[(])|([}\])])|([\"'`])", re.S)


def _bracketed(text: str) -> bool:
    """Brackets and quotes close in order: the check for languages without a parser here."""
    stack = []
    for m in _BRACKETED.finditer(text):
        if m[1]:
            stack.append(m[1])
        elif m[2]:
            if not stack or stack.pop() + m[2] not in ("()", "[]", "{}"):
                return False
        elif m[3]:
            return False
    return not stack


def _shell(text: str) -> bool:
    count = lambda w: len(re.findall(rf"(?m)(?:^|[;&|\s]){w}(?=$|[;\s])", text))
    return count("if") == count("fi") and count("do") == count("done") and count("case") == count("esac") and text.startswith("#!")


def _markdown(text: str) -> bool:
    return bool(re.match(r"\s*#{1,6}\s", text)) and text.count("```") % 2 == 0


FOREIGN = {"json": _json, "xml": _xml, "html": _html, "python": _python, "yaml": _yaml, "csv": _csv}
BY_TOKENS = {"javascript": _bracketed, "csharp": _bracketed, "powershell": _bracketed, "shell": _shell, "markdown": _markdown}
# Fixed value: different tokens that tell a language without a grammar.
TELLING = 2
_EMPTY = re.compile(f"[{BLANK}]*")


def accepted(text: str, order: list[str]) -> tuple[list[str], dict[str, str]]:
    """Languages whose grammars accept the text, in the order of the ranking, and why the SQL dialects among the others don't."""
    out, why, known = [], {}, common_tokens(text)
    for k in order:
        if k in DIALECTS:
            valid, reason, _ = check(text, k, known)
            if not valid:
                why[k] = reason
        else:
            valid = k in FOREIGN and FOREIGN[k](text)
        if valid:
            out.append(k)
    return out, why


def diagnose(text: str | None, dialect: str | None) -> tuple[bool, str, str, list[str]]:
    """(valid, cause, language, parses): cause is wrong extension, conflict, truncated or corrupt; parses lists all grammars that accept the file."""
    if not text or _EMPTY.fullmatch(text):
        return True, "", dialect or "", list(DIALECTS)
    hits = rank(text)
    parses, why = accepted(text, list(hits))
    own = [d for d in (DIALECTS if dialect not in DIALECTS else (dialect,))]
    good = [k for k in parses if k in own]
    if good:
        return True, "", good[0], parses
    reason = why.get(dialect, "syntax")
    if reason == "conflict" or CONFLICT.search(text):
        return False, "conflict", dialect or "", parses
    if parses:
        return False, "wrong extension", parses[0], parses
    most = max(hits[d] for d in DIALECTS)
    for k, n in hits.items():
        if k in BY_TOKENS and n >= TELLING and n > most and BY_TOKENS[k](text):
            return False, "wrong extension", k, parses
    return False, "truncated" if reason in ("end", "open") else "corrupt", dialect or "", parses


RESULT = T.StructType([T.StructField("valid", T.BooleanType()), T.StructField("cause", T.StringType()), T.StructField("language", T.StringType()), T.StructField("parses", T.ArrayType(T.StringType()))])


@F.pandas_udf(RESULT)
def _diagnosed(bodies, dialects):
    import pandas as pd

    seen: dict = {}
    for k in zip(bodies, dialects):
        if k not in seen:
            seen[k] = diagnose(*k)
    return pd.DataFrame([seen[k] for k in zip(bodies, dialects)], columns=RESULT.names)


# Not deterministic to the optimizer: a filter on its result would otherwise run it twice.
_diagnosed = _diagnosed.asNondeterministic()


def parsed_files(df: DataFrame, key: str = "id", body: str = "body", dialect: str = "dialect", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, dialect, the kept columns, valid, cause, language, parses; one row per input row. A narrow map, no shuffle."""
    cols = [F.col(key), F.col(dialect), *map(F.col, keep)]
    return spread(df.select(*cols, body)).select(*cols, _diagnosed(F.col(body), F.lower(F.col(dialect))).alias("_r")).select(key, dialect, *keep, "_r.valid", "_r.cause", "_r.language", "_r.parses")


def invalid_files(df: DataFrame) -> DataFrame:
    """query_id of the files that are not valid in their dialect; a file delivered twice gives one row."""
    return parsed_files(df).where(~F.col("valid")).select(F.col("id").alias("query_id")).distinct()


def invalid_rates(df: DataFrame) -> DataFrame:
    """files, invalid and rate per project and dialect; an id counts once."""
    one = parsed_files(df, keep=("project",)).groupBy("id", "project", "dialect").agg(F.min("valid").alias("valid"))
    return one.groupBy("project", "dialect").agg(
        F.count("*").alias("files"),
        F.sum((~F.col("valid")).cast("long")).alias("invalid"),
        F.round(F.avg((~F.col("valid")).cast("double")), 6).alias("rate"),
    )


def grammar_counts(df: DataFrame) -> DataFrame:
    """files per dialect, grammar that accepts them, and whether they are valid; an id counts once, a file that no grammar accepts under an empty name."""
    rows = parsed_files(df).select("id", "dialect", "valid", F.explode(F.when(F.size("parses") > 0, F.col("parses")).otherwise(F.array(F.lit("")))).alias("grammar")).distinct()
    return rows.groupBy("dialect", "grammar", "valid").agg(F.count("*").alias("files"))
