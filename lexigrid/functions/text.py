"""Scalar functions over text columns; all are JVM expressions unless they say otherwise."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F, types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARAM = r"\{\{(\w+)\}\}"


def ascii_fold(c: Column) -> Column:
    """Case folding of ASCII letters only, as in a NOCASE comparison: É and é stay apart. Null stays null."""
    return F.translate(c, UPPER, LOWER)


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """Lower-case letters with diacritics and their plain Latin letters, by canonical decomposition."""
    src, dst = [], []
    for o in range(0xC0, 0x1F00):
        c = chr(o)
        d = unicodedata.normalize("NFD", c)
        if len(d) > 1 and d[0].isascii() and d[0].isalpha() and all(unicodedata.combining(x) for x in d[1:]) and c == c.lower():
            src.append(c)
            dst.append(d[0].lower())
    # the index also folds the final sigma
    return "".join(src) + "ς", "".join(dst) + "σ"


def tokens(c: Column) -> Column:
    """Tokens of the full-text index: lower case, no diacritics, runs of letters and digits. Null gives an empty array."""
    src, dst = accent_table()
    plain = F.regexp_replace(F.translate(F.lower(F.coalesce(c, F.lit(""))), src, dst), r"\p{Mn}+", "")
    return F.filter(F.split(plain, r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


def fold_tokens(text: str) -> list[tuple[str, int, int]]:
    """The same tokens on the driver or in a UDF, each with its start and end in the text."""
    src, dst = accent_table()
    table = dict(zip(src, dst))
    out = []
    for m in re.finditer(r"[^\W_][^\W_̀-ͯ]*(?:[̀-ͯ]+[^\W_]*)*", text):
        w = "".join(table.get(c, c) for c in m[0].lower() if not "̀" <= c <= "ͯ")
        if w:
            out.append((w, m.start(), m.end()))
    return out


def template_params(c: Column) -> Column:
    """Unique {{name}} parameters in the order of first sight."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?U)" + PARAM), F.lit(1)))


def apply_template(body: Column, params: Column) -> Column:
    """Fill {{name}} from a map in one pass; unknown names stay and values aren't expanded again.

    The text is cut at its parameters once, and each part is replaced on its own.
    """
    marks = F.regexp_extract_all(body, F.lit(r"(?U)\{\{\w+\}\}"), F.lit(0))
    gaps = F.split(body, r"(?U)\{\{\w+\}\}", -1)
    filled = F.transform(marks, lambda m: F.coalesce(F.try_element_at(params, F.substring(m, 3, F.length(m) - 4)), m))
    woven = F.zip_with(gaps, filled, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.array_join(woven, "")


def safe_filename(title: Column) -> Column:
    """File stem of a title: trimmed, lower case, word characters, blanks and underscores as one underscore; never empty.

    Word characters are letters, numbers of any kind and the underscore; the separators U+001C to U+001F count as blanks.
    """
    name = F.lower(F.regexp_replace(title, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", ""))
    name = F.regexp_replace(F.regexp_replace(name, r"(?U)[^\p{L}\p{N}_\s\x1C-\x1F-]", ""), r"(?U)[\s\x1C-\x1F_]+", "_")
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("query"))


def relative_date(iso: Column, today: Column, unit: bool = False) -> Column:
    """today, yesterday, Nd, Nw, Nmo, Ny; '' for an empty or unreadable date. A date to come counts as days."""
    days = F.datediff(today, F.try_to_date(F.substring(iso, 1, 10), "yyyy-MM-dd"))
    label = (
        F.when(days == 0, "today")
        .when(days == 1, "yesterday")
        .when(days < 7, F.concat(days.cast("string"), F.lit("d")))
        .when(days < 30, F.concat(F.floor(days / 7).cast("string"), F.lit("w")))
        .when(days < 365, F.concat(F.floor(days / 30).cast("string"), F.lit("mo")))
        .otherwise(F.concat(F.floor(days / 365).cast("string"), F.lit("y")))
    )
    return F.when(days.isNull(), "").otherwise(label)


def meta_label(tables: Column, iso: Column, today: Column) -> Column:
    """First table, or else the relative date."""
    return F.coalesce(F.try_element_at(tables, F.lit(1)), relative_date(iso, today))


def input_tags(raw: Column) -> Column:
    """Tags typed into a box: commas and blanks part them, # is cut off, lower case, each once."""
    parts = F.split(F.replace(raw, F.lit(","), F.lit(" ")), r"(?U)\s+")
    bare = F.transform(parts, lambda t: F.lower(F.regexp_replace(t, "^#+|#+$", "")))
    return F.array_distinct(F.filter(bare, lambda t: t != ""))


def template_tags(raw: Column) -> Column:
    """Tags of a template dialog: parted by commas only; repeated ones stay."""
    return F.filter(F.transform(F.split(raw, ","), lambda t: F.lower(F.regexp_replace(t, r"(?U)^\s+|\s+$", ""))), lambda t: t != "")


def stored_tags(tags: Column) -> Column:
    """Tags as the index keeps them: trimmed, lower case, not empty, each once."""
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.lower(F.regexp_replace(t, r"(?U)^\s+|\s+$", ""))), lambda t: t != ""))


def chips(tags: Column, n: int = 2) -> Column:
    """The first tags of a sorted list, as a row of a result list shows them."""
    return F.slice(F.array_sort(tags), 1, n)


def word_occurrences(body: Column, token: str) -> Column:
    """How often a token stands as a whole word, whatever its case; 0 for a token of fewer than two characters."""
    if len(token) < 2:
        return F.lit(0)
    return F.regexp_count(body, F.lit(rf"(?iu)\b\Q{token}\E\b"))


def first_occurrence(body: Column, token: str) -> Column:
    """Position of the first whole-word occurrence, from 1; 0 if there is none."""
    return F.regexp_instr(body, F.lit(rf"(?iu)\b\Q{token}\E\b"))


# Words the editor shows as keywords.
KEYWORDS = (
    "SELECT FROM WHERE JOIN INNER LEFT RIGHT OUTER FULL ON GROUP BY ORDER HAVING INSERT INTO VALUES UPDATE SET DELETE CREATE TABLE ALTER DROP AS AND OR "
    "NOT NULL IS IN EXISTS BETWEEN LIKE TOP DISTINCT UNION ALL CASE WHEN THEN ELSE END WITH CROSS APPLY OVER PARTITION DECLARE EXEC EXECUTE USE ASC "
    "DESC PRIMARY KEY FOREIGN REFERENCES DEFAULT CHECK"
).split()


def lexical_counts(body: Column) -> dict[str, Column]:
    """Keywords, strings, numbers and comments of a text; what stands in a comment is no keyword, and so on."""
    noted = F.regexp_replace(body, r"(?s)/\*.*?(?:\*/|\z)", " ")
    bare = F.regexp_replace(noted, r"--[^\n]*", " ")
    unquoted = F.regexp_replace(bare, r"'[^'\n]*'", " ")
    return {
        "keywords": F.regexp_count(unquoted, F.lit(r"(?i)\b(?:" + "|".join(KEYWORDS) + r")\b")),
        "strings": F.regexp_count(bare, F.lit(r"'[^'\n]*'")),
        "numbers": F.regexp_count(unquoted, F.lit(r"\b\d+\b")),
        "comments": F.regexp_count(body, F.lit(r"(?s)/\*.*?(?:\*/|\z)")) + F.regexp_count(noted, F.lit(r"--[^\n]*")),
    }


def version_key(v: Column) -> Column:
    """Version as an array of ints for comparison; anything unreadable is [0]."""
    parts = F.split(F.regexp_replace(v, "^[vV]+", ""), r"\.")
    ints = F.transform(parts, lambda p: p.try_cast("int"))
    return F.when(F.exists(ints, lambda x: x.isNull()) | v.isNull(), F.array(F.lit(0))).otherwise(ints)


def percent(done: Column, total: Column) -> Column:
    """Progress in whole percent; null where the total is 0."""
    return F.floor(F.lit(100) * done / F.nullif(total, F.lit(0)))


def translated(key: Column, active: dict[str, str], fallback: dict[str, str]) -> Column:
    """Text of a key: active language, else the fallback, else the key itself."""

    def pick(texts: dict[str, str]) -> Column:
        if not texts:
            return F.lit(None).cast("string")
        m = F.create_map(*[F.lit(x) for kv in texts.items() for x in kv])
        return F.try_element_at(m, key)

    return F.coalesce(pick(active), pick(fallback), key)


STRINGS = T.ArrayType(T.StringType())
