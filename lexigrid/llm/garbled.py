"""p2: text that was decoded with the wrong character encoding.

Round-trip repair.  A run of characters is re-encoded under a candidate legacy
encoding and strictly decoded as the encoding that was meant; the result is
accepted when a garbling cost drops, and the step repeats for nested layers
until nothing drops: there is no limit on their number, as every step lowers the
cost or gives a text that was not seen before.

Defined results: a null or empty field is no case.  Pure-ASCII text is never
touched.  ``repaired`` equals the input where nothing could be restored.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame, functions as F, types as T

from ..plans.spread import spread

# Legacy encodings of one byte under which UTF-8 bytes are read by mistake; of equal results the first counts.
UTF8_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "cp1254", "iso8859_15", "iso8859_9", "iso8859_2", "koi8_r", "cp866")
# Those whose characters are letters for the most part, so that a run proves less.
LETTERED = {"cp1251", "cp1250", "iso8859_2", "koi8_r", "cp866"}
# Encodings of one or two bytes under which UTF-8 bytes are read by mistake.
WIDE_AS = ("gbk", "cp932")
# Fixed values: (encoding used by mistake, encoding meant), both of one byte.
SINGLE_AS = (
    ("mac_roman", "cp1252"),
    ("cp850", "cp1252"),
    ("cp437", "cp1252"),
    ("cp1252", "mac_roman"),
    ("cp1252", "cp850"),
    ("cp1251", "cp1252"),
    ("cp1252", "cp1251"),
    ("latin-1", "cp1251"),
    ("koi8_r", "cp1251"),
    ("cp866", "cp1251"),
    ("cp1251", "koi8_r"),
    ("cp1251", "cp866"),
)
# Signs that clean text also has between two letters.
INNER_SIGNS = set("’·\xad\xa0–—‑\u200b\u200c\u200d\u2060\ufeff")
MIXED = {"LATIN", "CYRILLIC", "GREEK"}
# Cyrillic letters that are rare in running text; a text with many of them was hardly meant.
RARE_CYRILLIC = set("ъэщфцюЪЭЩФЦЮЁёҐґЎўЄєЇїЂђЉљЊњЋћЏџ")
# Scripts whose words hold no Latin letter.
WIDE = {"CJK", "HIRAGANA", "KATAKANA", "HALFWIDTH", "HANGUL"}
# Letters that European prose hardly uses.
ODD_LETTERS = set("þÞðÐƒŒÝýÿŸÆØﬁﬂˆˇЅѕЂЃѓЌќЏџ")
# Signs that stand freely or beside a word in clean text.
FREE_SIGNS = set("“”‘’«»–—…•€£¥§©®™°²³½¼¾¿¡·×±´`¨→←≤≥≠\xa0  ﻿​‍⁠\xad")
# Signs that clean text also has right after a letter or digit.
AFTER_SIGNS = set("’”»…–—°²³™®€½¼¾ºª·\xa0 ​‍⁠\xad﻿")


def _byte_chars(encoding: str) -> dict[int, str]:
    """The character of each byte from 0x80; cp1252 and its like keep undefined bytes as C1 controls."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[b] = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


class _Table:
    def __init__(self, encoding: str):
        chars = _byte_chars(encoding)
        self.byte = {c: b for b, c in chars.items()}
        kind = lambda lo, hi: "[" + "".join(re.escape(chars[b]) for b in range(lo, hi + 1)) + "]"
        tail = kind(0x80, 0xBF)
        one = f"(?:{kind(0xC2, 0xDF)}{tail}|{kind(0xE0, 0xEF)}{tail}{{2}}|{kind(0xF0, 0xF4)}{tail}{{3}})"
        self.run = re.compile(f"{one}+")

    def encode(self, text: str) -> bytes | None:
        try:
            return bytes(ord(c) if c < "\x80" else self.byte[c] for c in text)
        except KeyError:
            return None


@lru_cache(maxsize=None)
def _table(encoding: str) -> _Table:
    return _Table(encoding)


@lru_cache(maxsize=65536)
def _script(c: str) -> str:
    return "LATIN" if c < "\x80" else unicodedata.name(c, "").split(" ")[0]


# Scripts whose letters are not odd in themselves.
SCRIPTS = {"GREEK", "CYRILLIC", "CJK", "HIRAGANA", "KATAKANA", "HANGUL", "ARABIC", "HEBREW", "DEVANAGARI", "THAI"}
MIXABLE = SCRIPTS | WIDE | MIXED


@lru_cache(maxsize=65536)
def _char(c: str) -> tuple[str, str, bool, bool]:
    """(kind, script, upper, common) of a non-ASCII character; kind is L (letter or mark), C (no character) or S (sign)."""
    cat = unicodedata.category(c)
    if cat[0] in "LM":
        script = _script(c)
        return "L", script, c != c.lower(), c < "\u0180" or script in SCRIPTS or cat[0] == "M"
    if cat in ("Cc", "Co", "Cn", "Cs") or c == "\ufffd":
        return "C", "", False, False
    return "S", "", False, True


NON_ASCII = re.compile("[^\x00-\x7f]")


def garbling_cost(text: str) -> float:
    """How unlikely the non-ASCII characters of a text are where they stand."""
    cost = 0.0
    n = len(text)
    for m in NON_ASCII.finditer(text):
        i, c = m.start(), m[0]
        cost += 0.5
        kind, script, upper, common = _char(c)
        before = text[i - 1] if i else " "
        after = text[i + 1] if i + 1 < n else " "
        left = before.isalpha()
        right = after.isalpha()
        if kind == "C":
            cost += 4
        elif kind == "L":
            if not common:
                cost += 3
            if c in ODD_LETTERS or c == "ı" and after in "eE":
                cost += 1
            for other, near in ((before, left), (after, right)):
                if near and (s := _script(other)) != script and {s, script} <= MIXABLE:
                    cost += (1 if s in WIDE or script in WIDE else 2) * (not (s in WIDE and script in WIDE))
            if script == "CYRILLIC":
                cost += 0.35 * (c in RARE_CYRILLIC)
            elif script == "LATIN" and left and right and before > "\x7f" < after and _script(before) == _script(after) == "LATIN":
                cost += 1
            if upper and left and before.islower():
                cost += 2
            if not upper and left and right and before.isupper() and after.isupper():
                cost += 1
            if upper and not left and not right:
                cost += 0.5
        else:
            box = "\u2500" <= c < "\u25a0"
            if box:
                cost += 2 * (left or right)
            elif left and right and c not in INNER_SIGNS:
                cost += 2
            elif c not in FREE_SIGNS:
                cost += 1
            elif left and c not in AFTER_SIGNS:
                cost += 1.5
    return cost


def _unutf8(text: str, table: _Table, strict: float) -> tuple[str, int]:
    """The text with each convincing run decoded, and how many characters those runs held."""
    covered = 0

    def swap(m: re.Match) -> str:
        nonlocal covered
        run = m[0]
        try:
            new = table.encode(run).decode("utf-8")
        except UnicodeDecodeError:
            return run
        a, b = text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 1]
        if garbling_cost(a + new + b) + strict > garbling_cost(a + run + b) or strict >= 1 and not _whole(a, run, b, new):
            return run
        covered += len(run)
        return new

    new = table.run.sub(swap, text)
    return _all_of(text, table.encode(text), new, covered) if covered else (new, 0)


def _all_of(text: str, raw: bytes | None, new: str, covered: int) -> tuple[str, int]:
    """Where runs of a text were proven and all of it decodes strictly, what wasn't proven by itself is meant too."""
    try:
        return raw.decode("utf-8") if raw else new, len(NON_ASCII.findall(text)) if raw else covered
    except UnicodeDecodeError:
        return new, covered


def _whole(before: str, run: str, after: str, new: str) -> bool:
    """Whether a run of letters can be meant as other letters: it isn't cut out of a word of its own script, and gives European letters or several others."""
    for a, b in ((before, run[0]), (after, run[-1])):
        if a.isalpha() and b.isalpha() and _script(a) == _script(b) != "LATIN":
            return False
    scripts = {_script(c) for c in new if c.isalpha() or unicodedata.combining(c)}
    return scripts <= MIXED and _plain(new) or len(new) > 3 and len(scripts) == 1


def _plain(text: str) -> bool:
    """A one-byte swap proves nothing by itself: its result must be plain prose."""
    for c in NON_ASCII.findall(text):
        kind, _, _, common = _char(c)
        if kind == "C" or kind == "S" and c not in FREE_SIGNS or kind == "L" and (not common or c in ODD_LETTERS):
            return False
    return True


# A drawn line; letters that were misread as one would stand beside others.
DRAWN = re.compile("(?<!\\w)[\u2500-\u259f]{2,}(?!\\w)")


def _swap(text: str, wrong: str, meant: str) -> str | None:
    raw = None if DRAWN.search(text) else _table(wrong).encode(text)
    try:
        return raw.decode(meant) if raw else None
    except UnicodeDecodeError:
        return None


# A word with a character beyond ASCII, and a line.
WORD_RUN = re.compile(r"[^\s\x00-\x2c\x2e\x2f:-@\[-`{-\x7f]*[^\x00-\x7f\s][^\s\x00-\x2c\x2e\x2f:-@\[-`{-\x7f]*")
LINE = re.compile(r"[^\r\n]+")


def _excess(text: str, cost: float) -> float:
    """What a one-byte swap can lower the cost by, at most: it keeps the number of characters beyond ASCII, and each costs 0.5 at least."""
    return cost - 0.5 * len(NON_ASCII.findall(text))


def _unswap(text: str, wrong: str, meant: str) -> tuple[str, int]:
    """The text with each line swapped that was misread as a whole, else each word of it that was, and how many characters those held.

    A run counts when its own cost drops by 1 and its result is plain; a word must also give letters only, and hold an ASCII letter or be a Cyrillic word.
    """
    covered = 0

    def better(run: str, before: str, after: str) -> str | None:
        new = _swap(run, wrong, meant)
        if not new or new == run or not _plain(new):
            return None
        return new if garbling_cost(before + new + after) <= garbling_cost(before + run + after) - 1 else None

    def word(m: re.Match) -> str:
        nonlocal covered
        run = m[0]
        a, b = m.string[max(0, m.start() - 1) : m.start()], m.string[m.end() : m.end() + 1]
        if _excess(a + run + b, garbling_cost(a + run + b)) < 1:
            return run
        new = better(run, a, b)
        letters = NON_ASCII.findall(new or "")
        if not new or not all(c.isalpha() for c in letters):
            return run
        if not any(c.isalpha() and c < "\x80" for c in run) and not (len(letters) > 3 and all(_script(c) == "CYRILLIC" for c in letters)):
            return run
        covered += len(run)
        return new

    def line(m: re.Match) -> str:
        nonlocal covered
        run, held = m[0], covered
        if run.isascii() or _excess(run, garbling_cost(run)) < 1:
            return run
        parts, new = WORD_RUN.sub(word, run), better(run, "", "")
        if new and garbling_cost(new) <= garbling_cost(parts):
            covered = held + len(run)
            return new
        return parts

    return LINE.sub(line, text), covered


WIDE_RUN = re.compile("[^\x00-\xa0]+")


def _unwide(text: str, encoding: str) -> tuple[str, int]:
    """The text with each run decoded that is UTF-8 under an encoding of two bytes, and how many characters those held.

    Letters of these scripts cost as much as those that were meant, so the result
    must prove itself: letters of one script, Latin ones beside an ASCII letter,
    others two at least.
    """
    covered = 0

    def swap(m: re.Match) -> str:
        nonlocal covered
        run = m[0]
        try:
            new = run.encode(encoding).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            return run
        scripts = {_script(c) for c in new}
        beside = text[max(0, m.start() - 1) : m.start()] + text[m.end() : m.end() + 1]
        if len(scripts) > 1 or not all(c.isalpha() for c in new) or not _plain(new):
            return run
        if "LATIN" in scripts:
            proven = any(c.isascii() and c.isalpha() for c in beside)
        else:
            proven = len(new) > 1 and not scripts & WIDE or len(new) > 3 and bool(scripts & {"HIRAGANA", "KATAKANA"})
        covered += len(run) if proven else 0
        return new if proven else run

    new = WIDE_RUN.sub(swap, text)
    try:
        return _all_of(text, text.encode(encoding), new, covered) if covered else (new, 0)
    except UnicodeEncodeError:
        return new, covered


def _unpaired(text: str) -> tuple[str, str] | None:
    """A whole text whose bytes were cut into pairs by mistake, or weren't: UTF-8 read as UTF-16, and UTF-16 read as bytes."""
    if "\0" in text:
        for how, at in (("utf-16-le", 1), ("utf-16-be", 0)):
            if text[at::2].count("\0") * 2 >= len(text) // 2 and "\0" not in text[1 - at :: 2]:
                try:
                    return text.encode("latin-1").decode(how), f"latin-1>{how}"
                except (UnicodeEncodeError, UnicodeDecodeError):
                    pass
    elif len(text) > 3 and not any(c < "\u0100" for c in text):
        for how in ("utf-16-le", "utf-16-be"):
            try:
                new = text.encode(how).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            plain = sum(c.isascii() and (c.isalnum() or c in " \n\t,.;:()=_'-*") for c in new)
            if plain >= 0.8 * len(new) and new.isprintable() | ("\n" in new):
                return new, how
    return None


# Letters that are odd elsewhere; an Icelandic text has several of them.
ICELANDIC = set("ðþýæ")


def repair(text: str | None) -> tuple[str | None, str]:
    """The restored text and the chain of wrong encodings, outermost first."""
    if not text or text.isascii() and "\0" not in text:
        return text, ""
    chain, seen = [], {text}
    while True:
        now = garbling_cost(text)
        found = []
        if whole := _unpaired(text):
            found.append((-len(text), 0.0, 0, *whole))
        for e in UTF8_AS:
            new, covered = _unutf8(text, _table(e), 1.0 if e in LETTERED else 0.25)
            if covered and (c := garbling_cost(new)) < now - 0.2:
                found.append((-covered, c, len(found), new, e))
        for e in WIDE_AS if not found and WIDE_RUN.search(text) else ():
            new, covered = _unwide(text, e)
            if covered:
                found.append((-covered, garbling_cost(new), len(found), new, e))
        if not found and _excess(text, now) >= 1 and len(ICELANDIC & set(text.lower())) < 3:
            for wrong, meant in SINGLE_AS:
                new = _swap(text, wrong, meant)
                if new and new != text and (c := garbling_cost(new)) <= now - 1 and _plain(new):
                    found.append((0, c, len(found), new, f"{wrong}>{meant}"))
            # of results as likely, a swap of everything is the simpler one
            for wrong, meant in SINGLE_AS:
                new, covered = _unswap(text, wrong, meant)
                if covered and (c := garbling_cost(new)) <= now - 1:
                    found.append((0, c, len(found), new, f"{wrong}>{meant}"))
        if not found or min(found)[3] in seen:
            break
        *_, text, how = min(found)
        seen.add(text)
        chain.append(how)
        if text.isascii():
            break
    return text, " ".join(chain)


# Marks that no clean text of these tables has: replacement characters and C1 controls.
LOST = re.compile("[�\x80-\x84\x86-\x9f]")


def is_garbled(text: str | None) -> tuple[bool, str | None, str]:
    fixed, chain = repair(text)
    lost = bool(fixed) and (LOST.search(fixed) is not None or LOST.search(text) is not None)
    return bool(chain) or lost, fixed, chain or ("lost" if lost else "")


FOUND = T.StructType(
    [
        T.StructField("query_id", T.LongType()),
        T.StructField("field", T.StringType()),
        T.StructField("repaired", T.StringType()),
        T.StructField("chain", T.StringType()),
    ]
)


def _scan(batches):
    import pandas as pd

    for b in batches:
        out = []
        for i, f, t in zip(b["query_id"].tolist(), b["field"].tolist(), b["text"].tolist()):
            hit, fixed, chain = is_garbled(t)
            if hit:
                out.append((i, f, fixed, chain))
        yield pd.DataFrame(out, columns=FOUND.names).astype({"query_id": "int64"})


def garbled_fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per record and garbled field: query_id, field, repaired, chain.

    Only fields with a character beyond ASCII (or U+0000) leave the JVM.  The scan is a narrow
    map; the one shuffle is over the garbled rows alone (a record delivered
    twice gives one row).  ``chain`` is ``lost`` where replacement characters
    make the original unrecoverable; such text is still repaired as far as it goes.
    Rows with a null key are left out.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields]))
    texts = (
        spread(df.where(F.col(key).isNotNull()).select(key, *fields))
        .select(F.col(key).cast("long").alias("query_id"), cells.alias("cell"))
        .select("query_id", "cell.field", "cell.text")
        .where(F.col("text").rlike("[^\\x01-\\x7F]"))
    )
    return texts.mapInPandas(_scan, FOUND).dropDuplicates(["query_id", "field"])
