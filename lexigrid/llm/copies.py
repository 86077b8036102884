"""p3: duplicates hidden by formatting differences.

A body is a record of fields: one field ``text`` (all tokens outside the first
SELECT list) and one field ``item`` per entry of that list.  Each pair of field
name and value is hashed; a record's fingerprint is the sum of its pairs' hashes
modulo 2**128, which no order of the fields can change.  Rows are grouped by
fingerprint with map-side combining, and every member of a group is compared
with the group's first as a multiset of fields: by counting, without sorting.
A body that only shares the fingerprint becomes its own class.

Defined results: a null or empty body, or one without a word, has no class.  An
id delivered twice counts once.  The smallest id of a class is its keeper.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

from pyspark.sql import DataFrame, functions as F, types as T

from ..plans.spread import spread
from ..sources.shared import checkpoints

# A group is hot with more rows than both of these, the second being a share of all rows.
HOT, HOT_SHARE = 1000, 100_000
FIELD, ITEM = "\x1e", "\x1f"
_SPACE = re.compile("[\\s﻿]+")
_TOKEN = re.compile(
    r"(?P<note>--[^\r\n]*|/\*.*?(?:\*/|\Z))|(?P<text>'(?:[^']|'')*'?)|(?P<word>[\w@#$]+)|(?P<mark>[\"\[\]`])|(?P<open>\()|(?P<close>\))|(?P<comma>,)|(?P<end>;)|(?P<op>[^\s﻿])",
    re.S,
)
_NOTE = re.compile(r"--|/\*|\*/|[\w@#$]+|[^\w\s@#$,;()\"\[\]`﻿]")
_LETTER = re.compile(r"[^\W\d_]")
# Words that end a SELECT list.
_STOP = {"from", "into", "where", "union", "intersect", "except", "order", "group", "having", "limit", "offset", "option", "window", "for", "fetch"}


def fields(body: str | None) -> tuple[str, list[str]] | None:
    """The text field and the items of the first SELECT list; None for a body without a word."""
    if not body or not _LETTER.search(body):
        return None
    text: list[str] = []
    items: list[list[str]] = []
    state, depth = 0, 0  # 0 before the list, 1 its prefix, 2 within it, 3 after it
    top = False
    now = text
    for m in _TOKEN.finditer(body):
        kind, s = m.lastgroup, m[0]
        if kind == "word":
            s = s.casefold()
            if state == 0 and s == "select":
                text.append(s)
                state, depth, top = 1, 0, False
                continue
            if state == 1:
                if s in ("distinct", "all") or top and s in ("percent",):
                    text.append(s)
                    continue
                if s == "top":
                    text.append(s)
                    top = True
                    continue
                if top and (s[0].isdigit() or s[0] == "@" or depth):
                    text.append(s)
                    continue
                state, depth = 2, 0
                now = []
                items.append(now)
            if state == 2 and depth <= 0 and s in _STOP:
                state, now = 3, text
                text.append("\x1d")
            now.append(s)
        elif kind == "open":
            if state == 1 and not top:
                state, depth, now = 2, 0, []
                items.append(now)
            depth += 1
        elif kind == "close":
            depth -= 1
            if state == 2 and depth < 0:
                state, now = 3, text
                text.append("\x1d")
            elif state == 1 and depth == 0:
                top = False
        elif kind == "comma":
            if state == 2 and depth == 0:
                now = []
                items.append(now)
        elif kind == "end":
            if state == 2 and depth <= 0:
                state, now = 3, text
                text.append("\x1d")
        elif kind == "note":
            now.extend(x.casefold() for x in _NOTE.findall(s))
        elif kind == "text":
            now.append(_SPACE.sub(" ", s.casefold()))
        elif kind == "op":
            if state == 1:
                if top and depth:
                    text.append(s)
                    continue
                state, depth, now = 2, 0, []
                items.append(now)
            now.append(s)
        elif kind == "mark" and state == 1:
            state, depth, now = 2, 0, []
            items.append(now)
    return " ".join(text), [" ".join(x) for x in items]


def form_of(body: str | None) -> str | None:
    f = fields(body)
    return None if f is None else f[0] + FIELD + ITEM.join(f[1])


def _pairs(form: str) -> list[str]:
    text, _, rest = form.partition(FIELD)
    return ["text\0" + text] + ["item\0" + x for x in rest.split(ITEM)]


def fingerprint(form: str) -> str:
    """Commutative multiset hash of the field pairs."""
    total = 0
    for p in _pairs(form):
        total += int.from_bytes(hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=16).digest(), "big")
    return f"{total % (1 << 128):032x}"


def same_fields(a: str, b: str) -> bool:
    """Equality of two records as multisets of fields, by counting."""
    return a == b or Counter(_pairs(a)) == Counter(_pairs(b))


FORM = T.StructType([T.StructField("fp", T.StringType()), T.StructField("form", T.StringType())])


@F.pandas_udf(FORM)
def _formed(bodies):
    import pandas as pd

    out = []
    for b in bodies:
        f = form_of(b)
        out.append((None, None) if f is None else (fingerprint(f), f))
    return pd.DataFrame(out, columns=FORM.names, dtype=object)


# Not deterministic to the optimizer: a filter on its result would otherwise run it twice.
_formed = _formed.asNondeterministic()


@F.pandas_udf(T.StringType())
def _fingerprints(bodies):
    import pandas as pd

    return pd.Series([None if (f := form_of(b)) is None else fingerprint(f) for b in bodies], dtype=object)


_fingerprints = _fingerprints.asNondeterministic()

# keep_id is null where a part of a hot group is summed up: n members, and the form they share.
CHECKED = T.StructType([T.StructField(k, t) for k, t in (("fp", T.StringType()), ("part", T.IntegerType()), ("v", T.IntegerType()), ("id", T.LongType()), ("keep_id", T.LongType()), ("n", T.LongType()), ("form", T.StringType()))])


def _checked(batches):
    """Members of each group, which come sorted by group and id, compared with the first of each variant; a group has more than one only if fingerprints collide.

    A member of a whole group (part < 0) comes out with the smallest id of its
    variant, one without a second member not at all.  Of a part of a hot group
    each variant is summed up as well.
    """
    import pandas as pd

    group, variants, out = None, [], []

    def close() -> None:
        if group is not None and group[1] >= 0:
            out.extend((*group, v, first, None, n, form) for v, (form, first, n) in enumerate(variants))

    for batch in batches:
        for fp, part, i, form in zip(batch["fp"], batch["part"].tolist(), batch["id"].tolist(), batch["form"]):
            if (fp, part) != group:
                close()
                group, variants = (fp, part), []
            v = next((v for v, x in enumerate(variants) if same_fields(x[0], form)), len(variants))
            if v == len(variants):
                variants.append([form, i, 0])
            x = variants[v]
            x[2] += 1
            if part >= 0:
                out.append((fp, part, v, i, i, 0, None))
            elif x[2] > 1:
                if x[2] == 2:
                    out.append((fp, part, v, x[1], x[1], 0, None))
                out.append((fp, part, v, i, x[1], 0, None))
        yield pd.DataFrame(out, columns=CHECKED.names).astype({"id": "int64", "keep_id": "Int64"})
        out.clear()
    close()
    yield pd.DataFrame(out, columns=CHECKED.names).astype({"id": "int64", "keep_id": "Int64"})


MERGED = "fp string, part int, v int, all int, keep_id long"


def _merged(batches):
    """Variants of the parts of each hot group, sorted by group and first id, brought together: the variant of the whole group and its smallest id."""
    import pandas as pd

    group, variants, held, out = None, [], [], []

    def close() -> None:
        out.extend((group, part, v, g, variants[g][1]) for part, v, g in held if variants[g][2] > 1)

    for batch in batches:
        for fp, part, v, first, n, form in zip(batch["fp"], batch["part"].tolist(), batch["v"].tolist(), batch["id"].tolist(), batch["n"].tolist(), batch["form"]):
            if fp != group:
                close()
                group, variants, held = fp, [], []
            g = next((g for g, x in enumerate(variants) if same_fields(x[0], form)), len(variants))
            if g == len(variants):
                variants.append([form, first, 0])
            variants[g][2] += n
            held.append((part, v, g))
        yield pd.DataFrame(out, columns=["fp", "part", "v", "all", "keep_id"])
        out.clear()
    close()
    yield pd.DataFrame(out, columns=["fp", "part", "v", "all", "keep_id"])


def copy_classes(df: DataFrame, key: str = "id", body: str = "body") -> DataFrame:
    """id, class, keep_id: one row per id that has a class of two ids or more.

    Bodies are read once into (id, fingerprint), which is checkpointed; that is
    a job of its own.  The bodies of ids that share a fingerprint are read again
    and meet by fingerprint.  Hot groups, of which there are HOT_SHARE at most,
    are known by a broadcast list, come in parts by id, and only one row for each
    part is brought together, so no task holds such a group.
    """
    checkpoints(df.sparkSession)
    source = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(body).cast("string").alias("body"))
    rows = spread(source).select("id", _fingerprints("body").alias("fp")).where(F.col("fp").isNotNull()).checkpoint()
    hot = max(HOT, rows.count() // HOT_SHARE)
    groups = rows.groupBy("fp").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("fp", "n")
    large = F.broadcast(groups.where(F.col("n") > hot).select("fp", F.ceil(F.col("n") / hot).cast("int").alias("parts")))
    in_parts = rows.join(large, "fp").select("id", "fp", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    rest = rows.join(large, "fp", "left_anti").join(groups.where(F.col("n") <= hot).select("fp"), "fp").select("id", "fp", F.lit(-1).alias("part"))
    members = in_parts.unionByName(rest).distinct()
    texts = source.join(members, "id").select("id", "fp", "part", _formed("body").alias("f")).where(F.col("f.fp") == F.col("fp")).select("id", "fp", "part", F.col("f.form").alias("form"))
    met = texts.dropDuplicates(["id", "fp"]).repartition("fp", "part").sortWithinPartitions("fp", "part", "id").mapInPandas(_checked, CHECKED)
    met = met.checkpoint()
    whole = met.where("part < 0").select("id", F.concat_ws(".", "fp", "v").alias("class"), "keep_id")
    sums = met.where("keep_id is null").repartition("fp").sortWithinPartitions("fp", "id").mapInPandas(_merged, MERGED)
    split = met.where("part >= 0 and keep_id is not null").drop("keep_id").join(sums, ["fp", "part", "v"]).select("id", F.concat_ws(".", "fp", "all").alias("class"), "keep_id")
    return whole.unionByName(split)


def copies(df: DataFrame) -> DataFrame:
    """keep_id, copy_id: the smallest id of a class with each other id."""
    return copy_classes(df).where("id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))


def copy_counts(df: DataFrame) -> DataFrame:
    """keep_id, copies: how many ids each kept record stands for, itself included."""
    return copy_classes(df).groupBy("keep_id").agg(F.count("*").alias("copies"))
