"""Full-text engine: prefix phrases, BM25 and snippets over (title, description, body, objects).

A term of the search text is a phrase of its tokens; tokens must be adjacent
within one column, the last is a prefix; all terms must occur in the row.
Statistics are those of the whole index of a project, before any other filter.

Two physical forms: ``score_postings`` reads the token ranges of a search from
the stored inverted index (``postings`` and ``statistics``), and ``score`` scans
texts with JVM expressions alone where there is no index.

Defined results: a term without a token is ignored; if no term has one the
result is empty; a term with a double quote makes the search empty; null columns
count as empty; a file delivered twice counts once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import fold_tokens, tokens

COLUMNS = ["title", "description", "body", "objects"]
# Fixed values of the ranking function and the snippet.
K1, B, LEAST_IDF, WINDOW = 1.2, 0.75, 1e-6, 20


def phrases(text: str) -> list[list[str]] | None:
    """Phrases of a search text, each a list of tokens; None if the search can't match anything."""
    out = []
    for term in text.split():
        if '"' in term:
            return None
        words = [w for w, _, _ in fold_tokens(term)]
        if words:
            out.append(words)
    return out or None


def instances(toks: Column, phrase: list[str]) -> Column:
    """How often a phrase stands in an array of tokens."""
    if len(phrase) == 1:
        return F.size(F.filter(toks, lambda t: t.startswith(phrase[0])))
    *head, last = phrase
    size = F.size(toks)

    def at(i: Column) -> Column:
        hits = [F.get(toks, i + k) == w for k, w in enumerate(head)] + [F.get(toks, i + len(head)).startswith(last)]
        return reduce(lambda a, b: a & b, hits)

    starts = F.when(size >= len(phrase), F.sequence(F.lit(0), size - len(phrase))).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(starts, at))


def score(docs: DataFrame, text: str, key: str = "query_id") -> DataFrame:
    """project, key, rank of the matching rows of docs (project, key and the four text columns); the lower the better."""
    terms = phrases(text)
    if terms is None:
        return docs.select("project", key, F.lit(0.0).alias("rank")).where(F.lit(False))
    arrays = docs.select("project", key, *[tokens(F.col(c)).alias(c) for c in COLUMNS])
    counts = [sum((instances(F.col(c), p) for c in COLUMNS[1:]), instances(F.col(COLUMNS[0]), p)).alias(f"f{k}") for k, p in enumerate(terms)]
    rows = arrays.select("project", key, _length().alias("d"), *counts)
    # one narrow row per file, also if it was delivered twice; statistics and hits share this exchange, so texts are read once
    rows = rows.dropDuplicates(["project", key])
    return _rank(rows, rows.groupBy("project").agg(*_statistics(len(terms))), len(terms), key)


def _statistics(k: int) -> list[Column]:
    return [F.count("*").alias("n"), F.avg("d").alias("mean")] + [F.sum((F.col(f"f{i}") > 0).cast("long")).alias(f"n{i}") for i in range(k)]


def _rank(rows: DataFrame, stats: DataFrame, k: int, key: str) -> DataFrame:
    hits = rows.where(reduce(lambda a, b: a & b, [F.col(f"f{i}") > 0 for i in range(k)])).join(stats, "project")
    total = F.lit(0.0)
    for i in range(k):
        idf = F.log((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
        total = total + idf * F.col(f"f{i}") * (K1 + 1) / (F.col(f"f{i}") + K1 * (1 - B + B * F.col("d") / F.col("mean")))
    return hits.select("project", key, (-total).alias("rank"))


def postings(docs: DataFrame, key: str = "query_id") -> DataFrame:
    """project, token, key, field, pos, d: one row per token of a file, with the number of all tokens of the file.

    Stored sorted by project, token and key (``ORDER``), so that a prefix reads
    only the row groups of its range and needs no other table of the files.
    """
    one = docs.dropDuplicates(["project", key]).select("project", key, *[tokens(F.col(c)).alias(c) for c in COLUMNS])
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("t")) for c in COLUMNS])
    rows = one.select("project", key, _length().alias("d"), F.explode(cells).alias("c"))
    return rows.select("project", key, "d", "c.field", F.posexplode("c.t").alias("pos", "token")).select("project", "token", key, "field", "pos", "d")


ORDER = ["token", "query_id"]


def _length() -> Column:
    return reduce(lambda a, b: a + b, [F.size(c).cast("long") for c in COLUMNS])


def statistics(docs: DataFrame, key: str = "query_id") -> DataFrame:
    """project, n, mean: files of each project and their mean number of tokens."""
    rows = docs.select("project", key, *[tokens(F.col(c)).alias(c) for c in COLUMNS]).select("project", key, _length().alias("d")).dropDuplicates(["project", key])
    return rows.groupBy("project").agg(F.count("*").alias("n"), F.avg("d").alias("mean"))


def score_postings(index: DataFrame, stats: DataFrame, text: str, key: str = "query_id") -> DataFrame:
    """The result of ``score`` from stored postings and statistics.

    One scan of the tokens that the search names; a token of a phrase votes for
    the place where the phrase would begin, and a place with all votes is an
    instance.  Both counts need one exchange by file.
    """
    terms = phrases(text)
    if terms is None:
        return index.select("project", key, F.lit(0.0).alias("rank")).where(F.lit(False))
    votes = []
    for i, p in enumerate(terms):
        for k, w in enumerate(p):
            hit = F.col("token").startswith(w) if k == len(p) - 1 else F.col("token") == w
            votes.append((hit, F.struct(F.lit(i).alias("i"), (F.col("pos") - k).alias("at"))))
    rows = index.where(reduce(lambda a, b: a | b, [hit for hit, _ in votes]))
    cast = F.explode(F.array_compact(F.array(*[F.when(hit, v) for hit, v in votes]))).alias("v")
    rows = rows.select("project", key, "d", "field", cast).select("project", key, "d", "field", "v.i", "v.at").repartition("project", key)
    if any(len(p) > 1 for p in terms):
        full = reduce(lambda c, x: c.when(F.col("i") == x[0], len(x[1])), list(enumerate(terms))[1:], F.when(F.col("i") == 0, len(terms[0])))
        rows = rows.groupBy("project", key, "field", "i", "at").agg(F.count("*").alias("v"), F.first("d").alias("d")).where(F.col("v") == full)
    counts = rows.groupBy("project", key).agg(F.first("d").alias("d"), *[F.count_if(F.col("i") == i).alias(f"f{i}") for i in range(len(terms))])
    found = counts.groupBy("project").agg(*_statistics(len(terms))[2:])
    return _rank(counts, found.join(stats, "project"), len(terms), key)


def snippet_of(body: str | None, terms: list[list[str]], window: int = WINDOW, left: str = "[", right: str = "]", dots: str = "...") -> str:
    """The window of tokens that holds the most phrases, with their instances in brackets."""
    body = body or ""
    toks = fold_tokens(body)
    n = len(toks)
    words = [w for w, _, _ in toks]
    hits = sorted(
        (o, k)
        for k, p in enumerate(terms)
        for o in range(n - len(p) + 1)
        if all(words[o + j] == p[j] for j in range(len(p) - 1)) and words[o + len(p) - 1].startswith(p[-1])
    )
    start, best = 0, -1

    def weigh(at: int) -> tuple[int, int, int]:
        seen, total, first, last = set(), 0, -1, 0
        for o, k in hits:
            if at <= o < at + window:
                total += 1 if k in seen else 1000
                seen.add(k)
                first = o if first < 0 else first
                last = o + len(terms[k])
        return total, first, last

    sentences = [0] + [i for i in range(1, n) if _begins(body, toks[i - 1][2], toks[i][1])]
    for o, _ in hits:
        total, first, last = weigh(o)
        gap = window - (last - first)
        shift = first - int(gap / 2)
        shift = n - window if shift + window > n else shift
        if total > best:
            best, start = total, max(0, shift)
        if n > window:
            s = max(x for x in sentences if x <= o)
            if s < o:
                total = weigh(s)[0] + (120 if s == 0 else 100)
                if total > best:
                    best, start = total, s
    stop = min(n, start + window)
    marks: list[list[int]] = []
    for o, k in hits:
        a, b = max(o, start), min(o + len(terms[k]), stop)
        if o < start or o >= stop:
            continue
        if marks and a < marks[-1][1]:
            marks[-1][1] = max(marks[-1][1], b)
        else:
            marks.append([a, b])
    out, at = [dots] if start > 0 else [], toks[start][1] if start and n else 0
    for a, b in marks:
        out += [body[at : toks[a][1]], left, body[toks[a][1] : toks[b - 1][2]], right]
        at = toks[b - 1][2]
    if stop < n:
        out += [body[at : toks[stop - 1][2]], dots]
    else:
        out.append(body[at:])
    return "".join(out)


def _begins(body: str, end: int, start: int) -> bool:
    """Whether a sentence begins at a token: blanks before it, and before them a full stop or colon."""
    gap = body[end:start]
    bare = gap.rstrip(" \t\n\r")
    return bare != gap and bare[-1:] in (".", ":")


def snippets(body: Column, text: str) -> Column:
    """Snippet of each body; to be applied after ranking and limit."""
    terms = phrases(text) or []

    @F.pandas_udf(T.StringType())
    def cut(bodies):
        return bodies.map(lambda b: snippet_of(b, terms))

    return cut(body)
