"""p7: evaluation texts that leak into training text.

The test items form a BM25 inverted index with block maxima.  Every passage of
every training document is a query: block-max WAND returns all items whose score
reaches the item's own threshold, and an exact overlap check of successive words
follows.  A passage is a stretch of words that items have, cut to a bounded length.  The threshold of an item is the least score that any passage holding
``words`` successive words of it can have, so retrieval loses nothing; passages
overlap by ``words`` - 1, so no run is cut.

Defined results: words are runs of letters and digits after NFKC, case folding
and removal of accents and of format characters; null and empty texts have none;
items shorter than ``words`` words can't be found.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_left

import regex as re

from pyspark.sql import DataFrame, functions as F

from ..plans.spread import spread

K1, B = 1.2, 0.75
BLOCK = 4
PASSAGE = 24
_WORD = re.compile(r"[\p{L}\p{N}]+")
_DROP = re.compile(r"[\p{M}\p{Cf}]+")


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    if text.isascii():
        return [w for w in _WORD.findall(text.lower())]
    t = _DROP.sub("", unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).casefold()))
    return _WORD.findall(unicodedata.normalize("NFKC", t).casefold())


class Index:
    """Impact-ordered by item id; impacts are divided by the item's threshold, so 1 is the threshold of all."""

    def __init__(self, items: list[tuple[int, str]], words: int = 12):
        self.words = words
        texts = [(i, words_of(t)) for i, t in items if i is not None]
        texts = [(i, w) for i, w in texts if len(w) >= words]
        self.ids = [i for i, _ in texts]
        self.grams: dict[int, list[int]] = {}
        self.postings: dict[str, tuple[list[int], list[float], list[float], float]] = {}
        self.most: dict[str, float] = {}
        if not texts:
            return
        n, mean = len(texts), sum(len(w) for _, w in texts) / len(texts)
        lists: dict[str, list[tuple[int, float]]] = {}
        tf = []
        for k, (_, w) in enumerate(texts):
            c: dict[str, int] = {}
            for x in w:
                c[x] = c.get(x, 0) + 1
            tf.append(c)
        df: dict[str, int] = {}
        for c in tf:
            for x in c:
                df[x] = df.get(x, 0) + 1
        for k, (_, w) in enumerate(texts):
            score = {x: math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / mean)) for x, f in tf[k].items()}
            least = min(sum(score[x] for x in set(w[p : p + words])) for p in range(len(w) - words + 1))
            for x, s in score.items():
                lists.setdefault(x, []).append((k, s / least * (1 + 1e-9)))
            for p in range(len(w) - words + 1):
                g = " ".join(w[p : p + words])
                own = self.grams.setdefault(g, [])
                if not own or own[-1] != k:
                    own.append(k)
        for x, l in lists.items():
            docs, imps = [d for d, _ in l], [s for _, s in l]
            blocks = [max(imps[p : p + BLOCK]) for p in range(0, len(imps), BLOCK)]
            self.postings[x] = docs, imps, blocks, max(imps)
            self.most[x] = max(imps)

    def wand(self, terms: set[str]) -> list[int]:
        """Items with a score of at least 1 for these query terms, by block-max WAND."""
        lists = [self.postings[t] for t in terms if t in self.postings]
        if sum(p[3] for p in lists) < 1:
            return []
        # cursor: [current item, position, postings]
        cur = [[p[0][0], 0, p] for p in lists]
        end, out = len(self.ids), []
        while cur:
            cur.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cur):
                bound += c[2][3]
                if bound >= 1:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cur[pivot][0]
            while pivot + 1 < len(cur) and cur[pivot + 1][0] == item:
                pivot += 1
            # block bound: shallow moves only
            block, limit = 0.0, end
            for c in cur[: pivot + 1]:
                docs, _, blocks, _ = c[2]
                p = bisect_left(docs, item, c[1])
                if p < len(docs):
                    b = p // BLOCK
                    block += blocks[b]
                    limit = min(limit, docs[min(len(docs), (b + 1) * BLOCK) - 1] + 1)
            if block >= 1:
                if cur[0][0] == item:
                    score = 0.0
                    for c in cur[: pivot + 1]:
                        score += c[2][1][c[1]]
                        c[1] += 1
                        c[0] = c[2][0][c[1]] if c[1] < len(c[2][0]) else end
                    if score >= 1:
                        out.append(item)
                    target = None
                else:
                    target = item
            else:
                target = max(item + 1, min(limit, cur[pivot + 1][0] if pivot + 1 < len(cur) else end))
            if target is not None:
                for c in cur[: pivot + 1]:
                    if c[0] < target:
                        c[1] = bisect_left(c[2][0], target, c[1])
                        c[0] = c[2][0][c[1]] if c[1] < len(c[2][0]) else end
            cur = [c for c in cur if c[0] < end]
        return out

    def find(self, text: str | None) -> list[int]:
        """Ids of the items of which the text holds ``words`` successive words."""
        return self.find_in(words_of(text))

    def find_in(self, w: list[str]) -> list[int]:
        """The same for the words of a text."""
        n, hit = self.words, set()
        if len(w) < n or not self.ids:
            return []
        most, step = self.most, PASSAGE - n + 1
        bound = [most.get(x, 0.0) for x in w]
        bound.append(0.0)
        start = 0
        for end, b in enumerate(bound):
            if b:
                continue
            # a passage ends at a word that no item has, as no run of an item can cross it
            for at in range(start, end - n + 1, step):
                stop = min(end, at + PASSAGE)
                if sum(bound[at:stop]) >= 1:  # repeated words only raise this bound
                    self._verify(w[at:stop], hit)
            start = end + 1
        return sorted(self.ids[k] for k in hit)

    def _verify(self, part: list[str], hit: set[int]) -> None:
        """Adds the items that WAND retrieves for a passage and whose words it really holds in a row."""
        hot = set(self.wand(set(part))) - hit
        if hot:
            for p in range(len(part) - self.words + 1):
                own = self.grams.get(" ".join(part[p : p + self.words]))
                if own:
                    hit.update(k for k in own if k in hot)


# Fixed value: blocks of items that one pass over the documents looks for.
AT_ONCE = 4


def leaked(docs: DataFrame, items: DataFrame, words: int = 12, max_items: int = 20_000, max_chars: int = 4_000_000) -> DataFrame:
    """doc_id, item_id: one row per document and item of which it holds ``words`` successive words.

    The index of the items is broadcast.  Test sets are small by nature; their
    size is checked: beyond max_items or max_chars the items are indexed in
    blocks, and a pass over the documents, which reads the words of each once,
    serves AT_ONCE of them.
    """
    spark = docs.sparkSession
    rows = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("c")).first()
    parts = max(1, -(-size["n"] // max_items), -(-size["c"] // max_chars))
    found, docs = None, spread(docs.where("doc_id is not null and length(text) > 0").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))

    def index_of(part: int):
        block = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        return spark.sparkContext.broadcast(Index(sorted((r["item_id"], r["text"]) for r in block.toLocalIterator()), words))

    for first in range(0, parts, AT_ONCE):
        indexes = [index_of(part) for part in range(first, min(parts, first + AT_ONCE))]

        def hits(batches, indexes=indexes):
            import pandas as pd

            for batch in batches:
                seen: dict = {}
                out = []
                for i, t in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
                    if t not in seen:
                        w = words_of(t)
                        seen[t] = [k for index in indexes for k in index.value.find_in(w)]
                    out += [(i, k) for k in seen[t]]
                yield pd.DataFrame(out, columns=["doc_id", "item_id"]).astype("int64")

        one = docs.mapInPandas(hits, "doc_id long, item_id long")
        found = one if found is None else found.unionByName(one)
    return found.distinct()
