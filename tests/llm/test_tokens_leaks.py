"""p6 and p7: exact ids and round trips; leaks against brute force."""

import os
import random

import pytest

from lexigrid.llm import leaks, tokens

PATH = os.path.join(tokens.TOKENIZERS, "byte_bpe_50k.tiktoken")
TEXTS = ["", "Hello  world", "<|endoftext|> is text", "tab\t\t\tend\r\n\n x", "naïve 日本語 👩🏽‍💻 é", "a" * 3000, "word123 " * 30000, " " * 100000 + "x", "é" * 70000 + "1" * 70000, "x y 　z"]


@pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer files")
class TestTokens:
    @pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
    def test_ids_and_round_trip(self, text):
        ids = tokens.encode(text, PATH)
        assert ids == tokens.encoder(PATH).encode_ordinary(text)
        assert tokens.decode(ids, PATH) == text

    def test_any_cut(self):
        r = random.Random(1)
        enc = tokens.encoder(PATH)
        for _ in range(200):
            text = "".join(r.choice(["a", "Bc", "1", "22", " ", "  ", "\n", "'s", "'", ".", "é", "日", " ", "_"]) for _ in range(60))
            parts = list(tokens.pieces(text, r.randint(1, 10)))
            assert "".join(parts) == text
            assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)

    def test_same_as_the_other_library(self):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(PATH.replace(".tiktoken", ".json"))
        t.encode_special_tokens = True
        for text in TEXTS[:5]:
            assert t.encode(text, add_special_tokens=False).ids == tokens.encode(text, PATH)

    def test_columns(self, spark):
        df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS[:5] + [None])], "doc_id long, text string")
        out = tokens.encoded(df)
        got = {r["doc_id"]: r["ids"] for r in out.collect()}
        assert got == {k: tokens.encode(t, PATH) for k, t in enumerate(TEXTS[:5] + [None])} and got[5] == [] == got[0]
        back = {r[0]: r[1] for r in out.select("doc_id", tokens.token_text(out["ids"])).collect()}
        assert back == {k: t or "" for k, t in enumerate(TEXTS[:5] + [None])}
        assert tokens.encoded(df.limit(0)).count() == 0


def test_words():
    assert leaks.words_of("Año_2 ﬁle na​ïve Ⅷ ½ Straße!") == ["ano", "2", "file", "naive", "viii", "1", "2", "strasse"]
    assert leaks.words_of(None) == leaks.words_of("") == []


def _corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["the", "of", "a"] * 10
    make = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(k, make(r.randint(5, 40))) for k in range(40)]
    docs = []
    for k in range(150):
        w = make(r.randint(0, 120))
        for _ in range(r.randint(0, 2)):
            _, it = r.choice(items)
            n = r.choice([11, 12, 13, 20])
            p = r.randint(0, max(0, len(it) - n))
            at = r.randint(0, len(w))
            w[at:at] = it[p : p + n]
        docs.append((k, r.choice([" ", ", ", "\n", " ⁠"]).join(x.upper() if r.random() < 0.1 else x for x in w)))
    return items, docs


def _brute(items, docs, n=12):
    out = set()
    for d, t in docs:
        w = leaks.words_of(t)
        grams = {tuple(w[p : p + n]) for p in range(len(w) - n + 1)}
        out |= {(d, i) for i, x in items if any(tuple(x[p : p + n]) in grams for p in range(len(x) - n + 1))}
    return out


@pytest.mark.parametrize("seed", range(5))
def test_leaks(spark, seed):
    items, docs = _corpus(seed)
    want = _brute(items, docs)
    index = leaks.Index([(i, " ".join(w)) for i, w in items])
    assert {(d, i) for d, t in docs for i in index.find(t)} == want and want
    if seed == 0:
        df = spark.createDataFrame(docs + [(900, None), (901, "")], "doc_id long, text string")
        its = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(99, None), (0, " ".join(items[0][1]))], "item_id long, text string")
        assert {tuple(r) for r in leaks.leaked(df, its).collect()} == want
        assert {tuple(r) for r in leaks.leaked(df, its, max_items=15).collect()} == want  # indexed in blocks
        assert {tuple(r) for r in leaks.leaked(df, its, max_items=4).collect()} == want  # and in several passes
        assert leaks.leaked(df.limit(0), its).count() == 0 and leaks.leaked(df, its.limit(0)).count() == 0


def test_wand_returns_all_above_threshold():
    items, docs = _corpus(9)
    index = leaks.Index([(i, " ".join(w)) for i, w in items], 12)
    r = random.Random(3)
    for _ in range(300):
        terms = {f"w{r.randrange(60)}" for _ in range(r.randint(1, 30))} | {"the", "of"}
        total = [0.0] * len(index.ids)
        for t in terms:
            if t in index.postings:
                for d, s in zip(*index.postings[t][:2]):
                    total[d] += s
        got = index.wand(terms)
        assert len(got) == len(set(got))
        assert {k for k, s in enumerate(total) if s >= 1 + 1e-12} <= set(got) <= {k for k, s in enumerate(total) if s >= 1 - 1e-12}
