"""p6: encoding of a corpus with a public byte-level BPE tokenizer.

The tiktoken library runs with a local rank file.  A long text is split before
each run of white space that follows another character and between a letter and
a digit, where no piece of the tokenizer's pattern can cross, so the ids
are those of the whole text.  Decoding joins raw bytes, which also holds for ids
that end within a character.

Defined results: null and empty texts give an empty list; strings that look like
special tokens are ordinary text; unpaired surrogates can't occur in Spark strings.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import regex as re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..plans.spread import spread

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
# Fixed value: the split pattern of the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 65_536
_CUT = re.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = LONG):
    """Parts of a text whose encodings join to that of the whole; each as short as size allows."""
    at = 0
    while len(text) - at > size:
        m = _CUT.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode(text: str | None, path: str) -> list[int]:
    if not text:
        return []
    enc = encoder(path)
    if len(text) <= LONG:
        return enc.encode_ordinary(text)
    return [i for p in pieces(text) for i in enc.encode_ordinary(p)]


def decode(ids: list[int] | None, path: str) -> str:
    """Raw bytes of all ids, joined before they are read as UTF-8."""
    return encoder(path).decode_bytes(list(ids)).decode("utf-8", "replace") if ids is not None and len(ids) else ""


def token_ids(text: Column, path: str | None = None) -> Column:
    path = path or os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts):
        import pandas as pd

        return pd.Series([encode(t, path) for t in texts], dtype=object)

    return ids(text)


def token_text(ids: Column, path: str | None = None) -> Column:
    path = path or os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")

    @F.pandas_udf(T.StringType())
    def text(rows):
        import pandas as pd

        return pd.Series([decode(r, path) for r in rows], dtype=object)

    return text(ids)


def encoded(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, ids: a narrow map, no shuffle; every row of the input is kept."""
    return spread(df.select(key, text)).select(F.col(key).cast("long").alias("doc_id"), token_ids(F.col(text), path).alias("ids"))
