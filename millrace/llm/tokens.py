"""Problem 7: token ids of every document by a public tokenizer."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame

from .bpe import DEFAULT_DIR, encoder
from .common import map_rows, spread

#: Texts whose distinct words share one trie.
TEXTS_A_TRIE = 256


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: str = DEFAULT_DIR, key_type: str = "long") -> DataFrame:
    """``key, ids ARRAY<INT>``: one row for each input row.

    Null and empty texts have the empty list; strings of special tokens are
    ordinary text; repeated rows stay repeated; an empty table gives none. The
    work is row-local (no shuffle); only ``key`` and ``text`` leave the JVM.
    """
    path = f"{tokenizers}/byte_bpe_50k.tiktoken"

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        own = encoder(path)
        while part := list(islice(rows, TEXTS_A_TRIE)):
            keys, texts = zip(*part, strict=True)
            yield from zip(keys, own.encode_batch(texts), strict=True)

    return map_rows(spread(df.select(key, text)), [key, text], f"`{key}` {key_type}, ids array<int>", run)


def count(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: str = DEFAULT_DIR, key_type: str = "long") -> DataFrame:
    """``key, n_tokens INT``: the lengths of the lists of :func:`encode`."""
    path = f"{tokenizers}/byte_bpe_50k.tiktoken"

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        own = encoder(path)
        while part := list(islice(rows, TEXTS_A_TRIE)):
            keys, texts = zip(*part, strict=True)
            yield from zip(keys, own.count_batch(texts), strict=True)

    return map_rows(spread(df.select(key, text)), [key, text], f"`{key}` {key_type}, n_tokens int", run)


def decoded(df: DataFrame, key: str = "doc_id", tokenizers: str = DEFAULT_DIR, key_type: str = "long") -> DataFrame:
    """``key, digest``: of the bytes that the ids of :func:`encode` spell, their MD5."""
    path = f"{tokenizers}/byte_bpe_50k.tiktoken"

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        spelt = encoder(path).bytes_of
        for k, ids in rows:
            yield k, hashlib.md5(b"".join(spelt[i] for i in ids)).hexdigest()

    return map_rows(df, [key, "ids"], f"`{key}` {key_type}, digest string", run)
