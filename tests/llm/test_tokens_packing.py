import os
import random

import pytest

from millrace.llm import packing, tokens
from millrace.llm.bpe import DEFAULT_DIR, TrieEncoder, encoder

pytestmark = pytest.mark.skipif(not os.path.isdir(DEFAULT_DIR), reason="needs the vocabulary files")
ODD = ["", None, " ", "\n\n", "a  b   c \n d", "naïve café — “x” …", "日本語の文章です。", "<|endoftext|> and <|startoftext|>", "​­﻿", "😀👩‍👩‍👧 é", "x" * 3000, "\t\ttab\r\n", " lead", "trail ", "don't we'll I'VE", "12345 6.7e8", "\x00\x01", " nb sp", " line ", "a　b", "\x1c\x1d\x1e\x1f \x85"]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{DEFAULT_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch([y or "" for y in texts], add_special_tokens=False)]


def test_encoder_agrees_with_the_library(library):
    rng = random.Random(3)
    alphabet = "abcdefgh  .,\n\té日本1'- "
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 200))) for _ in range(300)]
    own = encoder()
    assert own.encode_batch(texts) == library(texts)
    assert own.count_batch(texts) == [len(x) for x in library(texts)]


def test_encoder_forgets_and_still_agrees(library):
    small = TrieEncoder(encoder().ranks, max_words=20)
    texts = [f"word{i} other{i * 7} same" for i in range(60)]
    out = [x for i in range(0, 60, 5) for x in small.encode_batch(texts[i : i + 5])]
    assert out == library(texts)


def test_trie_matches_plain_merging():
    own = encoder()
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("aeinorstz") for _ in range(rng.randint(2, 14))).encode() for _ in range(500)})
    assert own._walk(words) == {w: own._merge(w) for w in words}


def test_ids_of_every_row(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(1, None), (0, ""), (0, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text")
    got = tokens.encode(df).collect()
    assert len(got) == len(rows)
    want = {i: x for i, x in enumerate(library(ODD))}
    assert all(list(r["ids"]) == want[r["doc_id"]] for r in got)
    assert tokens.encode(df.limit(0)).count() == 0
    clash = spark.createDataFrame([(1, "a b", [9])], "doc_id long, text string, ids array<int>")
    assert tokens.encode(clash).columns == ["doc_id", "ids"]


def check_plan(items, placed, capacity):
    """No overlap, nothing lost, nothing over capacity, whole unless longer than a container."""
    fill, parts = {}, {}
    for key, piece, box, offset, start, length in placed:
        if box is None:
            assert length == 0
            continue
        fill.setdefault(box, []).append((offset, length))
        parts.setdefault(key, []).append((piece, start, length))
    for spans in fill.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    for key, size in items:
        own = sorted(parts.get(key, []))
        assert sum(x[2] for x in own) == max(0, size or 0)
        if size and size <= capacity:
            assert len(own) == 1
        if size and size > capacity:
            assert [x[2] for x in own[:-1]] == [capacity] * (len(own) - 1)
    return fill


@pytest.mark.parametrize("capacity", [7, 100, 2048])
def test_packing_is_valid_and_tight(capacity):
    rng = random.Random(capacity)
    items = [(i, rng.choice([0, None, 1, capacity, capacity + 1, 3 * capacity, rng.randint(1, capacity)])) for i in range(4000)]
    fill = check_plan(items, list(packing.plan(items, capacity)), capacity)
    used = sum(n for s in fill.values() for _, n in s)
    assert used / (len(fill) * capacity) > 0.97


def brute_force_choice(level, size, capacity):
    def squares(change):
        own = list(level)
        for h, d in change:
            if 0 < h < capacity:
                own[h] += d
        return sum(x * x for x in own)

    options = [(squares([(size, 1)]), 0)] + [(squares([(h, -1), (h + size, 1)]), -h) for h in range(1, capacity - size + 1) if level[h]]
    return min(options)[0]


def test_each_choice_minimises_the_squares():
    rng = random.Random(1)
    capacity = 12
    p = packing.SquarePacker(capacity)
    for _ in range(600):
        size = rng.randint(1, capacity - 1)
        best = brute_force_choice(list(p.level), size, capacity)
        p.put(size)
        assert sum(int(x) ** 2 for x in p.level[1:capacity]) == best


def test_pack_does_not_depend_on_partitions(spark):
    rows = [(i, (i * 37) % 300) for i in range(3000)] + [(7, 50), (7, 50), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens int")
    a = packing.pack(df.coalesce(1), capacity=256, streams=3)
    b = packing.pack(df.repartition(7), capacity=256, streams=3)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    use = packing.usage(a, 256).first()
    assert use["tokens"] == sum(n or 0 for _, n in rows) and use["used"] > 0.9
    assert packing.pack(df.limit(0)).count() == 0
    assert packing.usage(packing.pack(df.limit(0))).first()["containers"] == 0


def test_pack_documents(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (4, "word " * 5000)], "doc_id long, text string")
    got = packing.pack_documents(df).collect()
    assert {r["doc_id"] for r in got if r["container"] is None} == {2, 3}
    assert sum(r["length"] for r in got if r["doc_id"] == 4) == encoder().count_batch(["word " * 5000])[0]
