"""Token ids against the library, and packing against its definition."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meterlens.llm.packing import assign, pack, pack_texts, room_for
from meterlens.llm.tokens import default_vocabulary, encoder


def test_encoder_equals_library():
    enc = encoder(default_vocabulary())
    rng = random.Random(3)
    texts = ["", "a  b   c\n d", "<|endoftext|> x", "it's we'll don't", "a b  \t x", "日本 語 a", "½ ² 3rd", "x\x1cy z", "  lead", "trail  ",
             "é́ b", "..' '..s 'S", "a_b _c", "ab!'s", " '", "𝒜 b", "foo\x85bar baz", "word*** the&&& end.###"]
    texts += ["".join(rng.choice("ab 'Sé.,*_1\n\t ½ 日") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for text in texts:
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_added_tokens_get_the_ids_of_a_fresh_library():
    fresh, enc = Tokenizer.from_file(default_vocabulary()), encoder(default_vocabulary())
    rng = random.Random(5)
    texts = ["a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> x", "a <|endoftext|><|endoftext|>\n日本", "<|endoftext| >", "<|ENDOFTEXT|>", "word " * 50 + "<|endoftext|>"]
    texts += ["".join(rng.choice(["<|endoftext|>", "<|", "|>", "word", " ", "É", "日", "'s", "\n"]) for _ in range(rng.randint(0, 20))) for _ in range(500)]
    assert np.frombuffer(enc.encode("a<|endoftext|>b"), "<u4").tolist() == [64, 50256, 65]
    for text in texts:
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == fresh.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("seed", range(5))
def test_assign_fills_every_sequence(seed):
    rng = random.Random(seed)
    capacity = rng.choice([16, 100, 1024])
    lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 400))), reverse=True)
    pieces = assign(lengths, capacity)
    room = room_for(sum(lengths), capacity)
    used, seen = defaultdict(list), defaultdict(list)
    for doc, start, n, seq, offset in pieces:
        used[seq].append((offset, n))
        seen[doc].append((start, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, m in sorted(seen[doc]):
            assert start == at
            at += m
        assert at == n
    for seq, size in enumerate(room):
        at = 0
        for offset, n in sorted(used[seq]):
            assert offset == at
            at += n
        assert at == size <= capacity
    assert all(s == capacity or s & (s - 1) == 0 for s in room)


def test_assign_balances_cost():
    lengths = sorted([700] * 40 + [300] * 40 + [24] * 40, reverse=True)
    cost = defaultdict(float)
    for _, _, n, seq, _ in assign(lengths, 1024):
        cost[seq] += n + n * n / 1024
    assert max(cost.values()) / min(cost.values()) < 1.05


def check(spark, rows, groups=None, **settings):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, g int, ids int")
    pieces = pack_texts(df, **settings).collect()
    enc = encoder(default_vocabulary())
    want = defaultdict(int)
    for i, t in rows:
        want[(i, enc.encode(t or "") + bytes(4))] += 1
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.id].append(p)
        by_seq[p.sequence_id].append(p)
        assert len(p.ids) == 4 * p.length
    for i in {r[0] for r in rows}:
        expected = b"".join(sorted(ids * n for (k, ids), n in want.items() if k == i))
        assert sum(len(p.ids) for p in by_doc[i]) == len(expected)
        if sum(n for (k, _), n in want.items() if k == i) == 1:
            assert b"".join(bytes(p.ids) for p in sorted(by_doc[i], key=lambda p: p.start)) == expected
            assert {p.doc_tokens for p in by_doc[i]} == {len(expected) // 4}
    for seq in by_seq.values():
        at = 0
        for p in sorted(seq, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    return by_seq


def test_texts_with_nulls_repeats_and_long_ones(spark):
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (4, "word and word. " * 9000), (None, "null id"), (5, "x" * 5000)]
    check(spark, rows)
    assert pack_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_groups_and_little_padding(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma."]) for _ in range(rng.randint(1, 900)))) for i in range(300)]
    by_seq = check(spark, rows, group_bytes=100_000)
    sizes = [sum(p.length for p in s) for s in by_seq.values()]
    padding = sum(1024 - s for s in sizes if s & (s - 1))
    assert padding < 0.01 * sum(sizes)
    assert len({s >> 32 for s in by_seq}) > 1


def test_pack_takes_any_tokens(spark):
    df = spark.createDataFrame([("k", 0, 3, bytearray(np.arange(3, dtype="<u4").tobytes())), ("e", 0, 0, bytearray())],
                               "id string, start long, doc_tokens long, ids binary")
    got = pack(df, capacity=8).orderBy(F.col("length").desc()).collect()
    assert [(p.id, p.start, p.length, p.offset) for p in got] == [("k", 0, 2, 0), ("k", 2, 1, 0)]
