"""Prefix trie and tree contraction against plain dictionaries."""

import hashlib
import random
import re
import zlib

import pytest

from meterlens.llm import prefixtrie
from meterlens.llm.prefixtrie import end_digests, prefix_trie, subtree_totals

SCHEMA = "conv_id long, turn long, role string, text string, node string, n_leaves int"


def plain(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).digest()
            convs.setdefault(conv, []).append((turn is not None, turn or 0, digest, role, text))
    convs = {c: [t[3:] for t in sorted(turns)] for c, turns in convs.items()}
    nodes, kids, totals = {}, {}, {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        said = convs.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + own[h:]
        for d in range(len(said) + 1):
            nodes.setdefault(tuple(said[:d]), []).append((c, d == len(said)))
    for key in nodes:
        if key:
            kids.setdefault(key[:-1], []).append(key)
    for key in sorted(nodes, key=len, reverse=True):
        below = [totals[k] for k in kids.get(key, [])]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
        totals[key] = (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(nodes[key]) - 1) * words)
    ends = {k: ",".join(map(str, sorted(c for c, e in v if e))) for k, v in nodes.items()}
    return sorted(((min(v)[0], len(k), min(nodes[k[:-1]])[0] if k else None, len(v), len(kids.get(k, [])), *totals[k],
                    hashlib.sha256(ends[k].encode()).hexdigest()) for k, v in nodes.items()), key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in prefix_trie(df).collect()), key=repr)


def some(rng, convs, turns, choices):
    return [(c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]), rng.choice(choices))
            for c in convs for t in range(rng.randrange(1, turns))]


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_plain_trie(spark, seed):
    rng = random.Random(seed)
    ids = rng.sample(range(-60, 400), 70) + [10**12 + 20, 10**12 + 21]
    rows = some(rng, ids, 7, ["a b", "a\tb c", "", None, " x y"])
    rows += rng.sample(rows, 20) + [(None, 0, "user", "lost")]  # repeated rows, a null id
    assert run(spark, rows) == plain(rows)


def test_hot_conversations_and_a_long_one(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "PIECE", 7)
    rows = [(c, t, "user", f"same {t}") for c in range(100) for t in range(3)]
    rows += [(300, t, "user", f"long {t} " + "w " * (t % 3)) for t in range(60)]
    rows += [(301, t, "user", f"long {t} " + "w " * (t % 3)) for t in range(45)]
    assert run(spark, rows) == plain(rows)


def test_turnless_and_empty(spark):
    lonely = next(c for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4)
    rows = [(lonely, 0, "user", "gone")]  # its one turn is replaced by those of a conversation that is absent
    assert run(spark, rows) == plain(rows) == [(lonely, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lonely).encode()).hexdigest())]
    assert run(spark, []) == [] and run(spark, [(None, 1, "user", "x")]) == []


@pytest.mark.parametrize("shape", ["path", "star", "comb", "random", "one"])
def test_contraction_of_any_tree(spark, shape):
    rng = random.Random(shape)
    n = 1 if shape == "one" else 120
    parent = [None] + [{"path": i - 1, "star": 0, "comb": i - 1 if i % 2 else max(0, i - 2), "random": rng.randrange(i), "one": 0}[shape]
                       for i in range(1, n)]
    depth, kids = [0] * n, [0] * n
    for i in range(1, n):
        depth[i] = depth[parent[i]] + 1
        kids[parent[i]] += 1
    values = [rng.randrange(-5, 50) for _ in range(n)]
    total = values[:]
    for i in reversed(range(1, n)):
        total[parent[i]] += total[i]
    name = lambda i: None if i is None else i.to_bytes(4, "big")
    df = spark.createDataFrame([(name(i), name(parent[i]), depth[i], kids[i], values[i]) for i in range(n)],
                               "node binary, parent binary, depth int, n_children long, v long")
    got = {int.from_bytes(r["node"], "big"): r["v"] for r in subtree_totals(df, ["v"]).collect()}
    assert got == dict(enumerate(total))


def test_contraction_by_hash_bits_alone(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "DEPTH_ROUNDS", 0)
    rows = [(bytes([i]), bytes([i - 1]) if i else None, i, int(i < 40), 1) for i in range(41)]
    df = spark.createDataFrame(rows, "node binary, parent binary, depth int, n_children long, v long")
    assert {r["node"][0]: r["v"] for r in subtree_totals(df, ["v"]).collect()} == {i: 41 - i for i in range(41)}


def test_end_digests_of_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "PIECE", 3)
    ids = {b"a": [5, -7, 100, 20, 3, 11, 8], b"b": [1], b"c": list(range(50))}
    df = spark.createDataFrame([(k, c) for k, v in ids.items() for c in v], "node binary, conv long").repartition(4)
    got = {bytes(r["node"]): r["ends_sha256"] for r in end_digests(df).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in ids.items()}
