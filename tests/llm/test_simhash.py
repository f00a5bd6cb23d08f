"""SimHash components against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from meterlens.llm import simhash
from meterlens.llm.components import connected_components
from meterlens.llm.simhash import fingerprint, fingerprint_components, keep_one_of_each, plan_search, simhash_dedup


def plain(text, width=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + width]).encode(), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


TEXTS = ["One two three four", "one  TWO\tthree four", "", None, " \n ", "one", "one two", "É é straße ÀB", "a\x1cb c d", "x " * 50_000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert fingerprint(text) % (1 << 64) == plain(text)


def test_fingerprint_in_chunks(monkeypatch):
    text = " ".join(str(i * i) for i in range(500))
    whole = fingerprint(text)
    monkeypatch.setattr(simhash, "_CHUNK", 7)
    assert fingerprint(text) == whole == plain(text) - (1 << 64 if plain(text) >> 63 else 0)


@pytest.mark.parametrize("max_bits", [0, 1, 3, 5])
def test_plan_meets_the_pigeonhole_bound(max_bits):
    rng = np.random.default_rng(1)
    bits = (rng.random((500, 64)) < rng.random(64)).astype(float)
    bits[:, 1] = bits[:, 0]  # correlated bits
    for n in (500, 10**6, 10**10):
        plan = plan_search(n, bits.T @ bits * n / 500, max_bits)
        assert sum(t + 1 for _, t in plan) == max_bits + 1
        used = [b for g, _ in plan for b in g]
        assert len(used) == len(set(used))


def clustered(rng, n):
    out = set()
    while len(out) < n:
        centre = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 9)):
            near = centre
            for _ in range(rng.randrange(0, 4)):
                near ^= 1 << rng.randrange(64)
            out.add(near)
    return sorted(x - (1 << 64) if x >> 63 else x for x in out)


@pytest.mark.parametrize("max_bits,block", [(3, 1024), (2, 1024), (3, 16)])
def test_components_equal_brute_force(spark, monkeypatch, max_bits, block):
    monkeypatch.setattr(simhash, "BLOCK", block)  # small blocks: large keys are cut into cells
    rng = random.Random(max_bits)
    fps = clustered(rng, 400)
    if block == 16:  # one dense ball
        centre = rng.getrandbits(62)
        fps = sorted({*fps, *(centre ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62)) for _ in range(300))})
    got = {r.fp: r.root for r in fingerprint_components(spark.createDataFrame([(x,) for x in fps], "fp long"), max_bits).collect()}
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) % (1 << 64)).bit_count() <= max_bits]
    want = components(pairs, fps)
    linked = {n for p in pairs for n in p}
    assert got == {n: want[n] for n in linked}


def docs(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(7, base), (3, base + " tail"), (9, base.replace("w150 ", "other ")), (4, "something else entirely here"),
            (5, None), (6, ""), (8, "  "), (None, "null id text here now"), (None, base), (4, "another text with the same id"),
            (4, "another text with the same id"), (10, "A B"), (11, "a b")]
    return rows, spark.createDataFrame([(*r, 1, "r") for r in rows], "doc_id long, text string, fp int, row string")


def test_dedup_cases(spark):
    rows, df = docs(spark)
    got = simhash_dedup(df).collect()
    fps = [plain(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    root = components(pairs, range(len(rows)))
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root[i]] = min(ids.get(root[i], d), d)
    want = sorted(((d, fps[i], ids.get(root[i])) for i, (d, _) in enumerate(rows)), key=repr)
    assert sorted(((r.id, r.fp % (1 << 64), r.component_id) for r in got), key=repr) == want


def test_keep_one_of_each(spark):
    rows, df = docs(spark)
    kept = keep_one_of_each(df)
    assert kept.columns == df.columns
    fps = [plain(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    root = components(pairs, range(len(rows)))
    got = kept.collect()
    assert len(got) == len(set(root.values()))
    assert {r.doc_id for r in got} >= {3, 4, 5, 10}
    empty = spark.createDataFrame([], df.schema)
    assert keep_one_of_each(empty).count() == 0 and simhash_dedup(empty).count() == 0


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [
        (200, x) for x in range(201, 260)] + [(5, 5), (None, 3), (300, 299), (300, 299)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    nodes = {n for e in real for n in e}
    want = components(real, nodes)
    least = {}
    for n in nodes:
        least[want[n]] = min(least.get(want[n], n), n)
    assert got == {n: least[want[n]] for n in nodes}
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0
