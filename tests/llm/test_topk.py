"""Exact top-k against a plain sort."""

import random

import numpy as np
import pytest

from meterlens.llm import topk
from meterlens.llm.topk import best_of, top_k


def plain(rows, k, every):
    alive = [(i, n, np.floor(64 * np.array(v, "f4").astype("f8")).astype(object)) for n, (i, v) in enumerate(rows)
             if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, n, q in alive:
        if i is None or i % every:
            continue
        scores = [(-int(sum(int(a) * int(b) for a, b in zip(q, c))), j is None, j or 0, j) for j, m, c in alive if m != n and len(c) == len(q)]
        scores.sort(key=lambda s: s[:3])
        out += [(i, rank, s[3], -s[0]) for rank, s in enumerate(scores[:k], 1)]
    return sorted(out, key=repr)


def run(spark, rows, k=5, every=4):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    return sorted((tuple(r) for r in top_k(df, k, every).collect()), key=repr)


@pytest.mark.parametrize("stretch", [1 << 13, 32])
def test_equals_a_plain_sort(spark, monkeypatch, stretch):
    rng = random.Random(stretch)
    rows = [(i, [rng.choice([-0.5, -0.1, 0.0, 0.2, 0.7]) for _ in range(6)]) for i in range(150)]  # many ties
    rows += [(200, None), (201, [0.1, None, 0.2, 0.1, 0.1, 0.3]), (204, [float("nan")] * 6), (208, [float("inf")] * 6), (None, [0.7] * 6)]
    monkeypatch.setattr(topk, "BLOCK", 8)
    monkeypatch.setattr(topk, "STRETCH", stretch)
    monkeypatch.setattr(topk, "_BITS", stretch.bit_length() - 1)
    monkeypatch.setattr(topk, "QUERIES", 5)
    assert run(spark, rows) == plain(rows, 5, 4)


def test_queries_go_only_to_stretches_that_can_matter(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    centres = np.eye(8) * 20
    rows = [(i, (centres[i // 64] + rng.normal(size=8)).astype("f4").tolist()) for i in range(512)]  # a cluster a stretch
    monkeypatch.setattr(topk, "BLOCK", 8)
    monkeypatch.setattr(topk, "STRETCH", 64)
    monkeypatch.setattr(topk, "_BITS", 64 .bit_length() - 1)
    monkeypatch.setattr(topk, "CHUNK", 3)
    routed, real = [], topk._routed

    def counted(homes, numbered):
        out = real(homes, numbered)
        routed.append((out.count(), homes.count() * (numbered.count() - 1)))
        return out

    monkeypatch.setattr(topk, "_routed", counted)
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<float>").repartition(1)
    got = sorted((tuple(r) for r in top_k(df, 5, 4).collect()), key=repr)
    assert got == plain(rows, 5, 4)
    sent, all_pairs = routed[0]
    assert sent < all_pairs / 2


def test_few_candidates_lengths_and_empty(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, -1.0]), (4, [1.0]), (8, [2.0]), (12, [3.0, 3.0, 3.0])]
    assert run(spark, rows) == plain(rows, 5, 4)
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0])]) == []


def test_repeated_rows_leave_out_only_the_own_row(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (3, [0.5, 0.5])]
    got = run(spark, rows)
    assert got == plain(rows, 5, 4) and [r[2] for r in got] == [0, 0, 3, 3]


def test_blocks_are_pruned_exactly_and_large_values_stay_exact():
    rng = np.random.default_rng(0)
    matrix = np.floor(rng.normal(size=(1000, 8)) * 64)
    queries = matrix[::100]
    own = np.arange(0, 1000, 100)
    got = best_of(queries, own, matrix, 7)
    for q, o, best in zip(queries, own, got):
        scores = sorted(((-int(s), p) for p, s in enumerate(matrix @ q) if p != o))[:7]
        assert best == [(-s, p) for s, p in scores]
    huge = np.floor(rng.normal(size=(30, 4)) * 1e12)
    (best,) = best_of(huge[:1], np.array([0]), huge, 3)
    exact = sorted((-sum(int(a) * int(b) for a, b in zip(huge[0].tolist(), r)), p) for p, r in enumerate(huge.tolist()) if p)[:3]
    assert best == [(-s, p) for s, p in exact]
