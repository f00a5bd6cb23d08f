"""Whitening against an eigendecomposition of the exact covariance."""

from fractions import Fraction

import numpy as np
import pytest

from meterlens.llm import registry
from meterlens.llm.whitening import fit, shifted_cholesky, triangular_solve, whiten

SMALL = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, whitened string").repartition(3)


def run(spark, rows, **options):
    df = frame(spark, rows)
    return whiten(df, fit(df, **options), **{k: v for k, v in options.items() if k != "components"}).collect()


def plain(vectors, scale=1024.0, offset=100_000, components=8):
    """Whitened rows, deviations and shares of the variance, from exact integers."""
    x = [[int(np.floor(scale * float(c))) + offset for c in np.array(v, "f4")] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    off = [[n * r[j] - sums[j] for j in range(d)] for r in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in off), n**3)) for j in range(d)] for i in range(d)])
    e, w = np.linalg.eigh(cov)
    e, w = e[::-1][:components], w[:, ::-1][:, :components]
    keep = e > e.max(initial=0) * 1e-13 * d
    centred = np.array([[float(Fraction(c, n)) for c in r] for r in off])
    return centred @ w[:, keep] / np.sqrt(e[keep]), [sum(c * c for c in r) for r in off], e[keep] / np.trace(cov)


def same(got, vectors, **options):
    white, deviation, share = plain(vectors, **options)
    mine = np.array([r["whitened"] for r in got]).reshape(len(got), -1)
    assert mine.shape == white.shape
    signs = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine * signs - white).max(initial=0) < 1e-8
    assert [int(r["deviation"]) for r in got] == deviation
    assert all(np.allclose(r["explained"], share, rtol=1e-9) for r in got)
    assert all(r["identity_error"] < 1e-9 and r["n"] == len(vectors) for r in got)


def test_equals_eigenvectors_of_the_exact_covariance(spark):
    rng = np.random.default_rng(0)
    vectors = (rng.normal(size=(300, 12)) * np.linspace(0.02, 2, 12) + 0.3).tolist()
    rows = list(enumerate(vectors))
    got = sorted(run(spark, rows), key=lambda r: r["row"]["vec_id"])
    same(got, vectors)
    assert got[0]["row"]["whitened"] == "x"  # extra columns stay apart


def test_rows_that_take_no_part_and_repeated_rows(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(60, 5)).tolist()
    vectors += vectors[:20]  # repeated rows count again
    rows = [(i if i % 7 else None, v) for i, v in enumerate(vectors)]
    bad = [(900, None), (901, [0.1, None, 0.2, 0.3, 0.4]), (902, [float("nan")] * 5), (903, [float("inf")] + [0.0] * 4), (904, [3e38] * 5)]
    got = run(spark, rows + bad)
    assert len(got) == len(rows)
    white, _, _ = plain(vectors)
    mine = np.array(sorted([abs(x) for x in r["whitened"]] for r in got))
    assert np.abs(mine - np.array(sorted(np.abs(white).tolist()))).max() < 1e-8


def test_rank_below_full(spark):
    rng = np.random.default_rng(2)
    flat = rng.integers(-9, 9, size=(50, 3)) / 8.0
    vectors = np.hstack([flat, flat[:, :2] * 2, np.full((50, 1), 0.5)]).tolist()  # rank 3 of 6
    got = sorted(run(spark, list(enumerate(vectors))), key=lambda r: r["row"]["vec_id"])
    assert len(got[0]["whitened"]) == 3
    same(got, vectors)
    few = rng.normal(size=(4, 10)).tolist()  # fewer rows than dimensions
    got = sorted(run(spark, list(enumerate(few))), key=lambda r: r["row"]["vec_id"])
    assert len(got[0]["whitened"]) == 3
    same(got, few)


def test_equal_rows_single_rows_and_empty(spark):
    for rows in ([(1, [0.5, 0.25])], [(i, [0.5, 0.25]) for i in range(5)], [(1, []), (2, [])]):
        got = run(spark, rows)
        assert [(r["n"], int(r["deviation"]), r["whitened"], r["explained"]) for r in got] == [(len(rows), 0, [], [])] * len(rows)
    assert run(spark, []) == [] and run(spark, [(1, None)]) == []


def test_lengths_are_populations_of_their_own(spark):
    rng = np.random.default_rng(3)
    short, long = rng.normal(size=(40, 2)).tolist(), rng.normal(size=(30, 4)).tolist()
    got = sorted(run(spark, list(enumerate(short + long))), key=lambda r: r["row"]["vec_id"])
    same(got[:40], short)
    same(got[40:], long)


def test_values_beyond_64_bits_stay_exact(spark):
    vectors = [[1e15, -2e14], [3e14, 5e14], [-1e15, 1e13]]
    got = sorted(run(spark, list(enumerate(vectors))), key=lambda r: r["row"]["vec_id"])
    _, deviation, _ = plain(vectors)
    assert [int(r["deviation"]) for r in got] == deviation and deviation[0] > 1 << 64


def test_ill_conditioned_rows(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 6)) * 1e6
    vectors = np.hstack([base, base[:, :1] + rng.normal(size=(400, 1))]).astype("f4").tolist()
    got = sorted(run(spark, list(enumerate(vectors))), key=lambda r: r["row"]["vec_id"])
    white = np.array([r["whitened"] for r in got])
    assert white.shape == (400, 7) and np.abs(white.T @ white / 400 - np.eye(7)).max() < 1e-6


def test_cholesky_steps():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(500, 70)) * np.logspace(0, -6, 70)
    factors = []
    q = a
    for step in range(3):
        factors.append(shifted_cholesky(q.T @ q, 500, always=not step))
        q = triangular_solve(q, factors[-1])
    assert np.abs(q.T @ q - np.eye(70)).max() < 1e-12
    r = factors[2] @ factors[1] @ factors[0]
    assert np.abs(q @ r - a).max() < 1e-12 and np.abs(np.tril(r, -1)).max() == 0


def test_query(spark):
    got = registry.op11_whitening(spark, SMALL).collect()
    table = sorted(spark.read.parquet(f"{SMALL}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    white, deviation, share = plain([r.embedding for r in table])
    assert {r.component for r in got} == set(range(1, 9)) and len(got) == 8 * len(table)
    at = {r.vec_id: i for i, r in enumerate(table)}
    mine = np.zeros(white.shape)
    for r in got:
        mine[at[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == deviation[at[r.vec_id]] and r.n == len(table) and r.identity_error < 1e-4
        assert r.explained == pytest.approx(share[r.component - 1], rel=1e-9)
    assert np.abs(mine * np.sign((mine * white).sum(axis=0)) - white).max() < 1e-7
