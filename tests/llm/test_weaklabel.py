"""Weak-label classifier: EM on simulated votes, held-out accuracy, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlens.llm.weaklabel import LABELLERS, classify, estimate, fit, measure, train, votes

SF = "/root/testdata/sf0.1"


def test_em_recovers_accuracies():
    rng = np.random.default_rng(0)
    n, m = 40_000, len(LABELLERS)
    truth = rng.random(n) < 0.2
    hit = np.linspace(0.6, 0.9, m)
    counts = {}
    speak = rng.random((n, m)) < 0.7
    right = rng.random((n, m)) < np.where(truth[:, None], hit, 0.97)
    vote = np.where(speak, np.where(right == truth[:, None], "1", "0"), "-")
    vote = np.where(speak, np.where(truth[:, None], np.where(right, "1", "0"), np.where(right, "0", "1")), "-")
    for row in vote:
        key = "".join(row)
        counts[key] = counts.get(key, 0) + 1
    share, table, posterior = estimate(counts)
    assert share == pytest.approx(0.2, abs=0.02)
    spoken = table[:, 1, 1] / (table[:, 1, 0] + table[:, 1, 1])
    assert np.abs(spoken - hit).max() < 0.05
    guess = np.array([posterior["".join(row)] > 0.5 for row in vote])
    assert (guess == truth).mean() > 0.93


def test_em_without_votes():
    silent = "-" * len(LABELLERS)
    share, _, posterior = estimate({silent: 5})
    assert posterior == {silent: share}
    assert estimate({})[2] == {}


def test_train_separates():
    rng = np.random.default_rng(1)
    x = rng.random((500, 20)).astype(np.float32)
    y = (x[:, 3] > x[:, 7]).astype(np.float32)
    w = train(x, y, rounds=2000)
    assert (((np.hstack([x, np.ones((500, 1))]) @ w) > 0) == (y > 0.5)).mean() > 0.95
    assert not train(x[:0], y[:0]).any()


def test_labellers_on_plain_cases():
    clean = b"The quick brown fox jumps over the lazy dog. It was a fine and sunny day for all of them."
    assert "1" not in votes(measure(clean))
    assert "1" in votes(measure(b"BUY!! NOW!! THE!! BEST!! PILLS!! HERE!! TODAY!! OK!! YES!!"))
    assert "1" in votes(measure(b"spam spam spam spam spam spam spam spam spam spam"))
    assert votes(measure(b"")) == "-" * len(LABELLERS)


def test_held_out_accuracy(spark):
    # The labels take no part in fitting; they only judge the result.
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    judged = classify(docs, fit(docs)).select("row.doc_id", "kept").toPandas().merge(labels, on="doc_id")
    clean, junk = judged[judged.quality == 1], judged[judged.quality == 0]
    assert clean.kept.mean() > 0.998 and (~junk.kept).mean() > 0.97


def test_copies_of_one_text_leave_the_verdicts_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sentence = "The committee met on Tuesday and agreed that the new bridge should be opened in spring."
    copies = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit(sentence).alias("text"))
    alone = {r.doc_id: r.kept for r in classify(docs, fit(docs)).select("row.doc_id", "kept").collect()}
    model = fit(docs.union(copies))
    beside = {r.doc_id: r.kept for r in classify(docs, model).select("row.doc_id", "kept").collect()}
    rejected = sum(not k for k in alone.values())
    assert rejected > 100 and sum(alone[i] != beside[i] for i in alone) <= rejected // 20
    assert classify(copies.limit(1), model).first().kept


def test_a_very_long_clean_text_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    clean = [r.text for r in docs.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("quality = 1 AND length(text) > 500").collect()]
    words = " ".join(clean).split(" ")
    long = " ".join((words * (1 + 200_000 // len(words)))[:200_000])
    assert measure(long.encode()).words >= 200_000 and "1" not in votes(measure(long.encode()))
    df = spark.createDataFrame([(1, long)], "doc_id long, text string")
    assert classify(df, fit(docs)).first().kept


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "word " * 40), (3, "BUY!! NOW!! " * 20_000), (3, "BUY!! NOW!! " * 20_000)]
    rows += [(10 + i, f"Some plain words number {i} stand here, and they are read by someone. So it goes on for a while.") for i in range(60)]
    df = spark.createDataFrame([(*r, 0.5, True) for r in rows], "doc_id long, text string, score double, kept boolean")
    out = classify(df, fit(df))
    assert out.count() == len(rows)
    got = {r.doc_id: r.kept for r in out.select("row.doc_id", "kept").collect()}
    assert got[1] and got[2] and not got[3] and all(got[10 + i] for i in range(60))
    assert out.filter("kept").select("row.*").columns == df.columns
    empty = df.filter("false")
    assert classify(empty, fit(empty)).count() == 0
