"""Quality classifier from weak labels.

Overlapping heuristic labellers vote junk, clean or nothing on every whole
text.  Expectation-maximisation over the counts of vote patterns of the whole
corpus (at most 3 to the number of labellers) estimates how each labeller
votes on junk and on clean texts, without any true label.  The posteriors of
a bounded sample then train a linear scorer on hashed features, which judges
all documents, also where labellers are silent or disagree.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_row, field, quoted

#: Words of a stretch in which distinct words are counted, so that the share does not fall with the length of a text.
STRETCH = 200
#: Hashed feature slots, and distinct texts in the training sample (expected number; the bound is twice that).
SLOTS, SAMPLE = 2048, 4000

_WORD_SYMBOLS = tuple(bytes([c]) * 2 for c in range(33, 127) if not chr(c).isalnum())


def _shapes() -> np.ndarray:
    """Byte -> shape: letters, capitals, digits and white space each one number, every symbol its own."""
    table = np.ones(256, np.int64)  # a-z and the bytes of other letters
    for b in range(128):
        c = chr(b)
        table[b] = 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 5 if c == "\n" else 4 if c.isspace() else 6 + b
    return table


SHAPES = _shapes()


@dataclass
class Measures:
    """What labellers and scorer see of a text."""

    words: int
    symbols: float  # share of non-space bytes that are ASCII symbols
    capitals: float  # share of ASCII letters that are capitals
    marked: float  # share of words that end in a doubled symbol
    bars: float  # share of words that are a bar
    distinct: float  # distinct words by words, in stretches of STRETCH words
    repeats: float  # share of words equal to the word before
    same_lines: float  # share of lines seen before in the text
    endings: float  # share of words that end a sentence


def measure(data: bytes) -> Measures:
    words = data.split()
    n = max(1, len(words))
    counts = np.bincount(SHAPES[np.frombuffer(data, np.uint8)], minlength=134)
    dense = max(1, len(data) - counts[4] - counts[5])
    lines = data.split(b"\n")
    return Measures(len(words), counts[6:].sum() / dense, counts[2] / max(1, counts[1] + counts[2]),
                    sum(map(bytes.endswith, words, [_WORD_SYMBOLS] * len(words))) / n, words.count(b"|") / n,
                    sum(len(set(words[i:i + STRETCH])) for i in range(0, len(words), STRETCH)) / n, sum(map(bytes.__eq__, words, words[1:])) / n, 1 - len(set(lines)) / len(lines),
                    sum(map(bytes.endswith, words, [(b".", b"!", b"?")] * len(words))) / n)


def _vote(value: float, clean_below: float, junk_above: float) -> str:
    return "1" if value > junk_above else "0" if value <= clean_below else "-"


#: Labellers by name: 1 junk, 0 clean, - silent.
LABELLERS = {
    "symbols": lambda m: _vote(m.symbols, 0.06, 0.10),
    "capitals": lambda m: _vote(m.capitals, 0.10, 0.35),
    "marked words": lambda m: _vote(m.marked, 0.02, 0.20),
    "table bars": lambda m: _vote(m.bars, 0.0, 0.05),
    "few words": lambda m: _vote(-m.distinct, -0.50, -0.35),
    "repeats": lambda m: _vote(m.repeats, 0.05, 0.20),
    "same lines": lambda m: _vote(m.same_lines, 0.20, 0.45),
    "endings": lambda m: _vote(m.endings, 0.25, 0.45),
}
#: Texts of fewer words are too short for shares to tell anything: all labellers are silent.
SHORTEST = 8


def votes(m: Measures) -> str:
    return "-" * len(LABELLERS) if m.words < SHORTEST else "".join(label(m) for label in LABELLERS.values())


def features(data: bytes, m: Measures) -> np.ndarray:
    """Square roots of the shares of hashed 4-byte shapes, and a few hashed steps of the measures."""
    shape = SHAPES[np.frombuffer(data, np.uint8)]
    x = np.zeros(SLOTS, np.float32)
    if len(shape) >= 4:
        code = ((shape[:-3] * 137 + shape[1:-2]) * 137 + shape[2:-1]) * 137 + shape[3:]
        slot = (code * 2654435761 >> 15) % SLOTS
        x += np.sqrt(np.bincount(slot, minlength=SLOTS) / len(slot))
    if m.words >= SHORTEST:
        for name, value in (("distinct", m.distinct), ("repeats", m.repeats), ("lines", m.same_lines), ("ends", m.endings)):
            x[zlib.crc32(f"{name} {int(value * 10)}".encode()) % SLOTS] += 0.5
    return x


# ------------------------------------------------------------------ fitting

def estimate(patterns: dict[str, int], rounds: int = 200) -> tuple[float, np.ndarray, dict[str, float]]:
    """EM over counts of vote patterns: share of junk, P(vote | class) by [labeller, class, vote], posterior by pattern.

    Starts from "any junk vote means junk".  All-silent patterns take no part
    and get the share of junk as their posterior.
    """
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], float)
    vote = np.array([["01-".index(c) for c in k] for k in keys], int).reshape(len(keys), len(LABELLERS))
    spoken = (vote < 2).any(axis=1) if len(keys) else np.zeros(0, bool)
    q = np.where((vote == 1).any(axis=1), 0.95, 0.05)
    share, table = 0.5, np.full((len(LABELLERS), 2, 3), 1 / 3)
    one = np.eye(3)[vote]  # pattern, labeller, vote
    for _ in range(rounds):
        if not spoken.any():
            break
        weight = np.stack([(1 - q) * n * spoken, q * n * spoken])
        table = np.einsum("cp,plv->lcv", weight, one) + 0.5
        table /= table.sum(axis=2, keepdims=True)
        share = float(np.clip(weight[1].sum() / weight.sum(), 1e-4, 1 - 1e-4))
        logs = np.einsum("plv,lcv->pc", one, np.log(table))
        gap = np.clip(logs[:, 1] - logs[:, 0] + np.log(share / (1 - share)), -50, 50)
        old, q = q, 1 / (1 + np.exp(-gap))
        if np.abs(q - old).max() < 1e-9:
            break
    q = np.where(spoken, q, share)
    return share, table, dict(zip(keys, q.tolist()))


def train(x: np.ndarray, target: np.ndarray, penalty: float = 1e-5, rounds: int = 600) -> np.ndarray:
    """Logistic weights (last: bias) for soft targets, by accelerated gradient descent."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    if not len(x):
        return np.zeros(x.shape[1], np.float32)
    step = 4 / max(1e-9, float((x * x).sum(axis=1).mean()))
    w = z = np.zeros(x.shape[1], np.float32)
    for k in range(rounds):
        p = 1 / (1 + np.exp(-(x @ z)))
        new = z - step * (x.T @ (p - target) / len(x) + penalty * z).astype(np.float32)
        z, w = new + k / (k + 3) * (new - w), new
    return w


@dataclass
class Model:
    share: float
    accuracies: np.ndarray
    posteriors: dict[str, float]
    weights: np.ndarray

    def judge(self, text: str | None) -> tuple[float, float]:
        """Posterior of junk from the labellers, and the scorer's probability of junk."""
        data = (text or "").encode("utf-8", "replace")
        m = measure(data)
        x = features(data, m)
        return (self.posteriors.get(votes(m), self.share),
                float(1 / (1 + np.exp(-(x @ self.weights[:-1] + self.weights[-1])))))


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Labeller statistics from all documents; the scorer from a sample by text hash of ``sample`` expected distinct texts."""
    texts = docs.select(F.col(quoted(text_col)).alias("text"))

    def pattern(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [votes(measure((t.as_py() or "").encode("utf-8", "replace"))) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["pattern"])

    counted = texts.mapInArrow(pattern, "pattern string").groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()
    share, accuracies, posteriors = estimate({r["pattern"]: r["n"] for r in counted})

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, target = [], []
            for text in batch["text"]:
                data = (text.as_py() or "").encode("utf-8", "replace")
                m = measure(data)
                rows.append(features(data, m).tobytes())
                target.append(posteriors.get(votes(m), share))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(target)], names=["x", "y"])

    # The hash is of the text, so the sample holds distinct texts at the same rate, whatever their copies; one row of each is taken.
    total = texts.agg(F.approx_count_distinct(F.xxhash64("text"), 0.02)).first()[0]
    limit = min(1 << 30, round((1 << 30) * sample / max(1, total)))
    chosen = texts.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < limit).mapInArrow(featured, "x binary, y double").distinct()
    got = chosen.limit(2 * sample).collect()
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in got), np.float32).reshape(len(got), SLOTS)
    return Model(share, accuracies, posteriors, train(x, np.array([r["y"] for r in got], np.float32)))


def classify(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per input row: row (struct of all its columns), weak_posterior, score, kept.

    Both numbers are probabilities of junk; rows scored over ``threshold`` are
    not kept.  Null counts as empty; empty and very short texts, about which
    no labeller speaks, are judged by the scorer alone.  The threshold
    stands above one half, so that documents in doubt stay.  An empty table gives
    an empty result.
    """
    @F.arrow_udf(T.StructType([T.StructField("weak_posterior", T.DoubleType()), T.StructField("score", T.DoubleType())]))
    def judged(texts: pa.Array) -> pa.Array:
        got = [model.judge(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([g[k] for g in got], pa.float64()) for k in (0, 1)],
                                          names=["weak_posterior", "score"])

    done = as_row(docs).withColumn("judged", judged(field("row", text_col)))
    return done.select("row", "judged.weak_posterior", "judged.score", (F.col("judged.score") <= threshold).alias("kept"))
