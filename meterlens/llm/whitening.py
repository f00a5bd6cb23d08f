"""Whitening of embeddings by shifted CholeskyQR.

Entries become integers floor(scale * c) + offset.  One pass counts the rows
and sums every dimension exactly; the rows are centred with that before they
are multiplied.  Gram passes then orthogonalise the centred rows: each pass
adds up the Gram matrix of the rows, solved against the triangular factors so
far, its Cholesky factor (of the Gram matrix plus a small shift in the first pass, and later
where it is still ill-conditioned) becomes the next one, until the Gram matrix
is the identity or nothing is left to gain.  The factors compose to R, whose singular values
and right singular vectors are those of the rows, at their own condition and
not at its square.

Only sums of dimension and dimension-by-dimension size reach the driver; they
are added up by Spark, an entry at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field as default

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_row, field, quoted

#: Passes at most; three settle ordinary data, more are for ranks that are not full.
PASSES = 6
_EPS = float(np.finfo(float).eps)


@dataclass
class Basis:
    """What is known of the vectors of one length."""

    n: int
    sums: np.ndarray  # Python integers
    factors: list[np.ndarray] = default(default_factory=list)  # upper triangular, in the order of the passes
    components: np.ndarray | None = None  # columns, already divided by the square root of their eigenvalue
    explained: np.ndarray | None = None
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact; Python integers where 64 bits do not hold them."""
        reach = self.n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in self.sums), default=0)
        if reach < 1 << 62:
            return self.n * x - self.sums.astype("int64")
        return self.n * x.astype(object) - self.sums

    def rows(self, x: np.ndarray) -> np.ndarray:
        return np.asarray(self.centred(x) / self.n, dtype="float64")


def triangular_solve(a: np.ndarray, r: np.ndarray, block: int = 32) -> np.ndarray:
    """``a`` times the inverse of upper triangular ``r``, column by column."""
    q = a.copy()
    for s in range(0, r.shape[0], block):
        e = min(s + block, r.shape[0])
        q[:, s:e] -= q[:, :s] @ r[:s, s:e]
        for j in range(s, e):
            q[:, j] = (q[:, j] - q[:, s:j] @ r[s:j, j]) / r[j, j]
    return q


def shifted_cholesky(gram: np.ndarray, n: int, always: bool) -> np.ndarray:
    """Upper triangular R with R'R = ``gram`` plus a shift: ``always``, or where it is not safely positive without."""
    d = len(gram)
    norm = float(np.linalg.norm(gram, 2))
    shift = 11 * (n * d + d * (d + 1)) * _EPS / 2 * norm
    if always or float(np.linalg.eigvalsh(gram)[0]) <= shift:
        gram = gram + max(shift, 100 * d * _EPS * norm) * np.eye(d)
    return np.linalg.cholesky(gram).T


def whole_vectors(vectors: DataFrame, column: str, scale: float) -> DataFrame:
    """Rows whose vector holds numbers only, each small enough for a long once scaled."""
    held = F.forall(F.col(column), lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) * scale < 2.0**62), F.lit(False)))
    return vectors.filter(F.col(column).isNotNull() & held)


def _matrices(column: pa.Array, scale: float, offset: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, integer matrix) for each length of vector in a batch."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype("f8")).astype("int64") + offset
    starts = np.append(0, np.cumsum(lengths))[:-1]
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield at, values[starts[at][:, None] + np.arange(d)]


def _total(rows: DataFrame, each, kind: str) -> dict[int, dict[int, object]]:
    """Sums of ``each(matrix)`` by vector length and place; partial sums of a task are added up by Spark."""
    as_type = pa.decimal128(38, 0) if kind.startswith("decimal") else pa.float64()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, part in each(batch["vector"]):
                held[d] = held[d] + part if d in held else part
        for d, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), d), pa.int32()), pa.array(np.arange(len(part)), pa.int32()),
                                              pa.array(part.tolist(), as_type)], names=["dim", "place", "part"])

    added = rows.select("vector").mapInArrow(partial, f"dim int, place int, part {kind}").groupBy("dim", "place").agg(F.sum("part").alias("s"))
    found: dict[int, dict[int, object]] = {}
    for r in added.collect():  # at most a square matrix for each length
        found.setdefault(r["dim"], {})[r["place"]] = r["s"]
    return found


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = 8, scale: float = 1024.0, offset: int = 100_000) -> dict[int, Basis]:
    """The whitening basis of each vector length, fitted on all rows that take part."""
    rows = whole_vectors(vectors.select(F.col(quoted(vector_col)).alias("vector")), "vector", scale)

    def sums(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        for at, x in _matrices(column, scale, offset):
            if len(x):
                wide = x.astype(object) if int(np.abs(x).max(initial=0)) >= (1 << 62) // len(x) else x
                yield x.shape[1], np.append(wide.sum(axis=0).astype(object), len(at))

    bases = {}
    for d, places in _total(rows, sums, "decimal(38,0)").items():
        bases[d] = Basis(int(places[d]), np.array([int(places[j]) for j in range(d)], object))

    def gram(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        for _, x in _matrices(column, scale, offset):
            if x.size and x.shape[1] in todo:
                q = bases[x.shape[1]].rows(x)
                for r in bases[x.shape[1]].factors:
                    q = triangular_solve(q, r)
                yield x.shape[1], (q.T @ q)[np.triu_indices(x.shape[1])]

    def matrices() -> dict[int, np.ndarray]:
        found = {}
        for d, places in _total(rows, gram, "double").items():
            upper = np.zeros((d, d))
            upper[np.triu_indices(d)] = [places[i] for i in range(d * (d + 1) // 2)]
            found[d] = upper + np.triu(upper, 1).T
        return found

    todo, last = set(bases) - {0}, {}
    for step in range(PASSES):
        if not todo:
            break
        for d, g in matrices().items():
            basis, last[d] = bases[d], g
            # Settled: orthonormal, or (rank below full) each direction either kept or gone.
            e = np.linalg.eigvalsh(g) if step else np.full(1, 0.5)
            if not g.any() or np.all((np.abs(e - 1) < 1e-10) | (np.abs(e) < 1e-18)) or step + 1 == PASSES:
                todo.discard(d)
            else:
                basis.factors.append(shifted_cholesky(g, basis.n, always=not step))
    for d, basis in bases.items():
        _decompose(basis, last.get(d, np.zeros((d, d))), components)

    def identity(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        for _, x in _matrices(column, scale, offset):
            if x.size:
                w = bases[x.shape[1]].rows(x) @ bases[x.shape[1]].components  # centred: the rows are, exactly
                yield x.shape[1], (w.T @ w).ravel()

    if any(b.components.size for b in bases.values()):
        for d, places in _total(rows, identity, "double").items():
            k = bases[d].components.shape[1]
            g = np.array([places[i] for i in range(k * k)]).reshape(k, k) / bases[d].n
            bases[d].identity_error = float(np.abs(g - np.eye(k)).max(initial=0))
    return bases


def _decompose(basis: Basis, gram: np.ndarray, most: int) -> None:
    """Singular values and vectors of the composed factors; ``gram`` is what the last pass found, close to the identity."""
    d = len(gram)
    e, w = np.linalg.eigh(gram)
    r = np.sqrt(np.maximum(e, 0))[:, None] * w.T
    for factor in reversed(basis.factors):
        r = r @ factor
    _, s, v = np.linalg.svd(r) if d else (None, np.zeros(0), np.zeros((0, 0)))
    s, floor = s**2, float((s**2).max(initial=0)) * d * _EPS
    k = min(most, int((s > floor).sum()))
    v = v[:k].T
    if k:
        v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(k)])  # the largest entry of a component is positive
    basis.components = v / np.sqrt(s[:k] / basis.n)
    basis.explained = s[:k] / s.sum() if k else s[:0]


def whiten(vectors: DataFrame, bases: dict[int, Basis], vector_col: str = "embedding", scale: float = 1024.0, offset: int = 100_000) -> DataFrame:
    """Rows that take part: row (struct of all columns), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds null, non-finite or (scaled) over-long
    entries take no part.  Vectors of each length are a population of their
    own, n its rows.  deviation is the exact sum of (n * x - S)^2 as
    decimal(38,0).  whitened holds the centred vector on each component over
    the square root of its eigenvalue.  Components with an eigenvalue of zero
    (single or equal rows, fewer rows or dimensions than asked for) do not
    exist: the arrays are that much shorter, possibly empty.  Repeated rows,
    null and repeated ids count like others; an empty table gives an empty
    result.
    """
    out = T.StructType([T.StructField("n", T.LongType()), T.StructField("deviation", T.DecimalType(38, 0)),
                        T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("explained", T.ArrayType(T.DoubleType())),
                        T.StructField("identity_error", T.DoubleType())])

    @F.arrow_udf(out)
    def done(column: pa.Array) -> pa.Array:
        rows: list = [None] * len(column)
        for at, x in _matrices(column, scale, offset):
            if not len(x):
                continue
            basis = bases[x.shape[1]]
            off = basis.centred(x)
            small = off.dtype != object and int(np.abs(off).max(initial=0)) ** 2 * x.shape[1] < 1 << 62
            deviation = ((off * off) if small else (off.astype(object) ** 2)).sum(axis=1).tolist()
            whitened = (np.asarray(off / basis.n, dtype="float64") @ basis.components).tolist()
            explained = basis.explained.tolist()
            for i, dev, white in zip(at, deviation, whitened):
                rows[i] = (basis.n, dev, white, explained, basis.identity_error)
        kinds = (pa.int64(), pa.decimal128(38, 0), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64())
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=out.names)

    packed = as_row(vectors).withColumn("vector", field("row", vector_col))
    packed = whole_vectors(packed, "vector", scale).withColumn("done", done("vector"))
    return packed.select("row", "done.*")
