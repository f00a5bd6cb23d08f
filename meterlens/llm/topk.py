"""Exact top-k inner products, block at a time.

Vectors are cut into document-range blocks, each with the largest and smallest
value of every term (dimension).  A query visits the blocks in descending
order of the summed term maxima, scores a block through its forward index
(the block's matrix), and stops when a block's bound falls below its k-th
score.  Bounds are exact, so nothing is lost.

Blocks travel in stretches of bounded size.  A query first visits the blocks
of its own stretch, where it already lies, and so has a k-th score before it
is sent anywhere.  A table of the term maxima and minima of whole stretches,
in chunks, then bounds what any stretch can offer it: the query goes only to
stretches whose bound reaches that score, and there visits the blocks in
order as before.  The k best of each meeting are merged per query.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, stored

#: Vectors in a block, in a stretch (a power of two) and queries in a block.
BLOCK, STRETCH, QUERIES = 256, 1 << 13, 2048
#: Stretches in a chunk of the table of maxima.
CHUNK = 512
_BITS = STRETCH.bit_length() - 1
_NONE = np.iinfo("int64").min

_STRETCH_SCHEMA = "part int, nth int, dim int, n int, ids binary, anonymous binary, matrix binary"


def _stretches(scale: float) -> Callable:
    """Batches (id, vector) -> stretches of vectors that take part, scaled and floored."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, done = TaskContext.get().partitionId(), {}, Counter()  # stretches are counted per length
        names = [f.split()[0] for f in _STRETCH_SCHEMA.split(", ")]

        def row(dim: int, rows: list) -> pa.RecordBatch:
            done[dim] += 1
            ids = np.array([0 if i is None else i for i, _ in rows], "<i8")
            anonymous = np.array([i is None for i, _ in rows], bool)
            matrix = np.array([v for _, v in rows], "<f8").reshape(len(rows), dim)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(
                (part, done[dim] - 1, dim, len(rows), ids.tobytes(), anonymous.tobytes(), matrix.tobytes()),
                (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=names)

        for batch in batches:
            for key, vector in zip(batch["id"].to_pylist(), batch["vector"]):
                if not vector.is_valid or vector.values.null_count:
                    continue
                values = np.floor(scale * vector.values.to_numpy(zero_copy_only=False).astype("f8"))
                if np.isfinite(values).all():
                    rows = held.setdefault(len(values), [])
                    rows.append((key, values))
                    if len(rows) == STRETCH:
                        yield row(len(values), held.pop(len(values)))
        for dim, rows in held.items():
            yield row(dim, rows)

    return build


def best_of(queries: np.ndarray, own: np.ndarray, matrix: np.ndarray, k: int, least: np.ndarray | None = None) -> list[list[tuple[int, int]]]:
    """Per query its k best (score, place) in ``matrix``, ties to the smaller place; ``own`` is a place to leave out or -1.

    Blocks that cannot reach a query's ``least`` score are not visited.
    """
    size = max(1.0, float(np.abs(queries).max(initial=0)) * float(np.abs(matrix).max(initial=0)) * matrix.shape[1])
    if size >= 2.0 ** (62 - _BITS) or size >= 2.0**53:  # beyond exact doubles: Python integers
        exact = [[int(x) for x in row] for row in matrix.tolist()]
        return [sorted(((sum(int(x) * y for x, y in zip(q, row)), p) for p, row in enumerate(exact) if p != o),
                       key=lambda s: (-s[0], s[1]))[:k] for q, o in zip(queries.tolist(), own.tolist())]
    starts = np.arange(0, len(matrix), BLOCK)
    top = np.stack([matrix[s:s + BLOCK].max(axis=0) for s in starts])
    low = np.stack([matrix[s:s + BLOCK].min(axis=0) for s in starts])
    bounds = np.maximum(queries, 0) @ top.T + np.minimum(queries, 0) @ low.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    # One number a candidate: score first, then the smaller place.
    best = np.full((len(queries), k), _NONE)
    place = STRETCH - 1 - np.arange(len(matrix))
    active = np.arange(len(queries))
    for step in range(len(starts)):
        block = order[active, step]
        worst = best[active].min(axis=1)
        go = (worst == _NONE) | (bounds[active, block] >= worst >> _BITS)
        if least is not None:
            go &= bounds[active, block] >= least[active]
        active, block = active[go], block[go]
        if not len(active):
            break
        for b in np.unique(block):
            who = active[block == b]
            span = slice(starts[b], starts[b] + BLOCK)
            scores = (queries[who] @ matrix[span].T).astype("int64")
            keys = (scores << _BITS) | place[span]
            mine = (own[who] >= starts[b]) & (own[who] < starts[b] + scores.shape[1])
            keys[np.flatnonzero(mine), own[who][mine] - starts[b]] = _NONE
            best[who] = np.partition(np.hstack([best[who], keys]), -k, axis=1)[:, -k:]
    best = -np.sort(-best[:, :], axis=1) if len(best) else best
    return [[(int(x >> _BITS), STRETCH - 1 - int(x & (STRETCH - 1))) for x in row if x != _NONE] for row in best]


_HOME_SCHEMA = ("block long, stretch long, dim int, lo long, hi long, q_ids binary, q_places binary, q_matrix binary, least binary, "
                "place array<long>, query_id array<long>, vec_id array<long>, score array<long>")


def _at_home(every: int, k: int) -> Callable:
    """Stretches -> blocks of their queries, with what they find in their own stretch and the score that others must reach."""
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long, raw, longs = pa.int64(), pa.binary(), pa.list_(pa.int64())
        kinds = (long, long, pa.int32(), long, long, raw, raw, raw, raw, longs, longs, longs, longs)
        names = [f.split()[0] for f in _HOME_SCHEMA.split(", ")]
        for batch in batches:
            for r in batch.to_pylist():
                ids, anonymous = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["anonymous"], bool)
                chosen = np.flatnonzero((ids % every == 0) & ~anonymous)
                matrix = np.frombuffer(r["matrix"], "<f8").reshape(r["n"], r["dim"])
                for j, s in enumerate(range(0, len(chosen), QUERIES)):
                    p = chosen[s:s + QUERIES]
                    best = best_of(matrix[p], p, matrix, k)
                    least = np.array([b[k - 1][0] if len(b) == k and abs(b[k - 1][0]) < 1 << 62 else _NONE for b in best], "<i8")
                    rows = [(int(q), int(ids[q]), None if anonymous[at] else int(ids[at]), score) for q, b in zip(p, best) for score, at in b]
                    values = (r["stretch"] * 64 + j, r["stretch"], r["dim"], r["lo"], r["hi"], ids[p].tobytes(), p.astype("<i8").tobytes(),
                              matrix[p].tobytes(), least.tobytes(), *[[x[c] for x in rows] for c in range(4)])
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=names)

    return pick


def _extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches -> the largest and smallest value of every term in each."""
    for batch in batches:
        for r in batch.to_pylist():
            matrix = np.frombuffer(r["matrix"], "<f8").reshape(r["n"], r["dim"])
            top, low = (f(axis=0).tobytes() for f in (matrix.max, matrix.min))
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(
                (r["stretch"], r["dim"], top, low), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["stretch", "dim", "top", "low"])


def _routed(homes: DataFrame, numbered: DataFrame) -> DataFrame:
    """(stretch, block, q_ids, q_places, q_matrix, least): the queries of each block that a stretch but their own can offer something."""
    chunks = (numbered.mapInArrow(_extremes, "stretch long, dim int, top binary, low binary")
              .groupBy(F.floor(F.col("stretch") / CHUNK).alias("chunk"))
              .agg(F.collect_list(F.struct("stretch", "dim", "top", "low")).alias("entries")))  # at most CHUNK
    asked = homes.select("block", F.col("stretch").alias("home"), F.col("dim").alias("q_dim"), "q_ids", "q_places", "q_matrix", "least", F.explode(
        F.sequence(F.floor(F.col("lo") / CHUNK), F.floor((F.col("hi") - 1) / CHUNK))).alias("chunk"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["stretch", "block", "q_ids", "q_places", "q_matrix", "least"]
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        for batch in batches:
            for i in range(len(batch)):
                r = batch.slice(i, 1).to_pylist()[0]
                ids, places, least = (np.frombuffer(r[c], "<i8") for c in ("q_ids", "q_places", "least"))
                queries = np.frombuffer(r["q_matrix"], "<f8").reshape(len(ids), r["q_dim"])
                up, down = np.maximum(queries, 0), np.minimum(queries, 0)
                for e in r["entries"]:
                    if e["dim"] != r["q_dim"] or e["stretch"] == r["home"]:
                        continue
                    top, low = np.frombuffer(e["top"], "<f8"), np.frombuffer(e["low"], "<f8")
                    slack = 1e-12 * (np.abs(queries) @ np.maximum(np.abs(top), np.abs(low)))  # doubles may round a bound
                    go = np.flatnonzero((least == _NONE) | (up @ top + down @ low + slack >= least))
                    if len(go):
                        values = (e["stretch"], r["block"], ids[go].tobytes(), places[go].tobytes(), queries[go].tobytes(), least[go].tobytes())
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=names)

    return asked.join(chunks, "chunk").mapInArrow(
        route, "stretch long, block long, q_ids binary, q_places binary, q_matrix binary, least binary")


def _meetings(k: int) -> Callable:
    """Queries met with a stretch that is not their own -> what they find there."""
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                r = batch.slice(i, 1).to_pylist()[0]
                ids, anonymous = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["anonymous"], bool)
                matrix = np.frombuffer(r["matrix"], "<f8").reshape(r["n"], r["dim"])
                q_ids, places, least = (np.frombuffer(r[c], "<i8") for c in ("q_ids", "q_places", "least"))
                queries = np.frombuffer(r["q_matrix"], "<f8").reshape(len(q_ids), r["dim"])
                found = best_of(queries, np.full(len(places), -1), matrix, k, least)
                rows = [(r["block"], int(p), int(q), None if anonymous[at] else int(ids[at]), s)
                        for q, p, best in zip(q_ids, places, found) for s, at in best]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], pa.int64()) for c in range(5)],
                                                 names=["block", "place", "query_id", "vec_id", "score"])

    return meet


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: float = 64.0) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's ``k`` best of all other rows, by integer inner product.

    Components become floor(scale * x).  Queries are the rows whose id is
    divisible by ``every``; a query's own row is no candidate, other rows with
    the same id are.  Ties go to the smaller id, null ids last.  Vectors that
    are null or hold null or non-finite components take no part, and vectors
    of different lengths do not meet.  Repeated rows count each; with fewer
    candidates than ``k`` all are returned, and an empty table gives none.
    """
    source = vectors.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(vector_col)).alias("vector"))
    ranged = source.withColumn("hash", F.xxhash64("vector")).repartitionByRange(F.col("id").asc_nulls_last(), "hash")
    ranged = ranged.sortWithinPartitions(F.col("id").asc_nulls_last(), "hash").select("id", "vector")
    stretches = stored(ranged.mapInArrow(_stretches(scale), _STRETCH_SCHEMA), "stretches")

    # Stretches are numbered 0, 1, ... by (dim, part, nth), over one count for each part and length.
    counts = sorted((r["dim"], r["part"], r["n"]) for r in stretches.groupBy("dim", "part").agg(
        F.count(F.lit(1)).alias("n")).collect())
    spark, first, at = vectors.sparkSession, [], 0
    spans: dict[int, list[int]] = {}
    for dim, part, n in counts:
        first.append((dim, part, at, 0))
        spans.setdefault(dim, [at, at])[1] = at + n
        at += n
    numbers = spark.createDataFrame([(d, p, a, *spans[d]) for d, p, a, _ in first],
                                    "dim int, part int, base long, lo long, hi long")
    numbered = stretches.join(F.broadcast(numbers), ["dim", "part"]).withColumn("stretch", F.col("base") + F.col("nth"))
    homes = stored(numbered.mapInArrow(_at_home(every, k), _HOME_SCHEMA), "top-k-queries")
    found = homes.select("block", F.explode(F.arrays_zip("place", "query_id", "vec_id", "score")).alias("f")).select("block", "f.*")
    away = (numbered.select("stretch", "dim", "n", "ids", "anonymous", "matrix").join(_routed(homes, numbered), "stretch")
            .mapInArrow(_meetings(k), "block long, place long, query_id long, vec_id long, score long"))
    rank = F.row_number().over(Window.partitionBy("block", "place").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    return found.union(away).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
