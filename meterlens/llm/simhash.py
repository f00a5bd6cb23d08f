"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are split into groups of correlated bits, and every group i gets
a threshold t_i of its own with sum(t_i + 1) = max_bits + 1: two fingerprints
within ``max_bits`` then differ in at most t_i bits of some group i.
A dynamic programme picks the thresholds from candidate counts that are
estimated from the bit statistics of all fingerprints.  A group with
threshold t is probed by its key with every choice of t bits masked out, so
that probing is an ordinary grouping; pairs that share a key are verified on
all 64 bits.

Equal fingerprints are folded before the search.  Keys with many
fingerprints are cut into blocks, and each pair of blocks becomes a cell of
bounded size; a cell returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_row, checkpointed, field, quoted, stored
from .components import connected_components

BITS = 64
#: Fingerprints in a block of a hot key; a cell holds two blocks.
BLOCK = 1024
#: Rough costs in microseconds: shuffling and sorting a key, verifying a candidate.
KEY_COST, PAIR_COST = 1.5, 0.02

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_CHUNK = 100_000


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the ``width``-word shingles of a whole text, repeats included, as a signed 64-bit integer.

    A-Z are lower-cased, words are runs without white space; fewer words than
    ``width`` form one shingle; no words (null, empty, blank) give zero.
    """
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    spans = zip(starts[:n], [e - 1 for e in ends[min(width, len(words)) - 1:]])
    ones = np.zeros(BITS, np.int64)
    for _ in range(0, n, _CHUNK):
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in itertools.islice(spans, _CHUNK)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", width: int = 3) -> DataFrame:
    """Rows (row, fp): all input columns as a struct, and the fingerprint."""
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return as_row(docs).withColumn("fp", of(field("row", text_col)))


# ---------------------------------------------------------------- planning

def _bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bits set together, over all rows."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((BITS, BITS)), 0
        for part in batches:
            bits = np.unpackbits(part["fp"].to_numpy("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            bits = bits.astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        if n:
            yield pd.DataFrame({"at": np.arange(BITS * BITS + 1), "n": np.append(total.ravel(), n).astype("int64")})

    got = fps.mapInPandas(partial, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # 4,097 rows
    flat = np.zeros(BITS * BITS + 1)
    for r in got:
        flat[r["at"]] = r["n"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def _agreement(n: int, together: np.ndarray) -> np.ndarray:
    """P(two random fingerprints agree on bit i and on bit j); the diagonal holds single bits."""
    both = together / max(n, 1)
    p = np.diag(both)
    only_i, only_j = p[:, None] - both, p[None, :] - both
    none = 1 - both - only_i - only_j
    agree = both**2 + only_i**2 + only_j**2 + none**2
    np.fill_diagonal(agree, p**2 + (1 - p)**2)
    return agree


def bit_groups(agree: np.ndarray, m: int) -> list[list[int]]:
    """``m`` groups of nearly equal size; each grows by the bit that agrees most with its last ones."""
    single = np.diag(agree)
    excess = agree - np.outer(single, single)
    np.fill_diagonal(excess, -1)
    free, groups = set(range(BITS)), []
    for g in range(m):
        size = BITS // m + (g < BITS % m)
        rest = sorted(free)
        group = [rest[int(np.argmax(excess[np.ix_(rest, rest)].max(axis=1)))]] if len(rest) > 1 else rest
        while len(group) < size:
            rest = sorted(free - set(group))
            group.append(rest[int(np.argmax(excess[np.ix_(group, rest)].sum(axis=0)))])
        groups.append(group)
        free -= set(group)
    return groups


def _distances(agree: np.ndarray, group: list[int], most: int) -> np.ndarray:
    """P(a random pair differs in d bits of the group), d = 0..most: a chain where each bit depends on the one before."""
    def step(i: int, j: int) -> tuple[float, float]:
        a, b, ab = agree[i, i], agree[j, j], agree[i, j]
        return ab / max(a, 1e-12), (b - ab) / max(1 - a, 1e-12)

    same, diff = np.zeros(most + 2), np.zeros(most + 2)
    same[0], diff[1] = agree[group[0], group[0]], 1 - agree[group[0], group[0]]
    for i, j in itertools.pairwise(group):
        after_same, after_diff = (min(1.0, max(0.0, x)) for x in step(i, j))
        moved = same * (1 - after_same) + diff * (1 - after_diff)
        same, diff = same * after_same + diff * after_diff, np.append(0, moved[:-1])
    return (same + diff)[: most + 1]


def plan_search(n: int, together: np.ndarray, max_bits: int) -> list[tuple[list[int], int]]:
    """Groups of bits with their thresholds, of least estimated cost.

    Every number of groups up to max_bits + 1 is tried; for each, a dynamic
    programme over the groups spends max_bits + 1 units, t + 1 of them for a
    threshold t (none: the group is not probed).
    """
    agree, best = _agreement(n, together), (math.inf, [])
    for m in range(1, max_bits + 2):
        groups = bit_groups(agree, m)
        costs = []
        for group in groups:
            near = _distances(agree, group, max_bits) * n * n / 2
            row = [0.0]
            for t in range(max_bits + 1):
                met = sum(near[d] * math.comb(len(group) - d, t - d) for d in range(t + 1) if t <= len(group))
                row.append(max(n, 1) * math.comb(len(group), t) * KEY_COST + met * PAIR_COST)
            costs.append(row)
        table: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for row in costs:
            table = {total: min((table[used][0] + row[total - used], (*table[used][1], total - used - 1))
                                for used in table if 0 <= total - used < len(row))
                     for total in range(max_bits + 2) if any(0 <= total - used < len(row) for used in table)}
        cost, thresholds = table[max_bits + 1]
        best = min(best, (cost, [(g, t) for g, t in zip(groups, thresholds) if t >= 0]), key=lambda x: x[0])
    return best[1]


# ------------------------------------------------------------ probe, verify

def _masks(plan: list[tuple[list[int], int]]) -> list[int]:
    """For every key of a fingerprint, the bits it compares, as a signed 64-bit mask."""
    found = []
    for group, t in plan:
        for out in itertools.combinations(group, t):
            mask = sum(1 << b for b in group if b not in out)
            found.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return found


def forest(cell: np.ndarray, fp: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Spanning forest of the links inside each cell; rows must be sorted by cell.

    Rows at distance d = 1, 2, ... inside a cell are compared at once.
    """
    parent = np.arange(len(fp))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges, at, d = [], np.arange(len(fp)), 0
    while True:
        d += 1
        at = at[at + d < len(fp)]
        at = at[cell[at] == cell[at + d]]
        if not len(at):
            return edges
        to = at[(parent[at] != parent[at + d])]
        # Unsigned, as numpy counts the bits of a signed number's absolute value.
        to = to[np.bitwise_count((fp[to] ^ fp[to + d]).view(np.uint64)) <= max_bits]
        for i in to:
            a, b = root(i), root(i + d)
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((int(fp[i]), int(fp[i + d])))
        if len(to):
            while not np.array_equal(up := parent[parent], parent):
                parent[:] = up


def fingerprint_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b) that connect every two fingerprints within ``max_bits`` bits, directly or over others.

    ``fps``: distinct fingerprints, column fp, materialised.
    """
    n, together = _bit_counts(fps)
    masks = _masks(plan_search(n, together, max_bits))
    # xxhash64 of (mask number, masked bits) names the key; should two keys share a hash, verification sorts it out.
    probe = F.explode(F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(mask).cast("long")))
                                for k, mask in enumerate(masks)])).alias("key")
    keys = fps.select("fp", probe)
    sizes = checkpointed(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK)
                         .select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    hot = F.broadcast(sizes) if sizes.count() <= 1_000_000 else sizes
    i, j = F.col("block"), F.col("other")
    cells = (keys.join(hot, "key", "left").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.when(i.isNull(), F.array(F.lit(0))).otherwise(
                 F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != i))))
             .select("fp", F.when(i.isNull(), F.col("key")).otherwise(
                 F.xxhash64("key", F.least(i, j), F.greatest(i, j))).alias("cell")))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, fp = np.empty(0, "i8"), np.empty(0, "i8")
        for part in itertools.chain(batches, [None]):
            if part is not None:
                cell, fp = np.append(cell, part["cell"].to_numpy()), np.append(fp, part["fp"].to_numpy())
            whole = len(cell) if part is None else int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
            if whole:  # the last cell may go on in the next batch
                yield pd.DataFrame(forest(cell[:whole], fp[:whole], max_bits), columns=["a", "b"], dtype="int64")
                cell, fp = cell[whole:], fp[whole:]

    return cells.repartition("cell").sortWithinPartitions("cell").mapInPandas(verify, "a long, b long")


def fingerprint_components(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """Rows (fp, root) for every distinct fingerprint that has a link."""
    links = stored(fingerprint_links(fps, max_bits).distinct(), "simhash-links")
    return connected_components(links).select(F.col("node").alias("fp"), F.col("component").alias("root"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                  max_bits: int = 3) -> DataFrame:
    """One row per input row: id, fp (signed long), component_id.

    Rows link when their fingerprints differ in at most ``max_bits`` bits;
    component_id is the smallest id reachable (nulls are skipped; null when
    all ids of a component are null).  Null, empty and blank texts have
    fingerprint zero and link like any other.  Rows that repeat an id are
    fingerprinted and linked each on its own.  An empty table gives an empty result.
    """
    rows = stored(with_fingerprint(docs.select(quoted(id_col), quoted(text_col)), text_col, width)
                  .select(field("row", id_col).alias("id"), "fp"), "simhash-rows")
    return rows.join(_representatives(rows, max_bits), "fp").select("id", "fp", F.col("first.id").alias("component_id"))


def _representatives(rows: DataFrame, max_bits: int) -> DataFrame:
    """(fp, first): per distinct fingerprint the smallest of its component's rows, ids before nulls."""
    rank = [F.col("id").isNull().alias("none"), *[F.col(c) for c in rows.columns if c != "fp"]]
    folded = stored(rows.groupBy("fp").agg(F.min(F.struct(*rank)).alias("first")), "simhash-distinct")
    roots = fingerprint_components(folded.select("fp"), max_bits)
    joined = folded.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("first").alias("least"))
    return stored(joined.join(least, "root").select("fp", F.col("least").alias("first")), "simhash-map")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                     max_bits: int = 3) -> DataFrame:
    """The input rows, columns unchanged, that stay when one of each component is kept.

    The row with the smallest id stays (ids before nulls; among rows of one
    id the smallest text hash; of rows with equal id and text one stays).
    """
    keyed = with_fingerprint(docs, text_col, width).select("row", "fp", field("row", id_col).alias("id"),
                                                           F.xxhash64(field("row", text_col)).alias("hash"))
    rows = stored(keyed.select("id", "hash", "fp"), "simhash-rows")
    winners = (_representatives(rows, max_bits).select("first.id", "first.hash").distinct()
               .select(F.col("id").alias("w"), F.col("hash").alias("wh")))
    own = as_row(docs).select("row", field("row", id_col).alias("id"), F.xxhash64(field("row", text_col)).alias("hash"))
    kept = own.join(winners, F.col("id").eqNullSafe(F.col("w")) & (F.col("hash") == F.col("wh")), "left_semi")
    return kept.dropDuplicates(["id", "hash"]).select("row.*")
