"""Duplicate passages: paragraph MinHash banding, and verbatim passages inside paragraphs.

Paragraphs are lines.  Their 5-word shingles are min-hashed, bands are tuned
for high recall at the threshold, paragraphs that share a band are compared
by exact Jaccard similarity, and connected components of the links form the
clusters.  Band buckets that grow large are cut into blocks whose pairs are
compared in cells of bounded size; a cell returns a spanning forest.

A passage that stands inside longer paragraphs changes their similarity too
little to be found that way.  Windows of 25 words are therefore taken at
winnowed places, which depend on the words alone: two documents that share
50 words in a row share a window.  Around the windows that occur in several
documents, every window is taken and compared in turn, so that those which
occur in several documents cover a shared run to its ends; they are merged
into spans.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.prefilter import keep_hashes
from .common import discard, quoted, stored
from .components import connected_components

SHINGLE, SIMILARITY = 5, 0.8
#: Words of the shortest paragraphs compared by default: one shingle.
MIN_WORDS = SHINGLE
#: Words in a window, and places among which at least one window is taken: WINDOW + PLACES - 1 = 50.
WINDOW, PLACES = 25, 26
#: Paragraphs in a block of a large band bucket.
BLOCK = 128

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_FACTOR = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


_LOWER_CODE = np.arange(256, dtype=np.uint64) + 1
_LOWER_CODE[65:91] = _LOWER_CODE[97:123]
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _need_powers(n: int) -> None:
    if len(_powers[0]) <= n:
        for k, base in enumerate((_FACTOR, _INVERSE)):
            _powers[k] = np.multiply.accumulate(np.append(np.ones(1, np.uint64), np.full(2 * n, base, np.uint64)))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a UTF-8 text, A-Z lower-cased, with the byte where each begins and ends."""
    raw = np.frombuffer(data, np.uint8)
    space = np.ones(len(raw) + 2, bool)
    space[1:-1] = _IS_SPACE[raw]
    turns = np.flatnonzero(space[1:] != space[:-1])
    begins, ends = turns[::2], turns[1::2]
    _need_powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LOWER_CODE[raw] * _powers[0][:len(raw)], out=sums[1:])
    return _mixed((sums[ends] - sums[begins]) * _powers[1][begins]), begins, ends


def gram_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, in order, from the hashes of the words."""
    n = len(words)
    if n < width:
        return np.empty(0, np.uint64)
    _need_powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * _powers[0][:n], out=sums[1:])
    return _mixed((sums[width:] - sums[:-width]) * _powers[1][: n - width + 1])


def _large(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus: sort-merged (and split where skewed) at every size, never broadcast."""
    return df.hint("merge")


# ------------------------------------------------------- paragraph clusters

def tune_bands(similarity: float, recall: float = 0.999, most: int = 10) -> tuple[int, int]:
    """Bands and rows per band: the most selective rows that reach ``recall`` at ``similarity`` with at most ``most`` bands."""
    best = (1, 1)
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands > most:
            break
        best = (bands, rows)
    return best


@functools.lru_cache(maxsize=8)
def _permutations(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    factors = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return factors, rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64), np.arange(bands, dtype=np.uint64) * np.uint64(_FACTOR)


def band_keys(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Keys of the bands of a MinHash signature over shingle hashes (at least one)."""
    factors, offsets, keys = _permutations(bands, rows)
    least = (shingles[:4096, None] * factors + offsets).min(axis=0)
    for s in range(4096, len(shingles), 4096):
        least = np.minimum(least, (shingles[s:s + 4096, None] * factors + offsets).min(axis=0))
    for r in range(rows):
        keys = _mixed(keys * np.uint64(_FACTOR) + least[r::rows])
    return keys.view(np.int64)


def band_keys_of(lines: list[bytes], bands: int, rows: int) -> np.ndarray:
    """``band_keys`` of several lines of at least a shingle, words a space apart: one row of keys a line."""
    factors, offsets, keys = _permutations(bands, rows)
    counts = np.array([line.count(b" ") + 1 for line in lines])
    inside = np.ones(counts.sum(), bool)  # shingles that begin in the last words of a line reach into the next
    for back in range(1, SHINGLE):
        inside[np.cumsum(counts) - back] = False
    grams = gram_hashes(word_hashes(b"\n".join(lines))[0], SHINGLE)[inside[:1 - SHINGLE]]
    firsts = np.cumsum(counts - SHINGLE + 1) - (counts - SHINGLE + 1)
    least = np.minimum.reduceat(grams[:, None] * factors + offsets, firsts, axis=0)
    for r in range(rows):
        keys = _mixed(keys * np.uint64(_FACTOR) + least[:, r::rows])
    return keys.view(np.int64)


def _shingles(words: list[bytes]) -> set:
    return set(zip(*(words[k:] for k in range(SHINGLE)))) if len(words) >= SHINGLE else {tuple(words)}


def similar_forest(texts: list[bytes], similarity: float) -> list[tuple[int, int]]:
    """Spanning forest of the pairs whose 5-word shingle sets have at least this Jaccard similarity."""
    sets, root, links = [_shingles(t.split()) for t in texts], list(range(len(texts))), []
    for i in range(1, len(texts)):
        for j in range(i - 1, -1, -1):
            small, large = sorted((len(sets[i]), len(sets[j])))
            if root[i] != root[j] and small >= similarity * large:
                common = len(sets[i] & sets[j])
                if common >= similarity * (small + large - common):
                    links.append((i, j))
                    old, new = root[i], root[j]
                    root = [new if r == old else r for r in root]
    return links


def _lines(text: str, least: int) -> Iterator[tuple[int, str, bytes]]:
    """Start, text and normal form (lower case, single spaces) of each line with at least so many words."""
    start = 0
    for line, lower in zip(text.split("\n"), text.encode("utf-8", "replace").translate(_LOWER).split(b"\n")):
        words = lower.split()
        if len(words) >= least:
            yield start, line, b" ".join(words)
        start += len(line) + 1


def _paragraph_table(source: DataFrame, bands: int, rows: int, least: int) -> DataFrame:
    """(id, start, length, h, keys): every paragraph; band keys once per task and text, none below a shingle."""
    out = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("start", T.IntegerType()),
                        T.StructField("length", T.IntegerType()), T.StructField("h", T.BinaryType()),
                        T.StructField("keys", T.ArrayType(T.LongType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known = [f.name for f in out], set()
        for batch in batches:
            found, new, held = [], [], 0  # new: lines whose keys are still to be made, and their places in found

            def make_keys() -> None:
                for (at, _), keys in zip(new, band_keys_of([n for _, n in new], bands, rows) if new else ()):
                    found[at][4] = keys
                new.clear()

            for i, text in enumerate(batch["text"]):
                for start, line, normal in _lines(text.as_py() or "", least):
                    h, words = xxhash.xxh3_128_digest(normal), normal.count(b" ") + 1
                    found.append([i, start, len(line), h, None])
                    if words >= SHINGLE and h not in known:
                        if len(known) >= 200_000:
                            known.clear()
                        known.add(h)
                        if words > 4096:
                            found[-1][4] = band_keys(gram_hashes(word_hashes(normal)[0], SHINGLE), bands, rows)
                            continue
                        new.append((len(found) - 1, normal))
                        held += words
                        if held > 4096:
                            make_keys()
                            held = 0
                if len(found) > 20_000 or found and i + 1 == len(batch):
                    make_keys()
                    held = 0
                    at, starts, lengths, hs, keys = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [batch["id"].take(pa.array(at)), pa.array(starts, pa.int32()), pa.array(lengths, pa.int32()),
                         pa.array(hs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=names)
                    found = []

    return source.select("id", "text").mapInArrow(cut, out)


def _verified(cells: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between the texts of each cell; ``cells``: cell, h, normal."""
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(batch["cell"].to_pylist(), batch["h"].to_pylist(), batch["normal"].to_pylist())

        for _, group in itertools.groupby(rows(), key=lambda r: r[0]):  # at most two blocks a cell
            members = {h: normal for _, h, normal in group}
            hs = list(members)
            links = similar_forest(list(members.values()), similarity)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([hs[i] for i, _ in links], pa.binary()),
                                                  pa.array([hs[j] for _, j in links], pa.binary())], names=["a", "b"])

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(verify, "a binary, b binary")


def _normal_forms(source: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """(h, normal) for the paragraphs of ``wanted`` (h, id): their texts, read from their documents."""
    ids = wanted.select("id").distinct().withColumnRenamed("id", "k")
    held = source.join(_large(ids), F.col("id").eqNullSafe(F.col("k")), "left_semi").select("text")

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(xxhash.xxh3_128_digest(n), n) for t in batch["text"] for _, _, n in _lines(t.as_py() or "", least)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()),
                                              pa.array([f[1] for f in found], pa.binary())], names=["h", "normal"])

    texts = held.mapInArrow(forms, "h binary, normal binary")
    return texts.join(_large(wanted.select(F.col("h").alias("w"))), F.col("h") == F.col("w"), "left_semi").dropDuplicates(["h"])


def similar_paragraphs(source: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, start, length, cluster_id, cluster_size, kept) for paragraphs with a duplicate; ``source``: id, text.

    Paragraphs of at least ``min_words`` words; those below a shingle have duplicates only where they are equal.
    """
    bands, rows = tune_bands(similarity)
    keyed = stored(_paragraph_table(source, bands, rows, max(1, min_words)), "paragraphs-keys")
    bucket = Window.partitionBy("key")
    keys = (keyed.filter("keys IS NOT NULL").select("h", F.explode("keys").alias("key")).repartition("key")
            .dropDuplicates(["key", "h"]).withColumn("n", F.count(F.lit(1)).over(bucket))
            .withColumn("members", F.bit_xor(F.xxhash64("h")).over(bucket)).filter("n > 1"))
    # Similar paragraphs meet in many bands: buckets are named by their paragraphs, so that equal ones are compared once.
    # Buckets that share a name by chance are compared together.
    keys = keys.withColumn("key", F.xxhash64("n", "members"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine, other = F.col("block"), F.col("other")
    cells = (keys.withColumn("block", F.pmod(F.xxhash64("h"), blocks).cast("int"))
             .withColumn("other", F.explode(F.when(blocks == 1, F.array(F.lit(0))).otherwise(
                 F.filter(F.sequence(F.lit(0), blocks - 1), lambda x: x != mine))))
             .select("h", F.xxhash64("key", F.least(mine, other), F.greatest(mine, other)).alias("cell")))
    cells = stored(cells, "paragraph-cells")
    table = stored(keyed.drop("keys"), "paragraphs")
    discard(keyed)

    per_text = table.groupBy("h").agg(F.count(F.lit(1)).alias("n"),
                                      F.min(F.struct(F.col("id").isNull().alias("none"), "id", "start")).alias("first"))
    per_text = stored(per_text, "paragraph-texts")
    met = cells.select("h").distinct()
    wanted = stored(per_text.join(_large(met), "h").select("h", F.col("first.id").alias("id")), "paragraph-wanted")
    forms = stored(_normal_forms(source, wanted, SHINGLE), "paragraph-forms")
    discard(wanted)
    met_once = cells.repartition("h").dropDuplicates(["h", "cell"])
    links = stored(_verified(met_once.join(_large(forms), "h"), similarity).distinct(), "paragraph-links")
    discard(cells, forms)
    roots = connected_components(links).select(F.col("node").alias("h"), F.col("component").alias("root"))

    joined = per_text.join(_large(roots), "h", "left").withColumn("root", F.coalesce("root", "h"))
    clusters = (joined.groupBy("root").agg(F.sum("n").alias("cluster_size"), F.min("first").alias("head"))
                .filter("cluster_size > 1"))
    named = stored(joined.join(_large(clusters), "root").select(F.col("h").alias("k"), "cluster_size", "head",
                                                        F.lower(F.hex("root")).alias("cluster_id")), "paragraph-clusters")
    discard(per_text, links)
    return (table.select("id", "start", "length", "h").join(_large(named), F.col("h") == F.col("k"))
            .select("id", "start", "length", "cluster_id", "cluster_size",
                    (F.col("id").eqNullSafe(F.col("head.id")) & (F.col("start") == F.col("head.start"))).alias("kept")))


# --------------------------------------------------------- verbatim passages

def _slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of every ``width`` neighbours, by doubling."""
    pick, have = np.minimum if least else np.maximum, 1
    while 2 * have <= width:
        x, have = pick(x[:-have], x[have:]), 2 * have
    rest = width - have
    return pick(x[:-rest], x[rest:]) if rest else x


def window_places(grams: np.ndarray, places: int = PLACES) -> np.ndarray:
    """Winnowed places: those with the smallest hash among some ``places`` neighbours.

    In a periodic run, where equal hashes follow one another, the first stands for all.
    """
    if len(grams) <= places:
        at = np.flatnonzero(grams == grams.min())[:1] if len(grams) else np.empty(0, int)
    else:
        padded = np.zeros(len(grams) + places - 1, np.uint64)
        padded[places - 1:len(grams)] = _slide(grams, places, least=True)
        at = np.flatnonzero(_slide(padded, places, least=False) == grams)
    return at[np.append(True, (grams[at[1:]] != grams[at[:-1]]) | (np.diff(at) >= WINDOW))] if len(at) else at


def _windows(texts: DataFrame, near: bool = False, spans: bool = False) -> DataFrame:
    """(id, doc, key, and with ``spans`` start, stop): windows, with their characters; ``texts``: id, doc, text and, if ``near``, keys.

    Winnowed windows, or all that begin at most ``PLACES`` - 1 words from one of ``keys``.
    """
    out = T.StructType([T.StructField("id", texts.schema["id"].dataType), T.StructField("doc", T.LongType()),
                        T.StructField("key", T.LongType()),
                        *[T.StructField(c, T.IntegerType()) for c in ("start", "stop") if spans]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, starts, stops, keys, held = [], [], [], [], 0
            for i, text in enumerate(batch["text"]):
                data = (text.as_py() or "").encode("utf-8", "replace")
                words, begins, ends = word_hashes(data)
                grams = gram_hashes(words, WINDOW)
                if len(grams):
                    chosen = near_places(grams, batch["keys"][i].values.to_numpy().view(np.uint64)) if near else window_places(grams)
                    at.append(np.full(len(chosen), i))
                    if spans:
                        chars = np.zeros(len(data) + 1, np.int64)  # characters before each byte
                        np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80, out=chars[1:])
                        starts.append(chars[begins[chosen]].astype("int32"))
                        stops.append(chars[ends[chosen + WINDOW - 1]].astype("int32"))
                    keys.append(grams[chosen].view(np.int64))
                    held += len(chosen)
                if held > 100_000 or held and i + 1 == len(batch):
                    rows = pa.array(np.concatenate(at))
                    yield pa.RecordBatch.from_arrays(
                        [batch["id"].take(rows), batch["doc"].take(rows), pa.array(np.concatenate(keys)),
                         *[pa.array(np.concatenate(x)) for x in (starts, stops) if spans]], names=[f.name for f in out])
                    at, starts, stops, keys, held = [], [], [], [], 0

    return texts.mapInArrow(cut, out)


def near_places(grams: np.ndarray, keys: np.ndarray, reach: int = PLACES - 1) -> np.ndarray:
    """Places at most ``reach`` from one whose hash is among ``keys``."""
    before = np.append(0, np.cumsum(np.isin(grams, keys)))
    at = np.arange(len(grams))
    return np.flatnonzero(before[np.minimum(at + reach + 1, len(grams))] > before[np.maximum(at - reach, 0)])


def _shared(windows: DataFrame) -> DataFrame:
    """(key, first_id): keys of ``windows`` that stand in several documents, with the smallest id that has them."""
    # Documents are told apart by id; all rows with a null id count as one.
    return (windows.groupBy("key").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"),
                                       F.max(F.col("id").isNull()).alias("none"), F.max(F.col("id").isNotNull()).alias("some"))
            .filter("first_id <> last_id OR (none AND some)").select("key", "first_id"))


def _hits(windows: DataFrame, shared: DataFrame) -> DataFrame:
    """``windows`` whose key is ``shared``, with first_id; the others are dropped where they are read."""
    return keep_hashes(windows, shared.select("key"), "key").join(_large(shared), "key")


def _spans(hits: DataFrame) -> DataFrame:
    """(id, start, stop, first_id, n_windows, kept): runs of neighbouring windows with one first document.

    A run belongs to the document that is first for its windows, and is kept
    there.  Elsewhere it ends where windows begin that the document itself is
    first for, so that removing all runs that are not kept leaves every
    window whole in its first document.
    """
    # Windows of one text end in the order in which they begin, so neighbours tell where runs begin and end, and
    # what follows has only the first and the last window of every run.
    order = Window.partitionBy("id", "doc").orderBy("start", "stop")
    begins = (F.coalesce(F.col("start") > F.lag("stop").over(order) + 1, F.lit(True))
              | ~F.lag("first_id").over(order).eqNullSafe(F.col("first_id")))
    ends = (F.coalesce(F.lead("start").over(order) > F.col("stop") + 1, F.lit(True))
            | ~F.lead("first_id").over(order).eqNullSafe(F.col("first_id")))
    limits = (hits.select("id", "doc", "start", "stop", "first_id", begins.alias("begins"), ends.alias("ends"),
                          F.row_number().over(order).alias("place")).filter("begins OR ends"))
    n_windows = (F.max("place") - F.min("place") + 1).cast("long")
    runs = (limits.withColumn("run", F.sum(F.col("begins").cast("int")).over(Window.partitionBy("id", "doc").orderBy("place")))
            .groupBy("id", "doc", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"),
                                             F.first("first_id").alias("first_id"), n_windows.alias("n_windows"))
            .withColumn("kept", F.col("id").eqNullSafe(F.col("first_id"))))
    by_run = Window.partitionBy("id", "doc").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    from_end = Window.partitionBy("id", "doc").orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    own_before = F.max(F.when(F.col("kept"), F.col("stop"))).over(by_run)
    own_after = F.min(F.when(F.col("kept"), F.col("start"))).over(from_end)
    trimmed = runs.withColumn("a", F.when(F.col("kept"), F.col("start")).otherwise(F.greatest("start", own_before)))
    trimmed = trimmed.withColumn("b", F.when(F.col("kept"), F.col("stop")).otherwise(F.least("stop", own_after)))
    return trimmed.filter("a < b").select("id", F.col("a").alias("start"), F.col("b").alias("stop"), "first_id", "n_windows", "kept")


def shared_passages(source: DataFrame) -> DataFrame:
    """(id, start, length, first_id, n_windows, kept) for spans whose windows occur in several documents.

    A run of at least 50 words that two documents share is covered whole in
    both.  Shorter ones, of 25 words and more, may be found or not.  Each
    window that occurs in several documents stays whole in the one with the
    smallest id when all spans that are not kept are removed.
    """
    texts = source.select("id", F.xxhash64("text").alias("doc"), "text")
    winnowed = stored(_windows(texts), "windows")
    keys = stored(_hits(winnowed, _shared(winnowed)).groupBy("doc").agg(F.collect_set("key").alias("keys")), "window-keys")
    discard(winnowed)
    held = (keep_hashes(texts, keys.select("doc"), "doc")
            .join(_large(keys.withColumnRenamed("doc", "d")), F.col("doc") == F.col("d")).select("id", "doc", "text", "keys"))
    # Many windows, cheap to make: made twice, never stored, and with their spans only where they are shared.
    shared = stored(_shared(_windows(held, near=True)), "shared-windows")
    spans = _spans(_hits(_windows(held, near=True, spans=True), shared))
    return spans.select("id", "start", (F.col("stop") - F.col("start")).alias("length"), "first_id", "n_windows", "kept")


def duplicate_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (id, kind, start, length, cluster_id, occurrences, kept) for every duplicate span of characters.

    kind "paragraph": a line of at least ``min_words`` words (5 unless set; lines
    of fewer than 5 are compared for equality); cluster_id names its component, occurrences counts the paragraphs in it, and the one with the
    smallest id and start is kept; which clusters to remove (licence lines,
    greetings) is the caller's choice.  kind "passage": words in a row that also
    stand in another document, runs of at least 50 to both their ends;
    cluster_id is the smallest id that has them
    (kept there), occurrences the windows found; where a document is itself the
    first for a part of a run, that part is a kept span of its own.  Lower case A-Z; null counts
    as empty; documents are told apart by id, all null ids being one; repeated
    rows are compared like others; tables without duplicates or rows give an
    empty result.
    """
    source = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    paragraphs = similar_paragraphs(source, min_words=min_words).select(
        "id", F.lit("paragraph").alias("kind"), "start", "length", "cluster_id", F.col("cluster_size").alias("occurrences"), "kept")
    passages = shared_passages(source).select(
        "id", F.lit("passage").alias("kind"), "start", "length", F.col("first_id").cast("string").alias("cluster_id"),
        F.col("n_windows").alias("occurrences"), "kept")
    return paragraphs.union(passages)
