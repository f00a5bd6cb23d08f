"""N-best segmentation of texts by the pieces of a SentencePiece model, and decoding.

The pieces that match a text form a lattice.  Forward Viterbi gives the best
score of every prefix, which is an exact heuristic for an A-star search from
the end of the text backward, so complete segmentations leave the search in
order of their scores.

No piece holds certain pairs of neighbouring characters; a text is cut
between such pairs (all found at once, over arrays) without losing a
segmentation, and the best segmentations of a text are the best sums over its
parts (mostly words and marks).  The forward pass of a part, which a worker
keeps in a bounded cache, gives its best way and how much the second best
costs more.  Only the n-1 parts with the cheapest second
choice can differ from their best in an n-best result, so the backward search
runs for these alone.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import zlib
from array import array
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted

SPACE = "▁"
#: Parts of texts, and parts with all their choices, in a worker's caches.
CACHE, PARTS = 600_000, 40_000

#: A segmentation: cost over the best one, ids as little-endian 32-bit integers.
Choice = tuple[float, bytes]
#: A part of a text: best score, ids of the best way, cost of the second best over it (inf if there is none), its characters.
Part = tuple[float, bytes, float, str]
_NEVER = float("inf")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces(dict):
    """Part of a text, its space signs as ``blank`` -> that part."""

    def __init__(self, path: str, n: int):
        import sentencepiece

        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.model, self.n = model, n
        self.trie: dict = {}  # character -> (next characters, score or None, id)
        # Texts of one-byte characters are cut faster; normalised ones hold no plain space, if the model has a sign for it.
        self.blank = SPACE if " " in model.normalize("a b") else " "
        pairs: set[str] = set()
        lowest, self.bytes_at, self.spelt = 0.0, {}, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes_at[int(piece[1:-1], 16)] = i
                self.spelt.append(bytes([int(piece[1:-1], 16)]))
                continue
            plain = not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i))
            self.spelt.append(piece.replace(SPACE, " ").encode() if plain else b"")
            if plain:
                node = self.trie
                for c in piece[:-1]:
                    node = node.setdefault(c, ({}, None, b""))[0]
                below = node.get(piece[-1], ({},))[0]
                node[piece[-1]] = (below, float(model.get_score(i)), array("I", [i]).tobytes())
                lowest = min(lowest, model.get_score(i))
                pairs.update(map("".join, itertools.pairwise(piece.replace(SPACE, self.blank))))
        self.sizes = np.array([len(x) for x in self.spelt])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(self.spelt), np.uint8)
        self.unknown, self.unknown_id = lowest - 10.0, model.unk_id()
        self._choices: dict[str, list[Choice]] = {}
        # Characters that stand in pairs are numbered from 1, all others are 0; a cut is where no piece holds the pair.
        numbers = {c: i for i, c in enumerate(sorted(set("".join(pairs))), 1)}
        self.width = len(numbers) + 1
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in numbers]] = list(numbers.values())
        self.cut = np.ones(self.width * self.width, bool)
        self.cut[[numbers[a] * self.width + numbers[b] for a, b in pairs]] = False

    # ------------------------------------------------------------ one part
    def forward(self, part: str) -> Part:
        """The best way through a part, and what the second best costs more: Viterbi with two scores a place."""
        size = len(part)
        best, second, ids = [-_NEVER] * (size + 1), [-_NEVER] * (size + 1), [b""] * (size + 1)
        best[0], trie, unknown = 0.0, self.trie, self.unknown
        for i in range(size):
            here, other, before, node, alone, k = best[i], second[i], ids[i], trie, True, i
            for c in part[i:] if i else part:
                if c not in node:
                    break
                k += 1
                node, score, piece = node[c]
                if score is not None:
                    if k == i + 1:
                        alone = False
                    total, worse = here + score, other + score
                    old = best[k]
                    if total > old:
                        second[k] = old if old > worse else worse
                        best[k], ids[k] = total, before + piece
                    elif total > second[k]:
                        second[k] = total
            if alone:  # a character that is no piece
                total = here + unknown
                if total > best[i + 1]:
                    second[i + 1] = max(best[i + 1], other + unknown)
                    best[i + 1], ids[i + 1] = total, before + self._fallback(part[i])
                elif total > second[i + 1]:
                    second[i + 1] = total
        return best[size], ids[size], best[size] - second[size], part

    def search(self, part: str) -> tuple[float, list[Choice]]:
        """Best score of a part and its ``n`` best segmentations: forward Viterbi, then A-star backward."""
        size = len(part)
        best = [0.0] + [float("-inf")] * size
        back, ids = [0] * (size + 1), [b""] * (size + 1)  # of the best way to each place
        into: list[list[tuple[int, float, bytes]]] = [[] for _ in best]
        for i, char in enumerate(part):
            node, here, before, alone = self.trie, best[i], ids[i], True
            for k in range(i + 1, size + 1):
                step = node.get(part[k - 1])
                if step is None:
                    break
                node, score, piece = step
                if score is not None:
                    total = here + score
                    into[k].append((i, total, piece))
                    if total > best[k]:
                        best[k], back[k], ids[k] = total, i, before + piece
                    if k == i + 1:
                        alone = False
            if alone:  # a character that is no piece
                total, spelt = here + self.unknown, self._fallback(char)
                into[i + 1].append((i, total, spelt))
                if total > best[i + 1]:
                    best[i + 1], back[i + 1], ids[i + 1] = total, i, before + spelt
        # The heuristic is exact: an open hypothesis ends in one segmentation of just its cost, so no more stay
        # open than are still wanted, and the way on from its place is the best one, already known.
        found: list[Choice] = []
        open_now, turn = [(0.0, 0, size, b"")], 0
        while open_now:
            cost, _, at, tail = open_now.pop(0)
            head = ids[at]
            found.append((cost, head + tail))
            wanted = self.n - len(found)
            worst = open_now[-1][0] if len(open_now) >= wanted and open_now else float("inf")
            while at and wanted:
                last, gap = back[at], cost + best[at]
                for i, total, piece in into[at]:
                    if i != last and gap - total < worst:
                        turn += 1
                        insort(open_now, (gap - total, turn, i, piece + head[len(ids[at]):] + tail))
                        if len(open_now) >= wanted:
                            del open_now[wanted:]
                            worst = open_now[-1][0]
                at = last
        return best[size], found

    def _fallback(self, char: str) -> bytes:
        data = char.encode("utf-8", "replace")
        return array("I", [self.bytes_at[b] for b in data] if len(self.bytes_at) == 256 else [self.unknown_id]).tobytes()

    def __missing__(self, part: str) -> Part:
        score, ids, gap, _ = self.forward(part.replace(self.blank, SPACE))
        got = score, ids, gap, part
        if len(self) < CACHE and len(part) <= 40:
            self[part] = got
        return got

    def choices(self, part: str) -> list[Choice]:
        """The ``n`` best ways through a part."""
        got = self._choices.get(part)
        if got is None:
            got = self.search(part.replace(self.blank, SPACE))[1]
            if len(self._choices) < PARTS and len(part) <= 40:
                self._choices[part] = got
        return got

    def parts(self, text: str) -> list[Part]:
        """The parts of a text, its space signs as ``blank``, cut where no piece can cross."""
        if not text:
            return []
        at = self.number.take(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"))
        cuts = np.flatnonzero(self.cut.take(at[:-1] * self.width + at[1:])) + 1
        return [self[text[a:b]] for a, b in itertools.pairwise([0, *cuts.tolist(), len(text)])]

    # ----------------------------------------------------------- one text
    def encode(self, text: str) -> list[tuple[float, int, bytes]]:
        """(score, number of ids, ids) of the n best segmentations, best first; the empty text has one without ids."""
        parts = self.parts(self.model.normalize(text).replace(SPACE, self.blank) if text else "")
        score = sum([p[0] for p in parts])
        ids = [p[1] for p in parts]
        gaps = [p[2] for p in parts]
        open_parts = [i for gap, i in heapq.nsmallest(self.n - 1, zip(gaps, range(len(parts)))) if gap < _NEVER]
        choices = {i: self.choices(parts[i][3]) for i in sorted(open_parts)}
        ways: list[tuple[float, tuple]] = [(0.0, ())]
        for i, more in choices.items():
            ways = heapq.nsmallest(self.n, [(cost + c[0], (*changes, (i, k)) if k else changes)
                                            for cost, changes in ways for k, c in enumerate(more)])
        out = []
        for cost, changes in ways:
            own = ids[:] if changes else ids
            for i, k in changes:
                own[i] = choices[i][k][1]
            joined = b"".join(own)
            out.append((score - cost, len(joined) // 4, joined))
        return out

    def decode(self, ids: bytes) -> str:
        """Text of little-endian 32-bit ids: pieces and bytes joined, without the space that the model puts in front."""
        at = np.frombuffer(ids, "<u4")
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        # For every byte of the text, its place in the spellings of all pieces.
        place = np.arange(ends[-1] if len(at) else 0) + np.repeat(self.starts[at] - (ends - sizes), sizes)
        return self.letters[place].tobytes().decode("utf-8", "replace").removeprefix(" ")


@functools.lru_cache(maxsize=2)
def pieces(path: str, n: int) -> Pieces:
    """The worker's model; workers are reused, so its caches last over many tasks."""
    return Pieces(path, n)


def encode_n_best(docs: DataFrame, n: int = 4, id_col: str = "doc_id", text_col: str = "text",
                  model: str | None = None) -> DataFrame:
    """Rows (id, rank, score, n_pieces, ids, text_crc32): the ``n`` best segmentations of every whole text, fewer if there are no more.

    ``score`` is the sum of piece scores (unknown characters: the lowest score
    less 10, then spelt in byte pieces); among equal scores the order is that
    of the search.  ids are little-endian 32-bit integers, text_crc32 the
    checksum of the text that they decode to.  Null counts as
    empty and has one segmentation without ids; repeated rows and null ids are
    encoded like any other; an empty table gives an empty result.
    """
    path = model or default_model()
    source = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    out = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("rank", T.IntegerType()),
                        T.StructField("score", T.DoubleType()), T.StructField("n_pieces", T.LongType()),
                        T.StructField("ids", T.BinaryType()), T.StructField("text_crc32", T.LongType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in out]
        for batch in batches:
            rows, held = [], 0
            for i, text in enumerate(batch["text"]):
                for rank, (score, count, ids) in enumerate(pieces(path, n).encode(text.as_py() or ""), 1):
                    rows.append((i, rank, score, count, ids, zlib.crc32(pieces(path, n).decode(ids).encode("utf-8", "replace"))))
                    held += len(ids)
                if held > 8 << 20 or i + 1 == len(batch):
                    at, ranks, scores, counts, ids, sums = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [batch["id"].take(pa.array(at)), pa.array(ranks, pa.int32()), pa.array(scores, pa.float64()),
                         pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array(sums, pa.int64())], names=names)
                    rows, held = [], 0

    return source.mapInArrow(encode, out)


def decoded(ids: Column, model: str | None = None) -> Column:
    """Text of a column of ids (little-endian 32-bit integers); null stays null."""
    path = model or default_model()

    @F.arrow_udf(T.StringType())
    def texts(column: pa.Array) -> pa.Array:
        decode = pieces(path, 1).decode
        return pa.array([decode(x.as_py()) if x.is_valid else None for x in column], pa.string())

    return texts(ids)
