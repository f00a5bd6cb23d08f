"""Cost-balanced packing of token documents into sequences of bounded length.

The cost of a piece of n tokens is estimated as ``linear * n + quadratic * n**2``
(attention stays inside a piece).  Documents in descending order of length go
to the lowest-cost sequence that still has room for them.  Documents longer
than a sequence are first cut into full pieces and a rest.

Packing happens in groups of bounded size, dealt by a hash of id and ids, so
that no task sees more than a group.  The sequences of a group have together
exactly as much room as the group has tokens: full ones, and the remainder
as sequences of power-of-two lengths, which need no padding.  What fits
nowhere whole is cut into the room that is left.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted
from .tokens import default_vocabulary, encoder

#: Bytes of text in a packing group, about a third as many tokens.
GROUP_BYTES = 8 << 20


def room_for(total: int, capacity: int) -> list[int]:
    """Lengths of the sequences for ``total`` tokens: full ones, then the powers of two of the remainder."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def assign(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1 / 1024) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) for documents of 1 to ``capacity`` tokens, in descending order.

    Every sequence is filled exactly; ties go to the sequence opened first.
    """
    room = room_for(sum(lengths), capacity)
    free, cost = room[:], [0.0] * len(room)
    open_now = [(0.0, s) for s in range(len(room))]
    parked: dict[int, list[int]] = {}  # sequences by their room, until documents are that short
    heapq.heapify(open_now)
    pieces, later = [], []

    def put(doc: int, start: int, n: int, seq: int) -> None:
        pieces.append((doc, start, n, seq, room[seq] - free[seq]))
        free[seq] -= n
        cost[seq] += linear * n + quadratic * n * n

    size = capacity
    for doc, n in enumerate(lengths):
        while size > n:
            size -= 1
            for seq in parked.pop(size, ()):
                heapq.heappush(open_now, (cost[seq], seq))
        while open_now and free[open_now[0][1]] < n:
            seq = heapq.heappop(open_now)[1]
            parked.setdefault(free[seq], []).append(seq)
        if open_now:
            seq = heapq.heappop(open_now)[1]
            put(doc, 0, n, seq)
            heapq.heappush(open_now, (cost[seq], seq))
        else:
            later.append(doc)
    left = [(cost[s], s) for s in range(len(room)) if free[s]]
    heapq.heapify(left)
    for doc in later:
        start = 0
        while start < lengths[doc]:
            seq = heapq.heappop(left)[1]
            n = min(free[seq], lengths[doc] - start)
            put(doc, start, n, seq)
            start += n
            if free[seq]:
                heapq.heappush(left, (cost[seq], seq))
    return pieces


def pack(tokens: DataFrame, capacity: int = 1024, groups: int = 1, linear: float = 1.0, quadratic: float = 1 / 1024) -> DataFrame:
    """Pieces (id, start, length, ids, doc_tokens, sequence_id, offset, cost) of ``tokens`` (id, start, doc_tokens, ids).

    ``ids`` are little-endian 32-bit integers, at most ``capacity`` a row;
    ``start`` is the row's place in its document of ``doc_tokens`` ids.  Every
    id lies in exactly one piece, and pieces fill a sequence without gaps from
    offset 0.  Rows without ids give no piece; null and repeated ids are packed
    like others.  An empty table gives an empty result.
    """
    id_type = tokens.schema["id"].dataType
    out = T.StructType([T.StructField("id", id_type), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                        T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()),
                        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
                        T.StructField("cost", T.DoubleType())])
    names = [f.name for f in out]

    def group(table: pa.Table) -> pa.Table:
        ids = [x.as_py() for x in table["ids"]]
        keys, starts = table["id"], table["start"].to_pylist()
        order = sorted((i for i in range(len(ids)) if ids[i]),
                       key=lambda i: (-len(ids[i]), (v := keys[i].as_py()) is None, 0 if v is None else v, starts[i], ids[i]))
        lengths = [len(ids[i]) // 4 for i in order]
        first = table["g"][0].as_py() << 32
        whole = sum(n == capacity for n in lengths)  # these fill a sequence each
        pieces = [(d, 0, capacity, d, 0) for d in range(whole)]
        pieces += [(d + whole, a, n, s + whole, o) for d, a, n, s, o in assign(lengths[whole:], capacity, linear, quadratic)]
        rows = pa.array([order[p[0]] for p in pieces], pa.int64())
        at, n, seq, off = (np.array([p[k] for p in pieces], "int64") for k in (1, 2, 3, 4))
        cut = [ids[order[d]][4 * a:4 * (a + m)] for d, a, m, _, _ in pieces]
        begin = np.array([starts[order[p[0]]] for p in pieces], "int64")
        return pa.table([keys.take(rows), pa.array(begin + at), pa.array(n), pa.array(cut, pa.binary()),
                         table["doc_tokens"].take(rows), pa.array(first + seq), pa.array(off),
                         pa.array(linear * n + quadratic * n * n.astype("float64"))], names=names)

    dealt = tokens.withColumn("g", F.pmod(F.xxhash64("id", "start", "ids"), F.lit(max(1, groups))))
    return dealt.groupBy("g").applyInArrow(group, out)


def token_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
               end_id: int = 0, capacity: int = 1024) -> DataFrame:
    """Rows (id, start, doc_tokens, ids): each text's ids and the end id, cut into rows of at most ``capacity``.

    A null text counts as empty and has the end id alone.
    """
    path = vocabulary or default_vocabulary()
    source = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    out = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("start", T.LongType()),
                        T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    end, step = end_id.to_bytes(4, "little"), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        names = [f.name for f in out]
        for batch in batches:
            rows, starts, totals, parts, held = [], [], [], [], 0
            for i, text in enumerate(batch["text"]):
                ids = encode(text.as_py() or "") + end
                for a in range(0, len(ids), step):
                    rows.append(i)
                    starts.append(a // 4)
                    totals.append(len(ids) // 4)
                    parts.append(ids[a:a + step])
                held += len(ids)
                if held > 8 << 20 or i + 1 == len(batch):
                    yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()),
                                                      pa.array(totals, pa.int64()), pa.array(parts, pa.binary())], names=names)
                    rows, starts, totals, parts, held = [], [], [], [], 0

    return source.mapInArrow(cut, out)


def pack_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
               capacity: int = 1024, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``pack`` over the ids of whole texts; the number of groups follows the bytes of text."""
    size = docs.agg(F.sum(F.octet_length(F.col(quoted(text_col))))).first()[0] or 0
    return pack(token_rows(docs, id_col, text_col, vocabulary, capacity=capacity), capacity, 1 + size // group_bytes)
