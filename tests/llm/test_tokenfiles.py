"""Token files: exact round trip, order, selective reads, settings."""

import tempfile
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from meterlens.llm.tokenfiles import read_tokens, token_checksums, write_tokens, writer_options
from meterlens.llm.tokens import WordEncoder, default_vocabulary, encoder


def wanted(rows):
    enc, start, out = encoder(default_vocabulary()), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = enc.encode(t or "") + bytes(4)
        out.append((i, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    return out


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_round_trip(spark, encoding):
    rows = [(i * 7 % 101, f"document {i} " * (i % 13)) for i in range(101)] + [(200, None), (201, ""), (None, "null id"), (202, "long text. " * 20_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int").repartition(5)
    path = tempfile.mkdtemp(prefix="tokens-") + "/t"
    write_tokens(df, path, encoding=encoding, row_group_bytes=1 << 16, page_bytes=4096)
    files = read_tokens(spark, path)
    got = token_checksums(files).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == wanted(rows)
    # Files and their rows stand in ascending id order.
    parts = sorted((r.part, r.part_start, r.id if r.id is not None else -1) for r in spark.read.parquet(path).collect())
    assert [p[2] for p in parts] == sorted(p[2] for p in parts)
    part = next(f for f in sorted(spark.read.parquet(path).inputFiles()))
    meta = pq.ParquetFile(part.removeprefix("file:")).metadata
    tokens = next(c for c in (meta.row_group(0).column(k) for k in range(meta.num_columns)) if c.path_in_schema.startswith("tokens"))
    assert ("RLE_DICTIONARY" in tokens.encodings) == (encoding == "dictionary")
    assert ("DELTA_BINARY_PACKED" in tokens.encodings) == (encoding == "delta")
    assert tokens.has_column_index or tokens.has_offset_index


def test_repeated_ids_and_empty_table(spark):
    rows = [(1, "a"), (1, "b c d"), (1, "a"), (0, "zero")]
    path = tempfile.mkdtemp(prefix="tokens-") + "/t"
    write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path)
    got = sorted(token_checksums(read_tokens(spark, path)).collect(), key=lambda r: r.start)
    assert [r.id for r in got] == [0, 1, 1, 1] and sum(r.n_tokens for r in got) == sum(w[2] for w in wanted(rows))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    path = tempfile.mkdtemp(prefix="tokens-") + "/e"
    write_tokens(spark.createDataFrame([], "doc_id long, text string"), path)
    assert read_tokens(spark, path).count() == 0


def test_metadata_reads_leave_the_ids(spark):
    path = tempfile.mkdtemp(prefix="tokens-") + "/t"
    write_tokens(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), path)
    plan = read_tokens(spark, path).select("id", "start")._jdf.queryExecution().executedPlan().toString()
    assert "tokens" not in plan.replace("n_tokens", "").split("Location")[0].split("FileScan")[-1]
    row = read_tokens(spark, path).first()
    assert np.array(row.tokens, "<u4").tobytes() == encoder(default_vocabulary()).encode("a b") + bytes(4)
    with pytest.raises(ValueError):
        writer_options("zip")


def test_marks_after_any_letter_are_encoded_apart():
    words = WordEncoder(default_vocabulary())
    text = "x end.\nThe, x end.\nThe. x it's, x 2nd; x a_b!? x d'é) x 5's- x a”b."
    ids = np.frombuffer(words.encode(text), "<u4")
    assert list(ids) == words.tokenizer.encode(text, add_special_tokens=False).ids
    assert "end.\nThe" in words and not {"end.\nThe,", "end.\nThe.", "2nd;", "a_b!?"} & set(words)
