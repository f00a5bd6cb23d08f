"""Registered queries against DuckDB, and the pipeline stage by stage."""

import os
import re
import sys
import zlib

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))]
import corpus_pipeline  # noqa: E402
from meterlens.llm import registry  # noqa: E402
from meterlens.llm.simhash import fingerprint  # noqa: E402
from meterlens.llm.tokens import default_vocabulary, encoder  # noqa: E402

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_oracle(spark, duck01, name):
    from compare import compare

    result = compare(registry.queries()[name](spark, MIDDLE), duck01, registry.oracle_sql()[name])
    assert result["match"] and result["spark_rows"] == result["oracle_rows"] > 0, result


def test_every_operator_has_a_query():
    import __spark_entry__ as entry

    assert sorted(int(re.match(r"op(\d+)_", n).group(1)) for n in registry.queries()) == list(range(1, 14))
    assert set(registry.queries()) | {"pipeline"} <= set(entry.queries())
    assert set(registry.oracle_sql()) <= set(entry.oracle_sql())


def test_n_best_gives_four_segmentations(spark):
    got = registry.op6_n_best(spark, SMALL).groupBy("rank").count().collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3, 4]


def test_pipeline_stages(spark, tmp_path):
    docs = registry.table(spark, SMALL, "documents")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    good = {r.doc_id for r in kept["quality"]}
    judged = [(i in good) == (q == 1) for i, q in labels.items()]
    assert sum(judged) / len(judged) > 0.95

    texts = {}
    for i in sorted(good):
        texts.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[i].text or ""), i)
    assert sorted(r.doc_id for r in kept["exact_dedup"]) == sorted(texts.values())

    marks = {i: fingerprint(before[i].text) for i in texts.values()}
    parent = {i: i for i in marks}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in marks:
        for b in marks:
            if a < b and ((marks[a] ^ marks[b]) % (1 << 64)).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert sorted(r.doc_id for r in kept["near_dedup"]) == sorted({root(i) for i in marks})

    private = re.compile(r"[\w.]+@mail|\+1 \(\d{3}\) \d{3}-\d{4}|\d+\.\d+\.\d+\.\d+")
    new = {r.doc_id: r for r in kept["personal_data"]}
    assert set(new) == {r.doc_id for r in kept["near_dedup"]}
    for i, r in new.items():
        found = private.findall(before[i].text)
        assert not any(f in r.text for f in found)
        assert r.text == before[i].text if not re.search("[0-9@]", before[i].text) else r.n_chars == len(r.text)

    enc, got = encoder(default_vocabulary()), {}
    for p in sorted(kept["packing"], key=lambda p: p.start):
        got[p.doc_id] = got.get(p.doc_id, b"") + bytes(p.ids)
        assert p.ids_crc32 == zlib.crc32(bytes(p.ids))
    assert got == {i: enc.encode(r.text) + bytes(4) for i, r in new.items()}
