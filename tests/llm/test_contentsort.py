"""Exact dedup by content sort against brute force."""

import hashlib
import re

from meterlens.llm.contentsort import content_sort_dedup

SCHEMA = "doc_id long, text string, kept string, digest int, row int"


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in rows]
    groups = {}
    for i, n in enumerate(norm):
        groups.setdefault(n, []).append(i)
    out = []
    for n, members in groups.items():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            out.append((rows[i][0], min(ids) if ids else None, len(members), hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr), groups


def check(spark, rows, **settings):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    found = content_sort_dedup(df, **settings)
    got = found.select("row.doc_id", "keep_id", "group_size", "text_sha256", "kept").collect()
    want, groups = brute(rows)
    assert sorted([tuple(r)[:4] for r in got], key=repr) == want
    stay = [r for r in got if r.kept]
    assert len(stay) == len(groups)  # exactly one of each group, the one with the smallest id
    assert all(r.doc_id == r.keep_id for r in stay)
    assert {"doc_id", "kept", "digest", "row"} <= set(found.select("row.*").columns)
    return df


def test_white_space_nulls_empties_ties_and_clashing_columns(spark):
    rows = [(5, "a  b"), (3, "a\tb"), (9, "a b "), (4, " a b"), (7, "a\u00a0b"), (1, None), (2, ""), (None, ""), (6, " "),
            (6, "\n\t"), (8, "x"), (8, "x"), (None, "only null"), (None, "only null"), (11, "é" * 3), (10, "long " * 60_000),
            (12, "long " * 60_000), (13, "a\x1cb")]
    check(spark, rows)


def test_hot_text_is_spread_and_still_one_group(spark):
    rows = [(i, "the same text") for i in range(3000)] + [(i, f"text {i % 700}") for i in range(3000, 5000)] + [(3, "the same text")]
    df = check(spark, rows)
    kept = content_sort_dedup(df, kept_only=True).select("row.*")
    assert kept.columns == df.columns
    assert kept.count() == 701 and kept.filter("text = 'the same text'").first().doc_id == 0


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a", 1, 2, 3), (2, "a", 4, 5, 6)], "doc_id long, text string, ` ` int, `_` int, `a.b` int")
    found = content_sort_dedup(df, kept_only=True).select("row.*")
    assert found.columns == df.columns and [tuple(r) for r in found.collect()] == [(1, "a", 1, 2, 3)]


def test_carry_and_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert content_sort_dedup(empty).count() == 0
    one = spark.createDataFrame([(1, "a", "x", 1, 2)], SCHEMA)
    assert content_sort_dedup(one, carry=["doc_id"]).select("row.*").columns == ["doc_id"]


def test_one_exchange_of_texts(spark):
    df = spark.createDataFrame([(i, f"t{i}", "x", 1, 2) for i in range(50)], SCHEMA)
    plan = content_sort_dedup(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
