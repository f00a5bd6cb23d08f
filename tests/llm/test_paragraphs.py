"""Duplicate paragraphs and passages against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest

from meterlens.llm import paragraphs
from meterlens.llm.paragraphs import _lines, _shingles, duplicate_passages, gram_hashes, tune_bands, window_places, word_hashes

WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_bands_reach_the_recall():
    for similarity in (0.5, 0.8, 0.95):
        bands, rows = tune_bands(similarity)
        assert 1 - (1 - similarity**rows) ** bands >= 0.999 and bands <= 10


def test_gram_hashes_depend_on_the_words_alone():
    rng = random.Random(1)
    words = [rng.choice(WORDS + ["É", "x" * 40, "a"]) for _ in range(500)]
    text = " ".join(words).encode()
    hashes, begins, ends = word_hashes(b" \n" + text + b"\t")
    assert [(b" \n" + text)[a:b] for a, b in zip(begins, ends)] == text.split()
    assert len({*hashes.tolist()}) == len({*words})
    assert (word_hashes(text.upper().replace("é".upper().encode(), "É".encode()))[0] == hashes).all()
    whole = gram_hashes(hashes, 25)
    assert len(whole) == 476
    for k in (0, 17, 300, 475):
        assert gram_hashes(word_hashes(" ".join(words[k:k + 25]).encode())[0], 25)[0] == whole[k]
    assert len(gram_hashes(hashes[:24], 25)) == 0 and len(word_hashes(b" \n")[0]) == len(word_hashes(b"")[0]) == 0


def test_windows_are_dense_enough():
    rng = np.random.default_rng(2)
    grams = rng.integers(0, 1 << 62, 2000, dtype=np.uint64)
    at = window_places(grams).tolist()
    assert at[0] < 26 and at[-1] >= len(grams) - 26 and max(np.diff(at)) <= 26
    for s in range(0, len(grams) - 26):  # plain winnowing agrees
        assert s + int(np.argmin(grams[s:s + 26])) in at
    assert len(window_places(grams[:5])) == 1 and len(window_places(grams[:0])) == 0
    assert len(window_places(np.full(500, 7, np.uint64))) == 1


def brute_clusters(rows):
    found = [(i, s, _shingles(n.split())) for i, t in rows for s, _, n in _lines(t or "", 50)]
    parent = list(range(len(found)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(found)):
        for b in range(a):
            x, y = found[a][2], found[b][2]
            if len(x & y) >= 0.8 * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    groups = defaultdict(set)
    for k, (i, s, _) in enumerate(found):
        groups[root(k)].add((i, s))
    return {frozenset(g) for g in groups.values() if len(g) > 1}


@pytest.mark.parametrize("block", [128, 4])
def test_clusters_and_passages_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(paragraphs, "BLOCK", block)
    rng = random.Random(block)
    base = [prose(rng, rng.randint(55, 150)) for _ in range(12)]
    shared = prose(rng, 51)
    rows = []
    for i in range(80):
        lines = [prose(rng, rng.randint(5, 120)) for _ in range(rng.randint(1, 4))]
        if i % 3 == 0:
            words = rng.choice(base).split()
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = "edited"
            lines.insert(rng.randrange(len(lines) + 1), " ".join(words).upper() if i % 2 else " ".join(words))
        if i % 10 == 1:  # inside a paragraph of its own
            lines.append(f"{prose(rng, 90)} {shared} {prose(rng, 70)}")
        rows.append((i, "\n".join(lines)))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, kind string, start int")
    got = duplicate_passages(df).collect()
    clusters = defaultdict(set)
    for r in got:
        if r.kind == "paragraph":
            clusters[r.cluster_id].add((r.id, r.start))
            assert r.occurrences >= 2
    assert {frozenset(c) for c in clusters.values()} == brute_clusters(rows)
    for c in clusters:
        assert sum(r.kept for r in got if r.kind == "paragraph" and r.cluster_id == c) == 1
    texts = dict(rows)
    runs = defaultdict(set)
    for i, t in rows:
        words = t.lower().split()
        for k in range(len(words) - 50):
            runs[tuple(words[k:k + 51])].add(i)
    must = set().union(*(s for s in runs.values() if len(s) > 1))
    passages = [r for r in got if r.kind == "passage"]
    assert must <= {r.id for r in passages}
    for r in passages:  # every span really stands in another document, window by window
        words = texts[r.id][r.start:r.start + r.length].lower().split()
        assert len(words) >= 25 or not r.kept  # one that is not kept ends where the document's own begins
        others = [" ".join(t.lower().split()) for i, t in rows if i != r.id]
        assert any(" ".join(words[:25]) in t for t in others)


def test_edge_cases(spark):
    rng = random.Random(9)
    line, long = prose(rng, 60), "\n".join(prose(rng, 80) for _ in range(800))
    rows = [(1, None), (2, ""), (3, "short line"), (4, "short line"), (5, line), (None, line), (6, long), (7, long), (8, line), (8, line)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = duplicate_passages(df).collect()
    assert {r.id for r in got} == {5, 6, 7, 8, None}
    one = [r for r in got if r.kind == "paragraph" and r.occurrences == 4]
    assert sorted((r.id for r in one), key=repr) == [5, 8, 8, None] and sum(r.kept for r in one) == 1
    assert duplicate_passages(df.filter("doc_id in (1, 2, 3, 4)")).count() == 0
    assert duplicate_passages(df.filter("false")).count() == 0


def test_lines_of_every_length_have_clusters(spark):
    rng = random.Random(11)
    twenty, eight, seven, base = prose(rng, 20), prose(rng, 8), prose(rng, 7), prose(rng, 40)
    near = base.split()
    near[0] = "edited"  # one of 36 shingles
    rows = [(1, f"{twenty}\n{prose(rng, 30)}\nLes."), (2, f"{eight}\n{twenty.upper()}"), (3, f"les.\n{seven}\n{base}"),
            (4, f"{eight}  \n\n{' '.join(near)}"), (5, f"{seven} more\n{twenty} tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def clusters(**settings):
        found = defaultdict(set)
        for r in duplicate_passages(df, **settings).filter("kind = 'paragraph'").collect():
            found[r.cluster_id].add((r.id, rows[r.id - 1][1][r.start:r.start + r.length].lower()))
        return sorted(sorted(c) for c in found.values())

    long = [[(1, twenty), (2, twenty), (5, twenty + " tail")], [(2, eight), (4, eight + "  ")], [(3, base), (4, " ".join(near))]]
    assert clusters() == sorted(long)
    assert clusters(min_words=1) == sorted([*long, [(1, "les."), (3, "les.")]])


def test_keys_of_many_lines_equal_those_of_each():
    rng = random.Random(12)
    lines = [prose(rng, n).encode() for n in (5, 6, 80, 5, 300, 7)]
    each = [paragraphs.band_keys(gram_hashes(word_hashes(n)[0], 5), 10, 3).tolist() for n in lines]
    assert paragraphs.band_keys_of(lines, 10, 3).tolist() == each
    assert paragraphs.band_keys_of(lines[:1], 10, 3).tolist() == each[:1]


def test_spans_cover_the_whole_shared_run(spark):
    rng = random.Random(13)
    runs = [prose(rng, n) for n in (50, 51, 60, 77, 140, 400)] + [" ".join(["again"] * 120), " ".join(["to and fro"] * 60)]
    rows = []
    for k, run in enumerate(runs):
        for copy in range(3):
            rows.append((None if k == 3 and copy < 1 else 10 * k + copy, f"É{prose(rng, rng.randint(0, 90))}\n{run} {prose(rng, rng.randint(0, 90))}"))
    rows += [(900, f"{prose(rng, 30)} {runs[0]} {runs[1]} {prose(rng, 9)}"), (901, f"{prose(rng, 30)} {runs[4]}"), (901, f"{prose(rng, 7)} {runs[5]}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spans = defaultdict(list)
    for r in duplicate_passages(df).filter("kind = 'passage'").collect():
        spans[r.id].append((r.start, r.start + r.length))
    for i, text in rows:
        for run in runs:
            start = text.find(run)
            if start >= 0:
                assert any(a <= start and start + len(run) <= b for a, b in spans[i]), (i, run[:20])
    for i, text in rows[:-3]:  # and hardly more than the run: a word beside it that happens to be the same
        assert len(spans[i]) == 1 and spans[i][0][1] - spans[i][0][0] <= max(len(r) for r in runs if r in text) + 12


def test_removing_what_is_not_kept_leaves_every_window_somewhere(spark):
    rng = random.Random(14)
    parts = [prose(rng, 80) for _ in range(6)]
    a, b = parts[0], parts[1]
    rows = [(1, a), (5, f"{a} {b}"), (9, b)]  # b stands first in 5, right after what stands first in 1
    rows += [(20 + k, " ".join(rng.sample([*parts[2:], prose(rng, 30)], 4))) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [r for r in duplicate_passages(df).collect() if r.kind == "passage"]
    mine = {(r.id, r.kept) for r in got if r.id in (1, 5, 9)}
    assert mine == {(1, True), (5, False), (5, True), (9, False)}
    left = {}
    for i, text in rows:
        keep = [True] * len(text)
        for r in got:
            if r.id == i and not r.kept:
                keep[r.start:r.start + r.length] = [False] * r.length
        left[i] = "".join(c if k else "|" for c, k in zip(text, keep))
    whole = " || ".join(" ".join(t.split()) for t in left.values())
    assert left[9].strip("|") == "" and left[5].strip("| ") == b
    for part in parts:
        words = part.split()
        for k in range(len(words) - 24):
            assert " ".join(words[k:k + 25]) in whole


def test_paragraphs_that_meet_in_many_bands_are_compared_once(spark, monkeypatch):
    rng, compared, verified = random.Random(9), [], paragraphs._verified
    monkeypatch.setattr(paragraphs, "_verified", lambda cells, s: compared.append(cells.count()) or verified(cells, s))
    lines = [[f"w{rng.randrange(10**6)}" for _ in range(120)] for _ in range(3)]
    rows = [(i, " ".join(line)) for i, line in enumerate(lines + [line[:119] for line in lines])]
    found = duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).filter("kind = 'paragraph'").collect()
    assert len({r.cluster_id for r in found}) == 3 and [r.occurrences for r in found] == [2] * 6
    assert compared == [6]


def test_runs_of_windows_end_at_gaps_other_first_documents_and_repeated_rows(spark):
    # id, doc, start, stop, first_id: two runs with a gap, a repeated row, another first document, a run of one window
    rows = [(2, 7, 0, 9, 1), (2, 7, 2, 12, 1), (2, 7, 13, 20, 1), (2, 7, 22, 30, 1), (2, 7, 22, 30, 1), (2, 7, 31, 40, 2),
            (3, 8, 5, 9, 1), (None, 8, 5, 9, 1)]
    got = paragraphs._spans(spark.createDataFrame(rows, "id long, doc long, start int, stop int, first_id long")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(2, 0, 20, 1, 3, False), (2, 22, 30, 1, 2, False), (2, 31, 40, 2, 1, True), (3, 5, 9, 1, 1, False),
         (None, 5, 9, 1, 1, False)], key=str)
