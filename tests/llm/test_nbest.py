"""N-best segmentation against enumeration, and decoding against the text."""

import functools
import random
import zlib

import pytest

from meterlens.llm.nbest import SPACE, Pieces, decoded, default_model, encode_n_best


@pytest.fixture(scope="module")
def model():
    return Pieces(default_model(), 5)


def vocabulary(node, prefix=""):
    for c, (below, score, _) in node.items():
        if score is not None:
            yield prefix + c, score
        yield from vocabulary(below, prefix + c)


def all_scores(model, known, text):
    text = SPACE + text.replace(" ", SPACE)

    @functools.cache
    def rest(i):
        if i == len(text):
            return [0.0]
        out = []
        for j in range(i + 1, min(len(text), i + 16) + 1):
            if text[i:j] in known:
                out += [known[text[i:j]] + r for r in rest(j)]
        if text[i] not in known:
            out += [model.unknown + r for r in rest(i + 1)]
        return out

    return sorted(rest(0), reverse=True)


def test_scores_equal_enumeration_and_ids_decode(model):
    known = dict(vocabulary(model.trie))
    rng = random.Random(1)
    texts = ["the then", "  a  b", "thhe.thnd", "ñ é", "a\nb", "日本 x", "xx***", "to be", "a", " "]
    texts += ["".join(rng.choice("the n.a*ß") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    for text in texts:
        got = model.encode(text)
        want = all_scores(model, known, text)[:5]
        assert [g[0] for g in got] == want, text
        assert len({g[2] for g in got}) == len(got)
        assert all(model.decode(ids) == text and len(ids) == 4 * n for _, n, ids in got)


def test_longer_texts_keep_order_and_round_trip(model):
    text = "Thentien and the ononed erha; señor \u2603 said:\n" * 50
    got = model.encode(text)
    assert len(got) == 5 and [g[0] for g in got] == sorted((g[0] for g in got), reverse=True)
    assert all(model.decode(ids) == text for _, _, ids in got)


def test_forward_gives_the_best_way_and_the_gap_to_the_second(model):
    rng = random.Random(2)
    parts = ["▁the", "▁thethethe", "ñ", "日本語", "x", "▁", "▁▁▁", "*"]
    parts += ["".join(rng.choice("▁then.añ*") for _ in range(rng.randint(1, 12))) for _ in range(300)]
    for part in parts:
        best, ids, gap, text = model.forward(part)
        score, choices = model.search(part)
        assert (best, ids, text) == (score, choices[0][1], part)
        assert gap == (pytest.approx(choices[1][0], abs=1e-9) if len(choices) > 1 else float("inf"))


def test_texts_with_small_caches_have_the_same_segmentations(model, monkeypatch):
    from meterlens.llm import nbest

    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("the n.aß,") for _ in range(rng.randint(1, 8))) for _ in range(30)) for _ in range(20)]
    want = [model.encode(t) for t in texts]
    monkeypatch.setattr(nbest, "CACHE", 2)
    monkeypatch.setattr(nbest, "PARTS", 1)
    assert [Pieces(default_model(), 5).encode(t) for t in texts] == want


def test_frame(spark):
    rows = [(1, None), (2, ""), (3, "the cat"), (3, "the cat"), (None, "x"), (4, "long words here. " * 5000)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, rank int")
    out = encode_n_best(df, n=3)
    got = out.withColumn("text", decoded(out.ids)).collect()
    assert all(r.text_crc32 == zlib.crc32(r.text.encode()) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    assert [(r.rank, r.score, r.n_pieces, r.text) for r in by[1]] == [(1, 0.0, 0, "")] and len(by[2]) == 1
    assert sorted(r.rank for r in by[3]) == [1, 1, 2, 2, 3, 3] and all(r.text == "the cat" for r in by[3])
    assert {r.text for r in by[4]} == {rows[-1][1]} and len(by[4]) == 3 and by[None][0].text == "x"
    assert encode_n_best(df.filter("false")).count() == 0


def test_a_part_is_searched_once_wherever_it_stands(monkeypatch):
    seen, forward = [], Pieces.forward
    monkeypatch.setattr(Pieces, "forward", lambda self, part: seen.append(part) or forward(self, part))
    text = "the then, x\nthe then.\nthen the\nthe, (the) ñthe 日本 the日"
    got = Pieces(default_model(), 4).encode(text)
    assert len(seen) == len(set(seen)) and "▁the" in seen and "\n" in seen
    monkeypatch.undo()
    assert got == Pieces(default_model(), 4).encode(text)
