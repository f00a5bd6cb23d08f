"""Licence scan by a generalised suffix automaton of licence words.

The automaton is built over the words of licence notices and phrases.  Every
file streams through it once and yields matching statistics: at each word, the
longest run ending there that stands in some notice.  A phrase stands where
the run that ends there has it as its suffix.  Runs that cannot grow further
and are long enough are then chained, in the order of both the file and the
notice and with bounded gaps, into spans that cover the notice; a span that
covers enough of it gives the notice's label.

Words that stand in no notice, and neighbours that are neighbours in none,
end every run, so the automaton only walks the stretches between them.
"""

from __future__ import annotations

import functools
from bisect import bisect_right
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_row, field

#: Phrases and their labels (fixed values).
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Usual notices by label, as their licences word them (fixed values).
NOTICES = (
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
               "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
               "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
               "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
               "specific language governing permissions and limitations under the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
            "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
            "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
            "distribution."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
            "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
            "DISCLAIMED."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
            "version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
            "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
            "You should have received a copy of the GNU General Public License along with this program."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
             "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
             "any later version."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
            "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
            "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
            "and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
            "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("public-domain", "This is free and unencumbered software released into the public domain."),
)

#: Words of the shortest run that is chained, words a chain may skip (in the file or the notice), and the
#: share of a notice that its spans cover.
LEAST, GAP, COVER = 4, 16, 0.6

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(data: bytes) -> list[bytes]:
    """Words of a UTF-8 text: A-Z lower-cased, cut at ASCII characters that are no letters or digits."""
    return data.translate(_WORDS).split()


class Automaton:
    """Generalised suffix automaton of word sequences."""

    def __init__(self, texts: Sequence[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for t, text in enumerate(texts):
            last = 0
            for end, word in enumerate(text, 1):
                last = self._grow(last, word)
                while len(ends) < len(self.link):
                    ends.append([])
                ends[last].append((t, end))
        self.places = ends  # (text, end) of every place where the state's sequences stand
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                self.places[self.link[s]] = self.places[self.link[s]] + self.places[s]

    def _state(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, at: int, word: int, target: int) -> int:
        """The state of the sequences of ``target`` that end in ``at``'s longest one and ``word``."""
        if self.length[target] == self.length[at] + 1:
            return target
        copy = self._state(self.length[at] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while at >= 0 and self.next[at].get(word) == target:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _grow(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word, self.next[last][word])
        new, at = self._state(self.length[last] + 1, {}, 0), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, word, self.next[at][word])
        return new

    def statistics(self, words: Sequence[int]) -> Iterator[tuple[int, int]]:
        """(state, length) after each word: the longest suffix that stands in some text."""
        follow, link, lengths = self.next, self.link, self.length
        state = length = 0
        for word in words:
            while state and word not in follow[state]:
                state = link[state]
                length = lengths[state]
            if word in follow[state]:
                state = follow[state][word]
                length += 1
            yield state, length

    def state_of(self, words: Sequence[int]) -> int:
        state = 0
        for word in words:
            state = self.next[state][word]
        return state


class Scanner:
    """Phrases and notices, ready to scan files."""

    def __init__(self, phrases: Sequence[tuple[str, str]], notices: Sequence[tuple[str, str]], least: int, gap: int, cover: float):
        self.least, self.gap, self.cover = least, gap, cover
        known: dict[bytes, int] = {}
        number = lambda text: [known.setdefault(w, len(known)) for w in words_of(text.encode())]
        self.phrases = [(label, p) for text, label in phrases if (p := number(text))]
        self.notices = [(label, n) for label, text in notices if (n := number(text))]
        texts = [n for _, n in self.notices] + [p for _, p in self.phrases]

        class Numbers(dict):
            def __missing__(self, word: bytes) -> int:
                return len(self)

        self.numbers = Numbers(known)
        size = len(known) + 1
        self.pairs, self.alone = np.zeros((size, size), bool), np.zeros(size, bool)
        for text in texts:
            self.pairs[text[:-1], text[1:]] = True
            if len(text) == 1 or least == 1:
                self.alone[text] = True
        self.automaton = Automaton(texts)
        # State -> phrases that its longest sequence ends in, with their lengths.
        heads: dict[int, list[tuple[int, str]]] = {}
        for label, p in self.phrases:
            heads.setdefault(self.automaton.state_of(p), []).append((len(p), label))
        self.ending: list[list[tuple[int, str]]] = []
        for s in range(len(self.automaton.link)):
            found, at = [], s
            while at > 0:
                found += heads.get(at, [])
                at = self.automaton.link[at]
            self.ending.append(found)

    def scan(self, data: bytes) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, int, int, int, int]], float]:
        """Number of words, phrase places (label, start), spans (label, notice, start, words, covered, of), score."""
        words = words_of(data)
        n = len(words)
        ids = np.fromiter(map(self.numbers.__getitem__, words), np.int64, n)
        inside = self.alone[ids]
        if n > 1:
            met = self.pairs[ids[:-1], ids[1:]]
            inside[:-1] |= met
            inside[1:] |= met
        edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
        places, runs = [], []
        for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            state = length = 0
            for at, (new, more) in enumerate(self.automaton.statistics(ids[begin:end].tolist()), begin):
                if more <= length and length >= self.least:
                    runs.append((at - length, length, state))
                state, length = new, more
                places += [(label, at + 1 - k) for k, label in self.ending[state] if k <= length]
            if length >= self.least:
                runs.append((end - length, length, state))
        spans, best = self._chains(runs)
        return n, sorted(places, key=lambda p: (p[1], p[0])), spans, 1.0 if places else best

    def _chains(self, runs: list[tuple[int, int, int]]) -> tuple[list, float]:
        """Spans that cover notices, and the largest share of a notice that a chain covers."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        for start, length, state in runs:
            for t, end in self.automaton.places[state]:
                if t < len(self.notices):
                    found.setdefault(t, []).append((start, end - length, length))
        spans, best = [], 0.0
        for t, hits in found.items():
            label, notice = self.notices[t]
            hits.sort()
            # Best chain that ends in each hit; hits too far back cannot be followed.
            gain, before, window = [0] * len(hits), [-1] * len(hits), 0
            starts = [h[0] for h in hits]
            for i, (at, place, length) in enumerate(hits):
                gain[i] = length
                window = bisect_right(starts, at - self.gap - len(notice) - 1, window, i)
                for j in range(window, i):
                    a, p, k = hits[j]
                    skipped, missed = at - a - k, place - p - k
                    if a < at and p < place and skipped <= self.gap and missed <= self.gap:
                        added = length - max(0, -skipped, -missed)
                        if added > 0 and gain[j] + added > gain[i]:
                            gain[i], before[i] = gain[j] + added, j
            used = [False] * len(hits)
            for i in sorted(range(len(hits)), key=lambda i: (-gain[i], i)):
                chain = []
                while i >= 0 and not used[i]:
                    used[i] = True
                    chain.append(i)
                    i = before[i]
                if chain:
                    covered = gain[chain[0]] - (gain[i] if i >= 0 else 0)
                    best = max(best, covered / len(notice))
                    if covered >= self.cover * len(notice):
                        first, last = hits[chain[-1]], hits[chain[0]]
                        spans.append((label, t, first[0], last[0] + last[2] - first[0], covered, len(notice)))
        return sorted(spans, key=lambda s: (s[2], s[1])), best


@functools.lru_cache(maxsize=4)
def scanner(phrases: tuple, notices: tuple, least: int, gap: int, cover: float) -> Scanner:
    return Scanner(phrases, notices, least, gap, cover)


def scan_licences(docs: DataFrame, text_col: str = "text", phrases: Mapping[str, str] = PHRASES,
                  notices: Sequence[tuple[str, str]] = NOTICES, least: int = LEAST, gap: int = GAP, cover: float = COVER) -> DataFrame:
    """One row per input row: row (struct of all its columns), n_words, places, spans, score.

    places: (label, start) of every place where a phrase's words stand in a
    row, starts counted in words from 0, overlapping ones included.  spans:
    (label, notice, start, words, covered, of) of every chain of runs of at
    least ``least`` words, at most ``gap`` words apart, that covers at least
    the share ``cover`` of a notice (of ``of`` words).  score: 1 with a phrase,
    else the largest share of a notice that a chain covers, 0 without runs.
    Null counts as empty; empty texts have no words, empty lists and score 0.
    Repeated rows are judged each; an empty table gives an empty result.
    """
    fixed = (tuple(phrases.items()), tuple(map(tuple, notices)), least, gap, cover)
    place = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType())])
    span = T.StructType([T.StructField("label", T.StringType()), T.StructField("notice", T.IntegerType())]
                        + [T.StructField(c, T.LongType()) for c in ("start", "words", "covered", "of")])
    out = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("places", T.ArrayType(place)),
                        T.StructField("spans", T.ArrayType(span)), T.StructField("score", T.DoubleType())])
    of_place = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
    of_span = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.int32()), ("start", pa.int64()), ("words", pa.int64()),
                                  ("covered", pa.int64()), ("of", pa.int64())]))

    @F.arrow_udf(out)
    def scanned(texts: pa.Array) -> pa.Array:
        scan = scanner(*fixed).scan
        got = [scan(t.as_py().encode("utf-8", "replace") if t.is_valid else b"") for t in texts]
        spans = [[dict(zip(span.names, s)) for s in g[2]] for g in got]
        places = [[dict(zip(place.names, p)) for p in g[1]] for g in got]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array(places, of_place),
                                           pa.array(spans, of_span), pa.array([g[3] for g in got], pa.float64())], names=out.names)

    return as_row(docs).withColumn("scanned", scanned(field("row", text_col))).select("row", "scanned.*")
