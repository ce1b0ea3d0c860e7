"""Licence scans by matching statistics against a suffix automaton of template words.

A text's words run through a generalised suffix automaton of all templates; the state after each
word gives the longest run of words, ending there, that stands in some template. Maximal long runs
are placed in their templates and chained, in order and with bounded gaps, into spans; a template
whose words a chain covers well enough gives its label. Base phrases are counted apart, everywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trackhouse.llm import words as W
from trackhouse.llm.columns import batch_with, schema_with, slices, utf8

#: Words of a run that counts as a match, and words that may lie between chained runs.
LEAST_RUN, GAP = 4, 24
#: Share of a template that a chain covers to give its label.
COVERED = 0.6
SLICE = 1 << 20

#: Base phrases and their labels. Fixed values.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Template texts of well-known licences and notices, with the label each gives. Fixed values.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
    associated documentation files (the "Software"), to deal in the Software without restriction, including without
    limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
    Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
    The above copyright notice and this permission notice shall be included in all copies or substantial portions of
    the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
    NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
    EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
    ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
    OTHER DEALINGS IN THE SOFTWARE."""),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
    compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
    Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
    on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
    the specific language governing permissions and limitations under the License."""),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
    General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
    option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
    WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
    General Public License for more details."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
    that the following conditions are met: Redistributions of source code must retain the above copyright notice,
    this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above
    copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
    materials provided with the distribution."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
    hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "All rights reserved"),
)


def tokens_of(text: str) -> list[str]:
    """Words as the scan takes them: A to Z in lower case; ASCII letters and digits and all beyond
    ASCII make words."""
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))


class Automaton:
    """A generalised suffix automaton of word lists; each state knows where its runs end."""

    def __init__(self, texts: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, text in enumerate(texts):
            last = 0
            for place, word in enumerate(text):
                last = self._extend(last, word)
                self.ends[last].add((number, place + 1))
        # Places of a state are those of all states that it is the suffix of.
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.next) - 1

    def _extend(self, last: int, word: int) -> int:
        old = self.next[last].get(word)
        if old is not None:
            return old if self.length[old] == self.length[last] + 1 else self._clone(last, old, word)
        new = self._state(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            old = self.next[at][word]
            self.link[new] = old if self.length[old] == self.length[at] + 1 else self._clone(at, old, word)
        return new

    def _clone(self, at: int, old: int, word: int) -> int:
        copy = self._state(self.length[at] + 1, self.link[old], dict(self.next[old]))
        self.link[old] = copy
        while at >= 0 and self.next[at].get(word) == old:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """For every word the length of the longest run ending there that some text holds, and its state."""
        state = length = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            yield length, state


class Scanner:
    """Templates ready for scanning: word numbers, automaton, base phrases."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.labels = [label for label, _ in templates]
        texts = [tokens_of(text) for _, text in templates]
        self.phrases = [(tokens_of(text), label) for text, label in phrases]
        vocabulary = sorted({w for t in texts for w in t} | {w for t, _ in self.phrases for w in t})
        raw = [w.encode() for w in vocabulary]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(r) for r in raw])
        hashes = W.word_hashes(data, ends - [len(r) for r in raw], ends)
        order = np.argsort(hashes)
        self.hashes, self.vocabulary = hashes[order], [vocabulary[i] for i in order]
        number = {w: i for i, w in enumerate(self.vocabulary)}
        self.sizes = [len(t) for t in texts]
        self.automaton = Automaton([[number[w] for w in t] for t in texts])
        self.bases = [([number[w] for w in t], label) for t, label in self.phrases]
        self.least = min(LEAST_RUN, min(self.sizes))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def matches(self, words: list[int]) -> list[tuple[int, int, int]]:
        """Maximal matches ``(start, length, state)``: those that the next word does not prolong. A
        match counts from ``LEAST_RUN`` words on, or if it is a whole shorter template."""
        found, before = [], (0, 0)
        for i, now in enumerate([*self.automaton.statistics(words), (0, 0)]):
            length, state = before
            if now[0] <= length and length >= self.least:
                if length >= LEAST_RUN or any(self.sizes[t] == length == end for t, end in self.automaton.ends[state]):
                    found.append((i - length, length, state))
            before = now
        return found

    def chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """Covered spans ``(template, start, end, share)`` of at least ``COVERED``, from matches in
        text order: a match joins its template's chain if it lies further on in both and not beyond
        ``GAP`` words; otherwise a new chain begins."""
        done, open_chains = [], {}

        def close(template: int) -> None:
            start, end, _, covered = open_chains.pop(template)
            share = min(1.0, covered / self.sizes[template])
            if share >= COVERED:
                done.append((template, start, end, share))

        for start, length, state in matches:
            by_template: dict[int, list[int]] = {}
            for template, end in self.automaton.ends[state]:
                by_template.setdefault(template, []).append(end - length)
            for template, places in by_template.items():
                chain = open_chains.get(template)
                if chain:
                    first, last, at, covered = chain
                    cut = max(0, last - start)  # words that both matches hold
                    later = [p for p in places if p + cut >= at]
                    if later and start - last <= GAP and length > cut:
                        open_chains[template] = (first, start + length, min(later) + length, covered + length - cut)
                        continue
                    if covered >= length and start < last:
                        continue  # inside what the chain has
                    close(template)
                open_chains[template] = (start, start + length, min(places) + length, length)
        for template in list(open_chains):
            close(template)
        return done


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def _runs(inside: np.ndarray, firsts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of at least ``least`` template words, which do not cross texts: starts and ends."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[firsts] = True
    begin = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    long = end - begin >= least
    return begin[long], end[long]


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``,
    ``labels``, ``score`` and ``spans`` (label, first word, end word, share covered).

    ``n_base`` counts every place of a base phrase; ``first_word`` and ``last_word`` are the least
    and greatest start (null without one). ``labels`` adds those of covered templates; both lists
    are distinct, sorted and joined by commas. ``score`` is 1 with a base phrase, else the largest
    share covered, or 0. Null and empty texts have no words. Whole texts are read, however long;
    every row is kept; columns of these names are replaced. No shuffle.

    Only runs of template words are fed to the automaton: any other word takes it back to its start.
    """
    span = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()),
                         T.StructField("end", T.LongType()), T.StructField("share", T.DoubleType())])
    added = {"n_words": T.LongType(), "n_base": T.LongType(), "first_word": T.LongType(), "last_word": T.LongType(),
             "base_labels": T.StringType(), "labels": T.StringType(), "score": T.DoubleType(), "spans": T.ArrayType(span)}
    span_arrow = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner()
        for batch in batches:
            data, bounds = utf8(batch.column(batch.schema.names.index(text)))
            for first, last in slices(bounds, SLICE):
                part = batch.slice(first, last - first)
                lowered = W.LOWER[data[bounds[first] : bounds[last]]]
                starts, ends, firsts = W.spans(lowered, bounds[first : last + 1] - bounds[first], W.ALNUM)
                numbers = own.numbers(W.word_hashes(lowered, starts, ends)) if len(starts) else np.zeros(0, np.int64)
                n = last - first
                total, low, high = np.zeros(n, np.int64), np.full(n, 2**62), np.full(n, -1)
                base: list[set] = [set() for _ in range(n)]
                for phrase, label in own.bases:
                    fits = W.run_starts(firsts, len(phrase))
                    for i, word in enumerate(phrase):
                        fits[: len(numbers) - i] &= numbers[i:] == word
                    at = np.flatnonzero(fits)
                    doc = np.searchsorted(firsts, at, "right") - 1
                    np.add.at(total, doc, 1)
                    np.minimum.at(low, doc, at - firsts[doc])
                    np.maximum.at(high, doc, at - firsts[doc])
                    for d in np.unique(doc).tolist():
                        base[d].add(label)
                found: list[list] = [[] for _ in range(n)]
                begin, end = _runs(numbers >= 0, firsts, own.least)
                doc = np.searchsorted(firsts, begin, "right") - 1
                by_doc: dict[int, list] = {}
                for d, a, b in zip(doc.tolist(), begin.tolist(), end.tolist()):
                    shift = a - int(firsts[d])
                    hits = own.matches(numbers[a:b].tolist())
                    by_doc.setdefault(d, []).extend((s + shift, size, state) for s, size, state in hits)
                for d, hits in by_doc.items():
                    found[d] = [{"label": own.labels[t], "start": s, "end": e, "share": share} for t, s, e, share in own.chains(hits)]
                labels = [base[d] | {x["label"] for x in found[d]} for d in range(n)]
                score = [1.0 if base[d] else max((x["share"] for x in found[d]), default=0.0) for d in range(n)]
                none = total == 0
                yield batch_with(part, {
                    "n_words": pa.array(np.diff(firsts), pa.int64()), "n_base": pa.array(total),
                    "first_word": pa.array(low, mask=none), "last_word": pa.array(high, mask=none),
                    "base_labels": pa.array([",".join(sorted(b)) for b in base], pa.string()),
                    "labels": pa.array([",".join(sorted(x)) for x in labels], pa.string()),
                    "score": pa.array(score, pa.float64()), "spans": pa.array(found, span_arrow),
                })

    return docs.mapInArrow(run, schema_with(docs, added))
