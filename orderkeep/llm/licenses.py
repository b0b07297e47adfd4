"""Licence scans by a generalised suffix automaton of licence tokens.

All templates' words make one suffix automaton. A text's words stream through it and give matching statistics: at each
word the longest run of words up to it that some template holds. Runs of MIN_MATCH words or more that cannot be extended,
or end with a template's last word, are matches; one that stands at more than MAX_PLACES places of the templates tells nothing of which is meant and
is left out (a property of the templates, not of the text). Per template, matches in ascending order of text and
template, with at most MAX_GAP words between them, chain into a span, and the covered share of the template's words is
the chain's coverage; spans count from MIN_COVER on. Of spans that share more than half of the shorter one the one whose
covered words exceed its missing ones by most stays, so that a text is not given the labels of licences whose words it
holds in passing. Short phrases are found where the automaton has read all their words, wherever they stand.

Templates are whole licences (a file of public text each, in the folder licences, and its first HEAD_WORDS words as a
template of its own, for texts that quote the beginning) and notices. The driver reads them; workers get them by
broadcast. A state of the automaton keeps only the ends that are its own; those of its strings' longer forms are found
by walking the tree of suffix links, so memory is linear in the templates.

Only places whose window of the shortest length stands in a template take a step; other stretches are skipped.

Defined results: a null or empty text has no words, no labels and score 0; a very long text is scanned whole, in one
pass. Rows are scanned one by one: repeated rows, ties and null ids change nothing; an empty table gives an empty result;
other columns are ignored, whatever their names. Words are told apart by 64-bit hashes: another word passes for one of a
template's with a chance near 2**-50 for each word.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderkeep.llm.common import held, map_arrow, prepare, table, texts
from orderkeep.llm.textkernel import ALNUM, chunks

MIN_MATCH = 3
MAX_PLACES = 50
MAX_GAP = 25
MIN_COVER = 0.6
HEAD_WORDS = 60
FOLDER = os.path.join(os.path.dirname(os.path.abspath(__file__)), "licences")

# Phrases with their labels, and public licence notices and short licences with theirs.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_FSF = "This {thing} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as published by the Free Software Foundation{stop} either version {version} of the License, or (at your option) any later version."
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd-2", f"{_BSD} {_BSD_END}"),
    ("bsd-3", f"{_BSD} {_BSD_NAME} {_BSD_END}"),
    ("bsd-2", _BSD),
    ("bsd-3", f"{_BSD} {_BSD_NAME}"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"),
    ("postgresql", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."),
    ("bsl-1", "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
    ("bsl-1", "Distributed under the Boost Software License, Version 1.0."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-1", _FSF.format(thing="program", mark=";", name="", stop=";", version="1")),
    ("gpl-2", _FSF.format(thing="program", mark=";", name="", stop=";", version="2")),
    ("gpl-3", _FSF.format(thing="program", mark=":", name="", stop=",", version="3")),
    ("lgpl-2", _FSF.format(thing="library", mark=";", name="Library ", stop=";", version="2")),
    ("lgpl-2.1", _FSF.format(thing="library", mark=";", name="Lesser ", stop=";", version="2.1")),
    ("lgpl-3", _FSF.format(thing="library", mark=":", name="Lesser ", stop=",", version="3")),
    ("agpl-3", _FSF.format(thing="program", mark=":", name="Affero ", stop=",", version="3")),
    ("gfdl-1.2", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.2 or any later version published by the Free Software Foundation"),
    ("gfdl-1.3", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation"),
    ("mpl-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("epl-1", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("cddl-1", "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You may not use this file except in compliance with the License."),
    ("artistic-2", "This package is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0"),
    ("ofl-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at"),
    ("wtfpl", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
)
# The parts of Creative Commons licences, by label, and the versions of their notices.
COMMONS = (
    ("cc-by", "Attribution"),
    ("cc-by-sa", "Attribution-ShareAlike"),
    ("cc-by-nd", "Attribution-NoDerivatives"),
    ("cc-by-nc", "Attribution-NonCommercial"),
    ("cc-by-nc-sa", "Attribution-NonCommercial-ShareAlike"),
    ("cc-by-nc-nd", "Attribution-NonCommercial-NoDerivatives"),
)
COMMONS_VERSIONS = ("4.0 International", "3.0 Unported", "2.0 Generic")


@cache
def known_templates() -> tuple[tuple[str, str], ...]:
    """(label, text) of all templates: whole licences and their heads, notices, Creative Commons notices."""
    whole = []
    for name in sorted(os.listdir(FOLDER)):
        with open(os.path.join(FOLDER, name), encoding="utf-8") as f:
            whole.append((name.removesuffix(".txt"), f.read()))
    heads = tuple((label, " ".join(words_of(text)[:HEAD_WORDS])) for label, text in whole)
    commons = tuple((label, f"This work is licensed under a Creative Commons {parts} {version} License") for version in COMMONS_VERSIONS for label, parts in COMMONS)
    return (*NOTICES, *commons, *heads, *whole)


def words_of(text: str) -> list[str]:
    """The words of a text: A-Z lower-cased, runs of digits, a-z and everything beyond ASCII."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


@dataclass
class Automaton:
    """The suffix automaton of several token sequences (none of its strings spans two of them)."""

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: For each state, where its longest string ends: (sequence, index of the last token).
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])
    #: For each state, once finished, those whose suffix links lead to it, and in how many places its strings end.
    children: list[list[int]] = field(default_factory=list)
    places: list[int] = field(default_factory=list)

    def _state(self, step: dict[int, int], link: int, length: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.step) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        """A copy of q for the strings of it that p's extend to; those up the suffix links that led to q lead to the copy."""
        copy = self._state(dict(self.step[q]), self.link[q], self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.step[p].get(token) == q:
            self.step[p][token] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: int, tokens: Sequence[int]) -> None:
        last = 0
        for i, token in enumerate(tokens):
            q = self.step[last].get(token)
            if q is not None:  # another sequence holds this string
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, token, q)
            else:
                p, new = last, self._state({}, 0, self.length[last] + 1)
                while p >= 0 and token not in self.step[p]:
                    self.step[p][token] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.step[p][token]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, token, q)
                last = new
            self.ends[last].append((sequence, i))

    def finish(self) -> None:
        """Turn the suffix links around and count each state's places, those of its longer forms included."""
        self.children = [[] for _ in self.step]
        self.places = [len(e) for e in self.ends]
        for v in sorted(range(1, len(self.step)), key=self.length.__getitem__, reverse=True):
            self.children[self.link[v]].append(v)
            self.places[self.link[v]] += self.places[v]

    def ends_of(self, state: int) -> list[tuple[int, int]]:
        """All places where the strings of a state end."""
        out, todo = [], [state]
        while todo:
            v = todo.pop()
            out += self.ends[v]
            todo += self.children[v]
        return out

    def statistics(self, tokens: Sequence[int]) -> list[tuple[int, int]]:
        """For each token (state, length) of the longest string up to it that a sequence holds."""
        out, v, n = [], 0, 0
        step, link, length = self.step, self.link, self.length
        for token in tokens:
            while v and token not in step[v]:
                v = link[v]
                n = length[v]
            to = step[v].get(token)
            v, n = (to, n + 1) if to is not None else (0, 0)
            out.append((v, n))
        return out


class Scanner:
    def __init__(self, templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]] = PHRASES):
        self.labels = [label for label, _ in templates]
        split = [words_of(t) for _, t in templates]
        quoted = [words_of(p) for p, _ in phrases]
        self.sizes = [len(s) for s in split]
        self.phrases = [(label, len(words)) for (_, label), words in zip(phrases, quoted, strict=True)]
        names = sorted({w for s in (*split, *quoted) for w in s})
        hashes = next(chunks(names, ALNUM))[1].hashes if len(names) else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.known = hashes[order]
        self.code = order.astype(np.int64)
        number = {w: i for i, w in enumerate(names)}
        self.automaton = Automaton()
        for k, s in enumerate((*split, *quoted)):
            self.automaton.add(k, [number[w] for w in s])
        self.automaton.finish()
        whole: dict[int, int] = {}
        for k, s in enumerate(quoted):
            v = 0
            for w in s:
                v = self.automaton.step[v][number[w]]
            whole[v] = k
        #: For each state the phrases with which its strings end; states without one of their own share their link's.
        self.closed: list[tuple[int, ...]] = [()] * len(self.automaton.step)
        for v in sorted(range(1, len(self.automaton.step)), key=self.automaton.length.__getitem__):
            above = self.closed[self.automaton.link[v]]
            self.closed[v] = (whole[v], *above) if v in whole else above
        #: For each state the templates with whose last words its strings end, and of how many words.
        self.closing: list[tuple[tuple[int, int], ...]] = [()] * len(self.automaton.step)
        for v in sorted(range(1, len(self.automaton.step)), key=self.automaton.length.__getitem__):
            own = tuple((k, self.automaton.length[v]) for k, last in self.automaton.ends[v] if k < len(split) and last + 1 == self.sizes[k] and self.automaton.length[v] >= MIN_MATCH)
            self.closing[v] = (*own, *self.closing[self.automaton.link[v]]) if own else self.closing[self.automaton.link[v]]
        #: Windows of the shortest length that can matter.
        self.shortest = min([MIN_MATCH, *(n for _, n in self.phrases)])
        every = [words.windows(self.shortest)[a : max(a, b - self.shortest + 1)] for _, words in chunks([" ".join(s) for s in (*split, *quoted)], ALNUM) for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]
        self.windows = np.unique(np.concatenate([np.zeros(0, np.uint64), *every]))

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """Of word hashes the tokens, -1 for words that no template holds."""
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.code[at], -1)

    def _stretches(self, words, code: np.ndarray) -> np.ndarray:
        """Whether each word lies in a window that a template holds; windows across texts may count too."""
        size, inside = self.shortest, np.zeros(len(code), bool)
        if len(code) >= size:
            may = np.ones(len(code) - size + 1, bool)
            for k in range(size):
                may &= code[k : len(code) - size + 1 + k] >= 0
            at = np.flatnonzero(may)
            h = words.windows(size)[at]
            at = at[self.windows[np.minimum(np.searchsorted(self.windows, h), len(self.windows) - 1)] == h]
            for k in range(size):
                inside[at + k] = True
        return inside

    def scan(self, items: Sequence[str]) -> list[tuple[int, list[tuple[int, int]], dict[str, float], list[tuple[str, int, int, float]]]]:
        """For each text (number of words, [(phrase, first word)], {label: best coverage}, [(label, first word, word after the last, coverage)])."""
        out = []
        for _, words in chunks(items, ALNUM, most=1 << 19):
            code = self.codes(words.hashes)
            inside = self._stretches(words, code)
            for d in range(len(words.first) - 1):
                a, b = int(words.first[d]), int(words.first[d + 1])
                out.append((b - a, *self._scan(code[a:b], inside[a:b])))
        return out

    def _scan(self, code: np.ndarray, inside: np.ndarray):
        places: list[tuple[int, int]] = []
        matches: dict[int, list[tuple[int, int, int]]] = {}
        if inside.any():
            edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
            begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            for x, y in zip(begins.tolist(), ends.tolist(), strict=True):
                stats = self.automaton.statistics(code[x:y].tolist())
                for i, (v, n) in enumerate(stats):
                    if n < self.shortest:
                        continue
                    places.extend((k, x + i + 1 - self.phrases[k][1]) for k in self.closed[v] if self.phrases[k][1] <= n)
                    if n < MIN_MATCH:
                        continue
                    for k, most in self.closing[v]:  # a template ends here, though a longer one may go on
                        matches.setdefault(k, []).append((x + i + 1, self.sizes[k], min(n, most)))
                    if self.automaton.places[v] <= MAX_PLACES and (i + 1 == len(stats) or stats[i + 1][1] <= n):
                        for k, end in self.automaton.ends_of(v):
                            if k < len(self.labels):
                                matches.setdefault(k, []).append((x + i + 1, end + 1, n))
        spans = []
        for k, found in matches.items():
            for first, last, covered in _chains(found):
                share = covered / self.sizes[k]
                if share >= MIN_COVER:
                    spans.append((2 * covered - self.sizes[k], share, self.labels[k], first, last))
        kept = _resolved(spans)
        best: dict[str, float] = {}
        for label, _, _, share in kept:
            best[label] = max(best.get(label, 0.0), share)
        return places, best, kept


def _resolved(spans: list[tuple[int, float, str, int, int]]) -> list[tuple[str, int, int, float]]:
    """Of (worth, share, label, first, after) those that share no more than half of the shorter span with a better one, as
    (label, first, after, share) in the order of the text. Ties: the greater share, then the lesser label and place."""
    kept: list[tuple[str, int, int, float]] = []
    for _, share, label, first, after in sorted(spans, key=lambda s: (-s[0], -s[1], s[2], s[3], s[4])):
        # few spans of a text: those of templates that it holds for the most part
        if all(2 * (min(after, b) - max(first, a)) <= min(after - first, b - a) for _, a, b, _ in kept):
            kept.append((label, first, after, share))
    return sorted(kept, key=lambda s: (s[1], s[2], s[0]))


def _chains(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(first word, word after the last, covered template words) of the best chains of matches (text end, template end, words)."""
    found = sorted(set(found))
    chain: list[tuple[int, int]] = []  # for each match the first word of its best chain, and what that covers
    used = set()
    for i, (te, pe, n) in enumerate(found):
        best, begin, by = n, te - n, -1
        for j in range(i - 1, -1, -1):
            tj, pj, _ = found[j]
            if te - n - tj > MAX_GAP:
                if te - tj > MAX_GAP + 4 * n + 64:
                    break
                continue
            if tj < te and pj < pe:
                gain = min(n, te - tj, pe - pj)  # of the match only what lies beyond the one before
                if chain[j][1] + gain > best:
                    best, begin, by = chain[j][1] + gain, chain[j][0], j
        chain.append((begin, best))
        if by >= 0:
            used.add(by)
    return [(chain[i][0], found[i][0], chain[i][1]) for i in range(len(found)) if i not in used]


def scan(df: DataFrame, templates: Sequence[tuple[str, str]] | None = None, phrases: Sequence[tuple[str, str]] = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """With all known templates unless others are given: (id_col, n_words, phrase_labels and phrase_words: arrays of the places' labels and first words, cover map<label, coverage>,
    spans array<struct<label, first, after, cover>>), a row for each of df's."""
    prepare(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    templates, phrases = tuple(known_templates() if templates is None else templates), tuple(phrases)
    key, shared = ("licences", hash((templates, phrases))), df.sparkSession.sparkContext.broadcast((templates, phrases))
    span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("after", pa.int64()), ("cover", pa.float64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scanner = held(key, lambda: Scanner(*shared.value))
        got = scanner.scan(texts(batch))
        return pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                pa.array([x[0] for x in got], pa.int64()),
                pa.array([[scanner.phrases[k][0] for k, _ in x[1]] for x in got], pa.list_(pa.string())),
                pa.array([[w for _, w in x[1]] for x in got], pa.list_(pa.int64())),
                pa.array([list(x[2].items()) for x in got], pa.map_(pa.string(), pa.float64())),
                pa.array([[dict(zip(("label", "first", "after", "cover"), s, strict=True)) for s in x[3]] for x in got], pa.list_(span)),
            ],
            names=["id", "n_words", "phrase_labels", "phrase_words", "cover", "spans"],
        )

    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_words long, phrase_labels array<string>, phrase_words array<long>, cover map<string,double>, spans array<struct<label:string,first:long,after:long,cover:double>>"
    return map_arrow(rows, run, schema, "licences").withColumnRenamed("id", id_col)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan all documents; the score is the best coverage, 1 where a phrase stands whole."""
    found = scan(table(spark, sf_dir, "documents"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("phrase_words").cast("long").alias("n_base"),
        F.array_min("phrase_words").alias("first_word"),
        F.array_max("phrase_words").alias("last_word"),
        joined(F.col("phrase_labels")).alias("base_labels"),
        joined(F.concat("phrase_labels", F.map_keys("cover"))).alias("labels"),
        F.when(F.size("phrase_words") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.map_values("cover")), F.lit(0.0))).alias("score"),
        F.transform("spans", lambda s: F.struct(s["label"].alias("label"), s["first"].alias("first"), s["after"].alias("after"))).alias("spans"),
    )
