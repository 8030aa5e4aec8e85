"""License scans with a generalised suffix automaton of licence tokens.

The automaton accepts every word sequence that occurs in some template. A file's words stream through it
once; at each word it yields the length of the longest suffix read so far that occurs in a template (the
matching statistics). Maximal matches of a few words and more are chained, by template, into spans whose
covered words decide which licences a file carries.

Cases: null text counts as empty; an empty text has no words, null positions, empty labels and score 0;
very long texts stream in one pass and cost memory in proportion to their words; repeated rows are each
answered; columns other than the id and the text are ignored, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import bisect
import functools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, raw, small_batches

#: Fixed values of the query contract: phrases whose places are counted, and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_TWO = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission."
)


def _gnu(name: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by "
        f"the Free Software Foundation, either version {version} of the License, or (at your option) any later version"
    )


#: Licence texts and notices as published, one or more a label. Punctuation and case are dropped when they are read.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        _MIT_GRANT,
        _MIT_GRANT + ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "apache-2": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions "
        "and limitations under the License.",
    ],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0": ["To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work"],
    "gpl-3": ["This work is licensed under the GNU General Public License, version 3.", _gnu("General Public License", "3")],
    "gpl-2": [_gnu("General Public License", "2")],
    "lgpl-3": [_gnu("Lesser General Public License", "3")],
    "agpl-3": [_gnu("Affero General Public License", "3")],
    "bsd-2": [f"{_BSD_GRANT}: {_BSD_TWO}"],
    "bsd-3": [f"{_BSD_GRANT}: {_BSD_TWO} {_BSD_THIRD}", _BSD_THIRD],
    "mpl-2": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ],
    "zlib": [
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions"
    ],
}

#: Lower-cases A-Z; whatever isn't 0-9, a-z or a byte of a non-ASCII character parts words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


@dataclass
class Automaton:
    """Generalised suffix automaton over word ids. where: for each state and template, the ends of all occurrences."""

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    where: list[dict[int, set[int]]] = field(default_factory=lambda: [{}])

    def _state(self, length: int, nxt: dict, link: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.where.append({})
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def add(self, sequence: list[int], template: int) -> None:
        last = 0
        for end, c in enumerate(sequence, 1):
            q = self.next[last].get(c)
            if q is not None:  # a template read earlier has this prefix
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
            else:
                new, p = self._state(self.length[last] + 1, {}, 0), last
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][c]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
                last = new
            self.where[last].setdefault(template, set()).add(end)

    def finish(self) -> None:
        """A state's occurrences are those of its longer extensions too."""
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            for t, ends in self.where[s].items():
                self.where[self.link[s]].setdefault(t, set()).update(ends)


@dataclass
class Model:
    vocabulary: dict[bytes, int]
    automaton: Automaton
    labels: list[str]
    sizes: list[int]
    phrases: list[tuple[list[int], str]]

    @functools.cached_property
    def reach(self) -> int:
        return max(self.sizes, default=0)


@functools.lru_cache(maxsize=8)
def model(templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...]) -> Model:
    vocabulary: dict[bytes, int] = {}
    ids = lambda text: [vocabulary.setdefault(w, len(vocabulary)) for w in words(text.encode())]
    automaton, labels, sizes = Automaton(), [], []
    for label, text in templates:
        sequence = ids(text)
        automaton.add(sequence, len(labels))
        labels.append(label)
        sizes.append(len(sequence))
    automaton.finish()
    return Model(vocabulary, automaton, labels, sizes, [(ids(p), label) for p, label in phrases])


def maximal_matches(a: Automaton, ids: list[int], at: int, least: int) -> list[tuple[int, int, int]]:
    """(start, end, state) of the matches that can't be prolonged to either side, from the matching statistics."""
    out, state, size = [], 0, 0
    nxt, link, length = a.next, a.link, a.length
    for i, c in enumerate(ids):
        grown = nxt[state].get(c)
        if grown is None:
            if size >= least:
                out.append((at + i - size, at + i, state))
            while state > 0 and c not in nxt[state]:
                state = link[state]
                size = length[state]
            grown = nxt[state].get(c)
            if grown is None:
                state, size = 0, 0
                continue
        state, size = grown, size + 1
    if size >= least:
        out.append((at + len(ids) - size, at + len(ids), state))
    return out


def chains(m: Model, matches: list[tuple[int, int, int]], gap: int) -> list[tuple[int, float, int, int]]:
    """(template, covered share, start, end): the best chains of matches that follow one another in text and template, few words apart.

    Every occurrence of a match in the template may take part; the chain that covers most of the template's words is
    found by dynamic programming, then the best of what it leaves.
    """
    by: dict[int, list[tuple[int, int, int]]] = {}
    for start, end, state in matches:
        for t, ends in m.automaton.where[state].items():
            by.setdefault(t, []).extend((start, end, at) for at in ends)
    out = []
    for t, found in by.items():
        found.sort()
        best, before = [], []
        for j, (start, end, at) in enumerate(found):
            size, back = end - start, -1
            total = size
            for i in range(j - 1, -1, -1):
                s, e, a = found[i]
                if s < start - m.reach - gap:
                    break  # no match is longer than the longest template
                if s < start and e < end and start <= e + gap and a - (e - s) < at - size and a < at and at - size <= a + gap:
                    more = best[i] + size - max(0, e - start, a - (at - size))
                    if more > total:
                        total, back = more, i
            best.append(total)
            before.append(back)
        taken: set[int] = set()
        begins = [f[0] for f in found]
        for j in sorted(range(len(found)), key=lambda j: (-best[j], found[j])):
            if j in taken:
                continue
            chain, i = [j], before[j]
            while i >= 0 and i not in taken:
                chain.append(i)
                i = before[i]
            taken.update(chain)
            first, last = found[chain[-1]], found[j]
            covered = best[j] - (best[i] - max(0, found[i][1] - first[0], found[i][2] - (first[2] - first[1] + first[0])) if i >= 0 else 0)
            out.append((t, covered / m.sizes[t], first[0], last[1]))
            # what stands inside this chain's words is no chain of its own
            taken.update(k for k in range(bisect.bisect_left(begins, first[0]), bisect.bisect_left(begins, last[1])) if found[k][1] <= last[1])
    return out


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,covered:double>>"


def scan_licenses(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None, min_match: int = 3,
    max_gap: int = 4, min_covered: float = 0.75,
) -> DataFrame:
    """One row a document: words, places of the base phrases, labels, score and licence spans in words."""
    small_batches(docs.sparkSession)
    key_t = tuple((k, t) for k, v in (templates or TEMPLATES).items() for t in v)
    key_p = tuple((phrases or BASE_PHRASES).items())
    kind = docs.schema[id_col].dataType
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())]))

    def scan(batches):
        m = model(key_t, key_p)
        get = m.vocabulary.get
        for b in batches:
            schema = pa.schema([("id", b.schema.field(0).type), *((n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", span)])
            cols: dict[str, list] = {f.name: [] for f in schema if f.name != "id"}
            for text in raw(b.column(1)):
                found = words(text)
                ids = np.fromiter((get(w, -1) for w in found), np.int32, len(found))
                places, base = [], set()
                for phrase, label in m.phrases:
                    if len(ids) < len(phrase):
                        continue
                    hit = np.flatnonzero(ids[: len(ids) - len(phrase) + 1] == phrase[0])
                    for j, c in enumerate(phrase[1:], 1):
                        hit = hit[ids[hit + j] == c]
                    if len(hit):
                        places.append(hit)
                        base.add(label)
                known = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
                best, spans = 1.0 if base else 0.0, []
                matches = []
                for start, end in known.reshape(-1, 2)[np.diff(known.reshape(-1, 2), axis=1)[:, 0] >= min_match].tolist():
                    matches += maximal_matches(m.automaton, ids[start:end].tolist(), start, min_match)
                for t, covered, start, end in chains(m, matches, max_gap):
                    best = max(best, min(covered, 1.0))
                    if covered >= min_covered:
                        spans.append({"label": m.labels[t], "start": start, "end": end, "covered": min(covered, 1.0)})
                cols["n_words"].append(len(found))
                cols["n_base"].append(sum(map(len, places)))
                cols["first_word"].append(min((int(p[0]) for p in places), default=None))
                cols["last_word"].append(max((int(p[-1]) for p in places), default=None))
                cols["base_labels"].append(",".join(sorted(base)))
                cols["labels"].append(",".join(sorted(base | {s["label"] for s in spans})))
                cols["score"].append(best)
                cols["spans"].append(spans)
            yield pa.RecordBatch.from_arrays([b.column(0), *batch(pa.schema(list(schema)[1:]), **cols).columns], schema=schema)

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, f"id {kind.simpleString()}, {SCHEMA}")
    return out.withColumnRenamed("id", id_col)
