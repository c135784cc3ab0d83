"""License scans with a generalised suffix automaton of licence tokens.

The automaton holds the words of all templates and phrases. A document's words stream through it; the state after
each word gives the matching statistic: the longest run of words ending there that some template holds. Long matches
are chained in template order into spans, and a span that covers enough of its template gives the template's label.
A word that no template has resets the automaton, so only runs of known words are streamed at all.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import map_text

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# The base phrases and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Passages of public licences and notices, as their texts have them.
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY",
        "Released under the MIT License",
        "Licensed under the MIT License",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    ],
    "bsd-3": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "apache-2": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Licensed under the Apache License, Version 2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
        "each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form",
    ],
    "gpl": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details"],
    "mpl-2": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "zlib": [
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    ],
    "bsl-1": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "all-rights-reserved": [
        "All rights reserved",
        "No part of this publication may be reproduced without the prior written permission of the copyright holder",
    ],
}

# The GNU licences with their versions and the Creative Commons licences with theirs, as notices name them.
GNU = {"gpl": ("program", "GNU General Public License", ("1", "2", "3")), "lgpl": ("library", "GNU Lesser General Public License", ("2", "2.1", "3")), "agpl": ("program", "GNU Affero General Public License", ("3",))}
CREATIVE_COMMONS = {
    "cc-by": "Attribution",
    "cc-by-sa": "Attribution-ShareAlike",
    "cc-by-nc": "Attribution-NonCommercial",
    "cc-by-nd": "Attribution-NoDerivatives",
    "cc-by-nc-sa": "Attribution-NonCommercial-ShareAlike",
    "cc-by-nc-nd": "Attribution-NonCommercial-NoDerivatives",
}
CC_VERSIONS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
# Words that tell variants of a licence apart, besides numbers.
VARIANTS = frozenset(b"noderivatives noderivs noncommercial sharealike nd nc sa lesser affero".split())


def all_templates() -> dict[str, list[str]]:
    """TEMPLATES, and for each version the notices of the GNU and Creative Commons licences."""
    found = {label: list(texts) for label, texts in TEMPLATES.items()}
    for name, (what, title, versions) in GNU.items():
        for v in versions:
            found.setdefault(f"{name}-{v}", []).extend([
                f"This {what} is free software; you can redistribute it and/or modify it under the terms of the {title} as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version",
                f"{title}, version {v}",
                f"{title} v{v}",
            ])
    for label, name in CREATIVE_COMMONS.items():
        for v, place in CC_VERSIONS.items():
            found.setdefault(label, []).extend([f"Creative Commons {name} {v} {place}", f"Creative Commons {name.replace('NoDerivatives', 'NoDerivs')} {v} {place}", f"Licensed under {label.replace('-', ' ', 1).upper()} {v}"])
    return {label: list(dict.fromkeys(texts)) for label, texts in found.items()}


def tells_apart(word: bytes) -> bool:
    """Whether a word is one by which variants or versions of a licence differ."""
    return word in VARIANTS or word.removeprefix(b"v").isdigit()


#: Words that a match must have to be chained, share of a template that a span must cover, and words of the document that may lie between two of its matches.
LEAST_MATCH, COVERED, GAP = 3, 0.8, 6


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, list[str]]):
        self.phrases = list(phrases.items())
        self.templates = [(label, WORD.findall(t.lower().encode())) for label, texts in templates.items() for t in texts]
        self.vocabulary: dict[bytes, int] = {}
        texts = [WORD.findall(p.encode()) for p in phrases] + [words for _, words in self.templates]
        self.codes = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words] for words in texts]
        self.go: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: per state, for each text that holds its strings: where they end in it, all places
        self.ends: list[dict[int, set[int]]] = [{}]
        for t, words in enumerate(self.codes):
            self._add(t, words)
        for state in sorted(range(len(self.go)), key=lambda s: -self.length[s]):
            up = self.link[state]
            if up > 0:
                for t, e in self.ends[state].items():
                    self.ends[up].setdefault(t, set()).update(e)
        self.places = [{t: sorted(e) for t, e in ends.items()} for ends in self.ends]
        #: per state: the base phrases that are suffixes of its longest string, with their lengths
        n = len(self.phrases)
        whole = [self._walk(words) for words in self.codes[:n]]
        self.suffixes: list[list[tuple[int, int]]] = []
        for state in range(len(self.go)):
            found, s = [], state
            while s > 0:
                found += [(p, len(self.codes[p])) for p in range(n) if whole[p] == s]
                s = self.link[s]
            self.suffixes.append(found)
        #: per template: how many of its first words tell variants apart, and which words do
        self.tells = [[tells_apart(w) for w in words] for _, words in self.templates]
        self.told = [[0, *accumulate(map(int, t))] for t in self.tells]
        #: per state: the templates that hold a string of it, or else a suffix of LEAST_MATCH words or more, with that one's length (0: the match's own) and places
        self.reach: list[list[tuple[int, int, list[int]]]] = []
        for state in range(len(self.go)):
            found, s, seen = [], state, set()
            while s > 0 and (s == state or self.length[s] >= LEAST_MATCH):
                for t, stops in self.places[s].items():
                    if t >= n and t not in seen:
                        seen.add(t)
                        found.append((t - n, 0 if s == state else self.length[s], stops))
                s = self.link[s]
            self.reach.append(found)
        self.shortest = min([LEAST_MATCH, *(len(words) for words in self.codes[:n])])

    def _walk(self, words: list[int]) -> int:
        state = 0
        for c in words:
            state = self.go[state][c]
        return state

    def _state(self, length: int) -> int:
        self.go.append({})
        self.link.append(0)
        self.length.append(length)
        self.ends.append({})
        return len(self.go) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        new = self._state(self.length[p] + 1)
        self.go[new], self.link[new] = dict(self.go[q]), self.link[q]
        self.link[q] = new
        while p >= 0 and self.go[p].get(c) == q:
            self.go[p][c] = new
            p = self.link[p]
        return new

    def _add(self, text: int, words: list[int]) -> None:
        """Extend the automaton by one more text, starting again from its start state."""
        last = 0
        for at, c in enumerate(words):
            p = last
            if c in self.go[p]:
                q = self.go[p][c]
                last = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
            else:
                last = self._state(self.length[p] + 1)
                while p >= 0 and c not in self.go[p]:
                    self.go[p][c] = last
                    p = self.link[p]
                if p >= 0:
                    q = self.go[p][c]
                    self.link[last] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
            self.ends[last].setdefault(text, set()).add(at + 1)

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], list[tuple[str, int, int, float]]]:
        """Number of words, base places (phrase, first word), spans (label, first word, last word, share covered)."""
        words = WORD.findall(text.lower())
        codes = list(map(self.vocabulary.get, words))
        places: list[tuple[int, int]] = []
        matches: list[tuple[int, int, int]] = []  # end in the document, length, state
        go, link, length, suffixes = self.go, self.link, self.length, self.suffixes
        at, n = 0, len(codes)
        while at < n:
            if codes[at] is None:
                at += 1
                continue
            end = at + 1
            while end < n and codes[end] is not None:
                end += 1
            if end - at >= self.shortest:
                state = held = 0
                for i in range(at, end):
                    c = codes[i]
                    if c in go[state]:
                        state, held = go[state][c], held + 1
                    else:
                        if held >= LEAST_MATCH:
                            matches.append((i, held, state))
                        while state and c not in go[state]:
                            state = link[state]
                            held = length[state]
                        if c in go[state]:
                            state, held = go[state][c], held + 1
                    for p, size in suffixes[state]:
                        if held >= size:
                            places.append((p, i + 1 - size))
                if held >= LEAST_MATCH:
                    matches.append((end, held, state))
            at = end
        return n, places, self._chain(matches, words)

    def _chain(self, matches: list[tuple[int, int, int]], words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """Chain matches of each template, in order in both texts and close together; keep what covers enough of it.

        A chain goes on at the nearest later place of a match in the template, and begins at the first one. All words
        of a template that tell variants apart must be covered, and none may stand in a gap of the document: an
        Attribution-NoDerivatives licence is no Attribution licence with a word too many. Of spans of different labels
        that overlap by more than half of one, those that cover fewest words go.
        """
        open_: dict[int, list[int]] = {}  # template: first word, end in the document, end in the template, words covered, telling words covered
        spans = []

        def close(t: int) -> None:
            first, end, _, covered, told = open_.pop(t)
            share = covered / len(self.tells[t])
            if share >= COVERED and told == self.told[t][-1]:
                spans.append((self.templates[t][0], first, end - 1, min(1.0, share), covered))

        def breaks(t: int, upto: int, gap: list[bytes]) -> bool:
            """Whether a gap of the document, after so many words of a template, makes it another licence."""
            number = (upto > 0 and self.tells[t][upto - 1]) or (upto < len(self.tells[t]) and self.tells[t][upto])
            return any(w in VARIANTS or (number and tells_apart(w)) for w in gap)

        for end, whole, state in matches:
            for t, part, stops in self.reach[state]:
                size = part or whole
                begin, told = end - size, self.told[t]
                if t in open_:
                    _, before, upto, covered, known = open_[t]
                    stop = next((x for x in stops if x > upto and x - size >= upto - size // 2), None)
                    near = begin - before <= GAP
                    if near and stop is not None and not breaks(t, upto, words[before:begin]):
                        open_[t][1:] = [end, stop, covered + stop - max(stop - size, upto), known + told[stop] - told[max(stop - size, upto)]]
                        continue
                    if covered >= size and near and stop is None:
                        continue  # a lesser match beside the chain
                    close(t)
                open_[t] = [begin, end, stops[0], size, told[stops[0]] - told[stops[0] - size]]
        for t in list(open_):
            close(t)
        return sorted({s[:4] for s in self._best(spans)}, key=lambda s: (s[1], s[2], s[0]))

    @staticmethod
    def _best(spans: list[tuple[str, int, int, float, int]]) -> list[tuple]:
        """The spans that none of another label with more words covers by more than half. Such a one holds the middle of
        the other, and few hold any one word, as those of a template follow one another: one sweep finds them."""
        middle = lambda s: (s[1] + s[2]) // 2
        starts = sorted(spans, key=lambda s: s[1])
        there: list[tuple] = []
        kept, at = [], 0
        for s in sorted(spans, key=middle):
            m = middle(s)
            while at < len(starts) and starts[at][1] <= m:
                there.append(starts[at])
                at += 1
            there = [o for o in there if o[2] >= m]
            if not any(o[0] != s[0] and o[4] > s[4] and 2 * (min(s[2], o[2]) - max(s[1], o[1]) + 1) > s[2] - s[1] + 1 for o in there):
                kept.append(s)
        return kept


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner(BASE_PHRASES, all_templates())


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Words are lower-cased and numbered from 0. ``n_base`` counts every place of a base phrase; first_word and
    last_word are the smallest and largest start of one, null without any. ``labels`` adds the labels of the covered
    spans (label, first_word, last_word, share). ``score`` is 1 where a base phrase stands, else the largest share of a
    template that a span covers, else 0. A null text has no words and labels, which are then empty strings. A null
    key stays null, repeated rows repeat, other columns are left aside, an empty table gives an empty result.
    """

    def run(columns: list[pa.Array], texts: list[bytes]) -> pa.RecordBatch:
        scan = scanner()
        rows = []
        for k, t in zip(columns[0].to_pylist(), texts, strict=True):
            n, places, spans = scan.scan(t)
            starts = [s for _, s in places]
            base = {scan.phrases[p][1] for p, _ in places}
            rows.append(
                {
                    "k": k,
                    "n_words": n,
                    "n_base": len(places),
                    "first_word": min(starts, default=None),
                    "last_word": max(starts, default=None),
                    "base_labels": ",".join(sorted(base)),
                    "labels": ",".join(sorted(base | {s[0] for s in spans})),
                    "score": 1.0 if places else max((s[3] for s in spans), default=0.0),
                    "spans": [{"label": s[0], "first_word": s[1], "last_word": s[2], "share": s[3]} for s in spans],
                }
            )
        return pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    schema = "k bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,first_word:bigint,last_word:bigint,share:double>>"
    return map_text(docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).cast("binary").alias("t")), run, schema).withColumnRenamed("k", key)


_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("share", pa.float64())])
_ARROW = pa.schema(
    [(c, pa.int64()) for c in ("k", "n_words", "n_base", "first_word", "last_word")] + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN))]
)
