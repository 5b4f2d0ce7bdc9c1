"""License scans by a positional index of rare template words.

The templates' words are counted over the corpus by distinct documents, which gives each its inverse document frequency.
A file's rarest template words (RARE of them) are looked up in the index of the templates' word positions; each posting
votes for a template at the offset between the two positions, so that the words of a licence that stand in the right
distances meet at one offset. An offset with votes of at least half the template's rare words is a candidate: its
mandatory key phrases are verified word by word at their places, and its score is the share of the template's weight that
stands in the file at that offset. Where words are put in or left out, such as a name or a year, the offset changes: then
chains of postings that grow in both positions, with small changes of the offset, are candidates, and phrases and score are
verified along a chain.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import documents

# Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# The words of public licences and their notices, by label, with the phrases that none may lack.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        ("apache license version 2 0", "distributed on an as is basis"),
    ),
    ("mit", "released under the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without
        restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
        PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License", ("gnu general public license",)),
    (
        "gpl-2.0-or-later",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2
        of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
        ("gnu general public license", "either version 2 of the license"),
    ),
    (
        "gpl-3.0-or-later",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3
        of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
        ("gnu general public license", "either version 3 of the license"),
    ),
    (
        "lgpl-2.1-or-later",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either
        version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY""",
        ("gnu lesser general public license", "version 2 1 of the license"),
    ),
    (
        "agpl-3.0-or-later",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either
        version 3 of the License, or (at your option) any later version.""",
        ("gnu affero general public license",),
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    (
        "bsd-2-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must
        retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
        ("redistribution and use in source and binary forms", "must reproduce the above copyright notice"),
    ),
    (
        "bsd-3-clause",
        """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written
        permission.""",
        ("may be used to endorse or promote products derived from this software",),
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
        notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE""",
        ("for any purpose with or without fee is hereby granted",),
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions""",
        ("permission is granted to anyone to use this software for any purpose",),
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code
        form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
        ("free and unencumbered software released into the public domain",),
    ),
    (
        "bsl-1.0",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to
        use, reproduce, display, distribute, execute, and transmit the Software""",
        ("to any person or organization obtaining a copy of the software",),
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    ("cc0-1.0", "dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", ("to the public domain worldwide",)),
    ("cc-by-4.0", "licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike 4 0",)),
    ("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
)
RARE, LEAST = 8, 0.7
#: Words that a file may have more or less than the template between two rare ones.
GAP = 12
# A-Z to lower case; ASCII but for digits and letters to spaces.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Words of the whole text, in UTF-8; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


def _split(text: str) -> list[bytes]:
    return words(text)


class TemplateIndex:
    """Word positions of the templates, with the words' weights."""

    def __init__(self, templates, weight: dict[bytes, float]):
        self.labels = [t[0] for t in templates]
        self.words = [_split(t[1]) for t in templates]
        self.phrases = []
        for _, text, phrases in templates:
            whole = _split(text)
            at = [next(k for k in range(len(whole)) if whole[k : k + len(p)] == p) for p in map(_split, phrases)]
            self.phrases.append([(k, _split(p)) for k, p in zip(at, phrases)])
        self.weight = weight
        self.total = [sum(weight[w] for w in t) for t in self.words]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, ws in enumerate(self.words):
            for k, w in enumerate(ws):
                self.postings[w].append((t, k))
        self.needs = [frozenset(w for _, p in ps for w in p) for ps in self.phrases]
        # Votes that a template can get at most from its own rarest words; half of them make a candidate.
        self.rare = [sorted(set(ws), key=lambda w: (-weight[w], w))[:RARE] for ws in self.words]
        self.votes = [max(1, sum(ws.count(w) for w in r) // 2) for ws, r in zip(self.words, self.rare)]

    def match(self, found: list[bytes], gap: int = GAP) -> tuple[set[str], float]:
        """Labels that are verified in a file, and the best score; gap: words that may be put in or left out between two rare ones."""
        have = set(found).intersection(self.postings)
        open_ = [t for t, need in enumerate(self.needs) if need <= have]
        if not open_:
            return set(), 0.0
        # The file's rarest template words, and for each template that is open its own rarest.
        look = set(sorted(have, key=lambda w: (-self.weight[w], w))[:RARE]).union(*(self.rare[t] for t in open_)) & have
        votes: Counter = Counter()
        points: dict[int, list[tuple[int, int]]] = {t: [] for t in open_}
        for i, w in enumerate(found):
            if w in look:
                for t, k in self.postings[w]:
                    votes[t, i - k] += 1
                    if t in points:
                        points[t].append((i, k))
        labels, best = set(), 0.0
        for (t, at), n in votes.items():
            if n < self.votes[t] or t not in points:
                continue
            score = self._score(t, found, [(0, 0, at)])
            if score >= LEAST:
                labels.add(self.labels[t])
                best = max(best, score)
        for t in open_ if gap else ():
            if len(points[t]) < self.votes[t]:
                continue
            for chain in _chains(points[t], self.votes[t], gap):
                score = self._score(t, found, chain)
                if score >= LEAST:
                    labels.add(self.labels[t])
                    best = max(best, score)
        return labels, min(1.0, best)

    def _score(self, t: int, found: list[bytes], steps: list[tuple[int, int, int]]) -> float:
        """The weight of the template's words that stand where a chain says, as a share; 0 if a mandatory phrase is nowhere in the chain.

        steps: the template places of the first and the last rare word at an offset, and the offset. Between two steps the offset
        changes where most weight is found.
        """
        ws, weight, n = self.words[t], self.weight, len(found)
        offsets = dict.fromkeys(d for *_, d in steps)
        for k, p in self.phrases[t]:
            if not any(k + d >= 0 and found[k + d : k + d + len(p)] == p for d in offsets):
                return 0.0
        at = lambda k, d: weight[ws[k]] if 0 <= k + d < n and found[k + d] == ws[k] else 0.0
        total, k = 0.0, 0
        for (_, last, d), (first, _, new) in zip(steps, steps[1:]):
            total += sum(at(x, d) for x in range(k, last + 1))
            gains = [0.0]
            for x in range(last + 1, first):
                gains.append(gains[-1] + at(x, d) - at(x, new))
            total += sum(at(x, new) for x in range(last + 1, first)) + max(gains)
            k = first
        return (total + sum(at(x, steps[-1][2]) for x in range(k, len(ws)))) / self.total[t]


def _chains(points: list[tuple[int, int]], least: int, gap: int) -> Iterator[list[tuple[int, int, int]]]:
    """Chains of at least so many points (place in the file, place in the template) that grow in both, their offsets never changing by more than gap, as steps for _score.

    A point goes on from the longest chain of those that end at an earlier template word, at its last place in the file. Chains
    on one offset are left out: those are found by their votes.
    """
    last: dict[int, tuple[int, int, int]] = {}  # by template word: length of the chain, its last point, that point's file place
    before: list[int] = []
    ends: dict[int, int] = {}
    for j, (i, k) in enumerate(points):
        longest, prior = 0, -1
        for k2, (length, j2, i2) in last.items():
            if k2 < k and i2 < i and abs((i - k) - (i2 - k2)) <= gap and length > longest:
                longest, prior = length, j2
        before.append(prior)
        old = last.get(k)
        if old is None or longest + 1 >= old[0] or i - old[2] > gap:
            last[k] = (longest + 1, j, i)
        if longest + 1 >= least:
            ends.pop(prior, None)
            ends[j] = longest + 1
    for j in ends:
        chain = []
        while j >= 0:
            chain.append(points[j])
            j = before[j]
        chain.reverse()
        steps = [(chain[0][1], chain[0][1], chain[0][0] - chain[0][1])]
        for i, k in chain[1:]:
            if i - k == steps[-1][2]:
                steps[-1] = (steps[-1][0], k, i - k)
            else:
                steps.append((k, k, i - k))
        if len(steps) > 1:
            yield steps


_PHRASES = [(_split(p), label) for p, label in BASE.items()]


def base_places(found: list[bytes]) -> list[tuple[int, str]]:
    """Starts and labels of the base phrases; all of them end in the same word."""
    out, i = [], -1
    try:
        while True:
            i = found.index(b"license", i + 1)
            for p, label in _PHRASES:
                if i + 1 >= len(p) and found[i + 1 - len(p) : i + 1] == p:
                    out.append((i + 1 - len(p), label))
    except ValueError:
        return out


def corpus_weights(docs: DataFrame, templates=TEMPLATES) -> dict[bytes, float]:
    """Inverse document frequencies of the templates' words over all documents; each executor counts, words are as many as in the templates."""
    vocabulary = sorted({w for t in templates for w in _split(t[1])})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, known = Counter(), frozenset(vocabulary)
        for batch in batches:
            for t in batch.column(0):
                seen.update(known.intersection(words(t.as_py())))
                seen[b""] += 1
        if seen:
            yield pa.RecordBatch.from_pydict({"w": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

    got = {bytes(w): n for w, n in docs.select("text").mapInArrow(count, "w binary, n long").groupBy("w").agg(F.sum("n")).collect()}
    return {w: math.log((got.get(b"", 0) + 2) / (got.get(w, 0) + 1)) for w in vocabulary}


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Counts, labels and score of each document; null and empty texts have no words, no labels and score 0."""
    index = TemplateIndex(templates, corpus_weights(docs, templates))

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1):
                found = words(t.as_py())
                base = base_places(found)
                own = {label for _, label in base}
                more, score = index.match(found)
                starts = [at for at, _ in base]
                rows.append((len(found), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | more)), score))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], names=[x.split()[0] for x in _SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(matched, _SCHEMA)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for each document.

    Null and empty texts have no words, no places (null first_word and last_word), empty labels and score 0. Labels of equal
    score stand side by side; a template's label that is a base one too comes once. An empty table gives no rows.
    """
    return scan(documents(spark, sf_dir))
