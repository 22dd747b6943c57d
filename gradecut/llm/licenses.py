"""License scan: MinHash bands over overlapping text windows, verified by exact containment.

Texts and templates are lower-cased words in shingles of ``SHINGLE`` (five; a shorter template
is one shingle of all its words). For a template of n shingles a text is cut into windows of 2 n
shingles that begin every n, so that every passage as long as the template lies whole in one. A
window's MinHash signature is held against the template's in ``BANDS`` bands of ``ROWS`` rows.
A window that contains four fifths of the template has a Jaccard similarity of at least
0.8 / 2.2, for which one band agrees with probability over 0.9998; that of a window that holds
the whole template is over 0.9999999. The bands of all templates of one length are in one table from a band and its
values to templates; a window is signed once and looks its bands up there, whatever the number of
templates. Each template retrieved is verified: it is found if at least ``CONTAINMENT`` of its distinct
shingles occur in the window. Windows that share no shingle with any template of their length
are not signed, for their similarity is zero and no band could retrieve one.

Windows of one template that overlap and pass are one finding, from its first to its last
shingle of the template, with the largest containment.

Null, empty and wordless texts have no finding, whole texts are scanned. Repeated rows are
scanned alike, templates with equal shingles are both found; other columns are ignored.
"""

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradecut.llm.common import arrow_column

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 64
ROWS = 2
SEED = 20_240_601

FINDINGS = "array<struct<license:string,containment:double,start:int,stop:int>>"

# Notices as the licenses' publishers give them.
TEMPLATES = (
    ("Apache-2.0 line", "Licensed under the Apache License, Version 2.0"),
    (
        "Apache-2.0 notice",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License.",
    ),
    ("MIT line", "Released under the MIT License"),
    (
        "MIT notice",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software.",
    ),
    ("GPL-3.0 line", "This work is licensed under the GNU General Public License, version 3"),
    (
        "GPL-3.0 notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    ("CC-BY-NC-4.0 line", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0 line", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    (
        "CC-BY-SA-4.0 line",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    (
        "BSD notice",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
    (
        "MPL-2.0 notice",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "ISC notice",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("Unlicense line", "This is free and unencumbered software released into the public domain"),
    ("EPL-2.0 line", "made available under the terms of the Eclipse Public License 2.0"),
    ("BSL-1.0 line", "Distributed under the Boost Software License, Version 1.0"),
)

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    """Lower-case words."""
    return _WORD.findall(text.lower())


def shingles_of(words: list[str], size: int) -> np.ndarray:
    """64-bit hash of every run of ``size`` words."""
    runs = zip(*(words[i:] for i in range(size)), strict=False)
    return np.array([xxhash.xxh64_intdigest(" ".join(r).encode("utf-8", "replace")) for r in runs], np.uint64)


@dataclass(frozen=True)
class Template:
    """A license's distinct shingles, their size in words, and its MinHash signature."""

    name: str
    size: int
    length: int
    shingles: np.ndarray
    signature: np.ndarray


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED)
    count = BANDS * ROWS
    return draw.integers(0, 2**63, count, np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 2**63, count, np.uint64)


_FACTOR, _SHIFT = _multipliers()


def signature_of(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of a set of shingle hashes, one row for each band."""
    mixed = shingles[None, :] * _FACTOR[:, None] + _SHIFT[:, None]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    return mixed.min(axis=1).reshape(BANDS, ROWS)


def band_keys(signature: np.ndarray) -> list[int]:
    """One key for each band and its values."""
    mixed = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for values in signature.T:
        mixed = (mixed ^ values) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
    return mixed.tolist()


def make_templates(texts=TEMPLATES) -> list[Template]:
    """Templates from (name, text); those without words are left out."""
    out = []
    for name, text in texts:
        words = words_of(text)
        if not words:
            continue
        size = min(SHINGLE, len(words))
        every = shingles_of(words, size)
        out.append(Template(name, size, len(every), np.unique(every), signature_of(np.unique(every))))
    return out


class Scanner:
    """Scans texts for a list of templates."""

    def __init__(self, templates: list[Template]) -> None:
        self._templates = templates
        self._sizes = sorted({t.size for t in templates})
        # of each size and length: all shingles, and templates by band and its values
        self._tables: dict[tuple[int, int], tuple[np.ndarray, dict[int, list[int]]]] = {}
        for kind in sorted({(t.size, t.length) for t in templates}):
            mine = [i for i, t in enumerate(templates) if (t.size, t.length) == kind]
            table: dict[int, list[int]] = {}
            for i in mine:
                for key in band_keys(templates[i].signature):
                    table.setdefault(key, []).append(i)
            self._tables[kind] = np.unique(np.concatenate([templates[i].shingles for i in mine])), table

    def prepare(self, texts: tuple[tuple[str, str], ...]) -> "Scanner":
        """Take the words of the templates' texts, so that most texts are passed over by words alone."""
        self._starts = {size: set() for size in self._sizes}
        for template, (_, text) in zip(self._templates, texts, strict=True):
            words = words_of(text)
            runs = zip(*(words[i:] for i in range(template.size)), strict=False)
            self._starts[template.size].update(runs)
        self._first = {size: {r[:2] for r in runs} for size, runs in self._starts.items()}
        return self

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(license, containment, first word, word after the last) of every finding, in order."""
        words = words_of(text)
        out = []
        for size in self._sizes:
            if len(words) < size or self._first[size].isdisjoint(zip(words, words[1:], strict=False) if size > 1 else zip(words)):
                continue
            every = shingles_of(words, size)
            for (own, length), (known, table) in self._tables.items():
                if own == size:
                    hits = np.flatnonzero(np.isin(every, known))
                    if len(hits):
                        out += self._findings(length, table, every, hits)
        return sorted(out, key=lambda f: (f[2], f[0], f[3]))

    def _findings(self, n: int, table: dict[int, list[int]], every: np.ndarray, hits: np.ndarray):
        last = max(0, -(-(len(every) - 2 * n) // n))
        # only windows that hold a shingle of some template
        at = np.unique(np.concatenate([hits // n, hits // n - 1]))
        found: dict[int, list[list]] = {}
        for k in at[(at >= 0) & (at <= last)].tolist():
            window = every[k * n : k * n + 2 * n]
            retrieved = {i for key in band_keys(signature_of(np.unique(window))) for i in table.get(key, ())}
            for i in sorted(retrieved):
                template = self._templates[i]
                inside = np.isin(window, template.shingles)
                share = len(np.unique(window[inside])) / len(template.shingles)
                if share < CONTAINMENT:
                    continue
                places = np.flatnonzero(inside) + k * n
                start, stop = int(places[0]), int(places[-1]) + template.size
                mine = found.setdefault(i, [])
                if mine and k - mine[-1][0] == 1:
                    mine[-1] = [k, max(mine[-1][1], share), mine[-1][2], max(mine[-1][3], stop)]
                else:
                    mine.append([k, share, start, stop])
        return [(self._templates[i].name, share, start, stop) for i in sorted(found) for _, share, start, stop in found[i]]


def findings(text: Column, texts=TEMPLATES) -> Column:
    """Findings of the whole text as one array column."""

    def make():
        scanner = Scanner(make_templates(texts)).prepare([t for t in texts if words_of(t[1])])

        def apply(batch: pa.Array) -> pa.Array:
            found = [scanner.scan(t.as_py()) if t.is_valid else [] for t in batch]
            flat = [x for f in found for x in f]
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
            kinds = (pa.string(), pa.float64(), pa.int32(), pa.int32())
            columns = [pa.array([x[i] for x in flat], kind) for i, kind in enumerate(kinds)]
            values = pa.StructArray.from_arrays(columns, ["license", "containment", "start", "stop"])
            return pa.ListArray.from_arrays(pa.array(offsets), values)

        return apply

    return arrow_column(make, FINDINGS)(text)


def scan(documents: DataFrame, texts=TEMPLATES) -> DataFrame:
    """doc_id, findings and the number of findings of every row of ``documents`` (doc_id, text)."""
    found = documents.select("doc_id", findings(F.col("text"), texts).alias("findings"))
    return found.select("doc_id", F.size("findings").alias("n_findings"), "findings")
