"""License notices found by MinHash bands over overlapping windows of words.

Templates and documents are cut to lower-case words without edge punctuation and hashed in runs of
five. Templates are classed by the power of two L that holds their n runs, so n > L / 2. For L of 8 and
more a document is covered by windows of 2 L runs that overlap by half, for shorter templates by
windows of L runs at every place; each occurrence lies whole in some window. A window and a
template are a candidate if one of the single-row bands agrees. An occurrence with at least 0.8 of
the template's runs then has a Jaccard likeness of at least 0.22 to its window, and 64 bands miss it
with a chance of (1 - 0.22) ** 64, about one in ten million; for short templates it is at least 0.75, and
12 bands miss it as rarely. Candidates are checked by exact containment of the template's runs.
Templates of under five words have no run; they are looked for as a whole, word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from importlib.resources import files

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.words import distinct, slices, split_words

SHINGLE = 5
CONTAINED = 0.8
BANDS = 64
SHORT_BANDS = 12
BASE = 8
SEED = 5
NOTHING = np.uint64(0xFFFFFFFFFFFFFFFF)

#: Wording of public license notices.
TEMPLATES = {
    "AGPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version."
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software"
        " distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY"
        " KIND, either express or implied. See the License for the specific language governing permissions and"
        " limitations under the License."
    ),
    "BSD-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met"
    ),
    "BSD-disclaimer": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED"
        " WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR"
        " PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,"
        " INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"
    ),
    "BSD-source-clause": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following"
        " disclaimer"
    ),
    "BSD-binary-clause": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the"
        " following disclaimer in the documentation and/or other materials provided with the distribution"
    ),
    "BSD-name-clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
        " products derived from this software without specific prior written permission"
    ),
    "CC-BY-3.0-long": "This work is licensed under a Creative Commons Attribution 3.0 Unported License",
    "CC-BY-SA-3.0-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC0-1.0-waiver": "has waived all copyright and related or neighboring rights to this work",
    "EPL-2.0-header": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"
        " which is available at"
    ),
    "GPL-2.0-or-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation; either version 2 of the License, or (at your"
        " option) any later version."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version."
    ),
    "LGPL-2.1-or-later": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General"
        " Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your"
        " option) any later version."
    ),
    "LGPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version."
    ),
    "MIT": "Released under the MIT License",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without"
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
        " Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}

#: Notices of under five words.
SHORT_TEMPLATES = {"all-rights-reserved": "All rights reserved."} | {
    f"SPDX-{name}": f"SPDX-License-Identifier: {name}"
    for name in (
        "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "EPL-2.0",
        "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only",
        "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense",
    )
}


def full_texts() -> dict[str, str]:
    """Public texts of whole licenses, from the files of the package."""
    found = [f for f in files("shelfcast.llm").joinpath("licenses").iterdir() if f.name.endswith(".txt")]
    return {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in found}


_EDGES = re.compile(r"^\W+|\W+$")


def plain(word: bytes) -> str:
    return _EDGES.sub("", word.decode().lower())


def plain_words(text: str) -> list[str]:
    """Words of a text as they are compared; words of punctuation alone go."""
    return [p for w in text.encode().split() if (p := plain(w))]


def runs_of(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)} or ({tuple(words)} if words else set())


_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(SHINGLE)], np.uint64)


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode(), SEED)


def run_hashes(hashes: np.ndarray) -> np.ndarray:
    """Hash of every run of SHINGLE words."""
    n = len(hashes) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out += hashes[k : k + n] * _FACTORS[k]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def permutations(count: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, count, dtype=np.uint64)


class Catalog:
    """Templates by class: the least power of two that holds a template's runs."""

    def __init__(self, templates: Mapping[str, str], bands: int = BANDS):
        self.names = sorted(templates)
        self.a, self.b = permutations(bands)
        self.runs, self.classes, self.whole = [], {}, []
        for t, name in enumerate(self.names):
            words = plain_words(templates[name])
            if not words:
                raise ValueError(f"template {name} has no words")
            self.runs.append(runs_of(words))
            words = np.array([word_hash(w) for w in words], np.uint64)
            if len(words) < SHINGLE:
                self.whole.append((t, words))
                continue
            hashes = run_hashes(words)
            size = 1 << (len(hashes) - 1).bit_length()
            self.classes.setdefault(size, []).append((t, self.least(hashes)))
        self.tables = {}
        for size, held in self.classes.items():
            rows = np.array([m for _, m in held])
            order = np.argsort(rows, axis=0, kind="stable")
            self.tables[size] = (
                np.array([t for t, _ in held]), np.take_along_axis(rows, order, 0), order,
            )

    def least(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes[:, None] * self.a + self.b).min(axis=0)

    def block_minima(self, hashes: np.ndarray, crossing: np.ndarray) -> np.ndarray:
        """Least values of every BASE runs in a row; runs that cross two texts don't count."""
        blocks = -(-len(hashes) // BASE)
        out = np.empty((blocks, len(self.a)), np.uint64)
        step = 256
        for at in range(0, blocks, step):
            part = slice(at * BASE, min((at + step) * BASE, len(hashes)))
            values = hashes[part, None] * self.a + self.b
            values[crossing[part]] = NOTHING
            if len(values) % BASE:
                fill = np.full((BASE - len(values) % BASE, len(self.a)), NOTHING)
                values = np.concatenate([values, fill])
            out[at : at + step] = values.reshape(-1, BASE, len(self.a)).min(axis=1)
        return out

    def agreeing(self, size: int, windows: np.ndarray) -> list[tuple[int, int]]:
        """Pairs (window, template of the class) that share a band."""
        templates, rows, order = self.tables[size]
        seen = set()
        for k in range(windows.shape[1]):
            low = np.searchsorted(rows[:, k], windows[:, k], side="left")
            hit = np.flatnonzero(rows[np.minimum(low, len(rows) - 1), k] == windows[:, k])
            for w in hit.tolist():
                j = int(low[w])
                while j < len(rows) and rows[j, k] == windows[w, k]:
                    seen.add((w, int(templates[order[j, k]])))
                    j += 1
        return sorted(seen)

    def candidates(self, hashes: np.ndarray, crossing: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(template, first run, last run + 1) of windows that share a band with a template."""
        if not len(hashes) or not self.tables:
            return
        if min(self.tables) < BASE:
            yield from self._short(hashes, crossing)
        minima, size = self.block_minima(hashes, crossing), BASE
        nothing = np.full((1, minima.shape[1]), NOTHING)
        while size <= max(self.tables):
            if size in self.tables:
                for w, t in self.agreeing(size, np.minimum(minima, np.concatenate([minima[1:], nothing]))):
                    yield t, w * size, min((w + 2) * size, len(hashes))
            if len(minima) % 2:
                minima = np.concatenate([minima, nothing])
            minima = np.minimum(minima[::2], minima[1::2])
            size *= 2

    def whole_places(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(template, first word, last word + 1) of word hashes that agree with a template of under SHINGLE words."""
        for t, wanted in self.whole:
            at = np.flatnonzero(words[: max(0, len(words) - len(wanted) + 1)] == wanted[0])
            for k in range(1, len(wanted)):
                at = at[words[at + k] == wanted[k]]
            for low in at.tolist():
                yield t, low, low + len(wanted)

    def _short(self, hashes: np.ndarray, crossing: np.ndarray) -> Iterator[tuple[int, int, int]]:
        step = 1 << 16
        for at in range(0, len(hashes), step):
            part = slice(at, min(at + step + BASE, len(hashes)))
            values = hashes[part, None] * self.a[:SHORT_BANDS] + self.b[:SHORT_BANDS]
            values[crossing[part]] = NOTHING
            size = 1
            while size < BASE:
                if size in self.tables:
                    for w, t in self.agreeing(size, values[:step]):
                        yield t, at + w, min(at + w + size, len(hashes))
                tail = np.full((min(size, len(values)), values.shape[1]), NOTHING)
                values = np.minimum(values, np.concatenate([values[size:], tail]))
                size *= 2


_CATALOGS: dict[tuple, Catalog] = {}


def scan_texts(texts: pa.Array, catalog: Catalog, contained: float = CONTAINED) -> list[list[tuple[str, float, int, int]]]:
    """For each text its notices: (template, containment, first word, word after the last), best window each."""
    split = split_words(texts)
    codes, entries = distinct(split.words)
    words = [plain(w) for w in entries]
    full = np.array([bool(w) for w in words], bool)
    table = np.array([word_hash(w) for w in words], np.uint64)
    kept = np.flatnonzero(full[codes]) if len(codes) else np.zeros(0, np.int64)
    codes, owner = codes[kept], split.owners()[kept]
    first = np.searchsorted(kept, split.first)
    placed = table[codes] if len(codes) else np.zeros(0, np.uint64)
    hashes = run_hashes(placed)
    crossing = owner[: len(hashes)] != owner[SHINGLE - 1 :][: len(hashes)]
    best: list[dict[str, tuple[float, int, int]]] = [{} for _ in range(len(texts))]
    for t, low, high in catalog.candidates(hashes, crossing):
        high += SHINGLE - 1
        for text in np.unique(owner[low:high]).tolist():
            a, b = max(low, int(first[text])), min(high, int(first[text + 1]))
            inside = [words[c] for c in codes[a:b].tolist()]
            hits = [i for i in range(len(inside) - SHINGLE + 1) if tuple(inside[i : i + SHINGLE]) in catalog.runs[t]]
            share = len({tuple(inside[i : i + SHINGLE]) for i in hits}) / len(catalog.runs[t])
            if share >= contained:
                at = a - int(first[text])
                # The better share, then the earlier place.
                new = (share, at + hits[0], at + hits[-1] + SHINGLE)
                old = best[text].get(catalog.names[t])
                if old is None or (-new[0], new[1]) < (-old[0], old[1]):
                    best[text][catalog.names[t]] = new
    for t, low, high in catalog.whole_places(placed):
        text = int(owner[low])
        if owner[high - 1] == text and tuple(words[c] for c in codes[low:high].tolist()) in catalog.runs[t]:
            at = low - int(first[text])
            best[text].setdefault(catalog.names[t], (1.0, at, at + high - low))
    return [[(n, *found[n]) for n in sorted(found)] for found in best]


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, notices as array of (license, containment, first_word, end_word).

    Null and empty texts have none. The templates are a parameter of bounded size and go to every
    task. No shuffle.
    """
    key = tuple(sorted(templates.items()))
    kind = docs.schema[id_col].dataType.simpleString()
    item = pa.struct([("license", pa.string()), ("containment", pa.float64()), ("first_word", pa.int32()), ("end_word", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _CATALOGS:
            _CATALOGS[key] = Catalog(dict(key))
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                found = scan_texts(part.column("text"), _CATALOGS[key])
                rows = [[dict(zip(("license", "containment", "first_word", "end_word"), n)) for n in f] for f in found]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(rows, pa.list_(item))], ["id", "notices"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    notices = "array<struct<license: string, containment: double, first_word: int, end_word: int>>"
    return source.mapInArrow(work, f"id {kind}, notices {notices}").select(F.col("id").alias(id_col), "notices")
