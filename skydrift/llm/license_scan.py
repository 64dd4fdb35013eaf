"""License scans: MinHash bands over overlapping windows find templates, exact containment verifies them.

A template is the set of its five-word shingles, s of them. It occurs where a passage of S consecutive
shingles, S the power of two from s on, holds at least 80% of them. Texts are cut into windows of 1.5 S
shingles every S / 2 (of one shingle where S is 1), so each such passage lies within a window. The
window's similarity with the template is then at least J = ceil(0.8 s) / (1.5 S + s - ceil(0.8 s)), and
with bands of one minimum each, as many as bring (1 - J) ** bands below `miss` for every template of
that size, windows find templates with a chance of 1 - miss, by default all but one in a hundred
thousand. Minima of windows come from minima of blocks, and those of longer blocks from shorter ones.

What is found is verified over the whole text: the passages of S shingles and the template's shingles
within, exactly. Null, empty and short texts (below five words) match nothing. Rows of equal doc_id are
scanned each on its own; extra columns are ignored; an empty table gives an empty result. A passage that
holds several templates gives a row for each. Very long texts are hashed in pieces, and a task holds some hundred bytes a word of its longest text.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .near_dedup import _chunks
from .shingles import U, mix, shingles

CONTAINED = 0.8

# Notices as their licenses word them.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
}


class Index:
    """Templates by size class and, within it, by band and minimum."""

    def __init__(self, templates: dict[str, list[str]], miss: float = 1e-5, table_bits: int = 18):
        self.mask = U((1 << table_bits) - 1)
        self.templates: list[tuple[str, np.ndarray, int, int]] = []  # name, shingles, S, least number
        sizes: dict[int, list[int]] = defaultdict(list)
        for name, texts in templates.items():
            for s in shingles(texts):
                s = np.unique(s)
                if len(s):
                    size = 1 << (len(s) - 1).bit_length()
                    sizes[size].append(len(self.templates))
                    self.templates.append((name, s, size, math.ceil(CONTAINED * len(s) - 1e-9)))
        self.classes = []  # S, block, blocks a window, bands, {(band, minimum): templates}, table of low bits by band
        for size in sorted(sizes):
            block, n = max(1, size // 2), 3 if size > 1 else 1
            least = min(self.templates[t][3] / (block * n + len(self.templates[t][1]) - self.templates[t][3]) for t in sizes[size])
            b = 1 if least >= 1 else math.ceil(math.log(miss) / math.log(1 - least))
            found: dict[tuple[int, int], list[int]] = defaultdict(list)
            table = np.zeros((b, int(self.mask) + 1), bool)
            for k in range(b):
                for t in sizes[size]:
                    low = self.hashed(self.templates[t][1], k).min()
                    found[k, int(low)].append(t)
                    table[k, int(mix(low[None])[0] & self.mask)] = True
            self.classes.append((size, block, n, b, dict(found), table))
        self.bands = max((c[3] for c in self.classes), default=0)

    @staticmethod
    def hashed(s: np.ndarray, band: int) -> np.ndarray:
        a = int(mix(np.array([2 * band + 1], U))[0]) | 1
        return (s ^ (s >> U(29))) * U(a) ^ U(int(mix(np.array([2 * band + 2], U))[0]))

    def candidates(self, s: np.ndarray, starts: np.ndarray) -> set[tuple[int, int]]:
        """(text, template) of all windows of texts whose shingles follow each other in s from `starts` on. Windows may
        reach into the next text; what they find wrongly is sorted out by verification."""
        out: set[tuple[int, int]] = set()
        for k in range(self.bands):
            mins, width = self.hashed(s, k), 1
            for size, block, n, b, found, table in self.classes:
                while width < block:
                    if len(mins) % 2:
                        mins = np.append(mins, U(0xFFFFFFFFFFFFFFFF))
                    mins, width = np.minimum(mins[::2], mins[1::2]), 2 * width
                if k >= b:
                    continue
                low = mins
                if n > 1:
                    padded = np.concatenate([mins, np.full(n - 1, 0xFFFFFFFFFFFFFFFF, U)])
                    low = np.minimum(np.minimum(padded[:-2], padded[1:-1]), padded[2:])
                for w in np.flatnonzero(table[k][(mix(low) & self.mask).astype(np.int64)]):
                    if templates := found.get((k, int(low[w]))):
                        a = max(0, int(np.searchsorted(starts, w * block, side="right")) - 1)
                        z = int(np.searchsorted(starts, (w + n) * block, side="left"))
                        out.update((text, t) for text in range(a, z) for t in templates)
        return out

    def verified(self, s: np.ndarray, t: int) -> tuple[float, int, int, int] | None:
        """Containment of the best passage, where it begins and ends (in shingles), disjoint passages that match."""
        name, own, size, least = self.templates[t]
        at = np.flatnonzero(np.isin(s, own))
        best, n, free = None, 0, 0
        held: dict[int, int] = defaultdict(int)
        a = 0
        for z, p in enumerate(at):
            held[int(s[p])] += 1
            while p - at[a] >= size:
                held[int(s[at[a]])] -= 1
                if not held[int(s[at[a]])]:
                    del held[int(s[at[a]])]
                a += 1
            if len(held) >= least:
                if best is None or len(held) > best[0]:
                    best = len(held), int(at[a]), int(p)
                if at[a] >= free:
                    n, free = n + 1, int(p) + 1
        return (best[0] / len(own), best[1], best[2], n) if best else None


def scan_texts(index: Index, texts: list[str | None]) -> Iterator[tuple[int, str, float, int, int, int]]:
    """(text, license, containment, first word, last word, matches), best of a license's templates."""
    lists = list(shingles(texts))
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    flat = np.concatenate(lists) if lists else np.zeros(0, U)
    best: dict[tuple[int, str], tuple] = {}
    for text, t in sorted(index.candidates(flat, starts[:-1])):
        if got := index.verified(lists[text], t):
            key = text, index.templates[t][0]
            row = (got[0], len(index.templates[t][1]), -got[1]), got
            if key not in best or row[0] > best[key][0]:
                best[key] = row
    for (text, name), (_, (share, a, z, n)) in sorted(best.items()):
        yield text, name, share, a, z + 4, n


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, miss: float = 1e-5) -> DataFrame:
    """A row for each document and license found: doc_id, license, containment, first_word, last_word, n_matches."""
    made: list[Index] = []

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Index(templates, miss))
        for batch in batches:
            for start, texts in _chunks(batch.column(1).to_pylist()):
                if rows := list(scan_texts(made[0], texts)):
                    who, *rest = zip(*rows)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([start + i for i in who])), *(pa.array(c, t) for c, t in zip(rest, (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())))], names=["doc_id", "license", "containment", "first_word", "last_word", "n_matches"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(task, f"doc_id {kind}, license string, containment double, first_word long, last_word long, n_matches long")
