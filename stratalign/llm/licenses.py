"""Licence scans: passages compared with licence templates.

Texts are normalised (A-Z to lower case, every other ASCII mark a space).  Word
pairs that some template has are found by hash.  A text is compared with those
templates alone of which it has enough pairs for the asked Dice coefficient:
2 * shared / (a + b) >= t needs a and b within a factor (2 - t) / t.  Every passage
of such a size from one of the template's pairs to another is tried.  The best
passage is kept, then the best of those without a word of it, and so on.

Whole texts count.  A null or empty text has no licence.  Ties go to the longer
and then the alphabetically first template.  Ids may be null or repeated; an
empty table gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit
from .storage import keep_columns

U64 = np.uint64

# Licence notices in their usual wording.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]

_PASSAGE = pa.schema([("license", pa.string()), ("score", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())])
_FOUND = pa.schema([("doc_id", pa.int64()), *_PASSAGE, ("passages", pa.list_(pa.struct(list(_PASSAGE))))])
_DDL = "doc_id long, license string, score double, first_word long, n_words long, passages array<struct<license: string, score: double, first_word: long, n_words: long>>"


def _plain() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    for b in range(128):
        if not bytes([b]).isalnum():
            table[b] = 32
    return table


def pairs(data: np.ndarray, offsets: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of adjacent word pairs by row; a row of w words has w - 1 of them."""
    hashes, rows = textkit.words(plain[data], offsets)
    with np.errstate(over="ignore"):
        joint = textkit.mix(hashes[:-1] * U64(0x9E3779B97F4A7C15) + hashes[1:]) if len(hashes) > 1 else hashes[:0]
    made = np.maximum(np.diff(rows) - 1, 0)
    out_rows = np.r_[0, np.cumsum(made)]
    return joint[textkit.ranges(rows[:-1], made)], out_rows


def _before(values: np.ndarray) -> np.ndarray:
    """Where each value was last, -1 for nowhere."""
    order = np.argsort(values, kind="stable")
    out = np.full(len(values), -1)
    same = values[order[1:]] == values[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def _after(values: np.ndarray) -> np.ndarray:
    """Where each value is next, the length for nowhere."""
    return len(values) - 1 - _before(values[::-1])[::-1]


class Matcher:
    def __init__(self, templates: Sequence[tuple[str, str]], threshold: float):
        self.plain, self.threshold = _plain(), threshold
        data, offsets = textkit.buffer_of(pa.array([t for _, t in templates]))
        found, rows = pairs(data, offsets, self.plain)
        self.names = [name for name, _ in templates]
        self.sets = [np.unique(found[rows[k] : rows[k + 1]]) for k in range(len(templates))]
        self.order = sorted(range(len(templates)), key=lambda k: (-len(self.sets[k]), self.names[k]))
        self.all = np.unique(found)
        self.member = np.stack([np.isin(self.all, s) for s in self.sets], 1).astype(np.int64)

    def shared(self, pair_ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """How many distinct pairs of each template (columns) each text (rows) has."""
        kinds = len(self.all)
        own = np.unique(np.repeat(np.arange(len(rows) - 1), np.diff(rows)) * kinds + pair_ids)
        texts, first = np.unique(own // kinds, return_index=True)
        out = np.zeros((len(rows) - 1, len(self.sets)), np.int64)
        if len(own):
            out[texts] = np.add.reduceat(self.member[own % kinds], first, axis=0)
        return out

    def least(self, k: int) -> float:
        """So many pairs of template k a passage needs; a hair less, so that rounding keeps no passage out."""
        return self.threshold / (2 - self.threshold) * len(self.sets[k]) - 1e-9

    def passages(self, row: np.ndarray, hits: np.ndarray, pair_ids: np.ndarray, k: int) -> Iterator[tuple[float, int, int]]:
        """All passages from a pair of template k to another that reach the threshold, as score, start and past
        the end.  Any others have the score of one of these at most: a pair at an end that the passage has once
        more can be left off."""
        size = len(self.sets[k])
        least, most = self.least(k), (2 - self.threshold) / self.threshold * size + 1e-9
        chosen = self.member[pair_ids, k] > 0
        own = hits[chosen]
        before, before_own, after_own = _before(row), _before(row[own]), _after(row[own])
        for i, start in enumerate(own.tolist()):
            past = int(after_own[i])
            new = before_own[i:past] < i
            if new.sum() < least:
                continue
            shared, reach = np.cumsum(new), int(4 * most)
            while True:
                span = np.cumsum(before[start : start + reach] < start)
                if span[-1] > most or start + reach > own[past - 1]:
                    break
                reach *= 2
            inside = new & (own[i:past] < start + reach)
            at = np.flatnonzero(inside)
            scores = 2 * shared[at] / (span[own[i:past][at] - start] + size)
            for j in np.flatnonzero(scores >= self.threshold).tolist():
                yield float(scores[j]), start, int(own[i + at[j]]) + 1

    def found(self, row: np.ndarray, hits: np.ndarray, pair_ids: np.ndarray, shared: np.ndarray) -> list[tuple[str, float, int, int]]:
        """The passages of a text (its pairs, where pairs of some template are and which, and how many of each
        template) that have no word in common, best first."""
        made = [(score, place, start, end) for place, k in enumerate(self.order) if shared[k] >= self.least(k) for score, start, end in self.passages(row, hits, pair_ids, k)]
        if not made:
            return []
        scores, places, starts, ends = (np.array(c) for c in zip(*made, strict=True))
        order = np.lexsort((ends, starts, places, -scores))
        scores, places, starts, ends = scores[order], places[order], starts[order], ends[order]
        out = []
        while len(scores):
            start, end = int(starts[0]), int(ends[0])
            out.append((self.names[self.order[int(places[0])]], float(scores[0]), start, end - start + 1))
            free = (starts > end) | (ends < start)
            scores, places, starts, ends = scores[free], places[free], starts[free], ends[free]
        return out


def _scan(templates: Sequence[tuple[str, str]], threshold: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, threshold)
        for batch in batches:
            for part in textkit.slices(batch, "text"):
                data, offsets = textkit.buffer_of(part.column(1))
                found, rows = pairs(data, offsets, matcher.plain)
                place = np.minimum(np.searchsorted(matcher.all, found), len(matcher.all) - 1)
                hits = np.flatnonzero(matcher.all[place] == found)
                split = np.searchsorted(hits, rows)
                shared = matcher.shared(place[hits], split)
                out = []
                for r, doc_id in enumerate(part.column(0).to_pylist()):
                    own = hits[split[r] : split[r + 1]] - rows[r]
                    kept = matcher.found(found[rows[r] : rows[r + 1]], own, place[hits[split[r] : split[r + 1]]], shared[r]) if len(own) else []
                    best = kept[0] if kept else (None, 0.0, None, None)
                    out.append((doc_id, *best, [dict(zip(_PASSAGE.names, k, strict=True)) for k in sorted(kept, key=lambda k: k[2])]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _FOUND, strict=True)], schema=_FOUND)

    return scan


def license_scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = tuple(TEMPLATES), threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, license (null for none), score, first_word, n_words of its best passage, and
    all its passages in order."""
    rows = keep_columns(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_scan(templates, threshold), _DDL)
