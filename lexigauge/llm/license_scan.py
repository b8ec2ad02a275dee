"""License notices by MinHash bands over overlapping windows, verified by shingle containment.

Notices are grouped into scales by their length. At each scale the text is covered by windows that
overlap so far that any passage as long as the scale's longest notice lies in one of them whole. A
window and a notice that it holds (or holds the required share of) then have at least a known
Jaccard similarity, and from that the number of bands is chosen: the chance that no band collides
is below ``miss``. A band is one MinHash value, so bands need no tuning of rows. Windows that share
a band with a notice are verified by exact containment of the notice's shingles.

Windows cover the whole of every text; the notices' band tables are small (bands times notices).
Everything is local to a row's batch: no shuffle until the hits of one document are merged, and
these come from one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textvec

WIDTH = 5
CONTAINMENT = 0.8
MISS = 1e-6

#: Fixed values: (license id, notice).
TEMPLATES = [
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        'applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission.",
    ),
]

#: Words are runs of letters, digits and bytes beyond ASCII, lower-cased.
BREAKS = np.ones(256, bool)
BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass(frozen=True)
class Scale:
    """Notices of similar length and how the text is windowed for them (numbers in shingles)."""

    templates: tuple[int, ...]
    window: int
    stride: int
    bands: int


def _shingles(text: str) -> np.ndarray:
    buf = np.frombuffer(text.encode(), np.uint8)
    w = textvec.words(buf, np.array([0, len(buf)]), BREAKS)
    return np.unique(textvec.shingles(textvec.span_hashes(buf, w.starts, w.ends), w.bounds, WIDTH)[0])


def plan(sizes: list[int], containment: float = CONTAINMENT, miss: float = MISS) -> list[Scale]:
    """Scales for notices of ``sizes`` shingles: lengths of one scale differ by a factor of two at most.

    A window of ``window`` shingles that holds ``c`` of a notice's ``s`` has a similarity of at least
    c / (window + s - c); ``bands`` makes (1 - that) ** bands smaller than ``miss``.
    """
    by_class: dict[int, list[int]] = {}
    for k, n in enumerate(sizes):
        by_class.setdefault(max(2, math.ceil(math.log2(n + 1))), []).append(k)
    scales = []
    for members in by_class.values():
        longest = max(sizes[k] for k in members)
        stride = max(2, longest)
        window = 2 * stride  # any ``longest`` neighbouring shingles lie in one window whole
        least = min(
            math.ceil(containment * sizes[k]) / (window + sizes[k] - math.ceil(containment * sizes[k])) for k in members
        )
        bands = math.ceil(math.log(miss) / math.log1p(-least)) if least < 1 else 1
        scales.append(Scale(tuple(members), window, stride, bands))
    return scales


def _band_hash(shingles: np.ndarray, band: int) -> np.ndarray:
    """The band's order of shingles, as 32-bit integers; equal ones only cost a verification."""
    a, b = (int(x) for x in textvec.mix(np.array([2 * band + 1, 2 * band + 2], np.uint64)) >> np.uint64(32))
    x = (shingles ^ np.uint32(a)) * np.uint32(b | 1)
    x ^= x >> np.uint32(15)
    return x * np.uint32(0x85EBCA6B)


class Scanner:
    """Finds notices in chunks of texts."""

    def __init__(self, templates: list[tuple[str, str]], containment: float, miss: float):
        self.sets = [_shingles(t) for _, t in templates]
        self.containment = containment
        self.scales = plan([len(s) for s in self.sets], containment, miss)

    def _candidates(self, sh: np.ndarray, scale: Scale) -> list[tuple[int, int]]:
        """(notice, block) pairs: the notice and the window of blocks ``block`` and ``block + 1`` share a band."""
        blocks = np.arange(0, len(sh), scale.stride)
        sh = sh.astype(np.uint32)
        found: set[tuple[int, int]] = set()
        for band in range(scale.bands):
            h = _band_hash(sh, band)
            low = np.minimum.reduceat(h, blocks)
            window = np.minimum(low, np.append(low[1:], low[-1]))
            tops = {}
            for k in scale.templates:
                tops.setdefault(int(_band_hash(self.sets[k].astype(np.uint32), band).min()), []).append(k)
            keys = np.array(sorted(tops), np.uint32)
            at = np.searchsorted(keys, window)
            at[at == len(keys)] = 0
            for block in np.flatnonzero(keys[at] == window):
                found.update((k, int(block)) for k in tops[int(window[block])])
        return sorted(found)

    def scan(self, buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, float, np.ndarray, np.ndarray]]:
        """(text, notice, containment, the text's shingles that hit, their hashes) for every window that verifies."""
        w = textvec.words(buf, off, BREAKS)
        sh, bounds = textvec.shingles(textvec.span_hashes(buf, w.starts, w.ends), w.bounds, WIDTH)
        if not len(sh):
            return
        for scale in self.scales:
            for k, block in self._candidates(sh, scale):
                lo = block * scale.stride
                hi = min(len(sh), lo + scale.window)
                hit = np.isin(sh[lo:hi], self.sets[k])
                # a window may span two texts: each is verified by itself
                first = int(np.searchsorted(bounds, lo, "right")) - 1
                while first < len(bounds) - 1 and bounds[first] < hi:
                    a, b = max(lo, bounds[first]) - lo, min(hi, bounds[first + 1]) - lo
                    own = np.flatnonzero(hit[a:b]) + a + lo
                    if len(own):
                        share = len(np.unique(sh[own])) / len(self.sets[k])
                        if share >= self.containment:
                            yield first, k, share, own - bounds[first], sh[own]
                    first += 1


Found = list[tuple[int, float, np.ndarray, np.ndarray]]


def _closest(found: Found, sizes: list[int], names: list[str], containment: float) -> Found:
    """``found`` (notice, containment, positions, hashes) of one text without what fits another license better.

    A run of neighbouring hits goes if another license's notice overlaps it and has there both more
    shingles and the higher containment. A window stays if what is left of it still verifies. Ties stay.
    """
    at: dict[int, dict[int, int]] = {}
    for k, _, own, hashes in found:
        at.setdefault(k, {}).update(zip(own.tolist(), hashes.tolist(), strict=True))
    order = {k: np.array(sorted(places)) for k, places in at.items()}
    lost: dict[int, list[int]] = {k: [] for k in at}
    for k, places in order.items():
        for run in np.split(places, np.flatnonzero(np.diff(places) > 1) + 1):
            n = len({at[k][p] for p in run.tolist()})
            for j, others in order.items():
                if names[j] == names[k] or not ((others >= run[0]) & (others <= run[-1])).any():
                    continue
                # a word that tells notices apart is in the shingles just outside the run
                near = others[(others > run[0] - WIDTH) & (others < run[-1] + WIDTH)]
                m = len({at[j][p] for p in near.tolist()})
                if m > n and m / sizes[j] > n / sizes[k]:
                    lost[k].extend(run.tolist())
                    break
    out = []
    for k, _, own, hashes in found:
        left = ~np.isin(own, lost[k])
        share = len(np.unique(hashes[left])) / sizes[k]
        if share >= containment:
            out.append((k, share, own[left], hashes[left]))
    return out


def license_scan(
    docs: DataFrame,
    templates: list[tuple[str, str]] = TEMPLATES,
    containment: float = CONTAINMENT,
    miss: float = MISS,
    closest: bool = False,
) -> DataFrame:
    """One row per document and license found: doc_id, license, containment, first_word, n_places.

    A license is found where some window holds at least ``containment`` of the distinct 5-word
    shingles of one of its notices (a notice of fewer words is one shingle). ``first_word`` counts
    the text's words from 0; ``n_places`` counts runs of
    its shingles that are more than a changed word apart. Null, empty and
    unlicensed texts give no row; with ``closest`` a passage that fits another license's notice better
    doesn't count (lines of GPL-2.0 and GPL-3.0 share 7 of 8 shingles); ids that repeat give a row for each row of ``docs``; null ids come
    back as null; an empty table or no templates give no rows; other columns are ignored.
    """
    names = [name for name, _ in templates]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, containment, miss)
        sizes = [len(s) for s in scanner.sets]
        for batch in batches:
            for lo, _, buf, off in textvec.chunks(batch.column("text"), 1 << 20):
                shares: dict[tuple[int, str], float] = {}
                hits: dict[tuple[int, str], set[int]] = {}
                found: dict[int, Found] = {}
                for text, *one in scanner.scan(buf, off):
                    found.setdefault(text, []).append(tuple(one))
                for text, windows in found.items():
                    if closest and len({names[k] for k, *_ in windows}) > 1:
                        windows = _closest(windows, sizes, names, containment)
                    for k, share, at, _ in windows:
                        key = text, names[k]
                        shares[key] = max(share, shares.get(key, 0.0))
                        hits.setdefault(key, set()).update(at.tolist())
                rows = []
                for (text, name), at in sorted(hits.items()):
                    order = np.array(sorted(at))
                    # hits of one place are neighbours, or a changed word apart
                    places = 1 + int((np.diff(order) > WIDTH).sum())
                    rows.append((text, name, shares[text, name], int(order[0]), places))
                if rows:
                    text, name, share, first, n = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id").take(pa.array(np.array(text) + lo)),
                            pa.array(name, pa.string()),
                            pa.array(share, pa.float64()),
                            pa.array(first, pa.int64()),
                            pa.array(n, pa.int64()),
                        ],
                        names=["doc_id", "license", "containment", "first_word", "n_places"],
                    )

    if not templates:
        docs = docs.limit(0)
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(
        run, "doc_id bigint, license string, containment double, first_word bigint, n_places bigint"
    )
