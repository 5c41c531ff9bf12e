"""License scans by conditional compression.

Blocks around license wording are candidates. Their words are taken in overlapping pieces. A piece is
compressed by itself and with each template as raw zstandard dictionary; templates are ranked by how
much smaller that makes it. All that make it enough smaller are confirmed by the exact differences in words.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, types as T

from .base import append_columns

#: Wording of public licenses and of usual notices: fixed values.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"'),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Words of a cue may stand on two lines, behind comment marks.
CUE = r"(?i)licen[cs]e|copyright|permission|redistribut|free\W+software|public\W+domain|creative\W+commons|gnu\W+general|mozilla\W+public"
#: The least share by which a template must shrink a piece unless all its words are there; differing words allowed for 20 of the template.
SHRINK, DIFFER = 0.15, 1
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def allowed(template: list[str]) -> int:
    return DIFFER * len(template) // 20


#: Words on both sides of a cue that a block takes in: those of the longest template's wording, and as many again as may be added to it.
REACH = max(len(t) + 2 * allowed(t) for t in (words(text) for _, text in TEMPLATES))


def _blocks(text: str, reach: int) -> list[list[tuple[int, int]]]:
    """Blocks as the character ranges of their words: REACH words on both sides of each cue, joined where they meet."""
    spans = [m.span() for m in _WORD.finditer(text)]
    starts = [a for a, _ in spans]
    out: list[list[int]] = []
    for m in re.finditer(CUE, text):
        lo, hi = max(0, bisect_right(starts, m.start()) - 1 - reach), min(len(spans), bisect_left(starts, m.end()) + reach)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    return [spans[a:b] for a, b in out]


def blocks(text: str, reach: int = REACH) -> list[tuple[int, int]]:
    """Character ranges around license wording, in order; every cue of the text lies in one."""
    return [(b[0][0], b[-1][1]) for b in _blocks(text, reach)]


def difference(template: list[str], block: list[str]) -> int:
    """Words to change, add or drop to make the template's wording of the block's part that is most like it."""
    blocks_ = [m for m in difflib.SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if m.size]
    if not blocks_:
        return len(template)
    matched = sum(m.size for m in blocks_)
    span = blocks_[-1].b + blocks_[-1].size - blocks_[0].b
    return (len(template) - matched) + max(0, span - matched - (len(template) - matched))


def alignments(template: list[str], block: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each end in ``block`` the least edits that make the template of words up to there, and where these words begin."""
    n, number = len(block), {w: k for k, w in enumerate(dict.fromkeys(block))}
    own, at = np.array([number[w] for w in block]), np.arange(n + 1)
    cost, begin = np.zeros(n + 1, np.int64), at
    for w in template:
        kept = cost[:-1] + (own != number.get(w, -1))
        dropped = cost + 1
        take = kept <= dropped[1:]
        best, start = dropped.copy(), begin.copy()
        best[1:][take], start[1:][take] = kept[take], begin[:-1][take]
        low = np.minimum.accumulate(best - at)  # added words cost one each
        come = np.maximum.accumulate(np.where(best - at == low, at, 0))
        cost, begin = low + at, start[come]
    return cost, begin


def apart(taken: list[tuple[int, int]], lo: int, hi: int) -> bool:
    """Put a range into the sorted ranges ``taken`` unless it overlaps one."""
    k = bisect_left(taken, (lo, hi))
    if (k and taken[k - 1][1] > lo) or (k < len(taken) and taken[k][0] < hi):
        return False
    taken.insert(k, (lo, hi))
    return True


class Scanner:
    def __init__(self, templates: list[tuple[str, str]]):
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.templates = []
        for name, text in templates:
            own = words(text)
            raw = " ".join(own).encode()
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.templates.append((name, own, Counter(own), len(self.plain.compress(raw)), zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_dict_id=False)))
        self.reach = max((len(t) + 2 * allowed(t) for _, t, *_ in self.templates), default=0)

    def confirmed(self, own: list[str]) -> list[tuple[int, int, str, float, int]]:
        """(first word, end, license, share, differing words) of the templates' wording in a piece."""
        raw, there = " ".join(own).encode(), Counter(own)
        alone = len(self.plain.compress(raw))
        # a template is small beside a piece: what counts is the saving beside the template's own size
        ranked = sorted(((alone - len(z.compress(raw))) / min(alone, size), k) for k, (_, _, _, size, z) in enumerate(self.templates))
        out = []
        for share, k in sorted(ranked, key=lambda x: (-x[0], x[1])):
            name, template, counts, *_ = self.templates[k]
            limit, missing = allowed(template), sum((counts - there).values())
            if missing > limit or (missing and share < SHRINK):
                continue
            cost, begin = alignments(template, own)
            found = []
            for hi in np.flatnonzero(cost <= 2 * limit).tolist():
                lo = int(begin[hi])
                part = own[lo:hi]
                wrong = min(int(cost[hi]), difference(template, part))
                if wrong <= limit and all(w in part for w in template if any(c.isdigit() for c in w)):
                    found.append((wrong, lo, hi))
            taken: list[tuple[int, int]] = []
            for wrong, lo, hi in sorted(found):
                if apart(taken, lo, hi):
                    out.append((lo, hi, name, float(share), wrong))
        return out

    def scan(self, text: str) -> list[dict]:
        found: list[dict] = []
        for spans in _blocks(text, self.reach):
            own, places = [text[a:b].lower() for a, b in spans], {}
            for at in range(0, len(own), 2 * self.reach):  # any wording lies whole in one of the pieces
                for lo, hi, name, share, wrong in self.confirmed(own[at : at + 3 * self.reach]):
                    places[at + lo, at + hi, name] = share, wrong
            kept, taken = [], {}
            for (lo, hi, name), (share, wrong) in sorted(places.items(), key=lambda x: (x[0][0] - x[0][1], x[1][1], x[0])):
                if apart(taken.setdefault(name, []), lo, hi):  # a short wording in a longer one of the same license is one place
                    kept.append((lo, hi, name, share, wrong))
            found += [{"start": spans[lo][0], "end": spans[hi - 1][1], "license": name, "reduction": share, "differences": wrong} for lo, hi, name, share, wrong in sorted(kept)]
        return found


FOUND = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("license", T.StringType()), T.StructField("reduction", T.DoubleType()), T.StructField("differences", T.IntegerType())]))
ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("reduction", pa.float64()), ("differences", pa.int32())]))


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """``docs``, all its columns, with licenses: sorted distinct names, and matches: where their wording stands.

    Whole texts are scanned; a text without license wording, an empty or a null one has no license.
    All templates whose wording is confirmed are named, however many. An input column of either name is
    replaced.
    """
    fields = [T.StructField("licenses", T.ArrayType(T.StringType())), T.StructField("matches", FOUND)]
    chosen = TEMPLATES if templates is None else templates

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        scanner, column = Scanner(chosen), batch.column("text")
        some = pc.fill_null(pc.match_substring_regex(column, CUE), False).to_pylist()
        rows = [scanner.scan(column[i].as_py()) if has else [] for i, has in enumerate(some)]
        return [pa.array([sorted({m["license"] for m in r}) for r in rows], pa.list_(pa.string())), pa.array(rows, ARROW)]

    return append_columns(docs, fields, run)
