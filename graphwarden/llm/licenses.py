"""License scans: MinHash bands over overlapping text windows retrieve templates, and exact shingle
containment verifies them.

Shingles are five words. Windows come in sizes of two blocks, each block a power of two of shingles; a
template is looked for in the smallest size whose block holds all its n shingles, so a window has fewer
than 4n. A window that contains 80 % of the template then has a Jaccard similarity of more than 0.19
with it, and with bands of one value each, ``bands_for`` sets their number such that at least one of
them collides with probability ``RECALL``. A match is a window that contains at least 80 % of a
template's distinct shingles; it is always verified on the shingles themselves. A template of fewer than
five words (``NOTICES``) is one shingle of its own length and is compared with all runs of so many words.

A text has one entry for each place of a template, with the template's best containment in any of the
text's windows. Places are disjoint runs of at most a window's length, inside of matching windows, that
contain at least 80 % of the shingles: each ends as early as it can, and is then widened by further
shingles of the same copy.

Null, empty and wordless texts match nothing. Texts are scanned whole, whatever their length; repeated
rows agree, null ids don't matter, extra columns are passed through (those named like results are
replaced). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import Words, in_arrow, quoted, row_blocks, shingles, text_bytes

WORDS, CONTAINMENT, RECALL = 5, 0.8, 0.9999
#: Headers, grants and one-line notices of common licenses (fixed texts).
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "lgpl": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "agpl": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "cc0-1.0-notice": "licensed under CC0 1.0 Universal",
    "cc0-1.0": "has waived all copyright and related or neighboring rights to",
    "epl": "This program and the accompanying materials are made available under the terms of the Eclipse Public License",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
#: Notices of fewer than five words.
NOTICES = {"all-rights-reserved": "All rights reserved."}


def bands_for(recall: float = RECALL, containment: float = CONTAINMENT) -> int:
    """Bands of one value with which the least similar matching window collides with the probability asked for."""
    similarity = containment / (4 + 1 - containment)
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity)))


@dataclass
class _Template:
    name: str
    shingles: np.ndarray  # sorted, distinct
    first: np.ndarray  # where the template has each first
    last: np.ndarray
    level: int  # the block has 2**level shingles


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, bands: int | None = None):
        data, offs = text_bytes(pa.array(list(templates.values()), pa.string()))
        w = Words(data, offs)
        values, rows = shingles(w.hash, w.rows, WORDS)
        rng = np.random.default_rng(8)
        n = bands or bands_for()
        self.a = rng.integers(0, 1 << 31, n).astype(np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, n).astype(np.uint32)
        self.templates: list[_Template] = []
        #: By number of words below ``WORDS``: the templates' shingles.
        self.short: dict[int, list[tuple[str, np.uint64]]] = {}
        for k, name in enumerate(templates):
            own, front = np.unique(values[rows[k] : rows[k + 1]], return_index=True)
            back = rows[k + 1] - rows[k] - 1 - np.unique(values[rows[k] : rows[k + 1]][::-1], return_index=True)[1]
            if 0 < w.counts[k] < WORDS:
                self.short.setdefault(int(w.counts[k]), []).append((name, own[0]))
            elif len(own):
                self.templates.append(_Template(name, own, front, back, int(np.ceil(np.log2(len(own))))))
        self.levels = sorted({t.level for t in self.templates})
        #: By band and level: the templates' values.
        self.wanted = [{v: [(k, self._value(t.shingles, i).min()) for k, t in enumerate(self.templates) if t.level == v] for v in self.levels} for i in range(n)]

    def _value(self, x: np.ndarray, band: int) -> np.ndarray:
        return (x >> np.uint64(32)).astype(np.uint32) * self.a[band] + self.b[band]

    def candidates(self, values: np.ndarray, rows: np.ndarray) -> set[tuple[int, int, int]]:
        """(template, first shingle, end) of windows that share a band with a template."""
        found: set[tuple[int, int, int]] = set()
        if not len(values):
            return found
        top = self.levels[-1] if self.levels else -1
        for i in range(len(self.a)):
            least, bounds, starts = self._value(values, i), rows, np.arange(len(values))
            for level in range(top + 1):
                if level:  # blocks of a row, two by two
                    count = -(-np.diff(bounds) // 2)
                    after = np.concatenate([[0], np.cumsum(count)])
                    first = np.repeat(bounds[:-1], count) + 2 * (np.arange(after[-1]) - np.repeat(after[:-1], count))
                    least, starts, bounds = np.minimum.reduceat(least, first), starts[first], after
                if level not in self.levels:
                    continue
                window = least.copy()
                window[:-1] = np.minimum(least[:-1], least[1:])
                last = bounds[1:][np.diff(bounds) > 0] - 1
                window[last] = least[last]
                for k, target in self.wanted[i][level]:
                    for at in np.flatnonzero(window == target):
                        end = rows[int(np.searchsorted(rows, starts[at], "right"))]
                        found.add((k, int(starts[at]), int(min(starts[at] + (2 << level), end))))
        return found

    def places(self, t: _Template, part: np.ndarray) -> list[tuple[int, int]]:
        """First and last shingle of the disjoint copies of a template in ``part``."""
        at = np.flatnonzero(np.isin(part, t.shingles))
        ids = np.searchsorted(t.shingles, part[at]).tolist()
        need, window, out = int(np.ceil(CONTAINMENT * len(t.shingles) - 1e-9)), 2 << t.level, []
        count: dict[int, int] = {}
        first, i, at = 0, 0, at.tolist()
        begin = 0  # what comes before belongs to other copies
        while i < len(at):
            count[ids[i]] = count.get(ids[i], 0) + 1
            while at[i] - at[first] >= window or count[ids[first]] > 1:  # leave what is too far away or comes again
                count[ids[first]] -= 1
                if not count[ids[first]]:
                    del count[ids[first]]
                first += 1
            if len(count) >= need:
                last = i  # a copy goes on as long as it goes on in the template
                while last + 1 < len(at) and at[last + 1] - at[first] < window and t.last[ids[last + 1]] > t.first[ids[last]]:
                    last += 1
                while first > begin and at[last] - at[first - 1] < window and t.first[ids[first - 1]] < t.last[ids[first]]:
                    first -= 1
                out.append((at[first], at[last]))
                i = last + 1
                while i < len(at) and at[i] < at[last] + WORDS:  # they share words with this copy
                    i += 1
                begin = first = i
                count = {}
            else:
                i += 1
        return out

    def scan(self, data: np.ndarray, offs: np.ndarray) -> list[list[tuple[str, float, int, int]]]:
        """For each text its (template, best containment, start byte, end byte), by template and place."""
        w = Words(data, offs)
        values, rows = shingles(w.hash, w.rows, WORDS)
        best: list[dict[str, float]] = [{} for _ in range(len(offs) - 1)]
        found: list[list[tuple[str, int, int]]] = [[] for _ in range(len(offs) - 1)]
        regions: list[tuple[int, int, int, int]] = []  # row, template and matching windows that overlap or touch
        for k, a, b in sorted(self.candidates(values, rows)):
            t = self.templates[k]
            share = np.isin(t.shingles, values[a:b]).sum() / len(t.shingles)
            if share < CONTAINMENT:
                continue
            row = int(np.searchsorted(rows, a, "right")) - 1
            best[row][t.name] = max(share, best[row].get(t.name, 0.0))
            if regions and regions[-1][:2] == (row, k) and a <= regions[-1][3]:
                regions[-1] = (row, k, regions[-1][2], max(b, regions[-1][3]))
            else:
                regions.append((row, k, a, b))
        for row, k, a, b in regions:
            for first, last in self.places(self.templates[k], values[a:b]):
                at = a - rows[row] + w.rows[row]
                end = min(at + last + WORDS, w.rows[row + 1]) - 1
                found[row].append((self.templates[k].name, int(w.starts[at + first] - offs[row]), int(w.ends[end] - offs[row])))
        for n, wanted in self.short.items():
            values, rows = shingles(w.hash, w.rows, n)
            for name, value in wanted:
                end = -1
                for a in np.flatnonzero(values == value):
                    row = int(np.searchsorted(rows, a, "right")) - 1
                    at = a - rows[row] + w.rows[row]
                    if at >= end:
                        best[row][name], end = 1.0, at + n
                        found[row].append((name, int(w.starts[at] - offs[row]), int(w.ends[end - 1] - offs[row])))
        return [[(name, float(best[row][name]), a, b) for name, a, b in sorted(x)] for row, x in enumerate(found)]


_TYPE = pa.list_(pa.struct([("license", pa.string()), ("containment", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES | NOTICES, text: str = "text", out: str = "licenses") -> DataFrame:
    """``docs`` with the places of licenses in the text, in its place: array<struct<license, containment, start, end>>.
    All other columns pass through."""
    keep = [c for c in docs.columns if c not in (out, text)]
    kind = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("containment", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out, kind)])
    scanner = Scanner(templates)  # its size is that of the templates, which come with the code

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in row_blocks(batch, text):
                found = [[dict(zip(("license", "containment", "start", "end"), x)) for x in row] for row in scanner.scan(*text_bytes(block.column(text)))]
                yield pa.RecordBatch.from_arrays([*(block.column(c) for c in keep), pa.array(found, _TYPE)], names=[*keep, out])

    return in_arrow(docs.select(*quoted([*keep, text])), run, schema)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_licenses, licenses (comma-joined), containment and the spans of each,
    joined by ``;`` within a license."""
    found = scan(docs.select("doc_id", "text"), out="places").withColumn("names", F.array_distinct("places.license"))
    span = lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))
    return found.select(
        "doc_id", F.size("names").cast("long").alias("n_licenses"), F.concat_ws(",", "names").alias("licenses"),
        F.array_min("places.containment").alias("least_containment"),
        F.concat_ws(",", F.transform("names", lambda n: F.concat_ws(";", F.transform(F.filter("places", lambda x: x["license"] == n), span)))).alias("spans"),
    )
