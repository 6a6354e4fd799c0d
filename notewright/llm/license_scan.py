"""License scan: winnowed fingerprints of templates in an inverted index pick candidates, banded alignment measures them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm._kernel import U64, Texts, Words, run_hashes, span_hashes, texts
from notewright.llm._shared import lean
from notewright.llm.decontaminate import split_words

_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, '
    "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
    "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
)


def _gnu(name: str, version: str) -> list[str]:
    """The notice for source files, and a short reference."""
    return [
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
        f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.",
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
        f"This work is licensed under the GNU {name}, version {version}.",
    ]


#: Whole texts of the short licenses, and the notices by which the long ones are applied, as their publishers
#: word them.  Any run of GRAM + WINDOW - 1 equal words shares a fingerprint.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": ["Released under the MIT License.", _MIT],
    "BSD-2-Clause": [_BSD_2 + _BSD_END],
    "BSD-3-Clause": [_BSD_2 + _BSD_NAME + _BSD_END],
    "ISC": [_ISC],
    "Zlib": [_ZLIB],
    "Unlicense": [_UNLICENSE],
    "GPL-3.0": _gnu("General Public License", "3"),
    "GPL-2.0": _gnu("General Public License", "2"),
    "LGPL-3.0": _gnu("Lesser General Public License", "3"),
    "LGPL-2.1": _gnu("Lesser General Public License", "2.1"),
    "AGPL-3.0": _gnu("Affero General Public License", "3"),
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
}
GRAM, WINDOW, BAND = 3, 3, 8
#: Template words times candidates aligned at once.
AT_ONCE = 1 << 18
#: Words of all templates: the index is broadcast.
MOST_WORDS = 2_000_000


@dataclass
class Index:
    names: list[str]
    hashes: list[np.ndarray]  # of each template's words
    prints: np.ndarray  # sorted fingerprints
    template: np.ndarray  # of each fingerprint
    place: np.ndarray


def winnow(grams: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Places of the least gram of every WINDOW consecutive ones within low..high (of each place's text), the last of equals; a text of fewer has one window."""
    n = len(grams)
    if not n:
        return np.zeros(0, np.int64)
    here = np.arange(n)
    best = here.copy()
    for k in range(1, WINDOW):
        other = np.minimum(here + k, high - 1)
        best = np.where(grams[other] <= grams[best], other, best)
    begins = (here + WINDOW <= high) | (here == low)
    return np.unique(best[begins])


def fingerprints(w: Words, wh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of the chosen grams of each row, and their hashes."""
    at = np.flatnonzero(np.arange(len(wh)) + GRAM <= w.first[1:][w.doc]) if len(wh) else np.zeros(0, np.int64)
    doc = w.doc[at]
    grams = run_hashes(wh, at, at + GRAM)
    edges = np.searchsorted(doc, np.arange(len(w.first)))
    chosen = winnow(grams, edges[:-1][doc], edges[1:][doc])
    return at[chosen], grams[chosen]


def build_index(templates: dict[str, list[str]]) -> Index:
    names = [k for k, v in templates.items() for _ in v]
    hashes, prints, template, place = [], [], [], []
    for t in texts(pa.array([x for v in templates.values() for x in v], pa.large_string()), 1 << 62):
        flat, w = split_words(t)
        if len(w.starts) > MOST_WORDS:
            raise ValueError(f"templates of {len(w.starts)} words: their index is broadcast and may have {MOST_WORDS}")
        wh = span_hashes(flat, w.starts, w.ends)
        hashes = [wh[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        at, key = fingerprints(w, wh)
        prints.append(key)
        template.append(w.doc[at])
        place.append(at - w.first[w.doc[at]])
    if not prints:
        return Index([], [], *(np.zeros(0, k) for k in (U64, np.int64, np.int64)))
    key = np.concatenate(prints)
    order = np.argsort(key, kind="stable")
    return Index(names, hashes, key[order], np.concatenate(template)[order], np.concatenate(place)[order])


def align(template: np.ndarray, words: np.ndarray, first: np.ndarray, last: np.ndarray, shift: np.ndarray, band: int = BAND) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each candidate, matched template words, and begin and end of the matched span among words.

    Local alignment near the diagonal words[i + shift] = template[i] within words[first:last]: +2 for an equal word, -1
    for a different, missing or additional one; at most `band` words off the diagonal.  The best end is the first of
    equals.  All candidates take a template word at once.
    """
    n, m, width = len(shift), len(template), 2 * band + 1
    off = np.arange(width)
    score = np.zeros((n, width + 2), np.int64)  # one cell more on either side stays 0
    step = np.zeros((m, n, width), np.int8)  # 0 begin, 1 equal, 2 different, 3 missing, 4 additional
    best, at = np.zeros(n, np.int64), np.zeros((n, 2), np.int64)
    for i in range(m):
        j = shift[:, None] + i - band + off  # the words beside template[i]
        real = (j >= first[:, None]) & (j < last[:, None])
        same = real & (words[np.where(real, j, 0)] == template[i])
        across, missing = score[:, 1:-1] + np.where(same, 2, -1), score[:, 2:] - 1
        value = np.maximum(np.maximum(across, missing), 0)
        kind = np.where(value == 0, 0, np.where(value == across, np.where(same, 1, 2), 3))
        value = np.where(real, value, 0)
        # an additional word comes from the left: the best of all cells there, less their distance
        left = np.maximum.accumulate(value + off, axis=1) - off
        kind = np.where(real, np.where(left > value, 4, kind), 0)
        value = np.where(real, np.maximum(left, value), 0)
        score[:, 1:-1], step[i] = value, kind
        top = value.argmax(1)
        high = value[np.arange(n), top]
        more = high > best
        best[more] = high[more]
        at[more, 0], at[more, 1] = i, top[more]
    matched, begin, end = np.zeros(n, np.int64), np.zeros(n, np.int64), at[:, 0] + shift + at[:, 1] - band + 1
    begin[:] = end
    for c in np.flatnonzero(best > 0):
        i, k = at[c]
        while i >= 0 and 0 <= k < width and (kind := step[i, c, k]):
            if kind <= 2:
                matched[c] += kind == 1
                begin[c] = i + shift[c] + k - band
                i -= 1
            elif kind == 3:
                i, k = i - 1, k + 1
            else:
                k -= 1
    return matched, begin, end


def scan_chunk(t: Texts, index: Index, least: float) -> list[list[dict]]:
    flat, w = split_words(t)
    out: list[list[dict]] = [[] for _ in range(len(t.offsets) - 1)]
    if not len(w.starts) or not len(index.prints):
        return out
    wh = span_hashes(flat, w.starts, w.ends)
    at, key = fingerprints(w, wh)
    low, high = np.searchsorted(index.prints, key), np.searchsorted(index.prints, key, "right")
    hit = np.flatnonzero(high > low)
    n = (high - low)[hit]
    which = np.repeat(low[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place, doc = np.repeat(at[hit], n), w.doc[np.repeat(at[hit], n)]
    # hits near one diagonal are one candidate, aligned once
    diagonal = place - w.first[doc] - index.place[which]
    hits = np.unique(np.stack([doc, index.template[which], diagonal], 1), axis=0)
    keep, last = [], (-1, -1, 0)
    for c, (d, k, shift) in enumerate(hits.tolist()):
        if last[:2] == (d, k) and shift - last[2] <= BAND // 2:
            continue
        last = (d, k, shift)
        keep.append(c)
    hits = hits[keep]
    found: dict[int, list[dict]] = {}
    for k in np.unique(hits[:, 1]):
        template = index.hashes[k]
        own = hits[hits[:, 1] == k]
        for part in np.array_split(own, -(-len(own) * len(template) // AT_ONCE)):
            d = part[:, 0]
            for doc_, m, a, b in zip(d, *align(template, wh, w.first[d], w.first[d + 1], w.first[d] + part[:, 2]), strict=True):
                if m >= least * len(template):
                    found.setdefault(int(doc_), []).append({"license": index.names[k], "template": int(k), "matched": int(m), "coverage": m / len(template), "first": int(a - w.first[doc_]), "last": int(b - w.first[doc_])})
    for d, each in found.items():
        # of overlapping matches the one with most words stays
        each.sort(key=lambda m: (-m["matched"], -m["coverage"], m["first"], m["template"]))
        stay: list[dict] = []
        for m in each:
            if all(m["last"] <= s["first"] or s["last"] <= m["first"] for s in stay):
                stay.append(m)
        starts = np.concatenate([[0], np.cumsum((t.data[t.offsets[d] : t.offsets[d + 1]] & 0xC0) != 0x80)])
        for m in sorted(stay, key=lambda m: m["first"]):
            a, b = w.starts[w.first[d] + m["first"]] - t.offsets[d], w.ends[w.first[d] + m["last"] - 1] - t.offsets[d]
            out[d].append({"license": m["license"], "matched": m["matched"], "coverage": m["coverage"], "start": int(starts[a]), "end": int(starts[b])})
    return out


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words and matches (license, matched words, coverage of the template, start and end in code points) of each row.

    A match covers at least `least` of its template's words.  Words are lower-cased runs of ASCII letters, digits and
    all beyond ASCII.  The index of templates is of bounded size and broadcast; texts are not shuffled.  Templates of
    fewer than GRAM words have no fingerprint and are never found.

    Of overlapping matches in a document the one with most matched words stays, of equals that with the higher
    coverage, then the earlier, then the earlier template.

    Null or empty text: no words, no matches.  Repeated rows are scanned each; a long text is a chunk of its own.
    """
    lean(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(build_index(TEMPLATES if templates is None else templates))
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = pa.list_(pa.struct([("license", pa.string()), ("matched", pa.int64()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts(batch.column("text")):
                part = batch.slice(t.lo, t.hi - t.lo)
                _, w = split_words(t)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(w.counts, pa.int64()), pa.array(scan_chunk(t, shared.value, least), kind)], names=["doc_id", "n_words", "matches"])

    return base.mapInArrow(run, f"doc_id {dict(base.dtypes)['doc_id']}, n_words long, matches array<struct<license: string, matched: long, coverage: double, start: long, end: long>>")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, how many matches and of which licenses, and the highest coverage."""
    return found.select("doc_id", "n_words", F.size("matches").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(F.col("matches.license"))), ",").alias("licenses"), F.round(F.array_max(F.col("matches.coverage")), 4).alias("coverage"))
