"""License scans: winnowed template fingerprints in an inverted index, then banded alignment of word sequences.

Fingerprints are hashes of two-word runs, winnowed as far as a template's length allows: any run of words that changes
within the threshold must leave holds one (guaranteed_run). A document's two-word hashes are looked up in the index;
hits of one template are chained along the text, whatever their diagonals, and a chain with as many hits as such changes
must leave is aligned with the template's words. The band is as wide as the scoring allows a counted alignment to drift,
so the band loses nothing. An alignment that matches enough of the template is reported with its span in the text, then
what is left on both sides of it is looked at again.

The index is a few thousand entries whatever the corpus is. One pass over the texts, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_but, map_batches, process_cache
from .decontam import plain_words
from .shingles import windows, word_hashes

#: Words of a fingerprint, least percentage of a template's words.
GRAM, PERCENT = 2, 80
#: Fixed texts of licenses and license notices.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "All-rights-reserved": "All rights reserved.",
    "BSD-3-Clause-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
#: Templates read from a folder have so many characters in all at most; they are held by every worker.
MAX_TEMPLATE_CHARS = 16_000_000
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOUND = "array<struct<license:string,n_words:int,n_matched:int,start:bigint,end:bigint>>"


#: A cell of an alignment in one integer: score, matched words, first word. Later first words are shorter alignments.
_SCORE, _MATCH = 1 << 43, 1 << 23


def align(template: np.ndarray, words: np.ndarray, middle: int, band: int | None) -> tuple[int, int, int]:
    """Best local alignment: (matched words, first word, word after the last); 2 for a match, -1 for anything else.

    Cells further than band from the diagonal middle (word minus template position) are left out; None: none are. Of
    equal scores the one with more matched words, then the first end in the text, then the shorter one counts.
    """
    m = len(template)
    gap = np.arange(m + 1, dtype=np.int64) * _SCORE
    row, best, end = np.zeros(m + 1, np.int64), _SCORE - 1, 0
    for j, word in enumerate(words):
        lo, hi = (0, m) if band is None else (max(0, j - middle - band), min(m, j - middle + band + 1))
        if lo >= hi:
            row[:] = j + 1
            continue
        step = np.where(template[lo:hi] == word, 2 * _SCORE + _MATCH, -_SCORE)
        # From the diagonal or from above, then from the left: a running maximum with the gaps taken off.
        now = np.maximum(row[lo:hi] + step, row[lo + 1 : hi + 1] - _SCORE)
        now = np.maximum.accumulate(now + gap[lo:hi]) - gap[lo:hi]
        row[:] = j + 1
        row[lo + 1 : hi + 1] = np.where(now >= _SCORE, now, j + 1)
        if (top := int(now.max())) // _MATCH > best // _MATCH:
            best, end = top, j + 1
    if not end:
        return 0, 0, 0
    return (best % _SCORE) // _MATCH, best % _MATCH, end


def needed(n: int, percent: int) -> int:
    return max(1, -(-n * percent // 100))


def guaranteed_run(n: int, percent: int) -> int:
    """The longest run that a template of n words keeps when as many words as the threshold allows are changed or left
    out, and others put in at as many places."""
    return -(-needed(n, percent) // (2 * (n - needed(n, percent)) + 1))


def winnow(grams: np.ndarray, window: int) -> list[int]:
    """The place of the least hash in every window of hashes, each once; the last of equal ones."""
    if not len(grams):
        return []
    starts = range(max(1, len(grams) - window + 1))
    return sorted({max(range(i, min(i + window, len(grams))), key=lambda p: (-int(grams[p]), p)) for i in starts})


class Templates:
    """Word hashes of the templates and the inverted index of their fingerprints."""

    def __init__(self, templates: dict[str, str], percent: int = PERCENT):
        self.names, self.percent = sorted(templates), percent
        self.words = [word_hashes(plain_words(templates[n])) for n in self.names]
        self.need = [needed(len(h), percent) for h in self.words]
        #: Hits that a place must have: with all two-word runs indexed, those that the changes leave.
        self.least = [1] * len(self.words)
        found: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for t, h in enumerate(self.words):
            if not len(h):
                continue
            run = guaranteed_run(len(h), percent)
            k = min(GRAM, run)
            window = run - k + 1
            if window == 1:
                n, need = len(h), self.need[t]
                self.least[t] = max(1, need - (k - 1) * (2 * (n - need) + 1))
            grams = windows(h, k)
            for p in winnow(grams, window):
                found.setdefault(k, {}).setdefault(int(grams[p]), []).append((t, p))
        self.indexes = []
        for k, places in found.items():
            keys = np.array(sorted(places), dtype=np.uint64)
            bits = np.zeros(1 << 20, bool)
            bits[keys >> np.uint64(44)] = True
            self.indexes.append((k, keys, [places[x] for x in keys.tolist()], bits))

    def candidates(self, h: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(template, first word, word after the last, least and largest diagonal) of places with enough hits.

        An alignment that counts has at most three words of text for each of the template's, so hits that can't meet
        in one stand six times its length apart; nearer ones are chained, in order of the text.
        """
        seen: dict[int, list[tuple[int, int]]] = {}
        for k, keys, places, bits in self.indexes:
            if len(h) < k:
                continue
            g = windows(h, k)
            near = np.flatnonzero(bits[g >> np.uint64(44)])
            if len(near):
                key = np.minimum(np.searchsorted(keys, g[near]), len(keys) - 1)
                for q, x in zip(near[keys[key] == g[near]].tolist(), key[keys[key] == g[near]].tolist(), strict=True):
                    for t, p in places[x]:
                        seen.setdefault(t, []).append((q, p))
        out = []
        for t, hits in sorted(seen.items()):
            reach, least = 3 * len(self.words[t]), self.least[t]
            hits.sort()
            chain = [hits[0]]
            for hit in [*hits[1:], None]:
                if hit is not None and hit[0] - chain[-1][0] <= 2 * reach:
                    chain.append(hit)
                    continue
                at = sorted({q for q, _ in chain})
                if any(at[i + least - 1] - at[i] <= reach for i in range(len(at) - least + 1)):
                    drift = [q - p for q, p in chain]
                    out.append((t, max(0, at[0] - reach), min(len(h), at[-1] + reach + GRAM), min(drift), max(drift)))
                chain = [hit]
        return out

    def _places(self, t: int, h: np.ndarray, start: int, end: int, low: int, high: int) -> list[tuple[int, int, int]]:
        """(first word, matched words, word after the last) of all counted alignments between two words."""
        own, need = self.words[t], self.need[t]
        m = len(own)
        out, todo = [], [(start, end)]
        while todo:
            a, b = todo.pop()
            near = h[a:b]
            if len(near) < need or int(np.isin(own, near).sum()) < need:
                continue
            whole = next((i for i in np.flatnonzero(near[: len(near) - m + 1] == own[0]).tolist() if np.array_equal(near[i : i + m], own)), None) if len(near) >= m else None
            if whole is not None:
                n, s, e = m, whole, whole + m
            else:
                middle = (low + high) // 2
                n, s, e = align(own, near, middle - a, 2 * m + (high - low + 1) // 2)
            if n < need:
                continue
            out.append((a + s, n, a + e))
            todo += [(a, a + s), (a + e, b)]
        return sorted(out)

    def scan(self, text: str | None, percent: int) -> list[dict]:
        if percent != self.percent:
            raise ValueError("the index was made for another threshold")
        h = word_hashes(plain_words(text))
        found = sorted((a, t, n, e) for t, *place in self.candidates(h) for a, n, e in self._places(t, h, *place))
        if not found:
            return []
        spans = [(w.start(), w.end()) for w in _WORD.finditer(text)]
        rows = [{"license": self.names[t], "n_words": len(self.words[t]), "n_matched": n, "start": spans[a][0], "end": spans[e - 1][1]} for a, t, n, e in found]
        return sorted(rows, key=lambda r: (r["license"], r["start"]))


def read_templates(spark: SparkSession, folder: str) -> dict[str, str]:
    """Templates from a folder of text files, one each; a file's name without its ending is the license's."""
    files = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("name"), "value")
    if (files.agg(F.sum(F.char_length("value"))).first()[0] or 0) > MAX_TEMPLATE_CHARS:
        raise ValueError(f"templates of more than {MAX_TEMPLATE_CHARS} characters")
    found: dict[str, str] = {}
    for r in files.collect():
        if found.setdefault(r.name, r.value) is not r.value:
            raise ValueError(f"two templates are named {r.name!r}")
    return found


def scan_licenses(df: DataFrame, text: str = "text", templates: dict[str, str] | None = None, percent: int = PERCENT) -> DataFrame:
    """Add licenses: for every place where enough of a template stands its name, words, matched words and span.

    Spans are code points of the text, the end is exclusive. A column licenses in the input is replaced.

    Edge cases: a null or empty text has none; texts are scanned whole; several places of one template are all
    reported, best first, and none overlap. A template without words is nowhere. Repeated rows are each scanned. An
    empty table gives an empty result.
    """
    given = TEMPLATES if templates is None else templates
    kept = columns_but(df, ("licenses",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = process_cache()
        key = ("licenses", percent, tuple(sorted(given.items())))
        if key not in cache:
            cache[key] = Templates(given, percent)
        index = cache[key]
        kind = pa.list_(pa.struct([("license", pa.string()), ("n_words", pa.int32()), ("n_matched", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = pa.array([index.scan(t.as_py(), percent) for t in batch.column(text)], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "licenses"])

    return map_batches(df, kept, run, ("licenses", FOUND))
