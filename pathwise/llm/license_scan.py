"""License scans: winnowed fingerprints pick candidates, banded alignment confirms them.

Templates are normalised to words. Of each template's word k-grams, the least hash of every ``WINNOW``
consecutive ones is kept in an inverted index from fingerprint to (template, place). All k-grams of a
text are looked up, so any passage that shares WINNOW + GRAM - 1 consecutive words with a template meets
a fingerprint. Hits whose diagonals lie within ``BAND`` of each other and whose places in the text lie
within a template's length form a candidate region; a banded alignment of the template with the region
counts the template's words found in order. A match covers at least ``MIN_COVERAGE`` of them. Its words are
taken out and what hits are left are searched again, so neighbouring copies are found one by one. At last
hits whose diagonals lie within ``GAP`` are joined and aligned in as wide a band: a template into which up
to so many words were inserted.

The index is built from a list of templates of a checked size (``MAX_TEMPLATE_BYTES``) and shipped to
the tasks; no rows are shuffled.

Defined results: a null text has no match; of overlapping matches of one template the one with the
higher coverage, then the earlier, is reported; matches of different templates may overlap; a template
with no words is refused; repeated rows are repeated; an empty table gives no rows. A text is held by one
task, with some 40 bytes for each of its own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pathwise.llm.text import ALNUM, Texts, Words, mix, slices

GRAM = 3
WINNOW = 2
BAND = 8
#: Words that may be inserted into a template, less the template's own that are dropped behind them.
GAP = 60
MIN_COVERAGE = 0.8
MAX_TEMPLATE_BYTES = 1 << 22

_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Notices, headers and full texts of public licenses, without their copyright lines.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause": _CONDITIONS + _DISCLAIMER,
    "BSD-3-Clause": (
        _CONDITIONS + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission. " + _DISCLAIMER
    ),
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see "
        "<https://www.gnu.org/licenses/>."
    ),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MIT-notice": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
        "IN THE SOFTWARE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
        "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it "
        "and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that "
        "you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is "
        "not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This "
        "notice may not be removed or altered from any source distribution."
    ),
}


def _grams(h: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM-word runs that start at each place."""
    n = max(0, len(h) - GRAM + 1)
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out = mix(out + h[k : k + n] * np.uint64(2 * k + 3))
    return out


def winnow(grams: np.ndarray, window: int = WINNOW) -> list[int]:
    """Places of the least hash (the last of equals) of every window of consecutive grams."""
    if not len(grams):
        return []
    if len(grams) <= window:
        return [len(grams) - 1 - int(np.argmin(grams[::-1]))]
    return sorted({i + window - 1 - int(np.argmin(grams[i : i + window][::-1])) for i in range(len(grams) - window + 1)})


class Index:
    def __init__(self, templates: dict[str, str]) -> None:
        if sum(len(t.encode()) for t in templates.values()) > MAX_TEMPLATE_BYTES:
            raise ValueError("the templates are too large for one index; scan with parts of the list")
        self.names = sorted(templates)
        words = Words(Texts(pa.array([templates[k] for k in self.names], pa.string())), ALNUM)
        h = words.hashes()
        self.words = [h[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        if any(len(w) < GRAM for w in self.words):
            raise ValueError(f"a template needs {GRAM} words")
        self.vocabulary = np.unique(h)
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, w in enumerate(self.words):
            g = _grams(w)
            for i in winnow(g):
                self.places[int(g[i])].append((t, i))
        self.prints = np.array(sorted(self.places), np.uint64)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in a run of texts' words where a fingerprint starts, and the fingerprints."""
        known = self.sieve[(h & np.uint64((1 << 20) - 1)).astype(np.int64)]
        run = known[: max(0, len(h) - GRAM + 1)].copy()
        for k in range(1, GRAM):
            run &= known[k : k + len(run)]
        for edge in first[1:-1]:
            run[max(0, edge - GRAM + 1) : edge] = False
        at = np.flatnonzero(run)
        if not len(at):
            return at, np.zeros(0, np.uint64)
        g = np.zeros(len(at), np.uint64)
        for k in range(GRAM):
            g = mix(g + h[at + k] * np.uint64(2 * k + 3))
        j = np.minimum(np.searchsorted(self.prints, g), len(self.prints) - 1)
        same = self.prints[j] == g
        return at[same], g[same]

    def matches(self, h: np.ndarray, at: list[int], prints: list[int]) -> list[tuple[int, int, int, float]]:
        """(template, from, to, coverage) of a text's words ``h`` with fingerprints at places ``at``."""
        by: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for p, g in zip(at, prints, strict=True):
            for t, i in self.places[g]:
                by[t].append((p, p - i))
        out = []
        for t, hits in by.items():
            w, free, hits = self.words[t], h.copy(), sorted(hits)
            for apart in (BAND, GAP):
                while hits:
                    found = [m for d, band in regions(hits, len(w), apart) if (m := align(w, free, d, band)) and m[2] >= MIN_COVERAGE]
                    taken: list[tuple[int, int, float]] = []
                    for a, b, c in sorted(found, key=lambda m: (-m[2], m[0])):
                        if all(b <= x or a >= y for x, y, _ in taken):
                            taken.append((a, b, c))
                    if not taken:
                        break
                    for a, b, _ in taken:
                        free[a:b] = 0  # no word of a template
                    out += [(t, *m) for m in taken]
                    hits = [x for x in hits if free[x[0]] and free[x[0] + GRAM - 1]]
        return sorted(out, key=lambda m: (m[1], m[0]))


def regions(hits: list[tuple[int, int]], length: int, apart: int) -> list[tuple[int, int]]:
    """(diagonal, half the band's width) of each run of hits (place, diagonal; sorted) for a template of that length."""
    done, open_ = [], []  # of [first diagonal, least, greatest, last place]
    for p, d in hits:
        gone = [r for r in open_ if p - r[3] > length + BAND]
        if gone:
            done += gone
            open_ = [r for r in open_ if p - r[3] <= length + BAND]
        for r in open_:
            if abs(r[0] - d) <= apart:
                r[1:] = [min(r[1], d), max(r[2], d), p]
                break
        else:
            open_.append([d, d, d, p])
    if apart == BAND:
        return [(r[0], BAND) for r in done + open_]
    return [((r[1] + r[2]) // 2, (r[2] - r[1] + 1) // 2 + BAND) for r in done + open_]


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, float] | None:
    """The best ordered common words of a template and a text within ``band`` of a diagonal.

    Returns the text's span from the first to behind the last common word, and the share of template
    words that are common. Cell (i, k) stands for template word i and text word i + diagonal - band + k.
    """
    width = 2 * band + 1
    empty = (0, -1, 0)  # common words, first place, less the last place: of equal counts the tightest span
    before = [empty] * (width + 1)
    for i, w in enumerate(template.tolist()):
        now = [empty] * (width + 1)
        left = empty
        for k in range(width):
            j = i + diagonal - band + k
            best = max(before[k + 1], left)  # skip the template word, or the text word
            if 0 <= j < len(text) and int(text[j]) == w:
                n, first, _ = before[k]
                best = max(best, (n + 1, first if n else j, -j))
            now[k] = left = best
        before = [*now[:width], empty]
    n, first, last = max(before)
    return (first, 1 - last, n / len(template)) if n else None


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_matches, licenses (sorted, comma-joined) and spans of every row.

    spans lists template:start:end:coverage in order of start; positions are code points of the text.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(Index(TEMPLATES if templates is None else templates))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shipped.value
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = Texts(batch.column(1))
                words = Words(texts, ALNUM)
                h, first = words.hashes(), words.first
                at, prints = index.hits(h, first)
                owner = np.searchsorted(first, at, "right") - 1
                n, names, spans = [0] * len(texts), [""] * len(texts), [""] * len(texts)
                for k in np.unique(owner).tolist():
                    a, b, mine = int(first[k]), int(first[k + 1]), owner == k
                    found = index.matches(h[a:b], (at[mine] - a).tolist(), prints[mine].tolist())
                    if found:
                        start = int(texts.start[k])
                        point = lambda byte, start=start: len(texts.slice_bytes(start, byte).decode())
                        n[k] = len(found)
                        names[k] = ",".join(sorted({index.names[t] for t, *_ in found}))
                        spans[k] = ",".join(f"{index.names[t]}:{point(int(words.starts[a + x]))}:{point(int(words.ends[a + y - 1]))}:{c:.3f}" for t, x, y, c in found)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(names, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_matches", "licenses", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_matches long, licenses string, spans string")
