"""License scan: winnowed fingerprints pick candidates, banded alignment measures them.

The templates are few and fixed, so their inverted index (fingerprint to template and place) goes to
every task. A document is read once; each place of it that shares fingerprints with a template is aligned with
that template inside a band, and the matched part of the template and its span in the text are reported.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from vaporlog.llm.common import text_of, with_library
from vaporlog.llm.sets import shingle_numbers
from vaporlog.llm.tokens import texts_of

#: Words of a fingerprint, and fingerprints of a window of which the smallest is kept.
GRAM, WINDOW = 3, 3
#: Words by which an alignment may leave its diagonal.
BAND = 8
#: Least share of a template's words that must match.
COVERAGE = 0.6

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_DISCLAIMER = (
    " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_DISCLAIMER = (
    " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
    "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)


def _gnu(name: str, version: str) -> str:
    """The file notice of a GNU license."""
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as "
        f"published by the Free Software Foundation, either version {version} of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        f"the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. "
        f"You should have received a copy of the GNU {name} along with this program. If not, see "
        "<https://www.gnu.org/licenses/>."
    )


def _creative(kind: str) -> str:
    return f"This work is licensed under a Creative Commons {kind} 4.0 International License."


#: Whole license texts (the longer ones in the folder license_texts), file notices and lines in common use (public wording).
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
        + _MIT_DISCLAIMER
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
        + _ISC_DISCLAIMER
    ),
    "BSD-2-Clause": _BSD + _BSD_DISCLAIMER,
    "BSD-3-Clause": _BSD + _BSD_THIRD + _BSD_DISCLAIMER,
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-2.0-notice": _gnu("General Public License", "2"),
    "GPL-3.0-notice": _gnu("General Public License", "3"),
    "LGPL-2.1-notice": _gnu("Lesser General Public License", "2.1"),
    "LGPL-3.0-notice": _gnu("Lesser General Public License", "3"),
    "AGPL-3.0-notice": _gnu("Affero General Public License", "3"),
    "CC-BY-SA-4.0-line": _creative("Attribution-ShareAlike"),
    "CC-BY-NC-4.0-notice": _creative("Attribution-NonCommercial"),
    "CC-BY-NC-SA-4.0-line": _creative("Attribution-NonCommercial-ShareAlike"),
    "CC-BY-ND-4.0-line": _creative("Attribution-NoDerivatives"),
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}

TEMPLATES |= {path.stem: path.read_text("utf-8") for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}

_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
_PLACE = re.compile(r"[A-Za-z0-9\u0080-\U0010FFFF]+")


def _numbers(words: list) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), "uint64", len(words))


def winnow(grams: np.ndarray, window: int = WINDOW) -> list[int]:
    """Places of the smallest gram of every window, the rightmost of equal ones."""
    places: list[int] = []
    for i in range(max(1, len(grams) - window + 1) if len(grams) else 0):
        part = grams[i:i + window]
        at = i + len(part) - 1 - int(np.argmin(part[::-1]))
        if not places or places[-1] != at:
            places.append(at)
    return places


def align(text: np.ndarray, template: np.ndarray, start: int = 0, band: int = BAND) -> tuple[int, int, int]:
    """Most template words in order inside the band: how many, first matched place in the text, and the place after the last.

    text[i] may stand for template[j] while |i - start - j| <= band.
    """
    best: dict[int, tuple[int, int, int]] = {}  # by i - start - j: matched, first, stop
    n = len(text)
    for j, word in enumerate(template.tolist()):
        now: dict[int, tuple[int, int, int]] = {}
        for d in range(-band, band + 1):
            i = start + j + d
            options = [best.get(d + 1, (0, -1, -1)), now.get(d - 1, (0, -1, -1))]  # leave out a word of either side
            if 0 <= i < n and int(text[i]) == word:
                count, first, _ = best.get(d, (0, -1, -1))
                options.insert(0, (count + 1, first if count else i, i + 1))  # before equal ones of other diagonals
            now[d] = max(options, key=lambda x: (x[0], -(x[2] - x[1])))
        best = now
    # of equal ones the nearest diagonal, so each of several copies in a row has its own
    return max(best.items(), key=lambda x: (x[1][0], -(x[1][2] - x[1][1]), -abs(x[0])), default=(0, (0, -1, -1)))[1]


def most(text: np.ndarray, template: np.ndarray, start: int, band: int = BAND) -> int:
    """Template words that stand anywhere in their part of the band: no alignment has more."""
    n = len(template)
    part = np.zeros(n + 2 * band, "uint64")
    there = np.zeros(n + 2 * band, bool)
    low, high = max(start - band, 0), min(start + n + band, len(text))
    if high > low:
        at = low - (start - band)
        part[at:at + high - low] = text[low:high]
        there[at:at + high - low] = True
    found = np.zeros(n, bool)
    for d in range(2 * band + 1):
        found |= (part[d:d + n] == template) & there[d:d + n]
    return int(np.count_nonzero(found))


class Scanner:
    """The inverted index of all templates."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.templates = {name: _numbers(_WORD.findall(text.encode().lower())) for name, text in templates.items()}
        index = defaultdict(list)
        for name, words in self.templates.items():
            grams = shingle_numbers(words, min(GRAM, len(words)))
            for at in winnow(grams):
                index[int(grams[at])].append((name, at))
        self.index = dict(index)
        self.known = np.array(sorted(self.index), "uint64")

    def scan(self, text: str, coverage: float) -> list[tuple[str, float, int, int]]:
        """Matches: template, share of its words, and the span in code points. The best of places that overlap stays."""
        numbers = _numbers(_WORD.findall(text.encode("utf-8").lower()))
        if len(numbers) < GRAM or not len(self.known):
            return []
        grams = shingle_numbers(numbers, GRAM)
        at = np.searchsorted(self.known, grams)
        at[at == len(self.known)] = 0
        hits = np.flatnonzero(self.known[at] == grams)
        starts: dict[str, set[int]] = defaultdict(set)
        for i in hits.tolist():
            for name, place in self.index[int(grams[i])]:
                if len(numbers) >= coverage * len(self.templates[name]):
                    starts[name].add(i - place)
        found = []
        for name, places in starts.items():
            template, done = self.templates[name], set()
            for start in sorted(places):
                if start in done or most(numbers, template, start) < coverage * len(template):
                    continue
                matched, first, stop = align(numbers, template, start)
                if matched >= coverage * len(template):
                    found.append((name, matched / len(template), first, stop))
                    if matched == len(template) == stop - first:
                        done.add(first)  # its own diagonal, word for word
        found.sort(key=lambda m: (-round(m[1] * len(self.templates[m[0]])), -m[1], m[2], m[0]))
        chosen: list[tuple[str, float, int, int]] = []
        for match in found:
            if all(match[3] <= other[2] or match[2] >= other[3] for other in chosen):
                chosen.append(match)
        if not chosen:
            return []
        spans = [m.span() for m in _PLACE.finditer(text)]
        if len(spans) != len(numbers):  # bytes and characters part words alike; a lone surrogate could not
            return [(n, c, -1, -1) for n, c, _, _ in chosen]
        return sorted(((n, c, spans[a][0], spans[b - 1][1]) for n, c, a, b in chosen), key=lambda m: (m[2], m[0]))


_scanners: dict[tuple, Scanner] = {}


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per match: doc_id, license, coverage, span_start, span_end (code points), matched text.

    Documents without a match, null and empty texts give no row; repeated rows give repeated matches; other columns are
    ignored. Of matches that overlap, the one with most matched words stays, of ties the one with the
    greater coverage, then the first in the text, then by name.
    """
    with_library(docs.sparkSession)
    fixed = tuple((templates or TEMPLATES).items())
    rows = docs.select(docs[id_column].alias("doc_id"), text_of(docs, text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if fixed not in _scanners:
            _scanners[fixed] = Scanner(dict(fixed))
        scan = _scanners[fixed].scan
        for batch in batches:
            row, out = [], []
            for i, text in enumerate(texts_of(batch.column(1))):
                for name, share, start, stop in scan(text, coverage):
                    row.append(i)
                    out.append((name, share, start, stop, text[start:stop]))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                names=["doc_id", "license", "coverage", "span_start", "span_end", "matched"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, license string, coverage double, span_start long, span_end long, matched string")
