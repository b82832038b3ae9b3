"""License scans: winnowed fingerprints of templates find candidates, banded alignment confirms them."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.scratch import slices

# Texts of public licenses and the notices that name them.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_GNU = "This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this {what}"
_GNU_NAMES = {"gpl": "General Public License", "lgpl": "Lesser General Public License", "agpl": "Affero General Public License"}
TEMPLATES = {
    "apache-2.0-name": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-2-clause": f"{_BSD_HEAD} {_BSD_TAIL}",
    "bsd-3-clause": f"{_BSD_HEAD} {_BSD_NAMES} {_BSD_TAIL}",
    "bsd-name": "Released under the BSD License",
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "mit": f'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}',
    "mit-name": "Released under the MIT License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}
#: What tells a template's license from its kin: words that a span must have matched, in order, and words that it must not hold.
TELLING = {"apache-2.0-name": ("apache 2", ""), "bsd-2-clause": ("", "neither"), "bsd-3-clause": ("neither name", ""), "bsd-name": ("bsd", ""), "mit-name": ("mit", "")}
for _short, _version in (("gpl", "2"), ("gpl", "3"), ("lgpl", "2.1"), ("lgpl", "3"), ("agpl", "3")):
    _id, _old, _name = f"{_short}-{_version if '.' in _version else _version + '.0'}", _version[0] == "2", _GNU_NAMES[_short]
    _what = "library" if _short == "lgpl" else "program"
    _end = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA." if _old else ". If not, see <https://www.gnu.org/licenses/>."
    TEMPLATES[f"{_id}-notice"] = _GNU.format(what=_what, colon=";" if _old else ":", name=_name, version=_version) + _end
    TEMPLATES[f"{_id}-name"] = f"licensed under the GNU {_name}, version {_version}"
    _kin = {"gpl": ("general public", "lesser affero"), "lgpl": ("lesser general public", "affero"), "agpl": ("affero general public", "lesser")}[_short]
    TELLING[f"{_id}-notice"] = TELLING[f"{_id}-name"] = (f"{_kin[0]} version {_version.replace('.', ' ')}", _kin[1])
for _version in ("3.0", "4.0"):
    for _kind in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"):
        TEMPLATES[f"cc-{_kind}-{_version}-name"] = f"Licensed under CC {_kind.upper()} {_version}"
        TELLING[f"cc-{_kind}-{_version}-name"] = (f"cc {_kind.replace('-', ' ')} {_version[0]}", " ".join({"sa", "nd", "nc"} - set(_kind.split("-"))))
WORD = re.compile(r"[a-z0-9]+")
SCHEMA = "doc_id long, license string, coverage double, start int, end int"


def hashes(words: list[str], k: int) -> np.ndarray:
    """A hash of each k words in a row, mixed from the words' own checksums."""
    codes = np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint64, len(words))
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out ^ codes[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the rightmost least hash of each window; all places' least if there are fewer."""
    if len(h) == 0:
        return np.zeros(0, np.int64)
    width = min(window, len(h))
    views = np.lib.stride_tricks.sliding_window_view(h[::-1], width)
    return np.unique(len(h) - 1 - (views.argmin(1) + np.arange(len(views))))


class Scanner:
    """An inverted index over winnowed fingerprints of templates, and the alignment that confirms its candidates.

    Of each window k-grams in a row of a template the index holds one at least, so any
    window + k - 1 words that a text shares with it in a row are met, as all k-grams of a
    text are looked up. Where at most a share 1 - least of a template's n words is changed,
    dropped or parted by words put between, some run of its words stays whole with at least
    least * n / ((1 - least) * n + 1) of them: with 0.8 more than three, so four, once n is
    16 or more. So with k = 3 and a window of 2 no such copy is missed. Shorter templates
    are indexed by all their k-grams, or by all shorter ones where no run of k is sure.

    drift is how far, as a share of the template's words, words put in or dropped may move
    the rest of a copy; the band of the alignment is so wide on either side.
    """

    def __init__(self, templates: dict[str, str], k: int = 3, window: int = 2, drift: float = 0.5, least: float = 0.8, whole: int = 16):
        self.least = least
        self.words = {name: WORD.findall(text.lower()) for name, text in templates.items()}
        self.band = {name: max(2, round(drift * len(words))) for name, words in self.words.items()}
        self.masks = {}
        self.index: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for name, words in self.words.items():
            lost = int((1 - least) * len(words) + 1e-9)
            size = max(1, min(k, -(-(len(words) - lost) // (lost + 1))))
            h = hashes(words, size)
            for at in winnow(h, window if len(words) >= whole else 1).tolist():
                self.index[size][int(h[at])].append((name, at))
            masks: dict[str, int] = {}
            for at, word in enumerate(words):
                masks[word] = masks.get(word, 0) | 1 << at
            self.masks[name] = masks
        self.keys = {size: np.array(sorted(index), np.uint64) for size, index in self.index.items()}
        self.telling = {name: tuple(x.split() for x in TELLING[name]) for name, text in templates.items() if name in TELLING and text == TEMPLATES[name]}

    def common(self, name: str, text: list[str]) -> int:
        """Words of a template that a stretch has in order, whatever the diagonals: a bound of every alignment, by bits."""
        size, masks = len(self.words[name]), self.masks[name]
        full = v = (1 << size) - 1
        for word in text:
            if m := masks.get(word):
                u = v & m
                v = ((v + u) | (v - u)) & full
        return size - v.bit_count()

    def aligned(self, template: list[str], text: list[str], shift: int, band: int) -> tuple[int, int, int]:
        """(words matched, first, last place in text) of the best alignment whose diagonals differ from shift by at most band; of equal ones the shortest."""
        width = 2 * band + 1
        before = [(0, 0, None, None)] * width  # matched, less the stretch between first and last, first, last
        for i, word in enumerate(template):
            row = [(0, 0, None, None)] * width
            for d in range(width):
                j = i + shift + d - band
                best = before[d + 1] if d + 1 < width else (0, 0, None, None)
                if d and row[d - 1][:2] > best[:2]:
                    best = row[d - 1]
                if 0 <= j < len(text) and text[j] == word:
                    n, _, first, _ = before[d]
                    first = j if first is None else first
                    if (n + 1, first - j) > best[:2]:
                        best = (n + 1, first - j, first, j)
                elif before[d][:2] > best[:2]:
                    best = before[d]
                row[d] = best
            before = row
        n, _, first, last = max(before, key=lambda x: x[:2])
        return n, first, last

    def told(self, name: str, span: list[str]) -> bool:
        """Whether a span has the words, in order, that tell a short template's license from its kin, and none that speaks against it."""
        needed, barred = self.telling.get(name, ((), ()))
        rest = iter(span)
        return all(w in rest for w in needed) and not set(barred) & set(span)

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(license, coverage, start, end) in code points.

        Of overlapping spans of one template the better, then the earlier stays; of spans
        of two templates, one of which lies in the other by half of its words or more, the
        one with more words matched, then with the higher coverage.
        """
        low = text.lower()
        if len(low) != len(text):  # some capitals become two characters; they stay as they are
            low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
        spans = [m.span() for m in WORD.finditer(low)]
        words = [low[a:b] for a, b in spans]
        diagonals = defaultdict(list)
        for size, keys in self.keys.items():
            h = hashes(words, size)
            for at in np.flatnonzero(np.isin(h, keys)).tolist():
                for name, i in self.index[size][int(h[at])]:
                    diagonals[name].append((at - i, at))
        every = []
        for name, hits in diagonals.items():
            hits.sort()
            groups, template = [[hits[0][0], hits[0][0]]], self.words[name]
            band = self.band[name]
            for shift, _ in hits[1:]:
                if shift - groups[-1][0] > band:
                    groups.append([shift, shift])
                groups[-1][1] = shift
            found = []
            for a, b in groups:
                middle, enough = (a + b) // 2, self.least * len(template)
                if self.common(name, words[max(0, middle - band) : max(0, middle + len(template) + band)]) < enough:
                    continue
                n, first, last = self.aligned(template, words, middle, band)
                if n >= enough and self.told(name, words[first : last + 1]):
                    found.append((-n, first, last))
            kept = []
            for n, first, last in sorted(found):
                if all(last < a or first > b for _, a, b in kept):
                    kept.append((n, first, last))
            every += [(n, n / len(template), name, a, b) for n, a, b in kept]
        out, best = [], []
        for n, coverage, name, a, b in sorted(every):
            if all(other == name or 2 * (min(b, d) - max(a, c) + 1) < min(b - a, d - c) + 1 for other, c, d in best):
                best.append((name, a, b))
                out.append((name, -coverage, spans[a][0], spans[b][1]))
        return sorted(out, key=lambda x: (x[2], x[0], x[3]))


def license_spans(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = 0.8, drift: float = 0.5) -> DataFrame:
    """(doc_id, license, coverage, start, end): a row for each span that covers a template's words, in order, to a share of least or more.

    start and end count code points of the whole text, end exclusive. Documents without a
    match, empty or null texts give no row; repeated rows give theirs each. Nothing is
    shuffled: the templates, a fixed list, go with the function. least and drift: see Scanner.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least=least, drift=drift)
        for x in slices(batches):
            ids = x.column("doc_id").to_pylist()
            rows = [(d, *found) for d, t in zip(ids, x.column("text").to_pylist(), strict=True) if t for found in scanner.scan(t)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "license", "coverage", "start", "end"])

    types = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32()]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
