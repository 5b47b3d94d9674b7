"""Licence scan: normalised text against licence templates by the Dice coefficient of word bigrams.

A licence stands wherever a window of words has a coefficient of at least ``least`` with its
template.  Two bags of bigrams with sizes m and n have a coefficient of at most
2 min(m, n) / (m + n), so for each template only windows between two sizes are compared; the
best one begins and ends with a bigram of the template, so only windows between places of
these are.

A window of that coefficient lacks fewer than a third of the template's bigrams (at 0.8), so
of any third and one more of them it holds one.  Each template's rarest ones by length of
their words are looked up in all texts by hash, and only texts that hold one are compared with
that template: no list of licence words decides.

Defined results: a null or empty text has no licence; a document has one row for each
template that it matches, with the best window's coefficient and place, but none for a
template that another one beats where it stands; ties go to the earlier, then the shorter
window; repeated rows each count; an empty table gives no rows; very long texts are read some
documents at a time, one longer text by itself; other columns are ignored.  Case and
punctuation don't count; letters beyond ASCII divide words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .wordhash import ngram_hashes, text_buffers, word_chunks

LEAST_DICE = 0.8
SAME_PLACE = 0.8  # windows this near in length stand for one place

#: The opening or short notices of common licences.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT-notice": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "LGPL": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "BSD": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:""",
    "BSD-conditions": """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "BSD-disclaimer": """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "MIT-disclaimer": """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "All-rights-reserved": "Copyright. All rights reserved.",
}
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_LOWER = {c: c + 32 for c in range(65, 91)}
_PLAIN = np.full(256, 32, dtype=np.uint8)  # letters and digits in lower case, all else a space
_PLAIN[48:58], _PLAIN[97:123], _PLAIN[65:91] = np.arange(48, 58), np.arange(97, 123), np.arange(97, 123)


def words_of(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) in lower case."""
    return [(m.group(), m.start(), m.end()) for m in _WORD.finditer(text.translate(_LOWER))]


def bigrams(text: str) -> Counter:
    words = [w for w, _, _ in words_of(text)]
    return Counter(zip(words, words[1:], strict=False)) if len(words) > 1 else Counter(words)


def dice(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return 2.0 * both / max(1, sum(a.values()) + sum(b.values()))


def _seam(a: str, b: str) -> str:
    """The end of a word and the beginning of the next, cut at all marks, as they stand side by side in a text."""
    return f"{re.split('[.-]', a)[-1]} {re.split('[.-]', b)[0]}"


def _seam_hashes(seams: list[str]) -> np.ndarray:
    offsets, data = text_buffers(pa.array(seams, pa.string()))
    return np.concatenate([ngram_hashes(c.hashes[lo:hi], 2) for c in word_chunks(offsets, data) for lo, hi in zip(c.bounds, c.bounds[1:], strict=False)])


class Templates:
    """Templates of at least two words, their sizes, and the bigrams of which a near window holds one."""

    def __init__(self, templates: dict[str, str], least: float) -> None:
        self.least = least
        self.all = sorted((sum(g.values()), name, g) for name, g in ((k, bigrams(v)) for k, v in templates.items()))
        if short := [name for _, name, g in self.all if not all(isinstance(x, tuple) for x in g)] or [n for s, n, _ in self.all if not s]:
            raise ValueError(f"templates need two words: {short}")
        self.having: dict[tuple[str, str], list[int]] = {}
        self.telling: dict[str, list[int]] = {}
        for k, (size, _, grams) in enumerate(self.all):
            for gram in grams:
                self.having.setdefault(gram, []).append(k)
            lacking = size - math.ceil(self.fewest(size) - 1e-9)  # bigrams that a near window may lack, each as often as it comes
            for gram in sorted(grams, key=lambda x: (-len(x[0]) - len(x[1]), x)):
                self.telling.setdefault(_seam(*gram), []).append(k)
                lacking -= grams[gram]
                if lacking < 0:
                    break
        seams = sorted(self.telling)
        hashes = _seam_hashes(seams) if seams else np.zeros(0, dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.of_hash = hashes[order], [self.telling[seams[i]] for i in order]

    def fewest(self, size: int) -> float:
        """The least number of shared bigrams (and the least size) of a window near a template of ``size``."""
        return size * self.least / (2 - self.least)

    def candidates(self, texts: pa.Array) -> dict[int, set[int]]:
        """The templates that each text may hold, by the texts' places."""
        out: dict[int, set[int]] = {}
        offsets, data = text_buffers(texts)
        for c in word_chunks(offsets, _PLAIN[data], lower=False) if len(self.hashes) else ():
            pairs = ngram_hashes(c.hashes, 2)
            place = np.minimum(np.searchsorted(self.hashes, pairs), len(self.hashes) - 1)
            at = np.flatnonzero(self.hashes[place] == pairs)
            owner = np.searchsorted(c.bounds, at, side="right") - 1
            for d, k in np.unique(np.column_stack([owner, place[at]])[at + 2 <= c.bounds[owner + 1]], axis=0).tolist():
                out.setdefault(c.first + d, set()).update(self.of_hash[k])
        return out

    def windows(self, text: str, which: set[int]) -> Iterator[tuple[str, float, int, int]]:
        """(licence, coefficient, start, end) of the best word window of each of the templates ``which``, if it is near enough."""
        words = words_of(text)
        grams = [(a[0], b[0]) for a, b in zip(words, words[1:], strict=False)]
        places: dict[int, list[int]] = {}
        for i, gram in enumerate(grams):
            for k in self.having.get(gram, ()):
                if k in which:
                    places.setdefault(k, []).append(i)
        for k, found in places.items():
            size, name, wanted = self.all[k]
            most = size * (2 - self.least) / self.least
            need = max(1, math.ceil(self.fewest(size) - 1e-9))  # places that a window must hold
            best = (self.least - 1e-12, 0, 0)
            for x, first in enumerate(found[: len(found) - need + 1] if len(found) >= need else ()):
                if found[x + need - 1] - first + 1 > most + 1e-9:
                    continue
                left, both = dict(wanted), 0
                for last in found[x:]:
                    length = last - first + 1
                    if length > most + 1e-9:
                        break
                    if left[grams[last]]:
                        left[grams[last]] -= 1
                        both += 1
                    value = 2.0 * both / (length + size)
                    if value > best[0] + (1e-12 if best[2] else 0.0):
                        best = (value, words[first][1], words[last + 1][2])
            if best[2]:
                yield name, *best

    def matches(self, text: str | None, which: set[int] | None = None) -> list[tuple[str, float, int, int]]:
        """(licence, coefficient, start, end) of the best window for each template.

        A window gives way only to a nearer template whose window overlaps it and is about as long or longer
        (``SAME_PLACE``): a short notice inside a licence doesn't take the licence's place.
        """
        if which is None:
            which = self.candidates(pa.array([text], pa.string())).get(0, set())
        found = sorted((-value, start, end, name) for name, value, start, end in (self.windows(text, which) if text and which else ()))
        kept: list[tuple[float, int, int, str]] = []
        for x in found:  # of templates for one place, the nearest
            if not any(x[1] < y[2] and y[1] < x[2] and x[0] > y[0] and y[2] - y[1] >= SAME_PLACE * (x[2] - x[1]) for y in kept):
                kept.append(x)
        return sorted((name, -value, start, end) for value, start, end, name in kept)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST_DICE) -> DataFrame:
    """doc_id, licence, dice, start, end for each document and template that match."""
    source = docs.select("doc_id", F.col("text").alias("__text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, licence string, dice double, start int, end int"
    held = Templates(templates, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            found = [(i, *m) for i, which in sorted(held.candidates(texts).items()) for m in held.matches(texts[i].as_py(), which)]
            rows = pa.array([f[0] for f in found], pa.int64())
            kinds = (pa.string(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), *(pa.array([f[k + 1] for f in found], kind) for k, kind in enumerate(kinds))], names=["doc_id", "licence", "dice", "start", "end"])

    return common.arrow_map(source, run, schema)
