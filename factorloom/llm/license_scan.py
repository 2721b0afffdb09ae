"""License scans: windows of the normalised text compared with licence templates by the Dice coefficient over word bigrams.

A window starts and ends at a bigram of the template. Only sizes that can still reach the threshold are looked at:
2 min(a, b) / (a + b) bounds the coefficient, which prunes templates for short texts and long windows for all.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import documents
from .slices import sliced

#: EDGE: sizes and coefficients at a bound are within it, whatever their last digit.
THRESHOLD, EDGE = 0.8, 1e-9

# Public wording of licences, of the headers they ask for, and of usual notices.
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_CLAUSES = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_ADVERTISING = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. 4. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "{work} is free software: you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_DISCLAIMER = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_CC = "This work is licensed under a Creative Commons {kind} {version} International License."
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-grant": _GRANT,
    "MIT": _GRANT + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": _GNU.format(work="This program", name="", version="3"),
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "AGPL-3.0": _GNU.format(work="This program", name="Affero ", version="3"),
    "LGPL-3.0": _GNU.format(work="This library", name="Lesser ", version="3"),
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "BSD-notice": "Released under the BSD License.",
    "BSD-grant": _BSD_GRANT,
    "BSD-2-Clause": f"{_BSD_GRANT} {_BSD_CLAUSES} {_BSD_DISCLAIMER}",
    "BSD-3-Clause": f"{_BSD_GRANT} {_BSD_CLAUSES} {_BSD_NAMES} {_BSD_DISCLAIMER}",
    "BSD-4-Clause": f"{_BSD_GRANT} {_BSD_CLAUSES} {_BSD_ADVERTISING} {_BSD_DISCLAIMER}",
    "ISC-grant": f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC": f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_DISCLAIMER}",
    "0BSD": f"{_ISC_GRANT}. {_ISC_DISCLAIMER}",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "Unlicense-notice": "This is free and unencumbered software released into the public domain.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0": _CC.format(kind="Attribution", version="4.0"),
    "CC-BY-SA-4.0": _CC.format(kind="Attribution-ShareAlike", version="4.0"),
    "CC-BY-NC-4.0": _CC.format(kind="Attribution-NonCommercial", version="4.0"),
    "CC-BY-ND-4.0": _CC.format(kind="Attribution-NoDerivatives", version="4.0"),
    "all-rights-reserved": "All rights reserved.",
}

_WORD = re.compile(r"[^\W_]+")


def bigrams(words: list[str]) -> list[tuple[str, str]]:
    return list(zip(words, words[1:]))


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.grams = {name: Counter(bigrams(_WORD.findall(text.lower()))) for name, text in templates.items()}
        self.size = {name: sum(g.values()) for name, g in self.grams.items()}
        if not all(self.size.values()):
            raise ValueError("a template needs two words at least")
        self.holders: dict[tuple[str, str], list[str]] = {}
        for name, g in self.grams.items():
            for b in g:
                self.holders.setdefault(b, []).append(name)
        self.starts = {a for a, _ in self.holders}

    def windows(self, name: str, at: list[int], grams: list[tuple[str, str]]) -> Iterator[tuple[float, int, int]]:
        """(coefficient, first bigram, last bigram) of windows that reach the threshold. at: where bigrams of the template are."""
        own, size = self.grams[name], self.size[name]
        low, high = size * self.threshold / (2 - self.threshold) - EDGE, size * (2 - self.threshold) / self.threshold + EDGE
        for i, start in enumerate(at):
            left, common = dict(own), 0
            for end in at[i:]:
                length = end - start + 1
                if length > high:
                    break
                if left[grams[end]]:
                    left[grams[end]] -= 1
                    common += 1
                if length >= low and 2 * common >= self.threshold * (size + length) - EDGE:
                    yield 2 * common / (size + length), start, end

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(template, coefficient, start, stop in code points): disjoint windows, the best first; ties go to the longer, then the earlier, then the name."""
        lowered = (text or "").lower()
        words = _WORD.findall(lowered)
        if len(words) < 2 or self.starts.isdisjoint(words):
            return []
        at: dict[str, list[int]] = {}
        grams = bigrams(words)
        for i, b in enumerate(grams):
            for name in self.holders.get(b, ()):
                at.setdefault(name, []).append(i)
        found = []
        for name, places in at.items():
            least = self.size[name] * self.threshold / (2 - self.threshold) - EDGE
            if len(places) >= least:
                found += [(-dice, start - end, start, name, end) for dice, start, end in self.windows(name, places, grams)]
        if not found:
            return []
        # lower-casing may lengthen a text, so places are looked up in a text whose characters keep theirs
        same = lowered if len(lowered) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
        spans, taken, out = [m.span() for m in _WORD.finditer(same)], set(), []
        if len(spans) != len(words):
            spans = [m.span() for m in _WORD.finditer(lowered)]
        for minus, _, start, name, end in sorted(found):
            if taken.isdisjoint(range(start, end + 1)):
                taken.update(range(start, end + 1))
                out.append((name, -minus, spans[start][0], spans[end + 1][1]))
        return out


def licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each licence text found: doc_id, license_id, dice, start and stop in code points.

    Windows of a text don't overlap; the best coefficient goes first, ties go to the longer, then the earlier window,
    then the first name. Texts without any licence, null or empty, have no row; long texts are scanned whole. Repeated
    rows and null ids are rows of their own, other columns are not read, an empty table gives an empty one."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for batch in sliced(batches, 1):
            rows, which = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for found in scanner.scan(text):
                    rows.append(found)
                    which.append(i)
            columns = zip(*rows) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int32())), *[pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.float64(), pa.int32(), pa.int32()))]], ["doc_id", "license_id", "dice", "start", "stop"])

    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return slim.mapInArrow(task, slim.select("doc_id").schema.add("license_id", "string").add("dice", "double").add("start", "integer").add("stop", "integer"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence texts in every row of documents; see ``licenses`` for nulls, ties, long texts, repeats and other columns."""
    return licenses(documents(spark, sf_dir))
