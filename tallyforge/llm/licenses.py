"""Licence scans: normalised text against licence templates by Dice coefficient over word bigrams.

Text and templates are normalised alike (lower case, words of letters and digits, marks dropped, one spelling of
"license", "v2" and "2.0" read as 2). A stretch of a text is compared with a template by the multiset Dice coefficient
of their word bigrams: twice the shared over the sum of both sizes. Stretches are proposed where a template's bigrams
occur: hits no farther apart than the template is long form a group, and the group's best window of any length is
taken. Size bounds prune first: a window of a bigrams and a template of b can reach t only if
t / (2 - t) <= a / b <= (2 - t) / t, and only if at least t / (2 - t) * b hits lie within the longest such window. All
work is inside a row; only found (document, licence) rows leave the scan.

Dice alone can't tell licences that differ in a word, so a window counts only if its telling words (TELLING: names,
and version numbers behind them) are those of the template and no version or modifier stands right beside it:
"version 2" is never a find of a version 3 notice, nor an Affero licence one of a plain one. Of overlapping finds the one with
the larger net evidence stays: bigrams shared, less those of either side that are not.

Defined cases: null and empty texts hold none; ties of evidence go to the better Dice, then the name, then the first;
the same licence found twice in a text is reported once, at its best, with the number of places; very long texts are
scanned whole; a null document id is carried; repeated rows are each reported; an empty table gives an empty result;
further columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import small, trimmed

WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
_VERSION = re.compile(r"v?([0-9]+(?:\.[0-9]+)*)\Z")
_SPELLING = {"licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense"}
THRESHOLD = 0.8

#: Words that tell licences apart. Numbers do if they follow one of BEFORE_VERSION.
TELLING = frozenset(
    "affero lesser library apache mit isc bsd mozilla eclipse boost unlicense zlib artistic gpl lgpl agpl mpl epl cc cc0 "
    "nc noncommercial sa sharealike nd noderivatives noderivs later only endorse advertising wtfpl".split()
)
#: Those that change the meaning of a notice they stand next to.
MODIFIERS = frozenset("affero lesser nc noncommercial sa sharealike nd noderivatives noderivs".split())
BEFORE_VERSION = frozenset("version v license gpl lgpl agpl mpl epl apache bsd by sa nc nd attribution sharealike noncommercial noderivatives noderivs cc0 0".split())
#: Telling words that notices of one licence use or leave out at will.
OPTIONAL = frozenset(["cc", "gpl", "lgpl", "agpl", "mpl", "epl", "cc0", "library"])


def _gnu() -> dict[str, list[str]]:
    """Notices of the GNU licences: one line or the usual paragraph; this version, or any later one as well."""
    out: dict[str, list[str]] = {}
    for short, full, versions in (("GPL", "General", ("2", "3")), ("LGPL", "Lesser General", ("2.1", "3")), ("AGPL", "Affero General", ("3",))):
        out[short] = [f"This work is licensed under the GNU {full} Public License", f"under the terms of the GNU {full} Public License"]
        for v in versions:
            name = f"{short}-{v if '.' in v else v + '.0'}"
            free = f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU {full} Public License"
            no_warranty = f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {full} Public License for more details."
            later = "or (at your option) any later version."
            out[name] = [
                f"This work is licensed under the GNU {full} Public License, version {v}.",
                f"the GNU {full} Public License, version {v}",
                f"{free}, version {v}, as published by the Free Software Foundation.",
                f"{free} version {v} as published by the Free Software Foundation. {no_warranty}",
                f"SPDX-License-Identifier: {name}",
                f"SPDX-License-Identifier: {name}-only",
            ]
            out[f"{name}-or-later"] = [
                f"This work is licensed under the GNU {full} Public License, version {v} or later.",
                f"{free} as published by the Free Software Foundation, either version {v} of the License, {later}",
                f"{free} as published by the Free Software Foundation; either version {v} of the License, {later} {no_warranty}",
                f"SPDX-License-Identifier: {name}-or-later",
            ]
    return out


def _creative_commons() -> dict[str, list[str]]:
    """Notices of the Creative Commons licences, versions 3.0 and 4.0."""
    out: dict[str, list[str]] = {}
    for short, full in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
        for v in ("3.0", "4.0"):
            out[f"CC-{short}-{v}"] = [
                f"Licensed under CC {short} {v}.",
                f"This work is licensed under CC {short} {v}.",
                f"This work is licensed under a Creative Commons {full} {v} {'International' if v == '4.0' else 'Unported'} License.",
                f"Creative Commons {full} {v}",
                f"SPDX-License-Identifier: CC-{short}-{v}",
            ]
    return out


# Whole licences and the usual notices by which works name their licence.
_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_REDISTRIBUTE = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_ADVERTISING = "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."
_ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_HOLDERS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC_TAIL = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_ISC_HEAD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        _GRANT,
        f"{_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}",
        "SPDX-License-Identifier: MIT",
    ],
    "MIT-0": [f"{_GRANT}. {_AS_IS}", "SPDX-License-Identifier: MIT-0"],
    "BSD": [_REDISTRIBUTE],
    "BSD-2-Clause": [f"{_REDISTRIBUTE}: 1. {_SOURCE} 2. {_BINARY} {_HOLDERS}", f"{_REDISTRIBUTE}: {_SOURCE} {_BINARY}", "SPDX-License-Identifier: BSD-2-Clause", "Licensed under the BSD 2-Clause License"],
    "BSD-3-Clause": [f"{_REDISTRIBUTE}: 1. {_SOURCE} 2. {_BINARY} 3. {_ENDORSE} {_HOLDERS}", f"{_REDISTRIBUTE}: {_SOURCE} {_BINARY} {_ENDORSE}", "SPDX-License-Identifier: BSD-3-Clause", "Licensed under the BSD 3-Clause License"],
    "BSD-4-Clause": [f"{_REDISTRIBUTE}: 1. {_SOURCE} 2. {_BINARY} 3. {_ADVERTISING} 4. {_ENDORSE} {_HOLDERS}", "SPDX-License-Identifier: BSD-4-Clause"],
    "ISC": [f"{_ISC_HEAD}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_TAIL}", f"{_ISC_HEAD}, provided that the above copyright notice and this permission notice appear in all copies.", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC"],
    "0BSD": [f"{_ISC_HEAD}. {_ISC_TAIL}"],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        "SPDX-License-Identifier: Zlib",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "Artistic-2.0": ["Licensed under the Artistic License 2.0.", "SPDX-License-Identifier: Artistic-2.0"],
    "WTFPL": ["Licensed under the WTFPL, version 2."],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Licensed under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ],
    **_gnu(),
    **_creative_commons(),
}


def normalised(text: str | None) -> list[str]:
    return [_plain(w) if w[-1] <= "9" or w in _SPELLING else w for w in WORD.findall((text or "").lower())]


def _plain(word: str) -> str:
    m = _VERSION.match(word)
    if m:
        number = m.group(1)
        while number.endswith(".0"):
            number = number[:-2]
        return number
    return _SPELLING.get(word, word)


def telling(words: list[str], first: int, end: int) -> set[str]:
    """The words of a stretch that tell licences apart; a number counts if the word before it calls for a version."""
    out = set()
    for i in range(first, end):
        w = words[i]
        if w in TELLING:
            out.add(w)
        elif w[0].isdigit() and len(w) <= 4 and i > 0 and words[i - 1] in BEFORE_VERSION:
            out.add(w)
    return out - OPTIONAL


def bigrams(words: list[str]) -> list[tuple[str, str]]:
    return list(zip(words, words[1:]))


def dice(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


class Scanner:
    """Templates ready for scanning."""

    def __init__(self, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD):
        self.threshold = threshold
        split = [(name, i, normalised(t)) for name, texts in sorted((templates or TEMPLATES).items()) for i, t in enumerate(texts)]
        self.templates = [(name, i, Counter(bigrams(w))) for name, i, w in split]
        self.telling = [telling(w, 0, len(w)) for _, _, w in split]
        self.vocabulary = {w for _, _, b in self.templates for p in b for w in p}
        self.owners: dict[tuple[str, str], list[int]] = {}
        for i, (_, _, b) in enumerate(self.templates):
            for p in b:
                self.owners.setdefault(p, []).append(i)

    def scan(self, text: str | None) -> list[tuple[str, int, float, int, int]]:
        """(licence, template, Dice, first word, end) of the stretches found, without overlaps, in order."""
        words = normalised(text)
        known = self.vocabulary
        at = [i for i, w in enumerate(words) if w in known]
        hits: dict[int, list[int]] = {}
        for i, j in zip(at, at[1:]):
            if j == i + 1:
                for t in self.owners.get((words[i], words[j]), ()):
                    hits.setdefault(t, []).append(i)
        found = []
        for t, places in hits.items():
            size, ratio = self.templates[t][2].total(), self.threshold / (2 - self.threshold)
            breaks = [k for k in range(1, len(places)) if places[k] - places[k - 1] > size]
            for s, e in zip([0, *breaks], [*breaks, len(places)]):
                if e - s >= ratio * size:  # else too few hits for any window
                    found += self._windows(words, places[s:e], t, size, ratio)
        kept: list[tuple] = []
        for x in sorted(found, key=lambda x: (-x[5], -x[2], x[0], x[3])):
            if all(x[4] <= k[3] or x[3] >= k[4] for k in kept):
                kept.append(x)
        return sorted([k[:5] for k in kept], key=lambda x: x[3])

    def _windows(self, words, places, t, size, ratio):
        """The best window from each hit of a group on, with its net evidence: it begins and ends with a hit, its size
        is within the bounds and its telling words are the template's."""
        name, n, target = self.templates[t]
        need, out = -(-ratio * size // 1), []
        for i, first in enumerate(places):
            far = i + max(int(need), 1) - 1
            if far >= len(places) or places[far] - first + 1 > size / ratio:
                continue  # too few hits within the longest window
            have: Counter = Counter()
            shared, fits = 0, []
            for last in places[i:]:
                length = last - first + 1
                if length > size / ratio:
                    break
                p = (words[last], words[last + 1])
                have[p] += 1
                shared += have[p] <= target[p]
                if length >= ratio * size:
                    d = 2 * shared / (length + size)
                    if d >= self.threshold:
                        fits.append((-d, last + 2, 3 * shared - length - size))
            for d, end, net in sorted(fits):
                around = telling(words, max(first - 1, 0), first) | telling(words, end, min(end + 1, len(words)))
                if telling(words, first, end) == self.telling[t] and not (around & MODIFIERS or any(w[0].isdigit() for w in around)):
                    out.append((name, n, -d, first, end, net))
                    break
        return out


_FOUND = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("license", T.StringType()),
        T.StructField("dice", T.DoubleType()),
        T.StructField("places", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("end_word", T.LongType()),
    ]
)


def licences_in(scanner: Scanner, text: str | None) -> list[tuple]:
    """(licence, Dice, places, first word, end) of each licence of a text, at its best place."""
    best: dict[str, list] = {}
    for name, _, d, s, e in scanner.scan(text):
        b = best.setdefault(name, [d, 0, s, e])
        b[1] += 1
        if d > b[0]:
            b[0], b[2], b[3] = d, s, e
    return [(k, *v) for k, v in sorted(best.items())]


def scan_licences(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row and licence found in it."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for b in batches:
            for part in small(b):
                found = [(k, *x) for k, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()) for x in licences_in(scanner, t)]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()))], names=_FOUND.fieldNames())

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _FOUND)
