"""Operator 4: license scans.

Retrieval: a text's 5-word shingles are covered by overlapping windows of 2, 4, 8 ... shingles, each moved by half its
width, so that a template of t shingles lies in some window of at most twice its rounded-up size. Windows and templates
have BANDS MinHash values, bands of a single row each: a window that holds three quarters of a template, which is at
least 3/16 of all in the window, meets it in some band with a probability of 1 - (13/16)^BANDS or more: 0.9999 for 44.
Verification: for each template retrieved, the positions of its shingles in the whole text are cut into runs where more
than the template's size lies between two; a run with at least 75 % of the template's distinct shingles is a match."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, releasing, table

WIDTH, CONTAINED, BANDS = 5, 75, 44
_U = np.uint64
_SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)

#: The wording of public license notices, by SPDX identifier.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "AGPL-3.0": ("it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    ),
    "0BSD": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "WTFPL": ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.",),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "GFDL-1.3": ("Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation",),
}


def shingle_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """Hashes of each run of WIDTH words of each text: words of letters and digits in lower case; the whole of fewer."""
    from .common import _BYTE, _powers  # bytes that are no word characters become spaces

    out = []
    for text in texts:
        data = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
        words = [np.zeros(0, np.uint64)]
        at = 0
        while at < len(data):
            end = min(at + (1 << 20), len(data))
            while at < end < len(data) and _WORD_BYTE[data[end - 1]] and end > at + (1 << 19):
                end -= 1
            part = data[at:end]
            some = np.concatenate([[False], _WORD_BYTE[part], [False]])
            starts, ends = np.flatnonzero(some[1:-1] & ~some[:-2]), np.flatnonzero(some[1:-1] & ~some[2:]) + 1
            power, inverse = _powers(len(part))
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTE[part] * power[: len(part)], out=total[1:])
            words.append(mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)))
            at = end
        w = np.concatenate(words)
        n = min(WIDTH, len(w))
        if n:
            s = mix(w[: len(w) - n + 1] + _U(n))
            for j in range(1, n):
                s = mix(s * _U(0xD1342543DE82EF95) + w[j : len(w) - n + 1 + j])
            w = s
        out.append(w)
    return out


_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


class Scanner:
    """Templates by shingles and MinHash bands. templates: notices by license."""

    def __init__(self, templates: dict[str, tuple[str, ...]] | None = None):
        self.templates: list[tuple[str, np.ndarray]] = []
        for name, notices in (TEMPLATES if templates is None else templates).items():
            self.templates += [(name, np.unique(s)) for s in shingle_hashes(list(notices)) if len(s)]
        self.sizes = sorted({1 << (len(s) - 1).bit_length() for _, s in self.templates})
        self.bands: dict[tuple[int, int], dict[int, list[int]]] = {}
        self.maybe: dict[int, np.ndarray] = {}
        for i, (_, s) in enumerate(self.templates):
            size = 1 << (len(s) - 1).bit_length()
            for b, seed in enumerate(_SEEDS):
                self.bands.setdefault((size, b), {}).setdefault(int((s * seed).min()), []).append(i)
        for size in self.sizes:  # a table by the top 16 bits tells most windows apart at once
            self.maybe[size] = np.zeros((BANDS, 1 << 16), bool)
            for b in range(BANDS):
                for value in self.bands[size, b]:
                    self.maybe[size][b, value >> 48] = True

    def retrieve(self, parts: list[np.ndarray]) -> list[set[int]]:
        """For the shingles of each text, the templates that share a band with one of its windows.

        Texts are laid end to end, as numpy works best on long arrays; a window over two texts counts for both."""
        found: list[set[int]] = [set() for _ in parts]
        ends = np.cumsum([len(x) for x in parts])
        s = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        step, overlap = 1 << 16, 2 * self.sizes[-1]  # starts of parts fall on starts of windows of all sizes
        for at in range(0, len(s), step):
            part = s[at : at + step + overlap]
            for b, seed in enumerate(_SEEDS):
                least, width = part * seed, 1  # least of `width` shingles from each width-th place on
                for size in self.sizes:
                    while width < size:
                        least = np.minimum(least[0::2], np.append(least[1::2], least[-1:])[: len(least[0::2])])
                        width *= 2
                    window = np.minimum(least, np.append(least[1:], least[-1:]))  # 2 * size wide, moved by size
                    for i in np.flatnonzero(self.maybe[size][b][(window >> _U(48)).astype(np.intp)]):
                        if templates := self.bands[size, b].get(int(window[i])):
                            first = np.searchsorted(ends, at + i * size, side="right")
                            last = np.searchsorted(ends, min(at + (i + 2) * size, len(s)) - 1, side="right")
                            for text in range(first, last + 1):
                                found[text].update(templates)
        return found

    def matches(self, s: np.ndarray, candidates) -> list[tuple[str, int, int, float]]:
        """(license, first word, words, contained share) of the verified matches of the candidate templates."""
        out = []
        for i in sorted(candidates):
            name, shingles_ = self.templates[i]
            place = np.flatnonzero(np.isin(s, shingles_))
            if not len(place):
                continue
            for run in np.split(place, np.flatnonzero(np.diff(place) > len(shingles_)) + 1):
                n = len(np.unique(s[run]))
                if 100 * n >= CONTAINED * len(shingles_):
                    out.append((name, int(run[0]), int(run[-1] - run[0] + WIDTH), n / len(shingles_)))
        return out

    def scan(self, texts: list[str | None]) -> list[list[tuple[str, int, int, float]]]:
        """For each text its matches: one for each license and first word, the longest."""
        out = []
        parts = shingle_hashes(texts)
        for s, candidates in zip(parts, self.retrieve(parts), strict=True):
            best: dict[tuple[str, int], tuple[str, int, int, float]] = {}
            for m in self.matches(s, candidates):
                key = m[:2]
                if key not in best or m[2:] > best[key][2:]:
                    best[key] = m
            out.append([best[k] for k in sorted(best)])
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """doc_id, license, start_word, n_words, containment of every license notice in docs (doc_id, text), from 0.

    Texts that are null or without a notice give no rows, rows that repeat give theirs each, a null doc_id is kept as
    null, and an empty table gives no rows. Other columns are ignored."""
    scanner = Scanner(templates)

    @F.pandas_udf("array<struct<license: string, start_word: bigint, n_words: bigint, containment: double>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("license", "start_word", "n_words", "containment")
        for texts in releasing(batches):
            rows = [x for i in range(0, len(texts), 400) for x in scanner.scan(list(texts[i : i + 400]))]
            yield pd.Series([[dict(zip(names, m, strict=True)) for m in x] for x in rows], dtype=object)

    x = docs.select(F.col("doc_id").cast("long"), found(F.col("text")).alias("m"))
    return x.filter(F.size("m") > 0).select("doc_id", F.inline("m"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
