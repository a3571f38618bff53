"""Operator 5, license scans.

Texts and templates are lower-cased words (runs of ASCII letters, digits and other bytes from 128
on), shingled by five; fewer words than that are one shingle, the whole sequence. A template of
fewer words matches where exactly its words stand in a row. Longer templates of m shingles scan with overlapping windows: blocks of S >= m - 1
shingles, two neighbours a window, so each run of m shingles lies in one window whole. For each
size class the number of bands follows from the lowest similarity that a window with a match can
have, so that a match is missed with probability MISS at most (bands of one row); a class that would
need more than MOST_BANDS counts each template's shingles in every window instead. Each band has an
index, the templates' sorted minima: a window's minimum finds the templates that share it by
bisection, however many there are. What is found is then decided by exact containment of its shingles.

Null or empty text matches nothing, nor does a template without words. A very long text is scanned whole. A null doc_id keeps its matches; repeated rows give
their matches each. An empty table or template list gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, slices
from .hashing import ODD, mixed, text_buffer, word_hashes

SHINGLE = 5
CONTAINED = 0.8
MISS = 1e-6
MOST_BANDS = 1024

#: Public license notices and short license texts, by name.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
        law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
        under the License.""",
    "BSL-1.0 notice": "Distributed under the Boost Software License, Version 1.0.",
    "BUSL-1.1 name": "Business Source License 1.1",
    "BSD conditions": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met""",
    "CC-BY-4.0 name": "Creative Commons Attribution 4.0 International",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 name": "Creative Commons Attribution-ShareAlike 4.0 International",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0 name": "CC0 1.0 Universal",
    "CC0-1.0 waiver": "has waived all copyright and related or neighboring rights to",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "ISC permission": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "MPL-2.0 header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "MIT notice": "Released under the MIT License.",
    "MIT permission": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
        copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions""",
    "Reserved rights": "All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "0BSD text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
        DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
        TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and
        the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE
        COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
        LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT
        OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
        LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
        THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSL-1.0 text": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the
        Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all
        subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this
        restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works
        of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source
        language processor.""",
    "ISC text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
        AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
        EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
        LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
        WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to
        do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
        NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS
        OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
        FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Unlicense text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any
        and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to
        the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present
        and future rights to this software under copyright law.""",
    "Zlib text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
        any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this
        software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
        acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked
        as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source
        distribution.""",
}


def read_templates(folder: str) -> dict[str, str]:
    """Templates from the text files of a folder, by file name without its ending: license texts that aren't in TEMPLATES."""
    fs, path = file_system(folder)
    files = [f for f in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if f.is_file and not f.base_name.startswith(".")]
    out = {}
    for f in sorted(files, key=lambda f: f.path):
        with fs.open_input_stream(f.path) as stream:
            out[f.base_name.rpartition(".")[0] or f.base_name] = stream.read().decode("utf-8", "replace")
    return out

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = ~np.isin(np.arange(256), [*range(48, 58), *range(97, 123), *range(128, 256)])
_random = np.random.Generator(np.random.PCG64(5))
_C = _random.integers(0, 1 << 64, SHINGLE, np.uint64) | np.uint64(1)
_A = _random.integers(0, 1 << 64, MOST_BANDS, np.uint64) | np.uint64(1)
_B = _random.integers(0, 1 << 64, MOST_BANDS, np.uint64)
_HALF = np.uint64(32)


def bands_needed(similarity: float, miss: float = MISS) -> int:
    """Bands of one row that miss a pair of this similarity with probability `miss` at most."""
    return 1 if similarity >= 1 else math.ceil(math.log(miss) / math.log(1 - similarity))


def worded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts one after the other, and the texts' bounds in them."""
    data, bounds = text_buffer(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    words, at, _, _ = word_hashes(_FOLD[data], bounds, _SPACE)
    return words, at


def runs_of(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n words in a row; fewer than SHINGLE differ from any other number of words."""
    many = max(0, len(words) - n + 1)
    h = sum((words[i : i + many] * _C[i] for i in range(n)), np.zeros(many, np.uint64))
    return mixed(h if n == SHINGLE else h + np.full(many, n, np.uint64) * ODD)


def shingles_of(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of texts of these words, and the texts' bounds in them."""
    sizes = np.diff(at)
    counts = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, np.minimum(sizes, 1))
    keep = np.concatenate([[0], np.cumsum(counts)])
    flat = np.zeros(keep[-1], np.uint64)
    long = np.repeat(sizes >= SHINGLE, counts)
    own = np.repeat(at[:-1] - keep[:-1], counts) + np.arange(keep[-1])
    flat[long] = runs_of(words, SHINGLE)[own[long]]
    for n in range(1, SHINGLE):
        short = np.flatnonzero(sizes == n)
        if len(short):
            flat[keep[short]] = runs_of(words, n)[at[short]]
    return flat, keep


def shingled(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts one after the other, and the texts' bounds in them."""
    return shingles_of(*worded(texts))


class Scanner:
    """Templates in size classes: block length S, minima of each template, its shingles; and those of few words by their number."""

    def __init__(self, templates: dict[str, str], contained: float = CONTAINED, miss: float = MISS):
        self.contained = contained
        self.classes: dict[int, list[tuple[str, np.ndarray]]] = defaultdict(list)
        self.short: dict[int, list[tuple[str, np.uint64]]] = defaultdict(list)
        words, at = worded(pa.array(list(templates.values()), pa.string()))
        flat, bounds = shingles_of(words, at)
        for name, n, a, b in zip(templates, np.diff(at).tolist(), bounds[:-1], bounds[1:], strict=True):
            if 0 < n < SHINGLE:
                self.short[n].append((name, flat[a]))
            elif s := np.unique(flat[a:b]).tolist():
                self.classes[1 << max(0, int(b - a) - 2).bit_length()].append((name, np.array(s, np.uint64)))
        self.bands = {}  # 0: by counting
        for size, members in self.classes.items():
            least = min(need / (2 * size + len(s) - need) for _, s in members for need in [math.ceil(contained * len(s))])
            bands = bands_needed(least, miss) if least > 0 else MOST_BANDS + 1
            self.bands[size] = bands if bands <= MOST_BANDS else 0
        # for each band its hash function, the templates' minima in order and whose they are
        self.index: dict[int, list[tuple[np.uint64, np.uint64, np.ndarray, np.ndarray]]] = {}
        for size, members in self.classes.items():
            flat = np.concatenate([s for _, s in members]) >> _HALF
            first = np.cumsum([0, *(len(s) for _, s in members[:-1])])
            self.index[size] = []
            for a, b in zip(_A[: self.bands[size]], _B[: self.bands[size]], strict=True):
                minima = np.minimum.reduceat((flat * a + b) >> _HALF, first)
                order = np.argsort(minima, kind="stable")
                self.index[size].append((a, b, minima[order], order))

    def scan(self, words: np.ndarray, at: np.ndarray) -> dict[tuple[int, str], tuple[float, int]]:
        """For each text and template that match: the highest containment in a window, and the window's first word."""
        out: dict[tuple[int, str], tuple[float, int]] = {}
        flat, bounds = shingles_of(words, at)
        if not len(flat):
            return out
        for n, members in self.short.items():
            runs = runs_of(words, n)
            for name, s in members:
                found = np.flatnonzero(runs == s)
                d = np.searchsorted(at, found, "right") - 1
                inside = found + n <= at[d + 1]
                d, which = np.unique(d[inside], return_index=True)
                out.update({(int(i), name): (1.0, int(w - at[i])) for i, w in zip(d, found[inside][which], strict=True)})
        x, counts = flat >> _HALF, np.diff(bounds)
        for size, members in self.classes.items():
            per = -(-counts // size)
            owner = np.repeat(np.arange(len(counts)), per)
            starts = bounds[owner] + (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)) * size
            follows = np.append(owner[1:] == owner[:-1], False)
            following = np.flatnonzero(follows)
            hits: set[tuple[int, int]] = set()
            for a, b, minima, numbers in self.index[size]:
                least = np.minimum.reduceat((x * a + b) >> _HALF, starts)
                window = least.copy()
                window[following] = np.minimum(least[following], least[following + 1])
                low, high = np.searchsorted(minima, window), np.searchsorted(minima, window, "right")
                hits.update((i, int(j)) for i in np.flatnonzero(high > low).tolist() for j in numbers[low[i] : high[i]])
            if not self.bands[size]:
                for j, (_, s) in enumerate(members):
                    in_block = np.add.reduceat(np.isin(flat, s).astype(np.int64), starts)
                    window = in_block.copy()
                    window[following] += in_block[following + 1]
                    hits.update((int(i), j) for i in np.flatnonzero(window >= max(1, math.ceil(self.contained * len(s)))))
            for i, j in sorted(hits):
                name, s = members[j]
                a, d = int(starts[i]), int(owner[i])
                part = np.isin(s, flat[a : min(a + 2 * size, int(bounds[d + 1]))]).mean()
                if part >= self.contained and part > out.get((d, name), (0.0, 0))[0]:
                    out[d, name] = (float(part), a - int(bounds[d]))
        return out


def scan_licenses(docs: DataFrame, id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, contained: float = CONTAINED) -> DataFrame:
    """A row for each document and template found in it: doc_id, license, containment, first_word of the window."""
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, contained)
        for part in slices(batches, "text", 1 << 20):
            found = scanner.scan(*worded(part.column("text")))
            rows = sorted(found.items())
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array([d for (d, _), _ in rows], pa.int64())), pa.array([n for (_, n), _ in rows], pa.string()), pa.array([c for _, (c, _) in rows], pa.float64()), pa.array([w for _, (_, w) in rows], pa.int64())], ["doc_id", "license", "containment", "first_word"])

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, license string, containment double, first_word long")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
