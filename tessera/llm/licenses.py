"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Words are runs of letters and digits, lower-cased; shingles are WIDTH words. Templates of n shingles are sought with blocks
of B shingles, B the power of two at or above 2 n, so a copy stretched to twice the template at most lies wholly in one of
the windows of two neighbouring blocks, whatever its offset. A window's signature is that of those of its shingles that
occur in any template; bands are single minimum hashes, as a copy that keeps CONTAINMENT of a template may be a small part
of its window. Even if every other shingle of the window came from other templates, a window and a template of a copy have
a similarity of CONTAINMENT * n / (2 B + n) or more, and the number of bands is the least at which such a pair shares none
with probability MISS at most. A retrieved template is verified on the whole text: the most distinct shingles of it in any
window of 2 B shingles, which is exact.

Null and short texts match nothing; very long texts are scanned whole. A document is reported once for each template, with
its best window, the first on a tie; rows that repeat an id are scanned each. An empty table gives none. Other columns are
not read. Null ids are reported as null.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .runtime import rows_per_task, ship

WIDTH, CONTAINMENT, CACHE = 3, 0.8, 250_000
#: Largest probability of not retrieving a copy.
MISS = 1e-6
#: Public license notices and texts, by name.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-file": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free-software": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License.",
    "mit-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "mit-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. "
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
        "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. "
        "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution."
    ),
}
WORDS = re.compile(r"[^\W_]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = zlib.crc32(word.encode()) << 32 | zlib.adler32(word.encode())
        return h


_WORDS = _Words()


def shingle_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the shingles in order; empty below WIDTH words."""
    words = WORDS.findall(text.lower())
    n = len(words) - WIDTH + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    ids, h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words)), np.zeros(n, np.uint64)
    for k in range(WIDTH):
        h = (h ^ ids[k : k + n]) * _STEP
        h ^= h >> np.uint64(29)
    return h


def _bands(n: int, block: int, containment: float, miss: float) -> int:
    """The fewest single-hash bands at which a window that holds a copy shares none with its template with probability miss at most."""
    return math.ceil(math.log(miss) / math.log1p(-containment * n / (2 * block + n)))


_RNG = np.random.Generator(np.random.PCG64(2))
_MUL, _ADD = (_RNG.integers(1, 1 << 63, 4096, dtype=np.uint64) for _ in range(2))


def _hashed(h: np.ndarray, bands: int) -> np.ndarray:
    """A row of hashes for each band."""
    x = h[None, :] * (_MUL[:bands, None] * np.uint64(2) + np.uint64(1)) + _ADD[:bands, None]
    return (x ^ (x >> np.uint64(31))) * _STEP


class Scanner:
    """Templates, the signatures that retrieve them, and the index of their shingles."""

    def __init__(self, templates: dict[str, str], containment: float, miss: float = MISS) -> None:
        self.names, self.containment = sorted(templates), containment
        self.sets = [np.unique(shingle_hashes(templates[n])) for n in self.names]
        if any(not len(s) for s in self.sets):
            raise ValueError(f"a template needs {WIDTH} words")
        blocks = np.array([1 << (2 * len(s) - 1).bit_length() for s in self.sets], np.int64)
        self.windows = (2 * blocks).tolist()
        keys = np.concatenate([np.zeros(0, np.uint64), *self.sets])
        order = np.argsort(keys, kind="stable")
        self.keys, self.begin = np.unique(keys[order], return_index=True)
        self.begin = np.append(self.begin, len(keys))
        self.owner = np.repeat(np.arange(len(self.sets)), [len(s) for s in self.sets])[order]
        self.near = np.zeros(1 << 16, bool)
        self.near[(self.keys >> np.uint64(48)).astype(np.intp)] = True
        #: By block size: the templates and their minimum hashes, one a band.
        self.classes = []
        for b in np.unique(blocks).tolist():
            mine = np.flatnonzero(blocks == b)
            bands = max(_bands(len(self.sets[t]), b, containment, miss) for t in mine)
            self.classes.append((b, mine, np.stack([_hashed(self.sets[t], bands).min(axis=1) for t in mine])))

    def _retrieved(self, at: np.ndarray, h: np.ndarray) -> set[int]:
        """Templates that share a band with a window of two blocks; at, h: the places and hashes of the shingles of any template."""
        found: set[int] = set()
        for b, templates, wanted in self.classes:
            block, starts = np.unique(at // b, return_index=True)
            least = np.minimum.reduceat(_hashed(h, wanted.shape[1]), starts, axis=1)
            after = np.flatnonzero(block[1:] == block[:-1] + 1)
            windows = np.concatenate([least, np.minimum(least[:, after], least[:, after + 1])], axis=1)
            found.update(templates[k] for k in range(len(templates)) if (windows == wanted[k][:, None]).any())
        return found

    def scan(self, text: str | None) -> list[tuple[str, float, int]]:
        """(template, containment, first word of the window's match), the best window of each template found."""
        h = shingle_hashes(text or "")
        at = np.flatnonzero(self.near[(h >> np.uint64(48)).astype(np.intp)])
        key = np.searchsorted(self.keys, h[at])
        held = key < len(self.keys)
        at, key = at[held], key[held]
        same = self.keys[key] == h[at]
        at, key = at[same], key[same]
        if not len(at):
            return []
        retrieved = self._retrieved(at, h[at])
        sizes = self.begin[key + 1] - self.begin[key]
        ends = np.cumsum(sizes)
        owner = self.owner[np.arange(ends[-1]) + np.repeat(self.begin[key] - ends + sizes, sizes)]
        at, key = np.repeat(at, sizes), np.repeat(key, sizes)
        found = []
        for t in sorted(retrieved):
            mine = owner == t
            c, first = self._best(at[mine], key[mine], self.windows[t])
            if c / len(self.sets[t]) >= self.containment:
                found.append((self.names[t], c / len(self.sets[t]), first))
        return found

    @staticmethod
    def _best(at: np.ndarray, key: np.ndarray, window: int) -> tuple[int, int]:
        """The most distinct shingles in a window that begins at a hit, and the first such window's begin."""
        n = len(at)
        order = np.argsort(key, kind="stable")
        last = np.full(n, -1)  # the hit before of the same shingle
        again = key[order[1:]] == key[order[:-1]]
        last[order[1:][again]] = order[:-1][again]
        # A hit counts once in the windows that begin after that one, at most a window's length before it.
        change = np.bincount(np.maximum(last + 1, np.searchsorted(at, at - window + 1)), minlength=n + 1) - np.bincount(np.arange(1, n + 1), minlength=n + 1)
        distinct = np.cumsum(change)[:n]
        best = int(distinct.argmax())
        return int(distinct[best]), int(at[best])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, template, containment and start_word, one row for each document and template found; a narrow step."""
    ship(docs.sparkSession)
    docs = docs.select("doc_id", text)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    given = dict(TEMPLATES if templates is None else templates)

    def run(batches):
        scanner = Scanner(given, containment)
        for batch in (part for whole in batches for part in rows_per_task(whole, text)):
            rows, out = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for found in scanner.scan(t):
                    rows.append(i)
                    out.append(found)
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.float64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), *columns], ["doc_id", "template", "containment", "start_word"])

    return docs.mapInArrow(run, f"doc_id {id_type}, template string, containment double, start_word long")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
