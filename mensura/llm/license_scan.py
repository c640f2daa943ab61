"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Templates are a table of notices and of whole license texts (the files in licenses/), given as a parameter and thus bounded;
they go to every task. By number of shingles they fall into classes of powers of two. For the class of step = 2 ** c, a text
is covered by windows of 3 * step shingles at steps of step, so any run of 2 * step + 1 shingles, which is twice a
template's length, lies wholly within one window. A window retrieves the templates with which it shares a band (one least
hash) of BANDS: where a window holds 0.8 of a template the Jaccard similarity is 0.129 at least, and a band agrees with that
chance, so a match is missed with a chance below 4e-6. A band can agree only where the text has a template's least shingle,
which a table look-up over the whole text tells first. What is retrieved is then verified on the words themselves, in the
window grown by a step at both ends: a match is a run of at most 2 * step shingles with the most of the template's distinct
shingles, the shortest of equals; their share must reach CONTAINMENT, and where the template gives its license's version,
a shingle with the version must be among them. Further runs of a template are sought beside the first.

Of overlapping matches of two licenses the one of the higher containment stays, then the one with more shingles; but one
with at most half the shingles of the other is a part of the other, and a name with a version or variant (LGPL-3.0) goes
before the bare one (LGPL).

Words are lower-cased runs without ASCII punctuation. Defined results: null and empty texts and those of under 5 words have
no license; a text is scanned whole; repeated rows are scanned each; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from importlib.resources import files

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import with_longs

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 96
NEAR = 64  # words of a stretch by which overlaps are looked up

#: Fixed values: (license, notice), as published with each license.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("MIT", "Distributed under the MIT License."),
    ("MIT", "Available under the MIT License."),
    ("MIT", "Published under the MIT License."),
    ("MIT", "Provided under the MIT License."),
    ("MIT", "Covered by the MIT License."),
    ("MIT", "under the terms of the MIT License"),
    ("MIT", "licensed under the MIT (Expat) License"),
    ("Apache-2.0", "under the Apache License, Version 2.0"),
    ("Apache-2.0", "under the Apache License 2.0"),
    ("Apache-2.0", "under the Apache 2.0 License"),
    ("Apache-2.0", "under the terms of the Apache License, Version 2.0"),
    ("GPL-1.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-2.0", "under the GNU General Public License, version 2"),
    ("GPL-2.0", "under version 2 of the GNU General Public License"),
    ("GPL-2.0", "under the terms of the GNU General Public License, version 2"),
    ("GPL-2.0", "under the GNU General Public License v2.0"),
    ("GPL-2.0", "under the GNU General Public License v2"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation."),
    ("GPL-3.0", "under the GNU General Public License, version 3"),
    ("GPL-3.0", "under version 3 of the GNU General Public License"),
    ("GPL-3.0", "under the terms of the GNU General Public License, version 3"),
    ("GPL-3.0", "under the GNU General Public License v3.0"),
    ("GPL-3.0", "under the GNU General Public License v3"),
    ("LGPL-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-2.1", "under the GNU Lesser General Public License v2.1"),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "under the GNU Lesser General Public License v3.0"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "under the GNU Affero General Public License v3.0"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-2-Clause", "under the BSD 2-Clause License"),
    ("BSD-2-Clause", "under the Simplified BSD License"),
    ("BSD-3-Clause", "under the BSD 3-Clause License"),
    ("BSD-3-Clause", "under the New BSD License"),
    ("BSD", "Licensed under the BSD License."),
    ("BSD", "Released under the BSD License."),
    ("BSD", "Distributed under the BSD License."),
    ("BSD", "governed by a BSD-style license"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "Released under the ISC License."),
    ("ISC", "Distributed under the ISC License."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"),
    ("EPL-1.0", "under the Eclipse Public License, Version 1.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("EPL-2.0", "under the Eclipse Public License, Version 2.0"),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License."),
    ("MPL-2.0", "under the Mozilla Public License, Version 2.0"),
    ("MPL-2.0", "under the Mozilla Public License 2.0"),
    ("CC0-1.0", "under the CC0 1.0 Universal Public Domain Dedication"),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC0-1.0", "has waived all copyright and related or neighboring rights to this work"),
    *(
        (f"CC-{code}-{version}", text)
        for code, words in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
        for version, form in (("2.0", "Generic"), ("3.0", "Unported"), ("4.0", "International"))
        for text in (f"under a Creative Commons {words} {version} {form} License", f"under the Creative Commons {words} {version} License", f"under CC {code} {version}")
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    *((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in sorted(files(__package__).joinpath("licenses").iterdir(), key=lambda f: f.name)),
)

_TABLE = bytes(32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else b for b in range(256))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_TABLE).split()


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    n = len(words) - SHINGLE + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = h[:n].copy()
    for i in range(1, SHINGLE):
        out = (out ^ (out >> np.uint64(29))) * _FACTOR + h[i : n + i]
    return out


def _with_version(name: str, shingles: set[tuple[bytes, ...]]) -> set[tuple[bytes, ...]]:
    """The shingles of a template that give the version in its license's name, as fully as any does; none if none does."""
    version = re.search(r"-([0-9]+)\.([0-9]+)", name)
    if not version:
        return set()
    major, minor = version[1].encode(), version[2].encode()
    for said in ((major, minor), (b"v" + major, minor), (b"version", major), (b"v" + major,)):
        if held := {s for s in shingles if any(s[i : i + len(said)] == said for i in range(SHINGLE))}:
            return held
    return set()


class Bank:
    """The templates with their bands."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.names = [name for name, _ in templates]
        rng = np.random.default_rng(11)
        self.odd = rng.integers(0, 2**63, BANDS, np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = rng.integers(0, 2**63, BANDS, np.uint64)
        self.shingles: list[set[tuple[bytes, ...]]] = []
        self.hashes: list[np.ndarray] = []
        self.versions: list[set[tuple[bytes, ...]]] = []
        self.steps: list[int] = []
        self.bands: dict[int, list[dict[int, list[int]]]] = {}
        self.holders: dict[int, set[tuple[int, int]]] = {}  # least shingle -> its classes and bands
        for at, (name, text) in enumerate(templates):
            words = words_of(text)
            if len(words) < SHINGLE:
                raise ValueError(f"a template of under {SHINGLE} words: {text!r}")
            hashes = shingle_hashes(words)
            self.hashes.append(np.unique(hashes))
            self.shingles.append({tuple(words[i : i + SHINGLE]) for i in range(len(hashes))})
            self.versions.append(_with_version(name, self.shingles[-1]))
            c = max(0, len(hashes) - 1).bit_length()
            self.steps.append(1 << c)
            tables = self.bands.setdefault(c, [{} for _ in range(BANDS)])
            for k in range(BANDS):
                values = hashes * self.odd[k] + self.shift[k]
                self.holders.setdefault(int(hashes[values.argmin()]), set()).add((c, k))
                tables[k].setdefault(int(values.min()), []).append(at)
        self.leasts = np.sort(np.fromiter(self.holders, np.uint64, len(self.holders)))
        self.quick = np.zeros(1 << 16, bool)
        self.quick[self.leasts >> np.uint64(48)] = True

    def candidates(self, hashes: np.ndarray, held: set[tuple[int, int]]) -> set[tuple[int, int, int]]:
        """(first shingle, one past the last, template) of windows that share one of the bands with a template."""
        found: set[tuple[int, int, int]] = set()
        for c, k in held:
            step, table = 1 << c, self.bands[c][k]
            heads = np.arange(0, max(1, len(hashes) - 2 * step), step)
            blocks = np.minimum.reduceat(hashes * self.odd[k] + self.shift[k], np.arange(0, len(hashes), step))
            least = np.minimum(np.minimum(blocks, np.append(blocks[1:], blocks[-1])), np.append(blocks[2:], blocks[-2:])[: len(blocks)])[: len(heads)]
            for w in np.flatnonzero(np.isin(least, np.fromiter(table, np.uint64, len(table)))):
                found.update((int(heads[w]), min(int(heads[w]) + 3 * step, len(hashes)), t) for t in table[int(least[w])])
        return found

    def scan(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(license, first word, one past the last, containment) of each verified match; overlaps of one license are one."""
        words = words_of(text)
        hashes = shingle_hashes(words)
        if not len(hashes):
            return []
        near = hashes[self.quick[hashes >> np.uint64(48)]]
        near = near[self.leasts[np.minimum(np.searchsorted(self.leasts, near), len(self.leasts) - 1)] == near]
        if not len(near):
            return []
        # a band agrees only where the template's least shingle stands in the text
        windows = self.candidates(hashes, set().union(*(self.holders[int(h)] for h in np.unique(near))))
        return self.verify(words, hashes, windows) if windows else []

    def verify(self, words: list[bytes], hashes: np.ndarray, windows: set[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        n = len(words) - SHINGLE + 1
        by_template: dict[int, list[list[int]]] = {}
        for t, a, b in sorted((t, max(0, a - self.steps[t]), min(n, b + self.steps[t])) for a, b, t in windows):
            parts = by_template.setdefault(t, [])
            if parts and a <= parts[-1][1]:
                parts[-1][1] = max(b, parts[-1][1])
            else:
                parts.append([a, b])
        found = []
        for t, parts in by_template.items():
            for a, b in parts:  # hashes say where to look, words decide
                near = (a + np.flatnonzero(np.isin(hashes[a:b], self.hashes[t]))).tolist()
                places = [(i, s) for i in near if (s := tuple(words[i : i + SHINGLE])) in self.shingles[t]]
                found += ((*run, t) for run in self.runs(places, t))
        spans: dict[str, list[tuple[int, int, float]]] = {}
        for a, b, k, t in self.chosen(found):
            spans.setdefault(self.names[t], []).append((a, b, k / len(self.shingles[t])))
        out = []
        for name, own in spans.items():
            merged: list[list] = []
            for a, b, share in sorted(own):
                if merged and a < merged[-1][1]:
                    merged[-1][1:] = [max(b, merged[-1][1]), max(share, merged[-1][2])]
                else:
                    merged.append([a, b, share])
            out += [(name, a, b, share) for a, b, share in merged]
        return sorted(out, key=lambda x: (x[1], x[0]))

    def runs(self, places: list[tuple[int, tuple[bytes, ...]]], t: int) -> list[tuple[int, int, int]]:
        """Disjoint runs that hold enough of a template, the fullest first: (first word, one past the last, distinct shingles).

        Of each place as a run's last one, the run is the longest that fits and begins with a shingle that it does not hold again.
        Runs are taken from a heap; a taken one cuts short only those that end soon behind it, which are made anew, so the work is
        proportional to the places.
        """
        least, most, version = CONTAINMENT * len(self.shingles[t]), 2 * self.steps[t], self.versions[t]
        n = len(places)
        first, taken, heap = [-1] * n, bytearray(n), []

        def sweep(left: int) -> None:
            held: dict[tuple[bytes, ...], int] = {}
            stated = 0  # shingles held that give the version
            for right in range(left, n):
                if taken[right] or first[right] >= left:  # from here on nothing has changed
                    return
                i, s = places[right]
                held[s] = held.get(s, 0) + 1
                stated += held[s] == 1 and s in version
                while i - places[left][0] > most or held[places[left][1]] > 1:
                    out = places[left][1]
                    held[out] -= 1
                    if not held[out]:
                        del held[out]
                        stated -= out in version
                    left += 1
                first[right] = left
                if len(held) >= least and (stated or not version):
                    heapq.heappush(heap, (-len(held), i - places[left][0], right, left))

        sweep(0)
        out = []
        while heap:
            k, _, right, left = heapq.heappop(heap)
            if taken[right] or first[right] != left:
                continue
            out.append((places[left][0], places[right][0] + SHINGLE, -k))
            taken[left : right + 1] = b"\1" * (right + 1 - left)
            sweep(right + 1)
        return out

    def chosen(self, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Of overlapping matches of two licenses the one that is nearer to its template, or of which the other is a part. Matches are
        looked up by the stretches of NEAR words that they touch; in one, matches of two licenses never stand kept side by side for long."""
        kept: dict[int, tuple[int, int, int, int]] = {}
        at: dict[int, list[int]] = {}
        for number, m in enumerate(sorted(found, key=lambda m: (-m[2] / len(self.shingles[m[3]]), -m[2], m[0], m[3]))):
            name = self.names[m[3]]
            stretches = range(m[0] // NEAR, (m[1] - 1) // NEAR + 1)
            close = {k for x in stretches for k in at.get(x, ()) if k in kept}
            rivals = [k for k in close if m[0] < kept[k][1] and kept[k][0] < m[1] and self.names[kept[k][3]] != name]
            wins = lambda k: name.startswith(f"{self.names[k[3]]}-") or 2 * k[2] <= m[2] and not self.names[k[3]].startswith(f"{name}-")  # noqa: B023, E731
            if all(wins(kept[k]) for k in rivals):
                for k in rivals:
                    for x in range(kept[k][0] // NEAR, (kept[k][1] - 1) // NEAR + 1):
                        at[x].remove(k)
                    del kept[k]
                kept[number] = m
                for x in stretches:
                    at.setdefault(x, []).append(number)
        return list(kept.values())


@lru_cache(maxsize=4)
def bank(templates: tuple[tuple[str, str], ...]) -> Bank:
    return Bank(templates)


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row per row of docs: doc_id, matches (array of license, first word, one past the last, containment)."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan = bank(templates).scan
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "matches": [[{"license": n, "start": s, "stop": e, "containment": c} for n, s, e, c in scan(t)] for t in b["text"]]})

    found = "matches array<struct<license: string, start: long, stop: long, containment: double>>"
    return with_longs(rows, ["doc_id"], lambda rows: rows.mapInPandas(run, f"doc_id {dict(rows.dtypes)['doc_id']}, {found}"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its licenses and the words they stand at, as license:start:stop."""
    found = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct("matches.license")), ",").alias("licenses"),
        F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"], m["stop"])), ",").alias("spans"),
        F.coalesce(F.array_min(F.col("matches.containment")), F.lit(0.0)).alias("least_containment"),
    )


QUERIES = {"op10_license_scan": op10_license_scan}
SQL: dict[str, str] = {}
