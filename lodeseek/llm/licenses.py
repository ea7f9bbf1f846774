"""License scans by conditional compression.

Lines with a word of HINT, and at most ``gap`` lines between two of them, form a candidate block. Every template that shares
word triples with a block is compared by wording: its words are aligned with the part of the block that shares most of its
triples, and the words missing from it and added to it are listed. Those whose differences are at most ``most_percent`` of
their words are confirmed. That part, with ``AROUND`` characters on either side, is compressed with zstandard alone, and with
the template as a raw dictionary; of templates confirmed there, that which saves most bytes names the license, ties going to
fewer differences, then to the template's name. However long a line is, what is compressed has the template's length.

A wrapped license has lines without a hint, so a block is compared with as many words on either side as the longest template
needs. Each place confirmed that touches the block gives a row, whose start and length hold both; a place that lies over
several blocks is told with the first, and a block that such places alone explain gives no row.

Texts without a hint never leave the JVM. Each block is compared whole, by one Arrow pass without a shuffle.

Defined results: null and empty texts have no block; a block that no template explains is kept with a null license, and
its sizes are of the whole block;
repeated rows give rows each; columns of other names are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HINT = r"(?i)licen[sc]e|copyright|rights reserved|public domain|permission is hereby|redistribution and use|warranty|creative commons|cc by|cc0|spdx"
#: Name of the template, after the license's identifier and a slash.
TEMPLATES = {
    "MIT/line": "Released under the MIT License.",
    "MIT/notice": "Licensed under the MIT License. See LICENSE file in the project root for full license information.",
    "MIT/text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0/line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0/line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0/notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-3.0/line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0/line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSD-3-Clause/text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-2-Clause/text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC/text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0/line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0/line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0/line": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-4.0/line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0/line": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-4.0/notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0/notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0/notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0/notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense/text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Proprietary/line": "All rights reserved.",
}
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
)
TEMPLATES |= {
    "BSD-3-Clause/full": f"{TEMPLATES['BSD-3-Clause/text']} {_BSD_END}",
    "BSD-2-Clause/full": f"{TEMPLATES['BSD-2-Clause/text']} {_BSD_END}",
    "ISC/full": TEMPLATES["ISC/text"]
    + ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
}
#: Characters on either side of a confirmed wording that are compressed with it.
AROUND = 100
WORDS = re.compile(r"[\w.+/-]*\w|©")
ROWS = "doc_id long, block int, start long, length long, license string, template string, size_alone long, size_with long, n_missing int, n_added int, differences string, exact boolean"
ROWS_ARROW = pa.schema([("doc_id", pa.int64()), ("block", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("license", pa.string()), ("template", pa.string()), ("size_alone", pa.int64()), ("size_with", pa.int64()), ("n_missing", pa.int32()), ("n_added", pa.int32()), ("differences", pa.string()), ("exact", pa.bool_())])
_hint = re.compile(HINT)


def blocks(text: str, gap: int = 2) -> list[tuple[int, int]]:
    """Start and end of each candidate block, in characters."""
    out: list[list[int]] = []
    for m in _hint.finditer(text):
        if out and m.start() < out[-1][1]:
            continue
        start = text.rfind("\n", 0, m.start()) + 1
        end = text.find("\n", m.end())
        end = len(text) if end < 0 else end
        if out and start > out[-1][1] and text.count("\n", out[-1][1], start) <= gap + 1:
            out[-1][1] = end
        elif not out or start >= out[-1][1]:
            out.append([start, end])
    return [(a, b) for a, b in out]


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORDS.findall(text)]


class Scanner:
    def __init__(self, templates: dict[str, str], most_percent: int):
        import zstandard

        self.most_percent = most_percent
        self.alone = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.packers = {n: zstandard.ZstdCompressor(level=3, write_content_size=False, write_dict_id=False, dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for n, t in templates.items()}
        self.words = {n: words_of(t) for n, t in templates.items()}
        #: By width, the templates that hold a sequence of so many words.
        self.grams: dict[int, dict[tuple[str, ...], list[str]]] = {}
        for n, own in self.words.items():
            width = min(3, len(own))
            for g in {tuple(own[i : i + width]) for i in range(len(own) - width + 1)} if own else ():
                self.grams.setdefault(width, {}).setdefault(g, []).append(n)

    def hits(self, block: list[str]) -> dict[str, list[int]]:
        """For each template that shares word triples with the block, their places."""
        out: dict[str, list[int]] = {}
        for width, grams in self.grams.items():
            for i, g in enumerate(zip(*(block[k:] for k in range(width)))):
                for n in grams.get(g, ()):
                    out.setdefault(n, []).append(i)
        return out

    def places(self, name: str, block: list[str], hits: list[int]) -> Iterator[tuple[int, int, list[str], list[str]]]:
        """Each place that the wording confirms, without overlaps, by differences(); parts that share most triples first."""
        own = self.words[name]
        width = min(3, len(own))
        span = len(own) + len(own) // 4 + width
        # A word missing or added breaks so many triples at most: with fewer left, the wording can't be confirmed.
        need = max(1, len(own) - width + 1 - width * (self.most_percent * len(own) // 100))
        ends = [bisect_right(hits, h + span) for h in hits]
        taken: list[tuple[int, int]] = []
        for k in sorted((k for k in range(len(hits)) if ends[k] - k >= need), key=lambda k: (k - ends[k], k)):
            if any(a <= hits[k] < b for a, b in taken):
                continue
            first, end, missing, added = self.differences(name, block, hits[k], hits[ends[k] - 1] + width)
            if 100 * (len(missing) + len(added)) <= self.most_percent * len(own) and not any(first < b and a < end for a, b in taken):
                taken.append((first, end))
                yield first, end, missing, added

    def differences(self, name: str, block: list[str], first: int, last: int) -> tuple[int, int, list[str], list[str]]:
        """Start and end of the wording in the block, about from first to last, the template's words that it lacks, and
        the words added among those it has."""
        own = self.words[name]
        width = min(3, len(own))
        first = max(0, first - 2 * width)
        part = block[first : last + 2 * width]
        missing, added = [], []
        steps = SequenceMatcher(None, own, part, autojunk=False).get_opcodes()
        inside = [k for k, s in enumerate(steps) if s[0] == "equal"]
        for k, (kind, a, b, c, d) in enumerate(steps):
            if kind != "equal":
                missing += own[a:b]
                if inside and inside[0] < k < inside[-1]:
                    added += part[c:d]
        return first + steps[inside[0]][3], first + steps[inside[-1]][4], missing, added

    def sizes(self, name: str, text: str) -> tuple[int, int]:
        data = text.encode("utf-8", "replace")
        return len(self.alone.compress(data)), len(self.packers[name].compress(data))

    def confirmed(self, text: str, spans: list[tuple[int, int]]) -> list[tuple]:
        """Start and end in the text, and ROWS' columns from license on, of each wording confirmed among the words at spans;
        without overlaps, in order of bytes saved."""
        words = [text[a:b].lower() for a, b in spans]
        good = []
        for name, hits in self.hits(words).items():
            for first, end, missing, added in self.places(name, words, hits):
                a, b = spans[first][0], spans[end - 1][1]
                alone, size = self.sizes(name, text[max(0, a - AROUND) : b + AROUND])
                good.append((size - alone, len(missing) + len(added), name, a, b, alone, size, missing, added))
        out: list[tuple] = []
        # The wording decides among those it confirms: of two nested templates the longer one explains more.
        for _, _, name, a, b, alone, size, missing, added in sorted(good, key=lambda t: t[:4]):
            if not any(a < y and x < b for x, y, *_ in out):
                shown = " ".join([*(f"-{w}" for w in missing), *(f"+{w}" for w in added)])
                out.append((a, b, name.split("/")[0], name, alone, size, len(missing), len(added), shown, not (missing or added)))
        return out

    def unexplained(self, block: str) -> tuple:
        data = block.encode("utf-8", "replace")
        return None, None, len(self.alone.compress(data)), min((len(p.compress(data)) for p in self.packers.values()), default=None), None, None, None, False

    def scan(self, block: str) -> tuple:
        """ROWS' columns from license on, of the wording that saves most bytes."""
        found = self.confirmed(block, [m.span() for m in WORDS.finditer(block)])
        return found[0][2:] if found else self.unexplained(block)

    def rows(self, text: str, gap: int) -> Iterator[tuple]:
        """ROWS' columns from block on."""
        spans = [m.span() for m in WORDS.finditer(text)]
        # What differences() looks into at most, on either side of a word of the block.
        most = max((len(w) + len(w) // 4 for w in self.words.values()), default=0) + 18
        told: list[tuple[int, int]] = []
        for k, (a, b) in enumerate(blocks(text, gap)):
            first, end = bisect_right(spans, a, key=lambda s: s[1]), bisect_left(spans, b, key=lambda s: s[0])
            here = [f for f in self.confirmed(text, spans[max(0, first - most) : end + most]) if f[0] < b and a < f[1]]
            new = sorted(f for f in here if not any(f[0] < y and x < f[1] for x, y in told))
            told += [f[:2] for f in new]
            for x, y, *found in new:
                yield k, min(a, x), max(b, y) - min(a, x), *found
            if not here:
                yield k, a, b - a, *self.unexplained(text[a:b])


def scanned(docs: DataFrame, templates: dict[str, str] = TEMPLATES, most_percent: int = 15, gap: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ROWS' columns, a row for each license of a candidate block, one at least."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").rlike(HINT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, most_percent)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                rows += [(doc_id, *row) for row in scanner.rows(text, gap)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), ROWS_ARROW)], schema=ROWS_ARROW)

    return src.mapInArrow(run, ROWS)
