"""License scans by conditional compression.

A text is read as words, so line breaks and punctuation do not matter.  No key word
(name or version) of a template may be missing, so a notice can only be where the
rarest of them is.  Around each such place blocks are cut in a few sizes (powers of two of words, up to the longest
template's), whatever template the word comes from.  Every block is compressed once alone and once with each
template as a raw zstandard dictionary.  Templates are ranked by the bytes that they save, and tried in that order (none is left
out, so what stands around a notice cannot hide it) for their exact wording: the words around the place are aligned with the template's, at
least ``wording`` of these must be there in order and only few may come in between, so a
text that only resembles a license, or names another version, is not taken for it.
The stretch that the alignment covers must also shrink by ``least_gain`` by itself.  The differences
that remain are reported, with the template's rank and the bytes it saved.

Texts are scanned in Arrow batches without a shuffle; only those that hold all key words
of a template are cut into words, and only places of such templates are looked at.

Defined results: null or empty texts give no rows; of confirmed notices that overlap, the
one whose template saves most bytes of its block stays, then the one with the most words in common less differences, then the one with more words,
then the one whose template comes first; all others give a row each, in text order;
repeated rows give repeated results; extra columns are ignored; ids must be integers.
"""

from __future__ import annotations

import difflib
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values: (license, key words, wording) of common notices, license headers and whole license texts.
TEMPLATES = [
    ("Apache-2.0", "apache 2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "apache 2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "mit", "Released under the MIT License."),
    ("MIT", "deal restriction", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("GPL-3.0", "gnu general public 3", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "gnu general public 2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2."),
    ("LGPL-2.1", "gnu lesser general public 2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "gnu affero general public 3", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "mozilla public 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "redistribution binary", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "cc by-nc 4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "cc by 4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "cc by-sa 4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "creative commons attribution 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "public domain", "To the extent possible under law, the author has dedicated all copyright to this work to the public domain."),
    ("All-Rights-Reserved", "all rights reserved", "All rights reserved."),
    (
        "MIT",
        "merchantability noninfringement sublicense",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: '
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "fee negligence tortious",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "redistributions disclaimer exemplary",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "redistributions endorse promote exemplary",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "Apache-2.0",
        "apache 2.0 limitations governing",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-2.0-or-later", "gnu general public 2 later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0-or-later", "gnu general public 3 later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "gnu lesser general public 2.1 later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "gnu affero general public 3 later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "mozilla public 2.0 mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    (
        "Zlib",
        "misrepresented freely altered",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "unencumbered domain compile",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
]

_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
_CLOSING = re.compile(r"[^\w\s]*")


class Scanner:
    def __init__(self, templates=TEMPLATES, least_gain: float = 0.15, wording: float = 0.8):
        import zstandard

        self.templates, self.least_gain, self.wording = templates, least_gain, wording
        self.words = [_WORD.findall(t.lower()) for _, _, t in templates]
        self.keys = [k.split() for _, k, _ in templates]
        self.by_length = [sorted(keys, key=len, reverse=True) for keys in self.keys]
        #: Words on either side of a block of the template's size.
        self.reach = [1 << (2 * len(w) - 1).bit_length() for w in self.words]
        self.alone = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False)
        self.given = [zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False, write_dict_id=False, dict_data=zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, _, t in templates]

    def ranking(self, block: str) -> list[tuple[int, int]]:
        """(bytes saved, template) of all templates, case aside, the most first."""
        raw = block.lower().encode("utf-8", "surrogatepass")
        alone = len(self.alone.compress(raw))
        return sorted(((alone - len(c.compress(raw)), k) for k, c in enumerate(self.given)), key=lambda x: (-x[0], x[1]))

    def gain(self, block: str, k: int) -> float:
        """Share of the block's compressed bytes that template ``k`` saves, case aside."""
        raw = block.lower().encode("utf-8", "surrogatepass")
        return 1 - len(self.given[k].compress(raw)) / len(self.alone.compress(raw))

    def align(self, there: list[str], k: int):
        """First and last of the words that match template ``k``, how many do, and what differs (``-`` missing, ``+`` in between).

        Of the runs of words in common, those in a row that leave the fewest differences
        count, so that stray words before or after a notice are no part of it.
        """
        wanted = self.words[k]
        runs = [m for m in difflib.SequenceMatcher(None, wanted, there, autojunk=False).get_matching_blocks() if m.size]
        best = None
        for i in range(len(runs)):
            same = extra = 0
            for j in range(i, len(runs)):
                same += runs[j].size
                extra += runs[j].b - runs[j - 1].b - runs[j - 1].size if j > i else 0
                if best is None or (len(wanted) - same + extra, -same) < best[0]:
                    best = ((len(wanted) - same + extra, -same), i, j)
        if best is None:
            return None
        runs = runs[best[1] : best[2] + 1]
        same = {m.a + i for m in runs for i in range(m.size)}
        inside = {m.b + i for m in runs for i in range(m.size)}
        first, last = runs[0].b, runs[-1].b + runs[-1].size
        diff = ["-" + w for i, w in enumerate(wanted) if i not in same] + ["+" + there[i] for i in range(first, last) if i not in inside]
        return first, last, len(same), diff

    def confirmed(self, words: list[str], spans, text: str, i: int, k: int):
        """The notice of template ``k`` whose key word stands at ``i``: words, differences and place, or null."""
        wanted, size = self.words[k], len(self.words[k])
        least, most = round(self.wording * size, 9), max(1, round((1 - self.wording) * 2 * size, 9))
        slack = math.ceil(most)
        begin = i - wanted.index(words[i])
        a, b = max(0, begin - slack), begin + size + slack
        if len(set(wanted).intersection(words[a:b])) < least - (size - len(set(wanted))) or not (fit := self.align(words[a:b], k)):
            return None
        first, last, n, diff = fit
        if n < least or len(diff) > most or {d[1:] for d in diff if d[0] == "-"}.intersection(self.keys[k]):
            return None
        start, end = spans[a + first][1], _CLOSING.match(text, spans[a + last - 1][2]).end()
        gain = self.gain(text[start:end], k)
        return (n, tuple(diff), a + first, a + last, start, end, gain) if gain >= self.least_gain else None

    def scan(self, text: str | None):
        """(license, start, end, gain, share of words, differences) of each confirmed notice."""
        for x in self.ranked(text):
            yield x[:6]

    def ranked(self, text: str | None):
        """What ``scan`` gives, with the rank of the notice's template in its block and the bytes that it saved."""
        low = (text or "").lower()
        usable = [k for k, keys in enumerate(self.by_length) if all(w in low for w in keys)]
        if not usable:
            return
        spans = [(m[0].lower(), *m.span()) for m in _WORD.finditer(text)]
        words = [s[0] for s in spans]
        at = {w: [] for k in usable for w in self.keys[k]}
        for i, w in enumerate(words):
            if w in at:
                at[w].append(i)
        rarest = {k: min(self.keys[k], key=lambda w: len(at[w])) for k in usable}
        blocks = {(i, self.reach[k]) for k, w in rarest.items() for i in at[w]}
        found: dict = {}
        for i, reach in blocks:
            first, last = spans[max(0, i - reach)], spans[min(len(spans), i + reach) - 1]
            for rank, (saved, k) in enumerate(self.ranking(text[first[1] : last[2]]), 1):
                if self.reach[k] == reach and rarest.get(k) == words[i] and (hit := self.confirmed(words, spans, text, i, k)):
                    n, diff, a, b, start, end, gain = hit
                    key = (k, a, b, start, end, diff, n, gain)
                    found[key] = max(found.get(key, (saved, -rank)), (saved, -rank))
        stay = []
        for key, (saved, rank) in sorted(found.items(), key=lambda x: (-x[1][0], len(x[0][5]) - x[0][6], -x[0][6], x[0][0], x[0][1:5])):
            if all(key[2] <= y[1] or y[2] <= key[1] for y, _, _ in stay):
                stay.append((key, saved, -rank))
        for (k, _, _, start, end, diff, n, gain), saved, rank in sorted(stay, key=lambda x: x[0][1]):
            yield self.templates[k][0], start, end, gain, n / len(self.words[k]), list(diff), rank, saved


def scan(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, license, start, end, gain, wording, differences, rank, saved_bytes``: a row for each confirmed notice."""

    def run(batches):
        import pyarrow as pa

        scanner = Scanner(templates)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.int32(), pa.int64()]
        for b in batches:
            rows = [(d, *x) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in scanner.ranked(t)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "license", "start", "end", "gain", "wording", "differences", "rank", "saved_bytes"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    return rows.mapInArrow(run, "doc_id long, license string, start long, end long, gain double, wording double, differences array<string>, rank int, saved_bytes long")
