"""License scans by patience alignment of texts with license templates."""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Notices by which public licenses are named or granted, short license bodies and warranty parts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD-named": "Distributed under the BSD License.",
    "BSD-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-named": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC-warranty": "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
#: What the longer texts hold beside the parts above.
MIT_TERMS = "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
TEMPLATES |= {
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to http://unlicense.org/",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0-text": "Boost Software License - Version 1.0 - August 17th, 2003. Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
}
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
#: Every template holds such a word, so a text without any holds no license.
TRIGGER = re.compile(r"licen[sc]e|redistribut|permission|merchantab|unencumbered")
COVERAGE = 0.9
#: A template's copy in a text spans so many halves of its length at most.
STRETCH = 3


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence of pairs (rising in the first) that rises in the second too."""
    tails, at, back = [], [], []
    for k, (_, y) in enumerate(pairs):
        i = bisect_left(tails, y)
        tails[i : i + 1] = [y]
        at[i : i + 1] = [k]
        back.append(at[i - 1] if i else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions of a and b: equal ends first, then words that both hold once, in their longest common order; what
    lies between two anchors is aligned in the same way. Gaps are kept on a list, so depth is no limit."""
    out, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        once_a, once_b = once(a, a0, a1), once(b, b0, b1)
        anchors = rising([(i, once_b[w]) for w, i in once_a.items() if w in once_b])
        for i, j in anchors:
            gaps.append((a0, i, b0, j))
            out.append((i, j))
            a0, b0 = i + 1, j + 1
        if anchors:
            gaps.append((a0, a1, b0, b1))
    return sorted(out)


def once(words: list[str], lo: int, hi: int) -> dict[str, int]:
    """The words that occur once in words[lo:hi], and where."""
    seen: dict[str, int] = {}
    for i in range(lo, hi):
        seen[words[i]] = -1 if words[i] in seen else i
    return {w: i for w, i in seen.items() if i >= 0}


TEMPLATES |= {
    "MIT-text": " ".join((TEMPLATES["MIT-grant"].rstrip("."), MIT_TERMS, TEMPLATES["MIT-warranty"])),
    "ISC-text": " ".join((TEMPLATES["ISC"], TEMPLATES["ISC-warranty"])),
    "BSD-2-Clause-text": " ".join((TEMPLATES["BSD"], BSD_BINARY, TEMPLATES["BSD-warranty"])),
    "BSD-3-Clause-text": " ".join((TEMPLATES["BSD"], BSD_BINARY, BSD_NAMES, TEMPLATES["BSD-warranty"])),
}
PARSED = {k: WORD.findall(v.lower()) for k, v in TEMPLATES.items()}


def windows(words: list[str], reach: int) -> list[tuple[int, int]]:
    """Spans of `reach` words around each trigger, overlapping ones apart, so that a template meets one copy at a time."""
    return [(max(0, i - reach), i + reach + 1) for i, w in enumerate(words) if TRIGGER.match(w)]


def scan(text: str) -> list[tuple[str, float]]:
    """(template, best coverage of its words) for each template that a part of the text covers by COVERAGE or more, by name.

    Where parts of two templates overlap in the text, the one with more matched words counts (ties: the shorter template, then the
    first name)."""
    lower = text.lower()
    if not TRIGGER.search(lower):
        return []
    words, hits = WORD.findall(lower), []
    for name, template in PARSED.items():
        unique = set(template)
        for lo, hi in windows(words, STRETCH * len(template) // 2 + 2):
            part = words[lo:hi]
            if len(unique.intersection(part)) < COVERAGE * len(unique) - 1:
                continue
            matched = covered(part, template)
            if len(matched) >= COVERAGE * len(template):
                hits.append((-len(matched), len(template), name, lo + matched[0][0], lo + matched[-1][0]))
    found, taken = {}, []
    for matched, size, name, lo, hi in sorted(hits):
        if all(hi < a or b < lo or n == name for n, a, b in taken):
            taken.append((name, lo, hi))
            found[name] = max(found.get(name, 0.0), -matched / size)
    return sorted(found.items())


def covered(part: list[str], template: list[str]) -> list[tuple[int, int]]:
    """The matched positions of a window and a template. Words around the copy may have drawn an end of the template away from
    it, so the copy's own stretch is aligned once more."""
    first = close(align(part, template), len(template))
    if not first or len(first) == len(template):
        return first
    (i, j), (k, m) = first[0], first[-1]
    lo, hi = max(0, i - j), k + len(template) - m
    again = close([(x + lo, y) for x, y in align(part[lo:hi], template)], len(template))
    return max(first, again, key=len)


def close(matched: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Of the matched positions, the most that lie within 1.5 template lengths of each other in the text."""
    best, lo = [], 0
    for hi in range(len(matched)):
        while 2 * (matched[hi][0] - matched[lo][0]) > STRETCH * size:
            lo += 1
        if hi - lo + 1 > len(best):
            best = matched[lo : hi + 1]
    return best


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, licenses (names joined by commas, null if none), n_licenses, coverage (the largest; 0 if none).

    One row per input row; repeated and tied ids stay. Null text: empty. An empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            got = [scan(t) for t in batch.column(1).to_pylist()]
            names = [",".join(n for n, _ in g) or None for g in got]
            best = [max((c for _, c in g), default=0.0) for g in got]
            yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array([len(g) for g in got], pa.int64()), pa.array(best, pa.float64())], ["id", "licenses", "n_licenses", "coverage"])

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, licenses string, n_licenses long, coverage double").withColumnRenamed("id", id_col)
