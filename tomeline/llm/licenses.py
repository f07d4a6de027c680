"""License scans by patience alignment.

A text is read in windows of twice a template's length, every half length, so that
each passage of up to one and a half times its length lies whole in one of them; where
inserted words count against coverage, a longer one cannot reach 0.8.  In
a window, words unique to both the text and the template are anchors; the longest
run of anchors that keeps both orders stands, and the gaps between them are aligned
in the same way.  Coverage is the share of the template's words that found their place.

Two exact bounds save work: a text without any word of a set that makes up more than
``1 - min_coverage`` of a template cannot reach ``min_coverage``, nor can a window
with fewer template words than that share.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from math import ceil
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
MIT_TERMS = ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"
MIT_END = (
    ". THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
# Public license notices and short licenses, as authors put them into their texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "BSD": "Released under the BSD License.",
    "BSD-2-Clause": BSD_2 + BSD_END,
    "BSD-3-Clause": BSD_2 + BSD_3 + BSD_END,
    "BSD-notice": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
    "BSL-1.0-text": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: "
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. "
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "CC0-1.0": "This work is released under CC0 1.0 Universal.",
    "EPL-2.0": "Licensed under the Eclipse Public License, Version 2.0.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-short": "MIT licensed",
    "MIT-0": MIT_GRANT + MIT_END,
    "MIT-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the Software), to deal in the Software without restriction"
    ),
    "MIT-text": MIT_GRANT + MIT_TERMS + MIT_END,
    "Zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. "
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
}


def named(name: str, version: str) -> str:
    return f"{name} version {version}|{name} v {version}|{name} v{version}|{name} {version}"


# What tells each template from all others: word runs that must stand unbroken in a match; | parts other forms of one run.
TELLING = {
    "Apache-2.0": (named("apache license", "2 0"),),
    "Apache-2.0-notice": (named("apache license", "2 0"),),
    "BSD": ("the bsd license",),
    "BSD-2-Clause": ("provided with the distribution this software is provided",),
    "BSD-3-Clause": ("provided with the distribution", "neither the name", "endorse or promote products derived from this software"),
    "BSD-notice": ("redistribution and use in source and binary forms",),
    "BSL-1.0-text": ("to permit third parties to whom the software is furnished", "source language processor"),
    "CC0-1.0": ("cc0 1 0",),
    "EPL-2.0": (named("eclipse public license", "2 0"),),
    "ISC": ("permission to use copy modify and or distribute this software|permission to use copy modify and distribute this software", "permission notice appear in all copies"),
    "MIT": ("mit license",),
    "MIT-short": ("mit licensed",),
    "MIT-0": ("furnished to do so the software is provided",),
    "MIT-notice": ("deal in the software",),
    "MIT-text": ("permission notice shall be included in all copies",),
    "Zlib-text": ("the origin of this software must not be misrepresented", "altered source versions must be plainly marked"),
    "MPL-2.0": (named("mozilla public license", "2 0"),),
    "Unlicense": ("free and unencumbered software",),
}
for _key, _name, _v in [("GPL-2.0", "General", "2"), ("GPL-3.0", "General", "3"), ("LGPL-2.1", "Lesser General", "2.1"), ("LGPL-3.0", "Lesser General", "3"), ("AGPL-3.0", "Affero General", "3")]:
    _run, _number = f"gnu {_name.lower()} public license", _v.replace(".", " ")
    TEMPLATES[_key] = f"This work is licensed under the GNU {_name} Public License, version {_v}."
    TELLING[_key] = (named(_run, _number),)
    TEMPLATES[f"{_key}-notice"] = f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {_name} Public License as published by the Free Software Foundation, either version {_v} of the License, or (at your option) any later version."
    TELLING[f"{_key}-notice"] = (f"{_run} as published by the free software foundation", f"version {_number} of the license")
for _key, _name in [("BY", ""), ("BY-NC", "-NonCommercial"), ("BY-SA", "-ShareAlike"), ("BY-ND", "-NoDerivatives"), ("BY-NC-SA", "-NonCommercial-ShareAlike"), ("BY-NC-ND", "-NonCommercial-NoDerivatives")]:
    _short, _words = (f"CC-{_key}-4.0-short", f"CC-{_key}-4.0") if _key == "BY" else (f"CC-{_key}-4.0", f"CC-{_key}-4.0-words")
    TEMPLATES[_short] = f"Licensed under CC {_key} 4.0."
    TELLING[_short] = (f"cc {_key.lower().replace('-', ' ')} 4 0",)
    TEMPLATES[_words] = f"This work is licensed under a Creative Commons Attribution{_name} 4.0 International License."
    TELLING[_words] = (f"creative commons attribution{_name.lower().replace('-', ' ')} 4 0",)
# Tags of public source files, by the list's own names.
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later",
    "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0", "Unlicense", "Zlib",
)
for _key in SPDX:
    TEMPLATES[f"{_key}-tag"] = f"SPDX-License-Identifier: {_key}"
    TELLING[f"{_key}-tag"] = (f"spdx license identifier {_key.lower().replace('-', ' ').replace('.', ' ')}",)
# Full texts, one file each in license_texts, told by their headings.
TEXTS = {
    "Apache-2.0": "apache license version 2 0 january 2004",
    "CC0-1.0": "cc0 1 0 universal",
    "GPL-2": "gnu general public license version 2 june 1991",
    "GPL-3": "gnu general public license version 3 29 june 2007",
    "LGPL-2.1": "gnu lesser general public license version 2 1 february 1999",
    "LGPL-3": "gnu lesser general public license version 3 29 june 2007",
    "MPL-2.0": "mozilla public license version 2 0",
}


def all_templates() -> tuple[dict[str, str], dict[str, tuple[str, ...]]]:
    """All templates, full texts included, and what tells each."""
    folder = Path(__file__).parent / "license_texts"
    return TEMPLATES | {f"{n}-text": (folder / f"{n}.txt").read_text() for n in TEXTS}, TELLING | {f"{n}-text": (run,) for n, run in TEXTS.items()}


SEPARATORS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Words: ASCII letters and digits (lower-cased) and all non-ASCII characters; the rest separates."""
    return text.encode("utf-8", "replace").translate(SEPARATORS).split()


def longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs sorted by the first number, a longest run whose second numbers rise."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        if k == len(tails):
            tails.append(b)
            at.append(i)
        else:
            tails[k], at[k] = b, i
        back[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(text: list, template: list) -> list[tuple[int, int]]:
    """Matched places (in text, in template), both rising."""
    matched: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and text[a0] == template[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and text[a1 - 1] == template[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        mine, theirs = Counter(text[a0:a1]), Counter(template[b0:b1])
        place = {text[i]: i for i in range(a0, a1)}
        unique = sorted((place[w], j) for j, w in enumerate(template[b0:b1], b0) if theirs[w] == 1 and mine.get(w) == 1)
        anchors = longest_increasing(unique)
        last_a, last_b = a0, b0
        for a, b in anchors:
            matched.append((a, b))
            todo.append((last_a, a, last_b, b))
            last_a, last_b = a + 1, b + 1
        if anchors:
            todo.append((last_a, a1, last_b, b1))
    return sorted(matched)


class Scanner:
    """Aligns texts with all templates."""

    def __init__(self, templates: dict[str, str], min_coverage: float, telling: dict[str, tuple[str, ...]] | None = None):
        self.templates = {n: words_of(t) for n, t in sorted(templates.items())}
        self.templates = {n: w for n, w in self.templates.items() if w}
        self.least = {n: ceil(min_coverage * len(w) - 1e-9) for n, w in self.templates.items()}
        self.counts = {n: Counter(w) for n, w in self.templates.items()}
        self.min_coverage, self.strict = min_coverage, telling is not None
        runs = {n: (telling or {}).get(n, ()) for n in self.templates}
        self.runs = {n: [[b" %s " % b" ".join(words_of(form)) for form in run.split("|")] for run in r] for n, r in runs.items()}
        self.needed = {n: self.telling(w, self.least[n]) for n, w in self.templates.items()}

    @staticmethod
    def telling(words: list[bytes], least: int) -> frozenset[bytes]:
        """Long words, so many that a text with none of them matches fewer than ``least`` words."""
        count, chosen, left = Counter(words), set(), len(words)
        for w in sorted(count, key=lambda w: (-len(w), w)):
            if left < least:
                break
            chosen.add(w)
            left -= count[w]
        return frozenset(chosen)

    def told(self, name: str, joined: bytes) -> bool:
        """Whether all runs that tell a template stand in ``joined``, words with a space around each."""
        return all(any(form in joined for form in run) for run in self.runs[name])

    @staticmethod
    def dense(pairs: list[tuple[int, int]], size: int) -> tuple[float, list[tuple[int, int]]]:
        """Coverage where words inserted between matched ones count as words of the template, and the pairs without strays at either end."""
        at, m = np.array([a for a, _ in pairs]), len(pairs)
        share = lambda many, span: many / (size + span - many)
        i = int(np.argmax(share(m - np.arange(m), at[-1] + 1 - at)))
        ahead = share(np.arange(1, m - i + 1), at[i:] + 1 - at[i])
        j = i + int(np.argmax(ahead))
        return float(ahead[j - i]), pairs[i : j + 1]

    def scan(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, first word, word after the last, words matched) of each found template's best window."""
        words = words_of(text)
        present = set(words)
        joined = b" %s " % b" ".join(words) if self.strict else b""
        found = []
        for name, template in self.templates.items():
            if self.needed[name].isdisjoint(present) or not self.told(name, joined):
                continue
            size, least = len(template), self.least[name]
            own = frozenset(template)
            if not least or sum(c for w, c in self.counts[name].items() if w in present) < least:
                continue
            count = np.concatenate([[0], np.cumsum(np.fromiter((w in own for w in words), dtype=np.int64, count=len(words)))])
            starts = np.arange(0, len(words), max(1, size // 2))
            ends = np.minimum(starts + 2 * size, len(words))
            best = None
            for s, e in zip(*(x[count[ends] - count[starts] >= least].tolist() for x in (starts, ends)), strict=True):
                pairs = patience(words[s:e], template)
                if len(pairs) < least:
                    continue
                if self.strict:
                    coverage, pairs = self.dense(pairs, size)
                    a, b = s + pairs[0][0], s + pairs[-1][0] + 1
                    if coverage >= self.min_coverage - 1e-9 and (best is None or coverage > best[1]) and self.told(name, b" %s " % b" ".join(words[a:b])):
                        best = (name, coverage, a, b, len(pairs))
                elif best is None or len(pairs) > best[4]:
                    best = (name, len(pairs) / size, s + pairs[0][0], s + pairs[-1][0] + 1, len(pairs))
            if best:
                found.append(best)
        return found


SCANNED = "licenses array<struct<license:string,coverage:double,first_word:long,end_word:long,matched:long>>"
FOUND = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("matched", pa.int64())]))


def scan_texts(templates: dict[str, str], min_coverage: float, telling: dict[str, tuple[str, ...]] | None = None):
    def run(batches):
        scanner = Scanner(templates, min_coverage, telling)
        names = ("license", "coverage", "first_word", "end_word", "matched")
        for batch in batches:
            found = [[dict(zip(names, x, strict=True)) for x in scanner.scan(t or "")] for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(found, FOUND)], ["key", "licenses"])

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text", telling: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``id_col, licenses``: for every row the templates covered to ``min_coverage`` or more.

    Each found template has its coverage, the words (counted from 0) between which it
    lies and the number matched, by template name; of windows that match alike the
    first counts.  Null, empty and wordless texts, and texts without a license, have
    an empty list; repeated rows give repeated rows; other columns are not read.

    With ``telling``, a match must hold the word runs that tell its template, and words
    inserted between matched ones count against coverage; without, coverage alone decides
    and cannot tell licenses apart whose notices differ in a word or two.
    """
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    scanned = rows.mapInArrow(scan_texts(TEMPLATES if templates is None else templates, min_coverage, telling), f"key {kind}, {SCANNED}")
    return scanned.withColumnRenamed("key", id_col)


def best_license(scanned: DataFrame) -> DataFrame:
    """One row for each row of ``scan_licenses``: its best license (most words matched, then coverage, then name) or nulls."""
    ranked = F.array_sort(F.transform("licenses", lambda x: F.struct((-x["matched"]).alias("m"), (-x["coverage"]).alias("c"), x["license"].alias("license"), x["first_word"].alias("first_word"), x["end_word"].alias("end_word"))))
    rows = scanned.withColumn("best", F.get(ranked, F.lit(0)))
    return rows.select("doc_id", F.col("best.license").alias("license"), (-F.col("best.c")).alias("coverage"), F.col("best.first_word").alias("first_word"), F.col("best.end_word").alias("end_word"), F.size("licenses").alias("n_licenses"))
