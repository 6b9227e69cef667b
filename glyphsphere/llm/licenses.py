"""License scans: templates with optional and replaceable regions, compiled into automata over words.

Markup: ``<<beginOptional>>...<<endOptional>>`` and ``<<var;N>>`` (any 0 to N words). A text is accepted where its words
follow a template's mandatory wording exactly. Beside that, fixed phrases are counted (the base scan).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from glyphsphere.llm.common import text_slices

# Phrases of the base scan.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
_O, _E = "<<beginOptional>>", "<<endOptional>>"
_AS_IS = (
    f'THIS SOFTWARE IS PROVIDED BY <<var;12>> {_O}"AS IS"{_E} AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY "
    "WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"
)
_BSD = (
    f"Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: {_O}1.{_E} "
    f"Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. {_O}2.{_E} Redistributions in "
    "binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
    "provided with the distribution."
)
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND <<var;4>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND '
    "FITNESS. IN NO EVENT SHALL <<var;4>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
    "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"
)


def _gnu(name: str, version: str) -> str:
    return (
        f"is free software{_O}:{_E} you can redistribute it and/or modify it under the terms of the GNU {name} {_O}as published by the Free Software Foundation{_E} "
        f"<<var;6>> version {version} <<var;40>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        f"MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details"
    )


# Published wordings of whole licenses, and of the notices that their texts ask for.
TEMPLATES = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in "
        "the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
        f"permission notice {_O}(including the next paragraph){_E} shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
        "\"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
        "AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;8>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    ],
    "BSD-2-Clause": [f"{_BSD} {_AS_IS}"],
    "BSD-3-Clause": [
        f"{_BSD} {_O}3.{_E} Neither the name of <<var;12>> nor the names of its contributors may be used to endorse or promote products derived from this software "
        f"without specific prior written permission. {_AS_IS}",
    ],
    "ISC": [
        f"Permission to use, copy, modify, {_O}and{_E} {_O}or{_E} distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        f"copyright notice and this permission notice appear in all copies. {_ISC_END}",
    ],
    "0BSD": [f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_END}"],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of "
        "this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it "
        f"freely, subject to the following restrictions: {_O}1.{_E} The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        f"software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. {_O}2.{_E} Altered "
        f"source versions must be plainly marked as such, and must not be misrepresented as being the original software. {_O}3.{_E} This notice may not be removed or "
        "altered from any source distribution",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright "
        "laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the "
        "benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity "
        "of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE "
        "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
        "USE OR OTHER DEALINGS IN THE SOFTWARE",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the "
        f"License at {_O}http://www.apache.org/licenses/LICENSE-2.0{_E} {_O}https://www.apache.org/licenses/LICENSE-2.0{_E} Unless required by applicable law or agreed to "
        "in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        f"{_O}http://mozilla.org/MPL/2.0/{_E} {_O}https://mozilla.org/MPL/2.0/{_E}",
    ],
    "GPL-2.0": [_gnu("General Public License", "2")],
    "GPL-3.0": [_gnu("General Public License", "3")],
    "LGPL-2.1": [_gnu("Lesser General Public License", "2.1")],
    "LGPL-3.0": [_gnu("Lesser General Public License", "3")],
    "AGPL-3.0": [_gnu("Affero General Public License", "3")],
    # a line that names a license without its wording
    "MIT-notice": [f"{_O}Released{_E} {_O}Licensed{_E} under the {_O}terms of the{_E} MIT License"],
    "Apache-2.0-notice": ["Licensed under the Apache License, Version 2.0"],
    "GPL-2.0-notice": [f"under the {_O}terms of the{_E} GNU General Public License <<var;8>> version 2"],
    "GPL-3.0-notice": [f"under the {_O}terms of the{_E} GNU General Public License <<var;8>> version 3"],
    "LGPL-notice": [f"under the {_O}terms of the{_E} GNU Lesser General Public License"],
    "AGPL-notice": [f"under the {_O}terms of the{_E} GNU Affero General Public License"],
    "BSD-notice": [f"under the {_O}terms of the{_E} BSD {_O}2 Clause{_E} {_O}3 Clause{_E} License"],
    "CC-BY-notice": [f"Licensed under {_O}the{_E} {_O}Creative Commons Attribution{_E} {_O}a{_E} CC BY 4.0", f"under {_O}the{_E} {_O}a{_E} Creative Commons Attribution 4.0 {_O}International{_E} License"],
    "CC-BY-SA-notice": ["Licensed under CC BY SA 4.0", f"under {_O}the{_E} {_O}a{_E} Creative Commons Attribution ShareAlike 4.0 {_O}International{_E} License"],
    "CC-BY-NC-notice": ["Licensed under CC BY NC 4.0", f"under {_O}the{_E} {_O}a{_E} Creative Commons Attribution NonCommercial 4.0 {_O}International{_E} License"],
    "CC0-notice": ["CC0 1.0 Universal", "To the extent possible under law <<var;12>> has waived all copyright and related or neighboring rights to"],
    "Copyright": [f"Copyright {_O}(c){_E} <<var;6>> All rights reserved"],
}

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """UTF-8 words: runs of digits, a-z (A-Z folded) and everything beyond ASCII."""
    return (text or "").encode().translate(_FOLD).split()


def parts(template: str) -> list[tuple[str, object]]:
    """A template as ("word", w), ("optional", parts) and ("any", n)."""
    stack: list[list] = [[]]
    for mark, text in re.findall(r"<<([^>]*)>>|([^<]+)", template):
        if mark == "beginOptional":
            stack.append([])
        elif mark == "endOptional":
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        elif mark:
            stack[-1].append(("any", int(mark.split(";")[1])))
        else:
            stack[-1] += [("word", w) for w in words(text)]
    if len(stack) > 1:
        raise ValueError(f"optional region isn't closed: {template}")
    return stack[0]


class Automaton:
    """Nondeterministic automaton over words: ``step[s]`` has the moves (word or None for any word, to), ``skip[s]`` the moves
    without a word. State 0 begins, the last accepts."""

    def __init__(self, template: str):
        self.step: list[list[tuple[bytes | None, int]]] = [[]]
        self.skip: list[list[int]] = [[]]
        self._add(parts(template), 0)
        self.end = len(self.step) - 1
        self.first = {w for s in self._closure({0}) for w, _ in self.step[s]}

    def _state(self) -> int:
        self.step.append([])
        self.skip.append([])
        return len(self.step) - 1

    def _add(self, items: list, at: int) -> int:
        for kind, x in items:
            if kind == "word":
                to = self._state()
                self.step[at].append((x, to))
            elif kind == "any":
                ends = [at]
                for _ in range(x):
                    ends.append(self._state())
                    self.step[ends[-2]].append((None, ends[-1]))
                to = self._state()
                for s in ends:
                    self.skip[s].append(to)
            else:
                last = self._add(x, at)
                to = self._state()
                self.skip[last].append(to)
                self.skip[at].append(to)
            at = to
        return at

    def _closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def match(self, text: list[bytes], at: int) -> int | None:
        """End of the longest match that starts at word ``at``, or None."""
        states, found = self._closure({0}), None
        for i in range(at, len(text) + 1):
            if self.end in states:
                found = i
            if i == len(text):
                break
            states = self._closure({to for s in states for w, to in self.step[s] if w is None or w == text[i]})
            if not states:
                break
        return found


@cache
def _automata() -> tuple[list[tuple[str, Automaton]], frozenset]:
    made = [(label, Automaton(t)) for label, ts in TEMPLATES.items() for t in ts]
    return made, frozenset(w for _, a in made for w in a.first)


def scan(text: str | None) -> dict:
    """Words, places of the base phrases, and the matched spans (label, first word, end) of one text.

    ``score``: 1 if a whole wording is accepted, 0.75 if only a notice is, else 0.5 if a base phrase occurs, else 0. Null or
    empty text: no words. Equal spans of one label under several templates count once.
    """
    w = words(text)
    have = set(w)
    base: list[tuple[int, str]] = []
    if b"license" in have:
        for phrase, label in PHRASES.items():
            p = phrase.encode().split()
            base += [(i, label) for i in _places(w, p[0]) if w[i : i + len(p)] == p] if p[0] in have else []
    spans = []
    automata, first = _automata()
    if not have.isdisjoint(first):
        for label, a in automata:
            for i in sorted(i for f in a.first & have for i in _places(w, f)):
                if (end := a.match(w, i)) is not None:
                    spans.append((label, i, end))
    spans = sorted(set(spans), key=lambda x: (x[1], x[2], x[0]))
    starts = [i for i, _ in base]
    base_labels = sorted({x for _, x in base})
    return {
        "n_words": len(w), "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": ",".join(base_labels), "labels": ",".join(sorted({*base_labels, *(x for x, _, _ in spans)})),
        "score": 1.0 if any(map(_whole, spans)) else 0.75 if spans else 0.5 if base else 0.0, "spans": [{"label": x, "first": i, "end": j} for x, i, j in spans],
    }


def _whole(span: tuple[str, int, int]) -> bool:
    return not span[0].endswith("-notice") and span[0] != "Copyright"


def _places(w: list[bytes], word: bytes) -> list[int]:
    out, at = [], -1
    try:
        while True:
            at = w.index(word, at + 1)
            out.append(at)
    except ValueError:
        return out


_FIELDS = [
    ("n_words", LongType()), ("n_base", LongType()), ("first_word", LongType()), ("last_word", LongType()), ("base_labels", StringType()), ("labels", StringType()),
    ("score", DoubleType()), ("spans", ArrayType(StructType([StructField("label", StringType()), StructField("first", LongType()), StructField("end", LongType())]))),
]


def scanned(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) with what ``scan`` finds in each whole text; a column of the same name is replaced.
    Repeated rows are scanned each; a null text is an empty one. Empty table: no rows."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in dict(_FIELDS)]
    schema = StructType([*(docs.schema[c] for c in keep), *(StructField(n, t) for n, t in _FIELDS)])
    docs = docs.select(F.col(text_col).alias("__text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for whole in batches:
            for lo, hi in text_slices(whole.column(0)):
                batch = whole.slice(lo, hi - lo)
                found = [scan(t) for t in batch.column(0).to_pylist()]
                cols = [pa.array([r[n] for r in found], to_arrow_type(t)) for n, t in _FIELDS]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *cols], [*keep, *(n for n, _ in _FIELDS)])

    return docs.mapInArrow(run, schema)


def _pattern(items: list) -> str:
    """The same language as a regular expression over words, each with a space after it."""
    out = ""
    for kind, x in items:
        out += x.decode() + " " if kind == "word" else f"([^ ]+ ){{0,{x}}}" if kind == "any" else f"({_pattern(x)})?"
    return out


def duckdb_sql() -> str:
    """The whole scan as DuckDB SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    starts = "list_concat(" + "list_concat(".join(
        f"list_filter(range(1, len(w) + 1), lambda i: array_to_string(w[i:i+{len(p.split()) - 1}], ' ') = '{p}'), " for p in PHRASES
    ) + "[]" + ")" * len(PHRASES)
    base = ", ".join(f"CASE WHEN contains(t, ' {p} ') THEN '{label}' END" for p, label in PHRASES.items())
    own = ", ".join("CASE WHEN " + " OR ".join(f"regexp_matches(t, ' {_pattern(parts(x))}')" for x in ts) + f" THEN '{label}' END" for label, ts in TEMPLATES.items())
    return rf"""
WITH a AS (SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) AS s FROM documents),
b AS (SELECT doc_id, CASE WHEN s = '' THEN []::VARCHAR[] ELSE string_split(s, ' ') END AS w, ' ' || s || ' ' AS t FROM a),
c AS (SELECT doc_id, w, CASE WHEN contains(t, ' license ') THEN {starts} ELSE [] END AS p,
  list_filter([{base}], lambda x: x IS NOT NULL) AS bl, list_filter([{own}], lambda x: x IS NOT NULL) AS ol FROM b)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base, CAST(list_min(p) - 1 AS BIGINT) AS first_word, CAST(list_max(p) - 1 AS BIGINT) AS last_word,
  array_to_string(list_sort(bl), ',') AS base_labels, array_to_string(list_sort(list_concat(bl, ol)), ',') AS labels,
  CASE WHEN len(list_filter(ol, lambda x: NOT ends_with(x, '-notice') AND x <> 'Copyright')) > 0 THEN 1.0::DOUBLE WHEN len(ol) > 0 THEN 0.75::DOUBLE WHEN len(p) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM c"""
