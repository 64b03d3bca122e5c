"""Licence texts by templates with optional and replaceable regions.

A template is plain wording with two kinds of markup:

* ``<<beginOptional>> ... <<endOptional>>`` (may nest): may be left out;
* ``<<var;match="...">>``: other wording may stand here; ``.{a,b}`` stands for a
  to b words, anything else for alternatives ``one|two words|three``.

Wording is compared as folded words (``licence`` and ``license`` are one), all
of it that is neither optional nor replaceable must be there, in order, with
nothing between. A template becomes an automaton over words; it runs from every
word of a text with which a match can begin, and the longest match from the
first such word counts; the search goes on behind it.

A licence has its whole text as a template, in this module or in the folder
``licenses``, where numbers of clauses, titles, copyright lines and appendices
are optional. Most also have a template for the notice by which works refer to
them. AGPL and the other Creative Commons licences have the notice only.
"""

from __future__ import annotations

import re
from pathlib import Path
from typing import Any, Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkernel as K
from .common import prepare, require

_NOTICE = '<<beginOptional>>This <<var;match="work|software|program|project|library|file|document|code|text|article">> is <<endOptional>>'
_UNDER = '<<var;match="licensed|released|distributed|available|published|made available">> under <<beginOptional>>the terms of <<endOptional>><<beginOptional>>the <<endOptional>>'
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND <<var;match="NONINFRINGEMENT|NON-INFRINGEMENT">>. IN NO EVENT SHALL <<var;match=".{1,20}">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<beginOptional>>1. <<endOptional>>Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2. <<endOptional>>Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY <<var;match=".{1,20}">> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;match=".{1,20}">> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        _NOTICE + _UNDER + "MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph) <<endOptional>>shall be included in all copies or substantial portions of <<var;match=\"the Software|the Materials\">>. "
        + _AS_IS,
    ],
    "Apache-2.0": [
        _NOTICE + _UNDER + 'Apache <<beginOptional>>Software <<endOptional>>License, Version 2.0<<beginOptional>> (the License); you may not use <<var;match="this file|this work|this software">> except in compliance with the License<<endOptional>>'
    ],
    "GPL-2.0": [
        _NOTICE + _UNDER + "GNU General Public License, version 2<<beginOptional>>.0<<endOptional>>",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    ],
    "GPL-3.0": [
        _NOTICE + _UNDER + "GNU General Public License, version 3<<beginOptional>>.0<<endOptional>>",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "LGPL-2.1": [_NOTICE + _UNDER + "GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": [_NOTICE + _UNDER + "GNU Lesser General Public License, version 3<<beginOptional>>.0<<endOptional>>"],
    "AGPL-3.0": [_NOTICE + _UNDER + "GNU Affero General Public License, version 3<<beginOptional>>.0<<endOptional>>"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "BSD-2-Clause": [_BSD_HEAD + " " + _BSD_TAIL],
    "BSD-3-Clause": [
        _BSD_HEAD
        + ' <<beginOptional>>3. <<endOptional>>Neither the name of <<var;match=".{1,20}">> may be used to endorse or promote products derived from this software without specific prior written permission. '
        + _BSD_TAIL
    ],
    "ISC": [
        'Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;match=".{1,8}">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;match=".{1,8}">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
    ],
    "Zlib": [
        'This software is provided <<var;match="as is">>, without any express or implied warranty. In no event will the <<var;match="author|authors">> be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: <<beginOptional>>1. <<endOptional>>The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. <<beginOptional>>2. <<endOptional>>Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. <<beginOptional>>3. <<endOptional>>This notice may not be removed or altered from any source distribution.'
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
        + _AS_IS
        + '<<beginOptional>> For more information, please refer to <<var;match=".{1,6}">><<endOptional>>'
    ],
    **{
        f"CC-BY{x.upper()}-4.0": [
            _NOTICE + _UNDER + f"CC BY{x} 4.0",
            _NOTICE + _UNDER + f"<<beginOptional>>a <<endOptional>>Creative Commons Attribution{y} 4.0 International <<beginOptional>>Public <<endOptional>>License",
        ]
        for x, y in (("", ""), ("-nc", "-NonCommercial"), ("-sa", "-ShareAlike"), ("-nd", "-NoDerivatives"), ("-nc-sa", "-NonCommercial-ShareAlike"), ("-nc-nd", "-NonCommercial-NoDerivatives"))
    },
    "CC0-1.0": [_NOTICE + _UNDER + "CC0 1.0<<beginOptional>> Universal<<endOptional>>"],
}
for _path in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
    TEMPLATES[_path.stem].append(_path.read_text())


def fold_words(text: str) -> list[str]:
    return ["license" if w == "licence" else "licensed" if w == "licenced" else w for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())]


class Automaton(NamedTuple):
    """``edges``: from each state, word to next states; ``any``: states from
    which any word leads; ``free``: next states without a word."""

    name: str
    edges: list[dict[str, list[int]]]
    any: list[list[int]]
    free: list[list[int]]
    final: int
    must: frozenset[str]


def compile_template(name: str, text: str) -> Automaton:
    edges: list[dict[str, list[int]]] = [{}]
    wild: list[list[int]] = [[]]
    free: list[list[int]] = [[]]
    must: set[str] = set()

    def state() -> int:
        edges.append({})
        wild.append([])
        free.append([])
        return len(edges) - 1

    def words(at: int, ws: list[str]) -> int:
        for w in ws:
            to = state()
            edges[at].setdefault(w, []).append(to)
            at = to
        return at

    at, opened = 0, []
    for part in re.split(r"(<<.*?>>)", text):
        if part.startswith("<<beginOptional"):
            opened.append(at)
        elif part.startswith("<<endOptional"):
            if not opened:
                raise ValueError(f"{name}: endOptional without beginOptional")
            to = state()
            free[opened.pop()].append(to)
            free[at].append(to)
            at = to
        elif part.startswith("<<var"):
            match = re.search(r'match="([^"]*)"', part)
            if not match:
                raise ValueError(f"{name}: var without match")
            end = state()
            if m := re.fullmatch(r"\.\{(\d+),(\d+)\}", match[1]):
                lo, hi = int(m[1]), int(m[2])
                for i in range(hi + 1):
                    if i >= lo:
                        free[at].append(end)
                    if i < hi:
                        to = state()
                        wild[at].append(to)
                        at = to
            else:
                for one in match[1].split("|"):
                    free[words(at, fold_words(one))].append(end)
            at = end
        elif part.startswith("<<"):
            raise ValueError(f"{name}: unknown markup {part}")
        else:
            ws = fold_words(part)
            at = words(at, ws)
            if not opened:
                must |= set(ws)
    if opened:
        raise ValueError(f"{name}: beginOptional without endOptional")
    if not must:
        raise ValueError(f"{name}: no mandatory wording")
    return Automaton(name, edges, wild, free, at, frozenset(must))


def _closure(a: Automaton, states: set[int]) -> set[int]:
    todo = list(states)
    while todo:
        for to in a.free[todo.pop()]:
            if to not in states:
                states.add(to)
                todo.append(to)
    return states


def longest(a: Automaton, words: list[str], at: int) -> int:
    """End of the longest match that begins at word ``at``, or -1."""
    now, end = _closure(a, {0}), -1
    while now:
        if a.final in now:
            end = at
        if at >= len(words):
            break
        w = words[at]
        now = _closure(a, {to for s in now for to in (*a.edges[s].get(w, ()), *a.any[s])})
        at += 1
    return end


def find(a: Automaton, words: list[str]) -> list[tuple[int, int]]:
    start = _closure(a, {0})
    first = None if any(a.any[s] for s in start) else {w for s in start for w in a.edges[s]}
    out, at = [], 0
    while at < len(words):
        if first is None or words[at] in first:
            end = longest(a, words, at)
            if end > at:
                out.append((at, end))
                at = end
                continue
        at += 1
    return out


def _rare(a: Automaton) -> str:
    """A mandatory word by which texts are chosen before they are scanned."""
    common = ("unencumbered", "license", "permission", "redistribution", "cc", "cc0", "commons")
    return next((w for w in common if w in a.must), max(a.must, key=len))


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """(doc_id, license, start_word, end_word, matched) of every match.

    Matches of different licences may overlap; those of one template don't. A
    match that lies within a longer one of the same licence is left out; of
    matches that begin at one word, the longest counts. Null and empty texts
    match nothing. Texts may be of any length and hold any number of matches.
    Rows that repeat match each; a null doc_id stays null; an empty table yields
    no rows. Other columns are ignored."""
    prepare(docs.sparkSession)
    automata = [compile_template(name, t) for name, ts in templates.items() for t in ts]
    words = sorted({_rare(a) for a in automata})
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[0], []).append(re.escape(w[1:]).replace("icense", "icen[sc]e"))
    # one look at the first letter settles most places of a text
    pattern = f"(?i)(?=[{''.join(heads)}])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in heads.items()) + ")"
    by_word: dict[str, list[Automaton]] = {}
    for a in automata:
        by_word.setdefault(_rare(a), []).append(a)
    shared = docs.sparkSession.sparkContext.broadcast(by_word)  # the templates, whatever the data

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_word = shared.value
        for batch in it:
            out: list[list] = [[] for _ in range(5)]
            for i, text in enumerate(batch.column("text").to_pylist()):
                buf = np.frombuffer(text.encode(), np.uint8)
                ws = K.words(K.Slice(0, buf, np.array([0, buf.size])), folded=True)
                raw, low = buf.tobytes(), K.fold(buf).tobytes()
                ours = [low[b:e].decode("utf-8", "replace") for b, e in zip(ws.start.tolist(), ws.end.tolist())]
                ours = ["license" if w == "licence" else "licensed" if w == "licenced" else w for w in ours]
                has = set(ours)
                found = {(a.name, b, e) for w in words if w in has for a in by_word[w] if a.must <= has for b, e in find(a, ours)}
                of, reach = "", -1
                for name, b, e in sorted(found, key=lambda x: (x[0], x[1], -x[2])):
                    if name == of and e <= reach:  # lies within one that begins before it or is longer
                        continue
                    of, reach = name, e
                    for o, v in zip(out, (i, name, b, e, raw[ws.start[b] : ws.end[e - 1]].decode("utf-8", "replace"))):
                        o.append(v)
            ids = batch.column("doc_id").take(pa.array(out[0], pa.int64()))
            yield pa.record_batch([ids, pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.string())], names=["doc_id", "license", "start_word", "end_word", "matched"])

    rows = require(docs, "doc_id", "text").where(F.col("text").rlike(pattern))
    return rows.mapInArrow(run, "doc_id long, license string, start_word int, end_word int, matched string")
