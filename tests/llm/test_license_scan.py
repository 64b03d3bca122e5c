import itertools
import random
import re
import time
from pathlib import Path

import pytest

from mdlake.llm import license_scan as L

from .helpers import awkward, frame


def expand(template):
    """All wordings of a template, by trying every choice."""
    tokens = re.findall(r"<<.*?>>|[^<]+", template)

    def walk(i):
        """(wordings, index behind) up to an endOptional or the end."""
        out = [[]]
        while i < len(tokens):
            t = tokens[i]
            if t.startswith("<<beginOptional"):
                inner, i = walk(i + 1)
                out = [a + b for a in out for b in [[], *inner]]
            elif t.startswith("<<endOptional"):
                return out, i
            elif t.startswith("<<var"):
                match = re.search('match="(.*?)"', t)[1]
                if m := re.fullmatch(r"\.\{(\d+),(\d+)\}", match):
                    choices = [["*"] * n for n in range(int(m[1]), int(m[2]) + 1)]
                else:
                    choices = [L.fold_words(x) for x in match.split("|")]
                out = [a + b for a in out for b in choices]
            else:
                out = [a + L.fold_words(t) for a in out]
            i += 1
        return out, i

    return walk(0)[0]


TEMPLATES = [
    "a b<<beginOptional>> c<<beginOptional>> d<<endOptional>><<endOptional>> e", 'a <<var;match=".{0,2}">> b', '<<beginOptional>>x <<endOptional>>a <<var;match="b|c d">> e',
    'a <<var;match=".{1,3}">> a', "a a b",
]


@pytest.mark.parametrize("template", TEMPLATES)
def test_automaton_against_all_wordings(template):
    a = L.compile_template("t", template)
    wordings = expand(template)
    rng = random.Random(1)
    for _ in range(600):
        ws = [rng.choice("abcdex") for _ in range(rng.randrange(1, 9))]
        for at in range(len(ws)):
            ends = [at + len(w) for w in wordings if at + len(w) <= len(ws) and all(p in ("*", q) for p, q in zip(w, ws[at:]))]
            assert L.longest(a, ws, at) == max(ends, default=-1)


def test_bad_templates():
    for bad in ("a<<endOptional>>", "a<<beginOptional>>b", "<<var;x>>a", "<<other>>a", "<<beginOptional>>a<<endOptional>>"):
        with pytest.raises(ValueError):
            L.compile_template("t", bad)


def test_scan(spark):
    mit = L.TEMPLATES["MIT"][1].replace('<<var;match="the Software|the Materials">>', "the Materials")
    full = re.sub("<<.*?>>", "", mit.replace('<<var;match="NONINFRINGEMENT|NON-INFRINGEMENT">>', "NonInfringement").replace('<<var;match=".{1,20}">>', "the authors"))
    rows = [
        (1, "Head.\n" + full.upper().replace(" ", "\n * ") + "\nTail"), (2, full.replace("without restriction", "without any restriction")), (20, full.replace("TORT OR OTHERWISE", "TORT OR ELSE")), (21, full[: full.index("IN NO EVENT")]), (3, "This program is licenced under the GNU General Public License, version 3.0!"),
        (4, "This work is licensed under CC BY-SA 4.0."), (5, "released under the Apache License, Version 2.0"), (6, "Apache License"), (7, "x " * 100_000 + "licensed under the MIT license"),
        (8, "This file is licensed under MIT License. This file is licensed under the MIT License."),
    ]
    found = {}
    for r in L.scan(frame(spark, rows, "doc_id long, text string")).collect():
        found.setdefault(r.doc_id, []).append((r.license, r.start_word, r.end_word, r.matched))
    assert {d: [x[0] for x in v] for d, v in found.items()} == {1: ["MIT"], 3: ["GPL-3.0"], 4: ["CC-BY-SA-4.0"], 5: ["Apache-2.0"], 7: ["MIT"], 8: ["MIT", "MIT"]}
    assert found[1][0][1] == 1 and found[3][0][3] == "This program is licenced under the GNU General Public License, version 3.0" and found[7][0][1] == 100_000


def test_scan_against_brute_force_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    automata = [L.compile_template(n, t) for n, ts in L.TEMPLATES.items() for t in ts]
    want = set()
    for r in docs.collect():
        ws = L.fold_words(r.text or "")
        spans = {(a.name, b, e) for a in automata for b in range(len(ws)) if (e := L.longest(a, ws, b)) > b}
        for n, b, e in spans:  # the first of overlapping ones, and of these the longest
            if not any(m == n and (x < b < y or (x <= b and e <= y and (x, y) != (b, e))) for m, x, y in spans):
                want.add((r.doc_id, n, b, e))
    got = {(r.doc_id, r.license, r.start_word, r.end_word) for r in L.scan(docs).collect()}
    assert got == want and got


def test_awkward_rows(spark):
    rows = awkward(random.Random(1)) + [(None, "under the MIT license, licensed under the MIT License", None, None, None)] * 2
    out = L.scan(frame(spark, rows, clash=True)).collect()
    assert [(r.doc_id, r.license, r.start_word) for r in out] == [(None, "MIT", 4)] * 2
    assert L.scan(frame(spark, rows).where("false")).count() == 0
    assert list(itertools.islice(L.find(L.compile_template("t", "a b"), "a b a b".split()), 3)) == [(0, 2), (2, 4)]


def text_of(name):
    """The wording of a template with all options in it, its own line breaks,
    and a word for each free region."""
    t = (Path(L.__file__).parent / "licenses" / f"{name}.txt").read_text()
    return re.sub("<<(begin|end)Optional>>", "", t.replace('<<var;match="http|https">>', "http"))


def test_whole_licences(spark):
    names = ["Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"]
    rows = []
    for i, name in enumerate(names):
        t = text_of(name)
        assert len(t.split()) > 900
        ws = t.split()
        at = next(k for k in range(len(ws) // 2, len(ws)) if ws[k].isalpha() and len(ws[k]) > 4)
        rows += [(i, f"Before it.\n{t}\nBehind it."), (100 + i, " ".join(ws[:at] + ["altered"] + ws[at + 1 :])), (200 + i, " ".join(ws[: len(ws) // 2]))]
    got = {}
    for r in L.scan(frame(spark, rows, "doc_id long, text string")).collect():
        if r.end_word - r.start_word > 200:
            got.setdefault(r.doc_id, []).append(r.license)
    assert got == {i: [name] for i, name in enumerate(names)}


def test_many_matches_in_one_text(spark):
    text = "Licensed under the MIT License. " * 50_000
    began = time.perf_counter()
    assert L.scan(frame(spark, [(1, text)], "doc_id long, text string")).count() == 50_000
    assert time.perf_counter() - began < 15
