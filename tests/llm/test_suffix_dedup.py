import random

import numpy as np
import pytest

from mdlake.llm import bwt, suffix_dedup as D

from .helpers import awkward, frame, plain, prose


def brute(docs, n, within=False):
    """Marked passages: every window of n words that an earlier document
    holds, or that occurs before."""
    seen, out = {}, []
    order = sorted({(d, t) for d, t in docs if t}, key=lambda x: (x[0] is not None, x[0] or 0))
    for d, t in order:
        w = plain(t)
        mark = np.zeros(len(w), bool)
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            if k in seen and (within or seen[k] != (d, t)):
                mark[i : i + n] = True
            seen.setdefault(k, (d, t))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.view(np.int8), [0]])))
        out += [(d, int(b), int(e)) for b, e in zip(edge[::2], edge[1::2])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("ram, hot", [(1 << 23, 1 << 40), (1000, 1 << 40), (1 << 23, 3), (1 << 23, 0)])
@pytest.mark.parametrize("within", [False, True])
@pytest.mark.parametrize("vocabulary, words", [(3000, 50), (3, 20), (2, 10), (3000, 300)])
def test_against_brute_force(spark, vocabulary, words, within, ram, hot):
    rng = random.Random(vocabulary)
    passages = [prose(rng, n, vocabulary) for n in (49, 50, 51, 80, 200, 299, 300, 301, 420)]
    docs = []
    for i in range(40):
        parts = [prose(rng, rng.randrange(0, 70), vocabulary)]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), prose(rng, rng.randrange(0, 30), vocabulary)]
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(parts)))
    docs.append((50, " ".join([passages[1]] * 4)))
    rows = D.repeats(frame(spark, docs, "doc_id long, text string"), words=words, k=min(16, words // 2), within=within, ram=ram, hot=hot).collect()
    assert sorted(((r.doc_id, r.start_word, r.end_word) for r in rows), key=repr) == brute(docs, words, within)
    assert all(r.first_doc_id <= r.doc_id for r in rows)


def test_cut(spark):
    rng = random.Random(1)
    shared = prose(rng, 60)
    a, b = prose(rng, 30), prose(rng, 30)
    docs = frame(spark, [(1, shared, "x", "s", 0), (2, f"{a}\n{shared} {b}", "x", "s", 0), (3, shared, "x", "s", 0), (4, a, "x", "s", 7)])
    rows = {r.doc_id: r for r in D.cut(docs).collect()}
    assert set(rows) == {1, 2, 4} and rows[2].text == f"{a}\n{b}" and rows[2].n_chars == len(rows[2].text) and rows[4].n_chars == 7 and rows[1].text == shared


def test_awkward_rows(spark):
    rows = awkward(random.Random(5))
    docs = frame(spark, rows, clash=True)
    found = sorted(((r.doc_id, r.start_word, r.end_word) for r in D.repeats(docs).collect()), key=repr)
    assert found == brute([(r[0], r[1]) for r in rows], 50)
    out = D.cut(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(map(str, [None, None, 3, 4, 5, 6, 7, 8, 9, 10, -5, 2**62]))
    assert D.repeats(docs.where("false")).count() == 0 and D.cut(docs.where("false")).count() == 0


@pytest.mark.parametrize("ram", [1 << 23, 16])
def test_order_of_suffixes(tmp_path, ram):
    rng = np.random.default_rng(1)
    for alphabet in (1, 2, 50):
        seqs = [rng.integers(0, alphabet, rng.integers(0, 25)) for _ in range(20)]
        starts = np.append(0, np.cumsum([len(s) for s in seqs]))
        order = bwt.build(np.concatenate(seqs).astype(np.int64), starts, 200, bwt.Room(str(tmp_path), ram))
        pieces = [(lcp.copy(), own.copy()) for _, _, (lcp, own) in order.pieces(1, 2)]
        assert (len(pieces) > 3) == (ram < 100)
        lcp, own = (np.concatenate(x) for x in zip(*pieces))
        seq, off = own >> 32, own & (2**32 - 1)
        order.drop()
        assert not list(tmp_path.iterdir())
        want = sorted((tuple(s[i:]), n, i) for n, s in enumerate(seqs) for i in range(len(s)))
        assert [(int(a), int(b)) for a, b in zip(seq, off)] == [(n, i) for _, n, i in want]
        for i in range(1, len(want)):
            a, b = want[i - 1][0], want[i][0]
            n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
            assert lcp[i] == n
