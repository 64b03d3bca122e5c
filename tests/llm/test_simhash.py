import random
from collections import defaultdict

import numpy as np
import pytest

from mdlake.llm import simhash as S
from mdlake.llm import textkernel as K

from .helpers import awkward, frame, prose


def changed(rng, text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"z{rng.randrange(10**6)}"
    return " ".join(w)


def marks(texts):
    import pyarrow as pa

    out = []
    for s in K.slices(pa.array(texts)):
        hi, lo, n = S.fingerprints_of(s)
        out += [(int(a) << 64 | int(b), int(c)) for a, b, c in zip(hi, lo, n)]
    return out


def brute(texts, most):
    """Components of the pairs within the distance, by all pairs."""
    f = marks(texts)
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = []
    for i in range(len(f)):
        for j in range(i):
            if f[i][1] and f[j][1] and (f[i][0] ^ f[j][0]).bit_count() <= most:
                pairs.append((j, i))
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    groups = defaultdict(list)
    for i in range(len(f)):
        groups[root(i)].append(i)
    return pairs, groups


def test_recall_and_precision(spark):
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(30, 200)) for _ in range(150)]
    for i in range(120):
        texts.append(changed(rng, texts[i], rng.randrange(0, 5)))
    pairs, groups = brute(texts, S.PARAMS["max_distance"])
    rows = S.near_duplicates(frame(spark, list(enumerate(texts)), "doc_id long, text string")).collect()
    group = {r.doc_id: r.group_id for r in rows}
    hit = sum(group.get(a, -1) == group.get(b, -2) for a, b in pairs)
    assert len(pairs) > 90 and hit / len(pairs) >= 0.9
    true = {i: min(g) for g in groups.values() for i in g}
    assert all(true[r.doc_id] == true[r.group_id] for r in rows)  # nothing is joined that brute force doesn't join
    assert sum(r.keep for r in rows) == len({r.group_id for r in rows})
    assert all(r.keep == (r.doc_id == r.group_id) for r in rows)


def test_large_buckets_are_split_and_still_found(spark):
    rng = random.Random(4)
    base = prose(rng, 150)
    texts = [changed(rng, base, 2) for _ in range(300)] + [prose(rng, 150) for _ in range(50)]
    rows = S.near_duplicates(frame(spark, list(enumerate(texts)), "doc_id long, text string"), cap=20).collect()
    assert len({r.group_id for r in rows}) == 1 and len(rows) >= 290 and all(r.doc_id < 300 for r in rows)


def test_all_buckets_large_equal_brute_force(spark):
    """With no bits to sample all points share one bucket, so no task has a
    bucket of few points and nothing may be missed."""
    rng = random.Random(8)
    texts = [prose(rng, rng.randrange(30, 120)) for _ in range(120)]
    texts += [changed(rng, t, rng.randrange(0, 6)) for t in texts[:80]]
    _, groups = brute(texts, S.PARAMS["max_distance"])
    want = {i: (min(g), len(g)) for g in groups.values() if len(g) > 1 for i in g}
    rows = S.near_duplicates(frame(spark, list(enumerate(texts)), "doc_id long, text string"), bits=0, tables=1).collect()
    assert len(want) > 100 and {r.doc_id: (r.group_id, r.group_size) for r in rows} == want


def test_no_small_buckets():
    none = np.zeros(0, np.uint64)
    assert [x.tolist() for x in S._small(none.astype(np.int64), none, none, 22)] == [[], []]


def test_awkward_rows(spark):
    rows = awkward(random.Random(5))
    docs = frame(spark, rows, clash=True)
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    # the copies of one text leave the one without an id, which sorts first; documents without words stay
    assert sorted(map(str, ids)) == sorted(map(str, [None, 3, 4, 5, 6, 7, 8, 10, -5, 2**62]))
    near = S.near_duplicates(docs).collect()
    assert {r.doc_id for r in near} == {None, 1, 2, 9} and {r.group_size for r in near} == {4}
    assert S.keep_one(docs.where("false")).count() == 0 and S.near_duplicates(docs.where("false")).count() == 0


def components(n, pairs):
    label = list(range(n))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return [root(x) for x in range(n)]


@pytest.mark.parametrize("n, centres, flips", [(300, 300, 0), (300, 5, 14), (3000, 8, 12), (2500, 2500, 0), (2600, 40, 20)])
def test_forest_connects_what_all_pairs_connect(n, centres, flips):
    rng = np.random.default_rng(n + centres)
    base = rng.integers(0, 2, (centres, 128))
    x = base[rng.integers(0, centres, n)]
    for row in x:
        row[rng.choice(128, rng.integers(0, flips + 1), replace=False)] ^= 1
    word = np.packbits(x, axis=1).view(np.uint64)
    hi, lo = word[:, 0].copy(), word[:, 1].copy()
    near = S._distance(hi, lo, np.arange(n)[:, None], np.arange(n)[None, :]) <= 22
    found = S.forest(hi, lo, 22)
    assert all(near[a, b] for a, b in found) and len(found) < 5 * n
    assert components(n, found) == components(n, zip(*(v.tolist() for v in np.nonzero(np.triu(near, 1)))))


def test_recall_is_planned_to_be_the_same_at_every_size():
    least = S.meets(22, 13, 32)
    assert S.plan(1000, S.PARAMS) == (13, 32) and S.plan(3_200_000, S.PARAMS) == (13, 32)
    for points in (4_000_000, 12_000_000, 10**9, 4 * 10**10):
        bits, tables = S.plan(points, S.PARAMS)
        assert points / 2**bits <= S.PARAMS["bucket"] and S.meets(22, bits, tables) >= least > S.meets(22, bits, tables - 1)


def test_recall_with_more_bits(spark):
    """As on a corpus for which 18 bits are planned, with the tables for them."""
    rng = random.Random(7)
    texts = [prose(rng, rng.randrange(60, 200)) for _ in range(200)]
    texts += [changed(rng, t, 8) for t in texts]
    docs = frame(spark, list(enumerate(texts)), "doc_id long, text string")
    pairs, _ = brute(texts, 22)
    assert S.plan(400, S.PARAMS | {"bucket": 400 / 2**18})[0] == 18
    group = {r.doc_id: r.group_id for r in S.near_duplicates(docs, bucket=400 / 2**18).collect()}
    assert len(pairs) > 150 and sum(group.get(a, -1) == group.get(b, -2) for a, b in pairs) / len(pairs) > 0.9
