import random
import time

import pytest

from mdlake.llm import decontam

from .helpers import awkward, folded, frame, got, prose

ITEMS = "item_id long, text string"


def brute(docs, items, span):
    """Every maximal shared run of at least ``span`` words."""
    out = []
    for d, t in docs:
        a = folded(t)
        for i, s in items:
            b = folded(s)
            for x in range(len(a)):
                for y in range(len(b)):
                    if a[x] == b[y] and (x == 0 or y == 0 or a[x - 1] != b[y - 1]):
                        n = 0
                        while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                            n += 1
                        if n >= span:
                            out.append((d, i, x, x + n, y, n, round(n / len(b), 6)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [4_000_000, 0])
@pytest.mark.parametrize("vocabulary", [4, 3000])
def test_against_brute_force(spark, limit, vocabulary):
    rng = random.Random(vocabulary)
    items = [(i, prose(rng, rng.choice([5, 11, 12, 20, 40]), vocabulary)) for i in range(6)] + [(None, prose(rng, 15)), (7, None), (8, "")]
    docs = [(i, prose(rng, rng.randrange(5, 60), vocabulary)) for i in range(12)]
    for i in range(8):
        w = items[i % 6][1].upper().split()
        b = rng.randrange(max(1, len(w) - 14))
        docs.append((100 + i, f"{prose(rng, 9)} {', '.join(w[b:b + 14])} {prose(rng, 9)}"))
    docs.append((200, items[6][1]))
    found = got(decontam.overlaps(frame(spark, docs, "doc_id long, text string"), frame(spark, items, ITEMS), broadcast_limit=limit))
    assert found == brute(docs, [x for x in items if x[1]], 12) and any(r[1] is None for r in found)


@pytest.mark.parametrize("limit", [4_000_000, 0])
def test_awkward_rows(spark, limit):
    rng = random.Random(2)
    rows = awkward(rng)
    items = frame(spark, [(1, rows[0][1]), (1, rows[0][1]), (None, None), (3, "")], ITEMS).selectExpr("*", "'c' AS h", "'c' AS doc_id", "'c' AS th")
    docs = frame(spark, rows, clash=True)
    kept = decontam.keep_clean(docs, items, broadcast_limit=limit)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in rows if rows[0][1] not in (r[1] or "") and r[0] != 9)
    assert decontam.keep_clean(docs, items.where("false"), broadcast_limit=limit).count() == len(rows)
    assert decontam.overlaps(docs.where("false"), items, broadcast_limit=limit).count() == 0


@pytest.mark.parametrize("limit", [4_000_000, 0])
def test_repeated_items_are_one(spark, limit):
    rng = random.Random(6)
    one, two = prose(rng, 20), prose(rng, 20)
    items = [(1, one), (1, two), (2, one), (None, two)]
    docs = [(1, f"{one} x {two}"), (1, f"{one} x {two}"), (2, two), (None, one)]
    found = got(decontam.overlaps(frame(spark, docs, "doc_id long, text string"), frame(spark, items + items[::-1] + items[:1], ITEMS), broadcast_limit=limit))
    assert found == brute(docs, items, 12) and len(found) == 12


@pytest.mark.parametrize("n", [60, 61])
def test_texts_that_repeat_themselves(spark, n):
    """Runs of a cycle, also broken ones, against brute force."""
    rng = random.Random(n)
    cycle = lambda k, m: " ".join(f"c{i % k}" for i in range(m))
    items = [(1, cycle(4, n)), (2, cycle(1, 30)), (3, f"{cycle(4, 25)} x {cycle(4, 25)}"), (4, cycle(3, 20) + " " + cycle(4, 40))]
    docs = [(1, cycle(4, n)), (2, f"{cycle(4, 30)} y {cycle(4, 41)}"), (3, cycle(1, 45)), (4, " ".join([cycle(3, 20), cycle(2, 20), cycle(4, 22)])), (5, " ".join(rng.choice(["a b c d", "a b", "c"]) for _ in range(40)))]
    items.append((5, docs[4][1][20:150]))
    found = got(decontam.overlaps(frame(spark, docs, "doc_id long, text string"), frame(spark, items, ITEMS)))
    assert found == brute(docs, items, 12)


def test_repetition_costs_little():
    import numpy as np
    import pyarrow as pa

    from mdlake.llm import textkernel as K

    for n, most in ((4_000, 1), (40_000, 5)):
        text = pa.array([" ".join(f"c{i % 4}" for i in range(n))], pa.string())
        began = time.perf_counter()
        items = decontam.index(pa.array([1]), text, decontam.PARAMS)
        runs = decontam.matches(next(K.slices(text)), items, decontam.PARAMS, decontam._bitmap(items))
        assert time.perf_counter() - began < most and np.array_equal(runs[4].max(), n)
