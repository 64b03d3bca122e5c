import itertools
import random

import numpy as np
import pyarrow as pa

from mdlake.llm import quality as Q
from mdlake.llm import textkernel as K

from .helpers import awkward, frame

FLOOR, P = np.array(Q.PARAMS["floor"]), Q.P


def matrix(texts):
    return np.concatenate([Q.statistics(s, Q.PARAMS["weight"])[0] for s in K.slices(pa.array(texts))])


def medians(x):
    n = len(x)

    def quantile(v, q):
        v = np.sort(np.floor(v * 256))
        return v[int(np.searchsorted(np.arange(1, n + 1), q * n))] / 256 + 1 / 512

    return tuple(np.array(v) for v in zip(*((quantile(c, 0.5), max((quantile(c, 0.75) - quantile(c, 0.25)) / 1.349, f)) for c, f in zip(x.T, FLOOR))))


def estimate(x, p=Q.PARAMS):
    """(centre, inverse, log determinant, median distance): the same starts and
    steps, on all vectors of a group at once."""
    n = len(x)

    def close(mean, cov):
        cov = cov + np.diag(FLOOR**2)
        return mean, np.linalg.inv(cov), np.linalg.slogdet(cov)[1]

    def bucket(mean, inv):
        return np.floor(np.log2(np.maximum(np.einsum("ij,jk,ik->i", x - mean, inv, x - mean), 1e-12)) * 16)

    def step(mean, inv, _):
        b, need = bucket(mean, inv), int(np.ceil(p["h"] * n))
        edge = np.sort(b)[need - 1]
        w = np.where(b < edge, 1.0, 0.0)
        w[b == edge] = (need - w.sum()) / (b == edge).sum()
        new = w @ x / need
        return close(new, (x - new).T @ (w[:, None] * (x - new)) / need)

    mean, scale = medians(x)
    z = (x - mean) / scale
    by = np.outer(scale, scale)
    way = z / np.maximum(np.linalg.norm(z, axis=1), 1e-9)[:, None]
    begin = [(mean, np.diag(scale**2)), (x.mean(axis=0), np.cov(x.T, bias=True)), (mean, way.T @ way / n * P * by), (mean, np.tanh(z).T @ np.tanh(z) / n * by)]
    now = [close(*v) for v in begin]
    for _ in range(p["first_steps"]):
        now = [step(*v) for v in now]
    best = min(now, key=lambda v: v[2])
    while (new := step(*best))[2] < best[2] - p["tolerance"]:
        best = new
    best = min(best, new, key=lambda v: v[2])
    return *best, 2.0 ** ((np.sort(bucket(*best[:2]))[int(np.ceil(n / 2)) - 1] + 0.5) / 16)


def brute(x, p=Q.PARAMS):
    mean, inv, _, half = estimate(x, p)
    return np.maximum(np.einsum("ij,jk,ik->i", x - mean, inv, x - mean), 1e-12) * Q.chi2_quantile(P, 0.5) / half


def determinant(x):
    return np.linalg.slogdet(np.cov(x.T, bias=True) + np.diag(FLOOR**2))[1]


def test_least_determinant_of_all_subsets():
    """Of small groups, with outliers, against every subset of the share h."""
    for seed in range(6):
        rng = np.random.default_rng(seed)
        x = rng.normal(0, 1, (13, P)) * rng.uniform(0.1, 0.6, P)
        x[:3] += 4
        least = min(determinant(x[list(some)]) for some in itertools.combinations(range(13), 10))
        assert estimate(x)[2] < least + 0.6 and estimate(x)[2] < determinant(x) - 1


def test_least_determinant_of_many_random_starts():
    """Of a group with a cluster of outliers, against 300 random starts with
    exact subsets."""
    for seed in range(3):
        rng = np.random.default_rng(seed)
        x = rng.normal(0, 1, (400, P)) @ rng.normal(0, 0.3, (P, P))
        x[:80] = rng.normal(0, 0.05, (80, P)) + 2
        need, best, near = 300, np.inf, None
        for _ in range(300):
            at = rng.choice(400, P + 1, replace=False)
            for _ in range(12):
                mean, inv = x[at].mean(axis=0), np.linalg.inv(np.cov(x[at].T, bias=True) + np.diag(FLOOR**2))
                at = np.argsort(np.einsum("ij,jk,ik->i", x - mean, inv, x - mean))[:need]
            if determinant(x[at]) < best:
                best, near = determinant(x[at]), x[at]
        mean, inv, det, _ = estimate(x)
        assert det < best + 0.02 and np.abs(mean - near.mean(axis=0)).max() < 0.05


def sound(rng, n=120):
    words = ["the", "river", "Mountain", "runs", "slowly", "toward", "every", "valley", "in", "summer", "and", "people", "walk", "there", "often", "with", "their", "old", "friends"]
    return " ".join(rng.choice(words) + str(rng.randrange(40)) * (rng.random() < 0.02) + "." * (rng.random() < 0.1) for _ in range(n))


def corpus(n=150):
    rng = random.Random(1)
    rows = []
    for g, (lang, source) in enumerate([("en", "web"), ("de", "web"), (None, None)]):
        rows += [(1000 * g + i, sound(rng, rng.randrange(60, 200)), lang, source, 1) for i in range(n)]
    bad = ["#$%& {}<> " * 60, "AAAA BBBB CCCC! " * 60, "spam " * 200, "1 2 3 4 5 6 7 8 " * 30]
    return rows + [(9000 + i, t, "en", "web", 1) for i, t in enumerate(bad)]


def test_against_brute_force_and_planted_junk(spark):
    rows = corpus()
    out = {r.doc_id: r for r in Q.judge(frame(spark, rows)).collect()}
    for lang, source in (("en", "web"), ("de", "web"), (None, None)):
        mine = [r for r in rows if r[2:4] == (lang, source)]
        want = brute(matrix([r[1] for r in mine]))
        for r, d in zip(mine, want):
            assert abs(out[r[0]].distance - d) <= 1e-4 * max(1, d), (r[0], out[r[0]].distance, d)
    assert not any(out[9000 + i].keep for i in range(4))
    assert sum(r.keep for r in out.values()) / len(out) > 0.97


def test_small_groups_use_wider_estimates(spark):
    rng = random.Random(2)
    rows = corpus(90) + [(20_000 + i, sound(rng), "en", f"rare{i}", 1) for i in range(5)] + [(30_000, sound(rng), "xx", "one", 1)]
    out = {r.doc_id: r for r in Q.judge(frame(spark, rows)).collect()}
    assert len(out) == len(rows) and out[30_000].distance is not None and all(out[20_000 + i].keep for i in range(5))
    english = brute(matrix([r[1] for r in rows if r[2] == "en"]))
    at = [r[0] for r in rows if r[2] == "en"].index(20_000)
    assert abs(out[20_000].distance - english[at]) <= 1e-4 * max(1, english[at])
    every = brute(matrix([r[1] for r in rows]))
    assert abs(out[30_000].distance - every[-1]) <= 1e-4 * max(1, every[-1])


def test_awkward_rows(spark):
    rows = awkward(random.Random(5))
    out = Q.judge(frame(spark, rows, clash=True))
    found = out.collect()
    assert len(found) == len(rows) and out.columns == ["doc_id", "lang", "source", "words", "distance", "limit", "keep"]
    assert all((r.distance is None) == (r.words == 0) and not (r.keep and r.words == 0) for r in found)
    assert {r.doc_id for r in found if r.words == 0} == {3, 4, 5}
    assert Q.judge(frame(spark, rows).where("false")).count() == 0
    assert [r.keep for r in Q.judge(frame(spark, [(1, None, "en", "w", 1), (2, "", None, None, 1)])).collect()] == [False, False]


def test_chi_square_quantile():
    assert abs(Q.chi2_quantile(7, 0.05) - 14.0671) < 1e-3 and abs(Q.chi2_quantile(4, 0.01) - 13.2767) < 1e-3 and abs(Q.chi2_quantile(2, 0.5) - 1.386294) < 1e-5
