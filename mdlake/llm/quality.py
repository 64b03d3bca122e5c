"""Quality by robust multivariate outliers.

Each document is a vector of transformed statistics of its whole text. For each
language and source the minimum-covariance-determinant estimate of centre and
scatter is found by concentration steps over all its documents: the share ``h``
of the documents nearest to the centre (Mahalanobis) gives the next centre and
scatter. There are four starts, none of them random: medians with quartile
ranges, means with the covariance, and medians with the covariances of the
directions from them and of bounded deviations. Each start makes two steps; the
one of least determinant goes on until a step doesn't lower it by more than
``tolerance`` any more, however many steps that takes. The estimate of least
determinant counts. A document farther than the chi-square quantile is rejected.

A step is one pass: distances fall into logarithmic buckets (a sixteenth of a
doubling), moments are summed by group and bucket, and buckets are added from
the nearest on; the bucket in which the share h is reached counts by the part
that is needed. A group of fewer than ``least`` documents uses its language's
estimate, a language of fewer that of all documents: with seven statistics a
covariance from fewer vectors is little more than noise. ``floor`` is added to
the scatter's diagonal, so that a statistic that hardly varies doesn't make it
singular and trifles in it don't reject. Sound documents have heavier tails than
the normal distribution, so the default ``tail``, found on the provided tables,
is far below the share that is meant to go.
"""

from __future__ import annotations

import math
from typing import Any, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkernel as K
from .common import prepare, require, written

NAMES = ("word_length", "capitals", "symbols", "punctuation", "digits", "richness", "stutter")
P = len(NAMES)
PARAMS: dict[str, Any] = {
    "h": 0.75, "least": 60, "first_steps": 2, "tolerance": 1e-3, "tail": 1e-17, "weight": 30.0,
    "floor": (0.08, 0.15, 0.25, 0.15, 0.7, 0.02, 0.1),
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*|<>{}[]\\/@^~_=+`")] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b".,;:!?\"'()-")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[0xC0:] = True  # a character beyond ASCII counts by its first byte
_CHAR = np.ones(256, bool)
_CHAR[[9, 10, 11, 12, 13, 32]] = False
_CHAR[0x80:0xC0] = False


def statistics(s: K.Slice, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, number of words) of the documents of a slice. Rates are drawn
    towards usual values by ``weight`` words, so that short texts, whose rates
    scatter, don't stand out."""
    ws = K.words(s, folded=False)
    n = np.diff(ws.bounds).astype(float)
    docs = n.size

    def count(mask: np.ndarray) -> np.ndarray:
        cs = np.zeros(mask.size + 1, np.int64)
        np.cumsum(mask, out=cs[1:])
        return (cs[s.offs[1:]] - cs[s.offs[:-1]]).astype(float)

    chars, alpha = count(_CHAR[s.buf]), count(_ALPHA[s.buf])
    capital = _UPPER[s.buf]
    if s.buf.size > 1:
        capital[:-1] |= (s.buf[:-1] == 0xC3) & (s.buf[1:] <= 0x9E) & (s.buf[1:] >= 0x80)
    key = np.sort((ws.doc.astype(np.uint64) << np.uint64(43)) | (ws.hash >> np.uint64(21)))
    if key.size:
        key = key[np.append(True, key[1:] != key[:-1])]
    distinct = np.bincount((key >> np.uint64(43)).astype(np.int64), minlength=docs).astype(float)
    same = np.flatnonzero((ws.hash[1:] == ws.hash[:-1]) & (ws.doc[1:] == ws.doc[:-1]))
    stutter = np.bincount(ws.doc[1:][same], minlength=docs).astype(float)
    rate = lambda x, usual: (x + weight * usual) / (n + weight)
    x = np.stack(
        [
            np.log(rate(chars, 5.2)),
            np.arcsinh(20 * (count(capital) + weight * 0.1) / (alpha + weight * 5)),
            np.arcsinh(10 * rate(count(_SYMBOL[s.buf]), 0.0)),
            np.arcsinh(5 * rate(count(_PUNCT[s.buf]), 0.14)),
            np.arcsinh(5 * rate(count(_DIGIT[s.buf]), 0.003)),
            np.log(distinct + weight) / np.log(n + weight + 2),
            np.arcsinh(10 * rate(stutter, 0.005)),
        ],
        axis=1,
    )
    return np.round(x, 9), n


def vectors(docs: DataFrame, weight: float) -> DataFrame:
    """(doc_id, lang, source, x0..): null where a text has no words."""
    prepare(docs.sparkSession)
    schema = "doc_id long, lang string, source string, words long, " + ", ".join(f"x{i} double" for i in range(P))
    names = ["doc_id", "lang", "source", "words", *(f"x{i}" for i in range(P))]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for s in K.slices(batch.column("text")):
                x, n = statistics(s, weight)
                rows = batch.slice(s.first, n.size)
                none = n == 0
                yield pa.record_batch([*(rows.column(c) for c in ("doc_id", "lang", "source")), pa.array(n.astype(np.int64)), *(pa.array(x[:, i], mask=none) for i in range(P))], names=names)

    return require(docs, "doc_id", "text", "lang", "source").mapInArrow(run, schema)


def chi2_quantile(p: int, tail: float) -> float:
    """The value that a chi-square variable of p degrees exceeds with
    probability ``tail``."""

    def above(x: float) -> float:
        y = x / 2
        if p % 2:
            return math.erfc(math.sqrt(y)) + math.exp(-y) * sum(y ** (j - 0.5) / math.gamma(j + 0.5) for j in range(1, (p + 1) // 2))
        return math.exp(-y) * sum(y**j / math.factorial(j) for j in range(p // 2))

    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if above(mid) > tail else (lo, mid)
    return hi


_KEY = ["level", "lang", "source"]
_EST = "level int, lang string, source string, start int, n long, det double, half double, mean array<double>, inverse array<double>"


def _medians(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Medians and scales (from quartile ranges) of each group, from its
    histograms."""
    for batch in it:
        rows: list[list] = [[] for _ in range(5)]
        for key, hist in zip(zip(*(batch.column(c).to_pylist() for c in _KEY)), batch.column("hist").to_pylist()):
            mean, scale = np.zeros(P), np.zeros(P)
            for i in range(P):
                mine = sorted((h["b"], h["c"]) for h in hist if h["i"] == i)
                b, c = np.array([x[0] for x in mine]), np.cumsum([x[1] for x in mine])
                q = [b[np.searchsorted(c, share * c[-1])] / 256 + 1 / 512 for share in (0.25, 0.5, 0.75)]
                mean[i], scale[i] = q[1], (q[2] - q[0]) / 1.349
            for r, v in zip(rows, (*key, mean.tolist(), scale.tolist())):
                r.append(v)
        d = pa.list_(pa.float64())
        yield pa.record_batch([pa.array(r, t) for r, t in zip(rows, (pa.int32(), pa.string(), pa.string(), d, d))], names=[*_KEY, "mean", "scale"])


def _put(rows: list[list], key: tuple, start: int, n: int, mean: np.ndarray, cov: np.ndarray, floor: np.ndarray, half: float) -> None:
    cov = cov + np.diag(floor**2)
    for r, v in zip(rows, (*key, start, n, float(np.linalg.slogdet(cov)[1]), half, mean.tolist(), np.linalg.inv(cov).ravel().tolist())):
        r.append(v)


def _estimates(rows: list[list]) -> pa.RecordBatch:
    d = pa.list_(pa.float64())
    return pa.record_batch([pa.array(r, t) for r, t in zip(rows, (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), d, d))], names=[*_KEY, "start", "n", "det", "half", "mean", "inverse"])


def _square(m: np.ndarray) -> np.ndarray:
    """A symmetric matrix from its upper triangle."""
    out = np.zeros((P, P))
    out[np.triu_indices(P)] = m
    return out + np.triu(out, 1).T


def starts(n: int, mean: np.ndarray, scale: np.ndarray, plain: np.ndarray, ways: np.ndarray, bent: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(centre, scatter) of the four starts, from sums over deviations from the
    medians in units of ``scale``: of the deviations and their products, of the
    products of their directions, and of their hyperbolic tangents."""
    by = np.outer(scale, scale)
    shift, out = plain[:P] / n, [(mean, np.diag(scale**2))]
    out.append((mean + shift * scale, (_square(plain[P:]) / n - np.outer(shift, shift)) * by))
    out.append((mean, _square(ways) / n * P * by))
    return [*out, (mean, _square(bent) / n * by)]


def _begin(it: Iterator[pa.RecordBatch], floor: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in it:
        rows: list[list] = [[] for _ in range(9)]
        columns = [batch.column(c).to_pylist() for c in ("n", "mean", "scale", "plain", "ways", "bent")]
        for key, n, *of in zip(zip(*(batch.column(c).to_pylist() for c in _KEY)), *columns):
            for i, (mean, cov) in enumerate(starts(n, *(np.array(x) for x in of))):
                _put(rows, key, i, n, mean, cov, floor, float("nan"))
        yield _estimates(rows)


def nearest(parts: list[dict], h: float) -> tuple[int, float, np.ndarray, np.ndarray]:
    """(documents, median distance, shift of the centre, scatter) of the share h
    nearest to a centre, from the moments of the buckets."""
    parts = sorted(parts, key=lambda x: x["b"])
    n = np.cumsum([x["n"] for x in parts])
    need = math.ceil(h * n[-1])
    at = int(np.searchsorted(n, need))
    half = 2.0 ** ((parts[int(np.searchsorted(n, math.ceil(n[-1] / 2)))]["b"] + 0.5) / 16)
    part = (need - (n[at] - parts[at]["n"])) / parts[at]["n"]
    m = (sum((np.array(x["m"]) for x in parts[:at]), np.zeros(P + P * (P + 1) // 2)) + part * np.array(parts[at]["m"])) / need
    return int(n[-1]), half, m[:P], _square(m[P:]) - np.outer(m[:P], m[:P])


def _step(it: Iterator[pa.RecordBatch], h: float, floor: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The next estimate of each group and start."""
    for batch in it:
        rows: list[list] = [[] for _ in range(9)]
        for key, start, old, parts in zip(zip(*(batch.column(c).to_pylist() for c in _KEY)), *(batch.column(c).to_pylist() for c in ("start", "mean", "parts"))):
            n, half, shift, cov = nearest(parts, h)
            _put(rows, key, start, n, np.array(old) + shift, cov, floor, half)
        yield _estimates(rows)


def _distance() -> Any:
    x = [F.col(f"x{i}") - F.col("mean")[i] for i in range(P)]
    total = F.lit(0.0)
    for i in range(P):
        for j in range(i, P):
            total = total + (1 if i == j else 2) * x[i] * x[j] * F.col("inverse")[i * P + j]
    return F.greatest(total, F.lit(1e-12))


def _same(a: DataFrame, b: DataFrame) -> Any:
    cond = a["level"] == b["level"]
    for c in ("lang", "source"):
        cond = cond & a[c].eqNullSafe(b[c])
    return cond


def judge(docs: DataFrame, **params: Any) -> DataFrame:
    """(doc_id, lang, source, words, distance, limit, keep) of every document.

    ``distance`` is the squared Mahalanobis distance, scaled so that its median
    is the chi-square's; ``keep`` says that it is within the limit. A null or
    empty text, or one without words, has a null distance and isn't kept. Null
    languages and sources are groups of their own. Repeated rows are judged, and
    counted in the estimates, each, and so do ties: what is as far as the limit
    is kept. A text may be of any length. An empty table yields no rows. Other
    columns are ignored."""
    p = PARAMS | params
    floor = np.array(p["floor"])
    every = written(vectors(docs, p["weight"]), "statistics")
    rows = every.where("words > 0")
    # which level each language and source takes its estimate from
    sizes = rows.groupBy("lang", "source").count()
    by_lang = rows.groupBy("lang").count().select(F.col("lang").alias("l"), F.col("count").alias("of_lang"))
    place = sizes.join(by_lang, sizes["lang"].eqNullSafe(by_lang["l"])).select(
        "lang", "source", F.when(F.col("count") >= p["least"], 0).when(F.col("of_lang") >= p["least"], 1).otherwise(2).alias("level")
    )
    place = written(place, "levels")
    need = place.select("level", F.when(F.col("level") < 2, F.col("lang")).alias("lang"), F.when(F.col("level") == 0, F.col("source")).alias("source")).distinct()
    # every document counts at each level from which any group takes its estimate
    levels = [rows.select(F.lit(i).alias("level"), c1.alias("lang"), c2.alias("source"), *(f"x{k}" for k in range(P))) for i, c1, c2 in ((0, F.col("lang"), F.col("source")), (1, F.col("lang"), F.lit(None).cast("string")), (2, F.lit(None).cast("string"), F.lit(None).cast("string")))]
    used = [r[0] for r in place.select("level").distinct().collect()]
    data = None
    for i in sorted(used):
        data = levels[i] if data is None else data.unionByName(levels[i])
    if data is None:  # no document has any word
        return every.select("doc_id", "lang", "source", "words", F.lit(None).cast("double").alias("distance"), F.lit(None).cast("double").alias("limit"), F.lit(False).alias("keep"))
    data = data.join(need, _same(data, need), "left_semi")

    long = data.select(*_KEY, F.posexplode(F.array(*(F.floor(F.col(f"x{i}") * 256).cast("int") for i in range(P)))).alias("i", "b"))
    hist = long.groupBy(*_KEY, "i", "b").agg(F.count(F.lit(1)).alias("c")).groupBy(*_KEY).agg(F.collect_list(F.struct("i", "b", "c")).alias("hist"))
    middle = written(hist.mapInArrow(_medians, "level int, lang string, source string, mean array<double>, scale array<double>"), "medians")

    def met(one: DataFrame, *columns: str) -> DataFrame:
        """The vectors with columns of their groups' rows."""
        one = one.select(F.col("level").alias("lv"), F.col("lang").alias("la"), F.col("source").alias("so"), *columns)
        return data.join(one, (data["level"] == one["lv"]) & data["lang"].eqNullSafe(one["la"]) & data["source"].eqNullSafe(one["so"]))

    def sums(name: str) -> Any:
        return F.array(*(F.sum(F.col(f"{name}{i}") * F.col(f"{name}{j}")) for i in range(P) for j in range(i, P)))

    floors = [F.lit(float(x)) for x in floor]
    z = met(middle, "mean", "scale").select(*_KEY, "mean", "scale", *((F.col(f"x{i}") - F.col("mean")[i]).alias(f"e{i}") for i in range(P)))
    z = z.select(*_KEY, "mean", F.array(*(F.greatest(F.col("scale")[i], floors[i]) for i in range(P))).alias("scale"), *((F.col(f"e{i}") / F.greatest(F.col("scale")[i], floors[i])).alias(f"z{i}") for i in range(P)))
    size = F.sqrt(sum((F.col(f"z{i}") ** 2 for i in range(1, P)), F.col("z0") ** 2))
    z = z.select("*", F.greatest(size, F.lit(1e-9)).alias("size")).select("*", *((F.col(f"z{i}") / F.col("size")).alias(f"w{i}") for i in range(P)), *(F.tanh(f"z{i}").alias(f"t{i}") for i in range(P)))
    z = z.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"), F.first("mean").alias("mean"), F.first("scale").alias("scale"), F.concat(F.array(*(F.sum(f"z{i}") for i in range(P))), sums("z")).alias("plain"), sums("w").alias("ways"), sums("t").alias("bent"))
    now = written(z.mapInArrow(lambda it: _begin(it, floor), _EST), "estimates")
    moments = [F.sum(f"d{i}") for i in range(P)] + [F.sum(F.col(f"d{i}") * F.col(f"d{j}")) for i in range(P) for j in range(i, P)]

    def step(now: DataFrame) -> DataFrame:
        rows = met(now, "start", "mean", "inverse").select(*_KEY, "start", "mean", F.floor(F.log2(_distance()) * 16).cast("int").alias("b"), *((F.col(f"x{i}") - F.col("mean")[i]).alias(f"d{i}") for i in range(P)))
        part = rows.groupBy(*_KEY, "start", "b").agg(F.first("mean").alias("mean"), F.count(F.lit(1)).alias("n"), F.array(*moments).alias("m"))
        return part.groupBy(*_KEY, "start").agg(F.first("mean").alias("mean"), F.collect_list(F.struct("b", "n", "m")).alias("parts")).mapInArrow(lambda it: _step(it, p["h"], floor), _EST)

    for _ in range(p["first_steps"]):
        now = written(step(now), "estimates")
    now = written(now.groupBy(*_KEY).agg(F.min_by(F.struct(*now.columns), F.struct("det", "start")).alias("r")).select("r.*"), "estimates")
    final = None
    while True:  # the determinant falls by more than the tolerance with every round and can't fall below the floor's
        new = step(now)
        old = now.select(F.col("level").alias("lv"), F.col("lang").alias("la"), F.col("source").alias("so"), F.struct(*now.columns).alias("old"))
        both = new.select(*_KEY, F.struct(*new.columns).alias("new")).join(old, (F.col("level") == F.col("lv")) & F.col("lang").eqNullSafe(F.col("la")) & F.col("source").eqNullSafe(F.col("so")))
        both = written(both.select("new", "old", (F.col("old.det") - F.col("new.det") > p["tolerance"]).alias("moved")), "estimates")
        done = both.where("not moved").select(F.when(F.col("new.det") < F.col("old.det"), F.col("new")).otherwise(F.col("old")).alias("r")).select("r.*")
        final = done if final is None else final.unionByName(done)
        now = both.where("moved").select("new.*")
        if now.isEmpty():
            break
    # the medians of the distances from the settled estimate
    final = written(final, "estimates")
    last = step(final).select(F.col("level").alias("lv"), F.col("lang").alias("la"), F.col("source").alias("so"), "half")
    final = final.drop("half").join(last, (final["level"] == last["lv"]) & final["lang"].eqNullSafe(last["la"]) & final["source"].eqNullSafe(last["so"])).select(F.col("level").alias("at"), F.col("lang").alias("la"), F.col("source").alias("so"), "mean", "inverse", "half")
    final = written(final, "estimates")
    own = place.select(F.col("lang").alias("pl"), F.col("source").alias("ps"), "level")
    own = own.join(
        final, (own["level"] == final["at"]) & F.when(own["level"] < 2, own["pl"]).eqNullSafe(final["la"]) & F.when(own["level"] == 0, own["ps"]).eqNullSafe(final["so"])
    ).select("pl", "ps", "mean", "inverse", "half")
    median, limit = chi2_quantile(P, 0.5), chi2_quantile(P, p["tail"])
    every_met = every.join(own, every["lang"].eqNullSafe(own["pl"]) & every["source"].eqNullSafe(own["ps"]), "left")
    dist = F.when(F.col("words") > 0, F.round(_distance() * F.lit(median) / F.greatest(F.col("half"), F.lit(1e-9)), 6))
    return every_met.select("doc_id", "lang", "source", "words", dist.alias("distance")).select("*", F.lit(limit).alias("limit"), F.coalesce(F.col("distance") <= limit, F.lit(False)).alias("keep"))
