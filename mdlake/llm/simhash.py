"""Near-duplicate documents by SimHash and random bit sampling.

A document's fingerprint has 128 bits: each bit is the majority, over its
distinct folded words, of that bit of the word's hash. Equal fingerprints are
one point from then on. Each of ``tables`` hash tables groups the points by
``bits`` coordinates drawn at random (a fixed permutation per table). Within a
bucket all pairs at distance ``max_distance`` or less are found, as far as
connected components need them (see ``forest``), with no limit on partners.
Groups are the components over all tables; the least (doc_id, text hash) of a
group stays.

A pair at distance d meets in one table with probability (1 - d/128)^bits, so
with 32 tables of 13 bits in any of them with probability 0.999 at d = 15 and
0.94 at d = 22; distances of copies with some words changed are mostly 5 to 15.
So that buckets don't grow with the corpus, ``bits`` rises by one whenever the
number of points doubles beyond ``bucket`` times 2^bits, and so that recall
doesn't fall with it, ``tables`` rises to keep the probability at
``max_distance`` (``plan``): recall is the same at every size, and work a point
grows as the points to the power 0.27.

A bucket of more than ``cap`` points, as hardly any but a dense cluster makes
it, is split by the next ``more`` coordinates of its table's permutation, again
and again until it fits. Buckets are counted for that before they are shuffled,
so no task ever gets more than ``cap`` points of one. The pairs that a split
parts are looked for in further tables.
"""

from __future__ import annotations

import math
from typing import Any, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators import components
from . import textkernel as K
from .common import placed, prepare, require, written

PARAMS: dict[str, Any] = {"tables": 32, "bits": 13, "bucket": 400, "cap": 20_000, "more": 8, "max_distance": 22, "seed": 7}
WIDTH = 128
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def fingerprints_of(s: K.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(high, low, number of distinct words) of each document of a slice."""
    docs = s.offs.size - 1
    w = K.words(s, folded=True)
    key = np.sort((w.doc.astype(np.uint64) << np.uint64(43)) | (w.hash >> np.uint64(21)))
    if key.size:
        key = key[np.append(True, key[1:] != key[:-1])]
    doc = (key >> np.uint64(43)).astype(np.int64)
    h = key & np.uint64((1 << 43) - 1)
    cut = np.searchsorted(doc, np.arange(docs + 1))
    size = np.diff(cut)
    out = np.zeros((docs, 2), np.uint64)
    has = np.flatnonzero(size)
    if has.size:
        both = np.stack([K.mix(h), K.mix(h ^ np.uint64(0xA5A5A5A5DEADBEEF))], axis=1)
        # each byte becomes eight counters of a byte each in one integer; at most 255 words are added before they are widened
        lanes = _LANES[both.view(np.uint8)]
        part = np.concatenate([np.arange(b, e, 255) for b, e in zip(cut[:-1][has], cut[1:][has])])
        ones = np.add.reduceat(lanes, part, axis=0).view(np.uint8)
        ones = np.add.reduceat(ones, np.searchsorted(part, cut[:-1][has]), axis=0, dtype=np.int32)
        out[has] = np.packbits(2 * ones > size[has][:, None], axis=1).view(np.uint64)
    return out[:, 0], out[:, 1], size


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, th, hi, lo) of the documents that have a word; ``th`` is a hash
    of the text and tells documents of one doc_id apart."""
    prepare(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for s in K.slices(batch.column("text")):
                hi, lo, n = fingerprints_of(s)
                rows = batch.slice(s.first, n.size)
                yield pa.record_batch([rows.column("doc_id"), rows.column("th"), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64))], names=["doc_id", "th", "hi", "lo"]).filter(pa.array(n > 0))

    rows = require(docs, "doc_id", "text").where("text is not null").withColumn("th", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, th long, hi long, lo long").distinct()


def meets(distance: int, bits: int, tables: int) -> float:
    """The probability that a pair at a distance shares a bucket in any table."""
    return 1 - (1 - (1 - distance / WIDTH) ** bits) ** tables


def plan(points: int, p: dict[str, Any]) -> tuple[int, int]:
    """(bits, tables) for a number of points."""
    bits = max(p["bits"], math.ceil(math.log2(max(points, 1) / p["bucket"])))
    tables = p["tables"]
    while meets(p["max_distance"], bits, tables) < meets(p["max_distance"], p["bits"], p["tables"]):
        tables += 1
    return bits, tables


def permutations(seed: int, tables: range) -> np.ndarray:
    """The order in which each table samples the coordinates."""
    return np.stack([np.random.default_rng([seed, t]).permutation(WIDTH) for t in tables])


def sampled(hi: np.ndarray, lo: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The bits at the given places (0..127) packed into one integer a point."""
    out = np.zeros(hi.size, np.int64)
    for x in places:
        word = hi if x < 64 else lo
        out = (out << 1) | ((word >> np.uint64(x & 63)) & np.uint64(1)).astype(np.int64)
    return out


def _distance(hi: np.ndarray, lo: np.ndarray, a: Any, b: Any) -> np.ndarray:
    return np.bitwise_count(hi[a] ^ hi[b]) + np.bitwise_count(lo[a] ^ lo[b])


def _small(key: np.ndarray, hi: np.ndarray, lo: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (positions) with the same key and a distance of at most
    ``most``; rows are sorted by key. For many small buckets at once."""
    n = key.size
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if n else np.zeros(0, np.int64)
    end = np.append(start, n)[1:]  # none without rows, as where all buckets are large
    left = np.repeat(end, end - start) - np.arange(n) - 1  # partners that follow in the bucket
    found_a, found_b = [], []
    alive = np.flatnonzero(left > 0)
    step = 1
    while alive.size:
        other = alive + step
        ok = _distance(hi, lo, alive, other) <= most
        found_a.append(alive[ok])
        found_b.append(other[ok])
        step += 1
        alive = alive[left[alive] >= step]
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return cat(found_a), cat(found_b)


def forest(hi: np.ndarray, lo: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Pairs within the distance that connect the same components as all such
    pairs do.

    A pivot takes all points within the distance of it; they are one component
    and are done with. A point outside of that ball can have a neighbour in it
    only within twice the distance of the pivot, and needs one neighbour only.
    So a cluster costs about its size, not the square of it. Up to 2048 points
    all distances are computed at once, which suits points that are far apart."""
    if hi.size <= 2048:
        a, b = np.nonzero(np.triu(_distance(hi, lo, np.arange(hi.size)[:, None], np.arange(hi.size)[None, :]) <= most, 1))
        if a.size <= 4 * hi.size:
            return list(zip(a.tolist(), b.tolist()))
    edges: list[tuple[int, int]] = []
    left = np.arange(hi.size)
    while left.size:
        d = _distance(hi, lo, left, left[0])
        ball = left[d <= most]
        edges += [(int(ball[0]), int(x)) for x in ball[1:]]
        near = left[(d > most) & (d <= 2 * most)]
        for x in ball[1:] if near.size else ():
            ok = _distance(hi, lo, near, x) <= most
            if ok.any():
                edges += [(int(x), int(y)) for y in near[ok]]
                near = near[~ok]
                if not near.size:
                    break
        left = left[d > most]
    return edges


def buckets(points: DataFrame, bits: int, tables: range, p: dict[str, Any]) -> tuple[DataFrame, DataFrame | None]:
    """(t, key, hi, lo) of every point and table, in buckets of at most ``cap``
    points; then the points (hi, lo) whose bucket was split in any table, if
    there are such."""
    perms = permutations(p["seed"], tables)
    shape = "t int, key long, hi long, lo long"

    def batch_of(t: np.ndarray, key: np.ndarray, depth: int, hi: pa.Array, lo: pa.Array) -> pa.RecordBatch:
        return pa.record_batch([pa.array(t, pa.int32()), pa.array(K.mix(key.view(np.uint64) + np.uint64(depth)).view(np.int64)), hi, lo], names=["t", "key", "hi", "lo"])

    def begin(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            hi, lo = (batch.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo"))
            for i, t in enumerate(tables):
                yield batch_of(np.full(hi.size, t, np.int32), sampled(hi, lo, perms[i, :bits]), 0, batch.column("hi"), batch.column("lo"))

    def deeper(depth: int) -> Any:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                hi, lo = (batch.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo"))
                t, key = batch.column("t").to_numpy(), batch.column("key").to_numpy().copy()
                for x in np.unique(t):
                    at = np.flatnonzero(t == x)
                    key[at] += sampled(hi[at], lo[at], perms[x - tables.start, depth : depth + p["more"]])
                yield batch_of(t, key, depth, batch.column("hi"), batch.column("lo"))

        return run

    rows, depth, out, strained = points.select("hi", "lo").mapInArrow(begin, shape), bits, None, None
    while True:
        big = written(rows.groupBy("t", "key").count().where(F.col("count") > p["cap"]).select("t", "key"), "simhash-split") if depth < WIDTH else None
        if big is None or big.isEmpty():
            return rows if out is None else out.unionByName(rows), strained
        fit = rows.join(big, ["t", "key"], "left_anti").select("t", "key", "hi", "lo")
        out = fit if out is None else out.unionByName(fit)
        inside = written(rows.join(big, ["t", "key"], "left_semi").select("t", "key", "hi", "lo"), "simhash-inside")
        strained = inside.select("hi", "lo").distinct() if strained is None else strained
        rows, depth = inside.mapInArrow(deeper(depth), shape), depth + p["more"]


def edges(rows: DataFrame, p: dict[str, Any]) -> DataFrame:
    """(a_hi, a_lo, b_hi, b_lo): pairs of points within the distance, enough of
    them to connect every bucket's components."""

    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole(it):
            t, key = batch.column("t").to_numpy(), batch.column("key").to_numpy()
            hi, lo = (batch.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo"))
            bucket = np.cumsum(np.append(True, (t[1:] != t[:-1]) | (key[1:] != key[:-1]))) - 1
            size = np.bincount(bucket)
            few = np.flatnonzero(size[bucket] <= 64)
            x, y = _small(bucket[few], hi[few], lo[few], p["max_distance"])
            a, b = [few[x]], [few[y]]
            start = np.append(0, np.cumsum(size))
            for k in np.flatnonzero(size > 64).tolist():
                mine = slice(start[k], start[k + 1])
                found = np.array(forest(hi[mine], lo[mine], p["max_distance"]), np.int64).reshape(-1, 2) + start[k]
                a.append(found[:, 0])
                b.append(found[:, 1])
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.record_batch([pa.array(v.view(np.int64)) for v in (hi[a], lo[a], hi[b], lo[b])], names=["a_hi", "a_lo", "b_hi", "b_lo"])

    return rows.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(verify, "a_hi long, a_lo long, b_hi long, b_lo long")


def _whole(it: Iterator[pa.RecordBatch], least: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Batches of at least ``least`` rows that end where a bucket does."""
    held: list[pa.RecordBatch] = []
    rows, need = 0, least
    for batch in it:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < need:
            continue
        one = pa.concat_batches(held)
        t, k = (one.column(c).to_numpy() for c in ("t", "key"))
        other = np.flatnonzero((t != t[-1]) | (k != k[-1]))
        cut = int(other[-1]) + 1 if other.size else 0
        if cut:
            yield one.slice(0, cut)
            one = one.slice(cut)
        held, rows = [one], one.num_rows
        need = max(least, 2 * rows)
    if rows:
        yield pa.concat_batches(held)


def links(points: DataFrame, p: dict[str, Any]) -> DataFrame:
    """The pairs over all tables. Points whose bucket was split are searched in
    three times as many tables more; what splits part is so found by chance
    again, which isn't certain: recall of pairs within a cluster of more than
    ``cap`` distinct fingerprints that agree on all sampled bits isn't planned."""
    bits, tables = plan(points.count(), p)
    rows, strained = buckets(points, bits, range(tables), p)
    pairs = edges(rows, p)
    if strained is not None:
        pairs = pairs.unionByName(edges(buckets(strained, bits, range(tables, 4 * tables), p)[0], p))
    return pairs


def groups(docs: DataFrame, **params: Any) -> DataFrame:
    """(doc_id, th, group_id, group_size, keep) of every document with a word.

    ``group_id`` is the least doc_id of the group; ``keep`` marks the one that
    stays, the least (doc_id, th). A null doc_id sorts first and is a document
    like others. Rows that repeat doc_id and text are one document. Documents
    without words (null or empty text) are copies of none and aren't listed. A
    text may be of any length. An empty table yields no rows. Other columns are
    ignored."""
    p = PARAMS | params
    marks = written(fingerprints(docs), "simhash")
    points = written(marks.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "th")).alias("least")), "simhash-points")
    node = lambda x: F.struct(F.col(f"{x}hi").alias("hi"), F.col(f"{x}lo").alias("lo"))
    roots = components.connected(links(points, p).select(node("a_").alias("a"), node("b_").alias("b")), "a", "b").select("node.*", "root")
    named = points.join(roots, ["hi", "lo"], "left").withColumn("root", F.coalesce("root", node("")))
    whole = named.groupBy("root").agg(F.sum("n").alias("group_size"), F.min("least").alias("first"))
    named = named.select("hi", "lo", "root").join(whole, "root")
    key = F.struct("doc_id", "th")
    return marks.join(named, ["hi", "lo"]).select("doc_id", "th", F.col("first.doc_id").alias("group_id"), "group_size", key.eqNullSafe(F.col("first")).alias("keep"))


def near_duplicates(docs: DataFrame, **params: Any) -> DataFrame:
    """(doc_id, group_id, group_size, keep) of the documents that have a near
    copy; the rest stand alone. See ``groups``."""
    return groups(docs, **params).where("group_size > 1").select("doc_id", "group_id", "group_size", "keep")


def keep_one(docs: DataFrame, **params: Any) -> DataFrame:
    """The rows of ``docs`` without the further documents of each group, and
    without further rows that repeat doc_id and text; all columns stay, and so
    do documents without words (null or empty text). Of rows with one doc_id and
    text that differ elsewhere, the one whose other columns have the least hash
    stays. An empty table stays empty. See ``groups``."""
    null, some = F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("some_id")
    lose = groups(docs, **params).where("not keep").select(null, some, "th")
    rows = placed(docs, "doc_id", "text")
    rest = [c for c in rows.columns if c not in ("doc_id", "text")]
    order = F.xxhash64(F.lit(0), *(c for c, t in rows.dtypes if c in rest and "map<" not in t and "variant" not in t))
    # one shuffle of the texts serves the repeated rows and the join
    one = rows.groupBy(null, some, F.xxhash64("text").alias("th")).agg(F.min_by(F.struct(*rows.columns), order).alias("row"))
    return one.join(lose, ["no_id", "some_id", "th"], "left_anti").select("row.*").toDF(*docs.columns)
