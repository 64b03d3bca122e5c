"""Benchmark decontamination by winnowing.

Texts are sequences of folded words. Documents and benchmark items keep the
least k-gram hash of every window of ``span - k + 1`` k-grams, so a shared run
of ``span`` words always has a common fingerprint. Fingerprints are joined, and
each hit is extended in both directions, word by word, to the maximal shared
run; runs of at least ``span`` words are reported.

The benchmark goes to every task while it has at most ``broadcast_limit``
words; a larger one is joined with the documents' fingerprints by a shuffle.
"""

from __future__ import annotations

from typing import Any, Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkernel as K
from .common import placed, prepare, require, through

PARAMS: dict[str, Any] = {"span": 12, "k": 6, "broadcast_limit": 4_000_000}

SPANS = "doc_id long, item_id long, start_word int, end_word int, item_start int, n_words int, coverage double"


class Items(NamedTuple):
    ids: pa.Array
    words: Prefix  # words of all items, one item after another
    item: np.ndarray  # the item of each word
    bounds: np.ndarray
    prints: np.ndarray  # sorted fingerprints, those with equal steps together
    at: np.ndarray  # the word at which each begins
    groups: np.ndarray  # sorted keys of fingerprint and step
    begin: np.ndarray  # where the fingerprints of each key begin
    end: np.ndarray


class Prefix(NamedTuple):
    """Hashes of the runs of words, for comparing runs of any length at once."""

    total: np.ndarray
    inverse: np.ndarray

    @classmethod
    def of(cls, h: np.ndarray) -> Prefix:
        total = np.zeros(h.size + 1, np.uint64)
        np.cumsum(h * K._power("r", K._R, h.size), out=total[1:])
        return cls(total, K._power("i", K._RINV, h.size + 1))

    def run(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (self.total[hi] - self.total[lo]) * self.inverse[lo]


def _steps(x: np.ndarray, h: np.ndarray, doc: np.ndarray, words: Prefix, head: int) -> np.ndarray:
    """For each fingerprint a hash of the words from the one before it with the
    same hash in the same text up to it; ``head`` where there is none."""
    order = np.lexsort((x, doc, h))
    a, b = order[:-1], order[1:]
    same = (h[a] == h[b]) & (doc[a] == doc[b])
    a, b = a[same], b[same]
    out = np.full(x.size, head, np.uint64)
    out[b] = K.mix(words.run(x[a], x[b]) + (x[b] - x[a]).astype(np.uint64)) | np.uint64(2)
    return out


def _key(h: np.ndarray, step: np.ndarray) -> np.ndarray:
    return K.mix(h ^ K.mix(step))


def index(ids: pa.Array, text: pa.Array, p: dict[str, Any]) -> Items:
    w = p["span"] - p["k"] + 1
    hashes, bounds, prints, at = [], [np.zeros(1, np.int64)], [], []
    base = 0
    for s in K.slices(text):
        ws = K.words(s, folded=True)
        x, h = K.winnow(ws, p["k"], w, s.offs.size - 1, thin=False)
        hashes.append(ws.hash)
        bounds.append(ws.bounds[1:] + base)
        prints.append(h)
        at.append(x + base)
        base += ws.hash.size
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    prints, at, bounds, words = cat(prints, np.uint64), cat(at, np.int64), np.concatenate(bounds), Prefix.of(cat(hashes, np.uint64))
    item = np.repeat(np.arange(bounds.size - 1), np.diff(bounds))
    step = _steps(at, prints, item[at], words, 1)
    order = np.lexsort((at, step, prints))
    prints, at, step = prints[order], at[order], step[order]
    begin = np.flatnonzero(np.append(True, (prints[1:] != prints[:-1]) | (step[1:] != step[:-1]))) if prints.size else np.zeros(0, np.int64)
    key, end = _key(prints[begin], step[begin]), np.append(begin[1:], prints.size)[: begin.size]
    order = np.argsort(key)
    return Items(ids, words, item, bounds, prints, at, key[order], begin[order], end[order])


def _agree(a: Prefix, x: np.ndarray, b: Prefix, y: np.ndarray, room: np.ndarray, back: bool) -> np.ndarray:
    """How many words, ``room`` at most, agree from x and y on, or before them:
    by doubling steps down, so the cost doesn't depend on the length."""
    far = np.zeros(x.size, np.int64)
    step = 1 << int(room.max(initial=0)).bit_length()
    while step := step // 2:
        at = np.flatnonzero(far + step <= room)
        lo, hi = (-far[at] - step, -far[at]) if back else (far[at], far[at] + step)
        ok = a.run(x[at] + lo, x[at] + hi) == b.run(y[at] + lo, y[at] + hi)
        far[at[ok]] += step
    return far


def matches(s: K.Slice, items: Items, p: dict[str, Any], bitmap: np.ndarray, pairs: int = 1 << 20) -> tuple[np.ndarray, ...]:
    """(document, item, first word, first word in the item, words) of each
    maximal shared run in a slice.

    A fingerprint of a document meets those of items that have the same hash,
    but for such as continue a run: where the same words lead from the same
    fingerprint before to either, that pair lies on the same run. So a text that
    repeats itself yields about as many pairs as it has runs."""
    ws = K.words(s, folded=True)
    x, h = K.winnow(ws, p["k"], p["span"] - p["k"] + 1, s.offs.size - 1, thin=False)
    ok = np.flatnonzero(bitmap[(h >> np.uint64(44)).astype(np.int64)])
    lo, hi = np.searchsorted(items.prints, h[ok]), np.searchsorted(items.prints, h[ok], "right")
    ok, lo, hi = ok[hi > lo], lo[hi > lo], hi[hi > lo]
    if not ok.size:
        return tuple(np.zeros((5, 0), np.int64))
    x, h = x[ok], h[ok]
    words = Prefix.of(ws.hash)
    key = _key(h, _steps(x, h, ws.doc[x], words, 0))
    g = np.minimum(np.searchsorted(items.groups, key), items.groups.size - 1)
    same = items.groups[g] == key
    first = np.where(same, items.begin[g], lo)  # partners from here to ``last`` continue a run
    last = np.where(same, items.end[g], lo)
    n = (first - lo) + (hi - last)
    total = np.append(0, np.cumsum(n))
    found, i = [], 0
    while i < x.size:
        j = max(i + 1, int(np.searchsorted(total, total[i] + pairs, "right")) - 1)
        m = n[i:j]
        own = np.repeat(np.arange(i, j), m)
        at = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        skip = at >= (first - lo)[own]
        u, v = x[own], items.at[np.where(skip, at + last[own] - (first - lo)[own], at + lo[own])]
        doc, item = ws.doc[u], items.item[v]
        left = _agree(words, u, items.words, v, np.minimum(u - ws.bounds[doc], v - items.bounds[item]), True)
        right = _agree(words, u, items.words, v, np.minimum(ws.bounds[doc + 1] - u, items.bounds[item + 1] - v), False)
        long = left + right >= p["span"]
        part = np.stack([c[long] for c in (doc, item, u - left - ws.bounds[doc], v - left - items.bounds[item], left + right)])
        found.append(np.unique(part, axis=1))
        i = j
    return tuple(np.unique(np.concatenate(found, axis=1), axis=1))


def _bitmap(items: Items) -> np.ndarray:
    seen = np.zeros(1 << 20, bool)
    seen[(items.prints >> np.uint64(44)).astype(np.int64)] = True
    return seen


def _spans(doc_ids: pa.Array, found: tuple[np.ndarray, ...], items: Items) -> pa.RecordBatch:
    doc, item, start, at, size = found
    total = np.diff(items.bounds)[item]
    i32 = lambda x: pa.array(x.astype(np.int32))
    return pa.record_batch(
        [doc_ids.take(pa.array(doc)), items.ids.take(pa.array(item)), i32(start), i32(start + size), i32(at), i32(size), pa.array(np.round(size / np.maximum(total, 1), 6))],
        names=["doc_id", "item_id", "start_word", "end_word", "item_start", "n_words", "coverage"],
    )


def _small(benchmark: DataFrame, p: dict[str, Any]) -> Items | None:
    """The benchmark as an index if it is within the limit."""
    words = benchmark.agg(F.sum(F.length("text") / 2)).first()[0] or 0  # no more words than half the characters
    if words > p["broadcast_limit"]:
        return None
    rows = benchmark.dropDuplicates(["item_id", "text"]).orderBy("item_id", "text").toArrow().combine_chunks()
    one = lambda c: rows.column(c).combine_chunks() if rows.num_rows else pa.array([], rows.schema.field(c).type)
    ids, text = one("item_id"), one("text")
    if isinstance(ids, pa.ChunkedArray):
        ids, text = pa.concat_arrays(ids.chunks), pa.concat_arrays(text.chunks)
    return index(ids.cast(pa.int64()), text, p)


def overlaps(docs: DataFrame, benchmark: DataFrame, **params: Any) -> DataFrame:
    """One row per document, item and maximal shared run of at least ``span``
    words: (doc_id, item_id, start_word, end_word, item_start, n_words,
    coverage: part of the item's words).

    Null or empty texts on either side share nothing; an item of fewer than
    ``span`` words can't reach the length and is never matched. Items with equal
    texts each match, but rows that repeat item_id and text are one item. Rows
    that repeat doc_id and text yield rows each. There are no ties: every
    maximal run is a row. Texts may be of any length, and repeat themselves: the
    cost follows the number of shared runs. An empty table of either kind yields
    no rows. Other columns are ignored."""
    p = PARAMS | params
    prepare(docs.sparkSession)
    docs, benchmark = require(docs, "doc_id", "text"), require(benchmark, "item_id", "text")
    items = _small(benchmark, p)
    if items is None:
        return _joined(docs, benchmark, p)
    shared = docs.sparkSession.sparkContext.broadcast((items, _bitmap(items)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, bitmap = shared.value
        for batch in it:
            for s in K.slices(batch.column("text")):
                yield _spans(batch.column("doc_id").slice(s.first), matches(s, items, p, bitmap), items)

    return docs.mapInArrow(run, SPANS)


def _prints(df: DataFrame, p: dict[str, Any], key: list[str]) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for s in K.slices(batch.column("text")):
                ws = K.words(s, folded=True)
                x, h = K.winnow(ws, p["k"], p["span"] - p["k"] + 1, s.offs.size - 1, thin=False)
                at = pa.array(ws.doc[x] + s.first)
                yield pa.record_batch([pa.array(h.view(np.int64)), *(batch.column(c).take(at) for c in key)], names=["h", *key])

    return df.mapInArrow(run, "h long, " + ", ".join(f"{c} long" for c in key)).distinct()


def _joined(docs: DataFrame, benchmark: DataFrame, p: dict[str, Any]) -> DataFrame:
    """For a benchmark that is too large for every task: fingerprints meet by a
    shuffle, then each candidate pair of texts is compared."""
    docs, items = (df.where("text is not null").withColumn(t, F.xxhash64("text")) for df, t in ((docs, "th"), (benchmark, "ith")))
    hits = _prints(docs, p, ["doc_id", "th"]).join(_prints(items, p, ["item_id", "ith"]), "h").select("doc_id", "th", "item_id", "ith").distinct()
    one = items.dropDuplicates(["item_id", "ith"]).select(F.col("item_id").alias("i"), F.col("ith").alias("it"), F.col("text").alias("item_text"))
    hits = hits.join(one, hits["item_id"].eqNullSafe(one["i"]) & (hits["ith"] == one["it"])).select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "item_id", "item_text")
    hits = hits.groupBy("d", "t").agg(F.collect_list(F.struct("item_id", "item_text")).alias("items"))
    met = docs.join(hits, docs["doc_id"].eqNullSafe(hits["d"]) & (docs["th"] == hits["t"])).select("doc_id", "text", "items")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            offs, values = batch.column("items").offsets.to_numpy(), batch.column("items").values
            for row in range(batch.num_rows):
                mine = values.slice(offs[row], offs[row + 1] - offs[row])
                found = index(mine.field("item_id").slice(offs[row], len(mine)) if len(mine.field("item_id")) != len(mine) else mine.field("item_id"), mine.field("item_text"), p)
                for s in K.slices(batch.column("text").slice(row, 1)):
                    yield _spans(batch.column("doc_id").slice(row, 1), matches(s, found, p, _bitmap(found)), found)

    return met.mapInArrow(run, SPANS)


def keep_clean(docs: DataFrame, benchmark: DataFrame, **params: Any) -> DataFrame:
    """The rows of ``docs``, with all their columns, that share no run of
    ``span`` words with any benchmark item. Null and empty texts stay; repeated
    rows stay or go alike; with an empty benchmark all stay. See ``overlaps``."""
    p = PARAMS | params
    prepare(docs.sparkSession)
    benchmark = require(benchmark, "item_id", "text")
    items = _small(benchmark, p)
    if items is None:
        hashed = F.xxhash64(F.coalesce("text", F.lit("")))
        bad = _joined(require(docs, "text").select(hashed.alias("doc_id"), "text"), benchmark, p).select(F.col("doc_id").alias("bad")).distinct()
        rows = placed(docs, "text")
        return rows.join(bad, hashed == F.col("bad"), "left_anti").toDF(*docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast((items, _bitmap(items)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, bitmap = shared.value
        for batch in it:
            keep = np.ones(batch.num_rows, bool)
            for s in K.slices(batch.column("text")):
                keep[matches(s, items, p, bitmap)[0] + s.first] = False
            yield batch.filter(pa.array(keep))

    return through(docs, run, "text")
