"""Repeated passages: every run of at least ``words`` words that occurs before.

Words are runs without ASCII white space, compared as they are (by 64-bit hash).
Documents are ordered by doc_id (null first) and text hash. A window of
``words`` words is marked where an earlier document holds it, too; in the first
document that holds it, it stays. What a document repeats of itself only is
marked, but for its first occurrence, if ``within`` is true. Marked windows are
joined into passages, which can be cut out.

1. Winnowing gives every window at least one anchor, a k-gram that depends on
   the window's words alone, so equal windows share an anchor. Anchors that
   occur once are dropped after a shuffle of hashes.
2. Around each repeated anchor lies a segment that holds all its windows. Of
   equal segments of one anchor those of the first document are kept; those of
   others are marked whole.
3. The remaining segments meet by anchor, and ``bwt.build`` makes the sorted
   order of their suffixes with common prefixes, column by column. Neighbours
   with a common prefix of ``words`` words or more are equal windows.

A collection is all segments of some anchors, at least ``segments`` of them and
as many more as one anchor has. No task gets more of one anchor than ``hot``
occurrences: the windows around anchors that occur more often (a passage in a
third of all documents has such) are grouped by their own hashes, which partial
aggregation does before any shuffle, and give the same marks (``hot_windows``).
"""

from __future__ import annotations

from typing import Any, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import bwt
from . import textkernel as K
from .common import Shipped, placed, prepare, require, shared_dir, written

PARAMS: dict[str, Any] = {"words": 50, "k": 16, "segments": 10000, "within": False, "ram": 1 << 23, "hot": 1_000_000}

SPANS = "doc_id long, th long, start_word int, end_word int, first_doc_id long"


def _rows(docs: DataFrame) -> DataFrame:
    return require(docs, "doc_id", "text").where("text is not null").withColumn("th", F.xxhash64("text"))


def _take(batch: pa.RecordBatch, first: int, doc: np.ndarray) -> list[pa.Array]:
    at = pa.array(doc + first)
    return [batch.column("doc_id").take(at), batch.column("th").take(at)]


def _prefix(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    base = np.uint64(0xD6E8FEB86659FD93)
    power = np.full(h.size + 1, base, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    cs = np.zeros(h.size + 1, np.uint64)
    np.cumsum(h * power[: h.size], out=cs[1:])
    return cs, power


_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def anchors(rows: DataFrame, p: dict[str, Any]) -> DataFrame:
    """(h, seg, doc_id, th, span): each anchor with the hash of its segment and
    its place, first word << 20 | number of words."""
    words, k = p["words"], p["k"]
    w = words - k + 1

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for s in K.slices(batch.column("text")):
                ws = K.words(s, folded=False)
                at, h = K.winnow(ws, k, w, s.offs.size - 1)
                doc = ws.doc[at]
                long = ws.bounds[doc + 1] - ws.bounds[doc] >= words
                at, h, doc = at[long], h[long], doc[long]
                if not at.size:
                    continue
                lo = np.maximum(ws.bounds[doc], at - w + 1)
                hi = np.minimum(ws.bounds[doc + 1], at + words)
                cs, _ = _prefix(ws.hash)
                back = np.full(ws.hash.size + 1, _INVERSE, np.uint64)
                back[0] = 1
                np.multiply.accumulate(back, out=back)
                seg = K.mix((cs[hi] - cs[lo]) * back[lo] + (hi - lo).astype(np.uint64))
                span = ((lo - ws.bounds[doc]) << 20) | (hi - lo)
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(seg.view(np.int64)), *_take(batch, s.first, doc), pa.array(span)], names=["h", "seg", "doc_id", "th", "span"])

    return rows.mapInArrow(run, "h long, seg long, doc_id long, th long, span long")


def repeated(found: DataFrame, within: bool) -> DataFrame:
    """Of anchors that occur in more than one document: each segment's
    occurrences in the first document that has it, and every other one with that
    document's doc_id (``copy``). With ``within``, of anchors that occur more
    than once: the first occurrence of each segment, and every other one."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole(it, "h"):
            h, seg, th, span = (batch.column(c).to_numpy() for c in ("h", "seg", "th", "span"))
            doc = batch.column("doc_id")
            null = doc.is_null().to_numpy(zero_copy_only=False)
            ids = doc.fill_null(0).to_numpy()
            new_h = np.append(True, h[1:] != h[:-1])
            new_seg = new_h | np.append(True, seg[1:] != seg[:-1])
            new = new_seg | np.append(True, (ids[1:] != ids[:-1]) | (null[1:] != null[:-1]) | (th[1:] != th[:-1]) | (span[1:] != span[:-1]))
            group = np.cumsum(new_h) - 1
            first = np.flatnonzero(new_seg)[np.cumsum(new_seg) - 1]
            if within:
                often, copy = np.bincount(group[new])[group] > 1, ~new_seg
            else:
                other = lambda x: (ids != ids[x]) | (null != null[x]) | (th != th[x])
                start = np.flatnonzero(new_h)
                often, copy = np.logical_or.reduceat(other(start[group]), start)[group], other(first)
            keep = np.flatnonzero(new & often)
            yield pa.record_batch([*(batch.column(c).take(pa.array(keep)) for c in ("h", "doc_id", "th", "span")), pa.array(copy[keep]), doc.take(pa.array(first[keep]))], names=["h", "doc_id", "th", "span", "copy", "first_doc_id"])

    order = [F.col("h"), F.col("seg"), F.col("doc_id").asc_nulls_first(), F.col("th"), F.col("span")]
    return found.repartition("h").sortWithinPartitions(*order).mapInArrow(run, "h long, doc_id long, th long, span long, copy boolean, first_doc_id long")


def whole(it: Iterator[pa.RecordBatch], key: str, least: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Batches of at least ``least`` rows, cut where ``key`` changes."""
    held: list[pa.RecordBatch] = []
    rows = 0
    need = least
    for batch in it:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < need:
            continue
        one = pa.concat_batches(held)
        k = one.column(key).to_numpy()
        cut = int(np.flatnonzero(k != k[-1])[-1]) + 1 if (k != k[-1]).any() else 0
        if cut:
            yield one.slice(0, cut)
            one = one.slice(cut)
        held, rows = [one], one.num_rows
        need = max(least, 2 * rows)  # a key of very many rows isn't joined again with each batch
    if rows:
        yield pa.concat_batches(held)


def segments(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """(h, doc_id, th, start, words): the text of each segment."""
    places = firsts.groupBy("doc_id", "th").agg(F.collect_list(F.struct("h", "span")).alias("at")).select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "at")
    met = rows.join(places, rows["doc_id"].eqNullSafe(places["d"]) & (rows["th"] == places["t"])).select("doc_id", "th", "text", "at")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            at = batch.column("at")
            offs = at.offsets.to_numpy()
            every_h = at.values.field("h").to_numpy()
            every_span = at.values.field("span").to_numpy()
            for s in K.slices(batch.column("text")):
                ws = K.words(s, folded=False)
                n = s.offs.size - 1
                o = offs[s.first : s.first + n + 1]
                doc = np.repeat(np.arange(n), np.diff(o))
                span = every_span[o[0] : o[-1]]
                start, size = span >> 20, span & ((1 << 20) - 1)
                lo = ws.bounds[doc] + start
                b, e = ws.start[lo], ws.end[lo + size - 1]
                raw = s.buf.tobytes()
                for i in range(0, lo.size, 4000):
                    j = slice(i, i + 4000)
                    text = [raw[x:y] for x, y in zip(b[j].tolist(), e[j].tolist())]
                    yield pa.record_batch([pa.array(every_h[o[0] : o[-1]][j]), *_take(batch, s.first, doc[j]), pa.array(start[j]), pa.array(text, pa.binary()).cast(pa.string())], names=["h", "doc_id", "th", "start", "words"])

    return met.mapInArrow(run, "h long, doc_id long, th long, start long, words string")


def _groups(order: bwt.Table, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, number of its group) of the suffixes whose first ``words`` words
    another suffix shares."""
    kept, number, count = [], [], 0
    before: np.ndarray | None = None  # the last suffix so far, while it isn't kept
    for _, _, (lcp, own) in order.pieces(1, 2):
        if not own.size:
            break
        like = lcp >= words  # the one before
        keep = like | np.append(like[1:], False)
        if before is not None and like[0]:
            kept.append(before)
            number.append(np.array([count]))
        g = np.cumsum(~like) + count
        kept.append(own[keep])
        number.append(g[keep])
        count = int(g[-1])
        before = None if keep[-1] else own[-1:].copy()
    order.drop()
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return cat(kept), cat(number)


def marked(segs: DataFrame, p: dict[str, Any], folder: str | None) -> DataFrame:
    """The windows of segments that occur before, joined where they overlap."""
    words = p["words"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = bwt.Room(folder, p["ram"])
        for batch in whole(it, "h", p["segments"]):
            sym, starts = [], [0]
            for s in K.slices(batch.column("words")):
                ws = K.words(s, folded=False)
                sym.append(ws.hash)
                starts.extend((ws.bounds[1:] + starts[-1]).tolist())
            sym = np.unique(np.concatenate(sym), return_inverse=True)[1]
            starts = np.array(starts)
            own, g = _groups(bwt.build(sym, starts, words, room), words)
            if not own.size:
                continue
            seq, off = own >> 32, own & ((1 << 32) - 1)
            doc = batch.column("doc_id")
            null = doc.is_null().to_numpy(zero_copy_only=False)
            ids, th = doc.fill_null(0).to_numpy(), batch.column("th").to_numpy()
            order = np.lexsort((th, ids, ~null))
            new = np.append(True, (ids[order][1:] != ids[order][:-1]) | (null[order][1:] != null[order][:-1]) | (th[order][1:] != th[order][:-1]))
            rank = np.empty(order.size, np.int64)
            rank[order] = np.cumsum(new) - 1
            owner = order[np.flatnonzero(new)]  # a row of each document
            place = (rank[seq] << 40) | (batch.column("start").to_numpy()[seq] + off)
            cut = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            first = np.repeat(np.minimum.reduceat(place, cut), np.diff(np.append(cut, g.size)))
            dup = place != first if p["within"] else place >> 40 != first >> 40
            place, first = place[dup], first[dup]
            if not place.size:
                continue
            place, pick = np.unique(place, return_index=True)
            first = first[pick]
            head = np.append(True, place[1:] - place[:-1] > words)  # documents are far apart in this numbering
            b = np.flatnonzero(head)
            e = np.append(b[1:], place.size) - 1
            low = (1 << 40) - 1
            own = pa.array(owner[place[b] >> 40])
            yield pa.record_batch([doc.take(own), batch.column("th").take(own), pa.array((place[b] & low).astype(np.int32)), pa.array(((place[e] & low) + words).astype(np.int32)), doc.take(pa.array(owner[first[b] >> 40]))], names=["doc_id", "th", "start_word", "end_word", "first_doc_id"])

    return segs.repartition("h").sortWithinPartitions("h").mapInArrow(run, SPANS)


def hot_windows(rows: DataFrame, hot: Any, p: dict[str, Any]) -> DataFrame:
    """Marked windows, each a span of its own, of those that hold one of the
    anchors ``hot``: the first document, or place, of each window is found by a
    least value over its hash."""
    words, k = p["words"], p["k"]
    w = words - k + 1

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = hot.value
        for batch in it:
            for s in K.slices(batch.column("text")):
                ws = K.words(s, folded=False)
                at, h = K.winnow(ws, k, w, s.offs.size - 1)
                at = at[np.isin(h, some)]
                if not at.size:
                    continue
                doc = ws.doc[at]
                lo = np.maximum(ws.bounds[doc], at - w + 1)
                n = np.minimum(ws.bounds[doc + 1] - words, at) - lo + 1  # windows that hold the anchor
                lo, n = lo[n > 0], n[n > 0]
                start = np.unique(np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum())))
                cs, _ = _prefix(ws.hash)
                back = np.full(ws.hash.size + 1, _INVERSE, np.uint64)
                back[0] = 1
                np.multiply.accumulate(back, out=back)
                hashed = K.mix((cs[start + words] - cs[start]) * back[start])
                doc = ws.doc[start]
                for i in range(0, start.size, 1 << 18):
                    j = slice(i, i + (1 << 18))
                    yield pa.record_batch([pa.array(hashed[j].view(np.int64)), *_take(batch, s.first, doc[j]), pa.array((start[j] - ws.bounds[doc[j]]).astype(np.int32))], names=["wh", "doc_id", "th", "start_word"])

    each = written(rows.mapInArrow(run, "wh long, doc_id long, th long, start_word int").distinct(), "hot-windows")
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "th", *(["start_word"] if p["within"] else []))
    first = each.groupBy("wh").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("wh", "first")
    return each.join(first, "wh").where(place != F.col("first")).select("doc_id", "th", "start_word", (F.col("start_word") + words).alias("end_word"), F.col("first.doc_id").alias("first_doc_id"))


def united(spans: DataFrame) -> DataFrame:
    """Passages of a document that overlap or touch become one; it keeps the
    first_doc_id of its first part. A task gets whole documents."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole(it, "th"):
            doc, th = batch.column("doc_id"), batch.column("th").to_numpy()
            null, ids = doc.is_null().to_numpy(zero_copy_only=False), doc.fill_null(0).to_numpy()
            b, e = (batch.column(c).to_numpy().astype(np.int64) for c in ("start_word", "end_word"))
            base = (np.cumsum(np.append(False, (th[1:] != th[:-1]) | (ids[1:] != ids[:-1]) | (null[1:] != null[:-1]))) << 32).astype(np.int64)
            reach = np.maximum.accumulate(base + e)
            head = np.append(True, (base + b)[1:] > reach[:-1])
            at = np.flatnonzero(head)
            last = np.append(at[1:], b.size) - 1
            out = batch.take(pa.array(at))
            out = out.set_column(3, "end_word", pa.array((reach[last] - base[last]).astype(np.int32)))
            yield out

    order = [F.col("th"), F.col("doc_id").asc_nulls_first(), F.col("start_word"), F.col("end_word").desc(), F.col("first_doc_id").asc_nulls_first()]
    return spans.repartition("doc_id", "th").sortWithinPartitions(*order).mapInArrow(run, SPANS)


def repeats(docs: DataFrame, **params: Any) -> DataFrame:
    """(doc_id, th, start_word, end_word, first_doc_id) of every maximal
    passage all of whose windows an earlier document holds (or, with
    ``within``, which occur before in this or an earlier document).

    Null and empty texts and texts of fewer than ``words`` words have no
    windows; a text may be of any length. Rows that repeat doc_id and text are
    one document; documents of one doc_id with other texts are ordered by text
    hash, so there are no ties. A null doc_id comes first in the order. An empty
    table yields no rows. Other columns are ignored."""
    p = PARAMS | params
    spark = docs.sparkSession
    prepare(spark)
    rows = _rows(docs)
    folder = f"{shared_dir(spark)}/columns"
    every = written(anchors(rows, p), "anchors")
    often = every.groupBy("h").count().where(F.col("count") > p["hot"]).select("h")
    hot = sorted(r[0] for r in often.collect())  # at most one in ``hot`` of all anchors
    cold = every
    if hot:
        shared = Shipped(spark, np.array(hot, np.int64).view(np.uint64), "hot-anchors")
        cold = every.join(F.broadcast(spark.createDataFrame([(x,) for x in hot], "h long")), "h", "left_anti")
    found = written(repeated(cold, p["within"]), "anchors")
    copies = found.where("copy").select("doc_id", "th", F.expr("cast(span div 1048576 as int)").alias("start_word"), F.expr("cast((span div 1048576) + (span & 1048575) as int)").alias("end_word"), "first_doc_id")
    firsts = found.where("not copy")
    spans = copies.unionByName(marked(segments(rows, firsts), p, folder))
    return united(spans.unionByName(hot_windows(rows, shared, p)) if hot else spans)


def cut(docs: DataFrame, **params: Any) -> DataFrame:
    """``docs`` without the marked passages: what is left of a text keeps its
    white space, and ``n_chars``, where there is such a column, its new length.
    A document all of whose words are marked goes; all others stay, also those
    with null or empty texts. Repeated rows are cut alike. See ``repeats``."""
    spans = repeats(docs, **params)
    rows = placed(docs, "doc_id", "text", *(c for c in ("n_chars",) if c in docs.columns))
    names, schema = rows.columns, rows.schema
    spans = spans.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("spans")).select(F.col("doc_id").alias("span_id"), F.col("th").alias("span_th"), "spans")
    rows = rows.withColumn("th", F.xxhash64("text"))
    met = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("span_id")) & (F.col("th") == F.col("span_th")), "left").select(*names, "spans")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            text, spans = batch.column("text"), batch.column("spans")
            has = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
            out = batch.select(names)
            if has.size:
                new = text.to_pylist()
                keep = np.ones(batch.num_rows, bool)
                offs, b, e = spans.offsets.to_numpy(), spans.values.field("start_word").to_numpy(), spans.values.field("end_word").to_numpy()
                for i in has.tolist():
                    for s in K.slices(text.slice(i, 1)):
                        ws = K.words(s, folded=False)
                        n, raw, parts, at = ws.start.size, s.buf.tobytes(), [], 0
                        left = n
                        for x, y in zip(b[offs[i] : offs[i + 1]].tolist(), e[offs[i] : offs[i + 1]].tolist()):
                            parts.append(raw[at : ws.start[x]])
                            at = int(ws.start[y]) if y < n else len(raw)
                            left -= y - x
                        parts.append(raw[at:])
                        new[i] = b"".join(parts).decode("utf-8", "replace")
                        keep[i] = left > 0
                text = pa.array(new, pa.string())
                out = out.set_column(names.index("text"), "text", text)
                if "n_chars" in names:
                    size = pc.utf8_length(text).cast(out.schema.field("n_chars").type)
                    out = out.set_column(names.index("n_chars"), "n_chars", pc.if_else(pa.array(np.isin(np.arange(batch.num_rows), has)), size, batch.column("n_chars")))
                out = out.filter(pa.array(keep))
            yield out

    return met.mapInArrow(run, schema).toDF(*docs.columns)
