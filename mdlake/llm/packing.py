"""Packing of documents into windows of a fixed number of tokens.

Each partition keeps ``open`` windows at most. A document (its tokens and an
end mark) goes into the open window that it fills best, the one with the least
room that still holds it; if none does, the fullest window is emitted and a new
one opened. A document longer than a window is first cut into whole windows,
which are emitted at once, and a rest. At the end, the windows still open in
``merge`` partitions at a time meet in one task and are joined by the same
rule, fullest first.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from typing import Any, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import textkernel as K
from . import tokens
from .common import prepare, require, written

PARAMS: dict[str, Any] = {"window": 2048, "open": 64, "merge": 64, "vocabulary": tokens.VOCABULARY}

_PIECES = "array<struct<doc_id:bigint,first_token:int,n_tokens:int>>"


class Packer:
    """Bounded-space best fit. Items are (size, payload)."""

    def __init__(self, window: int, most: int):
        self.window, self.most = window, most
        self.room: list[tuple[int, int]] = []  # (room left, number of the window), sorted
        self.held: dict[int, list[Any]] = {}
        self.made = 0

    def add(self, size: int, payload: Any) -> list[Any] | None:
        """Places one item of at most a window; the contents of a window that
        is emitted for it, if any."""
        out = None
        i = bisect_left(self.room, (size, -1))
        if i < len(self.room):
            left, w = self.room.pop(i)
            self.held[w].append(payload)
            left -= size
        else:
            if len(self.room) >= self.most:
                out = self.held.pop(self.room.pop(0)[1])
            w, left = self.made, self.window - size
            self.made += 1
            self.held[w] = [payload]
        if left == 0:
            full = self.held.pop(w)
            if out is None:
                return full
            self.held[w] = full  # at most one window leaves at a time; this one has no room and is next
        insort(self.room, (left, w))
        return out

    def rest(self) -> Iterator[tuple[int, list[Any]]]:
        for left, w in self.room:
            yield self.window - left, self.held[w]


def _batch(rows: list[tuple[int, bool, int, list[tuple[Any, int, int]]]]) -> pa.RecordBatch:
    piece = pa.struct([("doc_id", pa.int64()), ("first_token", pa.int32()), ("n_tokens", pa.int32())])
    offs = np.append(0, np.cumsum([len(r[3]) for r in rows])).astype(np.int32)
    flat = [x for r in rows for x in r[3]]
    values = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.int32()), pa.array([x[2] for x in flat], pa.int32())], fields=list(piece))
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.int32()), pa.ListArray.from_arrays(pa.array(offs), values)], names=["window_id", "open", "used", "pieces"])


def pack(docs: DataFrame, **params: Any) -> DataFrame:
    """(window_id, used, n_docs, doc_ids, pieces) of every window.

    ``pieces`` says which tokens of which documents a window holds, in order;
    ``first_token`` counts within the document, whose last token is the end
    mark. A window holds places, not ids: whoever reads it encodes the
    documents by the same vocabulary (``tokens.Encoder``) and takes those tokens.
    Every token of every document is in one window. Null and empty texts have
    nothing to pack and appear nowhere; a text longer than a window fills
    several. Of windows that are equally full the oldest is taken. Rows that
    repeat are packed each; a null doc_id stays null. An empty table yields no
    windows. Other columns are ignored."""
    p = PARAMS | params
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(tokens.ranks(p["vocabulary"]))
    window = p["window"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(p["vocabulary"], shared.value)
        packer = Packer(window, p["open"])
        base, made = TaskContext.get().partitionId() << 34, 0
        for batch in it:
            rows = []
            for s in K.slices(batch.column("text")):
                n = enc.counts(s)
                ids = batch.column("doc_id").slice(s.first, n.size).to_pylist()
                for doc, size in zip(ids, n.tolist()):
                    if not size:
                        continue
                    size, first = size + 1, 0
                    while size - first >= window:
                        rows.append((base + made, False, window, [(doc, first, window)]))
                        made, first = made + 1, first + window
                    if first < size:
                        out = packer.add(size - first, (doc, first, size - first))
                        if out is not None:
                            rows.append((base + made, False, sum(x[2] for x in out), out))
                            made += 1
            if rows:
                yield _batch(rows)
        rest = list(packer.rest())
        if rest:
            yield _batch([(base + made + i, True, used, pieces) for i, (used, pieces) in enumerate(rest)])

    schema = f"window_id long, open boolean, used int, pieces {_PIECES}"
    first = written(require(docs, "doc_id", "text").mapInArrow(run, schema), "windows")

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(it):
            packer = Packer(window, batch.num_rows)
            rows, ids = [], batch.column("window_id").to_pylist()
            for used, own, pieces in zip(batch.column("used").to_pylist(), ids, batch.column("pieces").to_pylist()):
                out = packer.add(used, (own, pieces))
                if out is not None:
                    rows.append(out)
            rows += [x for _, x in packer.rest()]
            flat = [(min(w for w, _ in x), [(y["doc_id"], y["first_token"], y["n_tokens"]) for _, ys in x for y in ys]) for x in rows]
            if flat:
                yield _batch([(own, False, sum(y[2] for y in ys), ys) for own, ys in flat])

    group = F.shiftright("window_id", 34)
    left = first.where("open").withColumn("grp", F.floor(group / p["merge"]))
    left = left.repartition("grp").sortWithinPartitions("grp", F.col("used").desc(), "window_id")
    every = first.where("not open").unionByName(left.mapInArrow(merge, schema))
    return every.select("window_id", "used", F.size("pieces").alias("n_docs"), F.transform("pieces", lambda x: x["doc_id"]).alias("doc_ids"), "pieces")


def _groups(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One batch for each value of ``grp``: ``merge`` times ``open`` rows at most."""
    held: list[pa.RecordBatch] = []
    for batch in it:
        g = batch.column("grp").to_numpy()
        cut = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if g.size else []
        for b, e in zip(cut, np.append(cut[1:], g.size)):
            if held and held[0].column("grp")[0] != batch.column("grp")[int(b)]:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(int(b), int(e - b)))
    if held:
        yield pa.concat_batches(held)
