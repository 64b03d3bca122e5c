"""Token ids in training order, as binary shards of fixed stride.

Within each input partition the token ids of the documents, each followed by an
end mark, form one stream, which is cut into sequences of ``length`` ids (only
the partition's last is padded, with end marks). Sequence i of n gets the slot
that a keyed Feistel permutation of [0, n) assigns to i; values that fall
outside of [0, n) walk the cycle until they fall inside. Slots are cut into
ranges of ``per_shard``; each range is one file's, in slot order, and a task
writes ``per_task`` consecutive ones, whatever the size of the corpus. So any
slot is at ``(slot % per_shard) * stride`` of file ``slot // per_shard`` and a
reader can stop and resume anywhere.

A file is written under another name and then renamed, so a task that is run
again, or twice at once, leaves the same whole file.
"""

from __future__ import annotations

import uuid
import zlib
from typing import Any, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import textkernel as K
from . import tokens
from .common import prepare, require, shared_dir

PARAMS: dict[str, Any] = {"length": 2048, "per_shard": 2048, "per_task": 8, "key": 0x5EED, "rounds": 6, "end": 50256, "vocabulary": tokens.VOCABULARY}


def _half_bits(n: int) -> int:
    return max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)


def slots(i: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """The slot of each index in [0, n): a bijection of [0, n)."""
    half = np.uint64(_half_bits(n))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = np.asarray(i).astype(np.uint64).copy()
    todo = np.arange(out.size)
    while todo.size:
        x = out[todo]
        left, right = x >> half, x & mask
        for r in range(rounds):
            left, right = right, left ^ (K.mix(right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xC2B2AE3D27D4EB4F) & (2**64 - 1))) & mask)
        x = (left << half) | right
        out[todo] = x
        todo = todo[x >= np.uint64(n)]
    return out.astype(np.int64)


def _sequences(it: Iterator[pa.RecordBatch], enc: tokens.Encoder, length: int, end: int) -> Iterator[tuple[np.ndarray, list[np.ndarray], pa.Array]]:
    """(ids of whole sequences, shape (m, length); for each the rows of its
    documents, counted from the first row of the partition)."""
    held, owner, row, ids = np.zeros(0, enc.ids.dtype), np.zeros(0, np.int64), 0, []
    for batch in it:
        for s in K.slices(batch.column("text")):
            flat, bounds = enc.encode(s)
            n = np.diff(bounds)
            has = np.flatnonzero(n)
            flat = np.insert(flat, bounds[1:][has], end)
            own = np.repeat(has, n[has] + 1)
            docs = batch.column("doc_id").slice(s.first, n.size)
            whole, who = np.concatenate([held, flat]), np.concatenate([owner, own + row])
            ids.append(docs)
            m = whole.size // length
            yield whole[: m * length].reshape(m, length), [np.unique(x) for x in who[: m * length].reshape(m, length)], pa.concat_arrays(ids)
            held, owner = whole[m * length :], who[m * length :]
            row += n.size
            least = int(owner[0]) if owner.size else row  # earlier rows are done with
            ids = [pa.concat_arrays(ids)[least - row + sum(len(x) for x in ids) :]]
            owner, row = owner - least, row - least
    if held.size:
        yield np.append(held, np.full(length - held.size, end, held.dtype))[None, :], [np.unique(owner)], pa.concat_arrays(ids)


class _Shards:
    """One file after another below a folder, each under its name only when it
    is whole."""

    def __init__(self, path: str):
        self.files, self.base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        self.files.create_dir(self.base, recursive=True)
        self.shard, self.stream, self.temp = -1, None, ""

    def _name(self, shard: int) -> str:
        return f"{self.base}/shard-{shard:08d}.bin"

    def write(self, shard: int, blob: Any) -> str:
        if shard != self.shard:
            self.close()
            self.shard, self.temp = shard, f"{self.base}/part-{shard:08d}-{uuid.uuid4().hex}"
            self.stream = self.files.open_output_stream(self.temp)
        self.stream.write(blob)
        return self._name(shard)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.files.move(self.temp, self._name(self.shard))
            self.stream = None

    def drop(self) -> None:
        """Removes a file that isn't whole, as a task that fails leaves it."""
        if self.stream is not None:
            self.stream.close()
            self.files.delete_file(self.temp)


def write(docs: DataFrame, path: str | None = None, **params: Any) -> DataFrame:
    """Writes the shards below ``path`` (by default a new folder in the shared
    one) and returns a row per sequence: (slot, shard, path, offset, stride,
    doc_ids, crc32). The files are written when the rows are computed.

    Null and empty texts have no tokens and are in no sequence. Rows that
    repeat are tokenised each. Null doc_ids stay null in ``doc_ids``. A text may
    be of any length. An empty table makes no file. Other columns are ignored. ``docs`` is read twice, to
    count and to write, and its partitions must hold the same rows both times, as
    those of a table in files do."""
    p = PARAMS | params
    spark = docs.sparkSession
    prepare(spark)
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    shared = spark.sparkContext.broadcast(tokens.ranks(p["vocabulary"]))
    docs = require(docs, "doc_id", "text")
    length, per = p["length"], p["per_shard"]

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, total = tokens.encoder(p["vocabulary"], shared.value), 0
        for batch in it:
            for s in K.slices(batch.column("text")):
                n = enc.counts(s)
                total += int(n.sum() + (n > 0).sum())
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()]), pa.array([-(-total // length)])], names=["part", "n"])

    sizes = {r[0]: r[1] for r in docs.mapInArrow(count, "part long, n long").collect()}  # two numbers a partition
    parts = sorted(sizes)
    begin = dict(zip(parts, np.append(0, np.cumsum([sizes[x] for x in parts])).tolist()))
    n = sum(sizes.values())
    shards = max(1, -(-n // per))

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(p["vocabulary"], shared.value)
        at = begin[TaskContext.get().partitionId()]
        for seq, rows, ids in _sequences(it, enc, length, p["end"]):
            if not len(seq):
                continue
            slot = slots(np.arange(at, at + len(seq)), n, p["key"], p["rounds"])
            at += len(seq)
            stride = length * seq.itemsize
            data = pa.Array.from_buffers(pa.binary(), len(seq), [None, pa.py_buffer((np.arange(len(seq) + 1) * stride).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(seq))])
            offs = np.append(0, np.cumsum([x.size for x in rows])).astype(np.int32)
            who = pa.ListArray.from_arrays(pa.array(offs), ids.take(pa.array(np.concatenate(rows))))
            yield pa.record_batch([pa.array(slot), pa.array(slot // per), who, data], names=["slot", "shard", "doc_ids", "data"])

    def store(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Shards(path)
        try:
            for batch in it:
                data, slot = batch.column("data"), batch.column("slot").to_numpy()
                crc, offset, names = [], [], []
                for i, shard in enumerate(batch.column("shard").to_pylist()):
                    blob = data[i].as_buffer()
                    names.append(out.write(shard, blob))
                    crc.append(zlib.crc32(blob))
                    offset.append(int(slot[i]) % per * blob.size)
                stride = len(data[0].as_buffer()) if batch.num_rows else 0
                yield pa.record_batch([batch.column("slot"), batch.column("shard"), pa.array(names, pa.string()), pa.array(offset, pa.int64()), pa.array([stride] * batch.num_rows, pa.int32()), batch.column("doc_ids"), pa.array(crc, pa.int64())], names=["slot", "shard", "path", "offset", "stride", "doc_ids", "crc32"])
            out.close()
        finally:
            out.drop()

    made = docs.mapInArrow(encode, "slot long, shard long, doc_ids array<long>, data binary")
    tasks = -(-shards // p["per_task"])
    return made.repartitionById(tasks, F.floor(F.col("shard") / p["per_task"]).cast("int")).sortWithinPartitions("slot").mapInArrow(store, "slot long, shard long, path string, offset long, stride int, doc_ids array<long>, crc32 long")


def read(path: str, slot: int, count: int, per_shard: int, stride: int, dtype: type = np.uint16) -> np.ndarray:
    """``count`` sequences from ``slot`` on, read sequentially."""
    target, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    out = []
    while count:
        at = slot % per_shard
        with target.open_input_file(f"{base}/shard-{slot // per_shard:08d}.bin") as f:
            f.seek(at * stride)
            blob = f.read(min(count, per_shard - at) * stride)
        got = len(blob) // stride
        if not got:
            break
        out.append(np.frombuffer(blob, dtype).reshape(got, -1))
        slot, count = slot + got, count - got
    return np.concatenate(out) if out else np.zeros((0, stride // np.dtype(dtype).itemsize), dtype)
