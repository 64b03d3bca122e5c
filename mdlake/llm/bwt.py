"""Burrows-Wheeler order and common prefixes of a collection of sequences,
built column by column.

All sequences are aligned at their right ends. Round j takes one symbol of
every sequence, the j-th from its end, and inserts the suffix that it begins
into the sorted order of all shorter suffixes. The order is held as three
columns in sorted order: for each suffix its first symbol with the rank of its
tail (which together are the transform's inverse mapping, so a new suffix finds
its place by its symbol and its tail's rank), its common prefix with the suffix
before it, and the place it comes from.

Columns are read and written from front to back only. A round reads the first
to find where new suffixes go, the second for the least common prefix between
the tails of suffixes that became neighbours, and then all three while it writes
the next ones. Columns of more than ``ram`` entries are files, read in pieces of
``ram`` entries; besides a piece, memory holds a few numbers for each sequence.
"""

from __future__ import annotations

import uuid
from typing import Any, Iterator

import numpy as np
from pyarrow import fs

_LOW = np.int64((1 << 32) - 1)
_B = 32


class Room:
    """Room for columns: files below ``folder`` (a path or URI of any file
    system) beyond ``ram`` entries, memory otherwise."""

    def __init__(self, folder: str | None = None, ram: int = 1 << 23):
        self.folder, self.ram = folder, ram if folder else 1 << 62

    def table(self, n: int, dtypes: tuple[Any, ...]) -> Table:
        return (Table if n <= self.ram else Files)(n, dtypes, self)


class Table:
    """Columns of n entries in memory, appended to and then read in pieces."""

    def __init__(self, n: int, dtypes: tuple[Any, ...], room: Room):
        self.n, self.at = n, 0
        self.columns = [np.empty(n, t) for t in dtypes]

    def append(self, *parts: np.ndarray) -> None:
        for column, part in zip(self.columns, parts):
            column[self.at : self.at + part.size] = part
        self.at += parts[0].size

    def pieces(self, *which: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        """(begin, end, columns) of the pieces in order; of an empty table one
        empty piece."""
        yield 0, self.n, [self.columns[i] for i in which]

    def drop(self) -> None:
        self.columns = []


class Files(Table):
    def __init__(self, n: int, dtypes: tuple[Any, ...], room: Room):
        self.n, self.ram, self.dtypes = n, room.ram, [np.dtype(t) for t in dtypes]
        self.files, base = fs.FileSystem.from_uri(room.folder) if "://" in room.folder else (fs.LocalFileSystem(), room.folder)
        self.files.create_dir(base, recursive=True)
        self.paths = [f"{base}/column-{uuid.uuid4().hex}" for _ in dtypes]
        self.streams = [self.files.open_output_stream(x) for x in self.paths]

    def append(self, *parts: np.ndarray) -> None:
        for stream, part, t in zip(self.streams, parts, self.dtypes):
            stream.write(np.ascontiguousarray(part, t))

    def pieces(self, *which: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        for s in self.streams:
            s.close()
        streams = [self.files.open_input_stream(self.paths[i]) for i in which]
        for a in range(0, self.n, self.ram):
            b = min(a + self.ram, self.n)
            yield a, b, [np.frombuffer(s.read((b - a) * self.dtypes[i].itemsize), self.dtypes[i]) for s, i in zip(streams, which)]
        for s in streams:
            s.close()

    def drop(self) -> None:
        for path in self.paths:
            self.files.delete_file(path)


class _RangeMin:
    """Least value of ranges of a column of integers."""

    def __init__(self, a: np.ndarray):
        n = a.size
        blocks = -(-n // _B)
        full = np.full(blocks * _B, np.iinfo(a.dtype).max, a.dtype)
        full[:n] = a
        full = full.reshape(blocks, _B)
        self.a = a
        self.front = np.minimum.accumulate(full, axis=1).ravel()
        self.back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [full.min(axis=1)]
        step = 1
        while 2 * step <= blocks:
            t = self.table[-1]
            self.table.append(np.minimum(t[:-step], t[step:]))
            step *= 2

    def query(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """min(a[lo..hi]), both included, lo <= hi."""
        out = self.a[lo]
        bl, bh = lo // _B, hi // _B
        far = np.flatnonzero(bl < bh)
        if far.size:
            r = np.minimum(self.back[lo[far]], self.front[hi[far]])
            gap = bh[far] - bl[far] - 1
            more = np.flatnonzero(gap > 0)
            if more.size:
                g, b = gap[more], bl[far][more] + 1
                level = np.frexp(g.astype(float))[1] - 1
                m = r[more]
                for k in np.unique(level):
                    x = np.flatnonzero(level == k)
                    t = self.table[k]
                    m[x] = np.minimum(m[x], np.minimum(t[b[x]], t[b[x] + g[x] - (1 << int(k))]))
                r[more] = m
            out[far] = r
        near = np.flatnonzero((bl == bh) & (lo < hi))
        at = lo[near]
        while near.size:
            at = at + 1
            out[near] = np.minimum(out[near], self.a[at])
            going = at < hi[near]
            near, at = near[going], at[going]
        return out


def _places(old: Table, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of the sorted new keys the index of the old one that it goes
    before, and the old keys on its left and right (-1 where there is none)."""
    at, left, right = np.full(key.size, old.n), np.full(key.size, -1), np.full(key.size, -1)
    done, last = 0, np.int64(-1)
    for a, _, (col,) in old.pieces(0):
        if not col.size:
            break
        j = int(np.searchsorted(key, col[-1]))
        x = np.searchsorted(col, key[done:j])
        at[done:j], right[done:j] = x + a, col[x]
        left[done:j] = np.where(x > 0, col[x - 1], last)
        done, last = j, col[-1]
    left[done:] = last
    return at, left, right


def _least(old: Table, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least common prefix in each range of old suffixes."""
    out: np.ndarray | None = None
    for a, b, (lcp,) in old.pieces(1):
        if out is None:
            out = np.full(lo.size, np.iinfo(lcp.dtype).max, lcp.dtype)
        met = np.flatnonzero((lo < b) & (hi >= a))
        if met.size:
            out[met] = np.minimum(out[met], _RangeMin(lcp).query(np.maximum(lo[met], a) - a, np.minimum(hi[met], b - 1) - a))
    return out


def build(symbols: np.ndarray, starts: np.ndarray, cap: int, room: Room | None = None) -> Table:
    """The columns (symbol and tail's rank, common prefix with the one before,
    at most ``cap``, sequence << 32 | offset) of every suffix in sorted order.

    ``symbols``: non-negative integers below 2^31, one sequence after another;
    ``starts``: index of the first symbol of each sequence, and the end.
    Sequences may be empty, equal, and of different length. A sequence's end
    sorts before every symbol; ends of equal suffixes sort by sequence.
    """
    room = room or Room()
    dtypes = (np.int64, np.uint8 if cap < 1 << 8 else np.uint16 if cap < 1 << 16 else np.uint32, np.int64)
    m = starts.size - 1
    length = np.diff(starts)
    rank = np.arange(m, dtype=np.int64)  # of each sequence's last suffix; ranks below m are the empty suffixes
    old = room.table(0, dtypes)
    for j in range(1, int(length.max(initial=0)) + 1):
        active = np.flatnonzero(length >= j)
        key = (symbols[starts[active + 1] - j].astype(np.int64) << 32) | rank[active]
        order = np.argsort(key)
        key, active = key[order], active[order]
        n, k = old.n, key.size
        at, left, right = _places(old, key)
        to = at + np.arange(k)
        together = np.append(False, at[1:] == at[:-1])  # the suffix on the left is new, too
        left[together] = key[np.flatnonzero(together) - 1]
        right[np.flatnonzero(together) - 1] = -1  # seen to as the left one
        u, v = np.concatenate([left, key]), np.concatenate([key, right])
        prefix = np.zeros(2 * k, dtypes[1])
        same = np.flatnonzero((u >> 32 == v >> 32) & (u >= 0) & (v >= 0))
        prefix[same] = 1
        q, p = (u[same] & _LOW) - m, (v[same] & _LOW) - m
        deep = np.flatnonzero(q >= 0)
        if deep.size:
            prefix[same[deep]] = np.minimum(_least(old, q[deep] + 1, p[deep]).astype(np.int64) + 1, cap)
        shift = None
        if n <= room.ram:  # how far each old rank moves, as a table while it is small
            shift = np.zeros(m + n + 1, np.int64)
            shift[m:] = np.cumsum(np.bincount(at, minlength=n + 1))
        moved = lambda x, s=shift, at=at: x + (s[x & _LOW] if s is not None else np.searchsorted(at, (x & _LOW) - m, "right"))
        new = room.table(n + k, dtypes)
        done = 0
        for a, b, (col, lcp, own) in old.pieces(0, 1, 2):
            end = k if b == n else int(np.searchsorted(at, b))
            here = to[done:end] - a - done
            size = (b - a) + (end - done)
            keep = np.ones(size, bool)
            keep[here] = False
            c, x, o = (np.empty(size, t) for t in dtypes)
            c[keep], x[keep], o[keep] = col, lcp, own
            c[here], x[here], o[here] = key[done:end], prefix[done:end], (active[done:end] << 32) | (length[active[done:end]] - j)
            behind = done + np.flatnonzero(right[done:end] >= 0)
            x[to[behind] + 1 - a - done] = prefix[k + behind]
            new.append(moved(c), x, o)
            done = end
        old.drop()
        old = new
        rank[active] = m + to
    return old
