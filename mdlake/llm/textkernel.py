"""Vectorised word scanning over Arrow string columns.

Everything here works on the raw UTF-8 bytes of a slice of documents (a few
megabytes at a time, so that a Python worker stays small whatever the length
of a text) and never loops over words in Python.

Two word classes exist:

* ``plain``  - maximal runs of bytes that are not ASCII white space, as they are;
* ``folded`` - maximal runs of ASCII letters, digits and non-ASCII bytes, with
  ASCII and Latin-1 capitals folded to lower case.

A null text has no words, like an empty one.
"""

from __future__ import annotations

from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa

SLICE = 2 << 20
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLAIN = ~_SPACE
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


class Slice(NamedTuple):
    """``rows``: index of the first document in the batch; ``offs`` has one
    entry more than there are documents."""

    first: int
    buf: np.ndarray
    offs: np.ndarray


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray  # index of the first word of each document, and the end


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE) -> Iterator[Slice]:
    """The documents of a string column in runs of about ``limit`` bytes; a
    longer document is a run of its own and stays whole."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n)
        yield Slice(i, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        i = j


def fold(buf: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the Latin-1 letters, byte by byte."""
    out = _LOWER[buf]
    if buf.size > 1 and buf.max() >= 128:
        m = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        out[1:][m] += 32
    return out


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or have.size < n:
        size = max(n, SLICE + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[name] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hash of each byte span, equal for equal bytes."""
    n = buf.size
    if not start.size:
        return np.zeros(0, np.uint64)
    cs = np.empty(n + 1, np.uint64)
    cs[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(seed)) * _power("r", _R, n), out=cs[1:])
    h = (cs[end] - cs[start]) * _power("i", _RINV, n + 1)[start]
    return mix(h + (end - start).astype(np.uint64))


def words(s: Slice, folded: bool = True) -> Words:
    """All words of a slice, in order."""
    table = _ALNUM if folded else _PLAIN
    buf, offs = s.buf, s.offs
    n = buf.size
    cls = table[buf]
    first = np.zeros(n + 1, bool)
    first[offs[:-1]] = True
    last = np.zeros(n + 1, bool)
    last[offs[1:]] = True
    head = cls.copy()
    head[1:] &= ~cls[:-1] | first[1:n]
    tail = cls.copy()
    tail[:-1] &= ~cls[1:] | last[1:n]
    start = np.flatnonzero(head)
    end = np.flatnonzero(tail) + 1
    h = span_hash(fold(buf) if folded else buf, start, end)
    bounds = np.searchsorted(start, offs)
    doc = np.repeat(np.arange(offs.size - 1), np.diff(bounds))
    return Words(start, end, doc, h, bounds)


def kgrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words; entry i starts at word i."""
    n = h.size - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out *= np.uint64(0x2545F4914F6CDD1D)
        out += h[i : i + n]
    return mix(out)


def window_min(g: np.ndarray, w: int) -> np.ndarray:
    """Position of the rightmost least value in every window of w values."""
    n = g.size - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best = g[:n].copy()
    at = np.arange(n)
    step = np.zeros(n, np.int64)
    for i in range(1, w):
        less = g[i : i + n] <= best
        np.copyto(best, g[i : i + n], where=less)
        np.copyto(step, i, where=less)
    return at + step


def _thin(pick: np.ndarray, g: np.ndarray, doc: np.ndarray, w: int) -> np.ndarray:
    """Where a text repeats itself, equal least values follow each other
    closely. Of such a run the first, the last and one in every half window
    stay, so that every window still holds one with its least value."""
    if pick.size < 3:
        return pick
    v, half = g[pick], max(w // 2, 1)
    new = np.ones(pick.size, bool)
    new[1:] = (v[1:] != v[:-1]) | (pick[1:] - pick[:-1] > half) | (doc[pick[1:]] != doc[pick[:-1]])
    last = np.append(new[1:], True)
    first = pick[np.flatnonzero(new)][np.cumsum(new) - 1]
    at = (pick - first) // half
    return pick[new | last | np.append(True, at[1:] != at[:-1])]


def winnow(ws: Words, k: int, w: int, docs: int, thin: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed fingerprints of every document: (word index, hash).

    Each window of ``w`` consecutive k-grams keeps its least hash, the
    rightmost of equals, so two documents that share ``w + k - 1`` words share
    a fingerprint at the same place of it, unless ``thin`` takes out some of
    those that follow each other closely where a text repeats itself. A document with at least k words
    but fewer than ``w + k - 1`` keeps its least k-gram.
    """
    g = kgrams(ws.hash, k)
    if not g.size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    pick = window_min(g, w)
    if pick.size:  # windows that cross from one document into the next don't count
        same = ws.doc[: pick.size] == ws.doc[w + k - 2 : w + k - 2 + pick.size]
        pick = pick[same]
        pick = np.unique(pick)
        pick = _thin(pick, g, ws.doc, w) if thin else pick
    size = np.diff(ws.bounds)
    short = np.flatnonzero((size >= k) & (size < w + k - 1))
    if short.size:
        extra = []
        for d in short:
            b, e = ws.bounds[d], ws.bounds[d + 1] - k + 1
            extra.append(e - 1 - int(np.argmin(g[b:e][::-1])))
        pick = np.sort(np.concatenate([pick, np.array(extra, np.int64)]))
    return pick, g[pick]
