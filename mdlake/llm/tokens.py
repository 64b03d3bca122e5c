"""Byte-level BPE over slices of documents, by a public vocabulary file.

A text may be cut where the pre-tokeniser's pattern always begins a piece:
before a single space and around a single line feed between characters that
aren't white space, and between a letter and one of ``,.;:!?``. Most of the
chunks so made repeat, so each distinct chunk is encoded once and remembered (up
to ``REMEMBER`` chunks a worker); the result is that of encoding the whole text.
"""

from __future__ import annotations

import base64

import numpy as np

from . import textkernel as K

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
REMEMBER = 1_200_000

_INK = np.zeros(256, bool)
_INK[33:127] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[list(b",.;:!?")] = True
_GAP = np.zeros(256, bool)
_GAP[[10, 32]] = True


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class Encoder:
    """Made once per task from the vocabulary that the driver read."""

    def __init__(self, vocabulary: dict[bytes, int]):
        import tiktoken

        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary, special_tokens={})
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for piece, i in vocabulary.items():
            self.size[i] = len(piece)
        self._forget()

    def _forget(self) -> None:
        self.key = np.zeros(0, np.uint64)
        self.check = np.zeros(0, np.uint64)
        self.first = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint16 if self.size.size <= 1 << 16 else np.uint32)

    def _chunks(self, s: K.Slice) -> tuple[np.ndarray, np.ndarray]:
        buf, n = s.buf, s.buf.size
        cut = np.zeros(n + 1, bool)
        if n > 2:
            lead = buf == 0xC3
            before = _INK[buf]
            before[1:] |= lead[:-1]
            after = _INK[buf] | lead
            alone = _GAP[buf[1:-1]] & before[:-2] & after[2:]
            cut[1 : n - 1] = alone
            cut[2:n] |= alone & (buf[1:-1] == 10)
            letter = _LETTER[buf]
            letter[1:] |= lead[:-1] & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
            cut[1:n] |= letter[:-1] & _STOP[buf[1:]]
        cut[s.offs] = True
        cut[n] = True
        at = np.flatnonzero(cut)
        return at[:-1], at[1:]

    def _learn(self, s: K.Slice, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, one chunk after another; number of ids of each)."""
        raw, dtype = s.buf.tobytes(), self.ids.dtype
        head = s.buf[start]
        size = np.zeros(start.size, np.int64)
        parts, order = [], []
        # chunks that begin with a space, or with a letter behind a line feed, are encoded in one go
        for kind, glue in ((head == 32, b""), (_LETTER[head], b"\n")):
            at = np.flatnonzero(kind & (end - start > (glue == b"")) & ~_GAP[s.buf[np.minimum(start + 1, s.buf.size - 1)]] & ~_GAP[s.buf[end - 1]])
            if not at.size:
                continue
            text = glue + glue.join([raw[b:e] for b, e in zip(start[at].tolist(), end[at].tolist())])
            ids = np.array(self.bpe.encode_ordinary(text.decode("utf-8", "replace")), dtype)
            stops = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum(end[at] - start[at] + len(glue))) + 1
            n = np.diff(stops, prepend=0)
            if glue:
                ids = np.delete(ids, stops - n)
                n = n - 1
            size[at] = n
            parts.append(ids)
            order.append(at)
        done = np.zeros(start.size, bool)
        for at in order:
            done[at] = True
        rest = np.flatnonzero(~done)
        for i in rest.tolist():
            ids = np.array(self.bpe.encode_ordinary(raw[start[i] : end[i]].decode("utf-8", "replace")), dtype)
            size[i] = ids.size
            parts.append(ids)
        seq = np.concatenate([*order, rest])
        joined = np.concatenate(parts)
        begin = np.zeros(start.size, np.int64)
        begin[seq] = np.cumsum(size[seq]) - size[seq]
        at = np.cumsum(size) - size
        return joined[np.repeat(begin - at, size) + np.arange(joined.size)], size

    def _lookup(self, s: K.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first chunk of each document, and the end; the place of each chunk
        in the memory; its number of ids)."""
        start, end = self._chunks(s)
        full = start < end
        start, end = start[full], end[full]
        h = K.span_hash(s.buf, start, end)
        key, first, inv = np.unique(h, return_index=True, return_inverse=True)
        check = K.span_hash(s.buf, start[first], end[first], seed=977)
        if self.key.size > REMEMBER:
            self._forget()
        i = np.minimum(np.searchsorted(self.key, key), max(self.key.size - 1, 0))
        known = (self.key[i] == key) & (self.check[i] == check) if self.key.size else np.zeros(key.size, bool)
        new = np.flatnonzero(~known)
        if new.size:
            ids, size = self._learn(s, start[first[new]], end[first[new]])
            stale = np.flatnonzero(np.isin(self.key, key[new])) if self.key.size else new[:0]  # another chunk with that hash
            have = np.diff(self.first)
            if stale.size:
                self.ids = self.ids[np.repeat(np.isin(np.arange(have.size), stale, invert=True), have)]
                self.key, self.check, have = (np.delete(x, stale) for x in (self.key, self.check, have))
                self.first = np.append(0, np.cumsum(have))
            at = np.searchsorted(self.key, key[new])
            self.ids = np.insert(self.ids, np.repeat(self.first[at], size), ids)
            self.first = np.append(0, np.cumsum(np.insert(have, at, size)))
            self.key, self.check = np.insert(self.key, at, key[new]), np.insert(self.check, at, check[new])
            i = np.searchsorted(self.key, key)
        at = i[inv]
        return np.searchsorted(start, s.offs), at, (self.first[at + 1] - self.first[at])

    def counts(self, s: K.Slice) -> np.ndarray:
        """Number of ids of each document of a slice."""
        bounds, _, n = self._lookup(s)
        total = np.append(0, np.cumsum(n))
        return total[bounds[1:]] - total[bounds[:-1]]

    def encode(self, s: K.Slice) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents of a slice; where each begins, and the end)."""
        bounds, at, n = self._lookup(s)
        total = np.append(0, np.cumsum(n))
        ids = self.ids[np.repeat(self.first[at] - total[:-1], n) + np.arange(total[-1])]
        return ids, total[bounds]


_encoder: dict[str, Encoder] = {}


def encoder(name: str, vocabulary: dict[bytes, int]) -> Encoder:
    """The worker's encoder, kept from task to task."""
    if name not in _encoder:
        _encoder.clear()
        _encoder[name] = Encoder(vocabulary)
    return _encoder[name]
