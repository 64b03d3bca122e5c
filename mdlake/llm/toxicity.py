"""Toxicity from the nearest labelled examples.

Documents and labelled examples are TF-IDF vectors over all words of the
examples. A word whose presence doesn't depend on the label (chi-square below
``strong_chi2``) weighs less by a factor, ``weak``. The words that no example
holds count as one word more, ``other``, of which a vector holds the number.
Both factors are chosen on the examples. Document frequencies are counted over
all documents. For every document with a word of any example the ``k`` examples
of greatest cosine are found exactly in a block-max inverted index: examples
that are alike lie in one block of ``BLOCK``; for each word and block the index
has the greatest weight that the word has in the block. These bound the cosines
of a block (for words that an eighth of the examples hold, and ``other``, it is
the block's greatest sum); a document's blocks are scored from the greatest
bound on, and those whose bound lies below its k-th cosine so far are skipped,
which loses nothing.
Votes weighted by distance give a score, which isotonic regression on the
examples themselves (each left out of its own neighbours) turns into a
probability.

Only the labelled sample is bounded: at most ``max_examples`` rows of each
class, those of least hash, and of these as many as have ``max_words`` different
words in all, again by least hash. Everything else covers all rows, words and
whole texts.
"""

from __future__ import annotations

from typing import Any, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import textkernel as K
from .common import Shipped, fetched, prepare, require, through, written

PARAMS: dict[str, Any] = {"k": 15, "max_examples": 3000, "max_words": 4_000_000, "min_chi2": 0.0, "strong_chi2": 10.0, "min_count": 3, "threshold": 0.5, "other": (0.0, 0.25, 0.5, 1.0), "weak": (0.05, 0.2, 1.0)}
#: Documents, and postings, whose cosines are computed at once.
BATCH_DOCS, BATCH_POSTINGS = 128, 2_000_000
#: Examples in a block of the index, and how many blocks a document has scored before bounds are looked at again.
BLOCK, WAVES = 64, (2, 12)

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("toxic", T.BooleanType()),
    T.StructField("evidence", T.ArrayType(T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("toxic", T.IntegerType()), T.StructField("cosine", T.DoubleType())]))),
    T.StructField("terms", T.ArrayType(T.StringType())),
])


def term_counts(s: K.Slice, vocab: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(document, word, count, first byte, last byte) of each distinct word of
    each document of a slice; the word as its index in ``vocab`` (others
    dropped), or as its hash. Then the number of words of each document."""
    w = K.words(s, folded=True)
    h, doc, at = w.hash, w.doc, np.arange(w.hash.size)
    if vocab is not None:
        if not vocab.size or not h.size:
            z = np.zeros(0, np.int64)
            return z, z, z, z, z, np.diff(w.bounds)
        # most words are in no vocabulary: a bitmap of 2^16 hash prefixes drops them cheaply
        seen = np.zeros(1 << 16, bool)
        seen[(vocab >> np.uint64(48)).astype(np.int64)] = True
        at = np.flatnonzero(seen[(h >> np.uint64(48)).astype(np.int64)])
        i = np.minimum(np.searchsorted(vocab, h[at]), vocab.size - 1)
        ok = vocab[i] == h[at]
        at, term = at[ok], i[ok]
        doc = doc[at]
    else:
        term = h
    order = np.lexsort((at, term, doc)) if vocab is None else np.argsort(doc * vocab.size + term, kind="stable")
    d, t, a = doc[order], term[order], at[order]
    new = np.ones(d.size, bool)
    new[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, d.size))
    a = a[first]
    return d[first], t[first], count, w.start[a], w.end[a], np.diff(w.bounds)


def _sample(labels: DataFrame, most: int) -> DataFrame:
    one = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    parts = [one.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for c in (0, 1)]
    return parts[0].unionByName(parts[1])


def _example_words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        ids, tox, th = (batch.column(c) for c in ("doc_id", "toxic", "th"))
        for s in K.slices(batch.column("text")):
            d, h, n, *_ = term_counts(s)
            cut = np.searchsorted(d, np.arange(s.offs.size))
            k = s.offs.size - 1
            offs = pa.array(cut.astype(np.int32))
            yield pa.record_batch(
                [ids.slice(s.first, k), tox.slice(s.first, k), th.slice(s.first, k), pa.ListArray.from_arrays(offs, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(offs, pa.array(n.astype(np.int32)))],
                names=["doc_id", "toxic", "th", "words", "counts"],
            )


def _chi2(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    n, tot = n1 + n0, a + b
    den = tot * (n - tot) * float(n1) * float(n0)
    return np.where(den > 0, n * (a * (n0 - b) - b * (n1 - a)) ** 2 / np.maximum(den, 1), 0)


def weight(n: np.ndarray | float) -> np.ndarray | float:
    """The weight of n occurrences; of none as of one, which keeps ``other``
    comparable among short texts."""
    return 1 + np.log(np.maximum(n, 1))


def _alike(x: np.ndarray) -> np.ndarray:
    """An order of the rows in which similar ones lie together: halves along
    the direction of the greatest variance, again and again."""
    out: list[np.ndarray] = []
    todo = [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if at.size <= BLOCK:
            out.append(at)
            continue
        y = x[at] - x[at].mean(axis=0)
        way = y[np.argmax((y * y).sum(axis=1))]
        for _ in range(6):
            way = y.T @ (y @ way)
            way = way / max(np.linalg.norm(way), 1e-300)
        at = at[np.argsort(y @ way, kind="stable")]
        half = -(-(at.size // 2) // BLOCK) * BLOCK
        todo += [at[half:], at[:half]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Model:
    """The fitted examples, small enough to go to every task: bounded by
    ``max_examples``, not by the data. ``min_chi2`` above 0 would leave words
    out of the vocabulary; by default it holds every word of the examples."""

    def __init__(self, ids: np.ndarray, y: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], prior: float, p: dict[str, Any]):
        self.p, self.prior = p, prior
        n1, n0 = int(y.sum()), int((y == 0).sum())
        words = np.concatenate([np.zeros(0, np.uint64), *(r[0] for r in rows)])
        label = np.repeat(y, [len(r[0]) for r in rows]) if rows else np.zeros(0, int)
        u, inv = np.unique(words, return_inverse=True)
        a = np.bincount(inv[label == 1], minlength=u.size).astype(float)
        b = np.bincount(inv[label == 0], minlength=u.size).astype(float)
        chi = _chi2(a, b, n1, n0)
        chi[a + b < p["min_count"]] = 0
        held = chi >= p["min_chi2"]
        self.vocab, self.strong, self.once = u[held], chi[held] >= p["strong_chi2"], (a + b)[held] == 1
        self.ids, self.y, self.rows, self.stamp = ids, y, rows, None

    def weigh(self, df: np.ndarray, total: int) -> Model:
        """Fits with each factor and keeps those whose scores of the examples,
        each left out of its own neighbours, have the least log loss."""
        size, n = self.vocab.size, len(self.rows)
        self.idf = np.log((1.0 + total) / (1.0 + df)) + 1.0
        row = np.repeat(np.arange(n), [len(h) for h, _ in self.rows]) if n else np.zeros(0, np.int64)
        hash = np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in self.rows)])
        count = np.concatenate([np.zeros(0), *(c for _, c in self.rows)])
        self.rows = []
        words = np.bincount(row, count, minlength=n)
        term = np.minimum(np.searchsorted(self.vocab, hash), max(size - 1, 0))
        ok = np.flatnonzero(self.vocab[term] == hash) if size else np.zeros(0, np.int64)
        row, term, count = row[ok], term[ok], count[ok]
        value = (1 + np.log(count)) * self.idf[term]
        order = self._order(row, term, value)
        self.ids, self.y, words, rank = self.ids[order], self.y[order], words[order], np.argsort(order)
        row = rank[row]
        order = np.argsort(row, kind="stable")
        row, term, count, value = row[order], term[order], count[order], value[order]
        self.share = max(int(self.y.sum()), 1) / max(len(self.y), 1)
        self.ones, self.zeros = max(int(self.y.sum()), 1), max(int((self.y == 0).sum()), 1)
        self.known = np.bincount(row, minlength=n) > 0  # examples that hold a word of the vocabulary
        self.bare_ones, self.bare_zeros = int(self.y[~self.known].sum()), int((self.y[~self.known] == 0).sum())
        self.full = words > 0
        rest = words - np.bincount(row, count, minlength=n)
        # As a document outside of the sample, an example would have its words that no other example holds in ``other``.
        own = self.once[term]
        alone = rest + np.bincount(row[own], count[own], minlength=n)
        self._index(row, term, value, weight(rest))
        self._choose(row, term, value, own, weight(alone))
        self._blocks()
        return self

    def _order(self, row: np.ndarray, term: np.ndarray, value: np.ndarray) -> np.ndarray:
        n, at = len(self.ids), np.bincount(term, minlength=self.vocab.size)
        often = np.argsort(-at, kind="stable")[:400]
        column = np.full(self.vocab.size, -1)
        column[often] = np.arange(often.size)
        x, ok = np.zeros((n, often.size)), column[term] >= 0
        x[row[ok], column[term[ok]]] = value[ok]
        return _alike(x / np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None])

    def _index(self, row: np.ndarray, term: np.ndarray, value: np.ndarray, length: np.ndarray) -> None:
        """Words by example: a matrix of those of many examples, postings of
        the others; ``length`` is the weight of ``other``."""
        size, n = self.vocab.size, len(self.ids)
        self.squares = np.stack([np.bincount(row[x], value[x] ** 2, minlength=n) for x in (self.strong[term], ~self.strong[term])])
        self.length = length
        order = np.lexsort((row, term))
        at = np.bincount(term, minlength=size)
        many = at > max(n / 8, 16)
        self.column = np.where(many, np.cumsum(many) - 1, -1)
        self.matrix = np.zeros((int(many.sum()), n))
        dense = many[term]
        self.matrix[self.column[term[dense]], row[dense]] = value[dense]
        order = order[~dense[order]]
        self.start = np.append(0, np.cumsum(np.where(many, 0, at)))
        self.post, self.value = row[order].astype(np.int32), value[order]
        # the words of each example, for evidence
        order = np.lexsort((term, row))
        self.held, self.held_start = term[order].astype(np.int32), np.append(0, np.cumsum(np.bincount(row, minlength=n)))

    def _dots(self, doc: np.ndarray, term: np.ndarray, q: np.ndarray, docs: int) -> np.ndarray:
        """Inner products of documents (0..docs-1) with all examples, without
        ``other``."""
        n = len(self.ids)
        col = self.column[term]
        d = col >= 0
        a = np.zeros((docs, self.matrix.shape[0]))
        a[doc[d], col[d]] = q[d]
        out = a @ self.matrix
        doc, term, q = doc[~d], term[~d], q[~d]
        size = self.start[term + 1] - self.start[term]
        at = np.repeat(self.start[term] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        out += np.bincount(np.repeat(doc * n, size) + self.post[at], np.repeat(q, size) * self.value[at], minlength=docs * n).reshape(docs, n)
        return out

    def _blocks(self) -> None:
        """The greatest weight of each word, scaled to the examples' norms, in
        each block of examples that holds it."""
        n = len(self.ids)
        first = np.arange(0, n, BLOCK)
        self.n_blocks, self.scored, self.bounded = first.size, 0, 0
        pad = self.n_blocks * BLOCK - n
        self.scaled = np.pad(self.matrix * self.scale, ((0, 0), (0, pad)))
        self.scaled_other = np.pad(self.other * self.length * self.scale, (0, pad))
        self.scaled_value = self.value * self.scale[self.post]
        self.matrix = self.value = None  # only fitting needs them
        term = np.repeat(np.arange(self.vocab.size), np.diff(self.start))
        block = self.post // BLOCK
        new = np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])) if term.size else np.zeros(0, bool)
        at = np.flatnonzero(new)
        self.entry = np.searchsorted(at, self.start)  # entries of each word
        self.entry_block, self.entry_at = block[at].astype(np.int32), np.append(at, term.size).astype(np.int32)
        self.within = (self.post % BLOCK).astype(np.uint8 if BLOCK <= 256 else np.int32)
        self.entry_most = np.maximum.reduceat(self.scaled_value, at) if at.size else np.zeros(0)

    def _top(self, cos: np.ndarray, most: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, cosine) of the ``most`` greatest of each line, ties by the
        examples' doc_id; -1 where there are fewer. ``least``: bounds below which
        none of them lies, where such are known."""
        n = cos.shape[1]
        rows, best = np.full((cos.shape[0], most), -1), np.zeros((cos.shape[0], most))
        if least is None:
            least = np.partition(cos, n - most, axis=1)[:, n - most] if n > most else np.zeros(cos.shape[0])
        line, x = np.nonzero(cos >= np.maximum(least - 2e-9, 1e-9)[:, None])
        c = np.round(cos[line, x], 9)
        order = np.lexsort((self.ids[x], -c, line))
        line, x, c = line[order], x[order], c[order]
        place = np.arange(line.size) - np.searchsorted(line, line)
        ok = place < most
        rows[line[ok], place[ok]], best[line[ok], place[ok]] = x[ok], c[ok]
        return rows, best

    def _batches(self, doc: np.ndarray, term: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of words, of whole documents, that are scored at once."""
        cut = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if doc.size else np.zeros(0, np.int64)
        ends = np.append(cut[1:], doc.size)
        cost = np.append(0, np.cumsum(self.start[term + 1] - self.start[term]))
        i = 0
        while i < cut.size:
            j = min(i + BATCH_DOCS, int(np.searchsorted(cost[ends], cost[cut[i]] + BATCH_POSTINGS, "right")))
            j = max(j, i + 1)
            yield int(cut[i]), int(ends[j - 1])
            i = j

    def neighbours(self, doc: np.ndarray, term: np.ndarray, count: np.ndarray, rest: np.ndarray, ids: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
        """(row, cosine) of the k nearest examples of each document (0..),
        greatest first, those of the same doc_id left out; -1 where there are
        fewer. ``rest`` counts a document's words outside of the vocabulary."""
        docs = len(ids)
        own = np.array([self.places.get(x, -1) for x in ids], np.int64)
        at = np.flatnonzero(self.once[term] & (own[doc] >= 0))
        at = at[self.post[self.start[term[at]]] == own[doc[at]]]  # words that no example but the document itself holds
        rest = rest + np.bincount(doc[at], count[at], minlength=docs)
        doc, term, count = (np.delete(x, at) for x in (doc, term, count))
        q = (1 + np.log(count)) * self.idf[term] * np.where(self.strong[term], 1.0, self.weak)
        length = self.other * weight(rest)
        norm = np.sqrt(np.bincount(doc, q * q, minlength=docs) + length**2)
        q = q * np.where(self.strong[term], 1.0, self.weak)  # the examples' values don't have the factor
        return self._search(doc, term, q, length, norm, own)

    def _search(self, doc: np.ndarray, term: np.ndarray, q: np.ndarray, length: np.ndarray, norm: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest by bounds, block after block."""
        docs, n, nb, k = norm.size, len(self.ids), self.n_blocks, self.p["k"]
        cos = np.zeros((docs, nb * BLOCK))
        if not nb:
            return self._top(cos, k)
        q = q / np.where(norm > 0, norm, 1)[doc]
        length = length / np.where(norm > 0, norm, 1)
        col = self.column[term]
        dense = col >= 0
        a = np.zeros((docs, self.scaled.shape[0]))
        a[doc[dense], col[dense]] = q[dense]
        doc, term, q = doc[~dense], term[~dense], q[~dense]
        size = self.entry[term + 1] - self.entry[term]
        e = np.repeat((self.entry[term] - (np.cumsum(size) - size)).astype(np.int32), size) + np.arange(int(size.sum()), dtype=np.int32)
        cell = np.repeat((doc * nb).astype(np.int32), size) + self.entry_block[e]
        share = np.repeat(q, size)
        common = a @ self.scaled
        common += np.outer(length, self.scaled_other)
        common = common.reshape(docs, nb, BLOCK)
        bound = np.bincount(cell, share * self.entry_most[e], minlength=docs * nb).reshape(docs, nb) + common.max(axis=2)
        todo = bound > 1e-9
        self.bounded += todo.size
        mark = np.full(docs * nb, -1, np.int32)

        def run(line: np.ndarray, block: np.ndarray) -> np.ndarray:
            """Cosines of the examples of some documents' blocks."""
            todo[line, block] = False
            self.scored += line.size
            mark[line * nb + block] = np.arange(line.size, dtype=np.int32)
            to = mark[cell]
            some = np.flatnonzero(to >= 0)
            mark[line * nb + block] = -1
            to, e_some = to[some], e[some]
            first = self.entry_at[e_some]
            m = self.entry_at[e_some + 1] - first
            at = np.repeat(first - (np.cumsum(m, dtype=np.int32) - m), m) + np.arange(int(m.sum()), dtype=np.int32)
            dots = np.bincount(np.repeat(to * BLOCK, m) + self.within[at], np.repeat(share[some], m) * self.scaled_value[at], minlength=line.size * BLOCK).reshape(-1, BLOCK)
            dots += common[line, block]
            hit = np.flatnonzero((own[line] >= 0) & (own[line] // BLOCK == block))
            dots[hit, own[line[hit]] % BLOCK] = 0
            cos.reshape(docs, nb, BLOCK)[line, block] = dots
            return dots

        seen, least = np.zeros((docs, 0)), np.zeros(docs)
        for wave in WAVES:
            if wave >= nb:
                break
            block = np.argpartition(np.where(todo, bound, -1.0), nb - wave, axis=1)[:, nb - wave :]
            line, place = np.nonzero(np.take_along_axis(todo, block, axis=1))
            found = np.zeros((docs, wave, BLOCK))
            found[line, place] = run(line, block[line, place])
            seen = np.concatenate([seen, found.reshape(docs, -1)], axis=1)
            if seen.shape[1] > k:
                seen = np.partition(seen, seen.shape[1] - k, axis=1)[:, -k:]
                least = seen.min(axis=1)
                todo &= bound >= np.maximum(least - 4e-9, 1e-9)[:, None]
        line, block = np.nonzero(todo)
        if line.size:
            run(line, block)
        return self._top(cos[:, :n], k, least)

    def vote(self, rows: np.ndarray, cos: np.ndarray) -> np.ndarray:
        """Share of toxic votes of each line; a neighbour counts by the inverse
        of its distance, and by how much the sample thins out its class. One
        vote of the prior keeps few far neighbours from deciding."""
        y = self.y[rows] if len(self.y) else np.zeros_like(rows)
        w = np.where(rows >= 0, 1.0 / (1.05 - np.minimum(cos, 1.0)), 0.0)
        w = w * np.where(y == 1, self.prior / self.share, (1 - self.prior) / max(1 - self.share, 1e-9))
        pseudo = 1.0
        return ((w * y).sum(axis=1) + self.prior * pseudo) / (w.sum(axis=1) + pseudo)

    def _factors(self, weak: float, other: float) -> None:
        self.weak, self.other = weak, other
        norm = np.sqrt(self.squares[0] + weak**2 * self.squares[1] + (other * self.length) ** 2)
        self.scale = np.where((norm > 0) & self.full, 1 / np.where(norm > 0, norm, 1), 0)

    def _choose(self, row: np.ndarray, term: np.ndarray, value: np.ndarray, own: np.ndarray, length: np.ndarray) -> None:
        n, grid = len(self.ids), [(w, o) for w in self.p["weak"] for o in self.p["other"]]
        self.places = {int(x): i for i, x in enumerate(self.ids)}
        votes = np.zeros((len(grid), n))
        scales = []
        for weak, other in grid:
            self._factors(weak, other)
            scales.append(self.scale)
        strong = self.strong[term]
        square = np.stack([np.bincount(row[x], value[x] ** 2, minlength=n) for x in (strong, ~strong & ~own)])
        for lo, hi in self._batches(row, term):
            first, docs = row[lo], int(row[hi - 1] - row[lo] + 1)
            part = [self._dots(row[lo:hi][x] - first, term[lo:hi][x], value[lo:hi][x], docs) for x in (strong[lo:hi], ~strong[lo:hi])]
            me = np.arange(first, first + docs)
            for g, (weak, other) in enumerate(grid):
                cos = part[0] + weak**2 * part[1] + np.outer(other**2 * length[me], self.length)
                norm = np.sqrt(square[0][me] + weak**2 * square[1][me] + (other * length[me]) ** 2)
                cos *= scales[g]
                cos /= np.where(norm > 0, norm, 1)[:, None]
                cos[me - first, me] = 0
                votes[g, me] = self.vote(*self._top(cos, self.p["k"]))
        best = None
        for g, (weak, other) in enumerate(grid):
            loss = self._calibrate(votes[g])
            if best is None or loss < best[0] - 1e-9:
                best = loss, g
        self.loss = best[0]
        self._factors(*grid[best[1]])
        self._calibrate(votes[best[1]])

    def _calibrate(self, votes: np.ndarray) -> float:
        """Isotonic regression of labels on votes; the examples' log loss."""
        w1, w0 = self.prior / self.ones, (1 - self.prior) / self.zeros
        z1, z0 = self.bare_ones * w1, self.bare_zeros * w0
        self.none = float(z1 / (z1 + z0)) if z1 + z0 > 0 else self.prior
        y, votes = self.y[self.known].astype(float), votes[self.known]
        pools: list[list[float]] = []  # [weight, weight of toxic, lowest vote, highest vote]
        level, at = np.unique(np.round(votes, 9), return_inverse=True)  # examples with equal votes are one point
        weight, toxic = (np.bincount(at, np.where(y > 0, w1, z), minlength=level.size) for z in (w0, 0.0))
        for v, w, t in zip(level, weight, toxic):
            pools.append([w, t, v, v])
            while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
                last = pools.pop()
                pools[-1][0] += last[0]
                pools[-1][1] += last[1]
                pools[-1][3] = last[3]
        self.steps = np.array([v for x in pools for v in x[2:]])
        self.level = np.array([x[1] / x[0] for x in pools for _ in (0, 1)])  # straight lines join the pools
        score = np.clip(self.probability(votes), 1e-3, 1 - 1e-3)
        return float(-(np.where(y > 0, w1 * np.log(score), w0 * np.log(1 - score))).sum())

    def probability(self, votes: np.ndarray) -> np.ndarray:
        if not self.steps.size:
            return np.full(votes.shape, self.prior)
        return np.interp(np.round(votes, 9), self.steps, self.level)

    def shared(self, term: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Which of the terms any of these examples holds."""
        if self.stamp is None:
            self.stamp, self.turn = np.zeros(self.vocab.size, np.int32), 0
        self.turn += 1
        self.stamp[np.concatenate([self.held[self.held_start[r] : self.held_start[r + 1]] for r in rows.tolist()])] = self.turn
        return self.stamp[term] == self.turn


def fit(docs: DataFrame, labels: DataFrame, **params: Any) -> Model:
    """Fits on labelled documents. Labels that are null or neither 0 nor 1, or
    of a null doc_id, don't count; of several labels of a doc_id the greatest
    does. Without any labelled document, or any document, nothing is toxic (the
    prior is 0)."""
    p = PARAMS | params
    spark = docs.sparkSession
    prepare(spark)
    docs = require(docs, "doc_id", "text")
    labels = require(labels, "doc_id", "toxic")
    chosen = F.broadcast(_sample(labels, p["max_examples"]))  # at most two times max_examples rows
    one = docs.where("text is not null").join(chosen, "doc_id").select("doc_id", "toxic", "text", F.xxhash64("text").alias("th"))
    found = one.mapInArrow(_example_words, "doc_id long, toxic int, th long, words array<long>, counts array<int>")
    # of the texts of one doc_id the one of least hash counts
    found = written(found.groupBy("doc_id").agg(F.min_by(F.struct("toxic", "words", "counts"), "th").alias("x")).select("doc_id", "x.*"), "examples")
    sizes = found.select("doc_id", F.size("words"), F.xxhash64("doc_id")).collect()  # at most two times max_examples rows
    ids, total = [], 0
    for doc, n, _ in sorted(sizes, key=lambda r: (r[2], r[0])):
        total += n
        if total > p["max_words"]:
            break
        ids.append(doc)
    rows = fetched(found).to_pandas()
    if len(ids) < len(sizes):
        rows = rows[rows["doc_id"].isin(ids)]
    rows = rows.sort_values("doc_id", ignore_index=True) if len(rows) else rows
    tally = {r[0]: r[1] for r in labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("toxic").cast("int")).count().collect()}
    prior = tally.get(1, 0) / max(sum(tally.values()), 1)
    feats = [(np.asarray(w, np.int64).view(np.uint64), np.asarray(c, float)) for w, c in zip(rows.get("words", []), rows.get("counts", []))]
    model = Model(rows["doc_id"].to_numpy(np.int64) if len(rows) else np.zeros(0, np.int64), rows["toxic"].to_numpy(np.int64) if len(rows) else np.zeros(0, np.int64), feats, prior, p)
    vocab = model.vocab

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(vocab.size, np.int64), 0
        for batch in it:
            n += batch.num_rows - batch.column("text").null_count
            for s in K.slices(batch.column("text")):
                df += np.bincount(term_counts(s, vocab)[1], minlength=vocab.size)
        yield pa.record_batch([pa.array(np.append(np.flatnonzero(df), -1)), pa.array(np.append(df[df > 0], n))], names=["term", "n"])

    df = np.zeros(vocab.size + 1, np.int64)  # the last one is the number of documents
    found = fetched(written(docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")), "frequencies"))
    df[found["term"].to_numpy()] = found["n"].to_numpy()
    del rows, feats, found
    pa.default_memory_pool().release_unused()
    return model.weigh(df[:-1], int(df[-1]))


def _scored(batch: pa.RecordBatch, model: Model, evidence: bool) -> Iterator[tuple]:
    """(row, probability, neighbours, cosines, words) of rows that hold any
    word of the examples."""
    ids = batch.column("doc_id")
    for s in K.slices(batch.column("text")):
        d, t, n, b, e, total = term_counts(s, model.vocab)
        raw = s.buf.tobytes() if evidence else b""
        rest = total - np.bincount(d, n, minlength=total.size)
        for lo, hi in model._batches(d, t):
            here, doc = np.unique(d[lo:hi], return_inverse=True)
            at = (s.first + here).tolist()
            rows, cos = model.neighbours(doc, t[lo:hi], n[lo:hi], rest[here], [ids[x].as_py() for x in at])
            prob = model.probability(model.vote(rows, cos))
            if not evidence:
                yield from ((x, p) for x, p, r in zip(at, prob, rows) if r[0] >= 0)
                continue
            cut = lo + np.searchsorted(doc, np.arange(here.size + 1))
            for i, x in enumerate(at):
                r = rows[i][rows[i] >= 0]
                if r.size:
                    w = cut[i] + np.flatnonzero(model.shared(t[cut[i] : cut[i + 1]], r))
                    yield x, prob[i], r, cos[i, : r.size], [raw[f:g].decode("utf-8", "replace") for f, g in zip(b[w].tolist(), e[w].tolist())]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: probability, verdict, the neighbours that voted
    and the words that they share. Of examples of equal cosine those of least
    doc_id count. A text may be of any length; an empty table yields no rows. A
    document without any word of the
    examples (also a null or empty text) has the rate of such examples as its
    score and no evidence. Repeated rows are scored each; a null ``doc_id``
    stays null. Other columns are ignored."""
    prepare(docs.sparkSession)
    shared = Shipped(docs.sparkSession, model, "toxicity-model")  # bounded by max_examples and max_words
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("toxic", pa.bool_()), ("evidence", pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))), ("terms", pa.list_(pa.string()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in it:
            n = batch.num_rows
            prob = np.full(n, m.none)
            near, cosines, size = [], [], np.zeros(n, np.int64)
            terms: list[list] = [[] for _ in range(n)]
            for row, p, r, c, w in _scored(batch, m, True):  # in order of rows
                prob[row], size[row], terms[row] = p, r.size, w
                near.append(r)
                cosines.append(c)
            r = np.concatenate([np.zeros(0, np.int64), *near])
            votes = pa.StructArray.from_arrays([pa.array(m.ids[r]), pa.array(m.y[r].astype(np.int32)), pa.array(np.round(np.concatenate([np.zeros(0), *cosines]), 6))], fields=list(schema.field("evidence").type.value_type))
            evidence = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), votes)
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.round(prob, 6)), pa.array(prob >= m.p["threshold"]), evidence.cast(schema.field("evidence").type), pa.array(terms, pa.list_(pa.string()))], schema=schema)

    return require(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, that aren't toxic by
    ``score``. Null and empty texts go by the rate of examples without words;
    repeated rows stay or go alike; an empty table stays empty."""
    prepare(docs.sparkSession)
    shared = Shipped(docs.sparkSession, model, "toxicity-model")  # bounded by max_examples and max_words

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in it:
            keep = np.full(batch.num_rows, m.none < m.p["threshold"])
            for row, p in _scored(batch, m, False):
                keep[row] = p < m.p["threshold"]
            yield batch.filter(pa.array(keep))

    return through(docs, run, "doc_id", "text")
