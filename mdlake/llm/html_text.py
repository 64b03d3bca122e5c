"""Main text of HTML pages from flat text blocks.

A page is cut into blocks of text at every tag that isn't inline. A block is
described by its number of words and its link density (share of words inside
links), and by the same two numbers of the block before and the block after
(zero at the ends). A decision tree, trained on the small labelled table below,
tells content from navigation, advertising and footers.
"""

from __future__ import annotations

import html
import re
from typing import Any, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import prepare, require

FEATURES = ("prev_words", "prev_links", "words", "links", "next_words", "next_links")

#: Words and link density of the block before, the block and the block after; 1 for content.
LABELLED = [
    # menus, breadcrumbs, tag lists, pagers
    (0, 0, 1, 1.0, 1, 1.0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0), (1, 1.0, 1, 1.0, 9, 0, 0), (1, 1.0, 2, 1.0, 1, 1.0, 0), (2, 1.0, 3, 1.0, 2, 1.0, 0), (0, 0, 4, 1.0, 12, 0, 0),
    (180, 0, 1, 1.0, 1, 1.0, 0), (95, 0.02, 6, 1.0, 5, 1.0, 0), (6, 1.0, 8, 1.0, 7, 0.9, 0), (4, 1.0, 3, 0.67, 2, 1.0, 0), (60, 0, 5, 0.8, 0, 0, 0), (3, 0.5, 12, 0.9, 4, 1.0, 0),
    (12, 0, 22, 0.8, 15, 0.7, 0), (40, 0.1, 30, 0.85, 12, 0.9, 0), (5, 1.0, 40, 0.7, 6, 1.0, 0), (1, 1.0, 1, 0, 1, 1.0, 0), (2, 1.0, 3, 0, 2, 1.0, 0), (5, 1.0, 6, 0.5, 3, 1.0, 0),
    # advertising and banners between a menu and the headline
    (1, 1.0, 7, 0, 8, 0, 0), (1, 1.0, 10, 0, 6, 0, 0), (1, 1.0, 13, 0, 10, 0, 0), (1, 1.0, 4, 0, 12, 0, 0), (2, 1.0, 9, 0, 5, 0, 0), (1, 1.0, 16, 0, 9, 0, 0), (3, 1.0, 11, 0.1, 7, 0, 0), (1, 1.0, 6, 0, 14, 0, 0),
    (1, 1.0, 12, 0, 3, 0, 0), (1, 1.0, 18, 0, 11, 0, 0), (2, 1.0, 5, 0.2, 9, 0, 0), (1, 1.0, 14, 0, 25, 0, 0), (1, 1.0, 9, 0, 60, 0, 0), (1, 1.0, 3, 0, 5, 0, 0),
    # footers: the last block
    (60, 0, 14, 0, 0, 0, 0), (120, 0, 20, 0, 0, 0, 0), (5, 0, 18, 0, 0, 0, 0), (35, 0, 9, 0.1, 0, 0, 0), (210, 0, 26, 0, 0, 0, 0), (16, 0, 16, 0, 0, 0, 0), (80, 0, 5, 0.4, 0, 0, 0), (1, 0, 12, 0, 0, 0, 0), (44, 0, 30, 0, 0, 0, 0), (9, 0, 22, 0, 0, 0, 0), (3, 0.5, 24, 0.2, 0, 0, 0), (150, 0, 8, 0, 0, 0, 0),
    # headlines
    (8, 0, 7, 0, 45, 0, 1), (11, 0, 9, 0, 80, 0, 1), (0, 0, 6, 0, 50, 0, 1), (6, 0, 10, 0, 5, 0, 1), (13, 0, 4, 0, 120, 0, 1), (9, 0, 12, 0, 30, 0, 1), (70, 0, 5, 0, 90, 0, 1), (40, 0, 3, 0, 65, 0, 1), (15, 0, 8, 0, 12, 0, 1), (5, 0, 11, 0, 22, 0, 1),
    # paragraphs
    (7, 0, 45, 0, 60, 0, 1), (60, 0, 80, 0, 35, 0, 1), (35, 0, 25, 0, 14, 0, 1), (25, 0, 110, 0.03, 70, 0, 1), (110, 0, 60, 0.1, 12, 0, 1), (9, 0, 5, 0, 40, 0, 1), (40, 0, 1, 0, 75, 0, 1), (80, 0, 6, 0, 15, 0, 1), (55, 0.05, 12, 0, 48, 0, 1), (30, 0, 2, 0, 30, 0, 1),
    (20, 0, 15, 0, 20, 0, 1), (100, 0, 40, 0, 16, 0, 1), (30, 0, 90, 0, 18, 0, 1), (12, 0, 35, 0.2, 50, 0.05, 1), (8, 0, 18, 0, 9, 0, 1), (1, 1.0, 55, 0.02, 70, 0, 1), (1, 1.0, 120, 0, 40, 0, 1), (2, 1.0, 70, 0.05, 3, 1.0, 1), (90, 0, 45, 0.1, 4, 1.0, 1), (70, 0, 55, 0, 0, 0, 1),
    (0, 0, 130, 0, 0, 0, 1), (10, 0, 200, 0, 0, 0, 1), (0, 0, 60, 0, 40, 0, 1), (0, 0, 45, 0.1, 0, 0, 1), (26, 0, 70, 0, 0, 0, 1), (50, 0, 30, 0.3, 60, 0, 1), (65, 0, 8, 0.25, 55, 0, 1), (22, 0, 3, 0, 17, 0, 1), (6, 0, 7, 0, 6, 0, 1), (14, 0, 4, 0, 13, 0, 1),
    # paragraphs before or after short ones
    (108, 0, 40, 0, 2, 0, 1), (40, 0, 2, 0, 7, 0, 1), (75, 0, 8, 0, 12, 0, 1), (123, 0, 1, 0, 9, 0, 1), (1, 0, 9, 0, 11, 0, 1), (43, 0, 4, 0, 9, 0, 1), (4, 0, 9, 0, 9, 0, 1), (25, 0, 25, 0, 3, 0, 1), (66, 0, 32, 0, 7, 0, 1), (32, 0, 7, 0, 10, 0, 1),
    (9, 0, 13, 0, 5, 0, 1), (3, 0, 10, 0, 2, 0, 1), (2, 0, 60, 0, 4, 0, 1), (12, 0, 22, 0, 6, 0, 1), (5, 0, 3, 0, 8, 0, 1), (17, 0, 95, 0, 1, 0, 1), (8, 0, 140, 0, 12, 0, 1), (14, 0, 5, 0, 1, 0, 1), (30, 0, 18, 0.1, 4, 0, 1), (6, 0, 2, 0, 3, 0, 1),
    (52, 0, 16, 0, 11, 0, 1), (21, 0, 38, 0.05, 8, 0, 1), (11, 0, 11, 0, 10, 0, 1), (10, 0, 6, 0, 2, 0, 1), (85, 0, 12, 0, 1, 0, 1), (7, 0, 28, 0, 9, 0, 1), (3, 0, 4, 0, 5, 0, 1), (19, 0, 7, 0.1, 12, 0, 1), (45, 0, 52, 0, 2, 0, 1), (13, 0, 1, 0, 6, 0, 1),
    # a last block after short ones
    (9, 0, 11, 0, 0, 0, 0), (12, 0, 10, 0, 0, 0, 0), (6, 0, 8, 0, 0, 0, 0), (13, 0, 13, 0, 0, 0, 0), (7, 0, 15, 0, 0, 0, 0), (2, 0, 9, 0, 0, 0, 0), (22, 0, 12, 0, 0, 0, 0), (10, 0, 17, 0, 0, 0, 0), (4, 0, 14, 0, 0, 0, 0), (18, 0, 6, 0, 0, 0, 0), (11, 0, 28, 0, 0, 0, 0), (30, 0, 33, 0, 0, 0, 0),
]


def train(table: list[tuple], depth: int = 7, least: int = 2) -> Any:
    """A decision tree by Gini impurity: nested (feature, threshold, below,
    above), leaves 0 or 1. Ties take the first feature and the least threshold."""
    data = np.array(table, float)

    def grow(rows: np.ndarray, d: int) -> Any:
        y = rows[:, -1]
        most = int(2 * y.sum() >= y.size)
        if d == 0 or y.min() == y.max() or y.size < 2 * least:
            return most
        best: tuple[float, int, float] | None = None
        for f in range(rows.shape[1] - 1):
            values = np.unique(rows[:, f])
            for t in (values[1:] + values[:-1]) / 2:
                left = rows[:, f] < t
                n = int(left.sum())
                if n < least or y.size - n < least:
                    continue
                a, b = y[left].mean(), y[~left].mean()
                score = (n * a * (1 - a) + (y.size - n) * b * (1 - b)) / y.size
                if best is None or score < best[0] - 1e-12:
                    best = (score, f, float(t))
        if best is None:
            return most
        _, f, t = best
        left = rows[:, f] < t
        low, high = grow(rows[left], d - 1), grow(rows[~left], d - 1)
        return low if low == high and not isinstance(low, tuple) else (f, t, low, high)

    return grow(data, depth)


def classify(tree: Any, x: np.ndarray) -> np.ndarray:
    """0 or 1 for each row of features."""
    if not isinstance(tree, tuple):
        return np.full(len(x), bool(tree))
    f, t, low, high = tree
    below = x[:, f] < t
    out = np.empty(len(x), bool)
    out[below] = classify(low, x[below])
    out[~below] = classify(high, x[~below])
    return out


_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose contents aren't text of the page, once they are closed.
_DROPPED = frozenset("template svg math iframe textarea select object".split())
_RAW = "script|style"
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<({_RAW})\b(?:[^<>"']|"[^"]*"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"""
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?:(?=[\s/>])(?:(?:[^<>"']|"[^"]*"|'[^']*')*+>|[^<>]*>))|<[!?][^<>]*>""",
    re.S | re.I,
)


def blocks(page: str) -> tuple[str, list[tuple[str, int, int]]]:
    """(title, [(text, words, words in links)]) of a page. Unclosed and
    misnested tags are taken as they come; a ``<`` that begins no tag is text. A
    quoted attribute may hold ``>``. An unclosed script or style reaches to the
    end; of other dropped elements one that isn't closed is a tag like others."""
    found: list[tuple[str, int, int]] = []
    parts: list[str] = []
    title: list[str] = []
    linked = 0
    link = in_title = False
    tokens = list(_TOKEN.finditer(page))
    last = {m[3].lower(): m.start() for m in tokens if m[2]}  # where each element is closed for the last time

    def text(raw: str) -> None:
        nonlocal linked
        if not raw:
            return
        if in_title:
            title.append(raw)
            return
        parts.append(raw)
        if link:
            linked += len(raw.split())

    def close() -> None:
        nonlocal linked
        words = html.unescape("".join(parts)).split()
        if words:
            found.append((" ".join(words), len(words), min(linked, len(words))))
        parts.clear()
        linked = 0

    at, dropped, depth = 0, "", 0
    for m in tokens:
        name = (m[3] or "").lower()
        opens = not m[2]
        if dropped:
            if name == dropped and not m[0].endswith("/>"):
                depth += 1 if opens else -1
                if not depth or m.start() == last[name]:
                    at, dropped = m.end(), ""
            continue
        text(page[at : m.start()])
        at = m.end()
        if not name:
            continue
        if name in _DROPPED:
            close()
            if opens and last.get(name, -1) > m.start() and not m[0].endswith("/>"):
                dropped, depth = name, 1
        elif name == "a":
            link = opens
        elif name == "br":
            parts.append("\n")
        elif name == "title":
            close()
            in_title = opens
        elif name not in _INLINE:
            close()
            link = in_title = False
    text(page[at:])
    close()
    return " ".join(html.unescape("".join(title)).split()), found


def features(found: list[tuple[str, int, int]]) -> np.ndarray:
    n = len(found)
    x = np.zeros((n + 2, 2))
    for i, (_, words, linked) in enumerate(found):
        x[i + 1] = words, linked / words
    return np.concatenate([x[:-2], x[1:-1], x[2:]], axis=1)


def extract(pages: DataFrame, table: list[tuple] = LABELLED) -> DataFrame:
    """(page_id, title, text, n_blocks, n_content) of every page: the content
    blocks, a line each.

    A null page has a null text and no blocks; an empty page, or one without
    text, an empty text. A page may be of any length. Repeated rows are extracted
    each, alike; an empty table yields no rows. Other columns are ignored."""
    prepare(pages.sparkSession)
    tree = train(table)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            titles, texts, n_blocks, n_content = [], [], [], []
            every, sizes = [], []
            for page in batch.column("html").to_pylist():
                title, found = blocks(page or "")
                titles.append(None if page is None else title)
                every.append(None if page is None else found)
                sizes.append(len(found))
            x = [features(f) for f in every if f]
            keep = classify(tree, np.concatenate(x)) if x else np.zeros(0, bool)
            at = 0
            for found, n in zip(every, sizes):
                mine = [b[0] for b, k in zip(found or [], keep[at : at + n]) if k]
                at += n
                texts.append(None if found is None else "\n".join(mine))
                n_blocks.append(n)
                n_content.append(len(mine))
            yield pa.record_batch([batch.column("page_id"), pa.array(titles, pa.string()), pa.array(texts, pa.string()), pa.array(n_blocks, pa.int32()), pa.array(n_content, pa.int32())], names=["page_id", "title", "text", "n_blocks", "n_content"])

    return require(pages, "page_id", "html").mapInArrow(run, "page_id long, title string, text string, n_blocks int, n_content int")
