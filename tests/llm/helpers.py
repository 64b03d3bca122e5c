"""Documents that hold every awkward case, and brute force that is slow but
plain."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use inside.
CLASHES = ["th", "key", "h", "hi", "lo", "pid", "keep", "group_id", "level", "words", "span", "window_id", "slot", "shard", "distance", "node", "root", "d", "t", "at", "item_id", "url_key", "title", "a", "b", "x.y", "__text_hash", "__spans", "__lose_id", "__bad", "bad", "Text", "DOC_ID", "Lang", "N_CHARS", "`q`", "__place_1"]


def folded(text):
    low = []
    for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text or ""):
        low.append("".join(c.lower() if c < "\x80" or "\xc0" <= c <= "\xde" and c != "\xd7" else c for c in w))
    return low


def plain(text):
    return re.findall(r"[^\t\n\x0b\x0c\r ]+", text or "")


def prose(rng, n, vocabulary=3000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward(rng, long=60_000):
    """Rows of ``documents``: nulls in every column, empty and very long texts,
    repeated rows, equal texts under other ids."""
    base = prose(rng, 120)
    return [
        (1, base, "en", "web", len(base)), (1, base, "en", "web", len(base)), (2, base, "en", "web", len(base)), (None, base, "en", "web", None), (None, base, "en", "web", None),
        (3, None, "en", "web", None), (4, "", "en", "web", 0), (5, " \n\t ", None, None, 4), (6, "!!! ???", "de", None, 7), (7, prose(rng, 80) + " " + base, None, "web", 1),
        (8, prose(rng, long), "en", "book", 1), (9, base.replace("w1", "q1", 3), "en", "web", len(base)), (10, "É" * 5 + " ß 日本語 \U0001f600", "fr", "web", 12), (-5, "x", "en", "web", 1), (2**62, prose(rng, 60), "en", "", 9),
    ]


def frame(spark, rows, schema=SCHEMA, clash=False):
    df = spark.createDataFrame(rows, schema)
    if clash:
        from pyspark.sql import functions as F

        new = [name for name in CLASHES if name not in df.columns]
        names = [*df.columns, *new]
        df = df.select("*", *(F.lit("clash") for _ in new)).toDF(*names)
    return df


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
