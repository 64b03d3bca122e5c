"""URL filters as a sort-merge range join.

A URL's key is its host with the labels reversed, each followed by a comma,
then ``)`` and the path with its query: ``https://www.News.Example.org/a?b#c``
becomes ``org,example,news,)/a?b``. A rule for a host and its subdomains is the
prefix ``org,example,``; a rule for a path of one host the prefix
``org,example,)/a``. A prefix is an interval of keys, and two intervals are
nested or apart. Keys are range-partitioned by bounds sampled from the URLs, a
rule goes to each partition that its interval meets, and one sweep over the
sorted rows of a partition keeps the stack of rules whose interval is open; the
innermost decides. A key that is many bounds at once, as very many URLs have it,
has as many partitions, among which its rows are dealt. An IP address is a host
like others, a version 6 address in its brackets.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from typing import Any, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import prepare, require

PARAMS: dict[str, Any] = {"samples": 40}

_HEAD = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//"
_HOST = _HEAD + r"(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@]*)"
_PATH = _HEAD + r"[^/?#]*([^#]*)"

#: Unwanted sites, with their subdomains, and pages of them that are wanted.
BLOCKED = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
DEFAULT_RULES = [(f"{name}.example.{tld}", "block") for name in BLOCKED for tld in ("com", "net", "org")] + [
    (f"{name}.example.{tld}/about/legal", "allow") for name in BLOCKED for tld in ("com", "net", "org")
]


def rules_table(spark: SparkSession, rules: list[tuple[str, str]] = DEFAULT_RULES) -> DataFrame:
    return spark.createDataFrame([(i, x, a) for i, (x, a) in enumerate(rules)], "rule_id long, pattern string, action string")


def canonical_key(url: Any) -> Any:
    """The key of a URL column; null without a host."""
    url = F.trim(url)
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"^www\.|\.$", "")
    path = F.regexp_extract(url, _PATH, 1)
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.when(host != "", F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(",)"), path))


def rule_prefix(pattern: Any) -> Any:
    """The key prefix of a rule: ``host`` (with its subdomains) or
    ``host/path``; null for an empty or null pattern."""
    pattern = F.trim(pattern)
    host = F.regexp_replace(F.lower(F.regexp_extract(pattern, r"^([^/]*)", 1)), r"^www\.|^\*\.|\.$", "")
    path = F.regexp_extract(pattern, r"^[^/]*(.*)$", 1)
    return F.when(host != "", F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(","), F.when(path != "", F.concat(F.lit(")"), path)).otherwise("")))


def _after(prefix: bytes) -> bytes:
    """The least byte string above all that begin with ``prefix``."""
    while prefix and prefix[-1] == 0xFF:
        prefix = prefix[:-1]
    return prefix[:-1] + bytes([prefix[-1] + 1]) if prefix else b"\xff" * 8


def decide(pages: DataFrame, rules: DataFrame, **params: Any) -> DataFrame:
    """(page_id, url, url_key, rule_id, action, depth, kept) of every page.

    The innermost of the rules whose interval holds the key decides, ``depth``
    says how many do; of rules with equal prefixes ``block`` goes before
    ``allow``, then the least rule_id. ``kept`` is false for ``block``. A page
    that no rule matches is kept, with null rule and depth 0; so is a null or
    unparsable URL, whose key is null. A URL may be of any length. Repeated rows
    are decided each. Rules with a null or empty pattern match nothing. No pages
    give no rows, no rules keep all. Other columns are ignored."""
    p = PARAMS | params
    spark = pages.sparkSession
    prepare(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = require(pages, "page_id", "url").withColumn("key", canonical_key(F.col("url")))
    rules = require(rules, "rule_id", "pattern", "action").withColumn("key", rule_prefix(F.col("pattern"))).where("key is not null")
    order = F.xxhash64("key", "page_id")
    sample = keyed.where("key is not null").select("key", order.alias("o")).orderBy("o").limit(parts * p["samples"]).collect()
    keys = sorted(r[0].encode() for r in sample)
    bounds = keys[p["samples"] :: p["samples"]]

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            pid = []
            for i, k in enumerate(batch.column("key").to_pylist()):
                if k is None:  # meets no rule, wherever it goes
                    pid.append(-1 - i % parts)
                    continue
                lo, hi = bisect_left(bounds, k := k.encode()), bisect_right(bounds, k)
                pid.append(hi - i % (hi - lo) if hi > lo else hi)
            yield batch.append_column("pid", pa.array(pid, pa.int32()))

    def spread(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows, pid = [], []
            for i, k in enumerate(batch.column("key").to_pylist()):
                for x in range(bisect_left(bounds, k.encode()), bisect_right(bounds, _after(k.encode())) + 1):
                    rows.append(i)
                    pid.append(x)
            yield batch.take(pa.array(rows, pa.int64())).append_column("pid", pa.array(pid, pa.int32()))

    shape = "key string, is_page boolean, id long, url string, action string"
    left = keyed.select("key", F.lit(True).alias("is_page"), F.col("page_id").cast("long").alias("id"), "url", F.lit(None).cast("string").alias("action")).mapInArrow(place, shape + ", pid int")
    right = rules.select("key", F.lit(False).alias("is_page"), F.col("rule_id").cast("long").alias("id"), F.lit(None).cast("string").alias("url"), "action").mapInArrow(spread, shape + ", pid int")

    def sweep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stack = None, []
        for batch in it:
            out: list[list] = [[] for _ in range(7)]
            for key, page, ident, url, action, pid in zip(*(batch.column(c).to_pylist() for c in ("key", "is_page", "id", "url", "action", "pid"))):
                if pid != now:
                    now, stack = pid, []
                while stack and (key is None or not key.startswith(stack[-1][0])):
                    stack.pop()
                if page:
                    top = stack[-1] if stack else (None, None, None)
                    for o, v in zip(out, (ident, url, key, top[1], top[2], len(stack), top[2] != "block")):
                        o.append(v)
                else:
                    stack.append((key, ident, action))
            yield pa.record_batch([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.bool_()))], names=["page_id", "url", "url_key", "rule_id", "action", "depth", "kept"])

    # of equal prefixes the deciding rule comes last
    sort = ["pid", "key", "is_page", F.col("action").asc_nulls_first(), F.col("id").desc()]
    return left.unionByName(right).repartition(parts, "pid").sortWithinPartitions(*sort).mapInArrow(sweep, "page_id long, url string, url_key string, rule_id long, action string, depth int, kept boolean")


def oracle_sql(rules: list[tuple[str, str]] = DEFAULT_RULES) -> str:
    values = ", ".join(f"({i}, '{x}', '{a}')" for i, (x, a) in enumerate(rules))
    return f"""
WITH parts AS (
  SELECT page_id, url, regexp_replace(lower(regexp_extract(trim(url), '{_HOST}', 1)), '^www\\.|\\.$', '', 'g') AS host, regexp_extract(trim(url), '{_PATH}', 1) AS path FROM pages),
keyed AS (
  SELECT page_id, url, CASE WHEN host <> '' THEN array_to_string(list_reverse(string_split(host, '.')), ',') || ',)' || CASE WHEN starts_with(path, '/') THEN path ELSE '/' || path END END AS url_key FROM parts),
rules(rule_id, pattern, action) AS (VALUES {values}),
pieces AS (
  SELECT rule_id, action, array_to_string(list_reverse(string_split(string_split(pattern, '/')[1], '.')), ',') || ',' AS host, CASE WHEN contains(pattern, '/') THEN ')' || substr(pattern, strpos(pattern, '/')) ELSE '' END AS path FROM rules),
met AS (
  SELECT k.*, r.rule_id, r.action, length(r.host || r.path) AS len FROM keyed k LEFT JOIN pieces r ON starts_with(k.url_key, r.host || r.path)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY len DESC NULLS LAST, action DESC, rule_id) AS rn, count(rule_id) OVER (PARTITION BY page_id, url) AS depth FROM met)
SELECT page_id, url, url_key, CAST(rule_id AS BIGINT) AS rule_id, action, CAST(depth AS INTEGER) AS depth, coalesce(action, '') <> 'block' AS kept FROM ranked WHERE rn = 1"""
