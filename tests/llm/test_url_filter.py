import random
from urllib.parse import urlsplit

from mdlake.llm import url_filter as U

from ..oracle import both
from .helpers import got

PAGES, RULES = "page_id long, url string", "rule_id long, pattern string, action string"


def key(url):
    if url is None or "//" not in url:
        return None
    p = urlsplit(url.strip())
    host = (f"[{p.hostname}]" if ":" in (p.hostname or "") else p.hostname or "").lower().removeprefix("www.").removesuffix(".")
    if not host:
        return None
    return ",".join(reversed(host.split("."))) + ",)" + (p.path if p.path.startswith("/") else "/" + p.path) + (f"?{p.query}" if p.query else "")


def brute(url, rules):
    k, hits = key(url), []
    for i, pattern, action in rules:
        if not pattern:
            continue
        host, slash, path = pattern.partition("/")
        prefix = ",".join(reversed(host.split("."))) + "," + (f"){slash}{path}" if slash else "")
        if k is not None and k.startswith(prefix):
            hits.append((len(prefix), action == "block", -i, i, action))
    if not hits:
        return k, None, None, 0, True
    best = max(hits)
    return k, best[3], best[4], len(hits), best[4] != "block"


def test_against_brute_force(spark):
    rng = random.Random(1)
    labels = ["a", "b", "a-b", "ab", "c1"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 4))) + ".org"
    path = lambda: "".join("/" + rng.choice(["x", "xy", "y-", "z.html"]) for _ in range(rng.randrange(0, 4)))
    rules = [(i, host() + (path() or "/") * rng.randrange(2), rng.choice(["block", "allow"])) for i in range(120)] + [(500, None, "block"), (501, "", "block")]
    urls = [f"http://{rng.choice(['', 'www.', 'u@'])}{host()}{rng.choice(['', ':80'])}{path()}{rng.choice(['', '?q=1', '#f', '/?a'])}" for _ in range(1500)] + [None, "", "no scheme", "//a.org/x", "http://", "HTTP://A.B.org/X", "http://[::1]/x", "http://u@[2001:DB8::7]:8080/y?z", "http://127.0.0.1:80/x"] + ["http://a.org/x/xy"] * 700
    rules += [(600, "[::1]", "block"), (601, "[2001:db8::7]/y", "block"), (602, "a.org/x", "block"), (603, "a.org/x/xy", "allow")]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], PAGES)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = U.decide(pages, spark.createDataFrame(rules, RULES), samples=5)
        out = got(found)
        assert found.where("url = 'http://a.org/x/xy'").selectExpr("spark_partition_id() AS p").distinct().count() > 1  # a hot key is dealt out
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    want = sorted(((i, u, *brute(u, rules)) for i, u in [*enumerate(urls), (0, urls[0])]), key=repr)
    assert out == want
    assert sum(r[5] > 1 for r in out) > 50


def test_awkward_rows(spark):
    pages = spark.createDataFrame([(None, None), (None, "http://x.org/"), (1, "http://x.org/" + "p" * 200_000), (2, "http://x.org/"), (2, "http://x.org/")], PAGES).selectExpr("*", "'c' AS key", "'c' AS action", "'c' AS pid", "1 AS rule_id")
    rules = spark.createDataFrame([(3, "x.org", "allow"), (2, "x.org", "block"), (1, "x.org", "allow")], RULES).selectExpr("*", "'c' AS url", "'c' AS key")
    out = U.decide(pages, rules).collect()
    assert len(out) == 5 and [r.rule_id for r in out if r.url] == [2] * 4 and [r.kept for r in out if not r.url] == [True]
    assert U.decide(pages.where("false"), rules).count() == 0
    assert all(r.kept and r.depth == 0 for r in U.decide(pages, rules.where("false")).collect())


def test_query(spark):
    from mdlake.llm import queries

    ours, theirs = both(spark, "/root/testdata/sf0.001", queries.QUERIES["op1_url_filter"], queries.ORACLE["op1_url_filter"])
    assert ours == theirs
