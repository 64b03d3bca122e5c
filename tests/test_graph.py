import random

import pytest

from mdlake.operators import graph


@pytest.fixture(scope="module")
def make(spark):
    return lambda pairs: spark.createDataFrame([(a, b, "wiki_link", "") for a, b in pairs], "source_path string, target_path string, link_type string, anchor_text string")


def ranks(edges, more=None, d=0.85, n=20):
    nodes = sorted({x for e in edges for x in e} | set(more or ()))
    s = {x: 1 / len(nodes) for x in nodes}
    out = {x: sum(a == x for a, _ in edges) for x in nodes}
    for _ in range(n):
        loose = sum(s[x] for x in nodes if not out[x])
        s = {x: (1 - d) / len(nodes) + d * (sum(s[a] / out[a] for a, b in edges if b == x) + loose / len(nodes)) for x in nodes}
    return s


def test_pagerank(spark, make):
    pairs = [("a", "b"), ("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "c"), ("d", "e")]
    want = ranks(pairs)
    got = graph.pagerank(make(pairs)).collect()
    assert all(abs(r.score - want[r.path]) < 1e-9 for r in got) and len(got) == 5
    assert [r.path for r in got] == sorted(want, key=lambda x: (-round(want[x], 12), x))
    lone = spark.createDataFrame([("x",), ("y",), ("z",)], "path string")
    assert all(abs(r.score - 1 / 3) < 1e-10 for r in graph.pagerank(make([]), lone, rounds=3).collect())
    hub = graph.pagerank(make([(f"s{i}", "hub") for i in range(10)]), rounds=10).collect()
    assert hub[0].path == "hub" and max(r.score for r in hub[1:]) - min(r.score for r in hub[1:]) < 1e-10
    assert graph.pagerank(make([])).count() == 0
    assert {round(r.score, 9) for r in graph.pagerank(make(pairs), rounds=0).collect()} == {0.2}


def test_components(spark, make):
    chain = [("a", "b"), ("b", "c"), ("x", "y")]
    assert [(r["size"], r.members) for r in graph.component_lists(graph.connected_components(make(chain))).collect()] == [(3, ["a", "b", "c"]), (2, ["x", "y"])]
    lone = spark.createDataFrame([("m",)], "path string")
    assert graph.component_lists(graph.connected_components(make(chain), lone)).collect()[-1].members == ["m"]
    assert graph.connected_components(make([("s", "s")])).collect() == [("s", "s")]
    rng = random.Random(1)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(45)] + [(f"p{i}", f"p{i + 1}") for i in range(40)]
    parent = {x: x for e in pairs for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert {r.path: r.component for r in graph.connected_components(make(pairs)).collect()} == {x: root(x) for x in parent}


def test_paths(make):
    e = make([("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("a", "x"), ("x", "z"), ("b", "z"), ("d", "a"), ("p", "q")])
    assert graph.shortest_path(e, "a", "d") == ["a", "d"]
    assert graph.shortest_path(e, "a", "z") == ["a", "b", "z"]  # the lexicographically least
    assert graph.shortest_path(e, "c", "z") == ["c", "d", "a", "b", "z"]
    assert graph.shortest_path(e, "z", "a") is None and graph.shortest_path(e, "a", "q") is None


def test_edits(make):
    e = make([("a", "b"), ("b", "a"), ("a", "b")])
    assert graph.get_links(e, "a").count() == 2 and graph.get_backlinks(e, "a").count() == 1 and graph.get_links(e, "no").count() == 0
    rest = graph.remove_document(e, "a")
    assert graph.stats(rest).first() == (2, 1) and graph.stats(graph.add_links(rest, e)).first() == (2, 4)
    assert graph.stats(e).first() == (2, 3)
    assert {r.path: r.out_degree for r in graph.out_degree(e).collect()} == {"a": 2, "b": 1}
