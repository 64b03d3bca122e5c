"""Plans that must hold at any size: what is joined, shuffled or parsed."""

import tracemalloc

import duckdb
import pyarrow as pa
import pytest

from mdlake.functions import embedding as E
from mdlake.operators import blocks as B, fts, graph, parse as P
from mdlake.plans import catalog

DIR = "/root/testdata/sf0.001"
NESTED = "# A\n\n- a\n  - b\n    > c\n    > - d\n- e\n\ntext\n"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["block_parents", "block_descendants"])
def test_blocks_are_not_joined(spark, name):
    assert "Join" not in plan(catalog.QUERIES[name](spark, DIR))


@pytest.mark.parametrize("depth", [1, 3, 8])
def test_descendants_of_rows_and_tables(spark, depth):
    docs = spark.createDataFrame([("a.md", NESTED), ("b.md", "x"), ("c.md", "---\na: [\n---\n# E"), ("d.md", ">" * 40 + " y")], "path string, content string")
    parsed = P.parse(docs)
    flat = B.descendants(P.tables(parsed)["blocks"], depth)
    assert "BroadcastHashJoin" not in plan(flat)
    columns = "ancestor_id", "block_id", "distance"
    found = sorted(map(tuple, P.descendants(parsed, depth).select(*columns).collect()))
    assert found == sorted(map(tuple, flat.select(*columns).collect())) and len(found) > 40


def test_parents_of_rows_and_tables(spark):
    parsed = P.parse(spark.createDataFrame([("a.md", NESTED), ("b.md", "")], "path string, content string"))
    rows = {r.block_id: r for r in P.tables(parsed)["blocks"].collect()}
    want = sorted((r.path, r.ordinal, rows[r.parent_block_id].ordinal, rows[r.parent_block_id].block_type) for r in rows.values() if r.parent_block_id)
    assert sorted(map(tuple, P.parents(parsed).collect())) == want and want


class Sized:
    """A provider of two numbers, that notes how many texts it gets at once."""

    dimension, model_id = 2, "sized"

    def __init__(self):
        self.most = 0

    def embed_batch(self, texts):
        self.most = max(self.most, len(texts))
        return [[float(len(t)), 1.0] for t in texts]


def test_vectors_of_a_batch_are_made_in_parts():
    texts = ["a b", None, "", "!!", "x " * 3000] * 400
    sized = Sized()
    assert E.vectors(pa.array(texts), sized).to_pylist() == [None if t is None else [float(len(t)), 1.0] for t in texts]
    assert sized.most <= E.MOST_TEXTS
    found = E.vectors(pa.array(texts[:50]), E.HashProvider())
    assert found.to_pylist() == [None if t is None else E.HashProvider().embed(t) for t in texts[:50]]
    assert E.vectors(pa.array([None, None], pa.string()), E.HashProvider()).to_pylist() == [None, None]


def test_vectors_need_little_memory():
    """No numbers as objects of Python: those of 5,000 vectors take 41 MB."""
    texts = pa.array([f"w{i} of the text" for i in range(5000)])
    tracemalloc.start()
    E.vectors(texts, E.HashProvider())
    assert tracemalloc.get_traced_memory()[1] < 20e6
    tracemalloc.stop()


def test_texts_are_embedded_once(spark):
    assert plan(catalog.QUERIES["hash_embed"](spark, DIR)).count("ArrowEvalPython") == 1


@pytest.mark.parametrize("name", ["full_document", "blocks_by_doc", "get_document_by_path", "scan_prefix", "scan_range", "links_from"])
def test_only_documents_asked_for_are_parsed(spark, name):
    """Every scan of the documents is filtered before it is parsed."""
    lines = plan(catalog.QUERIES[name](spark, DIR)).splitlines()
    parses = [i for i, x in enumerate(lines) if "MapInArrow" in x]
    for i in parses:
        below = next(i + j for j, x in enumerate(lines[i:]) if "FileScan" in x)
        assert any("Filter" in x and ("part/" in x or "customer/42" in x) for x in lines[i:below])
    assert parses


def test_counts_are_of_one_parse(spark):
    text = plan(catalog.QUERIES["ingest_counts"](spark, DIR))
    assert text.count("MapInArrow") == 1 and "Join" not in text


def test_counts_of_rows_and_tables(spark):
    docs = spark.createDataFrame([("a.md", "---\ntags: [x, y]\n---\n" + NESTED + "[[b]]"), ("b.md", ""), ("c.md", "---\na: [\n---\n# E"), ("d.md", None)], "path string, content string")
    t = P.tables_of(docs)
    want = B.counts(t["documents"], t["blocks"], t["links"], t["tags"]).select("path", "blocks", "links", "tags")
    found = P.counts(P.parse(docs, P.TABLES))
    assert found.dtypes == want.dtypes and sorted(found.collect()) == sorted(want.collect()) and found.count() == 3


ENTRIES = [("1", "", "b a", "b a"), ("1", "1:0", "b a", "x y x, Z x"), ("2", "", None, None), ("2", "2:0", "", "y " * 50 + "q"), ("3", "3:0", "t", "--")]


def ordered(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_postings_and_counts_without_a_shuffle(spark):
    rows = spark.createDataFrame([(d, b, d, "", t, c) for d, b, t, c in ENTRIES], "doc_id string, block_id string, path string, block_type string, title string, content string")
    want, found = fts.postings(rows), fts.postings(rows, unique=True)
    assert ordered(found) == ordered(want) and found.dtypes == want.dtypes and "Exchange" not in plan(found)
    assert ordered(fts.unique_term_stats(rows)) == ordered(fts.term_stats(want))
    assert not fts.repeats(rows, "doc_id", "block_id") and fts.repeats(rows, "doc_id")


def test_lines_are_not_joined_nor_shuffled_by_entry(spark):
    text = plan(catalog.QUERIES["fts_term_stats"](spark, DIR))
    assert "Join" not in text and "doc_id" not in "".join(x for x in text.splitlines() if "Exchange" in x)


def test_repeated_documents_count_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b\nb c"), (1, "a d"), (2, "a")], "doc_id long, text string")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    found = catalog.QUERIES["fts_term_stats"](spark, str(tmp_path)).collect()
    sql = catalog.ORACLE["fts_term_stats"].replace("documents", f"'{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, found)) == sorted(duckdb.sql(sql).fetchall())


def test_parsed_entries_are_those_of_tables(spark):
    docs = spark.createDataFrame([("a.md", NESTED), ("b.md", ""), ("c.md", "---\na: [\n---\n# E"), ("d.md", "---\ntitle: T\n---\nx")], "path string, content string")
    t = P.tables_of(docs)
    found = fts.parsed_entries(P.parse(docs, ("title", "blocks")))
    assert ordered(found) == ordered(fts.entries(t["documents"], t["blocks"])) and plan(found).count("MapInArrow") == 1


def test_a_round_holds_nodes_with_edges_in(spark, monkeypatch):
    """Scores against a dense iteration; what rounds write has no other nodes."""
    pairs = [(f"s{i}", f"t{i % 3}") for i in range(50)] + [("t0", "t1"), ("t1", "s0"), ("t1", "s0"), ("s1", "s1"), ("s2", "t0")]
    edges = spark.createDataFrame([(a, b, "wiki_link", "") for a, b in pairs], "source_path string, target_path string, link_type string, anchor_text string")
    more = spark.createDataFrame([("alone",), ("t2",)], "path string")
    tables, write = {}, graph.written
    monkeypatch.setattr(graph, "written", lambda df, name, **o: tables.setdefault(name, []).append(write(df, name, **o)) or tables[name][-1])
    found = dict(map(tuple, graph.pagerank(edges, more, rounds=5).collect()))
    names = sorted({x for p in pairs for x in p} | {"alone"})
    score = dict.fromkeys(names, 1 / len(names))
    out = {x: [b for a, b in pairs if a == x] for x in names}
    for _ in range(5):
        loose = sum(score[x] for x in names if not out[x])
        score = {x: 0.15 / len(names) + 0.85 * (sum(score[a] * out[a].count(x) / len(out[a]) for a in names if x in out[a]) + loose / len(names)) for x in names}
    assert found.keys() == score.keys() and all(abs(found[x] - score[x]) < 1e-12 for x in names)
    assert {t.count() for t in tables["scores"]} == {5}
