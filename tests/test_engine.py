import os

import pytest
from pyspark.sql import functions as F

from mdlake.engine import Engine
from mdlake.functions import embedding as E
from mdlake.operators import fts, knn
from mdlake.plans import mql
from mdlake.sources import store
from mdlake.streaming import ingest as streaming

DOCS = {
    "rust.md": "---\ntitle: Rust Programming\ntags: [rust, systems, memory]\ncategory: languages\n---\n# Rust\n\nOwnership and the borrow checker, see [[python-guide]].\n\n## Code\n\n```rust\nfn main() {}\n```\n\n[site](https://rust.example)\n\n| a | b |\n|---|---|\n| 1 | 2 |\n",
    "python.md": "---\ntitle: Python Guide\ntags: [python, scripting, dynamic]\ncategory: languages\n---\n# Python\n\nDuck typing and dynamic dispatch, unlike [[rust-programming]].\n\n## Code\n\n```python\nprint(1)\n```\n",
    "go.md": "---\ntitle: Go Guide\ntags: [go, concurrency, channels]\ncategory: languages\n---\n# Go\n\nGoroutines and channels; compare [[rust-programming]] and [[go-faq]].\n\n## Code\n\n```go\nfunc main() {}\n```\n",
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")))
    e.ingest(spark.createDataFrame(list(DOCS.items()), "path string, content string"))
    return e


def test_counts_and_lookups(engine):
    assert [r.path for r in engine.list_documents().collect()] == ["go.md", "python.md", "rust.md"]
    assert engine.query_blocks(heading_level=1).count() == 3
    assert engine.query_blocks(block_type="heading").count() == 6
    for lang in ("rust", "python", "go"):
        assert engine.query_blocks(language=lang).count() == 1
    assert engine.query_blocks(block_type="CodeBlock").count() == 3 and engine.query_blocks(block_type="nonsense").count() == 0
    row = engine.get_document("rust.md").first()
    assert (row.title, len(row.tags), row.version) == ("Rust Programming", 5, 1)
    assert [b.ordinal for b in row.blocks] == list(range(6))
    with pytest.raises(store.NotFoundError):
        engine.query_blocks(doc_path="none.md")
    stats = engine.stats().first()
    assert stats.document_count == 3 and stats.edge_count == 5 and stats.node_count == 7 and stats.vector_count > 0
    assert '"path":"go.md"' in engine.to_json(engine.list_documents()).first()[0]


def test_graph(engine):
    assert [r["size"] for r in engine.graph_components().collect()] == [4, 3]
    assert engine.get_backlinks("rust-programming").count() == 2
    assert engine.shortest_path("rust.md", "python-guide") == ["rust.md", "python-guide"]
    assert engine.shortest_path("rust.md", "go-faq") is None and engine.shortest_path("rust.md", "unknown") is None
    assert engine.shortest_path("go.md", "go.md") == ["go.md"]
    scores = engine.graph_pagerank(rounds=5).collect()
    assert abs(sum(r.score for r in scores) - 1) < 1e-9


def test_fulltext(engine):
    assert engine.search_fulltext("duck typing").first().path == "python.md"
    assert engine.search_fulltext('"borrow checker"').first().path == "rust.md"
    hit = engine.search_fulltext("goroutines", 1).first()
    assert hit.path == "go.md" and "<b>Goroutines</b>" in hit.snippet and hit.score > 0
    assert engine.search_fulltext("nothing-like-this").count() == 0
    assert {r.path for r in engine.search_fulltext("path:go.md").collect()} == {"go.md"}
    assert {r.path for r in engine.search_fulltext("title:guide NOT title:go").collect()} == {"python.md"}
    assert {r.path for r in engine.search_fulltext("block_type:code_block AND content:main").collect()} == {"rust.md", "go.md"}
    assert {r.path for r in engine.search_fulltext('"borrow main"~2').collect()} == set()
    assert {r.path for r in engine.search_fulltext("content:[goroutines TO goroutinez]").collect()} == {"go.md"}
    assert engine.search_fulltext("guide", 0).count() == 0
    # the title hit counts for the document in both fields and for every block of it
    assert engine.search_fulltext("title:rust").count() == 7
    low, high = (engine.search_fulltext(q).first().score for q in ("goroutines", "goroutines^2"))
    assert abs(high - 2 * low) < 1e-5


@pytest.mark.parametrize("bad", ["(a", "a OR", "nofield:x", "a)", '"open'])
def test_fulltext_errors(bad):
    with pytest.raises(fts.QuerySyntaxError):
        fts.parse_query(bad)


def test_semantic(engine):
    assert engine.search_semantic("goroutines and channels").first().path == "go.md"
    assert engine.search_semantic("duck typing dynamic").first().path == "python.md"
    assert engine.search_semantic("x", 0).count() == 0
    with pytest.raises(knn.DimensionError):
        knn.search(engine.vectors(), [1.0], dimension=256)


def test_query_language(engine):
    assert engine.query("select BLOCKS where block_type = 'heading' AND level = 2 LIMIT 2").count() == 2
    assert engine.query("SELECT blocks WHERE level != 1").count() == 3  # null compares to neither
    assert engine.query("SELECT tags WHERE key = 'category'").count() == 3
    assert engine.query("SELECT documents LIMIT 0").count() == 0
    assert engine.query("SEARCH fulltext 'duck typing' LIMIT 1").first().path == "python.md"
    assert engine.query("SEARCH semantic 'goroutines and channels' LIMIT 1").first().path == "go.md"
    one = engine.list_documents().first().doc_id
    assert engine.query(f"SELECT blocks WHERE doc_id = {one.upper()}").count() > 0


def test_query_language_parser():
    assert mql.parse("SELECTdocuments") == mql.Select("documents")
    assert mql.parse("select Links WHERE PATH = 'a\nb'AND x>=3") == mql.Select("links", (mql.Condition("PATH", "=", "a\nb"), mql.Condition("x", ">=", 3)))
    for op in ("=", "!=", ">", "<", ">=", "<="):
        assert mql.parse(f"SELECT blocks WHERE level {op} 2").conditions[0].op == op
    for bad in ("", "INVALID", "SELECT", "SELECT x", "SELECT blocks WHERE", "SELECT blocks WHERE a = 'x' OR b = 'y'", "SELECT documents FROM x", "SELECT blocks WHERE a = -1", "SELECT blocks LIMIT x", "SEARCH fulltext", "SEARCH other 'x'", "SELECT blocks LIMIT 1 x"):
        with pytest.raises(mql.MqlError):
            mql.parse(bad)
    with pytest.raises(mql.InvalidNumber):
        mql.parse("SELECT blocks WHERE a = 99999999999999999999")
    nothing = {}.__getitem__
    with pytest.raises(mql.UnknownField):
        mql.predicate(mql.Condition("nope", "=", 1), __import__("mdlake.schema").schema.BLOCKS)
    with pytest.raises(mql.TypeMismatch):
        mql.predicate(mql.Condition("level", "=", "x"), __import__("mdlake.schema").schema.BLOCKS)
    with pytest.raises(mql.MqlError):
        mql.plan("SEARCH fulltext 'x'", nothing)


def test_versions(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    assert e.snapshot().documents.count() == 0 and e.graph_components().count() == 0
    e.ingest_document("a.md", "# A\n\n[[b.md]]\n")
    e.ingest_document("b.md", "# B\n")
    first, second = e.snapshot(1), e.snapshot(2)
    made = e.snapshot().documents.where("path = 'a.md'").first()
    e.ingest_document("a.md", "# New\n")
    now = e.snapshot().documents.where("path = 'a.md'").first()
    assert (now.version, now.title, now.created_at, now.doc_id) == (2, "New", made.created_at, made.doc_id)
    assert e.snapshot().links.count() == 0 and second.links.count() == 1
    e.delete_document("b.md")
    assert [x.documents.count() for x in (first, second, e.snapshot())] == [1, 2, 1]
    assert e.snapshot().blocks.join(e.snapshot().documents, "doc_id", "left_anti").count() == 0
    with pytest.raises(store.ReadOnlyError):
        first.delete(["x"])
    with pytest.raises(store.NotFoundError):
        e.delete_document("b.md")
    with pytest.raises(store.NotFoundError):
        e.snapshot(99)
    n = e.snapshot().blocks.count()
    e.store.delete(["unknown"])
    e.store.compact()
    assert e.snapshot().blocks.count() == n and len(e.snapshot()._segments) == 1
    again = Engine(spark, str(tmp_path / "s"))
    assert again.list_documents().count() == 1 and again.store.version == e.store.version


def test_conflicts_and_errors(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    bad = spark.createDataFrame([("x.md", "---\na: [\n---\n"), ("y.md", "# Y"), (None, "z"), ("n.md", None)], "path string, content string")
    with pytest.raises(store.ParseError):
        s.ingest(bad)
    assert s.version == 0
    s.ingest(bad, on_error="skip")
    assert sorted(r.path for r in s.table("documents").collect()) == ["n.md", "y.md"]
    with pytest.raises(store.ConflictError):
        s._publish(1, [])
    tag = spark.createDataFrame([("t1", s.table("documents").where("path = 'y.md'").first().doc_id, "k", '"v"')], "tag_id string, doc_id string, key string, value string")
    s.upsert("tags", tag)
    s.upsert("tags", tag.withColumn("value", F.lit('"w"')))
    assert [r.value for r in s.table("tags").collect()] == ['"w"'] and s.table("documents").count() == 2 and s.table("blocks").count() == 1
    assert s.snapshot().scan_prefix("documents", "path", "y").count() == 1
    assert s.snapshot().scan_range("documents", "path", "a", "y").count() == 1
    assert s.snapshot().get("tags", "t1").count() == 1
    plan = s.table("blocks")._jdf.queryExecution().toString()
    assert "Parquet" in plan or "parquet" in plan


def test_files_and_streaming(spark, tmp_path):
    src = tmp_path / "in" / "deep"
    os.makedirs(src)
    (src / "a.md").write_text("# A é\n")
    (src / "b.MD").write_text("# no\n")
    (tmp_path / "in" / "c.txt").write_text("# no\n")
    e = Engine(spark, str(tmp_path / "s"))
    e.ingest_path(str(tmp_path / "in"))
    row = e.list_documents().collect()
    assert [(r.path, r.title) for r in row] == [(str(src / "a.md"), "A é")]
    t = store.Store(spark, str(tmp_path / "t"))
    streaming.ingest(streaming.files(spark, str(tmp_path / "in")), t, str(tmp_path / "cp"), once=True).awaitTermination()
    assert t.table("documents").count() == 1


def test_embedding(spark):
    p = E.HashProvider()
    v = p.embed("Hello, (world)! don't")
    assert len(v) == 256 and abs(sum(x * x for x in v) - 1) < 1e-5 and v == p.embed("hello world don't")
    assert not any(p.embed(" ... !")) and E.tokenize(" A b") == ["a", "b"]
    with pytest.raises(ValueError):
        E.HashProvider(0)
    rows = spark.createDataFrame([("d", "1", ""), ("d", "2", "    "), ("d", "3", "hi"), ("d", "4", "ééé"), ("d", "5", "  four  ")], "doc_id string, block_id string, text_content string")
    assert [r.block_id for r in knn.embed_blocks(rows).collect()] == ["4"]
    down = E.HttpProvider("ollama", "http://127.0.0.1:9")
    assert down.embed_batch([]) == [] and down.dimension == 768
    with pytest.raises(E.EmbeddingError):
        down.embed("x")


def test_vectors(spark):
    rows = spark.createDataFrame([("a", "1", [1.0, 0.0]), ("a", "2", [0.0, 1.0]), ("b", "1", [-1.0, 0.0]), ("c", "1", [0.0, 0.0])], "doc_id string, block_id string, vector array<float>")
    got = [(r.doc_id, r.block_id, round(r.score, 6)) for r in knn.search(rows, [2.0, 0.0], 4).collect()]
    assert got == [("a", "1", 1.0), ("a", "2", 0.0), ("c", "1", 0.0), ("b", "1", -1.0)]
    new = spark.createDataFrame([("a", "1", [0.0, 5.0])], rows.schema)
    assert knn.upsert(rows, new, 2).count() == 4 and knn.delete_document(rows, "a").count() == 2
    with pytest.raises(Exception, match="dimension 3"):
        knn.upsert(rows, new, 3).collect()
    assert knn.search(rows.where("false"), [1.0, 0.0]).count() == 0
