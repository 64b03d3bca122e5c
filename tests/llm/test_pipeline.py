import random

import corpus_pipeline as P
from mdlake.llm import packing, queries, simhash, suffix_dedup
from mdlake.llm.common import shared_dir, table

from .helpers import SCHEMA, awkward, frame, prose

DIR = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(1)
    bad = ["scum", "idiot", "trash", "moron", "stupid"]
    rows, labels = awkward(rng, 3000), []
    for i in range(100, 300):
        w = prose(rng, 80).split()
        toxic = int(i % 4 == 0)
        if toxic:
            for b in bad:
                w[rng.randrange(80)] = b
        rows.append((i, " ".join(w), "en", "web", 1))
        labels.append((i, 1, toxic))
    shared, item = prose(rng, 60), prose(rng, 20)
    clean = [prose(rng, 90) for _ in range(8)]
    rows += [(501, clean[0], "en", "web", 1), (502, clean[0] + " extra", "en", "web", 1), (503, f"{clean[1]} {shared}", "en", "web", 1), (504, f"{clean[2]} {shared}", "en", "web", 1), (505, f"{clean[3]} {item.upper()} {clean[4]}", "en", "web", 1), (506, clean[5], "en", "web", 1), (507, clean[6] + " scum idiot moron", "en", "web", 1)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = table(spark, str(tmp_path), "documents")
    ids, texts = [], []
    for i, (_, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        got = docs.collect()
        ids.append({r.doc_id for r in got})
        texts.append({r.doc_id: r.text for r in got})
    everything = {r[0] for r in rows}
    toxic = {x[0] for x in labels if x[2]} | {507}
    assert everything - ids[0] == toxic
    assert ids[0] - ids[1] == {502, 1, 2, 9}
    assert ids[1] == ids[2] and shared in texts[2][503] and shared not in texts[2][504] and clean[2] in texts[2][504]
    assert ids[2] - ids[3] == {505}
    windows = P.run(spark, str(tmp_path)).collect()
    assert {d for w in windows for d in w.doc_ids} == {d for d in ids[3] if texts[3][d]}
    assert len(P.STAGES) == 5 and P.ORACLE_SQL is None


def test_stages_take_any_columns(spark, tmp_path):
    """Clashing names, nulls and repeated rows pass through the four stages that
    filter; what they leave behind but the last table is removed."""
    rows = awkward(random.Random(2), 3000)
    docs = frame(spark, rows, clash=True)
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (9, 1, 0), (8, 1, 0), (10, 1, 0), (7, 1, 1), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(random.Random(9), 30)), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert {str(r[0]) for r in out.collect()} >= {"3", "4", "5", "6", "8", "10"}
    P.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    folder = spark.sparkContext._jvm.java.io.File(shared_dir(spark).removeprefix("file://").removeprefix("file:"))
    before = set(folder.list())
    assert P.run(spark, str(tmp_path)).count() > 0
    assert sorted(x.rpartition("-")[0] for x in set(folder.list()) - before if not x.startswith("columns")) == ["stage-decontamination", "windows"]


def test_near_copies_where_all_buckets_are_large(spark, tmp_path, monkeypatch):
    """As on many documents: a task has no bucket of few points."""
    rng = random.Random(6)
    texts = [prose(rng, 60) for _ in range(100)]
    rows = [(i, t, "en", "web", 1) for i, t in enumerate(texts + [f"{t} extra" for t in texts[:30]])]
    monkeypatch.setitem(simhash.PARAMS, "bits", 0)
    monkeypatch.setitem(simhash.PARAMS, "tables", 1)
    stage = dict(P.STAGES)["near duplicates"]
    assert sorted(r.doc_id for r in stage(spark, frame(spark, rows), str(tmp_path)).collect()) == list(range(100))


def test_empty_table(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_queries_cover_their_tables(spark):
    n = table(spark, DIR, "documents").count()
    assert sorted(int(x[2:].split("_")[0]) for x in queries.QUERIES) == list(range(1, 11))
    assert queries.QUERIES["op10_toxicity"](spark, DIR).count() == n and queries.QUERIES["op8_quality"](spark, DIR).count() == n
    assert queries.QUERIES["op9_html_text"](spark, DIR).count() == table(spark, DIR, "pages").count()
    docs = table(spark, DIR, "documents")
    assert {d for w in queries.QUERIES["op6_packing"](spark, DIR).collect() for d in w.doc_ids} == {r.doc_id for r in docs.where("text <> ''").collect()}
    assert {d for w in queries.QUERIES["op5_token_output"](spark, DIR).collect() for d in w.doc_ids} == {r.doc_id for r in docs.where("text <> ''").collect()}
    assert "th" not in queries.QUERIES["op2_suffix_dedup"](spark, DIR).columns
    assert packing.PARAMS["window"] == 2048 and simhash.PARAMS["tables"] >= 20 and suffix_dedup.PARAMS["words"] == 50
