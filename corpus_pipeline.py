"""A corpus pipeline of operators of ``mdlake.llm``, stage by stage.

Each stage works on all that its predecessor kept. All but the last return the
columns of ``documents``, whatever other columns there are and however they are
named; the last returns packed windows.

Every stage takes nulls in any column, empty and very long texts, and repeated
rows. An empty table passes through all of them and gives no windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mdlake.llm import decontam, packing, simhash, suffix_dedup, toxicity
from mdlake.llm.common import remove, scratch, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated score is at least the threshold go. Null and
    empty texts, having no words, get the rate of examples without words and so
    stay with any usual labels. Repeated rows go or stay alike; a null doc_id is
    judged by its text like others; examples of equal cosine count by doc_id."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of least doc_id
    (null first), then of least text hash. Documents without words are copies of
    none and stay, once for each doc_id and text. Of rows that repeat doc_id and
    text one stays."""
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds, too, are cut out of the texts, in
    the order of doc_id (null first), then text hash; a document of which nothing
    is left goes. Null and empty texts stay as they are."""
    return suffix_dedup.cut(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a passage with a benchmark item go. Null and empty
    texts share nothing and stay; so do all with an empty benchmark."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of tokens, with the documents that fill them. Null and empty texts
    have no tokens and are in no window; repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("repeated passages", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can't express the nearest neighbours' calibration, nor bounded-space packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written and read again as the next one's ``docs``;
    the last stage's rows are the result. Once a stage is written, what it and
    its predecessor left in the shared folder is removed; what the last stage
    reads stays, as its rows are computed when they are asked for."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with scratch() as made:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        remove(spark, before + made[:-1])
        before = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
