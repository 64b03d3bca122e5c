"""The registered queries over the provided tables, and SQL for each."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mdlake.functions import embedding as E
from mdlake.operators import blocks as B, fts, graph, knn, parse as P, shared
from mdlake.plans import corpus, features, mql  # noqa: F401 - features registers its queries
from mdlake.plans.registry import ORACLE, QUERIES, query  # noqa: F401
from mdlake.sources import markdown, store

def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parts(spark: SparkSession, sf_dir: str, path: Column | None = None) -> dict[str, DataFrame]:
    return P.tables_of(corpus.parts(spark, sf_dir), path)


def _places(spark: SparkSession, sf_dir: str, path: Column | None = None) -> dict[str, DataFrame]:
    return P.tables_of(corpus.places(spark, sf_dir), path)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query of the query language, from text to rows."""
    t = _parts(spark, sf_dir)
    return mql.plan("SELECT blocks WHERE block_type = 'heading' AND level = 2 LIMIT 10", t.__getitem__)


# Documents

_TITLE = "CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'Part ' || p_name END"


@query(f"SELECT 'part/' || p_partkey || '.md' AS path, {_TITLE} AS title, CAST(1 AS BIGINT) AS version FROM part")
def list_documents(spark, sf_dir):
    return _parts(spark, sf_dir)["documents"].select("path", "title", "version")


@query(f"SELECT 'part/' || p_partkey || '.md' AS path, {_TITLE} AS title FROM part WHERE p_partkey = 7")
def get_document_by_path(spark, sf_dir):
    return B.by_path(_parts(spark, sf_dir, F.col("path") == "part/7.md")["documents"], "part/7.md").select("path", "title")


@query("SELECT count(*) AS documents FROM part")
def document_count(spark, sf_dir):
    return _parts(spark, sf_dir)["documents"].agg(F.count(F.lit(1)).alias("documents"))


@query(
    f"""WITH t AS (SELECT p_partkey, 'title' AS key, '"' || p_name || '"' AS value FROM part UNION ALL SELECT p_partkey, 'brand', '"' || p_brand || '"' FROM part UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part
UNION ALL SELECT p_partkey, 'tags', '"' || p_type || '"' FROM part UNION ALL SELECT p_partkey, 'tags', '"' || p_brand || '"' FROM part)
SELECT 'part/' || p.p_partkey || '.md' AS path, {_TITLE} AS title, 'heading|paragraph|heading|code_block|list|list_item|paragraph|list_item|paragraph' AS block_types,
'Part ' || p_name || '|A ' || p_name || ' of size ' || p_size || '.|Query|SELECT ' || p.p_partkey || ';' || chr(10) || '|type ' || p_type || 'by ' || p_type || '|type ' || p_type || '|type ' || p_type || '|by ' || p_type || '|by ' || p_type AS texts,
(SELECT string_agg(key || '=' || value, '|' ORDER BY key, value) FROM t WHERE t.p_partkey = p.p_partkey) AS tags FROM part p WHERE p.p_partkey = 8"""
)
def full_document(spark, sf_dir):
    t = _parts(spark, sf_dir, F.col("path") == "part/8.md")
    row = B.full_document(t["documents"], t["blocks"], t["tags"], "part/8.md")
    joined = lambda c, f: F.array_join(F.transform(c, f), "|")
    return row.select("path", "title", joined("blocks", lambda b: b["block_type"]).alias("block_types"), joined("blocks", lambda b: b["text_content"]).alias("texts"), joined("tags", lambda x: F.concat_ws("=", x["key"], x["value"])).alias("tags"))


@query("SELECT 'part/' || p_partkey || '.md' AS path, CAST(9 AS BIGINT) AS blocks, CAST(1 AS BIGINT) AS links, CAST(4 + CAST(p_partkey % 2 = 0 AS INTEGER) AS BIGINT) AS tags FROM part")
def ingest_counts(spark, sf_dir):
    return P.counts(P.parse(corpus.parts(spark, sf_dir), P.TABLES))


@query("SELECT 'part/' || p_partkey || '.md' AS path FROM part WHERE 'part/' || p_partkey || '.md' LIKE 'part/1%'")
def scan_prefix(spark, sf_dir):
    return _parts(spark, sf_dir, F.col("path").startswith("part/1"))["documents"].select("path")


@query("SELECT 'part/' || p_partkey || '.md' AS path FROM part WHERE 'part/' || p_partkey || '.md' >= 'part/2' AND 'part/' || p_partkey || '.md' < 'part/31'")
def scan_range(spark, sf_dir):
    return _parts(spark, sf_dir, (F.col("path") >= "part/2") & (F.col("path") < "part/31"))["documents"].select("path")


@query("SELECT '{\"path\":\"part/' || p_partkey || '.md\",\"title\":\"' || " + _TITLE + " || '\"}' AS json FROM part")
def json_sink(spark, sf_dir):
    return _parts(spark, sf_dir)["documents"].select(F.to_json(F.struct("path", "title")).alias("json"))


# Blocks

_PARTS = "SELECT p_partkey, 'part/' || p_partkey || '.md' AS path, p_name, p_size, p_type FROM part"
_BLOCKS = f"""WITH p AS ({_PARTS}), b AS (
  SELECT path, 0 AS ordinal, 0 AS depth, 'heading' AS block_type, 1 AS heading_level, 'Part ' || p_name AS text_content, CAST(NULL AS INTEGER) AS parent FROM p
  UNION ALL SELECT path, 1, 0, 'paragraph', NULL, 'A ' || p_name || ' of size ' || p_size || '.', NULL FROM p
  UNION ALL SELECT path, 2, 0, 'heading', 2, 'Query', NULL FROM p
  UNION ALL SELECT path, 3, 0, 'code_block', NULL, 'SELECT ' || p_partkey || ';' || chr(10), NULL FROM p
  UNION ALL SELECT path, 4, 0, 'list', NULL, 'type ' || p_type || 'by ' || p_type, NULL FROM p
  UNION ALL SELECT path, 5, 1, 'list_item', NULL, 'type ' || p_type, 4 FROM p
  UNION ALL SELECT path, 6, 2, 'paragraph', NULL, 'type ' || p_type, 5 FROM p
  UNION ALL SELECT path, 7, 1, 'list_item', NULL, 'by ' || p_type, 4 FROM p
  UNION ALL SELECT path, 8, 2, 'paragraph', NULL, 'by ' || p_type, 7 FROM p)
"""


@query(_BLOCKS + "SELECT path, ordinal, depth, block_type, heading_level, text_content FROM b")
def all_blocks(spark, sf_dir):
    return _parts(spark, sf_dir)["blocks"].select("path", "ordinal", "depth", "block_type", "heading_level", "text_content")


@query(_BLOCKS + "SELECT path, ordinal, text_content FROM b WHERE block_type = 'list_item'")
def blocks_by_type(spark, sf_dir):
    return B.query_blocks(_parts(spark, sf_dir)["blocks"], kind="ListItem").select("path", "ordinal", "text_content")


@query("SELECT 'conversation/' || conv_id || '.md' AS path, CAST(1 + 2 * row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 2 AS INTEGER) AS ordinal, 'Turn ' || turn AS text_content FROM conversations")
def blocks_heading_level(spark, sf_dir):
    t = P.tables_of(corpus.conversations(spark, sf_dir))
    return B.query_blocks(t["blocks"], heading_level=2).select("path", "ordinal", "text_content")


@query("SELECT 'conversation/' || conv_id || '.md' AS path, role AS language, text || chr(10) AS text_content FROM conversations WHERE role = 'user'")
def code_blocks_by_language(spark, sf_dir):
    t = P.tables_of(corpus.conversations(spark, sf_dir))
    return B.query_blocks(t["blocks"], language="user").select("path", "language", "text_content")


@query(_BLOCKS + "SELECT ordinal, block_type, depth FROM b WHERE path = 'part/7.md'")
def blocks_by_doc(spark, sf_dir):
    t = _parts(spark, sf_dir, F.col("path") == "part/7.md")
    return B.blocks_of(t["documents"], t["blocks"], "part/7.md").select("ordinal", "block_type", "depth")


@query(_BLOCKS + "SELECT c.path, c.ordinal, p.ordinal AS parent_ordinal, p.block_type AS parent_type FROM b c JOIN b p ON c.path = p.path AND c.parent = p.ordinal")
def block_parents(spark, sf_dir):
    return P.parents(P.parse(corpus.parts(spark, sf_dir), ("blocks",)))


@query(_BLOCKS + ", up AS (SELECT path, ordinal, parent AS above, 1 AS distance FROM b WHERE parent IS NOT NULL), two AS (SELECT u.path, u.ordinal, b.parent AS above, 2 AS distance FROM up u JOIN b ON u.path = b.path AND u.above = b.ordinal WHERE b.parent IS NOT NULL) SELECT distance, count(*) AS pairs FROM (SELECT * FROM up UNION ALL SELECT * FROM two) GROUP BY distance")
def block_descendants(spark, sf_dir):
    return P.descendants(P.parse(corpus.parts(spark, sf_dir), ("blocks",)), 4).groupBy("distance").agg(F.count(F.lit(1)).alias("pairs"))


_FENCE = "chr(96) || chr(96) || chr(96)"


@query(f"""WITH p AS (SELECT *, 'part/' || p_partkey || '.md' AS path, 'by [' || p_type || '](brand/' || replace(p_brand, '#', '-') || ')' AS by_link FROM part)
SELECT path, 0 AS ordinal, '# Part ' || p_name AS raw_markdown FROM p UNION ALL SELECT path, 1, 'A **' || p_name || '** of size *' || p_size || '*.' FROM p UNION ALL SELECT path, 2, '## Query' FROM p
UNION ALL SELECT path, 3, {_FENCE} || 'sql' || chr(10) || 'SELECT ' || p_partkey || ';' || chr(10) || {_FENCE} FROM p UNION ALL SELECT path, 4, '- type ' || p_type || chr(10) || '- ' || by_link FROM p
UNION ALL SELECT path, 5, '- type ' || p_type FROM p UNION ALL SELECT path, 6, 'type ' || p_type FROM p UNION ALL SELECT path, 7, '- ' || by_link FROM p UNION ALL SELECT path, 8, by_link FROM p""")
def raw_markdown(spark, sf_dir):
    return _parts(spark, sf_dir)["blocks"].select("path", "ordinal", "raw_markdown")


# Tags, titles and links


@query("""WITH p AS (SELECT *, 'part/' || p_partkey || '.md' AS path FROM part)
SELECT path, 'title' AS key, '"' || p_name || '"' AS value FROM p WHERE p_partkey % 2 = 0 UNION ALL SELECT path, 'brand', '"' || p_brand || '"' FROM p UNION ALL SELECT path, 'size', CAST(p_size AS VARCHAR) FROM p
UNION ALL SELECT path, 'tags', '"' || p_type || '"' FROM p UNION ALL SELECT path, 'tags', '"' || p_brand || '"' FROM p""")
def tags_flattened(spark, sf_dir):
    return _parts(spark, sf_dir)["tags"].select("path", "key", "value")


@query(f"SELECT 'part/' || p_partkey || '.md' AS path, {_TITLE} AS title, p_partkey % 2 = 0 AS from_key FROM part")
def title_resolution(spark, sf_dir):
    return _parts(spark, sf_dir)["documents"].select("path", "title", F.get_json_object("frontmatter", "$.title").isNotNull().alias("from_key"))


_LINKS = """WITH l AS (
  SELECT 'customer/' || c_custkey AS path, 'nation/' || n_name AS target, 'wiki_link' AS link_type, n_name AS anchor_text FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'customer/' || c_custkey, 'segment/' || c_mktsegment, 'markdown_link', c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'nation/' || n_name, 'region/' || r_name, 'wiki_link', 'region/' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
"""


@query(_LINKS + "SELECT path, target, anchor_text FROM l WHERE link_type = 'wiki_link'")
def wiki_links(spark, sf_dir):
    return _places(spark, sf_dir)["links"].where("link_type = 'wiki_link'").select("path", "target", "anchor_text")


@query(_LINKS + "SELECT link_type, count(*) AS links FROM l GROUP BY link_type")
def link_types(spark, sf_dir):
    return _places(spark, sf_dir)["links"].groupBy("link_type").agg(F.count(F.lit(1)).alias("links"))


@query(_LINKS + "SELECT target, link_type, anchor_text FROM l WHERE path = 'customer/42'")
def links_from(spark, sf_dir):
    t = _places(spark, sf_dir, F.col("path") == "customer/42")
    return B.links_from(t["documents"], t["links"], "customer/42").select("target", "link_type", "anchor_text")


@query(_LINKS + "SELECT path, anchor_text FROM l WHERE target = 'nation/NATION_3'")
def links_to(spark, sf_dir):
    t = _places(spark, sf_dir)
    return B.links_to(t["links"], "nation/NATION_3").select("path", "anchor_text")


# Mutation and versions

_DROP = "CAST(p_size AS INTEGER) <= 10"


@query(_BLOCKS.replace(_PARTS, _PARTS + " WHERE p_size > 10") + "SELECT block_type, count(*) AS blocks FROM b GROUP BY block_type")
def cascade_delete(spark, sf_dir):
    t = _parts(spark, sf_dir)
    small = t["documents"].where(F.get_json_object("frontmatter", "$.size").cast("int") <= 10)
    return store.cascade(t, small)["blocks"].groupBy("block_type").agg(F.count(F.lit(1)).alias("blocks"))


@query(f"SELECT 'part/' || p_partkey || '.md' AS path, CASE WHEN p_size <= 10 THEN 'New ' || p_partkey ELSE {_TITLE} END AS title FROM part")
def replace_by_path(spark, sf_dir):
    new = _read(spark, sf_dir, "part").where("p_size <= 10").selectExpr("concat('part/', p_partkey, '.md') AS path", "concat('# New ', p_partkey, '\\n') AS content")
    return store.replace_by_path(_parts(spark, sf_dir), P.tables(P.parse(new)))["documents"].select("path", "title")


@query(f"SELECT CAST(1 AS BIGINT) AS at, count(*) AS documents, CAST(0 AS BIGINT) AS replaced FROM part UNION ALL SELECT 2, count(*), sum(CAST(p_size <= 10 AS BIGINT)) FROM part UNION ALL SELECT 3, sum(CAST(p_size <= 40 AS BIGINT)), sum(CAST(p_size <= 10 AS BIGINT)) FROM part")
def snapshot_read(spark, sf_dir):
    """Three commits (all parts, some replaced, some deleted), each read as it
    was."""
    s = store.Store(spark, f"{shared.folder(spark)}/store-{uuid.uuid4().hex}")
    s.ingest(corpus.parts(spark, sf_dir))
    part = _read(spark, sf_dir, "part")
    s.ingest(part.where("p_size <= 10").selectExpr("concat('part/', p_partkey, '.md') AS path", "concat('# New ', p_partkey, '\\n') AS content"))
    s.delete(part.where("p_size > 40").select(P.doc_id(F.expr("concat('part/', p_partkey, '.md')")).alias("doc_id")))
    out = None
    for v in s.versions():
        rows = s.snapshot(v).documents.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(F.col("version") - 1), F.lit(0)).alias("replaced")).select(F.lit(v).cast("long").alias("at"), "documents", "replaced")
        out = rows if out is None else out.unionByName(rows)
    return out


# Full-text search over the lines of the documents


def _line_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    named = docs.select("doc_id", F.col("doc_id").alias("path"), F.lit(None).cast("string").alias("title"))
    lines = markdown.lines(docs).select("*", F.lit("paragraph").alias("block_type"), F.col("doc_id").alias("path"), F.lit(None).cast("string").alias("title"))
    return fts.entries(named, lines)


_ENTRIES = """WITH lines AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents WHERE text IS NOT NULL),
entries AS (SELECT doc_id, doc_id || ':' || line_no AS block_id, content FROM lines WHERE trim(content, ' ') <> '' UNION ALL SELECT CAST(doc_id AS VARCHAR), '', '' FROM documents),
words AS (SELECT doc_id, block_id, list_filter(string_split_regex(lower(content), '[^\\p{L}\\p{N}]+'), lambda t: t <> '' AND strlen(t) <= 40) AS ws FROM entries),
stats AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM words),
posts AS (SELECT doc_id, block_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, block_id, unnest(ws) AS term, len(ws) AS dl FROM words) GROUP BY doc_id, block_id, term)
"""


def _bm25(words: list[str], where: str = "true", top: str = "ORDER BY round(score, 9) DESC, doc_id, block_id LIMIT 10") -> str:
    some = ", ".join(f"'{w}'" for w in words)
    return _ENTRIES + f""", dfs AS (SELECT term, count(*) AS df FROM posts WHERE term IN ({some}) GROUP BY term),
scored AS (SELECT doc_id, block_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score, list(term) AS terms FROM posts JOIN dfs USING (term), stats GROUP BY doc_id, block_id)
SELECT doc_id, block_id, round(score, 6) AS score FROM scored WHERE {where} {top}"""


@query(_ENTRIES + "SELECT count(*) AS entries, sum(CAST(block_id = '' AS BIGINT)) AS documents, sum(len(content)) AS characters FROM entries")
def fts_entries(spark, sf_dir):
    return _line_entries(spark, sf_dir).agg(F.count(F.lit(1)).alias("entries"), F.sum((F.col("block_id") == "").cast("long")).alias("documents"), F.sum(F.length("content")).alias("characters"))


@query(_ENTRIES + "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM posts GROUP BY term")
def fts_term_stats(spark, sf_dir):
    entries = _line_entries(spark, sf_dir)
    found = fts.term_stats(fts.postings(entries)) if fts.repeats(_read(spark, sf_dir, "documents"), "doc_id") else fts.unique_term_stats(entries)
    return found.where("field = 'content'").select("term", "df", "cf")


def _found(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return fts.Index(_line_entries(spark, sf_dir)).scores(text).select("doc_id", "block_id", F.round("score", 6).alias("score"))


@query(_bm25(["the", "and", "nicht"]))
def bm25_top_k(spark, sf_dir):
    found = fts.Index(_line_entries(spark, sf_dir)).scores("the and nicht")
    return found.orderBy(F.desc(F.round("score", 9)), "doc_id", "block_id").limit(10).select("doc_id", "block_id", F.round("score", 6).alias("score"))


@query(_bm25(["with", "that", "les"], "list_contains(terms, 'with') AND list_contains(terms, 'that') OR list_contains(terms, 'les')", ""))
def fts_boolean(spark, sf_dir):
    return _found(spark, sf_dir, "(with AND that) OR les")


@query(_bm25(["with"], "true", "").replace("FROM scored WHERE true", "FROM scored WHERE NOT EXISTS (SELECT 1 FROM posts p WHERE p.doc_id = scored.doc_id AND p.block_id = scored.block_id AND p.term = 'and')"))
def fts_not(spark, sf_dir):
    return _found(spark, sf_dir, "+with -and")


@query(_ENTRIES + """, hits AS (SELECT doc_id, block_id, len(ws) AS dl, len(list_filter(range(1, len(ws)), lambda i: ws[i] = 'of' AND ws[i + 1] = 'the')) AS tf FROM words),
dfs AS (SELECT term, count(*) AS df FROM posts WHERE term IN ('of', 'the') GROUP BY term), w AS (SELECT sum(ln(1 + (n - df + 0.5) / (df + 0.5))) AS idf FROM dfs, stats)
SELECT doc_id, block_id, round(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM hits, w, stats WHERE tf > 0""")
def fts_phrase(spark, sf_dir):
    return _found(spark, sf_dir, '"of the"')


@query(_ENTRIES + ", hit AS (SELECT doc_id, block_id FROM entries WHERE doc_id = '7'), c AS (SELECT count(*) AS df FROM hit) SELECT doc_id, block_id, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS score FROM hit, c, stats")
def fts_raw_field(spark, sf_dir):
    return _found(spark, sf_dir, "path:7")


@query(_ENTRIES + "SELECT DISTINCT doc_id, block_id, 1.0::DOUBLE AS score FROM posts WHERE term >= 'the' AND term <= 'thez'")
def fts_range(spark, sf_dir):
    return _found(spark, sf_dir, "content:[the TO thez]")


@query(_ENTRIES + "SELECT count(*) AS entries FROM entries WHERE doc_id <> '7'")
def fts_delete(spark, sf_dir):
    return fts.delete_document(_line_entries(spark, sf_dir), "7").agg(F.count(F.lit(1)).alias("entries"))


_BEST = _bm25(["the", "and", "nicht"])
_SNIPPETS = (
    _ENTRIES.replace("WITH lines", "WITH RECURSIVE lines")
    + _BEST[len(_ENTRIES) :].replace("\nSELECT doc_id, block_id, round(score, 6) AS score FROM scored", "\n, top AS MATERIALIZED (SELECT doc_id, block_id, round(score, 4) AS score, content FROM scored JOIN entries USING (doc_id, block_id)")
    + """),
pieces AS (SELECT doc_id, block_id, unnest(regexp_extract_all(content, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+')) AS piece, generate_subscripts(regexp_extract_all(content, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+'), 1) AS i FROM top),
placed AS (SELECT *, sum(strlen(piece)) OVER (PARTITION BY doc_id, block_id ORDER BY i) AS shut, regexp_matches(piece, '[\\p{L}\\p{N}]') AND strlen(piece) <= 40 AS is_word FROM pieces),
worded AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, block_id ORDER BY i) AS k FROM placed WHERE is_word),
cuts AS (SELECT doc_id, block_id, k, CASE WHEN shut > 150 THEN shut - strlen(piece) ELSE 0 END AS start FROM worded WHERE k = 1
  UNION ALL SELECT w.doc_id, w.block_id, w.k, CASE WHEN w.shut - c.start > 150 THEN w.shut - strlen(w.piece) ELSE c.start END FROM cuts c JOIN worded w ON w.doc_id = c.doc_id AND w.block_id = c.block_id AND w.k = c.k + 1),
parts AS (SELECT w.doc_id, w.block_id, c.start, max(w.shut) AS stop, round(sum(coalesce(1.0 / (1 + df), 0)), 12) AS worth FROM worded w JOIN cuts c USING (doc_id, block_id, k) LEFT JOIN dfs ON term = lower(piece) GROUP BY w.doc_id, w.block_id, c.start),
best AS (SELECT doc_id, block_id, arg_min(start, (-worth, start)) AS start, arg_min(stop, (-worth, start)) AS stop FROM parts GROUP BY doc_id, block_id),
safe AS (SELECT p.doc_id, p.block_id, p.i, CASE WHEN lower(piece) IN ('the', 'and', 'nicht') THEN '<b>' || piece || '</b>' ELSE replace(replace(replace(piece, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') END AS html FROM placed p JOIN best b USING (doc_id, block_id) WHERE p.shut - strlen(p.piece) >= b.start AND p.shut <= b.stop)
SELECT doc_id, block_id, string_agg(html, '' ORDER BY i) AS snippet, any_value(score) AS score FROM safe JOIN top USING (doc_id, block_id) GROUP BY doc_id, block_id"""
)


@query(_SNIPPETS)
def snippet(spark, sf_dir):
    return fts.Index(_line_entries(spark, sf_dir)).search("the and nicht", 10).select("doc_id", "block_id", "snippet", F.round(F.col("score").cast("double"), 4).alias("score"))


# Embeddings and nearest neighbours

_HASHED = """WITH t AS (SELECT conv_id, turn, unnest(list_filter(list_transform(string_split_regex(text, '\\s+'), lambda w: lower(trim(w, '!"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'))), lambda w: w <> '')) AS token FROM conversations),
h AS (SELECT conv_id, turn, CAST(CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % 256 AS INTEGER) AS bucket, CASE WHEN CAST('0x' || substr(md5(token), 9, 1) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END AS s FROM t),
b AS (SELECT conv_id, turn, bucket, sum(s) AS v FROM h GROUP BY conv_id, turn, bucket),
v AS (SELECT conv_id, turn, bucket, CAST(v / sqrt(sum(v * v) OVER (PARTITION BY conv_id, turn)) AS FLOAT) AS x FROM b WHERE v <> 0)
"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").where("text is not null")
    return rows.select("conv_id", "turn", E.embed(F.col("text")).alias("vector"))


@query(_HASHED + "SELECT conv_id, turn, bucket, round(CAST(x AS DOUBLE), 4) AS value FROM v")
def hash_embed(spark, sf_dir):
    # Spark would filter by what it explodes, and so embed each text twice, unless that is an outer explode
    return _vectors(spark, sf_dir).select("conv_id", "turn", F.posexplode_outer("vector").alias("bucket", "value")).where("value <> 0").select("conv_id", "turn", "bucket", F.round(F.col("value").cast("double"), 4).alias("value"))


@query(_ENTRIES + "SELECT doc_id, count(*) AS blocks FROM entries WHERE block_id <> '' AND strlen(regexp_replace(content, '^[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+|[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+$', '', 'g')) >= 5 GROUP BY doc_id")
def embed_min_length(spark, sf_dir):
    lines = markdown.lines(_read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text"))
    return lines.where(E.long_enough(F.col("text_content"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"))


@query("WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(score, 5) AS score FROM (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS score FROM embeddings, q) ORDER BY round(score, 9) DESC, vec_id LIMIT 10")
def knn_top_k(spark, sf_dir):
    rows = _read(spark, sf_dir, "embeddings")
    one = rows.where("vec_id = 0").first()["embedding"]
    return knn.search(rows, one, 10, 64, ("vec_id",), "embedding").select("vec_id", F.round("score", 5).alias("score"))


_QUESTION = "la mention que nicht the"


@query(_HASHED.replace("FROM conversations)", f"FROM (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT -1, -1, '{_QUESTION}'))") + "SELECT a.conv_id, a.turn, round(sum(CAST(a.x AS DOUBLE) * q.x), 4) AS score FROM v a JOIN v q ON q.conv_id = -1 AND a.conv_id >= 0 AND a.bucket = q.bucket GROUP BY a.conv_id, a.turn ORDER BY round(sum(CAST(a.x AS DOUBLE) * q.x), 5) DESC, a.conv_id, a.turn LIMIT 10")
def semantic_search(spark, sf_dir):
    asked = E.HashProvider().embed(_QUESTION)
    scored = _vectors(spark, sf_dir).withColumn("score", knn.similarity(F.col("vector"), asked))
    return scored.orderBy(F.desc(F.round("score", 5)), "conv_id", "turn").limit(10).select("conv_id", "turn", F.round("score", 4).alias("score"))


@query("SELECT count(*) AS vectors, sum(CAST(conv_id = 3 AS BIGINT)) AS replaced FROM conversations WHERE conv_id <> 5")
def vector_upsert_delete(spark, sf_dir):
    """Vectors of one conversation replaced by others, those of another
    deleted."""
    rows = _vectors(spark, sf_dir).select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("string").alias("block_id"), "vector")
    new = rows.where("doc_id = '3'").withColumn("vector", F.transform("vector", lambda x: x * F.lit(0).cast("float")))
    left = knn.delete_document(knn.upsert(rows, new, 256), "5")
    return left.agg(F.count(F.lit(1)).alias("vectors"), F.sum(F.forall("vector", lambda x: x == 0).cast("long")).alias("replaced"))


@query("SELECT conv_id, turn, substr(text, 1, 200) AS text_preview FROM conversations")
def text_preview(spark, sf_dir):
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", knn.preview(F.col("text")).alias("text_preview"))


# Graph: pages and the targets of their links


def _page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    href = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("target_path")
    return _read(spark, sf_dir, "pages").select(F.col("url").alias("source_path"), href, F.lit("markdown_link").alias("link_type"), F.lit("").alias("anchor_text"))


_EDGES = """WITH RECURSIVE edges AS MATERIALIZED (SELECT url AS s, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS t FROM pages),
nodes AS MATERIALIZED (SELECT s AS p FROM edges UNION SELECT t FROM edges),
deg AS MATERIALIZED (SELECT s, count(*) AS d FROM edges GROUP BY s)
"""


@query(_EDGES + "SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count")
def graph_stats(spark, sf_dir):
    return graph.stats(_page_edges(spark, sf_dir))


@query(_EDGES + "SELECT s AS path, d AS out_degree FROM deg")
def out_degree(spark, sf_dir):
    return graph.out_degree(_page_edges(spark, sf_dir))


@query(_EDGES + "SELECT s AS source_path, t AS target_path FROM edges WHERE t = '/the'")
def backlinks(spark, sf_dir):
    return graph.get_backlinks(_page_edges(spark, sf_dir), "/the").select("source_path", "target_path")


@query(_EDGES + ", one AS (SELECT min(url) AS u FROM pages) SELECT t AS target_path, count(*) AS links FROM edges, one WHERE s = u GROUP BY t")
def graph_links(spark, sf_dir):
    edges = _page_edges(spark, sf_dir)
    first = _read(spark, sf_dir, "pages").agg(F.min("url")).first()[0]
    return graph.get_links(edges, first).groupBy("target_path").agg(F.count(F.lit(1)).alias("links"))


@query(_EDGES + ", one AS (SELECT min(url) AS u FROM pages) SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges, one WHERE s <> u) AS edge_count")
def graph_remove_document(spark, sf_dir):
    edges = _page_edges(spark, sf_dir)
    first = _read(spark, sf_dir, "pages").agg(F.min("url")).first()[0]
    return graph.stats(graph.remove_document(edges, first), graph.nodes(edges))


def _rank_sql() -> str:
    out = _EDGES + ", flow AS MATERIALIZED (SELECT e.s, e.t, count(*) / any_value(d) AS share FROM edges e JOIN deg USING (s) GROUP BY e.s, e.t), n AS MATERIALIZED (SELECT count(*) AS n FROM nodes), r0 AS MATERIALIZED (SELECT p, 1.0::DOUBLE / n AS x FROM nodes, n)"
    for i in range(1, 21):
        out += f""", r{i} AS MATERIALIZED (SELECT p, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(y, 0) + (SELECT coalesce(sum(x), 0) FROM r{i - 1} WHERE p NOT IN (SELECT s FROM deg)) / n) AS x
FROM nodes LEFT JOIN (SELECT t, sum(share * x) AS y FROM flow JOIN r{i - 1} ON p = s GROUP BY t) ON t = p, n)"""
    return out + " SELECT p AS path, round(x, 8) AS score FROM r20"


@query(_rank_sql())
def pagerank_20(spark, sf_dir):
    return graph.pagerank(_page_edges(spark, sf_dir)).select("path", F.round("score", 8).alias("score"))


@query(_EDGES + """, both_ways AS MATERIALIZED (SELECT s, t FROM edges UNION SELECT t, s FROM edges), reach AS (SELECT p, p AS q FROM nodes UNION SELECT r.p, b.t FROM reach r JOIN both_ways b ON r.q = b.s)
SELECT p AS path, min(q) AS component FROM reach GROUP BY p""")
def components(spark, sf_dir):
    return graph.connected_components(_page_edges(spark, sf_dir))


@query(_EDGES + """, both_ways AS MATERIALIZED (SELECT s, t FROM edges UNION SELECT t, s FROM edges), reach AS (SELECT p, p AS q FROM nodes UNION SELECT r.p, b.t FROM reach r JOIN both_ways b ON r.q = b.s),
parts AS (SELECT p, min(q) AS c FROM reach GROUP BY p) SELECT c AS component, count(*) AS size, list_sort(list(p))[1] AS first_member FROM parts GROUP BY c""")
def component_sizes(spark, sf_dir):
    return graph.component_lists(graph.connected_components(_page_edges(spark, sf_dir))).select("component", "size", F.col("members")[0].alias("first_member"))


@query("SELECT 0 AS step, 'customer/7' AS path UNION ALL SELECT 1, 'nation/' || n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 7 UNION ALL SELECT 2, 'region/' || r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey = 7")
def shortest_path(spark, sf_dir):
    t = _places(spark, sf_dir)
    edges = shared.written(graph.edges(t["documents"], t["links"]), "edges")
    row = _read(spark, sf_dir, "customer").where("c_custkey = 7").join(_read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).first()
    return graph.path_rows(edges, "customer/7", f"region/{row['r_name']}")


# Query language


@query(_BLOCKS + "SELECT path, ordinal, text_content FROM b WHERE block_type = 'heading' AND heading_level = 2")
def mql_select(spark, sf_dir):
    t = _parts(spark, sf_dir)
    rows = mql.plan("SELECT blocks WHERE block_type = 'heading' AND level = 2", t.__getitem__)
    return rows.select("path", "ordinal", "text_content")


@query(f"SELECT 'part/' || p_partkey || '.md' AS path, {_TITLE} AS title FROM part ORDER BY path LIMIT 5")
def mql_limit(spark, sf_dir):
    t = _parts(spark, sf_dir)
    return mql.plan("SELECT documents WHERE version >= 1 LIMIT 5", t.__getitem__).select("path", "title")


@query(_bm25(["the", "nicht"], "true", "ORDER BY round(score, 9) DESC, doc_id, block_id LIMIT 5"))
def mql_search_fulltext(spark, sf_dir):
    def run(text: str, limit: int) -> DataFrame:
        return fts.Index(_line_entries(spark, sf_dir)).scores(text).orderBy(F.desc(F.round("score", 9)), "doc_id", "block_id").limit(limit)

    return mql.plan("SEARCH fulltext 'the nicht' LIMIT 5", dict, run).select("doc_id", "block_id", F.round("score", 6).alias("score"))


@query(ORACLE["semantic_search"].replace("LIMIT 10", "LIMIT 5"))
def mql_search_semantic(spark, sf_dir):
    def run(text: str, limit: int) -> DataFrame:
        scored = _vectors(spark, sf_dir).withColumn("score", knn.similarity(F.col("vector"), E.HashProvider().embed(text)))
        return scored.orderBy(F.desc(F.round("score", 5)), "conv_id", "turn").limit(limit)

    return mql.plan(f"SEARCH semantic '{_QUESTION}' LIMIT 5", dict, None, run).select("conv_id", "turn", F.round("score", 4).alias("score"))
