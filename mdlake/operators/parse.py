"""Markdown documents to rows: one Arrow pass parses, the rest is native."""

from __future__ import annotations

from typing import Collection, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mdlake.functions import frontmatter, markdown as M

BATCH_ROWS = 500

_BLOCK = pa.struct([
    ("ordinal", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("block_type", pa.string()), ("heading_level", pa.int32()), ("language", pa.string()),
    ("list_ordered", pa.bool_()), ("text_content", pa.string()), ("raw_markdown", pa.string()),
])
_LINK = pa.struct([("seq", pa.int32()), ("block", pa.int32()), ("target", pa.string()), ("link_type", pa.string()), ("anchor_text", pa.string())])
_TAG = pa.struct([("seq", pa.int32()), ("key", pa.string()), ("value", pa.string())])
_OUT = pa.schema([("path", pa.string()), ("content_hash", pa.string()), ("title", pa.string()), ("frontmatter", pa.string()), ("error", pa.string()), ("blocks", pa.list_(_BLOCK)), ("links", pa.list_(_LINK)), ("tags", pa.list_(_TAG))])
PARSED = (
    "path string, content_hash string, title string, frontmatter string, error string, "
    "blocks array<struct<ordinal:int,parent:int,depth:int,block_type:string,heading_level:int,language:string,list_ordered:boolean,text_content:string,raw_markdown:string>>, "
    "links array<struct<seq:int,block:int,target:string,link_type:string,anchor_text:string>>, tags array<struct<seq:int,key:string,value:string>>"
)


class _Walk:
    """Blocks in pre-order with their nesting, and the links in them."""

    def __init__(self, parser: M.Parser):
        self.parser = parser
        self.blocks: list[dict] = []
        self.links: list[dict] = []

    def visit(self, nodes: list[M.Node]) -> str:
        """Emits all blocks; the plain text of all of them, one after another
        without anything between."""
        top: list[str] = []
        # (nodes to come, text so far, node, its block, ordinal of the block around, depth)
        stack: list[tuple] = [(iter(nodes), top, None, None, None, 0)]
        while stack:
            todo, text, node, block, parent, depth = stack[-1]
            n = next(todo, None)
            if n is None:
                stack.pop()
                if node is not None:
                    own = "".join(text)
                    stack[-1][1].append(own)
                    if block is not None:
                        block["text_content"] = f"[^{node.name}]: {own.strip()}" if node.kind == "footnote_definition" else own.strip()
                continue
            if n.kind == "task_item":  # isn't a block itself; what is in it belongs to the list
                stack.append((iter(n.children), [], n, None, parent, depth))
                continue
            block = {"ordinal": len(self.blocks), "parent": parent, "depth": depth, "block_type": n.kind, "heading_level": n.level, "language": None, "list_ordered": n.ordered, "raw_markdown": n.raw.strip()}
            self.blocks.append(block)
            if n.kind in ("list", "list_item", "block_quote", "footnote_definition"):
                stack.append((iter(n.children), [], n, block, block["ordinal"], depth + 1))
            elif n.kind in ("heading", "paragraph", "table"):
                parts = []
                for source in n.cells if n.kind == "table" else [n.text]:
                    plain, links = M.inline(source, self.parser)
                    parts.append(plain)
                    self.links += [{"block": block["ordinal"], "target": x.url, "link_type": M.link_type(x), "anchor_text": x.anchor} for x in links]
                own = "".join(parts)
                block["text_content"] = own.strip()
                text.append(own)
                if n.kind == "heading":  # also one that is underlined
                    block["raw_markdown"] = f"{'#' * n.level} {n.text}".strip()
            elif n.kind == "thematic_break":
                block["text_content"], block["raw_markdown"] = "", "---"
            elif n.kind == "code_block":
                block["text_content"], block["language"] = n.text, (n.info.split() or [None])[0]
                block["raw_markdown"] = f"```{n.info}\n{n.text}" + ("" if n.text.endswith("\n") else "\n") + "```"
            else:
                block["text_content"] = block["raw_markdown"] = n.text
        return "".join(top)


TABLES = ("blocks", "links", "tags")


def parse_one(content: str, want: Collection[str] = TABLES) -> dict:
    """Title, frontmatter, blocks, links and tags of one text; ``error`` and
    nothing else where its frontmatter is invalid, or anything else fails, so
    that no text stops a job. Only the tables wanted are filled."""
    try:
        return _parsed(content, want)
    except Exception as e:  # noqa: BLE001 - the row says what
        text = str(e) if isinstance(e, frontmatter.FrontmatterError) else f"{type(e).__name__}: {e}"
        return {"title": None, "frontmatter": None, "error": text, "blocks": [], "links": [], "tags": []}


def _parsed(content: str, want: Collection[str]) -> dict:
    yaml, body = frontmatter.split(content)
    matter = None if yaml is None else frontmatter.load(yaml)
    parser = M.Parser()
    title, blocks, links = frontmatter.title(matter), [], []
    if "blocks" in want or "links" in want:
        walk = _Walk(parser)
        walk.visit(parser.document(body))
        blocks = walk.blocks
        links = walk.links + [{"block": None, "target": t, "link_type": "wiki_link", "anchor_text": a} for t, a in M.wiki_links(body)]
        title = title or next((b["text_content"] for b in blocks if b["heading_level"] == 1), None)
    elif "title" in want and title is None:
        first = next((n for n in M.preorder(parser.document(body)) if n.level == 1), None)
        title = first and M.inline(first.text, parser)[0].strip()
    return {
        "title": title,
        "frontmatter": None if matter is None else frontmatter.dumps(matter),
        "error": None,
        "blocks": blocks if "blocks" in want else [],
        "links": [{"seq": i, **x} for i, x in enumerate(links)] if "links" in want else [],
        "tags": [{"seq": i, "key": k, "value": v} for i, (k, v) in enumerate(frontmatter.tags(matter))] if "tags" in want else [],
    }


def parse(docs: DataFrame, want: Collection[str] = ("title", *TABLES)) -> DataFrame:
    """(path, content) to one nested row per document. A null content is an
    empty document, a null path is no document; other columns are ignored. What
    isn't wanted (``title``, ``blocks``, ``links``, ``tags``) may stay empty and
    isn't parsed for its own sake."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [parse_one(x or "", want) for x in batch.column("content").to_pylist()]
            columns = [batch.column("path"), batch.column("content_hash"), *(pa.array([r[f.name] for r in rows], f.type) for f in list(_OUT)[2:])]
            yield pa.record_batch(columns, schema=_OUT)

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    rows = docs.select("path", "content", F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_hash")).where("path is not null")
    return rows.mapInArrow(run, PARSED)


def uuid_of(*parts: Column) -> Column:
    """A name-based identifier in the form of a UUID."""
    return F.regexp_replace(F.md5(F.concat_ws("\0", *parts)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def doc_id(path: Column) -> Column:
    return uuid_of(path)


def block_id(doc: Column, ordinal: Column) -> Column:
    return uuid_of(doc, F.lit("block"), ordinal.cast("string"))


#: What each table needs of a parse.
_NEEDS = {"documents": ("title",), "blocks": ("blocks",), "links": ("links",), "tags": ("tags",)}


def tables_of(docs: DataFrame, path: Column | None = None) -> dict[str, DataFrame]:
    """The four tables of (path, content) rows, each with a column ``path`` and
    each by a parse of its own that makes nothing but that table: for queries
    that read one table. What reads several should parse once, see ``tables``.

    ``path`` is a condition on the column of that name. Spark can't move a filter
    on a table below its parse, so a query for some documents gives it here, and
    only texts that meet it are parsed."""
    if path is not None:
        docs = docs.where(path)
    return {name: tables(parse(docs, want))[name] for name, want in _NEEDS.items()}


def tables(parsed: DataFrame, now: Column | None = None) -> dict[str, DataFrame]:
    """The four tables of parsed rows, each with the column ``path``. Rows with
    an error are left out."""
    good = parsed.where("error is null").withColumn("doc_id", doc_id(F.col("path")))
    now = F.current_timestamp() if now is None else now
    part = lambda kind, seq: uuid_of(F.col("doc_id"), F.lit(kind), seq.cast("string"))
    block = good.select("doc_id", "path", F.inline("blocks"))
    link = good.select("doc_id", "path", F.inline("links"))
    tag = good.select("doc_id", "path", F.inline("tags"))
    return {
        "documents": good.select("doc_id", "path", "title", "frontmatter", "content_hash", now.alias("created_at"), now.alias("updated_at"), F.lit(1).cast("long").alias("version")),
        "blocks": block.select(
            part("block", F.col("ordinal")).alias("block_id"), "doc_id", "block_type", "heading_level", "language", "list_ordered", "depth", "ordinal",
            F.when(F.col("parent").isNotNull(), part("block", F.col("parent"))).alias("parent_block_id"), "text_content", "raw_markdown", "path",
        ),
        "links": link.select(
            part("link", F.col("seq")).alias("link_id"), F.col("doc_id").alias("source_doc_id"), F.when(F.col("block").isNotNull(), part("block", F.col("block"))).alias("source_block_id"),
            "target", F.lit(None).cast("string").alias("target_doc_id"), "link_type", "anchor_text", "path",
        ),
        "tags": tag.select(part("tag", F.col("seq")).alias("tag_id"), "doc_id", "key", "value", "path"),
    }


def counts(parsed: DataFrame) -> DataFrame:
    """(path, blocks, links, tags): how many each document has, by one parse."""
    return parsed.where("error is null").select("path", *(F.size(t).cast("long").alias(t) for t in TABLES))


# Blocks inside of others. The ordinal of a block is its place in the row of its
# document, so these read single parsed rows: without a join, however many
# documents there are.


def parents(parsed: DataFrame) -> DataFrame:
    """(path, ordinal, parent_ordinal, parent_type) of every block inside of
    another."""
    inner = F.filter("blocks", lambda b: b["parent"].isNotNull())
    pairs = F.transform(inner, lambda b: F.struct(b["ordinal"].alias("ordinal"), b["parent"].alias("parent_ordinal"), F.get("blocks", b["parent"])["block_type"].alias("parent_type")))
    return parsed.where("error is null").select("path", F.inline(pairs))


def descendants(parsed: DataFrame, depth: int = 8) -> DataFrame:
    """(ancestor_id, block_id, distance) of every block and the blocks around
    it, up to ``depth`` levels; see ``blocks.descendants`` for stored tables."""
    pair = lambda block, ancestor, distance: F.struct(block.alias("block"), ancestor.alias("ancestor"), distance.alias("distance"))
    level, out = F.transform("blocks", lambda b: pair(b["ordinal"], b["parent"], F.lit(1))), []
    for _ in range(depth):
        level = F.filter(level, lambda x: x["ancestor"].isNotNull())
        out.append(level)
        level = F.transform(level, lambda x: pair(x["block"], F.get("blocks", x["ancestor"])["parent"], x["distance"] + 1))
    rows = parsed.where("error is null").select(doc_id(F.col("path")).alias("doc_id"), F.inline(F.concat(*out)))
    return rows.select(block_id(F.col("doc_id"), F.col("ancestor")).alias("ancestor_id"), block_id(F.col("doc_id"), F.col("block")).alias("block_id"), "distance")
