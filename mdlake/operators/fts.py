"""Full-text search: an inverted index as a table, BM25 and boolean queries.

Every document has one entry (block_id '', its title as title and content) and
one per block (the title again, and the block's text). ``postings`` holds one row
for each entry, field and term; a query reads the rows of its terms alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import parse as P

K1, B = 1.2, 0.75
RAW = ("doc_id", "block_id", "path", "block_type")
TEXT = ("content", "title")


class QuerySyntaxError(ValueError):
    pass


# Index


def entries(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, path, block_type, title, content). Blocks that have
    their documents' path and title aren't joined with them."""
    title = F.coalesce("title", F.lit(""))
    docs = documents.select("doc_id", "path", title.alias("title"))
    own = docs.select("doc_id", F.lit("").alias("block_id"), "path", F.lit("").alias("block_type"), "title", F.col("title").alias("content"))
    if {"path", "title"} <= set(blocks.columns):
        each = blocks.select("doc_id", "block_id", "path", "block_type", title.alias("title"), F.col("text_content").alias("content"))
    else:
        each = blocks.select("doc_id", "block_id", "block_type", F.col("text_content").alias("content")).join(docs, "doc_id")
    return own.unionByName(each.select(*own.columns))


def parsed_entries(parsed: DataFrame) -> DataFrame:
    """The entries of documents that are parsed just now, title and blocks, by
    one parse and without a join."""
    entry = lambda ordinal, kind, content: F.struct(ordinal.alias("ordinal"), kind.alias("block_type"), content.alias("content"))
    title = F.coalesce("title", F.lit(""))
    own = F.array(entry(F.lit(None).cast("int"), F.lit(""), title))
    each = F.transform("blocks", lambda b: entry(b["ordinal"], b["block_type"], b["text_content"]))
    rows = parsed.where("error is null").select(P.doc_id(F.col("path")).alias("doc_id"), "path", title.alias("title"), F.inline(F.concat(own, each)))
    block_id = F.when(F.col("ordinal").isNull(), "").otherwise(P.block_id(F.col("doc_id"), F.col("ordinal")))
    return rows.select("doc_id", block_id.alias("block_id"), "path", "block_type", "title", "content")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of at most 40 bytes."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: (t != "") & (F.octet_length(t) <= 40))


def _words(entries: DataFrame, *columns: str) -> DataFrame:
    """``columns``, ``field`` and its ``words``, a row per entry and field."""
    fields = F.array(*(F.struct(F.lit(f).alias("field"), tokens(F.coalesce(f, F.lit(""))).alias("words")) for f in TEXT))
    return entries.select(*columns, F.inline(fields))


def _by_term(words: Column) -> Column:
    """(term, positions) of the words of one text."""
    bind = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731 - so that it is computed once

    def runs(found: Column, starts: Column) -> Column:
        end = lambda k: F.coalesce(F.get(starts, k + 1), F.size(found))
        return F.transform(starts, lambda b, k: F.struct(F.get(found, b)["term"].alias("term"), F.slice(found, b + 1, end(k) - b)["at"].alias("positions")))

    def grouped(found: Column) -> Column:
        begins = F.transform(found, lambda x, i: F.when((i == 0) | (F.get(found, i - 1)["term"] != x["term"]), i))
        return bind(F.filter(begins, lambda i: i.isNotNull()), lambda starts: runs(found, starts))

    return bind(F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("term"), i.alias("at")))), grouped)


def postings(entries: DataFrame, unique: bool = False) -> DataFrame:
    """(term, field, doc_id, block_id, tf, dl, positions). Where it is known that
    no two entries have the same doc_id and block_id (``unique``), each is grouped
    by itself and nothing is shuffled."""
    each = _words(entries, "doc_id", "block_id")
    if unique:
        rows = each.select("doc_id", "block_id", "field", F.size("words").alias("dl"), F.inline(_by_term(F.col("words"))))
        return rows.select("term", "field", "doc_id", "block_id", F.size("positions").alias("tf"), "dl", "positions")
    words = each.select("doc_id", "block_id", "field", F.size("words").alias("dl"), F.posexplode("words").alias("at", "term"))
    return words.groupBy("term", "field", "doc_id", "block_id").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.first("dl").alias("dl"), F.sort_array(F.collect_list("at")).alias("positions"))


def field_stats(entries: DataFrame) -> DataFrame:
    """(field, n, avgdl)."""
    sizes = entries.select(*(F.size(tokens(F.coalesce(f, F.lit("")))).alias(f) for f in TEXT)).agg(F.count(F.lit(1)).alias("n"), *(F.avg(f).alias(f) for f in TEXT))
    return sizes.select(F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col("n"), F.col(f).alias("avgdl")) for f in TEXT))))


def term_stats(postings: DataFrame) -> DataFrame:
    """(field, term, df, cf): entries that hold a term, and its occurrences."""
    return postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def unique_term_stats(entries: DataFrame) -> DataFrame:
    """``term_stats`` of entries of which no two have the same doc_id and
    block_id, without their postings: words are summed up where they are read."""
    row = lambda w, df, cf: F.struct(w.alias("term"), F.lit(df).cast("long").alias("df"), F.lit(cf).cast("long").alias("cf"))
    both = F.concat(F.transform(F.array_distinct("words"), lambda w: row(w, 1, 0)), F.transform("words", lambda w: row(w, 0, 1)))
    return _words(entries).select("field", F.inline(both)).groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def repeats(rows: DataFrame, *key: str) -> bool:
    """Whether two rows have the same key."""
    return not rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def delete_document(entries: DataFrame, doc_id: str) -> DataFrame:
    return entries.where(F.col("doc_id") != doc_id)


# Query language


@dataclass
class Leaf:
    """A term, phrase (several words) or range over fields."""

    words: list[str]
    fields: tuple[str, ...]
    boost: float = 1.0
    slop: int = 0
    span: tuple[str | None, str | None, bool, bool] | None = None
    raw: str | None = None
    everything: bool = False


@dataclass
class Group:
    """``must``, ``should`` and ``must_not`` clauses."""

    must: list = field(default_factory=list)
    should: list = field(default_factory=list)
    must_not: list = field(default_factory=list)
    boost: float = 1.0


_TOKEN = re.compile(
    r"\s*(?:(?P<field>[A-Za-z_][\w.]*):(?=\S)|(?P<phrase>\"(?:[^\"\\]|\\.)*\")(?:~(?P<slop>\d+))?|(?P<range>[\[{]\s*\S+\s+TO\s+\S+?\s*[\]}])|(?P<open>\()|(?P<shut>\))|(?P<boost>\^\d+(?:\.\d+)?)|(?P<sign>[+-])(?=\S)|(?P<word>[^\s()\"^:\[\]{}]+))"
)


def analyse(text: str) -> list[str]:
    return [t for t in re.sub(r"[\W_]+", " ", text.lower()).split() if len(t.encode()) <= 40]


class _Parser:
    def __init__(self, text: str):
        self.items: list[tuple[str, str, int]] = []
        at = 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                raise QuerySyntaxError(f"unexpected {text[at:at + 10]!r}")
            kind = m.lastgroup if m.lastgroup != "slop" else "phrase"
            self.items.append((kind, m[kind], int(m["slop"] or 0)))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str, int]:
        return self.items[self.at] if self.at < len(self.items) else ("end", "", 0)

    def next(self) -> tuple[str, str, int]:
        item = self.peek()
        self.at += 1
        return item

    def whole(self) -> Group:
        found = self.either()
        if self.peek()[0] != "end":
            raise QuerySyntaxError(f"unexpected {self.peek()[1]!r}")
        return found

    def either(self) -> Group:
        """Clauses side by side are alternatives; AND binds closer than OR."""
        out = Group()
        while self.peek()[0] not in ("end", "shut"):
            sign, clause = self.clause()
            both = [(sign, clause)]
            while self.peek()[:2] == ("word", "AND"):
                self.next()
                both.append(self.clause())
            if len(both) > 1:
                own = Group([c for s, c in both if s != "-"], [], [c for s, c in both if s == "-"])
                if not own.must:
                    raise QuerySyntaxError("only negations")
                out.should.append(own)
            else:
                (out.must_not if sign == "-" else out.must if sign == "+" else out.should).append(clause)
            if self.peek()[:2] == ("word", "OR"):
                self.next()
                if self.peek()[0] in ("end", "shut"):
                    raise QuerySyntaxError("OR without a right side")
        return out

    def clause(self) -> tuple[str, Leaf | Group]:
        sign = ""
        kind, text, _ = self.peek()
        if kind == "sign":
            sign = self.next()[1]
        elif (kind, text) == ("word", "NOT"):
            self.next()
            sign = "-"
        return sign, self.atom(TEXT)

    def atom(self, fields: tuple[str, ...]) -> Leaf | Group:
        kind, text, slop = self.next()
        if kind == "field":
            if text not in (*TEXT, *RAW):
                raise QuerySyntaxError(f"no field {text}")
            return self.atom((text,))
        if kind == "open":
            inner = self.either()
            if self.next()[0] != "shut":
                raise QuerySyntaxError("( without )")
            out: Leaf | Group = self._into(inner, fields) if fields != TEXT else inner
        elif kind == "phrase":
            words = text[1:-1].replace('\\"', '"')
            out = Leaf(analyse(words), fields, slop=slop, raw=words)
        elif kind == "range":
            lo, hi = re.split(r"\s+TO\s+", text[1:-1].strip())
            out = Leaf([], fields, span=(None if lo == "*" else lo.lower(), None if hi == "*" else hi.lower(), text[0] == "[", text[-1] == "]"))
        elif kind == "word" and text not in ("AND", "OR", "NOT"):
            out = Leaf([], fields, everything=True) if text == "*" else Leaf(analyse(text), fields, raw=text)
        else:
            raise QuerySyntaxError(f"unexpected {text or 'end'!r}")
        if self.peek()[0] == "boost":
            out.boost *= float(self.next()[1][1:])
        return out

    def _into(self, group: Group, fields: tuple[str, ...]) -> Group:
        for c in (*group.must, *group.should, *group.must_not):
            if isinstance(c, Group):
                self._into(c, fields)
            elif c.fields == TEXT:
                c.fields = fields
        return group


def parse_query(text: str) -> Group:
    return _Parser(text).whole()


def _leaves(group: Group, boost: float = 1.0, negated: bool = False) -> list[tuple[Leaf, float, bool]]:
    out = []
    for clauses, no in ((group.must, negated), (group.should, negated), (group.must_not, True)):
        for c in clauses:
            out += _leaves(c, boost * c.boost, no) if isinstance(c, Group) else [(c, boost * c.boost, no)]
    return out


def _holds(group: Group, number: dict[int, int]) -> Column:
    """Whether an entry meets the query, from the numbers of its leaves."""

    def one(c: Leaf | Group) -> Column:
        return _holds(c, number) if isinstance(c, Group) else F.array_contains("hit", number[id(c)])

    out = F.lit(True)
    for c in group.must:
        out = out & one(c)
    if group.should and not group.must:
        any_ = F.lit(False)
        for c in group.should:
            any_ = any_ | one(c)
        out = out & any_
    if not group.must and not group.should:
        out = F.lit(False)
    for c in group.must_not:
        out = out & ~one(c)
    return out


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def saturation(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


# Search


class Index:
    """The tables of an index; ``build`` computes them once into a folder."""

    def __init__(self, entries: DataFrame, postings_: DataFrame | None = None, stats: DataFrame | None = None):
        self.entries = entries
        self.postings = postings(entries) if postings_ is None else postings_
        self.stats = field_stats(entries) if stats is None else stats

    @classmethod
    def build(cls, documents: DataFrame, blocks: DataFrame, path: str) -> "Index":
        """``write`` of the entries of these tables."""
        return cls.write(entries(documents, blocks), path)

    @classmethod
    def write(cls, made: DataFrame, path: str) -> "Index":
        """Writes the index below ``path``, replacing what is there. Postings are
        range-partitioned and sorted by term, so a term's rows are in few row
        groups."""
        spark = made.sparkSession
        made.write.mode("overwrite").parquet(f"{path}/entries")
        made = spark.read.parquet(f"{path}/entries")
        unique = not repeats(made.where("block_id = ''"), "doc_id")  # blocks have an id each, in their document
        postings(made, unique).repartitionByRange("term", "field", "doc_id").sortWithinPartitions("term", "field").write.mode("overwrite").parquet(f"{path}/postings")
        field_stats(made).write.mode("overwrite").parquet(f"{path}/stats")
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark, path: str) -> "Index":
        return cls(*(spark.read.parquet(f"{path}/{x}") for x in ("entries", "postings", "stats")))

    def _leaf(self, leaf: Leaf, boost: float, i: int) -> DataFrame | None:
        """(doc_id, block_id, score, leaf) of the entries that hold a leaf."""
        out = None
        columns = ["doc_id", "block_id", F.col("score").cast("double").alias("score"), F.lit(i).alias("leaf")]
        raw = [f for f in leaf.fields if f in RAW]
        text = [f for f in leaf.fields if f in TEXT]
        parts = []
        if leaf.everything:
            return self.entries.select("doc_id", "block_id", F.lit(boost).cast("double").alias("score"), F.lit(i).alias("leaf"))
        if raw:
            parts.append(self._raw(raw[0], leaf, boost))
        elif text and leaf.span:
            lo, hi, lo_in, hi_in = leaf.span
            rows = self.postings.where(F.col("field").isin(text))
            if lo is not None:
                rows = rows.where(F.col("term") >= lo if lo_in else F.col("term") > lo)
            if hi is not None:
                rows = rows.where(F.col("term") <= hi if hi_in else F.col("term") < hi)
            parts.append(rows.select("doc_id", "block_id", F.lit(boost).alias("score")).distinct())
        elif text and leaf.words:
            parts.append(self._words(leaf, text, boost))
        for p in parts:
            p = p.select(*columns)
            out = p if out is None else out.unionByName(p)
        return out

    def _raw(self, name: str, leaf: Leaf, boost: float) -> DataFrame:
        if leaf.span:
            lo, hi, lo_in, hi_in = leaf.span
            rows = self.entries
            if lo is not None:
                rows = rows.where(F.col(name) >= lo if lo_in else F.col(name) > lo)
            if hi is not None:
                rows = rows.where(F.col(name) <= hi if hi_in else F.col(name) < hi)
            return rows.select("doc_id", "block_id", F.lit(boost).alias("score"))
        rows = self.entries.where(F.col(name) == leaf.raw).select("doc_id", "block_id")
        n = self.stats.agg(F.max("n").alias("n"))
        return rows.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("df")).crossJoin(n))).select("doc_id", "block_id", (idf(F.col("n"), F.col("df")) * boost).alias("score"))

    def _words(self, leaf: Leaf, fields: list[str], boost: float) -> DataFrame:
        words = leaf.words
        rows = self.postings.where(F.col("term").isin(sorted(set(words))) & F.col("field").isin(fields))
        # two rows of statistics and as many counts as the query has words
        weight = rows.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(self.stats), "field").withColumn("idf", idf(F.col("n"), F.col("df")))
        if len(words) > 1:
            times = {w: words.count(w) for w in words}
            weight = weight.withColumn("idf", F.col("idf") * F.element_at(F.create_map(*(F.lit(x) for kv in times.items() for x in kv)), F.col("term")))
            weight = weight.groupBy("field").agg(F.sum("idf").alias("idf"), F.first("avgdl").alias("avgdl"))
            rows = self._phrase(rows, words, leaf.slop)
        else:
            weight = weight.select("field", "idf", "avgdl")
        met = rows.join(F.broadcast(weight), "field")
        return met.select("doc_id", "block_id", (F.col("idf") * saturation(F.col("tf"), F.col("dl"), F.col("avgdl")) * boost).alias("score"))

    def _phrase(self, rows: DataFrame, words: list[str], slop: int) -> DataFrame:
        """Entries and fields that hold the words in a row: positions less the
        place in the phrase agree (or differ by ``slop`` in all)."""
        places = F.create_map(*(x for w in sorted(set(words)) for x in (F.lit(w), F.array(*(F.lit(i) for i, v in enumerate(words) if v == w)))))
        at = rows.select("doc_id", "block_id", "field", "dl", F.explode(F.element_at(places, F.col("term"))).alias("i"), "positions").select("doc_id", "block_id", "field", "dl", "i", F.explode("positions").alias("p"))
        if not slop:
            starts = at.groupBy("doc_id", "block_id", "field", (F.col("p") - F.col("i")).alias("start")).agg(F.count(F.lit(1)).alias("n"), F.first("dl").alias("dl")).where(F.col("n") == len(words))
        else:
            shift = at.select("*", F.explode(F.sequence(F.lit(0), F.lit(slop))).alias("s")).withColumn("start", F.col("p") - F.col("i") - F.col("s"))
            best = shift.groupBy("doc_id", "block_id", "field", "start", "i").agg(F.min("s").alias("s"), F.first("dl").alias("dl"))
            starts = best.groupBy("doc_id", "block_id", "field", "start").agg(F.count(F.lit(1)).alias("n"), F.max("s").alias("s"), F.first("dl").alias("dl")).where((F.col("n") == len(words)) & (F.col("s") <= slop))
        return starts.groupBy("doc_id", "block_id", "field").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))

    def scores(self, query: str) -> DataFrame:
        """(doc_id, block_id, score) of every entry that meets the query."""
        group = parse_query(query)
        leaves = _leaves(group)
        number, found, negated = {}, None, set()
        for i, (leaf, boost, no) in enumerate(leaves):
            number[id(leaf)] = i
            if no:
                negated.add(i)
            rows = self._leaf(leaf, boost, i)
            if rows is not None:
                found = rows if found is None else found.unionByName(rows)
        if found is None:
            return self.entries.where("false").select("doc_id", "block_id", F.lit(0.0).alias("score"))
        counts = F.sum(F.when(F.col("leaf").isin(sorted(negated)), 0.0).otherwise(F.col("score")) if negated else F.col("score"))
        one = found.groupBy("doc_id", "block_id").agg(counts.alias("score"), F.collect_set("leaf").alias("hit"))
        return one.where(_holds(group, number)).select("doc_id", "block_id", "score")

    def search(self, query: str, limit: int = 20) -> DataFrame:
        """(doc_id, block_id, path, title, block_type, snippet, score), best
        first; ties by doc_id and block_id. Empty names are null."""
        top = self.scores(query).orderBy(F.desc(F.round("score", 9)), "doc_id", "block_id").limit(limit)
        met = top.join(self.entries, ["doc_id", "block_id"])
        words = sorted({w for leaf, _, no in _leaves(parse_query(query)) if not no for w in leaf.words})
        # one row: rare words count more
        rare = self.postings.where((F.col("field") == "content") & F.col("term").isin(words)).groupBy("term").agg((1 / (1 + F.count(F.lit(1)))).alias("w")).agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("rare"))
        met = met.crossJoin(F.broadcast(rare))
        empty = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
        out = met.select("doc_id", empty("block_id"), "path", empty("title"), empty("block_type"), snippet("content", "rare").alias("snippet"), F.col("score").cast("float").alias("score"), F.round("score", 9).alias("_s"), F.col("block_id").alias("_b"))
        return out.orderBy(F.desc("_s"), "doc_id", "_b").drop("_s", "_b")


_SPAN = re.compile(r"[^\W_]+")


def fragment(text: str, weight: dict[str, float], most: int = 150) -> str:
    """The part of a text that the words suit best, as HTML with the words in
    bold; all of the text where none is in it.

    The text is cut, from its begin on, into parts of whole words of ``most``
    bytes; a part counts the weights of its words, the first of the best is
    taken."""
    best, start, score, at, end, hits = (0.0, 0, 0, []), 0, 0.0, 0, 0, []
    size = 0  # bytes before ``at``
    begin = 0
    for m in _SPAN.finditer(text):
        word = m[0].lower()
        if len(word.encode()) > 40:
            continue
        first = size + len(text[at : m.start()].encode())
        last = first + len(m[0].encode())
        at, size = m.end(), last
        if last - begin > most:
            if score > best[0]:
                best = score, start, end, hits
            begin, start, score, hits = first, m.start(), 0.0, []
        end = m.end()
        if word in weight:
            score += weight[word]
            hits.append((m.start(), m.end()))
    if score > best[0]:
        best = score, start, end, hits
    if not best[0]:
        return text
    _, start, end, hits = best
    out, at = [], start
    for b, e in hits:
        out += [escape(text[at:b], quote=False), "<b>", escape(text[b:e], quote=False), "</b>"]
        at = e
    return "".join([*out, escape(text[at:end], quote=False)])


@F.pandas_udf(T.StringType())
def snippet(content: pd.Series, weight: pd.Series) -> pd.Series:
    """The best ``fragment`` of each text; for the rows of a result only."""
    return pd.Series([None if c is None else fragment(c, dict(w or ())) for c, w in zip(content, weight)])
