"""Markdown rendered from the provided relational tables: (path, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mdlake.operators.shared import spread

_FENCE = "```"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frontmatter (a title for even keys only), two headings, a paragraph, a
    code block and a list with a link."""
    return _read(spark, sf_dir, "part").selectExpr(
        "concat('part/', p_partkey, '.md') AS path",
        f"""concat('---\\n', IF(p_partkey % 2 = 0, concat('title: ', p_name, '\\n'), ''), 'brand: "', p_brand, '"\\nsize: ', p_size, '\\ntags:\\n  - ', p_type, '\\n  - "', p_brand, '"\\n---\\n',
        '# Part ', p_name, '\\n\\nA **', p_name, '** of size *', p_size, '*.\\n\\n## Query\\n\\n{_FENCE}sql\\nSELECT ', p_partkey, ';\\n{_FENCE}\\n\\n- type ', p_type, '\\n- by [', p_type, '](brand/', replace(p_brand, '#', '-'), ')\\n') AS content""",
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers link to their nation (wiki links) and segment, nations to their
    region."""
    nation, region = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("nation", "region"))
    customer = _read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    own = customer.selectExpr("concat('customer/', c_custkey) AS path", "concat('# ', replace(c_name, '#', '-'), '\\n\\nLives in [[nation/', n_name, '|', n_name, ']], buys for [', c_mktsegment, '](segment/', c_mktsegment, ').\\n') AS content")
    of = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).selectExpr("concat('nation/', n_name) AS path", "concat('# ', n_name, '\\n\\nPart of [[region/', r_name, ']].\\n') AS content")
    top = region.selectExpr("concat('region/', r_name) AS path", "concat('# ', r_name, '\\n') AS content")
    return own.unionByName(of).unionByName(top)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heading per conversation and per turn, the texts as code."""
    rows = _read(spark, sf_dir, "conversations").selectExpr("conv_id", "struct(turn, concat('## Turn ', turn, '\\n\\n~~~~ ', coalesce(role, ''), '\\n', coalesce(text, ''), '\\n~~~~\\n\\n') AS part) AS t")
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts")).selectExpr("concat('conversation/', conv_id, '.md') AS path", "concat('# Conversation ', conv_id, '\\n\\n', array_join(transform(ts, t -> t.part), '')) AS content")



def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of block, link and extension for each nation, and a document of
    3,000 quotes inside of each other."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr(
        "concat('kinds/', n_nationkey, '.md') AS path",
        f"""concat('# Kinds of ', n_name, '\\n\\n| a | b |\\n|---|---|\\n| ', n_name, ' | ', n_nationkey, ' |\\n\\n> Quoted ', n_name, '\\n\\n---\\n\\n<div>', n_name, '</div>\\n\\n- [x] done ', n_name, '\\n- [ ] todo\\n\\n',
        '![map](img/', n_nationkey, '.png) <https://x.org/', n_nationkey, '> http://y.org/', n_nationkey, ' ~~old~~ *text*[^f]\\n\\nUnder ', n_name, '\\n------\\n\\n{_FENCE}py\\nx = ', n_nationkey, '\\n{_FENCE}\\n\\n[^f]: Note on ', n_name, '\\n') AS content""",
    )
    return rows.unionByName(spark.createDataFrame([("kinds/deep.md", ">" * 3000 + " x")], rows.schema))
