"""Mixing sources to target weights by systematic sampling.

Sources rank by code point, null last, and weigh WEIGHTS in turn. Their targets fill up like water: each gets its weight's
share of the total, none above CAP times its own size. Every document of a source has the same expected number of copies;
with prefix sums of that number along the source's documents, ordered by size, and one random offset, a document is emitted
once for each integer boundary that it crosses. As neighbours have nearly equal sizes, a source's words come within about
one document's size of its target.

Ranks come from counts, so mix_counts shuffles no text; mix has to bring texts and copies together, by doc_id. A source that holds most rows is only ever summed by (source, size) and by
blocks of ids within them, so no task needs a source's rows together; equal rows are one row with a count until the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.llm import storage

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
#: Rows of one block of ids, about; ranks within a block are counted together.
ID_BLOCK = 4096


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and 0x09-0x0D; null: 0."""
    squeezed = F.length(F.regexp_replace(text, r"[ \t-\r]*+[^ \t-\r]++[ \t-\r]*+", "w"))
    return F.when(text.rlike(r"[^ \t-\r]"), squeezed).otherwise(F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """Per source: source_size, target, rate (expected copies of a document) and the offset of its sampling."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("rk", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighed = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), ((F.col("rk") - 1) % len(weights) + 1).cast("int")))
    order = Window.orderBy((F.lit(cap).cast("long") * F.col("source_size")).cast("double") / F.col("weight"), "rk")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (
        weighed.withColumn("caps", F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(before), F.lit(0)))
        .withColumn("used", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("level", (F.col("all_size") - F.col("caps")).cast("double") / (F.col("all_weight") - F.col("used")))
        .withColumn("level", F.max("level").over(everything))
    )
    target = F.least((F.lit(cap) * F.col("source_size")).cast("double"), F.col("weight") * F.col("level"))
    return level.select(
        "source",
        "source_size",
        target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
        (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce("source", F.lit("\u0000")))), 1, 4), 16, 10).cast("double") / 65536.0).alias("offset"),
    )


def ranks(sizes: DataFrame) -> DataFrame:
    """One row per (source, size, doc_id) with its number of rows m and the number of rows before it in its source."""
    keys = ["source", "size", "block"]
    # Sparse ids get wide blocks: with one block a row, all rows of a size and source would be ranked in one task.
    seen = sizes.agg(F.count("*").alias("n"), (F.max("doc_id").cast("double") - F.min("doc_id").cast("double")).alias("span")).first()
    width = max(float(ID_BLOCK), (seen.span or 0.0) / max(1, seen.n // ID_BLOCK))
    units = sizes.groupBy("source", "size", "doc_id").agg(F.count("*").alias("m")).withColumn("block", F.floor(F.col("doc_id") / width))
    groups = units.groupBy(*keys).agg(F.sum("m").alias("n"))
    back = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    by_size = groups.groupBy("source", "size").agg(F.sum("n").alias("k")).withColumn("size_base", F.coalesce(F.sum("k").over(back("source").orderBy("size")), F.lit(0))).drop("k")
    s, g = by_size.alias("s"), groups.withColumn("block_base", F.coalesce(F.sum("n").over(back("source", "size").orderBy("block")), F.lit(0))).drop("n").alias("g")
    bases = g.join(s, F.col("s.source").eqNullSafe(F.col("g.source")) & F.col("s.size").eqNullSafe(F.col("g.size"))).select("g.*", "s.size_base").alias("b")
    inner = units.withColumn("in_block", F.coalesce(F.sum("m").over(back(*keys).orderBy("doc_id")), F.lit(0))).alias("u")
    on = [F.col(f"u.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return inner.join(bases, on[0] & on[1] & on[2]).select("u.source", "u.size", "u.doc_id", "u.m", (F.col("size_base") + F.col("block_base") + F.col("in_block")).alias("rank"))


def copies(rank: Column, cap: int = CAP) -> Column:
    """Integer boundaries crossed by the document of this rank."""
    edge = lambda r: F.floor(r * F.col("rate") + F.col("offset"))
    return F.least(edge(rank + 1) - edge(rank), F.lit(cap).cast("long")).cast("long")


def _planned(docs: DataFrame, weights, cap, seed) -> DataFrame:
    sizes = docs.select(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"))
    sizes = storage.staged(sizes, "mix-sizes")
    r, t = ranks(sizes).alias("r"), targets(sizes, weights, cap, seed).alias("t")
    return r.join(t, F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.*", "t.source_size", "t.target", "t.rate", "t.offset")


def mix_counts(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per document, repeated rows included.

    Null text has size 0; a null source is a source; null ids rank first. An empty table gives no rows. A source of size 0
    has target 0. Other columns of docs take no part.
    """
    each = _planned(docs, weights, cap, seed).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    return each.select("doc_id", "size", "source_size", "target", (copies(F.col("rank") + F.col("i"), cap) * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mixed documents: each row of docs as often as the mix takes it, with the columns of docs.

    Rows of one id, source and size share their copies, the odd ones by a hash of the text: reruns agree. Null ids and
    sources are ids and sources; a text without words is taken as its rank says, too. An empty table gives no rows.
    """
    names = docs.columns
    p = _planned(docs, weights, cap, seed).select(*[F.col(c).alias(f"__{c}") for c in ("source", "size", "doc_id", "m", "rank", "rate", "offset")])
    d = docs.withColumn("__words", word_count(F.col("text"))).withColumn("__hash", F.xxhash64("text"))
    joined = d.join(p, F.col("doc_id").eqNullSafe(F.col("__doc_id")) & F.col("__words").eqNullSafe(F.col("__size")) & F.col("source").eqNullSafe(F.col("__source")))
    # Only repeated rows need a number among their equals; the window runs in the join's own partitions and order.
    nth = F.when(F.col("__m") == 1, F.lit(0)).otherwise(F.row_number().over(Window.partitionBy("__doc_id", "__size", "__source").orderBy("__hash")) - 1)
    edge = lambda r: F.floor(r * F.col("__rate") + F.col("__offset"))
    first = F.col("__rank") + F.col("__nth")
    n = F.least(edge(first + 1) - edge(first), F.lit(cap).cast("long")).cast("int")
    return joined.withColumn("__nth", nth).withColumn("__n", n).where("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*names)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix_counts() of all documents."""
    return mix_counts(storage.read(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM p),
w AS (SELECT *, [{', '.join(map(str, WEIGHTS))}][(rk - 1) % {len(WEIGHTS)} + 1] AS weight FROM r),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum({CAP} * source_size) OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS lv
  FROM w WINDOW o AS (ORDER BY ({CAP} * source_size)::DOUBLE / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(({CAP} * source_size)::DOUBLE, weight * max(lv) OVER ()) AS target,
  ('0x' || substr(md5('{SEED}:' || coalesce(source, chr(0))), 1, 4))::BIGINT / 65536.0::DOUBLE AS off FROM l),
d AS (SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate, t.off,
  row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id NULLS FIRST) - 1 AS k FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(least(floor((k + 1) * rate + off) - floor(k * rate + off), {CAP}) * size AS BIGINT) AS taken FROM d
"""
