"""Mixing sources to target weights by systematic sampling.

Within a source, documents stand in order of size and id; each expects target / source size
copies. The prefix sums of these expectations plus one random offset a source cross integers, and
a document is emitted once for each integer that its own step crosses. After any number of
documents the copies differ from their expectation by less than one; in order of size, the words
taken of a source so differ from its target by less than its longest document's. Prefix sums come
from global row numbers, so no source, however large, is gathered in one task.

Defined cases: a null or empty text has size 0; null sources form one source, last in order; a
source without words keeps each document once (its rate is 1); rows repeated in id are separate
rows; an empty table gives no rows; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ._spark import Scratch, global_row_number, join_groups, join_small, key_filter, with_membership

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: A target is at most so many times its source's size.
MOST = 3
SEED = "leafmill-mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: _source, docs, source_size in; target and first (rows of earlier sources) added.

    Targets share the total by weight; those above ``most`` sizes stop there and the excess is
    shared again until none is above. In order of size / weight the stopped sources come first,
    so running sums give, for each possible number of stopped sources, the share of the rest.
    This table has a row per source, not per document.
    """
    by_name = Window.orderBy(F.col("_source").isNull(), "_source")
    t = sources.withColumn("_k", F.row_number().over(by_name) - 1)
    t = t.withColumn("first", F.coalesce(F.sum("docs").over(by_name.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("_w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_k") % len(weights) + 1).cast("int")))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("_w"), "_k")
    before, after, all_ = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    t = t.withColumn("_share", (F.sum("source_size").over(all_) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("_w").over(after))
    # The share only grows along the order; the first source that isn't above its stop sets it for all later ones.
    t = t.withColumn("_free", F.col("_share") * F.col("_w") <= most * F.col("source_size"))
    t = t.withColumn("_share", F.min(F.when(F.col("_free"), F.struct(F.col("source_size") / F.col("_w"), "_k", "_share"))).over(all_)["_share"])
    target = F.least(F.coalesce(F.col("_share") * F.col("_w"), F.lit(float("inf"))), most * F.col("source_size").cast("double"))
    return t.withColumn("target", target).select("_source", "docs", "source_size", "target", "first")


def offset(key: Column, seed: str = SEED) -> Column:
    """The random offset in [0, 1) of a source."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), key)), 1, 8), 16, 10).cast("double") / 4294967296.0


def copies(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """One row per document: _id, _source, size, source_size, target, copies. Texts don't shuffle."""
    narrow = docs.select(docs[f"`{id_col}`"].alias("_id"), docs[f"`{source_col}`"].alias("_source"), words(docs[f"`{text_col}`"]).alias("size"))
    order = [F.col("_source").isNull().asc(), F.col("_source").asc(), F.col("size").asc(), F.col("_id").asc_nulls_last()]
    placed = scratch.save(global_row_number(narrow, order, scratch), "placed")
    targets = scratch.save(source_targets(placed.groupBy("_source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))), "targets")
    key = F.coalesce(F.concat(F.lit("+"), "_source"), F.lit("-"))
    met = join_small(placed.withColumn("_key", key), targets.withColumn("_key", key).drop("_source"), "_key", "inner")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    met = met.withColumn("_rate", rate).withColumn("_i", (F.col("row_number") - F.col("first")).cast("double"))
    u = offset(F.col("_key"), seed)
    crossed = F.floor((F.col("_i") + 1.0) * F.col("_rate") + u) - F.floor(F.col("_i") * F.col("_rate") + u)
    met = met.withColumn("copies", F.least(crossed, F.lit(MOST)).cast("bigint"))
    return met.select("_id", "_source", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The documents, each emitted as often as the mix takes it, with all their columns.

    Most documents of a source are taken equally often, its usual number; by a bitmap filter only the
    others' rows shuffle. Rows alike in id, source and size take the mean of their copies, and the
    remainder goes to some of them, so that the sum is the same; they are numbered globally, so rows
    that repeat in any number don't meet in one task.
    """
    counts = scratch.save(copies(docs, scratch, id_col, text_col, source_col, seed), "copies")
    key = F.md5(F.to_json(F.struct(F.col("_id").cast("string").alias("a"), F.col("_source").alias("b"), F.col("size").alias("c"))))
    name = F.coalesce(F.concat(F.lit("+"), "_source"), F.lit("-")).alias("_name")
    usual = counts.groupBy(name, "copies").agg(F.count("*").alias("_n")).groupBy("_name").agg(F.max(F.struct("_n", "copies"))["copies"].alias("_usual"))
    usual = scratch.save(usual, "usual")
    sums = counts.groupBy(key.alias("_key"), name).agg(F.count("*").alias("_rows"), F.sum("copies").alias("_copies"))
    odd = join_small(sums, usual, "_name").filter("_copies != _rows * _usual").select("_key", "_rows", "_copies")
    odd = scratch.save(odd, "odd")
    filter_, bits = key_filter(odd, F.col("_key"), odd.count())
    filter_ = scratch.save(filter_, "filter")
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row")
    keyed = docs.select(row, docs[f"`{id_col}`"].alias("_id"), docs[f"`{source_col}`"].alias("_source"), words(docs[f"`{text_col}`"]).alias("size"))
    keyed = join_small(keyed.select("_row", key.alias("_key"), name), usual, "_name").drop("_name")
    flagged = with_membership(keyed, F.col("_key"), filter_, bits, "_maybe")
    plain = flagged.filter("not _maybe").select("_row", F.col("_usual").alias("_n"))
    met = join_groups(flagged.filter("_maybe").drop("_maybe"), odd, "_key", "_rows", counts.count())
    alone = met.filter("_rows is null or _rows = 1").select("_row", F.coalesce("_copies", "_usual").alias("_n"))
    every = plain.unionByName(alone)
    if odd.filter("_rows > 1").limit(1).count():
        # Of rows alike, the r-th takes floor((r + 1) c / n) - floor(r c / n) copies.
        many = scratch.save(global_row_number(met.filter("_rows > 1"), [F.col("_key").asc()], scratch), "alike")
        first = many.groupBy("_key").agg(F.min("row_number").alias("_first"), F.count("*").alias("_alike"))
        many = join_groups(many, first, "_key", "_alike", counts.count()).withColumn("_r", F.col("row_number") - F.col("_first"))
        step = lambda r: F.floor(r * F.col("_copies") / F.col("_rows"))
        every = every.unionByName(many.select("_row", (step(F.col("_r") + 1) - step(F.col("_r"))).alias("_n")))
    every = every.filter("_n > 0")
    return every.select("_row", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select("_row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = copies(docs, Scratch(spark))
    return out.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END AS w
  FROM (SELECT source, count(*) AS docs, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
r AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM s),
l AS (SELECT arg_min(share, source_size / w) AS share FROM r WHERE share * w <= 3 * source_size),
t AS (SELECT s.source, source_size, least(coalesce((SELECT share FROM l) * w, 'inf'::DOUBLE), 3 * source_size::DOUBLE) AS target FROM s),
n AS (SELECT d.doc_id, d.source, d.size, row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS LAST) - 1.0::DOUBLE AS i FROM d),
x AS (
  SELECT n.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 1.0::DOUBLE END AS rate
  FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source),
o AS (SELECT source, CAST('0x' || substr(md5('leafmill-mix-1/' || coalesce('+' || source, '-')), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS u FROM t),
c AS (
  SELECT x.*, CAST(least(floor((i + 1.0::DOUBLE) * rate + u) - floor(i * rate + u), 3) AS BIGINT) AS copies
  FROM x JOIN o ON x.source IS NOT DISTINCT FROM o.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""

QUERIES = {"op9_mixing": op9_mixing}
ORACLES = {"op9_mixing": SQL}
