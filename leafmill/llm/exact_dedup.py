"""Exact dedup by two-pass Bloom filtering, in DataFrame functions alone.

Pass one counts the cells of a Bloom filter: every hash hits two cells, counters are added up in
each task before the exchange, and the cells hit at least twice are packed in bitmaps of fixed
size. Pass two tests every row against the bitmaps. Only rows both of whose cells were hit again
shuffle; the rest are proven unique and pass straight through. Beyond the filter's capacity the
hashes are dealt to several rounds of filters, so no broadcast exceeds 32 MiB.

Defined cases: a null text counts as empty, empty texts equal each other, null ids order last,
rows repeated in id and text form a group of which one stays, an empty table gives no rows, extra
columns are kept by ``dedup`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import MAX_BITS, Scratch, bitmap, cell, filter_bits, join_groups, with_membership

#: The characters [\x20\x09-\x0D], which don't count.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
PER_KEY = 16


def text_sha256(text: Column) -> Column:
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), SPACES, ""), 256)


def _flag_repeats(rows: DataFrame, hashes: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """Add _maybe to rows: whether the hash in _sha may occur twice in ``hashes`` (never false if it does)."""
    rounds = max(1, -(-n * PER_KEY // (1 << MAX_BITS)))
    bits = filter_bits(-(-n // rounds), PER_KEY)
    turn = F.pmod(F.xxhash64("_sha", F.lit(-1)), F.lit(rounds))
    out = None
    for r in range(rounds):
        own = (lambda d, r=r: d if rounds == 1 else d.filter(turn == r))
        cells = own(hashes).select(F.explode(F.array(*(cell(F.col("_sha"), k, bits) for k in (0, 1)))).alias("cell"))
        again = cells.groupBy("cell").agg(F.count("*").alias("_hits")).filter("_hits > 1")
        filter_ = scratch.save(bitmap(again), "repeats")
        part = with_membership(own(rows), F.col("_sha"), filter_, bits, "_maybe")
        out = part if out is None else out.unionByName(part)
    return out


def _better(*more: str) -> Column:
    """Least for the row that stays: most code points, then smallest id, nulls last."""
    return F.struct(-F.col("_n"), F.col("_id").isNull(), "_id", *more)


def exact_groups(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256. Texts are read once and never shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("_id"), text_sha256(F.col(text_col)).alias("_sha"), F.length(text).alias("_n"), F.monotonically_increasing_id().alias("_uid"))
    narrow = scratch.save(narrow, "hashes")
    n = narrow.count()
    flagged = scratch.save(_flag_repeats(narrow, narrow, n, scratch), "flagged")
    maybe = flagged.filter("_maybe").drop("_maybe")
    groups = maybe.groupBy("_sha").agg(F.min(_better("_uid")).alias("_best"), F.count("*").alias("group_size")).filter("group_size > 1")
    groups = scratch.save(groups.select("_sha", F.col("_best._id").alias("_keep"), F.col("_best._uid").alias("_keep_uid"), "group_size"), "groups")
    met = join_groups(maybe, groups, "_sha", "group_size", n)
    alone = flagged.filter("not _maybe").drop("_maybe").select("_sha", "_id", "_n", "_uid", F.lit(None).cast(groups.schema["_keep"].dataType).alias("_keep"), F.lit(None).cast("bigint").alias("_keep_uid"), F.lit(None).cast("bigint").alias("group_size"))
    every = met.select(*alone.columns).unionByName(alone)
    single = F.col("group_size").isNull()
    return every.select(
        F.col("_id").alias(id_col),
        F.when(single, F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (single | (F.col("_uid") == F.col("_keep_uid"))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def dedup(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. Copies of one text are combined in each task before they shuffle."""
    keyed = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row"), docs[id_col].alias("_id"), docs[text_col].alias("_text")).select("_row", "_id", text_sha256(F.col("_text")).alias("_sha"), F.length(F.coalesce("_text", F.lit(""))).alias("_n"))
    hashes = scratch.save(keyed.select("_sha"), "hashes")
    flagged = _flag_repeats(keyed, hashes, hashes.count(), scratch)
    best = F.struct(-F.col("_n"), F.col("_id").isNull(), "_id", F.col(f"_row.`{text_col}`"))
    kept = flagged.filter("_maybe").groupBy("_sha").agg(F.min_by("_row", best).alias("_row"))
    return flagged.filter("not _maybe").select("_row").unionByName(kept.select("_row")).select("_row.*")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), Scratch(spark))


SQL = r"""
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size,
         row_number() OVER w AS rn
  FROM (SELECT doc_id, length(coalesce(text, '')) AS n,
               sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
  WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST))
"""

QUERIES = {"op4_exact_dedup": op4_exact_dedup}
ORACLES = {"op4_exact_dedup": SQL}
