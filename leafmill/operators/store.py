"""The keyed document store: reads, upserts, updates and deletes on a documents table.

The store is a DataFrame with a row per document. Writers return the new table; ``commit`` writes
it beside the old one and returns the path, so readers of the old table aren't disturbed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import document_id
from ..session import work_path


def by_key(store: DataFrame, key: str) -> DataFrame:
    return store.filter(F.col("doc_id") == key)


def by_url(store: DataFrame, url: str) -> DataFrame:
    return store.filter(F.col("doc_id") == document_id(F.lit(url)))


def recency() -> Column:
    """Last viewed, else updated, else 0."""
    return F.coalesce("last_viewed_at", "updated_at", F.lit(0))


def recent(store: DataFrame, limit: int = 100) -> DataFrame:
    """The most recent documents; ties by key. A bounded top-k: no full sort."""
    return store.filter("doc_id is not null").orderBy(recency().desc(), F.col("doc_id")).limit(limit)


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Of the rows of a key, the last in order, combined in each task before they shuffle."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def upsert(store: DataFrame, incoming: DataFrame, now: Column | int, fields: list[str] | None = None) -> DataFrame:
    """Merge documents by URL. Columns that ``incoming`` has overwrite, its nulls too; others stay.

    created_at keeps the first save, updated_at and last_viewed_at are set to ``now``. ``incoming``
    has at most one row a URL (see ``latest``).
    """
    at = F.lit(now) if isinstance(now, int) else now
    given = [c for c in (fields or incoming.columns) if c not in ("doc_id", "created_at", "updated_at", "last_viewed_at")]
    new = incoming.select(document_id("source_url").alias("doc_id"), F.struct(*given).alias("_new"))
    met = store.withColumn("_old", F.lit(True)).join(new, "doc_id", "full")
    kept = [c for c in store.columns if c not in (*given, "doc_id", "created_at", "updated_at", "last_viewed_at")]
    fresh = F.col("_new").isNotNull()
    pick = lambda c: F.when(fresh, F.col(f"_new.{c}")).otherwise(F.col(c) if c in store.columns else F.lit(None)).alias(c)
    stamp = lambda c: F.when(fresh, at).otherwise(F.col(c)).alias(c)
    return met.select("doc_id", *(pick(c) for c in given), *kept, F.coalesce("created_at", F.when(fresh, at)).alias("created_at"), stamp("updated_at"), stamp("last_viewed_at"))


def touch(store: DataFrame, keys: DataFrame, now: int) -> DataFrame:
    """last_viewed_at of the given keys (a doc_id column) set; keys without a document do nothing."""
    hit = keys.select("doc_id").distinct().withColumn("_hit", F.lit(True))
    return store.join(hit, "doc_id", "left").withColumn("last_viewed_at", F.when(F.col("_hit"), F.lit(now)).otherwise(F.col("last_viewed_at"))).drop("_hit").select(*store.columns)


def update(store: DataFrame, changes: DataFrame, now: int | None = None) -> DataFrame:
    """Set the columns of ``changes`` (one row a doc_id) on existing documents, and updated_at if ``now`` is given."""
    fields = [c for c in changes.columns if c != "doc_id"]
    met = store.join(changes.select("doc_id", F.struct(*fields).alias("_new")), "doc_id", "left")
    fresh = F.col("_new").isNotNull()
    for c in fields:
        met = met.withColumn(c, F.when(fresh, F.col(f"_new.{c}")).otherwise(F.col(c) if c in store.columns else F.lit(None)))
    if now is not None:
        met = met.withColumn("updated_at", F.when(fresh, F.lit(now)).otherwise(F.col("updated_at")))
    return met.drop("_new")


def remove(store: DataFrame, keys: DataFrame) -> DataFrame:
    return store.join(keys.select("doc_id").distinct(), "doc_id", "left_anti")


def clear(store: DataFrame) -> DataFrame:
    return store.limit(0)


def without_embeddings(store: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents that have no stored chunks yet."""
    return store.join(chunks.select("doc_id").distinct(), "doc_id", "left_anti")


def commit(store: DataFrame) -> str:
    path = work_path(store.sparkSession, "store")
    store.write.parquet(path)
    return path


def free_highlights(highlights: DataFrame, selections: DataFrame) -> DataFrame:
    """Selections with their action: delete if one of the passage's highlights overlaps, else add."""
    h = highlights.select("doc_id", "passage_index", F.col("start").alias("_s"), F.col("end").alias("_e"))
    met = selections.join(h, ["doc_id", "passage_index"], "left")
    over = (F.col("start") < F.col("_e")) & (F.col("end") > F.col("_s"))
    return met.filter("end > start").groupBy("doc_id", "passage_index", "start", "end").agg(F.when(F.bool_or(F.coalesce(over, F.lit(False))), "delete").otherwise("add").alias("action"))


def running_rank(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
