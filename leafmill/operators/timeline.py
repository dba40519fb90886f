"""As-of joins on timelines: the last entry at or before a time, or the first at or after.

The join never compares all pairs: clock and timeline are merged by a union that is sorted within
each key and span of time (one shuffle), and a window carries the last timeline entry along. What
comes from other spans is carried by a table of one row per key and span, so a key with most of the
rows is spread over its spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(clock: DataFrame, timeline: DataFrame, key: str, time: str, value: Column, tolerance: float = 0, forward: bool = False, span: float | None = None) -> DataFrame:
    """``clock`` with ``matched``: ``value`` (over timeline columns) of the last entry of the same key whose time is
    at most the clock's plus ``tolerance``; with ``forward`` the first at least the clock's time less ``tolerance``.
    ``span`` is the length of time that one window sees; without it a window sees all of a key."""
    kind = timeline.select(value.alias("v")).schema[0].dataType.simpleString()
    record = F.struct(*clock.columns)
    row_type = clock.select(record.alias("r")).schema[0].dataType
    cell = (lambda t: F.floor(t / span).cast("bigint")) if span else (lambda t: F.lit(0).cast("bigint"))
    entries = timeline.select(F.col(key).alias("_k"), F.col(time).cast("double").alias("_t"), F.struct(value.alias("v")).alias("_v")).withColumn("_cell", cell(F.col("_t")))
    asks = clock.select(F.col(key).alias("_k"), (F.col(time).cast("double") + (-tolerance if forward else tolerance)).alias("_t"), record.alias("_row")).withColumn("_cell", cell(F.col("_t")))
    # entries at the time of an ask stand on its side of it
    merged = entries.select("_k", "_cell", "_t", F.lit(1 if forward else 0).alias("_side"), "_v", F.lit(None).cast(row_type).alias("_row"))
    merged = merged.unionByName(asks.select("_k", "_cell", "_t", F.lit(0 if forward else 1).alias("_side"), F.lit(None).cast(f"struct<v:{kind}>").alias("_v"), "_row"))
    w = Window.partitionBy("_k", "_cell").orderBy("_t", "_side")
    if forward:
        found = F.first("_v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    else:
        found = F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = merged.withColumn("_found", found).filter("_row is not null")
    if span:
        edge = F.min_by if forward else F.max_by
        cells = entries.groupBy("_k", "_cell").agg(edge("_v", "_t").alias("_edge"))
        cells = cells.unionByName(asks.select("_k", "_cell").distinct().withColumn("_edge", F.lit(None).cast(f"struct<v:{kind}>"))).groupBy("_k", "_cell").agg(F.first("_edge", ignorenulls=True).alias("_edge"))
        order = Window.partitionBy("_k").orderBy("_cell")
        if forward:
            carried = F.first("_edge", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
        else:
            carried = F.last("_edge", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
        cells = cells.select("_k", "_cell", carried.alias("_carried"))
        out = out.join(cells, ["_k", "_cell"], "left").withColumn("_found", F.coalesce("_found", "_carried"))
    return out.select("_row.*", F.col("_found.v").alias("matched"))


def keep_outer(rows: DataFrame, key: str, start: str, end: str, *order: str) -> DataFrame:
    """Spans that begin at or after the end of every earlier span of their key, rejected ones included; longer first,
    of equal spans the first by the columns of ``order``. Spans without a start come last."""
    last = [F.col(c).asc_nulls_last() for c in order]
    w = Window.partitionBy(key).orderBy(F.col(start).asc_nulls_last(), F.col(end).desc_nulls_last(), *last).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_m", F.max(end).over(w)).filter(F.col("_m").isNull() | (F.col(start) >= F.col("_m"))).drop("_m")
