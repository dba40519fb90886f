"""Conversations: speaker labels, groups of one speaker's passages, and headings on change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse

#: The sites whose saved pages name speakers, and the names.
SITES = r"(?i)^(?:ChatGPT|Claude|Gemini|Grok)$"
SPEAKER = r"(?i)^(you|user|assistant|chatgpt|claude|gemini|grok)(?:\s+said)?$"


def decorate(passages: DataFrame, site: Column, doc: str = "doc_id") -> DataFrame:
    """chat_role, chat_group and chat_speaker of passages (type, text, pos) of the four known sites; others unchanged.

    A heading or paragraph that is a speaker's label leaves and begins a group, counted from 0; the
    label's name stands at the group's first passage only. Passages before any label carry nothing.
    """
    label = collapse(F.coalesce(F.col("text"), F.lit("")))
    name = F.when(site.rlike(SITES) & F.col("type").isin("heading", "paragraph"), F.nullif(F.regexp_extract(label, SPEAKER, 1), F.lit("")))
    own = F.lower("_name").isin("you", "user")
    title = F.when(own, "You").when(F.col("_name") == "chatgpt", "ChatGPT").otherwise(F.concat(F.upper(F.left("_name", F.lit(1))), F.substring("_name", 2, 100)))
    w = Window.partitionBy(doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = passages.withColumn("_name", name).withColumn("_group", F.sum(F.when(F.col("_name").isNotNull(), 1).otherwise(0)).over(w) - 1)
    rows = rows.withColumn("_who", F.last(F.when(F.col("_name").isNotNull(), F.struct(F.when(own, "user").otherwise("assistant").alias("role"), title.alias("speaker"))), ignorenulls=True).over(w)).filter("_name is null")
    first = F.row_number().over(Window.partitionBy(doc, "_group").orderBy("pos")) == 1
    inside = F.col("_group") >= 0
    rows = rows.withColumn("chat_role", F.when(inside, F.col("_who.role"))).withColumn("chat_group", F.when(inside, F.col("_group")).cast("int")).withColumn("chat_speaker", F.when(inside & first, F.col("_who.speaker")))
    return rows.drop("_name", "_group", "_who")


def turn_groups(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """chat_group of typed turns (turn, role): a new group when the role changes; system turns begin none and carry null."""
    speaking = turns.filter("role in ('user', 'assistant')")
    w = Window.partitionBy(conv).orderBy("turn")
    change = F.when(F.lag("role").over(w).eqNullSafe(F.col("role")), 0).otherwise(1)
    grouped = speaking.withColumn("_change", change).withColumn("chat_group", (F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("bigint"))
    first = F.col("_change") == 1
    grouped = grouped.withColumn("chat_speaker", F.when(first & (F.col("role") == "user"), "You").when(first, "Assistant")).drop("_change")
    rest = turns.filter("role is null or role not in ('user', 'assistant')").withColumn("chat_group", F.lit(None).cast("bigint")).withColumn("chat_speaker", F.lit(None).cast("string"))
    return grouped.unionByName(rest)
