"""What an article's display, its summary and a transcript's article take from passages.

Passages have id_col, pos, type and text; tables have table_rows, rows of cells with text. Nulls count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col, escape_html, ws_trim
from ..functions.urls import host
from .links import text_for_speech

#: Languages of the browser's summaries; characters that a language is detected in, and of an excerpt.
SUMMARY_LANGUAGES, SAMPLE, EXCERPT = ("en", "fr", "de", "es", "ja"), 8000, 240


def _full(c: Column | str) -> Column:
    """The value, null where it is empty."""
    return F.nullif(F.coalesce(col(c), F.lit("")), F.lit(""))


def summary_parts(passages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per part that a summary reads: a passage's text, or each row of a table without one, its cells joined by bars.

    Parts are in spoken form and trimmed; empty ones are left out, so a document without any has no rows. id_col, pos, part (from 0), text.
    """
    cells = lambda r: F.array_join(F.filter(F.transform(r["cells"], lambda c: c["text"]), lambda t: F.coalesce(t, F.lit("")) != ""), " | ")
    none = F.array().cast("array<string>")
    rows = F.when(F.col("type") == "table", F.coalesce(F.transform("table_rows", cells), none)).otherwise(none)
    texts = F.when(_full("text").isNotNull(), F.array("text")).otherwise(F.filter(rows, lambda t: t != ""))
    parts = passages.select(id_col, "pos", F.posexplode(texts).alias("part", "_text"))
    return parts.select(id_col, "pos", "part", ws_trim(text_for_speech("_text")).alias("text")).filter("text <> ''")


def language_sample(parts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The start of a document's parts, joined by lines, that a detector judges."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "part", "text")))
    return parts.groupBy(id_col).agg(F.left(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n"), F.lit(SAMPLE)).alias("sample"))


def language(declared: Column | str, detected: Column | str | None = None) -> Column:
    """The declared language's primary part, lower-cased; else the detector's; else English."""
    own = _full(F.element_at(F.split(F.lower(F.coalesce(col(declared), F.lit(""))), "[-_]"), 1))
    found = F.lit(None).cast("string") if detected is None else _full(F.element_at(F.split(F.coalesce(col(detected), F.lit("")), "-"), 1))
    return F.coalesce(own, found, F.lit("en"))


def can_summarise(lang: Column | str) -> Column:
    """Whether the browser's summaries know the language."""
    return F.coalesce(col(lang).isin(*SUMMARY_LANGUAGES), F.lit(False))


def generated_text(text: Column | str, messages: Column | str) -> Column:
    """A generator's output: its text, else the last message's content; trimmed, empty if there is neither."""
    last = F.try_element_at(col(messages), F.lit(-1))["content"]
    return ws_trim(F.coalesce(col(text), last, F.lit("")))


def has_times(starts: Column | str) -> Column:
    """Whether any of the sentences' start times is a finite number; ``starts`` is an array of each passage's array."""
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))
    return F.coalesce(F.exists(F.flatten(F.filter(col(starts), lambda s: s.isNotNull())), finite), F.lit(False))


def shown_passages(passages: DataFrame, title: Column | str) -> DataFrame:
    """All but a first passage that is a heading equal to the title."""
    repeats = (F.col("pos") == 0) & (F.col("type") == "heading") & (F.col("text") == col(title))
    return passages.filter(~F.coalesce(repeats, F.lit(False)))


def first_headings(passages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The text of each document's first heading, one row per document that has a heading; combined before the exchange."""
    return passages.filter("type = 'heading'").groupBy(id_col).agg(F.min_by("text", "pos").alias("heading"))


def shown_title(title: Column | str, heading: Column | str, url: Column | str) -> Column:
    """The metadata's title, else the first heading, else the url's host."""
    return F.coalesce(_full(title), _full(heading), host(url))


def details(author: Column | str, site: Column | str, published: Column | str) -> Column:
    """Author, site and day, those that are there, with dots between."""
    return F.concat_ws(" · ", _full(author), _full(site), _full(F.left(col(published), F.lit(10))))


def transcript_article(passages: DataFrame, id_col: str = "video_id") -> DataFrame:
    """A transcript's passages as an article: content, text_content, length, excerpt; one row per video that has passages."""
    tag = F.when(F.col("type") == "heading", "h2").otherwise("p")
    text = F.coalesce("text", F.lit(""))
    html = F.concat(F.lit("<"), tag, F.lit(">"), escape_html(text), F.lit("</"), tag, F.lit(">"))
    own = passages.select(id_col, "pos", "type", text.alias("text"), html.alias("html"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "text", "html")))
    joined = lambda name: F.array_join(F.transform(ordered, lambda p: p[name]), "\n")
    first = F.min_by("text", F.when(F.col("type") == "paragraph", F.col("pos")))
    return own.groupBy(id_col).agg(
        joined("html").alias("content"), joined("text").alias("text_content"), F.sum(F.length("text")).alias("length"),
        F.coalesce(F.left(first, F.lit(EXCERPT)), F.lit("")).alias("excerpt"),
    )


def text_offsets(chunks: DataFrame, id_col: str = "video_id") -> DataFrame:
    """Where each chunk starts in its video's text, in which a space goes before a chunk once there is any text.

    Needs seq and text; adds text_offset. A video's chunks are ordered in one task, narrow but for their texts.
    """
    size = F.length(F.coalesce("text", F.lit("")))
    before = Window.partitionBy(id_col).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    gap = F.when(F.coalesce(F.sum(size).over(before), F.lit(0)) > 0, 1).otherwise(0)
    to = Window.partitionBy(id_col).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = chunks.withColumn("_gap", gap)
    offset = F.coalesce(F.sum(size).over(before), F.lit(0)) + F.sum("_gap").over(to)
    return marked.withColumn("text_offset", offset.cast("bigint")).drop("_gap")
