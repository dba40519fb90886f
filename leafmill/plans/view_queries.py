"""Queries over what is displayed, summarised and composed of passages, each with its SQL; turns of conversations stand in
for passages, pages and documents for articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import views
from .article_queries import TURNS, turns
from .text_queries import read

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def passages(spark, sf_dir) -> DataFrame:
    """Each conversation's turns as passages in order: its user turns are headings, some of the others are tables."""
    t = turns(spark, sf_dir).select("conv_id", F.col("turn").alias("pos"), "role", "plain")
    kind = F.when(F.col("role") == "user", "heading").when(F.col("pos") % 4 == 3, "table").otherwise("paragraph")
    row = lambda *cells: F.struct(F.array(*(F.struct(c.alias("text")) for c in cells)).alias("cells"))
    rows = F.array(row(F.col("plain"), F.lit(""), F.lit("end")), row(F.lit(""), F.lit(None).cast("string")))
    table = kind == "table"
    return t.select("conv_id", "pos", kind.alias("type"), F.when(~table, F.col("plain")).alias("text"), F.when(table, rows).alias("table_rows"))


PASSAGES = f"""{TURNS},
p AS (SELECT conv_id, turn AS pos, plain, CASE WHEN role = 'user' THEN 'heading' WHEN turn % 4 = 3 THEN 'table' ELSE 'paragraph' END AS type FROM t),
x AS (SELECT conv_id, pos, type, CASE WHEN type <> 'table' THEN plain END AS text, plain FROM p)"""
PARTS = f"{PASSAGES}, s AS (SELECT conv_id, pos, CAST(0 AS INTEGER) AS part, CASE WHEN type <> 'table' THEN plain WHEN plain = '' THEN 'end' ELSE plain || ' | end' END AS text FROM p WHERE type = 'table' OR plain <> '')"


@query(f"WITH {PARTS} SELECT * FROM s")
def summary_sources(spark, sf_dir):
    return views.summary_parts(passages(spark, sf_dir), "conv_id")


@query(f"WITH {PARTS} SELECT conv_id, left(string_agg(text, chr(10) ORDER BY pos, part), 8000) AS sample FROM s GROUP BY conv_id")
def language_samples(spark, sf_dir):
    return views.language_sample(views.summary_parts(passages(spark, sf_dir), "conv_id"), "conv_id")


@query("""
WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN upper(lang) || '-XX' WHEN 1 THEN lang || '_yy' WHEN 2 THEN '' END AS declared, CASE WHEN doc_id % 8 < 4 THEN 'ja-JP' END AS detected, lang FROM documents),
l AS (SELECT doc_id, CASE WHEN doc_id % 4 < 2 AND lang <> '' THEN lower(lang) WHEN detected IS NOT NULL THEN 'ja' ELSE 'en' END AS language FROM d)
SELECT doc_id, language, language IN ('en', 'fr', 'de', 'es', 'ja') AS can_summarise FROM l
""")
def summary_languages(spark, sf_dir):
    rest = F.col("doc_id") % 4
    declared = F.when(rest == 0, F.concat(F.upper("lang"), F.lit("-XX"))).when(rest == 1, F.concat("lang", F.lit("_yy"))).when(rest == 2, "")
    detected = F.when(F.col("doc_id") % 8 < 4, "ja-JP")
    d = read(spark, sf_dir, "documents").select("doc_id", views.language(declared, detected).alias("language"))
    return d.withColumn("can_summarise", views.can_summarise("language"))


@query(f"""
WITH {TURNS} SELECT key, CASE turn % 3 WHEN 0 THEN plain WHEN 1 THEN plain ELSE '' END AS output FROM t
""")
def generated_outputs(spark, sf_dir):
    """Outputs as text, as messages, or neither."""
    t, rest = turns(spark, sf_dir), F.col("turn") % 3
    message = lambda c: F.struct(F.lit("assistant").alias("role"), c.alias("content"))
    messages = F.when(rest == 1, F.array(message(F.lit("first")), message(F.concat(F.lit(" \n"), "plain", F.lit("\t")))))
    return t.select("key", views.generated_text(F.when(rest == 0, F.concat(F.lit("  "), "plain")), messages).alias("output"))


@query("SELECT event_id, event_id % 3 = 0 AS timed FROM events")
def timed_passages(spark, sf_dir):
    """Events' values as sentences' starts of two passages; others hold no number."""
    e = read(spark, sf_dir, "events")
    start = F.when(F.col("event_id") % 3 == 0, F.lit(1.5)).when(F.col("event_id") % 3 == 1, F.lit(float("nan")))
    return e.select("event_id", views.has_times(F.array(F.lit(None).cast("array<double>"), F.array(F.lit(float("inf")), start))).alias("timed"))


@query(f"WITH {PASSAGES}, f AS (SELECT conv_id, min_by(plain, pos) AS title FROM p GROUP BY conv_id) SELECT conv_id, pos, type FROM x JOIN f USING (conv_id) WHERE NOT coalesce(pos = 0 AND type = 'heading' AND text = title, false)")
def passages_without_title(spark, sf_dir):
    """The first turn's words stand in for the title."""
    p = passages(spark, sf_dir)
    titles = turns(spark, sf_dir).groupBy("conv_id").agg(F.min_by("plain", "turn").alias("title"))
    return views.shown_passages(p.join(titles, "conv_id"), "title").select("conv_id", "pos", "type")


@query(f"WITH {PASSAGES}, h AS (SELECT conv_id, min_by(text, pos) AS heading FROM x WHERE type = 'heading' GROUP BY conv_id), c AS (SELECT DISTINCT conv_id FROM t) SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'Title' WHEN coalesce(heading, '') <> '' THEN heading ELSE 'example.org' END AS title, CASE WHEN conv_id % 2 = 0 THEN 'A · S · 2024-05-06' ELSE 'S' END AS details FROM c LEFT JOIN h USING (conv_id)")
def shown_titles(spark, sf_dir):
    p = passages(spark, sf_dir)
    met = p.select("conv_id").distinct().join(views.first_headings(p, "conv_id"), "conv_id", "left")
    title, even = F.when(F.col("conv_id") % 3 == 0, "Title").when(F.col("conv_id") % 3 == 1, ""), F.col("conv_id") % 2 == 0
    shown = views.shown_title(title, "heading", F.lit("https://example.org/a"))
    day = F.when(even, "2024-05-06T07:08:09Z")
    return met.select("conv_id", shown.alias("title"), views.details(F.when(even, "A").otherwise(""), F.lit("S"), day).alias("details"))


@query(f"""
WITH {PASSAGES}, y AS (SELECT conv_id, pos, type, coalesce(text, '') AS text, CASE type WHEN 'heading' THEN 'h2' ELSE 'p' END AS tag FROM x)
SELECT conv_id, md5(string_agg('<' || tag || '>' || text || '</' || tag || '>', chr(10) ORDER BY pos)) AS content_md5, md5(string_agg(text, chr(10) ORDER BY pos)) AS text_md5,
  CAST(sum(length(text)) AS BIGINT) AS length, coalesce(left(min_by(text, pos) FILTER (type = 'paragraph'), 240), '') AS excerpt FROM y GROUP BY conv_id
""")
def transcript_articles(spark, sf_dir):
    a = views.transcript_article(passages(spark, sf_dir), "conv_id")
    return a.select("conv_id", F.md5("content").alias("content_md5"), F.md5("text_content").alias("text_md5"), "length", "excerpt")


@query(f"""
WITH {TURNS}, a AS (SELECT conv_id, turn, plain, coalesce(string_agg(plain, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS head FROM t),
b AS (SELECT conv_id, turn, length(head) + CAST(sum(CASE WHEN head <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS text_offset FROM a)
SELECT conv_id, turn, CAST(text_offset AS BIGINT) AS text_offset FROM b
""")
def chunk_offsets(spark, sf_dir):
    chunks = turns(spark, sf_dir).select("conv_id", "turn", F.col("turn").alias("seq"), F.col("plain").alias("text"))
    return views.text_offsets(chunks, "conv_id").select("conv_id", "turn", "text_offset")
