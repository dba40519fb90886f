"""Queries over positioned content, citations and streams.

The tables hold no page layouts, so order lines stand in as tokens on pages, and parts as boxes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import citations as ci
from ..operators import layout as la
from ..operators import links as li
from ..streaming import pages as sp
from .text_queries import read

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def tokens(spark, sf_dir) -> DataFrame:
    """Order lines as tokens: an order's hundred is its document, the line's number its page."""
    return read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey DIV 100 AS doc_id", "CAST(l_linenumber AS INT) AS page", "l_orderkey * 10 + l_linenumber AS token",
        "concat(l_returnflag, l_linestatus, CAST(l_suppkey AS STRING)) AS text", "CAST(8 + l_partkey % 5 AS DOUBLE) AS font_size",
        "l_returnflag = 'R' AS is_bold", "l_linestatus = 'O' AS is_italic", "l_partkey % 11 = 0 AS is_math", "CAST((l_suppkey % 3) * 90 AS DOUBLE) AS text_angle",
        "CAST(l_partkey % 500 AS DOUBLE) AS x1", "CAST(l_orderkey % 70 * 10 AS DOUBLE) AS y1", "CAST(l_partkey % 500 + 40 AS DOUBLE) AS x2", "CAST(l_orderkey % 70 * 10 + 9 AS DOUBLE) AS y2",
        "CAST(l_orderkey % 70 * 10 + 8 AS DOUBLE) AS baseline_y",
    )


TOKENS = """t AS (SELECT l_orderkey // 100 AS doc_id, CAST(l_linenumber AS INTEGER) AS page, l_orderkey * 10 + l_linenumber AS token,
  l_returnflag || l_linestatus || CAST(l_suppkey AS VARCHAR) AS text, (8 + l_partkey % 5)::DOUBLE AS font_size, l_returnflag = 'R' AS is_bold, l_linestatus = 'O' AS is_italic, l_partkey % 11 = 0 AS is_math,
  ((l_suppkey % 3) * 90)::DOUBLE AS text_angle, (l_partkey % 500)::DOUBLE AS x1, (l_orderkey % 70 * 10)::DOUBLE AS y1, (l_partkey % 500 + 40)::DOUBLE AS x2, (l_orderkey % 70 * 10 + 9)::DOUBLE AS y2 FROM lineitem)"""


def boxes(spark, sf_dir) -> DataFrame:
    """Parts as detections, ten on each page of seventy of a document."""
    return read(spark, sf_dir, "part").selectExpr(
        "p_partkey DIV 70 AS doc_id", "CAST(p_partkey % 7 + 1 AS INT) AS page", "CAST(p_partkey AS INT) AS item", "CAST(p_size % 11 AS INT) AS cls", "CAST((p_partkey * 37 % 100) / 100 AS DOUBLE) AS score",
        "CAST(p_partkey * 53 % 480 AS DOUBLE) AS x1", "CAST(p_partkey * 31 % 650 AS DOUBLE) AS y1", "CAST(p_partkey * 53 % 480 + 10 + p_size AS DOUBLE) AS x2", "CAST(p_partkey * 31 % 650 + 5 + p_size % 9 AS DOUBLE) AS y2",
    )


BOXES = """b AS (SELECT p_partkey // 70 AS doc_id, CAST(p_partkey % 7 + 1 AS INTEGER) AS page, CAST(p_partkey AS INTEGER) AS item, CAST(p_size % 11 AS INTEGER) AS cls, (p_partkey * 37 % 100) / 100.0::DOUBLE AS score,
  (p_partkey * 53 % 480)::DOUBLE AS x1, (p_partkey * 31 % 650)::DOUBLE AS y1, (p_partkey * 53 % 480 + 10 + p_size)::DOUBLE AS x2, (p_partkey * 31 % 650 + 5 + p_size % 9)::DOUBLE AS y2 FROM part)"""
INSIDE = "greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)) / greatest(1, ({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1))"


@query(f"WITH {TOKENS} SELECT doc_id, page, round(sum(font_size * length(text)) / greatest(1, sum(length(text))), 6) AS font_size, sum(CASE WHEN is_bold THEN length(text) ELSE 0 END) >= 0.5 * sum(length(text)) AS is_bold, sum(CASE WHEN is_italic THEN length(text) ELSE 0 END) >= 0.5 * sum(length(text)) AS is_italic FROM t GROUP BY 1, 2")
def block_styles(spark, sf_dir):
    return la.block_style(tokens(spark, sf_dir), la.PAGE).withColumn("font_size", F.round("font_size", 6))


@query(f"""
WITH {TOKENS}, s AS (SELECT doc_id, page, text_angle, sum(length(text)) AS n FROM t GROUP BY 1, 2, 3),
g AS (SELECT doc_id, page, sum(n) AS total, coalesce(max(n) FILTER (text_angle = 0), 0) AS n0, coalesce(max(n) FILTER (text_angle = 90), 0) AS n90, coalesce(max(n) FILTER (text_angle = 180), 0) AS n180 FROM s GROUP BY 1, 2)
SELECT doc_id, page, CAST(CASE WHEN greatest(n90, n180) >= 0.55 * total AND greatest(n90, n180) >= greatest(20, 1.5 * n0) THEN CASE WHEN n90 >= n180 THEN 90 ELSE 180 END ELSE 0 END AS INTEGER) AS rotation FROM g
""")
def page_rotations(spark, sf_dir):
    return la.rotation(tokens(spark, sf_dir))


@query(f"WITH {BOXES} SELECT doc_id, page, CAST(list_sort(list(x2 - x1))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS DOUBLE) AS body_font FROM b WHERE cls = 9 GROUP BY 1, 2 UNION ALL SELECT doc_id, page, 11.0::DOUBLE FROM b GROUP BY 1, 2 HAVING count(*) FILTER (cls = 9) = 0")
def body_fonts(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("font_size", F.col("x2") - F.col("x1")).withColumn("label", F.when(F.col("cls") == 9, "Text"))
    return la.body_font(b)


@query(f"""
WITH {BOXES}, d AS (SELECT doc_id, page, item, cls, least(greatest((x1 - 4) / 2, 0), 240) AS x1, least(greatest((y1 - 2) / 2, 0), 320) AS y1, least(greatest((x2 - 4) / 2, 0), 240) AS x2, least(greatest((y2 - 2) / 2, 0), 320) AS y2 FROM b WHERE score >= 0.2)
SELECT item, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, cls IN (2, 6, 8) AS is_visual FROM d WHERE x2 > x1 AND y2 > y1 AND cls NOT IN (4, 5)
""")
def detections(spark, sf_dir):
    n = lambda v: F.lit(float(v))
    d = la.decode_detections(boxes(spark, sf_dir), n(2), n(4), n(2), n(240), n(320))
    return d.select("item", *(F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")), F.col("label").isin(*la.VISUAL).alias("is_visual"))


@query(f"WITH {TOKENS}, {BOXES} SELECT token FROM t WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = t.doc_id AND b.page = t.page AND cls IN (2, 6, 8) AND {INSIDE.format(a='t', b='b')} >= 0.35)")
def tokens_outside_visuals(spark, sf_dir):
    v = boxes(spark, sf_dir).filter("cls in (2, 6, 8)")
    return la.exclude(tokens(spark, sf_dir), v).select("token")


@query(f"""
WITH {TOKENS}, {BOXES}, m AS (SELECT t.token, b.item, {INSIDE.format(a='t', b='b')} * 100 - sqrt(pow(greatest(0, b.x1 - t.x2, t.x1 - b.x2), 2) + pow(greatest(0, b.y1 - t.y2, t.y1 - b.y2), 2)) / greatest(1, t.font_size) AS fit
  FROM t JOIN b ON b.doc_id = t.doc_id AND b.page = t.page WHERE b.cls = 9)
SELECT token, item AS region FROM m QUALIFY row_number() OVER (PARTITION BY token ORDER BY fit DESC, item) = 1
""")
def token_regions(spark, sf_dir):
    r = boxes(spark, sf_dir).filter("cls = 9").withColumnRenamed("item", "region")
    return la.best_region(tokens(spark, sf_dir), r, ["token"]).select("token", "region")


@query()
def reading_order(spark, sf_dir):
    """Detections of each page in reading order; tested as a permutation and on cases."""
    b = boxes(spark, sf_dir).withColumn("label", F.lit("Text"))
    return la.ordered_detections(b).select("doc_id", "page", "item", "ord")


@query()
def page_rows(spark, sf_dir):
    return la.rows_of(tokens(spark, sf_dir)).select("doc_id", "page", "row", "text", "n_tokens")


@query(f"""
WITH {BOXES}, r AS (SELECT doc_id, page, 1 AS "table", row_number() OVER (PARTITION BY doc_id, page ORDER BY item) AS "row", y1, y2 FROM b),
c AS (SELECT doc_id, page, 1 AS "table", row_number() OVER (PARTITION BY doc_id, page ORDER BY item) AS "column", x1, x2 FROM b),
g AS (SELECT r.doc_id, r.page, r."row", c."column", x1, y1, x2, y2 FROM r JOIN c ON r.doc_id = c.doc_id AND r.page = c.page),
k AS (SELECT doc_id, page, CAST(item AS VARCHAR) AS text, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, x1, y1 FROM b)
SELECT g.doc_id, g.page, "row", "column", coalesce(array_to_string(list(k.text ORDER BY k.x1, k.y1, k.text), ' '), '') AS text
FROM g LEFT JOIN k ON k.doc_id = g.doc_id AND k.page = g.page AND k.x BETWEEN g.x1 AND g.x2 AND k.y BETWEEN g.y1 AND g.y2 GROUP BY 1, 2, 3, 4
""")
def table_cells(spark, sf_dir):
    from pyspark.sql import Window

    b = boxes(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("item"))
    r = b.select("doc_id", "page", F.lit(1).alias("table"), n.alias("row"), "y1", "y2")
    c = b.select("doc_id", "page", F.lit(1).alias("table"), n.alias("column"), "x1", "x2")
    t = b.withColumn("text", F.col("item").cast("string"))
    return la.reconstruct_table(la.grid(r, c), t).select("doc_id", "page", "row", "column", F.coalesce("text", F.lit("")).alias("text"))


def line_passages(spark, sf_dir) -> DataFrame:
    """Documents' lines as passages on pages of twenty lines, the first and last of a page at its edges."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    at = F.col("pos") % 20
    y1 = (at * 35 + 10).cast("double")
    box = F.struct(F.lit(50.0).alias("x1"), y1.alias("y1"), F.lit(500.0).alias("x2"), (y1 + 20).alias("y2"), F.lit(600.0).alias("page_width"), F.lit(720.0).alias("page_height"))
    return d.select("doc_id", "pos", "text", F.floor(F.col("pos") / 20).cast("int").alias("page"), F.lit(True).alias("pdf_text"), F.lit(None).cast("int").alias("heading_level"), F.when(F.col("pos") % 3 == 0, "Title").otherwise("Text").alias("layout_label"), box.alias("layout"))


@query(r"""
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
q AS (SELECT *, CAST(floor(pos / 20) AS INTEGER) AS page, (pos % 20) * 35 + 10 AS y1, (pos % 20) * 35 + 30 AS y2, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM p),
a AS (SELECT *, CASE WHEN y2 <= 720 * 0.12 THEN 'top' WHEN y1 >= 720 * 0.88 THEN 'bottom' ELSE '' END AS at_edge,
  lower(trim(regexp_replace(regexp_replace(flat, '(?i)^(?:\d{1,4}|[ivxlcdm]{1,8})\s+', ''), '(?i)\s+(?:\d{1,4}|[ivxlcdm]{1,8})$', ''))) AS bare FROM q),
k AS (SELECT *, CASE WHEN at_edge <> '' AND length(bare) BETWEEN 4 AND 240 THEN at_edge || ':' || bare END AS key FROM a),
r AS (SELECT doc_id, key FROM k WHERE key IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT page) >= 2)
SELECT doc_id, CAST(pos AS INTEGER) AS pos FROM k WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = k.doc_id AND r.key = k.key) AND NOT (at_edge <> '' AND pos % 3 <> 0 AND length(flat) BETWEEN 1 AND 120)
""")
def marginals_dropped(spark, sf_dir):
    return la.drop_marginals(line_passages(spark, sf_dir)).select("doc_id", "pos")


@query(r"""
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
q AS (SELECT doc_id, pos, CASE WHEN pos % 20 IN (0, 9, 18) THEN CAST(pos // 20 + 1 AS VARCHAR) ELSE line END AS text FROM p)
SELECT doc_id, CAST(pos AS INTEGER) AS pos FROM q WHERE regexp_matches(trim(regexp_replace(text, '\s+', ' ', 'g')), '(?i)^(?:\d{1,4}|[ivxlcdm]{1,8})$') AND ((pos % 20) * 35 + 30 <= 72 OR (pos % 20) * 35 + 10 >= 720 * 0.82)
""")
def page_numbers(spark, sf_dir):
    """Lines 1, 10 and 19 of each page are replaced by its number; only those at the edges count."""
    p = line_passages(spark, sf_dir).withColumn("text", F.when((F.col("pos") % 20).isin(0, 9, 18), (F.col("page") + 1).cast("string")).otherwise(F.col("text")))
    return p.filter(la.page_number_like(F.col("text"), F.col("layout.y1"), F.col("layout.y2"), F.lit(720.0))).select("doc_id", "pos")


@query(r"""
WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\b(Figure|Fig\.?|Table|Listing)\s+(\d+(?:\.\d+)*)([A-Za-z]?)\b')) AS mention FROM (SELECT doc_id, text || ' see Figure ' || CAST(doc_id % 9 AS VARCHAR) || 'a and Table 2.' AS text FROM documents))
SELECT doc_id, mention, CASE WHEN lower(mention) LIKE 'table%' THEN 'table' WHEN lower(mention) LIKE 'listing%' THEN 'listing' ELSE 'figure' END AS kind,
  CASE WHEN lower(mention) LIKE 'fig%' AND regexp_extract(mention, '\d+') IN ('1', '2', '3') THEN CAST(regexp_extract(mention, '\d+') AS INTEGER) WHEN lower(mention) LIKE 'table 2' THEN 102 END AS item FROM c
""")
def visual_mentions(spark, sf_dir):
    """Each document mentions a figure's part and a table; figures 1 to 3 and table 2 exist."""
    d = read(spark, sf_dir, "documents")
    p = d.select("doc_id", F.lit(0).alias("pos"), F.concat("text", F.lit(" see Figure "), (F.col("doc_id") % 9).cast("string"), F.lit("a and Table 2.")).alias("text"))
    v = d.select("doc_id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(n).alias("number"), F.lit(i).alias("item")) for k, n, i in (("figure", "1", 1), ("figure", "2", 2), ("figure", "3", 3), ("table", "2", 102))))).alias("v")).select("doc_id", "v.*")
    return ci.mentions(p, v).select("doc_id", "mention", "kind", "item")


@query()
def author_year_citations(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(" (Müller et al., 2020a; "), F.initcap(F.substring("source", 1, 3)), F.lit(" and Doe, 1999)")).alias("text"))
    return ci.author_years(d, ["doc_id"]).select("doc_id", "ord", "surname", "year", "key")


@query()
def text_links(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(li.link_spans_of("text")).alias("s")).select("doc_id", "s.start", "s.end", "s.label", "s.href")


@query()
def spoken_text(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(li.text_for_speech("text")).alias("spoken_md5"))


@query("SELECT conv_id AS job, count(*) AS pages, count(DISTINCT turn) AS once FROM conversations GROUP BY 1")
def stream_pages(spark, sf_dir):
    """Turns as page events of conversations, each sent twice: the stream delivers each once."""
    from ..session import work_path

    c = read(spark, sf_dir, "conversations").selectExpr("CAST(conv_id AS STRING) AS job", "CAST(turn AS INT) AS page", "0 AS page_count", "'page' AS event", "text")
    path = work_path(spark, "events")
    c.write.parquet(path)
    c.write.mode("append").parquet(path)
    out = sp.run_to_table(sp.once(sp.read_events(spark, path, files_per_batch=1000)), "delivered")
    return out.groupBy(F.col("job").cast("bigint").alias("job")).agg(F.count("*").alias("pages"), F.count_distinct("page").alias("once"))
