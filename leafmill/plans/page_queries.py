"""Queries that meet tokens, blocks and cells with boxes of their page, each with its SQL; order lines and parts stand in."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import page_joins as pj
from .layout_queries import BOXES, INSIDE, TOKENS, boxes, tokens
from .text_queries import read

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


@query("SELECT l_orderkey * 10 + l_linenumber AS line, l_orderkey % 100 >= 78 AND (l_suppkey % 4 = 0 OR l_suppkey % 4 = 1) AS is_number FROM lineitem")
def lower_margin_numbers(spark, sf_dir):
    rest = F.col("l_suppkey") % 4
    text = F.when(rest == 0, F.concat(F.lit(" "), (F.col("l_orderkey") % 9999).cast("string"))).when(rest == 1, "xIV ").when(rest == 2, "page 4")
    y1 = (F.col("l_orderkey") % 100).cast("double")
    return read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), pj.lower_margin_number(text, y1, F.lit(100.0)).alias("is_number"))


@query(f"""
WITH {TOKENS}, {BOXES} SELECT token FROM t SEMI JOIN b ON b.doc_id = t.doc_id AND b.page = t.page AND b.cls = 9 AND ({INSIDE.format(a="t", b="b")} >= 0.35
  OR (t.is_math AND (t.x1 + t.x2) / 2 BETWEEN b.x1 - greatest(2, t.font_size * 0.4::DOUBLE) AND b.x2 + greatest(2, t.font_size * 0.4::DOUBLE)
    AND t.y2 >= b.y1 - greatest(3, t.font_size * 1.15::DOUBLE) AND t.y1 <= b.y2 + greatest(3, t.font_size * 1.15::DOUBLE)))
""")
def region_tokens(spark, sf_dir):
    return pj.of_regions(tokens(spark, sf_dir), boxes(spark, sf_dir).filter("cls = 9")).select("token")


@query(f"""
WITH {TOKENS}, {BOXES}, k AS (SELECT *, CASE WHEN is_math THEN 'formula' ELSE 'text' END AS type FROM t)
SELECT token FROM k ANTI JOIN b ON b.doc_id = k.doc_id AND b.page = k.page AND k.type = 'text' AND (k.x1 + k.x2) / 2 BETWEEN b.x1 AND b.x2 AND (k.y1 + k.y2) / 2 BETWEEN b.y1 AND b.y2
""")
def blocks_outside_listings(spark, sf_dir):
    blocks = tokens(spark, sf_dir).withColumn("type", F.when(F.col("is_math"), "formula").otherwise("text"))
    return pj.outside_listings(blocks, boxes(spark, sf_dir)).select("token")


@query(f"""
WITH {TOKENS}, {BOXES} SELECT t.token, EXISTS (SELECT 1 FROM b WHERE b.doc_id = t.doc_id AND b.page = t.page AND b.cls < 4 AND {INSIDE.format(a="t", b="b")} >= 0.5) AS header FROM t
""")
def table_headers(spark, sf_dir):
    """Tokens stand in for cells, some classes of boxes for headers; a page is one table."""
    cells = tokens(spark, sf_dir).withColumn("table", F.lit(1))
    return pj.header_cells(cells, boxes(spark, sf_dir).filter("cls < 4").withColumn("table", F.lit(1))).select("token", "header")


@query(f"WITH {TOKENS} SELECT doc_id, page, y1, round(avg(font_size), 6) AS font_size, count(*) FILTER (is_bold) * 2 >= count(*) AS is_bold, count(*) FILTER (is_italic) * 2 >= count(*) AS is_italic FROM t GROUP BY 1, 2, 3")
def unclaimed_rows(spark, sf_dir):
    rows = pj.row_styles(tokens(spark, sf_dir), ["doc_id", "page", "y1"])
    return rows.withColumn("font_size", F.round("font_size", 6))


@query(f"""
WITH {BOXES}, e AS (SELECT * FROM b WHERE cls = 8 QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY item) = 1),
k AS (SELECT doc_id, page, item, x1 - 20 AS x1, y1 - 20 AS y1, x2 + 20 AS x2, y2 + 20 AS y2 FROM e),
r AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.item = b.item) AND NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = b.doc_id AND k.page = b.page AND {INSIDE.format(a="b", b="k")} >= 0.65))
SELECT doc_id, page, item, x1 FROM k UNION ALL SELECT doc_id, page, item, x1 FROM r
""")
def expanded_tables(spark, sf_dir):
    """Each page's first table is oblique and grows by twenty on each side."""
    b = boxes(spark, sf_dir)
    first = b.filter("cls = 8").groupBy("doc_id", "page").agg(F.min("item").alias("item"))
    grown = b.join(first, ["doc_id", "page", "item"]).withColumns({"x1": F.col("x1") - 20, "y1": F.col("y1") - 20, "x2": F.col("x2") + 20, "y2": F.col("y2") + 20})
    return pj.with_expanded_tables(b, first, grown).select("doc_id", "page", "item", "x1")


@query(f"""
WITH {BOXES}, k AS (SELECT doc_id, item, 'block ' || item AS text, (8 + item % 9)::DOUBLE AS font_size, cls, y1 FROM b WHERE page = 1),
f AS (SELECT * FROM k WHERE cls NOT IN (0, 1, 3) AND length(text) >= 8 AND font_size >= 10 * 1.3::DOUBLE AND y1 <= 800 * 0.4::DOUBLE)
SELECT doc_id, item, text FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CASE cls WHEN 10 THEN 0 ELSE 1 END, CASE cls WHEN 10 THEN 0 ELSE -font_size END, CASE cls WHEN 10 THEN 0 ELSE y1 END, item) = 1
""")
def first_page_titles(spark, sf_dir):
    from ..operators.layout import CLASSES

    label = F.element_at(F.array(*map(F.lit, CLASSES)), F.col("cls") + 1)
    text = F.concat(F.lit("block "), F.col("item").cast("string"))
    blocks = boxes(spark, sf_dir).withColumns({"label": label, "text": text, "type": F.lit("text"), "font_size": (F.col("item") % 9 + 8).cast("double"), "page_height": F.lit(800.0)})
    return pj.first_page_titles(blocks, F.lit(10.0), "item")
