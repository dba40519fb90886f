"""Blocks, tokens and cells of pages met with boxes of the same page, and choices among a document's blocks.

Boxes are columns x1, y1, x2, y2; rows belong to a page by doc_id and page. A box that lacks a coordinate meets nothing.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.text import col, collapse, ws_trim
from .layout import PAGE, contain, per_page

#: What a page number looks like; glyphs of radicals and scalable operators; labels that hold no title.
NUMBER = r"(?i)^(?:\d{1,4}|[ivxlcdm]{1,8})$"
MATH_GLYPHS = "[√∛∜∫∮∑∏]"
NO_TITLE = ("Caption", "Footnote", "List-item")

BOX = ("x1", "y1", "x2", "y2")


def box(prefix: str = "") -> Column:
    """The four columns as a struct."""
    return F.struct(*(F.col(f"{prefix}{c}").alias(c) for c in BOX))


def share_in(inner: Column, outer: Column) -> Column:
    """The share of ``inner`` in ``outer``; none if either lacks a coordinate."""
    whole = [b[c].isNotNull() for b in (inner, outer) for c in BOX]
    return F.when(reduce(and_, whole), geo.containment(inner, outer)).otherwise(0.0)


def lower_margin_number(text: Column | str, y1: Column | str, page_height: Column | str) -> Column:
    """Whether a text block is a page number by itself, in the lowest 22 % of its page."""
    low = (col(page_height) > 0) & (col(y1) >= col(page_height) * 0.78)
    return F.coalesce(ws_trim(F.coalesce(col(text), F.lit(""))).rlike(NUMBER) & low, F.lit(False))


def belongs(token: Column, region: Column, font_size: Column, is_math: Column, text: Column) -> Column:
    """Whether a token is of a text region: 0.35 of it lies inside, or it is a mathematical glyph close by, measured by its font."""
    beside, above = F.greatest(F.lit(2.0), font_size * 0.4), F.greatest(F.lit(3.0), font_size * 1.15)
    middle = (token["x1"] + token["x2"]) / 2
    near = middle.between(region["x1"] - beside, region["x2"] + beside)
    near = near & (token["y2"] >= region["y1"] - above) & (token["y1"] <= region["y2"] + above)
    math = F.coalesce(is_math, F.lit(False)) | F.coalesce(text, F.lit("")).rlike(MATH_GLYPHS)
    return (share_in(token, region) >= 0.35) | (math & near)


def of_regions(tokens: DataFrame, regions: DataFrame) -> DataFrame:
    """Tokens that belong to any text region of their page, once each; tokens need text, font_size and is_math."""
    t = tokens.select(*tokens.columns, box().alias("_t")).alias("t")
    r = regions.select(*PAGE, box().alias("_r")).alias("r")
    met = belongs(F.col("t._t"), F.col("r._r"), F.col("t.font_size"), F.col("t.is_math"), F.col("t.text"))
    same = (F.col("t.doc_id") == F.col("r.doc_id")) & (F.col("t.page") == F.col("r.page"))
    return t.join(r, same & met, "left_semi").drop("_t")


def outside_listings(blocks: DataFrame, listings: DataFrame) -> DataFrame:
    """All blocks but text blocks whose centre lies in a listing of their page."""
    b = blocks.select(*blocks.columns, box().alias("_b")).alias("b")
    v = listings.select(*PAGE, box().alias("_l")).alias("v")
    same = (F.col("b.doc_id") == F.col("v.doc_id")) & (F.col("b.page") == F.col("v.page")) & (F.col("b.type") == "text")
    return b.join(v, same & geo.center_in(F.col("b._b"), F.col("v._l")), "left_anti").drop("_b")


def header_cells(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Cells with header: whether half of the cell lies in any one header box of its table."""
    keys = [*PAGE, "table"]
    boxes = headers.groupBy(*keys).agg(F.collect_list(box()).alias("_headers"))  # of one table
    own = box()
    hit = F.exists("_headers", lambda h: share_in(own, h) >= 0.5)
    return cells.join(boxes, keys, "left").withColumn("header", F.coalesce(hit, F.lit(False))).drop("_headers")


def row_styles(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of tokens that no region claims: plain mean of the font sizes, bold and italic by half of the tokens."""
    share = lambda c: F.avg(F.when(F.col(c), 1.0).otherwise(0.0)) >= 0.5
    return tokens.groupBy(*keys).agg(F.avg("font_size").alias("font_size"), share("is_bold").alias("is_bold"), share("is_italic").alias("is_italic"))


def _outermost(tables: list[dict]) -> list[dict]:
    partial = [t for t in tables if any(t[c] is None for c in BOX)]
    kept: list[dict] = []
    for t in sorted((t for t in tables if t not in partial), key=lambda t: -max(0.0, t["x2"] - t["x1"]) * max(0.0, t["y2"] - t["y1"])):
        if all(contain(t, k) < 0.72 for k in kept):
            kept.append(t)
    return kept + partial


def with_expanded_tables(visuals: DataFrame, originals: DataFrame, expanded: DataFrame, item: str = "item") -> DataFrame:
    """Visuals of pages whose oblique tables were expanded: the outermost expanded tables, and those other visuals that
    aren't the ``originals`` (known by page and ``item``) and of which less than 0.65 lies in one of these tables."""
    columns = [*PAGE, item, *BOX]
    kept = per_page(expanded.select(*columns), _outermost, expanded.select(*columns).schema)
    v = visuals.select(*columns).join(originals.select(*PAGE, item), [*PAGE, item], "left_anti").withColumn("_v", box()).alias("v")
    k = kept.select(*PAGE, box().alias("_k")).alias("k")
    same = (F.col("v.doc_id") == F.col("k.doc_id")) & (F.col("v.page") == F.col("k.page"))
    rest = v.join(k, same & (share_in(F.col("v._v"), F.col("k._k")) >= 0.65), "left_anti")
    return kept.unionByName(rest.select(*columns))


def first_page_titles(blocks: DataFrame, body: Column, pos: str = "pos") -> DataFrame:
    """One block per document that has a candidate: the first labelled Title, else the one in the largest font, the upper of equals.

    Candidates are text blocks of page 1 of 8 to 240 characters in a font of at least 1.3 times ``body``, in the upper 40 %
    of the page where its height is known. Combined before the exchange.
    """
    height = F.coalesce("page_height", F.lit(0.0))
    size = F.length(collapse(F.coalesce("text", F.lit(""))))
    fits = (F.col("page") == 1) & (F.col("type") == "text") & ~F.coalesce(F.col("label").isin(*NO_TITLE), F.lit(False))
    fits = fits & size.between(8, 240) & (F.col("font_size") >= body * 1.3) & ((height == 0) | (F.col("y1") <= height * 0.4))
    titled = F.coalesce(F.col("label") == "Title", F.lit(False))
    rank = F.struct(F.when(titled, 0).otherwise(1).alias("a"), F.when(titled, 0.0).otherwise(-F.col("font_size")).alias("b"), F.when(titled, 0.0).otherwise(F.coalesce("y1", F.lit(0.0))).alias("c"), F.col(pos).alias("d"))
    return blocks.filter(fits).groupBy("doc_id").agg(F.min_by(F.struct(pos, "text"), rank).alias("_b")).select("doc_id", "_b.*")
