"""Boxes as Column expressions: structs with x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x2"] - b["x1"]) * F.greatest(F.lit(0.0), b["y2"] - b["y1"])


def containment(inner: Column, outer: Column) -> Column:
    """The share of ``inner`` that lies in ``outer``; areas below one count as one."""
    w = F.greatest(F.lit(0.0), F.least(inner["x2"], outer["x2"]) - F.greatest(inner["x1"], outer["x1"]))
    h = F.greatest(F.lit(0.0), F.least(inner["y2"], outer["y2"]) - F.greatest(inner["y1"], outer["y1"]))
    return w * h / F.greatest(F.lit(1.0), (inner["x2"] - inner["x1"]) * (inner["y2"] - inner["y1"]))


def clamp(v: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, v))


def center_in(inner: Column, outer: Column) -> Column:
    x, y = (inner["x1"] + inner["x2"]) / 2, (inner["y1"] + inner["y2"]) / 2
    return x.between(outer["x1"], outer["x2"]) & y.between(outer["y1"], outer["y2"])


def caption_distance(image: Column, caption: Column, page_height: Column) -> Column:
    """Vertical gap plus half the horizontal, and 12 % of the page for a caption that isn't below."""
    below = caption["y1"] >= image["y2"]
    gap = F.when(below, caption["y1"] - image["y2"]).when(image["y1"] >= caption["y2"], image["y1"] - caption["y2"]).otherwise(F.lit(0.0))
    side = F.greatest(F.lit(0.0), F.greatest(image["x1"], caption["x1"]) - F.least(image["x2"], caption["x2"]))
    return gap + side * 0.5 + F.when(below, F.lit(0.0)).otherwise(F.coalesce(page_height, F.lit(1000.0)) * 0.12)


def marginal(y1: Column, y2: Column, page_height: Column) -> Column:
    """top or bottom within 12 % of the page's edge, else empty."""
    return F.when((page_height > 0) & (y2 <= page_height * 0.12), "top").when((page_height > 0) & (y1 >= page_height * 0.88), "bottom").otherwise("")


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors in double precision; 0 if empty or of different length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), dot).otherwise(F.lit(0.0))
