"""Further rules on page content: structured rows, wrapped URLs, angled tables, drop caps, shifted fonts, listings."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TOP_LEVELS, ws_trim
from .layout import PAGE, contain

RADICALS = r"[√∛∜]"


def structured_rows(text: Column) -> Column:
    """Whether a block reads as numbered or input/output rows: five lines, three and 30 % of them such, of uneven width."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), ws_trim), lambda x: x != "")
    rows = F.size(F.filter(lines, lambda x: x.rlike(r"(?i)^(?:input|output)\s*:|^\d{1,3}\s*:")))
    widths = F.sort_array(F.transform(lines, lambda x: F.length(F.regexp_replace(x, r"\s+", ""))))
    at = lambda q: F.coalesce(F.try_element_at(widths, (F.floor(F.size(lines) * q) + 1).cast("int")), F.lit(0))
    uneven = (at(0.75) >= 20) & (at(0.25) <= at(0.75) * 0.62)
    return (F.size(lines) >= 5) & (rows >= 3) & (rows >= 0.3 * F.size(lines)) & uneven


#: How a URL may be cut between two texts: the end of the first and the start of the second.
CUTS = (
    (r"https?:$", r"^//[\p{L}\p{N}]"),
    (r"https?://$", r"^[\p{L}\p{N}]"),
    (r"(?:https?://|www\.)\S+[/?#=&-]$", r"^[\p{L}\p{N}%._~-]"),
    (r"(?:https?://|www\.)\S+\.[A-Za-z]{2,}$", r"^/\s*[\p{L}\p{N}%._~-]"),
    (r"(?:https?://|www\.)\S+\.$", rf"^(?:{'|'.join(TOP_LEVELS)})(?:\b|[/#?])"),
)


def wrapped_url(previous: Column, following: Column) -> Column:
    out = F.lit(False)
    for a, b in CUTS:
        out = out | (previous.rlike("(?i)" + a) & following.rlike("(?i)" + b))
    return F.coalesce(out, F.lit(False))


def interrupts(kind: Column, pdf_text: Column, label: Column, text: Column) -> Column:
    """Whether a passage is a visual or a visual's caption."""
    named = F.coalesce(text, F.lit("")).rlike(r"(?i)^\s*(?:Figure|Fig\.?|Table)\s+\d+(?:\.\d+)*[A-Za-z]?\b")
    return F.coalesce(kind.isin("image", "table", "formula"), F.lit(False)) | (F.coalesce(pdf_text, F.lit(False)) & (F.coalesce(label == "Caption", F.lit(False)) | named))


def oblique_tables(tables: DataFrame, tokens: DataFrame) -> DataFrame:
    """doc_id, page, item and oblique: whether text at ten degrees or more off both axes makes up the table's surroundings.

    Three such tokens, twelve characters and 12 % of the characters are needed. tables and tokens
    carry boxes; tables also page_width and page_height; angles are radians.
    """
    t = tables.select(*PAGE, "item", *(F.col(c).alias(f"_{c}") for c in ("x1", "y1", "x2", "y2", "page_width", "page_height")))
    near = {"x1": F.greatest(F.lit(0.0), F.col("_x1") - F.col("_page_width") * 0.08), "y1": F.greatest(F.lit(0.0), F.col("_y1") - F.col("_page_height") * 0.12), "x2": F.least("_page_width", F.col("_x2") + F.col("_page_width") * 0.08), "y2": F.least("_page_height", F.col("_y2") + F.col("_page_height") * 0.12)}
    met = t.join(tokens, PAGE, "left")
    w = F.greatest(F.lit(0.0), F.least("x2", near["x2"]) - F.greatest("x1", near["x1"])) * F.greatest(F.lit(0.0), F.least("y2", near["y2"]) - F.greatest("y1", near["y1"]))
    inside = w / F.greatest(F.lit(1.0), (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))) >= 0.35
    n = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", ""))
    angle = F.abs(F.atan2(F.sin(F.coalesce("text_angle", F.lit(0.0))), F.cos(F.coalesce("text_angle", F.lit(0.0)))))
    off = F.least(angle, F.abs(math.pi / 2 - angle), F.abs(math.pi - angle)) >= math.pi / 18
    counted = inside & (n > 0)
    sums = met.groupBy(*PAGE, "item").agg(F.sum(F.when(counted, n).otherwise(0)).alias("all"), F.sum(F.when(counted & off, n).otherwise(0)).alias("angled"), F.count(F.when(counted & off, 1)).alias("tokens"))
    return sums.select(*PAGE, "item", ((F.col("tokens") >= 3) & (F.col("angled") >= 12) & (F.col("angled") >= 0.12 * F.col("all"))).alias("oblique"))


def drop_cap(tokens: list[dict], label: str) -> dict | None:
    """The large first letter of a text region that spans two of its lines."""
    if label != "Text" or len(tokens) < 4:
        return None
    first = min(tokens, key=lambda t: (t["item_index"], t["token_index"]))
    rest = [t for t in tokens if t is not first]
    body = sorted(t["font_size"] for t in rest)[len(rest) // 2]
    if first["is_math"] or len(first["text"]) != 1 or not first["text"].isalpha() or body <= 0 or first["font_size"] < 2.5 * body:
        return None
    if first["x1"] > min(t["x1"] for t in tokens) + 0.75 * body:
        return None
    lines = {round(t["baseline_y"] / max(1.0, body / 2)) for t in rest if first["y1"] <= (t["y1"] + t["y2"]) / 2 <= first["y2"]}
    return first if len(lines) >= 2 else None


def inline_formula(formula: dict, tokens: list[dict]) -> bool:
    """Whether a formula box is a radical within a line of text, and so no visual: narrow for the radical's font, and among
    the tokens next to the radical (two items away at most, about its baseline) one stands before it and one goes on behind it.

    Tokens need text, font_size, item_index, baseline_y and their box; the first radical in or partly in the box decides.
    """
    import re

    def touches(t: dict) -> bool:
        x, y = (t["x1"] + t["x2"]) / 2, (t["y1"] + t["y2"]) / 2
        inside = formula["x1"] <= x <= formula["x2"] and formula["y1"] <= y <= formula["y2"]
        return inside or contain(t, formula) >= 0.15

    root = next((t for t in tokens if re.search(RADICALS, t["text"] or "") and touches(t)), None)
    if formula["label"] != "Formula" or root is None or formula["x2"] - formula["x1"] > 4.5 * root["font_size"]:
        return False
    before = after = False
    for t in tokens:
        step = t["item_index"] - root["item_index"]
        if 0 < abs(step) <= 2 and abs(t["baseline_y"] - root["baseline_y"]) <= 1.2 * root["font_size"]:
            before |= step < 0 and t["x1"] <= root["x1"]
            after |= step > 0 and t["x2"] >= root["x2"]
    return before and after


def font_shift(texts: list[str]) -> int:
    """The offset that makes a font's control codes printable text, mostly letters with some spaces; 0 if none does."""
    codes = Counter(ord(c) for t in texts for c in t)
    total = sum(codes.values())
    controls = [c for c, _ in codes.most_common() if c < 32]
    if not total or sum(codes[c] for c in controls) < 0.02 * total:
        return 0
    for c in controls:
        shift = 32 - c
        moved = {k + shift: n for k, n in codes.items()}
        share = lambda test: sum(n for k, n in moved.items() if 0 <= k < 0x110000 and test(chr(k))) / total
        if share(str.isprintable) >= 0.95 and share(str.isalpha) >= 0.5 and 0.05 <= moved.get(32, 0) / total <= 0.4:
            return shift
    return 0


def listings(rows: list[dict], most: int = 80) -> list[dict]:
    """Listings of a page: a caption "Listing n", then rows until a gap of two and a half lines, a heading, or ``most`` rows; indents kept."""
    import re

    out, k = [], 0
    ordered = sorted(rows, key=lambda r: (r["y1"], r["x1"]))
    while k < len(ordered):
        head = re.match(r"(?i)\s*Listing\s+(\d+(?:\.\d+)*)", ordered[k]["text"])
        k += 1
        if not head:
            continue
        body: list[dict] = []
        while k < len(ordered) and len(body) < most:
            last = body[-1] if body else ordered[k - 1]
            high = max(1.0, last["y2"] - last["y1"])
            if ordered[k]["y1"] - last["y2"] > 2.5 * high or re.match(r"(?i)\s*(?:\d+(?:\.\d+)*\s+[A-Z][a-z]|Listing\s+\d|(?:Figure|Table)\s+\d)", ordered[k]["text"]):
                break
            body.append(ordered[k])
            k += 1
        if body:
            left = min(r["x1"] for r in body)
            width = max(1.0, sum((r["x2"] - r["x1"]) / max(1, len(r["text"])) for r in body) / len(body))
            out.append({"number": head.group(1), "text": "\n".join(" " * round((r["x1"] - left) / width) + r["text"] for r in body)})
    return out


def supplementary_tables(passages: DataFrame) -> DataFrame:
    """Passages without overview tables (three rows, half of them ending in page numbers) and the labels on their pages.

    Tables come as array<struct<cells array<struct<text>>>> in table_rows.
    """
    last = lambda r: F.element_at(r["cells"], -1)["text"]
    rows = F.filter("table_rows", lambda r: F.size(r["cells"]) > 1)
    indexed = F.size(F.filter(rows, lambda r: last(r).rlike(r"^\s*[A-Z]?\d{1,4}\s*$")))
    overview = (F.col("type") == "table") & (F.size(rows) >= 3) & (indexed >= 0.5 * F.size(rows))
    marked = passages.withColumn("_overview", F.coalesce(overview, F.lit(False)))
    pages = marked.filter("_overview").select(*PAGE).distinct().withColumn("_page", F.lit(True))
    label = F.coalesce(F.col("text"), F.lit("")).rlike(r"(?i)^\s*(?:supplementary|appendix|overview)\b")
    return marked.join(pages, PAGE, "left").filter(~F.col("_overview") & ~(F.coalesce("_page", F.lit(False)) & label)).drop("_overview", "_page")


def title_block(blocks: DataFrame) -> DataFrame:
    """Per document the likeliest title of the first three pages: the largest font of 8 to 300 characters, then the earliest."""
    fit = blocks.filter((F.col("page") <= 3) & F.length(ws_trim("text")).between(8, 300))
    w = Window.partitionBy("doc_id").orderBy(F.col("font_size").desc(), "page", "y1")
    text = F.regexp_replace(F.regexp_replace("text", r"(\p{L})-\s*\n\s*(?=\p{Ll})", "$1"), r"\s+", " ")
    return fit.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("doc_id", F.trim(text).alias("title"))
