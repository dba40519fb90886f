"""From glyph runs to blocks to passages: tokens, text regions, block styles, and angled tables' growth."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .layout import contain, per_page, reading_key, token_rows


def glyph_tokens(items: DataFrame, scale: float = 2.0) -> DataFrame:
    """Glyph runs (text, transform a..f, width, height, font, page_height) as boxes in page pixels with style flags.

    The font's name tells bold, italic and mathematical faces; text is horizontal if the sine of its
    angle is 0.35 at most.
    """
    size = F.sqrt(F.col("c") * F.col("c") + F.col("d") * F.col("d")) * scale
    angle = F.atan2(F.col("b"), F.col("a"))
    name = F.coalesce(F.col("font"), F.lit(""))
    x, y = F.col("e") * scale, (F.col("page_height") - F.col("f")) * scale
    out = items.withColumns({"font_size": size, "text_angle": angle, "baseline_y": y, "is_bold": name.rlike(r"(?i)bold|black|heavy|semibold|demi"), "is_italic": name.rlike(r"(?i)italic|oblique|slanted"), "is_math": name.rlike(r"(?i)math|symbol|cmmi|cmsy|cmex|msam|msbm")})
    out = out.withColumn("is_horizontal", F.abs(F.sin("text_angle")) <= 0.35)
    w, h = F.col("width") * scale, F.col("font_size")
    return out.withColumns({"x1": x, "y1": y - h * 0.8, "x2": x + w * F.abs(F.cos("text_angle")), "y2": y + h * 0.2}).drop("a", "b", "c", "d", "e", "f")


def split_items(tokens: DataFrame) -> DataFrame:
    """One row per word of a glyph run, its width in proportion to its characters; token_index counts from 0."""
    words = F.regexp_extract_all("text", F.lit(r"\s*\S+"), F.lit(0))
    total = F.greatest(F.lit(1), F.length("text"))
    start = F.aggregate(F.slice(F.col("_words"), 1, F.col("token_index")), F.lit(0), lambda s, w: s + F.length(w))
    rows = tokens.withColumn("_words", words).select("*", F.posexplode("_words").alias("token_index", "_word")).withColumn("_start", start)
    lead = F.length("_word") - F.length(F.regexp_replace("_word", r"^\s+", ""))
    span = F.col("x2") - F.col("x1")
    left = F.col("x1") + span * (F.col("_start") + lead) / total
    right = F.col("x1") + span * (F.col("_start") + F.length("_word")) / total
    return rows.withColumn("_left", left).withColumn("_right", right).withColumn("text", F.trim("_word")).withColumn("x1", F.col("_left")).withColumn("x2", F.col("_right")).drop("_words", "_word", "_start", "_left", "_right")


def lift_regions(lines: list[dict], regions: list[dict], visuals: list[dict]) -> list[dict]:
    """Lines gathered in the region that holds them best (its centre counts 0.35, 0.45 is needed); lines in visuals go, lone ones stay."""
    held: dict[int, list[dict]] = {}
    alone = []
    for line in lines:
        if any(contain(line, v) >= 0.5 for v in visuals):
            continue
        x, y = (line["x1"] + line["x2"]) / 2, (line["y1"] + line["y2"]) / 2
        fits = [(contain(line, r) + 0.35 * (r["x1"] <= x <= r["x2"] and r["y1"] <= y <= r["y2"]), -k) for k, r in enumerate(regions)]
        best = max(fits, default=(0.0, 0))
        if best[0] >= 0.45:
            held.setdefault(-best[1], []).append(line)
        else:
            alone.append(line)
    out = []
    for k, own in sorted(held.items()):
        own.sort(key=reading_key)
        chars = sum(len(x["text"]) for x in own)
        r = regions[k]
        out.append({"text": "\n".join(x["text"] for x in own), "font_size": sum(x["font_size"] * len(x["text"]) for x in own) / max(1, chars), "label": r["label"], **{c: r[c] for c in ("x1", "y1", "x2", "y2")}})
    return out + [{"text": x["text"], "font_size": x["font_size"], "label": "Text", **{c: x[c] for c in ("x1", "y1", "x2", "y2")}} for x in alone]


def blocks_of(rows: list[dict]) -> list[dict]:
    """A page's rows (kind line, region or visual) as its blocks, with the page's keys."""
    kind = lambda k: [r for r in rows if r["kind"] == k]
    return [{"doc_id": rows[0]["doc_id"], "page": rows[0]["page"], "ord": k} | b for k, b in enumerate(lift_regions(kind("line"), kind("region"), kind("visual")))]


BLOCKS = "doc_id bigint, page int, ord int, text string, font_size double, label string, x1 double, y1 double, x2 double, y2 double"


def page_blocks(rows: DataFrame) -> DataFrame:
    return per_page(rows, blocks_of, BLOCKS)


def block_type(label: Column, font_size: Column, body_font: Column, text: Column) -> Column:
    """heading for title and section labels and for short text of 1.45 times the body's font, caption, else paragraph."""
    large = (font_size >= body_font * 1.45) & (F.length(text) <= 180)
    return F.when(label.isin("Title", "Section-header") | large, "heading").when(label == "Caption", "caption").otherwise("paragraph")


def block_passages(blocks: DataFrame, body: DataFrame) -> DataFrame:
    """Blocks with their type, heading level (1 for titles) and cleaned text; ``body`` is body_font per page."""
    from ..functions.text import block_text

    met = blocks.join(body, ["doc_id", "page"])
    kind = block_type(F.col("label"), F.col("font_size"), F.col("body_font"), F.col("text"))
    out = met.withColumn("type", kind).withColumn("text", block_text("text")).filter("text != ''")
    return out.withColumn("heading_level", F.when((F.col("type") == "heading") & (F.col("label") == "Title"), 1).when(F.col("type") == "heading", 2)).drop("body_font")


#: Private-use marks around superscript, subscript, mathematics and bold in a row's text.
MARKS = {"\ue100": ("superscript", 1), "\ue101": ("superscript", 0), "\ue102": ("subscript", 1), "\ue103": ("subscript", 0), "\ue104": ("math", 1), "\ue105": ("math", 0), "\ue106": ("bold", 1), "\ue107": ("bold", 0)}


def inline_styles(text: str) -> tuple[str, dict[str, list[tuple[int, int]]]]:
    """Text without its marks, and the ranges they held; bold ranges with only blanks between are one."""
    out, open_, ranges = [], {}, {k: [] for k in ("superscript", "subscript", "math", "bold")}
    n = 0
    for ch in text:
        mark = MARKS.get(ch)
        if mark is None:
            out.append(ch)
            n += 1
        elif mark[1]:
            open_[mark[0]] = n
        elif mark[0] in open_:
            start = open_.pop(mark[0])
            if n > start:
                ranges[mark[0]].append((start, n))
    plain, bold = "".join(out), []
    for a, b in ranges["bold"]:
        if bold and not plain[bold[-1][1] : a].strip():
            bold[-1] = (bold[-1][0], b)
        else:
            bold.append((a, b))
    ranges["bold"] = bold
    return plain, ranges


def grow_oblique(table: dict, tokens: list[dict], width: float, height: float) -> dict:
    """A table's box grown over the angled tokens that touch it, until nothing more touches; captions stop it."""
    off = lambda t: min(abs(a := abs(math.atan2(math.sin(t["text_angle"]), math.cos(t["text_angle"])))), abs(math.pi / 2 - a), abs(math.pi - a)) >= math.pi / 18
    box = {k: table[k] for k in ("x1", "y1", "x2", "y2")}
    stop = [t["y1"] for t in tokens if re.match(r"(?i)\s*(?:Table|Figure)\s+\d", t["text"]) and t["y1"] > table["y2"]]
    floor, rest, grown = min(stop, default=height), [t for t in tokens if off(t)], True
    while grown:
        grown = False
        for t in list(rest):
            pad = max(4.0, t["font_size"])
            if t["x2"] >= box["x1"] - pad and t["x1"] <= box["x2"] + pad and t["y2"] >= box["y1"] - pad and t["y1"] <= min(floor, box["y2"] + pad):
                box = {"x1": max(0.0, min(box["x1"], t["x1"])), "y1": max(0.0, min(box["y1"], t["y1"])), "x2": min(width, max(box["x2"], t["x2"])), "y2": min(floor, max(box["y2"], t["y2"]))}
                rest.remove(t)
                grown = True
    return table | box


def front_matter_page(tokens: list[dict], active: bool, page: int, pages: int) -> bool:
    """Whether a page belongs to the front matter's index: begun by its heading in the first 20 % (12 pages at least), kept up by two entries."""
    lines = [r["text"].strip() for r in token_rows(tokens)] if tokens else []
    entries = sum(bool(re.search(r"(?:\.{3,}|\s)\s*(?:\d{1,4}|[ivxlcdm]+)$", x)) for x in lines)
    begins = page <= max(12, 0.2 * pages) and any(re.match(r"(?i)(?:table of )?contents$|list of (?:figures|tables)$|index$", x) for x in lines)
    return begins or (active and entries >= 2)


def transcript_passages(chunks: list[tuple[str, float]], chapters: list[tuple[float, str]]) -> list[dict]:
    """Captions as paragraphs under their chapters' headings; a chapter begins at the sentence end at or after its first caption."""
    from bisect import bisect_left

    from ..functions.text import SENTENCE
    from ..sources.captions import paragraphs

    text, places = "", []
    for words, start in chunks:
        text += " " if text else ""
        places.append((start, len(text)))
        text += words
    ends = [m.end() for m in re.finditer(SENTENCE, text)]
    out, at, seen = [], 0, set()
    for start, title in sorted(chapters):
        target = next((o for t, o in places if t >= start), len(text))
        k = bisect_left(ends, target)
        offset = 0 if target == 0 else ends[k] if k < len(ends) else len(text)
        if not title or offset >= len(text) or offset in seen:
            continue
        seen.add(offset)
        out += [{"type": "paragraph", "text": p} for p in paragraphs(text[at:offset])] if offset > at else []
        out.append({"type": "heading", "text": title})
        at = offset
    return out + [{"type": "paragraph", "text": p} for p in paragraphs(text[at:])]
