"""Markdown rendering of passages as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def escape_inline(c: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), r"([\\`*_\[\]<>])", r"\\$1")


def escape_destination(c: Column | str) -> Column:
    return F.replace(F.replace(F.coalesce(col(c), F.lit("")), F.lit(">"), F.lit("%3E")), F.lit("\n"), F.lit(""))


def fenced_code(text: Column | str, language: Column | None = None) -> Column:
    """A code block whose fence is one longer than the text's longest run of backticks, three at least."""
    body = F.regexp_replace(F.coalesce(col(text), F.lit("")), r"(?U)\s+$", "")
    runs = F.transform(F.regexp_extract_all(body, F.lit("`+"), F.lit(0)), F.length)
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(2), F.coalesce(F.array_max(runs), F.lit(0))) + 1)
    return F.concat(fence, F.coalesce(language, F.lit("")) if language is not None else F.lit(""), F.lit("\n"), body, F.lit("\n"), fence)


def table(rows: Column) -> Column:
    """A table from array<struct<cells array<struct<text, ...>>>>: the first row heads, short rows are filled up."""
    full = F.filter(F.transform(rows, lambda r: r["cells"]), lambda c: F.size(c) > 0)
    width = F.array_max(F.transform(full, lambda c: F.size(c)))
    cell = lambda t: F.trim(F.regexp_replace(F.replace(F.coalesce(t, F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " "))
    row = lambda c: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(1), width), lambda k: cell(F.try_element_at(c, k)["text"])), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.concat(F.array(row(F.element_at(full, 1)), rule), F.transform(F.slice(full, 2, F.greatest(F.size(full), F.lit(1))), row))
    return F.when(F.size(full) > 0, F.array_join(lines, "\n")).otherwise("")


def image(original: Column, source: Column, alt: Column, description: Column) -> Column:
    src = F.coalesce(F.nullif(original, F.lit("")), F.nullif(source, F.lit("")))
    name = F.regexp_replace(F.coalesce(F.nullif(alt, F.lit("")), F.nullif(description, F.lit("")), F.lit("Image")), r"[\[\]]", "")
    caption = F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit("*"), escape_inline(description), F.lit("*"))).otherwise("")
    return F.when(src.isNull() | F.startswith(src, F.lit("blob:")), caption).otherwise(F.concat(F.lit("!["), name, F.lit("](<"), escape_destination(src), F.lit(">)")))


def heading(text: Column, level: Column | None = None) -> Column:
    n = F.lit(2) if level is None else F.greatest(F.lit(2), F.least(F.lit(6), F.coalesce(level, F.lit(2))))
    return F.concat(F.repeat(F.lit("#"), n), F.lit(" "), text)


def emphasis(text: Column, bold: Column, italic: Column) -> Column:
    t = F.when(bold, F.concat(F.lit("**"), text, F.lit("**"))).otherwise(text)
    return F.when(italic, F.concat(F.lit("*"), t, F.lit("*"))).otherwise(t)


def article(title: Column, author: Column, site: Column, published: Column, url: Column, summary: Column, body: Column) -> Column:
    """The document around its passages' Markdown (an array in order): head, details, source, summary; no run of blank lines."""
    name = F.coalesce(F.nullif(F.trim(title), F.lit("")), F.lit("Article"))
    details = F.filter(F.array(author, site, F.left(published, F.lit(10))), lambda d: F.coalesce(d, F.lit("")) != "")
    parts = F.array(
        F.concat(F.lit("# "), escape_inline(name)),
        F.when(F.size(details) > 0, F.concat(F.lit("> "), F.array_join(F.transform(details, escape_inline), " · "))),
        F.when(F.coalesce(url, F.lit("")) != "", F.concat(F.lit("Source: ["), escape_inline(url), F.lit("](<"), escape_destination(url), F.lit(">)"))),
        F.when((F.coalesce(summary, F.lit("")) != "") & ~F.startswith(summary, F.lit("Could not summarize locally:")), F.concat(F.lit("## Local AI summary\n\n"), escape_inline(summary))),
    )
    every = F.filter(F.concat(parts, body), lambda p: F.coalesce(p, F.lit("")) != "")
    return F.concat(F.regexp_replace(F.regexp_replace(F.array_join(every, "\n\n"), r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", ""), F.lit("\n"))
