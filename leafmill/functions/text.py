"""Text functions as Column expressions; lengths and offsets count code points."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words, sentences, and characters of a spoken piece.
WORD = r"[\p{L}\p{N}]+"
SENTENCE = r"[^.!?]+(?:[.!?]+|$)"
#: Stands for a full stop that ends no sentence.
HELD_STOP = "\ue200"
SENTENCE_PACK = 340


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ws_trim(c: Column | str) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(col(c), rf"(?U)^\s+|\s+$", "")


def collapse(c: Column | str) -> Column:
    """Each run of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def tighten(c: Column | str) -> Column:
    """No white space before closing punctuation; runs collapsed."""
    return collapse(F.regexp_replace(col(c), r"(?U)\s+([,.;:!?])", "$1"))


def excerpt(c: Column | str, size: int = 280) -> Column:
    return F.left(collapse(c), F.lit(size))


def word_count(c: Column | str) -> Column:
    """White-space separated tokens of the trimmed text; an empty text counts one."""
    return F.size(F.split(ws_trim(F.coalesce(col(c), F.lit(""))), r"(?U)\s+")).cast("bigint")


def tokens(c: Column | str) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(WORD), F.lit(0))


def query_terms(c: Column | str) -> Column:
    """Distinct runs of letters and digits of two characters or more, longest first, else in order. Case counts."""
    found = F.filter(F.array_distinct(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(WORD), F.lit(0))), lambda t: F.length(t) >= 2)
    ranked = F.transform(found, lambda t, i: F.struct((-F.length(t)).alias("size"), i.alias("place"), t.alias("term")))
    return F.transform(F.array_sort(ranked), lambda s: s["term"])


def sentences(c: Column | str) -> Column:
    """Runs of text up to terminators, trimmed, blanks dropped; the stop of "Fig." and "Figs." ends none."""
    held = F.regexp_replace(col(c), r"(?i)\b(Figs?)\.", "$1" + HELD_STOP)
    parts = F.transform(F.regexp_extract_all(held, F.lit(SENTENCE), F.lit(0)), lambda s: ws_trim(F.translate(s, HELD_STOP, ".")))
    parts = F.filter(parts, lambda s: s != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(col(c)))


def pack(c: Column | str, limit: int = SENTENCE_PACK) -> Column:
    """Sentences packed greedily into pieces of at most ``limit`` characters; a short text is one piece, untouched."""
    text = col(c)
    parts = F.regexp_extract_all(text, F.lit(r"[^.!?]+[.!?]+|[^.!?]+$"), F.lit(0))
    parts = F.when(F.size(parts) > 0, parts).otherwise(F.array(text))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, s: Column) -> Column:
        full = (acc["open"] != "") & (F.length(acc["open"]) + F.length(s) > limit)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(ws_trim(acc["open"])))).otherwise(acc["done"]).alias("done"),
            F.when(full, s).otherwise(F.concat(acc["open"], s)).alias("open"),
        )

    def finish(acc: Column) -> Column:
        last = ws_trim(acc["open"])
        return F.when(last != "", F.concat(acc["done"], F.array(last))).otherwise(acc["done"])

    return F.when(F.length(text) <= limit, F.array(text)).otherwise(F.aggregate(parts, start, step, finish))


def reader_quotes(c: Column | str) -> Column:
    """Curly apostrophes straight, curly double quotes removed."""
    return F.translate(col(c), "‘’ʼ“”", "'''")


def phoneme_text(c: Column | str) -> Column:
    """Quotes straight, dashes and brackets as commas, ellipses as stops, white space collapsed."""
    t = F.translate(col(c), "‘’“”", "''\"\"")
    return collapse(F.regexp_replace(F.replace(t, F.lit("…"), F.lit("...")), r"[–—()\[\]{}]", ", "))


def split_keeping_punctuation(c: Column | str) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(col(c), F.lit(r"[^,;:.!?]*[,;:.!?]|[^,;:.!?]+$"), F.lit(0)), ws_trim), lambda s: s != "")


def block_text(c: Column | str, listing: bool = False) -> Column:
    """A layout block's text: words rejoined over line ends, lines joined (kept in listings), punctuation tightened."""
    t = F.regexp_replace(col(c), r"([\p{L}])-\n(?=\p{Ll})", "$1")
    return t if listing else tighten(F.regexp_replace(t, r"\n", " "))


#: What may follow the stop of a host that a line wrap cut.
TOP_LEVELS = ("com", "org", "net", "edu", "gov", "io", "ai", "co", "dev", "app")
_HEAD = re.compile(r"(?i)\bhttps?\s*:\s*//\s*(?=\w)|\bwww\.(?=\w)")
_RUN, _GAP = re.compile(r"\S*"), re.compile(r"\s*")
_TOP = re.compile(rf"(?i)(?:{'|'.join(TOP_LEVELS)})(?:\b|[/#?])")
_PART = re.compile(r"(/\s*)?[\w%.~-]")


def _goes_on(url: str, gap: str, text: str, at: int) -> int | None:
    """Where the address continues behind the gap, or None if it ends before it."""
    part, rest = _PART.match(text, at), url.partition("//")[2] or url
    if url.endswith(".") and _TOP.match(text, at):
        return at
    if part is None:
        return None
    slash = part.group(1)
    if url.endswith("/"):  # a slash on both sides of the gap is one
        return at + len(slash or "")
    if slash:
        return None if "/" in rest else at
    return at if "\n" in gap and url[-1] in "?#=&-" and url.lower().startswith("http") else None


def _rejoined(text: str | None) -> str | None:
    if text is None:
        return None
    out, done = [], 0
    while (head := _HEAD.search(text, done)) is not None:
        out.append(text[done : head.start()])
        url, done = "".join(head.group().split()), head.end()
        while True:
            run = _RUN.match(text, done).group()
            url, done = url + run, done + len(run)
            gap = _GAP.match(text, done).group()
            following = _goes_on(url, gap, text, done + len(gap)) if gap else None
            if following is None:
                break
            done = following
            if text[done] == "/" and (after := _GAP.match(text, done + 1).group()):
                url, done = url + "/", done + 1 + len(after)
        out.append(url)
    return "".join(out) + text[done:]


def repair_urls(c: Column | str) -> Column:
    """White space that a line wrap left inside a URL is removed: after the scheme, at a slash, at a line end, before a top-level domain."""
    rejoin = F.pandas_udf(lambda texts: texts.map(_rejoined), "string")
    return rejoin(col(c))


#: What a generated summary holds besides its words, the words themselves as groups.
SUMMARY_MARKS = r"(?m)\[([^\]]+)\]\([^)]+\)|\*\*([^*]+)\*\*|^\s*(?:[-*•]|\d+[.)])\s+|</?SOURCE(?:_NOTES)?>"


def plain_summary(c: Column | str) -> Column:
    """A generated summary without Markdown links, bold, list marks and source tags, as one line."""
    outer = F.regexp_replace(col(c), SUMMARY_MARKS, "$1$2")
    return collapse(F.regexp_replace(outer, SUMMARY_MARKS, "$1$2"))


#: Fixed value: phrases of an answer that talks about the task instead of doing it.
META = (
    r"(?iu)\b(?:i(?:'m| am) ready to summarize|ready to provide|provided source material|i(?:'ve| have) analyzed"
    r"|based on these observations|here(?:'s| is) (?:a|the) concise summary:)(?:\b|(?<=:))"
)


def is_meta_response(c: Column | str) -> Column:
    """An empty answer, or one that talks about the task."""
    t = F.coalesce(col(c), F.lit(""))
    return (t == "") | t.rlike(META)


def summary_prompt(mode: Column | str, text: Column | str) -> Column:
    """The instruction for a generator, by mode: section, reduction or the final summary."""
    lead = F.when(col(mode) == "section", "Write short notes on the main points of this section.")
    lead = lead.when(col(mode) == "reduction", "Merge these notes and drop what repeats.")
    return F.concat_ws("\n\n", lead.otherwise("Write a plain summary in one paragraph."), col(text))


def shifted_text(c: Column | str, offset: Column | int) -> Column:
    """Each character moved by an offset of code points."""
    by = F.lit(offset) if isinstance(offset, int) else offset
    return F.array_join(F.transform(F.split(col(c), ""), lambda ch: F.char((F.ascii(ch) + by).cast("bigint"))), "")


def spoken_visual(kind: Column | str, text: Column | str) -> Column:
    """What is read aloud for a passage: a phrase for figures, formulas and tables, nothing for code, else its sentences."""
    k = col(kind)
    phrase = F.when(k == "image", "See figure.").when(k == "formula", "See mathematical formula.").when(k == "table", "See table.")
    return F.when(phrase.isNotNull(), F.array(phrase)).when((k == "code") | (F.coalesce(col(text), F.lit("")) == ""), F.array().cast("array<string>")).otherwise(sentences(text))


def slug(c: Column | str, size: int = 52) -> Column:
    """A heading's anchor: lower-cased letters and digits, others as single hyphens."""
    s = F.regexp_replace(F.lower(collapse(c)), r"[^\p{L}\p{N}]+", "-")
    return F.left(F.regexp_replace(s, r"^-|-$", ""), F.lit(size))


def file_name(c: Column | str, extension: str = "md") -> Column:
    s = collapse(F.regexp_replace(F.coalesce(col(c), F.lit("article")), r'[\\/:*?"<>|\x00-\x1F]', " "))
    return F.concat(F.coalesce(F.nullif(F.left(s, F.lit(120)), F.lit("")), F.lit("article")), F.lit("." + extension))


def escape_html(c: Column | str) -> Column:
    t = col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def clock(ms: Column | str) -> Column:
    """Milliseconds as minutes:seconds; minutes grow without hours."""
    s = F.greatest(F.lit(0), F.floor(col(ms) / 1000)).cast("bigint")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def upper_median(values: Column) -> Column:
    """Of a list, the element at floor(n / 2) in ascending order."""
    return F.try_element_at(F.sort_array(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def includes_any(value: Column, terms: Column) -> Column:
    """Whether the text holds one of the terms, whatever the case."""
    v = F.lower(F.coalesce(value, F.lit("")))
    return F.exists(terms, lambda t: F.contains(v, F.lower(t)))


def snippet(content: Column, title: Column, terms: Column, lead: int = 110, size: int = 360) -> Column:
    """An excerpt around the first term: from a word's start ``lead`` characters before it, ``size`` long, to a word's end."""
    text, name = collapse(content), collapse(F.coalesce(title, F.lit("")))
    text = F.when((name != "") & F.startswith(text, F.concat(name, F.lit(" "))), F.substr(text, F.length(name) + 2)).otherwise(text)
    lower = F.lower(text)
    places = F.filter(F.transform(terms, lambda t: F.position(F.lower(t), lower) - 1), lambda p: p >= 0)
    first = F.when(F.size(places) > 0, F.greatest(F.lit(0), F.array_min(places) - lead)).otherwise(F.lit(0))
    space = F.position(F.lit(" "), text, first + 1)
    start = F.when((first > 0) & (space > 0), space).otherwise(first)
    stop = F.least(F.length(text), start + size)
    # the last space at or before ``stop``
    head = F.substr(text, F.lit(1), stop + 1)
    last = F.length(head) - F.position(F.lit(" "), F.reverse(head))
    last = F.when(F.contains(head, F.lit(" ")), last).otherwise(F.lit(-1))
    end = F.when((stop < F.length(text)) & (last > start), last).otherwise(stop)
    body = F.trim(F.substr(text, start + 1, end - start))
    return F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(end < F.length(text), "…").otherwise(""))


def quoted(term: Column) -> Column:
    """A text as a pattern that matches itself."""
    return F.regexp_replace(term, r"([^\p{L}\p{N}\s])", r"\\$1")


def highlight(text: Column, terms: Column, before: str = "<mark>", after: str = "</mark>") -> Column:
    """Marks around every occurrence of a term, the longest first, whatever the case."""
    pattern = F.concat(F.lit("(?iu)("), F.array_join(F.transform(terms, quoted), "|"), F.lit(")"))
    return F.when(F.size(terms) > 0, F.regexp_replace(text, pattern, F.lit(f"{before}$1{after}"))).otherwise(text)
