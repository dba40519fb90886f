"""Timed captions: parsing, chapters, paragraphs, and sentence times."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SENTENCE, col, collapse

#: Caption elements, chapter lines, a paragraph's length, and the five named entities that captions use.
CAPTION = r"(?is)<(?:text|p)\b[^>]*>.*?</(?:text|p)>"
CHAPTER = r"^\s*(?:[•*-]\s*)?((?:\d{1,2}:)?\d{1,2}:\d{2})\s*(?:[-–—:]\s*)?(.+)$"
PARAGRAPH = 700
NAMED = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def decode_entities(c: Column | str) -> Column:
    """Decimal and hexadecimal character references of the Basic Latin and Latin-1 blocks by way of char(), and the five names."""
    t = col(c)
    parts = F.regexp_extract_all(t, F.lit(r"(?is)&#x[\da-f]+;|&#\d+;|[^&]+|&"), F.lit(0))

    def one(p: Column) -> Column:
        hexa, deci = F.regexp_extract(p, r"(?i)^&#x([\da-f]+);$", 1), F.regexp_extract(p, r"^&#(\d+);$", 1)
        code = F.when(hexa != "", F.conv(hexa, 16, 10)).when(deci != "", deci).cast("int")
        wide = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(code.isNull(), p).otherwise(wide)

    t = F.array_join(F.transform(parts, one), "")
    for a, b in NAMED:
        t = F.regexp_replace(t, "(?i)" + a, re.sub(r"([\\$])", r"\\\1", b))
    return t


def attribute(source: Column, name: str) -> Column:
    """A quoted attribute's value, else "0"."""
    found = F.regexp_extract(source, rf"""(?i)\b{name}=["']([^"']+)["']""", 1)
    return F.when(found != "", found).otherwise("0")


def caption_chunks(xml: DataFrame, id_col: str = "video_id", xml_col: str = "xml") -> DataFrame:
    """One row per caption: id, seq, text, start_ms, duration_ms; tags and [bracketed] parts dropped, blanks skipped."""
    rows = xml.select(id_col, F.posexplode(F.regexp_extract_all(F.col(xml_col), F.lit(CAPTION), F.lit(0))).alias("seq", "_c"))
    head, body = F.regexp_extract("_c", r"(?is)^<(?:text|p)\b([^>]*)>", 1), F.regexp_extract("_c", r"(?is)^<[^>]*>(.*)</[^>]*>$", 1)
    modern = F.lower(F.substring("_c", 2, 2)).rlike("^p")
    number = lambda new, old: F.coalesce(F.when(modern, attribute(head, new).try_cast("double")).otherwise(attribute(head, old).try_cast("double") * 1000), F.lit(0.0))
    text = collapse(F.regexp_replace(decode_entities(F.regexp_replace(body, r"<[^>]+>", " ")), r"\[[^\]]*\]", " "))
    return rows.select(id_col, "seq", text.alias("text"), number("t", "start").alias("start_ms"), number("d", "dur").alias("duration_ms")).filter("text != ''")


def description_chapters(videos: DataFrame, id_col: str = "video_id", text_col: str = "description", seconds_col: str = "duration") -> DataFrame:
    """Chapters from lines that lead with a time, up to five seconds beyond the end; at least two a video."""
    line = F.explode(F.split(F.col(text_col), "\n"))
    found = videos.select(id_col, seconds_col, line.alias("_l")).select(id_col, seconds_col, F.regexp_extract("_l", CHAPTER, 1).alias("_t"), F.trim(F.regexp_extract("_l", CHAPTER, 2)).alias("text")).filter("_t != ''")
    seconds = F.aggregate(F.split("_t", ":"), F.lit(0).cast("bigint"), lambda s, p: s * 60 + p.cast("bigint"))
    found = found.withColumn("_s", seconds).filter(F.col("_s") <= F.col(seconds_col) + 5)
    enough = found.groupBy(id_col).agg(F.count("*").alias("_n")).filter("_n >= 2").select(id_col)
    return found.join(enough, id_col, "left_semi").select(id_col, "text", (F.col("_s") * 1000).cast("double").alias("start_ms"))


def normalized_chapters(c: Column) -> Column:
    """array<struct<text, title, start, start_time>> as sorted array<struct<start, text>>, null if nothing stays."""
    one = F.transform(c, lambda x: F.struct(F.coalesce(x["start"], x["start_time"] * 1000).alias("start"), F.trim(F.coalesce(F.nullif(x["text"], F.lit("")), x["title"], F.lit(""))).alias("text")))
    good = F.array_sort(F.filter(one, lambda x: (x["text"] != "") & x["start"].isNotNull() & ~F.isnan(x["start"])))
    return F.when(F.size(good) > 0, good)


_SPEAKER = re.compile("\\s*>>\\s*(?=[\"“‘'(\\[]*[^\\W\\d_a-z])")
_sentence = re.compile(SENTENCE).findall


def split_sentences(text: str) -> list[str]:
    return [s for p in _sentence(text) if (s := p.strip())] or [text]


def paragraphs(text: str, limit: int = PARAGRAPH) -> list[str]:
    """Speaker turns (">>" before an upper-case letter) as paragraphs of whole sentences, later turns led by a dash."""
    parts, last = [], 0
    for m in _SPEAKER.finditer(text):
        if text[m.end() :].lstrip("\"“‘'([")[:1].isupper():
            parts.append(text[last : m.start()])
            last = m.end()
    parts.append(text[last:])
    out: list[str] = []
    for turn, part in enumerate(parts):
        clean = " ".join(re.sub(r"\s*>>\s*", " ", part).split())
        if not clean:
            continue
        lead, held = ("— " if turn else ""), []
        size = len(lead)
        for s in split_sentences(clean):
            gap = 0 if not held else 1
            if held and size + len(s) + 1 > limit:
                out.append(lead + " ".join(held))
                lead, held, size, gap = "", [], 0, 0
            held.append(s)
            size += gap + len(s)
        if held:
            out.append(lead + " ".join(held))
    return out


_word = re.compile(r"[^\W_]+(?:['’][^\W_]+)*").findall


def sentence_times(texts: list[str], chunks: list[tuple[str, float]]) -> list[list[float]]:
    """Start times of each paragraph's sentences: the next caption word equal to the sentence's first, never going back."""
    words = [(w.lower(), start) for text, start in chunks for w in _word(text.replace(">>", " "))]
    at: dict[str, list[int]] = {}
    for k, (w, _) in enumerate(words):
        at.setdefault(w, []).append(k)
    from bisect import bisect_left

    cursor, out = 0, []
    for text in texts:
        times = []
        for s in split_sentences(text):
            own = _word(re.sub(r"^—\s*", "", s))
            places = at.get(own[0].lower(), []) if own else []
            k = bisect_left(places, cursor)
            found = places[k] if k < len(places) else min(cursor, max(0, len(words) - 1))
            times.append(words[found][1] if found < len(words) else 0.0)
            cursor = min(len(words), found + max(1, len(own)))
        out.append(times)
    return out
