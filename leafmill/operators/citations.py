"""Citations: author-year keys, numbered references, and mentions of figures and tables."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names, years, citations and mentions.
NAME = r"[\p{L}\p{M}][\p{L}\p{M}'’.-]+"
YEAR = r"(?:19|20)\d{2}[a-z]?"
#: surname, optional co-authors, year; whole match and both groups
CITATION = rf"(?iu)\b({NAME})(?:\s+et\s+al\.|\s*(?:&|and)\s+{NAME})?(?:\s*,\s*|\s*\(\s*)({YEAR})"
MENTION = r"(?i)\b(Figure|Fig\.?|Table|Listing)\s+(\d+(?:\.\d+)*)([A-Za-z]?)\b"


@F.pandas_udf(T.StringType())
def plain_name(names: pd.Series) -> pd.Series:
    """A name without marks, punctuation and case (compatibility decomposition has no built-in function)."""
    one = lambda v: None if v is None else "".join(c for c in unicodedata.normalize("NFKD", v) if unicodedata.category(c)[0] in "LN").lower()
    return names.map(one)


@F.pandas_udf(T.StringType())
def compatibility_form(texts: pd.Series) -> pd.Series:
    return texts.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def key(surname: Column, year: Column) -> Column:
    name = plain_name(surname)
    return F.when((F.coalesce(name, F.lit("")) != "") & (F.coalesce(year, F.lit("")) != ""), F.concat(name, F.lit(":"), F.lower(year))).otherwise("")


def author_years(texts: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """One row per author-year citation: ids, ord, surname, year, key."""
    found = texts.select(*id_cols, F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(CITATION), F.lit(0))).alias("ord", "citation"))
    out = found.withColumn("surname", F.regexp_extract("citation", CITATION, 1)).withColumn("year", F.regexp_extract("citation", CITATION, 2))
    return out.withColumn("key", key(F.col("surname"), F.col("year")))


#: The combining mark that a spacing mark before a letter stands for.
COMBINING = {
    "´": "\u0301", "ˊ": "\u0301", "`": "\u0300", "ˋ": "\u0300", "ˆ": "\u0302", "^": "\u0302", "¨": "\u0308", "˜": "\u0303", "~": "\u0303",
    "ˇ": "\u030c", "˘": "\u0306", "˙": "\u0307", "˚": "\u030a", "°": "\u030a", "¯": "\u0304", "¸": "\u0327",
}
#: The letters that each combining mark goes with.
LETTERS = {
    "\u0301": "aceilnorsuyz", "\u0300": "aeiou", "\u0302": "aeiou", "\u0308": "aeiouy", "\u0303": "ano", "\u030c": "cdelnrstz",
    "\u0306": "ag", "\u0307": "cegiz", "\u030a": "au", "\u0304": "aeiouy", "\u0327": "cst",
}
#: Ligatures, letters that elide before an apostrophe, and the ends of words that lose their W.
LIGATURES = "ﬀﬁﬂﬃﬄ"
ELIDED, AFTER_ELISION = "cdjlstn", "aeiouyh"
W_ENDS = ("hat", "hen", "here", "hich", "hile", "ho", "hom", "hy", "ith", "ould")


def _repairs() -> re.Pattern:
    """All that is repaired, as one pattern: each place of a text is looked at once."""
    either = "|".join(f"{re.escape(m)}\\s*[{LETTERS[c]}]" for m, c in COMBINING.items())
    elision = f"(?<=[{ELIDED}])´(?=[{AFTER_ELISION}])"
    split = rf"\b(?-i:[Ww])\s+(?-i:{'|'.join(W_ENDS)})\b"
    apart = "(?<=[A-Za-zÀ-ÖØ-öø-ÿ])\\s+(?=[\u0300-\u036f])"
    return re.compile(rf"(?i)\u00ad|[{LIGATURES}]|{elision}|{split}|{either}|{apart}")


REPAIRS = _repairs()


def _repaired(match: re.Match) -> str:
    found = match.group()
    if found == "\u00ad" or found.isspace():
        return ""
    if found == "´":
        return "’"
    if found[0] in COMBINING:
        return found[-1] + COMBINING[found[0]]
    return unicodedata.normalize("NFKC", found) if found in LIGATURES else "".join(found.split())


@F.pandas_udf(T.StringType())
def typography(texts: pd.Series) -> pd.Series:
    """Soft hyphens out, ligatures as letters, apostrophes and split words with W repaired, marks on their letters, composed form."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", REPAIRS.sub(_repaired, t)))


#: How a list of references is headed, with a section number or without; how an entry with a bracketed number
#: starts; and how other entries do: a number with a stop or bracket, or a bare one before a capital letter.
REFERENCES = r"(?i)^\s*(?:\d+(?:\.\d+)*[.)]?\s+)?(?:references(?:\s+and\s+notes)?|bibliography|works\s+cited|notes|endnotes)\s*:?[\s.]*$"
BRACKETED = r"^\s*\[(\d{1,3})\](?:\s|$)"
NUMBERED = r"^\s*(\d{1,3})(?:[.)](?:\s|$)|\s+(?=[\p{Lu}\p{Lt}]))"


def bibliography_flag(passages: DataFrame) -> DataFrame:
    """in_references: whether a references heading stands at or before the passage."""
    heading = F.col("text").rlike(REFERENCES)
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return passages.withColumn("in_references", F.max(F.coalesce(heading, F.lit(False))).over(w))


def reference_numbers(passages: DataFrame) -> DataFrame:
    """Numbered entries: doc_id, number, pos. A bracketed number starts an entry anywhere, other numbers only below the
    bibliography's heading; headings themselves and passages without text are none."""
    entries = passages.filter(~F.col("text").rlike(REFERENCES))
    below = F.when(F.col("in_references"), F.regexp_extract("text", NUMBERED, 1)).otherwise("")
    number = F.concat(F.regexp_extract("text", BRACKETED, 1), below)  # a text starts in one of the ways at most
    return entries.select("doc_id", "pos", number.alias("number")).filter("number != ''")


def tail_numbers(candidates: DataFrame) -> DataFrame:
    """Numbers that, where no heading helps, look like a bibliography: in the last 40 % of passages, two at least, from 3 at most, strictly rising."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    late = candidates.filter(F.col("pos") >= 0.6 * F.col("n_passages")).withColumn("_last", F.lag("number").over(w))
    good = late.groupBy("doc_id").agg(F.count("*").alias("n"), F.min_by("number", "pos").alias("first"), F.every(F.col("_last").isNull() | (F.col("number") > F.col("_last"))).alias("rising")).filter("n >= 2 and first <= 3 and rising")
    return late.join(good.select("doc_id"), "doc_id", "left_semi").drop("_last")


def number_citations(passages: DataFrame, references: DataFrame) -> DataFrame:
    """Bracketed numbers in running text that name a reference of the same document."""
    lists = passages.filter("not in_references").select("doc_id", "pos", F.explode(F.regexp_extract_all("text", F.lit(r"\[(\d{1,3}(?:\s*[,;–-]\s*\d{1,3})*)\]"), F.lit(1))).alias("_l"))
    numbers = lists.select("doc_id", "pos", F.explode(F.regexp_extract_all("_l", F.lit(r"\d{1,3}"), F.lit(0))).alias("number"))
    return numbers.join(references.select("doc_id", "number").distinct(), ["doc_id", "number"], "left_semi")


def is_superscript_citation(text: Column, numbers: Column, in_references: Column) -> Column:
    """A list of numbers of which one at least is a known reference, outside the bibliography."""
    return ~in_references & text.rlike(r"^\s*\d{1,3}(?:\s*[,;–-]\s*\d{1,3})*\s*$") & F.arrays_overlap(F.regexp_extract_all(text, F.lit(r"\d{1,3}"), F.lit(0)), numbers)


def link_author_years(citations: DataFrame, entries: DataFrame) -> DataFrame:
    """Citations with the first bibliography entry (doc_id, pos, text) of their key: the year stands in it, and its first author ends with the surname."""
    before = F.element_at(F.split("text", rf"\b{YEAR}\b", 2), 1)
    first = F.element_at(F.split(before, ",", 2), 1)
    e = entries.select("doc_id", F.col("pos").alias("entry"), plain_name(first).alias("_author"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(rf"\b({YEAR})\b"), F.lit(1)))).alias("_year"))
    c = citations.withColumn("_name", plain_name(F.col("surname"))).withColumn("_year", F.lower("year"))
    met = c.join(e.withColumn("_year", F.lower("_year")), ["doc_id", "_year"], "left").withColumn("entry", F.when(F.endswith("_author", F.col("_name")), F.col("entry")))
    return met.groupBy(*citations.columns).agg(F.min("entry").alias("entry"))


def mentions(passages: DataFrame, visuals: DataFrame) -> DataFrame:
    """Mentions of figures, tables and listings with the visual (doc_id, kind, number, item) of the exact number, else of its parent's."""
    found = passages.select("doc_id", "pos", F.posexplode(F.regexp_extract_all("text", F.lit(MENTION), F.lit(0))).alias("ord", "mention"))
    word = F.lower(F.regexp_extract("mention", MENTION, 1))
    found = found.withColumn("kind", F.when(word == "table", "table").when(word == "listing", "listing").otherwise("figure"))
    found = found.withColumn("parent", F.regexp_extract("mention", MENTION, 2)).withColumn("number", F.lower(F.concat("parent", F.regexp_extract("mention", MENTION, 3))))
    v = visuals.select("doc_id", "kind", F.lower("number").alias("number"), "item")
    exact = found.join(v, ["doc_id", "kind", "number"], "left").withColumnRenamed("item", "_exact")
    whole = v.withColumnsRenamed({"number": "parent", "item": "_whole"})
    return exact.join(whole, ["doc_id", "kind", "parent"], "left").select("doc_id", "pos", "ord", "mention", "kind", F.coalesce("_exact", "_whole").alias("item"))
