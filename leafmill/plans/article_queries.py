"""Queries over saved articles: captions, chats, mails, Markdown, references, summaries and repairs, each with its SQL.

The given tables hold none of these formats, so each query first puts the rows of a whole table into the format (an XML
of captions, a saved chat page, a Markdown file, a list of references) and then applies the operator to it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import citations, layout, models, page_rules
from ..sources import articles, captions
from .text_queries import read

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of all conversations with a key of their own and their words as plain letters."""
    plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9]+", " "))
    key = F.col("conv_id") * 1000 + F.col("turn")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", key.alias("key"), plain.alias("plain"))


TURNS = "t AS (SELECT conv_id, turn, role, text, conv_id * 1000 + turn AS key, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g')) AS plain FROM conversations)"


@query(f"WITH {TURNS} SELECT key, CAST(0 AS INTEGER) AS seq, trim(plain || ' & more') AS text, (turn + 0.5) * 1000.0::DOUBLE AS start_ms, 2000.0::DOUBLE AS duration_ms FROM t")
def caption_rows(spark, sf_dir):
    xml = F.concat(F.lit('<text start="'), (F.col("turn") + 0.5).cast("string"), F.lit('" dur="2">'), F.col("plain"), F.lit(" &amp; <b>more</b> [Music]</text>"))
    return captions.caption_chunks(turns(spark, sf_dir).select("key", xml.alias("xml")), "key", "xml")


@query("""
WITH v AS (SELECT page_id, page_id % 50 + 1 AS m FROM pages WHERE page_id % 3 <> 0)
SELECT page_id, 'Start' AS text, 0.0::DOUBLE AS start_ms FROM v UNION ALL SELECT page_id, 'Part ' || CAST(m AS VARCHAR), (m * 60 + 5) * 1000.0::DOUBLE FROM v
UNION ALL SELECT page_id, 'End', 3603000.0::DOUBLE FROM v
""")
def chapter_rows(spark, sf_dir):
    m = (F.col("page_id") % 50 + 1).cast("string")
    several = F.concat(F.lit("0:00 Start\nno time here\n• "), m, F.lit(":05 - Part "), m, F.lit("\n1:00:03: End\n2:00:00 beyond"))
    text = F.when(F.col("page_id") % 3 == 0, "0:00 alone").otherwise(several)
    videos = read(spark, sf_dir, "pages").select("page_id", text.alias("description"), F.lit(3600.0).alias("duration"))
    return captions.description_chapters(videos, "page_id")


@query("SELECT doc_id, source AS title, lang AS language, md5('# ' || text) AS body_md5 FROM documents")
def front_matter_fields(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    file = F.concat(F.lit('---\ntitle: "'), "source", F.lit("\"\nnot a field\nlanguage: x\nlanguage: '"), "lang", F.lit("'\n---\n# "), "text")
    made = articles.front_matter(file)
    return d.select("doc_id", made["metadata"]["title"].alias("title"), made["metadata"]["language"].alias("language"), F.md5(made["body"]).alias("body_md5"))


@query(f"""
WITH {TURNS}, m AS (
  SELECT key, 'heading' AS type, role || ' x' AS text, 1 AS o FROM t UNION ALL
  SELECT key, 'paragraph', plain, 2 FROM t WHERE plain <> '' UNION ALL SELECT key, 'paragraph', 'a label, done', 3 FROM t)
SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY o) - 1 AS INTEGER) AS pos, type, text FROM m
""")
def markdown_files(spark, sf_dir):
    parts = [F.lit("## "), F.col("role"), F.lit(" *x*\n```\ncode\n```\n"), F.col("plain"), F.lit("\n\n- a [label](http://x.org/(y)) `code` , done\n[d]: http://z.org\n|---|")]
    return articles.markdown_rows(turns(spark, sf_dir).select("key", F.concat(*parts).alias("text")), "key", "text")


@query(f"""
WITH {TURNS} SELECT key, CAST(0 AS INTEGER) AS pos, role, CASE WHEN turn % 2 = 0 THEN 'Me' WHEN role = 'user' THEN 'You' WHEN role = 'assistant' THEN 'ChatGPT' ELSE 'Message' END AS author, plain AS text
FROM t WHERE plain <> ''
""")
def saved_chats(spark, sf_dir):
    label = F.when(F.col("turn") % 2 == 0, '<h5 class="sr-only">Me:</h5>').otherwise("")
    parts = [
        F.lit('<div data-testid="conversation-turn-1">'), label, F.lit('<div data-message-author-role="'), F.col("role"), F.lit('"><div class="markdown">'),
        F.col("plain"), F.lit("<button>Copy</button></div></div></div>"),
    ]
    return articles.chats(turns(spark, sf_dir).select("key", F.concat(*parts).alias("html")), "key")


@query(f"""
WITH {TURNS} SELECT key, CAST(0 AS INTEGER) AS pos, role AS author, CASE WHEN turn % 2 = 0 THEN '' ELSE 'May 1' END AS date,
  role || CASE WHEN turn % 2 = 0 THEN '' ELSE ' - May 1' END AS heading, plain AS text FROM t WHERE plain <> ''
""")
def saved_mails(spark, sf_dir):
    date = F.when(F.col("turn") % 2 == 0, "").otherwise('<span class="g3" title="May 1">1d</span>')
    parts = [
        F.lit('<div class="adn ads"><span class="gD" name="'), F.col("role"), F.lit('">x</span>'), date, F.lit('<div class="a3s">'), F.col("plain"),
        F.lit('<div class="gmail_quote">old</div><blockquote type="cite">older</blockquote></div></div>'),
    ]
    return articles.mails(turns(spark, sf_dir).select("key", F.concat(*parts).alias("html")), "key")


@query("""
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://i.org/p?name=large&x=' || CAST(page_id AS VARCHAR) ELSE 'https://i.org/' || CAST(page_id AS VARCHAR) || '?name=large' END AS image FROM pages
""")
def large_images(spark, sf_dir):
    n = F.col("page_id").cast("string")
    url = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://i.org/p?name=small&x="), n)).otherwise(F.concat(F.lit("https://i.org/"), n))
    return read(spark, sf_dir, "pages").select("page_id", articles.large_image(url).alias("image"))


@query(f"""
WITH {TURNS}, a AS (SELECT key, role, CASE WHEN turn % 3 = 0 THEN 'fall back' WHEN plain = '' THEN 'fall back' ELSE plain END AS text, turn % 3 <> 0 AND plain <> '' AS good FROM t)
SELECT key, text, substr(text, 1, 280) AS excerpt, CAST(length(text) AS INTEGER) AS length, CASE WHEN good THEN role ELSE 'article' END AS kind FROM a
""")
def article_results(spark, sf_dir):
    t = turns(spark, sf_dir)
    own = F.struct(F.when(F.col("turn") % 3 != 0, F.col("role")).alias("kind"), F.concat(F.lit("  "), "plain", F.lit(" \n ")).alias("text"))
    return t.select("key", articles.article(F.lit("T"), own, F.lit(" fall\n back ")).alias("a")).select("key", "a.text", "a.excerpt", "a.length", "a.kind")


@query(f"""
WITH {TURNS}, p AS (SELECT *, turn % 2 = 0 AS is_p, sum(CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM t)
SELECT conv_id AS doc_id, turn AS pos, CASE WHEN is_p THEN n * 1.5::DOUBLE END AS first_start FROM p
""")
def timed_sentences(spark, sf_dir):
    t = turns(spark, sf_dir).select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.when(F.col("turn") % 2 == 0, "paragraph").otherwise("image").alias("type"), "text")
    per = t.groupBy("doc_id").agg(F.count(F.when(F.col("type") == "paragraph", 1)).alias("n")).filter("n > 0")
    starts = per.select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("ord"))
    starts = starts.withColumn("sentence_starts", F.array(F.col("ord") * 1.5))
    return articles.timed_paragraphs(t, starts).select("doc_id", "pos", F.try_element_at("sentence_starts", F.lit(1)).cast("double").alias("first_start"))


def reference_passages(spark, sf_dir) -> DataFrame:
    """Each conversation as an article: a citing line, a heading, then numbered entries."""
    number = (F.col("turn") - F.min("turn").over(_in_order()) - 1).cast("string")
    place = F.col("turn") - F.min("turn").over(_in_order())
    text = F.when(place == 0, "See [1, 3] and [9].").when(place == 1, "2. References").otherwise(F.concat(F.lit("["), number, F.lit("] x"), "plain"))
    return turns(spark, sf_dir).select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), text.alias("text"), place.alias("place"))


def _in_order():
    from pyspark.sql import Window

    return Window.partitionBy("conv_id")


PLACES = f"{TURNS}, p AS (SELECT conv_id AS doc_id, turn AS pos, turn - min(turn) OVER (PARTITION BY conv_id) AS place, plain FROM t)"


@query(f"WITH {PLACES} SELECT doc_id, pos, CAST(place - 1 AS VARCHAR) AS number FROM p WHERE place >= 2")
def reference_entries(spark, sf_dir):
    return citations.reference_numbers(citations.bibliography_flag(reference_passages(spark, sf_dir))).select("doc_id", "pos", "number")


@query(f"WITH {PLACES} SELECT c.doc_id, c.pos, CAST(e.place - 1 AS VARCHAR) AS number FROM p c JOIN p e ON c.doc_id = e.doc_id WHERE c.place = 0 AND e.place IN (2, 4, 10)")
def cited_numbers(spark, sf_dir):
    flagged = citations.bibliography_flag(reference_passages(spark, sf_dir))
    return citations.number_citations(flagged, citations.reference_numbers(flagged)).select("doc_id", "pos", "number")


@query(f"""
WITH {PLACES}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM p), l AS (SELECT * FROM n WHERE place >= 0.6 * n),
g AS (SELECT doc_id FROM l GROUP BY doc_id HAVING count(*) >= 2 AND min(place) <= 3)
SELECT doc_id, place AS pos, place AS number FROM l WHERE doc_id IN (SELECT doc_id FROM g)
""")
def tail_numbering(spark, sf_dir):
    rows = reference_passages(spark, sf_dir)
    sizes = rows.groupBy("doc_id").agg(F.count("*").alias("n_passages"))
    found = citations.tail_numbers(rows.join(sizes, "doc_id").select("doc_id", F.col("place").alias("pos"), F.col("place").alias("number"), "n_passages"))
    return found.select("doc_id", "pos", "number")


@query(f"WITH {PLACES} SELECT doc_id, place AS page, CASE WHEN place < 4 THEN 4 ELSE 1 END AS lines FROM p WHERE place NOT IN (1, 2)")
def pages_without_contents(spark, sf_dir):
    """Page 1 is headed Contents, pages 1 and 2 hold entries, page 3 text."""
    place = F.col("place")
    entries = F.array(*(F.lit(f"Chapter {k} .... {k + 10}") for k in range(3)))
    lines = F.when(place == 1, F.concat(F.array(F.lit("Contents")), entries)).when(place == 2, F.concat(F.array(F.lit("More text")), entries))
    lines = lines.when(place < 4, F.array(*(F.lit(f"line {c}") for c in "abcd"))).otherwise(F.array(F.lit("last")))
    rows = reference_passages(spark, sf_dir).select("doc_id", place.alias("page"), F.explode(lines).alias("text"))
    return layout.drop_contents(rows).groupBy("doc_id", "page").agg(F.count("*").cast("int").alias("lines"))


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, 'Line ' || l_returnflag || ' of ' || CAST(l_orderkey AS VARCHAR) || ' x' || CAST(l_linenumber AS VARCHAR) AS title FROM lineitem WHERE l_linenumber <= 3)
SELECT l_orderkey AS doc_id, title FROM b QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_extendedprice) = 1
""")
def document_title_blocks(spark, sf_dir):
    text = F.concat(F.lit("Line\n"), "l_returnflag", F.lit(" of "), F.col("l_orderkey").cast("string"), F.lit(" x"), F.col("l_linenumber").cast("string"))
    blocks = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.col("l_quantity").alias("font_size"), F.col("l_extendedprice").alias("y1"), text.alias("text"))
    return page_rules.title_block(blocks)


@query(f"WITH {TURNS} SELECT key, turn % 3 = 0 OR plain = '' OR regexp_matches(plain, '(?i)\\b(ready to provide|provided source material|based on these observations)\\b') AS meta FROM t")
def meta_responses(spark, sf_dir):
    lead = F.when(F.col("turn") % 3 == 0, "I'm ready to summarize ").otherwise("")
    answer = F.when((F.col("plain") == "") & (F.col("turn") % 3 != 0), "").otherwise(F.concat(lead, "plain"))
    return turns(spark, sf_dir).select("key", tx.is_meta_response(answer).alias("meta"))


@query(f"WITH {TURNS} SELECT key, trim(role || ' c' || CAST(conv_id AS VARCHAR) || ' ' || plain) AS summary FROM t")
def plain_summaries(spark, sf_dir):
    parts = [F.lit("- **"), F.col("role"), F.lit("** **[c"), F.col("conv_id").cast("string"), F.lit("](u)**\n  2) <SOURCE_NOTES>"), F.col("plain"), F.lit("</SOURCE>")]
    return turns(spark, sf_dir).select("key", tx.plain_summary(F.concat(*parts)).alias("summary"))


@query(f"""
WITH {TURNS} SELECT key, CASE turn % 3 WHEN 0 THEN 'Write short notes on the main points of this section.' WHEN 1 THEN 'Merge these notes and drop what repeats.' ELSE 'Write a plain summary in one paragraph.' END
  || chr(10) || chr(10) || plain AS prompt FROM t
""")
def summary_prompts(spark, sf_dir):
    mode = F.element_at(F.array(F.lit("section"), F.lit("reduction"), F.lit("summary")), (F.col("turn") % 3 + 1).cast("int"))
    return turns(spark, sf_dir).select("key", tx.summary_prompt(mode, "plain").alias("prompt"))


@query(f"WITH {TURNS} SELECT key, array_to_string(list_transform(string_split(plain, ''), lambda c: CASE WHEN c = '' THEN '' ELSE chr(ascii(c) + 3) END), '') AS shifted FROM t WHERE plain <> ''")
def shifted_texts(spark, sf_dir):
    return turns(spark, sf_dir).filter("plain != ''").select("key", tx.shifted_text("plain", 3).alias("shifted"))


@query("SELECT conv_id, turn, md5(text) AS text_md5, length(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;'))::INTEGER AS escaped FROM conversations")
def escaped_and_decoded(spark, sf_dir):
    escaped = tx.escape_html("text")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(captions.decode_entities(escaped)).alias("text_md5"), F.length(escaped).alias("escaped"))


@query(f"""
WITH {TURNS} SELECT key, coalesce(nullif(substr(trim(regexp_replace(regexp_replace(role || ': ' || plain, '[\\\\/:*?"<>|]', ' ', 'g'), '\\s+', ' ', 'g')), 1, 120), ''), 'article') || '.pdf' AS file FROM t
""")
def file_names(spark, sf_dir):
    return turns(spark, sf_dir).select("key", tx.file_name(F.concat("role", F.lit(": "), "plain"), "pdf").alias("file"))


@query(r"""
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(translate(text, '‘’“”', '''''""'), '…', '...'), '[–—()\[\]{}]', ', ', 'g'), '[\s\x{a0}\x{0b}]+', ' ', 'g'))) AS phonemes_md5 FROM documents
""")
def phoneme_texts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(tx.phoneme_text("text")).alias("phonemes_md5"))


@query("SELECT page_id, 'now go ' || url AS text FROM pages")
def repaired_urls(spark, sf_dir):
    cut = F.replace(F.col("url"), F.lit("://"), F.lit(": // "))
    return read(spark, sf_dir, "pages").select("page_id", tx.repair_urls(F.concat(F.lit("now go "), cut)).alias("text"))


@query("SELECT page_id, regexp_matches(url, '^https?://[A-Za-z0-9]') AS wrapped FROM pages")
def wrapped_urls(spark, sf_dir):
    head, tail = F.regexp_extract("url", "^([a-z]+://)", 1), F.regexp_replace("url", "^[a-z]+://", "")
    return read(spark, sf_dir, "pages").select("page_id", page_rules.wrapped_url(F.concat(F.lit("see "), head), tail).alias("wrapped"))


@query("SELECT doc_id, 'fine ' || source || ' d’un café What Müller soft ' || lang AS text FROM documents")
def typographic_texts(spark, sf_dir):
    text = F.concat(F.lit("ﬁne "), "source", F.lit(" d´un caf´e W hat M¨uller so­ft "), "lang")
    return read(spark, sf_dir, "documents").select("doc_id", citations.typography(text).alias("text"))


@query(f"""
WITH {TURNS} SELECT key, turn % 4 = 0 OR (turn % 4 = 1) OR (turn % 4 = 2 AND regexp_matches(plain, '(?i)^(Figure|Fig|Table)\\s+\\d+')) AS interrupts FROM t
""")
def visual_interruptions(spark, sf_dir):
    k = F.col("turn") % 4
    text = F.when(k == 1, F.concat(F.lit("Fig. 2a: "), "plain")).otherwise(F.col("plain"))
    return turns(spark, sf_dir).select("key", page_rules.interrupts(F.when(k == 0, "table").otherwise("paragraph"), k != 3, F.lit(None).cast("string"), text).alias("interrupts"))


@query(f"WITH {TURNS} SELECT key, CASE turn % 4 WHEN 0 THEN 'See figure.' WHEN 1 THEN 'See mathematical formula.' WHEN 2 THEN 'See table.' ELSE '' END AS spoken FROM t")
def spoken_visuals(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("image", "formula", "table", "code"))), (F.col("turn") % 4 + 1).cast("int"))
    return turns(spark, sf_dir).select("key", F.array_join(tx.spoken_visual(kind, "plain"), " ").alias("spoken"))


def letter_counts():
    """A stand-in model: the length of a text and the number of two of its letters."""
    return lambda texts: np.array([[len(t), t.count("a"), t.count("e")] for t in texts], float)


@query(f"""
WITH {TURNS}, v AS (SELECT key, length(plain)::DOUBLE AS n, (length(plain) - length(replace(plain, 'a', '')))::DOUBLE AS a, (length(plain) - length(replace(plain, 'e', '')))::DOUBLE AS e FROM t WHERE plain <> '')
SELECT key, round(n / sqrt(n * n + a * a + e * e), 4) AS x, round(a / sqrt(n * n + a * a + e * e), 4) AS y, round(e / sqrt(n * n + a * a + e * e), 4) AS z FROM v
""")
def unit_embeddings(spark, sf_dir):
    made = models.embed(turns(spark, sf_dir).select("key", "plain"), letter_counts, "plain")
    part = lambda k, name: F.round(F.col("vector")[k].cast("double"), 4).alias(name)
    return made.select("key", part(0, "x"), part(1, "y"), part(2, "z"))
