"""Queries over text, URL and Markdown functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions import text as tx
from ..functions import urls


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return register


@query("SELECT page_id, substr(sha256(url), 1, 24) AS document_key FROM pages")
def doc_id_from_url(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.document_id("url").alias("document_key"))


@query(r"SELECT page_id, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host_label FROM pages")
def url_host_label(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.host_label("url").alias("host_label"))


@query(r"""
SELECT page_id, CASE WHEN NOT regexp_matches(url, '(?i)^(https?|file)://') THEN 'library'
  WHEN regexp_matches(url, '(?i)\.pdf($|[?#])') THEN 'pdf' ELSE 'article' END AS route,
  regexp_matches(url, '(?i)\.pdf($|[?#])') AS is_pdf FROM pages
""")
def page_route(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.route("url").alias("route"), urls.points_to_pdf("url").alias("is_pdf"))


#: Addresses of a video site made from the pages' ids, for both parsers.
VIDEO_FORMS = ("https://www.youtube.com/watch?v=", "https://m.youtube.com/shorts/", "https://youtu.be/", "https://music.youtube.com/watch?v=", "https://youtube.com/live/")


@query(r"""
WITH u AS (SELECT page_id, page_id % 5 AS k, CASE WHEN page_id % 2 = 0 THEN 'v' || lpad(CAST(page_id AS VARCHAR), 10, '0') ELSE 'x' || CAST(page_id AS VARCHAR) END AS v FROM pages)
SELECT page_id, CASE k WHEN 0 THEN v WHEN 1 THEN CASE WHEN length(v) >= 11 THEN v ELSE '' END WHEN 2 THEN v WHEN 3 THEN '' ELSE CASE WHEN length(v) >= 11 THEN v ELSE '' END END AS video_id,
  CASE k WHEN 0 THEN v WHEN 1 THEN v WHEN 2 THEN v ELSE '' END AS saved_video_id FROM u
""")
def video_ids(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id")
    v = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("v"), F.lpad(F.col("page_id").cast("string"), 10, "0"))).otherwise(F.concat(F.lit("x"), F.col("page_id").cast("string")))
    u = F.concat(F.element_at(F.array(*map(F.lit, VIDEO_FORMS)), (F.col("page_id") % 5 + 1).cast("int")), v)
    return p.select("page_id", urls.video_id(u).alias("video_id"), urls.saved_video_id(u).alias("saved_video_id"))


@query(r"""
SELECT page_id, coalesce(nullif(regexp_replace(coalesce(nullif(url_decode(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]+.*?([^/]*)$', 1)), ''), regexp_extract(url, '^https?://([^/?#:]+)', 1)), '(?i)\.pdf$', ''), ''), 'Saved document') AS title FROM pages
""")
def address_titles(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.title_of(F.lit(None).cast("string"), "url").alias("title"))


@query(r"SELECT doc_id, CAST(len(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')) AS BIGINT) AS words FROM documents")
def word_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.word_count("text").alias("words"))


@query(r"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+') AS all_terms FROM documents),
x AS (SELECT doc_id, unnest(all_terms) AS term, generate_subscripts(all_terms, 1) AS place FROM t),
f AS (SELECT doc_id, term, min(place) AS place FROM x WHERE length(term) >= 2 GROUP BY 1, 2),
r AS (SELECT doc_id, array_to_string(list(term ORDER BY length(term) DESC, place), ' ') AS terms, CAST(count(*) AS BIGINT) AS n_terms FROM f GROUP BY 1)
SELECT d.doc_id, coalesce(md5(terms), md5('')) AS terms_md5, coalesce(n_terms, 0) AS n_terms FROM documents d LEFT JOIN r USING (doc_id)
""")
def query_terms_distinct(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", tx.query_terms("text").alias("t"))
    return d.select("doc_id", F.md5(F.array_join("t", " ")).alias("terms_md5"), F.size("t").cast("bigint").alias("n_terms"))


@query(r"SELECT doc_id, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 280) AS excerpt, CAST(length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS BIGINT) AS length FROM documents")
def excerpts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.excerpt("text").alias("excerpt"), F.length(tx.collapse("text")).cast("bigint").alias("length"))


@query(r"""
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '\s+([,.;:!?])', '\1', 'g'), '\s+', ' ', 'g'))) AS tight_md5 FROM documents
""")
def tightened(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(tx.tighten("text")).alias("tight_md5"))


@query(r"""
WITH s AS (SELECT doc_id, text, list_filter(list_transform(regexp_extract_all(regexp_replace(text, '(?i)\b(Figs?)\.', '\1' || chr(57856), 'g'), '[^.!?]+(?:[.!?]+|$)'),
  lambda x: regexp_replace(replace(x, chr(57856), '.'), '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS parts FROM documents)
SELECT doc_id, CAST(greatest(len(parts), 1) AS BIGINT) AS n_sentences, md5(CASE WHEN len(parts) > 0 THEN array_to_string(parts, '|') ELSE text END) AS sentences_md5 FROM s
""")
def sentences(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", tx.sentences("text").alias("s"))
    return d.select("doc_id", F.size("s").cast("bigint").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("sentences_md5"))


@query()
def sentence_packs(spark, sf_dir):
    """Pieces of at most 340 characters unless one sentence is longer; tested against a plain loop."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.explode(tx.pack("text")).alias("piece"))
    return d.groupBy("doc_id").agg(F.count("*").alias("n_pieces"), F.max(F.length("piece")).alias("longest"))


@query(r"SELECT event_id, CAST(CAST(floor(value * 1000 / 60000) AS BIGINT) AS VARCHAR) || ':' || lpad(CAST(CAST(floor(value * 1000 / 1000) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS label FROM (SELECT event_id, greatest(value, 0) AS value FROM events)")
def video_time_labels(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", (F.greatest(F.col("value"), F.lit(0)) * 1000).alias("ms"))
    return e.select("event_id", tx.clock("ms").alias("label"))


@query(r"""
SELECT conv_id, turn, regexp_replace(text, '([\\`*_\[\]<>])', '\\\1', 'g') AS escaped FROM conversations
""")
def escaped_turns(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", md.escape_inline("text").alias("escaped"))


@query(r"""
SELECT source, array_to_string(list('| ' || line || ' |' ORDER BY k), chr(10)) AS markdown FROM (
  SELECT source, 0 AS k, 'lang | documents' AS line FROM documents GROUP BY source
  UNION ALL SELECT source, 1, '--- | ---' FROM documents GROUP BY source
  UNION ALL SELECT source, 1 + row_number() OVER (PARTITION BY source ORDER BY lang), lang || ' | ' || CAST(n AS VARCHAR) FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2))
GROUP BY source
""")
def markdown_tables(spark, sf_dir):
    """One table per source: documents by language."""
    n = read(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").cast("string").alias("n"))
    cell = lambda c: F.struct(c.alias("text"))
    row = F.struct(F.array(cell(F.col("lang")), cell(F.col("n"))).alias("cells"))
    head = F.array(F.struct(F.array(cell(F.lit("lang")), cell(F.lit("documents"))).alias("cells")))
    t = n.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("lang", row.alias("row")))).alias("rows"))
    return t.select("source", md.table(F.concat(head, F.transform("rows", lambda r: r["row"]))).alias("markdown"))


@query(r"""
SELECT conv_id, turn, repeat('`', 3) || chr(10) || regexp_replace(text, '\s+$', '') || chr(10) || repeat('`', 3) AS block FROM conversations WHERE NOT contains(text, '`')
""")
def code_blocks(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").filter("text is not null")
    return c.select("conv_id", "turn", md.fenced_code("text").alias("block"))


@query(r"""
SELECT benchmark.item_id, left(regexp_replace(regexp_replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '[^\p{L}\p{N}]+', '-', 'g'), '^-|-$', '', 'g'), 52) AS slug,
  left(trim(regexp_replace(regexp_replace(text, '[\\/:*?"<>|\x00-\x1F]', ' ', 'g'), '\s+', ' ', 'g')), 120) || '.md' AS file_name FROM benchmark
""")
def slugs(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", tx.slug("text").alias("slug"), tx.file_name("text").alias("file_name"))


@query(r"""
SELECT conv_id, turn, translate(text, '‘’ʼ“”', '''''''') AS quotes, regexp_matches(coalesce(text, ''), '^\s*$') AS blank FROM conversations
""")
def speech_normalise(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", tx.reader_quotes("text").alias("quotes"), (tx.ws_trim("text") == "").alias("blank"))


@query(r"""
SELECT doc_id, md5(array_to_string(list_filter(list_transform(regexp_extract_all(text, '[^,;:.!?]*[,;:.!?]|[^,;:.!?]+$'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), '|')) AS parts_md5 FROM documents
""")
def punctuation_parts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(tx.split_keeping_punctuation("text"), "|")).alias("parts_md5"))


@query(r"""
SELECT source, CAST(list_sort(list(n_chars))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS BIGINT) AS median_chars FROM documents GROUP BY source
""")
def upper_median(spark, sf_dir):
    """The upper median length per source, from exact ranks rather than a collected list."""
    from pyspark.sql import Window

    d = read(spark, sf_dir, "documents").select("source", "n_chars")
    counts = d.groupBy("source", "n_chars").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source").orderBy("n_chars")
    ranked = counts.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy("source")))
    # the element at floor(n / 2): the first value whose running count exceeds it
    return ranked.filter("upto > floor(total / 2)").groupBy("source").agg(F.min("n_chars").alias("median_chars"))
