"""Cases that the given tables don't hold."""

from pyspark.sql import functions as F

from leafmill.operators import views

PASSAGES = "doc_id bigint, pos int, type string, text string, table_rows array<struct<cells:array<struct<text:string>>>>"


def test_summary_parts_and_sample(spark):
    rows = [
        (1, 0, "heading", "Title", None),
        (1, 1, "table", None, [([("a",), (None,), ("b",)],), ([("",)],), ([("mail x@example.org",)],)]),
        (1, 2, "image", None, None),
        (2, 0, None, " \n", None),
        (None, 0, "paragraph", "no id", None),
    ]
    parts = views.summary_parts(spark.createDataFrame(rows, PASSAGES))
    got = sorted((str(r.doc_id), r.pos, r.part, r.text) for r in parts.collect())
    assert got == [("1", 0, 0, "Title"), ("1", 1, 0, "a | b"), ("1", 1, 1, "mail x at example dot org"), ("None", 0, 0, "no id")]
    samples = {r.doc_id: r.sample for r in views.language_sample(parts).collect()}
    assert samples == {1: "Title\na | b\nmail x at example dot org", None: "no id"}
    assert views.summary_parts(spark.createDataFrame([], PASSAGES)).count() == 0


def test_language_and_titles(spark):
    row = spark.range(1).select(
        views.language(F.lit("EN_us")).alias("a"), views.language(F.lit(None).cast("string"), F.lit("fr-CA")).alias("b"), views.language(F.lit("-x")).alias("c"),
        views.can_summarise(F.lit(None).cast("string")).alias("d"), views.shown_title(F.lit(""), F.lit(None).cast("string"), F.lit("https://Example.org/x")).alias("e"),
        views.details(F.lit(None).cast("string"), F.lit(""), F.lit(None).cast("string")).alias("f"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.f) == ("en", "fr", "en", False, "")
    assert row.e.lower() == "example.org"


def test_generated_text_without_messages(spark):
    schema = "k int, text string, messages array<struct<role:string,content:string>>"
    df = spark.createDataFrame([(1, None, None), (2, None, []), (3, None, [("user", "q"), ("assistant", None)]), (4, " x ", [("a", "y")])], schema)
    got = {r.k: r.out for r in df.select("k", views.generated_text("text", "messages").alias("out")).collect()}
    assert got == {1: "", 2: "", 3: "", 4: "x"}


def test_offsets_and_article_of_empty_texts(spark):
    rows = [(1, 0, None), (1, 1, ""), (1, 2, "ab"), (1, 3, ""), (1, 4, "c"), (2, 0, "d")]
    out = views.text_offsets(spark.createDataFrame(rows, "video_id bigint, seq int, text string"))
    text, want = "", {}
    for seq, t in [(s, t or "") for v, s, t in rows if v == 1]:  # as the text is put together
        text += " " if text else ""
        want[seq] = len(text)
        text += t
    assert {r.seq: r.text_offset for r in out.filter("video_id = 1").collect()} == want
    p = spark.createDataFrame([(1, 0, "heading", "A & b"), (1, 1, "paragraph", None), (2, 0, "heading", "h")], "video_id bigint, pos int, type string, text string")
    got = {r.video_id: r for r in views.transcript_article(p).collect()}
    assert (got[1].content, got[1].text_content, got[1].length, got[1].excerpt) == ("<h2>A &amp; b</h2>\n<p></p>", "A & b\n", 5, "")
    assert got[2].excerpt == ""
