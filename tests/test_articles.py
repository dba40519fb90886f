from pyspark.sql import functions as F

from leafmill.operators import page_rules
from leafmill.sources import articles


def test_chat_page():
    page = """<div data-testid="conversation-turn-1"><h5 class="sr-only">You said:</h5><div data-message-author-role="user"><div class="whitespace-pre-wrap">Hello <button>Copy</button></div></div></div>
    <div data-testid="conversation-turn-2"><div data-message-author-role="assistant"><div class="markdown"><p>Hi</p><div class="markdown">there</div></div></div></div>
    <div data-testid="conversation-turn-3"><div data-message-author-role="tool"> </div></div>"""
    assert articles.chat_turns(page) == [{"role": "user", "author": "You said", "text": "Hello"}, {"role": "assistant", "author": "ChatGPT", "text": "Hithere"}]
    assert articles.chat_turns(None) == []


def test_mail_thread():
    page = """<div class="adn ads"><span class="gD" name="Ann">x</span><span class="g3" title="May 1">1</span><div class="a3s">Text<blockquote type="cite">old</blockquote><div class="gmail_quote">q</div></div></div>
    <div class="adn ads"><div class="a3s"> </div></div><div class="adn ads"><div class="a3s">B</div></div>"""
    assert [(m["heading"], m["text"]) for m in articles.mail_messages(page)] == [("Ann - May 1", "Text"), ("Unknown sender", "B")]


def test_rows_of_chats(spark):
    df = spark.createDataFrame([(1, None), (2, '<div data-testid="conversation-turn-1"><div data-message-author-role="user">q</div></div>')], "page_id bigint, html string")
    assert [(r.page_id, r.pos, r.role, r.text) for r in articles.chats(df).collect()] == [(2, 0, "user", "q")]


def test_markdown():
    md = "# T *x*\n\nA [link](u) and ![i](j) text\nnext.\n\n```\ncode\n```\n![img](x)\n[a]: http://b\n| --- |\n[![badge](a)\n](https://c)\n- item"
    assert articles.markdown_passages(md) == [{"type": "heading", "text": "T x"}, {"type": "paragraph", "text": "A link and text next."}, {"type": "paragraph", "text": "item"}]


def test_front_matter(spark):
    row = spark.createDataFrame([("---\ntitle: \"A: b\"\nx: 'y'\nx: z\n---\nBody",), ("plain",)], "t string").select(articles.front_matter(F.col("t")).alias("f")).collect()
    assert row[0].f.metadata == {"title": "A: b", "x": "z"} and row[0].f.body == "Body"
    assert row[1].f.metadata == {} and row[1].f.body == "plain"


def test_player(spark):
    j = '{"videoDetails":{"videoId":"v","title":"","lengthSeconds":"9"},"captions":{"playerCaptionsTracklistRenderer":{"captionTracks":[{"languageCode":"de","baseUrl":"d"},{"languageCode":"en-GB","baseUrl":"e"}]}}}'
    rows = spark.createDataFrame([(j,), ("{}",)], "j string").select(articles.video(F.col("j")).alias("v")).collect()
    assert (rows[0].v.title, rows[0].v.duration, rows[0].v.track_url) == ("YouTube video", 9.0, "e") and rows[1].v is None


def test_images_and_articles(spark):
    one = spark.range(1).select(articles.large_image(F.lit("https://a/b?name=small&x=1")).alias("a"), articles.large_image(F.lit("https://a/b")).alias("b"))
    assert tuple(one.first()) == ("https://a/b?name=large&x=1", "https://a/b?name=large")
    df = spark.createDataFrame([("k", " a  b "), (None, "c"), ("k", " ")], "kind string, text string")
    got = [r.a for r in df.select(articles.article(F.lit("T"), F.struct("kind", "text"), F.lit("fall")).alias("a")).collect()]
    assert [(g.text, g.kind) for g in got] == [("a b", "k"), ("fall", "article"), ("fall", "article")]


def test_page_rules(spark):
    value = lambda c: spark.range(1).select(c.alias("v")).first()[0]
    block = "\n".join(["1: a much longer line of text here", "2: b", "Input: c", "4: another rather long line of it", "x"])
    assert value(page_rules.structured_rows(F.lit(block))) and not value(page_rules.structured_rows(F.lit("a\nb")))
    assert value(page_rules.wrapped_url(F.lit("see https://"), F.lit("a.org"))) and value(page_rules.wrapped_url(F.lit("www.a."), F.lit("com/x")))
    assert not value(page_rules.wrapped_url(F.lit("plain"), F.lit("text")))
    none = F.lit(None).cast("string")
    assert value(page_rules.interrupts(F.lit("paragraph"), F.lit(True), none, F.lit("Fig. 2: x"))) and not value(page_rules.interrupts(F.lit("paragraph"), F.lit(False), none, F.lit("Fig. 2")))


def test_oblique_tables(spark):
    tables = spark.createDataFrame([(1, 1, 7, 100.0, 100.0, 300.0, 300.0, 500.0, 700.0)], "doc_id int, page int, item int, x1 double, y1 double, x2 double, y2 double, page_width double, page_height double")
    schema = "doc_id int, page int, text string, text_angle double, x1 double, y1 double, x2 double, y2 double"
    angled = spark.createDataFrame([(1, 1, "slanted", 0.8, 110.0 + k, 120.0, 150.0, 130.0) for k in range(3)], schema)
    assert page_rules.oblique_tables(tables, angled).first().oblique
    assert not page_rules.oblique_tables(tables, angled.withColumn("text_angle", F.lit(0.05))).first().oblique


def test_drop_caps_fonts_listings():
    t = lambda k, text, size, x, y: {"item_index": k, "token_index": 0, "text": text, "font_size": size, "is_math": False, "x1": x, "x2": x + 9, "y1": y, "y2": y + size, "baseline_y": y + size}
    tokens = [t(0, "O", 36.0, 0, 0), t(1, "nce", 10.0, 40, 0), t(2, "upon", 10.0, 40, 12), t(3, "a", 10.0, 40, 24)]
    assert page_rules.drop_cap(tokens, "Text") is tokens[0] and page_rules.drop_cap(tokens, "Title") is None
    shifted = "".join(chr(ord(c) - 29) for c in "some words in a shifted font here")
    assert page_rules.font_shift([shifted]) == 29 and page_rules.font_shift(["plain text"]) == 0
    r = lambda text, x, y: {"text": text, "x1": float(x), "x2": x + 6.0 * len(text), "y1": float(y), "y2": y + 10.0}
    assert page_rules.listings([r("Listing 1: code", 0, 0), r("for x:", 0, 14), r("go(x)", 24, 28), r("Far away", 0, 200)]) == [{"number": "1", "text": "for x:\n    go(x)"}]


def test_titles_and_overviews(spark):
    blocks = spark.createDataFrame([(1, 1, "A Long Ti-\ntle here", 20.0, 5.0), (1, 1, "Body text", 10.0, 9.0), (1, 4, "Larger but late", 40.0, 0.0)], "doc_id int, page int, text string, font_size double, y1 double")
    assert page_rules.title_block(blocks).first().title == "A Long Title here"
    rows = '[{"cells":[{"text":"a"},{"text":"1"}]},{"cells":[{"text":"b"},{"text":"2"}]},{"cells":[{"text":"c"},{"text":"S3"}]}]'
    kind = "array<struct<cells:array<struct<text:string>>>>"
    p = spark.createDataFrame([(1, 1, "table", None, rows), (1, 1, "paragraph", "Supplementary overview", None), (1, 2, "paragraph", "Appendix A", None)], "doc_id int, page int, type string, text string, t string").withColumn("table_rows", F.from_json("t", kind)).drop("t")
    assert [r.text for r in page_rules.supplementary_tables(p).collect()] == ["Appendix A"]
