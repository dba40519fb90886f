"""Cases derived by hand from the rules."""

import pytest
from pyspark.sql import functions as F

from leafmill.functions import geometry as geo
from leafmill.functions import markdown as md
from leafmill.functions import text as tx
from leafmill.functions import urls
from leafmill.operators import chunks
from leafmill.sources import captions, html


@pytest.fixture(scope="module")
def value(spark):
    def get(column):
        return spark.range(1).select(column.alias("v")).first()[0]

    return get


def test_document_id(value):
    assert value(urls.document_id(F.lit("https://example.com/a"))) == "2dce0a4c50441bfccfa9caf4"


@pytest.mark.parametrize(
    "url, strict, lax",
    [
        ("https://www.youtube.com/watch?v=abc", "abc", "abc"),
        ("https://youtu.be/xyz?t=1", "xyz", "xyz"),
        ("https://m.youtube.com/shorts/abc", "", "abc"),
        ("https://music.youtube.com/watch?v=abc", "", ""),
        ("https://youtube.com/live/abcdefghijk", "abcdefghijk", ""),
        ("no url", "", ""),
        (None, "", ""),
    ],
)
def test_video_ids(value, url, strict, lax):
    u = F.lit(url).cast("string")
    assert value(urls.video_id(u)) == strict
    assert value(urls.saved_video_id(u)) == lax


@pytest.mark.parametrize("url, route", [("about:blank", "library"), ("https://youtu.be/x", "video"), ("https://a.org/b.PDF?x", "pdf"), ("https://arxiv.org/pdf/1234", "pdf"), ("https://a.org/b", "article"), (None, "library")])
def test_route(value, url, route):
    assert value(urls.route(F.lit(url).cast("string"))) == route


def test_titles(value):
    none = F.lit(None).cast("string")
    assert value(urls.title_of(none, F.lit("https://a.org/x/My%20Paper.pdf"))) == "My Paper"
    assert value(urls.title_of(none, F.lit("https://a.org/"))) == "a.org"
    assert value(urls.title_of(none, none)) == "Saved document"
    assert value(urls.title_of(F.lit("T"), none)) == "T"


def test_query_terms(value):
    assert value(tx.query_terms(F.lit("The cat, the Cats a1 x"))) == ["Cats", "The", "cat", "the", "a1"]


def test_clock(value):
    assert value(tx.clock(F.lit(65000))) == "1:05"
    assert value(tx.clock(F.lit(3723000))) == "62:03"


def test_upper_median(value):
    assert value(tx.upper_median(F.array(*map(F.lit, (4, 1, 3, 2))))) == 3


def test_sentences(value):
    assert value(tx.sentences(F.lit("See Fig. 2. Then stop! Why"))) == ["See Fig. 2.", "Then stop!", "Why"]
    assert value(tx.sentences(F.lit("..."))) == ["..."]


def test_pack(value):
    text = "a" * 200 + ". " + "b" * 200 + "."
    assert [len(p) for p in value(tx.pack(F.lit(text)))] == [201, 201]
    assert value(tx.pack(F.lit(" short "))) == [" short "]


def test_word_count(value):
    assert value(tx.word_count(F.lit(" a b c "))) == 3
    assert value(tx.word_count(F.lit(""))) == 1


def test_snippet(value):
    s = value(tx.snippet(F.lit("T " + "x " * 200 + "Needle" + " y" * 300), F.lit("T"), F.array(F.lit("needle"))))
    assert s.startswith("…") and s.endswith("…") and "Needle" in s and len(s) <= 364


def test_fence(value):
    assert value(md.fenced_code(F.lit("a ``` b"))) == "````\na ``` b\n````"


def test_table(value):
    rows = F.from_json(F.lit('[{"cells":[{"text":"a|b"},{"text":"c"}]},{"cells":[{"text":"d"}]}]'), "array<struct<cells:array<struct<text:string>>>>")
    assert value(md.table(rows)) == "| a\\|b | c |\n| --- | --- |\n| d |  |"


def test_containment(value):
    box = lambda *v: F.struct(*(F.lit(float(x)).alias(n) for x, n in zip(v, ("x1", "y1", "x2", "y2"))))
    assert value(geo.containment(box(0, 0, 10, 10), box(5, 0, 20, 10))) == 0.5


@pytest.mark.parametrize(
    "title, content, want",
    [("T", "ab", ["T\nab"]), ("T", "", ["T"]), ("", None, []), ("", "a" * 1300, [1200, 100]), ("", "a" * 1000 + " " + "b" * 500, [1000, 500])],
)
def test_chunks(title, content, want):
    got = chunks.chunk(title, content)
    assert (got if not want or isinstance(want[0], str) else list(map(len, got))) == want
    if want and isinstance(want[0], int):
        assert [len(x) for x in got] == want


def test_captions(spark):
    xml = '<text start="1.5" dur="2">Hi &amp; bye [Music]</text><p t="1500" d="2000">x&#x41;&#233;</p><text start="1"> </text>'
    rows = captions.caption_chunks(spark.createDataFrame([("v", xml)], "video_id string, xml string")).orderBy("seq").collect()
    assert [(r.text, r.start_ms, r.duration_ms) for r in rows] == [("Hi & bye", 1500, 2000), ("xAé", 1500, 2000)]


def test_chapters(spark):
    text = "0:00 Intro\n1:30 - Main\n1:02:03 End\nnone"
    rows = captions.description_chapters(spark.createDataFrame([("v", text, 3723), ("w", "0:00 Intro", 9)], "video_id string, description string, duration int")).collect()
    assert sorted((r.start_ms, r.text) for r in rows) == [(0, "Intro"), (90000, "Main"), (3723000, "End")]


def test_speaker_turns():
    assert captions.paragraphs("Hi. >> Bob here. >> ok then.") == ["Hi.", "— Bob here. ok then."]


def test_sentence_times():
    chunks_ = [("hello there. how", 0.0), ("are you", 1000.0), ("hello again", 2000.0)]
    assert captions.sentence_times(["hello there. how are you", "hello again"], chunks_) == [[0.0, 0.0], [2000.0]]


def test_html():
    page = '<nav>no</nav><h1>Title</h1><p>One <b>bold , text<p>Two <a href="/x">link</a><a href="javascript:1">j</a><ul><li>a<ul><li>b</li></ul></li></ul><pre><code class="language-py">x  =1</code></pre><table><tr><th>h</th><td> </td></tr><tr><td>1<img src="i.png" alt="I"></td></tr></table><img src=t.gif width=1><blockquote><p>q</p></blockquote>'
    got = html.passages(page, "https://a.org/d/")
    assert [(p["type"], p["text"]) for p in got] == [("heading", "Title"), ("paragraph", "One bold, text"), ("paragraph", "Two linkj"), ("paragraph", "ab"), ("paragraph", "b"), ("code", "x  =1"), ("table", ""), ("image", "Picture of I"), ("paragraph", "q")]
    assert got[2]["links"] == [{"label": "link", "href": "https://a.org/x"}]
    assert got[6]["rows"] == [{"cells": [{"text": "h", "header": True}]}, {"cells": [{"text": "1", "header": False}]}]
    assert html.passages(None, None) == []


def test_summaries_and_urls(value):
    assert value(tx.plain_summary(F.lit("- **Bold** [a](b)\n2) x <SOURCE>"))) == "Bold a x"
    assert value(tx.is_meta_response(F.lit("I am ready to summarize it"))) and value(tx.is_meta_response(F.lit("")))
    assert not value(tx.is_meta_response(F.lit("Cats purr.")))
    assert value(tx.repair_urls(F.lit("see https: //a.org/ x and https://b. com"))) == "see https://a.org/x and https://b.com"
    assert value(tx.phoneme_text(F.lit("“a”—b (c)…"))) == '"a", b , c, ...'


def test_highlight_takes_terms_as_they_are(spark):
    value = lambda c: spark.range(1).select(c.alias("v")).first()[0]
    terms = F.array(F.lit("c++"), F.lit("(x"))
    assert value(tx.highlight(F.lit("C++ and (x) in c"), terms)) == "<mark>C++</mark> and <mark>(x</mark>) in c"


def test_urls_cut_by_line_wraps(spark):
    value = lambda c: spark.range(1).select(c.alias("v")).first()[0]
    cases = {
        "a https://x.org /p/ q b": "a https://x.org/p/q b",
        "https://x.org/a?b=\nc d": "https://x.org/a?b=c d",
        "https://x.org/a-\nb": "https://x.org/a-b",
        "www.x. org/p and": "www.x.org/p and",
        "https : // x.org ends. Then": "https://x.org ends. Then",
        "no links / here": "no links / here",
        "https://x.org/ / y": "https://x.org/y",
    }
    for text, want in cases.items():
        assert value(tx.repair_urls(F.lit(text))) == want, text
    assert value(tx.repair_urls(F.lit(None).cast("string"))) is None
