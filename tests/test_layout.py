import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import citations, layout, links, models
from leafmill.streaming import pages as sp
from leafmill.session import work_path


def box(x1, y1, x2, y2, **more):
    return {"x1": float(x1), "y1": float(y1), "x2": float(x2), "y2": float(y2), "score": 0.5} | more


def test_xy_cut_header_and_columns():
    head, right, left = box(0, 0, 100, 20), box(60, 50, 100, 200), box(0, 50, 40, 200)
    assert layout.xy_cut([right, left, head]) == [head, left, right]


def test_xy_cut_is_a_permutation():
    r = random.Random(2)
    for _ in range(50):
        boxes = [box(x := r.randrange(500), y := r.randrange(700), x + r.randrange(1, 90), y + r.randrange(1, 40), k=k) for k in range(r.randrange(12))]
        assert sorted(b["k"] for b in layout.xy_cut(boxes)) == list(range(len(boxes)))


def test_suppression_keeps_the_outer_box():
    a, b = box(0, 0, 10, 10), box(0, 0, 2, 10, score=0.9)
    assert layout.suppress([b, a]) == [a]


def test_rows_and_spaces():
    t = lambda text, x, y, size=10.0, math=False: {"doc_id": 1, "page": 1, "text": text, "font_size": size, "baseline_y": float(y), "is_math": math, **{k: v for k, v in box(x, y - 8, x + 10 * len(text), y).items() if k != "score"}}
    rows = layout.token_rows([t("b", 25, 20), t("a", 0, 20), t("c", 0, 60), t("2", 35.5, 15, 5.0)])
    assert [r["text"] for r in rows] == ["a b2", "c"]


def test_captions_take_the_nearest_free_visual():
    i = lambda n, label, y, text="": box(0, y, 50, y + 10, item=n, label=label, text=text, page_height=1000.0, doc_id=1, page=1)
    got = layout.captions_to_visuals([i(0, "Picture", 0), i(1, "Picture", 100), i(2, "Caption", 12, "Figure 1"), i(3, "Caption", 15, "Figure 2"), i(4, "Caption", 50, "Table 1")])
    assert [(g["caption"], g["visual"]) for g in got] == [(2, 0), (3, 1), (4, None)]


def test_continuations_join():
    p = lambda text, page, x1=0: {"type": "paragraph", "text": text, "page": page, "x1": float(x1), "x2": x1 + 100.0}
    out = layout.merge_continuations([p("It goes on and", 1), {"type": "image", "text": "", "page": 1, "x1": 0.0, "x2": 1.0}, p("on here.", 2), p("A new one hyphen-", 2), p("ated", 3)])
    assert [b["text"] for b in out if b["type"] == "paragraph"] == ["It goes on and on here.", "A new one hyphenated"]


def test_contents_run_ends_at_the_first_other_page(spark):
    rows = [(1, 1, "Contents"), (1, 1, "a 5"), (1, 2, "b 7"), (1, 2, "c 8"), (1, 2, "d .... 9"), (1, 3, "Text"), (1, 4, "x 1"), (1, 4, "y 2"), (1, 4, "z 3")]
    left = layout.drop_contents(spark.createDataFrame(rows, "doc_id int, page int, text string"))
    assert {r.page for r in left.collect()} == {3, 4}


@pytest.mark.parametrize(
    "text, want",
    [("{ann, bo}@x.org", [("{ann, bo}@x.org", "mailto:ann@x.org,bo@x.org")]), ("see https://a.org/b. Or www.c.net", [("https://a.org/b", "https://a.org/b"), ("www.c.net", "http://www.c.net")]), ("", []), (None, [])],
)
def test_link_spans(text, want):
    assert [(s["label"], s["href"]) for s in links.link_spans(text)] == want


def test_spoken():
    assert links.spoken("Mail a@b.co now") == "Mail a at b dot co now"
    assert links.spoken("https://www.example.com/x") == "example dot com"


def test_styled():
    got = links.styled("a *b* x2 link", {"superscript": [(7, 8)], "bold": [(2, 5)]}, links.label_ranges("a *b* x2 link", [{"label": "link", "href": "h>"}]))
    assert got == "a **\\*b\\*** x<sup>2</sup> [link](<h%3E>)"


def test_reference_keys(spark):
    row = spark.createDataFrame([("Müller", "2020a"), (None, "1999")], "s string, y string").select(citations.key(F.col("s"), F.col("y")).alias("k")).collect()
    assert [r.k for r in row] == ["muller:2020a", ""]


def test_typography(spark):
    rows = spark.createDataFrame([("ﬁne d´un W hat M¨uller cafe \u0301 so\u00adft",)], "t string").select(citations.typography(F.col("t")).alias("t")).collect()
    assert rows[0].t == "fine d’un What Müller café soft"


def test_author_year_links_to_the_first_entry(spark):
    cites = citations.author_years(spark.createDataFrame([(1, "as Doe (1999) and Roe & Poe, 2001 say")], "doc_id int, text string"), ["doc_id"])
    entries = spark.createDataFrame([(1, 5, "Jane Doe, A title, 1999"), (1, 6, "Other, Doe, 1999"), (1, 7, "Roe, X. 2002")], "doc_id int, pos int, text string")
    assert sorted((r.surname, r.entry) for r in citations.link_author_years(cites, entries).collect()) == [("Doe", 5), ("Roe", None)]


def test_numbered_references(spark):
    rows = [(1, 0, "See [1, 2] and [9]."), (1, 1, "References"), (1, 2, "[1] A paper"), (1, 3, "2. Another")]
    p = citations.bibliography_flag(spark.createDataFrame(rows, "doc_id int, pos int, text string"))
    refs = citations.reference_numbers(p)
    assert sorted((r.pos, r.number) for r in citations.number_citations(p, refs).collect()) == [(0, "1"), (0, "2")]


def test_packing_and_summary():
    measure = lambda t: len(t.split())
    assert models.pack(["a b", "c", "d e f"], measure, 3) == ["a b\n\nc", "d e f"]
    assert all(measure(p) <= 5 for p in models.pack(["w " * 40 + "."], measure, 5))
    calls = []

    def generate(mode, text):
        calls.append(mode)
        return "" if len(calls) == 1 else f"{mode} note"

    assert models.summarize_text(["one two three", "four five six"], generate, window=3) == "summary note"
    assert calls[:2] == ["section", "section"] and "reduction" in calls
    with pytest.raises(ValueError):
        models.retried(lambda m, t: " ", "section", "x")


def test_embedding_skips_blanks(spark):
    import numpy as np

    df = spark.createDataFrame([(1, "a"), (2, " "), (3, None), (4, "bcd")], "id int, text string")
    rows = models.embed(df, lambda: lambda texts: np.array([[len(t), 0.0] for t in texts])).collect()
    assert {r.id: r.vector for r in rows} == {1: [1.0, 0.0], 4: [1.0, 0.0]}


def test_unigram_prefers_the_best_path():
    u = models.Unigram({"▁ab": -1.0, "▁a": -0.5, "b": -0.7, "c": -1.0})
    assert u.pieces("abc") == ["▁ab", "c"]
    assert u.pieces("é")[-2:] == ["<0xC3>", "<0xA9>"]


def test_audio_and_pixels():
    import numpy as np

    w = models.wav([0, 2, -2], 8000)
    assert w[:4] == b"RIFF" and w[-4:] == b"\xff\x7f\x00\x80" and len(w) == 50
    assert models.faded(np.ones(1000), 8000)[0] == 0
    page = np.full((5, 6), 255)
    assert models.ink_bounds(page) is None
    page[2, 3] = 0
    assert models.ink_bounds(page) == (3, 2, 4, 3)


def events(spark, rows):
    path = work_path(spark, "test-events")
    for part in rows:
        spark.createDataFrame(part, sp.EVENT).coalesce(1).write.mode("append").parquet(path)
    return path


def test_stream_delivers_once_and_replays(spark):
    path = events(spark, [[("j", 2, 3, "page", "b"), ("j", 1, 3, "page", "a")], [("j", 2, 3, "page", "again"), ("k", 1, 1, "page", "x")]])
    out = sp.run_to_table(sp.once(sp.read_events(spark, path)), "once")
    assert out.count() == 3
    assert [r.page for r in sp.replay(out, "j").collect()] == [1, 2]


def test_stream_state_carries_over(spark):
    path = events(spark, [[("j", 1, 4, "page", "Contents\na 4\nb 5\nc 6"), ("j", 2, 4, "page", "d 7\ne 8\nf 9")], [("j", 3, 4, "page", "g 1\nh 2\ni 3")], [("j", 4, 4, "page", "Text"), ("j", 5, 4, "result", None)]])
    out = sp.run_to_table(sp.suppress_contents(sp.read_events(spark, path)), "suppress").collect()
    flags = {r.page: r.suppressed for r in out}
    assert flags[4] is False and flags[1] and flags[2]
    progress = sp.run_to_table(sp.job_progress(sp.read_events(spark, path)), "progress", "update").collect()
    assert max((r.pages, r.page_count, r.ended) for r in progress) == (4, 4, True)
