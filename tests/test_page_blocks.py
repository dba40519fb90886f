from pyspark.sql import functions as F

from leafmill.operators import page_blocks as pb


def line(text, y, x=0.0, size=10.0, **more):
    return {"doc_id": 1, "page": 1, "kind": "line", "text": text, "font_size": size, "label": None, "x1": x, "y1": float(y), "x2": x + 50.0, "y2": y + 10.0} | more


def test_regions_gather_lines(spark):
    rows = [line("b", 20), line("a", 0), line("gone", 100), line("alone", 300), line(None, 0, kind="region", label="Text", y2=40.0), line(None, 95, kind="visual", label="Table", y2=120.0)]
    schema = "doc_id bigint, page int, kind string, text string, font_size double, label string, x1 double, y1 double, x2 double, y2 double"
    out = pb.page_blocks(spark.createDataFrame([tuple(r.values()) for r in rows], schema)).orderBy("ord").collect()
    assert [(r.text, r.label) for r in out] == [("a\nb", "Text"), ("alone", "Text")]


def test_glyph_runs_become_words(spark):
    schema = "text string, a double, b double, c double, d double, e double, f double, width double, height double, font string, page_height double"
    items = spark.createDataFrame([("two words", 10.0, 0.0, 0.0, 10.0, 5.0, 90.0, 45.0, 10.0, "CMBold-Italic", 100.0)], schema)
    rows = pb.split_items(pb.glyph_tokens(items)).orderBy("token_index").collect()
    assert [(r.text, r.x1, r.x2) for r in rows] == [("two", 10.0, 40.0), ("words", 50.0, 100.0)]
    assert rows[0].font_size == 20 and rows[0].baseline_y == 20 and rows[0].is_bold and rows[0].is_italic and rows[0].is_horizontal and not rows[0].is_math


def test_block_types(spark):
    blocks = spark.createDataFrame([(1, 1, "Head", 20.0, "Text"), (1, 1, "A bro-\nken line", 10.0, "Text"), (1, 1, "T", 10.0, "Title"), (1, 1, "c", 10.0, "Caption")], "doc_id int, page int, text string, font_size double, label string")
    body = spark.createDataFrame([(1, 1, 10.0)], "doc_id int, page int, body_font double")
    out = {r.text: (r.type, r.heading_level) for r in pb.block_passages(blocks, body).collect()}
    assert out == {"Head": ("heading", 2), "A broken line": ("paragraph", None), "T": ("heading", 1), "c": ("caption", None)}


def test_inline_styles():
    text, ranges = pb.inline_styles("a\ue106b\ue107 \ue106c\ue107 x\ue1002\ue101")
    assert text == "ab c x2" and ranges["bold"] == [(1, 4)] and ranges["superscript"] == [(6, 7)]


def test_tables_grow_over_angled_text():
    t = lambda y, angle: {"text": "w", "text_angle": angle, "font_size": 10.0, "x1": 10.0, "x2": 30.0, "y1": float(y), "y2": y + 10.0}
    box = pb.grow_oblique({"x1": 0.0, "y1": 100.0, "x2": 50.0, "y2": 150.0}, [t(85, 0.8), t(70, 0.8), t(40, 0.8), t(155, 0.0)], 100.0, 500.0)
    assert (box["y1"], box["y2"]) == (70.0, 150.0)


def test_transcript_chapters():
    chunks = [("One two. Three", 0.0), ("four. Five six.", 1000.0), ("Seven.", 2000.0)]
    got = pb.transcript_passages(chunks, [(0.0, "Start"), (1000.0, "Next"), (9000.0, "Late")])
    assert [(p["type"], p["text"]) for p in got] == [("heading", "Start"), ("paragraph", "One two. Three four."), ("heading", "Next"), ("paragraph", "Five six. Seven.")]


def test_front_matter_state():
    row = lambda text, y: {"doc_id": 1, "page": 1, "text": text, "font_size": 10.0, "baseline_y": y + 8.0, "is_math": False, "x1": 0.0, "x2": 50.0, "y1": float(y), "y2": y + 10.0}
    assert pb.front_matter_page([row("Contents", 0)], False, 2, 100)
    assert pb.front_matter_page([row("a ... 3", 0), row("b 4", 20)], True, 3, 100)
    assert not pb.front_matter_page([row("text", 0)], True, 4, 100)


def test_types_are_columns(spark):
    assert spark.range(1).select(pb.block_type(F.lit("Text"), F.lit(10.0), F.lit(10.0), F.lit("x")).alias("t")).first().t == "paragraph"
