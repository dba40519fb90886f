"""Cases that the given tables don't hold."""

from pyspark.sql import functions as F

from leafmill.operators import page_joins as pj

TOKEN = "doc_id bigint, page int, token int, text string, font_size double, is_math boolean, x1 double, y1 double, x2 double, y2 double"
BOX = "doc_id bigint, page int, x1 double, y1 double, x2 double, y2 double"


def test_tokens_of_regions(spark):
    rows = [
        (1, 1, 1, "in", 10.0, False, 10.0, 10.0, 20.0, 20.0),
        (1, 1, 2, "√", 10.0, None, 10.0, 105.0, 20.0, 110.0),  # a glyph close below
        (1, 1, 3, "x", 10.0, None, 10.0, 105.0, 20.0, 110.0),
        (1, 1, 4, "√", 10.0, None, 10.0, 120.0, 20.0, 130.0),
        (1, 2, 5, "other page", 10.0, False, 10.0, 10.0, 20.0, 20.0),
        (None, 1, 6, "no id", 10.0, True, 10.0, 10.0, 20.0, 20.0),
        (1, 1, 7, None, None, None, None, 10.0, 20.0, 20.0),
    ]
    tokens = spark.createDataFrame(rows, TOKEN)
    regions = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 100.0), (1, 1, 0.0, 0.0, 50.0, 50.0)], BOX)
    assert sorted(r.token for r in pj.of_regions(tokens, regions).collect()) == [1, 2]
    assert pj.of_regions(tokens, regions.limit(0)).count() == 0
    blocks = tokens.withColumn("type", F.when(F.col("token") == 1, "text").otherwise("table"))
    assert sorted(r.token for r in pj.outside_listings(blocks, regions).collect()) == [2, 3, 4, 5, 6, 7]


def test_headers_of_repeated_and_empty_tables(spark):
    cells = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 10.0, 10.0), (1, 1, 2, 0.0, 0.0, 10.0, 10.0), (1, 1, 1, None, 0.0, 10.0, 10.0)], "doc_id bigint, page int, `table` int, x1 double, y1 double, x2 double, y2 double")
    headers = cells.filter("table = 1 and x1 = 0").withColumn("y2", F.lit(5.0))
    got = sorted((r.table, r.x1 is not None, r.header) for r in pj.header_cells(cells, headers).collect())
    assert got == [(1, False, False), (1, True, True), (2, True, False)]


def test_expanded_tables_keep_the_outermost(spark):
    schema = "doc_id bigint, page int, item int, x1 double, y1 double, x2 double, y2 double"
    visuals = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 50.0, 50.0), (1, 1, 2, 10.0, 10.0, 40.0, 40.0), (1, 1, 3, 200.0, 200.0, 250.0, 250.0), (1, 2, 4, 10.0, 10.0, 40.0, 40.0)], schema)
    expanded = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 100.0, 100.0), (1, 1, 9, 5.0, 5.0, 90.0, 90.0)], schema)
    out = pj.with_expanded_tables(visuals, expanded, expanded)
    assert sorted((r.item, r.x2) for r in out.collect()) == [(1, 100.0), (3, 250.0), (4, 40.0)]
    assert pj.with_expanded_tables(visuals, expanded.limit(0), expanded.limit(0)).count() == 4


def test_titles_of_first_pages(spark):
    schema = "doc_id bigint, page int, pos int, type string, label string, text string, font_size double, y1 double, page_height double"
    rows = [
        (1, 1, 0, "text", "Text", "Largest of all", 30.0, 10.0, 800.0), (1, 1, 1, "text", "Title", "The named one", 14.0, 20.0, 800.0),
        (2, 1, 0, "text", "Text", "Lower of equals", 20.0, 200.0, None), (2, 1, 1, "text", None, "Upper of equals", 20.0, 100.0, None),
        (3, 1, 0, "text", "Caption", "No title label", 20.0, 1.0, 800.0), (4, 2, 0, "text", "Title", "Second page", 20.0, 1.0, 800.0), (5, 1, 0, "text", "Title", None, None, None, None),
    ]
    got = {r.doc_id: r.text for r in pj.first_page_titles(spark.createDataFrame(rows, schema), F.lit(10.0)).collect()}
    assert got == {1: "The named one", 2: "Upper of equals"}


def test_lower_margin_numbers(spark):
    df = spark.createDataFrame([("12", 90.0, 100.0), ("xiv", 78.0, 100.0), ("12", 77.0, 100.0), ("12345", 90.0, 100.0), (None, 90.0, 100.0), ("1", 90.0, None), ("1", 0.0, 0.0)], "text string, y double, h double")
    assert [r[0] for r in df.select(pj.lower_margin_number("text", "y", "h")).collect()] == [True, True, False, False, False, False, False]
