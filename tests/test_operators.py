from pyspark.sql import functions as F

from leafmill.operators import conversation, search, store, timeline


def test_upsert_keeps_creation_and_clears_fields(spark):
    schema = "source_url string, title string"
    empty = spark.createDataFrame([], "doc_id string, source_url string, title string, created_at bigint, updated_at bigint, last_viewed_at bigint")
    once = store.upsert(empty, spark.createDataFrame([("u", "T"), ("w", "W")], schema), 1)
    twice = store.upsert(once, spark.createDataFrame([("u", None)], schema), 2)
    rows = {r.source_url: r for r in twice.collect()}
    assert (rows["u"].created_at, rows["u"].updated_at, rows["u"].title) == (1, 2, None)
    assert (rows["w"].created_at, rows["w"].updated_at, rows["w"].title) == (1, 1, "W")


def test_best_hit_first_of_equals(spark):
    hits = spark.createDataFrame([("d1", 0, 2.0), ("d1", 1, 2.0), ("d2", 0, 3.0)], "doc_id string, idx int, score double")
    assert sorted((r.doc_id, r.idx) for r in search.best_per_document(hits).collect()) == [("d1", 0), ("d2", 0)]


def test_chat_groups_of_known_sites(spark):
    rows = [("d", k, "paragraph", t) for k, t in enumerate(["You said", "q", "Claude said", "a1", "a2"])]
    df = spark.createDataFrame(rows, "doc_id string, pos int, type string, text string")
    got = conversation.decorate(df, F.lit("Claude")).orderBy("pos").collect()
    assert [(r.text, r.chat_role, r.chat_group, r.chat_speaker) for r in got] == [("q", "user", 0, "You"), ("a1", "assistant", 1, "Claude"), ("a2", "assistant", 1, None)]
    assert conversation.decorate(df, F.lit("Other")).count() == 5


def test_as_of(spark):
    line = spark.createDataFrame([("v", float(t), t) for t in (0, 1000, 2000)], "k string, t double, s int")
    clock = spark.createDataFrame([("v", 900.0), ("v", 870.0), ("v", -500.0), ("x", 5.0)], "k string, t double")
    back = {(r.k, r.t): r.matched for r in timeline.as_of(clock, line, "k", "t", F.col("s"), 120).collect()}
    assert back == {("v", 900.0): 1000, ("v", 870.0): 0, ("v", -500.0): None, ("x", 5.0): None}
    ahead = {(r.k, r.t): r.matched for r in timeline.as_of(clock, line, "k", "t", F.col("s"), forward=True).collect()}
    assert ahead == {("v", 900.0): 1000, ("v", 870.0): 1000, ("v", -500.0): 0, ("x", 5.0): None}


def test_as_of_in_spans(spark):
    import random

    r = random.Random(4)
    line = [(f"k{r.randrange(3)}", float(t), t) for t in r.sample(range(10000), 60)]
    clock = [(f"k{r.randrange(4)}", float(r.randrange(-500, 11000))) for _ in range(200)]
    a, b = spark.createDataFrame(line, "k string, t double, s int"), spark.createDataFrame(clock, "k string, t double")
    for forward in (False, True):
        want = sorted((k, t, str((min if forward else max)((s for x, u, s in line if x == k and (u >= t if forward else u <= t)), default=None))) for k, t in clock)
        for span in (None, 100.0, 3000.0):
            got = timeline.as_of(b, a, "k", "t", F.col("s"), forward=forward, span=span).collect()
            assert sorted((x.k, x.t, str(x.matched)) for x in got) == want


def test_rejected_spans_block_too(spark):
    spans = spark.createDataFrame([("d", 0, 10), ("d", 5, 20), ("d", 15, 18)], "k string, a int, b int")
    assert [(r.a, r.b) for r in timeline.keep_outer(spans, "k", "a", "b").collect()] == [(0, 10)]


def test_highlights(spark):
    schema = "doc_id string, passage_index int, start int, end int"
    got = store.free_highlights(spark.createDataFrame([("d", 0, 2, 5)], schema), spark.createDataFrame([("d", 0, 5, 8), ("d", 0, 4, 8)], schema))
    assert {r.start: r.action for r in got.collect()} == {5: "add", 4: "delete"}


def test_bm25_needs_a_match(spark):
    df = spark.createDataFrame([(1, "nation thing"), (2, "natino"), (3, None)], "doc_id int, content string")
    assert [r.doc_id for r in search.bm25(df, "nation", ["doc_id"]).collect()] == [1]
    assert search.bm25(df.limit(0), "nation", ["doc_id"]).count() == 0
