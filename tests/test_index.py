"""The kept index against scores computed from the texts."""

import pytest

from leafmill.operators import search
from leafmill.plans import corpus_queries as cq
from leafmill.session import work_path


def scores(df, key):
    return sorted((tuple(str(r[k]) for k in key), round(r.score, 9)) for r in df.collect())


ROWS = [
    (1, 0, "Nations", "A nation of nations. Nation!"),
    (1, 1, "Nations", "mention"),
    (2, 0, None, "nothing here"),
    (2, 0, None, "nation again under a repeated id"),
    (None, 0, "nation", None),
    (3, 0, "", ""),
    (4, 0, "thing", "Things " * 5000),
]


@pytest.mark.parametrize("tolerance", [0, 1])
@pytest.mark.parametrize("query", ["nation thing", "absent", "", "…"])
def test_index_scores_as_without(spark, query, tolerance):
    df = spark.createDataFrame(ROWS, "term bigint, size int, title string, content string")  # keys named like the index's columns
    key = ["term", "size"]
    index = search.build_index(df, key, work_path(spark, "test-index"))
    got = scores(search.search_index(index, query, tolerance), key)
    assert got == scores(search.bm25(df, query, key, tolerance), key)
    assert bool(got) == query.startswith("nation")


def test_boosts_choose_fields(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, idx int, title string, content string")
    index = search.build_index(df, ["doc_id", "idx"], work_path(spark, "test-index"))
    got = scores(search.search_index(index, "nation", boosts={"title": 2.0}), ["doc_id", "idx"])
    assert got == scores(search.bm25(df, "nation", ["doc_id", "idx"], boosts={"title": 2.0}), ["doc_id", "idx"])
    assert [k for k, _ in got] == [("None", "0")]


def test_index_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, content string")
    index = search.build_index(df, ["doc_id"], work_path(spark, "test-index"))
    assert search.search_index(index, "nation", 1).count() == 0


def test_library_chunks_score_as_without(spark, sf_dir):
    key = ["doc_id", "idx"]
    parts, index = cq.kept_index(spark, sf_dir, "library", cq.library_chunks, key)
    assert scores(search.search_index(index, cq.QUERY, 1), key) == scores(search.bm25(parts, cq.QUERY, key, 1), key)


def test_index_follows_the_table(spark, tmp_path):
    def write(texts):
        rows = [(k, "s", "en", t) for k, t in enumerate(texts)]
        spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return {r.doc_id for r in cq.lexical(spark, str(tmp_path)).collect()}

    assert write(["a thing", "none"]) == {0}
    assert write(["none", "a thing", "nation"]) == {1, 2}
