"""Queries that have to take in every row of their tables."""

from leafmill.plans import catalog
from leafmill.plans import layout_queries as lq

from .oracle import run_sql


def test_tokens_of_all_documents_outside_visuals(spark, sf_dir):
    inside = lq.INSIDE.format(a="t", b="b")
    sql = f"WITH {lq.TOKENS}, {lq.BOXES} SELECT token FROM t WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = t.doc_id AND b.page = t.page AND cls IN (2, 6, 8) AND {inside} >= 0.35)"
    got = [r.token for r in catalog.queries()["tokens_outside_visuals"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(r["token"] for r in run_sql(sql, sf_dir))
    assert max(got) >= 10 * 1000


def test_links_and_speech_of_every_document(spark, tmp_path):
    rows = [(1, "see WWW.example.com now"), (2, "no link"), (3, "Www.example.org"), (4, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    links = catalog.queries()["text_links"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.label) for r in links) == [(1, "WWW.example.com"), (3, "Www.example.org")]
    spoken = catalog.queries()["spoken_text"](spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in spoken) == [1, 2, 3, 4]


def test_code_blocks_of_turns_with_backticks(spark, tmp_path):
    rows = [(1, 0, "plain"), (1, 1, "a `b`"), (1, 2, "```\nx\n```"), (1, 3, None)]
    spark.createDataFrame(rows, "conv_id bigint, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r.turn: r.block for r in catalog.queries()["code_blocks"](spark, str(tmp_path)).collect()}
    assert out == {0: "```\nplain\n```", 1: "```\na `b`\n```", 2: "````\n```\nx\n```\n````"}
