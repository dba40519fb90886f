"""Queries against their SQL on small tables of odd rows, which the given tables lack."""

import datetime as dt
import os

from leafmill.plans import catalog

from .oracle import TABLES, same


def check(spark, sf_dir, tmp_path, name, table, rows, schema):
    """The query's rows, equal to those of its SQL, over the given tables with this one in place of theirs."""
    for t in TABLES:
        if t != table:
            os.symlink(f"{sf_dir}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    out = catalog.queries()[name](spark, str(tmp_path))
    same(out, catalog.oracle_sql()[name], str(tmp_path))
    return out.collect()


EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, value double"


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_outer_spans_start_at_the_nearest_second(spark, sf_dir, tmp_path):
    # each user's first span ends 1 or 61 seconds after its rounded start
    rows = [(1, at(0.4), 1, 0.2), (2, at(0.9), 1, 0.0), (3, at(0.6), 2, 1.9), (4, at(61.2), 2, 0.0), (5, at(0.5), 3, 0.0), (6, at(1.5), 3, 0.0), (7, at(2.5), 3, 0.0), (8, at(3.500001), 3, 0.0)]
    got = check(spark, sf_dir, tmp_path, "outer_spans", "events", rows, EVENTS)
    assert sorted(r.event_id for r in got) == [1, 2, 3, 5, 6, 8]


def test_outer_spans_of_equal_spans_keep_the_smallest_id(spark, sf_dir, tmp_path):
    rows = [(100 * u + k, at(10), u, -3.5) for u in range(20) for k in range(9, 0, -1)]
    got = check(spark, sf_dir, tmp_path, "outer_spans", "events", rows, EVENTS)
    assert sorted(r.event_id for r in got) == [100 * u + 1 for u in range(20)]


def test_outer_spans_without_time_value_or_user(spark, sf_dir, tmp_path):
    rows = [(1, None, 1, 1.0), (2, at(5), 1, 1.0), (3, at(5), 1, None), (4, None, 2, 1.0), (5, None, 2, None), (6, at(9), None, 2.0), (7, at(9), None, 2.0), (None, at(9), None, 2.0)]
    got = check(spark, sf_dir, tmp_path, "outer_spans", "events", rows, EVENTS)
    assert sorted(r.event_id for r in got) == [2, 4, 5, 6]


LINES = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_returnflag string, l_linestatus string"


def test_page_rotations_at_the_exact_share(spark, sf_dir, tmp_path):
    # tokens of five characters: 100 to 900 on pages 1 to 6, of which the supplier's angle (90 or 180) has 55 %, or one token less
    rows = []
    for doc, (turned, page, tokens) in enumerate((t, p, n) for t in (100, 101) for p, n in ((1, 20), (2, 40), (3, 80), (4, 160), (5, 180), (6, 60))):
        for less in (0, 1):
            most = tokens * 11 // 20 - less
            angles = [turned] * most + [102] * (tokens // 4) + [201 - turned] * (tokens - most - tokens // 4)
            rows += [((2 * doc + less) * 100 + k % 100, k, s, page, "A", "O") for k, s in enumerate(angles)]
    got = check(spark, sf_dir, tmp_path, "page_rotations", "lineitem", rows, LINES)
    assert {(r.doc_id, r.rotation) for r in got} == {(d, 0 if d % 2 else 90 if d < 12 else 180) for d in range(24)}


def test_page_rotations_against_upright_and_little_text(spark, sf_dir, tmp_path):
    pages = {1: [100] * 6 + [102] * 4, 2: [100] * 11 + [102] * 8, 3: [101] * 4, 4: [101] * 3, 5: [100] * 5 + [101] * 5, 6: [None] * 30 + [101] * 4, 7: [None] * 5}
    rows = [(k, k, s, page, "A", "O") for page, keys in pages.items() for k, s in enumerate(keys)]
    rows += [(200 + k, k, 100, 1, None, "O") for k in range(9)]
    got = check(spark, sf_dir, tmp_path, "page_rotations", "lineitem", rows, LINES)
    assert {(r.doc_id, r.page): r.rotation for r in got} == {(0, 1): 90, (0, 2): 0, (0, 3): 180, (0, 4): 0, (0, 5): 0, (0, 6): 180, (0, 7): 0, (2, 1): 0}
