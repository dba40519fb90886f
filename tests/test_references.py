"""How bibliographies are headed and entries start; radicals within lines."""

import pytest

from leafmill.operators import citations
from leafmill.operators.page_rules import inline_formula


@pytest.mark.parametrize("heading", ["References", "2.1 Bibliography:", "7) References and  notes.", "endnotes", "Works cited"])
def test_entries_below_a_heading(spark, heading):
    texts = ["[7] bracketed anywhere", "3. not yet", None, heading, "1. One", "2) Two", "3 Three", "4 four", "[5]", "2020 Year", "6.", "[8]joined"]
    p = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "doc_id bigint, pos int, text string")
    got = citations.reference_numbers(citations.bibliography_flag(p)).orderBy("pos").collect()
    assert [(r.pos, r.number) for r in got] == [(0, "7"), (4, "1"), (5, "2"), (6, "3"), (8, "5"), (10, "6")]


def token(k, text, x1, x2, baseline=20.0):
    return {"text": text, "item_index": k, "font_size": 10.0, "baseline_y": baseline, "x1": x1, "y1": 10.0, "x2": x2, "y2": 20.0}


def test_radical_within_a_line():
    line = [token(0, "so", 0.0, 18.0), token(1, "√", 20.0, 26.0), token(2, "2", 26.0, 32.0), token(3, "is", 36.0, 46.0)]
    box = {"label": "Formula", "x1": 19.0, "y1": 8.0, "x2": 33.0, "y2": 22.0}
    assert inline_formula(box, line)
    assert not inline_formula(box | {"label": "Picture"}, line)
    assert not inline_formula(box | {"x2": 70.0}, line)  # a displayed formula
    assert not inline_formula(box, line[1:])  # nothing before it
    assert not inline_formula(box, line[:2])
    assert not inline_formula(box, [line[0] | {"baseline_y": 60.0}, *line[1:]])
    assert not inline_formula(box, [t for t in line if t["text"] != "√"])
    assert not inline_formula(box, [])
