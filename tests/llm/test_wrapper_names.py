"""Names, copies and articles of web pages."""

from __future__ import annotations

import pytest

from tidemark.llm import wrappers


@pytest.mark.parametrize("name", ["has-sidebar", "no-comments", "comments-open"])
def test_states_are_no_parts(name):
    assert wrappers.main_text(f"<div class='{name}'><p>Text</p></div>", None) == "Text"
    assert wrappers.main_text(f"<div class='{name}'><article><p>Text</p></article></div>", None) == "Text"
    assert wrappers.main_text(f"<article class='{name}'><p>Text</p></article>", None) == "Text"


def test_articles_outlast_names():
    assert wrappers.main_text("<div class='widget-area'><article class='promo'><p>Text</p></article></div>", None) == "Text"
    page = "<article><p>Text</p></article><div id=comments><article class=comment><p>first</p></article></div>"
    assert wrappers.main_text(page, None) == "Text"
    assert wrappers.main_text("<div class='site-footer'>End</div><p>Text</p>", None) == "Text"


def test_copies_are_no_evidence_for_template(spark):
    plain = "<body><div class=body><p>Story</p><p>Rest</p></div></body>"
    classed = "<article><p class=lead>Lead</p><p class=text>More</p></article>"
    rows = [(i, "http://a.example/1", plain) for i in range(5)] + [(10 + i, "http://b.example/1", classed) for i in range(12)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in wrappers.extract(frame).collect()}
    assert got == {**{i: "Story\nRest" for i in range(5)}, **{10 + i: "Lead\nMore" for i in range(12)}}
