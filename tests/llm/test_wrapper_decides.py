"""The wrapper, not the page's marks, decides on pages without any."""

from __future__ import annotations

import random

import pytest

from tidemark.llm import wrappers


def site(rng: random.Random, prose_of, n: int = 40) -> tuple[list[tuple], dict]:
    """Pages of divs alone: a masthead, a menu, one of three notices, a story, and a foot; a few copies of one story."""
    notices = [prose_of(rng, 8) for _ in range(3)]
    copied = [prose_of(rng, 30) for _ in range(4)]
    rows, want = [], {}
    for i in range(n):
        story = copied if i % 4 == 0 else [prose_of(rng, rng.randint(3, 40)) for _ in range(rng.randint(1, 6))]
        title = f"Story number {i}"
        html = (
            f"<body><div>Daily Tide</div><div><ul><li>Home<li>World<li>Sport</ul></div><div><p>{notices[i % 3]}</p></div>"
            f"<div><h1>{title}</h1>{''.join(f'<p>{p}</p>' for p in story)}</div><div class=foot>All rights {i % 2}</div></body>"
        )
        rows.append((i, f"https://a.example/{i}", html))
        want[i] = "\n".join([title, *story])
    return rows, want


def test_unmarked_pages_need_the_wrapper(spark, prose_of):
    rows, want = site(random.Random(9), prose_of)
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in wrappers.extract(frame).collect()}
    assert got == want
    changed = sum(wrappers.main_text(h) != got[i] for i, _, h in rows)
    assert changed == len(rows)


def test_results_do_not_depend_on_partitions_folds_or_the_way_wrappers_travel(spark, prose_of):
    rng = random.Random(3)
    rows, _ = site(rng, prose_of, 30)
    rows += [(100 + i, "https://a.example/x", f"<div class=c{i % 7}><p>{prose_of(rng, 4)}</p></div><section><p>again</p></section>") for i in range(40)]
    schema = "page_id long, url string, html string"
    once = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, schema).repartition(1)).collect()}
    rng.shuffle(rows)
    again = spark.createDataFrame(rows, schema).repartition(7)
    assert once == {r.page_id: r.text for r in wrappers.extract(again).collect()}
    assert once == {r.page_id: r.text for r in wrappers.extract(again, broadcast_bytes=0).collect()}
    assert set(once) == {r.page_id for r in wrappers.extract(again, fan_in=2).collect()}


def test_a_notice_inside_the_article_goes_and_repeated_stories_stay(spark, prose_of):
    rng = random.Random(5)
    copied = [prose_of(rng, 30) for _ in range(3)]
    rows, want = [], {}
    for i in range(90):
        story = copied if i % 3 == 0 else [prose_of(rng, 20) for _ in range(3)]
        inside = "".join(f"<p>{p}</p>" for p in story)
        rows.append((i, f"https://b.example/{i}", f"<main><article><h1>Title {i}</h1>{inside}<p>Subscribe to our letter today.</p></article></main>"))
        want[i] = "\n".join([f"Title {i}", *story])
    few = [(200 + i, f"https://c.example/{i}", f"<article><p>{prose_of(rng, 20)}</p><p>As ever.</p></article>") for i in range(12)]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows + few, "page_id long, url string, html string")).collect()}
    assert {i: got[i] for i in want} == want
    assert all(got[i].endswith("\nAs ever.") for i, _, _ in few)  # too few pages to overrule their marks


@pytest.mark.parametrize(
    "page, text",
    [
        ("<div class='content-sidebar-wrap'><main><article><p>Text</p></article></main></div>", "Text"),
        ("<article class='post has-sidebar'><p>Text</p></article>", "Text"),
        ("<form><article><p>Text</p></article></form>", "Text"),
        ("<article><p class='alert-level'>High</p><div class='related-work'><p>Work</p></div><p><math>x</math></p></article>", "High\nWork\nx"),
        ("<div role=main><p>Text</p></div><div>Other</div>", "Text"),
        ("<div class=sidebar>Side</div><p>Text</p><div hidden>no<p>no</p></div><p style='display: none'>no</p>", "Text"),
        ("<article><header><h1>Title</h1></header><p>Text</p><aside>More</aside><section id=comments><p>first</p></section></article>", "Title\nText"),
        ("<aside><article><p>Teaser</p></article></aside><article><p>Text</p></article>", "Text"),
        ("<table><tr><td>a<td>b<tr><td><div class=x>c</div></table>", "a\nb\nc"),
        ("a < b <3 &amp; <>c", "a < b <3 & <>c"),
    ],
)
def test_marks_of_single_pages(page, text):
    assert wrappers.main_text(page) == text


def test_deep_long_and_broken_pages_are_read_whole():
    for depth in (1000, 5000):
        page = "<div>" * depth + "deep" + "</div>" * depth + "<p>end"
        assert wrappers.main_text(page) == "deep\nend"
        skeleton, _ = wrappers.Page(page).skeleton()
        assert wrappers.skeleton_of(wrappers.merge(wrappers.tree(skeleton), wrappers.tree(skeleton))) == skeleton
    rows = "".join(f"<div class=a><span>x{i}</span></div><div class=b{i}>y{i}</div>" for i in range(3000))
    assert wrappers.main_text(rows).split("\n") == [t for i in range(3000) for t in (f"x{i}", f"y{i}")]
    assert wrappers.main_text("<p>a" + "<a title='" * 3000 + "</p>").startswith("a")
    assert wrappers.main_text("<p class=\"x>one</p><p class='y'>two</p><p>three</p>").endswith("three")


def plain_matching(a: list, b: list) -> int:
    """Most pairs of nodes, trying every way to pair the children in order."""
    if a[0] != b[0]:
        return 0

    def best(x, y):
        if not x or not y:
            return 0
        return max(best(x[1:], y), best(x, y[1:]), plain_matching(x[0], y[0]) + best(x[1:], y[1:]))

    return 1 + best(a[1], b[1])


def test_matching_equals_brute_force():
    rng = random.Random(2)

    def grow(level):
        return [rng.choice("ab"), [grow(level - 1) for _ in range(rng.randint(0, 3))] if level else []]

    for _ in range(60):
        a, b = ["r", grow(2)[1]], ["r", grow(2)[1]]
        assert wrappers.Matching().size(a, b) == plain_matching(a, b)
        whole = wrappers.merge(a, b)
        for part in (a, b):
            at = wrappers.slots(whole, part)
            assert len(at) == wrappers.skeleton_of(part).count("\n") + 1 and at[0] == 0
            found = [i for i in at if i >= 0]
            assert found == sorted(set(found)) and len(found) == wrappers.Matching().size(whole, part)
