"""Wrappers of several templates on a host, places in wrappers, and trees of many shapes."""

from __future__ import annotations

import random
import re

from skillcorpus.llm import html_extract

ARTICLE = "<body><div class=top>Welcome</div><article><p>Article {0} body</p></article></body>"
STORY = "<body><div class=top>Welcome</div><div class=story><p>Story {0} body, quite long and told at length</p></div><div class=end>All rights</div></body>"
POST = "<body><div class=top>Welcome</div><div class=post><p>Post {0}</p></div><div class=end>All rights</div></body>"
WANT = {ARTICLE: "Article {0} body", STORY: "Story {0} body, quite long and told at length", POST: "Post {0}"}


def texts(spark, rows):
    return {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_every_template_of_a_host_has_its_text(spark):
    for url in ("http://h.example.com/p", None, "no scheme"):
        rows = [(10 * k + i, url, page.format(i)) for k, page in enumerate(WANT) for i in range(5)]
        assert texts(spark, rows) == {10 * k + i: want.format(i) for k, want in enumerate(WANT.values()) for i in range(5)}


def test_places_of_the_wrapper_decide_within_an_article(spark):
    page = "<article><p>Begin {0}</p><div>Lead {0}</div><p>Middle {0}</p><div>Read our terms of use</div><p>End {0}</p></article>"
    rows = [(i, "http://h.example.com/p", page.format(i)) for i in range(5)]
    assert texts(spark, rows) == {i: f"Begin {i} Lead {i} Middle {i} End {i}" for i in range(5)}


def test_a_tree_of_many_shapes(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "GROUP", 4)
    kinds = [f"<div class=k{k}><p>Part {{0}} of {k}</p></div>" for k in range(6)]
    rows, want = [], {}
    for i in range(64):
        some = [k for k in range(6) if i >> k & 1]
        rows.append((i, "http://h.example.com/p", "<div class=top>Welcome</div>" + "".join(kinds[k].format(i) for k in some) + "<div class=end>All rights</div>"))
        want[i] = " ".join(f"Part {i} of {k}" for k in some)
    assert texts(spark, rows) == want


def test_runs_that_repeat_are_one():
    items, held = html_extract.folded(["a", *["b", "c", "c"] * 5, "d"])
    assert items == ["a", "b+", "c+", "d"] and [sorted(h) for h in held] == [[0], [1, 4, 7, 10, 13], [2, 3, 5, 6, 8, 9, 11, 12, 14, 15], [16]]
    assert html_extract.folded(["a", "b", "a", "b"])[0] == ["a", "b", "a", "b"]
    wrapper = html_extract.align(["a", "b+", "a"], ["a"])
    assert html_extract.match(["a", "b+", "a"], wrapper) == [0, 1, 2] and len(html_extract.match(["a"], wrapper)) == 1


def test_another_wrapper_gives_another_text():
    """What is kept is what stands at the wrapper's data places: of the same shape another wrapper keeps other items."""
    shape, data = ["top", "story", "story/div", "end"], {1}
    assert html_extract.main_items(shape, data, html_extract.match(shape, shape)) == [1]
    assert html_extract.main_items(["junk"], data, html_extract.match(shape, ["junk"])) == []
    assert html_extract.main_items(["end", "top", "story?"], data, html_extract.match(shape, ["end", "top", "story?"])) == [0]


def test_wrappers_against_brute_force(spark):
    """The inferred expression, run as a regular expression, takes every shape of its template; it has no union and no place that no shape fills."""
    rng = random.Random(8)
    shapes = set()
    for _ in range(40):
        body = ["nav"] * rng.randint(0, 1) + ["head"] + ["p/a"] * rng.randint(0, 3) + (["row/x", "row/y"] * rng.randint(0, 6)) + ["foot"] + ["end"] * rng.randint(0, 1)
        shapes.add("\n".join(html_extract.folded(body)[0]))
    rows = [("h", k, s, 1) for k, s in enumerate(sorted(shapes))]
    found = html_extract.templates(spark.createDataFrame(rows, "host string, sid long, shape string, n long")).collect()
    assert len(found) == len(rows)
    for r in found:
        parts = [(w.rstrip("+?"), w[len(w.rstrip("+?")) :]) for w in r.wrapper.split("\n")]
        pattern = "".join(f"(?:{re.escape(n)}\\+?,)" + ("?" if "?" in f else "") for n, f in parts)
        assert re.fullmatch(pattern, r.shape.replace("\n", ",") + ","), (r.shape, r.wrapper)
        places = html_extract.match(r.shape.split("\n"), r.wrapper.split("\n"))
        assert places == sorted(set(places)) and min(places) >= 0
        assert all("?" in f or i in places for i, (_, f) in enumerate(parts))
    used = {}
    for r in found:
        used.setdefault(r.wrapper, set()).update(html_extract.match(r.shape.split("\n"), r.wrapper.split("\n")))
    assert all(u == set(range(len(w.split("\n")))) for w, u in used.items())


def test_a_story_that_a_site_repeats_is_kept(spark):
    """Pages of one story under other stamps: the story is on all pages of its template, and most of what they have."""
    story = "<div class=top>Welcome</div><div class=story><p>The same story, told at some length, with all that belongs to it.</p><p>And its end.</p></div><div class=stamp>Updated {0}</div><div class=end>All rights</div>"
    rows = [(i, "http://a.example.com/p", story.format(i)) for i in range(4)]
    assert texts(spark, rows) == {i: f"The same story, told at some length, with all that belongs to it. And its end. Updated {i}" for i in range(4)}
    nested = story.replace("<p>And its end.</p>", "<ul><li>And</li><li>its end.</li></ul>")
    rows = [(i, "http://b.example.com/p", nested.format(i)) for i in range(4)]
    assert texts(spark, rows) == {i: f"The same story, told at some length, with all that belongs to it. And its end. Updated {i}" for i in range(4)}


def test_pages_that_differ_outside_their_text_only_keep_it(spark):
    page = "<div class=nav>Item {0}</div><div class=a><p>One half of it</p></div><div class=b><p>And the other</p></div>"
    assert texts(spark, [(i, "http://c.example.com/p", page.format(i)) for i in range(4)]) == {i: "One half of it And the other" for i in range(4)}


def test_comments_without_an_article(spark):
    page = "<div class=top>Welcome</div><div class=story><p>Story {0} here, at length</p></div><div class=reactions><p>Reader {0} says</p></div>"
    assert texts(spark, [(i, "http://d.example.com/p", page.format(i)) for i in range(4)]) == {i: f"Story {i} here, at length" for i in range(4)}


def test_long_records_are_groups():
    record = [f"s{i}" for i in range(30)]
    for times in (2, 3, 7):
        items, held = html_extract.folded(["a", *record * times, "z"])
        assert items == ["a", *(f"{s}+" for s in record), "z"] and all(len(h) == times for h in held[1:-1])
    slots = [f"x{i % 7}" for i in range(4900)]
    assert html_extract.folded(slots)[0] == [f"x{i}+" for i in range(7)]
