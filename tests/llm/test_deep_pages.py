"""Pages nested to any depth: marginal parts stay out, tags close what they opened, patterns survive their flat form."""

import sys

import pytest

from hazardline.llm import wrappers as W


def nested(depth):
    side = "<div class=sidebar>" + "<div>" * 70 + "side" + "</div>" * 70 + "</div>"
    return "<html><body>" + side + "<div>" * depth + "<nav>menu</nav>" + side + "<p>The text.</p>" + "</div>" * depth + "<div class=sidebar>more</div></body></html>"


@pytest.fixture
def unbounded():
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(W._NESTING)
    yield
    sys.setrecursionlimit(before)


@pytest.mark.parametrize("depth", [1, 97, 98, 99, 150, 20_000])
def test_text_at_any_depth(unbounded, depth):
    node = W._both(W.pattern(W.parse(nested(depth))), W.pattern(W.parse(nested(depth))))
    again = W.unpacked(W.packed(node))
    assert W.packed(again) == W.packed(node)
    free = W.released(again)
    assert W.main_text(W.opened(W.parse(nested(depth)), free), W.main_paths(W.weighed(again, free))) == "The text."


def test_flat_form_of_patterns():
    node = ["page", "1", 5, [["p", "+", 5, [["#", "1", 5, []]]], ["div sidebar", "?", 0, []], ["ul", "*", 0, [["li", "1", 0, []], ["li", "1", 0, []]]]]]
    assert W.unpacked(W.packed(node)) == node


def test_deep_pages_beside_flat_ones(spark):
    rows = [(i, "http://h/", nested(d)) for i, d in enumerate([1, 150, 4000, 150])] + [(4, "http://h/", "<p>flat</p>"), (5, "http://h/", None)]
    got = W.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert {r.page_id: r.text for r in got} == {**dict.fromkeys(range(4), "The text."), 4: "flat", 5: ""}
