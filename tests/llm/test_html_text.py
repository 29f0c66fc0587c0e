"""What belongs to an article stays in it, and time follows the size of a page."""

import time

import pytest

from sieveline.llm.html_text import main_text

TEXT = "A long paragraph, with commas, and some more text. "


def inside(part, mark="main"):
    """The blocks that a part of an article gives."""
    page = f"<body><{mark}><p>{TEXT * 5}</p>{part}<p>{TEXT * 5}</p></{mark}></body>"
    lines = main_text(page).split("\n")
    assert lines[0] == lines[-1] == (TEXT * 5).strip()
    return lines[1:-1]


@pytest.mark.parametrize("part, blocks", [
    ("<section id='related-work'><p>Others did it before.</p></section>", ["Others did it before."]),
    ("<div class='search-results-discussion'><p>What we found.</p></div>", ["What we found."]),
    ("<section id='discussion'><h2>Discussion</h2><p>We discuss.</p></section>", ["Discussion", "We discuss."]),
    ("<ul><li><a href=1>Source one</a></li><li><a href=2>Source two</a></li></ul>", ["Source one", "Source two"]),
    ("<table><tr><td><a href=1>Cell</a></td></tr></table>", ["Cell"]),
    ("<p>Let <math><mi>a</mi><mo>=</mo><mi>b</mi></math> hold.</p>", ["Let a=b hold."]),
    ("<object data=x><p>Instead of the film</p></object>", ["Instead of the film"]),
])
def test_article_text_stays(part, blocks):
    assert inside(part) == inside(part, "article") == blocks


@pytest.mark.parametrize("part", [
    "<section id='comments'><p>I disagree.</p></section>", "<div class='comment-list'><p>First!</p></div>", "<div class='share-buttons'>Share</div>",
    "<div class='ad'><p>Buy this.</p></div>", "<div class='cookie-notice'>We use cookies.</div>", "<select><option>One<option>Two</select>",
    "<nav><a href=1>Next</a></nav>", "<div role='search'>Find</div>", "<div class='post related'><a href=1>More</a></div>",
])
def test_other_parts_go(part):
    assert inside(part) == []


def test_lists_of_links_at_the_edge_of_an_unmarked_container_go():
    menu = "<ul><li><a href=1>Home page</a></li><li><a href=2>Other page</a></li></ul>"
    page = f"<div>{menu}<p>{TEXT * 5}</p>{menu}<p>{TEXT * 5}</p>{menu}</div>"
    assert main_text(page).split("\n") == [(TEXT * 5).strip(), "Home page", "Other page", (TEXT * 5).strip()]


@pytest.mark.parametrize("tags", ["<div><p>", "<b>", "<font><h1>", "<span>x</i>", "<p><b>", "<ul><li>", "<table><tr><td>", "<a><div></a>", "</p>", "<div></span>"])
def test_time_is_linear_in_depth(tags):
    def seconds(n):
        began = time.perf_counter()
        assert main_text("<body>" + tags * n + TEXT * 3).endswith(TEXT.strip())
        return time.perf_counter() - began

    assert seconds(50_000) < 10 * max(seconds(12_500), 0.05)  # four times, with room for a busy machine
