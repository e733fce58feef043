from __future__ import annotations

import pytest
from wareflow.llm import html

BODY = "<article><h1>Title</h1><p>A full article with a long first paragraph, and more.</p><p>A second paragraph, as long as the first one.</p></article>"
DIVS = "<div><h1>Title</h1><p>A full article with a long first paragraph, and more.</p><p>A second paragraph, as long as the first one.</p></div>"
WANTED = "Title\nA full article with a long first paragraph, and more.\nA second paragraph, as long as the first one."
WRAPPERS = [
    '<div class="layout with-sidebar">{}</div>',
    '<div id="no-menu">{}</div>',
    '<section class="social-science">{}</section>',
    '<div class="sidebar">{}</div>',
    '<div class="page header">{}</div>',
    "<form action=/ method=post>{}</form>",
    "<header>{}</header>",
    '<div data-id="menu">{}</div>',
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("body", [BODY, DIVS])
def test_wrappers_with_names_of_boilerplate_keep_the_content(wrapper, body):
    page = "<body><nav><a href=/>home</a></nav>" + wrapper.format('<div class="ad">buy</div>' + body + "<form>your mail</form>") + "<footer>f</footer>"
    assert html.main_text(page) == WANTED


def test_boilerplate_beside_and_in_an_article_still_goes():
    page = BODY.replace("</article>", '<div class="comments"><article>nice one</article></div></article>') + '<div class="wide related">see also</div>'
    assert html.main_text(page) == WANTED


def test_pages_in_named_parts_only_are_not_empty():
    assert html.main_text("<div class=widget>one part of it</div><div class=widget>one part of us</div>")
