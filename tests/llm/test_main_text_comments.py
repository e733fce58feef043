"""Short articles beside long reader comments of any naming, and pages worked out by hand."""

from __future__ import annotations

import itertools

import pytest
from wareflow.llm import html

SHORT = "<article><h1>News</h1><p>A short report of one paragraph, written by our staff.</p></article>"
WANTED = "News\nA short report of one paragraph, written by our staff."
COMMENT = "I have read this report three times now and I must say that nothing in it agrees with what I saw there. "
NAMES = [("comments", "comment"), ("comment-list", "comment-body"), ("commentList", "comment_text"), ("post-comments", "reply-item"), ("disqus_thread", "x"), ("user-comments-wrap", "y"), ("respond-area", "")]


@pytest.mark.parametrize("names, inside, attribute", itertools.product(NAMES, (False, True), ("class", "id")))
def test_comments_are_not_the_article(names, inside, attribute):
    each = "".join(f"<div {attribute}='{names[1]}'><p>{COMMENT * 3}</p></div>" for _ in range(12))
    comments = f"<div {attribute}='{names[0]}'>{each}</div>"
    body = SHORT.replace("</article>", comments + "</article>") if inside else SHORT + comments
    for page in (body, f"<div class='page'>{body}</div>", f"<main>{body}</main>"):
        assert html.main_text(f"<html><body><nav><a href=/>Home</a></nav>{page}<footer>f</footer></body></html>") == WANTED


PAGES = [
    ("<p>We know where <math><mi>x</mi><mo>=</mo><mn>7</mn></math> holds.</p>", "We know where x=7 holds."),
    ("<p>A <svg><title>icon</title><text>label</text></svg> here.</p>", "A label here."),
    ("<p>Seen <object data=x>as a plan</object> before.</p>", "Seen as a plan before."),
    ("<article><p>One &amp; two&nbsp;three</p><ul><li>first<li>second</ul></article><div class=site-footer>All rights</div>", "One & two three\nfirst\nsecond"),
    ("<div class='layout with-sidebar'><main><p>The text of the page, all of it.</p></main></div><div class='left-sidebar'><p>More of our texts for you to read</p></div>", "The text of the page, all of it."),
    ("<article><p>Before.</p><div class='ad-slot'>Buy this now</div><p>After it, some more.</p></article>", "Before.\nAfter it, some more."),
    ("<article><p>Text of the day, with some length.</p><div class='social-science'><p>Social science is a field of study.</p></div></article>", "Text of the day, with some length.\nSocial science is a field of study."),
    ("<div role='main'><p>First line<br>second line of it.</p></div><div id='cookieBanner'>We use cookies, as you know</div>", "First line second line of it."),
    ("<main><h2>Title</h2><table><tr><td>1<td>2</table><pre>a  b\n c</pre></main>", "Title\n1\n2\na b c"),
    ("<article><header><h1>Head</h1></header><blockquote>Said so.</blockquote><footer>Filed under</footer></article>", "Head\nSaid so."),
]


@pytest.mark.parametrize("source, wanted", PAGES)
def test_pages_by_hand(source, wanted):
    assert html.main_text(f"<body>{source}</body>") == wanted


def test_where_a_name_stands():
    weigh = {("sidebar",): 0.1, ("left-sidebar",): 0.2, ("commentList",): 0.2, ("my-comment-box",): 0.2, ("page-with-sidebar",): 1, ("menu-item",): 0.5, ("with-sidebar",): 1, ("no-menu",): 1, ("social-science",): 0.5, ("wide-menu",): 0.2, ("content", "SIDEBAR"): 0.1, ("",): 1, ("--",): 1}
    assert {k: html.doubt_by_names(list(k)) for k in weigh} == weigh
