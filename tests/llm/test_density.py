"""The main text follows the densities: brute force on small trees, pages without an article, and what changes without densities."""

from __future__ import annotations

import math
import re

import pytest
from wareflow.llm import html

PARAGRAPH = "This paragraph is a part of the text that the page is about, and it is long enough to be dense. "


def brute_force(node, share):
    """(density, sum of the children's, characters, tags, link characters, link tags) of a nested (tag, text, children)."""
    tag, text, children = node
    below = [brute_force(c, share) for c in children]
    chars = len(text) + sum(b[2] for b in below)
    tags = sum(b[3] + 1 for b in below)
    links = len(text) * (tag == "a") + sum(b[4] for b in below)
    link_tags = sum(b[5] for b in below) + sum(c[0] == "a" for c in children)
    density = 0.0
    if chars:
        inner = math.log(chars / max(1, chars - links) * links + share * chars + math.e)
        density = chars / max(1, tags) * math.log(max(1.0, chars / max(1, links) * max(1, tags) / max(1, link_tags))) / max(0.1, math.log(inner))
    return density, sum(b[0] for b in below), chars, tags, links, link_tags


def test_densities_equal_a_brute_force_version():
    tree = ("body", "", [("div", "abcdefgh", [("a", "link", []), ("p", "some text here", [("a", "more", []), ("b", "bold", [])])]), ("div", "", [("p", "x" * 90, []), ("p", "y" * 20, [])])])

    def written(node):
        return f"<{node[0]}>{node[1]}{''.join(map(written, node[2]))}</{node[0]}>"

    page = html._Page(written(tree))
    sizes = [0] * len(page.tag)
    for n, text in page.flow:
        sizes[n] += len(text or "")
    whole = brute_force(tree, 0)
    share, wanted = whole[4] / whole[2], []

    def collect(node):
        wanted.append(brute_force(node, share)[0])
        for child in node[2]:
            collect(child)

    collect(tree)
    assert html.densities(page, sizes)[1:] == pytest.approx(wanted)


@pytest.mark.parametrize("wrapper", ["div", "section", "td"])
def test_pages_without_an_article(wrapper):
    body = "".join(f"<p>{k} {PARAGRAPH * 2}</p>" for k in range(4))
    page = f"<body><div><a href=/>Home</a> <a href=/a>About us</a></div><div>Call us now</div><{wrapper}><h1>Head</h1>{body}<p>Yes.</p></{wrapper}><div>All rights</div></body>"
    if wrapper == "td":
        page = page.replace("<td>", "<table><tr><td>").replace("</td>", "</td></tr></table>")
    wanted = ["Head", *[f"{k} {(PARAGRAPH * 2).strip()}" for k in range(4)], "Yes."]
    assert html.main_text(page).split("\n") == wanted


def test_a_named_element_with_the_only_text_is_the_text():
    for name in ("menu-item recipe", "post related-work", "sidebar", "related"):
        assert html.main_text(f"<body><div class='{name}'><p>{PARAGRAPH}</p></div></body>") == PARAGRAPH.strip()


def articles(source):
    """What stands in the article element of the given, simple pages, read by patterns alone."""
    inner = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", source, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|li|ul)\b[^>]*>", inner)
    lines = [" ".join(html.html.unescape(re.sub(r"<br>", " ", re.sub(r"<(?!br)[^>]*>", "", b))).split()) for b in blocks]
    return "\n".join(x for x in lines if x)


def test_densities_decide_the_pages(spark, sf_dir, monkeypatch):
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    with_density = [html.main_text(p) for p in pages]

    wanted = [articles(p) for p in pages]
    assert with_density == wanted
    # With the advert's name gone nothing but the density tells it from the article.
    nameless = [p.replace(' class="ad"', "") for p in pages]
    assert sum(html.main_text(p) == w for p, w in zip(nameless, wanted, strict=True)) > 0.6 * len(pages)
    monkeypatch.setattr(html, "densities", lambda page, sizes: [0.0 if o else 1.0 for o in page.out])
    assert sum(html.main_text(p) == w for p, w in zip(nameless, wanted, strict=True)) < 0.1 * len(pages)


def test_nothing_and_very_much():
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>menu</nav>") == html.main_text("<body></body>") == ""
    long = "word " * 200_000
    assert html.main_text(f"<body><p>{long}</p></body>") == long.strip()
    many = "".join(f"<p>{k}</p>" for k in range(20_000))
    assert html.main_text(f"<body><div>{many}</div></body>") == "\n".join(map(str, range(20_000)))


def test_empty_table(spark):
    assert html.extracted(spark.createDataFrame([], "page_id long, html string, text string")).columns == ["page_id", "html", "text"]
    assert html.extracted(spark.createDataFrame([], "page_id long, html string")).count() == 0
