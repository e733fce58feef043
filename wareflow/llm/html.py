"""Main text of web pages by composite text density.

A page becomes a tree of elements.  Kinds that are never main text (menus, footers, asides, scripts, controls) are
left out with all that is in them.  For each other node, its characters per tag are adjusted for links: the more of
its characters and tags are those of links, the smaller the logarithm they are multiplied with.  Forms, page
headers and elements with a name of boilerplate in ``class``, ``id`` or ``role`` may still hold the text, so for them
and what is in them this density only counts by a share, once for each such element around it: a tenth where the name
is a whole word ("sidebar"), a fifth where it is part of a compound one ("comment-list", "leftSidebar"), a half where
the compound may as well name a topic ("social-science"), all of it after "with", "no" and the like ("with-sidebar").

A node's density sum adds up the densities of its children.  The node with the largest sum is the content, though none
under more doubt than an ``article`` or ``main`` with text, and the least density on the way from it to the body is the
threshold:

- Of what stands beside that way, nodes at least as dense as the threshold belong to the content too; below the
  body, so do headings, paragraphs, lists and the like that are not links alone.  Neither do so under more doubt
  than the content.
- A node in the content that is doubted by more than a half and thinner than the content is left out again, unless no
  text is left.

Text is given block by block, one a line: character references decoded, runs of white space made one space (a
``br`` counts as white space), blocks without text left out.  Null, empty and text-free pages give the empty text.
Broken markup is read as browsers do as far as text goes: unclosed elements end with those around them, stray end
tags are ignored, ``p`` and list items end where the next one starts.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

#: Fixed values of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
_ENDS_P = _BLOCK - frozenset("td th tr tbody thead tfoot caption body html".split())
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Elements that are never main text.
_OUT = frozenset("nav footer aside script style noscript template textarea select button input iframe canvas audio video dialog menu head title desc metadata".split())
#: Elements that running text is made of.
_FLOW = frozenset("h1 h2 h3 h4 h5 h6 hgroup p blockquote pre ul ol dl table figure figcaption details summary address b i em strong span a".split())
#: What the density of an element that looks like boilerplate is multiplied with: by a whole word, by a part of a
#: compound, and by a part that may be a topic.
DOUBT, COMPOUND_DOUBT, INNER_DOUBT = 0.1, 0.2, 0.5
#: Names that, unless they end a compound, may as well be what a text is about ("social-science").
_TOPICS = frozenset("social menu search notice alert advertising advertisement promotion subscription login".split())
#: After these a compound's words say what an element has or lacks, not what it is.
_ABOUT = frozenset("with has no non not without hide show is before after above below".split())
_PARTS = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z0-9])(?=[A-Z])")
#: Names of boilerplate, evidence only; a "header" inside an article is kept.
_OUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay"
    " nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead comments comment disqus respond reply replies share sharing social"
    " related recommended newsletter subscribe subscription signup login search pagination pager toolbar widget complementary contentinfo".split()
)


def doubt_by_names(words: list[str]) -> float:
    """What the words of an element's names make of its density: 1 where they say nothing against it."""
    doubt = 1.0
    for word in words:
        if word.lower() in _OUT_NAMES:
            return DOUBT
        parts = [p.lower() for p in _PARTS.split(word) if p]
        parts = parts[: next((k for k, p in enumerate(parts) if p in _ABOUT), len(parts))]
        telling = _OUT_NAMES.intersection(parts)
        if telling - _TOPICS or (parts and parts[-1] in telling):
            doubt = min(doubt, COMPOUND_DOUBT)
        elif telling:
            doubt = min(doubt, INNER_DOUBT)
    return doubt


class _Page:
    """The elements of a page in the order in which they start; parents come before children."""

    def __init__(self, source: str):
        self.tag, self.parent, self.out, self.last = ["#"], [-1], [False], [0]
        #: Elements that look like boilerplate, and what their density is multiplied with.
        self.doubted: dict[int, float] = {}
        #: (node, decoded text), and (node, None) where a block starts or ends.
        self.flow: list[tuple[int, str | None]] = []
        self.stack = [0]
        self.open: dict[str, int] = {"#": 1}
        self._read(source)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in _ENDS_P and self.open.get("p"):
            self._close({"p"}, {"table", "button"})
        if tag in _SAME and any(self.open.get(t) for t in _SAME[tag]):
            self._close(_SAME[tag], _FENCE[tag])
        node = len(self.tag)
        above = self.stack[-1]
        names = [w for m in _NAMES.findall(attributes) for part in m for w in part.split()] if attributes else []
        out = self.out[above] or tag in _OUT
        if not out and tag not in ("html", "body"):
            inside = self.open.get("article") or self.open.get("main")
            doubt = doubt_by_names(names)
            if tag == "form" or ((tag == "header" or "header" in map(str.lower, names)) and not inside):
                doubt = DOUBT
            if doubt < 1:
                self.doubted[node] = doubt
        self.tag.append(tag)
        self.parent.append(above)
        self.out.append(out)
        self.last.append(node)
        if tag in _BLOCK:
            self.flow.append((node, None))
        elif tag == "br":
            self.flow.append((above, " "))
        if tag not in _VOID:
            self.stack.append(node)
            self.open[tag] = self.open.get(tag, 0) + 1

    def _pop(self) -> None:
        node = self.stack.pop()
        self.open[self.tag[node]] -= 1
        if self.tag[node] in _BLOCK:
            self.flow.append((self.stack[-1], None))

    def _close(self, tags: set, fence: set) -> None:
        """Ends the nearest open element of ``tags`` and what is open in it, unless a fence is nearer."""
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.tag[self.stack[i]]
            if tag in tags:
                while len(self.stack) > i:
                    self._pop()
                return
            if tag in fence:
                return

    def _read(self, source: str) -> None:
        at, low = 0, None
        for m in iter(lambda: _TAG.search(source, at), None):
            if m.start() > at:
                self.flow.append((self.stack[-1], source[at : m.start()]))
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                if self.open.get(tag):
                    self._close({tag}, set() if tag in _BLOCK else {"td", "th", "table", "article", "section", "div", "main"})
                continue
            self._start(tag, m[3])
            if tag in _RAW:
                low = low or source.lower()
                low = low if len(low) == len(source) else source
                end = low.find(f"</{tag}", at)
                end = len(source) if end < 0 else end
                if tag == "textarea":
                    self.flow.append((self.stack[-1], source[at:end]))
                at = end
        if at < len(source):
            self.flow.append((self.stack[-1], source[at:]))


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Composite text density of a node: its characters per tag, adjusted for links.

    ``share`` is the body's share of link characters.  The inner logarithm tends to nothing where a page has no
    links, so it counts as a tenth at least.
    """
    if not chars:
        return 0.0
    tags, plain = max(1, tags), max(1, chars - link_chars)
    base = math.log(math.log(chars / plain * link_chars + share * chars + math.e))
    return chars / tags * math.log(max(1.0, chars / max(1, link_chars) * (tags / max(1, link_tags)))) / max(0.1, base)


def densities(page: _Page, sizes: list[int]) -> list[float]:
    """The density of each node, given the characters of its own text; 0 for what is left out."""
    count = len(page.tag)
    in_link = [False] * count
    chars, tags, link_chars, link_tags, all_chars, all_links = (x[:] for x in [[0] * count] * 6)
    for n in range(1, count):
        in_link[n] = in_link[page.parent[n]] or page.tag[n] == "a"
    for n in range(count - 1, -1, -1):
        all_chars[n] += sizes[n]
        all_links[n] += sizes[n] * in_link[n]
        if not page.out[n]:
            chars[n] += sizes[n]
            link_chars[n] += sizes[n] * in_link[n]
        if n:
            above, counts = page.parent[n], not page.out[n]
            all_chars[above] += all_chars[n]
            all_links[above] += all_links[n]
            chars[above] += chars[n]
            link_chars[above] += link_chars[n]
            tags[above] += (tags[n] + 1) * counts
            link_tags[above] += (link_tags[n] + (page.tag[n] == "a")) * counts
    # Menus have the links of most pages, so they count in the body's share.
    share = all_links[0] / max(1, all_chars[0])
    return [0.0 if page.out[n] else density(chars[n], tags[n], link_chars[n], link_tags[n], share) for n in range(count)]


def content(page: _Page, dense: list[float], doubting: bool = True) -> list[bool]:
    """Which nodes the content is made of."""
    count = len(page.tag)
    weight = [1.0] * count
    for n in range(1, count):
        weight[n] = weight[page.parent[n]] * (page.doubted.get(n, 1.0) if doubting else 1.0)
    dense = [d * w for d, w in zip(dense, weight, strict=True)]
    sums = [0.0] * count
    for n in range(1, count):
        sums[page.parent[n]] += dense[n]
    # The root and the html element only hold the body.
    may_be = [n for n in range(count) if not page.out[n] and page.tag[n] not in ("#", "html")] or [0]
    if all(page.tag[n] != "body" for n in may_be):
        may_be.append(0)
    surest = max((weight[n] for n in may_be if page.tag[n] in ("article", "main") and dense[n] > 0), default=0.0)
    may_be = [n for n in may_be if weight[n] >= surest]
    best = max(may_be, key=lambda n: (sums[n], dense[n], -n))
    way = [best]
    while way[-1] > 0 and page.tag[way[-1]] != "body":
        way.append(page.parent[way[-1]])
    on_way, least = set(way), min(dense[n] for n in way)
    within = [n == best for n in range(count)]
    for n in range(1, count):
        above = page.parent[n]
        thin = doubting and page.doubted.get(n, 1.0) < INNER_DOUBT and n not in on_way and dense[n] < max(least, dense[best])
        if page.out[n] or n == best or thin:
            continue
        flows = page.tag[n] in _FLOW and above != way[-1] and dense[n] > 0
        beside = above in on_way and n not in on_way and weight[n] >= weight[best] and (dense[n] >= least > 0 or flows)
        within[n] = within[above] or beside
    # Text of the nodes on the way themselves, such as that after an inner element, is not that of a node beside it.
    for n in way:
        within[n] = within[n] or page.tag[n] not in ("#", "html", "body")
    return within


def main_text(source: str | None) -> str:
    """The main text of a page."""
    if not source:
        return ""
    page = _Page(source)
    sizes, decoded = [0] * len(page.tag), []
    for node, text in page.flow:
        if text is not None:
            text = html.unescape(text)
            sizes[node] += len(" ".join(text.split()))
        decoded.append((node, text))
    if not any(n and not o for n, o in zip(sizes, page.out, strict=True)):
        return ""
    dense = densities(page, sizes)
    within = content(page, dense)
    if not any(n and w for n, w in zip(sizes, within, strict=True)):
        within = content(page, dense, doubting=False)
    blocks, line = [], []
    for node, text in decoded:
        if text is None:
            blocks.append(line)
            line = []
        elif within[node]:
            line.append(text)
    blocks.append(line)
    lines = (" ".join("".join(b).split()) for b in blocks if b)
    return "\n".join(x for x in lines if x)


def extracted(pages: DataFrame, source: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text of the whole ``source`` in ``text``, replacing a column of that name."""

    @F.arrow_udf("string")
    def extract(sources: pa.Array) -> pa.Array:
        return pa.array([main_text(s.as_py()) for s in sources], pa.string())

    return pages.withColumn(text, extract(F.col(source)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the main text of every page."""
    pages = extracted(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
