"""Main text of web pages by composite text density.

Every node of a page's tree has its characters, tags, link characters and link tags. A node's density is
characters per tag, adjusted so that text inside links counts for less; its density sum adds the densities of its children. The
subtree with the largest sum is the article's core, whatever its tag or name. On the way from it up to the body other parts join it: those that are at least as dense as the
body-path threshold and half as dense as the core. The threshold is the smallest density on that path below the body, and the body's at least. Where an article or main element holds the
core, plain parts of it that are less dense (captions, bylines, short paragraphs) join too, lists of links don't. On the pages of the test tables density alone gives the same texts.

Elements that never hold article text (scripts, menus, controls, ...) and parts whose class or id has only words for such parts (comments, related-posts, ad-slot, ...) go
before densities are computed. Names that have other words too (related-work, newsletter-history), elements hidden from assistive tools and an article's own header are only suspects: inside an article or main
element they go if they are less than half as dense as the threshold, of a header all but its headings. A form stays only as the frame of the whole: if the core is in it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never article text.
DROPPED = frozenset(
    "script style noscript template head title nav footer aside button select option textarea input label iframe object svg math canvas audio video dialog menu map datalist".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"))
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar status".split())
#: Words of a class or id that mark a part as something other than the article, if the name has no others but these, WEAK and NEUTRAL ones and COMPANIONS; with others they make it a suspect.
STRONG = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored promo promotion
    nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination sidebar sidebars
    widget widgets related recommended share sharing social newsletter subscribe subscription signup login cookie cookies consent
    gdpr popup comment comments commentlist respond disqus""".split()
)
#: Words that do so outside an article; inside one they make a part a suspect.
WEAK = frozenset("banner banners pager toc footer header masthead topbar toolbar aside rail notice notices alert alerts modal overlay reply replies discussion form search copyright legal disclaimer".split())
NEUTRAL = frozenset("site page global top bottom left right inner outer main box block bar list area wrap wrapper container row col column section item items widget part id class the and fixed sticky mobile desktop".split())
COMPANIONS = frozenset("post posts article articles content entry story stories blog user users reader readers count link links button btn icon latest popular more slot unit panel card cards module".split())
CONTENT = frozenset(("article", "main"))
#: A start tag closes these open elements first.
P_ENDS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "optgroup": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Node:
    __slots__ = ("tag", "up", "items", "dropped", "weak", "heads_only", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, up: Node | None, dropped: bool, weak: bool = False):
        self.tag, self.up, self.items, self.dropped, self.weak, self.heads_only = tag, up, [], dropped, weak, False


def _marks(tag: str, attrs: list, in_content: bool) -> tuple[bool, bool]:
    """Whether a part never is article text, and whether its name only suggests so."""
    if tag in DROPPED:
        return True, False
    if tag == "header":
        return not in_content, in_content
    suspect = weak = False
    for k, v in attrs:
        if k == "hidden":
            return True, False
        if not v:
            continue
        if k == "style" and "display:none" in v.replace(" ", "").lower() or k == "role" and v.lower() in ROLES and tag != "form":
            return True, False
        suspect |= k == "aria-hidden" and v == "true"
        if k in ("class", "id", "itemprop") and tag not in HEADINGS:
            for name in v.split():
                words = {m.lower() for m in _WORD.findall(name)}
                if tag in ("html", "body", "article", "main"):
                    # comments are often articles of their own
                    if tag == "article" and not words.isdisjoint(("comment", "comments", "reply")):
                        return True, False
                elif k != "itemprop":
                    known = words <= STRONG | WEAK | NEUTRAL | COMPANIONS
                    if not words.isdisjoint(STRONG):
                        if known or tag == "form":
                            return True, False
                        suspect = True
                    weak |= tag != "form" and not words.isdisjoint(WEAK) and words <= WEAK | NEUTRAL
    return weak and not in_content, suspect or weak


class Tree(HTMLParser):
    """The nodes of a page, with the usual repairs for end tags that are missing."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None, False)
        self.open: Counter = Counter()  # elements that are open, by tag
        self.forms: list[Node] = []

    def _leave(self, to: Node) -> None:
        while self.at is not to:
            self.open[self.at.tag] -= 1
            self.at = self.at.up

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "body"):
            if tag == "body":
                self._leave(self.root)
            return
        if tag in P_ENDS:
            self._close("p", ("td", "th", "li", "div", "article", "section", "main", "blockquote", "button"))
        elif tag in SIBLINGS:
            self._close_any(SIBLINGS[tag], SCOPES[tag])
        if tag in HEADINGS and self.at.tag in HEADINGS:
            self._leave(self.at.up)
        if tag == "a":
            self._close("a", ("td", "th", "li", "div", "p", "article"))
        at = self.at
        drop, weak = (True, False) if at.dropped else _marks(tag, attrs, self.open["article"] + self.open["main"] > 0)
        node = Node(tag, at, drop, weak)
        at.items.append(node)
        if tag == "form" and not drop:
            self.forms.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def _close(self, tag: str, stop: tuple) -> None:
        at = self.at
        if self.open[tag]:
            while at.tag != tag:
                if at.tag in stop:
                    return
                at = at.up
            self._leave(at.up)

    def _close_any(self, tags: set, stop: set) -> None:
        at, last = self.at, None
        if any(self.open[t] for t in tags):
            while at.up is not None and at.tag not in stop:
                if at.tag in tags:
                    last = at
                at = at.up
            if last is not None:
                self._leave(last.up)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body") or tag in VOID:
            if tag == "br":
                self.at.items.append(Node("br", self.at, self.at.dropped))
        elif self.open[tag]:
            at = self.at
            while at.tag != tag:
                at = at.up
            self._leave(at.up)

    def handle_data(self, data: str) -> None:
        if not self.at.dropped:
            self.at.items.append(data)


def _measure(root: Node) -> None:
    """Characters, tags, link characters, link tags, density and density sum, children first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [x for x in node.items if not isinstance(x, str) and not x.dropped]
    for node in reversed(order):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for x in node.items:
            if isinstance(x, str):
                node.chars += len(x.strip())
            elif not x.dropped:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
    share = root.link_chars / max(root.chars, 1)
    for node in reversed(order):
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        if not c:
            node.density = 0.0
        else:
            base = math.log(c * node.link_chars / max(c - node.link_chars, 1) + share * c + math.e)
            node.density = c / t * math.log(max(c / lc * t / lt, 1.0) + 1.0) / math.log(base + 1.0)
        node.total = sum(x.density for x in node.items if not isinstance(x, str) and not x.dropped) or node.density


def _parts(node: Node) -> list[Node]:
    return [x for x in node.items if not isinstance(x, str) and not x.dropped]


def _heads(node: Node) -> bool:
    """Whether all text of a part is in headings."""
    todo = [node]
    while todo:
        at = todo.pop()
        if at.tag not in HEADINGS:
            if any(isinstance(x, str) and x.strip() for x in at.items):
                return False
            todo += _parts(at)
    return True


def _core(root: Node) -> Node:
    """The block with the largest density sum; of equal ones the outermost, then the first."""
    best, todo = root, _parts(root)[::-1]
    while todo:
        node = todo.pop()
        # text of inline elements belongs to the block around them
        if node.tag not in INLINE and node.chars and (node.total > best.total or best is root and node.total >= best.total):
            best = node
        todo += _parts(node)[::-1]
    if best.up is not None and (best.tag in ("p", "li", "pre", "blockquote") or best.tag in HEADINGS):
        best = best.up
    return best


def _select(root: Node) -> None:
    """Drop all that is neither in the core nor joins it."""
    core = _core(root)
    path = [core]
    while path[-1].up is not None:
        path.append(path[-1].up)
    threshold = max(root.density, min((x.density for x in path[:-1]), default=0.0))
    content = next((i for i in range(len(path) - 1, -1, -1) if path[i].tag in CONTENT), -1)  # the outermost article or main around the core
    for i, node in enumerate(path[1:], 1):
        for x in _parts(node):
            if x is path[i - 1] or not x.chars:
                continue
            links = 2 * x.link_chars > x.chars
            if i <= content:
                x.dropped = links and x.tag not in INLINE
            elif _heads(x):
                x.dropped = links
            else:
                x.dropped = links or x.density < max(threshold, core.density / 2)
        if i > content:
            # loose text around the core
            node.items = [x for x in node.items if not isinstance(x, str) or len(x.strip()) >= max(threshold, core.density / 2)]
    todo = [path[content] if content >= 0 else core]
    while todo:
        for x in _parts(todo.pop()):
            if x.weak and x.density < threshold / 2:
                x.heads_only = x.tag == "header"
                x.dropped = not x.heads_only
            else:
                todo.append(x)


def _text(top: Node) -> str:
    blocks, words = [], []

    def end() -> None:
        line = " ".join("".join(words).split())
        if line:
            blocks.append(line)
        words.clear()

    todo: list = [top]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            words.append(x)
        elif x is None:
            end()
        elif x.dropped:
            if x.tag not in INLINE:
                end()
        elif x.tag == "br":
            words.append(" ")
        elif x.tag in INLINE:
            todo += reversed(x.items)
        else:
            end()
            todo.append(None)
            items = x.items
            if x.heads_only:
                items = [y for y in items if not isinstance(y, str) and y.tag in HEADINGS]
            todo += reversed(items)
    end()
    return " ".join(blocks)


def main_text(html: str | None) -> str:
    """The article of one page."""
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    _measure(tree.root)
    if not tree.root.chars:
        return ""
    if tree.forms:
        held, at = set(), _core(tree.root)
        while at is not None:
            held.add(at)
            at = at.up
        for form in tree.forms:
            form.dropped = form not in held
        _measure(tree.root)
    _select(tree.root)
    return _text(tree.root)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages(page_id, url, html, ...).

    Null or empty html, and a page without article text, give an empty text. Character references are decoded; white space inside a
    block becomes one space; blocks are joined by one space. Long pages are parsed whole. Null page_id or url stay null, repeated rows stay
    repeated, further columns are ignored, no rows give no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "html"):
            texts = [main_text(x) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
