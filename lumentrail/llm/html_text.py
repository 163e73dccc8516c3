"""Main text of web pages by composite text density.

Every node of the page's tree gets a density: its characters per tag, weighted
by a logarithm that falls with the share of link characters and link tags. A
block's density sum adds the densities of its children; the block with the
largest sum is the content. The smallest density on its path to the body is a
threshold: what hangs beside the path and reaches it belongs to the content too,
unless links make up most of it.

Titles, bylines and short lists have little density of their own. So from the
content upward: beside a path inside an article or main element everything belongs
to it; in any other block below the body so do headings, paragraphs, lists, tables
and the like, and text that stands in the block itself; and a page's first
heading, wherever it stands, if the content has none. Lists of links stay where a
heading announces them or the content itself holds them; elsewhere they are menus.

What cannot hold text for readers (scripts, styles, inputs) is never counted.
Elements, roles and names that say navigation, header, footer, aside, form,
advert, notice or comments are heeded only then: the chosen block does not lie in
one, and those inside the choice are cut, as are blocks that are mostly links. A
block on the path, or one that holds most of the page's text and its heading, is
a wrapper, whatever it is called. A name counts as a whole: each of its parts
must be such a word or a neutral one ("site-footer" is, "entry-header" is not).

Defined cases: a null or empty page has the empty text; an unclosed element ends
where HTML lets it, any page yields some tree, in time that grows with its
length; pages are read whole; of equal sums the outer, then the earlier block is
chosen; repeated rows are treated alike; other columns pass unchanged except the
added ones; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<open>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Where a raw element ends: at its closing tag, in any case.
_RAW_END = {tag: re.compile(rf"</{tag}[^>]*(?:>|\Z)", re.I | re.A) for tag in RAW}
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Elements that end an open one of their own kind, up to the element that holds them.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "datalist")),
}
NO_TEXT = frozenset("head script style noscript template button select option textarea input iframe object embed svg canvas audio video".split())
AROUND = frozenset("nav footer aside form dialog menu".split())
AROUND_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
AROUND_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert "
    "popup modal overlay newsletter subscribe subscription signup login sidebar side menu nav navbar navigation breadcrumb breadcrumbs toolbar topbar masthead header "
    "footer comment comments commentlist respond reply replies disqus share sharing social related recommended recommendations widget pagination pager skip search copyright".split()
)
#: Words that say nothing beside one of the above.
NEUTRAL_NAMES = frozenset("site page main global primary secondary top bottom left right upper lower box block list item items bar wrapper wrap container links link area section inner outer posts form unit slot text content icons buttons thread".split())
KEPT = frozenset("html body main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: What holds an article, and what is written in one.
RULED = frozenset("article main".split())
WRITTEN = frozenset("p ul ol dl table blockquote pre figure details center".split())


def says_around(name: str) -> bool:
    """Whether a class or an id names what lies around an article."""
    parts = [p for p in _SPLIT.split(name) if p and not p.isdigit()]
    return not AROUND_NAMES.isdisjoint(parts) and all(p in AROUND_NAMES or p in NEUTRAL_NAMES for p in parts)


class Page:
    """A page's tree in lists; a child's number is above its parent's."""

    def __init__(self, source: str):
        self.tag: list[str] = ["html"]
        self.parent = [-1]
        self.cut = [False]  # no text for readers
        self.around = [False]  # by element, role or name
        self.pieces: list[tuple[int, str]] = []  # node and text; a block's start and end are empty texts
        self._build(source)

    def _add(self, tag: str, attrs: str) -> int:
        over = self.stack[-1]
        self.tag.append(tag)
        self.parent.append(over)
        self.cut.append(self.cut[over] or tag in NO_TEXT)
        self.around.append(self._is_around(tag, attrs))
        return len(self.tag) - 1

    def _is_around(self, tag: str, attrs: str) -> bool:
        if tag in AROUND or (tag == "header" and not self.open["article"]):
            return True
        if tag in KEPT or "=" not in attrs and "hidden" not in attrs:
            return False
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id") and any(map(says_around, value.split())):
                return True
            if (name == "role" and value.strip() in AROUND_ROLES) or name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
        return False

    def _push(self, node: int) -> None:
        tag = self.tag[node]
        self.open[tag].append(len(self.stack))
        if tag not in INLINE:
            self.open_blocks.append(len(self.stack))
        self.stack.append(node)

    def _pop(self, depth: int) -> None:
        for node in reversed(self.stack[depth:]):
            self.open[self.tag[node]].pop()
            if self.tag[node] not in INLINE:
                self.open_blocks.pop()
                self.pieces.append((node, ""))
        del self.stack[depth:]

    def _open_depth(self, tags, limits=()) -> int | None:
        """Depth of the nearest open element of ``tags``, if none of ``limits`` is nearer."""
        depth, limit = (max((self.open[t][-1] for t in some if self.open[t]), default=0) for some in (tags, limits))
        return depth if depth > limit else None

    def _build(self, source: str) -> None:
        self.stack, self.open, self.open_blocks = [0], defaultdict(list), [0]
        at, end = 0, len(source)
        while at < end:
            m = _TOKEN.match(source, at)
            at = m.end()
            if m["text"] is not None:
                self.pieces.append((self.stack[-1], m["text"]))
            elif m["open"] is not None:
                tag = m["open"].lower()
                if tag == "html":
                    continue
                if tag in CLOSES_P and (depth := self._open_depth(("p",), ("table", "td", "th", "button", "caption", "object"))) is not None:
                    self._pop(depth)
                if tag in SIBLINGS and (depth := self._open_depth(*SIBLINGS[tag])) is not None:
                    self._pop(depth)
                if tag == "body" and (depth := self._open_depth(("head",))) is not None:
                    self._pop(depth)
                node = self._add(tag, m["attrs"])
                if tag not in INLINE:
                    self.pieces.append((node, ""))
                elif tag == "br":
                    self.pieces.append((node, " "))
                if tag in RAW:
                    close = _RAW_END[tag].search(source, at)
                    at = close.end() if close else end
                elif tag not in VOID:
                    self._push(node)
            elif m["close"] is not None:
                tag = m["close"].lower()
                depth = self._open_depth((tag,))
                if tag not in ("html", "body") and depth is not None and (tag not in INLINE or depth > self.open_blocks[-1]):
                    self._pop(depth)
        self._pop(1)

    def blocks(self, chosen: set[int], cut: list[bool], own: frozenset | set = frozenset()) -> list[str]:
        """Texts of the blocks under the chosen nodes, less those cut, in page order; of nodes in ``own`` the text beside their blocks."""
        inside = [False] * len(self.tag)
        for node in range(len(self.tag)):
            over = self.parent[node]
            inside[node] = not cut[node] and (node in chosen or (over >= 0 and (inside[over] or (over in own and self.tag[node] in INLINE))))
        out, now = [], []
        for node, text in self.pieces:
            if not text:
                if line := " ".join("".join(now).split()):
                    out.append(line)
                now = []
            elif inside[node] or node in own:
                now.append(entities.unescape(text) if "&" in text else text)
        if line := " ".join("".join(now).split()):
            out.append(line)
        return out

    def content(self) -> tuple[set[int], list[bool], set[int]]:
        """Numbers of the nodes whose subtrees are the main content, which nodes are cut from them, and whose own text is content, too."""
        n = len(self.tag)
        chars, tags, link_chars, link_tags, headings, mains, heading_chars = ([0] * n for _ in range(7))
        in_link, block, alone, alone_links = [False] * n, list(range(n)), [0] * n, [0] * n  # the last two: text beside a block's blocks
        for node in range(1, n):
            in_link[node] = self.tag[node] == "a" or in_link[self.parent[node]]
            if self.tag[node] in INLINE:
                block[node] = block[self.parent[node]]
        for node, text in self.pieces:
            if text and not self.cut[node]:
                size = len("".join(text.split()))
                chars[node] += size
                alone[block[node]] += size
                if in_link[node]:
                    link_chars[node] += size
                    alone_links[block[node]] += size
        for node in range(n - 1, 0, -1):
            if self.cut[node]:
                continue
            over = self.parent[node]
            chars[over] += chars[node]
            link_chars[over] += link_chars[node]
            heading_chars[over] += chars[node] if self.tag[node] in HEADINGS else heading_chars[node]
            tags[over] += tags[node] + 1
            link_tags[over] += link_tags[node] + (self.tag[node] == "a")
            headings[over] += headings[node] + (self.tag[node] == "h1")
            mains[over] += mains[node] + (self.tag[node] == "main")
        body = next((k for k in range(n) if self.tag[k] == "body" and not self.cut[k]), 0)
        share = link_chars[body] / max(1, chars[body])

        def density(k: int) -> float:
            c = chars[k]
            if not c or self.cut[k]:
                return 0.0
            t, lc, lt = max(1, tags[k]), max(1, link_chars[k]), max(1, link_tags[k])
            base = math.log(c / max(1, c - link_chars[k]) * link_chars[k] + share * c + math.e)
            return c / t * math.log(max(1.0, c / lc * t / lt)) / max(0.05, math.log(base))

        def wraps(k: int) -> bool:
            """Whether a block holds so much of the page that it can't lie around the article."""
            return 2 * chars[k] >= chars[body] and ((headings[k] and headings[k] == headings[body]) or mains[k] > 0 or 20 * chars[k] >= 19 * chars[body])

        dense = [density(k) for k in range(n)]
        sums, under, outside = [0.0] * n, [False] * n, [False] * n
        under[body] = True
        for k in range(1, n):
            if self.tag[k] not in INLINE:
                sums[self.parent[k]] += dense[k]
            under[k] |= under[self.parent[k]]
            outside[k] = outside[self.parent[k]] or (self.around[k] and not wraps(k))
        blocks = [k for k in range(n) if under[k] and not self.cut[k] and not outside[k] and self.tag[k] not in INLINE]
        best = max(blocks, key=lambda k: (sums[k], -k), default=body)
        path = [best]
        while path[-1] != body and self.parent[path[-1]] >= 0:
            path.append(self.parent[path[-1]])
        on_path = set(path)
        least = min(dense[k] for k in path)
        chosen = {best} if sums[best] else {body}
        mostly_links = [3 * link_chars[k] >= 2 * chars[k] and link_tags[k] >= 3 and self.tag[k] not in INLINE for k in range(n)]
        ruled = [False] * n  # in an article or main element
        before: dict[int, int] = {}  # the block with text before each, under the same parent
        announced = [False] * n  # a heading stands right before it, or in it
        for k in range(1, n):
            over = self.parent[k]
            ruled[k] = ruled[over] or self.tag[k] in RULED
            if self.tag[k] not in INLINE and chars[k] and not self.cut[k]:
                announced[k] = announced[over] or self.tag[before.get(over, 0)] in HEADINGS
                if self.tag[k] in HEADINGS:
                    announced[over] = True
                before[over] = k
        own: set[int] = set()
        has_title = any(self.tag[k] == "h1" for k in self._under(chosen)) if headings[body] else True
        beside: dict[int, list[int]] = defaultdict(list)
        for k in blocks:
            if k not in on_path and self.parent[k] in on_path and chars[k]:
                beside[self.parent[k]].append(k)
        for over in path[1:]:
            rule = ruled[over] and over != body
            for k in beside[over]:
                if mostly_links[k] and not (announced[k] and over != body):
                    continue
                title = self.tag[k] in HEADINGS or 2 * heading_chars[k] >= chars[k]
                if title and not rule:
                    first = headings[k] > 0 or self.tag[k] == "h1"
                    if has_title if first else over == body:
                        continue
                    has_title |= first
                    chosen.add(k)
                elif rule or (over != body and self.tag[k] in WRITTEN) or (dense[k] >= least and 2 * link_chars[k] < chars[k]):
                    chosen.add(k)
            if over != body and 2 * alone_links[over] < alone[over] and not (self.around[over] and not wraps(over)):
                own.add(over)
        keeps = {k for k in range(n) if mostly_links[k] and (ruled[k] or self.tag[best] != "body") and announced[k]}
        cut = [self.cut[k] or (k not in on_path and ((self.around[k] and not wraps(k)) or (mostly_links[k] and k not in keeps))) for k in range(n)]
        return chosen, cut, own

    def _under(self, chosen: set[int]) -> Iterator[int]:
        inside = [False] * len(self.tag)
        for k in range(len(self.tag)):
            inside[k] = k in chosen or (self.parent[k] >= 0 and inside[self.parent[k]])
            if inside[k]:
                yield k


def main_text(source: str | None) -> str:
    """The article of a page: its blocks, one to a line."""
    if not source:
        return ""
    page = Page(source)
    return "\n".join(page.blocks(*page.content()))


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (its code points)."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sources in batches:
            yield pd.Series([main_text(x) for x in sources], dtype=object)

    return pages.withColumn("text", texts(F.col(html_col))).withColumn("n_chars", F.char_length("text").cast("long"))
