"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded down the tree.

A tolerant parser builds the element tree of a whole page. For each element that holds text, features of its subtree (text,
links, tags and their densities), its attributes' words, its depth and its siblings go to boosted trees, which give the
probability that it holds article text. Decoding picks the most likely labelling in which no element under a
rejected one is kept, so ancestors and descendants never contradict each other; the text that kept elements own,
in page order, is the result.

The trees are trained in numpy on pages that ``make_pages`` lays out from parameters (containers, menus, adverts, forms,
comments and so on in many arrangements, with invented words), where the label of each element is known. No page of
the input is trained on, so results don't depend on what else a table holds.

Time and memory of a page grow in proportion to its length, whatever its markup.

Defined cases: a null or empty page has empty text; markup cut short anywhere keeps what precedes the cut;
a quote without its match in a tag stands for itself; elements that never show
text (scripts, styles, templates, form controls, head) are left out by the parser; character references are decoded
once; white space inside a block becomes one space, blocks are joined by one space; repeated rows are each extracted;
extra columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches, check_columns, emit, rows

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_SPECIAL = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")
#: Fixed values of HTML: elements without an end, those whose content is no text, inline ones, and which open elements end a paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
SKIPPED = RAW | frozenset("head select option button input object canvas audio video map".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLING_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("ul ol dl table article section div main aside nav header footer body form blockquote".split())
_LINK_SCOPES = SCOPES | {"p", "li", "td"}
#: Words of class and id attributes and roles that sites use for parts of pages.
PARTS = {
    "content": "article content main post entry story body text blog news page prose maincontent articlebody",
    "menu": "nav menu breadcrumb breadcrumbs navbar navigation toc pagination pager tabs topbar",
    "edge": "footer foot header head masthead copyright banner branding site legal contentinfo",
    "side": "sidebar side aside widget rail related recommended popular trending archive tags complementary more",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion commercial adsense banner dfp",
    "notice": "cookie cookies consent notice gdpr alert modal popup newsletter subscribe signup paywall overlay message",
    "form": "form search login register signin input",
    "comment": "comment comments reply replies disqus respond discussion feedback reviews commentlist",
    "share": "share social facebook twitter follow sharing byline meta author date tools print",
}
_PART_OF = {w: k for k, words in enumerate(PARTS.values()) for w in words.split()}
_TAGS = ("article", "main", "section", "div", "p", "nav", "header", "footer", "aside", "form", "ul", "li", "a", "table", "td", "body", "h1", "h2", "h3", "blockquote", "span", "pre", "figure")
_TAG_NUMBER = {t: i for i, t in enumerate(_TAGS)}


class Node:
    __slots__ = ("attributes", "children", "own", "tag", "parent", "number", "label")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node] = []
        self.own: list[tuple[int, str]] = []  # (place in the page, text)
        self.number, self.label = -1, 0


class Markup:
    """Finds the tags of a page, each place looked at a bounded number of times whatever the page."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.dead: set[int] = set()  # quotes from which on no tag's end is found
        self.special = (-1, -1)  # no sign that matters for tags stands between these places
        self.closing = -2  # the next > found, -1 if there is none any more

    def _next_special(self, at: int) -> int:
        if not self.special[0] <= at <= self.special[1]:
            m = _SPECIAL.search(self.page, at)
            self.special = (at, m.start() if m else len(self.page))
        return self.special[1]

    def _next_closing(self, at: int) -> int:
        if self.closing != -1 and self.closing < at:
            self.closing = self.page.find(">", at)
        return self.closing

    def end(self, at: int) -> int:
        """The place of the > that ends a tag: the next outside quotes, or, where quotes don't match, the next at all; -1 for none."""
        start, seen, page = at, [], self.page
        while True:
            x = self._next_special(at)
            if x == len(page) or x in self.dead:
                break
            if page[x] == ">":
                return x
            seen.append(x)
            close = page.find(page[x], x + 1)
            at = x + 1 if close < 0 else close + 1  # a quote that never closes stands for itself
        self.dead.update(seen)
        return self._next_closing(start)

    def tags(self) -> Iterator[tuple[str, bool, str, str, int]]:
        """(text before, whether an end tag, name, attributes, end) of each tag in turn; comments and declarations have an empty name.

        The caller may send() a place to go on from. Markup that the page's end cuts short goes.
        """
        page, at = self.page, 0
        text_from = 0
        while True:
            x = page.find("<", at)
            if x < 0:
                yield page[text_from:], False, "", "", len(page)
                return
            after = page[x + 1 : x + 2]
            closes = after == "/"
            name = _NAME.match(page, x + 1 + closes)
            if name is None and after not in ("!", "?", "/"):
                at = x + 1  # a plain sign
                continue
            if page.startswith("<!--", x):
                found = page.find("-->", x + 4)
                end = len(page) if found < 0 else found + 3
            else:
                found = self.end(name.end()) if name else self._next_closing(x + 1)
                end = len(page) if found < 0 else found + 1
            attributes = page[name.end() : end - 1] if name and found >= 0 else ""
            moved = yield page[text_from:x], closes, name[0].lower() if name and found >= 0 else "", attributes, end
            at = text_from = end if moved is None else moved
            if moved is not None:
                yield "", False, "", "", at  # what send() returns


def parse(page: str | None) -> Node:
    """The element tree of a page; inline elements don't become nodes of their own except links."""
    root = node = Node("body", {}, None)
    page, place = page or "", 0
    skipping: list[str] = []
    around: list[Node] = []  # the elements around the place, outermost first, without the root
    depths: defaultdict[str, list[int]] = defaultdict(list)  # at which places of around a tag's elements are

    def add(text: str) -> None:
        nonlocal place
        if text and not skipping:
            node.own.append((place, html.unescape(text)))
            place += 1

    def leave(depth: int) -> None:
        """Out of all elements from that place of around on."""
        nonlocal node
        for x in around[depth:]:
            depths[x.tag].pop()
        del around[depth:]
        node = around[-1] if around else root

    def innermost(tags: Iterable[str]) -> int:
        return max((depths[t][-1] for t in tags if depths[t]), default=-1)

    def up_to(tags: Iterable[str], stop: Iterable[str]) -> None:
        depth = innermost(tags)
        if depth >= 0 and depth >= innermost(stop):
            leave(depth)

    found = Markup(page).tags()
    for text, closes, tag, attributes, at in found:
        add(text)
        if not tag:
            continue
        if closes:
            if skipping:
                if tag in skipping:
                    del skipping[skipping.index(tag) :]
                continue
            if tag == "br":
                add(" ")
            elif (tag == "a" or tag not in INLINE) and depths[tag]:
                leave(depths[tag][-1])
            continue
        if skipping:
            if tag in SKIPPED and tag not in VOID and tag not in skipping:
                skipping.append(tag)
            elif tag == "body":
                skipping.clear()
            continue
        if tag in RAW:
            if tag in ("noscript", "template", "svg", "math"):
                skipping.append(tag)
            else:
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                at = page.find(">", end.start()) + 1 if end else 0
                found.send(at or len(page))
            continue
        if tag in SKIPPED and tag not in VOID:
            if tag not in skipping:
                skipping.append(tag)
            continue
        if tag in ("br", "hr", "wbr", "img"):
            add("" if tag == "wbr" else " ")
            continue
        if tag in VOID:
            continue
        if tag in ("html", "body"):
            if tag == "body":
                root.attributes |= _attributes(attributes)
            continue
        if tag in INLINE and tag != "a":
            continue
        if tag in CLOSES_P:
            up_to(("p",), SCOPES)
        if tag in SIBLING_ENDS:
            up_to(SIBLING_ENDS[tag], SCOPES)
        if tag == "a":
            up_to(("a",), _LINK_SCOPES)
        child = Node(tag, _attributes(attributes), node)
        node.own.append((place, child))
        place += 1
        node.children.append(child)
        if not attributes.endswith("/"):
            depths[tag].append(len(around))
            around.append(child)
            node = child
    return root


def _attributes(given: str) -> dict[str, str]:
    if not given or "=" not in given and "hidden" not in given:
        return {}
    out = {}
    for name, a, b, c in _ATTRIBUTE.findall(given):
        if name.lower() in ("class", "id", "role", "style", "hidden", "aria-hidden", "itemprop"):
            out.setdefault(name.lower(), a or b or c)
    return out


def _part_words(node: Node) -> list[int]:
    words = " ".join(node.attributes.get(n, "") for n in ("class", "id", "role", "itemprop"))
    return [_PART_OF[w] for w in (x.lower() for x in _PART.findall(words)) if w in _PART_OF] if words.strip() else []


def flat(root: Node) -> list[Node]:
    """All elements in page order, numbered, parents before their children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        node.number = len(out)
        out.append(node)
        stack.extend(reversed(node.children))
    return out


N_FEATURES = 22 + len(PARTS) * 2


def features(nodes: list[Node]) -> np.ndarray:
    """A row per element: tag, depth, subtree and sibling statistics, attribute words of its own and of its ancestors."""
    n = len(nodes)
    x = np.zeros((n, N_FEATURES), np.float32)
    size, links, tags, paragraphs, commas, depth = (np.zeros(n) for _ in range(6))
    own_size = np.zeros(n)
    for i, node in enumerate(nodes):
        text = "".join(t for _, t in node.own if isinstance(t, str))
        own_size[i] = size[i] = len(" ".join(text.split()))
        commas[i] = text.count(",") + text.count(".")
        tags[i] = 1
        paragraphs[i] = node.tag == "p" and size[i] > 20
        links[i] = size[i] if node.tag == "a" else 0
        if node.parent is not None:
            depth[i] = depth[node.parent.number] + 1
    inner = tags.copy()
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent.number
        if nodes[i].tag == "a":
            links[i] = size[i]
        for a in (size, links, inner, paragraphs, commas):
            a[p] += a[i]
    total = max(size[0], 1)
    near = 22 + len(PARTS)
    place = {id(m): k for node in nodes for k, m in enumerate(node.children)}
    kinds = [Counter(m.tag for m in node.children) for node in nodes]
    for i, node in enumerate(nodes):
        p = node.parent.number if node.parent is not None else 0
        mates = node.parent.children if node.parent is not None else [node]
        alike = kinds[p][node.tag] if node.parent is not None else 1
        at = place.get(id(node), 0)
        style = node.attributes.get("style", "").replace(" ", "").lower()
        hidden = "hidden" in node.attributes or node.attributes.get("aria-hidden") == "true" or "display:none" in style
        s = size[i]
        x[i, :22] = (
            _TAG_NUMBER.get(node.tag, -1), depth[i], math.log1p(s), links[i] / s if s else 0, inner[i] / (s + 1) * 100, paragraphs[i], commas[i] / (s + 1) * 100,
            math.log1p(own_size[i]), s / total, len(node.children), at / len(mates), len(mates), alike, s / max(size[p], 1), paragraphs[p], links[p] / max(size[p], 1),
            _TAG_NUMBER.get(node.parent.tag, -1) if node.parent is not None else -2, math.log1p(size[p]), hidden, math.log1p(inner[i]), own_size[i] / (s + 1), i / n,
        )
        if node.parent is not None:
            x[i, near:] = np.maximum(x[p, near:], x[p, 22:near])
            t = nodes[p].tag
            for tag, k in (("nav", 1), ("header", 2), ("footer", 2), ("aside", 3), ("form", 6), ("article", 0), ("main", 0)):
                if t == tag:
                    x[i, near + k] = 1
        for k in _part_words(node):
            x[i, 22 + k] += 1
    return x


@dataclass
class Trees:
    """Boosted regression trees of fixed depth: at each inner node a feature and a cut, at each leaf a value."""

    feature: np.ndarray  # trees, 2^depth - 1
    cut: np.ndarray
    leaf: np.ndarray  # trees, 2^depth
    base: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        out, every = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[every, f[at]] > c[at])
            out += v[at - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss with histogram splits."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    share = min(max(y.mean(), 1e-4), 1 - 1e-4)
    base = math.log(share / (1 - share))
    logit = np.full(len(y), base)
    feature, cut, leaf = np.zeros((trees, 2**depth - 1), np.int64), np.zeros((trees, 2**depth - 1)), np.zeros((trees, 2**depth))
    for t in range(trees):
        p = 1 / (1 + np.exp(-logit))
        g, h = p - y, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for node in range(2**depth - 1):
            here = np.flatnonzero(at == node)
            best, choice = 1e-6, (0, math.inf)
            if len(here) > 1:
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[here, j]
                    gs, hs = np.bincount(b, g[here], len(c) + 1).cumsum(), np.bincount(b, h[here], len(c) + 1).cumsum()
                    gain = gs**2 / (hs + ridge) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + ridge) - gs[-1] ** 2 / (hs[-1] + ridge)
                    k = int(gain[:-1].argmax())
                    if gain[k] > best:
                        best, choice = gain[k], (j, c[k])
            feature[t, node], cut[t, node] = choice
            right = x[here, choice[0]] > choice[1]
            at[here] = 2 * node + 1 + right
        slot = at - (2**depth - 1)
        leaf[t] = -rate * np.bincount(slot, g, 2**depth) / (np.bincount(slot, h, 2**depth) + ridge)
        logit += leaf[t][slot]
    return Trees(feature, cut, leaf, base)


def decode(nodes: list[Node], logits: np.ndarray) -> np.ndarray:
    """The likeliest labels in which nothing under a rejected element is kept."""
    keep = -np.logaddexp(0, -logits)
    drop = -np.logaddexp(0, logits)
    below_drop, best_keep = drop.copy(), keep.copy()
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent.number
        below_drop[p] += below_drop[i]
        best_keep[p] += max(best_keep[i], below_drop[i])
    out = np.zeros(len(nodes), bool)
    for i, node in enumerate(nodes):
        out[i] = (i == 0 or out[node.parent.number]) and best_keep[i] > below_drop[i]
    return out


def text_of(nodes: list[Node], kept: np.ndarray) -> str:
    """The kept elements' text: white space collapsed, blocks joined by one space, links within their block."""
    pieces: list[str] = []

    def walk(root: Node) -> None:
        stack: list[tuple[Node, Iterator]] = [(root, iter(root.own))]
        while stack:
            node, own = stack[-1]
            step = next(own, None)
            if step is None:
                stack.pop()
                if node.tag != "a":
                    pieces.append(" ")
            elif isinstance(step[1], str):
                pieces.append(step[1])
            elif kept[step[1].number]:
                if step[1].tag != "a":
                    pieces.append(" ")
                stack.append((step[1], iter(step[1].own)))
            elif step[1].tag != "a":
                pieces.append(" ")

    if len(nodes) and kept[0]:
        walk(nodes[0])
    return " ".join("".join(pieces).split())


# Training pages -------------------------------------------------------------------------------------------------------


def make_pages(n: int = 500, seed: int = 11) -> list[Node]:
    """Trees of laid out pages; each element's label says whether article text is in it."""
    return [_layout(random.Random(seed * 100_003 + k)) for k in range(n)]


def _layout(r: random.Random) -> Node:
    def words(low: int, high: int) -> str:
        out = []
        for _ in range(r.randint(low, high)):
            out.append("".join(r.choice("abcdefghijklmnoprstuv") for _ in range(r.randint(1, 11))) + r.choice(["", "", "", "", ",", ".", ". "]))
        return " ".join(out).capitalize()

    def put(parent: Node, tag: str, name: str = "", text: str = "", label: int = 0) -> Node:
        attributes = {r.choice(["class", "class", "id"]): name} if name and r.random() < 0.85 else {}
        child = Node(tag, attributes, parent)
        parent.own.append((len(parent.own), child))
        parent.children.append(child)
        if text:
            child.own.append((0, text))
        child.label = label
        x = parent
        while label and x is not None:
            x.label, x = 1, x.parent
        return child

    def linked(parent: Node, low: int = 3, high: int = 14) -> None:
        ul = put(parent, r.choice(["ul", "ul", "ol", "div"]))
        for _ in range(r.randint(low, high)):
            put(put(ul, "li") if r.random() < 0.8 else ul, "a", "", words(1, 3 if r.random() < 0.7 else 9))

    def name(kind: str) -> str:
        word = r.choice(PARTS[kind].split())
        return r.choice([word, f"{word}-{r.choice(['box', 'wrap', 'area', 'list'])}", f"site-{word}", f"c{r.randint(1, 99)}"] + [word] * 3)

    def clutter(parent: Node, where: str) -> None:
        kind = r.choice({"top": ["menu", "menu", "edge", "notice", "advert", "advert", "form", "share"], "in": ["advert", "share", "side", "notice"], "end": ["edge", "edge", "comment", "side", "menu", "advert", "form", "notice"]}[where])
        if kind == "menu":
            linked(put(parent, r.choice(["nav", "nav", "div"]), name("menu")))
        elif kind == "edge":
            box = put(parent, "header" if where == "top" else r.choice(["footer", "footer", "div"]), name("edge"))
            if r.random() < 0.5:
                linked(box, 1, 6)
            if r.random() < 0.7:
                (put(box, "p", "", words(4, 25)) if r.random() < 0.5 else box).own.append((9, words(3, 20)))
        elif kind == "side":
            box = put(parent, r.choice(["aside", "div", "section"]), name("side"))
            put(box, r.choice(["h2", "h3", "div"]), "", words(1, 4))
            if r.random() < 0.7:
                linked(box)
            else:
                put(box, "p", "", words(5, 40))
        elif kind == "advert":
            box = put(parent, r.choice(["div", "div", "aside", "section"]), name("advert"), words(3, 30))
            if r.random() < 0.4:
                put(box, "a", "", words(2, 6))
        elif kind == "notice":
            box = put(parent, r.choice(["div", "section", "aside"]), name("notice"), words(4, 30) if r.random() < 0.5 else "")
            put(box, r.choice(["p", "span", "div"]), "", words(6, 40))
        elif kind == "form":
            box = put(parent, "form", name("form"))
            put(box, r.choice(["p", "div", "label"]), "", words(1, 12))
        elif kind == "comment":
            box = put(parent, r.choice(["div", "section", "ul", "ol"]), name("comment"))
            for _ in range(r.randint(1, 8)):
                one = put(box, r.choice(["div", "li", "article"]), name("comment"))
                put(one, r.choice(["span", "a", "div"]), name("share"), words(1, 3))
                put(one, "p", "", words(4, 90))
        else:
            box = put(parent, r.choice(["div", "p", "ul"]), name("share"))
            for _ in range(r.randint(1, 5)):
                put(box, r.choice(["a", "span"]), "", words(1, 3))

    def paragraph(box: Node) -> None:
        tag = r.choice(["p"] * 12 + ["h2", "h3", "blockquote", "pre", "ul", "div", "td"])
        if tag == "ul":
            ul = put(box, "ul")
            for _ in range(r.randint(2, 6)):
                put(ul, "li", "", words(2, 25), 1)
        elif tag in ("h2", "h3"):
            put(box, tag, "", words(2, 8), 1)
        elif tag == "blockquote":
            put(put(box, tag), "p", "", words(5, 60), 1)
        elif tag == "td":
            put(put(put(box, "table"), "tr"), "td", "", words(3, 30), 1)
        else:
            p = put(box, tag, "", words(*r.choice([(1, 6), (5, 40), (20, 120), (60, 220)])), 1)
            if r.random() < 0.2:
                put(p, "a", "", words(1, 5), 1)

    root = Node("body", {}, None)
    top = root
    for _ in range(r.choice([0, 0, 1, 2])):
        top = put(top, "div", r.choice(["wrapper", "page", "container", "site", "layout", ""]))
    for _ in range(r.randint(0, 4)):
        clutter(top, "top")
    outer = top
    if r.random() < 0.4:
        outer = put(top, r.choice(["div", "main", "section"]), r.choice(["row", "wrapper", name("content")]))
    if r.random() < 0.25:
        clutter(outer, "top")
    body = outer
    if r.random() < 0.95:
        body = put(outer, r.choice(["article", "article", "article", "main", "div", "div", "section"]), name("content") if r.random() < 0.6 else "")
    if r.random() < 0.97:
        if r.random() < 0.85:
            h = put(body, "header") if r.random() < 0.15 else body
            put(h, r.choice(["h1", "h1", "h2"]), "", words(2, 14), 1)
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
            paragraph(body)
            if r.random() < 0.08:
                clutter(body, "in")
        if r.random() < 0.15:  # an article's own footer
            foot = put(body, "footer", name("share") if r.random() < 0.5 else "", words(1, 12))
            if r.random() < 0.5:
                put(foot, r.choice(["a", "p", "span"]), "", words(1, 8))
    for _ in range(r.randint(0, 2)):
        clutter(outer, "end")
    for _ in range(r.randint(0, 4)):
        clutter(top, "end")
    return root


@cache
def trained(pages: int = 400, seed: int = 11) -> Trees:
    x, y = [], []
    for root in make_pages(pages, seed):
        nodes = flat(root)
        x.append(features(nodes))
        y.append(np.array([n.label for n in nodes], float))
    return boost(np.concatenate(x), np.concatenate(y))


def main_text(page: str | None, trees: Trees) -> str:
    return next(main_texts([page], trees))


def main_texts(pages: list[str | None], trees: Trees) -> Iterator[str]:
    every = [flat(parse(p)) for p in pages]
    logits = trees.logits(np.concatenate([features(n) for n in every]))
    at = 0
    for nodes in every:
        yield text_of(nodes, decode(nodes, logits[at : at + len(nodes)]))
        at += len(nodes)


def extract(pages: DataFrame, page: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    check_columns(pages, page, page_id, url)
    bounded_batches(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(trained())
    schema = pa.schema([("__id", pa.int64()), ("__url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = list(rows(iter([batch]), "__id", "__url", "__page"))
            texts: list[str] = []
            for at in range(0, len(given), 50):
                texts += main_texts([g[2] for g in given[at : at + 50]], sent.value)
            yield emit({"__id": [g[0] for g in given], "__url": [g[1] for g in given], "text": texts}, schema)

    taken = pages.select(F.col(page_id).cast("long").alias("__id"), F.col(url).cast("string").alias("__url"), F.col(page).cast("string").alias("__page"))
    out = taken.mapInArrow(run, "__id long, __url string, text string")
    return out.select(F.col("__id").alias(page_id), F.col("__url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))
