"""Main text of web pages by belief propagation on the DOM tree.

Each element of a page is content or not.  An element's own evidence (its tag, what its class and id say, how
much of its text is linked, how long the text is) gives its node potential, and each parent and child share
an edge potential that depends on the child's kind and on whether the parent is the body.  The potentials are smoothed log frequencies in labelled pages.
The graph is a tree, so one sum-product pass up and one down give exact marginals; text
whose element has a marginal of content over one half is kept.

The labelled pages come from labelled_pages(): random pages of many layouts, in which every element's label is
known because the page is built from labelled parts.

Only scripts, styles, comments, titles, templates and the raw text of `noscript` and `textarea` are left out unread; whether formulas,
pictures' labels, frames and menus of choices are content is for the model to say.

Defined results: null html is empty and gives empty text; markup may be cut off or badly nested: unclosed
elements end with their parents, stray ends are ignored, a tag that never ends is dropped; reading takes time in proportion to
the page, whatever its nesting, and a page of any length is read whole, in the memory that its elements take; repeated rows are
treated alike; a page without content gives the empty string; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title".split())
MATH = "math semantics annotation menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover"
INLINE = frozenset(f"a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tspan tt u var {MATH}".split())
#: An opening tag ends these open elements.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table div section article main aside body".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
#: What words in class, id and role say; first match wins.
_HINTS = [
    ("comment", re.compile(r"comment|disqus|repl(?:y|ies)|discussion|respon[ds]|reader-?(?:voice|letter)|feedback", re.I)),
    ("notice", re.compile(r"cookie|consent|gdpr|notice|notif|alert|banner|popup|modal|overlay|toast|subscri|newsletter|signup|sign-up|paywall|promo", re.I)),
    ("ad", re.compile(r"\bads?\b|\bads?[-_]|[-_]ads?\b|advert|sponsor|dfp|outbrain|taboola|affiliate", re.I)),
    ("nav", re.compile(r"\bnav|[-_]nav|menu|breadcrumb|crumbs|pagination|pager|toc\b|tabs?\b|toolbar", re.I)),
    ("side", re.compile(r"side-?bar|\baside|\brail\b|related|recommend|widget|trending|popular|most-?read|tags?\b|archive", re.I)),
    ("head", re.compile(r"\bheader|masthead|site-?header|page-?header|top-?bar|\blogo|branding", re.I)),
    ("foot", re.compile(r"foot|copyright|legal|colophon|contentinfo|disclaimer", re.I)),
    ("share", re.compile(r"share|social|follow|byline-tools|print|search|login", re.I)),
    ("body", re.compile(r"article|content|post|entry|story|main|body|text|prose", re.I)),
]
_KINDS = {"nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "button": "form", "fieldset": "form", "input": "form", "dialog": "form", "article": "article", "main": "main", "section": "section", "p": "p", "blockquote": "p", "pre": "p", "ul": "list", "ol": "list", "dl": "list", "li": "item", "dt": "item", "dd": "item", "table": "table", "tbody": "table", "thead": "table", "tr": "table", "td": "cell", "th": "cell", "body": "body", "html": "body", "head": "meta", "figure": "figure", "figcaption": "figure", "svg": "figure", "object": "figure", "iframe": "frame", "select": "form", "option": "form", "optgroup": "form", "address": "footer"}


class Node:
    """An element: parent's index, tag, hint, characters of own and of linked text."""

    __slots__ = ("parent", "tag", "hint", "size", "linked")

    def __init__(self, parent: int, tag: str, hint: str):
        self.parent, self.tag, self.hint, self.size, self.linked = parent, tag, hint, 0, 0


class _Open:
    """The elements that are open: blocks, and the inline elements that each block holds.

    Blocks are counted by tag, in all and since the last scope, so that an end without a beginning costs nothing and every other
    step closes what it passes.
    """

    def __init__(self):
        self.blocks: list[tuple[str, int]] = [("html", 0)]  # tag, node
        self.inline: list[list[str]] = [[]]  # of each block, innermost last
        self.held: list[Counter] = [Counter()]  # the same, counted
        self.of_tag: Counter = Counter()
        self.since: list[Counter] = [Counter()]  # of each scope, itself left out
        self.links = 0

    def open(self, tag: str, node: int) -> None:
        self.blocks.append((tag, node))
        self.inline.append([])
        self.held.append(Counter())
        self.of_tag[tag] += 1
        if tag in _SCOPES:
            self.since.append(Counter())
        else:
            self.since[-1][tag] += 1

    def pop(self) -> str:
        """Close the innermost block with all that is open in it."""
        tag, _ = self.blocks.pop()
        self.inline.pop()
        self.links -= self.held.pop()["a"]
        self.of_tag[tag] -= 1
        if tag in _SCOPES:
            self.since.pop()
        else:
            self.since[-1][tag] -= 1
        return tag

    def open_inline(self, tag: str) -> None:
        self.inline[-1].append(tag)
        self.held[-1][tag] += 1
        self.links += tag == "a"

    def close_inline(self, tag: str) -> None:
        """Only an element of the innermost block can end; those inside it end with it."""
        while self.held[-1][tag]:
            inner = self.inline[-1].pop()
            self.held[-1][inner] -= 1
            self.links -= inner == "a"
            if inner == tag:
                break

    def close(self, tag: str) -> bool:
        """End a block: whether there was one."""
        if not self.of_tag[tag]:
            return False
        while self.pop() != tag:
            pass
        return True

    def make_way(self, tag: str) -> None:
        """A new block ends an open paragraph and what its tag ends, as far as the last scope."""
        for ended in ("p", *_ENDS.get(tag, ())):
            while self.since[-1][ended]:
                self.pop()


def parse(page: str) -> tuple[list[Node], list[tuple[int, str, bool]]]:
    """Block elements in page order, each after its parent, and pieces of text (element, raw text, begins a block).

    Inline elements and <br> are not nodes: their text is their block's.
    """
    nodes = [Node(-1, "html", "none")]
    pieces: list[tuple[int, str, bool]] = []
    now = _Open()
    at, fresh, size = 0, True, len(page)
    endless: set[str] = set()  # raw elements whose end does not come any more
    while at < size:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else size
        if stop > at:
            here = now.blocks[-1][1]
            text = page[at:stop]
            if not text.isspace():
                nodes[here].size += len(text)
                if now.links:
                    nodes[here].linked += len(text)
            pieces.append((here, text, fresh))
            fresh = False
        if not m:
            break
        at = m.end()
        slash, tag, attrs = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            if tag in INLINE:
                now.close_inline(tag)
            elif now.close(tag):
                fresh = True
        elif tag == "br":
            pieces.append((now.blocks[-1][1], " ", False))
        elif tag in RAW:
            # Nothing but its end tag ends such an element; without one, a tag written as empty is taken for that.
            end = None if tag in endless else re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if not end:
                endless.add(tag)
            if end or not attrs.endswith("/"):
                at = end.end() if end else size
            fresh = True
        elif tag in VOID:
            fresh = fresh or tag == "hr"
        elif attrs.endswith("/") and tag in INLINE:
            pass
        elif tag in INLINE:
            now.open_inline(tag)
        else:
            fresh = True
            now.make_way(tag)
            said = " ".join("".join(x) for x in _ATTR.findall(attrs)) if attrs else ""
            hint = next((name for name, words in _HINTS if words.search(said)), "other") if said else "none"
            if tag == "body":  # its classes name the site, not a part of the page
                hint = "none"
            nodes.append(Node(now.blocks[-1][1], tag, hint))
            if not (attrs.endswith("/") and tag in ("svg", "object", "iframe")):
                now.open(tag, len(nodes) - 1)
    return nodes, pieces


def kind(node: Node) -> str:
    return _KINDS.get(node.tag, "head" if len(node.tag) == 2 and node.tag[0] == "h" and node.tag[1].isdigit() else "div")


def edge_kind(node: Node, nodes: list[Node]) -> str:
    """The child's kind; apart for children of the body, whose own state says nothing about them."""
    return kind(node) + "^" * (nodes[node.parent].tag in ("body", "html"))


def evidence(node: Node) -> tuple[str, str]:
    """Two discrete observations: what markup says, what the text looks like."""
    size = "0" if not node.size else "s" if node.size < 40 else "m" if node.size < 160 else "l"
    linked = "x" if not node.size else "n" if node.linked * 4 < node.size else "y"
    return f"{kind(node)}/{node.hint}", f"{size}{linked}"


class Model:
    """Log potentials: node[state][observation], edge[child kind][parent state][child state]."""

    def __init__(self, pages: list[tuple[list[Node], list[int]]], smooth: float = 0.3):
        seen = [Counter(), Counter()]
        edges: Counter = Counter()
        words, kinds = set(), set()
        for nodes, labels in pages:
            for n, label in zip(nodes, labels, strict=True):
                for k, e in enumerate(evidence(n)):
                    seen[label][k, e] += 1
                    words.add((k, e))
                if n.parent >= 0:
                    edges[edge_kind(n, nodes), labels[n.parent], label] += 1
                    kinds.add(edge_kind(n, nodes))
        totals = [sum(c for (k, _), c in s.items() if not k) for s in seen]
        # Only kinds of evidence that were seen speak; others are neutral.
        self.node = {w: tuple(math.log((seen[s][w] + smooth) / (totals[s] + smooth * len(words))) for s in (0, 1)) for w in words}
        self.edge = {k: tuple(tuple(math.log((edges[k, p, s] + smooth) / (edges[k, p, 0] + edges[k, p, 1] + 2 * smooth)) for s in (0, 1)) for p in (0, 1)) for k in kinds}
        # A hint speaks for kinds of element that it was not seen with, too.
        hints = [Counter(), Counter()]
        for s in (0, 1):
            for (k, e), c in seen[s].items():
                if not k:
                    hints[s][e.split("/")[1]] += c
        self.hint = {h: tuple(math.log((hints[s][h] + smooth) / (totals[s] + smooth * 9)) for s in (0, 1)) for h in {*hints[0], *hints[1]}}
        self.neutral = ((math.log(0.5),) * 2,) * 2

    def potential(self, node: Node) -> tuple[float, float]:
        first, second = evidence(node)
        a = self.node.get((0, first)) or self.hint.get(node.hint) or (0.0, 0.0)
        b = self.node.get((1, second)) or (0.0, 0.0)
        return a[0] + b[0], a[1] + b[1]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of every node: messages upward in reverse page order, then downward in page order."""
        n = len(nodes)
        own = [self.potential(x) for x in nodes]
        edge = [self.edge.get(edge_kind(x, nodes), self.neutral) for x in nodes]
        low = [list(p) for p in own]  # evidence at and below
        up: list = [None] * n
        for k in range(n - 1, 0, -1):
            e, (x0, x1) = edge[k], low[k]
            up[k] = (_add(e[0][0] + x0, e[0][1] + x1), _add(e[1][0] + x0, e[1][1] + x1))
            above = low[nodes[k].parent]
            above[0] += up[k][0]
            above[1] += up[k][1]
        full = [None] * n
        full[0] = low[0]
        out = [0.0] * n
        for k in range(n):
            if k:
                p = full[nodes[k].parent]
                r0, r1 = p[0] - up[k][0], p[1] - up[k][1]  # all evidence outside this subtree
                e = edge[k]
                full[k] = (low[k][0] + _add(r0 + e[0][0], r1 + e[1][0]), low[k][1] + _add(r0 + e[0][1], r1 + e[1][1]))
            out[k] = 1 / (1 + math.exp(max(-700.0, min(700.0, full[k][0] - full[k][1]))))
        return out


def _add(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def labelled_pages(count: int = 600, seed: int = 3) -> list[tuple[list[Node], list[int]]]:
    """Random pages whose elements' labels are known: content text is upper-case while a page is built and read."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
    out = []
    for _ in range(count):
        one = rng.choice

        def menu() -> str:
            items = "".join(f"<li>{link()}</li>" for _ in range(rng.randint(3, 9)))
            return one([f"<nav><ul>{items}</ul></nav>", f'<div class="menu"><ul>{items}</ul></div>', f'<ul id="navigation">{items}</ul>', f'<nav class="breadcrumb">{link()} {link()}</nav>', f'<div role="navigation">{link()} {link()} {link()}</div>'])

        def clutter() -> str:
            text, long = words(3, 20), words(12, 60)
            # Any block may say what it is in its class or id.
            said = one(["notice", "cookie-banner", "alert", "ad", "ads", "advert", "sponsored", "sidebar", "related-posts", "widget", "comments", "comment-list", "replies", "site-header", "site-footer", "copyright", "share-buttons", "social", "menu", "breadcrumbs", "newsletter", "subscribe", "promo"])
            tag, attr = one(["p", "p", "div", "section", "aside", "ul"]), one(["class", "class", "id"])
            held = f"<li>{text}</li><li>{long}</li>" if tag == "ul" else one([long, long, text]) if tag == "p" else one([f"<p>{long}</p>", f"<p>{long}</p><p>{text}</p>", text, f"<h3>{words(1, 3)}</h3><p>{long}</p>"])
            if rng.random() < 0.4:
                return f'<{tag} {attr}="{said}">{held}</{tag}>'
            return one([
                menu(), f'<div class="ad">{text}</div>', f'<div class="advert"><p>{text}</p></div>', f'<div id="ad-slot"><span>{text}</span></div>', f'<aside class="sidebar"><h3>{words(1, 3)}</h3><p>{long}</p>{link()}</aside>', f"<aside><p>{long}</p></aside>",
                f'<div class="sidebar"><ul><li>{link()}</li><li>{link()}</li></ul><p>{text}</p></div>', f'<div class="cookie-notice"><p>{long}</p><button>{words(1, 2)}</button></div>', f'<div class="notice">{text}</div>', f'<div class="newsletter"><form><label>{text}</label><input><button>{word()}</button></form></div>',
                f"<form><p>{text}</p><input><button>{word()}</button></form>", f'<form action="/search"><label>{words(1, 3)}</label></form>', f'<section class="comments"><h3>{words(1, 2)}</h3><div class="comment"><p>{long}</p></div><div class="comment"><p>{text}</p></div></section>', f'<div id="comments"><ol><li><p>{long}</p></li><li><p>{words(12, 60)}</p></li></ol></div>', f'<div class="comments"><article class="comment"><p>{long}</p></article><article class="comment"><p>{text}</p></article></div>',
                f'<div class="related"><h3>{words(1, 2)}</h3><ul><li>{link()}</li><li>{link()}</li></ul></div>', f'<div class="share">{link()} {link()}</div>', f'<div class="promo"><p>{long}</p></div>', f'<div class="banner"><p>{long}</p></div>', f'<dialog><p>{text}</p></dialog>',
                f'<iframe src="/{word()}">{text}</iframe>', f'<div class="ad"><iframe>{words(1, 4)}</iframe></div>', f"<form><label>{words(1, 3)}</label><select><option>{word()}</option><option>{words(1, 3)}</option></select></form>", f"<select><option>{words(1, 2)}</option><option>{word()}</option></select>",
            ])

        def block() -> str:
            w = words(4, 90).upper()
            return one([f"<p>{w}</p>"] * 8 + [f"<p>{w[: len(w) // 2]}<a href='/x'>{words(1, 3).upper()}</a>{w[len(w) // 2 :]}</p>", f"<h2>{words(2, 6).upper()}</h2>", *[f"<{(tag := one(['ul', 'ul', 'ol']))}>" + "".join(f"<li>{words(2, 20).upper()}</li>" for _ in range(rng.randint(2, 6))) + f"</{tag}>"] * 3, f"<blockquote><p>{w}</p></blockquote>", f"<blockquote>{w}</blockquote>", f"<pre>{w}</pre>", f"<table><tr><td>{words(1, 4).upper()}</td><td>{words(1, 9).upper()}</td></tr></table>", f"<div>{w}</div>", f"<figure><figcaption>{words(3, 9).upper()}</figcaption></figure>", f"<section><h3>{words(1, 5).upper()}</h3><p>{w}</p></section>", f"<p>{w} <math><mi>{word().upper()}</mi><mo>=</mo><mn>{word().upper()}</mn></math></p>", f"<figure><svg><text>{words(1, 3).upper()}</text></svg><figcaption>{words(3, 9).upper()}</figcaption></figure>", f"<object><p>{w}</p></object>"])

        body = [f"<h1>{words(3, 9).upper()}</h1>"] * rng.randint(0, 1) + [block() for _ in range(rng.randint(1, 14))]
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            body.insert(rng.randint(0, len(body)), clutter())
        inner = "".join(body)
        article = one([f"<article>{inner}</article>"] * 4 + [f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", f'<div class="content">{inner}</div>', f'<div id="main"><div class="post-body">{inner}</div></div>', f'<div class="article">{inner}</div>', f"<div>{inner}</div>", f'<section class="story">{inner}</section>', inner])
        head = one([f"<header>{words(1, 4)}{menu()}</header>", f'<div class="header"><h1>{words(1, 4)}</h1></div>', f'<header class="site-header"><h1>{link()}</h1><p>{words(2, 9)}</p></header>', menu(), menu(), ""])
        foot = one([f"<footer>{words(3, 15)}</footer>", f"<footer><p>{words(3, 15)}</p>{link()}</footer>", f'<div class="footer"><p>{words(3, 15)}</p></div>', f'<div id="footer">{words(3, 15)}</div>', ""])
        page = f"<html><head><title>{words(1, 5)}</title></head><body>{head}{''.join(clutter() for _ in range(rng.randint(0, 3)))}{article}{''.join(clutter() for _ in range(rng.randint(0, 3)))}{foot}</body></html>"
        nodes, pieces = parse(page)
        shown = [Counter() for _ in nodes]
        for at, text, _ in pieces:
            if text.strip():
                shown[at][text.strip().isupper()] += 1
        labels = [int(c[True] > 0) for c in shown]
        for k in range(len(nodes) - 1, 0, -1):
            # A wrapper of content is content, unless text of its own isn't.
            parent = nodes[k].parent
            if labels[k] and parent and nodes[parent].tag not in ("body", "html") and not shown[parent][False]:
                labels[parent] = 1
        out.append((nodes, labels))
    return out


def extract(page: str | None, model: Model, threshold: float = 0.5) -> str:
    """The main text of one page."""
    nodes, pieces = parse(page or "")
    content = [m > threshold for m in model.marginals(nodes)]
    blocks: list[str] = []
    here: list[str] = []
    for at, text, fresh in pieces:
        if fresh and here:
            blocks.append("".join(here))
            here = []
        if content[at]:
            here.append(text)
    blocks.append("".join(here))
    clean = (_SPACE.sub(" ", entities.unescape(b)).strip() for b in blocks)
    return " ".join(b for b in clean if b)


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""
    bounded_batches(pages.sparkSession)
    model = Model(labelled_pages())

    def run(batches):
        for b in batches:
            found = [extract(x, model) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
