"""Main text of web pages: boosted trees over DOM nodes, decoded along the hierarchy.

A page becomes a tree of block-level nodes. Features of a node are its subtree's
text density and links, its attribute tokens, its depth, its ancestors and how
it compares with its siblings. Gradient-boosted trees, grown here in numpy on
pages that a generator lays out and labels, give each node log-odds of belonging
to the main text. Decoding keeps the connected part of the tree, from the root
down, with the highest sum of log-odds, so a kept node never has a dropped
ancestor. The text of kept nodes, block by block, is the result.

Pages are independent rows: one pass, no shuffle; features, trees and decoding
work on whole Arrow batches at a time.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

# fixed values: element groups of the HTML standard
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
RAW = set("script style title textarea noscript template iframe svg math canvas object audio video".split())
VOID_BREAKS = {"br", "hr", "wbr", "img"}
#: An opening tag closes an open element of these, up to the nearest of the others.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# fixed values: tokens of class, id and role that name a part of a page
TOKENS = {
    "content": "article articlebody body content entry main post story text prose blog hentry paragraph",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs pagination pager tabs toc toolbar topbar",
    "frame": "header masthead footer foot bottom colophon copyright legal logo brand credits",
    "aside": "aside sidebar side widget widgets rail related recommended popular trending more teaser complementary tags",
    "advert": "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion dfp adsense",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay disclaimer warning paywall announcement toast",
    "form": "form login signin signup register search subscribe subscription newsletter contact input captcha poll",
    "comment": "comment comments commentlist reply replies respond discussion disqus thread feedback reviews",
    "share": "share sharing social follow facebook twitter like likes rating toolbox print",
}
GROUPS = tuple(TOKENS)
_BIT = {word: 1 << i for i, words in enumerate(TOKENS.values()) for word in words.split()}
TAG_KINDS = (
    {"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"li", "dd", "dt"}, {"ul", "ol", "dl", "menu"}, {"div", "center"}, {"article", "main"}, {"section"},
    {"nav"}, {"aside"}, {"header"}, {"footer"}, {"form", "fieldset", "search", "legend"}, {"button", "select", "option"},
    {"table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"blockquote", "pre", "figure", "figcaption"}, {"html", "body"},
)
_KIND = {tag: k for k, tags in enumerate(TAG_KINDS) for tag in tags}
#: Groups whose tag says what their whole subtree is.
_ANCESTOR_KINDS = (5, 7, 8, 9, 10, 11)

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>?|<[!?/][^>]*>?""", re.S)
_RAW_END = {tag: re.compile(rf"</{tag}(?![^\s/>])", re.I) for tag in RAW}
_NAMED = re.compile(r"""(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """Nodes of one page in document order, and its text as segments (node, text)."""

    __slots__ = ("parent", "depth", "kind", "bits", "order", "text", "linked", "stops", "segments")

    def __init__(self) -> None:
        self.parent, self.depth, self.kind, self.bits, self.order = [0], [0], [15], [0], [0]
        self.text, self.linked, self.stops = [0], [0], [0]
        self.segments: list[tuple[int, str]] = []


def _attribute_bits(attributes: str) -> int:
    bits = 0
    for found in _NAMED.finditer(attributes):
        for token in _TOKEN.findall(found[1] or found[2] or found[3] or ""):
            bits |= _BIT.get(token.lower(), 0)
    return bits


def parse(html: str) -> Page:
    page = Page()
    stack: list[tuple[str, int]] = [("#root", 0)]  # open block elements: tag, node
    children = [0]
    pieces: list[str] = []
    link: int | None = None  # the node inside which a link is open
    at = 0

    def add_text(s: str) -> None:
        if not s or s.isspace():
            if s:
                pieces.append(" ")
            return
        if "&" in s:
            s = unescape(s)
        pieces.append(s)
        if link is not None:
            page.linked[stack[-1][1]] += len(s)

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                node = stack[-1][1]
                page.segments.append((node, text))
                page.text[node] += len(text)
                page.stops[node] += text.count(". ") + text.count(", ") + (text[-1] in ".!?")

    def pop_to(level: int) -> None:
        nonlocal link
        flush()
        del stack[level:]
        if link is not None and link > stack[-1][1]:
            link = None

    # a search from each place on, as what stands in a raw element is no markup
    while m := _MARKUP.search(html, at):
        add_text(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not m[1] and not m[3].endswith("/"):
                end = _RAW_END[tag].search(html, at)
                at = end.start() if end else len(html)
            continue
        if tag == "a":
            link = None if m[1] else stack[-1][1]
            continue
        if tag not in BLOCKS:
            if tag in VOID_BREAKS:
                pieces.append(" ")
            if tag == "hr":
                flush()
            continue
        if m[1]:
            for level in range(len(stack) - 1, 0, -1):
                if stack[level][0] == tag:
                    pop_to(level)
                    break
            else:
                flush()
            continue
        flush()
        if stack[-1][0] == "p":
            pop_to(len(stack) - 1)
        if tag in CLOSES:
            own, scope = CLOSES[tag]
            for level in range(len(stack) - 1, 0, -1):
                if stack[level][0] in own:
                    pop_to(level)
                    break
                if stack[level][0] in scope:
                    break
        up = stack[-1][1]
        node = len(page.parent)
        page.parent.append(up)
        page.depth.append(len(stack))
        page.kind.append(_KIND.get(tag, 4))
        page.bits.append(_attribute_bits(m[3]) if m[3] else 0)
        page.order.append(children[up])
        children[up] += 1
        children.append(0)
        page.text.append(0)
        page.linked.append(0)
        page.stops.append(0)
        stack.append((tag, node))
    if at < len(html):
        add_text(html[at:])
    flush()
    return page


class Forest:
    """Nodes of many pages as one table."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.parent) for p in pages], np.int64)
        self.start = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        flat = lambda name: np.concatenate([np.array(getattr(p, name), np.int64) for p in pages])
        self.page = np.repeat(np.arange(len(pages)), sizes)
        self.parent = flat("parent") + self.start[self.page]
        self.depth, self.kind, self.bits, self.order = (flat(n) for n in ("depth", "kind", "bits", "order"))
        self.text, self.linked, self.stops = (flat(n).astype(float) for n in ("text", "linked", "stops"))
        self.levels = [np.flatnonzero(self.depth == d) for d in range(self.depth.max(initial=0) + 1)]

    def upward(self, own: np.ndarray) -> np.ndarray:
        """Sums over subtrees."""
        total = own.astype(float)
        for nodes in reversed(self.levels[1:]):
            np.add.at(total, self.parent[nodes], total[nodes])
        return total

    def features(self) -> np.ndarray:
        n = len(self.parent)
        text, linked, stops, nodes = (self.upward(x) for x in (self.text, self.linked, self.stops, np.ones(n)))
        own = (self.kind[:, None] == np.arange(len(TAG_KINDS))).astype(float)
        named = ((self.bits[:, None] >> np.arange(len(GROUPS))) & 1).astype(float)
        flags = np.concatenate([named, own[:, _ANCESTOR_KINDS]], axis=1)
        above = np.zeros_like(flags)
        for level in self.levels[1:]:
            up = self.parent[level]
            above[level] = np.maximum(above[up], flags[up])
        inner = self.depth > 0
        siblings = np.bincount(self.parent[inner], minlength=n)
        alike = np.unique(np.stack([self.parent, self.kind]), axis=1, return_inverse=True, return_counts=True)
        same = alike[2][alike[1].ravel()]
        of_parent = np.maximum(siblings[self.parent], 1)
        sibling_text = np.bincount(self.parent[inner], text[inner], minlength=n)
        density = np.log1p(text) - np.log1p(nodes - 1)
        density_around = np.bincount(self.parent[inner], density[inner], minlength=n)[self.parent] / of_parent
        whole = np.maximum(text[self.start][self.page], 1)
        columns = [
            np.log1p(text), np.log1p(self.text), linked / np.maximum(text, 1), stops / np.maximum(text / 100, 1), np.log1p(nodes), density, density - density_around,
            self.depth, self.order, self.order / of_parent, of_parent, same / of_parent, text / np.maximum(sibling_text[self.parent], 1), text / whole,
            self.kind[self.parent],
        ]
        return np.concatenate([np.stack(columns, axis=1), own, named, above], axis=1)

    def decode(self, odds: np.ndarray) -> np.ndarray:
        """Which nodes are kept: the best connected part below the roots."""
        gain = odds.copy()
        for nodes in reversed(self.levels[1:]):
            np.add.at(gain, self.parent[nodes], np.maximum(gain[nodes], 0))
        kept = np.zeros(len(odds), bool)
        kept[self.levels[0]] = True
        for nodes in self.levels[1:]:
            kept[nodes] = kept[self.parent[nodes]] & (gain[nodes] > 0)
        return kept


TREES, TREE_DEPTH, SHRINK, BINS, RIDGE = 60, 4, 0.2, 32, 1.0


class Boosted:
    """Gradient-boosted trees for log-odds; every tree is complete to TREE_DEPTH."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
        share = y.mean()
        self.bias = float(np.log(share / (1 - share)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        odds = np.full(len(y), self.bias)
        inner = 2**TREE_DEPTH - 1
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-odds))
            g, h = y - p, p * (1 - p)
            feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
            at = np.zeros(len(y), np.int64)
            for level in range(TREE_DEPTH):
                first = 2**level - 1
                for node in range(first, 2 * first + 1):
                    rows = np.flatnonzero(at == node)
                    if len(rows) > 8:
                        feature[node], limit[node] = self._split(binned[rows], g[rows], h[rows], edges)
                at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > limit[at])
            leaf = at - inner
            top, under = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
            value = SHRINK * top / (under + RIDGE)
            odds = odds + value[leaf]
            self.trees.append((feature, limit, value))

    @staticmethod
    def _split(binned: np.ndarray, g: np.ndarray, h: np.ndarray, edges: list[np.ndarray]) -> tuple[int, float]:
        best, found = 1e-6, (0, np.inf)
        whole = g.sum() ** 2 / (h.sum() + RIDGE)
        for f, e in enumerate(edges):
            if not len(e):
                continue
            gl, hl = (np.cumsum(np.bincount(binned[:, f], v, len(e) + 1))[:-1] for v in (g, h))
            gain = gl**2 / (hl + RIDGE) + (g.sum() - gl) ** 2 / (h.sum() - hl + RIDGE) - whole
            k = int(gain.argmax())
            if gain[k] > best:
                best, found = gain[k], (f, float(e[k]))
        return found

    def odds(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.bias), np.arange(len(x))
        for feature, limit, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(TREE_DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
            total += value[at - len(feature)]
        return total


# The generator of labelled pages. A label is written into the page as an
# attribute that parse() does not read: data-keep="1" or "0".
TRAINING_PAGES, TRAINING_SEED = 500, 7
_SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi zo an el is or un th sch ion que ado".split()


class _Author:
    def __init__(self, rng: random.Random):
        self.rng = rng

    def words(self, low: int, high: int) -> str:
        r = self.rng
        return " ".join("".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(low, high)))

    def prose(self, low: int = 8, high: int = 90) -> str:
        r = self.rng
        style = r.random()
        said = ". ".join(self.words(4, 14).capitalize() for _ in range(max(1, r.randint(low, high) // 9))) + r.choice([".", ".", "", "!", " &amp; co."])
        return said.upper() if style < 0.06 else said.replace(" ", " | ") if style < 0.1 else said.replace(" ", r.choice(["%%% ", "*** ", "!! "])) if style < 0.16 else said

    def tag(self, tag: str, inner: str, keep: int, name: str = "") -> str:
        r = self.rng
        named = f' {r.choice(["class", "id", "class"])}="{name}"' if name else ""
        return f'<{tag}{named} data-keep="{keep}">{inner}' + ("" if tag in ("p", "li") and r.random() < 0.15 else f"</{tag}>")

    def links(self, keep: int, low: int = 2, high: int = 9) -> str:
        r = self.rng
        return self.tag("ul", "".join(self.tag("li", f'<a href="/{self.words(1, 1)}">{self.words(1, 3)}</a>', keep) for _ in range(r.randint(low, high))), keep)

    def name(self, *groups: str) -> str:
        """Attribute tokens of a group, now and then none or neutral ones."""
        r = self.rng
        if r.random() < 0.2:
            return r.choice(["", "box", "block-7", "c12", "wrap"])
        return r.choice(["", "site-", "page-", "js-"]) + r.choice(TOKENS[r.choice(groups)].split()) + r.choice(["", "", "-1", "-box", " wide"])

    def junk(self, where: str) -> str:
        r, t = self.rng, self.tag
        kind = r.choice(["ad", "share", "related", "newsletter", "notice", "comments", "menu", "note"] if where == "inside" else ["menu", "menu", "header", "crumbs", "sidebar", "notice", "ad", "ad", "form", "related", "footer"])
        div = r.choice(["div", "div", "section", "aside"])
        if kind == "ad":
            return t("div", r.choice([self.words(3, 30).capitalize() + ".", f'<a href="#">{self.words(2, 9)}</a>', t("p", self.prose(5, 30), 0)]), 0, self.name("advert") or "ad")
        if kind == "share":
            return t("div", "".join(f'<a href="#">{self.words(1, 1)}</a> ' for _ in range(r.randint(2, 6))), 0, self.name("share"))
        if kind == "menu":
            return t(r.choice(["nav", "nav", "div"]), self.links(0), 0, self.name("menu") if r.random() < 0.6 else "")
        if kind == "crumbs":
            return t(r.choice(["nav", "div", "ol"]), " &gt; ".join(f'<a href="/">{self.words(1, 2)}</a>' for _ in range(3)), 0, "breadcrumbs")
        if kind == "header":
            return t("header", t("div", self.words(1, 4), 0, "logo") + (self.links(0) if r.random() < 0.6 else t("p", self.words(3, 12), 0)), 0, self.name("frame") if r.random() < 0.5 else "")
        if kind in ("sidebar", "related"):
            inner = "".join(t(r.choice(["h2", "h3", "h4"]), self.words(1, 4), 0) + r.choice([self.links(0), t("p", self.prose(5, 40), 0), t("div", f'<a href="#">{self.words(3, 9)}</a>', 0)]) for _ in range(r.randint(1, 3)))
            return t(div if kind == "related" else r.choice(["aside", "aside", "div"]), inner, 0, self.name("aside"))
        if kind == "notice":
            return t(div, r.choice([self.prose(5, 30), t("p", self.prose(5, 30), 0)]) + r.choice(["", f"<button>{self.words(1, 2)}</button>", t("button", self.words(1, 2), 0)]), 0, self.name("notice"))
        if kind in ("form", "newsletter"):
            return t("form", f"<label>{self.words(1, 4)}</label><input name=q>" + r.choice(["", t("p", self.prose(4, 20), 0)]) + t("button", self.words(1, 2), 0), 0, self.name("form"))
        if kind == "comments":
            return self.comments()
        if kind == "note":
            return t("aside", t("p", self.prose(6, 40), 0), 0, self.name("aside", "advert"))
        return t("footer", r.choice(["&copy; ", ""]) + self.words(1, 2) + r.choice([" &middot; ", "<br>", ""]) + self.prose(4, 25) + r.choice(["", self.links(0)]), 0, self.name("frame") if r.random() < 0.4 else "")

    def comments(self) -> str:
        r, t = self.rng, self.tag
        one = lambda: t(r.choice(["div", "li", "article"]), r.choice(["", t("h4", self.words(1, 2), 0), f"<b>{self.words(1, 2)}</b>"]) + "".join(t("p", self.prose(4, 60), 0) for _ in range(r.randint(1, 2))), 0, r.choice(["comment", "comment-body", "reply", ""]))
        inner = t(r.choice(["h2", "h3"]), self.words(1, 3), 0) + "".join(one() for _ in range(r.randint(1, 6)))
        return t(r.choice(["section", "div", "ol", "aside"]), inner, 0, r.choice(["comments", "comment-list", "discussion", "replies", "disqus_thread"]))

    def part(self) -> str:
        r, t = self.rng, self.tag
        kind = r.random()
        if kind < 0.68:
            text = self.prose()
            if r.random() < 0.2:
                text = f"<b>{text}" + r.choice(["", "</b>"])
            if r.random() < 0.15:
                text += f' <a href="#">{self.words(1, 3)}</a> {self.words(1, 8)}'
            return t("p", text + r.choice(["", "", "<br>", "<br>" + self.words(3, 9)]), 1)
        if kind < 0.78:
            return t(r.choice(["h2", "h3"]), self.words(1, 8), 1)
        if kind < 0.85:
            return t(r.choice(["ul", "ol"]), "".join(t("li", self.prose(2, 25), 1) for _ in range(r.randint(2, 6))), 1)
        if kind < 0.9:
            return t("blockquote", r.choice([self.prose(), t("p", self.prose(), 1)]), 1)
        if kind < 0.93:
            return t("figure", f'<img src="x.png">{t("figcaption", self.words(3, 12), 1)}', 1)
        if kind < 0.96:
            return t("table", "".join(t("tr", "".join(t("td", self.words(1, 5), 1) for _ in range(3)), 1) for _ in range(r.randint(2, 4))), 1)
        return t(r.choice(["div", "section"]), "".join(t("p", self.prose(), 1) for _ in range(r.randint(1, 3))), 1)

    def page(self) -> str:
        r, t = self.rng, self.tag
        parts = [self.part() if r.random() > 0.07 else self.junk("inside") for _ in range(r.choice([1, 2, 3, 5, 8, 13, 21]))]
        if r.random() < 0.85:
            parts.insert(0, t("h1", self.words(1, 12), 1) if r.random() < 0.8 else t("header", t("h1", self.words(1, 9), 1) + r.choice(["", t("p", self.words(2, 6), 1)]), 1))
        if r.random() < 0.2:
            parts.append(self.comments())
        style = r.random()
        tag, name = ("article", "") if style < 0.45 else ("main", "") if style < 0.6 else ("article", "post") if style < 0.68 else (r.choice(["div", "section"]), self.name("content") or "content")
        body = t(tag, "".join(parts), 1, name)
        if r.random() < 0.3:
            body = t(r.choice(["main", "div"]), body + (self.comments() if r.random() < 0.4 else "") + (self.junk("outside") if r.random() < 0.3 else ""), 1, r.choice(["", "content", "container", "wrapper", "page"]))
        elif r.random() < 0.25:
            body += self.comments()
        before = "".join(self.junk("outside") for _ in range(r.randint(0, 4)))
        after = "".join(self.junk("outside") for _ in range(r.randint(0, 3)))
        if r.random() < 0.7:
            after += t("footer", r.choice(["&copy; ", ""]) + self.words(1, 3) + " &middot; " + self.words(3, 20), 0)
        whole = before + body + after
        if r.random() < 0.3:
            whole = t("div", whole, 1, r.choice(["page", "container", "wrapper", "root"]))
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><script>var a='</p>';</script></head><body>{whole}</body></html>"


_KEEP = re.compile(r'<([a-z0-9]+)[^>]*?(?: data-keep="([01])")?>')


def labelled_pages(n: int = TRAINING_PAGES, seed: int = TRAINING_SEED) -> tuple[list[str], list[list[int]]]:
    """Generated pages without their labels, and the labels of their nodes (the root, html and body are kept)."""
    pages, labels = [], []
    author = _Author(random.Random(seed))
    while len(pages) < n:
        html = author.page()
        own = [1]
        for m in _KEEP.finditer(html):
            if m[1] in BLOCKS:
                own.append(int(m[2]) if m[2] else 1 if m[1] in ("html", "body") else 0)
        pages.append(re.sub(r' data-keep="[01]"', "", html))
        labels.append(own)
    return pages, labels


@cache
def trained() -> Boosted:
    pages, labels = labelled_pages()
    forest = Forest([parse(p) for p in pages])
    return Boosted(forest.features(), np.concatenate([np.array(x, float) for x in labels]))


def extract(pages: list[str], model: Boosted) -> list[str]:
    """Main text of each page."""
    parsed = [parse(p) for p in pages]
    if not parsed:
        return []
    forest = Forest(parsed)
    kept = forest.decode(model.odds(forest.features()))
    return ["\n".join(text for node, text in p.segments if kept[s + node]) for p, s in zip(parsed, forest.start)]


def _extract_batches(model: Boosted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            html = batch.column(2).to_pylist()
            for at in range(0, len(html), 128):
                texts += extract([h or "" for h in html[at : at + 128]], model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per row of pages: (page_id, url, text, n_chars).

    Null and empty html give an empty text; a page without markup is one block
    of text and is returned as it is; unclosed and stray tags are tolerated; ids
    may be null or repeat; very long pages are read whole; an empty table gives
    an empty result; other columns are ignored.
    """
    common.bound_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract_batches(trained()), "page_id long, url string, text string, n_chars long")
