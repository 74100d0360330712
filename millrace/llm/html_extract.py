"""Main-text extraction from HTML by a tree-structured graphical model.

A page becomes a tree of its block elements with the blocks of text as leaves. Every node is content or boilerplate. Node potentials
come from its tag, class and id words, length and links; potentials between parent and child from the child's kind. One upward and
one downward pass of sum-product messages give each node's marginal, and the text blocks more likely content than not are the text.
The weights are trained on labelled pages by gradient ascent on the likelihood, whose gradient the same two passes give.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that begin and end a block.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose inside is never text of the page.
DROPPED = frozenset("script style head title template svg iframe object noembed noframes canvas audio video select textarea button option datalist".split())
#: Elements whose inside is raw up to their own end tag.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Open elements that a start tag ends.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"},
}
_SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
_IN_P = frozenset(BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"})
_MARKED = frozenset(("article", "main", "nav", "header", "footer", "aside", "form"))

_MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(>|\Z)", re.S
)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_BLANK = re.compile(r"\s+")


@dataclass
class Node:
    parent: int
    tag: str
    names: frozenset[str] = frozenset()
    marked: frozenset[str] = frozenset()
    text: str | None = None
    linked: int = 0


def _names(attributes: str) -> frozenset[str]:
    found = set()
    for m in _ATTR.finditer(attributes):
        found.update(_WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", html.unescape(m[2] or m[3] or m[4] or "")).lower()))
    return frozenset(found)


def parse(page: str) -> list[Node]:
    """The page's nodes in page order; the first is the root. Tolerates unclosed, stray and cut off tags."""
    nodes = [Node(-1, "#root")]
    stack: list[tuple[str, int]] = [("#root", 0)]  # block elements only
    dropped: list[str] = []
    parts: list[str] = []
    anchors, linked = 0, 0

    def flush() -> None:
        nonlocal linked
        text = _BLANK.sub(" ", "".join(parts)).strip()
        if text:
            up = nodes[stack[-1][1]]
            nodes.append(Node(stack[-1][1], "#text", up.names, up.marked, text, min(linked, len(text))))
        parts.clear()
        linked = 0

    def close(upto: int) -> None:
        del stack[upto:]

    def last(tags: set[str] | frozenset[str], scope: set[str] | frozenset[str] = frozenset()) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                return i
            if stack[i][0] in scope:
                break
        return 0

    pos, n = 0, len(page)
    while pos < n:
        m = _MARKUP.search(page, pos)
        s = m.start() if m else n
        if s > pos and not dropped:
            piece = html.unescape(page[pos:s])
            parts.append(piece)
            if anchors:
                linked += len(piece.strip())
        if not m:
            break
        pos = m.end()
        if not m[2] or not m[4]:  # a comment or declaration, or a tag that the end of the page cuts off
            continue
        end, tag = bool(m[1]), m[2].lower()
        if dropped:
            if tag in DROPPED and tag not in VOID:
                if not end:
                    dropped.append(tag)
                elif tag in dropped:
                    del dropped[len(dropped) - 1 - dropped[::-1].index(tag) :]
            elif dropped == ["head"] and not end and tag == "body":
                dropped.clear()  # a head that is never closed
            if dropped:
                if not end and tag in RAW:
                    pos = _raw_end(page, pos, tag)
                    dropped.pop()
                continue
            if tag != "body":
                continue
        if tag in DROPPED:
            if not end and not m[3].rstrip().endswith("/"):
                if tag in RAW:
                    pos = _raw_end(page, pos, tag)
                else:
                    dropped.append(tag)
            continue
        if tag == "a":
            anchors = 0 if end else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCK:
            flush()
            if end:
                if i := last({tag}, _SCOPE.get(tag, frozenset())):
                    close(i)
                continue
            anchors = 0 if tag in ("nav", "footer", "article") else anchors
            if tag in CLOSES and (i := last(CLOSES[tag], _SCOPE[tag])):
                close(i)
            elif tag in _IN_P and stack[-1][0] == "p":
                close(len(stack) - 1)
            if tag in VOID:
                continue
            names, up = _names(m[3]), nodes[stack[-1][1]]
            nodes.append(Node(stack[-1][1], tag, names, up.marked | ({tag} & _MARKED)))
            stack.append((tag, len(nodes) - 1))
    flush()
    return nodes


def _raw_end(page: str, pos: int, tag: str) -> int:
    m = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, pos)
    return m.end() if m else len(page)


def features(nodes: list[Node]) -> list[list[str]]:
    """What a node's potential is a sum over."""
    out = []
    for x in nodes:
        f = [f"tag {x.tag}", *(f"name {w}" for w in x.names), *(f"in {w}" for w in x.marked)]
        if x.text is not None:
            share = x.linked / len(x.text)
            f += [f"links {0 if share == 0 else 1 if share < 0.34 else 2 if share < 0.9 else 3}", f"length {min(len(x.text).bit_length(), 10)}"]
            f.append(f"stop {x.text[-1] in '.!?:;'}")
        out.append(f)
    return out


class Forest:
    """Trees as flat arrays; messages pass level by level over all trees at once."""

    def __init__(self, pages: Iterable[list[Node]], index: dict[str, int], grow: bool = False) -> None:
        parent: list[int] = []
        depth: list[int] = []
        at: list[int] = []
        feature: list[int] = []
        edge: list[int] = []
        self.starts = [0]
        for nodes in pages:
            base = len(parent)
            for i, (x, fs) in enumerate(zip(nodes, features(nodes), strict=True)):
                parent.append(base + x.parent if x.parent >= 0 else -1)
                depth.append(depth[base + x.parent] + 1 if x.parent >= 0 else 0)
                for f in fs:
                    k = index.setdefault(f, len(index)) if grow else index.get(f, -1)
                    if k >= 0:
                        at.append(base + i)
                        feature.append(k)
                edge.append(1 if x.text is not None else 0)
            self.starts.append(len(parent))
        self.parent, self.depth = np.array(parent, np.int64), np.array(depth, np.int64)
        self.at, self.feature, self.edge = np.array(at, np.int64), np.array(feature, np.int64), np.array(edge, np.int64)
        self.levels = [np.flatnonzero(self.depth == d) for d in range(int(self.depth.max(initial=0)) + 1)]

    def marginals(self, weights: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each node, and P(parent's state, own state) of each node but the roots."""
        n = len(self.parent)
        own = np.zeros((n, 2))
        own[:, 1] = np.bincount(self.at, weights[self.feature], n)
        up, to_parent = own.copy(), np.zeros((n, 2))
        for level in self.levels[:0:-1]:  # upward: what each subtree says to its parent
            to_parent[level] = np.logaddexp(*np.moveaxis(edges[self.edge[level]] + up[level][:, None, :], 2, 0))
            np.add.at(up, self.parent[level], to_parent[level])
        full, pair = up.copy(), np.zeros((n, 2, 2))
        for level in self.levels[1:]:  # downward: what all the rest says to each child
            rest = full[self.parent[level]] - to_parent[level]
            joint = rest[:, :, None] + edges[self.edge[level]] + up[level][:, None, :]
            full[level] = np.logaddexp(joint[:, 0], joint[:, 1])
            joint = np.exp(joint - joint.max((1, 2), keepdims=True))
            pair[level] = joint / joint.sum((1, 2), keepdims=True)
        return 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -500, 500))), pair


@dataclass
class PageModel:
    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    edges: np.ndarray = field(default_factory=lambda: np.zeros((2, 2, 2)))

    def content(self, pages: list[str]) -> list[list[str]]:
        """The content blocks of each page."""
        trees = [parse(p) for p in pages]
        forest = Forest(trees, self.index)
        p, _ = forest.marginals(self.weights, self.edges)
        return [[x.text for x, q in zip(t, p[s:e].tolist(), strict=True) if x.text is not None and q >= 0.5] for t, s, e in zip(trees, forest.starts[:-1], forest.starts[1:], strict=True)]

    def text(self, page: str | None) -> str:
        return "\n\n".join(self.content([page])[0]) if page else ""


def train(labelled: list[tuple[str, list[bool]]], epochs: int = 200, rate: float = 0.2, hold: float = 0.0005) -> PageModel:
    """Learns from pages with a label for each text block in page order. An element is content if most of its text is."""
    model, trees, truth = PageModel(), [], []
    for page, marks in labelled:
        nodes = parse(page)
        leaves = [i for i, x in enumerate(nodes) if x.text is not None]
        if len(leaves) != len(marks):
            raise ValueError(f"{len(marks)} labels for {len(leaves)} text blocks")
        good, all_ = np.zeros(len(nodes)), np.zeros(len(nodes))
        for i, y in zip(leaves, marks, strict=True):
            k = i
            while k >= 0:
                all_[k] += len(nodes[i].text)
                good[k] += y * len(nodes[i].text)
                k = nodes[k].parent
        trees.append(nodes)
        truth.append((good * 2 > all_).astype(float))
    forest, y = Forest(trees, model.index, grow=True), np.concatenate(truth)
    w, e = np.zeros(len(model.index)), np.zeros((2, 2, 2))
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (forest.edge[child], y[forest.parent[child]].astype(int), y[child].astype(int)), 1)
    had = np.bincount(forest.feature, y[forest.at], len(w))
    mw, vw, me, ve = np.zeros_like(w), np.zeros_like(w), np.zeros_like(e), np.zeros_like(e)
    for t in range(1, epochs + 1):
        p, pair = forest.marginals(w, e)
        expected = np.zeros((2, 2, 2))
        np.add.at(expected, forest.edge[child], pair[child])
        gw = (had - np.bincount(forest.feature, p[forest.at], len(w))) / len(trees) - hold * w
        ge = (seen - expected) / len(trees) - hold * e
        mw, vw, me, ve = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw**2, 0.9 * me + 0.1 * ge, 0.99 * ve + 0.01 * ge**2
        w = w + rate * (mw / (1 - 0.9**t)) / (np.sqrt(vw / (1 - 0.99**t)) + 1e-6)
        e = e + rate * (me / (1 - 0.9**t)) / (np.sqrt(ve / (1 - 0.99**t)) + 1e-6)
    model.weights, model.edges = w, e
    return model


# -- labelled pages

#: Names that page authors give to what is not the article, and to what is.
ASIDE_NAMES = (
    "ad ads advert advertisement adsbygoogle banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay "
    "sidebar widget rail related recommended trending share sharing social comments comment reply replies discussion disqus respond "
    "menu nav navbar navigation breadcrumb breadcrumbs toolbar footer foot copyright colophon header masthead topbar subscribe newsletter signup "
    "login search pagination pager tags skip paywall"
).split()
BOX_NAMES = ("box", "block", "c", "wrap", "inner", "site")
BODY_NAMES = "article post entry content story body main text page prose".split()


def labelled_pages(n: int = 900, seed: int = 7) -> list[tuple[str, list[bool]]]:
    """Pages made by rule, with a label for each text block: articles of many layouts amid what pages have around them."""
    rnd = random.Random(seed)
    letters = "aeiounrstlmdk"

    def words(a: int, b: int) -> str:
        return " ".join("".join(rnd.choices(letters, k=rnd.randint(2, 9))) for _ in range(rnd.randint(a, b)))

    def sentence(a: int, b: int) -> str:
        return words(a, b).capitalize() + rnd.choice((".", ".", ".", "!", "?", ""))

    def aside(name: str | None = None) -> tuple[str, int]:
        name = name or rnd.choice(ASIDE_NAMES)
        kind = rnd.randrange(5)
        mark = rnd.choice((f'class="{name}"', f'class="{rnd.choice(BOX_NAMES)}-{name}"', f'id="{name}"'))
        if kind == 0:
            return f"<div {mark}>{sentence(2, 30)}</div>", 1
        if kind == 1:
            k = rnd.randint(2, 6)
            return f"<div {mark}><ul>" + "".join(f'<li><a href="#">{words(1, 4)}</a></li>' for _ in range(k)) + "</ul></div>", k
        if kind == 2:
            k = rnd.randint(1, 3)
            return f"<section {mark}><h3>{words(1, 3)}</h3>" + "".join(f"<p>{sentence(3, 40)}</p>" for _ in range(k)) + "</section>", k + 1
        if kind == 3:
            return f"<aside {mark if rnd.random() < 0.5 else ''}><p>{sentence(3, 30)}</p></aside>", 1
        return f"<form {mark if rnd.random() < 0.5 else ''}><p>{sentence(2, 9)}</p><input name=q><button>{words(1, 1)}</button></form>", 1

    def article() -> tuple[str, list[bool]]:
        out, marks = "", []
        if rnd.random() < 0.8:
            out, marks = f"<h1>{words(1, 12)}</h1>", [True]
        for _ in range(rnd.choice((1, 1, 2, 4, 8, 16))):
            kind = rnd.random()
            if kind < 0.72:
                out += f"<p>{'<b>' if rnd.random() < 0.2 else ''}{sentence(1, rnd.choice((1, 8, 40, 120)))}{'<br>' if rnd.random() < 0.2 else '</p>'}"
                marks.append(True)
            elif kind < 0.78:
                out += f'<p>{sentence(2, 12)} <a href="/x">{words(1, 4)}</a> {sentence(2, 12)}</p>'
                marks.append(True)
            elif kind < 0.84:
                h = rnd.choice(("h2", "h3", "h4"))
                out, marks = out + f"<{h}>{words(1, 6)}</{h}>", [*marks, True]
            elif kind < 0.86:
                wrap = rnd.choice(("section", "div", "section", "figcaption"))
                out, marks = out + f"<{wrap}><p>{sentence(3, 40)}</p></{wrap}>", [*marks, True]
            elif kind < 0.88:
                k = rnd.randint(1, 4)
                out, marks = out + "<ul>" + "".join(f"<li>{sentence(1, 14)}</li>" for _ in range(k)) + "</ul>", marks + [True] * k
            elif kind < 0.91:
                out, marks = out + f"<blockquote><p>{sentence(3, 40)}</p></blockquote>", [*marks, True]
            elif kind < 0.94:
                out, marks = out + f"<table><tr><td>{words(1, 3)}<td>{words(1, 3)}</table>", [*marks, True, True]
            elif kind < 0.96:
                out, marks = out + f"<pre>{words(1, 20)}</pre>", [*marks, True]
            else:
                x, k = aside()
                out, marks = out + x, marks + [False] * k
        return out, marks

    pages = []
    for _ in range(n):
        before, after, marks, tail = "", "", [], []
        for _ in range(rnd.randint(0, 3)):
            if rnd.random() < 0.4:
                k = rnd.randint(2, 7)
                links = "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(k))
                x = f"<nav><ul>{links}</ul></nav>" if rnd.random() < 0.7 else f'<div class="menu"><ul>{links}</ul></div>'
            elif rnd.random() < 0.4:
                x, k = f"<header><div>{words(1, 4)}</div></header>", 1
            else:
                x, k = aside()
            before, marks = before + x, marks + [False] * k
        for _ in range(rnd.randint(0, 3)):
            if rnd.random() < 0.5:
                x, k = f"<footer>&copy; {words(1, 3)} &middot; {sentence(1, 20)}</footer>", 1
            else:
                x, k = aside(rnd.choice((None, "comments", "comment")))
            after, tail = after + x, tail + [False] * k
        body, inner = article()
        wrap = rnd.random()
        name = rnd.choice(("", f"{rnd.choice(BOX_NAMES)}-")) + rnd.choice(BODY_NAMES)
        if wrap < 0.55:
            body = f"<article>{body}</article>"
        elif wrap < 0.7:
            body = f"<main>{body}</main>"
        elif wrap < 0.8:
            body = f'<main><article class="{name}">{body}</article></main>'
        elif wrap < 0.95:
            kind = rnd.choice(("div", "div", "section"))
            body = f'<{kind} class="{name}">{body}</{kind}>'
        if rnd.random() < 0.3:
            before, after = f"<div>{before}", f"{after}</div>"
        pages.append((f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title></head><body>{before}{body}{after}</body></html>", marks + inner + tail))
    return pages


def extract(pages: DataFrame, model: PageModel, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the page's main text in ``text_col``, without ``html_col``.

    Blocks in page order joined by two line feeds; white space inside a block is one blank; references are decoded. A page that is null
    or empty, or has no content, gives an empty text. Repeated rows are answered each; an empty table gives an empty table.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(s: pd.Series) -> pd.Series:
        out: list[str] = []
        batch: list[str] = []
        size = 0
        for page in [*(p if isinstance(p, str) else "" for p in s), None]:
            if page is not None:
                batch.append(page)
                size += len(page)
            if batch and (page is None or size > 1_000_000):
                out += ["\n\n".join(b) for b in shared.value.content(batch)]
                batch, size = [], 0
        return pd.Series(out, index=s.index, dtype=object)

    one = F.pandas_udf(run, "string")
    rest = [c for c in pages.columns if c not in (html_col, text_col)]
    return pages.select(*rest, one(F.col(html_col).cast("string")).alias(text_col))


