"""Main text of HTML pages by a tree-structured graphical model over the blocks of the page.

Every block element and every text run of a page (``html_tree.py``) is a node with a hidden label: part of the main text or
not. A node's features (role of its tag, words of its class and id, length, punctuation, share of link text, place)
give its own potential; the label pair of parent and child has a potential of its own, with weights by kind of
child. The DOM is a tree, so one pass of messages from the leaves to the root and one back give
exact marginals, for all pages of a batch at once, level by level. Text runs whose marginal
says main text are the result, in page order.

The weights maximise the likelihood of labelled pages (gradient: observed less expected features, from the same messages). Labelled are
the given pages that have one ``<article>``, at most ``SAMPLE`` of them with up to ``PAGE_CHARS`` characters (the ones with the least hash of
their id), and ``LAYOUTS`` pages that set their blocks in other layouts (``html_layouts.py``). This bounds the fit alone: every
page is extracted from its whole text.

Defined results: a null or empty html, or one without main text, gives an empty text and no blocks; a text
without any markup is one block of the page, judged like another; repeated rows are separate rows; an empty table gives an empty result,
and a table without labelled pages is judged by the fixed texts of the layouts alone; other columns are ignored, whatever their names.
Character references are decoded as the HTML standard does (``&amp`` without a semicolon too, ``&am`` not); white space
(Unicode's, so no-break spaces too) inside a block becomes one space.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrain.llm.html_layouts import Layout, Parts, own_labels
from casegrain.llm.html_tree import Tree, parse
from casegrain.llm.tables import arrow
from casegrain.llm.words import column

SAMPLE = 200            # given pages to fit on, at most
PAGE_CHARS = 100_000    # their length, at most
LAYOUTS = 900           # pages in other layouts
SEED = 20240917
STEPS, RATE, DECAY = 150, 0.1, 2e-5
BATCH_NODES = 200_000   # nodes judged at once; a page with more stands alone

EXTRACTED = "page_id long, url string, text string, blocks array<struct<text:string,tag:string,probability:double>>"
_BLOCK = pa.struct([("text", pa.string()), ("tag", pa.string()), ("probability", pa.float64())])

# ---- fixed values: roles of tags and words in class, id and role attributes -----
ROLES = [("article", "main"), ("section",), ("div", "center"), ("p",), ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"),
         ("ul", "ol", "dl", "dir", "menu"), ("li", "dt", "dd"), ("table", "tbody", "thead", "tfoot", "tr"), ("td", "th", "caption"),
         ("nav",), ("header",), ("footer",), ("aside",), ("form", "fieldset", "search", "legend"), ("blockquote", "pre", "listing"),
         ("figure", "figcaption"), ("html", "body"), ("address", "details", "summary")]
GOOD = frozenset("article post entry content story main text body page single".split())
HINTS = [frozenset("nav menu navigation navbar breadcrumb breadcrumbs links toc pager pagination tabs".split()),
         frozenset("header masthead banner branding logo top head".split()),
         frozenset("footer bottom copyright imprint legal colophon foot".split()),
         frozenset("sidebar aside side widget widgets related recommended rail popular more teaser complementary".split()),
         frozenset("cookie cookies consent notice alert message gdpr warning popup modal overlay dialog contentinfo".split()),
         frozenset("ad ads advert adverts advertisement sponsor sponsored promo promotion banner dfp outbrain taboola".split()),
         frozenset("comment comments commentlist reply replies response responses discussion disqus reader respond feedback".split()),
         frozenset("form newsletter subscribe subscription search login signup register contact".split()),
         frozenset("share sharing social follow tweet".split())]
# --------------------------------------------------------------------------------
_ROLE = {t: i for i, tags in enumerate(ROLES) for t in tags}
N_FLAGS = 2 + 2 * (len(ROLES) + 1) + 1 + len(HINTS) + 1
N_FEATURES = N_FLAGS + 14
N_EDGE = 5 + len(HINTS)


class Pages(NamedTuple):
    """Some pages' nodes, level by level of their trees: features, parents (-1 for roots), edge features.

    ``bounds`` cuts the levels; children of one parent stand together, in the order of the parents, and begin at
    ``starts``. ``back`` gives the place of each node in page order.
    """

    x: np.ndarray
    parent: np.ndarray
    e: np.ndarray
    bounds: list[tuple[int, int]]
    starts: list[np.ndarray]
    back: np.ndarray

    def upward(self):
        """(children's slice, their parents, where each parent's children begin), deepest level first."""
        for (lo, hi), at in zip(self.bounds[:0:-1], self.starts[:0:-1]):
            yield slice(lo, hi), self.parent[lo + at], at

    def downward(self):
        for lo, hi in self.bounds[1:]:
            yield slice(lo, hi), self.parent[lo:hi]


def _flags(t: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per node: 0/1 features, edge features, and (code points, link code points, words, marks, digits, ends a sentence)."""
    n, roles = len(t.tag), len(ROLES) + 1
    x, e, c = np.zeros((n, N_FLAGS), np.float32), np.zeros((n, N_EDGE), np.float32), np.zeros((n, 6))
    x[:, 0] = 1
    e[:, 0] = 1
    for i, (tag, p, words) in enumerate(zip(t.tag, t.parent, t.words)):
        if not tag:
            text = t.text[i]
            x[i, 1] = 1
            x[i, 2 + roles + _ROLE.get(t.tag[p], roles - 1)] = 1
            e[i, 1] = 1
            c[i] = (len(text), t.linked[i], text.count(" ") + 1, sum(map(text.count, ",.;:!?")),
                    "©" in text or "®" in text, text[-1] in ".!?…»\"”")
            continue
        role = _ROLE.get(tag, roles - 1)
        x[i, 2 + role] = 1
        e[i, 2], e[i, 3] = tag in ("article", "main"), tag in ("nav", "header", "footer", "aside", "form")
        if words:
            x[i, 2 + 2 * roles] = e[i, 4] = bool(words & GOOD)
            for j, h in enumerate(HINTS):
                if words & h:
                    x[i, 3 + 2 * roles + j] = e[i, 5 + j] = 1
            x[i, N_FLAGS - 1] = 1
    return x, e, c


def pages(trees: list[Tree]) -> Pages:
    """Features and levels of some pages."""
    parts = [_flags(t) for t in trees]
    sizes = np.array([len(t.tag) for t in trees], np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    parent = np.concatenate([np.array(t.parent, np.int64) + np.where(np.array(t.parent) >= 0, f, 0) for t, f in zip(trees, first)])
    own, e = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    c = np.concatenate([p[2] for p in parts])
    n = len(parent)
    # Levels: children of the level before, in its order.
    order = np.argsort(parent, kind="stable")
    begin = np.searchsorted(parent[order], np.arange(-1, n + 1))
    levels, now = [], order[:begin[1]]
    while len(now):
        levels.append(now)
        lo, hi = begin[now + 1], begin[now + 2]
        size = hi - lo
        now = order[np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))]
    by_level = np.concatenate(levels)
    back = np.empty(n, np.int64)
    back[by_level] = np.arange(n)
    edges = np.cumsum([0] + [len(level) for level in levels])
    up = np.where(parent[by_level] >= 0, back[parent[by_level]], -1)
    bounds = [(int(lo), int(hi)) for lo, hi in zip(edges[:-1], edges[1:])]
    starts = [np.flatnonzero(np.diff(up[lo:hi], prepend=-2)) for lo, hi in bounds]
    own, e, c = own[by_level], e[by_level], c[by_level]
    page = np.repeat(np.arange(len(trees)), sizes)[by_level]
    p = Pages(own, up, e, bounds, starts, back)
    sums = np.concatenate([c, (c[:, :1] > 0), (c[:, :1] > 80)], axis=1)
    longest = c[:, 0].copy()
    # Pages with a landmark: what lies outside of all of them, and does not hold one.
    inside = (e[:, 2] > 0) & ~(e[:, 5:] > 0).any(axis=1)
    holds = inside.copy()
    for level, q, at in p.upward():
        sums[q] += np.add.reduceat(sums[level], at)
        longest[q] = np.maximum(longest[q], np.maximum.reduceat(longest[level], at))
        holds[q] |= np.logical_or.reduceat(holds[level], at)
    for level, q in p.downward():
        inside[level] |= inside[q]
    root = back[first[:-1]]
    outside = holds[root][page] & ~inside & ~holds
    chars, words = np.maximum(sums[:, 0], 1), np.maximum(sums[:, 2], 1)
    place = (by_level - first[page]) / np.maximum(sizes[page] - 1, 1)
    rest = np.stack([np.log1p(sums[:, 0]) / 6, np.log1p(longest) / 6, sums[:, 1] / chars, np.minimum(sums[:, 3] / words, 1),
                     sums[:, 4] > 0, c[:, 5], sums[:, 0] / np.maximum(sums[root, 0], 1)[page], np.log1p(sums[:, 6]) / 3,
                     sums[:, 7] / np.maximum(sums[:, 6], 1), place, place > .9, np.minimum(chars / words, 20) / 10, outside, inside], axis=1)
    return p._replace(x=np.concatenate([own, rest], axis=1).astype(np.float64), e=e.astype(np.float64))


class Model(NamedTuple):
    """Weights of nodes (features) and of label pairs (parent's label, child's label, edge features)."""

    node: np.ndarray
    edge: np.ndarray


def messages(p: Pages, m: Model) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginal of main text per node, joint marginals of (parent's label, own label) per node, log of the normaliser."""
    n = len(p.parent)
    below = np.zeros((n, 2))
    below[:, 1] = p.x @ m.node
    pair = (p.e @ m.edge.reshape(4, -1).T).reshape(n, 2, 2)
    up, above = np.zeros((n, 2)), np.zeros((n, 2))
    for level, q, at in p.upward():
        cells = pair[level] + below[level][:, None, :]
        up[level] = np.logaddexp(cells[:, :, 0], cells[:, :, 1])
        below[q] += np.add.reduceat(up[level], at)
    joint = np.zeros((n, 2, 2))
    for level, q in p.downward():
        cells = pair[level] + (above[q] + below[q] - up[level])[:, :, None]
        above[level] = np.logaddexp(cells[:, 0], cells[:, 1])
        cells += below[level][:, None, :]
        joint[level] = np.exp(cells - cells.max(axis=(1, 2), keepdims=True))
    joint /= np.maximum(joint.sum(axis=(1, 2), keepdims=True), 1e-300)
    both = above + below
    root = below[slice(*p.bounds[0])] if p.bounds else np.zeros((0, 2))
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700))), joint, float(np.logaddexp(root[:, 0], root[:, 1]).sum())


def fit_trees(trees: list[Tree]) -> Model:
    """Weights of greatest (penalised) likelihood of labelled trees."""
    p = pages(trees)
    y = np.zeros(len(p.parent), np.int64)
    y[p.back] = np.concatenate([np.array(t.label) for t in trees])
    child = p.parent >= 0
    seen_node = p.x.T @ y
    seen_edge = np.zeros((2, 2, N_EDGE))
    np.add.at(seen_edge, (y[p.parent[child]], y[child]), p.e[child])
    w = np.zeros(N_FEATURES + 4 * N_EDGE)
    first, second, n = np.zeros_like(w), np.zeros_like(w), len(y)
    for step in range(1, STEPS + 1):
        m = Model(w[:N_FEATURES], w[N_FEATURES:].reshape(2, 2, N_EDGE))
        one, joint, _ = messages(p, m)
        edge = (joint.reshape(-1, 4).T @ p.e).reshape(2, 2, N_EDGE)     # zero at the roots
        g = np.concatenate([seen_node - p.x.T @ one, (seen_edge - edge).ravel()]) / n - DECAY * w
        first, second = .9 * first + .1 * g, .99 * second + .01 * g * g
        w = w + RATE * (1 - step / (STEPS + 1)) * (first / (1 - .9 ** step)) / (np.sqrt(second / (1 - .99 ** step)) + 1e-9)
    return Model(w[:N_FEATURES], w[N_FEATURES:].reshape(2, 2, N_EDGE))


def fit(given: DataFrame) -> Model:
    """The model of the labelled ones among ``given`` (page_id, html) and of their blocks in other layouts."""
    labelled = (given.where("instr(lower(html), '<article') > 0").where(F.char_length("html") <= PAGE_CHARS)
                .select("html", F.xxhash64(F.lit(SEED), F.col("page_id").cast("long"), F.col("html")).alias("h")))
    # The hashes are ranked first, so no task sends its own best pages: only the chosen ones reach the driver.
    most = labelled.select("h").orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    sample = labelled.where(F.col("h") <= F.lit(most).cast("long")).orderBy("h", "html").limit(SAMPLE)
    own = [t for t in (parse(r["html"]) for r in sample.collect()) if own_labels(t)]
    r, parts = random.Random(SEED), Parts(own)
    return fit_trees(own + [parse(Layout(r, parts).page()) for _ in range(LAYOUTS)])


def _groups(trees: list[Tree]) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for i, t in enumerate(trees):
        if i > lo and size + len(t.tag) > BATCH_NODES:
            yield lo, i
            lo, size = i, 0
        size += len(t.tag)
    if trees:
        yield lo, len(trees)


def main_blocks(trees: list[Tree], model: Model) -> list[list[dict]]:
    """Text runs of the main text of each page: text, tag of the block, probability."""
    out = []
    for lo, hi in _groups(trees):
        p = pages(trees[lo:hi])
        one, at = messages(p, model)[0][p.back], 0
        for t in trees[lo:hi]:
            own = one[at:at + len(t.tag)]
            out.append([{"text": t.text[i], "tag": t.tag[t.parent[i]], "probability": float(own[i])}
                        for i in np.flatnonzero(own > .5).tolist() if not t.tag[i]])
            at += len(t.tag)
    return out


def extract(given: DataFrame, model: Model) -> DataFrame:
    """Main text of every page of ``given`` (page_id, url, html): one row of ``EXTRACTED`` per input row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = main_blocks([parse(h or "") for h in column(batch, "html").to_pylist()], model)
            texts = ["\n\n".join(b["text"] for b in page) for page in blocks]
            yield pa.RecordBatch.from_arrays([column(batch, "page_id"), column(batch, "url"), pa.array(texts, pa.string()),
                                              pa.array(blocks, pa.list_(_BLOCK))], names=["page_id", "url", "text", "blocks"])
    return arrow(given.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), run, EXTRACTED)
