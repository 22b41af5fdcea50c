"""Main text of web pages by gradient-boosted trees over DOM nodes, decoded over the tree."""

from __future__ import annotations

import functools
import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_buffers
from .dom import Node, attribute_words, blocks, parse

#: Tags and attribute words that have a feature of their own; the rest share hash buckets.
TAGS = "html body main article section div nav header footer aside form p h1 h2 h3 h4 ul ol li a span b table tr td th blockquote pre figure figcaption button input select label dl img iframe address details".split()
WORDS = "ad ads advert advertisement sponsor sponsored promo banner cookie consent notice popup modal overlay nav navigation menu navbar breadcrumb breadcrumbs sidebar side widget footer foot header head masthead top bottom share social follow related recommended more comment comments reply disqus respond newsletter subscribe signup login search form skip pagination pager tags meta author date byline copyright legal content article post entry main body text story page blog".split()
HASHED = 8
#: Pages made for the fit, trees, depth, step and bins.
FIT_PAGES, TREES, DEPTH, RATE, BINS = 600, 26, 4, 0.45, 24

_TAG = {t: i for i, t in enumerate(TAGS)}
_WORD = {w: i for i, w in enumerate(WORDS)}
_STATS = 17
LEAST = math.log(0.5)
WIDTH = _STATS + 2 + len(WORDS) + HASHED


@functools.lru_cache(maxsize=4096)
def _words(attrs: str) -> tuple[int, ...]:
    return tuple(_STATS + 2 + (_WORD[w] if w in _WORD else len(WORDS) + sum(w.encode()) % HASHED) for w in attribute_words(attrs))


def node_features(nodes: list[Node], stream: list[tuple[int, str]]) -> np.ndarray:
    """One row a node: place, subtree density, siblings, tag and attribute words."""
    n = len(nodes)
    chars, linked, tags, paras, controls, stops, mains = ([0.0] * n for _ in range(7))
    for i, text in stream:
        if text is not None:
            size = len(text.strip())
            chars[i] += size
            stops[i] += text.count(". ") + text.count(", ") if size > 40 else 0
    depth = [0] * n
    in_link = [False] * n
    own = chars[:]
    for i in range(1, n):
        x = nodes[i]
        depth[i] = depth[x.parent] + 1
        in_link[i] = in_link[x.parent] or x.tag == "a"
        if in_link[i]:
            linked[i] = chars[i]
        tags[i] = 1
        paras[i] = x.tag == "p"
        controls[i] = x.tag in ("input", "button", "select", "textarea", "label")
        mains[i] = x.tag in ("article", "main")
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        chars[p] += chars[i]
        linked[p] += linked[i]
        tags[p] += tags[i]
        paras[p] += paras[i]
        controls[p] += controls[i]
        stops[p] += stops[i]
        mains[p] += mains[i]
    whole = max(chars[0], 1.0)
    rows, before = [], 0.0
    for i, x in enumerate(nodes):
        p, at, size = x.parent, x.index, chars[i]
        kin = nodes[p].children if p >= 0 else [0]
        rows.append(
            (
                depth[i],
                at,
                len(kin) - at - 1,
                len(x.children),
                size,
                size / whole,
                linked[i] / (size + 1),
                size / (tags[i] + 1),
                tags[i],
                paras[i],
                controls[i],
                stops[i] / (size + 1) * 100,
                own[i],
                size / (chars[p] + 1) if p >= 0 else 1,
                before / whole,
                chars[kin[at - 1]] / (size + 1) if at else -1,
                mains[i],
                _TAG.get(x.tag, -1),
                _TAG.get(nodes[p].tag, -1) if p >= 0 else -1,
            )
        )
        before += own[i]
    out = np.zeros((n, WIDTH), np.float32)
    out[:, : _STATS + 2] = rows
    for i, x in enumerate(nodes):
        if x.attrs:
            for at in _words(x.attrs):
                out[i, at] = 1
    return out


class Boosted:
    """Trees of one depth over binned features, for the logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        tag = range(_STATS, _STATS + 2)
        for f in tag:
            self.edges[f] = np.arange(len(TAGS) - 1) + 0.5  # a bin a tag
        self.depth, self.trees = depth, []
        binned = self.bin(x)
        self.bias = float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
        z = np.full(len(y), self.bias)
        most = max(len(e) for e in self.edges) + 1
        used = [f for f in range(x.shape[1]) if len(self.edges[f])]
        for _ in range(trees):
            p = 1 / (1 + np.exp(-z))
            g, h = p - y, p * (1 - p) + 1e-6
            leaf = np.zeros(len(y), np.int64)
            splits = []
            for level in range(depth):
                leaves = 1 << level
                key = (leaf[:, None] * len(used) + np.arange(len(used))) * most + binned[:, used]
                shape = (leaves, len(used), most)
                gs = np.bincount(key.ravel(), np.repeat(g, len(used)), minlength=leaves * len(used) * most).reshape(shape).cumsum(axis=2)
                hs = np.bincount(key.ravel(), np.repeat(h, len(used)), minlength=leaves * len(used) * most).reshape(shape).cumsum(axis=2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                fit = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                fit[(hs < 2) | (ht - hs < 2)] = 0
                best = fit.reshape(leaves, -1).argmax(axis=1)
                choice = np.stack((np.array(used)[best // most], best % most), axis=1)
                choice[fit.reshape(leaves, -1).max(axis=1) <= 1e-6, 1] = most  # everything goes left
                splits.append(choice)
                leaf = leaf * 2 + (binned[np.arange(len(y)), choice[leaf, 0]] > choice[leaf, 1])
            gs, hs = np.bincount(leaf, g, minlength=1 << depth), np.bincount(leaf, h, minlength=1 << depth)
            value = -rate * gs / (hs + 1)
            self.trees.append((splits, value))
            z += value[leaf]

    def bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds that a node holds main text, given that its parent does."""
        rows = np.arange(len(x))
        binned = np.zeros(x.shape, np.int64)
        for f in {int(f) for splits, _ in self.trees for choice in splits for f in choice[:, 0]}:
            binned[:, f] = np.searchsorted(self.edges[f], x[:, f])
        z = np.full(len(x), self.bias)
        for splits, value in self.trees:
            leaf = np.zeros(len(x), np.int64)
            for choice in splits:
                leaf = leaf * 2 + (binned[rows, choice[leaf, 0]] > choice[leaf, 1])
            z += value[leaf]
        return z


def decode(nodes: list[Node], score: list[float]) -> list[bool]:
    """Which nodes are kept, never one under one that is not.

    The trees give the odds of a node given that its parent is kept. So the probability that a node is kept is the
    product along its path, which can only fall on the way down; nodes of at least one half are kept.
    """
    path, out = [0.0] * len(nodes), [True] * len(nodes)
    for i in range(1, len(nodes)):
        s = score[i]
        path[i] = path[nodes[i].parent] - (math.log1p(math.exp(-s)) if s > -30 else -s)
        out[i] = path[i] >= LEAST
    return out


# -- made pages ----------------------------------------------------------


def made_page(r: random.Random) -> str:
    """A page of invented words; elements with main text carry the attribute ``data-gold``."""
    syllables = [a + b for a in ("b", "d", "k", "l", "m", "n", "r", "s", "t", "v", "th", "") for b in ("a", "e", "i", "o", "u", "en", "ar")]
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))
    phrase = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    mark = r.choice(["", "", "", "!!", "*** ", "&amp; "])

    def text(a: int = 1, b: int = 90) -> str:
        return " ".join(phrase(1, 12).capitalize() + r.choice([".", ".", ",", mark or "."]) for _ in range(max(1, r.randint(a, b) // 8)))

    def attr(words: str) -> str:
        if r.random() < 0.1:
            return ""
        w = r.choice(words.split())
        return f' {r.choice(["class", "id", "class"])}="{r.choice([w, w, w + "-" + word(), word() + "-" + w, w + " " + word()])}"'

    gold = " data-gold"
    links = lambda a, b: "<ul>" + "".join(f'<li><a href="/{word()}">{phrase(1, 3)}</a></li>' for _ in range(r.randint(a, b))) + "</ul>"

    def junk(inside: bool) -> str:
        k = r.randrange(11)
        box = r.choice(["div", "div", "aside", "section"])
        if k == 0:
            return f"<nav{attr('nav menu navbar breadcrumb')}>{links(2, 12)}</nav>"
        if k == 1:
            return f"<{box}{attr('ad ads advert sponsor promo banner sponsored advertisement')}>{text(1, 40)}</{box}>"
        if k == 2:
            return f"<aside{attr('sidebar side widget related')}>{r.choice([links(2, 8), '<h3>' + phrase(1, 4) + '</h3><p>' + text() + '</p>', text()])}</aside>"
        if k == 3:
            return f"<form{attr('search newsletter subscribe signup login form')}>{r.choice(['<label>' + phrase(1, 4) + '</label>', '<p>' + text(1, 20) + '</p>'])}<input name=q><button>{phrase(1, 2)}</button></form>"
        if k == 4:
            return f"<div{attr('cookie consent notice popup banner modal')}>{r.choice([text(3, 30), '<p>' + text(3, 30) + '</p>'])}<button>{phrase(1, 2)}</button></div>"
        if k == 5:
            each = "".join(f"<{t}{attr('comment reply')}><b>{word()}</b><p>{text()}</p></{t}>" for t in [r.choice(["div", "li", "article"])] * r.randint(1, 5))
            return f"<{box} {attr('comments comment disqus respond replies') or 'class=comments'}><h3>{phrase(1, 3)}</h3>{each}</{box}>"
        if k == 6:
            return f"<div{attr('related recommended more')}><h4>{phrase(1, 3)}</h4>{links(2, 6)}</div>"
        if k == 7:
            return f"<div{attr('share social follow')}>{links(2, 5)}</div>"
        if k == 8 and not inside:
            return f"<header{attr('header masthead top head')}>{r.choice(['<h1>' + phrase(1, 3) + '</h1>', '<p>' + phrase(1, 8) + '</p>', ''])}{r.choice([links(2, 7), ''])}</header>"
        if k == 9 and not inside:
            return f"<footer{attr('footer foot bottom copyright legal')}>{r.choice(['&copy; ' + word() + ' &middot; ' + text(), '<p>&copy; ' + text() + '</p>', links(2, 9)])}</footer>"
        return f"<div{attr('menu sidebar widget pagination tags breadcrumbs skip notice')}>{r.choice([links(1, 6), '<p>' + text(1, 30) + '</p>', text(1, 20)])}</div>"

    def part() -> str:
        k = r.randrange(24)
        if k == 0:
            return f"<h{(h := r.randint(2, 4))}{gold}>{phrase(1, 6)}</h{h}>"
        if k == 1:
            t = r.choice(["ul", "ol"])
            return f"<{t}{gold}>" + "".join(f"<li{gold}>{text(1, 20)}</li>" for _ in range(r.randint(1, 6))) + f"</{t}>"
        if k == 2:
            return f"<blockquote{gold}><p{gold}>{text()}</p></blockquote>"
        if k == 3:
            return f"<table{gold}>" + "".join(f"<tr{gold}>" + "".join(f"<td{gold}>{phrase(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>"
        if k == 4:
            return f"<pre{gold}>{text(1, 20)}</pre>"
        if k == 5:
            return f"<figure{gold}><img src=x><figcaption{gold}>{phrase(2, 9)}</figcaption></figure>"
        if k == 6:
            return f"<p{gold}><b{gold}>{text()}<br>"
        if k == 7:
            return f'<p{gold}>{text()} <a{gold} href="/{word()}">{phrase(1, 4)}</a> {text()}</p>'
        if k == 8:
            return f"<div{gold}><p{gold}>{text()}</p></div>"
        if k in (9, 10, 11):
            return f"<p{gold}>{phrase(1, 3)}.</p>"
        if k == 12:
            return f"<p{gold}>{word()}.</p>" * r.randint(1, 3)
        return f"<p{gold}>{text()}</p>"

    def article() -> str:
        k = r.random()
        tag, a = ("article", r.choice(["", "", attr("article post entry content")])) if k < 0.6 else ("main", r.choice(["", attr("content main")])) if k < 0.75 else ("section" if k < 0.8 else "div", attr("content article post entry story main body text") or ' class="content"')
        title = f"<h1{gold}>{phrase(1, 9)}</h1>" if r.random() < 0.8 else ""
        if r.random() < 0.15:
            title = f"<header{gold}>{title or f'<h1{gold}>{phrase(1, 5)}</h1>'}</header>"
        body = "".join(part() + (junk(True) if r.random() < 0.06 else "") for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8, 12])))
        if r.random() < 0.2:
            body = f"<div{gold}{attr('body content text entry')}>{body}</div>"
        return f"<{tag}{gold}{a}>{title}{body}</{tag}>"

    inner = article()
    left, right = "".join(junk(False) for _ in range(r.randint(0, 4))), "".join(junk(False) for _ in range(r.randint(0, 4)))
    if r.random() < 0.35:
        wrap = r.choice(["div", "main", "div", "section"])
        inner = f"<{wrap}{gold}{attr('content page wrapper container main')}>{''.join(junk(False) for _ in range(r.randint(0, 2)))}{inner}{''.join(junk(False) for _ in range(r.randint(0, 2)))}</{wrap}>"
    head = f"<head><title>{phrase(1, 6)}</title><style>p{{}}</style></head>" if r.random() < 0.9 else ""
    return f"<!DOCTYPE html><html{gold}>{head}<body{gold}>{left}{inner}{right}</body></html>"


def made_sample(pages: int = FIT_PAGES, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of made pages whose parent holds main text: the rest is never asked about."""
    r = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        nodes, stream = parse(made_page(r))
        x = node_features(nodes, stream)
        y = np.array([i == 0 or "data-gold" in n.attrs for i, n in enumerate(nodes)])
        known = np.array([i > 0 and y[n.parent] for i, n in enumerate(nodes)])
        xs.append(x[known])
        ys.append(y[known].astype(float))
    return np.concatenate(xs), np.concatenate(ys)


@functools.lru_cache(maxsize=1)
def model() -> Boosted:
    return Boosted(*made_sample())


def extract(pages: list[str], trees: Boosted) -> list[str]:
    """Main text of each page; the nodes of all are scored together."""
    parsed = [parse(p) for p in pages]
    xs = [node_features(n, s) for n, s in parsed]
    z = trees.score(np.concatenate(xs)) if xs else np.zeros(0)
    out, at = [], 0
    for (nodes, stream), x in zip(parsed, xs, strict=True):
        score = z[at : at + len(x)].tolist()
        at += len(x)
        out.append("\n\n".join(blocks(stream, decode(nodes, score))))
    return out


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, text, n_chars: the main text of every whole page.

    The trees are fitted on the driver on pages made for it (``made_page``: templates with known main text) and
    broadcast (a few hundred kB). Null and empty pages have an empty text; repeated rows agree; pages too large for a
    batch are parsed alone; an empty table gives an empty result; other columns are not read.
    """
    kinds = dict(pages.dtypes)
    sent = pages.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, off = text_buffers(batch.column(2))
            for i, j in _few(off):
                texts = extract([x or "" for x in batch.column(2).slice(i, j - i).to_pylist()], sent.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col)).mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")


def _few(off: np.ndarray, size: int = 1 << 19, rows: int = 256) -> Iterator[tuple[int, int]]:
    i, n = 0, len(off) - 1
    while i < n:
        j = min(max(int(np.searchsorted(off, off[i] + size, side="right")) - 1, i + 1), n, i + rows)
        yield i, j
        i = j
