"""Main-text extraction: boosted trees judge DOM nodes, and a tree search gives labels without contradiction.

A page becomes a tree of elements. Each element has numbers about its subtree (text, tags, density, links), its attribute tokens and tag,
its depth and its siblings. Gradient-boosted trees, trained here, give the log-odds of "part of the article". Labels go down the tree
in one order only: container, then article, then dropped. So nothing under a dropped element is kept, and nothing under an article element is
a container again; the labels with the highest sum of weighted log-odds under that rule are found in one pass up and one down.

There are no labelled pages, so training pages are made from the table: the article of each page of a bounded sample (its ``article`` or
``main`` element, else its largest element of running text) is put among menus, headers, footers, sidebars, notices, adverts, forms and comments in many
wrappings, whose words come from the same pages, so that words decide nothing. The sample is SAMPLE_PAGES pages of at most SAMPLE_BYTES.

Defined cases: a null or empty page, or one without text, gives the empty text; unclosed and stray tags are put right as browsers do (a head
ends before the first tag or text that can't be in one); repeated pages are treated alike; with no page to learn from, all text outside tags that never show is kept. Other columns pass through, and one
that has the name of a result is replaced.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_PAGES = 300
SAMPLE_BYTES = 200_000
VARIANTS = 3

# Element names by their part in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript svg iframe title".split())
HEAD = frozenset("base link meta title style script noscript template".split())
RAW = frozenset("script style template noscript iframe textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img object canvas math mi mn mo ms mtext mrow mstyle mfrac msqrt mroot msub msup msubsup munder mover munderover semantics".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

#: Cues of tags and attribute tokens.
CUES = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs toc topbar pagination tabs skip",
    "header": "header masthead banner head site branding logo",
    "footer": "footer foot copyright colophon bottom legal",
    "side": "aside sidebar side widget related recommended rail trending popular teaser",
    "notice": "notice cookie consent alert popup modal newsletter subscribe gdpr message warning overlay",
    "advert": "ad ads advert advertisement sponsor sponsored promo banner adsense commercial advertising",
    "form": "form input select textarea button fieldset login search signup option label",
    "comment": "comment comments reply replies discussion disqus respond commentlist",
    "share": "share social follow tags meta byline author",
    "content": "article main content post entry story body text",
}
_CUE_OF: dict[str, list[int]] = {}
for _i, _words in enumerate(CUES.values()):
    for _w in _words.split():
        _CUE_OF.setdefault(_w, []).append(_i)
TAGS = ["p", "h1", "h2", "h3", "li", "ul", "a", "div", "section", "span", "td", "blockquote", "body"]

_NAME = re.compile(r"[\s/>]")
_SPECIAL = re.compile(r"[>\"']")
_COMMENT = re.compile(r"-?>|.*?(?:--!?>|$)", re.S)
_ATTR = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


@dataclass
class Page:
    """Elements in page order (parents first) and texts with their element; an empty text is a block border."""

    tags: list[str] = field(default_factory=list)
    attrs: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    texts: list[tuple[int, str]] = field(default_factory=list)


class Marks:
    """Markup of a page in time that grows with its length alone, whatever is left open in it.

    A tag ends at the first ``>`` outside quotes. If there is none, its ``<`` is text. Places that a failed search has passed outside quotes are
    remembered: another search that comes to one of them has failed too.
    """

    def __init__(self, source: str) -> None:
        self.source = source
        self._failed: set[int] = set()
        self._next = {_NAME: (0, -1), _SPECIAL: (0, -1)}

    def _first(self, pattern: re.Pattern, at: int) -> int:
        """The first match from ``at`` on, the end of the page if there is none; ``at`` never falls, so that stretches are searched once."""
        low, found = self._next[pattern]
        if not low <= at <= found:
            m = pattern.search(self.source, at)
            found = m.start() if m else len(self.source)
            self._next[pattern] = at, found
        return found

    def _closed(self, at: int) -> int:
        """The ``>`` of a tag whose name ends at ``at``, or -1."""
        source, passed = self.source, []
        at = self._first(_SPECIAL, at)
        while at < len(source) and at not in self._failed:
            if source[at] == ">":
                return at
            passed.append(at)
            quote = source.find(source[at], at + 1)
            m = _SPECIAL.search(source, quote + 1) if quote >= 0 else None
            at = m.start() if m else len(source)
        self._failed.update(passed)
        return -1

    def __iter__(self) -> Iterator[tuple[int, int, str, str, str]]:
        """(start, end, kind, tag, attributes) of each piece of markup; kinds are open, raw (with what it holds), close and other."""
        source, at = self.source, self.source.find("<")
        last = source.rfind(">")
        while 0 <= at < len(source) - 1:
            end, kind, tag, attrs = -1, "other", "", ""
            slash = source[at + 1] == "/"
            begin = at + 1 + slash
            if source.startswith("<!--", at):
                end = _COMMENT.match(source, at + 4).end()
            elif "a" <= source[begin : begin + 1].lower() <= "z":
                stop = self._first(_NAME, begin)
                if (closed := self._closed(stop) if stop < last + 1 else -1) >= 0:
                    end, tag, attrs, kind = closed + 1, source[begin:stop].lower(), source[stop:closed], "close" if slash else "open"
                    if not slash and tag in RAW:
                        kind = "raw"
                        m = _RAW_END[tag].search(source, end)
                        end = m.end() if m else len(source)
            if end < 0 and source[at + 1] in "!?/" and at < last:
                end = source.find(">", at) + 1
            if end > 0:
                yield at, end, kind, tag, attrs
            at = source.find("<", end if end > 0 else at + 1)


def parse(source: str) -> Page:
    page = Page(["root"], [""], [-1])
    stack = [0]
    hidden = 0
    opened: Counter[str] = Counter()

    def close(to: int) -> None:
        nonlocal hidden
        while len(stack) > to:
            tag = page.tags[stack.pop()]
            opened[tag] -= 1
            hidden -= tag in HIDDEN
            if tag not in INLINE:
                page.texts.append((stack[-1] if stack else 0, ""))

    def leave_head() -> None:
        if page.tags[stack[-1]] == "head":
            close(len(stack) - 1)

    def text(part: str) -> None:
        if part.strip(" \t\n\f\r"):
            leave_head()
        if part and not hidden:
            page.texts.append((stack[-1], entities.unescape(part)))

    at = 0
    for start, end, kind, tag, attrs in Marks(source):
        text(source[at:start])
        at = end
        if kind in ("open", "raw") and tag not in HEAD:
            leave_head()
        if kind in ("raw", "other"):
            continue
        if kind == "close":
            for i in range(len(stack) - 1 if opened[tag] else 0, 0, -1):
                if page.tags[stack[i]] == tag:
                    close(i)
                    break
            continue
        if tag in CLOSES_P or tag in SAME:
            ends, walls = ({"p"}, {"table", "body", "td", "th", "li", "button"}) if tag in CLOSES_P else (SAME[tag], SCOPE[tag])
            for i in range(len(stack) - 1 if any(opened[e] for e in ends) else 0, 0, -1):
                if page.tags[stack[i]] in ends:
                    close(i)
                    break
                if page.tags[stack[i]] in walls:
                    break
        if tag not in INLINE:
            page.texts.append((stack[-1], ""))
        if tag in VOID:
            continue
        page.tags.append(tag)
        page.attrs.append(attrs)
        page.parents.append(stack[-1])
        stack.append(len(page.tags) - 1)
        opened[tag] += 1
        hidden += tag in HIDDEN
        if attrs.endswith("/") and tag in HIDDEN:
            close(len(stack) - 1)
    text(source[at:])
    close(1)
    return page


def _cues(page: Page) -> np.ndarray:
    out = np.zeros((len(page.tags), len(CUES)), bool)
    for i, (tag, attrs) in enumerate(zip(page.tags, page.attrs, strict=True)):
        words = [tag]
        if attrs:
            for m in _ATTR.finditer(attrs):
                words += _WORD.findall((m[1] or m[2] or m[3] or "").lower())
        for w in words:
            for c in _CUE_OF.get(w, ()):
                out[i, c] = True
    return out


def features(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """A row for each element, and the letters directly in it."""
    n = len(page.tags)
    parent = np.array(page.parents)
    own = np.zeros((n, 5))  # characters, link characters, stops, digits, text runs
    link = [False] * n
    for i in range(1, n):
        link[i] = page.tags[i] == "a" or link[parent[i]]
    first = np.full(n, -1.0)
    done = 0
    for node, text in page.texts:
        if text and (size := len(text.strip())):
            own[node] += (size, size * link[node], sum(map(text.count, ".,!?;")), sum(map(str.isdigit, text)) if size < 400 else 0, 1)
            if first[node] < 0:
                first[node] = done
            done += size
    total = own.copy()
    tags, paragraphs, children, depth = np.ones(n), np.array([t == "p" for t in page.tags], float), np.zeros(n), np.zeros(n)
    for i in range(n - 1, 0, -1):
        p = parent[i]
        total[p] += total[i]
        tags[p] += tags[i]
        paragraphs[p] += paragraphs[i]
        children[p] += 1
        if first[i] >= 0 and (first[p] < 0 or first[i] < first[p]):
            first[p] = first[i]
    rank, same = np.zeros(n), np.zeros(n)
    seen: dict[int, int] = {}
    alike: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        depth[i] = depth[parent[i]] + 1
        rank[i] = seen[parent[i]] = seen.get(parent[i], -1) + 1
        alike[parent[i], page.tags[i]] = alike.get((parent[i], page.tags[i]), 0) + 1
    for i in range(1, n):
        same[i] = alike[parent[i], page.tags[i]]
    cues = _cues(page)
    above = np.zeros_like(cues)
    for i in range(1, n):
        above[i] = above[parent[i]] | cues[parent[i]]
    up = np.maximum(parent, 0)
    chars = total[:, 0]
    safe = np.maximum(chars, 1)
    columns = [
        depth, children, rank, children[up], rank / np.maximum(children[up], 1), same / np.maximum(children[up], 1), np.log1p(chars), np.log1p(own[:, 0]), chars / max(1, chars[0]),
        chars / np.maximum(chars[up], 1), np.log1p(tags), chars / tags, total[:, 1] / safe, np.log1p(paragraphs), chars / np.maximum(total[:, 4], 1), total[:, 2] / safe, total[:, 3] / safe,
        first / max(1, chars[0]), *(np.array([t == tag for t in page.tags], float) for tag in TAGS), *cues.T, *above.T,
    ]
    return np.stack(columns, 1).astype(np.float32), own[:, 0]


# --- boosted trees ---------------------------------------------------------------------------------------------------------------


@dataclass
class Trees:
    """Complete binary trees: feature and threshold of each inner node, value of each leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float
    depth: int

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 2.0) -> Trees:
    """Log-loss boosting with second-order leaf values over quantile bins."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], 1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    score = np.full(len(y), start)
    feature, threshold, leaf = [], [], []
    n_inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        f, t, at = np.zeros(n_inner, np.int64), np.full(n_inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            low = 2**level - 1
            here = at - low
            best = np.zeros(2**level)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                cell = here * bins + binned[:, j]
                gs = np.bincount(cell, g, 2**level * bins).reshape(-1, bins).cumsum(1)
                hs = np.bincount(cell, h, 2**level * bins).reshape(-1, bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = (gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge))[:, : len(c)]
                k = gain.argmax(1)
                better = gain[np.arange(2**level), k] > best + 1e-9
                best[better] = gain[np.arange(2**level), k][better]
                f[low : low + 2**level][better] = j
                t[low : low + 2**level][better] = c[k[better]]
            at = 2 * at + 1 + (x[np.arange(len(y)), f[at]] > t[at])
        here = at - n_inner
        value = rate * np.bincount(here, g, 2**depth) / (np.bincount(here, h, 2**depth) + ridge)
        score += value[here]
        feature.append(f)
        threshold.append(t)
        leaf.append(value)
    return Trees(np.array(feature), np.array(threshold), np.array(leaf), start, depth)


# --- training pages --------------------------------------------------------------------------------------------------------------

CONTENT_WRAPS = ["article", "main", "div class='content'", "div id='main-content'", "section class='post-body'", "div class='entry'", "div class='story-text'", "div", "section", "div class='c1'"]
NOISE = {
    "links": ["nav", "div class='menu'", "ul class='navbar'", "div class='breadcrumbs'", "aside", "div class='related'", "div class='sidebar'", "div class='widget'", "header", "footer", "div class='tags'", "div class='share'", "menu", "section class='recommended'", "div"],
    "line": ["header", "footer", "div class='ad'", "div class='notice'", "div class='cookie-consent'", "div id='banner'", "p class='copyright'", "div class='promo'", "aside class='advert'", "div class='newsletter'", "div role='alert'", "div class='site-header'", "div class='sponsored'", "section class='popup'"],
    "text": ["aside", "div class='sidebar'", "div class='ad'", "div class='advertisement'", "footer", "div class='widget'", "div id='notice'", "section class='promo'"],
    "form": ["form", "div class='search'", "form class='login'", "div class='subscribe'"],
    "comments": ["section class='comments'", "div id='comments'", "ol class='commentlist'", "div class='discussion'", "section id='reader-comments'"],
}


def _noise(rng: random.Random, words: list[str]) -> str:
    kind = rng.choice(list(NOISE))
    wrap = rng.choice(NOISE[kind])
    some = lambda a, b: entities.escape(" ".join(rng.choice(words) for _ in range(rng.randint(a, b))))
    if kind == "links":
        inner = "".join(f"<li><a href='/x'>{some(1, 3)}</a></li>" if rng.random() < 0.7 else f"<a href='/x'>{some(1, 4)}</a> " for _ in range(rng.randint(3, 10)))
        inner = f"<ul>{inner}</ul>" if rng.random() < 0.7 else inner
    elif kind == "line":
        inner = some(3, 20) if rng.random() < 0.4 else f"<{(tag := rng.choice(['p', 'p', 'h1', 'h2', 'div', 'span']))}>{some(1, 25)}</{tag}>" + f"<p>{some(2, 20)}</p>" * (rng.random() < 0.4)
    elif kind == "text":
        inner = "".join(f"<h3>{some(1, 5)}</h3>" * (rng.random() < 0.4) + f"<p>{some(5, 50)}</p>" for _ in range(rng.randint(1, 3)))
    elif kind == "form":
        inner = f"<label>{some(1, 4)}</label><input name='q'><p>{some(3, 12)}</p><button>{some(1, 2)}</button>"
    else:
        inner = f"<h2>{some(1, 3)}</h2>" + "".join(f"<div class='comment'><b>{some(1, 2)}</b><p>{some(5, 60)}</p></div>" for _ in range(rng.randint(1, 6)))
    return f"<{wrap} data-label='0'>{inner}</{wrap.split()[0]}>"


def _article(page: Page) -> list[str]:
    """Blocks of the page's article: of its article or main element, else of the element with most text in paragraphs directly below."""
    tops = [i for i, t in enumerate(page.tags) if t in ("article", "main")]
    if not tops:
        sizes: dict[int, int] = {}
        for node, text in page.texts:
            if page.tags[node] == "p":
                sizes[page.parents[node]] = sizes.get(page.parents[node], 0) + len(text)
        tops = [max(sizes, key=sizes.get)] if sizes else []
    if not tops:
        return []
    inside = {tops[0]}
    for i in range(tops[0] + 1, len(page.tags)):
        if page.parents[i] in inside:
            inside.add(i)
    blocks = [""]
    for node, text in page.texts:
        if node in inside:
            blocks[-1] += text
            if not text:
                blocks.append("")
    return [b for b in (" ".join(b.split()) for b in blocks) if b]


def _variant(rng: random.Random, blocks: list[str], words: list[str]) -> str:
    bare = rng.random() < 0.12
    wrap, mark = ("body", " data-label='1'") if bare else (rng.choice(CONTENT_WRAPS), "")
    some = blocks[: rng.choice([1, 2, 4, 8, len(blocks)])]
    parts = [f"<h1{mark}>{entities.escape(some[0])}</h1>"] * (rng.random() < 0.8)
    for b in some:
        inner = f"<b>{entities.escape(b)}</b><br>" if rng.random() < 0.1 else entities.escape(b)
        tag = rng.choice(["p"] * 8 + ["blockquote", "h2", "div", "pre"])
        parts.append(f"<{tag}{mark}>{inner}</{tag}>" if rng.random() < 0.9 else f"<ul{mark}><li>{inner}</li></ul>")
        if rng.random() < 0.06:
            parts.append(_noise(rng, words))
    body = "".join(parts) if bare else f"<{wrap} data-label='1'>{''.join(parts)}</{wrap.split()[0]}>"
    for _ in range(rng.randint(0, 2)):
        body = f"<div class='{rng.choice(['wrapper', 'page', 'container', 'row', 'col'])}' data-label='2'>{_noise(rng, words) * (rng.random() < 0.5)}{body}{_noise(rng, words) * (rng.random() < 0.5)}</div>"
    before, after = ("".join(_noise(rng, words) for _ in range(rng.randint(0, 3))) for _ in range(2))
    return f"<html><head><title>x</title></head><body>{before}{body}{after}</body></html>"


def train(sources: list[str], variants: int = VARIANTS) -> Trees | None:
    """Trees from the articles of some pages; None if they have none."""
    rng = random.Random(7)
    articles = [b for b in map(_article, map(parse, sources)) if b]
    words = [w for blocks in articles for b in blocks[:8] for w in b.split()[:60]]
    if not words:
        return None
    xs, ys = [], []
    for blocks in articles:
        for _ in range(variants):
            page = parse(_variant(rng, blocks, words))
            x, _ = features(page)
            label = np.full(len(page.tags), 2)
            for i in range(1, len(page.tags)):
                m = re.search(r"data-label='(\d)'", page.attrs[i])
                label[i] = int(m[1]) if m else label[page.parents[i]]
            xs.append(x[label < 2])
            ys.append(label[label < 2])
    return boost(np.concatenate(xs), np.concatenate(ys).astype(float))


# --- decoding --------------------------------------------------------------------------------------------------------------------

CONTAINER, ARTICLE, DROPPED = 0, 1, 2
#: What dropping an element costs inside the article, so that a short paragraph needs a reason.
SWITCH = 4.0
#: What it costs to leave the choice to the elements below.
CONTAIN = 3.0


def decode(parents: list[int], odds: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Labels, never falling from parent to child, with the highest sum of weighted log-odds. An element with text of its own is no container."""
    n = len(parents)
    weight = 0.3 + np.log1p(chars)
    odds = np.clip(odds, -6, 6)
    gain = np.stack([np.where(chars > 0, -1e9, -CONTAIN), odds * weight, -odds * weight], 1)
    gain[0] = (0, odds[0] * weight[0] * (chars[0] > 0), -odds[0] * weight[0] * (chars[0] > 0))
    if chars[0]:
        gain[0, CONTAINER] = -1e9
    best = gain.copy()
    for i in range(n - 1, 0, -1):
        best[parents[i]] += (best[i].max(), max(best[i, ARTICLE], best[i, DROPPED] - SWITCH), best[i, DROPPED])
    label = np.zeros(n, np.int64)
    for i in range(n):
        low = label[parents[i]] if i else CONTAINER
        label[i] = low + int((best[i, low:] - (0, SWITCH)[: 3 - low] if low == ARTICLE else best[i, low:]).argmax())
    return label


def main_text(page: Page, label: np.ndarray) -> str:
    return " ".join("".join(text or " " for node, text in page.texts if not text or label[node] == ARTICLE).split())


def extract(sources: list[str | None], model: Trees | None) -> list[str]:
    pages = [parse(s or "") for s in sources]
    if model is None:
        return [main_text(p, np.full(len(p.tags), ARTICLE)) for p in pages]
    rows = [features(p) for p in pages]
    odds = model(np.concatenate([x for x, _ in rows])) if rows else np.zeros(0)
    out, at = [], 0
    for page, (x, chars) in zip(pages, rows, strict=True):
        out.append(main_text(page, decode(page.parents, odds[at : at + len(x)], chars)))
        at += len(x)
    return out


def learn(pages: DataFrame, sample: int = SAMPLE_PAGES, most_bytes: int = SAMPLE_BYTES) -> Trees | None:
    """Trees from ``sample`` pages, picked by a hash of their html, so that the same table always gives the same pages."""
    short = pages.select("html", F.xxhash64("html").alias("h")).where(F.octet_length("html") <= most_bytes)
    picked = [r["h"] for r in short.select("h").distinct().orderBy("h").limit(sample).collect()]
    rows = short.where(F.col("h").isin(picked)).groupBy("h").agg(F.min("html").alias("html")) if picked else short
    return train([r["html"] for r in rows.orderBy("h").collect()])


def extracted(pages: DataFrame, model: Trees | None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (None: all) with text and n_chars."""
    names = [c for c in (pages.columns if keep is None else keep) if c not in ("text", "n_chars")]
    rows = pages.select(*dict.fromkeys([*names, "html"]))
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = extract(part.column("html").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*names, "text", "n_chars"])

    schema = T.StructType([*(f for c in names for f in rows.schema if f.name == c), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(run, schema)
