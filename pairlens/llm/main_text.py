"""Main text of web pages by boosted trees over DOM nodes (operator 5).

1. Pages are parsed to a DOM (implied end tags, void and raw-text elements,
   broken and truncated markup).
2. Every element gets features: depth, subtree sizes, text and link density,
   punctuation, counts and place among siblings, tag group, and evidence of
   content or boilerplate in its own and its ancestors' tags and attribute
   tokens.
3. Gradient-boosted trees are trained on a bounded sample (``train_pages``
   pages of the smallest hash of their html). Targets come from nodes whose
   markup is plain (an article, a navigation, an advert class and what lies
   below). Copies with shapes swapped between nodes teach that such markup
   counts whatever the shape; copies without markup teach density and shape.
4. Hierarchical decoding: each element is wrapper, content or boilerplate.
   A wrapper may hold anything, content holds content or boilerplate, and all
   below boilerplate is boilerplate. The best assignment of a page is found
   bottom-up; text directly in content is the page's text. In a fragment
   (text beside the topmost elements, no html or body) the root may be the
   article, and is where no block element is content.

Character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined in page order by one space.

Defined cases: null, empty and markup-free html has no text (plain text
without any tag is no article); repeated rows give equal rows; very long
pages are read whole; an empty table gives no rows; other columns of the
input are not carried.
"""

from __future__ import annotations

import functools
import html as html_lib
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe".split())
#: Elements whose content has its own rules: a "/" closes a tag there, and some elements aren't shown.
FOREIGN = frozenset(("svg", "math"))
HTML_AGAIN = frozenset("foreignobject desc mi mn mo ms mtext".split())     # HTML inside them
FOREIGN_RAW = frozenset("annotation annotation-xml desc metadata".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure "
                  "footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section select "
                  "summary table tbody td text tfoot th thead tr ul video audio canvas button label legend".split())
#: Elements whose start ends an open p.
ENDS_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements that end an open one of their kind, up to a container.
ENDS_OWN = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
            "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
CONTENT_TAGS = frozenset(("article", "main"))
BOILER_TAGS = frozenset("nav header footer aside form button select dialog menu head label fieldset input".split())
CONTENT_TOKENS = frozenset("article content entry main post story body text maincontent articlebody".split())
BOILER_TOKENS = frozenset(
    "ad ads advert adverts advertisement adverb banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disclaimer discuss discussion disqus footer footnote form gdpr header login masthead menu modal nav navbar navigation "
    "newsletter notice notices pagination pager popup privacy promo promotion reactions reader recommended related replies "
    "reply respond responses search share sharing sidebar signup social sponsor sponsored subscribe tags teaser toolbar "
    "topbar widget widgets".split())
#: First pieces of class names that say what a page lacks or has, or what it is filed under.
SAYS_OF_PAGE = frozenset("no not non has have with without hide show tag category cat tax term topic type format status".split())
#: Attributes whose words are evidence.
TOKEN_ATTRS = frozenset(("class", "id", "itemprop", "aria-label"))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())

# Comments, tags and declarations by HTML's own rules, each to its end or the end of the page. Quantifiers are
# possessive, so a tag is read once. A quote counts only behind "=", and runs to the next one, wherever that is.
_VALUE = r"""(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)"""
_TAG = re.compile(rf"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+{_VALUE}?+)*+)(?:>|(\Z))"""
                  r"""|(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z))""", re.S)
#: One attribute: its name and, quoted or bare, its value.
_ATTR = re.compile(r"""([^\s/=>]+)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?""")
_TELLS = re.compile(r"class|id|itemprop|aria|role|hidden", re.I)
_TOKEN = re.compile(r"[a-z]+")


@dataclass
class Node:
    tag: str
    parent: int
    attrs: str = ""
    parts: list = field(default_factory=list)     # str, or int of a child
    end: int = 0                                  # nodes below lie in (own, end)
    closed: bool = False                          # by its own end tag


@functools.lru_cache(maxsize=None)
def _end_tag(tag: str) -> re.Pattern:
    """The end tag of a raw element (there are few kinds)."""
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>", re.I)


def parse(text: str) -> list[Node]:
    """The elements of a page in document order; node 0 is the root. Work is
    linear in the page: a search that can find nothing isn't made twice."""
    nodes = [Node("#root", -1)]
    stack = [0]
    open_tags: Counter = Counter()      # open elements by tag
    unended: set[str] = set()           # raw tags with no end tag in the rest of the page
    rules: list[str] = []       # of the open elements, those that begin or end foreign rules
    at = 0

    def close_to(depth: int):
        while len(stack) > depth:
            x = nodes[stack.pop()]
            x.end = len(nodes)
            open_tags[x.tag] -= 1
            if x.tag in FOREIGN or x.tag in HTML_AGAIN:
                rules.pop()

    def foreign() -> bool:
        return bool(rules) and rules[-1] in FOREIGN

    while True:
        m = _TAG.search(text, at)
        if m is None:
            rest = text[at:]
            # a lone "</" or "<" at the very end is markup cut off
            nodes[stack[-1]].parts.append(rest.removesuffix("</").removesuffix("<"))
            break
        if m.start() > at:
            nodes[stack[-1]].parts.append(text[at:m.start()])
        at = m.end()
        if not m.group(2) or m.group(4) is not None:        # a tag cut off by the end of the page is none
            continue
        tag = m.group(2).lower()
        if m.group(1):
            if open_tags[tag]:
                for d in range(len(stack) - 1, 0, -1):
                    if nodes[stack[d]].tag == tag:
                        nodes[stack[d]].closed = True
                        close_to(d)
                        break
            continue
        if tag in ENDS_P and open_tags["p"]:
            for d in range(len(stack) - 1, 0, -1):
                t = nodes[stack[d]].tag
                if t == "p":
                    close_to(d)
                    break
                if t in ENDS_P or t in ("td", "th", "li", "button", "body"):
                    break
        if tag in ENDS_OWN:
            ends, stop = ENDS_OWN[tag]
            for d in range(len(stack) - 1, 0, -1) if any(open_tags[t] for t in ends) else ():
                t = nodes[stack[d]].tag
                if t in stop:
                    break
                if t in ends:
                    close_to(d)
                    break
        n = len(nodes)
        attrs = m.group(3)
        nodes.append(Node(tag, stack[-1], attrs))
        nodes[stack[-1]].parts.append(n)
        closed = attrs.rstrip().endswith("/") and (tag in FOREIGN or foreign())
        stop = None
        if not closed and (tag in RAW or tag in FOREIGN_RAW and foreign()) and tag not in unended:
            stop = _end_tag(tag).search(text, at)
            if stop is None:
                unended.add(tag)
        if tag in VOID or closed:
            nodes[n].end = n + 1
        elif stop or tag in RAW:
            at = stop.end() if stop else len(text)
            nodes[n].end = n + 1
        else:
            stack.append(n)
            open_tags[tag] += 1
            if tag in FOREIGN or tag in HTML_AGAIN:
                rules.append(tag)
    close_to(0)
    return nodes


def evidence(node: Node) -> tuple[int, int]:
    """(content, boilerplate) signs in an element's own markup."""
    content, boiler = _evidence(node.tag, node.attrs if node.attrs and _TELLS.search(node.attrs) else "")
    # a message for those without scripts; where its end tag is missing, the page goes on inside
    return content, boiler + (node.tag == "noscript" and node.closed)


@functools.lru_cache(maxsize=100_000)
def _evidence(tag: str, attrs: str) -> tuple[int, int]:
    if tag in ("html", "body"):      # classes there describe the page, not its parts
        return 0, 0
    content, boiler = int(tag in CONTENT_TAGS), int(tag in BOILER_TAGS)
    for m in _ATTR.finditer(attrs) if attrs else ():
        name, value = m.group(1).lower(), (m.group(2) or m.group(3) or m.group(4) or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            boiler += 1
        elif name == "role":
            boiler += value in ROLES
            content += value in ("main", "article")
        elif name in TOKEN_ATTRS:
            got = set()
            for token in value.split():
                pieces = _TOKEN.findall(token)
                if len(pieces) < 2 or pieces[0] not in SAYS_OF_PAGE:
                    got.update(pieces)
            boiler += len(got & BOILER_TOKENS)
            content += len(got & CONTENT_TOKENS)
    return content, boiler


FEATURES = ("depth", "text", "own_text", "density", "link_share", "stops", "mean_run", "children", "place", "alike",
            "paragraphs", "heading", "paragraph", "list", "inline", "grow", "start", "content", "boiler",
            "content_above", "boiler_above")
#: Share of a page's text that an element must hold for its signs of boilerplate to be void.
HELD = 0.3
HIDDEN = [FEATURES.index(f) for f in ("content", "boiler", "content_above", "boiler_above")]


def node_features(nodes: list[Node]) -> np.ndarray:
    """One row of :data:`FEATURES` per node. Signs of boilerplate on an element
    that holds all text with signs of content, and ``HELD`` of the page's
    text, don't count: it wraps the article (a form around the whole page)."""
    n = len(nodes)
    own, stops, runs, kids, para, begin = ([0.0] * n for _ in range(6))
    depth, place, alike = ([0.0] * n for _ in range(3))
    good, bad = [0] * n, [0] * n
    at = 0.0
    for i, x in enumerate(nodes):
        if x.parent >= 0:
            depth[i] = depth[x.parent] + 1
            good[i], bad[i] = evidence(x)
        same: dict[str, int] = {}
        k = 0
        for part in x.parts:
            if part.__class__ is str:
                solid = sum(map(len, part.split()))
                if solid:
                    own[i] += solid
                    stops[i] += part.count(".") + part.count(",")
                    runs[i] += 1
            else:
                t = nodes[part].tag
                place[part] = k
                k += 1
                same[t] = same.get(t, 0) + 1
        kids[i] = k
        if k:
            for part in x.parts:
                if part.__class__ is not str:
                    alike[part] = same[nodes[part].tag]
            para[i] = same.get("p", 0)
        begin[i] = at
        at += own[i]
    total, dots, run, below, link = own.copy(), stops.copy(), runs.copy(), [1.0] * n, [0.0] * n
    told = [0.0] * n                    # text below with signs of content
    for i in range(n - 1, 0, -1):       # children come after their parent
        p = nodes[i].parent
        if nodes[i].tag == "a":
            link[i] = total[i]
        if good[i] and not bad[i]:
            told[i] = total[i]
        total[p] += total[i]
        dots[p] += dots[i]
        run[p] += run[i]
        below[p] += below[i]
        link[p] += link[i]
        told[p] += told[i]
    above_good, above_bad = [0] * n, [0] * n
    for i in range(1, n):
        if bad[i] and told[i] and told[i] == told[0] and told[i] >= HELD * total[0]:
            bad[i] = 0
        p = nodes[i].parent
        above_good[i], above_bad[i] = above_good[p] + good[p], above_bad[p] + bad[p]
    own, stops, runs, kids, para, begin, depth, place, alike, total, dots, run, below, link = map(np.array, (
        own, stops, runs, kids, para, begin, depth, place, alike, total, dots, run, below, link))
    safe = np.maximum(total, 1)
    parent = np.array([max(x.parent, 0) for x in nodes])
    tag = lambda group: np.array([x.tag in group for x in nodes], float)
    return np.column_stack([
        depth, np.log1p(total), np.log1p(own), total / below, link / safe, dots / safe * 50,
        np.log1p(total / np.maximum(run, 1)), np.log1p(kids), place, np.log1p(alike), np.log1p(para),
        tag({"h1", "h2", "h3", "h4", "h5", "h6"}), tag({"p", "blockquote", "pre"}), tag({"ul", "ol", "li", "menu", "dl"}),
        tag({"a", "b", "i", "em", "strong", "span", "u", "small", "br", "img", "code", "sub", "sup"}),
        total / np.maximum(total[parent], 1), begin / max(1.0, at), good, bad, above_good, above_bad])


def weak_targets(nodes: list[Node], x: np.ndarray) -> np.ndarray:
    """1 in plain content, 0 in plain boilerplate, -1 where markup doesn't tell."""
    content, boiler = x[:, HIDDEN[0]] + x[:, HIDDEN[2]], x[:, HIDDEN[1]] + x[:, HIDDEN[3]]
    return np.where(boiler > 0, 0, np.where(content > 0, 1, -1))


@dataclass
class Trees:
    """Boosted regression trees of fixed depth over binned features, logistic loss."""
    edges: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]     # feature, bin and leaf values, heap order
    base: float
    rate: float
    depth: int

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)])

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feat, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feat[node]] > cut[node])
            out += self.rate * leaf[node - (2 ** self.depth - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, n_trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32,
              l2: float = 1.0) -> Trees:
    """Second-order gradient boosting by histograms."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0)
             for j in range(x.shape[1])]
    mean = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    model = Trees(edges, [], float(np.log(mean / (1 - mean))), rate, depth)
    if not len(x):
        return model
    b = model.bins(x)
    width = bins + 1
    margin = np.full(len(x), model.base)
    inner = 2 ** depth - 1
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feat, cut = np.zeros(inner, np.int64), np.full(inner, width, np.int64)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, n_nodes = 2 ** level - 1, 2 ** level
            best = np.zeros(n_nodes)
            for j in range(x.shape[1]):
                slot = (node - first) * width + b[:, j]
                gs = np.bincount(slot, g, n_nodes * width).reshape(n_nodes, width)
                hs = np.bincount(slot, h, n_nodes * width).reshape(n_nodes, width)
                gl, hl = gs.cumsum(1), hs.cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl ** 2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt ** 2 / (ht + l2)
                top = gain.argmax(1)
                value = gain[np.arange(n_nodes), top]
                better = value > best + 1e-9
                best[better] = value[better]
                feat[first:first + n_nodes][better] = j
                cut[first:first + n_nodes][better] = top[better]
            node = 2 * node + 1 + (b[np.arange(len(x)), feat[node]] > cut[node])
        leaf_of = node - inner
        gs, hs = np.bincount(leaf_of, g, inner + 1), np.bincount(leaf_of, h, inner + 1)
        leaf = -gs / (hs + l2)
        model.trees.append((feat, cut, leaf))
        margin += rate * leaf[leaf_of]
    return model


WRAPPER, CONTENT, BOILER = 0, 1, 2


def is_fragment(nodes: list[Node]) -> bool:
    """Text lies beside the elements at the top, and none of them is html or body."""
    top = nodes[0].parts
    return (any(isinstance(p, str) and p.strip() for p in top)
            and not any(nodes[p].tag in ("html", "body") for p in top if not isinstance(p, str)))


def decode(nodes: list[Node], margin: np.ndarray, weight: np.ndarray, root: int | None = WRAPPER) -> list[int]:
    """The best consistent state of every node. A node's own score for being
    content is its margin times its weight; wrapper and boilerplate are the
    other side, and boilerplate ends the subtree's choice. The root
    has the state ``root``, or (None) the better of wrapper and content."""
    n = len(nodes)
    pos = -np.logaddexp(0, -margin) * weight
    neg = -np.logaddexp(0, margin) * weight
    wrap, cont, boil = (neg - 1e-6).tolist(), pos.tolist(), neg.tolist()     # a wrapper only where something below is content
    for i in range(n - 1, 0, -1):
        w, c, b = wrap[i], cont[i], boil[i]
        p = nodes[i].parent
        boil[p] += b
        cont[p] += max(c, b)
        wrap[p] += max(w, c, b)
    state = [BOILER] * n
    state[0] = root if root is not None else CONTENT if cont[0] >= wrap[0] else WRAPPER
    for i in range(1, n):
        above = state[nodes[i].parent]
        if above == CONTENT:
            state[i] = CONTENT if cont[i] >= boil[i] else BOILER
        elif above == WRAPPER:
            best = max(wrap[i], cont[i], boil[i])
            state[i] = WRAPPER if wrap[i] == best else CONTENT if cont[i] == best else BOILER
    return state


def text_of(nodes: list[Node], state: np.ndarray) -> str:
    """Blocks of the content nodes' text, in page order."""
    out: list[str] = []

    def walk(top: int):
        stack = [(top, 0)]
        while stack:
            i, k = stack.pop()
            x = nodes[i]
            if k == 0 and x.tag in BLOCK:
                out.append("\n")
            while k < len(x.parts):
                part = x.parts[k]
                k += 1
                if isinstance(part, str):
                    if state[i] == CONTENT:
                        out.append(html_lib.unescape(part))
                else:
                    stack.append((i, k))
                    stack.append((part, 0))
                    break
            else:
                if x.tag in BLOCK:
                    out.append("\n")
    walk(0)
    return " ".join("".join(out).split())


def extract(html: str | None, model: Trees) -> str:
    return extract_all([html], model)[0]


def extract_all(pages: list[str | None], model: Trees) -> list[str]:
    """The main text of each page; the trees score all pages' nodes at once."""
    parsed = [parse(p) if p else [] for p in pages]
    read = [i for i, nodes in enumerate(parsed) if len(nodes) > 1]
    out = [""] * len(pages)
    if not read:
        return out
    features = [node_features(parsed[i]) for i in read]
    margins = np.split(model.margin(np.concatenate(features)), np.cumsum([len(x) for x in features])[:-1])
    for i, x, margin in zip(read, features, margins):
        out[i] = _text(parsed[i], x, margin, model)
    return out


def _text(nodes: list[Node], x: np.ndarray, margin: np.ndarray, model: Trees) -> str:
    weight = np.log1p(np.expm1(x[:, FEATURES.index("own_text")])) + 0.05
    fragment = is_fragment(nodes)
    state = decode(nodes, margin, weight, None if fragment else WRAPPER)
    if fragment and (state[0] == CONTENT or not any(s == CONTENT and nodes[i].tag in BLOCK for i, s in enumerate(state))):
        # the root is the article, as if its markup said so
        x[0, HIDDEN[0]] += 1
        x[1:, HIDDEN[2]] += 1
        state = decode(nodes, model.margin(x), weight, CONTENT)
    return text_of(nodes, state)


def fit_pages(df: DataFrame, html_col: str = "html", train_pages: int = 400, seed: int = 3,
              train_nodes: int = 2000) -> Trees:
    """Trees from a bounded sample: at most ``train_pages`` pages, and of each
    at most ``train_nodes`` nodes, evenly from its first to its last."""
    src = df.select(F.col(html_col).cast("string").alias("_html")).filter(F.col("_html").isNotNull())
    pick = (src.select(F.xxhash64(F.lit(seed), "_html").alias("_k")).distinct().orderBy("_k").limit(train_pages))
    rows = (src.withColumn("_k", F.xxhash64(F.lit(seed), "_html")).join(F.broadcast(pick), "_k")   # train_pages rows
            .dropDuplicates(["_k"]))

    def fn(cols):
        got = []
        for t in cols["_html"].to_pylist():
            nodes = parse(t)
            x = node_features(nodes)
            y = weak_targets(nodes, x)
            at = np.flatnonzero(y >= 0)
            if len(at) > train_nodes:       # a page of very many nodes doesn't outweigh the sample
                at = at[np.linspace(0, len(at) - 1, train_nodes).astype(int)]
            got.append((x[at], y[at]))
        return {"_k": cols["_k"], "x": [g[0].ravel() for g in got], "y": [g[1] for g in got]}

    got = sorted(arrow_map(rows, fn, "_k bigint, x array<double>, y array<bigint>").collect(), key=lambda r: r["_k"])
    x = np.concatenate([np.array(r["x"]).reshape(-1, len(FEATURES)) for r in got]) if got else np.empty((0, len(FEATURES)))
    y = np.concatenate([np.array(r["y"], float) for r in got]) if got else np.empty(0)
    # markup with the shape of another node: where markup tells, it tells whatever the shape;
    # and shape without markup
    other = x[np.random.default_rng(seed).permutation(len(x))]
    other[:, HIDDEN] = x[:, HIDDEN]
    hidden = x[::2].copy()
    hidden[:, HIDDEN] = 0
    nested = other[y == 0]              # boilerplate stays so inside content
    nested[:, HIDDEN[2]] += 1
    return fit_trees(np.concatenate([x, other, nested, hidden]), np.concatenate([y, y, np.zeros(len(nested)), y[::2]]))


def main_text(df: DataFrame, model: Trees | None = None, id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page, one pass after the fit."""
    model = fit_pages(df, html_col) if model is None else model
    shared = df.sparkSession.sparkContext.broadcast(model)

    def fn(cols):
        text = extract_all(cols["_html"].to_pylist(), shared.value)
        return {"_id": cols["_id"], "_url": cols["_url"], "text": text, "n_chars": [len(t) for t in text]}

    src = df.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).cast("string").alias("_html"))
    kind, url = src.schema["_id"].dataType.simpleString(), src.schema["_url"].dataType.simpleString()
    out = arrow_map(src, fn, f"_id {kind}, _url {url}, text string, n_chars bigint")
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", "n_chars")
