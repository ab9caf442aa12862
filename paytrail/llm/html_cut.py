"""Main text of web pages by a minimum cut between content and boilerplate.

A page is cut into blocks of text. A classifier gives each block the log odds of being content: a logistic model of the
text itself, fitted here on blocks whose place in the page tells what they are, plus what the block's own place says. The
odds become the capacities between the block and the two terminals; neighbours in page order, children of one element
and grandchildren of one element are joined by edges. The minimum cut is the labelling with the least cost in all.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import Packed, fit_in_task
from .storage import bound_batches

#: Elements that end a block where they begin and end; all others are inline.
BLOCKS = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main "
    "menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose end tag may be left out, and which elements' starts end them.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}}
#: What is no text of the page; contents of these elements run to their end tag, or to the end of the page.
TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<(?P<raw>script|style|template|noscript|iframe|svg|textarea|select|title|object)\b[^>]*+>(?:.*?</(?P=raw)\s*+>|.*\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]{0,10000}+\"|'[^']{0,10000}+')*+>|[^>]*+>)|<[!?/][^>]*+>",
    re.S | re.I,
)
OPEN_TAG = re.compile(r"<[a-zA-Z/!?]")
ATTRS = re.compile(r"""(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORDS = re.compile("[a-z]+")

#: Regions: what an element says of the blocks in it. ``BARRED`` holds for all below it, ``SOFT`` yields to a main part inside
#: it, and a header says nothing inside a main part.
NONE, HINTED, MAIN, SOFT, BARRED, HEADER = range(6)
#: Words of class, id and role that name a part of a page.
COMMENT_WORDS = frozenset("comment comments disqus reply replies".split())
BARRED_WORDS = COMMENT_WORDS | frozenset(
    "ad ads advert adverts advertisement advertising alert breadcrumb breadcrumbs complementary consent contentinfo cookie cookies copyright footer form gdpr login menu menubar modal "
    "nav navbar navigation newsletter notice notices notification pagination popup promo promoted promotion recommended related search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
HEADER_WORDS = frozenset("banner header masthead".split())
MAIN_WORDS = frozenset("article content entry main maincontent post story".split())
LAYOUT_WORDS = frozenset("has with without no layout".split())
BARRED_TAGS = frozenset("nav footer aside menu dialog search button select option".split())
#: Log odds that a region adds; blocks outside any region lose some where the page has a main one.
ODDS = {NONE: 0.0, HINTED: 2.5, MAIN: 8.0, SOFT: -8.0, BARRED: -12.0}
OUTSIDE = -3.0
#: Weights of the edges.
NEXT, SIBLING, COUSIN = 0.5, 1.0, 0.5

#: Weights of the text's features before any fitting, which the fit is drawn to.
FEATURES = {"bias": -2.0, "log words": 0.9, "link share": -4.0, "sentence end": 1.0, "commas": 0.5, "heading": 1.6, "list item": -0.8, "digits": -1.0, "paragraph": 0.7}
STOPS = (".", "!", "?", "…", "。", ":", '"', "”")


@lru_cache(maxsize=20_000)
def region(tag: str, attrs: str) -> int:
    """What an element says of its blocks. Whole-page elements say nothing."""
    if tag in ("html", "body", "head"):
        return NONE
    words, hidden = set(), False
    for m in ATTRS.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").lower()
        if name == "style":
            hidden |= "display:none" in value.replace(" ", "")
        elif name in ("hidden", "aria-hidden"):
            hidden |= name == "hidden" or "true" in value
        else:
            words |= set(WORDS.findall(value))
    if hidden or tag in BARRED_TAGS:
        return BARRED
    main = tag in ("article", "main") or "articlebody" in words or bool(re.search(r"role\s*=\s*.?main\b", attrs, re.I))
    if words & COMMENT_WORDS and not words & {"post", "entry"} if main else words & BARRED_WORDS and not words & LAYOUT_WORDS:
        return BARRED
    if main:
        return MAIN
    if tag == "form":
        return SOFT
    return HEADER if tag == "header" or words & HEADER_WORDS else HINTED if words & MAIN_WORDS else NONE


def inner(outer: int, own: int) -> int:
    """The region inside an element."""
    if outer == BARRED or own == NONE:
        return outer
    if own == HEADER:
        return outer if outer in (MAIN, HINTED) else SOFT
    return outer if own == HINTED and outer == MAIN else own


class Block:
    __slots__ = ("pieces", "linked", "tag", "region", "node", "parent", "text")

    def __init__(self, tag: str, region: int, node: int, parent: int):
        self.pieces, self.linked, self.tag, self.region, self.node, self.parent, self.text = [], 0, tag, region, node, parent, ""


def blocks_of(page: str) -> list[Block]:
    """Blocks with text in page order. A tag that the page's end cuts off is left out; an end tag without its start only ends a block."""
    last = page.rfind(">") + 1
    cut = OPEN_TAG.search(page, last)
    stop = cut.start() if cut else len(page)
    stack: list[tuple[str, int, int]] = [("", 0, NONE)]
    counts: dict[str, int] = {}
    nodes, link, at, out = 0, False, 0, []
    block: Block | None = None

    def pop() -> None:
        counts[stack.pop()[0]] -= 1

    def take(text: str) -> None:
        nonlocal block
        if block is None:
            if text.isspace():
                return
            tag, node, where = stack[-1]
            block = Block(tag, where, node, stack[-2][1] if len(stack) > 1 else -1)
            out.append(block)
        block.pieces.append(text)
        if link:
            block.linked += len(text)

    for m in TOKEN.finditer(page, 0, stop):
        if m.start() > at:
            take(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in BLOCKS:
            if tag == "a":
                link = not m["end"]
            elif tag in ("br", "img") and block is not None:
                block.pieces.append(" ")
            continue
        block = None
        if m["end"]:
            link = False
            if counts.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if stack[-1][0] == "p":
            pop()
        ends = IMPLIED.get(tag)
        while ends and stack[-1][0] in ends:
            pop()
        if tag != "hr":
            nodes += 1
            stack.append((tag, nodes, inner(stack[-1][2], region(tag, m["attrs"]))))
            counts[tag] = counts.get(tag, 0) + 1
    if at < stop:
        take(page[at:stop])
    for b in out:
        b.text = " ".join(html.unescape("".join(b.pieces)).split())
    return [b for b in out if b.text]


def features(b: Block) -> tuple[float, ...]:
    """Values of ``FEATURES``: of the text and its own element alone."""
    text, n = b.text, len(b.text)
    words = text.count(" ") + 1
    digits = sum(map(str.isdigit, text)) if n < 200 else 0
    heading = b.tag[:1] == "h" and b.tag[1:].isdigit()
    return (1.0, math.log(words), min(1.0, b.linked / n), float(text.endswith(STOPS)), min(1.0, text.count(",") / 3), float(heading), float(b.tag in ("li", "dt", "dd", "option")), digits / n, float(b.tag in ("p", "blockquote", "pre")))


def fit_weights(rows: list[tuple[tuple[float, ...], int]], pull: float = 5.0, rounds: int = 30) -> list[float]:
    """Logistic weights by Newton's method, each class counting alike, drawn to ``FEATURES`` by a ridge of ``pull`` rows; these
    themselves if a class is missing."""
    prior = np.array(list(FEATURES.values()))
    y = np.array([r[1] for r in rows], dtype=np.float64)
    if not len(rows) or y.min() == y.max():
        return prior.tolist()
    x, w = np.array([r[0] for r in rows]), prior.copy()
    each = np.where(y == 1, 1 / y.sum(), 1 / (len(y) - y.sum())) * 100
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (each * (p - y)) + pull * (w - prior)
        move = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), slope)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    return w.tolist()


def told(pages: list[str]) -> list[tuple[tuple[float, ...], int]]:
    """Features of the blocks whose region tells their label."""
    return [(features(b), int(b.region == MAIN)) for page in pages for b in blocks_of(page) if b.region in (MAIN, SOFT, BARRED)]


def fit(pages: DataFrame, column: str = "html", rows: int = 1000, most: int = 65_536) -> Packed:
    """The text's weights, fitted in one task on a sample of at most ``rows`` pages of at most ``most`` bytes, picked by a hash
    of the page. An empty sample, or one whose regions tell nothing, leaves the weights of ``FEATURES``."""
    own = pages.select(F.col(column).alias("page")).where(F.octet_length("page") <= most)
    return fit_in_task(own.orderBy(F.xxhash64("page")).limit(rows), lambda found: fit_weights(told([r["page"] for r in found])))


def odds(blocks: list[Block], weights: list[float]) -> list[float]:
    """Log odds of content."""
    has_main = any(b.region == MAIN for b in blocks)
    return [sum(map(float.__mul__, features(b), weights)) + ODDS[b.region] + (OUTSIDE if has_main and b.region in (NONE, HINTED) else 0.0) for b in blocks]


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Neighbours in page order, and along each element the blocks that it holds itself or through one child."""
    out = [(i, i + 1, NEXT) for i in range(len(blocks) - 1)]
    for price, of in ((SIBLING, Block.node.__get__), (COUSIN, Block.parent.__get__)):
        before: dict[int, int] = {}
        for i, b in enumerate(blocks):
            key = of(b)
            if key in before:
                out.append((before[key], i, price))
            before[key] = i
    return out


def min_cut(z: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side of the minimum cut; ``z`` is the capacity from the source less that to the sink.
    Of several minimum cuts, the one with most nodes on that side.

    A node whose own capacity outweighs all its edges is on its side in a minimum cut; it goes, and pulls its neighbours.
    What is left, if anything, is solved by the maximum flow.
    """
    z, n = list(z), len(z)
    side: list[bool | None] = [None] * n
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    weight = [sum(x.values()) for x in near]
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i] is None and (z[i] >= weight[i] or z[i] < -weight[i]):
            side[i] = z[i] >= 0
            for j, w in near[i].items():
                if side[j] is None:
                    z[j] += w if side[i] else -w
                    weight[j] -= w
                    todo.append(j)
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        number = {i: k for k, i in enumerate(rest)}
        joined = [(number[i], number[j], w) for i in rest for j, w in near[i].items() if i < j and j in number]
        for i, up in zip(rest, by_flow([z[i] for i in rest], joined), strict=True):
            side[i] = up
    return side


def by_flow(z: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The same cut by blocking flows along shortest paths: nodes from which the sink can't be reached once the flow is full."""
    n, tiny = len(z), 1e-9
    source, sink = n, n + 1
    arcs: list[list[int]] = [[] for _ in range(n + 2)]
    head, room = [], []

    def arc(i: int, j: int, there: float, back: float) -> None:
        arcs[i].append(len(head))
        arcs[j].append(len(head) + 1)
        head.extend((j, i))
        room.extend((there, back))

    for i, x in enumerate(z):
        if x > 0:
            arc(source, i, x, 0.0)
        elif x < 0:
            arc(i, sink, -x, 0.0)
    for i, j, w in edges:
        arc(i, j, w, w)

    def levels(start: int, forward: bool) -> list[int]:
        level = [-1] * (n + 2)
        level[start], todo = 0, deque([start])
        while todo:
            i = todo.popleft()
            for a in arcs[i]:
                if level[head[a]] < 0 and room[a if forward else a ^ 1] > tiny:
                    level[head[a]] = level[i] + 1
                    todo.append(head[a])
        return level

    while (level := levels(source, True))[sink] >= 0:
        nexts, path, i = [0] * (n + 2), [], source
        while True:
            if i == sink:
                flow = min(room[a] for a in path)
                for a in path:
                    room[a] -= flow
                    room[a ^ 1] += flow
                full = next(k for k, a in enumerate(path) if room[a] <= tiny)
                i = head[path[full] ^ 1]
                del path[full:]
                continue
            while nexts[i] < len(arcs[i]):
                a = arcs[i][nexts[i]]
                if room[a] > tiny and level[head[a]] == level[i] + 1:
                    path.append(a)
                    i = head[a]
                    break
                nexts[i] += 1
            else:
                if not path:
                    break
                i = head[path.pop() ^ 1]
                nexts[i] += 1
    reach = levels(sink, False)
    return [reach[i] < 0 for i in range(n)]


def main_text(page: str, weights: list[float]) -> str:
    blocks = blocks_of(page)
    keep = min_cut(odds(blocks, weights), edges_of(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame, model: Packed, key: str = "page_id", url: str = "url", column: str = "html") -> DataFrame:
    """``key``, ``url``, ``text`` (main text, its blocks joined by line feeds; empty if there is none) and ``n_chars`` of every
    page. A null page is an empty one, null keys and urls stay, repeated rows each have their row, extra columns are left
    out, an empty table gives no rows. A page is one task's work; its graph has as many nodes as blocks and at most three
    times as many edges."""
    bound_batches(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(model.load())  # nine numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(page, sent.value) if page else "" for page in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["k", "u", "text", "n_chars"])

    slim = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(column).alias("page"))
    kinds = [f.dataType.simpleString() for f in slim.schema.fields]
    found = slim.mapInArrow(run, f"k {kinds[0]}, u {kinds[1]}, text string, n_chars long")
    return found.withColumnsRenamed({"k": key, "u": url})
