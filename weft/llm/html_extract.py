"""Main text of web pages.

A page is cut into flat text blocks. Each block has its word count and link
density, those of the blocks before and after it, and which kind of container
holds it. A decision tree, trained on the small labelled table in
`html_labelled.py`, tells article blocks from the rest: by words and link densities
where containers say nothing or hold lists of links, by the container where it says more.
A class or id that names a layout (`has-sidebar`) says nothing about what is inside an
article or main element, and one that names chrome (or a form) nothing about a page that it
wraps. A paragraph or heading has a name of its own.

Defined results: null or empty html gives an empty text; cut-off or badly nested
markup is read as far as it goes; pages without blocks give an empty text; rows
that repeat are each answered; columns other than the two named are ignored, so
their names cannot clash.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm._common import chunks
from weft.llm.html_labelled import labelled_pages

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?:!|\?|/(?![a-zA-Z]))[^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.S)
_HINT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

#: Elements whose content is no text of the page. `raw` ones end at their own end tag only.
RAW = frozenset("script style textarea title iframe noframes xmp noembed".split())
UNSEEN = frozenset("head template svg math object canvas audio video select datalist button noscript dialog map".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section"
    " summary table tbody td tfoot th thead tr ul caption noscript title".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME_TAGS = frozenset("nav aside footer form menu search".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar status".split())
CORE_TAGS = frozenset(["article", "main"])
#: Words of class and id names.
CHROME_HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner cookie cookies consent"
    " gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup sidebar widget widgets related"
    " recommended recommendations share sharing social menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar"
    " comment comments disqus reply replies respond responses login register search form legal copyright disclaimer pagination pager"
    " toolbar rail teaser skip outbrain taboola paywall alert hidden".split()
)
CORE_HINTS = frozenset("article content post entry story text".split())
#: Of these, words that name a part of the layout; an article inside is an article still.
LAYOUT_HINTS = frozenset("sidebar rail menu nav navbar navigation header masthead topbar toolbar footer banner widget widgets notice notices cookie cookies".split())
#: What a class name begins with if it tells of something elsewhere: has-sidebar, no-header.
ELSEWHERE = frozenset("has with without no show hide".split())
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

FEATURES = ("chrome", "core", "heading", "words", "words_before", "words_after", "links", "links_before", "links_after")


@dataclass
class Block:
    text: str
    words: int
    links: float
    chrome: bool
    core: bool
    heading: bool
    keep: bool = False


@dataclass
class _Open:
    """An element of the page: what it says of itself, and what stands under it."""

    name: str
    parent: _Open | None
    unseen: bool
    keep: bool
    hidden: bool = False  # by its tag, role or style, whatever it holds
    named: bool = False  # chrome by names of other things than the layout, or a form
    layout: bool = False  # chrome by names of the layout alone
    core: bool = False  # an article or main, or its role
    whole: bool = False  # a main
    other: bool = False  # an article named like chrome
    near_core: bool = False  # that, or named like one, here or above
    words: int = 0
    wraps: bool = False  # it holds the page's article
    chrome: bool = False
    in_layout: bool = False


@dataclass
class _State:
    stack: list[_Open] = field(default_factory=list)
    open_names: Counter = field(default_factory=Counter)
    nodes: list[_Open] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    own: bool = False  # the paragraph or heading is named like chrome


#: A container named like chrome is none if it holds the page's article or, where no element says
#: what that is, so much of the page's words.
WRAPPER = 2 / 3
#: The first article that has so much of the words of the longest is the page's.
ARTICLE = 1 / 2


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in _ATTR.findall(source):
        found.setdefault(name.lower(), _html.unescape(value.strip("\"'")))
    return found


def _hints(attrs: dict[str, str]) -> set[str]:
    named = [[x.lower() for x in _HINT.findall(c)] for c in f"{attrs.get('class', '')} {attrs.get('id', '')}".split()]
    return {x for words in named if words and words[0] not in ELSEWHERE for x in words}


def _unseen_by_style(attrs: dict[str, str]) -> bool:
    return "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN_STYLE.search(attrs.get("style", "")))


def _container(name: str, source: str, parent: _Open) -> _Open:
    attrs = _attributes(source) if source.strip(" /\n\t") else {}
    hints, role = _hints(attrs), attrs.get("role", "").lower()
    core = name in CORE_TAGS or role in ("main", "article")
    named = hints & CHROME_HINTS if name not in ("html", "body", "article", "main") else set()
    hidden = (name in CHROME_TAGS and name != "form") or role in CHROME_ROLES - {"form"} or (name == "header" and not parent.near_core) or _unseen_by_style(attrs)
    marked = parent.keep if "data-drop" not in attrs and "data-keep" not in attrs else "data-keep" in attrs
    out = _Open(name, parent, parent.unseen or name in UNSEEN, marked, hidden, bool(named - LAYOUT_HINTS) or name == "form" or role == "form", bool(named), core)
    out.near_core = parent.near_core or core or bool(hints & CORE_HINTS)
    out.whole, out.other = name == "main" or role == "main", bool(hints & CHROME_HINTS)
    return out


def _decide(nodes: list[_Open], words: int) -> None:
    """Which elements are chrome: those that say so, and what stands in them, but for wrappers of the page."""
    for x in reversed(nodes):
        x.parent.words += x.words
    for x in nodes:  # hidden is what stands in a hidden element
        x.hidden |= x.parent.hidden
    articles = [x for x in nodes if x.core and x.words and not x.hidden and not x.other]
    most = max((x.words for x in articles), default=0)
    article = next((x for x in articles if x.whole), None) or next((x for x in articles if x.words >= ARTICLE * most), None)
    x = article
    while x:
        x.wraps, x = True, x.parent
    for x in nodes:
        wrapper = x.wraps if article else x.words > WRAPPER * words
        x.chrome = x.parent.chrome or x.hidden or (x.named and not wrapper)
        x.in_layout = (x.layout and not wrapper) or (x.parent.in_layout and not x.core)


def blocks(page: str | None) -> list[Block]:
    """The flat text blocks of a page, in page order."""
    page = page or ""
    root = _Open("", None, False, False)
    state, out, at, in_link, heading = _State(), [], 0, 0, False

    def flush() -> None:
        words = "".join(state.pieces).split()
        if words:
            top = state.stack[-1] if state.stack else root
            top.words += len(words)
            out.append((Block(" ".join(words), len(words), min(1.0, state.linked / len(words)), state.own, top.near_core, heading, top.keep), top))
        state.pieces.clear()
        state.linked, state.own = 0, False

    def text(piece: str) -> None:
        if piece and not (state.stack and state.stack[-1].unseen):
            piece = _html.unescape(piece)
            state.pieces.append(piece)
            if in_link:
                state.linked += len(piece.split())

    while at < len(page):
        tag = _TAG.search(page, at)
        if tag is None:
            text(page[at:])
            break
        text(page[at : tag.start()])
        at = tag.end()
        name = (tag["name"] or tag["name2"] or "").lower()
        if not name:
            continue
        closing, source = bool(tag["close"] or tag["close2"]), tag["attrs"] if tag["name"] else tag["attrs2"]
        title = len(name) == 2 and name[0] == "h" and name[1] in "123456"
        if name == "br":
            state.pieces.append(" ")
        elif name == "a":
            in_link = 0 if closing else 1
        if name in BLOCK or name in UNSEEN or name in RAW:
            flush()
            in_link = in_link if name in ("p",) else 0
            heading = not closing and title
            if not closing and (title or name == "p") and source and "=" in source:
                attrs = _attributes(source)
                state.own = bool(_hints(attrs) & CHROME_HINTS) or _unseen_by_style(attrs)
        if name in RAW and not closing:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
        elif name in VOID or name in RAW or name == "p":
            continue
        elif closing:
            while state.open_names[name]:  # else it closes nothing
                last = state.stack.pop()
                state.open_names[last.name] -= 1
                if last.name == name:
                    break
        elif (name in BLOCK or name in UNSEEN) and not title:
            if name == "body" and state.open_names["head"]:
                state.stack = [x for x in state.stack if x.name != "head"]
                state.open_names["head"] = 0
            parent = state.stack[-1] if state.stack else root
            state.stack.append(_container(name, source or "", parent))
            state.open_names[name] += 1
            state.nodes.append(state.stack[-1])
    flush()
    _decide(state.nodes, sum(b.words for b, _ in out))
    for block, top in out:
        block.chrome |= top.chrome or top.in_layout
    return [block for block, _ in out]


def features(found: list[Block]) -> np.ndarray:
    """One row of FEATURES for each block; a missing neighbour counts as 0 words, density 0."""
    words = np.array([0, *(b.words for b in found), 0], float)
    links = np.array([0, *(b.links for b in found), 0], float)
    own = np.array([(b.chrome, b.core, b.heading) for b in found], float).reshape(-1, 3)
    return np.column_stack([own, words[1:-1], words[:-2], words[2:], links[1:-1], links[:-2], links[2:]])


def grow_tree(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2) -> list:
    """A classification tree by Gini impurity: [feature, threshold, left, right] or [share of 1]."""
    share = float(y.mean()) if len(y) else 0.0
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return [share]
    best = (len(y) * share * (1 - share) - 1e-9, 0, 0.0)
    for k in range(x.shape[1]):
        order = np.argsort(x[:, k], kind="stable")
        value, ones = x[order, k], np.cumsum(y[order])
        n = np.arange(1, len(y))
        left, right = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(y) - n)
        cost = n * left * (1 - left) + (len(y) - n) * right * (1 - right)
        cost[(value[1:] == value[:-1]) | (n < least) | (len(y) - n < least)] = np.inf
        if len(cost) and cost.min() < best[0]:
            at = int(cost.argmin())
            best = (float(cost[at]), k, float(value[at] + value[at + 1]) / 2 if at + 1 < len(value) else float(value[at]))
    if best[0] >= len(y) * share * (1 - share) - 1e-9:
        return [share]
    go = x[:, best[1]] <= best[2]
    return [best[1], best[2], grow_tree(x[go], y[go], depth - 1, least), grow_tree(x[~go], y[~go], depth - 1, least)]


def classify(tree: list, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0] >= 0.5)
    go = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x), bool)
    out[go], out[~go] = classify(tree[2], x[go]), classify(tree[3], x[~go])
    return out


def train(pages: list[str] | None = None) -> list:
    """The tree of a labelled table: pages whose article elements carry data-keep, and what is
    no article inside them data-drop."""
    found = [blocks(p) for p in pages or labelled_pages()]
    return grow_tree(np.vstack([features(b) for b in found]), np.array([b.keep for bs in found for b in bs], float))


def main_text(page: str | None, tree: list) -> str:
    found = blocks(page)
    if not found:
        return ""
    kept = classify(tree, features(found))
    return "\n".join(b.text for b, k in zip(found, kept, strict=True) if k)


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """id, url, text and n_chars (code points) of every page."""
    tree = train()
    chosen = pages.select(F.col(id_column), F.col(url_column), F.col(html_column).alias("__html"))
    schema = T.StructType([chosen.schema[0], chosen.schema[1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, pages_ in chunks(batches, "__html"):
            texts = [main_text(p.as_py(), tree) for p in pages_]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

    return chosen.mapInArrow(run, schema)
