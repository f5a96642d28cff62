"""HTML extraction: a minimum cut separates content from boilerplate.

A page becomes blocks of text in page order. Each block has a cost for being taken as content and
one for being taken as boilerplate, from a linear classifier over its place, length and links; these are the
capacities of edges to the two terminals. Blocks that follow each other, and blocks under the same
parent, are tied by smoothness edges, stronger the closer they are in the DOM. Maximum flow (shortest
augmenting paths in a level graph) finds the cheapest labelling; the source side is the content.

The classifier is fitted to the pages at hand: on a sample of about SAMPLE different pages, drawn by a hash, blocks inside article and main
elements are taken as content and those in places of boilerplate as such. What a block's words, links and kind say
is fitted to these labels by logistic regression, drawn towards the weights given here, which hold where the sample has too few blocks of
either label; what its place says is fixed, as it made the labels.

Names (class, id, role) tell boilerplate by whole names: one of NOISE says so firmly, a compound of NOISE and FILLER words alone
(``site-footer``, but not ``share-price`` or ``related-work``) weakly enough for long text, an article or neighbours to outvote it.
Names and form elements say nothing of what is inside an element that holds an article or main, and on pages without these nothing inside one that
holds most of the page's long text, unless it is named as comments; nor do names of html, body, main and article, nor those of a layout
(``sidebar-left layout``). Inside an article a header is a heading.

A missing table, null or empty html, or a page without content gives an empty text. Nothing is capped: the
whole page is read, in time that grows with its length however deep its elements lie and whatever they leave
unclosed. Unclosed and misplaced tags are taken as browsers would, roughly.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphsieve.llm.common import slices

#: What stands in a tag after its name: a quoted value may hold a ``<`` only if it ends soon.
INSIDE = r"""(?:"[^"<]*+"|'[^'<]*+'|"[^"]{0,2000}+"|'[^']{0,2000}+'|[^'"<>])*+"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(script|style|template|noscript|iframe|svg|annotation|annotation-xml|textarea|select|object|canvas|audio|video|title)\b{INSIDE}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({INSIDE})>|([^<]+|<)", re.S | re.I)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Fixed word lists: tags that run on within a line, that hold nothing, that close an open paragraph.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math semantics mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup munder mover munderover mtable mtr mtd mstyle mspace mpadded mphantom merror".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Where the key begins, the innermost open element of these ends, unless one of LISTS stands inside it.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "tbody": ("tr",), "tfoot": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS = ("ul", "ol", "table", "dl")
#: Fixed word lists: places of boilerplate by tag; of these, tags that pages wrap around whatever they like.
OUTSIDE = frozenset("nav footer aside form menu button fieldset dialog".split())
WRAPS = frozenset("form fieldset button".split())
#: Fixed word lists: names of boilerplate; words that with these make names of boilerplate too; names of readers' comments.
NOISE = frozenset("ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar side widget widgets footer foot header masthead cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup login comment comments reply replies disqus discussion respond share sharing social related recommended recommend toolbar pagination pager copyright legal disclaimer skip search complementary contentinfo".split())
FILLER = frozenset("site page main top bottom left right upper lower box block bar list item items link links area section wrap wrapper container inner outer button buttons btn icon icons text form global primary secondary mobile desktop sticky fixed inline first last row col column columns unit slot group panel region zone content title message thread body label author meta date count avatar posts articles stories reading tools this dialog google media policy info trail entry post id".split())
COMMENTS = frozenset("comment comments reply replies disqus discussion respond".split())
LAYOUT = frozenset("layout template theme".split())
CORE = frozenset("article main".split())
#: Fixed word lists: elements whose names say nothing of what they hold; words that inside an article name its heading; prefixes of names that tell what a page has elsewhere.
WHOLE = frozenset("html body main article".split())
HEADING_WORDS = frozenset("header head masthead".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CAMEL = re.compile("([a-z])([A-Z])")
ABOUT = re.compile(r"^(?:has|with|no|is|not|hide|without)[-_]")
#: The classifier's weights for a block's place, and those for the block itself before any fit.
PLACE = {"core": 3.0, "outside": -8.0, "noise": -8.0, "compound": -3.0, "head_tag": -2.0}
WEIGHTS = {"bias": -0.6, "links": -3.0, "long": 2.2, "very_long": 1.0, "short": -0.7, "heading": 1.0, "sentence": 0.5}
#: Pages from which the classifier is fitted, about; blocks of either label that it needs; how firmly it keeps to WEIGHTS.
SAMPLE, LEAST, FIRM = 2000, 200, 40.0
#: Smoothness: of neighbours under the same parent, less for each step between their parents; and of the next but one.
TIE, FADE, SECOND = 0.9, 0.5, 0.3
#: Words of a long block, at least.
LONG = 12
#: Steps beyond which neighbours count as untied.
FAR = 40


class Element:
    """An element of the page; what its place says is settled when all of the page is read."""

    __slots__ = ("tag", "parent", "block", "depth", "core", "outside", "header", "head", "named", "comments", "words", "holds", "dead")

    def __init__(self, tag: str, parent: Element | None, named: int, comments: bool):
        self.tag, self.parent, self.named, self.comments, self.dead = tag, parent, named, comments, False
        inline = tag in INLINE
        #: the innermost element that is no inline one
        self.block = self if not inline else parent.block if parent else None
        self.depth = (parent.block.depth if parent and parent.block else 0) + (not inline)
        self.core = tag in CORE or bool(parent and parent.core)
        self.outside = False
        self.header = tag == "header" or bool(parent and parent.header)
        self.head = tag == "head" or bool(parent and parent.head)
        #: words of long blocks inside; whether an article or main is inside
        self.words, self.holds = 0, False


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    at: Element | None  # the innermost open element

    @property
    def words(self) -> int:
        return self.text.count(" ") + 1


def told(tag: str, attributes: str, core: bool) -> tuple[int, bool]:
    """How firmly an element's names tell of boilerplate (0 to 2), and whether of comments."""
    if tag in WHOLE or "=" not in attributes:
        return 0, False
    firm, comments = 0, False
    for found in NAMES.findall(attributes):
        for name in CAMEL.sub(r"\1-\2", "".join(found)).lower().split():
            words = [w for w in re.split(r"[^a-z]+", name) if w]
            if words and words[-1] in LAYOUT:
                return 0, False
            noise = NOISE.intersection(words) - (HEADING_WORDS if core else frozenset())
            if noise and not ABOUT.match(name) and all(w in NOISE or w in FILLER for w in words):
                firm = max(firm, 2 if len(words) == 1 else 1)
                comments = comments or bool(COMMENTS & noise)
    return firm, comments


def settle(made: list[Element], out: list[Block]) -> None:
    """What each element's place says; elements come in the order in which they begin."""
    for b in out:
        if b.at is not None and b.words >= LONG and 2 * b.linked < len(b.text):
            b.at.words += b.words
    for e in reversed(made):
        if e.parent is not None:
            e.parent.words += e.words
            e.parent.holds |= e.holds or e.tag in CORE
    total = sum(e.words for e in made if e.parent is None)
    bare = not any(e.tag in CORE and e.words for e in made)
    for e in made:
        most = e.holds or (bare and 2 * e.words > total and not e.comments)
        if most:
            e.named = 0
        e.outside = e.tag in OUTSIDE and not (most and e.tag in WRAPS)
        if e.parent is not None:
            e.named, e.outside = max(e.named, e.parent.named), e.outside or e.parent.outside


def blocks(page: str) -> list[Block]:
    """Runs of text between block elements, with where they stand. Takes time in proportion to the page."""
    out: list[Block] = []
    made: list[Element] = []
    stack: list[Element] = []
    places: dict[str, list[int]] = {}  # where in the stack each tag's open elements are
    outer: list[int] = []  # where those that are not inline are
    parts: list[str] = []
    linked = links = 0
    last = lambda tag: held[-1] if (held := places.get(tag)) else -1

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, linked, stack[-1] if stack else None))
        parts, linked = [], 0

    def close(at: int) -> None:
        """Ends the elements from this place on, and ended inline ones that then lie on top."""
        nonlocal links
        while len(stack) > at or (stack and stack[-1].dead):
            e = stack.pop()
            if not e.dead:
                places[e.tag].pop()
                links -= e.tag == "a"
            if outer and outer[-1] == len(stack):
                outer.pop()

    for m in TOKEN.finditer(page):
        if (text := m[5]) is not None:
            parts.append(text)
            if links:
                linked += len(text.strip())
            continue
        if m[1] is not None:
            if m[1].lower() in ("textarea", "select", "noscript", "iframe", "object", "audio", "video", "title"):
                flush()
            continue
        if m[3] is None:
            continue
        tag = m[3].lower()
        inline = tag in INLINE
        if m[2]:
            at = last(tag)
            if not inline:
                flush()
                if at >= 0:
                    close(at)
            # an inline end tag does not reach beyond the block that it stands in
            elif at >= 0 and not (outer and outer[-1] > at):
                stack[at].dead = True
                places[tag].pop()
                links -= tag == "a"
                close(len(stack))
            continue
        if not inline:
            flush()
            if tag in CLOSES_P and outer and stack[outer[-1]].tag == "p":
                close(outer[-1])
            ends = max(map(last, ENDS.get(tag, ())), default=-1)
            if ends >= 0 and ends > max(map(last, LISTS)):
                close(ends)
        elif tag in ("br", "wbr", "img"):
            parts.append(" " if tag == "br" else "")
        if tag not in VOID and not m[4].endswith("/"):
            parent = stack[-1] if stack else None
            e = Element(tag, parent, *told(tag, m[4], bool(parent and parent.core)))
            made.append(e)
            places.setdefault(tag, []).append(len(stack))
            if not inline:
                outer.append(len(stack))
            stack.append(e)
            links += tag == "a"
    flush()
    settle(made, out)
    return out


def place(b: Block) -> dict[str, bool]:
    e = b.at
    if e is None:
        return dict.fromkeys(PLACE, False)
    return {"core": e.core, "outside": e.outside or (e.header and not e.core), "noise": e.named == 2, "compound": e.named == 1, "head_tag": e.head or (e.header and e.core)}


def facts(b: Block) -> dict[str, float]:
    words = b.words
    return {
        "bias": 1.0,
        "links": min(1.0, b.linked / max(1, len(b.text))),
        "long": words >= LONG,
        "very_long": words >= 40,
        "short": words < 5,
        "heading": b.at is not None and b.at.block is not None and b.at.block.tag in HEADINGS,
        "sentence": b.text[-1] in ".!?…。\"”»",
    }


def leaning(b: Block, weights: dict[str, float] = WEIGHTS) -> float:
    """Above 0: rather content. The costs of the two labels differ by this much."""
    return sum(PLACE[k] * v for k, v in place(b).items()) + sum(weights[k] * float(v) for k, v in facts(b).items())


def fitted(seen: dict[tuple, tuple[float, float]]) -> dict[str, float]:
    """Weights from how many blocks with these facts (in the order of WEIGHTS) were content and boilerplate; WEIGHTS where either are too few."""
    first = np.array([*WEIGHTS.values()])
    content, other = np.array([[*v] for v in seen.values()], float).reshape(-1, 2).T
    if content.sum() < LEAST or other.sum() < LEAST:
        return dict(WEIGHTS)
    x, w = np.array([*seen], float), first.copy()
    # both labels weigh the same, LEAST blocks each
    content, other = content * LEAST / content.sum(), other * LEAST / other.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (content - (content + other) * p) - FIRM * (w - first)
        curve = (x.T * ((content + other) * p * (1 - p))) @ x + FIRM * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return dict(zip(WEIGHTS, w.tolist(), strict=True))


def smoothness(a: Block, b: Block) -> float:
    """How strongly two neighbours are tied: by the steps from both parents to the common ancestor."""
    x, y = (e.at.block.parent.block if e.at and e.at.block and e.at.block.parent else None for e in (a, b))
    steps = 0
    while x is not y and steps <= FAR:
        if y is None or (x is not None and x.depth >= y.depth):
            x = x.parent.block if x.parent else None
        else:
            y = y.parent.block if y.parent else None
        steps += 1
    return TIE * FADE**steps if steps <= FAR else 0.0


def siblings(a: Block, b: Block) -> bool:
    x, y = (e.at.block.parent.block if e.at and e.at.block and e.at.block.parent else None for e in (a, b))
    return x is y


def min_cut(lean: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source side of a minimum cut; among several the smallest such set.

    Node ``i`` has capacity ``lean[i]`` from the source if positive, else ``-lean[i]`` to the sink.
    """
    n = len(lean)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    edges: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, there: float, back: float) -> None:
        edges[a].append(len(to))
        to.append(b)
        room.append(there)
        edges[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, v in enumerate(lean):
        if v > 0:
            add(source, i, v, 0.0)
        elif v < 0:
            add(i, sink, -v, 0.0)
    for a, b, w in ties:
        add(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in edges[u]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        nexts = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:  # augment along the level graph until it has no path left
            if u == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                path, u = [], source
                continue
            while nexts[u] < len(edges[u]):
                e = edges[u][nexts[u]]
                if room[e] > tiny and level[to[e]] == level[u] + 1:
                    break
                nexts[u] += 1
            if nexts[u] < len(edges[u]):
                path.append(edges[u][nexts[u]])
                u = to[path[-1]]
            elif path:
                u = to[path.pop() ^ 1]
                nexts[u] += 1
            else:
                break


def main_text(page: str, weights: dict[str, float] = WEIGHTS) -> str:
    """The content blocks, a line each."""
    found = blocks(page)
    if not found:
        return ""
    lean = [leaning(b, weights) for b in found]
    ties = [(i, i + 1, smoothness(found[i], found[i + 1])) for i in range(len(found) - 1)]
    ties += [(i, i + 2, SECOND) for i in range(len(found) - 2) if siblings(found[i], found[i + 2])]
    return "\n".join(b.text for b, kept in zip(found, min_cut(lean, ties), strict=True) if kept)


def fit(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> dict[str, float]:
    """The classifier's weights for these pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, list[int]] = {}
        for batch in slices(batches, "page_html"):
            for page in batch.column("page_html").to_pylist():
                for b in blocks(page):
                    where = place(b)
                    if where["head_tag"]:
                        continue
                    boilerplate = where["outside"] or where["noise"]
                    if where["core"] or boilerplate:
                        values = facts(b)
                        key = (*(float(values[k]) if k != "links" else round(values[k] * 4) / 4 for k in WEIGHTS),)
                        seen.setdefault(key, [0, 0])[boilerplate] += 1
        yield pa.RecordBatch.from_arrays([pa.array([[*k] for k in seen], pa.list_(pa.float64())), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], ["facts", "content", "other"])

    chosen = pages.select(pages[html_col].alias("page_html"))
    scale = 1 << 30
    share = int(min(1, sample / max(1, chosen.count())) * scale)
    # about ``sample`` pages, as a hash deals them: copies all together or not at all, once
    drawn = chosen.where("page_html is not null").where(F.pmod(F.xxhash64("page_html"), F.lit(scale)) < share).distinct()
    got = drawn.mapInArrow(run, "facts array<double>, content long, other long").groupBy("facts").agg(F.sum("content").alias("content"), F.sum("other").alias("other"))
    return fitted({tuple(r.facts): (r.content, r.other) for r in got.orderBy("facts").collect()})  # at most 5 * 2 ** 5 rows


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns named in ``keep``, text and n_chars: a row for each page; only the sample for the classifier is shuffled."""
    weights = fit(pages, html_col)
    chosen = pages.select(*(F.col(f"`{c}`") for c in keep), F.coalesce(pages[html_col], F.lit("")).alias("page_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "page_html"):
            texts = [main_text(p, weights) for p in batch.column("page_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([*map(len, texts)], pa.int64())], [*keep, "text", "n_chars"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema][:-1]
    return chosen.mapInArrow(run, ", ".join([*kinds, "text string, n_chars long"]))
