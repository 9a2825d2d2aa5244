"""Main text of web pages by minimum-cut labelling.

A page is read into text blocks (a block element's own text; inline markup
does not split it). A classifier gives each block a logit of being content;
its costs become terminal capacities: softplus(z) from the source, what
calling the block boilerplate costs, and softplus(-z) to the sink. Smoothness
edges join neighbouring blocks and, through the DOM, successive blocks of one
container; an edge weighs more where its blocks share container and tag, and
less the further apart they lie in depth. The minimum cut, found by maximum
flow, labels all blocks of the page at once; content blocks are the main text.

All weights are fitted on a bounded sample (TRAIN_PAGES pages, about, with all
their blocks) and drawn towards stated ones (PRIOR, EDGE_PRIOR), which stand
alone where a sample says nothing. Blocks well inside article or main against
blocks inside navigation, footers and the like are the weak labels. What the
enclosing elements say (tags, and words of class, id and role) is three features
among those of a block's own text; every block is learnt from three times, with
these, without them, and without its own tag too, so that a page without telling
markup is judged by its text. Edge weights are a logistic regression of two neighbours sharing their label; their
common scale is the one of SCALES with the best text F1 on held-out pages whose
telling features are taken away.

Cases: null and empty html give no text; unclosed, crossed and 100,000-deep
elements are read with an explicit stack; a page that is one text without
markup is one block; scripts, styles, comments, titles and templates are never
blocks; texts of any length are kept whole; repeated rows stay; an empty table
gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import html
import pickle
import re
from collections import deque
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import slices, small_batches
from .sampling import thinned

TRAIN_PAGES = 1000

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[a-z]+")
#: Elements whose whole content is not text of the page.
RAW = frozenset("script style title textarea template noscript iframe svg math select object xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody td tfoot th thead tr ul".split())
#: An element that begins ends an open element of its group, if that is the innermost block.
ENDS = {**{t: frozenset(["p"]) for t in BLOCKS}, "li": frozenset(["p", "li"]), "dt": frozenset(["p", "dt", "dd"]),
        "dd": frozenset(["p", "dt", "dd"]), "td": frozenset(["p", "td", "th"]), "th": frozenset(["p", "td", "th"]),
        "tr": frozenset(["p", "td", "th", "tr"]), "option": frozenset(["option"])}
CONTENT_TAGS = frozenset("article main".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu button dialog search fieldset".split())
BOILERPLATE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notices notification popup modal overlay newsletter subscribe signup login sidebar aside widget widgets menu "
    "submenu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar comment comments reply replies "
    "discussion disqus respond share sharing social related recommended recommendations pagination pager".split())
CONTENT_WORDS = frozenset("article content post entry story main".split())
#: Elements too wide for a word of their class to speak of all they hold.
WIDE = frozenset("html body article main".split())
#: Weights that the fit is drawn towards. Of the text: constant, words (log), share in links, ends as a sentence
#: does, commas a word, word length, heading, list or cell, paragraph; of the enclosing elements: inside content,
#: inside boilerplate, outside while the page has content.
PRIOR = np.array([-1.0, 0.8, -3.0, 0.8, 0.0, 0.0, 0.5, -0.5, 0.5, 4.0, -6.0, -3.0])
#: The last ones, of enclosing elements and of these and the block's own tag.
AROUND, TELLING = 3, 6
#: The same of edges: constant, one container, one tag, depth between them (log).
EDGE_PRIOR = np.array([0.2, 0.5, 0.3, -0.2])
EDGE_MOST = 4.0
SCALES = (0.25, 0.5, 1.0, 1.5, 2.0)
#: Blocks and pairs that the pull towards the stated weights counts for.
PULL, EDGE_PULL = 20.0, 4.0


@dataclass(frozen=True)
class Block:
    text: str
    links: int  # characters inside links
    tag: str
    container: int  # number of the block element around that of the block
    content: bool
    boilerplate: bool
    depth: int

    def features(self) -> list[float]:
        """Of the block's own text and tag."""
        words = self.text.count(" ") + 1
        size = len(self.text)
        return [1.0, float(np.log1p(words)), self.links / size, float(self.text[-1] in ".!?…:\"'”»"),
                self.text.count(",") / words, size / words / 10, float(self.tag[0] == "h" and self.tag[1:].isdigit()),
                float(self.tag in ("li", "td", "th", "dt", "dd")), float(self.tag in ("p", "blockquote", "pre"))]


def _evidence(tag: str, attributes: str, content: bool, boilerplate: bool) -> tuple[bool, bool]:
    """(content, boilerplate) inside an element, given that around it."""
    content = content or tag in CONTENT_TAGS
    boilerplate = boilerplate or tag in BOILERPLATE_TAGS or (tag == "header" and not content)
    if attributes and not boilerplate and "=" in attributes:
        words: set[str] = set()
        for name, *values in ATTRIBUTE.findall(attributes):
            value = "".join(values).lower()
            if name.lower() == "role":
                boilerplate = boilerplate or value in BOILERPLATE_ROLES
                content = content or value in ("main", "article")
            else:
                words.update(PARTS.findall(value))
        if tag not in WIDE and words & BOILERPLATE_WORDS and not words & CONTENT_WORDS:
            boilerplate = True
    return content, boilerplate


def blocks(page: str | None) -> list[Block]:
    """Text blocks of a page in order."""
    page = page or ""
    out: list[Block] = []
    # open elements: tag, place of the innermost block among them, evidence, whether in a link, number
    stack = [("html", 0, False, False, False, 0)]
    count, number, at = {}, 0, 0
    pieces: list[str] = []
    links = 0

    def flush():
        nonlocal links
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                place = stack[-1][1]
                tag, _, content, boilerplate, *_ = stack[place]
                container = stack[stack[place - 1][1]][5] if place else -1
                out.append(Block(text, min(links, len(text)), tag, container, content, boilerplate, place))
            pieces.clear()
        links = 0

    def add(text: str):
        nonlocal links
        if text:
            pieces.append(text)
            if stack[-1][4]:
                links += len(text.strip())

    def cut(place: int):
        for tag, *_ in stack[place:]:
            count[tag] -= 1
        del stack[place:]

    while True:
        found = TOKEN.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at: found.start()])
        at = found.end()
        tag = found[2] and found[2].lower()
        if not tag:
            continue
        if found[1]:
            if tag in BLOCKS:
                flush()
            if count.get(tag):
                place = len(stack) - 1
                while stack[place][0] != tag:
                    place -= 1
                cut(place)
            continue
        if tag in RAW:
            if not found[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            pieces.append(" ")
            continue
        if tag in VOID:
            pieces.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag in BLOCKS:
            flush()
            while (inner := stack[-1][1]) and stack[inner][0] in ENDS[tag]:
                cut(inner)
        _, inner, content, boilerplate, link, _ = stack[-1]
        content, boilerplate = _evidence(tag, found[3], content, boilerplate)
        number += 1
        is_block = tag in BLOCKS
        stack.append((tag, len(stack) if is_block else inner, content, boilerplate, link or tag == "a", number))
        count[tag] = count.get(tag, 0) + 1
    flush()
    return out


@dataclass(frozen=True)
class Weights:
    block: np.ndarray
    edge: np.ndarray
    scale: float


@dataclass(frozen=True)
class Shape:
    """What the fit and the cut need of a page's blocks."""

    features: np.ndarray  # blocks x weights
    pairs: np.ndarray  # (i, j), i < j: neighbours, and successive blocks of a container
    pair_features: np.ndarray
    labels: np.ndarray  # weak ones: 1 content, 0 boilerplate, -1 unknown
    sizes: np.ndarray  # characters


def shape(found: list[Block]) -> Shape:
    somewhere = any(b.content and not b.boilerplate for b in found)
    rows = [[*b.features(), float(b.content and not b.boilerplate), float(b.boilerplate),
             float(somewhere and not b.content and not b.boilerplate)] for b in found]
    joined: dict[tuple[int, int], None] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            joined[i - 1, i] = None
        if (j := last.get(b.container)) is not None:
            joined[j, i] = None
        last[b.container] = i
    kinds = [[1.0, float(found[i].container == found[j].container), float(found[i].tag == found[j].tag),
              float(np.log1p(abs(found[i].depth - found[j].depth)))] for i, j in joined]
    return Shape(np.array(rows).reshape(-1, len(PRIOR)), np.array(list(joined), np.int64).reshape(-1, 2),
                 np.array(kinds).reshape(-1, len(EDGE_PRIOR)),
                 np.array([0 if b.boilerplate else 1 if b.content else -1 for b in found], np.int64),
                 np.array([len(b.text) for b in found], np.int64))


def edge_weights(kinds: np.ndarray, weights: Weights) -> np.ndarray:
    """Between 0 and EDGE_MOST, times the scale."""
    return np.clip(kinds @ weights.edge, 0.0, EDGE_MOST) * weights.scale


def labelled(page: Shape, weights: Weights) -> list[bool]:
    """The cut's labels of a page's blocks."""
    gain = page.features @ weights.block
    smooth = {(i, j): w for (i, j), w in zip(page.pairs.tolist(), edge_weights(page.pair_features, weights).tolist(), strict=True) if w}
    return minimum_cut(gain.tolist(), smooth)


def minimum_cut(gain: list[float], smooth: dict[tuple[int, int], float]) -> list[bool]:
    """Labels that minimise the cut: ``gain`` is a node's source capacity less
    its sink capacity (their common part is cut either way). True: with the
    source. A node whose terminal outweighs all its edges keeps its side in
    every minimum cut, so those are settled first and their edges become
    terminal capacities of the neighbours; all others go to maximum flow. A
    node that may be on either side is with the sink."""
    n = len(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), w in smooth.items():
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [g > 0 if abs(g) > sum(e.values()) else None for g, e in zip(gain, near, strict=True)]
    core = [v for v in range(n) if label[v] is None]
    if core:
        rest = list(gain)
        for v in core:
            for u, w in near[v].items():
                if label[u] is not None:
                    rest[v] += w if label[u] else -w
        inside = {v: {u: w for u, w in near[v].items() if label[u] is None} for v in core}
        reached = _max_flow(core, rest, inside)
        for v in core:
            label[v] = v in reached
    return [bool(x) for x in label]


def _max_flow(core: list[int], gain: list[float], near: dict[int, dict[int, float]]) -> set[int]:
    """Nodes that the source still reaches after a maximum flow (shortest
    augmenting paths in levels; an undirected edge has its weight both ways)."""
    source, sink = -1, -2
    rest: dict[int, dict[int, float]] = {v: dict(near[v]) for v in core}
    rest[source], rest[sink] = {}, {}
    for v in core:
        if gain[v] > 0:
            rest[source][v], rest[v][source] = gain[v], 0.0
        elif gain[v] < 0:
            rest[v][sink], rest[sink][v] = -gain[v], 0.0
    tiny = 1e-12
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue and sink not in level:
            v = queue.popleft()
            for u, c in rest[v].items():
                if c > tiny and u not in level:
                    level[u] = level[v] + 1
                    queue.append(u)
        if sink not in level:
            return set(level)
        options = {v: iter(list(rest[v])) for v in level}
        path = [source]
        while path:  # a blocking flow, depth first with an explicit path
            v = path[-1]
            if v == sink:
                amount = min(rest[a][b] for a, b in zip(path, path[1:], strict=False))
                back = None
                for k, (a, b) in enumerate(zip(path, path[1:], strict=False)):
                    rest[a][b] -= amount
                    rest[b][a] = rest[b].get(a, 0.0) + amount
                    if back is None and rest[a][b] <= tiny:
                        back = k + 1
                path = path[:back]
                options[path[-1]] = iter(list(rest[path[-1]]))
                continue
            for u in options[v]:
                if rest[v][u] > tiny and level.get(u) == level[v] + 1:
                    path.append(u)
                    break
            else:
                level[v] = -1
                path.pop()


UNTRAINED = Weights(PRIOR, EDGE_PRIOR, 1.0)


def main_text(page: str | None, weights: Weights = UNTRAINED) -> str:
    found = blocks(page)
    label = labelled(shape(found), weights)
    return " ".join(b.text for b, keep in zip(found, label, strict=True) if keep)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: np.ndarray, pull: float) -> np.ndarray:
    """Weights of a logistic regression, drawn towards ``prior``."""
    w = prior.copy()
    for _ in range(30):  # Newton steps, halved while they overshoot
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(prior))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - pull * (w - prior))
        w = w + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
    return w


def _balanced(y: np.ndarray) -> np.ndarray:
    """Weights by which both classes count alike, 1 on average."""
    n, ones = len(y), y.sum()
    return np.where(y == 1, n / (2 * ones), n / (2 * (n - ones))) if 0 < ones < n else np.ones(n)


def text_f1(label: list[bool], page: Shape) -> float:
    """F1 of the characters of labelled blocks."""
    got, known = np.array(label, bool), page.labels >= 0
    true = page.labels == 1
    hit = page.sizes[got & true].sum()
    return float(2 * hit / max(1, page.sizes[got & known].sum() + page.sizes[true].sum()))


def fitted(pages: list[Shape]) -> Weights:
    """Weights by the weak labels of ``pages``; every fourth is held out to
    choose the scale of the edges."""
    learnt = [p for i, p in enumerate(pages) if i % 4 != 3 or len(pages) < 8]
    held = [p for i, p in enumerate(pages) if i % 4 == 3]
    x, y = (np.concatenate(c) for c in zip(*[(p.features[p.labels >= 0], p.labels[p.labels >= 0]) for p in learnt], strict=True)) if learnt else (
        np.zeros((0, len(PRIOR))), np.zeros(0))
    block = PRIOR
    if 0 < y.sum() < len(y):
        copies = [x, x.copy(), x.copy()]
        copies[1][:, -AROUND:] = 0.0
        copies[2][:, -TELLING:] = 0.0
        block = _logistic(np.vstack(copies), np.tile(y, 3), np.tile(_balanced(y), 3) / 3, PRIOR, PULL)
    kinds, same = [], []
    for p in learnt:
        ends = p.labels[p.pairs] if len(p.pairs) else np.zeros((0, 2), np.int64)
        known = (ends >= 0).all(axis=1)
        kinds.append(p.pair_features[known])
        same.append(ends[known, 0] == ends[known, 1])
    kinds, same = (np.concatenate([*kinds, np.zeros((0, len(EDGE_PRIOR)))]), np.concatenate([*same, np.zeros(0, bool)]).astype(int))
    edge = _logistic(kinds, same, np.ones(len(same)), EDGE_PRIOR, EDGE_PULL) if len(same) else EDGE_PRIOR
    views = [view for p in held for view in _less_telling(p)]
    scores = {s: np.mean([text_f1(labelled(v, Weights(block, edge, s)), v) for v in views]) if views else -abs(np.log(s)) for s in SCALES}
    return Weights(block, edge, max(SCALES, key=lambda s: (scores[s], s)))


def _less_telling(page: Shape) -> list[Shape]:
    """A page without what encloses its blocks, without their own tags too, and
    with all tags alike."""
    around, tags, pairs = page.features.copy(), page.features.copy(), page.pair_features.copy()
    around[:, -AROUND:] = 0.0
    tags[:, -TELLING:] = 0.0
    pairs[:, 2] = 1.0
    return [replace(page, features=around), replace(page, features=tags), replace(page, features=tags, pair_features=pairs)]


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Weights:
    """``fitted`` to a bounded sample of pages, with all their blocks."""
    small_batches(pages.sparkSession)
    sample = thinned(pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")), F.col("id"), TRAIN_PAGES)

    def run(batches):
        for part in slices(batches):
            shapes = [pickle.dumps(shape(blocks(page))) for page in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(shapes, pa.binary())], ["shape"])

    got = sample.select("html").mapInArrow(run, "shape binary").toArrow().column(0).to_pylist()
    return fitted([pickle.loads(x) for x in sorted(got)])  # in an order that does not depend on tasks


def extract(pages: DataFrame, weights: Weights, keep: tuple = ("page_id", "url"), html_col: str = "html",
            out: str = "text") -> DataFrame:
    """``keep`` columns and the main text of each page (empty if none)."""
    small_batches(pages.sparkSession)
    keep = [c for c in keep if c != out]
    fields = [pages.schema[c] for c in keep]

    def run(batches):
        for part in slices(batches):
            texts = [main_text(p, weights) for p in part.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string())], [*keep, out])

    rows = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(html_col).alias("_llm_html"))
    return rows.mapInArrow(run, StructType([*fields, StructField(out, StringType())]))
