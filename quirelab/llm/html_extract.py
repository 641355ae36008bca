"""Main text of web pages: block costs from a classifier, smoothed over the page by a minimum cut."""

from __future__ import annotations

import html as _html
import math
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import small_batches
from ._text import thrifty

SAMPLE = 1000
SAMPLE_BLOCKS = 20_000
BUCKETS = 1 << 14
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|href|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
PART = re.compile(r"[^\W_]+")
HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
# Elements by what HTML makes of their content.
SKIPPED = frozenset("script style template title iframe textarea select datalist button desc metadata".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark map meter nobr object canvas output picture progress q rp rt ruby s samp slot small span strike strong sub sup time tt u var".split()
)
MATH = frozenset(
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts none"
    " mtable mtr mlabeledtr mtd maction semantics annotation annotation-xml".split()
)
DRAWN = frozenset("svg g path rect circle ellipse line polyline polygon text tspan textpath defs use symbol clippath mask marker lineargradient radialgradient stop pattern filter image foreignobject animate".split())
APART = frozenset("br mspace mtr mlabeledtr mtd annotation annotation-xml text".split())
WITHIN = INLINE | MATH | DRAWN | (VOID - {"hr"})
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table body article main section div nav aside header footer form blockquote".split())
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
# What the standards say of elements and roles.
MAIN = frozenset("article main".split())
ASIDE = frozenset("nav footer aside form menu dialog fieldset head search navigation banner contentinfo complementary alertdialog toolbar menubar".split())
# What names weigh that no lesson has shown; for names that lessons show, the learned weight counts alone. A name that is a whole class, id or tag counts twice.
UNSEEN = {
    -10.0: "ad ads advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs captcha comment comments consent cookie cookies disqus gdpr masthead modal navbar newsletter pagination pager"
    " popup promo promoted promotion respond sidebar signup skip sponsor sponsored subscribe toolbar topbar widget",
    -6.0: "recommend recommended recommendations related",
    -5.0: "nav navigation reply replies thread",
    -4.0: "footer login menu overlay share sharing social trending",
    -2.0: "copyright disclaimer notice notices noscript search toc",
    -1.0: "header",
    -0.5: "byline tags",
    1.0: "article body content entry main page post story text",
}
START = {name: w for w, names in UNSEEN.items() for name in names.split()}
ANCHOR, PENALTY = 0.05, 5e-5  # how firmly the weights of shapes are held to DEFAULT, and all others to 0
SHAPED, MOST = 3.0, 1.5  # how much shapes, and names that speak for a block, can say
#: Neighbours on the page by tree distance: the share that are alike, before any page is seen, and how many pairs that guess counts for.
ALIKE, GUESSED, TIGHT = (0.9, 0.9, 0.85, 0.7, 0.65, 0.6), 20.0, 1.5
#: Smoothness between the next two blocks under one parent, or grandparent.
NEAR, WIDE = 0.4, 0.2


@dataclass(slots=True)
class Node:
    """An open element: where it stands, and what it and those around it say about the text inside."""

    tag: str
    parent: Node | None
    depth: int
    own: tuple[str, ...] = ()
    says: int = 0  # 1 in an article, -1 in what the standards set apart
    good: float = 0.0  # weights of the names around
    bad: float = 0.0
    hidden: bool = False
    scope: dict[str, int] = field(default_factory=dict)


@dataclass(slots=True)
class Block:
    node: Node
    parts: list[str] = field(default_factory=list)
    link: int = 0
    text: str = ""


@dataclass
class Model:
    """Weights of block features and of names by hash bucket (NaN where lessons have not shown it), how much an article element says on pages that have one, and the smoothness between neighbours on
    the page by the distance of their elements."""

    features: tuple[float, ...]
    names: np.ndarray
    marked: float
    next: tuple[float, ...]

    def weight(self, token: str) -> float:
        w = float(self.names[bucket(token)])
        return w if w == w else 0.0 if token[0] == "p" else START.get(token[2:], 0.0)


def bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % BUCKETS


def tokens_of(tag: str, label: str) -> list[str]:
    """Names of an element: each class and id as a whole, and their parts, set apart where a name has more than two; its tag, if the page made that up."""
    words = label.split()
    if "-" in tag or tag == "noscript":
        words.append(tag)
    out = [f"c:{w.lower()}" for w in words]
    for parts in (PART.findall(HUMP.sub(" ", w)) for w in words):
        out += [f"{'n' if len(parts) < 3 else 'p'}:{x.lower()}" for x in parts]
    return list(dict.fromkeys(out))


class _Reader:
    """One pass over a page; every step that looks ahead either moves on or is never tried again, so time is linear."""

    def __init__(self, page: str, model: Model):
        self.page, self.model = page, model
        self.gone: set[str] = set()  # what no longer comes on this page
        self.out: list[Block] = []
        self.node = Node("", None, 0)
        self.open: dict[str, int] = {}
        self.named: dict[str, int] = {}
        self.link_depth: int | None = None
        self.now = Block(self.node)
        self.weights: dict[str, float] = {}
        self.quotes = True

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        if (i := self.page.find(what, at)) < 0:
            self.gone.add(what)
        return i

    def tag_end(self, at: int) -> int:
        """Place of the > that ends a tag; one in quotes does not, unless there is no other."""
        i = at
        while self.quotes and ">" not in self.gone:
            m = STOP.search(self.page, i)
            if m is None:
                break
            if m.group() == ">":
                return m.start()
            j = self.find(m.group(), m.end())
            i = m.end() if j < 0 else j + 1
        self.quotes = False
        return self.find(">", at)

    def closing(self, tag: str, at: int) -> int:
        """End of the element's closing tag, or -1."""
        if f"</{tag}" in self.gone:
            return -1
        m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(self.page, at)
        if m is None:
            self.gone.add(f"</{tag}")
            return -1
        return m.end()

    def cut(self) -> None:
        if self.now.parts and not self.now.node.hidden:
            text = "".join(self.now.parts)
            self.now.text = " ".join((_html.unescape(text) if "&" in text else text).split())
            if self.now.text:
                self.out.append(self.now)
        self.now = Block(self.node)

    def write(self, s: str) -> None:
        self.now.parts.append(s)
        if self.link_depth is not None:
            self.now.link += len(s)

    def pop(self, tag: str) -> None:
        """Closes the open elements down to the nearest one of this name."""
        while True:
            gone = self.node
            self.node = gone.parent
            self.open[gone.tag] -= 1
            if gone.tag not in SCOPE:
                self.node.scope[gone.tag] -= 1
            for t in gone.own:
                self.named[t] -= 1
            if gone.tag == tag:
                break
        if self.link_depth is not None and self.node.depth < self.link_depth:
            self.link_depth = None

    def push(self, tag: str, rest: str) -> None:
        above, role, own, label = self.node, "", [], ""
        says, good, bad, hidden = above.says, above.good, above.bad, above.hidden
        if rest:
            found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(rest)}
            role = found.get("role", "").strip().lower()
            label = f"{found.get('class', '')} {found.get('id', '')}"
            hidden = hidden or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(found.get("style", "")))
        if tag in ASIDE or role in ASIDE or (tag == "header" and says <= 0) or (tag == "article" and says > 0):  # an article in an article is a reader's comment
            says = -1
        elif (tag in MAIN or role in MAIN) and says >= 0:
            says = 1
        if tag not in ("html", "body"):
            own = tokens_of(tag, label)
            for t in own:
                if not self.named.get(t):
                    if (w := self.weights.get(t)) is None:
                        w = self.weights[t] = self.model.weight(t)
                    good, bad = (good + w, bad) if w > 0 else (good, bad + w)
                self.named[t] = self.named.get(t, 0) + 1
        scope = {} if tag in SCOPE else self.node.scope
        if tag not in SCOPE:
            scope[tag] = scope.get(tag, 0) + 1
        self.open[tag] = self.open.get(tag, 0) + 1
        self.node = Node(tag, above, above.depth + 1, tuple(own), says, good, bad, hidden, scope)

    def start(self, tag: str, rest: str, at: int) -> int:
        if tag in SKIPPED and not (tag == "button" and any(self.node.scope.get(h) for h in HEADS)):
            end = -1 if rest.endswith("/") and tag not in ("script", "style") else self.closing(tag, at)
            return end if end >= 0 else len(self.page) if tag in ("script", "style") else at
        if tag in WITHIN or tag == "button":
            if tag in APART:
                self.now.parts.append(" ")
            elif tag == "a":
                self.link_depth = self.node.depth if "href" in rest.lower() else None
            return at
        for shut in CLOSES.get(tag, ("p",)):
            if self.node.scope.get(shut):
                self.pop(shut)
        if tag not in VOID:
            self.push(tag, rest)
        self.cut()
        return at

    def blocks(self) -> list[Block]:
        page, at, end = self.page, 0, len(self.page)
        while at < end:
            i = page.find("<", at)
            if i < 0:
                i = end
            if i > at:
                self.write(page[at:i])
            if i >= end:
                break
            mark = page[i + 1 : i + 2]
            if mark == "/" or mark.isalpha() and mark.isascii():
                m = NAME.match(page, i + 1 + (mark == "/"))
                stop = self.tag_end(m.end()) if m else self.find(">", i)
                if stop < 0:
                    self.write("<")
                    at = i + 1
                    continue
                at = stop + 1
                if m is None:
                    continue
                tag = m.group().lower()
                if mark != "/":
                    at = self.start(tag, page[m.end() : stop].rstrip(), at)
                elif tag == "a":
                    self.link_depth = None
                elif tag not in WITHIN:
                    if self.open.get(tag):
                        self.pop(tag)
                    if tag not in SKIPPED:
                        self.cut()
            elif page.startswith("<!--", i):
                j = i + 4 if page.startswith((">", "->"), i + 4) else self.find("-->", i + 4)
                at = end if j < 0 else page.index(">", j) + 1
            elif mark in ("!", "?"):
                j = self.find(">", i)
                at = end if j < 0 else j + 1
            else:
                self.write("<")
                at = i + 1
        self.cut()
        return self.out


def features(b: Block) -> list[float]:
    """What a block looks like, and last whether the standards set its element apart."""
    words, size = b.text.count(" ") + 1, len(b.text)
    return [
        1.0, math.log1p(words), min(b.link / size, 1.0), float(b.text[-1] in ".!?\"'…:。！？"), float(words < 4), float(b.node.tag == "p"), float(b.node.tag in HEADS), float(b.node.tag == "li"),
        min(sum(map(b.text.count, ",;.")) / words, 1.0), float(b.node.says < 0),
    ]


#: For tables whose pages teach nothing.
DEFAULT = Model((-1.5, 0.7, -4.0, 0.8, -1.0, 1.0, 0.8, -0.5, 0.5, -6.0), np.full(BUCKETS, np.nan, np.float32), 4.5, tuple(0.5 * math.log(p / (1 - p)) for p in ALIKE))
FEATURES = len(DEFAULT.features)


def blocks(page: str, model: Model = DEFAULT) -> list[Block]:
    """Runs of text between the edges of block elements, in page order; unclosed and stray tags are tolerated."""
    return _Reader(page, model).blocks()


def cost(b: Block, model: Model, marked: bool) -> float:
    """Log odds that a block is main text: its shape (within SHAPED), whether it is set apart, the names around it, and on pages with an article element (`marked`) whether that holds it."""
    x = features(b)
    z = max(-SHAPED, min(SHAPED, sum(w * v for w, v in zip(model.features[:-1], x[:-1], strict=True))))
    inside = (model.marked if b.node.says > 0 else -model.marked) if marked else 0.0
    return z + model.features[-1] * x[-1] + min(MOST, b.node.good) + b.node.bad + inside


def distance(a: Node, b: Node) -> int:
    """Edges of the element tree between two nodes."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def edges(found: list[Block], model: Model = DEFAULT) -> dict[tuple[int, int], float]:
    """Smoothness: between neighbours on the page, by the distance of their elements, and between the next two blocks under one parent, or grandparent."""
    out: dict[tuple[int, int], float] = {}
    last: dict[tuple[int, int], int] = {}
    for i, b in enumerate(found):
        if i:
            out[i - 1, i] = model.next[min(distance(found[i - 1].node, b.node), len(ALIKE) - 1)]
        holder = b.node
        for level, w in ((1, NEAR), (2, WIDE)):
            holder = holder.parent or holder
            if (j := last.get((level, id(holder)))) is not None:
                out[j, i] = out.get((j, i), 0.0) + w
            last[level, id(holder)] = i
    return out


def settle(costs: list[float], around: list[dict[int, float]]) -> list[bool | None]:
    """Labels of blocks whose cost outweighs all their links; each is joined to its terminal, which changes no minimum. costs and around are brought up to date."""
    fixed: list[bool | None] = [None] * len(costs)
    queue = deque(range(len(costs)))
    while queue:
        i = queue.popleft()
        if fixed[i] is None and abs(costs[i]) > sum(around[i].values()):
            fixed[i] = costs[i] > 0
            for j, w in around[i].items():
                costs[j] += w if fixed[i] else -w
                del around[j][i]
                queue.append(j)
            around[i] = {}
    return fixed


def max_flow(costs: list[float], around: list[dict[int, float]], open_: list[int]) -> set[int]:
    """Blocks on the side of main text once no more flows: shortest augmenting paths, a level graph at a time."""
    s, t = -1, -2
    cap: dict[int, dict[int, float]] = {i: dict(around[i]) for i in open_} | {s: {}, t: {}}
    for i in open_:
        a, b = (s, i) if costs[i] > 0 else (i, t)
        cap[a][b] = abs(costs[i])
        cap[b].setdefault(a, 0.0)
    while True:
        level, todo = {s: 0}, deque([s])
        while todo:
            u = todo.popleft()
            for v, c in cap[u].items():
                if c > 1e-9 and v not in level:
                    level[v] = level[u] + 1
                    todo.append(v)
        if t not in level:
            return set(level)
        arcs = {u: iter(list(cap[u])) for u in level}
        path = [s]
        while path:
            u = path[-1]
            if u == t:
                flow = min(cap[a][b] for a, b in zip(path, path[1:], strict=False))
                cutoff = len(path)
                for k, (a, b) in enumerate(zip(path, path[1:], strict=False)):
                    cap[a][b] -= flow
                    cap[b][a] = cap[b].get(a, 0.0) + flow
                    if cap[a][b] <= 1e-9:
                        cutoff = min(cutoff, k + 1)
                path = path[:cutoff]
                continue
            for v in arcs[u]:
                if level.get(v) == level[u] + 1 and cap[u].get(v, 0.0) > 1e-9:
                    path.append(v)
                    break
            else:
                path.pop()


def min_cut(costs: list[float], links: dict[tuple[int, int], float]) -> list[bool]:
    """Labels with the least sum of costs gone against and links cut (ties: boilerplate), by maximum flow."""
    around: list[dict[int, float]] = [{} for _ in costs]
    for (i, j), w in links.items():
        around[i][j] = around[i].get(j, 0.0) + w
        around[j][i] = around[j].get(i, 0.0) + w
    costs = list(costs)
    fixed = settle(costs, around)
    if open_ := [i for i, x in enumerate(fixed) if x is None]:
        main = max_flow(costs, around, open_)
        for i in open_:
            fixed[i] = i in main
    return fixed


def labels(found: list[Block], model: Model = DEFAULT) -> list[bool]:
    """Which blocks of a page are main text: the minimum cut of their costs."""
    marked = any(b.node.says > 0 for b in found)
    return min_cut([cost(b, model, marked) for b in found], edges(found, model))


def main_text(page: str, model: Model = DEFAULT) -> str:
    found = blocks(page, model)
    return "\n\n".join(b.text for b, k in zip(found, labels(found, model), strict=True) if k)


AROUND = 64


def lesson(found: list[Block]) -> list[tuple[list[float], list[int], int, bool, bool]]:
    """Features, buckets of names, distance to the block before (-1: none), whether that has the same label, and label of each block of a page that marks its article
    with a standard element: inside of it or outside. Names are taken from the AROUND nearest elements, so that very deep pages stay cheap to learn from."""
    out = []
    if any(b.node.says > 0 for b in found):
        for i, b in enumerate(found):
            names, x, before = [], b.node, found[i - 1].node
            for _ in range(AROUND):
                if x is None:
                    break
                names += x.own
                x = x.parent
            apart = min(distance(before, b.node), len(ALIKE) - 1) if i else -1
            out.append((features(b), [bucket(t) for t in dict.fromkeys(names)], apart, (before.says > 0) == (b.node.says > 0), b.node.says > 0))
    return out


LESSONS = pa.schema([("x", pa.list_(pa.float64())), ("names", pa.list_(pa.int32())), ("apart", pa.int32()), ("same", pa.bool_()), ("y", pa.bool_())])


def _lessons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in thrifty(batches):
        rows = [r for page in batch.column("html").to_pylist() if page for r in lesson(blocks(page))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(LESSONS.types)], schema=LESSONS)


def train(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE, most: int = SAMPLE_BLOCKS) -> Model:
    """A logistic regression over block features and hashed names, taught by pages that mark their article with standard elements.

    Shapes are fitted alone, so that they tell what they can; their weights start from, and are held to, DEFAULT, since few sites show all shapes. Names and what is set apart are fitted alone too, from 0,
    held by a small penalty. What an article element says on pages that have one is fitted last, given the others: it is what is to be told, so the others serve pages without it. The smoothness between neighbours is half the log odds that they are alike. Fits on the
    pages whose ids hash smallest, `sample` at most, one row an id, and of their blocks on the `most` that hash smallest. DEFAULT without both kinds of blocks.
    """
    rows = pages.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    ids = rows.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = rows.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("html").alias("html"))
    found = rows.select("html").mapInArrow(_lessons, "x array<double>, names array<int>, apart int, same boolean, y boolean")
    got = found.orderBy(F.xxhash64(*LESSONS.names), *LESSONS.names).limit(most).toArrow()
    y = got.column("y").to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return DEFAULT
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), FEATURES)
    at = got.column("names").combine_chunks()
    doc, at = np.repeat(np.arange(len(y)), at.value_lengths().to_numpy()), at.flatten().to_numpy()
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    look, first = x[:, :-1], np.array(DEFAULT.features[:-1])

    def fit(values: list[np.ndarray], logit, gradients) -> None:
        """Adam over the whole sample."""
        m, v = [np.zeros_like(a) for a in values], [np.zeros_like(a) for a in values]
        for t in range(1, 301):
            g = balance * (1 / (1 + np.exp(-np.clip(logit(), -30, 30))) - y) / len(y)
            for k, (value, grad) in enumerate(zip(values, gradients(g), strict=True)):
                m[k] += 0.1 * (grad - m[k])
                v[k] += 0.01 * (grad * grad - v[k])
                value -= 0.05 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)

    shape, apart_, names = first.copy(), np.zeros(2), np.zeros(BUCKETS)
    fit([shape], lambda: look @ shape, lambda g: [look.T @ g + ANCHOR * (shape - first)])
    named = lambda: np.bincount(doc, weights=names[at], minlength=len(y))
    fit([apart_, names], lambda: apart_[0] * x[:, -1] + apart_[1] + named(), lambda g: [np.array([x[:, -1] @ g, g.sum()]) + PENALTY * apart_, np.bincount(at, weights=g[doc], minlength=BUCKETS) + PENALTY * names])
    w = np.append(shape, apart_[0])
    z, side, marked = np.clip(look @ shape, -SHAPED, SHAPED) + apart_[0] * x[:, -1] + named(), np.where(y == 1, 1.0, -1.0), 0.0
    for _ in range(50):  # Newton's method for one weight
        p = 1 / (1 + np.exp(-np.clip(z + marked * side, -30, 30)))
        marked -= ((balance * (p - y) * side).mean() + PENALTY * marked) / ((balance * p * (1 - p)).mean() + PENALTY)
    apart, same = got.column("apart").to_numpy(), got.column("same").to_numpy(zero_copy_only=False)
    alike, other = (np.bincount(apart[(apart >= 0) & (same == k)], minlength=len(ALIKE)) for k in (True, False))
    odds = np.log((alike + GUESSED * np.array(ALIKE)) / (other + GUESSED * (1 - np.array(ALIKE))))
    smooth = tuple(float(round(z, 6)) for z in np.clip(0.5 * odds, 0, TIGHT))
    names[np.bincount(at, minlength=BUCKETS) == 0] = np.nan
    return Model(tuple(float(round(z, 6)) for z in w), names.round(4).astype(np.float32), float(round(marked, 6)), smooth)


TEXTS = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string())])


def _extract(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in thrifty(batches):
            texts = [main_text(p, model) if p else "" for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], schema=TEXTS)

    return run


def extract_main_text(pages: DataFrame, model: Model = DEFAULT, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url, text, n_chars) for every page: its main text, blocks joined by an empty line.

    The page is cut into blocks at the edges of block elements. A block's cost is the log odds of a classifier over its shape, the standard elements that set it apart, the names
    (classes, ids) around it, and, on pages that have one, whether an article element holds it. All these weights are learned; UNSEEN serves only names that no lesson has shown. Costs are capacities to
    the two terminals; neighbours on the page and in the element tree are linked, the more the nearer; maximum flow finds the minimum cut, which parts main text from the rest. Hidden elements
    have no text. Character references are decoded and white space becomes one space. Time is linear in the page but for the flow among blocks that are not settled.

    Null or empty html: empty text. A page without tags is one block, judged by its shape. Equal costs on both sides: boilerplate. Repeated and null
    ids stay as rows. Empty table: empty result. Other columns are ignored.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = rows.mapInArrow(_extract(model), "id long, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias("url"), "text", F.char_length("text").cast("long").alias("n_chars"))
