"""Main-text extraction from HTML by a minimum cut.

A page is scanned once into blocks: runs of text between block-level tags, each with its elements, its
link share and its place. A block's gain is the log-odds that it is content: what a logistic classifier says of its text, links, place and
neighbours, and what the markup around it says. The two labels' costs become capacities from the source and to the sink. Blocks that follow
each other, and blocks that share a parent or a near ancestor, are tied by smoothness edges. The maximum flow's
cut is the labelling of least total cost, so that a doubtful block (a two-word paragraph) goes with its neighbours, and
a block with strong evidence of its own (an advert inside an article) does not.

The classifier sees no sectioning markup and no class names: it is trained on a bounded sample of pages (``SAMPLE``, those whose hash is lowest,
``BLOCKS`` evenly spaced blocks of each) on which ``article`` and ``main`` against ``nav``, ``footer``, ``aside`` and ``form`` give the labels. So it
carries what it learnt of texts to pages without such markup.

Markup is evidence too. A sectioning element's is of fixed strength (``BAD``, ``GOOD``). That of a class or id is learnt: on the sample's pages that have
an ``article`` or ``main``, blocks under the name are counted inside and outside of it, and its weight is the log-odds of these counts. A list of words gives no more
than the pseudo-counts that they begin with (``SURE``, ``MAYBE``, ``PART`` for a word in a longer name), and a few blocks outvote it. Prose outvotes a name that only may mean
boilerplate, or has it as a part; one that means nothing else is outvoted by where the sample's pages have it. Evidence against an element
is dropped where hardly any running text of the page (``LEFT``) would be left without it: a wrapper around the article is not boilerplate whatever it is called. A page of which nothing
would be kept keeps the best of what no strong evidence speaks against, so that bare text, a list or a table alone is a text.

Reading: ``script``, ``style``, ``head``, ``template``, ``noscript``, ``svg``, form controls, players and comments hold no text, and are skipped to their own end tag;
unclosed and stray tags are tolerated. Character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined in page order by a blank line.

Cases: null and empty html give an empty text; html without tags is one block; unclosed comments and scripts end the page; repeated pages give the same text; a
sample without labels falls back on fixed text weights and the lists; of an ``object`` the text within counts; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.textbuf import trimmed

#: Pages that are learnt from, and blocks of each, at most.
SAMPLE, BLOCKS = 2_000, 60
#: Log-odds of a sectioning element against and for content.
BAD, GOOD = -12.0, 3.0
#: Log-odds that a name begins with: one that means boilerplate and hardly ever anything else, one that may, one of which such a word is a part, one that means content.
SURE, MAYBE, PART, KIND = -4.5, -1.5, -1.0, 2.0
#: Blocks that these count as; bounds of what a name can weigh; share of it on a paragraph or heading; evidence from which an element may be cleared.
PSEUDO, LOWEST, HIGHEST, LEAF, CLEAR = 4.0, -4.5, 2.0, 0.5, -2.5
#: Names whose weights are learnt, at most: those with most blocks.
NAMES = 5_000
#: Share of a page's words outside links that evidence against elements must leave; words of an element that is worth clearing.
LEFT, LEFT_WORDS = 0.12, 12
#: Weight of smoothness edges: between neighbours, and between blocks with one parent.
NEAR, KIN = 0.35, 0.6
#: Ancestors that a block remembers for its distance to others.
DEPTH = 16

SKIPPED = frozenset("script style head template noscript svg select option textarea iframe canvas audio video button title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MATH = "math mi mo mn ms mtext mspace mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mstyle mpadded mfenced semantics annotation"
INLINE = frozenset(MATH.split()) | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr br".split())
#: Elements that a new block-level start tag closes if they are open innermost.
CLOSES = {"li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "tr": ("p", "td", "th", "tr"), "td": ("p", "td", "th"), "th": ("p", "td", "th")}
#: Elements that tell of boilerplate and of content. Words of classes, ids and roles: that mean boilerplate, that may, that tell of content, and that only say
#: where or how an element stands; beginnings of names that say the contrary or nothing.
BAD_TAGS = frozenset("nav footer aside form header menu dialog fieldset".split())
GOOD_TAGS = frozenset("article main".split())
SURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs footer masthead sidebar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login comment comments disqus pagination pager share sharing toolbar related recommended complementary contentinfo".split()
)
MAYBE_WORDS = frozenset("header alert form search social legal copyright reply replies respond rail aside widget skip tags".split())
GOOD_WORDS = frozenset("article content entry post story body main text articlebody".split())
PLACE_WORDS = frozenset("site page top bottom left right inner outer wrap wrapper container box bar block section area list item items slot unit panel global primary secondary layout row col column grid group link links btn icon title head foot fixed sticky widgets articles posts stories entries".split())
NOT_WORDS = frozenset("has have had no not non with without is are hide show js tag category type status format".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li td th dt dd blockquote pre figcaption caption".split())

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z))", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|style|itemprop|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_BLANK = re.compile(r"\s+")


class Block:
    """A run of text: its link characters, its innermost element's name, and the numbers of its elements from the page down."""

    __slots__ = ("text", "links", "tag", "path", "heading")

    def __init__(self, text: str, links: int, tag: str, path: tuple[int, ...]) -> None:
        self.text, self.links, self.tag, self.path = text, links, tag, path
        self.heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()


class Element:
    """A block-level element: its parent's number, log-odds of the evidence against and for it, whether its name is sectioning, its classes and ids, and its words outside links."""

    __slots__ = ("parent", "bad", "good", "label", "names", "words")

    def __init__(self, parent: int, bad: float, good: float, label: int, names: tuple[str, ...] = ()) -> None:
        self.parent, self.bad, self.good, self.label, self.names, self.words = parent, bad, good, label, names, 0


def begun(name: str) -> float:
    """The log-odds that a class, id or role begins with, by its words."""
    words = _WORD.findall(name)
    if not words or (len(words) > 1 and (words[0] in NOT_WORDS or words[-1] == "free")):
        return 0.0
    bad = [w for w in words if w in SURE_WORDS or w in MAYBE_WORDS]
    if bad and all(w in SURE_WORDS or w in MAYBE_WORDS or w in PLACE_WORDS or w in GOOD_WORDS for w in words) and words[-1] not in ("story", "text", "body"):
        return SURE if any(w in SURE_WORDS for w in bad) else MAYBE
    if words[0] in bad or words[-1] in bad:
        return PART
    return KIND if any(w in GOOD_WORDS for w in words) else 0.0


def learnt(name: str, inside: int, outside: int) -> float:
    """The log-odds of a name that stood over so many blocks inside an article and outside of one."""
    p = 1 / (1 + math.exp(-begun(name)))
    return min(HIGHEST, max(LOWEST, math.log((inside + PSEUDO * p) / (outside + PSEUDO * (1 - p)))))


def _evidence(tag: str, attrs: str, known: dict[str, float]) -> tuple[float, float, bool, tuple[str, ...]]:
    """Log-odds against and for an element, whether it is hidden, and its names."""
    bad, good, hidden, names = BAD * (tag in BAD_TAGS), GOOD * (tag in GOOD_TAGS), False, ()
    if attrs and not attrs.isspace():
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                hidden = True
            elif name in ("class", "id", "role", "itemprop"):
                names += tuple(value.split())
        weak = LEAF if tag in LEAVES else 1.0
        for x in names:
            w = known.get(x)
            w = (begun(x) if w is None else w) * weak
            bad, good = min(bad, w), max(good, w)
    return bad, 0.0 if bad <= CLEAR else good, hidden, names


def blocks(page: str, known: dict[str, float] = {}) -> tuple[list[Block], list[Element]]:  # noqa: B006
    """The text blocks of a page, in its order, and its elements; element 0 is the page. ``known``: the learnt weights of names."""
    out: list[Block] = []
    elements = [Element(-1, 0.0, 0.0, 0)]
    # open elements: name, whether it is in an article, place, name and number of the innermost block, its last ancestors
    stack: list[tuple[str, bool, int, str, int, tuple[int, ...]]] = [("", False, 0, "", 0, (0,))]
    opened: dict[str, int] = {}
    parts: list[str] = []
    links = 0
    in_link = 0
    pos, n = 0, len(page)

    def flush() -> None:
        nonlocal links
        if parts:
            text = _BLANK.sub(" ", _html.unescape("".join(parts))).strip()
            if text:
                _, _, _, tag, own, path = stack[-1]
                out.append(Block(text, links, tag, path))
                if len(text) > links:  # words outside links
                    elements[own].words += int((text.count(" ") + 1) * (1 - links / len(text)))
            parts.clear()
        links = 0

    def close(at: int) -> None:
        for e in stack[at:]:
            opened[e[0]] -= 1
        del stack[at:]

    while pos < n:
        m = _TAG.search(page, pos)
        if m is None:
            parts.append(page[pos:])
            break
        if m.start() > pos:
            piece = page[pos : m.start()]
            parts.append(piece)
            if in_link:
                links += len(piece)
        pos = m.end()
        if m[2] is None:
            continue
        name, end = m[2].lower(), m[1] == "/"
        if end:
            if name in VOID:
                continue
            if name not in INLINE:
                flush()
            if opened.get(name):
                low = stack[-1][2] if name in INLINE else 0  # an inline end tag does not close the block it stands in
                at = next((i for i in range(len(stack) - 1, low, -1) if stack[i][0] == name), 0)
                if at:
                    close(at)
            if name == "a":
                in_link = max(0, in_link - 1)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name == "hr":
            flush()
            continue
        if name in VOID:
            continue
        bad, good, hidden, names = _evidence(name, m[3] or "", known)
        if name in SKIPPED or hidden:
            if name not in INLINE:
                flush()
            if (m[3] or "").rstrip().endswith("/") and name == "svg":
                continue
            pos = _skip(page, pos, name)
            continue
        if name in INLINE:
            if name == "a":
                in_link += 1
            top = stack[-1]
            stack.append((name, *top[1:]))
            opened[name] = opened.get(name, 0) + 1
            continue
        flush()
        for closed in CLOSES.get(name, ("p",)):
            block = stack[-1][2]
            if block and stack[block][0] == closed:
                close(block)
        top = stack[-1]
        inside = top[1] or name in GOOD_TAGS
        if name == "header" and top[1]:  # an article's own header is content
            bad = 0.0
        if name in ("body", "html"):  # their classes tell of the whole page
            bad = good = 0.0
        elements.append(Element(top[4], bad, good, -1 if name in ("nav", "footer", "aside", "form") else int(name in GOOD_TAGS), names))
        stack.append((name, inside, len(stack), name, len(elements) - 1, (*top[5][-DEPTH:], len(elements) - 1)))
        opened[name] = opened.get(name, 0) + 1
    flush()
    for e in reversed(elements[1:]):  # children come after their parents
        elements[e.parent].words += e.words
    return out, elements


def _skip(page: str, pos: int, name: str) -> int:
    """The place after the end tag that matches an element begun before ``pos``. ``head`` also ends where the body begins."""
    if name == "head":
        m = re.compile(r"</head\s*>|(?=<body\b)", re.I).search(page, pos)
        if m is None:
            return pos
        return m.end()
    raw = name in ("script", "style", "textarea", "title", "iframe")
    find = re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])[^>]*(>|\Z)", re.I)
    depth = 1
    while depth:
        m = find.search(page, pos)
        if m is None:
            return len(page)
        pos = m.end()
        if m[1]:
            depth -= 1
        elif not raw:
            depth += 1
    return pos


N_FEATURES = 14


def features(bs: list[Block]) -> np.ndarray:
    """A row for each block: its text, its links, its place, its neighbours. Nothing of sectioning elements and class names."""
    n = len(bs)
    x = np.zeros((n, N_FEATURES))
    for i, b in enumerate(bs):
        t = b.text
        words = t.count(" ") + 1
        x[i, 0] = min(1.0, math.log1p(words) / 5)
        x[i, 1] = min(1.0, b.links / max(1, len(t)))
        x[i, 2] = t[-1] in ".!?…\"”»"
        x[i, 3] = min(1.0, (t.count(",") + t.count(".")) / 10)
        x[i, 4] = words <= 4
        x[i, 5] = "©" in t or "|" in t or "·" in t
        x[i, 6] = b.tag in ("p", "blockquote", "pre")
        x[i, 7] = b.heading
        x[i, 8] = b.tag in ("li", "ul", "ol", "td")
    near = x[:, :2]
    both = np.maximum(1, (np.arange(n) > 0).astype(int) + (np.arange(n) < n - 1))[:, None]
    around = np.zeros((n, 2))
    around[1:] += near[:-1]
    around[:-1] += near[1:]
    x[:, 9:11] = around / both
    x[:, 11] = np.arange(n) / max(1, n - 1)
    x[:, 12] = x[:, 0] * (1 - x[:, 1])
    x[:, 13] = 1.0
    return x


#: Weights where no sample teaches better: length, few links and sentences speak for content.
FALLBACK = np.array([1.5, -4.0, 0.5, 1.0, -0.5, -2.5, 0.8, 1.2, -0.3, 1.0, -1.0, -0.3, 1.0, -0.9])


def believed(elements: list[Element]) -> list[float]:
    """The evidence against each element, without that which would leave hardly any running text.

    The element against which there is evidence that holds most words is cleared, as long as too few are left outside all such elements, none
    of them in an element with evidence for it. A
    sectioning element such as ``form`` is cleared only if it holds one with evidence for it, or nearly all words.
    """
    bad = [e.bad if e.bad <= CLEAR else 0.0 for e in elements]
    total = elements[0].words
    holds = [e.label > 0 or e.good >= KIND for e in elements]
    children: list[list[int]] = [[] for _ in elements]
    for i in range(len(elements) - 1, 0, -1):
        holds[elements[i].parent] |= holds[i]
        children[elements[i].parent].append(i)
    outer: list[tuple[int, int, bool]] = []  # the outermost elements with evidence against them
    left, sure = total, False

    def descend(todo: list[tuple[int, bool]]) -> None:
        nonlocal left, sure
        while todo:
            i, good = todo.pop()
            e = elements[i]
            if bad[i]:
                left -= e.words
                heapq.heappush(outer, (-e.words, i, good))
                continue
            good |= e.good >= KIND
            sure |= good and e.words > sum(elements[c].words for c in children[i])
            todo += [(c, good) for c in children[i]]

    descend([(0, False)])
    while outer and not sure and left < LEFT * total:
        words, i, good = heapq.heappop(outer)
        if -words < LEFT_WORDS:
            break
        if bad[i] > BAD or holds[i] or -words > (1 - LEFT / 2) * total:
            bad[i] = 0.0
            left -= words
            descend([(i, good)])
    return [b or (e.bad if e.bad > CLEAR else 0.0) for b, e in zip(bad, elements, strict=True)]


def markup(bs: list[Block], elements: list[Element]) -> np.ndarray:
    """Log-odds by the markup around each block: the strongest believed evidence against, and the strongest for."""
    own = believed(elements)
    bad, good = [0.0] * len(elements), [0.0] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        # what speaks for an element counts for nothing inside one that strong evidence is against: a comment that is an ``article``
        bad[i], good[i] = min(bad[e.parent], own[i]), 0.0 if bad[e.parent] <= CLEAR else max(good[e.parent], e.good)
    return np.array([bad[b.path[-1]] + good[b.path[-1]] for b in bs])


def costs(bs: list[Block], side: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log-odds of content, bounded: those of the text, and those of the markup."""
    return np.clip(np.clip(features(bs) @ weights, -4, 4) + side, -8, 8)


def min_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) of least cost, and of such the one with the fewest True: a block labelled against its gain pays it, an edge whose ends differ pays its weight.

    A block whose gain outweighs all its edges keeps its own label in every best labelling; it is taken out, and its edges become gains of
    its neighbours, until none is left. What remains is cut by Dinic's algorithm: flows along shortest paths, a layered graph at a time.
    """
    n = len(gain)
    gain = list(gain)
    ties: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b:
            ties[a][b] = ties[a].get(b, 0.0) + w
            ties[b][a] = ties[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    weight = [sum(t.values()) for t in ties]
    todo = list(range(n))
    while todo:
        i = todo.pop()
        if label[i] is not None or not (gain[i] > weight[i] + 1e-9 or -gain[i] >= weight[i] - 1e-9):
            continue
        label[i] = gain[i] > weight[i] + 1e-9
        for j, w in ties[i].items():
            if label[j] is None:
                gain[j] += w if label[i] else -w
                weight[j] -= w
                todo.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        at = {i: k for k, i in enumerate(rest)}
        links = [(at[i], at[j], w) for i in rest for j, w in ties[i].items() if j in at and i < j]
        for i, x in zip(rest, _dinic([gain[i] for i in rest], links), strict=True):
            label[i] = x
    return [bool(x) for x in label]


def _dinic(gain: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """The side of the source in a minimum cut of least such side."""
    n = len(gain)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    of: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, there: float, back: float) -> None:
        of[a].append(len(to))
        to.append(b)
        cap.append(there)
        of[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, g in enumerate(gain):
        if g > 0:
            add(s, i, g, 0.0)
        elif g < 0:
            add(i, t, -g, 0.0)
    for a, b, w in links:
        add(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = [s]
        for u in queue:
            for e in of[u]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        nxt = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if cap[e] <= 1e-9)
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while nxt[u] < len(of[u]):
                e = of[u][nxt[u]]
                if cap[e] > 1e-9 and level[to[e]] == level[u] + 1:
                    break
                nxt[u] += 1
            else:
                if u == s:
                    break
                level[u] = -1
                u = to[path.pop() ^ 1]
                nxt[u] += 1
                continue
            path.append(e)
            u = to[e]


def edges(bs: list[Block], side: np.ndarray) -> list[tuple[int, int, float]]:
    """Smoothness: neighbours in page order, more the nearer their common ancestor; and successive blocks of one parent. Neighbours of which
    the markup speaks differently (``side``) are tied weakly."""
    out = []
    last: dict[int, int] = {}
    for i, b in enumerate(bs):
        if i:
            a = bs[i - 1]
            common = len({*a.path} & {*b.path})
            apart = len(a.path) + len(b.path) - 2 * common
            crossing = abs(side[i] - side[i - 1]) > 1
            out.append((i - 1, i, NEAR * (0.3 if crossing else 1.0) / max(1, apart - 1)))
        parent = b.path[-2] if len(b.path) > 1 else 0
        if parent in last:
            out.append((last[parent], i, KIN))
        last[parent] = i
    return out


class Model:
    """Weights of the text classifier, and of the names that were learnt."""

    def __init__(self, weights: np.ndarray = FALLBACK, names: dict[str, float] | None = None) -> None:
        self.weights, self.names = weights, names or {}


def extract(page: str | None, model: Model = Model()) -> str:  # noqa: B008
    """The main text of a page."""
    bs, elements = blocks(page or "", model.names)
    if not bs:
        return ""
    side = markup(bs, elements)
    gain, ties = costs(bs, side, model.weights), edges(bs, side)
    keep = min_cut(gain.tolist(), ties)
    if not any(keep):  # nothing: the best of what only its text speaks against
        open_ = np.array([s > CLEAR and 2 * b.links < len(b.text) for s, b in zip(side, bs, strict=True)])
        if open_.any():
            keep = min_cut(np.where(open_, gain + max(0.0, 1 - gain[open_].max()), gain).tolist(), ties)
    return "\n\n".join(b.text for b, k in zip(bs, keep, strict=True) if k)


def labelled(bs: list[Block], elements: list[Element]) -> list[int]:
    """1 in an ``article`` or ``main``, -1 in a ``nav``, ``footer``, ``aside`` or ``form``, 0 where neither is; names say nothing here."""
    label = [0] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        up = label[e.parent]
        label[i] = -1 if up < 0 or e.label < 0 else max(up, e.label)
    return [label[b.path[-1]] for b in bs]


def named(bs: list[Block], elements: list[Element], label: list[int]) -> Iterator[tuple[str, int]]:
    """(name, 1 inside an article, else 0) for the blocks under each name, on a page that has an article."""
    if 1 not in label:
        return
    over: list[tuple[str, ...]] = [()] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        over[i] = (*over[e.parent], *e.names) if e.names else over[e.parent]
    for b, y in zip(bs, label, strict=True):
        for name in {*over[b.path[-1]]}:
            yield name, int(y > 0)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """x, y of labelled blocks; and name, y, c: in how many blocks a name stood inside and outside of an article."""
    for batch in batches:
        xs, ys, names = [], [], Counter()
        for page in batch.column("html").to_pylist():
            bs, elements = blocks(page or "")
            label = labelled(bs, elements)
            names.update(named(bs, elements, label))
            known = [j for j, y in enumerate(label) if y]
            if known:
                x = features(bs)
                for j in known if len(known) <= BLOCKS else [known[k * len(known) // BLOCKS] for k in range(BLOCKS)]:
                    xs.append(x[j].tolist())
                    ys.append(int(label[j] > 0))
        n, own = len(xs), list(names)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*xs, *[None] * len(own)], pa.list_(pa.float64())), pa.array([None] * n + [x for x, _ in own], pa.string()), pa.array([*ys, *[y for _, y in own]], pa.int32()), pa.array([1] * n + [names[x] for x in own], pa.int64())],
            names=["x", "name", "y", "c"],
        )


def train(pages: DataFrame, sample: int = SAMPLE) -> Model:
    """The classifier's weights, by Newton steps on the labelled blocks of the sample, L2-regularised towards the fixed ones; and the names' weights."""
    own = pages.where("html is not null").select(F.xxhash64("page_id", "html").alias("h"), "html")
    top = own.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if top is None:
        return Model()
    rows = own.where(F.col("h") <= F.lit(top)).dropDuplicates(["h"]).select("html")  # ``sample`` pages at most
    got = rows.mapInArrow(trimmed(_learn), "x array<double>, name string, y int, c long").groupBy("x", "name", "y").agg(F.sum("c").alias("c"))
    data = got.where("x is not null").orderBy(F.xxhash64("x", "y")).collect()  # ``sample`` times ``BLOCKS`` rows at most
    seen = got.where("name is not null").groupBy("name").agg(F.sum(F.when(F.col("y") > 0, F.col("c")).otherwise(0)).alias("inside"), F.sum("c").alias("c"))
    names = {r["name"]: learnt(r["name"], r["inside"], r["c"] - r["inside"]) for r in seen.orderBy(F.col("c").desc(), "name").limit(NAMES).collect()}
    if len({r["y"] for r in data}) < 2:
        return Model(names=names)
    x = np.array([r["x"] for r in data])
    y, c = np.array([r["y"] for r in data], float), np.array([r["c"] for r in data], float)
    c = c / c.sum() * 200
    w = FALLBACK.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (c * (p - y)) + 1.0 * (w - FALLBACK)
        hess = (x * (c * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return Model(np.round(w, 6), names)


def extracted(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py(), model) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return own.mapInArrow(trimmed(run), "page_id long, url string, text string, n_chars long")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extracted(pages, train(pages))
