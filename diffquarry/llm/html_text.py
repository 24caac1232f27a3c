"""Main text of web pages by minimum-cut labelling of their text blocks."""

from __future__ import annotations

import html
import math
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")
NAME, WORDS = re.compile(r"[a-z]+"), re.compile(r"\S+")
#: Hidden parts aren't silent: they are weighed like others, against this.
HIDDEN, HIDDEN_COST = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden"), -1.0

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page: code, fields of forms, and what stands in for media that can't be shown.
SILENT = frozenset("script style noscript template title textarea select option iframe object audio video canvas head datalist".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br button cite code data del dfn em font i img ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr "
    "mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot munder mover munderover mstyle mpadded semantics annotation".split()
)
#: What an opening tag ends if it is still open, up to the list or table around it.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDERS = ("ul", "ol", "dl", "table", "tbody")
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CORE = ("article", "main")

#: Evidence for (above 0) or against an article in the tags, roles and names around a block, in nats. Evidence against
#: counts by the strongest element around a block, evidence for adds up to 4 at most.
TAG_COST = {"article": 4.0, "main": 3.0, "nav": -8.0, "footer": -8.0, "aside": -8.0, "form": -8.0, "menu": -8.0, "dialog": -8.0, "header": -4.0, "fieldset": -6.0, "address": -1.0, "button": -4.0, "svg": -2.0}
ROLE_COST = {"main": 3.0, "article": 4.0, "navigation": -8.0, "banner": -6.0, "contentinfo": -8.0, "complementary": -8.0, "search": -8.0, "dialog": -8.0, "alert": -8.0, "alertdialog": -8.0, "menu": -8.0, "menubar": -8.0, "form": -8.0}
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar aside menu nav navbar navigation breadcrumb "
    "breadcrumbs footer foot masthead share sharing social related recommended recommendations comment comments commentlist reply replies disqus discussion respond responses newsletter subscribe subscription signup login "
    "widget widgets search toolbar pagination pager copyright legal disclaimer skip tags tagcloud trending popular header".split()
)
#: Parts of names that say where or what a box is, not what it holds.
NEUTRAL = frozenset(
    "area bar bars block body bottom box boxes btn button buttons cloud col column columns container content desktop details entry fixed float footer form global group header heading holder icon icons inner item items left "
    "link links list main meta middle mobile module outer page panel part post posts primary right row secondary section site slot sticky story stories text thread title top unit user users view wrap wrapper zone".split()
)
GOOD = frozenset("article content story post entry main prose".split())


def name_cost(name: str, inside: bool) -> float:
    """Nats of one class or id. It must be made of words for boilerplate, besides neutral ones, as a whole: 'site-footer'
    and 'cookie-notice' are, 'no-sidebar', 'has-comments' and 'social-science' say something else."""
    parts = NAME.findall(name)
    bad = [x for x in parts if x in BOILERPLATE and not (inside and x == "header")]
    if bad and all(x in BOILERPLATE or x in NEUTRAL for x in parts):
        return -4.0 if bad == ["header"] else -8.0
    return 1.5 if parts and not bad and all(x in GOOD or x in NEUTRAL for x in parts) and any(x in GOOD for x in parts) else 0.0


class Element:
    """One element: what it says about its content, and what it holds."""

    __slots__ = ("tag", "parent", "tag_cost", "cost", "core", "cores", "chars", "below")

    def __init__(self, tag: str, parent: Element | None, attributes: str):
        self.tag, self.parent, self.chars, self.below = tag, parent, 0, 0.0
        inside = parent is not None and parent.core
        self.tag_cost, names, role = 0.0 if inside and tag == "header" else TAG_COST.get(tag, 0.0), 0.0, 0.0
        if attributes and ("=" in attributes or "hidden" in attributes):
            costs = []
            for m in ATTRIBUTE.finditer(attributes):
                key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if key in ("class", "id", "itemprop", "data-role"):
                    costs += [name_cost(n, inside) for n in WORDS.findall(value)]
                elif key == "role":
                    role = ROLE_COST.get(value.strip(), 0.0)
                elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and HIDDEN.search(value):
                    costs.append(HIDDEN_COST)
            names = min(costs, default=0.0) or max(costs, default=0.0)
        self.cost = min(self.tag_cost, names, role) if min(self.tag_cost, names, role) < 0 else self.tag_cost + names + role
        own = (tag in CORE or role > 2) and self.cost >= 0
        self.core, self.cores = own or inside and self.cost > -8, int(own)


class Block:
    """Text between two block boundaries, with the elements around it."""

    __slots__ = ("element", "holder", "tag", "pieces", "linked", "chars", "apart")

    def __init__(self, element: Element, holder: tuple[int, int], tag: str, apart: int):
        self.element, self.holder, self.tag, self.apart, self.pieces, self.linked, self.chars = element, holder, tag, apart, [], 0, 0

    def text(self) -> str:
        return SPACE.sub(" ", html.unescape("".join(self.pieces))).strip()


def blocks(page: str) -> tuple[list[Block], list[Element]]:
    """The text blocks of a page in order, and its elements; scripts, styles, comments and fields have no text.

    Tags that never close, close twice or close in the wrong order only end what they can. Each tag is handled in time that
    doesn't grow with the depth.
    """
    root = Element("", None, "")
    made: list[Block] = []
    elements, stack = [root], [root]
    open_: dict[str, list[int]] = {}  # places in the stack by tag
    walls = [0]  # places in the stack of all that isn't inline
    links, silent, block, low, at = 0, 0, None, 1, 0  # low: fewest walls since the last block began

    def add(text: str):
        nonlocal block, low
        if silent or not text:
            return
        if block is None:
            if not text.strip():
                return
            before = made[-1].holder[1] if made else 1
            inner = stack[walls[-1]]
            block = Block(stack[-1], (id(stack[walls[-2]]) if len(walls) > 1 else 0, len(walls)), inner.tag, before + len(walls) - 2 * low)
            low = len(walls)
            made.append(block)
        block.pieces.append(text)
        n = len(text) - text.count(" ")
        block.chars += n
        block.linked += n if links else 0

    def close(upto: int):
        nonlocal links, silent, low
        while len(stack) > upto:
            e = stack.pop()
            open_[e.tag].pop()
            if walls[-1] == len(stack):
                walls.pop()
            links -= e.tag == "a"
            silent -= e.tag in SILENT
        low = min(low, len(walls))

    last = lambda tag: open_[tag][-1] if open_.get(tag) else 0
    while at < len(page):
        m = TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            found = last(tag)
            if found and (tag not in INLINE or walls[-1] < found):
                close(found)
        else:
            if tag not in INLINE:
                if (p := last("p")) and walls[-1] == p:
                    close(p)
                if tag in ENDS and (ended := max(map(last, ENDS[tag]))) > max(map(last, HOLDERS)):
                    close(ended)
            if tag not in VOID and not m[3].rstrip().endswith("/"):
                e = Element(tag, stack[-1], m[3])
                elements.append(e)
                open_.setdefault(tag, []).append(len(stack))
                if tag not in INLINE:
                    walls.append(len(stack))
                stack.append(e)
                links += tag == "a"
                silent += tag in SILENT
                if tag in RAW:
                    end = RAW_END[tag].search(page, at)
                    at = end.start() if end else len(page)
        if tag not in INLINE:
            block = None
        elif tag == "br":
            add(" ")
    return made, elements


def weigh(found: list[Block], elements: list[Element]) -> None:
    """Sets for each element what it and those around it say about a block in it (below).

    Evidence against is set aside where it can't hold: in html and body, and in an element that has all articles of the page,
    or most of its unlinked text while no article stands elsewhere.
    """
    for b in found:
        b.element.chars += b.chars - b.linked
    for e in reversed(elements[1:]):
        e.parent.chars += e.chars
        e.parent.cores += e.cores
    all_, cores = elements[0].chars, elements[0].cores
    around = lambda e: e.parent is not None and e.parent.core  # noqa: E731  an article holds it
    for e in elements[1:]:
        cost = e.cost
        if cost < 0 and (e.tag in ("html", "body") or cores == e.cores and not around(e) and (cores or 2 * e.chars > all_)):
            cost = 0.0
        above = e.parent.below
        e.below = min(cost, above) if min(cost, above) < 0 else min(4.0, above + cost)


def classify(b: Block, text: str) -> float:
    """Nats for content against boilerplate of one block by itself: what stands around it, links, length, marks."""
    words = text.count(" ") + 1
    density = b.linked / max(1, b.chars)
    nats = b.element.below + min(3.0, 0.6 * math.log1p(words)) - 1.5 - 5.0 * density
    if b.tag == "p":
        nats += 1.0
    elif b.tag in HEADINGS:
        nats += 1.5
    elif b.tag == "li":
        nats -= 0.5
    if text[-1:] in ".!?…:;»”\"":
        nats += 0.7
    return nats


def minimum_cut(n: int, terminal: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each of n nodes whether it is on the source's side of a minimum cut, by Dinic's algorithm.

    terminal: capacity from the source if above 0, else to the sink. edges: (i, j, capacity both ways).
    """
    s, t = n, n + 1
    to, cap, out = [], [], [[] for _ in range(n + 2)]

    def link(i, j, c, back):
        out[i].append(len(to))
        to.append(j)
        cap.append(c)
        out[j].append(len(to))
        to.append(i)
        cap.append(back)

    for i, c in enumerate(terminal):
        if c > 0:
            link(s, i, c, 0.0)
        elif c < 0:
            link(i, t, -c, 0.0)
    for i, j, c in edges:
        link(i, j, c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            i = queue.popleft()
            for e in out[i]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt, path, i = [0] * (n + 2), [], s
        while True:
            if i == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                while path and cap[path[-1]] > tiny:
                    path.pop()
                first = next(k for k, e in enumerate(path) if cap[e] <= tiny) if path and any(cap[e] <= tiny for e in path) else 0
                del path[first:]
                i = to[path[-1]] if path else s
                continue
            while nxt[i] < len(out[i]):
                e = out[i][nxt[i]]
                if cap[e] > tiny and level[to[e]] == level[i] + 1:
                    break
                nxt[i] += 1
            if nxt[i] < len(out[i]):
                path.append(out[i][nxt[i]])
                i = to[path[-1]]
            elif path:
                back = path.pop()
                i = to[back ^ 1]
                nxt[i] += 1
            else:
                break


def main_text(page: str | None, smoothness: float = 1.2) -> str:
    """The article of a page: blocks on the content side of the cut, joined by an empty line; '' for null or empty.

    Neighbours are tied by an edge that weakens with the steps between them in the tree, blocks of one parent by another.
    """
    made, elements = blocks(page or "")
    weigh(made, elements)
    found = [(b, t) for b in made if (t := b.text())]
    if not found:
        return ""
    terminal = [classify(b, t) for b, t in found]
    edges, last = [], {}
    for i, (b, _) in enumerate(found):
        if i:
            edges.append((i - 1, i, smoothness / (1 + 0.5 * b.apart)))
        if last.get(b.holder[0], i - 1) != i - 1:
            edges.append((last[b.holder[0]], i, smoothness / 2))
        last[b.holder[0]] = i
    kept = minimum_cut(len(found), terminal, edges)
    return "\n\n".join(t for (_, t), k in zip(found, kept, strict=True) if k)


def extract(pages: DataFrame, key: str = "page_id", markup: str = "html", url: str = "url") -> DataFrame:
    """(key, url, text, n_chars) of every row: the main text and its code points.

    Null and empty markup give an empty text. Repeated rows stay; an empty table gives an empty result; other columns
    aren't read. Very long and very deep pages are handled whole, in time about proportional to their size. A page is
    handled by itself, so no rows are shuffled.
    """

    def batches(it):
        for b in it:
            texts = [main_text(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[key, url, "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (key, url)}
    return pages.select(F.col(key), F.col(url), F.col(markup)).mapInArrow(batches, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars long")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op9_html_text": op9_html_text}
ORACLE: dict[str, str] = {}
