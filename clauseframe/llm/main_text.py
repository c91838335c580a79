"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks at block-level tags. A classifier with fixed weights gives each block a score from its tags, class and id
words, link share and length; the score becomes the block's two terminal capacities (the cost of calling it
boilerplate and of calling it content). What stands in an element that is no part of an article wherever it is (hidden, a form, an aside,
a footer, or called an advert, a comment, a notice) has a capacity that nothing repays. Such an element isn't one if it holds the page's
article, or, on a page without one, most of its text. Smoothness edges join blocks that follow one another, and blocks that follow
one another under the same parent; they are stronger the more ancestors two blocks share. The minimum cut,
found by Dinic's algorithm, labels all blocks of a page at once, however many they are. Blocks whose own score outweighs
all their edges are labelled before it, so that flow runs among the doubtful ones only.

Scripts, styles, head, comments in the markup and form controls never become blocks. A head ends with its end tag or
with the first thing that can't stand in one. Formulas and the fallbacks of media are text of the block around them.

Edge cases: null and empty pages give an empty text; a tag cut off at the end of a page is dropped, unclosed elements
end with the page; character references are decoded; repeated rows are extracted each. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseframe.llm import textcore as tc

SMOOTH = 1.0
LEAST = 1e-9
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img nobr"
    " math mi mn mo ms mrow msup msub msubsup mfrac msqrt mroot mtext mspace mover munder munderover mstyle semantics object canvas audio video".split()
)
SILENT = frozenset("script style head title template textarea select option button svg annotation iframe".split())
#: What may stand in a head; anything else ends it, as its end tag may be left out.
IN_HEAD = frozenset("base link meta noscript script style template title".split())
AWAY = frozenset("nav footer aside form menu dialog fieldset".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
BAD = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert warning sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs topbar toolbar"
    " footer foot copyright legal disclaimer comment comments reply replies respond disqus discussion share sharing social related recommended recommendations more newsletter subscribe subscription signup login signin register popup modal overlay widget pagination pager paging search skip tags tagcloud trending popular sticky".split()
)
#: Of these, the ones that an article's own parts are called, too.
WEAK = frozenset("more legal disclaimer copyright warning alert side foot tags popular search skip".split())
#: Words of a name that only says how something else is: comments-open, no-sidebar.
STATES = frozenset("no has with without is not enabled disabled open opened closed on off active allowed hide show layout page wrapper wrap container".split())
#: Names of what readers write; however long it is, it isn't the text.
READERS = frozenset("comment comments reply replies respond disqus discussion".split())
HARD = -1000.0
HEADS = frozenset("header masthead head top".split())
GOOD = frozenset("article content main post entry story body text prose hentry".split())
_PART = re.compile(r"[^a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_TELLTALE = re.compile(r"©|\(c\)\s*\d{4}|copyright|all rights reserved|cookie", re.I)


class _Node:
    __slots__ = ("tag", "parent", "depth", "words", "bad", "hidden", "main", "size", "inside", "away", "sums")

    def __init__(self, tag: str, parent, attrs):
        self.tag, self.parent, self.depth = tag, parent, parent.depth + 1 if parent else 0
        self.words, self.bad, self.hidden, self.main, self.size = frozenset(), frozenset(), False, tag in ("article", "main"), 0
        for name, value in attrs:
            value = (value or "").lower()
            if name in ("class", "id", "role"):
                for token in value.split():
                    words = frozenset(_PART.split(token))
                    self.words |= words
                    if not words & STATES:
                        self.bad |= words & BAD
                self.main |= name == "role" and value == "main"
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
                self.hidden = True


class _Blocks(HTMLParser):
    """Collects (node, text, characters inside links, depth of the nearest node that holds this block and the one before)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.node = _Node("", None, ())
        self.out, self.text, self.linked, self.silent, self.in_link = [], [], 0, 0, 0
        self.nodes, self.opened, self.low = [self.root], Counter(), 0
        self.holders: set = set()

    def cut(self):
        text = " ".join("".join(self.text).split())
        if text:
            self.out.append((self.node, text, self.linked, self.low))
            self.node.size += len(text)
            self.low = self.node.depth
        self.text, self.linked = [], 0

    def go_up(self, to):
        while self.node is not to:
            self.silent -= self.node.tag in SILENT
            self.opened[self.node.tag] -= 1
            self.node = self.node.parent
        self.low = min(self.low, to.depth)

    def end_head(self):
        if self.node.tag == "head":
            self.go_up(self.node.parent)

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD:
            self.end_head()
        if tag in INLINE:
            self.in_link += tag == "a"
            return
        if tag in VOID:
            if tag in ("br", "hr"):
                self.text.append(" ")
                if tag == "hr":
                    self.cut()
            return
        self.cut()
        self.in_link = 0
        ends = CLOSES.get(tag, frozenset()) | ({"p"} if tag in ENDS_P else frozenset())
        at = self.node
        while at.tag in ends and at.parent:
            at = at.parent
        self.go_up(at)
        self.node = _Node(tag, at, attrs)
        self.nodes.append(self.node)
        self.opened[tag] += 1
        self.silent += tag in SILENT
        if self.node.main:
            while at is not None and at not in self.holders:
                self.holders.add(at)
                at = at.parent

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in INLINE:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in INLINE:
            self.in_link -= tag == "a" and self.in_link > 0
            return
        if not self.opened[tag]:
            return
        at = self.node
        while at.tag != tag:
            at = at.parent
        self.cut()
        self.go_up(at.parent)

    def handle_data(self, data):
        if self.node.tag == "head" and data.strip():
            self.end_head()
        if not self.silent:
            self.text.append(data)
            if self.in_link:
                self.linked += len(data.strip())


def blocks(html: str) -> list[tuple]:
    """(node, text, characters inside links, depth shared with the block before) in order; the nodes know what their ancestors say."""
    at = html.rfind("<")
    if at >= 0 and ">" not in html[at:] and (at + 1 == len(html) or html[at + 1].isalpha() or html[at + 1] in "/!?"):
        html = html[:at]
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.cut()
    for node in reversed(parser.nodes[1:]):
        node.parent.size += node.size
    whole = parser.root.size
    for node in parser.nodes:
        above = node.parent
        node.inside = node.main or above is not None and above.inside
        node.away, node.sums = (above.away, above.sums) if above else ((False, False), (0.0, 0.0))
        if above:
            weighed = [_weight(node, parser.holders, inside, whole) for inside in (False, True)]
            node.away = tuple(a or w is None for a, w in zip(node.away, weighed))
            node.sums = tuple(t + (w or 0.0) for t, w in zip(node.sums, weighed))
    return parser.out


def _weight(node: _Node, holders: set, inside: bool, whole: int) -> float | None:
    """What an element says about the blocks in it, of which `inside` says whether they stand in an article; none if they can't be content."""
    # the element holds the article; or it holds most of a page without an article, and is no place for readers
    wraps = node in holders or node.main or node.tag in ("html", "body")
    most = not holders and 2 * node.size > whole and not node.bad & READERS
    if node.hidden:
        return None
    if node.tag in AWAY and node not in holders and not most:
        return None
    total = 0.0
    if node.tag in ("header", "noscript") and not inside:
        total -= 6
    if not wraps:
        strong = node.bad - WEAK
        if strong and not most:
            return None
        if node.bad:
            total -= 1 if inside or most else 6
        elif not inside and node.words & HEADS:
            total -= 4
    if node.words & GOOD and not node.bad:
        total += 1.5
    return total


def score(node: _Node, text: str, linked: int) -> float:
    """Positive: more likely content."""
    inside = node.inside
    if node.away[inside]:
        return HARD
    total = node.sums[inside] + (3 if inside else 0)
    words = text.count(" ") + 1
    total += min(2.0, words / 12) - (0.0 if inside else 0.8)
    if node.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        total += 1
    if node.tag in ("p", "blockquote", "pre"):
        total += 0.7
    total -= 4 * min(1.0, linked / max(len(text), 1))
    if not inside and _TELLTALE.search(text):
        total -= 2
    return total


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source's side. source, sink: terminal capacities; edges have one in both directions."""
    n = len(source)
    graph: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        graph[a][b] = graph[a].get(b, 0.0) + w
        graph[b][a] = graph[b].get(a, 0.0) + w
    # a node whose terminals outweigh all its edges has its side in every minimum cut; its edges become its neighbours' terminals
    net, around = [s - t for s, t in zip(source, sink)], [sum(g.values()) for g in graph]
    side: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:
        i = todo.pop()
        if side[i] is None and (net[i] > around[i] + LEAST or net[i] <= -around[i]):
            side[i] = net[i] > 0
            for j, w in graph[i].items():
                net[j] += w if side[i] else -w
                around[j] -= w
                del graph[j][i]
                todo.append(j)
            graph[i] = {}
    rest = [i for i in range(n) if side[i] is None]
    reached = _reached(net, graph, rest) if rest else {}
    return [i in reached if side[i] is None else side[i] for i in range(n)]


def _reached(net: list[float], graph: list[dict[int, float]], nodes: list[int]) -> dict[int, int]:
    """The nodes that the source still reaches after a maximum flow, found by Dinic's phases. net: a node's excess, or its room to the sink below 0."""
    while True:
        level = {i: 0 for i in nodes if net[i] > LEAST}
        queue, ends = deque(level), False
        while queue:
            i = queue.popleft()
            ends |= net[i] < -LEAST
            for j, room in graph[i].items():
                if room > LEAST and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not ends:
            return level
        onward = {i: iter([j for j in graph[i] if level.get(j) == level[i] + 1]) for i in level}
        at = {i: next(onward[i], -1) for i in level}
        for start in [i for i in level if level[i] == 0]:
            path = [start]
            while path and net[start] > LEAST:
                i = path[-1]
                if net[i] < -LEAST:
                    flow = min(net[start], -net[i], *(graph[u][v] for u, v in zip(path, path[1:])))
                    net[start] -= flow
                    net[i] += flow
                    keep = len(path)
                    for k in range(len(path) - 1, 0, -1):
                        u, v = path[k - 1], path[k]
                        graph[u][v] -= flow
                        graph[v][u] += flow
                        if graph[u][v] <= LEAST:
                            keep = k
                    del path[keep:]
                    continue
                while at[i] >= 0 and graph[i][at[i]] <= LEAST:
                    at[i] = next(onward[i], -1)
                if at[i] >= 0:
                    path.append(at[i])
                else:  # nothing leads on from here in this phase
                    path.pop()
                    if path:
                        at[path[-1]] = next(onward[path[-1]], -1)


def labelled(html: str) -> list[tuple[str, bool]]:
    """The blocks of a page in order, each with whether it is content."""
    found = blocks(html)
    scores = [score(*b[:3]) for b in found]
    source = [math.log1p(math.exp(min(s, 30))) for s in scores]
    sink = [-s if s == HARD else math.log1p(math.exp(min(-s, 30))) for s in scores]
    edges, last = [], {}
    for i, (node, _, _, shared) in enumerate(found):
        if i:
            # the share of ancestors that both have
            edges.append((i - 1, i, SMOOTH * shared / max(found[i - 1][0].depth, node.depth, 1)))
        if last.get(node.parent, i - 1) != i - 1:
            edges.append((last[node.parent], i, SMOOTH / 2))
        last[node.parent] = i
    return list(zip((b[1] for b in found), minimum_cut(source, sink, edges)))


def main_text(html: str | None) -> str:
    return " ".join(text for text, kept in labelled(html) if kept) if html else ""


def _rows(batches):
    for batch in batches:
        for at, to, _, _ in tc.text_blocks(batch.column("html")):
            texts = [main_text(h) for h in batch.column("html").slice(at, to - at).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").slice(at, to - at), batch.column("url").slice(at, to - at), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> (page_id, url, text, n_chars), row by row."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(_rows, "page_id long, url string, text string, n_chars long")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(tc.read_table(spark, sf_dir, "pages"))
