"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks. A classifier of their tags, names, links and lengths gives each block a cost
for either label, which are the capacities of its edges to source (content) and sink (boilerplate). Smoothness edges
join neighbours in the page and the nearest blocks of one parent, stronger the closer they lie in the DOM. The
minimum cut, found by max-flow, labels all blocks of a page at once.

Elements such as nav or aside, roles and hidden elements are outside of the article for good; a header within an article is its own, with its headline. A class or id that sounds so, or a
form, is only a cost: high where a good part of the page's running text is elsewhere, low for a wrapper that holds nearly all of it. Names such
as has-sidebar or comments-open are no marks.

Blocks end where a block element begins or ends; within a block, white space, line breaks and the edges of
inline elements make no new block. Character references are decoded, white space becomes one space.

Edge cases: null or empty html gives an empty text; unclosed, stray and misnested tags are closed as browsers do; other columns
are passed on only where asked for; null ids and urls are passed on; repeated rows get equal results; pages of any
length are read whole; an empty table gives an empty one.
"""

import re
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import small_batches

#: Elements whose content is never text of the page.
RAW = set("script style noscript template svg math iframe object canvas audio video title textarea select datalist".split())
RAW_END = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in RAW}
START = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
#: Quotation marks hide a tag's end only in a value; no position is tried twice.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|[="'])*+)>""")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|\b(hidden)\b""")
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: An element of the key ends the open elements named.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements, roles and names that mark what isn't the article.
OUTSIDE = set("nav header footer aside menu button dialog fieldset label".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices notification alert popup modal "
    "overlay newsletter subscribe subscription paywall sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar comment comments reply replies disqus discussion "
    "respond responses share sharing social related recommended recommendations widget pagination pager toolbar skip login signup search tags copyright legal disclaimer".split()
)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
CONTENT_NAMES = set("article content main post entry story body text".split())
#: A name that begins or ends so says something of a page, not what the element is.
SAYS_FIRST, SAYS_LAST = set("has no not with without tag category".split()), set("open closed enabled disabled".split())
SPLIT_NAME = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
#: Foreign elements, which alone may close themselves.
FOREIGN = ("svg", "math")
#: Costs of calling a block of an element with such a name (or a form) content: for a wrapper of all running text, and for a small part.
NAMED_LEAST, NAMED_MOST = 3.0, 14.0
#: So many times the running text outside of it must be in a named element before its cost falls.
WRAPS = 4.0
#: Words that a block of running text has at least.
RUNNING_WORDS = 10
#: Capacities of the smoothness edges: neighbours in the page, and nearest blocks of one parent.
NEXT_TO, SAME_PARENT = 0.4, 0.8


class Element:
    """An open element. Elements and blocks point to what they stand in, so a page takes memory in proportion to its length however deep it is."""

    __slots__ = ("name", "number", "up", "depth", "home", "at", "inside", "outside", "named")

    def __init__(self, name: str, number: int, on: "Element | None", at: int, inside: bool, outside: bool, named: int) -> None:
        """on: the element that it stands in; at: its place on the stack; named: the innermost element around with a name (see NAMES), or -1."""
        self.name, self.number, self.at, self.inside, self.outside, self.named = name, number, at, inside, outside, named
        self.up = on.home if on else None  # the block element around
        self.depth = self.up.depth + 1 if self.up else 0
        self.home: Element = on.home if on and name in INLINE else self  # the innermost block element


class Block:
    __slots__ = ("parts", "linked", "home", "inside", "outside", "named", "name_cost")

    def __init__(self, home: Element, inside: bool = False, outside: bool = False, named: int = -1) -> None:
        self.parts: list[str] = []
        self.linked = 0
        self.home, self.inside, self.outside, self.named = home, inside, outside, named
        self.name_cost = NAMED_MOST if named >= 0 else 0.0


def _marks(name: str, attributes: str) -> tuple[bool, bool, bool]:
    """(inside, outside, named): whether an element marks its content as the article, as something else, or sounds like something else."""
    outside, inside, named = name in OUTSIDE, name in ("article", "main"), name == "form"
    if attributes and not outside:
        for key, value, hidden in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if hidden or key == "aria-hidden" and value == "true" or key == "style" and HIDDEN.search(value):
                outside = True
            elif key == "role":
                outside |= value.lower() in ROLES
                inside |= value.lower() in ("main", "article")
            elif key in ("class", "id") and name not in ("html", "body"):
                names = [[w.lower() for w in SPLIT_NAME.split(x) if w] for x in value.split()]
                named |= any(not NAMES.isdisjoint(x) for x in names if x and x[0] not in SAYS_FIRST and x[-1] not in SAYS_LAST)
                words = {w for x in names for w in x}
                inside |= bool(words & CONTENT_NAMES) and name in ("div", "section", "td")
    return inside, outside, named


def blocks_of(html: str) -> list[tuple[str, Block]]:
    """The text blocks of a page in order, with their texts."""
    found: list[Block] = []
    stack = [Element("", 0, None, 0, False, False, -1)]
    named_in: list[int] = []  # of each named element, the named one around
    open_ = Counter[str]()  # names on the stack
    number, at = 0, 0
    current: Block | None = None

    def text(chunk: str) -> None:
        nonlocal current
        if not chunk:
            return
        if current is None:
            if chunk.isspace():
                return
            top = stack[-1]
            current = Block(top.home, top.inside, top.outside, top.named)
            found.append(current)
        chunk = unescape(chunk) if "&" in chunk else chunk
        current.parts.append(chunk)
        if open_["a"]:
            current.linked += len(chunk)

    def close(k: int) -> None:
        while len(stack) > k:
            open_[stack.pop().name] -= 1

    def block_at() -> int:
        """The place of the innermost open block element, or 0."""
        return stack[-1].home.at

    while m := START.search(html, at):
        text(html[at : m.start()])
        if m[0] in ("<!--", "<!", "<?"):
            end = "-->" if m[0] == "<!--" else ">"
            at = html.find(end, m.end())
            at = len(html) if at < 0 else at + len(end)
            continue
        m = TAG.match(html, m.start())
        if not m:  # a tag that never ends
            at = len(html)
            break
        at = m.end()
        name = m[2].lower()
        if name in FOREIGN and m[3].endswith("/"):
            continue
        if name in RAW and not m[1]:
            end = RAW_END[name].search(html, at)
            at = end.end() if end else len(html)
            continue
        if name == "br":
            if current is not None:
                current.parts.append("\n")
            continue
        block = name not in INLINE
        if block:
            current = None
        if m[1]:
            if not open_[name]:
                continue  # a stray end
            # an inline element's end counts up to the innermost block only
            k = next((i for i in range(len(stack) - 1, 0 if block else block_at(), -1) if stack[i].name == name), 0)
            if k:
                close(k)
            continue
        if name in VOID:
            continue
        if block:
            k = block_at()
            if stack[k].name == "p" or k and stack[k].name in CLOSES.get(name, ()):
                close(k)
                while (k := block_at()) and stack[k].name in CLOSES.get(name, ()):
                    close(k)
        if not m[3].endswith("/"):
            inside, outside, named = _marks("div" if name == "header" and open_["article"] else name, m[3])
            number += 1
            top = stack[-1]
            outside = (outside or top.outside) and not (name in ("html", "body"))
            if named:
                named_in.append(top.named)
            stack.append(Element(name, number, top, len(stack), inside or top.inside, outside, len(named_in) - 1 if named else top.named))
            open_[name] += 1
        if current is not None and (stack[-1].outside != current.outside or stack[-1].named != current.named):
            current = None  # an inline element that is marked: a block of its own
    text(html[at:])
    rows = [(t, b) for b in found if (t := " ".join("".join(b.parts).split()))]
    _weigh_names(rows, named_in)
    return rows


def _weigh_names(rows: list[tuple[str, Block]], named_in: list[int]) -> None:
    """Sets name_cost: the most that one of the named elements around a block costs, by how much running text is in it and elsewhere."""
    own, total = [0] * len(named_in), 0
    for t, b in rows:
        words = t.count(" ") + 1
        if not b.outside and words >= RUNNING_WORDS and 2 * b.linked < len(t):
            total += words
            if b.named >= 0:
                own[b.named] += words
    for k in range(len(own) - 1, -1, -1):  # what stands in another comes later
        if named_in[k] >= 0:
            own[named_in[k]] += own[k]
    rest = [min(1.0, WRAPS * (total - n) / n) if n else 1.0 for n in own]
    for k, around in enumerate(named_in):
        if around >= 0:
            rest[k] = max(rest[k], rest[around])
    for _, b in rows:
        if b.named >= 0:
            b.name_cost = NAMED_LEAST + (NAMED_MOST - NAMED_LEAST) * rest[b.named] ** 2


def costs(text: str, block: Block) -> tuple[float, float]:
    """(cost of calling the block boilerplate, cost of calling it content)."""
    words = text.count(" ") + 1
    links = min(1.0, block.linked / len(text))
    content = 0.3 + min(3.0, words / 12) + 0.7 * (text[-1] in ".!?:;\"”»…") + 0.8 * (block.home.name in ("p", "pre", "blockquote", "h1"))
    boiler = 0.2 + 3.5 * links + 1.5 * ("©" in text)
    if block.inside:
        content, boiler = content + 6, boiler * 0.5
    boiler += 14 if block.outside else block.name_cost
    return content, boiler


class Flow:
    """Max-flow by shortest augmenting paths over blocking flows; capacities are floats."""

    def __init__(self, n: int) -> None:
        self.to: list[int] = []
        self.room: list[float] = []
        self.out: list[list[int]] = [[] for _ in range(n)]

    def join(self, a: int, b: int, there: float, back: float = 0.0) -> None:
        self.out[a].append(len(self.to))
        self.to.append(b)
        self.room.append(there)
        self.out[b].append(len(self.to))
        self.to.append(a)
        self.room.append(back)

    def levels(self, source: int) -> list[int]:
        level = [-1] * len(self.out)
        level[source], todo = 0, deque([source])
        while todo:
            v = todo.popleft()
            for e in self.out[v]:
                if self.room[e] > 1e-9 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[v] + 1
                    todo.append(self.to[e])
        return level

    def cut(self, source: int, sink: int) -> list[bool]:
        """Which nodes stay on the side of the source."""
        while (level := self.levels(source))[sink] >= 0:
            turn = [0] * len(self.out)
            path: list[int] = []
            v = source
            while True:
                if v == sink:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    k = next(i for i, e in enumerate(path) if self.room[e] <= 1e-9)
                    v = self.to[path[k] ^ 1]
                    del path[k:]
                    continue
                while turn[v] < len(self.out[v]):
                    e = self.out[v][turn[v]]
                    if self.room[e] > 1e-9 and level[self.to[e]] == level[v] + 1:
                        break
                    turn[v] += 1
                if turn[v] < len(self.out[v]):
                    path.append(e)
                    v = self.to[e]
                elif path:
                    v = self.to[path.pop() ^ 1]
                    turn[v] += 1
                else:
                    break
        return [x >= 0 for x in level]


def content_labels(pairs: list[tuple[float, float]], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Minimum cut. Nodes whose own costs outweigh all their edges are settled first, which the minimum allows."""
    lead = [a - b for a, b in pairs]
    near: list[list[tuple[int, float]]] = [[] for _ in pairs]
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    pull = [sum(w for _, w in x) for x in near]
    label: list[bool | None] = [None] * len(pairs)
    todo = [i for i in range(len(pairs)) if abs(lead[i]) >= pull[i]]
    while todo:
        i = todo.pop()
        if label[i] is None:
            label[i] = lead[i] > 0
            for j, w in near[i]:
                if label[j] is None:
                    lead[j] += w if label[i] else -w
                    pull[j] -= w
                    if abs(lead[j]) >= pull[j] - 1e-12:
                        todo.append(j)
    rest = {i: k for k, i in enumerate(i for i, x in enumerate(label) if x is None)}
    if rest:
        flow, n = Flow(len(rest) + 2), len(rest)
        for i, k in rest.items():
            if lead[i] > 0:
                flow.join(n, k, lead[i])
            else:
                flow.join(k, n + 1, -lead[i])
        for a, b, w in edges:
            if a in rest and b in rest:
                flow.join(rest[a], rest[b], w, w)
        side = flow.cut(n, n + 1)
        for i, k in rest.items():
            label[i] = side[k]
    return [bool(x) for x in label]


def apart(a: Element, b: Element) -> int:
    """Steps from one element to another in the DOM. Over the neighbours of a page they add up to twice its elements at most."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        steps += 1
    return steps


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    edges: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, NEXT_TO / (1 + apart(blocks[i - 1].home, b.home) / 2)))
        parent = (b.home.up or b.home).number
        if parent in last:
            edges.append((last[parent], i, SAME_PARENT))
        last[parent] = i
    return edges


def main_text(html: str | None) -> str:
    rows = blocks_of(html) if html else []
    labels = content_labels([costs(t, b) for t, b in rows], smoothness([b for _, b in rows]))
    return "\n\n".join(t for (t, _), keep in zip(rows, labels, strict=True) if keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    small_batches(pages.sparkSession)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return own.mapInArrow(_extract, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
