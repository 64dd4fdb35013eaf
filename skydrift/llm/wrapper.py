"""Main text of web pages by wrapper induction.

Pages of one host share a template. Each host has a reference page, the one whose length is nearest to the median of
its pages that aren't empty. The element trees of all its pages are aligned with the reference's by simple tree
matching (the largest mapping that keeps names, parents and the order of siblings). For each node of the reference
it is summed over the host's other pages how many have text there, on how many it is the very same, and how many
characters it has, in links and outside of them; text of a node that the reference lacks counts for the nearest
aligned ancestor, and such nodes are counted themselves by that ancestor and their text. A page of whose text four
fifths or more are the reference's is a copy and tells nothing. The sums are partial within tasks, so a host of any
size is never gathered in one place.

What follows from them, at any number of pages: text that is the same on n other pages is content with the weight
2 / (2 + n * n), else template; a node whose text varies is a slot for content, link text outside of paragraphs and headings isn't. The main part is the
node of the reference that holds most of the content and least of the rest (`choose`). On each page it is the
subtree aligned with that node; a page where this holds less than half of the page's own content, or nothing is
aligned, is judged by the same rule from its own text alone, and so are pages of hosts with one page. In the main part, nodes that are
the same on nine tenths of the other pages are dropped, from the third such page on, when the weight is below a quarter.

Element names, roles, classes and ids come in as evidence only: text that they place in menus, headers,
footers, sidebars, notices, adverts, forms or reader comments, or outside of the page's article, counts as not content when
the main part is chosen, and such blocks within the main part are dropped unless they hold most of it. Wrappers that hold
the page's article, or without one most of its text, aren't outside whatever their name (a form around the page, a
layout "has-sidebar"); of a name of several words the last one counts, and some first ones (`_tells`).
`names=False` leaves this evidence out. Scripts, styles and other elements that aren't shown are never text.

Character references are decoded; white space within a block becomes one blank; blocks are trimmed and
joined by one blank in page order. Null and empty pages give an empty text. Null urls form a host of
their own. Repeated rows are each extracted, and counted once per page_id's host as they come. Broken
markup is read as a browser would in the common cases (implied ends of p, li, td and the like, stray
ends ignored, unclosed elements closed at the end, elements below level DEEPEST beside each other). Very long pages: parsing takes one pass
forward; alignment is exact up to WORK comparisons, after which sibling lists are compared near their diagonal only and the smaller subtree's size stands for its score.
An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, small

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
SCOPE = frozenset("ul ol dl table div article section main body html aside nav form td th blockquote".split())
#: Never text.
HIDDEN = frozenset("head title meta link script style template noscript iframe object svg canvas textarea select option button input audio video map xmp noembed noframes".split())
UNSEEN = frozenset("script style template noscript".split())  # they don't part what stands around them
#: What is no main text, by element name.
OUTSIDE = frozenset("head script style noscript template iframe object svg canvas nav header footer aside form button select option input textarea dialog menu audio video map".split())
#: And by a word of class, id or role.
WORDS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent notice notices alert popup modal newsletter subscribe signup nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget related share sharing social comment comments disqus reply replies complementary contentinfo search toolbar pagination pager".split())
#: Words of WORDS that say the same of a name that begins with them, as comment-body.
STRONG = frozenset("ad ads advert advertisement breadcrumb breadcrumbs comment comments cookie footer menu nav navbar newsletter sidebar".split())
#: A name that begins with these says what a part has or is for, not what it is; before header, what the heading is of.
QUALIFIERS, HEADED = frozenset("has with no without not hide show is".split()), frozenset("article entry post story content section page".split())
#: Elements that wrap whole pages at times, forms included.
WRAPPERS = frozenset("body center div fieldset form main section span table tbody td tr".split())
#: Links in these are part of the text.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote figcaption".split())
#: The share of a page's text that is no link above which a wrapper isn't outside of the text, whatever its name.
MOST_TEXT = 0.8
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME, STOP = re.compile(r"[a-zA-Z][^\s/>]*"), re.compile("[>\"']")
ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
#: Levels of nesting; comparisons of one pair of pages; cells of an exact table of siblings.
DEEPEST, WORK, TABLE = 512, 2_000_000, 90_000
#: How much a share of text that is no content counts against a main part, by what makes it so.
AGAINST_KNOWN, AGAINST_SAME = 8.0, 1.0


@dataclass(slots=True)
class Node:
    tag: str
    out: bool = False  # by name, class, id or role no main text
    kids: list = field(default_factory=list)  # nodes, and strings of text in between
    key: int = 0  # of the subtree's shape
    size: int = 1
    own: str | None = None  # its text outside of child elements, once it is known
    order: list | None = None  # of a page: all nodes


class _Ends:
    """Where tags end: at the next > outside of quotes. Each search goes forward; quotes that don't pair up are
    plain characters, and once they have misled, all are."""

    def __init__(self, html: str):
        self.html, self.last = html, {c: html.rfind(c) for c in ">\"'"}
        self.quotes = True

    def after(self, pos: int) -> int:
        """The place of the >, or -1."""
        if pos > self.last[">"]:
            return -1
        at = pos
        while self.quotes and (m := STOP.search(self.html, at)):
            if m[0] == ">":
                return m.start()
            at = m.end() if m.start() >= self.last[m[0]] else self.html.index(m[0], m.end()) + 1
        self.quotes = False
        return self.html.find(">", pos)


def parse(html: str | None) -> Node:
    """The element tree."""
    root = Node("#page")
    stack, pos, html = [root], 0, html or ""
    ends, opened, text = _Ends(html), defaultdict(int), 0

    def close(k: int) -> None:
        for node in stack[k:]:
            opened[node.tag] -= 1
        del stack[k:]

    def close_one(names: set[str], within: frozenset[str]) -> None:
        if any(opened[n] for n in names):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in names:
                    close(k)
                    return
                if stack[k].tag in within:
                    return

    while (at := html.find("<", pos)) >= 0:
        pos = at + 1
        if html.startswith("!--", pos):
            end = html.find("-->", pos + 3)
            tag, stop = None, end + 2 if end >= 0 else len(html) - 1
        elif html[pos : pos + 1] in ("!", "?"):
            tag, stop = None, html.find(">", pos) if pos <= ends.last[">"] else -1
        else:
            closing = html[pos : pos + 1] == "/"
            m = NAME.match(html, pos + closing)
            tag, stop = m and m[0].lower(), ends.after(m.end()) if m else -1
        if stop < 0:
            continue  # a < that begins no tag is text
        if at > text:
            stack[-1].kids.append(html[text:at])
        pos = text = stop + 1
        if not tag:
            continue
        if closing:
            if opened[tag]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
                    if tag in INLINE and stack[k].tag not in INLINE:
                        break
            continue
        if tag in CLOSES_P:
            close_one({"p"}, SCOPE)
        if tag in SAME:
            close_one(SAME[tag], SCOPE)
        attributes = html[m.end() : stop]
        out = tag in OUTSIDE
        if not out and attributes:
            out = tag not in ("html", "body", "article", "main") and any(_tells(name) for _, a, b, c in ATTR.findall(attributes) for name in (a or b or c).lower().split())
        node = Node(tag, out)
        stack[-1].kids.append(node)
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in RAW:
            end = ENDS[tag].search(html, pos)
            node.kids.append(html[pos : end.start() if end else len(html)])
            pos = text = end.end() if end else len(html)
            continue
        if len(stack) < DEEPEST:
            stack.append(node)
            opened[tag] += 1
    if text < len(html):
        stack[-1].kids.append(html[text:])
    _shape(root)
    _unmark(root)
    return root


@lru_cache(maxsize=100_000)
def _tells(name: str) -> bool:
    """Whether a class, id or role says that its element is no main text: by its last word, or by a first one that is
    strong enough; has-sidebar and article-header don't."""
    words = [w for w in re.split("[^a-z]+", name) if w]
    if not words or len(words) > 1 and words[0] in QUALIFIERS or words[-1] == "header" and HEADED.intersection(words):
        return False
    return words[-1] in WORDS or words[0] in STRONG


def _unmark(root: Node) -> None:
    """Names don't put outside what holds the text: the wrappers around the longest article where every article is
    within some, and without articles, those that hold MOST_TEXT of what is no link."""
    todo = [root]
    while todo:  # what can be reached without passing a mark
        x = todo.pop()
        if x.tag in ("article", "main"):
            return
        if not x.out:
            todo.extend(k for k in x.kids if k.__class__ is Node)
    order = _order(root)
    if not any(x.out for x in order):
        return
    parent = {id(k): x for x in order for k in x.kids if k.__class__ is Node}
    size: dict[int, int] = {}
    for x in reversed(order):
        size[id(x)] = 0 if x.tag == "a" or _unseen(x) else len(own_text(x)) + sum(size[id(k)] for k in x.kids if k.__class__ is Node)

    def above(x: Node) -> list[Node]:
        out = []
        while (x := parent.get(id(x))) is not None:
            out.append(x)
        return out

    parts = [x for x in order if x.tag in ("article", "main")]
    if parts:  # all of them within marks
        for y in above(max(parts, key=lambda x: size[id(x)])):
            y.out = False
    elif total := size[id(root)]:
        for x in order:
            if x.out and x.tag in WRAPPERS and size[id(x)] >= MOST_TEXT * total:
                x.out = False


def _order(root: Node) -> list[Node]:
    """All nodes, parents first, in page order."""
    if root.order is not None:
        return root.order
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(k for k in reversed(node.kids) if k.__class__ is Node)
    return out


def _shape(root: Node) -> None:
    order = _order(root)
    for node in reversed(order):
        size, keys = 1, [node.tag]
        for k in node.kids:
            if k.__class__ is Node:
                size += k.size
                keys.append(k.key)
        node.size, node.key = size, hash(tuple(keys))
    root.order = order


def own_text(node: Node) -> str:
    """Its text outside of child elements."""
    if node.own is None:
        text = " ".join([k for k in node.kids if k.__class__ is str])
        node.own = " ".join((unescape(text) if "&" in text else text).split())
    return node.own


def _elements(node: Node) -> list[Node]:
    return [k for k in node.kids if k.__class__ is Node]


class _Matcher:
    """Simple tree matching without recursion; scores are kept by shapes, of which pages have few."""

    def __init__(self):
        self.memo: dict[tuple[int, int], int] = {}
        self.left = WORK

    @staticmethod
    def ends(xs: list[Node], ys: list[Node]) -> tuple[int, int]:
        """How many of equal shape both begin with, and end with."""
        n, head, tail = min(len(xs), len(ys)), 0, 0
        while head < n and xs[head].key == ys[head].key:
            head += 1
        while tail < n - head and xs[-1 - tail].key == ys[-1 - tail].key:
            tail += 1
        return head, tail

    def inner(self, x: Node, y: Node) -> tuple[list[Node], list[Node], int]:
        """Children between the equal ends, and the size of those."""
        xs, ys = _elements(x), _elements(y)
        head, tail = self.ends(xs, ys)
        return xs[head : len(xs) - tail], ys[head : len(ys) - tail], sum(v.size for v in xs[:head]) + sum(v.size for v in xs[len(xs) - tail :])

    def band(self, xs: list[Node], ys: list[Node]) -> list[range]:
        """For each of xs the places in ys that are compared with it: all, or those near the diagonal."""
        n, m = len(xs), len(ys)
        if n * m <= min(TABLE, self.left):
            return [range(m)] * n
        wide = max(4, min(TABLE, max(self.left, 0)) // (2 * n))
        return [range(max(0, i * m // n - wide), min(m, i * m // n + wide + 1)) for i in range(n)]

    def known(self, x: Node, y: Node) -> int | None:
        if x.tag != y.tag:
            return 0
        if x.key == y.key:
            return x.size
        got = self.memo.get((x.key, y.key))
        return min(x.size, y.size) if got is None and self.left <= 0 else got

    def table(self, xs: list[Node], ys: list[Node]) -> list[dict[int, int]]:
        """Of the first i of xs and j of ys the best score; what isn't in a row is as at its nearest end."""
        rows, m = [{}], len(ys)
        for x, places in zip(xs, self.band(xs, ys)):
            self.left -= len(places)
            up, row = rows[-1], {}
            low, high = (min(up), max(up)) if up else (0, 0)
            above = lambda j: up[j] if j in up else up[high] if up and j > high else 0  # noqa: B023, E731
            best = above(places.start) if places else 0
            row[places.start] = best
            for j in places:
                best = max(best, above(j + 1))
                if s := self.known(x, ys[j]):
                    best = max(best, above(j) + s)
                row[j + 1] = best
            rows.append(row)
        return rows

    def score(self, a: Node, b: Node) -> int:
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if self.known(x, y) is not None:
                todo.pop()
                continue
            xs, ys, same = self.inner(x, y)
            missing = [(p, ys[j]) for p, places in zip(xs, self.band(xs, ys)) for j in places if self.known(p, ys[j]) is None] if xs and ys else []
            if missing:
                self.left -= len(missing)
                todo += {(p.key, q.key): (p, q) for p, q in missing}.values()
                continue
            self.memo[x.key, y.key] = 1 + same + (max(self.table(xs, ys)[-1].values()) if xs and ys else 0)
            todo.pop()
        return self.known(a, b)


def match(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Simple tree matching: the largest mapping of a's nodes to b's that keeps names, parents and order."""
    m = _Matcher()
    out, todo = [], [(a, b)] if a.tag == b.tag else []
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        xs, ys = _elements(x), _elements(y)
        head, tail = (len(xs), 0) if x.key == y.key else m.ends(xs, ys)
        todo += zip(xs[:head], ys[:head])
        if tail:
            todo += zip(xs[-tail:], ys[-tail:])
        xs, ys = xs[head : len(xs) - tail], ys[head : len(ys) - tail]
        if not xs or not ys:
            continue
        for p, places in zip(xs, m.band(xs, ys)):
            for j in places:
                if m.known(p, ys[j]) is None:
                    m.score(p, ys[j])
        rows = m.table(xs, ys)
        i, j = len(xs), max(rows[-1], key=lambda k: (rows[-1][k], -k))
        while i and j:
            up = rows[i - 1]
            above = lambda k: up[k] if k in up else up[max(up)] if up and k > max(up) else 0  # noqa: B023, E731
            now = rows[i].get(j, 0)
            if now == above(j):
                i -= 1
            elif j - 1 in rows[i] and now == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((xs[i], ys[j]))
    return out


def _unseen(node: Node) -> bool:
    return node.tag in HIDDEN


@dataclass(slots=True)
class Evidence:
    """Characters of a place: content, text that names or links tell to be none, text that other pages have too."""

    content: float = 0.0
    known: float = 0.0
    same: float = 0.0


def _texts(root: Node, names: bool) -> Iterator[tuple[Node, str, bool]]:
    """Nodes with text that is shown: (node, own text, is it known to be no content). Links are known to be none, but for
    those in paragraphs and headings."""
    articles = names and any(n.tag in ("article", "main") for n in _order(root))
    todo = [(root, False, not articles, False)]
    while todo:
        x, no, inside, prose = todo.pop()
        if _unseen(x):
            continue
        inside = inside or x.tag in ("article", "main")
        prose = x.tag in PROSE or prose and x.tag in INLINE
        no = no or x.tag == "a" and not prose or names and x.out and not (x.tag == "header" and articles and inside)
        if text := own_text(x):
            yield x, text, no or not inside
        todo.extend((k, no, inside, prose) for k in reversed(x.kids) if k.__class__ is Node)


def weight(n: float) -> float:
    """Of text that n other pages have at the same place, as content."""
    return 2 / (2 + n * n)


def choose(root: Node, evidence: dict[int, Evidence]) -> Node:
    """The main part: the node that holds the largest share of the content, less the shares of the rest that it
    holds; of equal ones the deepest, of these the first. evidence: by id of node."""
    order, total = _order(root), {}
    for node in reversed(order):
        e = evidence.get(id(node), Evidence())
        c, k, s = e.content, e.known, e.same
        for kid in _elements(node):
            a, b, d = total[id(kid)]
            c, k, s = c + a, k + b, s + d
        total[id(node)] = c, k, s
    if not total[id(root)][0]:  # all of it is known to be none, so what there is counts
        total = {i: (k, 0.0, s) for i, (_, k, s) in total.items()}
    content = total[id(root)][0] or 1.0
    value = lambda n: round((total[id(n)][0] - AGAINST_KNOWN * total[id(n)][1] - AGAINST_SAME * total[id(n)][2]) / content, 9)
    best, depth, levels = root, 0, {id(root): 0}
    for node in order:
        for kid in _elements(node):
            levels[id(kid)] = levels[id(node)] + 1
        if (value(node), levels[id(node)]) > (value(best), depth):
            best, depth = node, levels[id(node)]
    # a run of text in an inline element belongs to the block around it
    parents = {id(k): n for n in order for k in _elements(n)}
    while best.tag in INLINE and id(best) in parents:
        best = parents[id(best)]
    return best


def alone(root: Node, names: bool = True) -> dict[int, Evidence]:
    """What a page's own text tells."""
    return {id(x): Evidence(known=len(t)) if no else Evidence(content=len(t)) for x, t, no in _texts(root, names)}


def _held(root: Node, evidence: dict[int, Evidence]) -> float:
    return sum(evidence[id(x)].content for x in _order(root) if id(x) in evidence)


def main_text(root: Node, part: Node | None = None, template: set[int] = frozenset(), names: bool = True) -> str:
    """Blocks of the main part; template: ids of nodes whose own text is the host's."""
    articles = any(n.tag in ("article", "main") for n in _order(root))
    if part is None:
        part = choose(root, alone(root, names))
    blocks, now, most = [], [], None

    def cut() -> None:
        if now:
            text = "".join(now)
            if text := " ".join((unescape(text) if "&" in text else text).split()):
                blocks.append(text)
            now.clear()

    def dropped(x: Node) -> bool:
        nonlocal most
        if _unseen(x):
            return True
        if not names or not x.out or x is part or x.tag == "header" and articles:
            return False
        if most is None:
            most = sum(len(own_text(y)) for y in _order(part) if not _unseen(y)) / 2
        return sum(len(own_text(y)) for y in _order(x) if not _unseen(y)) <= most

    todo: list = [part]
    while todo:
        x = todo.pop()
        if x is None:
            cut()
        elif x.__class__ is str:
            now.append(x)
        elif dropped(x):
            if x.tag not in INLINE and x.tag not in UNSEEN:
                cut()
        else:
            if x.tag not in INLINE:
                cut()
                todo.append(None)
            todo.extend(k for k in reversed(x.kids) if not (k.__class__ is str and id(x) in template))
    cut()
    return " ".join(blocks)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


class _Reference:
    """A host's reference page, and what the sums say of it."""

    def __init__(self, html: str, names: bool, sums: list | None = None):
        self.root = parse(html)
        self.nodes = _order(self.root)
        self.place = {id(n): k for k, n in enumerate(self.nodes)}
        self.text = [own_text(n) for n in self.nodes]
        self.twins: dict[int, dict[tuple[str, str], int]] = {}  # of each node its children by name and text
        for k, n in enumerate(self.nodes):
            for kid in _elements(n):
                if text := self.text[self.place[id(kid)]]:
                    self.twins.setdefault(k, {}).setdefault((kid.tag, text), self.place[id(kid)])
        self.fixed, self.extras, self.weight = set(), set(), {}
        if sums is not None:
            self._conclude(sums, names)

    def _conclude(self, sums: list, names: bool) -> None:
        """sums: (node, digest of a text that the reference lacks or null, pages, same, chars, chars known to be none, chars same)."""
        evidence = {i: Evidence(e.content, e.known) for i, e in alone(self.root, names).items()}  # the reference's own text is a page's too
        others = max((s["seen"] for s in sums), default=0)
        for s in sums:
            at = id(self.nodes[s["node"]])
            if s["extra"] is not None:
                if s["same"] >= 0.5 * others and weight(s["same"]) < 0.25:
                    self.extras.add((s["node"], s["extra"]))
                continue
            w = self.weight[s["node"]] = weight(s["same"])
            if s["same"] and (own := evidence.get(at)):
                own.content, own.same = own.content * w, own.content * (1 - w)
            e = evidence.setdefault(at, Evidence())
            e.content += s["chars"] + w * s["chars_same"]
            e.known += s["chars_known"]
            e.same += (1 - w) * s["chars_same"]
            if s["same"] and s["same"] >= 0.9 * s["pages"] and w < 0.25:
                self.fixed.add(s["node"])
        self.part = choose(self.root, evidence)


def _reference(held: dict, host: str, *args) -> _Reference:
    """Made once a task."""
    if host not in held:
        if len(held) > 2000:
            held.clear()
        held[host] = _Reference(*args)
    return held[host]


def _aligned(ref: _Reference, root: Node, names: bool) -> tuple[dict[int, int], list[tuple[Node, str, bool, int, bool]]]:
    """Places in the reference of the page's nodes; and for each of its texts (node, text, is it known to be no
    content, place of the node or its nearest aligned ancestor, is the node itself aligned)."""
    place = {id(y): ref.place[id(x)] for x, y in match(ref.root, root)}
    for x in _order(root):  # matching sees names and shapes; of aligned siblings those of equal text belong together
        if twins := ref.twins.get(place.get(id(x), -1)):
            kids = _elements(x)
            by_text = {twins[k]: id(kid) for kid in reversed(kids) if (k := (kid.tag, own_text(kid))) in twins}
            if by_text:
                for kid in kids:
                    if by_text.get(place.get(id(kid)), id(kid)) != id(kid):
                        del place[id(kid)]
                place |= {i: k for k, i in by_text.items()}
    found = {id(root): 0}
    for x in _order(root):
        at = found[id(x)] = place.get(id(x), found[id(x)])
        for kid in x.kids:
            if kid.__class__ is Node:
                found[id(kid)] = at
    return place, [(x, t, no, found[id(x)], id(x) in place) for x, t, no in _texts(root, names)]


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


SUMS = pa.schema([("host", pa.string()), ("node", pa.int32()), ("extra", pa.int64()), ("seen", pa.int64()), ("pages", pa.int64()), ("same", pa.int64()), ("chars", pa.int64()), ("chars_known", pa.int64()), ("chars_same", pa.int64())])
COUNTS = SUMS.names[3:]


def template_sums(pages: DataFrame, names: bool = True) -> DataFrame:
    """pages(host, html, ref): sums for each node of the references, made within each task before they are emitted.
    seen: pages that tell something (the same for all nodes of a host, kept with node 0)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs: dict = {}
        sums: dict = defaultdict(lambda: [0] * len(COUNTS))

        def emit() -> pa.RecordBatch:
            rows = [(*k, *v) for k, v in sums.items()]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows) if rows else ([],) * len(SUMS), SUMS)], schema=SUMS)

        for batch in batches:
            for host, html, reference in zip(*(batch.column(k).to_pylist() for k in range(3))):
                ref = _reference(refs, host, reference, names)
                _, texts = _aligned(ref, parse(html), names)
                same = [fits and t == ref.text[k] for _, t, _, k, fits in texts]
                if sum(len(x[1]) for x, s in zip(texts, same) if s) >= 0.8 * sum(len(x[1]) for x in texts):
                    continue  # the reference itself, a copy of it, or an empty page
                sums[host, 0, None][0] += 1
                for (_, t, no, k, fits), is_same in zip(texts, same):
                    c = sums[host, k, None]
                    c[1] += fits
                    c[2] += is_same
                    c[4 if no else 5 if is_same else 3] += len(t)
                for k, extra in {(k, _digest(t)) for _, t, _, k, fits in texts if not fits}:  # once a page, however often it comes there
                    sums[host, k, extra][2] += 1
            if len(sums) > 100_000:
                yield emit()
        yield emit()

    kind = "host string, node int, extra long, seen long, pages long, same long, chars long, chars_known long, chars_same long"
    return pages.select("host", "html", "ref").mapInArrow(task, kind).groupBy("host", "node", "extra").agg(*[F.sum(c).alias(c) for c in COUNTS])


def _references(p: DataFrame) -> DataFrame:
    """(host, ref): of each host's pages that aren't empty the one whose length is nearest to their median, of equal ones that of least page_id."""
    some = p.where("trim(html) <> ''").select("host", "page_id", "html", F.octet_length("html").alias("len"))
    mid = some.groupBy("host").agg(F.percentile_approx("len", F.lit(0.5), F.lit(1000)).alias("mid"), F.count("*").alias("n"))
    near = some.join(small(mid, 120), "host").groupBy("host").agg(F.min(F.struct(F.abs(F.col("len") - F.col("mid")).alias("off"), "page_id", F.xxhash64("html").alias("h"))).alias("m"))
    at = near.select("host", F.col("m.page_id").alias("at"), F.col("m.h").alias("h"))
    return some.join(small(at, 120), "host").where(F.col("page_id").eqNullSafe(F.col("at")) & (F.xxhash64("html") == F.col("h"))).groupBy("host").agg(F.min("html").alias("ref"))


def extract(spark: SparkSession, pages: DataFrame, names: bool = True, induction: bool = True) -> DataFrame:
    """page_id, url, text, n_chars of every page. names: whether element names, roles, classes and ids are evidence;
    induction: whether the host's other pages are."""
    work = Workspace(spark, "wrapper")
    p = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    refs = work.table(_references(p), "refs")

    def sent(df: DataFrame) -> DataFrame:
        size = df.agg(F.coalesce(F.sum(F.octet_length("ref") + 64), F.lit(0))).first()[0]
        return F.broadcast(df) if size <= 16 << 20 else df

    sums = template_sums(p.where("trim(html) <> ''").join(sent(refs), "host"), names)
    sums = sums.where("extra IS NULL OR same > 1").groupBy("host").agg(F.max("seen").alias("seen"), F.collect_list(F.struct("node", "extra", *COUNTS)).alias("all"))
    # of the texts that a reference lacks only those matter that half of the host's pages have, so the lists stay short
    sums = sums.select("host", F.filter("all", lambda s: s["extra"].isNull() | (2 * s["same"] >= F.col("seen"))).alias("sums"))
    hosts = work.table(refs.join(sums, "host"), "template")
    joined = p.join(sent(hosts), "host", "left").select("page_id", "url", "html", "host", "ref", "sums")
    if not induction:
        joined = joined.withColumn("ref", F.lit(None).cast("string"))
    page_kind = pages.schema["page_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            texts = []
            for k in range(batch.num_rows):
                html, host = batch.column(2)[k].as_py(), batch.column(3)[k].as_py()
                root, part, constant = parse(html), None, set()
                if batch.column(4)[k].is_valid and html:
                    ref = held[host] if host in held else _reference(held, host, batch.column(4)[k].as_py(), names, batch.column(5)[k].as_py())
                    place, found = _aligned(ref, root, names)
                    constant = {id(x) for x, t, _, at, fits in found if (at in ref.fixed and t == ref.text[at] if fits else (at, _digest(t)) in ref.extras)}
                    wanted = ref.place[id(ref.part)]
                    part = next((x for x in _order(root) if place.get(id(x)) == wanted), None)
                    own = {}
                    for x, t, no, at, fits in found:
                        w = 0.0 if id(x) in constant else ref.weight.get(at, 1.0) if fits and t == ref.text[at] else 1.0
                        own[id(x)] = Evidence(known=len(t)) if no else Evidence(len(t) * w, 0.0, len(t) * (1 - w))
                    if part is None or 2 * _held(part, own) < _held(root, own):
                        part = choose(root, own)
                texts.append(main_text(root, part, constant, names))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(task, f"page_id {page_kind}, url string, text string, n_chars long")
