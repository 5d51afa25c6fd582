"""Main text of a web page by tree scoring.

Paragraphs pass points for length and commas to their ancestors, half at each step up, containers are discounted by
link density, and the best container is kept with those siblings that score well beside it. What is never article text
(menus, adverts, forms, comments and the like, by tag or by the names in class, id and role) is left out, unless the
page has hardly any text outside of it: then it wraps the article and is looked into. Every pass is linear in the page.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

RAW = frozenset("script style textarea title noscript template iframe svg math select object".split())
NAME = re.compile(r"(/?)([a-z][^\s/>]*+)", re.I)
COMMENT_END = re.compile("--!?>")
QUOTED = re.compile(r"[>\"']")
#: A name starts where a run of name characters does, and nothing is tried twice.
ATTRIBUTE = re.compile(r"(?<![\w:-])([\w:-]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+", re.S)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Never article text, whatever it holds; and not unless it wraps the article.
GONE = frozenset("head button dialog nav footer menu".split())
ASIDE = frozenset("header aside form fieldset".split())
WHOLE = frozenset(("html", "body", "main"))
#: Names of class, id and role: of what is no article text, of reader comments and talk, of layout (they say nothing),
#: of article text, and words that tell what a page or post has rather than what an element is.
BAD = frozenset("ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promotion cookie cookies consent gdpr newsletter subscribe nav navbar navigation menu menubar breadcrumb breadcrumbs footer contentinfo share sharing social related recommended pagination pager sidebar header banner notice notices alert popup modal overlay masthead complementary toolbar signup login search dialog outbrain taboola".split())
COMMENTS = frozenset("comment comments commentlist disqus".split())
TALK = frozenset("respond discussion replies reply".split())
LAYOUT = frozenset("list area left right top bottom wrap wrapper container box section block bar inner outer holder panel links link items item widget widgets button buttons icons slot unit zone col column row grid global site page group form js id the".split())
GOOD = frozenset("article articles content main body post posts entry entries story stories text blog news".split())
HAS = frozenset("has with no without is not show hide tag category type format status".split())
SCORED = frozenset("p pre blockquote td dd".split())
CLOSES_P = BLOCK - {"br", "html", "body"}
#: Text that counts as some, and the share of a flagged node's text that may stand outside of it if it wraps the article.
ANY_TEXT, WRAPS, WRAPS_TALK = 25, 0.1, 0.02
CLOSES_OWN = frozenset("li td th tr option".split())


class Node:
    __slots__ = ("carried", "children", "commas", "flag", "inside", "link", "links", "parent", "points", "size", "tag", "whole")

    def __init__(self, tag: str, parent: Node | None, flag: int = 0):
        self.tag, self.parent, self.children, self.flag = tag, parent, [], flag
        self.points, self.carried, self.size, self.link, self.links, self.commas, self.inside, self.whole = 0.0, 0.0, 0, 0, 0, 0, 0, 0

    def density(self) -> float:
        return self.link / self.size if self.size else 0.0


def flag_of(tag: str, attributes: str) -> int:
    """0: may be article text; 1: only if it wraps the article; 2: the same, but it looks like talk of readers; 3: never."""
    if tag in GONE:
        return 3
    if tag in WHOLE:
        return 0
    found = int(tag in ASIDE)
    if not attributes:
        return found
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "style" and "display:none" in value.lower().replace(" ", "") or name == "aria-hidden" and value.lower() == "true":
            return 3
        if name in ("class", "id", "role"):
            for token in value.split():
                words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower()) if w and w not in LAYOUT]
                if not words or words[0] in HAS or not all(w in BAD or w in COMMENTS or w in TALK or w in GOOD for w in words):
                    continue
                ends = {words[0], words[-1]}
                if ends & COMMENTS:
                    return 3
                found = max(found, 2 if ends & TALK else int(bool(ends & BAD)))
    return found


def tokens(html: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, tag, "/" of an end tag, attributes) of every tag, in order; comments and raw elements have no tag.

    A tag ends at the first > outside of quotes. Once a page has a tag without one, quotes mean nothing in what
    follows, so that no stretch is searched again and again; a < that no > follows is text.
    """
    at, quotes, folded = 0, True, html.lower() if html.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), html)
    last = html.rfind(">")
    while (start := html.find("<", at)) >= 0 and start < last:
        if html.startswith("<!--", start):
            close = COMMENT_END.search(html, start + 4)
            at = close.end() if close else len(html)
            yield start, at, "", "", ""
            continue
        named = NAME.match(html, start + 1)
        if not named:
            if html[start + 1 : start + 2] in ("!", "?", "/"):
                at = html.find(">", start) + 1
                yield start, at, "", "", ""
            else:
                at = start + 1
            continue
        tag, end = named[2].lower(), -1
        if quotes:
            look = named.end()
            while (m := QUOTED.search(html, look)) and m[0] != ">":
                if (look := html.find(m[0], m.end()) + 1) == 0:
                    m = None
                    break
            end, quotes = (m.start(), True) if m else (-1, False)
        if end < 0:
            end = html.find(">", named.end())
        at = end + 1
        if tag in RAW and not named[1]:
            close = folded.find(f"</{tag}", at)
            at = folded.find(">", close) + 1 if close >= 0 else 0
            at = at or len(html)
            yield start, at, "", "", ""
            continue
        yield start, at, tag, named[1], html[named.end() : end]


def build(html: str) -> Node:
    """The page's tree. Open paragraphs and list items end where HTML lets them; stray end tags are ignored."""
    root = Node("html", None)
    stack, blocks, at = [root], [0], 0  # blocks: where the stack has a block
    held: defaultdict[str, list[int]] = defaultdict(list)  # where the stack has a tag

    def text(piece: str) -> None:
        if piece:
            stack[-1].children.append(unescape(piece) if "&" in piece else piece)

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            held[stack.pop().tag].pop()
        while blocks[-1] >= depth:
            blocks.pop()

    for start, end, tag, closing, attributes in tokens(html):
        text(html[at:start])
        at = end
        if not tag:
            continue
        if closing:
            if held[tag] and (tag in BLOCK or held[tag][-1] > blocks[-1]):  # an inline end tag closes no block
                pop_to(held[tag][-1])
            continue
        if tag in ("html", "body") and (held[tag] or tag == "html"):
            continue
        if tag in CLOSES_P and blocks[-1]:
            own = stack[blocks[-1]].tag
            if own == "p" or own == tag and tag in CLOSES_OWN or {own, tag} <= {"dt", "dd"}:
                pop_to(blocks[-1])
        node = Node(tag, stack[-1], flag_of(tag, attributes))
        stack[-1].children.append(node)
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCK:
            continue
        held[tag].append(len(stack))
        if tag in BLOCK:
            blocks.append(len(stack))
        stack.append(node)
    text(html[at:])
    return root


def walk(root: Node) -> list[Node]:
    """All nodes, parents first."""
    nodes, at = [root], 0
    while at < len(nodes):
        nodes += [c for c in nodes[at].children if isinstance(c, Node)]
        at += 1
    return nodes


def prune(root: Node) -> None:
    """Cut out what is flagged, but for wrappers: flagged nodes that hold nearly all that the page says.

    ``inside`` is a node's text outside of links and of flagged nodes below it, ``whole`` its text with theirs. From
    the top down, the largest flagged node (talk last) stays if all that stands outside of flagged nodes is little
    beside it; then its flag is void, and those below it are judged like it. An article or main element with text that
    stands free ends the search.
    """
    nodes = walk(root)
    for n in reversed(nodes):
        kids = [c for c in n.children if isinstance(c, Node)]
        if n.tag != "a" and n.flag != 3:
            own = sum(len(c.strip()) for c in n.children if isinstance(c, str))
            n.inside, n.whole = own + sum(c.inside for c in kids if not c.flag), own + sum(c.whole for c in kids)
    outside, queue, todo, order = root.inside, [], [root], 0
    while True:
        while todo:
            n = todo.pop()
            if n.tag in ("article", "main") and n.inside >= ANY_TEXT:
                queue.clear()
                todo.clear()
                break
            for c in n.children:
                if isinstance(c, Node) and not c.flag:
                    todo.append(c)
                elif isinstance(c, Node) and c.flag < 3:
                    order += 1
                    heappush(queue, (c.flag, -c.whole, order, c))
        if not queue:
            break
        flag, size, _, n = heappop(queue)
        if -size >= ANY_TEXT and outside <= -size * (WRAPS if flag == 1 else WRAPS_TALK):
            n.flag, outside = 0, outside + n.inside
            todo.append(n)
    for n in nodes:
        if any(isinstance(c, Node) and c.flag for c in n.children):
            n.children = [c for c in n.children if not (isinstance(c, Node) and c.flag)]


def score(nodes: list[Node]) -> None:
    """Sizes, link text and commas go up in one pass; so do points, halved at each step."""
    for n in reversed(nodes):
        for c in n.children:
            if isinstance(c, Node):
                n.size, n.link, n.commas, n.links = n.size + c.size, n.link + c.link, n.commas + c.commas, n.links + c.links
                n.points += c.carried
            else:
                n.size += len(c.strip())
                n.commas += c.count(",") + c.count("،") + c.count("、") + c.count("，")
        if n.tag == "a":
            n.link, n.links = n.size, n.links + 1
        own = 1 + n.commas + min(n.size / 100, 3) if n.tag in SCORED and n.size >= 25 else 0.0
        n.carried = own + n.points / 2


def menu(n: Node) -> bool:
    """A list that is nothing but three or more links."""
    return n.tag in ("ul", "ol", "div", "table", "p", "section") and n.size > 0 and n.link >= 0.9 * n.size and n.links >= 3


def best(nodes: list[Node]) -> list[Node]:
    """The container to keep and its good siblings, in page order."""
    found = [n for n in nodes if n.points > 0]
    if not found:
        named = {id(n) for n in nodes if n.tag == "article"} or {id(n) for n in nodes if n.tag == "main"}
        within: set[int] = set()
        for n in nodes:
            if id(n.parent) in within or id(n.parent) in named:
                within.add(id(n))
        outer = named - within
        return [n for n in nodes if id(n) in outer] or nodes[:1]
    top = max(found, key=lambda n: n.points * (1 - n.density()))
    frame = [a for a in [top, *above(top)] if a.tag == "article"] or [a for a in [top, *above(top)] if a.tag == "main"]
    if frame:
        top = frame[-1]
    else:
        while top.parent is not None and top.parent.tag not in ("html", "body") and top.parent.points >= top.points:
            top = top.parent
    if top.parent is None:
        return [top]
    mark, kept = max(10.0, 0.2 * top.points), []
    for c in top.parent.children:
        if not isinstance(c, Node):
            continue
        scores = c.points * (1 - c.density()) >= mark
        if c is top or (scores and c.tag == top.tag if frame else scores or c.tag == "p" and c.size >= 80 and c.density() < 0.25 or re.fullmatch("h[1-6]", c.tag)):
            kept.append(c)
    return kept


def above(n: Node) -> Iterator[Node]:
    while (n := n.parent) is not None:
        yield n


def main_text(html: str) -> str:
    """The article's blocks, white space made single, in page order, joined by one space."""
    root = build(html)
    prune(root)
    nodes = walk(root)
    score(nodes)
    blocks: list[list[str]] = [[]]
    todo: list[Node | str | None] = best(nodes)[::-1]
    while todo:
        x = todo.pop()
        if x is None:
            blocks.append([])
        elif isinstance(x, str):
            blocks[-1].append(x)
        elif not menu(x):
            if x.tag in BLOCK:
                blocks.append([])
                todo.append(None)
            todo += x.children[::-1]
    return " ".join(t for b in blocks if (t := " ".join("".join(b).split())))


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns and ``text`` of every page; null and empty pages and pages without text give the empty text.

    Repeated rows give repeated rows; an empty table gives none; further columns are not read. Row by row, no shuffle.
    """
    rows = pages.select(*keep, html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = pa.array([main_text(x or "") for x in part.column(len(keep)).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], texts], [*keep, "text"])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep), "text string"]))
