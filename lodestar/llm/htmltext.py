"""Main text of web pages by composite text density.

A page becomes a tree. Every node has a composite density: its characters by tag, adjusted by how much of both is in
links and by the page's link share. A container's density sum is that of its children. The container with the largest
sum is the heart of the text; the least density on its path from the body is the threshold. What lies beside the path is
kept if it reaches the threshold, and half the mean density of the heart's children unless it is a title, and is not
mostly links. Inside what is kept, lists of links go.

Scripts, styles and the like are no text. Elements that call themselves navigation, advert, comments, ... by tag, role,
class or id give only a weak sign: one is left out before densities are measured if it holds at most half of the page's
text outside links, or is mostly links. One that holds more is left out too if it has no blocks of its own (an advert
longer than a short article) or is for comments of readers; unless it holds the page's only article or main element.

Blocks are separated by one line feed; white space inside a block is one space. Null or empty html: empty text. Very long
and broken pages: reading is linear in the length; a tag without an end takes the rest of the page, as in browsers.
Repeated rows: each is extracted. Ties of density sums: the first container in page order.
"""

from __future__ import annotations

import html as entities
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import map_texts

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
INSIDE = re.compile(r"""[^>"']*""")
VALUE_NEXT = re.compile(r"=\s*\Z")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACES = re.compile(r"\s+")

# Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section"
    " summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - set("br html body head caption td th tr tbody thead tfoot option optgroup legend title".split())
ROWS = frozenset("tr td th tbody thead".split())
SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": ROWS, "tfoot": ROWS,
}
HOLDERS = frozenset("ul ol dl table select".split())
NO_TEXT = RAW | frozenset("svg math button select template canvas object audio video head input".split())
CONTAINERS = frozenset("html body article main section div center td form header footer aside nav details figure fieldset dialog".split())
SIGNING = frozenset("nav footer aside form header dialog menu fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form tablist toolbar".split())
NEVER = frozenset("html body article main".split())

#: Words of class and id that are a sign; the second list is one only beside no word of the third.
ALWAYS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot advertorial sponsor sponsored promo promotion"
    " cookie cookies consent gdpr notice notices notification banner sidebar sidenav rail nav navbar navigation"
    " navigations menu menus breadcrumb breadcrumbs comment comments disqus respond reply replies share sharing social"
    " newsletter subscribe subscription related recommended popup modal overlay pagination pager skip toolbar signup"
    " login paywall disclaimer".split()
)
OFTEN = frozenset("header footer masthead widget widgets meta tags toc copyright legal top bottom".split())
ARTICLE = frozenset("article content main post entry story text body title headline".split())
#: Comments of readers may be longer than the article.
READERS = frozenset("comment comments disqus respond reply replies".split())
#: First and last words of compounds that say what a page has, not what an element is; and of those that hold others.
HAVING, STATES = frozenset("no has have with without".split()), frozenset("open closed enabled disabled".split())
HOLDING = frozenset("wrap wrapper".split())
WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


class Node:
    __slots__ = ("tag", "parent", "parts", "chars", "tags", "link_chars", "link_tags", "density", "total", "dropped", "signs")

    def __init__(self, tag: str, parent: "Node | None", dropped: bool = False, signs: frozenset | set = frozenset()):
        self.tag, self.parent, self.dropped, self.signs = tag, parent, dropped, signs
        self.parts: list = []  # texts and nodes, in order
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def signs_of(tag: str, attributes: str) -> tuple[bool, set[str]]:
    """If an element is no text at all; and the words by which it calls itself boilerplate."""
    if tag in NO_TEXT:
        return True, set()
    if tag in NEVER:
        return False, set()
    signs = {tag} if tag in SIGNING else set()
    words: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True, set()
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return True, set()
        if name == "role" and value.lower() in ROLES:
            signs.add(value.lower())
        if name in ("class", "id"):
            for compound in value.split():
                own = [w.lower() for w in WORDS.findall(compound)]
                holds = own and own[-1] in HOLDING and not ARTICLE.isdisjoint(own)
                if len(own) > 1 and (own[0] in HAVING or own[-1] in STATES or holds):
                    own = [w for w in own if w in ARTICLE]
                words.update(own)
    signs |= words & ALWAYS
    if words.isdisjoint(ARTICLE):
        signs |= words & OFTEN
    return False, signs


class Tree:
    """The open elements while a page is read; finds the nearest one of a name without a walk."""

    def __init__(self):
        self.root = Node("html", None)
        self.stack = [self.root]
        self.places: dict[str, list[int]] = {}  # by tag, its places on the stack
        self.block_places: list[int] = []

    def place(self, tag: str) -> int:
        """Of the nearest open element of that name; 0 if there is none."""
        own = self.places.get(tag)
        return own[-1] if own else 0

    def nearest(self, tags) -> int:
        return max(map(self.place, tags))

    def nearest_block(self) -> int:
        return self.block_places[-1] if self.block_places else 0

    def open(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK:
            self.block_places.append(len(self.stack))
        self.stack.append(node)

    def close(self, place: int) -> None:
        """The element at that place, and all that is inside it."""
        while len(self.stack) > place:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in BLOCK:
                self.block_places.pop()

    def end_tag(self, tag: str) -> None:
        place = self.place(tag)
        if place and (tag in BLOCK or self.nearest_block() < place):  # an inline end tag does not end a block
            self.close(place)

    def start_tag(self, tag: str, attributes: str) -> None:
        if tag in CLOSES_P and self.place("p") and self.nearest_block() == self.place("p"):
            self.close(self.place("p"))
        if tag in SIBLINGS:
            while (place := self.nearest(SIBLINGS[tag])) > self.nearest(HOLDERS):
                self.close(place)
        if tag == "body":
            self.close(1)
        dropped, signs = signs_of(tag, attributes)
        if tag == "header" and (self.place("article") or self.place("main")):
            signs.discard("header")
        node = Node(tag, self.stack[-1], dropped, signs)
        self.stack[-1].parts.append(node)
        if tag not in VOID and tag not in RAW and not attributes.endswith("/"):
            self.open(node)


def end_of_tag(page: str, at: int) -> int:
    """Place of the ``>`` that ends a tag, -1 if none does. Only quotes after ``=`` hide one."""
    start = at
    while True:
        at = INSIDE.match(page, at).end()
        if at >= len(page):
            return -1
        if page[at] == ">":
            return at
        close = page.find(page[at], at + 1) if VALUE_NEXT.search(page, max(start, at - 8), at) else at
        if close < 0:
            return page.find(">", at)
        at = close + 1


def parse(page: str) -> Node:
    """The tree of a page; unclosed and misplaced tags end where browsers end them, more or less."""
    tree, at, n = Tree(), 0, len(page)
    lower = None
    while at < n:
        m = page.find("<", at)
        m = n if m < 0 else m
        if m > at:
            text = page[at:m]
            tree.stack[-1].parts.append(entities.unescape(text) if "&" in text else text)
        if m >= n:
            break
        if page.startswith("<!--", m):
            end = page.find("-->", m + 4)
            at = n if end < 0 else end + 3
            continue
        ending = page.startswith("/", m + 1)
        name = NAME.match(page, m + 1 + ending)
        if not name:
            if page[m + 1 : m + 2] in ("!", "/", "?"):
                end = page.find(">", m)
                at = n if end < 0 else end + 1
            else:
                tree.stack[-1].parts.append("<")
                at = m + 1
            continue
        end = end_of_tag(page, name.end())
        at = n if end < 0 else end + 1
        if end < 0:
            break
        tag, attributes = name.group().lower(), page[name.end() : end]
        if ending:
            tree.end_tag(tag)
        elif tag not in ("html", "body") or not tree.place(tag):
            tree.start_tag(tag, attributes)
            if tag in RAW:
                if lower is None:
                    lower = re.sub("[A-Z]+", lambda x: x.group().lower(), page)  # every letter keeps its place
                close = lower.find(f"</{tag}", at)
                close = page.find(">", close) if close >= 0 else -1
                at = close + 1 if close >= 0 else n
    return tree.root


def in_order(root: Node) -> list[Node]:
    """Nodes that are not left out, parents before children."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        if not x.dropped:
            out.append(x)
            todo.extend(p for p in reversed(x.parts) if p.__class__ is Node)
    return out


def count(root: Node) -> list[Node]:
    """Characters and tags, all and in links, of every node."""
    nodes = in_order(root)
    for x in nodes:
        x.chars = sum(len(SPACES.sub(" ", p).strip()) for p in x.parts if p.__class__ is str)
        x.tags = x.link_chars = x.link_tags = 0
    for x in reversed(nodes):
        if x.tag == "a":
            x.link_chars, x.link_tags = x.chars, x.tags + 1
        if x.parent is not None:
            p = x.parent
            p.chars, p.tags = p.chars + x.chars, p.tags + x.tags + 1
            p.link_chars, p.link_tags = p.link_chars + x.link_chars, p.link_tags + x.link_tags
    return nodes


def leave_out(root: Node) -> None:
    """Drops what the weak signs speak against; densities are measured without it."""
    nodes = count(root)
    if not any(x.signs for x in nodes):
        return
    own = {id(x): x.chars - x.link_chars for x in nodes}
    blocks_in, holds = dict.fromkeys(own, 0), {}
    under: dict[int, bool] = {}
    for x in nodes:
        under[id(x)] = bool(x.signs) or (x.parent is not None and under[id(x.parent)])
    for x in reversed(nodes):
        if x.parent is not None:
            blocks_in[id(x.parent)] += blocks_in[id(x)] + (x.tag in BLOCK and x.tag != "br" and x.chars > 0)
    mains = [x for x in nodes if x.tag == "main" and own[id(x)]]
    articles = [x for x in nodes if x.tag == "article" and own[id(x)]]
    if not mains and not any(not under[id(x)] for x in articles):
        mains = [max(articles, key=lambda x: own[id(x)])] if articles else []
    elif not any(not under[id(x)] for x in mains) and any(not under[id(x)] for x in articles):
        mains = []
    for x in mains:
        while x is not None and id(x) not in holds:
            holds[id(x)] = True
            x = x.parent
    for x in nodes:
        if not x.signs or id(x) in holds:
            continue
        small = 2 * own[id(x)] <= own[id(root)]
        x.dropped = small or 2 * x.link_chars > x.chars or not x.signs.isdisjoint(READERS) or not blocks_in[id(x)]


def densities(root: Node) -> tuple[list[Node], Node]:
    """Composite density and density sum of every node that is left; the nodes and the body."""
    nodes = count(root)
    body = next((x for x in nodes if x.tag == "body"), root)
    share = body.link_chars / max(1, body.chars)
    for x in nodes:
        x.density = x.total = 0.0
        if x.chars:
            c, t, lc, lt = x.chars, max(1, x.tags), max(1, x.link_chars), max(1, x.link_tags)
            base = math.log(math.log(c / max(1, c - x.link_chars) * lc + share * c + math.e))
            x.density = c / t * math.log(max(c * t / (lc * lt), 1.0)) / base
    for x in nodes:
        if x.parent is not None:
            x.parent.total += x.density
    return nodes, body


def links_only(x: Node) -> bool:
    """A container or list of three links or more that has little text beside them."""
    return x.link_tags >= 3 and 3 * x.link_chars > 2 * x.chars and (x.tag in CONTAINERS or x.tag in HOLDERS or x.tag == "menu")


def keep(nodes: list[Node], body: Node) -> list[Node]:
    """The subtrees that are the main text, in page order."""
    best = max((x for x in nodes if x.chars and x.tag in CONTAINERS), key=lambda x: x.total, default=None)
    if best is None:
        return []
    path, x = [], best
    while x is not None:
        path.append(x)
        if x is body:
            break
        x = x.parent
    least = min(x.density for x in path)
    own = [p.density for p in best.parts if p.__class__ is Node and p.density > 0]
    threshold = max(least, sum(own) / len(own) / 2 if own else 0.0)
    on_path, out = {id(x) for x in path}, []
    todo = [path[-1]]
    while todo:
        x = todo.pop()
        if x is best:
            out.append(x)
        elif id(x) in on_path:
            todo.extend(p for p in reversed(x.parts) if p.__class__ is Node and not p.dropped)
        elif x.chars and x.density >= (least if x.tag in ("h1", "h2") else threshold) and 2 * x.link_chars <= x.chars:
            out.append(x)
    for x in nodes:
        x.dropped = x.dropped or (id(x) not in on_path and links_only(x))
    return out


def blocks(tops: list[Node]) -> list[str]:
    """Texts of the blocks, in page order."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = SPACES.sub(" ", "".join(line)).strip()
        if text:
            out.append(text)
        line.clear()

    for top in tops:
        todo: list = [top]
        while todo:
            x = todo.pop()
            if x is None:
                end()
            elif x.__class__ is str:
                line.append(x)
            elif not x.dropped:
                if x.tag in BLOCK:
                    end()
                    todo.append(None)
                todo.extend(reversed(x.parts))
        end()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    leave_out(root)
    return "\n".join(blocks(keep(*densities(root))))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars. Null page_id or url: passed through."""
    key = F.struct(F.col("page_id").cast("long").alias("page_id"), "url").alias("page")
    both = pages.select(key, F.coalesce("html", F.lit("")).alias("html"))

    def rows(keys, batch):
        for k, h in zip(keys, batch):
            text = main_text(h)
            yield k["page_id"], k["url"], text, len(text)

    return map_texts(both, "page_id long, url string, text string, n_chars long", rows, first="page", second="html")
