"""Main text of web pages by tree scoring.

A page becomes a tree. Every paragraph gives points for its length and its commas to
its ancestors (all to the parent, half to the grandparent, less above), and a container
keeps the part of its points that is not link text. The container with most points is
the article, or the ``<article>`` or ``<main>`` around it if there is one. Without
those the part of the body that the best container lies in is kept whole, and its
siblings that are not mostly links, so nothing depends on how long a part is. Inside,
what is a menu, notice, form, advert or reader comment by its tag, role or name, and
blocks of mostly links, are left out. A name that says both (``post-comments``) is left
out too, unless the article or its title lies inside.

One page is one row and is handled alone, so pages need no shuffle. The parser is
forgiving: paragraphs, list items and cells close by themselves, stray end tags are
ignored, raw text elements end at their own end tag only. What is open is counted by
name, so its time is in proportion to the page, whatever the markup.

Defined results: null, empty and text-free pages give an empty text; rows that repeat
get equal results, null ids and urls stay; an empty table gives an empty one; further
columns are not looked at. A page is one row and read whole, in time in proportion to
its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video head title textarea select".split())
VERBATIM = frozenset("script style title textarea iframe".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("nav footer aside form button dialog menu search".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
CLOSES = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "thead": frozenset(["thead", "tbody", "tfoot", "tr", "td", "th"]),
    "tbody": frozenset(["thead", "tbody", "tfoot", "tr", "td", "th"]),
    "tfoot": frozenset(["thead", "tbody", "tfoot", "tr", "td", "th"]),
    "option": frozenset(["option"]),
}
HOLDS = {
    "li": frozenset(["ul", "ol", "menu"]),
    "dt": frozenset(["dl"]),
    "dd": frozenset(["dl"]),
    "tr": frozenset(["table"]),
    "td": frozenset(["table"]),
    "th": frozenset(["table"]),
    "thead": frozenset(["table"]),
    "tbody": frozenset(["table"]),
    "tfoot": frozenset(["table"]),
    "option": frozenset(["select"]),
}
HOLDERS = frozenset().union(*HOLDS.values())
VERBATIM_ENDS = {tag: re.compile(rf"</{tag}\s*/?\s*>", re.IGNORECASE) for tag in VERBATIM}
PARAGRAPH_ENDS = BLOCKS - {"body", "html", "caption", "legend", "tbody", "td", "tfoot", "th", "thead", "tr", "li"} | {"li"}
# Parts of class and id names of what is not the article.
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adsense|sponsor(?:ed)?|promo(?:tion)?|banner|breadcrumbs?|"
    r"comments?|commentlist|respond|replies|disqus|discussion|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|"
    r"footer|foot|header|masthead|menu|nav|navbar|navigation|sidebar|side|widgets?|related|recommended|share|sharing|"
    r"social|subscribe|newsletter|signup|login|pager|pagination|toolbar|skip|rail|tags|toc)(?:$|[\s_-])",
    re.IGNORECASE,
)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
TAG = re.compile(r"<(?:!--(.*?)(?:--!?>|$)|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|$))", re.DOTALL)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.IGNORECASE)
WHITE = re.compile(r"[ \t\n\r\f\v   -     　\x85\x1c-\x1f]+")

PARAGRAPH_TAGS = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 figcaption".split())
CONTAINERS = frozenset("article main section div body td blockquote form".split())
#: Points that a container's tag or name gives it.
HEAD_START = {"article": 30.0, "main": 25.0, "div": 5.0, "section": 5.0, "body": 0.0}
LIKELY = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|main|body|text|prose)(?:$|[\s_-])", re.IGNORECASE)


class Node:
    """An element; ``doubtful`` ones are left out unless the article lies inside."""

    __slots__ = (
        "tag", "parent", "children", "dropped", "doubtful", "heads", "name", "score", "chars", "linked", "at",
        "block", "holders", "items", "inline", "open",
    )

    def __init__(self, tag: str, parent: Node | None, name: str = "", dropped: bool = False):
        self.tag, self.parent, self.name, self.dropped = tag, parent, name, dropped
        self.children: list[Node | str] = []
        self.score = 0.0
        self.chars = self.linked = self.at = 0
        self.doubtful = self.heads = False
        self.open = True
        #: While parsing: the block around, the elements that hold items around, and what is open in this one.
        self.block: Node = self if parent is None or tag in BLOCKS else parent.block
        self.holders: dict[str, Node] = parent.holders if parent is not None else {}
        self.items: list[Node] = []
        self.inline: dict[str, int] = {}


def _attributes(raw: str) -> tuple[str, str, bool]:
    """class and id, role, and whether the element is hidden."""
    names, role, hidden = [], "", False
    if not raw or "=" not in raw and "hidden" not in raw.lower():
        return "", "", False
    for m in ATTRIBUTE.finditer(raw):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            names.append(value)
        elif key == "role":
            role = value.strip().lower()
        elif key == "hidden":
            hidden = True
        elif key == "aria-hidden":
            hidden |= value.strip().lower() == "true"
        elif "display:none" in value.replace(" ", "").lower():
            hidden = True
    return CAMEL.sub("-", " ".join(names)), role, hidden


class _Parser:
    """The tree so far and what is open in it."""

    def __init__(self):
        self.root = self.here = Node("body", None)
        self.open: dict[str, int] = {}
        self.nodes = [self.root]

    def push(self, node: Node) -> None:
        self.here.children.append(node)
        self.nodes.append(node)

    def enter(self, node: Node) -> None:
        self.here = node
        tag = node.tag
        self.open[tag] = self.open.get(tag, 0) + 1
        if node.block is not node:
            node.block.inline[tag] = node.block.inline.get(tag, 0) + 1
        if tag in HOLDERS:
            node.holders = {**node.holders, tag: node}
        if tag in CLOSES:
            self.holder(tag).items.append(node)

    def leave_to(self, node: Node) -> None:
        """Closes everything below ``node``; each element is closed once."""
        while self.here is not node:
            tag, block = self.here.tag, self.here.block
            self.open[tag] -= 1
            if block is not self.here:
                block.inline[tag] -= 1
            self.here.open = False
            self.here = self.here.parent

    def holder(self, tag: str) -> Node:
        """The nearest element around whose items of this tag close each other."""
        around = [self.here.holders[t] for t in HOLDS[tag] if t in self.here.holders]
        return max(around, key=lambda n: n.at) if around else self.root

    def end(self, tag: str) -> None:
        """An end tag; one that closes nothing is ignored.

        The end of inline markup does not reach over the blocks around it.
        """
        known = self.open if tag in BLOCKS else self.here.block.inline
        if not known.get(tag):
            return
        node = self.here
        while node.tag != tag:
            node = node.parent
        self.leave_to(node.parent)

    def end_paragraph(self) -> None:
        if self.here.block.tag == "p":
            self.leave_to(self.here.block.parent)

    def end_item(self, tag: str) -> None:
        """The outermost open item that the new one ends, and all below it."""
        items = self.holder(tag).items
        while items and not items[-1].open:
            items.pop()
        at = next((k for k, n in enumerate(items) if n.tag in CLOSES[tag]), None)
        if at is not None:
            self.leave_to(items[at].parent)
            del items[at:]


def parse(html: str) -> Node:
    """The tree of a page; leaves are decoded pieces of text."""
    tree, at, size = _Parser(), 0, len(html)
    while at < size:
        m = TAG.search(html, at)
        if not m:
            tree.here.children.append(unescape(html[at:]))
            break
        if m.start() > at:
            tree.here.children.append(unescape(html[at : m.start()]))
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if m[2]:
            tree.end(tag)
            continue
        if tag in ("html", "body"):
            continue
        if tag in VERBATIM:
            end = VERBATIM_ENDS[tag].search(html, at)
            at = end.end() if end else size
            continue
        if tag in PARAGRAPH_ENDS:
            tree.end_paragraph()
        if tag in CLOSES:
            tree.end_item(tag)
        if tag == "br" or tag == "wbr":
            tree.here.children.append(" " if tag == "br" else "")
            continue
        name, role, hidden = _attributes(m[4])
        dropped = hidden or tag in RAW or tag in DROPPED or role in DROPPED_ROLES
        dropped |= tag == "header" and not tree.open.get("article")
        node = Node(tag, tree.here, name, dropped)
        node.at = len(tree.nodes)
        node.doubtful = bool(name) and bool(UNLIKELY.search(name))
        tree.push(node)
        if tag not in VOID and not (m[4] or "").endswith("/"):
            tree.enter(node)
    for node in reversed(tree.nodes):
        own = node.tag in ("article", "main") or node.tag == "h1" and not node.dropped
        node.heads |= own
        if node.doubtful and not node.heads:
            node.dropped = True
        if node.heads and not node.dropped and node.parent is not None:
            node.parent.heads = True
    return tree.root


def _order(root: Node) -> list[Node]:
    """All elements that are not left out, parents first."""
    found, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        node.at = len(found)
        found.append(node)
        waiting.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.dropped)
    return found


def _measure(nodes: list[Node]) -> None:
    """Text and link text of each element, then the points that paragraphs give."""
    for node in reversed(nodes):
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        node.chars += own
        if node.tag == "a":
            node.linked = node.chars
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    for node in nodes:
        if node.tag in HEAD_START:
            node.score += HEAD_START[node.tag]
        if node.name and LIKELY.search(node.name):
            node.score += 25.0
    for node in nodes:
        direct = any(isinstance(c, str) and c.strip() for c in node.children)
        if node.tag in PARAGRAPH_TAGS or (direct and node.tag in CONTAINERS):
            words = node.chars - node.linked
            if words <= 0:
                continue
            commas = sum(c.count(",") for c in node.children if isinstance(c, str))
            points = 1.0 + commas + min(words / 100.0, 3.0)
            above, share = (node if node.tag in CONTAINERS else node.parent), 1.0
            for depth in range(1, 6):
                if above is None:
                    break
                if above.tag in CONTAINERS or depth <= 2:
                    above.score += points * share
                share = 0.5 if depth == 1 else share / (depth * 1.5)
                above = above.parent


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _final(node: Node) -> float:
    return node.score * (1.0 - _density(node))


def _chosen(nodes: list[Node]) -> list[Node]:
    """The best container and those of its siblings that belong to it, in page order."""
    held = [n for n in nodes if n.tag in CONTAINERS and n.chars]
    if not held:
        return nodes[:1]
    best = max(held, key=lambda n: (_final(n), -n.at))
    # The best part of an article stands for the article, however long that part is.
    above, outer = best, None
    while above is not None:
        outer = above if above.tag in ("article", "main") else outer
        above = above.parent
    if outer is not None or best.parent is None:
        return [outer or best]
    while best.parent.parent is not None:
        best = best.parent
    # Its siblings, bare text and inline markup between them too.
    whole = Node("div", None)
    for c in best.parent.children:
        block = isinstance(c, Node) and c.tag in BLOCKS
        if c is best or not block or (c.chars and not c.dropped and _density(c) < 0.25):
            whole.children.append(c)
    return [whole]


def _link_list(node: Node) -> bool:
    return node.tag in ("ul", "ol", "div", "section", "table", "dl") and node.chars > 0 and _density(node) > 0.7


def _blocks(node: Node) -> Iterator[str]:
    """The texts between block borders, white space turned into single spaces."""
    pieces: list[str] = []
    waiting: list[Node | str | None] = [node]
    while waiting:
        item = waiting.pop()
        if isinstance(item, str):
            pieces.append(item)
            continue
        if item is None or item.tag in BLOCKS:
            if pieces:
                text = WHITE.sub(" ", "".join(pieces)).strip(" ")
                pieces = []
                if text:
                    yield text
        if item is None or item.dropped or (item is not node and _link_list(item)):
            continue
        if item.tag in BLOCKS:
            waiting.append(None)
        waiting.extend(reversed(item.children))
    text = WHITE.sub(" ", "".join(pieces)).strip(" ")
    if text:
        yield text


def extract(html: str | None) -> str:
    """The main text of a page."""
    if not html:
        return ""
    nodes = _order(parse(html))
    _measure(nodes)
    return "\n".join(t for node in _chosen(nodes) for t in _blocks(node))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [extract(x.as_py()) for x in part.column(2)]
                columns = [part.column(0), part.column(1), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text"])

    rows = pages.select("page_id", "url", "html")
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string")
