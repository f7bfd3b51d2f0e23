"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors; a container's
points are discounted by its link density. The best container, or the whole article or
main element around it, is kept, with those of its siblings that hold text of the same kind.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import small_batches, table

#: Elements by what they do.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes annotation".split())
NEVER = frozenset("nav aside footer button select fieldset menu dialog head".split())
#: Whose paragraphs are those of the container around them; and what a cell that is a paragraph itself stands in.
WITHIN = frozenset("ul ol dl li dt dd blockquote figure".split())
FRAMES = WITHIN | frozenset("table thead tbody tfoot tr td th".split())
PARAGRAPHS = frozenset("html p pre td blockquote div section article main li dd h1 h2 h3 h4 h5 h6 body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class names that tell what isn't part of an article, those that may stand beside them, and those of an article.
UNLIKELY = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs combx comment comments consent cookie cookies disqus footer footnav gdpr header login"
    " masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promos promotion related remark remarks replies reply respond"
    " share sharing sidebar signup skip social sponsor sponsored sponsors subscribe tags toolbar widget widgets".split()
)
BESIDE = frozenset(
    "area articles bar block body bottom box btn button buttons card center col column container content count desktop dropdown en entries float form group head icon icons inner"
    " item items label left line link links list main message messages mobile module outer panel post posts primary right row secondary section site slot small stories text thread"
    " title top unit wrap wrapper".split()
)
LIKELY = frozenset("article body content entry hentry main page post text blog story".split())

#: A comment, a declaration, or a tag up to its end or its first value. Each repeat is taken whole and never given back.
_TAG = re.compile(r"<!--(?:[^-]++|-(?!->))*+(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)([^>=]*+)([>=])")
_VALUE_OR_END = re.compile(r">|=\s*+([\"'])")
_ATTRIBUTE = re.compile(r"""([^\s>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
_PARTS = re.compile(r"[a-z]+|[0-9]+")
#: Points of a sibling against the best container's, from which it is kept. From that ancestor on, the share of a paragraph's points is the same for all.
SIBLING, LEVELS = 0.2, 3
#: A form is part of the page, not a form of it, if it holds the article, or more than this share of all text.
FORM = 0.5
#: What belongs to an article that stands beside it, however short.
TITLES = HEADINGS | {"p", "header", "hgroup"}


class Node:
    """An element. block: itself, or the nearest ancestor that isn't a link; outer, framed: the nearest that isn't a list or quote, nor a table's part; link: the open link that it stands in, not beyond a block."""

    __slots__ = ("tag", "names", "parent", "children", "points", "chars", "linked", "dropped", "inside", "quoted", "outer", "framed", "block", "link")

    def __init__(self, tag: str, names: str, parent: Node | None, dropped: bool):
        self.tag, self.names, self.parent, self.dropped = tag, names, parent, dropped
        self.children: list[Node | str] = []
        self.points, self.chars, self.linked = 0.0, 0, 0
        self.inside: bool = tag in ("article", "main") or bool(parent and parent.inside)
        self.quoted: bool = tag == "blockquote" or bool(parent and parent.quoted)
        self.outer: Node = parent.outer if parent and tag in WITHIN else self
        self.framed: Node = parent.framed if parent and tag in FRAMES else self
        self.block: Node = parent.block if tag == "a" and parent else self
        self.link: Node | None = self if tag == "a" else None if tag in BLOCKS or not parent else parent.link


def _words(names: str) -> list[list[str]]:
    """The words of each of some class names."""
    return [_PARTS.findall(name) for name in names.split()]


def _unlikely(names: str, inside: bool) -> bool:
    """One of the names is made of UNLIKELY words, and of others only of those that stand beside them: `share-buttons`, but not `social-history`. Within an article a header is its own."""
    against = UNLIKELY - {"header"} if inside else UNLIKELY
    return any(not against.isdisjoint(words) and all(w in against or w in BESIDE or w.isdigit() for w in words) for words in _words(names))


def _likely(names: str) -> bool:
    return any(not LIKELY.isdisjoint(words) for words in _words(names))


def _attributes(attributes: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(attributes) if attributes else ():
        if name:
            found.setdefault(name.lower(), html.unescape(a or b or c).lower())
    return found


def _hidden(found: dict[str, str]) -> bool:
    """The hidden attribute (unless it waits for a search), aria-hidden=true, or a style that shows nothing; of a property's declarations the last counts."""
    if "hidden" in found and found["hidden"].strip() != "until-found" or found.get("aria-hidden", "").strip() == "true":
        return True
    style = {}
    for part in found.get("style", "").split(";"):
        name, _, value = part.partition(":")
        style[name.strip()] = value.partition("!")[0].strip()
    return style.get("display") == "none" or style.get("visibility") == "hidden"


class Tags:
    """Finds the tags of a page in time linear in it, if each search starts where the last tag ended.

    A quote counts only as that of a value, and only if it is closed. If no tag that begins with
    values ends before the page does, quotes count no more from there on.
    """

    def __init__(self, page: str):
        self.page, self.size = page, page.rfind(">") + 1
        self.last = {c: page.rfind(c) for c in ('"', "'")}
        self.quotes = True

    def _end(self, at: int) -> int:
        """Behind the `>` that ends a tag with values from here on; 0 if none does."""
        while self.quotes and (v := _VALUE_OR_END.search(self.page, at, self.size)):
            at = v.end()
            if not v[1]:
                return at
            if at <= self.last[v[1]]:
                at = self.page.index(v[1], at) + 1
        return 0

    def next(self, place: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, `/` or empty, name, attributes) of the next tag; comments and declarations have no name."""
        page = self.page
        m = _TAG.search(page, place, self.size) if place < self.size else None
        if not m or page.startswith("<!--", m.start()) and page[m.end() - 3 : m.end()] != "-->":  # a comment without an end
            start = m.start() if m else page.find("<!--", place)
            return (start, len(page), "", "", "") if start >= 0 else None
        end = m.end()
        if m[4] == "=":
            end = self._end(end - 1)
            if not end:
                self.quotes, end = False, page.index(">", m.end()) + 1
        return m.start(), end, m[1] or "", (m[2] or "").lower(), page[m.start(3) : end - 1] if m[2] else ""


def parse(page: str) -> list[Node]:
    """The page's block elements and links in page order, the root first; other inline elements leave only their text."""
    root = at = Node("html", "", None, False)
    nodes = [root]
    place, size = 0, len(page)
    ends: dict[str, int] = {}
    opened: dict[str, int] = {}

    def shut(node: Node) -> Node:
        """Closes all that is open within node, and itself."""
        now = at
        while True:
            opened[now.tag] -= 1
            up = now.parent or root
            if now is node:
                return up
            now = up

    tags = Tags(page)
    for start, end, closing, tag, attributes in iter(lambda: tags.next(place), None):
        if start > place:
            at.children.append(page[place:start])
        place = end
        if not tag:
            continue
        if not closing:
            if tag in RAW:
                if not attributes.endswith("/"):
                    if ends.get(tag, 0) < place:  # where it ends is looked up once, not again from each opening
                        close = re.compile(rf"</{tag}[\s/>]", re.I).search(page, place)
                        ends[tag] = close.start() if close else size
                    close = page.find(">", ends[tag])
                    place = size if ends[tag] == size or close < 0 else close + 1
                continue
            if tag == "br":
                at.children.append(" ")
            if tag in VOID and tag != "hr" or tag not in BLOCKS and tag not in NEVER and tag != "a":
                continue
            if tag == "a" and at.link:
                at = shut(at.link)
            if tag in BLOCKS:
                up = at.block
                if up.parent and (up.tag == "p" or tag == up.tag and tag in ("li", "td", "th", "tr", "dt", "dd", "option") or tag in HEADINGS and up.tag in HEADINGS):
                    at = shut(up)
            found = _attributes(attributes)
            names = " ".join(found[x] for x in ("class", "id", "role") if x in found)
            # Ids of headings, and within an article, are made from its own words.
            told = " ".join(found[x] for x in ("class", "role") if x in found) if at.inside else names
            unlikely = tag not in ("body", "article", "main") and tag not in HEADINGS and _unlikely(told, at.inside) and not (_likely(names) and tag in ("div", "section") and "comment" not in names)
            header = tag == "header" and not at.inside
            never = tag in NEVER and not (tag == "footer" and at.quoted)  # a quote's footer says whose it is
            node = Node(tag, names, at, at.dropped or never or header or unlikely or _hidden(found))
            at.children.append(node)
            nodes.append(node)
            if tag not in VOID and not attributes.endswith("/"):
                opened[tag] = opened.get(tag, 0) + 1
                at = node
        elif tag == "a":
            if at.link:
                at = shut(at.link)
        elif opened.get(tag):
            up = at
            while up.tag != tag:
                up = up.parent
            at = shut(up)
    if place < size:
        at.children.append(page[place:])
    return nodes


def _blocks(root: Node) -> list[tuple[Node, str, int, int]]:
    """(element, text, characters, characters in links) of each run of text between block borders, in page order."""
    found: list[tuple[Node, str, int, int]] = []
    run: list[str] = []
    linked = 0
    owner = root

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            found.append((owner, text, len(text), min(linked, len(text))))
        run.clear()
        linked = 0

    stack: list[tuple[Node, int, bool]] = [(root, 0, False)]
    while stack:
        node, place, link = stack.pop()
        if place == 0 and node.tag != "a":
            flush()
            owner = node
        while place < len(node.children):
            child = node.children[place]
            place += 1
            if isinstance(child, str):
                run.append(child)
                linked += len(child) if link else 0
            elif not child.dropped:
                stack.append((node, place, link))
                stack.append((child, 0, link or child.tag == "a"))
                break
            elif child.tag != "a":
                flush()
        else:
            if node.tag != "a":
                flush()
                owner = node.parent.block if node.parent else root
    return found


def _drop_forms(nodes: list[Node]) -> None:
    """Drops forms with all that is in them, but for one around the article, or around most of the page's text."""
    if not any(node.tag == "form" for node in nodes):
        return
    chars: dict[int, int] = {}
    holds: set[int] = set()
    for node in reversed(nodes):
        own = chars[id(node)] = chars.get(id(node), 0) + (0 if node.dropped else sum(len(c.strip()) for c in node.children if isinstance(c, str)))
        if node.parent:
            chars[id(node.parent)] = chars.get(id(node.parent), 0) + own
            if id(node) in holds or node.tag in ("article", "main") and not node.dropped:
                holds.add(id(node.parent))
    for node in nodes:
        if node.parent and node.parent.dropped or node.tag == "form" and id(node) not in holds and chars[id(node)] <= FORM * chars[id(nodes[0])]:
            node.dropped = True


def _whole(best: Node) -> Node:
    """The outermost article around best, or else the outermost main; best itself outside of both."""
    found: dict[str, Node] = {}
    node: Node | None = best
    while node:
        found[node.tag] = node
        node = node.parent
    return found.get("article") or found.get("main") or best


def main_text(page: str | None) -> str:
    """The article's text: blocks in page order, joined by a space; empty if there is none."""
    if not page:
        return ""
    nodes = parse(page)
    _drop_forms(nodes)
    blocks = _blocks(nodes[0])
    scored: dict[int, Node] = {}
    beyond: dict[int, float] = {}

    def add(node: Node, points: float) -> None:
        if id(node) not in scored:
            scored[id(node)] = node
            node.points += (25 if node.tag in ("article", "main") else 5 if node.tag in ("div", "section") else 0) + (25 if _likely(node.names) else 0)
        node.points += points

    for owner, text, chars, linked in blocks:
        paragraph = owner.tag in PARAGRAPHS and owner.tag not in HEADINGS
        points = (1 + text.count(",") + min(chars / 100, 3)) * (1 - linked / chars) if paragraph else 0.0
        node, share = (owner.parent or owner) if owner.tag in ("p", "pre", "h1", "h2", "h3", "h4", "h5", "h6") else owner, 1.0
        owner.chars += chars
        owner.linked += linked
        node = node.framed if owner.tag in ("td", "th") else node.outer
        level = 0
        while node and points:
            node = node.block
            level += 1
            if level > LEVELS:  # the rest of the way is gone once for all paragraphs
                beyond[id(node)] = beyond.get(id(node), 0.0) + points * share
                break
            add(node, points * share)
            share = max(share / 2, 0.25)
            node = node.parent
    for node in reversed(nodes):
        if id(node) in beyond:
            add(node, beyond[id(node)])
            if node.parent:
                up = node.parent.block
                beyond[id(up)] = beyond.get(id(up), 0.0) + beyond[id(node)]
    if not scored:  # no paragraph: the headlines of an article, if there is one
        keep = set()
        for node in nodes:
            if not node.dropped and (node.tag in ("article", "main") or node.parent and id(node.parent) in keep):
                keep.add(id(node))
        return " ".join(text for owner, text, _, _ in blocks if id(owner) in keep)
    for node in reversed(nodes[1:]):
        node.parent.chars += node.chars
        node.parent.linked += node.linked
    article = any(node.tag in ("article", "main") for node in scored.values())
    rank = lambda n: n.points * (1 - n.linked / n.chars if n.chars else 0) * (0.2 if article and n.tag in ("body", "html") else 1)
    best = max(scored.values(), key=rank)
    top = _whole(best)
    keep = {id(top)}
    siblings = [x for x in top.parent.children if isinstance(x, Node) and (x is top or not x.dropped and x.chars)] if top.parent and top.tag not in ("body", "html") else []
    among = top.parent is not None and top.parent.inside
    held = among and top.tag == "article"  # what stands beside an article within the main element
    for sibling in siblings:
        if sibling is not top and sibling.linked / sibling.chars < 0.25:
            scores = id(sibling) in scored and sibling.tag == top.tag and rank(sibling) >= SIBLING * max(rank(top), rank(best))
            if scores or sibling.tag == "p" and sibling.chars > 80 or held or among and (sibling.tag in TITLES or sibling.tag == top.tag):
                keep.add(id(sibling))
    follows = False  # titles and short paragraphs stand before what they belong to
    for sibling in reversed(siblings):
        follows = id(sibling) in keep or follows and sibling.tag in TITLES and sibling.linked / sibling.chars < 0.25
        if follows:
            keep.add(id(sibling))
    for node in nodes:
        if node.parent and id(node.parent) in keep:
            keep.add(id(node))
    return " ".join(text for owner, text, _, _ in blocks if id(owner) in keep)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([main_text(page.as_py()) for page in batch.column(0)], pa.string())], [*batch.schema.names[1:], "text"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) of every row, from its whole page and without a shuffle.

    White space inside a block is one space, blocks are joined by one; nothing is cut. A null or
    empty page, or one without an article, has empty text. Broken and unclosed markup is read as
    far as it goes. Null ids, repeated rows and other columns don't matter.
    """
    small_batches(pages.sparkSession)
    fields = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    rows = pages.select(F.col(html_col).cast("string").alias("page"), F.col(id_col).alias("id"), F.col(url_col).alias("link"))
    out = rows.mapInArrow(_extracted, f"id {fields[id_col]}, link {fields[url_col]}, text string")
    return out.select(F.col("id").alias(id_col), F.col("link").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


QUERIES = {"op7_html_text": op7_html_text}
ORACLE_SQL: dict[str, str] = {}
