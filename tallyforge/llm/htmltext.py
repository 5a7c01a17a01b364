"""Main text of HTML pages by tree scoring.

A forgiving parser builds a tree. Boilerplate elements are cut out by tag,
role, and class or id. Every paragraph gives points for its length and commas
to its ancestors, fewer the further they are; a container's points are
discounted by its link density. The best container is kept, with those
siblings that look like parts of the same article.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import map_rows

EXTRACTED = "page_id long, url string, text string, n_chars long"
# As in HTML, only a quote right after "=" opens a value, of any length. One that is never closed is part of a bare value
# and its tag ends at the next >; no quote of that kind follows, so each kind is searched in vain once a page.
_TAG = re.compile(r"""<!--(?:.*?--!?>|.*\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s/=>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+))?+)?+""")
#: Attributes of a named place that closes itself, as XHTML writes it. Otherwise a slash at the end of a tag means nothing, as in HTML.
_PLACE = re.compile(r"""\s(?:name|id)\s*=\s*(?:"[^"]*"|'[^']*')\s*/""", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
CUT = frozenset("script style title textarea xmp iframe noembed noframes head nav footer header aside form button select noscript template object embed svg canvas dialog menu audio video map datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Tags that an opening tag closes when they are open, and the elements that keep them open from outside.
CLOSES = {t: frozenset(["p"]) for t in "address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()}
CLOSES |= {"li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "tbody": frozenset(["tr", "td", "th", "thead", "p"]), "body": frozenset(["head"]), "option": frozenset(["option"])}
SCOPES = frozenset("html body div article section main table ul ol dl td th blockquote nav aside header footer form button".split())
#: Fixed word lists for classes and ids: boilerplate unless the element is an article or holds most of the text; boilerplate; content; boilerplate inside lines, too.
ALWAYS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr sidebar nav navbar navigation menu breadcrumb breadcrumbs comment comments disqus share sharing social related recommended newsletter subscribe popup modal pagination pager skip".split())
UNLESS = frozenset("header footer masthead notice notices widget side rail toolbar login signup alert form replies respond overlay meta tags byline".split())
CONTENT = frozenset("article body content entry main post story text page".split())
ALWAYS_INLINE = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner share sharing social newsletter subscribe breadcrumb breadcrumbs".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of a class or id after which its other words tell what an element has or lacks, not what it is.
HAVING = frozenset("has no with without".split())
PARAGRAPHS = frozenset("p pre td th li dd dt blockquote h1 h2 h3 h4 h5 h6 figcaption".split())
HEADINGS = frozenset("h1 h2".split())
LISTS = frozenset("ul ol dl div table section".split())
#: Ancestors that a paragraph's points reach.
REACH = 5


class Node:
    __slots__ = ("children", "cut", "doubtful", "inline", "links", "main", "named", "parent", "points", "size", "tag")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.children: list[Node | str] = []
        self.cut, self.inline, self.main = tag in CUT, tag in INLINE, tag in ("article", "main")
        self.doubtful = self.named = False
        self.points = 0.0
        self.size = self.links = 0


def _judge(words: list[str]) -> str:
    """What one class or id says by its last word, or by the others if that says nothing: cut, named (boilerplate), doubtful, content or nothing."""
    last, rest = words[-1], set(words)
    if last in UNLESS or not rest & (ALWAYS | CONTENT) and rest & UNLESS:
        return "cut"
    if last in ALWAYS:
        return "named"
    if rest & ALWAYS or last in CONTENT and rest & UNLESS:
        return "doubtful"
    return "content" if rest & CONTENT else ""


def _describe(node: Node, attributes: str) -> None:
    """Marks a node as boilerplate or as the main element by its attributes."""
    said: set[str] = set()
    inline = False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            for one in re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", m[2] or m[3] or m[4] or "").lower().split():
                own = re.findall(r"[a-z]+", one)
                own = own[: next((i for i, w in enumerate(own) if w in HAVING), None)]
                if own:
                    said.add(_judge(own))
                    inline |= own[-1] in ALWAYS_INLINE
        elif name == "role":
            node.cut |= value.strip() in ROLES
            node.main |= value.strip() == "main"
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            node.cut = True
        elif name == "itemprop":
            node.main |= value == "articlebody"
    if node.inline:
        node.cut |= inline and "content" not in said
    elif "content" not in said:
        node.cut |= "cut" in said
        node.doubtful, node.named = bool(said & {"named", "doubtful"}) and not node.main, "named" in said
    else:  # beside a name of content, the score decides on one of boilerplate
        node.doubtful = bool(said & {"cut", "named", "doubtful"}) and not node.main


def parse(page: str) -> Node:
    """The tree of a page. Nothing in the page is an error: unknown ends are passed over and open elements end with the page."""
    root = Node("html", None)
    stack = [root]
    opened: dict[str, int] = {}
    # for each open scope its place in the stack, and the places of the open elements by tag between it and the next scope
    scopes: list[tuple[int, dict[str, list[int]]]] = [(0, {})]
    at = 0

    def close(n: int) -> None:
        while scopes[-1][0] >= n:
            scopes.pop()
        left = scopes[-1][1]
        for i in range(len(stack) - 1, n - 1, -1):
            opened[stack[i].tag] -= 1
            if (places := left.get(stack[i].tag)) and places[-1] == i:
                places.pop()
        del stack[n:]

    for m in iter(lambda: _TAG.search(page, at), None):
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in INLINE or tag == "p":  # open inside the last scope or not at all
                if places := scopes[-1][1].get(tag):
                    close(places[-1])
            elif opened.get(tag):
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                close(i)
            continue
        if tag == "html" or tag == "body" and opened.get("body"):
            continue
        if shut := CLOSES.get(tag):
            last = 0
            for scope, places in reversed(scopes):
                last = min((places[t][0] for t in shut if places.get(t)), default=last)
                if scope == 0 or stack[scope].tag not in shut:
                    break
                last = scope
            if last:
                close(last)
        node = Node(tag, stack[-1])
        stack[-1].children.append(node)
        attributes = m[3]
        if attributes and tag != "body":
            _describe(node, attributes)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not (tag == "a" and _PLACE.fullmatch(attributes)):
            if tag in SCOPES:
                scopes.append((len(stack), {}))
            else:
                scopes[-1][1].setdefault(tag, []).append(len(stack))
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1
        if at >= len(page):
            break
    if at < len(page):
        stack[-1].children.append(page[at:])
    return root


def _walk(root: Node) -> Iterator[tuple[Node, bool]]:
    """Nodes that are not cut, each before (True) and after (False) what is in it."""
    stack: list[tuple[Node, bool]] = [(root, True)]
    while stack:
        node, first = stack.pop()
        yield node, first
        if first:
            stack.append((node, False))
            stack.extend((c, True) for c in reversed(node.children) if isinstance(c, Node) and not c.cut)


def _own_texts(root: Node) -> Iterator[tuple[Node, bool, str, str]]:
    """The nodes of ``_walk``; where a block ends, with its own text and that outside links, white space turned into one space.

    A piece of text belongs to the nearest block around it and is looked at once.
    """
    held: list[tuple[list[str], list[str]]] = []
    links = 0
    stack: list[tuple[Node | str, bool]] = [(root, True)]
    while stack:
        x, first = stack.pop()
        if isinstance(x, str):
            held[-1][0].append(x)
            if not links:
                held[-1][1].append(x)
            continue
        if first:
            yield x, True, "", ""
            if not x.inline:
                if held:
                    held[-1][0].append(" ")
                    held[-1][1].append(" ")
                held.append(([], []))
            links += x.tag == "a"
            stack.append((x, False))
            for c in reversed(x.children):
                if isinstance(c, str) or not c.cut:
                    stack.append((c, True))
                elif held:
                    stack.append((" ", True))
            continue
        links -= x.tag == "a"
        both = held.pop() if not x.inline else ([], [])
        yield x, False, *(" ".join("".join(parts).split()) for parts in both)


def _settle(root: Node) -> dict[int, float]:
    """Cuts the elements that words of ALWAYS name, except where one holds most of the page's paragraph points: the score decides on it.

    Inside a marked article it must hold nearly all, because the score takes a marked article whole; all, if its name
    ends in a word of boilerplate. Points are those of blocks of 25 characters or more, links not counted; returns them
    by node.
    """
    doubtful: list[tuple[Node, Node | None]] = []  # with the marked article around it
    mains: list[Node] = []
    held: dict[int, float] = {}
    clean: dict[int, float] = {}
    for node, first, _, text in _own_texts(root):
        if first:
            if node.doubtful:
                doubtful.append((node, mains[-1] if mains else None))
            if node.main:
                mains.append(node)
            continue
        if node.main:
            mains.pop()
        own = _points(text) if len(text) >= 25 else 0.0
        inside = [c for c in node.children if isinstance(c, Node) and not c.cut]
        held[id(node)] = own + sum(held[id(c)] for c in inside)
        clean[id(node)] = own + sum(clean[id(c)] for c in inside if not c.doubtful)
    for node, article in doubtful:
        most = held[id(node)] > 0.5 * held[id(root)]
        node.cut = not most or article is not None and clean[id(article)] > (0.0 if node.named else 0.1 * held[id(node)])
    return held


def _points(own: str) -> float:
    return (1 if len(own) >= 25 else 0.2) + own.count(",") + min(len(own) / 100, 3)


def _score(root: Node) -> list[Node]:
    """Sums sizes and links, cuts lists of links (in a marked article those of links alone), gives points; returns the containers that got some and are not inside a cut element."""
    scored: dict[int, Node] = {}
    anchors: dict[int, int] = {}
    mains = 0
    for node, first, own, _ in _own_texts(root):
        mains += node.main if first else -node.main
        if first:
            continue
        node.size = sum(len(c.strip()) if isinstance(c, str) else 0 if c.cut else c.size for c in node.children)
        node.links = node.size if node.tag == "a" else sum(c.links for c in node.children if isinstance(c, Node) and not c.cut)
        n_links = anchors[id(node)] = (node.tag == "a") + sum(anchors.get(id(c), 0) for c in node.children if isinstance(c, Node) and not c.cut)
        if node.tag in LISTS and n_links >= 3 and node.links > (0.95 if mains else 0.7) * node.size:
            node.cut = True
            continue
        if own:
            points = _points(own)
            up = node.parent if node.tag in PARAGRAPHS and node.parent else node
            level = 1
            while up is not None and level <= REACH:
                up.points += points / (1 if level == 1 else 2 if level == 2 else 3 * (level - 1))
                scored[id(up)] = up
                up, level = up.parent, level + 1
    live = {id(node) for node, _ in _walk(root)} if not root.cut else set()
    return [c for c in scored.values() if id(c) in live]


def _density(node: Node) -> float:
    return node.links / node.size if node.size else 0.0


def _whole_article(around: list[Node], held: dict[int, float]) -> Node:
    """Of marked elements inside each other the nearest, unless an outer one holds more of the same text.

    That is an article around a marked part of it, an article with a fifth as
    much text outside the inner one, and a main element with other articles of
    a fifth as much.
    """
    chosen = around[0]
    for outer in around[1:]:
        own = held.get(id(chosen), 0.0)
        if outer.tag == "article":
            more = chosen.tag != "article" or held.get(id(outer), 0.0) - own >= 0.2 * own
        else:
            more = sum(held.get(id(x), 0.0) for x in _articles(outer) if x is not chosen) >= max(0.2 * own, 1.0)
        if more:
            chosen = outer
    return chosen


def _articles(node: Node) -> Iterator[Node]:
    """The outermost articles in a node."""
    stack = [c for c in node.children if isinstance(c, Node)]
    while stack:
        x = stack.pop()
        if x.cut:
            continue
        if x.tag == "article":
            yield x
        else:
            stack.extend(c for c in x.children if isinstance(c, Node))


def _chosen(root: Node) -> list[Node]:
    """The best container and the siblings kept, in page order."""
    held = _settle(root)
    containers = _score(root)
    if not containers:
        return [root]
    value = {id(c): c.points * (1 - _density(c)) for c in containers}
    best = max(containers, key=lambda c: value[id(c)])
    around: list[Node] = []  # marked elements around the best container, the nearest first
    up: Node | None = best
    while up is not None:
        if up.main:
            around.append(up)
        up = up.parent
    if around:  # a marked article is the whole of it, whichever section of it is best
        return [_whole_article(around, held)]
    # an article or main element that holds all but a little of the points is the container, too
    marked = [c for c in containers if c.main and value[id(c)] >= 0.5 * value[id(best)]]
    if len(marked) == 1:
        return marked
    if best.parent is None or best.tag == "body":
        return [best]
    kept = []
    least = 0.2 * value[id(best)]
    for x in best.parent.children:
        if not isinstance(x, Node) or x.cut:
            continue
        text = x.size > 0 and _density(x) < 0.25
        if x is best or x.tag in HEADINGS or x.points * (1 - _density(x)) >= least or text and x.tag in PARAGRAPHS:
            kept.append(x)
    return kept


def blocks(node: Node) -> Iterator[str]:
    """The text blocks of a node in page order, character references decoded, white space turned into one space."""
    parts: list[str] = []
    stack: list[Node | str | None] = [node]  # None: the end of a block
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(html.unescape(x) if "&" in x else x)
        elif x is None or not x.cut:
            if x is not None and x.tag == "br":
                parts.append(" ")
            elif x is None or not x.inline:
                if parts and (text := " ".join("".join(parts).split())):
                    yield text
                parts = []
            if x is not None:
                if not x.inline and x.tag != "br":
                    stack.append(None)
                stack.extend(reversed(x.children))
    if parts and (text := " ".join("".join(parts).split())):
        yield text


def main_text(page: str) -> str:
    """The main text of a page, blocks joined by one space; empty if there is none."""
    if not page or not page.strip():
        return ""
    return " ".join(b for node in _chosen(parse(page)) for b in blocks(node))


def _extract(rows: Iterator[tuple]) -> Iterator[tuple]:
    for page_id, url, page in rows:
        text = main_text(page or "")
        yield page_id, url, text, len(text)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars (code points).

    Null and empty htmls have an empty text; pages that are cut off or badly
    nested are read as far as they go; text without markup is one block; null
    ids and urls and repeated rows are kept row by row; long pages are read
    whole; an empty table gives no rows; other columns are not read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_rows(rows, _extract, EXTRACTED)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
