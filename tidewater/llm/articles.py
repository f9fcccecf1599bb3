"""The main text of a web page by composite text density.

A tolerant reader turns the page into a tree. Menus, forms, scripts and other
parts that are no article by their tag, role, class or id are cut first; by role,
class or id none that the article lies in. For each node the density is its characters per tag, lowered by the share that stands in
links; a node's density sum adds up its children. The subtree of largest sum is
the article; the least density on its path from the body is the threshold that
blocks beside the path must reach to be taken along.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

# Tags by what they mean in HTML.
RAW = frozenset(["script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"])
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
DROPPED = frozenset(["script", "style", "noscript", "template", "iframe", "noembed", "noframes", "xmp", "head", "title", "nav", "footer", "aside", "button", "select", "option", "textarea", "input", "dialog", "menu", "svg", "canvas", "audio", "video", "object", "embed"])
INLINE = frozenset(["a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"])
CLOSES_P = frozenset(["address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"])
SECTIONS = frozenset(["html", "body", "main", "article", "section", "nav", "aside", "header", "footer", "div", "form", "table", "ul", "ol", "td"])
SIBLING = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
#: Cut as a marked part is, for some pages lie in one form as a whole.
WRAPPING = frozenset(["form"])
SAYING = frozenset(["p", "h1", "h2", "h3", "blockquote", "pre"])
PARAGRAPHS = frozenset(["p", "blockquote", "pre"])
#: Unlinked characters in paragraphs that make an article of what stands beside its readers' comments.
ENOUGH = 80
#: Words of class, id or role, between separators, that mark parts which are no article.
MARKS = re.compile(r"(?i)(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|popup|modal|overlay|sidebar|side-bar|menu\w*|nav|navbar|navigation|breadcrumbs?|footer|masthead|site-header|page-header|comments?|commentlist|disqus|respond|reply|replies|related|recommended|share|sharing|social|subscribe|newsletter|signup|login|search|skip|toolbar|widget|pagination|pager|complementary|contentinfo|alert)(?:$|[\s_-])")
#: Names that as a whole say that a part is what readers wrote.
TALK = re.compile(r"(?i)comments?(?:[-_](?:list|section|area|thread|wrapper))?|commentlist|disqus(?:[-_]thread)?|respond|reply|replies")
MODIFIER = re.compile(r"(?i)(?:has|have|no|not|with|without)[-_]")
TAG_SIGN = re.compile(r"[>\"']")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"(?i)\b(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")


class Node:
    __slots__ = ("tag", "up", "items", "cut", "chars", "tags", "link_chars", "link_tags", "density", "total", "marked", "talk", "holds", "plain", "told", "depth", "block", "said")

    def __init__(self, tag: str, up: Node | None, cut: bool = False, marked: bool = False, talk: bool = False):
        self.tag, self.up, self.items, self.cut, self.marked, self.talk = tag, up, [], cut, marked, talk
        self.depth = up.depth + 1 if up else 0
        #: The nearest node around that is not inline, or this one.
        self.block = up.block if up and tag in INLINE else self


def _cut(tag: str, rest: str, in_article: bool) -> bool:
    """Whether a part is no article by its tag or is hidden."""
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if tag in ("html", "body", "article", "main") or not rest:
        return False
    for name, *values in ATTRIBUTE.findall(rest):
        value = next((v for v in values if v), "")
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _marked(tag: str, rest: str) -> bool:
    """Whether class, id or role say that a part is no article; names like has-sidebar say nothing of the part itself."""
    if tag in WRAPPING:
        return True
    if tag in ("html", "body", "article", "main") or not rest:
        return False
    for name, *values in ATTRIBUTE.findall(rest):
        if name.lower() in ("class", "id", "role") and any(MARKS.search(x) and not MODIFIER.match(x) for x in next((v for v in values if v), "").split()):
            return True
    return False


def _talk(rest: str) -> bool:
    return any(name.lower() in ("class", "id") and any(TALK.fullmatch(x) for x in next((v for v in values if v), "").split()) for name, *values in ATTRIBUTE.findall(rest))


def _carries(part: Node, article: Node) -> bool:
    """Whether a marked part of an article holds most of its unlinked characters; readers' comments don't count where paragraphs stand beside them."""
    return 2 * part.plain > article.plain and not (part.talk and article.told - part.told >= ENOUGH)


def _cut_marked(root: Node) -> None:
    """Cuts marked parts, but none that holds an article or main if none stands outside, none that carries the article it lies in, and, on a page without, none with most of its unlinked characters (a form only if they stand in paragraphs or headings)."""
    order, stack = [], [(root, False, False)]
    while stack:
        node, linked, told = stack.pop()
        linked, told = linked or node.tag == "a", told or node.tag in PARAGRAPHS
        order.append(node)
        node.holds = node.tag in ("article", "main")
        node.plain = 0 if linked else sum(len("".join(x.split())) for x in node.items if isinstance(x, str))
        node.told = node.plain if told else 0
        stack += [(x, linked, told) for x in node.items if isinstance(x, Node) and not x.cut]
    for node in reversed(order):
        for x in node.items:
            if isinstance(x, Node) and not x.cut:
                node.holds = node.holds or x.holds
                node.plain += x.plain
                node.told += x.told
        node.said = node.tag in SAYING and node.plain > 0 or any(x.said for x in node.items if isinstance(x, Node) and not x.cut)
    named, stack = False, [(root, None)]
    while stack:
        # What no mark surrounds, and the outermost marked parts; then on within those that are kept.
        outer = []
        while stack:
            node, article = stack.pop()
            if node.marked:
                outer.append((node, article))
                continue
            if node.tag in ("article", "main"):
                named, article = True, node
            stack += [(x, article) for x in node.items if isinstance(x, Node) and not x.cut]
        for x, article in outer:
            if article is not None:
                kept = _carries(x, article)
            elif named:
                kept = False
            else:
                kept = x.holds if root.holds else 2 * x.plain > root.plain and (x.said or x.tag not in WRAPPING)
            if kept:
                x.marked = False
                stack.append((x, article))
            else:
                x.cut = True


def _tag_end(page: str, at: int, unclosed: set) -> int:
    """The place behind a tag from a place within it. A quote opens a value only after `=`, and only if it is closed somewhere."""
    while True:
        found = TAG_SIGN.search(page, at)
        if not found:
            return len(page)
        at, sign = found.end(), found.group()
        if sign == ">":
            return at
        before = found.start() - 1
        while page[before].isspace():
            before -= 1
        if page[before] == "=" and sign not in unclosed:
            close = page.find(sign, at)
            if close < 0:
                unclosed.add(sign)
            else:
                at = close + 1


class Tree:
    """The nodes of a page as its tags come. What is open is kept by tag, so no tag makes the whole path be walked."""

    def __init__(self):
        self.root = self.node = Node("#root", None)
        self.open: dict[str, list[Node]] = {}

    def nearest(self, tags) -> Node | None:
        """The innermost open node of some tags."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), key=lambda x: x.depth, default=None)

    def enter(self, child: Node) -> None:
        self.open.setdefault(child.tag, []).append(child)
        self.node = child

    def leave(self, up: Node) -> None:
        """Closes all down to and with `up`."""
        while self.node is not up:
            self.open[self.node.tag].pop()
            self.node = self.node.up
        self.open[up.tag].pop()
        self.node = up.up

    def begin(self, name: str) -> None:
        """Closes what a start tag closes."""
        block = self.node.block
        if name in CLOSES_P and block.tag == "p":
            self.leave(block)
        if name in SIBLING:
            closes, stop = SIBLING[name]
            up = self.nearest([*closes.split(), *stop])
            while up is not None and up.tag in closes.split():
                self.leave(up)
                up = self.node
            # Of a part that stands in another kind of part, as a cell of a row, only the former is closed.

    def end(self, name: str) -> None:
        up = self.nearest([name])
        if up is not None and name in INLINE:
            # An end tag of inline kind does not close the section around it.
            section = self.nearest(SECTIONS)
            if section is not None and section.depth > up.depth:
                return
        if up is not None:
            self.leave(up)


def parse(page: str) -> Node:
    """The tree of a page, in time in proportion to it. Unclosed and stray tags are mended; a tag cut off by the end of the page is no text."""
    tree = Tree()
    at, size, unclosed = 0, len(page), set()
    while at < size:
        begin = page.find("<", at)
        while 0 <= begin and not (page[begin + 1 : begin + 2] in ("!", "?", "/") or page[begin + 1 : begin + 2].isascii() and page[begin + 1 : begin + 2].isalpha()):
            begin = page.find("<", begin + 1)
        if begin < 0:
            tree.node.items.append(page[at:])
            break
        if begin > at:
            tree.node.items.append(page[at:begin])
        if page.startswith("<!--", begin):
            at = page.find("-->", begin + 4) + 3
            at = at if at > 2 else size
            continue
        if page.startswith("<![CDATA[", begin):
            at = page.find("]]>", begin + 9)
            at = at if at >= 0 else size
            tree.node.items.append(page[begin + 9 : at])
            at += 3
            continue
        closing = page[begin + 1] == "/"
        found = NAME.match(page, begin + 1 + closing)
        if not found:
            at = page.find(">", begin) + 1 or size
            continue
        name, at = found.group().lower(), _tag_end(page, found.end(), unclosed)
        if closing:
            if name == "br":
                tree.node.items.append(Node("br", tree.node))
            else:
                tree.end(name)
            continue
        tree.begin(name)
        rest = page[found.end() : at]
        marked = _marked(name, rest)
        child = Node(name, tree.node, _cut(name, rest, bool(tree.open.get("article"))), marked, marked and _talk(rest))
        tree.node.items.append(child)
        if name in RAW:
            end = re.compile(rf"(?i)</{name}[\s/>]").search(page, at)
            child.items.append(page[at : end.start() if end else size])
            at = page.find(">", end.start()) + 1 or size if end else size
        elif name not in VOID and not rest.endswith("/>"):
            tree.enter(child)
    _cut_marked(tree.root)
    return tree.root


def _measure(root: Node) -> Node:
    """Characters, tags and density of every node that is not cut, children first; the body."""
    order, body, stack = [], None, [root]
    while stack:
        node = stack.pop()
        order.append(node)
        if node.tag == "body" and body is None:
            body = node
        stack += [x for x in node.items if isinstance(x, Node) and not x.cut]
    for node in reversed(order):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for x in node.items:
            if isinstance(x, str):
                node.chars += len("".join(x.split()))
            elif not x.cut:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags + (x.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    body = body or root
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in order:
        c, t, lc, lt = node.chars, node.tags or 1, node.link_chars, node.link_tags or 1
        # The logarithm's base grows with the links in the node and on the page; without any link it is 1, and plain density holds.
        base = math.log(math.log(c / max(1, c - lc) * lc + share * c + math.e))
        node.density = c / t * max(0.0, math.log(max(1.0, c / max(1, lc) * t / lt))) / base if base > 1e-9 else c / t
    for node in order:
        node.total = sum(x.density for x in node.items if isinstance(x, Node) and not x.cut) or node.density
    return body


def _select(body: Node) -> list[Node]:
    """The article's subtrees in page order."""
    best, stack = body, [body]
    while stack:
        node = stack.pop()
        if (node.total, node.chars) > (best.total, best.chars):
            best = node
        stack += [x for x in reversed(node.items) if isinstance(x, Node) and not x.cut]
    articles, stack = [], [body]
    while stack:  # a page that says what its article is needs no guess about where it ends
        node = stack.pop()
        if node.tag == "article":
            articles.append(node)
        else:
            stack += [x for x in reversed(node.items) if isinstance(x, Node) and not x.cut]
    around = next((a for a in articles if _holds(a, best)), None)
    if around is not None:
        return [around]
    path, up = [], best
    while up is not None and up is not body.up:
        path.append(up)
        up = up.up
    threshold = min((x.density for x in path if x.density > 0), default=0.0)
    # A block's own parts belong together: go up from inline and paragraph nodes to what holds them.
    while best.up is not None and best is not body and (best.tag in INLINE or best.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote")):
        best = best.up
    if best is body or best.up is None:
        return [best]
    return [x for x in best.up.items if isinstance(x, Node) and not x.cut and (x is best or x.density >= threshold and x.tag not in INLINE and not x.link_chars * 2 > x.chars)]


def _holds(node: Node, inner: Node | None) -> bool:
    while inner is not None:
        if inner is node:
            return True
        inner = inner.up
    return False


def main_text(page: str | None) -> str:
    """Text of the article: references decoded, white space one space, blocks joined by one space. Empty for none."""
    if not page:
        return ""
    out: list[str] = []
    for top in _select(_measure(parse(page))):
        stack: list = [top]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif not x.cut:
                edge = "" if x.tag in INLINE else " "
                stack.append(edge)
                stack += reversed(x.items)
                out.append(edge)
    text = "".join(out)
    return " ".join((html.unescape(text) if "&" in text else text).split())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages.

    A null or empty page, and one without an article, has the empty text. Pages
    are read whole and one by one, so memory follows the longest page and time the
    characters read; nesting is never recursed into. Repeated rows give repeated rows; extra columns are ignored.
    """

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
