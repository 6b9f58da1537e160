"""Main-text extraction from HTML by composite text density.

Every block-level node of the page's tree gets its characters C, tags T, link characters LC and link tags
LT. Its density is C/T, adjusted by a logarithm of (C/LC)(T/LT) whose base grows with the share of linked
text. The densities of a node's children are summed; the node with the largest sum holds the article.
The outermost article or main around it is taken whole. Beside the path from there to body, headings,
paragraphs, lists, tables and sections belong to it, direct text as well, and other nodes of at least the
smallest C/T on the path; none of them if over a third of its text is linked.

What its tag or role says is navigation, footer, sidebar, notice, advert, control, script or style takes
no part, nor does what is hidden. A form takes part only if it holds over half of the page's text without links, with an
article, main, first heading or mostly paragraphs; a header if it holds a heading of an article or main. Where the
densest node stands apart from the page's first heading, the container of that heading is the article, unless the
other has over HEADED times its text. A class or id that says so, or names reader comments, is believed unless
the node holds the page's text: over half of all text without links, and for a name that is a whole token, a
first heading, article or main as well; for part of a token (site-nav), an article or main alone is enough.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|template|noscript|iframe|svg|math)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>|<[!?][^>]*>", re.S | re.I)
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE_TAGS = frozenset("nav footer aside button select option menu dialog search head".split())
#: These are noise unless they hold the page's text, or, a header, an article's heading.
WRAPPER_TAGS = frozenset("form fieldset".split())
HEADINGS = frozenset("h1 h2 hgroup".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
NOISE_NAMES = re.compile(
    r"nav\w*|menus?|header|masthead|footer|foot|side-?bar|aside|ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|share|sharing|social|related|recommend\w*|breadcrumbs?|pagination|pager|newsletter|subscribe|signup|login|form|widgets?|toolbar|skip-?link|copyright",
    re.I,
)
COMMENT_NAMES = re.compile(r"comments?|comment-?list|respond|replies|disqus|discussion|threads?|(?:user|customer|reader)?-?reviews", re.I)
#: A token that begins so tells what a node has, not what it is.
MODIFIERS = frozenset("with has no without is not show hide".split())
#: Names found as parts of a token and as whole tokens.
PART, WHOLE = 1, 2
#: Of a form around text, and of a header: see `_believe`.
WRAPPER, HEADER = 3, 4
#: What the start of a tag closes, besides an open paragraph.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Beside the path, these belong to the article unless links fill them.
HEADED = 5
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 hgroup p ul ol dl table blockquote pre figure section".split())
SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Node:
    tag: str
    parent: Node | None
    noise: bool
    named: int = 0
    children: list[Node] = field(default_factory=list)
    first: int = 0  # its blocks are first..last of the page's
    last: int = 0
    chars: int = 0
    tags: int = 0
    link_chars: int = 0
    link_tags: int = 0
    density: float = 0.0
    total: float = 0.0
    own_chars: int = 0  # of text that stands directly in it
    own_link_chars: int = 0


def _noise(tag: str, attrs: str) -> bool:
    """Whether a tag, role or attribute rules the node out."""
    if tag in NOISE_TAGS:
        return True
    if not attrs or tag in ("html", "body"):
        return False
    for name, a, b, c in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), (a or b or c).strip().lower()
        if name == "role" and value in NOISE_ROLES or name == "aria-hidden" and value == "true" or name == "hidden":
            return True
        if name == "style" and HIDDEN_STYLE.search(value):
            return True
    return "hidden" in ATTRIBUTE.sub(" ", attrs).lower().split()


def _named(tag: str, attrs: str) -> int:
    """PART or WHOLE if class or id name noise, WRAPPER or HEADER for such tags, else 0."""
    found = WRAPPER if tag in WRAPPER_TAGS else HEADER if tag == "header" else 0
    if not attrs or tag in ("html", "body", "main") or found:
        return found
    for name, a, b, c in ATTRIBUTE.findall(attrs):
        if name.lower() in ("class", "id"):
            for token in (a or b or c).split():
                if COMMENT_NAMES.fullmatch(token):
                    return WHOLE
                parts = re.split("[-_]", token)
                if tag == "article" or parts[0].lower() in MODIFIERS:
                    continue
                if NOISE_NAMES.fullmatch(token) or any(map(COMMENT_NAMES.fullmatch, (parts[0], parts[-1]))):
                    return WHOLE
                if any(map(NOISE_NAMES.fullmatch, parts)):
                    found = PART
    return found


def parse(page: str) -> tuple[Node, list[str]]:
    """The tree of block-level nodes, and the page's text blocks in order; what tags, roles and attributes rule out has neither."""
    root = Node("html", None, False)
    node, blocks, parts, links, muted = root, [], [], [], 0
    open_inline: list[tuple[str, bool, Node]] = []

    def end_block() -> None:
        text = SPACE.sub(" ", "".join(parts)).strip()
        parts.clear()
        if text:
            blocks.append(text)
            node.chars += len(text)
        link = sum(map(len, links))
        node.link_chars += min(link, len(text))
        links.clear()

    def close() -> None:
        nonlocal node, muted
        end_block()
        node.last = len(blocks)
        muted -= node.noise
        while open_inline and open_inline[-1][2] is node:
            muted -= open_inline.pop()[1]
        node = node.parent or root

    def text(raw: str) -> None:
        if not muted:
            found = entities.unescape(raw) if "&" in raw else raw
            parts.append(found)
            if any(tag == "a" for tag, _, _ in open_inline):
                links.append(SPACE.sub(" ", found).strip())

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = m[3] and m[3].lower()
        if not tag:
            continue
        if m[2]:
            if tag in BLOCKS:
                up = node
                while up is not root and up.tag != tag:
                    up = up.parent
                if up is not root:
                    while node is not up:
                        close()
                    close()
            else:
                for k in range(len(open_inline) - 1, -1, -1):
                    if open_inline[k][2] is not node:
                        break
                    if open_inline[k][0] == tag:
                        muted -= open_inline.pop(k)[1]
                        break
        elif tag in BLOCKS:
            if node.tag == "p":
                close()
            shut = CLOSES.get(tag)
            if shut:
                while node.tag in shut:
                    close()
            end_block()
            if tag == "html":
                continue
            if tag == "hr":
                continue
            child = Node(tag, node, _noise(tag, m[4]), _named(tag, m[4]), first=len(blocks))
            if not muted:
                node.children.append(child)
            node = child
            node.tags += not muted
            muted += child.noise
        else:
            if not muted:
                node.tags += 1
                node.link_tags += tag == "a"
            if tag == "br" or tag == "img":
                if not muted:
                    parts.append(" ")
            elif tag not in VOID and not m[4].endswith("/"):
                hidden = _noise(tag, m[4]) or _named(tag, m[4]) == WHOLE
                muted += hidden
                open_inline.append((tag, hidden, node))
    if at < len(page):
        text(page[at:])
    while node is not root:
        close()
    end_block()
    root.last = len(blocks)
    return root, blocks


def _believe(root: Node) -> None:
    """Makes noise of the nodes that are named so, but for those that hold the page's text."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += x.children
    free, holds, heads, told, titled = {}, {}, {}, {}, {}
    for x in reversed(order):
        free[id(x)] = x.chars - x.link_chars + sum(free[id(c)] for c in x.children)
        told[id(x)] = free[id(x)] if x.tag == "p" else sum(told[id(c)] for c in x.children)
        titled[id(x)] = x.tag in HEADINGS or any(titled[id(c)] for c in x.children)
        holds[id(x)] = x.tag in ("article", "main") or any(holds[id(c)] for c in x.children)
        heads[id(x)] = x.tag == "h1" or any(heads[id(c)] for c in x.children)
    for x in order:
        most = free[id(x)] * 2 > free[id(root)]
        if x.named == WHOLE:
            x.noise = x.noise or not (most and (holds[id(x)] or heads[id(x)]))
        elif x.named == PART:
            x.noise = x.noise or not (most or holds[id(x)])
        elif x.named == WRAPPER:
            x.noise = x.noise or not (most and (holds[id(x)] or heads[id(x)] or told[id(x)] * 2 > free[id(x)]))
        elif x.named == HEADER:
            x.noise = x.noise or not (titled[id(x)] and _inside(x, ("article", "main")))


def _inside(x: Node, tags: tuple[str, ...]) -> bool:
    while x.parent is not None:
        x = x.parent
        if x.tag in tags:
            return True
    return False


def _of_heading(body: Node, best: Node) -> Node:
    """The container of the page's first h1 if `best` is apart from it and has no more than HEADED times its text without links, else `best`.

    The container is the lowest node around the heading with as much text besides.
    """
    stack, head = [body], None
    while stack and head is None:
        x = stack.pop()
        head = x if x.tag == "h1" and x.chars else None
        stack += [c for c in reversed(x.children) if not c.noise]
    x = head
    while x is not None and x is not body:
        if x.chars - x.link_chars >= 2 * head.chars and x is not head:
            break
        x = x.parent
    if x is None or x is body or x.first <= best.first and best.last <= x.last or best.first <= x.first and x.last <= best.last:
        return best
    return x if (x.chars - x.link_chars) * HEADED >= best.chars - best.link_chars else best


def _measure(root: Node) -> Node:
    """Sums counts from below, sets densities and their sums, and returns body (or the root)."""
    order, stack, body = [], [root], root
    while stack:
        x = stack.pop()
        order.append(x)
        body = x if x.tag == "body" and body is root else body
        stack += [c for c in x.children if not c.noise]
    for x in reversed(order):
        x.own_chars, x.own_link_chars = x.chars, x.link_chars
        for c in x.children:
            if not c.noise:
                x.chars += c.chars
                x.tags += c.tags
                x.link_chars += c.link_chars
                x.link_tags += c.link_tags
    whole_c, whole_l = max(1, body.chars), body.link_chars
    for x in reversed(order):
        c, t, lc, lt = x.chars, max(1, x.tags), max(1, x.link_chars), max(1, x.link_tags)
        if c:
            base = math.log(c / max(1, c - x.link_chars) * x.link_chars + whole_l / whole_c * c + math.e)
            x.density = c / t * math.log(max(1.0, c / lc * t / lt) + 1e-9) / math.log(base + 1e-9) if base > 1 + 1e-6 else c / t * math.log(max(1.0, c / lc * t / lt) + 1e-9)
        x.total = sum(k.density for k in x.children if not k.noise) or x.density * 1e-3
    return body


def main_text(page: str | None) -> str:
    """The article's blocks, each with white space collapsed, joined by line feeds; empty if there is none."""
    if not page or not page.strip():
        return ""
    root, blocks = parse(page)
    if not blocks:
        return ""
    _believe(root)
    body = _measure(root)
    best, stack = body, [body]
    while stack:
        x = stack.pop()
        if x.total > best.total or x.total == best.total and x.chars > best.chars:
            best = x
        stack += [c for c in reversed(x.children) if not c.noise]
    path = [_of_heading(body, best)]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    outermost = max((i for i, x in enumerate(path) if x.tag in ("article", "main")), default=0)
    path = path[outermost:]
    # characters a tag do not grow with a node's size, as its density does
    threshold = min(x.chars / max(1, x.tags) for x in path)
    spans = [(path[0].first, path[0].last)]
    for below, x in zip(path, path[1:], strict=False):
        if x.own_link_chars * 3 <= x.own_chars:
            at = x.first
            for c in sorted(x.children, key=lambda c: c.first):
                spans.append((at, c.first))
                at = max(at, c.last)
            spans.append((at, x.last))
        spans += [(c.first, c.last) for c in x.children if c is not below and not c.noise and (c.tag in TEXTUAL or c.chars / max(1, c.tags) >= threshold) and c.link_chars * 3 <= c.chars]
    dropped, stack = set(), [root]
    while stack:
        x = stack.pop()
        if x.noise:
            dropped.update(range(x.first, x.last))
        else:
            stack += x.children
    return "\n".join(blocks[i] for first, last in sorted(spans) for i in range(first, last) if i not in dropped)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """`pages` with the column `text`, which replaces any of that name.

    Null, empty and textless pages give the empty string. Rows are independent: repeated rows, ties and
    nulls elsewhere pass through.
    """

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages_ in batches:
            yield pages_.map(main_text, na_action=None)

    return pages.withColumn("text", of(F.col(html_col)))
