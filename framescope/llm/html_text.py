"""Main text of web pages by tree scoring.

A page is read into a small element tree that tolerates unclosed and misnested tags. Every paragraph
passes points for its length and commas to its ancestors (all to the parent, less to each one above),
and an element's sum is discounted by its link density. The best container and those of its siblings
that are not mostly links are kept, without what tag, role, class or id marks as menu, header, footer,
sidebar, notice, advert, form or reader comment; scripts, styles and comments never enter the tree.
Where an `article` or `main` element holds the best container it is kept whole, and a sibling of it
only if it scores like content. Should the marks leave nothing of a page that has text, those of class
and id are passed over.

Two kinds of marks are weighed by what the element holds, once the page is read. A form (or fieldset, or
label) that wraps the page's text is no form in this sense: it stays if it holds an article, a main
element or an h1, or most of the page's text in real paragraphs; its controls go. A word that also names
contents (social, menu, navigation: "social-sciences", "lunch-menu") marks boilerplate as a whole name or beside its usual
companions; in another compound only if most of the element's text is links. Headings are never headers.

Blocks are joined in page order by one space; character references are decoded and white space
becomes one space. Null or empty html, or a page without text: the empty string. Ties between
containers: the outer, then the earlier. Repeated rows and rows of null page_id or url give rows of
their own; extra columns are ignored; an empty table gives an empty result. Each page is handled whole
by one task in time about linear in its length, however deep it nests; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict, deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)""",
    re.S,
)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
# Element classes of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe noframes xmp svg object select annotation annotation-xml".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - frozenset("body html option caption tbody td tfoot th thead tr".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
_SCOPE = {"li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",))}
_BOUND = frozenset(("table", "td", "th", "html", "body", "button", "caption"))
_DROP_TAG = frozenset("head nav footer aside button dialog menu".split())
_WRAPPERS = frozenset("form fieldset label".split())
_INSIDE = ("article", "main", "h1")  # what a form wraps only if it wraps the page
_PROSE = 140  # characters of paragraphs without links that make a form's text prose
_DROP_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# Parts of class and id names: those that mark boilerplate alone, and those that do so as a whole name
# or beside one of the parts given ("related-posts" is a link list, "related-work" a section).
_DROP_WORD = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion sidebar navbar breadcrumb breadcrumbs "
    "comments disqus respond replies cookie cookies consent gdpr popup newsletter subscribe signup pagination pager widget".split()
)
_BESIDE = {
    x: frozenset(y.split())
    for x, y in {
        "related": "article articles box content items links list news pages post posts reading stories topics videos",
        "recommended": "article articles box content items links list news pages post posts reading stories topics videos",
        "share": "article bar box buttons count icons links list post social this tools widget",
        "skip": "content link links main nav navigation to",
        "hidden": "visually",
        "notice": "bar banner box copyright legal privacy site top",
        "comment": "area author body box count field form item list meta reply respond section text thread",
        "header": "bar fixed global inner menu nav page site sticky top wrapper",
        "masthead": "bar global nav page site top",
        "banner": "ad bar bottom global hero image page site top",
        "topbar": "global inner nav page site",
        "overlay": "box close dark inner modal page",
        "login": "area bar box button form link",
        "toolbar": "bar bottom page site top",
        "menu": "bar box button footer global header icon inner item items left link links list main mobile nav navigation primary right secondary side site sub toggle top wrapper",
        "nav": "bar bottom box container footer global header inner item items left link links list main menu mobile next post posts prev primary right secondary side site sub tabs top wrapper",
        "navigation": "bar bottom box footer global header inner left links list main menu mobile post posts primary right secondary side site sub top wrapper",
        "footer": "bar global inner links main menu nav page post site top widgets wrapper",
        "modal": "body box content dialog inner overlay window",
        "social": "bar box buttons follow icons links list media nav network networks share sharing widget",
        "sharing": "bar box buttons icons links social tools",
    }.items()
}
# of these, other compounds are weighed by their links
_DOUBTFUL = frozenset("menu nav navigation footer modal social sharing".split())
_TITLE_WORD = frozenset("header banner masthead".split())  # words that headings carry too
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PARAGRAPH = frozenset("p pre td blockquote dd li h1 h2 h3 h4 h5 h6 div section article main figcaption body".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_COMMA = re.compile("[,،、，]")
_NEVER = frozenset(("body", "html", "article", "main"))  # tags that class and id do not drop


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "doubtful", "score")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, doubtful: bool = False):
        self.tag, self.parent, self.children, self.dropped, self.doubtful, self.score = tag, parent, [], dropped, doubtful, 0.0


def _marked(name: str, tag: str) -> bool | None:
    """Whether one class name or id marks boilerplate; None: if the element is mostly links."""
    parts = [x for x in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if x]
    if not _DROP_WORD.isdisjoint(parts):
        return True
    words = [x for x in parts if x in _BESIDE and not (tag in _HEADING and x in _TITLE_WORD)]
    if any(len(parts) == 1 or not _BESIDE[x].isdisjoint(parts) for x in words):
        return True
    return None if any(x in _DOUBTFUL for x in words) else False


def _boilerplate(tag: str, attrs: str, inside_article: bool, names: bool) -> bool | None:
    """Whether an element's tag or attributes mark boilerplate; None: that depends on what it holds."""
    if tag in _DROP_TAG or tag == "header" and not inside_article:
        return True
    doubt = None if tag in _WRAPPERS else False
    if not attrs or attrs.isspace():
        return doubt
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            return True
        if name == "role" and value.lower() in _DROP_ROLE:
            return True
        if names and name in ("class", "id") and tag not in _NEVER and not (tag == "header" and inside_article):
            marks = [_marked(x, tag) for x in value.split()]
            if True in marks:
                return True
            doubt = None if None in marks else doubt
    return doubt


class _Open:
    """The open elements, innermost last, and where each tag stands among them."""

    def __init__(self, root: Node):
        self.stack, self.at = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        self.at[node.tag].append(len(self.stack))
        self.stack.append(node)

    def pop_to(self, depth: int) -> None:
        for x in self.stack[depth:]:
            self.at[x.tag].pop()
        del self.stack[depth:]

    def last(self, tags) -> int:
        """Depth of the innermost element of these tags; 0 if there is none."""
        return max((self.at[x][-1] for x in tags if self.at[x]), default=0)

    def close(self, tags: tuple[str, ...], stop: frozenset[str]) -> None:
        depth = self.last(tags)
        if depth and depth >= self.last(stop):
            self.pop_to(depth)


def parse(html: str, names: bool = True) -> Node:
    """The element tree of a page; strings among the children are text. names: class and id count."""
    root = Node("html", None)
    open_, at, size = _Open(root), 0, len(html)
    stack = open_.stack
    while at < size:
        m = _TOKEN.search(html, at)
        if m is None:
            stack[-1].children.append(unescape(html[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(unescape(html[at : m.start()]))
        at = m.end()
        if m["cdata"] is not None:
            stack[-1].children.append(m["cdata"])
            continue
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["end"] or m["end2"]:
            if tag == "br":
                stack[-1].children.append(" ")
            else:
                open_.close((tag,), frozenset() if tag in ("html", "body", "article", "main", "table") else _BOUND - {tag})
            continue
        if tag in _RAW:
            over = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = over.end() if over else size
            continue
        if tag in ("html", "body"):
            if tag == "body":
                open_.pop_to(1)
            continue
        if tag in _VOID:
            if tag in ("br", "hr"):
                stack[-1].children.append(" " if tag == "br" else Node("hr", stack[-1]))
            continue
        if tag in _CLOSES_P:
            open_.close(("p",), _BOUND)
        if tag in _SAME:
            open_.close(_SAME[tag], _SCOPE.get(tag, frozenset()) | (frozenset(("table",)) if tag in ("tr", "td", "th") else _BOUND))
        if stack[-1].tag == "head" and tag in _BLOCK:
            open_.pop_to(1)
        attrs = m["attrs"] or m["attrs2"] or ""
        marked = _boilerplate(tag, attrs, bool(open_.at["article"] or open_.at["main"]), names)
        node = Node(tag, stack[-1], stack[-1].dropped or marked is True, marked is None)
        stack[-1].children.append(node)
        # a closing slash ends an inline element at once, but not as the end of an unquoted value
        if tag in _BLOCK or not re.search(r"(?:^|[\s\"'])/$", attrs):
            open_.push(node)
    _settle(root)
    return root


def _settle(root: Node) -> None:
    """Drop the doubtful elements that hold what their mark says: forms, and lists of links."""
    nodes = _order(root)
    if not any(x.doubtful for x in nodes):
        return
    chars, linked, prose, inside = {}, {}, {}, {}
    for x in reversed(nodes):  # children before parents
        below = [c for c in x.children if isinstance(c, Node) and not c.dropped]
        own = sum(len("".join(c.split())) for c in x.children if isinstance(c, str))
        k = id(x)
        chars[k] = own + sum(chars[id(c)] for c in below)
        linked[k] = chars[k] if x.tag == "a" else sum(linked[id(c)] for c in below)
        free = chars[k] - linked[k]
        prose[k] = free if x.tag in ("p", "li", "td", "blockquote", "pre") and free >= 40 else sum(prose[id(c)] for c in below)
        inside[k] = x.tag in _INSIDE or any(inside[id(c)] for c in below)
    whole = chars[id(root)]
    for x in nodes:
        k = id(x)
        if x.doubtful and x.tag in _WRAPPERS:
            x.dropped = not (inside[k] or 2 * chars[k] >= whole and prose[k] >= _PROSE)
        elif x.doubtful:
            x.dropped = 2 * linked[k] > chars[k]


def _order(root: Node) -> list[Node]:
    """Elements that are not boilerplate, parents first."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        if not x.dropped:
            out.append(x)
            todo += [c for c in reversed(x.children) if isinstance(c, Node)]
    return out


def _render(node: Node, into: list[str], top: bool = False) -> None:
    """Append the text of node to into, with spaces around blocks; without recursion."""
    todo: list[Node | str] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            into.append(x)
        elif not x.dropped:
            if x.tag in _BLOCK:
                into.append(" ")
                todo.append(" ")
            todo += reversed(x.children)


def main_text(html: str | None) -> str:
    if not html:
        return ""
    return _text(parse(html)) or _text(parse(html, False))


def _text(root: Node) -> str:
    nodes = _order(root)
    links: dict[int, int] = {}
    size: dict[int, int] = {}
    flow: dict[int, deque[str]] = {}
    for x in reversed(nodes):  # children before parents
        chars, linked, inline = 0, 0, deque()
        for c in x.children:
            if isinstance(c, str):
                chars += len(c) - c.count(" ") if c.isspace() else len(c)
                inline.append(c)
            elif not c.dropped:
                chars += size[id(c)]
                linked += links[id(c)]
                if c.tag not in _BLOCK:
                    inner = flow.pop(id(c))
                    if len(inner) > len(inline):  # the shorter one moves, so deep nesting stays cheap
                        inner.extendleft(reversed(inline))
                        inline = inner
                    else:
                        inline.extend(inner)
        size[id(x)], links[id(x)] = chars, chars if x.tag == "a" else linked
        flow[id(x)] = inline
    for x in nodes:
        if x.tag in _PARAGRAPH or x is root:
            text = " ".join("".join(flow[id(x)]).split())
            if not text:
                continue
            points = 1 + len(_COMMA.findall(text)) + min(len(text) / 100, 3) if len(text) >= 25 else len(text) / 50
            up, level = x if x.tag in ("div", "section", "article", "main", "body", "td", "html") else x.parent or x, 0
            while up is not None and level < 5:
                up.score += points / (1, 2, 6, 9, 12)[level]
                up, level = up.parent, level + 1
    density = lambda x: links[id(x)] / max(1, size[id(x)])
    best = max(nodes, key=lambda x: x.score * (1 - density(x)))  # ties: the outer, then the earlier
    if best.score <= 0:
        return ""
    top = best.score * (1 - density(best))
    whole, up = False, best
    while up is not None:  # a semantic container of the best one holds the whole article
        if up.tag in ("article", "main") and not up.dropped:
            best, whole = up, True
        up = up.parent

    def content(x: Node) -> bool:
        """Whether a sibling of the best container belongs to it."""
        if not whole:
            return density(x) < 0.5
        text = " ".join("".join(flow[id(x)]).split()) if x.tag == "p" else ""
        return x.score * (1 - density(x)) >= max(10.0, 0.2 * top) or bool(text) and (len(text) > 80 and density(x) < 0.25 or links[id(x)] == 0 and bool(re.search(r"\.( |$)", text)))

    out: list[str] = []
    for x in best.parent.children if best.parent is not None else [best]:
        if x is best or isinstance(x, Node) and not x.dropped and content(x):
            _render(x, out)
        elif isinstance(x, str) and not whole:
            out.append(x)
    return " ".join("".join(out).split())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string())], ["page_id", "url", "text"])

    found = pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
