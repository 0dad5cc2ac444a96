"""HTML extraction by composite text density.

A page becomes a tree of its elements. Each node's composite density is its characters per tag, adjusted for
links: nodes whose characters or tags are mostly links lose. The densities of a node's block children add up to
its density sum (inline elements without a block are part of their parent's text). The threshold is the least density on the path
from the body down to the node of the largest density sum. That node's subtree is main text, and so is that of
the largest sum below every other node that reaches the threshold, as do all nodes above it.

The densest node seldom is the whole article: titles, leads and short sections lie beside it. So the way from it up to
the body is walked once more, and what lies beside that way is taken if it is written text: headings, paragraphs, sections and the
like at every step; inside the article's frame (up to the element that holds the page's main heading) any block without
more link text than other text.

Elements that never are main text (scripts, navigation, forms, notices and the like) are cut before, by name, role or
class. A form, or an element with the class name of a page part, that holds the densest node and shows that it is a frame (it holds
the main heading, an article, or page parts of its own) is none, and stays. A header inside of an article gives its headings to it.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
CUT = frozenset("script style noscript template iframe title head nav header footer aside form button select textarea input label option menu dialog svg canvas object embed annotation annotation-xml audio video xmp noembed noframes map".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math mfrac mi mn mo mover mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split()
)
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
#: Words of class and id values (split at anything but letters, and at lower-upper) that mark what isn't main text.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion breadcrumb breadcrumbs widget cookie cookies consent notice gdpr popup modal overlay newsletter subscribe "
    "signup login share sharing social comment comments respond replies disqus pager pagination hidden copyright".split()
)
#: Words that name parts of a page, also in class names of what merely lies beside that part.
PARTS = frozenset("banner nav navbar navigation menu header masthead footer sidebar aside toolbar".split())
#: Words that mark noise alone, or with a word for what is listed (related-posts, not related-work).
LISTING = frozenset("related recommended".split())
LISTED = frozenset("article articles block box content item items link links list news page pages post posts product products reading section stories story topics video videos widget".split())
#: A name that ends in one of these is kept after a word of MAIN: an article's own header holds its title.
SOFT = frozenset("header masthead".split())
MAIN = frozenset("article main content post entry body story text".split())
#: A name that starts with one of these only tells what else the page has.
WITH = frozenset("has no with without".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMES = re.compile(r"[a-z]+|[A-Z]+[a-z]*")


class Node:
    __slots__ = ("tag", "attrs", "kids", "chars", "tags", "link_chars", "link_tags", "density", "total", "top", "block")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids = tag, attrs, []


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw.strip(" /\n\t") else {}


def is_cut(tag: str, raw: str) -> str:
    """Whether an element is cut with all below it: "" (no), "always", or "part", where it stays if it turns out to be the frame
    of the main text."""
    if tag in CUT:
        return "part" if tag == "form" else "always"
    if not raw or tag in ("html", "body"):
        return ""
    a = attributes(raw)
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")):
        return "always"
    kinds = {is_noise([x.lower() for x in _NAMES.findall(name)]) for k in ("class", "id") for name in a.get(k, "").split()}
    return "noise" if "noise" in kinds else "part" if "part" in kinds else ""


def is_noise(words: list[str]) -> str:
    """Whether a class or id of these words marks noise ("noise") or a part of the page ("part"): its first or last word does
    (comment-body, post-comments), but content-sidebar-wrap and has-sidebar don't."""
    if not words or words[0] in WITH:
        return ""
    if words[0] in NOISE or words[-1] in NOISE:
        return "noise"
    if words[0] in LISTING or words[-1] in LISTING:
        return "noise" if len(words) == 1 or words[0] not in LISTING or words[1] in LISTED else ""
    return "part" if words[0] in PARTS or words[-1] in PARTS and not (words[-1] in SOFT and not MAIN.isdisjoint(words)) else ""


def parse(page: str) -> Node:
    """The tree of a page: kids are nodes and strings (raw text between tags). Unclosed elements end with their
    parent; a new block ends an open paragraph, a new item the open one; stray end tags are skipped."""
    root = Node("#root")
    stack, pos = [root], 0
    end = len(page)
    while pos < end:
        m = _TOKEN.search(page, pos)
        if m is None:
            stack[-1].kids.append(page[pos:])
            break
        if m.start() > pos:
            stack[-1].kids.append(page[pos : m.start()])
        pos = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                stack[-1].kids.append(m[0][9:].removesuffix("]]>"))
            continue
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in CLOSES_P:
            _close(stack, "p", CLOSES_P - {"p"})
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
            for name in same:
                _close(stack, name, {"ul", "ol", "dl", "table", "select", "tr"} - {tag})
        node = Node(tag, m[3] or "")
        stack[-1].kids.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, pos)
            node.kids.append(page[pos : close.start() if close else end])
            pos = close.start() if close else end
            if close:
                pos = page.find(">", close.start())
                pos = end if pos < 0 else pos + 1
            continue
        if not m[3].endswith("/") or tag not in ("svg", "path"):
            stack.append(node)
    return root


def _close(stack: list[Node], name: str, barrier) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == name:
            del stack[i:]
            return
        if stack[i].tag in barrier:
            return


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold written text wherever they stand.
WRITTEN = HEADINGS | frozenset("p section blockquote pre figure dl table hgroup center".split())
#: Elements that are parts of a page.
CHROME = frozenset("nav header footer aside form".split())


def prune(root: Node) -> None:
    """Cuts what never is main text."""
    kinds: dict[int, str] = {}
    inside: set[int] = set()  # nodes in an article or main
    framing: set[int] = set()
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag in ("article", "main") and not kinds.get(id(node)):
            inside.add(id(node))
        kept = []
        for k in node.kids:
            if isinstance(k, str):
                kept.append(k)
                continue
            kind = is_cut(k.tag, k.attrs)
            if k.tag == "header" and id(node) in inside:
                kept += [h for h in _ordered(k) if h.tag in HEADINGS and not is_cut(h.tag, h.attrs)]
            elif kind != "always":
                kept.append(k)
                kinds[id(k)] = kind
            elif k.tag in CHROME:
                framing.add(id(node))
        node.kids = kept
        own = [k for k in kept if not isinstance(k, str)]
        if id(node) in inside:
            inside |= {id(k) for k in own}
        todo += own
    if any(kinds.values()):
        _cut_marked(root, kinds, framing)


def _cut_marked(root: Node, kinds: dict[int, str], framing: set[int]) -> None:
    """Cuts elements marked as noise or page parts, unless they are the frame of the densest node. ``framing``: elements that
    held page parts which are cut already."""
    nodes = measure(root)
    above = {id(k): n for n in nodes for k in n.kids if not isinstance(k, str)}
    marked = {id(n) for n in nodes if kinds.get(id(n))}
    noise = {i for i in marked if kinds[i] == "noise"}
    # of each subtree: its main headings, and whether it shows to be a frame
    headings, shows = {id(n): int(n.tag == "h1") for n in nodes}, {id(n): id(n) in framing for n in nodes}
    for n in reversed(nodes[1:]):
        up = id(above[id(n)])
        headings[up] += headings[id(n)]
        own = n.tag in ("h1", "article", "main") and id(n) not in marked or kinds.get(id(n)) == "part"
        shows[up] = shows[up] or shows[id(n)] or own

    def seen(without: set[int]) -> list[Node]:
        hidden: set[int] = set()
        for n in nodes:
            if id(n) in without or id(above.get(id(n))) in hidden:
                hidden.add(id(n))
        return [n for n in nodes if id(n) not in hidden]

    def way(left: list[Node]) -> list[Node]:
        """The densest node and all above it."""
        best = max((n for n in reversed(left) if n.block), key=lambda n: n.total, default=None)  # the lowest of equals
        out = [best] if best is not None and best.total else []
        while out and id(out[-1]) in above:
            out.append(above[id(out[-1])])
        return out

    # comments and the like may be denser than a short article: they are a frame only if they hold all main headings
    frames = {id(n) for n in way(nodes) if id(n) in noise and 0 < headings[id(n)] == headings[id(root)]}
    lone = not any(n.tag == "p" and n.chars for n in seen(marked))
    frames |= {id(n) for n in way(seen(noise - frames)) if id(n) in marked and (lone or shows[id(n)])}
    for n in nodes:
        n.kids = [k for k in n.kids if isinstance(k, str) or id(k) not in marked or id(k) in frames]


def _ordered(root: Node) -> list[Node]:
    """All nodes, parents before children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [k for k in reversed(node.kids) if not isinstance(k, str)]
    return out


def measure(body: Node) -> list[Node]:
    """Characters, tags, link characters, link tags, composite density, density sum and the node of the largest sum (top) of
    every subtree below body."""
    nodes = _ordered(body)
    for node in reversed(nodes):
        kids = [k for k in node.kids if not isinstance(k, str)]
        node.chars = sum(len("".join(k.split())) for k in node.kids if isinstance(k, str)) + sum(k.chars for k in kids)
        node.tags = len(kids) + sum(k.tags for k in kids)
        link = node.tag == "a"
        node.link_chars = node.chars if link else sum(k.link_chars for k in kids)
        node.link_tags = int(link) + sum(k.link_tags for k in kids)
    ratio = body.link_chars / max(1, body.chars)
    for node in nodes:
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, ratio)
    for node in reversed(nodes):
        blocks = [k for k in node.kids if not isinstance(k, str) and k.block]
        node.block = node.tag not in INLINE and node.tag not in VOID or bool(blocks)
        node.total = sum(k.density for k in blocks)
        node.top = max([node, *(k.top for k in blocks)], key=lambda n: n.total)
    return nodes


def density(chars: int, tags: int, link_chars: int, link_tags: int, body_ratio: float) -> float:
    """Characters per tag times a logarithm that falls with the share of link characters and link tags."""
    if not chars:
        return 0.0
    tags, links, link_tags = max(1, tags), max(1, link_chars), max(1, link_tags)
    base = math.log(chars / max(1, chars - link_chars) * link_chars + body_ratio * chars + math.e)
    # a base below e would blow up small nodes without links
    return chars / tags * math.log(max(1.0, chars / links * tags / link_tags) + 1e-9) / math.log(max(base, math.e))


def main_nodes(body: Node) -> list[Node]:
    """The nodes whose subtrees are the main text, in page order."""
    nodes = measure(body)
    if not body.top.total:
        return [body]
    above = {id(k): n for n in nodes for k in n.kids if not isinstance(k, str)}
    node, threshold = body.top, body.top.density
    while node is not body:
        node = above[id(node)]
        threshold = min(threshold, node.density)
    out: list[Node] = []
    taken: set[int] = set()
    for n in nodes:  # parents first: a node is looked at if all above it reach the threshold
        up = above.get(id(n))
        if id(n) in taken or up is not None and id(up) in taken:
            taken.add(id(n))
        elif not n.block or n.density < threshold or up is not None and up.top is None:
            n.top = None
        elif n.chars and id(n.top) not in taken:
            out.append(n.top)
            taken.add(id(n.top))
    place = {id(n): i for i, n in enumerate(nodes)}
    out += _beside(next((n for n in out if n is body.top), out[0]), body, above, out, nodes) if out else []
    return sorted(out, key=lambda n: place[id(n)])


def _beside(node: Node, body: Node, above: dict[int, Node], taken: list[Node], nodes: list[Node]) -> list[Node]:
    """The written text beside the way from the densest node up to the body."""
    held = {id(n) for t in taken for n in _ordered(t)}
    way = [node]
    while way[-1] is not body:
        way.append(above[id(way[-1])])
    main = next((h for tag in ("h1", "h2") for h in nodes if h.tag == tag), None)
    frame = body
    if main is not None:
        over = set()
        while main is not body:
            over.add(id(main))
            main = above[id(main)]
        frame = next((n for n in way if id(n) in over), body)
    else:
        frame = node
    within = way.index(frame)
    out: list[Node] = []
    for i, parent in enumerate(way[1:], 1):
        for k in parent.kids:
            # another article beside is no part of this one
            if isinstance(k, str) or k is way[i - 1] or id(k) in held or not k.chars or 2 * k.link_chars > k.chars or k.tag in ("article", "main"):
                continue
            if k.tag in WRITTEN or k.block and i <= within and (parent is not body or any(x.tag in WRITTEN for x in _ordered(k))):
                # what is taken already lies inside it: the rest of it isn't
                if not any(id(x) in held for x in _ordered(k)) and not _is_notice(k):
                    out.append(k)
                    held |= {id(x) for x in _ordered(k)}
    return out


def _is_notice(node: Node) -> bool:
    return text_of(node).startswith(("©", "(c) ", "Copyright"))


def text_of(node: Node) -> str:
    """The text of a subtree: references decoded, white space as one space, blocks joined by one space."""
    out: list[str] = []
    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(entities.unescape(x))
        elif x is None:
            out.append(" ")
        elif x.tag in INLINE:
            todo += reversed(x.kids)
        else:
            todo += [None, *reversed(x.kids), None]
    return " ".join("".join(out).split())


def extract(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    prune(root)
    body = next((n for n in _ordered(root) if n.tag == "body"), root)
    return " ".join(t for t in map(text_of, main_nodes(body)) if t)


def _run(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [extract(h) for h in b.column(at).to_pylist()]
            keep = [c for i, c in enumerate(b.columns) if i != at]
            names = [x for i, x in enumerate(b.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(text, pa.string())], [*names, "text"])

    return run


def main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with html_col replaced by ``text``, the main text of the whole page (null html, or none found: empty).
    An own column named text is replaced; repeated rows stay; an empty table gives no rows."""
    small_batches(pages.sparkSession)
    pages = pages.drop("text") if html_col != "text" else pages.withColumnRenamed("text", "_html")
    html_col = "_html" if html_col == "text" else html_col
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != html_col)
    return pages.mapInArrow(_run(pages.columns.index(html_col)), f"{schema}, text string")


def op10_text_density(spark, sf_dir):
    from .common import table

    df = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return df.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
