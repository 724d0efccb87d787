"""Main text of web pages by composite text density.

Each page becomes a tree. Elements that never hold article text (scripts, styles, forms, navigation,
page headers and footers, asides, and elements whose role, class or id names an advert, menu, sidebar,
notice or comment list) are cut off first, those whose name articles use for sections, too, only if they have no paragraph or are
mostly links; one cut off by class or id alone comes back if it holds the densest
part of the page and its heading. Every remaining element gets its composite density: its
characters per tag, adjusted by how much of both lies in links. The element whose children's densities
have the greatest sum is the content; the least density on its path from body is the threshold that
decides which enclosing elements belong to it too. What is left of that element is emitted block by block, with an empty line between blocks.

Defined cases: null or blank html gives an empty text; broken or unclosed markup is repaired by the usual
implied end tags; very long pages are read whole in linear time; repeated rows are extracted alike; an
empty table gives an empty table; other columns of the input pass through unless they are called text or n_chars.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelake.llm.common import fresh, without

# Element names as the HTML standard groups them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCK - frozenset("body html tbody td tfoot th thead tr caption".split())
NEVER_TEXT = frozenset("script style noscript template head title nav footer aside form button select option textarea input iframe object svg canvas audio video dialog menu".split())
NEVER_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NEVER_NAME = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner banners sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices notification popup modal overlay comment comments commentlist disqus respond replies reply share sharing social newsletter subscribe signup login related recommended widget pagination pager toolbar skip hidden".split())
#: Names that article sections have as well: alone, they cut off only what has no paragraph or is mostly links.
DOUBTFUL = frozenset("hidden login recommended related reply respond share sharing signup skip social subscribe toolbar widget".split())
LAYOUT = frozenset("has no with without".split())
HOLDER = frozenset("area bar block body bottom box button buttons card cards center col column container content feed form group header heading icon icons inner item items label layer left links list module outer panel post posts right row section slot space stories strip text thread title tools top unit wrap wrapper zone".split())
NAME_PART = re.compile(r"[A-Za-z0-9]+")
TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=[A-Za-z/!?])[^<]*\Z", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


class Node:
    __slots__ = ("tag", "parent", "children", "chars", "tags", "link_chars", "link_tags", "density", "total", "never", "named")

    def __init__(self, tag: str, parent: Node | None, never: bool = False) -> None:
        self.tag, self.parent, self.never = tag, parent, never
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.named = ""  #: how class or id names what never holds text: "", "part", "whole" or "doubtful"


def is_never(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in NEVER_TEXT or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        # An article that lists reader comments is named so, too.
        if tag != "article" or "comment" not in attributes.lower():
            return False
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = "".join(values).lower(), name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in NEVER_ROLE):
            return True
    return False


def name_of(tag: str, attributes: str) -> str:
    """Whether class or id holds a name of NEVER_NAME as a "whole" name, as a "part" of one, or not (""); "doubtful" if only one of DOUBTFUL.

    A name that says that its element has, or lacks, such a part ("has-sidebar") is none; nor is one in which something
    else than a holder follows ("related-work").
    """
    if not attributes or tag in ("html", "body", "main") or (tag == "article" and "comment" not in attributes.lower()):
        return ""
    found = ""
    for name, *values in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id"):
            for word in "".join(values).lower().split():
                if word in DOUBTFUL:
                    found = found or "doubtful"
                    continue
                if word in NEVER_NAME:
                    return "whole"
                parts = [x for x in NAME_PART.findall(word) if not x.isdigit()]
                if any(part in NEVER_NAME and not (k and set(parts[:k]) & LAYOUT) and HOLDER.union(NEVER_NAME).issuperset(parts[k + 1 :]) for k, part in enumerate(parts)):
                    found = "part"
    return found


def put_back_readable(root: Node) -> None:
    """Puts doubtful elements back that have a paragraph and text that mostly isn't linked, inner ones first."""
    stack, order = [root], []
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in node.children if isinstance(x, Node) and (not x.never or x.named == "doubtful")]
    told: dict[int, tuple[int, int, bool]] = {}
    for node in order[::-1]:
        chars, linked, paragraph = 0, 0, node.tag == "p"
        for x in node.children:
            if isinstance(x, str):
                chars += len("".join(x.split()))
            elif not x.never:
                n, in_links, has = told[id(x)]
                chars, linked, paragraph = chars + n, linked + in_links, paragraph or has
        told[id(node)] = chars, chars if node.tag == "a" else linked, paragraph
        if node.named == "doubtful" and paragraph and 2 * linked < chars:
            node.never, node.named = False, ""


def parse(page: str) -> Node:
    root = here = Node("#root", None)
    doubtful = False
    depth: dict[str, int] = {}

    def close_to(stop: Node) -> None:
        nonlocal here
        while here is not stop:
            depth[here.tag] -= 1
            here = here.parent  # type: ignore[assignment]

    def end(tag: str, barrier: tuple[str, ...] = ()) -> None:
        nonlocal here
        if not depth.get(tag):
            return
        at = here
        while at.tag != tag:
            if at.tag in barrier or at.parent is None:
                return
            at = at.parent
        close_to(at.parent)  # type: ignore[arg-type]

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else size]
        if text:
            here.children.append(entities.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        cdata, slash, tag, attributes = m.group(1), m.group(2), m.group(3), m.group(4)
        if cdata:
            here.children.append(cdata)
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            if tag == "br":
                here.children.append(" ")
            else:
                end(tag, ("table",) if tag not in ("table", "body", "html") and depth.get("table") and tag not in ("td", "th", "tr", "tbody", "thead", "tfoot") and tag not in BLOCK else ())
            continue
        if tag in CLOSES_P:
            end("p", ("table", "article", "td", "th", "div", "section", "li"))
        if tag == "li":
            end("li", ("ul", "ol", "menu"))
        elif tag in ("dd", "dt"):
            end("dd", ("dl",)), end("dt", ("dl",))
        elif tag in ("td", "th"):
            end("td", ("table",)), end("th", ("table",))
        elif tag == "tr":
            end("tr", ("table",))
        elif tag == "option":
            end("option", ("select",))
        if tag in VOID:
            here.children.append(" ") if tag == "br" else here.children.append(Node(tag, here))
            continue
        node = Node(tag, here, is_never(tag, attributes, bool(depth.get("article") or depth.get("main"))))
        if not node.never and (named := name_of(tag, attributes)):
            node.never, node.named = True, named
            doubtful = doubtful or named == "doubtful"
        here.children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else size
            continue
        if not attributes.rstrip().endswith("/") or tag in BLOCK:
            here = node
            depth[tag] = depth.get(tag, 0) + 1
    if doubtful:
        put_back_readable(root)
    return root


def in_post_order(root: Node) -> list[Node]:
    """Elements that may hold text, children before parents; no recursion, so depth doesn't matter."""
    stack, out = [root], []
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [x for x in node.children if isinstance(x, Node) and not x.never]
    return out[::-1]


def measure(root: Node, body: Node) -> list[Node]:
    nodes = in_post_order(root)
    for node in nodes:
        link = node.tag == "a"
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        node.density = 0.0
        for x in node.children:
            if isinstance(x, str):
                node.chars += len("".join(x.split()))
            elif not x.never:
                node.chars, node.tags = node.chars + x.chars, node.tags + x.tags + 1
                node.link_chars, node.link_tags = node.link_chars + x.link_chars, node.link_tags + x.link_tags + (x.tag == "a")
        if link:
            node.link_chars = node.chars
    of_body = body.link_chars / body.chars if body.chars else 0.0
    for node in nodes:
        if node.chars:
            plain = max(1, node.chars - node.link_chars)
            base = math.log(node.chars / plain * node.link_chars + of_body * node.chars + math.e)
            inner = node.chars / max(1, node.link_chars) * max(1, node.tags) / max(1, node.link_tags)
            node.density = node.chars / max(1, node.tags) * math.log(max(inner, 1.0)) / math.log(max(base, 1.0001))
    for node in nodes:
        node.total = sum(x.density for x in node.children if isinstance(x, Node) and not x.never)
    return nodes


INLINE = ("a", "b", "i", "em", "strong", "span", "u", "font", "small")
HEADING = ("h1", "article", "main")


def restore(root: Node) -> None:
    """Puts elements back that class or id cut off, if they hold the densest part of the page and its heading.

    One with such a name as a part of another also comes back if the page has no heading at all.
    """
    stack, named = [root], []
    while stack:
        node = stack.pop()
        if node.named:
            named.append(node)
        stack += [x for x in node.children if isinstance(x, Node) and (x.named or not x.never)]
    if not named:
        return
    body = next((n for n in in_post_order(root) if n.tag == "body"), root)
    outside = [n for n in measure(root, body) if n.tag not in INLINE]
    headed, most = any(n.tag in HEADING for n in outside), max((n.total for n in outside), default=0.0)
    for node in named:
        node.never = False
    # What isn't cut off holds named elements, too, whose densities are none of its own.
    known = {id(n) for n in outside}
    at = max((n for n in measure(root, body) if n.tag not in INLINE and id(n) not in known), key=lambda n: (n.total, n.chars), default=None)
    if at is not None and at.total <= most:
        at = None
    held = []
    while at is not None:
        if at.named:
            held.append(at)
        at = at.parent
    back = []
    if not headed and held:
        inside = [any(n.tag in HEADING for n in in_post_order(x)) for x in held]
        anywhere = any(n.tag in HEADING for x in named for n in in_post_order(x))
        # held runs outwards: what encloses an element that comes back must come back, too.
        if inside[-1] or (not anywhere and all(x.named == "part" for x in held)):
            back = held
    for node in named:
        node.never = all(node is not x for x in back)


def content_root(root: Node) -> Node:
    restore(root)
    nodes = in_post_order(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    nodes = [n for n in measure(root, body)]
    inside = {id(n) for n in in_post_order(body)}
    best = max((n for n in nodes if id(n) in inside and n.tag not in INLINE), key=lambda n: (n.total, n.chars), default=body)
    path, at = [], best
    while at is not None and at is not body:
        path.append(at)
        at = at.parent
    threshold = min((n.density for n in [*path, body]), default=0.0)
    for outer in path:
        if outer.tag in ("article", "main"):
            return outer
    chosen = best
    for outer in path[1:]:
        other = [x for x in outer.children if isinstance(x, Node) and not x.never and x.chars and x not in path]
        if all(x.density >= threshold for x in other):
            chosen = outer
    if chosen is not body and chosen.parent is body and not any(isinstance(x, str) and x.strip() for x in body.children):
        other = [x for x in body.children if isinstance(x, Node) and not x.never and x.chars and x is not chosen]
        if other and all(x.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "ul", "ol", "pre", "table") and 2 * x.link_chars < x.chars for x in other):
            return body
    return chosen


def blocks(root: Node) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if line := " ".join("".join(run).split()):
            out.append(line)
        run.clear()

    stack: list[Node | str | None] = [root]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif not x.never:
            edge = x.tag in BLOCK
            if edge:
                flush()
                stack.append(None)
            stack += x.children[::-1]
    flush()
    return out


def main_text(page: str | None) -> str:
    return "\n\n".join(blocks(content_root(parse(page)))) if page else ""


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """The rows of pages, less html, with text (the main text) and n_chars (its code points)."""
    kept = without(pages, "text", "n_chars") if html.lower() not in ("text", "n_chars") else pages

    @F.pandas_udf("string")
    def texts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(main_text, na_action=None).astype(object)

    name = fresh(kept, "_text")
    out = kept.withColumn(name, texts(F.coalesce(F.col(f"`{html}`"), F.lit(""))))
    return without(out, html).withColumnRenamed(name, "text").withColumn("n_chars", F.char_length("text").cast("long"))
