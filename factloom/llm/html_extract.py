"""Main text of HTML pages by composite text density.

A page becomes a tree of elements. Elements that are never article text (menus, forms,
scripts, adverts, notices, reader comments) are taken out by tag, role and class words; an
element that only a class word speaks against stays if nearly all text of the page is in it.
For every other element the composite text density is its characters per tag, scaled by
the share of characters and tags that are not in links (Sun, Song and Liao, 2011). The
element whose children's densities have the largest sum is the core. The least density
on the path from the core to the body is the threshold; every element of that density or
more gives its largest-sum subtree. A parent of several of these parts below the body is one text with
them; a parent of one adds its headings, paragraphs, lists and tables beside it, as titles
and short paragraphs have little density of their own. Lists of links are left out.

Parsing takes time in proportion to a page's length, whatever its markup.
"""

from __future__ import annotations

import html as references
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# an attribute's quote opens after "=" only, and one that is never closed ends with the tag
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+|=)*+)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
_SPACE = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
_DROPPED = frozenset(
    "script style noscript template head title nav aside footer form button select textarea input iframe object embed svg canvas audio video dialog menu".split()
)
_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar".split())
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs consent cookie cookies "
    "footer gdpr masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pagination popup promo promoted promotion "
    "recommended related share sharing sidebar sidebars signup social sponsor sponsored subscribe subscription tagcloud toolbar widget widgets".split()
)
_COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
_CLOSES = {
    **dict.fromkeys("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split(), ("p",)),
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "option": ("option",), "tr": ("tr", "td", "th", "p"),
    "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tbody": ("tr", "td", "th", "p"),
}
_SCOPE = {"li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "tr": frozenset(("table",)), "td": frozenset(("table",)), "th": frozenset(("table",)), "tbody": frozenset(("table",))}
_FENCE = frozenset("article aside body div footer header html main nav section table td th ul ol dl form blockquote".split())
_FLOW = frozenset("h1 h2 h3 h4 h5 h6 hgroup p pre blockquote figure ul ol dl table".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Text in an element that a class word speaks against, over the text elsewhere, from which it stays.
_OUTWEIGHS = 10


class _Node:
    __slots__ = ("tag", "parent", "parts", "dropped", "suspect", "chars", "tags", "link_chars", "link_tags", "density", "total", "best", "pick")

    def __init__(self, tag: str, parent: _Node | None, dropped: bool, suspect: bool = False):
        self.tag, self.parent, self.dropped, self.suspect = tag, parent, dropped, suspect
        self.parts: list[_Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.best = self
        self.pick = 0


def _attributes(attributes: str) -> tuple[bool, bool]:
    """Whether an element goes for sure, and whether a class word speaks against it."""
    suspect = False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            words = set(re.split(r"[^a-z0-9]+", value))
            if not _COMMENTS.isdisjoint(words):
                return True, False
            suspect = suspect or not _WORDS.isdisjoint(words)
        if (name == "role" and value in _ROLES) or name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True, False
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, False
    return False, suspect


class _Open:
    """The open elements from the root on; the depths of each tag's open elements are at hand, so no search walks up."""

    def __init__(self, root: _Node):
        self.nodes = [root]
        self.depths: dict[str, list[int]] = {}
        self.fences: list[int] = []

    def push(self, node: _Node) -> None:
        self.depths.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in _FENCE:
            self.fences.append(len(self.nodes))
        self.nodes.append(node)

    def close(self, depth: int) -> None:
        """Close the element of this depth and all in it."""
        while len(self.nodes) > depth:
            tag = self.nodes.pop().tag
            self.depths[tag].pop()
            if tag in _FENCE:
                self.fences.pop()

    def last(self, tag: str) -> int:
        """Depth of the innermost open element of a tag, 0 if there is none."""
        own = self.depths.get(tag)
        return own[-1] if own else 0


def parse(page: str) -> _Node:
    """The element tree of a page; unclosed and stray tags are mended as browsers do."""
    root = _Node("html", None, False)
    open_ = _Open(root)
    at, size = 0, len(page)

    def add(text: str) -> None:
        if text and not open_.nodes[-1].dropped:
            open_.nodes[-1].parts.append(text)

    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            add(references.unescape(page[at:]))
            break
        add(references.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            depth = open_.last(tag)
            if depth and (tag in _FENCE or not open_.fences or open_.fences[-1] < depth):
                open_.close(depth)
            continue
        here = open_.nodes[-1]
        if tag == "html" or (tag == "body" and here.tag == "body"):
            continue
        if tag in _BLOCK and here.tag == "head":
            open_.close(len(open_.nodes) - 1)
        for closed in _CLOSES.get(tag, ()):
            depth, fence = open_.last(closed), _SCOPE.get(tag, _FENCE)
            if closed != "p":
                fence = fence | _SCOPE.get(closed, frozenset())
            if depth and all(open_.last(f) <= depth for f in fence):
                open_.close(depth)
        here = open_.nodes[-1]
        in_article = bool(open_.last("article") or open_.last("main"))
        dropped, suspect = tag in _DROPPED or (tag == "header" and not in_article), False
        if here.tag == "header" and tag not in _HEADINGS:
            dropped = dropped or tag not in ("div", "section")
        if m[3] and not dropped and tag not in ("html", "body", "article", "main"):
            dropped, suspect = _attributes(m[3])
        node = _Node(tag, here, here.dropped or dropped, suspect)
        here.parts.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = size if end is None else (page.find(">", end.start()) + 1 or size)
        elif tag not in _VOID and not m[3].rstrip().endswith("/"):
            open_.push(node)
    return root


def _settle(root: _Node) -> None:
    """Drop the outermost suspects, but for those that outweigh all other text of the page."""
    suspects: list[_Node] = []
    rest, stack = 0, [(root, -1)]
    sums: list[int] = []
    while stack:
        node, own = stack.pop()
        if node.suspect and own < 0:
            own = len(suspects)
            suspects.append(node)
            sums.append(0)
        for part in node.parts:
            if not isinstance(part, str):
                if not part.dropped and not (own >= 0 and part.suspect):
                    stack.append((part, own))
            elif own < 0:
                rest += len(part.strip())
            else:
                sums[own] += len(part.strip())
    for node, chars in zip(suspects, sums, strict=True):
        node.dropped = chars <= _OUTWEIGHS * (rest + sum(sums) - chars)
    inner = [p for n in suspects if not n.dropped for p in n.parts if not isinstance(p, str)]
    while inner:
        node = inner.pop()
        node.dropped = node.dropped or node.suspect
        inner += [p for p in node.parts if not isinstance(p, str)] if not node.dropped else []


def _post_order(root: _Node) -> list[_Node]:
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [p for p in node.parts if not isinstance(p, str) and not p.dropped]
    return order[::-1]


def densities(root: _Node) -> list[_Node]:
    """Set each kept element's composite density and the sum of its children's; children come first."""
    order = _post_order(root)
    for node in order:
        for part in node.parts:
            if isinstance(part, str):
                node.chars += len(part.strip())
            elif not part.dropped:
                node.chars, node.tags = node.chars + part.chars, node.tags + part.tags + 1
                node.link_chars, node.link_tags = node.link_chars + part.link_chars, node.link_tags + part.link_tags + (part.tag == "a")
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags
    body = next((n for n in order if n.tag == "body"), root)
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in order:
        chars, links = node.chars, node.link_chars
        if chars:
            base = math.log(chars / max(chars - links, 1) * links + share * chars + math.e)
            ratio = chars / max(links, 1) * max(node.tags, 1) / max(node.link_tags, 1)
            node.density = chars / max(node.tags, 1) * max(math.log(ratio) / base if base > 0 and ratio > 0 else 0.0, 0.0)
        for part in node.parts:
            if not isinstance(part, str) and not part.dropped:
                node.total += part.density
                if part.best.total > node.best.total or (node.best is node and part.best.total > node.total):
                    node.best = part.best
        if node.total >= node.best.total:
            node.best = node
    return order


def _is_link_list(node: _Node) -> bool:
    return node.tag in ("ul", "ol", "dl", "div", "section", "table") and node.link_tags >= 3 and 5 * node.link_chars >= 4 * node.chars


def main_nodes(root: _Node) -> list[_Node]:
    """Elements whose text is the main text, in page order, none inside another."""
    _settle(root)
    order = densities(root)
    body = next((n for n in order if n.tag == "body"), root)
    core = body.best if body.best.chars else body
    least, node = core.density, core
    while node is not None and node is not body:
        node = node.parent
        if node is not None:
            least = min(least, node.density)
    core.pick = 2
    stack = [body]
    while stack:
        node = stack.pop()
        if node.density >= least and node.chars:
            node.best.pick = 2
            stack += [p for p in node.parts if not isinstance(p, str) and not p.dropped]
    for node in order:
        if node.pick == 2:
            continue
        inner = [p for p in node.parts if not isinstance(p, str) and not p.dropped]
        picked = sum(p.pick == 2 for p in inner)
        if picked > 1 and node is not body and node is not root:
            node.pick = 2
        elif picked or any(p.pick for p in inner):
            node.pick = 1
            beside = _HEADINGS if node is body or node is root else _FLOW
            for p in inner:
                if p.tag in beside or (p.tag == "header" and p.chars):
                    p.pick = 2
    out = []
    stack = [root]
    while stack:
        node = stack.pop()
        if node.pick == 2:
            out.append(node)
        elif node.pick:
            stack += [p for p in reversed(node.parts) if not isinstance(p, str) and not p.dropped]
    return out


def blocks(node: _Node) -> list[str]:
    """Text of an element's blocks, in page order; white space is one space, empty blocks are left out."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = _SPACE.sub(" ", "".join(run)).strip()
        if text:
            out.append(text)
        run.clear()

    stack: list[_Node | str | None] = [node]
    while stack:
        part = stack.pop()
        if part is None:
            close()
        elif isinstance(part, str):
            run.append(part)
        elif part.tag == "br":
            run.append(" ")
        elif not part.dropped and not _is_link_list(part):
            if part.tag in _BLOCK:
                close()
                stack.append(None)
            stack += reversed(part.parts)
    close()
    return out


def main_text(page: str | None) -> str:
    """The main text of a page, its blocks joined by line feeds; empty for null and empty pages."""
    if not page:
        return ""
    return "\n".join(b for node in main_nodes(parse(page)) for b in blocks(node))


def with_main_text(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """One row for each page: the key columns, text and n_chars (code points).

    Pages are read whole. A null or empty page has an empty text; null keys pass through; repeated
    rows give repeated results; an empty table gives no rows; other columns are not read, whatever their names.
    """
    typed = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(page) for page in batch["_page"]]
            yield batch[list(keys)].assign(text=texts, n_chars=[len(t) for t in texts])

    return pages.selectExpr(*(f"`{k}`" for k in keys), f"`{html}` AS _page").mapInPandas(extract, f"{typed}, text string, n_chars long")
