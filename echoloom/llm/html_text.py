"""Main text of web pages by composite text density (Sun, Song and Liao, 2011)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, table

#: Elements without content, elements whose content is no markup, and elements that never hold an article's text.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
OUTSIDE = frozenset("head script style textarea title noscript iframe noembed noframes template svg math object canvas audio video map nav footer aside fieldset button select datalist menu dialog".split())
#: Elements inside a line; all others begin and end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Start tags that end an open element, up to the elements that bound the search.
CLOSES = {t: frozenset(["p"]) for t in "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()} | {
    "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]),
    "tbody": frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "p"]), "tfoot": frozenset(["thead", "tbody", "tr", "td", "th", "p"]), "option": frozenset(["option"]), "body": frozenset(["head", "p"]),
}
BOUNDS = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"])} | {t: frozenset(["table"]) for t in ("tr", "td", "th", "tbody", "tfoot")}
ANY_BOUND = frozenset("table td th button object div section article aside nav main header footer body html ul ol dl form".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id attributes that name what is no article text; those of the second list are an article's own as well.
STRONG_NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsbygoogle banner sponsor sponsored promo nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login share sharing widget toolbar pagination pager skip comment comments commentlist disqus respond replies".split())
WEAK_NAMES = frozenset("aside notice notices notification alert promotion subscription social related recommended recommendations teaser copyright search discussion reply".split())
#: Those of replies, the only ones that say anything of an article element.
REPLIES = frozenset("comment comments commentlist disqus respond reply replies".split())
#: Words that may stand beside those in such a name; any other word makes it the name of something else ("related-work").
PLAIN_NAMES = frozenset("a area article articles bar bars block body bottom box card center class col column container content div form group header inner item items left links list main mobile new news outer page panel post posts primary right row secondary section site small text thread title top wrap wrapper".split())
#: Elements whose class and id say nothing: ids of headings are made from their text.
UNNAMED = frozenset("html body main p h1 h2 h3 h4 h5 h6 hgroup".split())
#: Words that make a class a statement about an element ("has-comments", "with-sidebar"), not the name of one.
STATES = frozenset("has no not with without is hide show open closed enabled disabled".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_REST = re.compile(r"""(?:[^>"']+|"[^"]*"|'[^']*')*+>""")
_ATTRIBUTE = re.compile(r"""(?<![^\s/"'])([^\s=/"'>]++)\s*+=\s*+("[^"]*"|'[^']*'|[^\s>]+)""")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: What an element's role, class, id or kind says of it: nothing, perhaps or probably no article text, certainly none.
CLEAR, WEAK, STRONG, SURE = range(4)
#: What a character counts in an element that is marked so, and in a weakly marked one that reads like prose.
WEIGHTS, PROSE_WEIGHT = {CLEAR: 1.0, WEAK: 0.1, STRONG: 0.01}, 0.5
#: Prose: visible characters at least, and the shares that blocks of LONG ones have at least and links at most.
ENOUGH, LONG, PROSE, LINKED = 200, 80, 2 / 3, 0.2
#: Share of the threshold that a marked element inside the main text needs to stay there.
INSIDE = 1 / 3
#: Elements that may hold links or short lines beside the text inside its own element; their share of linked characters that
#: is too much, and that of a paragraph.
DIVISIONS = frozenset("div section ul ol li dl dd dt table tbody thead tfoot tr td th center details summary figure address hgroup".split())
MOSTLY, ALL_LINKS = 0.5, 0.9


class Node:
    """An element: its pieces of text and children in page order, and the sums of its subtree."""

    __slots__ = ("tag", "parent", "children", "mark", "own", "raw", "long", "links", "weight", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, mark: int):
        self.tag, self.parent, self.mark = tag, parent, mark
        self.children: list = []
        self.own = self.raw = self.long = self.links = 0  # visible characters: of its own block, all, in long blocks, in links
        self.weight = 1.0
        self.chars = self.link_chars = 0.0  # weighted
        self.tags = self.link_tags = 0
        self.density = self.total = 0.0


def _named(names: str, among: frozenset[str]) -> int:
    """The strongest mark that names of a class or id attribute give with those words.

    A word that is not known makes the name that of something else, unless the name speaks of replies; letters that prefix
    a name ("c-promo") say nothing.
    """
    mark = CLEAR
    for name in names.split():
        words = {w.lower() for w in _TOKEN.findall(name) if not w.isdigit()}
        telling = words & among
        others = {w for w in words - telling - PLAIN_NAMES if len(w) > 1}
        if telling and (not others or telling & REPLIES) and not words & STATES:
            mark = max(mark, STRONG if telling & STRONG_NAMES else WEAK)
    return mark


def _mark(tag: str, attributes: str, inside_article: bool) -> int:
    if tag in OUTSIDE or (tag == "header" and not inside_article):
        return SURE
    mark = STRONG if tag == "form" else CLEAR
    if not attributes or tag in ("html", "body", "main"):
        return mark
    found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    role = found.get("role", "").lower()
    if role in ROLES or found.get("aria-hidden", "").lower() == "true" or re.search(r"(?:^|\s)hidden(?:\s|$|=)", _ATTRIBUTE.sub(" ", attributes)):
        return SURE
    if re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return SURE
    if tag in UNNAMED:
        return mark
    among = REPLIES if tag == "article" else STRONG_NAMES | WEAK_NAMES
    return max(mark, STRONG if role == "form" else CLEAR, *(_named(found.get(key, ""), among) for key in ("class", "id")))


def parse(html: str) -> Node:
    """The element tree of a page, lenient as browsers are: end tags may lack, and so may the page's own end.

    The places of open elements are kept by name, so a tag costs the same however deep it is. Where a quoted attribute
    never ends, that tag and those after it end at their first >.
    """
    root = Node("#page", None, CLEAR)
    stack, at, low, quotes = [root], 0, html.lower() if "<" in html else "", True
    depths: dict[str, list[int]] = {}

    def add(text: str) -> None:
        if text:
            stack[-1].children.append(unescape(text) if "&" in text else text)

    def nearest(tags) -> int:
        return max((depths[t][-1] for t in tags if depths.get(t)), default=0)

    def close(depth: int) -> None:
        while len(stack) > depth:
            depths[stack.pop().tag].pop()

    while at < len(html):
        mark = html.find("<", at)
        if mark < 0:
            add(html[at:])
            break
        add(html[at:mark])
        if html.startswith("<!--", mark):
            end = html.find("-->", mark + 4)
            at = len(html) if end < 0 else end + 3
            continue
        closing = html.startswith("</", mark)
        name = _NAME.match(html, mark + 1 + closing)
        if not name:
            if html[mark + 1 : mark + 2] in ("!", "?", "/"):
                end = html.find(">", mark)
                at = len(html) if end < 0 else end + 1
            else:
                add("<")
                at = mark + 1
            continue
        rest = _REST.match(html, name.end()) if quotes else None
        if rest:
            attributes, at = html[name.end() : rest.end() - 1], rest.end()
        else:
            quotes, end = False, html.find(">", name.end())
            if end < 0:
                break
            attributes, at = html[name.end() : end], end + 1
        tag = name[0].lower()
        if closing:
            depth = nearest([tag])
            if depth and not (tag == "p" and nearest(ANY_BOUND) > depth):
                close(depth)
            continue
        if tag in CLOSES:
            while (depth := nearest(CLOSES[tag])) > nearest(BOUNDS.get(tag, ANY_BOUND)):
                close(depth)
                if tag in ("p", "option") or CLOSES[tag] == frozenset(["p"]):
                    break
        if tag in ("html", "body") and depths.get(tag):
            continue
        if tag == "body" and depths.get("head"):
            close(depths["head"][0])
        elif stack[-1].tag == "head" and tag not in ("title", "meta", "link", "style", "script", "base", "noscript", "template"):
            close(len(stack) - 1)
        node = Node(tag, stack[-1], _mark(tag, attributes, bool(depths.get("article") or depths.get("main"))))
        stack[-1].children.append(node)
        if tag in VOID or attributes.endswith("/") and tag in RAW:
            continue
        if tag in RAW:
            end = low.find(f"</{tag}", at)
            at = len(html) if end < 0 else end
            close_ = html.find(">", at)
            at = len(html) if close_ < 0 else close_ + 1
            continue
        depths.setdefault(tag, []).append(len(stack))
        stack.append(node)
    return root


def _visible(text: str) -> int:
    return len("".join(text.split()))


def measure(root: Node) -> list[Node]:
    """All elements that may hold text, weights, sums and densities set; children come after their parents.

    A character in marked elements counts as in the least of them, so what an element is called lowers the densities of
    itself and of all around it, and takes nothing away.
    """
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        node.own = node.raw = sum(_visible(c) for c in node.children if isinstance(c, str))
        todo += [c for c in reversed(node.children) if not isinstance(c, str) and c.mark != SURE]
    for node in reversed(order):
        node.long += node.own if node.tag not in INLINE and node.own >= LONG else 0
        node.links = node.raw if node.tag == "a" else node.links
        if node.parent is not None:
            up = node.parent
            up.raw, up.long, up.links = up.raw + node.raw, up.long + node.long, up.links + node.links
            up.own += node.own if node.tag in INLINE else 0
    linked: set[int] = set()
    for node in order:
        prose = node.raw >= ENOUGH and node.long >= PROSE * node.raw and node.links <= LINKED * node.raw
        own = PROSE_WEIGHT if node.mark == WEAK and prose else WEIGHTS[node.mark]
        node.weight = own if node.parent is None else min(own, node.parent.weight)
        if node.tag == "a" or node.parent is not None and id(node.parent) in linked:
            linked.add(id(node))
        node.chars = node.weight * sum(_visible(c) for c in node.children if isinstance(c, str))
        node.link_chars = node.chars if id(node) in linked else 0.0
    for node in reversed(order):
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags + (id(node) in linked)
    share = root.link_chars / max(1, root.chars)
    for node in order:
        chars, tags, links, link_tags = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        if chars:
            base = math.log(chars / max(1, chars - node.link_chars) * node.link_chars + share * chars + math.e)
            # a page without links has base 1, where the logarithm has no value; a floor keeps the order of its nodes
            node.density = chars / tags * math.log(max(1.0, chars / links * tags / link_tags)) / max(0.1, math.log(base))
    for node in order:
        node.total = sum(c.density for c in node.children if not isinstance(c, str) and c.mark != SURE)
    return order


def _mostly_links(node: Node, threshold: float) -> bool:
    """A block inside the main text that is sparse and whose characters are links for the most part."""
    most = MOSTLY if node.tag in DIVISIONS else ALL_LINKS if node.tag == "p" else 1.0
    return node.raw > 0 and node.density < threshold and node.links > most * node.raw


def _edges(lead: Node, path: set[int], threshold: float) -> set[int]:
    """Short sparse divisions in the lead before its first dense or long block and after its last: site names, imprints."""
    blocks = [c for c in lead.children if not isinstance(c, str) and c.tag not in INLINE and c.mark != SURE and c.raw]
    dense = [k for k, b in enumerate(blocks) if id(b) in path or b.mark == CLEAR and (b.density >= threshold or b.raw >= LONG) and not _mostly_links(b, threshold)]
    if not dense:
        return set()
    return {id(b) for k, b in enumerate(blocks) if not dense[0] <= k <= dense[-1] and b.tag in DIVISIONS and b.raw < LONG and b.density < threshold and not _headed(b)}


def _headed(node: Node) -> bool:
    """Whether the first block in an element is a heading: it belongs to the text that follows."""
    while True:
        inner = [c for c in node.children if not isinstance(c, str) and c.raw]
        if not inner:
            return False
        node = inner[0]
        if node.tag in UNNAMED - {"p"}:
            return True


def select(root: Node, tie_break: bool = True) -> tuple[list, float, set[int], set[int]]:
    """The pieces (elements, or strings between them) that hold the main text in page order, the density threshold, the
    lead's path, and the blocks inside that the threshold rules out.

    The element with the largest sum of its children's densities leads. The smallest density on its path from the body
    is the threshold: every element or string beside the path whose density reaches it is a piece as well, unless it is
    mostly links, and so are headings beside the path. Where an article or main element around the lead holds other
    pieces of the same text that are below the threshold, as by-lines, it breaks the tie: it stands for all pieces in it.
    """
    order = measure(root)
    if not root.chars:
        return [], 0.0, set(), set()
    best = max(order, key=lambda n: (n.total, n.density, n.tag in ("article", "main")))
    if not best.total:
        best = root
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min((n.density for n in path if n.tag not in ("#page", "html")), default=0.0)
    holders = [n for n in path if n.tag == "article"] or [n for n in path if n.tag == "main"]
    whole = holders[-1] if holders and tie_break else best
    on_path, found = {id(n) for n in path}, []
    todo: list = [root]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            if _visible(node) >= max(1.0, threshold):
                found.append(node)
        elif node is whole:
            found.append(node)
        elif id(node) in on_path:
            todo += [c for c in reversed(node.children) if isinstance(c, str) or c.mark != SURE]
        elif node.density >= threshold and node.tag != "a" and node.chars > 2 * node.link_chars or node.tag in ("h1", "h2") and node.weight == 1.0:
            found.append(node)
    # what stands at the ends of an article or main element is its own, as by-lines
    dropped = set() if holders else _edges(best, on_path, threshold)
    dropped |= {id(n) for n in order if id(n) not in on_path and n.mark == CLEAR and _mostly_links(n, threshold)}
    return found, threshold, on_path, dropped


def main_text(html: str | None, tie_break: bool = True) -> str:
    """The main text of a page: blocks in page order, white space of any length one space; empty for none or null.

    Inside the pieces everything stays but elements that are certainly no text, marked ones whose density, lowered by
    their names, is under a third of the threshold and that don't hold the lead, and blocks below the threshold that are
    mostly links or short divisions at an end of the lead.
    """
    pieces: list[str] = []
    root = parse(html or "")
    found, threshold, lead, dropped = select(root, tie_break)
    for top in found:
        todo: list = [top]
        while todo:
            item = todo.pop()
            if isinstance(item, str):
                pieces.append(item)
            elif item is not top and id(item) in dropped:
                pieces.append(" ")
            elif item is top or item.mark == CLEAR or item.mark != SURE and (id(item) in lead or item.density >= INSIDE * threshold > 0):
                edge = [] if item.tag in INLINE else [" "]
                todo += [*edge, *reversed(item.children), *edge]
        pieces.append(" ")
    return " ".join("".join(pieces).split())


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            texts = [main_text(h.as_py()) for h in part.column("html")]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page, from its whole html.

    One page is handled at a time and no row is shuffled. Null and empty pages have an empty text; null ids and urls
    stay; repeated rows are kept; an empty table gives no rows; further columns are ignored.
    """
    return map_arrow(pages.selectExpr("cast(page_id as long) as page_id", "url", "html"), _extract, "page_id long, url string, text string, n_chars long")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
