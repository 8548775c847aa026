"""The main text of web pages by tag-path ratios.

Method:

1. One pass over the markup yields text nodes, each under its root-to-leaf path
   of tags (with class and id names less their digits), and the block that the
   text belongs to.
   End tags may be missing: a new paragraph, list item or row closes the open
   one, an end tag closes what stands open inside its element, and what is open
   at the end of the page ends there. The work for a tag does not grow with the
   number of open elements.
2. Paths through an element whose name or attributes mark it as menu, header,
   footer, sidebar, notice, advert, form or comment are out, whatever their ratio.
   Words that articles use too, as in related-studies, tell a part only where its
   name has no other word. Within an article or main element only containers and
   further articles, which are comments or teasers, are told by such words: a
   paragraph, heading or item stays whatever its class, and so does a header
   element, which is the article's own.
3. For each other path of every page: the sum of its texts' lengths and
   punctuation marks over its number of nodes, the text-to-tag-path ratios. Both
   are smoothed over the nodes in page order and fused by their product, which
   counts double inside an article or main element. Paths whose mean reaches the
   deviation of the page's fused ratios are chosen, the best one always.
4. The content is what holds all nodes of the chosen paths: their lowest common
   container, and the article or main element around it or else each container
   above it that holds no text of other containers. If only the body is common, and no chosen
   node is its own, it is the containers with chosen nodes, what lies between
   them, and the body's own text.
5. All text of the content that is not under an excluded element is kept, so
   headings, lists and short blocks stay: character references decoded, white
   space inside a block made one space, blocks in page order joined by one space.

Defined results: a null or empty html, or a page without text, has an empty
text. Unclosed or misplaced tags never fail. A null url or page_id is returned
as it is. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.exchange import small_batches

# Element names of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title annotation annotation-xml iframe object select option canvas audio video head".split())
INLINE = frozenset("math mrow mi mn mo ms mtext msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mstyle mspace mpadded mfenced semantics annotation annotation-xml svg g text tspan textpath a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
OUTSIDE = frozenset("nav header footer aside form button menu dialog fieldset".split())
CLOSES = {
    "p": frozenset(["p"]), "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]),
    "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"]),
}
#: Elements at which the search for an unclosed sibling stops.
SCOPES = frozenset("ul ol dl table article section div body main td th blockquote figure".split())
CLOSE_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())
# Words in class, id and role attributes of parts that are not the article.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe "
    "subscription signup login nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar toolbar footer footnav bottombar sidebar aside rail widget related recommended "
    "recommendations trending share sharing social comment comments commentlist reply replies disqus respond reviews pagination pager search searchbox copyright legal "
    "disclaimer skip hidden complementary contentinfo".split()
)
# Of those, words that articles use too, which tell only where a name holds no others than these and words of layout.
AMBIGUOUS = frozenset("related reviews reply replies notice alert header share social legal banner menu search".split())
LAYOUT = frozenset(
    "area articles bar block body bottom box button buttons column container content footer inner items item left link links list main news outer page panel post posts right section "
    "card child depth even odd parent site stories story text thread top unit wrap wrapper".split()
)
CONTENT = frozenset(["article", "main"])
#: Containers, which alone are told by class words within an article or main element.
BOXES = frozenset("div section ul ol dl table figure details center".split())
#: How often a ratio counts inside an article or main element.
CONTENT_WEIGHT = 2
PAGE = frozenset(["", "html", "body"])
CONTAINERS = PAGE | CONTENT | frozenset(["div", "section", "center"])

# a quote opens a value only right after an equals sign; anywhere else it is a character like others
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$|[\"'])", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")
_SPACE = re.compile(r"\s+")
_MARKS = re.compile(r"[.,;:!?…、。，！？]")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


def _boilerplate(value: str, name: str) -> bool:
    """Whether the names in an attribute tell a part other than the article. An article element is one only by a name with no other word, such as that of a comment."""
    for token in value.split():
        words = set(_WORDS.findall(token))
        told = words & BOILERPLATE
        if told and (words <= BOILERPLATE | LAYOUT or (name != "article" and told - AMBIGUOUS)):
            return True
    return False


def _excluded(name: str, attributes: str, inside: bool) -> tuple[bool, str]:
    """Whether an element, inside a content element or not, is a part other than the article, and its label in a tag path."""
    if name in OUTSIDE and not (inside and name == "header"):
        return True, name
    label, out = name, False
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true"):
                out = True
            elif key == "style":
                out |= "display:none" in value.replace(" ", "")
            elif value:
                label += f".{_DIGITS.sub('', value)}"
                told = name in BOXES or name == "article" if inside else name not in ("body", "html", "main")
                out |= told and _boilerplate(value, name)
    return out, label


class _Node:
    __slots__ = ("block", "content", "element", "out", "path", "text")

    def __init__(self, text: str, path: int, block: int, out: bool, content: int, element: int) -> None:
        self.text, self.path, self.block, self.out, self.content, self.element = text, path, block, out, content, element


class _Elements:
    """The tree of elements, numbered in page order: names, parents and the nearest container, which may be the element itself."""

    def __init__(self) -> None:
        self.names, self.parents, self.boxes = [""], [0], [0]

    def add(self, name: str, parent: int) -> int:
        self.names.append(name)
        self.parents.append(parent)
        self.boxes.append(len(self.boxes) if name in CONTAINERS or "-" in name else self.boxes[parent])
        return len(self.boxes) - 1

    def above(self, box: int) -> int:
        return self.boxes[self.parents[box]]

    def common(self, a: int, b: int) -> int:
        """The lowest common container of two containers."""
        while a != b:
            if a > b:
                a = self.above(a)
            else:
                b = self.above(b)
        return a


class _Open:
    """The open elements, from the root inwards, with what finds one without walking over the others."""

    def __init__(self) -> None:
        # name, number of the path, excluded, number of the content element or 0, element, the nearest scope's depth
        self.stack: list[tuple[str, int, bool, int, int, int]] = [("", 0, False, 0, 0, 0)]
        self.depths: dict[str, list[int]] = {}

    def push(self, name: str, path: int, out: bool, content: int, element: int) -> None:
        depth = len(self.stack)
        self.stack.append((name, path, out, content, element, depth if name in SCOPES else self.stack[-1][5]))
        self.depths.setdefault(name, []).append(depth)

    def cut(self, depth: int) -> None:
        """Close all from the given depth on."""
        while len(self.stack) > depth:
            self.depths[self.stack.pop()[0]].pop()

    def innermost(self, name: str) -> int:
        """The depth of the innermost open element of a name, or 0."""
        depths = self.depths.get(name)
        return depths[-1] if depths else 0

    def outermost(self, names: frozenset[str], above: int) -> int:
        """The depth of the outermost open element of some names above a depth, or 0."""
        found = 0
        for name in names:
            depths = self.depths.get(name, ())
            at = bisect_right(depths, above)
            if at < len(depths) and (not found or depths[at] < found):
                found = depths[at]
        return found


def nodes(page: str) -> tuple[list[_Node], _Elements]:
    """The text nodes of a page in order, and its elements."""
    found: list[_Node] = []
    elements = _Elements()
    paths: dict[tuple[int, str], int] = {}
    open_ = _Open()
    endless: set[str] = set()  # raw elements without a further end tag
    block = at = contents = 0
    end = len(page)
    while at < end:
        m = _TAG.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            _, path, out, content, element, _ = open_.stack[-1]
            found.append(_Node(page[at:stop], path, block, out, content, element))
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        closing = m[1] or m[4]
        if name not in INLINE:
            block += 1
        if closing:
            depth = open_.innermost(name)
            if depth and not (name in INLINE and open_.stack[-1][5] > depth):
                open_.cut(depth)
            continue
        if name in VOID:
            continue
        attributes = m[3] if m[2] else m[6]
        if name in RAW:
            if name == "head" or attributes.endswith("/"):
                continue
            last = None if name in endless else _RAW_END[name].search(page, at)
            if last:
                at = page.find(">", last.end()) + 1 or end
            else:
                endless.add(name)
                at = end if name in ("script", "style", "textarea", "title") else at
            continue
        closes = CLOSES.get(name) or (CLOSES["p"] if name in CLOSE_P else None)
        if closes:
            scope = open_.stack[-1][5]
            lowest = scope if name in ("li", "dt", "dd", "tr", "td", "th") and scope and open_.stack[scope][0] in closes else open_.outermost(closes, scope)
            if lowest:
                open_.cut(lowest)
        _, path, out, content, element, _ = open_.stack[-1]
        marked, label = _excluded(name, attributes, content > 0)
        if name in CONTENT and not content and not (out or marked):
            contents += 1
            content = contents
        if not attributes.endswith("/") or name in INLINE:
            open_.push(name, paths.setdefault((path, label), len(paths) + 1), out or marked, content, elements.add(name, element))
    return found, elements


def _path_nodes(with_text: list[_Node]) -> list[_Node]:
    """The nodes of the paths that reach the threshold."""
    paths: dict[int, list[float]] = {}
    for n in with_text:
        sums = paths.setdefault(n.path, [0.0, 0.0, 0.0])
        sums[0] += len(n.text.strip())
        sums[1] += len(_MARKS.findall(n.text))
        sums[2] += 1
    text_ratio = np.array([paths[n.path][0] / paths[n.path][2] for n in with_text])
    mark_ratio = np.array([paths[n.path][1] / paths[n.path][2] for n in with_text])
    kernel = np.array([0.25, 0.5, 0.25])
    smooth = lambda x: np.convolve(np.pad(x, 1, mode="edge"), kernel, mode="valid")
    fused = smooth(text_ratio) * (1 + smooth(mark_ratio)) * np.array([CONTENT_WEIGHT if n.content else 1 for n in with_text])
    weight = dict.fromkeys(paths, 0.0)
    for n, f in zip(with_text, fused, strict=True):
        weight[n.path] += float(f) / paths[n.path][2]
    level = min(max(weight.values()), float(fused.std()))
    return [n for n in with_text if weight[n.path] >= level]


def _chosen(found: list[_Node], elements: _Elements) -> list[_Node]:
    """The nodes of the content, by path ratios."""
    inside = [n for n in found if not n.out]
    with_text = [n for n in inside if n.text.strip()]
    if not with_text:
        return []
    boxes, parents, names = elements.boxes, elements.parents, elements.names
    own = {boxes[n.element] for n in _path_nodes(with_text)}
    top = elements.common(min(own), max(own))  # numbers follow the page, so the others lie between
    around = top
    while around and names[around] not in CONTENT:
        around = elements.above(around)
    top = around or top
    texts, below = [0] * len(names), [0] * len(names)
    for n in with_text:
        texts[boxes[n.element]] += 1
    for e in range(len(names) - 1, -1, -1):
        below[e] += texts[e]
        if e:
            below[parents[e]] += below[e]
    while top and names[top] not in CONTENT and below[up := elements.above(top)] == below[top] + texts[up]:
        top = up
    if names[top] in PAGE and top not in own:
        return _parts(inside, elements, top, own)
    under = [e == top for e in range(len(names))]
    for e in range(top + 1, len(names)):
        under[e] = under[parents[e]]
    return [n for n in inside if under[n.element]]


def _parts(inside: list[_Node], elements: _Elements, top: int, own: set[int]) -> list[_Node]:
    """The nodes in those containers directly in top that hold containers of own, between them, and in top itself."""
    part = list(range(len(elements.names)))
    for e in range(1, len(part)):
        box = elements.boxes[e]
        part[e] = part[box] if box != e else e if e <= top or elements.above(e) <= top else part[elements.above(e)]
    held = {part[box] for box in own}
    at = [i for i, n in enumerate(inside) if part[n.element] in held]
    return [n for i, n in enumerate(inside) if at[0] <= i <= at[-1] or part[n.element] == top]


def main_text(page: str | None) -> str:
    """The article's text."""
    if not page:
        return ""
    blocks: dict[int, list[str]] = {}
    for n in _chosen(*nodes(page)):
        blocks.setdefault(n.block, []).append(n.text)
    texts = (_SPACE.sub(" ", html.unescape("".join(parts))).strip() for parts in blocks.values())
    return " ".join(t for t in texts if t)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page) for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages(page_id, url, html)."""
    small_batches(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
