"""Main text of web pages by tag-path ratios.

A page is read as a sequence of text nodes with their root-to-leaf tag paths (class and id
names are part of a path). Per path, text length and punctuation are added up and divided by
the path's number of nodes; both ratios are smoothed over the sequence of paths, fused into
one score, weighed down by the share of linked text and by what the path's elements say of themselves
(menus, headers, footers, asides, forms; names such as advert, comment, notice, sidebar, which say nothing where
the element holds more than half of the page's text), and compared with a threshold relative
to the page's spread. Paths above it are content nodes, and all of them are kept. So are, short headings
included, the nodes that nothing weighs down beside them in the content area: the deepest element
that holds nine tenths of the content nodes' text, and the elements around it short of the body
as long as nothing is in them that is weighed down or a list of links. What is never shown (scripts, styles, form controls) is not text.

Paths are a tree of parent pointers, and all that is added up or handed down takes one pass over it, so a page
takes time in proportion to its length, however deep it is nested.

Defined cases: a null or empty page, and one without text, give an empty text. Markup that
isn't closed ends with its block. Where no path is weighed up to the threshold there is no text. Equal scores are on the
same side of the threshold. Nothing is shortened. Repeated rows each get their own
row. Only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_TAG = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)((?:[^\"'<>]|\"[^\"<]*\"|'[^'<]*')*)>|[!?/][^>]*>?)")
_NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")

_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDS = {"ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "select", "article", "main", "section", "div", "body", "blockquote", "figure", "aside", "nav", "header", "footer"}
#: Elements whose text is not shown as text of the page.
_HIDDEN = {"button", "select", "option", "head", "template", "svg", "canvas", "object", "audio", "video", "datalist"} | _RAW
#: Elements, and below the names of others, that are seldom content: their scores count so much of what they are.
_SELDOM = {"nav", "header", "footer", "aside", "form", "dialog", "menu", "fieldset"}
WEIGHT = 0.02
_AREA = {"article", "main"}
_NAMED = re.compile(r"(?:^|[-_\s])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|sidebar|side-bar|comments?|comment-list|disqus|respond|notice|cookies?|consent|gdpr|newsletter|subscribe|subscription|popup|modal|overlay|menu|nav|navbar|navigation|breadcrumbs?|header|footer|masthead|toolbar|share|sharing|social|related|recommended|widget|login|signup|alert|dialog|complementary|contentinfo|search|pagination|pager)(?:$|[-_\s])", re.I)
_LEAVES = _INLINE | {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in _RAW}
_BODY = re.compile(r"(?:^|[-_\s])(?:content|article|post|entry|story|text|body|main)(?:$|[-_\s])", re.I)


class Path:
    """A root-to-leaf tag path: a node of the tree of paths, and what was added up for it."""

    __slots__ = ("parent", "tag", "hidden", "named", "linked", "weight", "chars", "marks", "links", "nodes", "below", "kids")

    def __init__(self, parent: Path | None, tag: str, names: str):
        self.parent, self.tag, self.kids = parent, tag, {}
        self.hidden = tag in _HIDDEN or (parent is not None and parent.hidden)
        self.linked = tag == "a" or (parent is not None and parent.linked)
        #: Whether the element names itself something else than content.
        self.named = bool(names) and tag not in ("html", "body") and bool(_NAMED.search(names)) and not (tag in _AREA and _BODY.search(names))
        self.weight = 1.0
        self.chars = self.marks = self.links = self.nodes = self.below = 0

    def kid(self, tag: str, names: str, paths: list[Path]) -> Path:
        found = self.kids.get((tag, names))
        if found is None:
            found = self.kids[tag, names] = Path(self, tag, names)
            paths.append(found)
        return found


class Element:
    """An element of the page, and how much content it holds."""

    __slots__ = ("parent", "path", "below", "odd", "inside")

    def __init__(self, parent: Element | None, path: Path):
        self.parent, self.path, self.below, self.odd, self.inside = parent, path, 0, 0, False


def parse(page: str) -> tuple[list[Path], list[Element], list[tuple[Element, str, bool]]]:
    """All paths and all elements, each after its parent, and (element, text, whether a block starts) of the text nodes."""
    paths = [Path(None, "", "")]
    elements = [Element(None, paths[0])]
    stack, out = elements[:], []
    opened: dict[str, int] = {}  # open elements by tag
    at, broke = 0, True

    def text(to: int) -> None:
        nonlocal broke
        if to <= at:
            return
        raw = page[at:to]
        if not raw.strip("\x20\t\n\x0b\x0c\r"):
            if out and not broke:
                out.append((out[-1][0], " ", False))
            return
        out.append((stack[-1], entities.unescape(raw) if "&" in raw else raw, broke))
        broke = False

    def close(i: int) -> None:
        for x in stack[i:]:
            opened[x.path.tag] -= 1
        del stack[i:]

    while True:
        m = _TAG.search(page, at)
        if m is None:
            text(len(page))
            break
        text(m.start())
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0] == "<!--":
                end = page.find("-->", at)
                at = len(page) if end < 0 else end + 3
            continue
        tag = tag.lower()
        if tag not in _INLINE and tag not in ("script", "style", "noscript"):
            broke = True
        if m[1]:
            for i in range(len(stack) - 1, 0, -1) if opened.get(tag) else ():
                if stack[i].path.tag == tag:
                    close(i)
                    break
                if tag in _INLINE and stack[i].path.tag not in _INLINE:
                    break  # an inline end does not close a block
            continue
        if tag in _VOID:
            continue
        if tag in _RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag not in _INLINE:
            ends = _ENDS.get(tag, frozenset())
            for i in range(len(stack) - 1, 0, -1) if opened.get("p") or any(opened.get(x) for x in ends) else ():
                name = stack[i].path.tag
                if name == "p" or name in ends:
                    close(i)
                    if name != "p" or not ends:
                        break
                elif name in _HOLDS:
                    break
        names = " ".join(x[0] or x[1] or x[2] for x in _NAME.findall(m[3])) if "=" in m[3] else ""
        stack.append(Element(stack[-1], stack[-1].path.kid(tag, names, paths)))
        elements.append(stack[-1])
        opened[tag] = opened.get(tag, 0) + 1
        if m[3].endswith("/") and tag in ("svg", "path", "use"):
            close(len(stack) - 1)
    return paths, elements, out


def add_up(paths: list[Path], nodes: list[tuple[Element, str, bool]]) -> None:
    """Text length, punctuation and linked text of each path, and how much its elements weigh it down."""
    for element, text, _ in nodes:
        path = element.path
        if not path.hidden:
            n = len(text.strip())
            path.chars += n
            path.nodes += 1
            path.marks += len(_PUNCTUATION.findall(text))
            path.links += n if path.linked else 0
    for path in paths:
        path.below = path.chars
    hand_up(paths)
    for path in paths[1:]:
        seldom = path.tag in _SELDOM or (path.named and 2 * path.below <= paths[0].below)
        path.weight = path.parent.weight * (WEIGHT if seldom else 1.0)


def hand_up(tree: list[Path] | list[Element]) -> None:
    """Adds what each node has below it to its parent's, from the leaves to the root."""
    for x in reversed(tree[1:]):
        x.parent.below += x.below


def scores(paths: list[Path]) -> dict[Path, float]:
    """Fused, smoothed score of each path that has text, in their order on the page."""
    some = [p for p in paths if p.nodes and p.chars]
    length = [math.log1p(p.chars) * math.log1p(p.chars / p.nodes) for p in some]
    marks = [math.log1p(p.marks) + math.log1p(p.marks / p.nodes) for p in some]
    out = {}
    for k, p in enumerate(some):
        near = [(w, k + d) for d, w in ((-1, 0.25), (0, 0.5), (1, 0.25)) if 0 <= k + d < len(some)]
        total = sum(w for w, _ in near)
        a, b = (sum(w * x[j] for w, j in near) / total for x in (length, marks))
        out[p] = a * (1 + b) * (1 - p.links / p.chars) * p.weight
    return out


def threshold(found: list[float]) -> float:
    mean = sum(found) / len(found)
    spread = math.sqrt(sum((x - mean) ** 2 for x in found) / len(found))
    return max(min(spread, max(found) * 0.5), max(found) * 0.1) if len(found) > 1 else 0.0


def main_text(page: str | None) -> str:
    if not page:
        return ""
    paths, elements, nodes = parse(page)
    add_up(paths, nodes)
    fused = scores(paths)
    if not fused:
        return ""
    least = threshold(list(fused.values()))
    content = {p for p, x in fused.items() if x >= least}
    area = content_area(elements, nodes, content)
    for e in elements:
        e.inside = e is area or (e.parent is not None and e.parent.inside)
    pieces, gap = [], False
    for e, x, b in nodes:
        if e.path in content or (e.inside and e.path.weight == 1.0 and not e.path.hidden):
            pieces.append((" " if b or gap else "") + x)
            gap = False
        else:
            gap = True  # a node after a dropped one starts a block
    return _SPACE.sub(" ", "".join(pieces)).strip(" ")


def content_area(elements: list[Element], nodes: list[tuple[Element, str, bool]], content: set[Path]) -> Element:
    """The deepest element that holds nine tenths of the content's text; a paragraph or heading counts as part of what is around it."""
    for e, text, _ in nodes:
        e.below += len(text.strip()) if e.path in content else 0
        e.odd += not e.path.hidden and (e.path.weight < 1 or (2 * e.path.links > e.path.chars and e.path not in content))
    hand_up(elements)
    for e in reversed(elements[1:]):
        e.parent.odd += e.odd
    total, area = elements[0].below, elements[0]
    for e in elements:
        if e.parent is area and 10 * e.below >= 9 * total and e.path.tag not in _LEAVES:
            area = e
    while area.parent is not None and area.parent.odd == area.odd and area.parent.path.tag not in ("", "html", "body"):
        area = area.parent
    return area


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = [main_text(x.as_py()) for x in batch.column("html")]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    types = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
