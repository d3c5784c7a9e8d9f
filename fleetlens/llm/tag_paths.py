r"""Main text of web pages by tag-path ratios.

A page is read into text nodes, each with the path of open elements above it. Per path, text length and punctuation are
summed over all its nodes and divided by their number: the path's ratios. The fused ratio, length times punctuation, is
smoothed along the page with a Gaussian and compared with a threshold from its mean; a path is content if its nodes pass
with most of their text. The home of the text is the deepest container that holds all of the content, or what its articles
share if they hold most of it. In it all paths count that are content, headings, or below such; in an article blocks with
a node of such a path, whatever its formatting, and pieces of lists, tables, quotations and programs that are not links.
Nodes below menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments have no ratio at all: their paths are marked by element or by class,
id or role, unless such an element holds the page itself.

Blocks of the page become lines: character references are decoded, white space inside a block is one space.

Defined cases: a null or empty page, or one without text, gives the empty text; broken markup (unclosed elements, a page
that stops inside a tag or comment) is read as far as it goes; null ids and repeated rows are kept; an empty table gives
an empty result; extra columns pass through. Pages are read whole.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fleetlens.llm.scratch import arrow_map, extended, slices

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<[/a-zA-Z][^>]*(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea svg math iframe object canvas video audio select datalist title head".split())
OPAQUE = frozenset("script style textarea title noscript iframe template".split())  # no elements inside: read to the end tag
MARKED = frozenset("nav header footer aside form button dialog menu fieldset label".split())
WRAPPERS = frozenset("form fieldset header".split())  # of the marked ones, those that may hold a whole page
IN_HEAD = frozenset("title meta link base basefont bgsound script style noscript template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
REGIONS = frozenset("article main".split())
PIECES = frozenset("li dt dd th td caption figcaption blockquote pre".split())  # short ones are text of an article too
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
# An open element of the value is closed by a start tag of the key.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead"), "tfoot": ("tr", "td", "th", "tbody"),
}
SCOPES = frozenset("table ul ol dl article section div body html main blockquote".split())
# Names of parts that are not the article: a class, id or role that is, begins or ends with such a word.
WORDS = (
    r"(?:ads?|adverts?|advertisement|advertising|adsense|sponsor(?:ed|s)?|promo(?:tion|s)?|banner|nav(?:bar|igation)?|menu|breadcrumbs?|crumbs?|"
    r"sidebar|side|aside|rail|footer|foot|masthead|header|topbar|toolbar|comments?|commentlist|respond|replies|discussion|disqus|cookies?|consent|gdpr|notices?|"
    r"alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|recommendations|more-posts|tags|"
    r"tagcloud|widget|pagination|pager|search|skip|copyright|legal|disclaimer|contentinfo|complementary|dialog)"
)
PART = re.compile(rf"{WORDS}(?:$|[_-])|.*[_-]{WORDS}$", re.I | re.S)
HEADER = re.compile(r"header(?:$|[_-])|.*[_-]header$", re.I | re.S)
# A class that tells a state of the page or of what it holds is not the name of a part.
STATE = re.compile(
    r"(?:has|have|with|without|no|not|non|is|hide|show|shows|enable|disable|supports?|js)[_-]|.*[_-](?:open|opened|closed|on|off|enabled|disabled|active|"
    r"inactive|visible|hidden|allowed|page|layout|none|collapsed|expanded|fixed|sticky)$", re.I | re.S
)
COMMENTS = re.compile(r"(?:.*[_-])?(?:comments?|commentlist|respond|replies|discussion|disqus)(?:$|[_-])", re.I | re.S)
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？؟।]")


THRESHOLD = 0.1  # of the page's mean fused ratio


class Node:
    __slots__ = ("path", "text", "block", "region", "heading", "container", "marks")

    def __init__(self, path: str, text: str, block: int, region: tuple[int, ...], heading: bool, container: str, marks: tuple["Mark", ...]):
        self.path, self.text, self.block, self.region, self.heading, self.container, self.marks = path, text, block, region, heading, container, marks


class Mark:
    """A marked element: whether it may turn out to hold the page itself, and whether it is named as reader comments."""

    __slots__ = ("wrapper", "comments")

    def __init__(self, wrapper: bool, comments: bool = False):
        self.wrapper, self.comments = wrapper, comments


def _marked(name: str, attributes: str, inside_region: bool) -> Mark | None:
    if name in MARKED:
        # The header of an article holds its title; that of the page does not.
        return None if name == "header" and inside_region else Mark(name in WRAPPERS)
    if not attributes or name in ("body", "html", "article", "main"):
        return None
    mark = None
    for found in ATTRIBUTE.finditer(attributes):
        kind, value = found[1].lower(), next((v for v in found.groups()[1:] if v is not None), "")
        if kind == "hidden" or kind == "aria-hidden" and value.strip().lower() == "true" or kind == "style" and "display:none" in value.replace(" ", "").lower():
            mark = mark or Mark(True)
        elif kind in ("class", "id", "role"):
            parts = [token for token in value.split() if PART.match(token) and not STATE.match(token)]
            if parts and not (inside_region and all(HEADER.match(token) and not PART.match(re.sub(r"(?i)header", "", token)) for token in parts)):
                mark = Mark(True, bool(mark and mark.comments) or any(COMMENTS.match(token) for token in parts))
    return mark


def _unmarked(nodes: list[Node]) -> list[Node]:
    """Nodes outside marked parts; a marked element that holds the page is none.

    It does if no article is outside marked elements and its own articles have more text than is outside, or it has most of
    the text: four fifths, or more than half and the only title. Reader comments do only if no text is outside. Menus,
    footers and the like by element never do.
    """
    if not any(node.marks for node in nodes):
        return nodes
    inside, articles, titled = Counter(), Counter(), set()
    total = free = 0
    free_article = free_title = False
    for node in nodes:
        if not all(mark.wrapper for mark in node.marks):
            continue
        size, title = len(node.text.strip()), "h1" in node.path.split(">")
        total += size
        if not node.marks:
            free += size
            free_article, free_title = free_article or bool(node.region), free_title or title
        for mark in node.marks:
            inside[mark] += size
            articles[mark] += size if node.region else 0
            if title:
                titled.add(mark)

    def page(mark: Mark) -> bool:
        if not mark.wrapper or free_article or mark.comments and free:
            return False
        most = 2 * inside[mark] > total and (inside[mark] >= 4 * free or mark in titled and not free_title)
        return most or not mark.comments and articles[mark] > free

    pages = {mark for mark in inside if page(mark)}
    return [node for node in nodes if all(mark in pages for mark in node.marks)]


def read_nodes(page: str) -> list[Node]:
    """Text nodes outside marked parts, in page order; with the number of its block and the regions it is in."""
    nodes: list[Node] = []
    names: list[str] = []  # open elements
    marks: list[tuple[Mark, ...] | None] = [()]  # the marked elements at or above; none where nothing is text
    regions: list[tuple[int, ...]] = [()]
    line: dict[tuple[Mark, ...], Node] = {}  # the last nodes of the block
    block = region_count = at = 0
    end = len(page)

    def push(name: str, attributes: str) -> None:
        nonlocal region_count
        above = marks[-1]
        mark = None if above is None or name in RAW else _marked(name, attributes, bool(regions[-1]))
        marks.append(None if above is None or name in RAW else (*above, mark) if mark else above)
        names.append(name)
        if name in REGIONS and marks[-1] is not None:
            region_count += 1
            regions.append((*regions[-1], region_count))
        else:
            regions.append(regions[-1])

    def pop(to: int) -> None:
        del names[to:], marks[to + 1 :], regions[to + 1 :]

    def text_at(begin: int, stop: int) -> None:
        text = page[begin:stop]
        if names and names[-1] == "head" and text.strip():  # text ends a head that was not closed
            pop(len(names) - 1)
        if text and marks[-1] is not None:
            if text.strip():
                cut = next((i for i in range(len(names) - 1, -1, -1) if names[i] not in INLINE), -1)
                outer = [n for n in names if n not in INLINE]
                container = ">".join(outer[:-1] if cut >= 0 else outer)
                nodes.append(Node(">".join(names), text, block, regions[-1], any(n in HEADINGS for n in names), container, marks[-1]))
                line[marks[-1]] = nodes[-1]
            elif marks[-1] in line:
                line[marks[-1]].text += " "

    while at < end:
        found = TOKEN.search(page, at)
        if found is None:
            text_at(at, end)
            break
        text_at(at, found.start())
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if name not in INLINE:
            block += 1
            line.clear()
        elif name == "br":
            for node in line.values():
                node.text += " "
        if found[1]:
            if name in names:
                to = len(names) - 1 - names[::-1].index(name)
                # An inline end tag closes nothing beyond its block.
                if name not in INLINE or all(n in INLINE for n in names[to:]):
                    pop(to)
            continue
        if names and names[-1] == "head" and name not in IN_HEAD:  # its end tag may be left out
            pop(len(names) - 1)
        if name not in INLINE and "p" in names:
            to = len(names) - 1 - names[::-1].index("p")
            if not any(n in SCOPES for n in names[to:]):
                pop(to)
        if name not in INLINE:  # formatting that was never closed does not run on into new blocks
            while names and names[-1] in INLINE and names[-1] != "a":
                pop(len(names) - 1)
        for other in CLOSES.get(name, ()):
            for to in range(len(names) - 1, -1, -1):
                if names[to] == other:
                    pop(to)
                    break
                if names[to] in SCOPES:
                    break
        if name in VOID or found[3].rstrip().endswith("/") and name in ("svg", "path", "rect", "use"):
            continue
        if name in OPAQUE:
            close = re.compile(rf"</{re.escape(name)}\s*>?", re.I).search(page, at)
            at = close.end() if close else end
            continue
        push(name, found[3])
    return _unmarked(nodes)


def _smoothed(values: np.ndarray, radius: int = 1) -> np.ndarray:
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / max(radius, 1)) ** 2)
    spread = np.convolve(values, kernel, mode="full")[radius : radius + len(values)]
    return spread / np.convolve(np.ones(len(values)), kernel, mode="full")[radius : radius + len(values)]


def select(nodes: list[Node]) -> list[Node]:
    """The content nodes, in page order."""
    if not nodes:
        return []
    number = {path: i for i, path in enumerate(sorted({node.path for node in nodes}))}
    of = np.array([number[node.path] for node in nodes])
    chars = np.array([len(node.text.strip()) for node in nodes], float)
    marks = np.array([len(PUNCTUATION.findall(node.text)) for node in nodes], float)
    count = np.bincount(of)
    length, points = np.bincount(of, chars) / count, np.bincount(of, marks) / count
    fused = (length * (1 + points))[of]
    passed = np.maximum(_smoothed(fused), fused) >= THRESHOLD * np.average(fused, weights=chars)
    content = (np.bincount(of, chars * passed) >= 0.5 * np.bincount(of, chars))[of]

    # Articles hold the text if they hold most of the content; what several of them share is around them.
    places = [node.region for node in nodes]
    held = [place for place, good in zip(places, content) if good and place]
    if 2 * sum((chars * content)[[bool(place) for place in places]]) >= sum(chars * content):
        home = commonprefix(held)
        # A block is kept whole: for content, also of its path with other formatting, as a heading or piece; not for links.
        outer = [tuple(n for n in node.path.split(">") if n not in INLINE) for node in nodes]
        related = {path for path, good in zip(outer, content) if good}
        kept: dict[int, bool] = {}
        for node, path, good in zip(nodes, outer, content):
            plain = "a" not in node.path.split(">") and (path in related or not PIECES.isdisjoint(path))
            kept[node.block] = kept.get(node.block, False) or good or node.heading or plain
        # A title may stand above the article, in a region around it.
        return [
            node for node in nodes
            if node.region and node.region[: len(home)] == home and kept[node.block]
            or node.region and node.region == home[: len(node.region)] and "h1" in node.path.split(">")
        ]
    places = [tuple(node.container.split(">")) if node.container else () for node in nodes]
    home = commonprefix([place for place, good in zip(places, content) if good])
    related = {node.path for node, good in zip(nodes, content) if good or node.heading}
    # A title may stand above the container.
    return [
        node for node, place in zip(nodes, places)
        if place[: len(home)] == home and any(path in related for path in accumulate(node.path.split(">"), "{}>{}".format))
        or place == home[: len(place)] and "h1" in node.path.split(">")
    ]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    blocks: dict[int, list[str]] = {}
    for node in select(read_nodes(page)):
        blocks.setdefault(node.block, []).append(node.text)
    lines = (SPACE.sub(" ", html.unescape("".join(parts))).strip() for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def with_main_text(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` in place of the html; columns of these names are replaced."""
    others = [c for c in pages.columns if c.lower() not in ("text", "n_chars", html_column.lower())]
    kept = pages.select(*[F.col(f"`{c}`") for c in others], F.col(html_column).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "html"):
                texts = [main_text(page) for page in piece.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in others), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[*others, "text", "n_chars"],
                )

    return arrow_map(kept, run, extended([f for f in kept.schema.fields if f.name != "html"], "text string, n_chars long"))
