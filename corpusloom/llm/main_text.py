"""Main text of HTML pages by tree scoring.

A page becomes a tree. Menus, headers, footers, sidebars, notices, adverts, forms, reader comments and what is never
shown are cut off, by element and by the words of class, id and role. Every paragraph of the rest passes points to its
ancestors, by its length and its commas, halved at each further level; a container's points are discounted by the share
of its text that is in links. The best container, or the outermost <article> or <main> around it, is kept whole, with
all of its siblings, bare text too, that have few links or score well themselves.

Text: character references are decoded, white space inside a block is one space, blocks are trimmed and joined in page
order by one newline. A line break counts as white space.

Words of class, id and role cut an element where they name it: the last word of a name counts, behind parts such as
"-list" or "-wrapper"; so "social-links" is cut and "social-history" is not, and what holds the page's <h1> or <main> stays.
A form stays where it holds most of the page's text, without its controls.

Defined results: null and blank pages, and pages without shown text, give ""; unclosed and crossed elements are closed
where their parent ends, and an inline end tag closes nothing beyond a block; a quote opens an attribute's value only right
after "=", and a tag that the page's end cuts off is no text; a page takes time in proportion to its length; pages are handled alone, so ties, repeated rows and empty tables need no rule, and of equally
good containers the first in the page is taken; columns with an output's name are replaced, others kept.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.runtime import quoted

# Names of HTML elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg annotation annotation-xml object audio video canvas select".split())
BLOCKS = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address details summary hgroup header footer aside nav form fieldset hr center".split()
)
CUT = frozenset("head nav footer aside fieldset button input label dialog menu".split())
PARAGRAPHS = frozenset("p pre blockquote td th li dd dt h1 h2 h3 h4 h5 h6 figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CLOSES_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: What a start tag closes, and the elements beyond which it closes nothing.
SAME_KIND = {"li": ("li", ("ul", "ol")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
#: Words of class, id or role that mark what is not the article.
NOT_ARTICLE = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside rail ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner notice alert cookie cookies consent gdpr popup modal overlay comment comments commentlist respond reply replies disqus share sharing social related recommended newsletter subscribe subscription signup login search searchbox pagination pager toolbar widget complementary contentinfo skip paywall dialog".split()
)
#: Words at the end of a name that say nothing of what it names, and beginnings that tell of a layout only.
PARTS = frozenset(
    "container wrapper wrap box area block section bar link links list item items button buttons icon icons inner outer form slot unit left right top bottom main primary secondary post posts content body text group panel row col column title".split()
)
LAYOUT = frozenset("has with no without is".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
UNSHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

_CLOSERS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in RAW}


class Node:
    __slots__ = ("links", "name", "named", "parent", "points", "size", "parts")

    def __init__(self, name: str, parent: Node | None):
        self.name, self.parent, self.parts = name, parent, []
        self.points, self.size, self.links = 0.0, 0, 0
        self.named = False  # its class, id or role names no part of the article


def attributes_of(raw: str) -> dict[str, str]:
    """Attributes by name; of repeated ones the first."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def is_hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(UNSHOWN.search(attributes.get("style", "")))


def names_other_part(attributes: dict[str, str]) -> bool:
    """Whether a name in class, id or role is that of something beside the article."""
    for which in ("class", "id", "role"):
        for name in attributes.get(which, "").split():
            words = [w.lower() for w in WORD.findall(name)]
            if not words or words[0] in LAYOUT:
                continue
            own = len(words)
            while own and words[own - 1] in PARTS:
                own -= 1
            if own and words[own - 1] in NOT_ARTICLE and not (words[own - 1] == "header" and words[0] in ("article", "entry", "post", "story")):
                return True
    return False


class Open:
    """The open elements, with the places of each name, so that no search goes through the whole stack."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}
        self.cut: list[int] = []  # places of elements that are cut
        self.articles = 0

    def push(self, node: Node, cut: bool) -> None:
        self.places.setdefault(node.name, []).append(len(self.stack))
        if cut:
            self.cut.append(len(self.stack))
        elif node.name in ("article", "main"):
            self.articles += 1
        self.stack.append(node)

    def close_from(self, place: int) -> None:
        """Close the element at a place and all in it."""
        while len(self.stack) > place:
            node = self.stack.pop()
            self.places[node.name].pop()
            if self.cut and self.cut[-1] == len(self.stack):
                self.cut.pop()
            elif node.name in ("article", "main"):
                self.articles -= 1

    def last(self, names) -> int:
        """The innermost place of any of the names, 0 if none is open."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def first_behind(self, names, place: int) -> int:
        """The outermost place of any of the names behind a place, 0 if there is none."""
        behind = [p[k] for n in names if (p := self.places.get(n)) and (k := bisect.bisect_right(p, place)) < len(p)]
        return min(behind, default=0)


def parsed(page: str) -> Node:
    """The tree of what may be shown."""
    root = Node("#root", None)
    now = Open(root)
    at = 0
    while True:
        found = TOKEN.search(page, at)
        text = page[at : found.start() if found else len(page)]
        above = now.stack[-1]
        if text and not now.cut:
            above.parts.append(html.unescape(text))
        if not found:
            return root
        at = found.end()
        if found[1] is not None and not now.cut:
            above.parts.append(found[1])
        elif found[2]:
            name = found[2].lower()
            place = now.last([name])
            if place and (name in BLOCKS or place > now.last(BLOCKS)):
                now.close_from(place)
            elif name in ("p", "br") and not place and not now.cut:
                above.parts.append(Node(name, above))
        elif found[3]:
            name, raw = found[3].lower(), found[4]
            if name in RAW:
                if not raw.endswith("/"):
                    closing = _CLOSERS[name].search(page, at)
                    at = closing.end() if closing else len(page)
                if not now.cut and name not in ("script", "style"):
                    above.parts.append(" ")
                continue
            closed = SAME_KIND.get(name) or (("p", ("button", "td", "th", "table")) if name in CLOSES_P else None)
            if closed and (place := now.first_behind(closed[0].split(), now.last(closed[1]))):
                now.close_from(place)
                above = now.stack[-1]
            node = Node(name, above)
            if name in VOID:
                if not now.cut:
                    above.parts.append(node)
                continue
            attributes = attributes_of(raw) if raw and not now.cut else {}
            cut = bool(now.cut) or name in CUT or (name == "header" and not now.articles) or is_hidden(attributes)
            if not cut:
                node.named = name not in ("html", "body", "article", "main") and names_other_part(attributes)
                above.parts.append(node)
            now.push(node, cut)


def in_page_order(root: Node) -> list[Node]:
    """A tree's nodes, parents before children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(x for x in reversed(node.parts) if isinstance(x, Node))
    return out


def without_other_parts(root: Node) -> list[Node]:
    """The nodes that stay once elements named as no article, and forms that hold less than half of the text, are emptied."""
    nodes = in_page_order(root)
    size: dict[Node, int] = {}
    titled: set[Node] = set()
    for node in reversed(nodes):
        if node.name in ("h1", "main"):
            titled.add(node)
        if node in titled and node.parent is not None:
            titled.add(node.parent)
        own = sum(len(p) if isinstance(p, str) else size[p] for p in node.parts)
        size[node] = 0 if node.named and node not in titled else own
    for node in nodes:
        if (node.named and node not in titled) or (node.name == "form" and 2 * size[node] < size[root]):
            node.parts = []
    return in_page_order(root)


def blocks(node: Node) -> list[str]:
    """The blocks of text below a node, in page order."""
    out: list[str] = []
    held: list[str] = []
    todo: list[Node | str | None] = [node]

    def flush() -> None:
        text = " ".join("".join(held).split())
        if text:
            out.append(text)
        held.clear()

    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            held.append(x)
        elif x.name == "br":
            held.append(" ")
        else:
            if x.name in BLOCKS:
                flush()
                todo.append(None)
            todo.extend(reversed(x.parts))
    flush()
    return out


def scored(nodes: list[Node]) -> None:
    """Fill in each node's text and link sizes, and the points that its paragraphs pass to ancestors."""
    for node in reversed(nodes):
        own = [p for p in node.parts if isinstance(p, str)]
        text = sum(len("".join(p.split())) for p in own)
        node.size += text
        if node.name == "a":
            node.links = node.size
        direct = node.name in PARAGRAPHS or (node.name in BLOCKS and text >= 25)
        if direct and node.size:
            commas = sum(p.count(",") + p.count("，") + p.count("、") for p in own) + sum(c for c in (commas_of(p) for p in node.parts if isinstance(p, Node)))
            points = (1 + commas + min(node.size / 100, 3)) * (1 - node.links / node.size)
            if node.name in HEADINGS:
                points = min(points, 0.5)
            above, share = node.parent, 1.0
            if node.name in BLOCKS - PARAGRAPHS:
                node.points += points
                share = 0.5
            while above is not None and share > 0.01:
                above.points += points * share
                above, share = above.parent, share / 2
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.links += node.links


def commas_of(node: Node) -> int:
    """Commas of inline text below a paragraph."""
    total, todo = 0, [node]
    while todo:
        x = todo.pop()
        if x.name in BLOCKS:
            continue
        for p in x.parts:
            if isinstance(p, str):
                total += p.count(",")
            else:
                todo.append(p)
    return total


def rating(node: Node) -> float:
    bonus = 1.25 if node.name in ("article", "main") else 1.0
    return node.points * bonus * (1 - node.links / node.size if node.size else 0)


def runs(parts: list[Node | str]) -> list[list[Node | str]]:
    """Each element that is or holds blocks by itself, and the text and inline elements between two of them together."""
    out: list[list[Node | str]] = []
    inline = False
    for x in parts:
        was, inline = inline, isinstance(x, str) or (x.name not in BLOCKS and x.points <= 0)
        if was and inline:
            out[-1].append(x)
        else:
            out.append([x])
    return out


def main_blocks(page: str | None) -> list[str]:
    """The blocks of a page's main text."""
    if not page or page.isspace():
        return []
    root = parsed(page)
    nodes = without_other_parts(root)
    scored(nodes)
    containers = [n for n in nodes if n.points > 0 and n.name not in PARAGRAPHS]
    if not containers:
        return blocks(root)
    best = max(containers, key=rating)
    base = above = best
    while above is not None:
        if above.name in ("article", "main"):
            base = above
        above = above.parent
    if base.parent is None:
        return blocks(base)
    out, least = [], max(1.0, 0.2 * rating(best))
    for group in runs(base.parent.parts):
        size = sum(len("".join(x.split())) if isinstance(x, str) else x.size for x in group)
        links = sum(x.links for x in group if isinstance(x, Node))
        whole = Node("div", None)
        if base in group or links < 0.25 * size:
            whole.parts = group
        else:
            whole.parts = [x for x in group if isinstance(x, str) or x.links < 0.25 * x.size or rating(x) >= least]
        out += blocks(whole)
    return out


def extract_main_text(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] | None = None, output: str = "text") -> DataFrame:
    """Add the main text of every whole page, and its number of code points as n_chars."""
    outputs = (output, "n_chars")
    kept = [f for f in df.schema.fields if (keep is None or f.name in keep) and f.name not in outputs]
    source = df.select(*(F.col(quoted(f.name)).alias(f"c{i}") for i, f in enumerate(kept)), F.col(quoted(html_col)).cast("string").alias("given"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n".join(main_blocks(page.as_py())) for page in batch.column(batch.num_columns - 1)]
            arrays = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[*(f.name for f in kept), *outputs])

    return source.mapInArrow(run, T.StructType([*kept, T.StructField(output, T.StringType()), T.StructField("n_chars", T.LongType())]))
