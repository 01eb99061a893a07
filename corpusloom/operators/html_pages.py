"""Pages of HTML to plain text, Markdown and metadata, in Arrow tasks with the standard library's parser."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame

HIDDEN = frozenset("script style noscript".split())
BOILERPLATE = HIDDEN | frozenset("nav header footer aside form iframe svg template button".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BREAKS = frozenset("p div section article main h1 h2 h3 h4 h5 h6 ul ol li table tr br blockquote pre figure dl dt dd title body".split())


class _Walker(HTMLParser):
    """Base: skips the given elements with what is in them."""

    def __init__(self, skip: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.skip, self.hidden = skip, 0

    def handle_starttag(self, tag, attrs):
        if tag in self.skip and tag not in VOID:
            self.hidden += 1
        elif not self.hidden:
            self.begin(tag, dict(attrs))

    def handle_endtag(self, tag):
        if tag in self.skip:
            self.hidden = max(0, self.hidden - 1)
        elif not self.hidden:
            self.end(tag)

    def handle_data(self, data):
        if not self.hidden:
            self.text(data)

    def begin(self, tag, attrs): ...
    def end(self, tag): ...
    def text(self, data): ...


class _Lines(_Walker):
    def __init__(self):
        super().__init__(HIDDEN)
        self.parts: list[str] = []

    def text(self, data):
        self.parts.append(data)

    def begin(self, tag, attrs):
        self.parts.append("\n")

    end = lambda self, tag: self.parts.append("\n")


def plain_lines(html: str | None) -> str:
    """The stripped lines of text that is neither script nor style, blank ones left out."""
    walker = _Lines()
    walker.feed(html or "")
    walker.close()
    return "\n".join(filter(None, (s.strip() for s in "".join(walker.parts).split("\n"))))


#: The most columns and rows that a cell may span (HTML standard).
MOST_COLUMNS, MOST_ROWS = 1000, 65534


def grid(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """Cells with row and column spans as a rectangle, a spanning cell repeated.

    Each column carries down the cell that spans it; rows go on as long as a cell is carried, also behind the last.
    """
    lines: list[dict[int, str]] = []
    carried: dict[int, tuple[str, int]] = {}
    for y in itertools.count():
        if y >= len(rows) and not carried:
            break
        line = {column: text for column, (text, _) in carried.items()}
        after = {column: (text, more - 1) for column, (text, more) in carried.items() if more > 1}
        free = (column for column in itertools.count() if column not in carried)
        column = next(free)
        for text, down, across in rows[y] if y < len(rows) else ():
            down, across = min(down, MOST_ROWS), min(across, MOST_COLUMNS)
            spanned = range(column, column + across)
            line.update(dict.fromkeys(spanned, text))
            if down > 1:
                after.update(dict.fromkeys(spanned, (text, down - 1)))
            column = next(c for c in free if c >= spanned.stop)
        lines.append(line)
        carried = after
    width = max((max(line) for line in lines if line), default=-1) + 1
    return [[line.get(column, "") for column in range(width)] for line in lines]


def table_markdown(rows: list[list[str]]) -> str:
    width = max(map(len, rows), default=0)
    line = lambda r: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ").strip() for c in [*r, *[""] * (width - len(r))]) + " |"
    return "\n".join([line(rows[0]), "| " + " | ".join(["---"] * width) + " |", *map(line, rows[1:])]) if rows and width else ""


class _Markdown(_Walker):
    """Headings, paragraphs, lists, links and tables; collects links, tables and metadata on the way."""

    def __init__(self, base: str):
        super().__init__(BOILERPLATE)
        self.base, self.out, self.links = base, [], set()
        self.tables: list[list] = []
        self.rows: list | None = None
        self.cell: list | None = None
        self.href: str | None = None
        self.meta: dict[str, str] = {}
        self.first_heading: str | None = None
        self.words: list[str] = []
        self.in_title = self.in_h1 = False

    def shown(self) -> str:
        """The visible text, pieces apart."""
        return " ".join(filter(None, self.words))

    def emit(self, s: str) -> None:
        (self.cell[0] if self.cell is not None else self.out).append(s)

    def close_cell(self) -> None:
        """A cell also ends where the next cell or row begins, or its table ends."""
        if self.cell is not None:
            self.rows[-1].append((" ".join("".join(self.cell[0]).split()), self.cell[1], self.cell[2]))
            self.cell = None

    def begin(self, tag, attrs):
        if tag in ("td", "th", "tr") and self.rows:
            self.close_cell()
        if tag == "meta":
            name = attrs.get("property") or attrs.get("name")
            if name and attrs.get("content"):
                self.meta.setdefault(name.lower(), attrs["content"].strip())
        elif tag == "title":
            self.in_title = True
        elif re.fullmatch("h[1-6]", tag):
            self.in_h1 = self.in_h1 or (tag == "h1" and self.first_heading is None)
            self.emit("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.emit("\n- ")
        elif tag == "a":
            self.href = urljoin(self.base, attrs.get("href") or "")
            if self.href.startswith(("http://", "https://")):
                self.links.add(self.href)
            self.emit("[")
        elif tag == "img" and (attrs.get("alt") or "").strip():
            self.emit(f"![{attrs['alt'].strip()}]({urljoin(self.base, attrs.get('src') or '')})")
        elif tag == "table":
            self.rows, self.cell = [], None
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            span = lambda n: max(1, int(attrs[n])) if (attrs.get(n) or "").isdigit() else 1
            self.cell = ([], span("rowspan"), span("colspan"))
        elif tag in BREAKS:
            self.emit("\n" if tag == "br" else "\n\n")

    def end(self, tag):
        if tag == "title":
            self.in_title = False
        elif tag == "h1":
            self.in_h1 = False
            self.emit("\n\n")
        elif tag == "a" and self.href is not None:
            self.emit(f"]({self.href})")
            self.href = None
        elif tag in ("td", "th"):
            self.close_cell()
        elif tag == "table" and self.rows is not None:
            self.close_cell()
            rows, self.rows = grid([r for r in self.rows if r]), None
            self.tables.append(rows)
            self.emit("\n\n" + table_markdown(rows) + "\n\n")
        elif tag in BREAKS:
            self.emit("\n\n")

    def text(self, data):
        if self.in_title:
            self.meta.setdefault("<title>", " ".join(data.split()))
            return
        self.words.append(data.strip())
        if self.in_h1:
            self.first_heading = " ".join(((self.first_heading or "") + " " + data).split())
        self.emit(re.sub(r"\s+", " ", data))


#: Where a page's content is looked for, in this order, and the text that it must have at least.
CONTENT = ("article .entry-content", ".entry-content", ".post-content", ".td-post-content", ".single-content", "article", "main")
LEAST_CONTENT = 80


class _Boxes(HTMLParser):
    """The first element of each selector (a name or a .class, maybe below an ancestor), as a span of the page's source."""

    def __init__(self, source: str, selectors: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.source = source
        self.lines = [0, *(m.end() for m in re.finditer("\n", source))]
        self.wanted = {s: tuple(s.split()) for s in (*selectors, "body")}
        self.spans: dict[str, list[int]] = {}
        self.open: list[tuple[str, frozenset[str], list[str]]] = []
        self.depth: dict[str, int] = {}
        self.texts: list[tuple[int, int]] = []
        self.feed(source)
        self.close()

    def at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        names = frozenset([tag, *("." + c for c in (dict(attrs).get("class") or "").split())])
        mine = []
        for selector, (*above, own) in self.wanted.items():
            if selector not in self.spans and own in names and all(self.depth.get(a) for a in above):
                self.spans[selector] = [self.at(), -1]
                mine.append(selector)
        for name in names:
            self.depth[name] = self.depth.get(name, 0) + 1
        self.open.append((tag, names, mine))

    def handle_endtag(self, tag):
        if not self.depth.get(tag):
            return
        end = self.source.find(">", self.at()) + 1 or len(self.source)
        while self.open:
            name, names, mine = self.open.pop()
            for n in names:
                self.depth[n] -= 1
            for selector in mine:
                self.spans[selector][1] = end
            if name == tag:
                break

    def handle_data(self, data):
        self.texts.append((self.at(), len(data.strip())))


def content_html(html: str, selectors: tuple[str, ...] = CONTENT, least: int = LEAST_CONTENT) -> str:
    """The source of the first selector's element that has enough text, else of the body, else the whole page.

    Of each selector only the first element is looked at. An element that nothing closes goes on to the page's end.
    """
    boxes = _Boxes(html, selectors)
    for selector in (*selectors, "body"):
        if selector not in boxes.spans:
            continue
        start, end = boxes.spans[selector]
        end = len(html) if end < 0 else end
        sizes = [n for at, n in boxes.texts if n and start <= at < end]
        if selector == "body" or sum(sizes) + len(sizes) - 1 >= least:
            return html[start:end]
    return html


NUMBERS = re.compile(r"(?<!\w)\d+(?:[.,:/-]\d+)*(?!\w)")


def page_facts(url: str | None, html: str | None) -> dict:
    """Markdown, metadata, links and counts of one page: metadata of the whole of it, the rest of its content."""
    html = html or ""
    page = _Markdown(url or "")
    page.feed(html)
    page.close()
    content = content_html(html)
    walker = _Markdown(url or "")
    walker.feed(content)
    walker.close()
    body = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(walker.out))).strip()
    tail = urlparse(url or "").path.rstrip("/").rsplit("/", 1)[-1]
    title = page.meta.get("og:title") or page.first_heading or tail
    dates = [page.meta.get(k) for k in ("article:published_time", "article:modified_time")]
    n = len(body)
    status = "no_text_detected" if not n else "insufficient_content" if n < 80 else "ok"
    counts = {"table_count": len(walker.tables), "numeric_tokens": len(NUMBERS.findall(body)), "source_table_count": len(re.findall(r"<table\b", content, re.I)), "source_numeric_tokens": len(NUMBERS.findall(walker.shown()))}
    return {"title": title, "published_at": dates[0], "updated_at": dates[1], "markdown": body, "links": sorted(walker.links), "pdf_links": sorted(u for u in walker.links if re.search(r"\.pdf(?:$|[?#])", u, re.I)), "status": status} | counts


def html_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text): visible lines of each page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([plain_lines(h) for h in b.column(2).to_pylist()], pa.string())], names=["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")


def html_to_markdown(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, published_at, updated_at, markdown, status, links, pdf_links) and the counts of tables and numbers in Markdown and source."""
    strings, lists, ints = ("title", "published_at", "updated_at", "markdown", "status"), ("links", "pdf_links"), ("table_count", "numeric_tokens", "source_table_count", "source_numeric_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [page_facts(u, h) for u, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            arrays = [pa.array([r[n] for r in rows], kind) for names, kind in ((strings, pa.string()), (lists, pa.list_(pa.string())), (ints, pa.int32())) for n in names]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays], names=["page_id", "url", *strings, *lists, *ints])

    schema = "page_id long, url string, " + ", ".join([f"{n} string" for n in strings] + [f"{n} array<string>" for n in lists] + [f"{n} int" for n in ints])
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
