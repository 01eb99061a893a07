"""Chunking by structure: sections under their headings, tables, parents with children, all as rows and column expressions.

The input has a row a page: doc_id, page_number, text, headings (text, level) and tables (rows of cells). Headings are
placed in their page's text one after another; a section's path holds, for each level, the last heading of that level
unless a higher one came later. What a page inherits from the pages before it is a running window over page rows, and so
are the numbers of chunks; a section is packed by a fold within its row. The texts are shuffled once, by document; nothing
leaves the JVM.

Defined results: null texts are empty; "\\r\\n" and "\\r" are line ends; a document's page numbers are distinct; headings
without text are nothing; levels run from 1 to ``LEVELS``, deeper ones count as the deepest, a null level as 1; empty
tables give no chunks. The time of placing grows with headings times text of one page.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import stable_chunk_id
from corpusloom.runtime import checkpointed

#: Levels of headings.
LEVELS = 6
#: White space as Python strips it, ends of sentences, of paragraphs and of lines.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = "[\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SENTENCE_END = rf"(?<=[.!?…]){SPACE}+|\n+"
PARAGRAPH_END = rf"\n{SPACE}*\n+"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

HEADINGS = "array<struct<text:string,level:int>>"
_STRINGS = "array<string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


# Packing --------------------------------------------------------------------------------------------------------------


def packed(units: Column, joint: str, width: Column) -> Column:
    """Units joined in order while they fit; a unit that begins anew stands alone until others fit behind it."""
    start = F.struct(F.array().cast(_STRINGS).alias("done"), F.lit(None).cast("string").alias("held"))

    def step(state: Column, unit: Column) -> Column:
        fits = F.length(state.held) + len(joint) + F.length(unit) <= width
        longer = F.struct(state.done.alias("done"), F.concat(state.held, F.lit(joint), unit).alias("held"))
        anew = F.struct(F.array_append(state.done, state.held).alias("done"), unit.alias("held"))
        return F.when(state.held.isNull(), F.struct(state.done.alias("done"), unit.alias("held"))).when(fits, longer).otherwise(anew)

    return F.aggregate(units, start, step, lambda s: F.when(s.held.isNull(), s.done).otherwise(F.array_append(s.done, s.held)))


def wrapped(text: Column, width: Column) -> Column:
    """Pieces of at most ``width`` characters that end before a space where one allows it."""
    pattern = F.concat(F.lit(f"(?s){SPACE}*+(.{{1,"), width.cast("string"), F.lit(r"}(?= |\z)|.{"), width.cast("string"), F.lit("})"))
    return F.transform(F.regexp_extract_all(text, pattern, F.lit(1)), stripped)


def parts(text: Column, pattern: str) -> Column:
    """Stripped parts between matches, blank ones left out."""
    return F.filter(F.transform(F.split(text, pattern), stripped), lambda x: x != "")


def body_pieces(body: Column, width: Column) -> Column:
    """Paragraphs packed into pieces that fit; one that doesn't fit is cut into sentences, a sentence at spaces."""

    def unit(paragraph: Column) -> Column:
        sentences = F.transform(parts(paragraph, SENTENCE_END), lambda s: F.when(F.length(s) <= width, F.array(s)).otherwise(wrapped(s, width)))
        return F.when(F.length(paragraph) <= width, F.array(paragraph)).otherwise(packed(F.flatten(sentences), " ", width))

    return packed(F.flatten(F.transform(parts(body, PARAGRAPH_END), unit)), "\n\n", width)


def section_pieces(heading: Column, body: Column, size: int) -> Column:
    """A section's pieces, each under its heading; a heading that leaves no room stands alone before them."""

    def under(head: Column) -> Column:
        room = F.when(head == "", F.lit(size)).otherwise(F.lit(size) - F.length(head) - 2)
        return let(room, lambda r: laid(head, r))

    def laid(head: Column, room: Column) -> Column:
        alone = F.when(head == "", F.array().cast(_STRINGS)).otherwise(F.array(head))
        pieces = let(F.when(room <= 0, F.lit(size)).otherwise(room), lambda width: body_pieces(body, width))
        headed = F.transform(pieces, lambda p: F.concat(head, F.lit("\n\n"), p))
        return F.when(body == "", alone).when(head == "", pieces).when(room <= 0, F.concat(alone, pieces)).otherwise(headed)

    return let(F.coalesce(stripped(heading), F.lit("")), under)


# Sections -------------------------------------------------------------------------------------------------------------


def placed_headings(text: Column, headings: Column) -> Column:
    """array(start, nth, text, level): each heading behind the one before it, or else wherever it is first found."""
    kind = "array<struct<start:int,nth:int,text:string,level:int>>"
    start = F.struct(F.lit(1).alias("cursor"), F.array().cast(kind).alias("found"))

    def step(state: Column, heading: Column) -> Column:
        ahead, anywhere = F.position(heading.text, text, state.cursor), F.position(heading.text, text)
        place = F.coalesce(F.nullif(ahead, F.lit(0)), F.nullif(anywhere, F.lit(0)))

        def found(at: Column) -> Column:
            here = F.struct(at.alias("start"), F.size(state.found).alias("nth"), heading.text.alias("text"), heading.level.alias("level"))
            return F.when(at.isNull(), state).otherwise(F.struct((at + F.length(heading.text)).alias("cursor"), F.array_append(state.found, here).alias("found")))

        return let(place, found)

    return F.sort_array(F.aggregate(headings, start, step, lambda s: s.found))


def named_headings() -> Column:
    """array(text, level) of the headings that have a text."""
    level = lambda h: F.least(F.greatest(F.coalesce(h["level"], F.lit(1)), F.lit(1)), F.lit(LEVELS)).cast("int")
    named = F.filter("headings", lambda h: F.coalesce(F.length(h["text"]), F.lit(0)) > 0)
    return F.coalesce(F.transform(named, lambda h: F.struct(h["text"].alias("text"), level(h).alias("level"))), F.array().cast(HEADINGS))


def level_head(headings: Column, deepest: int) -> Column:
    """The last heading of a level or above it."""
    return F.try_element_at(F.filter(headings, lambda h: h["level"] <= deepest), F.lit(-1))


def with_sections(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, nth, heading, heading_level, heading_path, body) of every page's sections.

    The path of a page's first section comes from the pages before it: for each level the last heading of that level
    or above, which counts if it has just that level.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n")
    rows = pages.select("doc_id", "page_number", text.alias("text"), named_headings().alias("named"))
    rows = rows.withColumn("placed", placed_headings(F.col("text"), F.col("named")))
    some = F.size("placed") > 0
    rows = rows.withColumn("heads", F.when(some, F.transform("placed", lambda p: F.struct(p["text"].alias("text"), p["level"].alias("level")))).otherwise(F.col("named")))
    before = Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    lasts = [level_head(F.col("heads"), k).alias(f"last{k}") for k in range(1, LEVELS + 1)]
    rows = rows.select("*", *lasts).select("doc_id", "page_number", "text", "placed", "heads", *(F.last(f"last{k}", ignorenulls=True).over(before).alias(f"old{k}") for k in range(1, LEVELS + 1)))
    held = F.filter(F.array(*(F.when(F.col(f"old{k}.level") == k, F.col(f"old{k}")) for k in range(1, LEVELS + 1))), lambda h: h.isNotNull())

    def step(state: Column, head: Column) -> Column:
        path = F.array_append(F.filter(state.path, lambda h: h.level < head.level), head)
        return let(path, lambda p: F.struct(p.alias("path"), F.array_append(state.all, p).alias("all")))

    start = F.struct(F.col("held").alias("path"), F.array(F.col("held")).alias("all"))
    rows = rows.withColumn("held", held).withColumn("paths", F.aggregate("heads", start, step, lambda s: s.all))

    def section(k: Column, body: Column) -> Column:
        return F.struct(k.cast("int").alias("k"), body.alias("body"))

    n = F.size("heads")
    end = lambda i: F.coalesce(F.get("placed", i + 1)["start"], F.length("text") + 1)
    bodies = F.transform("placed", lambda p, i: section(i + 1, stripped(F.substring("text", p["start"] + F.length(p["text"]), end(i) - p["start"] - F.length(p["text"])))))
    preface = section(F.lit(0), stripped(F.substring("text", F.lit(1), F.get("placed", F.lit(0))["start"] - 1)))
    whole = stripped(F.col("text"))
    unplaced = F.when(whole != "", F.array(section(n, whole))).when(n > 0, F.transform("heads", lambda _, i: section(i + 1, F.lit(""))))
    all_sections = F.when(F.size("placed") > 0, F.concat(F.filter(F.array(preface), lambda s: s["body"] != ""), bodies)).otherwise(F.coalesce(unplaced, F.array().cast("array<struct<k:int,body:string>>")))
    rows = rows.select("doc_id", "page_number", "paths", F.posexplode(all_sections).alias("nth", "s"))
    rows = rows.select("doc_id", "page_number", "nth", F.get("paths", F.col("s.k")).alias("path"), F.col("s.body").alias("body"))
    last = F.try_element_at("path", F.lit(-1))
    return rows.select("doc_id", "page_number", "nth", last["text"].alias("heading"), last["level"].alias("heading_level"), F.transform("path", lambda h: h["text"]).alias("heading_path"), "body")


def numbered(rows: DataFrame, pieces: str, order: list[str], output: str) -> DataFrame:
    """Add the number of pieces that stand before each row in its document."""
    before = Window.partitionBy("doc_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(output, F.coalesce(F.sum(F.size(pieces)).over(before), F.lit(0)).cast("int"))


def heading_name() -> Column:
    return F.coalesce("heading", F.lit(""))


def chunk_structure(pages: DataFrame, size: int = 500) -> DataFrame:
    """(doc_id, chunk_id, chunk_type, chunk_index, page_number, heading, heading_level, heading_path, content, chunking_strategy)."""
    if size <= 0:
        raise ValueError("the size is positive")
    rows = with_sections(pages).withColumn("pieces", section_pieces(F.col("heading"), F.col("body"), size)).drop("body")
    rows = numbered(rows, "pieces", ["page_number", "nth"], "before").select("*", F.posexplode("pieces").alias("piece", "content"))
    rows = rows.withColumn("chunk_index", F.col("before") + F.col("piece"))
    own = stable_chunk_id(F.col("doc_id"), F.lit("text"), F.col("page_number"), heading_name(), F.lit(""), F.col("chunk_index"), F.col("content"))
    return rows.select("doc_id", own.alias("chunk_id"), F.lit("text").alias("chunk_type"), "chunk_index", "page_number", heading_name().alias("heading"), "heading_level", "heading_path", "content", F.lit("structure_aware").alias("chunking_strategy"))


def families(pages: DataFrame, parent_size: int = 1500, child_size: int = 300) -> DataFrame:
    """A row a parent: doc_id, page_number, heading, heading_level, heading_path, content, chunk_index, chunk_id, and its
    children as array(chunk_index, chunk_id, content)."""
    if min(parent_size, child_size) <= 0 or child_size > parent_size:
        raise ValueError("sizes are positive, and children no larger than parents")
    rows = with_sections(pages).withColumn("pieces", section_pieces(F.col("heading"), F.col("body"), parent_size)).drop("body")
    rows = numbered(rows, "pieces", ["page_number", "nth"], "before").select("*", F.posexplode("pieces").alias("piece", "content")).drop("pieces")
    rows = rows.withColumn("chunk_index", F.col("before") + F.col("piece"))
    own = stable_chunk_id(F.col("doc_id"), F.lit("parent"), F.col("page_number"), heading_name(), F.lit(""), F.col("chunk_index"), F.col("content"))
    under = F.when(F.startswith("content", heading_name()), F.ltrim(F.substr("content", F.length(heading_name()) + 1), F.lit(WHITE))).otherwise(F.col("content"))
    inner = F.when(heading_name() == "", F.col("content")).otherwise(under)
    rows = rows.withColumn("chunk_id", own).withColumn("pieces", section_pieces(F.col("heading"), inner, child_size))
    rows = numbered(rows, "pieces", ["chunk_index"], "before")

    def child(content: Column, i: Column) -> Column:
        index = F.col("before") + i
        own = stable_chunk_id(F.col("doc_id"), F.lit("child"), F.col("page_number"), heading_name(), F.col("chunk_id"), index, content)
        return F.struct(index.cast("int").alias("chunk_index"), own.alias("chunk_id"), content.alias("content"))

    return rows.select("doc_id", "page_number", heading_name().alias("heading"), "heading_level", "heading_path", "content", "chunk_index", "chunk_id", F.transform("pieces", child).alias("children"))


# Tables ---------------------------------------------------------------------------------------------------------------

TABLES = "array<struct<rows:array<array<string>>,page_number:int>>"


def table_line(cells: Column) -> Column:
    """A Markdown row: line ends in cells become spaces, bars are escaped."""
    clean = F.transform(cells, lambda c: stripped(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))))
    return F.concat(F.lit("| "), F.array_join(clean, " | "), F.lit(" |"))


def table_parts(title: Column, rows: Column, size: int) -> Column:
    """array(content, row_start, row_end): groups of rows that fit, each under title, header and separator."""
    header = F.get(rows, F.lit(0))
    head = F.concat_ws("\n", title, table_line(header), F.concat(F.lit("| "), F.array_join(F.transform(header, lambda _: F.lit("---")), " | "), F.lit(" |")))
    kind = "array<struct<content:string,row_start:int,row_end:int>>"
    lines = F.transform(F.slice(rows, 2, F.size(rows)), lambda r, i: F.struct((i + 1).cast("int").alias("k"), table_line(r).alias("line")))

    def part(content: Column, first: Column, last: Column) -> Column:
        return F.struct(content.alias("content"), first.cast("int").alias("row_start"), last.cast("int").alias("row_end"))

    def step(state: Column, row: Column) -> Column:
        held = state.held
        begun = part(F.concat(head, F.lit("\n"), row.line), row.k, row.k)
        fits = F.length(held.content) + 1 + F.length(row.line) <= size
        longer = F.struct(state.done.alias("done"), part(F.concat(held.content, F.lit("\n"), row.line), held.row_start, row.k).alias("held"))
        return F.when(held.isNull(), F.struct(state.done.alias("done"), begun.alias("held"))).when(fits, longer).otherwise(F.struct(F.array_append(state.done, held).alias("done"), begun.alias("held")))

    start = F.struct(F.array().cast(kind).alias("done"), F.lit(None).cast("struct<content:string,row_start:int,row_end:int>").alias("held"))
    groups = F.aggregate(lines, start, step, lambda s: F.when(s.held.isNull(), s.done).otherwise(F.array_append(s.done, s.held)))
    return F.when(F.size(rows) == 1, F.array(part(head, F.lit(0), F.lit(0)))).otherwise(groups)


def chunk_tables(pages: DataFrame, size: int = 500, title: str = "Table {n}: {heading}", untitled: str = "Full text") -> DataFrame:
    """A row a table part, with table_index, table_title, table_part, table_part_count, row_start and row_end.

    A table belongs to the last heading that is placed above it. One that isn't found in the text belongs to its page's
    last heading; one of a page without headings to the last heading of the pages before.
    """
    if size <= 0:
        raise ValueError("the size is positive")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n")
    full = F.filter(F.coalesce(F.col("tables").cast(TABLES), F.array().cast(TABLES)), lambda t: F.size(t["rows"]) > 0)
    rows = pages.select("doc_id", "page_number", text.alias("text"), named_headings().alias("named"), full.alias("tables"))
    before = Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("placed", F.when(F.size("tables") > 0, placed_headings(F.col("text"), F.col("named"))))
    rows = rows.withColumns({"carried": F.last(F.try_element_at("named", F.lit(-1)), ignorenulls=True).over(before), "first": F.coalesce(F.sum(F.size("tables")).over(before), F.lit(0)).cast("int")})
    rows = rows.where(F.size("tables") > 0)

    def step(state: Column, table: Column) -> Column:
        header = F.get(table["rows"], F.lit(0))
        plain = F.array_join(F.filter(F.transform(header, lambda c: stripped(F.coalesce(c, F.lit("")))), lambda c: c != ""), " ")
        as_row = F.nullif(F.position(table_line(header), F.col("text"), state.cursor), F.lit(0))
        as_text = F.when(plain != "", F.nullif(F.position(plain, F.col("text"), state.cursor), F.lit(0)))
        at = F.when(F.size("named") > 0, F.coalesce(as_row, as_text))
        return let(at, lambda x: F.struct(F.coalesce(x + 1, state.cursor).alias("cursor"), F.array_append(state.at, x).alias("at")))

    start = F.struct(F.lit(1).alias("cursor"), F.array().cast("array<int>").alias("at"))
    rows = rows.withColumn("at", F.aggregate("tables", start, step, lambda s: s.at)).select("*", F.posexplode("tables").alias("k", "table"))
    above = F.try_element_at(F.filter("placed", lambda p: p["start"] <= F.get("at", F.col("k"))), F.lit(-1))
    shown = F.try_element_at("placed", F.lit(-1))
    own = F.coalesce(*(F.when(h.isNotNull(), F.struct(h["text"].alias("text"), h["level"].alias("level"))) for h in (above, shown, F.try_element_at("named", F.lit(-1)), F.col("carried"))))
    rows = rows.select("doc_id", F.col("page_number").alias("of_page"), "k", own.alias("own"), (F.col("first") + F.col("k")).alias("table_index"), "table")
    rows = rows.withColumn("table_title", F.coalesce("own.text", F.lit(untitled)))
    line = F.replace(F.replace(F.lit(title), F.lit("{n}"), (F.col("table_index") + 1).cast("string")), F.lit("{heading}"), F.col("table_title"))
    rows = rows.withColumn("parts", table_parts(line, F.col("table.rows"), size))
    rows = numbered(rows, "parts", ["of_page", "k"], "before").select("*", F.posexplode("parts").alias("p", "part"))
    path = F.when(F.col("own").isNotNull(), F.array("own.text")).otherwise(F.array().cast(_STRINGS))
    rows = rows.select("doc_id", F.coalesce(F.nullif("table.page_number", F.lit(0)), "of_page").alias("page_number"), (F.col("before") + F.col("p")).alias("chunk_index"), F.coalesce("own.text", F.lit("")).alias("heading"), F.col("own.level").alias("heading_level"), path.alias("heading_path"), "part.content", "table_index", "table_title", (F.col("p") + 1).alias("table_part"), F.size("parts").alias("table_part_count"), "part.row_start", "part.row_end")
    own_id = stable_chunk_id(F.col("doc_id"), F.lit("table"), F.col("page_number"), F.col("heading"), F.lit(""), F.col("chunk_index"), F.col("content"))
    return rows.select("doc_id", own_id.alias("chunk_id"), F.lit("table").alias("chunk_type"), *rows.columns[1:], F.lit("table_aware").alias("chunking_strategy"))


def cells_of(line: Column) -> Column:
    """Cells of a stripped Markdown row; null where the line is none."""
    inner = F.substring(line, F.lit(2), F.length(line) - 2)
    cells = F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: stripped(F.replace(c, F.lit("\\|"), F.lit("|"))))
    return F.when(F.startswith(line, F.lit("|")) & F.endswith(line, F.lit("|")), cells)


def is_separator(cells: Column) -> Column:
    return F.coalesce(F.forall(cells, lambda c: c.rlike(r"^:?-{3,}:?\z")), F.lit(False))


def lines_of(text: Column) -> Column:
    """Lines without their ends; no line after a last end."""
    return let(F.split(text, LINE_END, -1), lambda x: F.when(F.try_element_at(x, F.lit(-1)) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x))


def tight(text: Column) -> Column:
    """Each run of white space one space, stripped."""
    return stripped(F.regexp_replace(text, f"{SPACE}+", " "))


def without_table_rows(pages: DataFrame) -> DataFrame:
    """Pages whose text has no line that repeats a table's row, its separator or its cells in a row."""
    none = F.array().cast(_STRINGS)
    rows = F.flatten(F.transform("tables", lambda t: t["rows"]))
    signatures = F.transform(rows, lambda r: F.transform(r, lambda c: tight(F.coalesce(c, F.lit("")))))
    marked = pages.withColumns({"__rows": F.coalesce(F.array_distinct(F.transform(signatures, lambda s: F.array_join(s, "\x1f"))), none), "__flat": F.coalesce(F.array_distinct(F.transform(signatures, lambda s: F.array_join(F.filter(s, lambda c: c != ""), " "))), none)})

    def repeats(cells: Column) -> Column:
        return F.array_contains("__rows", F.array_join(F.transform(cells, tight), "\x1f")) | is_separator(cells)

    def stays(line: Column) -> Column:
        # only what looks like a row is split into cells, only lines of pages with tables are tightened, each once
        bar = F.lit("|")
        as_row = F.when(F.contains(line, bar), let(stripped(line), lambda x: F.when(F.startswith(x, bar) & F.endswith(x, bar), let(cells_of(x), repeats))))
        as_text = F.when(F.size("__flat") > 0, let(tight(line), lambda x: (x != "") & F.array_contains("__flat", x)))
        return ~F.coalesce(as_row, F.lit(False)) & ~F.coalesce(as_text, F.lit(False))

    text = F.coalesce("text", F.lit(""))
    lines = F.array_join(F.filter(lines_of(text), stays), "\n")
    plain = ~F.contains(text, F.lit("|")) & (F.size("__flat") == 0)
    kept = stripped(F.when(plain, F.regexp_replace(text, LINE_END, "\n")).otherwise(lines))
    return marked.withColumn("text", kept).drop("__rows", "__flat")


PAGES = "array<struct<page_number:int,text:string,headings:array<struct<text:string,level:int,page_number:int>>,tables:array<struct<rows:array<array<string>>,page_number:int>>>>"

# Both -----------------------------------------------------------------------------------------------------------------


def table_parents(tables: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables with parent_chunk_id and parent_chunk_index, and the parents made for those without one.

    A table's parent is the first one of its page and heading, else the first of its page; the first table of a page without
    parents becomes one, for all tables of that page, numbered after the document's others.
    """
    first = F.min(F.struct("chunk_index", "chunk_id"))
    by_page = parents.groupBy("doc_id", "page_number").agg(first.alias("on_page"))
    by_heading = parents.groupBy("doc_id", "page_number", "heading").agg(first.alias("under_heading"))
    count = parents.groupBy("doc_id").agg(F.count("*").alias("n_parents"))
    rows = tables.join(by_heading, ["doc_id", "page_number", "heading"], "left").join(by_page, ["doc_id", "page_number"], "left").withColumn("parent", F.coalesce("under_heading", "on_page"))
    page = Window.partitionBy("doc_id", "page_number").orderBy("chunk_index")
    orphans = rows.where("parent IS NULL").withColumn("of_page", F.row_number().over(page)).where("of_page = 1")
    orphans = orphans.join(count, "doc_id", "left").withColumn("at", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index")) - 1)
    made = orphans.select("doc_id", "page_number", "heading", "heading_level", "heading_path", "content", (F.coalesce("n_parents", F.lit(0)) + F.col("at")).cast("int").alias("chunk_index"))
    made = made.withColumn("chunk_id", stable_chunk_id(F.col("doc_id"), F.lit("parent"), F.col("page_number"), F.col("heading"), F.lit(""), F.col("chunk_index"), F.col("content")))
    own = made.select("doc_id", "page_number", F.struct("chunk_index", "chunk_id").alias("made"))
    placed = rows.join(own, ["doc_id", "page_number"], "left").withColumn("parent", F.coalesce("parent", "made"))
    own_id = stable_chunk_id(F.col("doc_id"), F.lit("table"), F.col("page_number"), F.col("heading"), F.col("parent.chunk_id"), F.col("chunk_index"), F.col("content"))
    kept = [c for c in tables.columns if c != "chunk_id"]
    return placed.select(*kept, own_id.alias("chunk_id"), F.col("parent.chunk_id").alias("parent_chunk_id"), F.col("parent.chunk_index").alias("parent_chunk_index")), made


def members(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parents with child_chunk_ids, and children with parent_chunk_id, of families."""
    common = ["doc_id", "page_number", "heading", "heading_level", "heading_path"]
    ids = F.transform("children", lambda c: c["chunk_id"])
    up = rows.select(*common, "content", "chunk_index", "chunk_id", F.lit("parent").alias("chunk_type"), ids.alias("child_chunk_ids"), F.size("children").alias("child_count"))
    down = rows.select(*common, F.col("chunk_id").alias("parent_chunk_id"), F.col("chunk_index").alias("parent_chunk_index"), F.explode("children").alias("c"))
    return up, down.select(*common, "parent_chunk_id", "parent_chunk_index", "c.content", "c.chunk_index", "c.chunk_id", F.lit("child").alias("chunk_type"))


def chunk_parent_child(pages: DataFrame, parent_size: int = 1500, child_size: int = 300) -> DataFrame:
    """Parents with child_chunk_ids, and their children with parent_chunk_id."""
    up, down = members(families(pages, parent_size, child_size))
    return up.unionByName(down, allowMissingColumns=True).withColumn("chunking_strategy", F.lit("parent_child"))


def chunk_combined(pages: DataFrame, size: int = 500, parent_size: int = 1500, child_size: int = 300, **titles: str) -> DataFrame:
    """Parents that have children or tables, then children and tables that aren't blank, numbered by combined_chunk_index.

    The text of the pages is chunked without their tables' rows. Families and tables are written to the shared folder
    once (at the call), as several steps read them.
    """
    parents, children = members(checkpointed(families(without_table_rows(pages), parent_size, child_size)))
    parents = parents.drop("child_chunk_ids", "child_count")
    tables, made = table_parents(checkpointed(chunk_tables(pages, size, **titles)), parents.drop("content"))
    parents = parents.unionByName(made.withColumn("chunk_type", F.lit("parent"))).withColumn("chunking_strategy", F.lit("parent_child"))
    children = children.withColumn("chunking_strategy", F.lit("parent_child"))
    kept = children.unionByName(tables, allowMissingColumns=True).where(stripped(F.col("content")) != "")
    order = Window.partitionBy("doc_id").orderBy(F.when(F.col("chunk_type") == "child", 0).otherwise(1), "chunk_index")
    kept = kept.withColumn("combined_chunk_index", F.row_number().over(order) - 1)
    of = kept.groupBy("doc_id", F.col("parent_chunk_id").alias("chunk_id")).agg(F.sort_array(F.collect_list(F.struct("combined_chunk_index", "chunk_id"))).alias("own"))
    parents = parents.join(of, ["doc_id", "chunk_id"]).withColumns({"child_chunk_ids": F.transform("own", lambda c: c["chunk_id"]), "child_count": F.size("own")}).drop("own")
    return parents.unionByName(kept, allowMissingColumns=True)


def page_rows(docs: DataFrame) -> DataFrame:
    """A row a page of (doc_id, pages) rows."""
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.explode("pages").alias("p")).select("doc_id", "p.page_number", "p.text", "p.headings", "p.tables")


def build_chunks(docs: DataFrame, strategy: str = "combined", size: int = 500, parent_size: int = 1500, child_size: int = 300) -> DataFrame:
    """Chunks of (doc_id, pages) rows: strategy structure, tables, parent_child or combined; a last column ``error``.

    A document with a page without number, or with a heading without text or level, gives one row with its error; others
    go on.
    """
    make = {"structure": lambda p: chunk_structure(p, size), "tables": lambda p: chunk_tables(p, size), "parent_child": lambda p: chunk_parent_child(p, parent_size, child_size), "combined": lambda p: chunk_combined(p, size, parent_size, child_size)}[strategy]
    nameless = F.exists("pages", lambda p: p["page_number"].isNull())
    odd = F.exists("pages", lambda p: F.exists(p["headings"], lambda h: h["text"].isNull() | h["level"].isNull()))
    fault = F.when(F.coalesce(nameless, F.lit(False)), "page without number").when(F.coalesce(odd, F.lit(False)), "heading without text or level")
    told = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "pages", fault.alias("error"))
    good = make(page_rows(told.where("error IS NULL"))).withColumn("error", F.lit(None).cast("string"))
    return good.unionByName(told.where("error IS NOT NULL").select("doc_id", "error"), allowMissingColumns=True)


# Markdown -------------------------------------------------------------------------------------------------------------

_HEADING_LINE = rf"^{SPACE}*(#{{1,6}}){SPACE}+(.+?){SPACE}*\z"


def parse_markdown_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pages) of Markdown texts, one page each: text, headings by # and pipe tables that have a separator row.

    Lines are rows. A run of lines that look like table rows is a table from the first line that a separator follows; a
    heading's line keeps its text only, a table's lines stay in the text.
    """
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "\r\n?", "\n")
    lines = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.posexplode_outer(lines_of(text)).alias("at", "line"))
    heading = F.length(F.regexp_extract("line", _HEADING_LINE, 1))
    # a line after a heading's marks may hold a line break of another kind: the pattern looks at the first part only
    lines = lines.withColumns({"level": F.when(heading > 0, heading), "title": F.regexp_extract("line", _HEADING_LINE, 2), "cells": cells_of(stripped(F.col("line")))})
    doc = Window.partitionBy("doc_id").orderBy("at")
    lines = lines.withColumns({"rule": is_separator(F.col("cells")), "run": F.sum(F.when(F.col("cells").isNull(), 1).otherwise(0)).over(doc)})
    lines = lines.withColumn("opens", F.col("cells").isNotNull() & F.coalesce(F.lead("rule").over(doc), F.lit(False)))
    start = F.min(F.when(F.col("opens"), F.col("at"))).over(Window.partitionBy("doc_id", "run"))
    lines = lines.withColumn("start", F.when(F.col("cells").isNotNull(), start))
    row = F.col("start").isNotNull() & ((F.col("at") == F.col("start")) | ((F.col("at") > F.col("start")) & ~F.col("rule")))
    tables = F.collect_list(F.when(row, F.struct("start", "at", "cells")))
    told = lines.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("at", F.coalesce(F.when(F.col("level").isNotNull(), F.col("title")), "line", F.lit("")).alias("line")))).alias("lines"),
        F.sort_array(F.collect_list(F.when(F.col("level").isNotNull(), F.struct("at", "title", "level")))).alias("heads"),
        F.sort_array(tables).alias("rows"),
    )
    page_text = stripped(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    heads = F.transform("heads", lambda h: F.struct(h["title"].alias("text"), h["level"].cast("int").alias("level"), F.lit(1).alias("page_number")))
    starts = F.array_distinct(F.transform("rows", lambda r: r["start"]))
    tables = F.transform(starts, lambda s: F.struct(F.transform(F.filter("rows", lambda r: r["start"] == s), lambda r: r["cells"]).alias("rows"), F.lit(1).alias("page_number")))
    page = F.struct(F.lit(1).alias("page_number"), page_text.alias("text"), heads.alias("headings"), tables.alias("tables"))
    return told.select("doc_id", F.array(page).alias("pages"))
