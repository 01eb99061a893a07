"""Catalogues from split tables, with proof: all rows of the newest, widest tables, or nothing.

A request asks for places and perhaps years. The newest year and, within a document, each place's widest table are chosen
among *all* tables that declare themselves in scope, damaged ones too; only then must the chosen ones prove complete. A
damaged winner refuses its document, so a smaller or an older table can't stand in for it. One document must cover all places that
the request asks for; of several complete documents those with most entries count, and if they disagree there is no answer.

A part's lines are read in Arrow batches, once for a proof: a row a part with its counts and marks leaves them, no line. A request's
tables are chosen by metadata alone; of the text of all tables only first parts are read for it. Only the parts of documents that are
whole by their metadata are kept and read in full.

Defined results: null or blank metadata never matches a host, year or place; a table without parts or rows isn't proved; requests
without places ask for all ``CatalogRules.places``; repeated requests give repeated rows; empty inputs give empty results.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import BASE_OF, url_host, years
from corpusloom.runtime import broadcast_if_small, checkpointed

#: Metadata that all parts of a table have in common.
IDENTITY = ("doc_id", "source_url", "source_file", "raw_file", "version", "content_hash", "admission_year", "academic_year", "table_index")
#: Metadata that tells versions of documents apart.
DOCUMENT = ("doc_id", "source_url", "source_file", "raw_file", "version", "content_hash")
#: The end of a text as ``$`` finds it in the JVM, before a last line terminator too (no cell has an ASCII one).
END = r"(?=[\x85\u2028\u2029]?\Z)"
#: Signs that a copied cell may not have, emphasis, separator cells, numbers of entries and of sections.
UNSAFE, EMPHASIS = re.compile(r"[<>\[\]\\\x00-\x1f\x7f]|https?://"), re.compile(r"\*\*|__|`")
SEPARATOR, NUMBER, SECTION_NUMBER = (re.compile(p + END) for p in (r":?-{3,}:?", r"[0-9]+", r"[IVX]*"))
BARS, WHITE = re.compile(r"\A\|+|\|+" + END), re.compile(r"[ \t\n\x0b\f\r]+")
LONGEST_NAME, MOST_PARTS = 300, 1000
#: Lines that a worker remembers for one header, and headers.
REMEMBERED, REMEMBERED_HEADERS = 1000, 100
#: Hashes of chosen tables are broadcast up to so many, 8 bytes each.
MOST_HASHES = 4_000_000


@dataclass(frozen=True)
class CatalogRules:
    """What the tables of one domain look like: folded beginnings of the headers, the pattern of codes, hosts and places."""

    name_header: str
    code_header: str
    code_pattern: str
    hosts: tuple[str, ...]
    places: tuple[str, ...]


def _cells(line: str) -> list[str]:
    bare = line.strip(" ").strip("|") if line.isascii() else BARS.sub("", line.strip(" "))
    if "*" in line or "_" in line or "`" in line:
        return [EMPHASIS.sub("", c).strip(" ") for c in bare.split("|")]
    return [c.strip(" ") for c in bare.split("|")]


def _folded(cell: str) -> str:
    """As ``functions.text.fold``."""
    if cell.isascii():
        return cell.lower()
    bare = cell.lower().replace("ß", "ss").translate(BASE_OF)
    return "".join(c for c in bare if unicodedata.category(c) != "Mn").replace("đ", "d")


@lru_cache(16)
def line_reader(rules: CatalogRules) -> Callable[[str | None], Iterator[tuple]]:
    """A function from a part's content to its lines from the first header on, as (at, (cells, header, folded, kind, name, code, unnumbered)).

    kind is header, section, entry or broken; folded is the header's cells, folded and joined. Separators and lines above the first header are
    left out. A broken line is neither a numbered entry with a right code and a safe name, nor a section, or has not as many cells as its header.
    Headers, separators and sections come again and again: up to REMEMBERED of them are read once.
    """
    code_like = re.compile(f"(?:{rules.code_pattern}){END}", re.ASCII)
    place = lambda folded, beginning: next((i for i, c in enumerate(folded) if c.startswith(beginning)), None)

    def line_of(line: str, head: tuple | None) -> tuple:
        """(its header as (line, cells, folded, n, c), own fields) under a header; own fields are None for a line that is left out."""
        plain = line.isascii() and not ("*" in line or "_" in line or "`" in line)
        cells = [x.strip(" ") for x in line.strip(" ").strip("|").split("|")] if plain else _cells(line)
        # a cell of ASCII characters without emphasis stands in its line
        if not plain or (rules.name_header in (low := line.lower()) and rules.code_header in low):
            folded = [_folded(x) for x in cells]
            n, c = place(folded, rules.name_header), place(folded, rules.code_header)
            if n is not None and c is not None:
                return (line, cells, "|".join(folded), n, c), (cells, cells, "|".join(folded), "header", cells[n], WHITE.sub("", cells[c]), cells[0] == "")
        if head is None:
            return None, None
        _, top, folded, n, c = head
        first, many = cells[0], len(cells)
        if first[:1] in "-:" and all(SEPARATOR.match(x) for x in cells):
            return head, None
        kind, name, code = "broken", cells[n] if n < many else None, cells[c] if c < many else None
        if many == len(top) and name and not UNSAFE.search(name):
            if code_like.match(code) and NUMBER.match(first) and len(name) <= LONGEST_NAME:
                kind = "entry"
            elif name == code and SECTION_NUMBER.match(first):
                kind = "section"
        return head, (cells, top, folded, kind, name, code if not code or code.isalnum() else WHITE.sub("", code), first == "")

    #: By the header above a line: the lines themselves.
    remembered = {None: {}}

    def read(content: str | None) -> Iterator[tuple]:
        head, known = None, remembered[None]
        text = content or ""
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        for at, line in enumerate(text.split("\n")):
            got = known.get(line)
            if got is None:
                if "|" not in line:
                    continue
                got = line_of(line, head)
                if (got[1] is None or got[1][3] in ("header", "section")) and len(known) < REMEMBERED:
                    known[line] = got
            under, own = got
            if under is not head:
                head, known = under, remembered.get(under[0])
                if known is None:
                    known = {}
                    if len(remembered) < REMEMBERED_HEADERS:
                        remembered[under[0]] = known
            if own is not None:
                yield at, own

    return read


def part_facts(content: str | Column, rules: CatalogRules) -> Column:
    """What a proof takes from a part's text: physical (lines without headers), broken, the least and most header (all null without header),
    entries, and marks: a line an entry (e and its code) or section (n or u, numbered or not, and its label)."""
    def facts(texts: pa.Array) -> pa.Array:
        read = line_reader(rules)
        rows = []
        for text in texts.to_numpy(zero_copy_only=False):
            least, physical, broken, entries, marks = None, 0, False, 0, []
            for _, (_, _, folded, kind, name, code, unnumbered) in read(text):
                physical += 1
                if kind == "entry":
                    entries += 1
                    marks.append("e" + code)
                elif kind == "header":
                    physical -= 1
                    least, most = (folded, folded) if least is None else (min(least, folded), max(most, folded))
                elif kind == "section":
                    marks.append(("u" if unnumbered else "n") + name)
                else:
                    broken = True
            rows.append((None, None, None, None, 0, None) if least is None else (physical, broken, least, most, entries, "\n".join(marks) if marks else None))
        columns = zip(*rows, strict=True) if rows else ((),) * 6
        names = ("physical", "broken", "least", "most", "entries", "marks")
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.int32(), pa.string()), strict=True)], names)

    return F.arrow_udf(facts, "physical int, broken boolean, least string, most string, entries int, marks string")(content)


def _repeats_code(marks: str | None) -> bool:
    """Whether a section, or the same subsection of it, has a code twice: sections as in ``with_sections``."""
    lines = marks.split("\n") if marks else []
    codes = [m for m in lines if m[0] == "e"]
    if len(set(codes)) == len(codes):
        return False
    section, below, seen = None, None, set()
    for m in lines:
        if m[0] == "e":
            if (section, below, m) in seen:
                return True
            seen.add((section, below, m))
        elif m[0] == "n" or section is None:
            section, below = m[1:], None
        else:
            below = m[1:]
    return False


def repeats_code(marks: str | Column) -> Column:
    def repeats(texts: pa.Array) -> pa.Array:
        return pa.array([_repeats_code(t) for t in texts.to_numpy(zero_copy_only=False)], pa.bool_())

    return F.arrow_udf(repeats, "boolean")(marks)


def is_headed(content: str | Column, rules: CatalogRules) -> Column:
    """Whether a part has a header; it is read no further."""
    def headed(texts: pa.Array) -> pa.Array:
        read = line_reader(rules)
        return pa.array([next(read(t), None) is not None for t in texts.to_numpy(zero_copy_only=False)], pa.bool_())

    return F.arrow_udf(headed, "boolean")(content)


def table_rows(parts: DataFrame, rules: CatalogRules) -> DataFrame:
    """(doc_id, table_index, table_part, chunk_id, at, cells, header, kind, name, code, unnumbered): lines from a part's first header on."""
    key = ["doc_id", "table_index", "table_part", "chunk_id"]
    texts = pa.list_(pa.string())
    fields = (("at", pa.int32()), ("cells", texts), ("header", texts), ("kind", pa.string()), ("name", pa.string()), ("code", pa.string()), ("unnumbered", pa.bool_()))
    def lines(contents: pa.Array) -> pa.Array:
        read = line_reader(rules)
        rows = [[(at, *x[:2], *x[3:]) for at, x in read(t)] for t in contents.to_numpy(zero_copy_only=False)]
        ends = [0]
        for r in rows:
            ends.append(ends[-1] + len(r))
        own = pa.StructArray.from_arrays([pa.array([x[i] for r in rows for x in r], kind) for i, (_, kind) in enumerate(fields)], [n for n, _ in fields])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), own)

    of = F.arrow_udf(lines, "array<struct<at int, cells array<string>, header array<string>, kind string, name string, code string, unnumbered boolean>>")
    return parts.select(*key, of("content").alias("lines")).select(*key, F.explode("lines").alias("x")).select(*key, *(f"x.{n}" for n, _ in fields))


def with_sections(rows: DataFrame) -> DataFrame:
    """Entries with section and subsection (label, chunk_id): a numbered section begins anew; one without number is below the
    last numbered one, or stands for it if none has begun."""
    table = Window.partitionBy("doc_id", "table_index").orderBy("table_part", "at")
    own = F.when(F.col("kind") == "section", F.struct(F.col("name").alias("label"), "chunk_id"))
    rows = rows.where("kind IN ('section', 'entry')").withColumn("own", own)
    earlier = F.count("own").over(table.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("begins", F.col("own").isNotNull() & (~F.col("unnumbered") | (earlier == 0)))
    rows = rows.withColumn("nth", F.sum(F.col("begins").cast("int")).over(table))
    inner = Window.partitionBy("doc_id", "table_index", "nth").orderBy("table_part", "at")
    rows = rows.withColumns({"section": F.last(F.when(F.col("begins"), F.col("own")), ignorenulls=True).over(table), "subsection": F.last(F.when(~F.col("begins"), F.col("own")), ignorenulls=True).over(inner)})
    return rows.where("kind = 'entry'").drop("own", "begins", "nth", "unnumbered", "kind")


def _rule(ok: Column, name: str) -> Column:
    return F.when(~F.coalesce(ok, F.lit(False)), name)


def _of_lines() -> list[Column]:
    """What a table's lines must be, over the columns of ``part_facts``: as many as declared, under one header, none broken."""
    physical = F.bool_and(F.coalesce(F.col("physical") == F.col("row_end") - F.col("row_start") + 1, F.lit(False)))
    header = (F.min("least") == F.max("most")) & (F.count("least") == F.count("*"))
    return [_rule(physical, "physical"), _rule(header, "header"), _rule(~F.bool_or(F.coalesce("broken", F.lit(True))), "broken")]


def _in_order(marks: Column) -> Column:
    """Aggregate: a table's marks in order of its parts."""
    return F.array_join(F.sort_array(F.collect_list(F.when(marks.isNotNull(), F.struct("table_part", marks.alias("marks")))))["marks"], "\n").alias("marks")


def _own_ids(chunk_id: Column) -> Column:
    """Aggregate: whether each part has a name of its own; ``chunk_id`` may be null in rows that make a table faulty anyway."""
    return (F.size(F.collect_set(chunk_id)) == F.count("*")) & F.bool_and(F.coalesce(F.col("chunk_id") != "", F.lit(False)))


def _numbered(parts: DataFrame) -> DataFrame:
    """Add follows (a part's rows begin where those of the part before it end) and part_row (a part number's first row, up to MOST_PARTS)."""
    order = Window.partitionBy("doc_id", "table_index").orderBy("table_part", "chunk_id")
    follows = F.col("row_start") == F.coalesce(F.lag("row_end").over(order), F.lit(0)) + 1
    new_part = F.col("table_part").isNotNull() & ~F.col("table_part").eqNullSafe(F.lag("table_part").over(order))
    return parts.withColumns({"follows": follows, "part_row": new_part & F.col("table_part").between(1, MOST_PARTS)})


def _tables(rows: DataFrame, first: list[Column], ids: list[Column], faults: list[Column], more: list[Column]) -> DataFrame:
    """A row a table: its first part's metadata and ``first``, declared size, ``fault`` by metadata, with ``ids`` and ``faults``, and ``more``.

    ``rows`` are ``_numbered``; a table with rows that aren't a part_row has the fault ``parts``. Without ``ids``, ``faults`` and ``more`` a table's
    rows are folded as they come, none is collected.
    """
    key = ["doc_id", "table_index"]
    n = F.max("table_part_count")
    same = F.struct(*(F.col(c).cast("string") for c in (*IDENTITY, "campus") if c not in key))
    metadata = (
        _rule((F.min("table_part_count") == n) & n.between(1, MOST_PARTS) & (F.count("*") == n) & (F.count_if("part_row") == n) & (F.min("table_part") == 1) & (F.max("table_part") == n), "parts"),
        _rule(F.bool_and(F.coalesce(F.col("chunk_type") == "table", F.lit(False))), "type"),
        _rule(F.min(same) == F.max(same), "identity"),
        *ids,
        _rule(F.bool_and(F.coalesce(F.col("follows") & (F.col("row_end") >= F.col("row_start")), F.lit(False))), "rows"),
    )
    said = F.coalesce(F.nullif("admission_year", F.lit("")), "academic_year")
    year = years(said)
    one = F.min_by(F.struct(*DOCUMENT[1:], "campus", "admission_year", "academic_year", *first), F.struct("table_part", "chunk_id")).alias("first")
    tables = rows.groupBy(*key).agg(one, F.coalesce(F.max("row_end"), F.lit(0)).alias("declared"), F.coalesce(*metadata, *faults, F.lit(None)).alias("fault"), *more)
    extra = [c for c in tables.columns if c not in (*key, "first")]
    tables = tables.select(*key, "first.*", *extra)
    # most say a year and nothing else
    alone = (F.length(said) == 4) & said.rlike(r"^(19|20|21)[0-9]{2}$")
    return tables.withColumn("year", F.when(alone, said.try_cast("int")).when(year["kind"] == "single", F.get(year["values"], F.lit(0)))).drop("admission_year", "academic_year")


def proved_tables(parts: DataFrame, rules: CatalogRules) -> tuple[DataFrame, DataFrame]:
    """(tables, entries). tables: a row a table with its metadata, declared size, whether its first part has a header, and
    ``fault``, the first rule that it breaks (null: complete). entries: the numbered rows of all tables under their sections."""
    # tables are numbered before they are read: a reading in Python hides how its rows lie, and would have them shuffled first
    own = _numbered(parts).withColumn("facts", part_facts("content", rules)).select(*(c for c in parts.columns if c != "content"), "follows", "part_row", "facts.*")
    own = own.withColumnRenamed("entries", "part_entries").withColumnRenamed("marks", "part_marks")
    held = F.when(F.col("part_row"), F.col("part_marks"))
    ids = _rule(_own_ids(F.when(F.col("part_row"), F.col("chunk_id"))), "ids")
    tables = _tables(own, [F.col("least").isNotNull().alias("headed")], [ids], _of_lines(), [F.sum("part_entries").alias("entries"), _in_order(held)])
    fault = F.coalesce("fault", F.when(F.col("entries") == 0, "empty").when(repeats_code(F.col("marks")), "codes"))
    return tables.withColumn("fault", fault).drop("marks"), with_sections(table_rows(parts, rules))


def _chosen(requests: DataFrame, parts: DataFrame, rules: CatalogRules) -> DataFrame:
    """(query_id, document, place, year, doc_id, table_index): the newest, widest tables of documents that are whole by their metadata, one
    untied table for each place that the request asks for. Checkpointed."""
    tables = _tables(_numbered(parts), [F.col("content")], [], [], [])
    every = F.array(*(F.lit(p) for p in rules.places))
    asked = requests.select("query_id", F.array_distinct(F.when(F.size("places") > 0, F.col("places")).otherwise(every)).alias("places"), F.coalesce("asked_years", F.array().cast("array<int>")).alias("asked_years"))
    wanted = asked.select("query_id", F.size("places").alias("n_places"), "asked_years", F.explode("places").alias("place"))
    scope = tables.where(url_host(F.col("source_url")).isin(*rules.hosts) & F.col("doc_id").isNotNull() & F.col("year").isNotNull())
    document = F.sha2(F.to_json(F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in DOCUMENT))), 256)
    scope = scope.select("campus", "year", "doc_id", "table_index", "declared", document.alias("document"), F.col("fault").isNull().alias("sound"), is_headed("content", rules).alias("headed")).where("headed")
    found = wanted.join(scope, F.col("place") == F.col("campus")).where((F.size("asked_years") == 0) | ((F.size("asked_years") == 1) & F.array_contains("asked_years", F.col("year"))))
    found = checkpointed(found.select("query_id", "n_places", "place", "year", "document", "doc_id", "table_index", "declared", "sound"))
    # one row a query: broadcast for few requests; for many, what follows needs no other shuffle
    newest = broadcast_if_small(found.groupBy("query_id").agg(F.max("year").alias("year")), requests.count())
    same = ["query_id", "year", "document", "place", "n_places"]
    sizes = found.join(newest, ["query_id", "year"]).groupBy(*same, "declared").agg(F.count("*").alias("tied"), F.bool_and("sound").alias("sound"), F.min("doc_id").alias("doc_id"), F.min("table_index").alias("table_index"))
    widest = sizes.groupBy(*same).agg(F.max_by(F.struct("tied", "sound", "doc_id", "table_index"), "declared").alias("x"))
    whole = widest.groupBy("query_id", "year", "document", "n_places").agg(F.count("*").alias("covered"), F.bool_and((F.col("x.tied") == 1) & F.col("x.sound")).alias("whole"), F.collect_list(F.struct("place", "x.doc_id", "x.table_index")).alias("tables"))
    return checkpointed(whole.where(F.col("whole") & (F.col("covered") == F.col("n_places"))).select("query_id", "document", "year", F.inline("tables")))


def complete_catalog(requests: DataFrame, parts: DataFrame, rules: CatalogRules) -> DataFrame:
    """(query_id, place, year, doc_id, table_index, entry, name, code, section, subsection, labels, cells, chunk_id) of answered requests.

    ``requests`` has (query_id, places, asked_years), both arrays; ``parts`` the columns of IDENTITY and chunk_id, chunk_type, campus,
    table_part, table_part_count, row_start, row_end and content. entry numbers a place's entries from 1.
    """
    key = ["doc_id", "table_index"]
    chosen = _chosen(requests, parts, rules)
    # only chosen tables' parts are kept and read; a hash that another table shares is harmless, for joins with chosen follow
    hashes = chosen.select(F.xxhash64(*key).alias("hash")).distinct()
    hashes = F.broadcast(hashes) if chosen.count() <= MOST_HASHES else hashes
    few = parts.withColumn("hash", F.xxhash64(*key)).join(hashes, "hash", "left_semi")
    few = checkpointed(few.select(*key, "table_part", "chunk_id", "row_start", "row_end", "content"))
    read = few.withColumn("facts", part_facts("content", rules)).select(*key, "table_part", "chunk_id", "row_start", "row_end", "facts.*")
    proved = read.groupBy(*key).agg(F.coalesce(_rule(_own_ids(F.col("chunk_id")), "ids"), *_of_lines()).alias("fault"), F.sum("entries").alias("table_entries"), _in_order(F.col("marks")))
    proved = proved.select(*key, "table_entries", (F.col("fault").isNull() & (F.col("table_entries") > 0) & ~repeats_code("marks")).alias("proved"))
    ids = few.select(*key, "chunk_id")
    both = chosen.join(proved, key)
    whole = both.groupBy("query_id", "document").agg(F.bool_and("proved").alias("proved"), F.sum("table_entries").alias("entries"), F.collect_list(F.struct("place", "year", *key)).alias("tables")).where("proved")
    most = whole.groupBy("query_id").agg(F.max("entries").alias("entries"))
    best = checkpointed(whole.join(most, ["query_id", "entries"]).select("query_id", "document", F.inline("tables")))
    repeated = best.join(ids, key).groupBy("query_id", "document", "chunk_id").agg(F.count("*").alias("times")).groupBy("query_id", "document").agg((F.max("times") == 1).alias("distinct_ids"))
    entries = with_sections(table_rows(few.join(best.select(*key).distinct(), key, "left_semi"), rules))
    order = Window.partitionBy("query_id", "document", "place").orderBy("table_part", "at")
    rows = checkpointed(best.join(entries, key).withColumn("entry", F.row_number().over(order)))
    own = F.sha2(F.to_json(F.struct("place", "entry", "name", "code", F.col("section.label").alias("s"), F.col("subsection.label").alias("t"), "header", "cells"), {"ignoreNullFields": "false"}), 256)
    # equal sets of digested entries are equal catalogues, for place and number tell entries apart
    signed = rows.groupBy("query_id", "document").agg(F.sum(F.conv(F.substring(own, 1, 15), 16, 10).cast("decimal(38,0)")).alias("s1"), F.sum(F.conv(F.substring(own, 17, 15), 16, 10).cast("decimal(38,0)")).alias("s2")).join(repeated, ["query_id", "document"])
    agreed = signed.groupBy("query_id").agg(F.count_distinct("s1", "s2").alias("n"), F.min(F.struct("document", "distinct_ids")).alias("one")).where("n = 1 AND one.distinct_ids")
    # whoever reads the result several times, as a rendering does, digests nothing again
    agreed = checkpointed(agreed.select("query_id", F.col("one.document").alias("document")))
    labels = F.col("header").alias("labels")
    return rows.join(agreed, ["query_id", "document"]).select("query_id", "place", "year", "doc_id", "table_index", "entry", "name", "code", "section", "subsection", labels, "cells", "chunk_id")


def render_catalog(entries: DataFrame, sources: DataFrame, heading: str = "Programmes of {year}, {place}", line: str = "Programme **{name}**, code **{code}**") -> DataFrame:
    """(query_id, text): each place's entries under its heading and sections, each line with the number of its source.

    ``sources`` has (query_id, chunk_id, marker). A query whose sources repeat a chunk, or aren't just the chunks that its
    entries and sections come from, has no row.
    """
    said = entries.select("query_id", "chunk_id").union(entries.where("section IS NOT NULL").select("query_id", "section.chunk_id")).union(entries.where("subsection IS NOT NULL").select("query_id", "subsection.chunk_id")).distinct()
    told = sources.groupBy("query_id", "chunk_id").agg(F.count("*").alias("times"), F.min("marker").alias("marker"))
    both = said.withColumn("used", F.lit(True)).join(told, ["query_id", "chunk_id"], "full_outer")
    good = both.groupBy("query_id").agg(F.bool_and(F.col("used").isNotNull() & F.coalesce(F.col("times") == 1, F.lit(False))).alias("good")).where("good").select("query_id")
    rows = entries.join(good, "query_id")
    for name, of in (("m", "chunk_id"), ("ms", "section.chunk_id"), ("mt", "subsection.chunk_id")):
        marks = told.select(F.col("query_id").alias("q"), F.col("chunk_id").alias("c"), F.col("marker").alias(name))
        rows = rows.join(marks, (F.col("query_id") == F.col("q")) & (F.col(of) == F.col("c")), "left").drop("q", "c")
    place = Window.partitionBy("query_id", "place").orderBy("entry")
    changed = lambda c: F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.lag(c).over(place))
    rows = rows.withColumns({"new_s": changed("section"), "new_t": changed("subsection"), "after": F.lag("entry").over(place).isNotNull()})
    title = lambda marks, c, m: F.concat(F.lit(marks), F.col(c), F.lit(" ["), F.col(m).cast("string"), F.lit("]\n\n"))
    heads = F.concat(F.when(F.col("new_s"), title("#### ", "section.label", "ms")).otherwise(""), F.when(F.col("new_t"), title("##### ", "subsection.label", "mt")).otherwise(""))
    filled = F.lit(line)
    for c in ("name", "code"):
        filled = F.replace(filled, F.lit("{" + c + "}"), F.col(c))
    block = F.concat(F.when(F.col("after") & (F.col("new_s") | F.col("new_t")), "\n").otherwise(""), heads, F.lit("- "), filled, F.lit(" ["), F.col("m").cast("string"), F.lit("]."))
    by_place = rows.withColumn("block", block).groupBy("query_id", "place", "year").agg(F.sort_array(F.collect_list(F.struct("entry", "block"))).alias("b"))
    top = F.replace(F.replace(F.lit("### " + heading), F.lit("{year}"), F.col("year").cast("string")), F.lit("{place}"), F.col("place"))
    text = F.concat(top, F.lit("\n\n"), F.array_join(F.transform("b", lambda x: x["block"]), "\n"))
    return by_place.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", text.alias("text")))).alias("t")).select("query_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("text"))
