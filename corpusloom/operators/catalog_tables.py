"""Split tables proved complete before their rows are listed, and session history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import fold, markdown_cells, url_host


def _lines() -> F.Column:
    """The pipe-table lines of a part's content, without its separator."""
    rows = F.filter(F.split("content", "\n"), lambda s: F.trim(s).rlike(r"^\|.*\|$"))
    return F.filter(rows, lambda s: ~F.trim(s).rlike(r"^\|(?:\s*:?-{3,}:?\s*\|)+$"))


def table_family_check(parts: DataFrame, identity: tuple[str, ...] = ("title", "source_url", "admission_year", "campus")) -> DataFrame:
    """(doc_id, table_index, complete, rows): whether a split table's parts are all there and agree.

    Complete: parts 1 to the count once each, one identity and one header, rows that follow on from part to part, as
    many physical rows as declared, at least one row.
    """
    lines = parts.withColumn("lines", _lines()).withColumn("header", F.get("lines", F.lit(0))).withColumn("physical", F.greatest(F.size("lines") - 1, F.lit(0)))
    before = F.lag("row_end").over(Window.partitionBy("doc_id", "table_index").orderBy("table_part"))
    follows = F.when(before.isNull(), F.col("row_start") == 1).otherwise(F.col("row_start") == before + 1)
    lines = lines.withColumn("follows", follows).withColumn("declared", F.col("row_end") - F.col("row_start") + 1)
    one = lambda c: F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\x00"))) == 1
    ok = (
        (F.count("*") == F.max("table_part_count"))
        & (F.min("table_part_count") == F.max("table_part_count"))
        & (F.count_distinct("table_part") == F.count("*"))
        & (F.min("table_part") == 1)
        & (F.max("table_part") == F.max("table_part_count"))
        & F.bool_and(F.coalesce("follows", F.lit(False)))
        & F.bool_and(F.coalesce(F.col("physical") == F.col("declared"), F.lit(False)))
        & one("header")
        & (F.sum("physical") > 0)
    )
    for name in identity:
        ok = ok & one(name)
    return lines.groupBy("doc_id", "table_index").agg(F.coalesce(ok, F.lit(False)).alias("complete"), F.sum("physical").alias("rows"))


def catalog_rows(parts: DataFrame) -> DataFrame:
    """(doc_id, table_index, row, cells, labels): the rows of complete tables under their header."""
    good = table_family_check(parts).where("complete").select("doc_id", "table_index")
    lines = parts.join(good, ["doc_id", "table_index"]).withColumn("lines", _lines())
    rows = lines.select("doc_id", "table_index", "row_start", markdown_cells(F.get("lines", F.lit(0))).alias("labels"), F.posexplode(F.slice("lines", 2, F.size("lines"))).alias("at", "line"))
    return rows.select("doc_id", "table_index", (F.col("row_start") + F.col("at")).alias("row"), markdown_cells(F.col("line")).alias("cells"), "labels")


def carry_sections(rows: DataFrame) -> DataFrame:
    """Add section and subsection: label rows (one filled cell) name the rows after them; a roman number starts a new section.

    A label without a number is a subsection, or a section if none has begun.
    """
    table = Window.partitionBy("doc_id", "table_index").orderBy("row")
    filled = F.filter("cells", lambda c: c != "")
    label = F.when(F.size(filled) == 1, F.get(filled, F.lit(0)))
    roman = label.rlike(r"^(?i:[ivxlc]+)[.)\s]")
    marked = rows.withColumn("label", label).withColumn("begins", F.when(roman, 1).otherwise(0))
    marked = marked.withColumn("nth", F.sum("begins").over(table))
    marked = marked.withColumn("own", F.when(roman | (F.col("label").isNotNull() & (F.col("nth") == 0)), F.col("label")))
    marked = marked.withColumn("section", F.last("own", ignorenulls=True).over(table))
    sub = F.when(F.col("label").isNotNull() & F.col("own").isNull(), F.col("label"))
    inner = Window.partitionBy("doc_id", "table_index", "nth").orderBy("row")
    return marked.withColumn("subsection", F.last(sub, ignorenulls=True).over(inner)).where("label is null").drop("label", "begins", "nth", "own")


def widest_table(families: DataFrame, *scope: str) -> DataFrame:
    """Of each scope (such as document, year and place) the complete table with most rows; none if two tie."""
    ranked = families.where("complete").withColumn("r", F.rank().over(Window.partitionBy(*scope).orderBy(F.desc("rows"))))
    best = ranked.where("r = 1").withColumn("n", F.count("*").over(Window.partitionBy(*scope)))
    return best.where("n = 1").drop("r", "n")


def complete_catalog(parts: DataFrame, allowed_hosts: list[str], years: list[str] | None = None, places: list[str] | None = None) -> DataFrame:
    """The rows of the newest year's widest table of each place, from allowed hosts, if it is complete; a place whose widest table is
    damaged or tied, or whose documents disagree, has none. ``complete_catalog.complete_catalog`` answers for all places at once."""
    own = parts.where(url_host(F.col("source_url")).isin(*allowed_hosts))
    own = own.where(F.col("admission_year").isin(*years)) if years else own
    own = own.where(F.col("campus").isin(*places)) if places else own
    declared = own.groupBy("doc_id", "table_index", "admission_year", "campus").agg(F.max("row_end").alias("declared"))
    families = table_family_check(own).join(declared, ["doc_id", "table_index"])
    newest = families.agg(F.max("admission_year").alias("newest"))
    # chosen among all declared tables: a damaged winner leaves its place without an answer
    families = families.join(F.broadcast(newest), F.col("admission_year") == F.col("newest")).drop("newest")
    scope = Window.partitionBy("doc_id", "admission_year", "campus")
    ranked = families.withColumn("r", F.rank().over(scope.orderBy(F.desc("declared")))).where("r = 1")
    best = ranked.withColumn("tied", F.count("*").over(scope)).where("tied = 1 AND complete")
    rows = catalog_rows(own).join(best.select("doc_id", "table_index", "admission_year", "campus"), ["doc_id", "table_index"])
    signed = rows.groupBy("campus", "doc_id", "table_index").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("row", "cells")))), 256).alias("s"))
    agreed = signed.groupBy("campus").agg(F.count_distinct("s").alias("n"), F.min(F.struct("doc_id", "table_index")).alias("one")).where("n = 1").select("campus", "one.doc_id", "one.table_index")
    return carry_sections(rows.join(agreed, ["campus", "doc_id", "table_index"]))


def named_entry_lookup(entries: DataFrame, names: DataFrame, name_fields: list[int]) -> DataFrame:
    """Entries one of whose name cells, folded, equals a requested name."""
    exploded = entries.withColumn("__name", F.explode(F.array(*(fold(F.trim(F.get("cells", F.lit(i)))) for i in name_fields))))
    wanted = names.select("query_id", fold(F.trim("name")).alias("__name"))
    return exploded.join(wanted, "__name").drop("__name").dropDuplicates(["query_id", "doc_id", "table_index", "row"])


def render_catalog(entries: DataFrame) -> DataFrame:
    """(query_id, text): a numbered line per entry, its fields as label: value, ordered by row."""
    fields = F.array_join(F.zip_with("labels", "cells", lambda a, b: F.concat(a, F.lit(": "), b)), "; ")
    lines = entries.select("query_id", "row", fields.alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("row", "line")))
    return lines.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["line"])), "\n").alias("text"))


def session_history(messages: DataFrame, max_turns: int = 5) -> DataFrame:
    """The last 2 * max_turns messages of each conversation, in order; other roles than user, assistant and system are left out."""
    own = messages.where(F.col("role").isin("user", "assistant", "system"))
    last = own.withColumn("__n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))))
    return last.where(F.col("__n") <= 2 * max_turns).drop("__n")


def _seeds(picked: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, place) of the first k of each query's ordered list ``order``."""
    return picked.select("query_id", F.posexplode(F.slice("order", 1, k)).alias("place", "h")).select("query_id", F.col("h.chunk_id").alias("chunk_id"), "place")


def seed_cover(hits: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, place): the overview first, then by rank the hits that add an item not yet covered, then the rest by rank.

    ``hits`` has (query_id, chunk_id, rank, items array, overview boolean); of several overviews the best-ranked one counts,
    if it has items. One row folds a query's hits, which the candidate cap bounds; no state crosses queries.
    """
    first = (F.col("overview") & (F.size("items") > 0)).cast("int")
    ranked = hits.withColumn("lead", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last(first), "rank")))
    ranked = ranked.withColumn("late", F.when((F.col("lead") == 1) & (first == 1), 0).otherwise(1))
    listed = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("late", "rank", "chunk_id", "items"))).alias("hits"))
    none = F.array().cast(hits.schema["items"].dataType)

    def step(acc, h):
        new = F.size(F.array_except(h["items"], acc["covered"])) > 0
        placed = F.struct(F.when(h["late"] == 0, 0).when(new, 1).otherwise(2).alias("kind"), h["rank"].alias("rank"), h["chunk_id"].alias("chunk_id"))
        return F.struct(F.array_union(acc["covered"], h["items"]).alias("covered"), F.concat(acc["order"], F.array(placed)).alias("order"))

    kinds = dict(hits.dtypes)
    start = F.struct(none.alias("covered"), F.array().cast(f"array<struct<kind:int,rank:{kinds['rank']},chunk_id:{kinds['chunk_id']}>>").alias("order"))
    return _seeds(listed.select("query_id", F.array_sort(F.aggregate("hits", start, step)["order"]).alias("order")), k)


def seed_cover_catalog(hits: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, place): catalogue hits of the newest year, again and again the one that adds most.

    ``hits`` has (query_id, chunk_id, rank, years, places, names, asked_years); only hits with names and one single year, the
    asked one if any is asked, count. Most new places wins, then most new names, then the best rank; a hit that adds neither
    is left out. One row folds a query's hits, which the candidate cap bounds; no state crosses queries.
    """
    year = F.get("years", F.lit(0))
    own = hits.where((F.size("names") > 0) & (F.size("years") == 1) & ((F.size("asked_years") == 0) | (F.array_sort("asked_years") == F.array_sort("years"))))
    newest = own.withColumn("__year", year).withColumn("__newest", F.max(year).over(Window.partitionBy("query_id"))).where("__year = __newest")
    listed = newest.groupBy("query_id").agg(F.collect_list(F.struct("rank", "chunk_id", "places", "names")).alias("hits"))
    kinds = dict(hits.dtypes)
    start = F.struct(
        F.array().cast(kinds["places"]).alias("places"), F.array().cast(kinds["names"]).alias("names"), F.array().cast(f"array<struct<chunk_id:{kinds['chunk_id']},rank:{kinds['rank']}>>").alias("order")
    )

    def step(acc, _):
        gain = lambda h, n: F.size(F.array_except(h[n], acc[n]))
        scored = F.transform("hits", lambda h: F.struct(gain(h, "places").alias("p"), gain(h, "names").alias("n"), (-h["rank"]).alias("r"), h.alias("h")))
        best = F.array_max(scored)
        taken = F.struct(best["h"]["chunk_id"].alias("chunk_id"), best["h"]["rank"].alias("rank"))
        more = F.struct(F.array_union(acc["places"], best["h"]["places"]).alias("places"), F.array_union(acc["names"], best["h"]["names"]).alias("names"), F.concat(acc["order"], F.array(taken)).alias("order"))
        return F.when((best["p"] > 0) | (best["n"] > 0), more).otherwise(acc)

    return _seeds(listed.select("query_id", F.aggregate(F.sequence(F.lit(1), F.lit(k)), start, step)["order"].alias("order")), k)


#: Signs that a copied table field may not have.
UNSAFE_FIELD = r"[<>\[\]\\\x00-\x1f\x7f]|https?://"


def render_profile(entries: DataFrame, heading: str = "Admission {year}, {campus}") -> DataFrame:
    """(query_id, text): every field of each entry as a small table of its own with the number of its source, under its sections.

    ``entries`` are catalogue rows (labels, cells, section, subsection, admission_year, campus, row) with (query_id, marker).
    A query whose entries lack a marker or a field, or have an unsafe one (UNSAFE_FIELD), has no row.
    """
    mark = F.concat(F.lit(" ["), F.col("marker").cast("string"), F.lit("]"))
    line = lambda c: F.concat(F.lit("| "), F.array_join(c, " | "), F.lit(" |"))
    marked = lambda c: line(F.concat(F.slice(c, 1, F.size(c) - 1), F.array(F.concat(F.element_at(c, -1), mark))))
    section = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit("**"), F.col(c), F.lit("**"), mark, F.lit(".\n\n")))
    good = F.col("marker").isNotNull() & (F.size("cells") > 0) & (F.size("cells") == F.size("labels")) & ~F.exists(F.concat("labels", "cells"), lambda c: c.rlike(UNSAFE_FIELD))
    table = F.concat_ws("\n", marked(F.col("labels")), line(F.transform("labels", lambda _: F.lit("---"))), marked(F.col("cells")))
    head = F.lit(heading)
    for name in ("year", "campus"):
        head = F.replace(head, F.lit("{" + name + "}"), F.coalesce(F.col("admission_year" if name == "year" else name).cast("string"), F.lit("")))
    rows = entries.withColumns({"good": F.coalesce(good, F.lit(False)), "head": head})
    rows = rows.withColumn("block", F.when(F.col("good"), F.concat(F.concat_ws("", section("section"), section("subsection")), table)))
    family = rows.groupBy("query_id", "head", "campus").agg(F.bool_and("good").alias("good"), F.array_sort(F.collect_list(F.struct("row", "block"))).alias("rows"))
    family = family.withColumn("text", F.concat(F.lit("### "), "head", F.lit("\n\n"), F.array_join(F.transform("rows", lambda r: r["block"]), "\n\n")))
    whole = family.groupBy("query_id").agg(F.bool_and("good").alias("good"), F.array_sort(F.collect_list(F.struct("campus", "head", "text"))).alias("parts"))
    return whole.where("good").select("query_id", F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n").alias("text"))
