"""Context for answers: packing within a budget, rendering, evidence groups and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import case_folded, content_tokens, fold, normalized_space

#: What makes two hits the same evidence; a chunk's own id only counts where none of these is known.
LOCATORS = ("doc_id", "source_url", "version", "page_number", "heading", "table_index", "table_part", "row_start", "row_end")


def evidence_key(*locators: str) -> F.Column:
    """A digest of a hit's provenance; of the chunk id if it has none."""
    names = locators or LOCATORS
    some = F.coalesce(*(F.col(n).cast("string") for n in names)).isNotNull()
    return F.when(some, F.sha2(F.to_json(F.struct(*names)), 256)).otherwise(F.sha2(F.concat(F.lit("chunk:"), F.col("chunk_id").cast("string")), 256))


def pack_context(hits: DataFrame, max_chars: int = 12_000, locators: tuple[str, ...] = LOCATORS) -> DataFrame:
    """(query_id, chunk_id, place, n_chars): hits that fit the budget; one too long is skipped and later ones may still fit.

    Order: exact hits, table parts and parents, neighbours, each by position. Blank hits and repeats of the same content
    with the same provenance are left out. A query's hits are bounded by the candidate cap, so its fold is one row's work.
    """
    first = F.when(F.coalesce("expansion_type", F.lit("exact")) == "exact", 0).when(F.col("expansion_type") == "neighbor", 2).otherwise(1)
    own = hits.where(F.length(F.trim(F.coalesce("content", F.lit("")))) > 0).withColumns({"first": first, "same": F.sha2(F.concat(normalized_space(F.col("content")), evidence_key(*locators)), 256), "len": F.length("content")})
    once = own.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "same").orderBy("first", "pos"))).where("n = 1")
    rows = once.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("first", "pos", "chunk_id", "len"))).alias("rows"))
    id_type = dict(hits.dtypes)["chunk_id"]
    start = F.struct(F.lit(0).alias("used"), F.array().cast(f"array<struct<chunk_id:{id_type},n_chars:int>>").alias("kept"))

    def step(acc, r):
        fits = acc["used"] + r["len"] <= max_chars
        more = F.concat(acc["kept"], F.array(F.struct(r["chunk_id"].alias("chunk_id"), r["len"].cast("int").alias("n_chars"))))
        return F.struct(F.when(fits, acc["used"] + r["len"]).otherwise(acc["used"]).alias("used"), F.when(fits, more).otherwise(acc["kept"]).alias("kept"))

    packed = rows.select("query_id", F.aggregate("rows", start, step).alias("acc"))
    return packed.select("query_id", F.posexplode("acc.kept").alias("place", "k")).select("query_id", "k.chunk_id", F.col("place").alias("place"), "k.n_chars")


def escaped(c: F.Column) -> F.Column:
    """Text safe in an attribute."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def rendered_source() -> F.Column:
    """A source's numbered block with escaped attributes and its score to four decimals."""
    name = escaped(F.coalesce("title", F.lit("")))
    return F.format_string('<document index="%d" title="%s" score="%.4f">\n%s\n</document>', F.col("place") + 1, name, F.col("score"), F.col("content"))


def render_context(sources: DataFrame) -> DataFrame:
    """(query_id, context): the blocks of each query's sources in order, a blank line between them."""
    blocks = sources.select("query_id", "place", rendered_source().alias("block"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "block")))
    return blocks.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("context"))


def trim_context_tail(sources: DataFrame, max_chars: int) -> DataFrame:
    """The leading sources whose rendered blocks, with the blank lines between, fit."""
    upto = Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    sized = sources.withColumn("__used", F.sum(F.length(rendered_source()) + 2).over(upto) - 2)
    return sized.where(F.col("__used") <= max_chars).drop("__used")


def group_evidence(hits: DataFrame, locators: tuple[str, ...] = LOCATORS) -> DataFrame:
    """Hits of one provenance and content as one: best score, first position, all their tokens."""
    keyed = hits.withColumn("evidence", F.sha2(F.concat(normalized_space(F.col("content")), evidence_key(*locators)), 256))
    return keyed.groupBy("query_id", "evidence").agg(F.max("score").alias("score"), F.min("pos").alias("pos"), F.min_by("chunk_id", "pos").alias("chunk_id"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tokens")))).alias("tokens"))


def citation_order(evidence: DataFrame) -> DataFrame:
    """Rank evidence by coverage, best overlap, score and position."""
    order = Window.partitionBy("query_id").orderBy(F.desc("coverage"), F.desc("overlap"), F.desc("score"), "pos")
    return evidence.withColumn("rank", F.row_number().over(order))


def citation_id_collisions(hits: DataFrame, locators: tuple[str, ...] = LOCATORS) -> DataFrame:
    """(query_id, chunk_id, identities): chunk ids that stand for more than one evidence."""
    return hits.groupBy("query_id", "chunk_id").agg(F.count_distinct(evidence_key(*locators)).alias("identities")).where("identities > 1")


def citations_for_answers(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(answer_id, marker, chunk_id): one row for each distinct [n] of an answer that names one of its sources."""
    marks = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"\[(\d{1,6})\]"), 1), lambda m: m.cast("int")))
    named = answers.select("answer_id", "query_id", F.explode(marks).alias("marker"))
    own = sources.select("query_id", (F.col("place") + 1).alias("marker"), "chunk_id")
    return named.join(own, ["query_id", "marker"]).select("answer_id", "marker", "chunk_id")


def claim_tokens(text: F.Column, stopwords: tuple[str, ...] = ()) -> F.Column:
    """Distinct case-folded words of two characters or more, and numbers, without [n] marks and stop words."""
    words = content_tokens(F.regexp_replace(text, r"\[\d+\]", " "), stopwords, min_len=1)
    return F.filter(words, lambda t: (F.length(t) > 1) | t.rlike(r"^\p{N}+$"))


def specific_tokens(text: F.Column) -> F.Column:
    """Distinct case-folded words with a digit, and words of capitals only; . / % + - belong to words, [n] marks don't."""
    words = F.regexp_extract_all(F.regexp_replace(text, r"\[\d+\]", " "), F.lit(r"([\p{L}\p{N}_./%+-]+)"), 1)
    capitals = lambda t: (F.length(t) >= 2) & t.rlike(r"\p{L}") & (F.upper(t) == t)
    return F.array_distinct(F.transform(F.filter(words, lambda t: t.rlike(r"\p{N}") | capitals(t)), case_folded))


def best_excerpt(hits: DataFrame, claims: DataFrame, longest: int = 360, ideal: int = 220, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """(claim_id, chunk_id, excerpt): the sentence, list item or table row of a hit that supports a claim best.

    Best: most of the claim's specific words (codes, years, capitals), then most of its words, then the densest, then the
    nearest to the ideal length, then the first. A claim none of whose words is found, or that has specific words none of which
    is found, has no row. An excerpt that is too long is cut around the first of the claim's words in it.
    """
    asked = claims.select("claim_id", "query_id", claim_tokens(F.col("claim"), stopwords).alias("c"), specific_tokens(F.col("claim")).alias("cs"))
    parts = hits.select("query_id", "chunk_id", "pos", F.posexplode(F.split("content", r"(?<=[.!?;])\s+|\n+")).alias("at", "raw"))
    ruler = F.col("raw").rlike(r"^\s*\|?(?:\s*:?-{3,}:?\s*\|?)+\s*$")
    parts = parts.where(~ruler).withColumn("part", F.trim(F.regexp_replace("raw", r"\s+", " "))).where("part <> ''")
    scored = parts.join(asked, "query_id").withColumns({"w": claim_tokens(F.col("part"), stopwords), "specific": F.size(F.array_intersect(specific_tokens(F.col("part")), "cs"))})
    both = F.size(F.array_intersect("w", "c"))
    scored = scored.withColumns({"both": both, "dense": both / F.greatest(F.lit(1), F.size("w")), "off": -F.abs(F.length("part") - ideal)})
    key = F.struct("specific", "both", "dense", "off", (-F.col("pos")).alias("p"), (-F.col("at")).alias("a"))
    best = scored.groupBy("claim_id").agg(F.max_by(F.struct("chunk_id", "part", "c", "cs", "both", "specific"), key).alias("b")).select("claim_id", "b.*")
    best = best.where((F.col("both") > 0) & ((F.size("cs") == 0) | (F.col("specific") > 0)))
    places = F.filter(F.transform("c", lambda t: F.position(t, case_folded(F.col("part")))), lambda k: k > 0)
    anchor = F.coalesce(F.array_min(places) - 1, F.lit(0))
    start = F.greatest(F.lit(0), F.least(anchor - longest // 3, F.length("part") - longest))
    middle = F.trim(F.substring("part", start + 1, F.lit(longest)))
    cut = F.concat(F.when(start > 0, "…").otherwise(""), middle, F.when(start + longest < F.length("part"), "…").otherwise(""))
    return best.select("claim_id", "chunk_id", F.when(F.length("part") > longest, cut).otherwise(F.col("part")).alias("excerpt"))


def citation_details(cited: DataFrame, answers: DataFrame, sources: DataFrame, snippet: int = 280) -> DataFrame:
    """Each (answer_id, marker, chunk_id) of ``cited`` with what a reader is shown of its source.

    The snippet is the source's excerpt that best supports the paragraphs of the answer with its [n] and the question, else
    the beginning of the content. ``answers`` has (answer_id, query_id, query, text), ``sources`` (query_id, chunk_id, content,
    score, title, source, source_url, source_type, doc_id, page_number, section, published_at, retrieved_at).
    """
    j = cited.join(answers.select("answer_id", "query_id", "query", "text"), "answer_id").join(sources, ["query_id", "chunk_id"])
    own = lambda p: F.array_contains(F.regexp_extract_all(p, F.lit(r"\[(\d{1,6})\]"), 1), F.col("marker").cast("string"))
    claim = F.concat_ws("\n", F.array_join(F.filter(F.split("text", r"\n\s*\n"), own), " "), "query")
    key = F.struct("answer_id", "marker")
    asked = j.select(key.alias("claim_id"), key.alias("query_id"), claim.alias("claim"))
    found = best_excerpt(j.select(key.alias("query_id"), "chunk_id", F.lit(0).alias("pos"), "content"), asked).select(F.col("claim_id.answer_id").alias("answer_id"), F.col("claim_id.marker").alias("marker"), "excerpt")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    some = lambda c: F.when(text(c) != "", text(c))
    name = F.coalesce(some("title"), some("source"), F.concat(F.lit("Chunk "), F.col("chunk_id").cast("string")))
    begins = F.substring(F.trim(F.regexp_replace(text("content"), r"\s+", " ")), 1, snippet)
    return j.join(found, ["answer_id", "marker"], "left").select(
        "answer_id", "marker", "chunk_id", name.alias("title"), name.alias("source"), *(text(c).alias(c) for c in ("source_url", "source_type", "doc_id", "published_at", "retrieved_at")),
        F.col("page_number").alias("page"), "section", F.coalesce("excerpt", begins).alias("snippet"), F.round("score", 6).alias("score"),
    )


def numbered_methods(hits: DataFrame, total: str, item: str, title: str = "", most: int = 10, longest: int = 800) -> DataFrame:
    """(query_id, number, text): complete numbered lists in hits, from 1 to the one declared total.

    ``total`` finds a declared number of items, ``item`` a line's number (group 1) and text (group 2). A query has no rows if
    several totals are declared or none, the total isn't between 1 and ``most``, a number has two texts (folded), a number is missing
    or beyond the total, or a text doesn't begin with ``title`` (folded), is longer than ``longest`` or has an unsafe sign.
    If ``hits`` has columns year and places, the years must be one, and a source of a single place refuses
    the list unless the query asked for places (column asked_places) and all such sources have the same.
    """
    lines = hits.select("query_id", F.explode(F.split("content", "\n")).alias("line"))
    said = lines.select("query_id", F.regexp_extract("line", total, 1).try_cast("int").alias("total")).where("total is not null").groupBy("query_id").agg(F.min("total").alias("total"), F.max("total").alias("most"))
    said = said.where((F.col("total") == F.col("most")) & F.col("total").between(1, most)).drop("most")
    if {"year", "places", "asked_places"} <= set(hits.columns):
        single = F.when(F.size("places") == 1, F.get("places", F.lit(0)))
        scope = hits.groupBy("query_id").agg(F.count_distinct(F.coalesce(F.col("year").cast("string"), F.lit(""))).alias("years"), F.bool_or(F.col("year").isNull()).alias("no_year"), F.count_distinct(single).alias("singles"), F.max(F.size("asked_places")).alias("asked"))
        good = scope.where((F.col("years") == 1) & ~F.col("no_year") & ((F.col("singles") == 0) | ((F.col("singles") == 1) & (F.col("asked") > 0))))
        said = said.join(good.select("query_id"), "query_id")
    items = lines.select("query_id", F.regexp_extract("line", item, 1).try_cast("int").alias("number"), F.regexp_replace(F.regexp_replace(F.regexp_extract("line", item, 2), r"\s+", " "), r"^[ .:;]+|[ .:;]+$", "").alias("text")).where("number is not null")
    fits = F.startswith(fold(F.col("text")), fold(F.lit(title))) & (F.length("text") <= longest) & ~F.col("text").rlike(r"[<>\[\]]|https?://")
    one = items.groupBy("query_id", "number").agg(F.min("text").alias("text"), F.count_distinct(fold(F.col("text"))).alias("texts"), F.bool_and(fits).alias("fits"))
    whole = one.groupBy("query_id").agg(F.count("*").alias("n"), F.min("number").alias("least"), F.max("number").alias("last"), F.max("texts").alias("texts"), F.bool_and("fits").alias("fits")).join(said, "query_id")
    whole = whole.where("n = total AND least = 1 AND last = total AND texts = 1 AND fits").select("query_id")
    return one.join(whole, "query_id").select("query_id", "number", "text")
