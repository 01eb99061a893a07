"""Registered queries of single steps: seeds and covers, citations, numbered lists, pages, sources, frontmatter; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import catalog_tables, chunking, context, dense, embedding, evaluation, fusion, quality
from corpusloom.plans.corpus_queries import CHUNKS_SQL, docs, sql_tokens
from corpusloom.plans.evidence_queries import _answers_of, _found, _hits, _spaced
from corpusloom.plans.search_queries import _ITEMS, _benchmark, _near_sql, _search_sql, dense_topk
from corpusloom.runtime import read_table
from corpusloom.sources import corpus


def _labelled_hits(spark, sf) -> DataFrame:
    """The nearest vectors of every fiftieth vector with their labels; limit says how many a query gives out."""
    labels = read_table(spark, sf, "embeddings").select("vec_id", "label")
    return dense_topk(spark, sf).join(labels, "vec_id").select("query_id", F.col("vec_id").alias("chunk_id"), F.col("rank").alias("pos"), "rank", "score", "label", F.lit(14).alias("limit"))


def min_score(spark, sf):
    return embedding.min_score(_labelled_hits(spark, sf), 0.3).select("query_id", "chunk_id", "score")


def expand_guarded(spark, sf):
    """Vectors beside a hit are its table parts (one step) and neighbours (two steps); the guard wants the hit's label."""
    hits, v = _labelled_hits(spark, sf), read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("own"))
    seeds = hits.select("query_id", F.col("chunk_id").alias("seed_id"), "label")
    beside = lambda steps, name: seeds.select("*", F.posexplode(F.array(*(F.col("seed_id") + s for s in steps))).alias(name, "chunk_id"))
    siblings, neighbours = beside((-1, 1), "table_part"), beside((-2, 2), "place")
    both = siblings.drop("table_part").unionByName(neighbours.drop("place"))
    allowed = both.join(v, "chunk_id").where("own = label").select("query_id", "seed_id", "chunk_id")
    return fusion.expand_guarded(hits, siblings, neighbours, allowed).withColumn("score", F.round("score", 6))


def hydrate_guarded(spark, sf):
    """Hits under the vector ten times their label, where the guard (equal parity of child and query) lets them."""
    h = _labelled_hits(spark, sf).withColumns({"parent_chunk_id": F.col("label").cast("long") * 10, "chunk_type": F.when(F.col("chunk_id") % 7 == 0, "table").otherwise("child")})
    parents = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.lit("parent").alias("chunk_type"))
    return fusion.hydrate_parents(h, parents, h.where("chunk_id % 2 = query_id % 2"))


def vector_fallback(spark, sf):
    """The next vector stands in for a hypothetical document if its label is the same; cosine of what is searched with to the vector."""
    v = read_table(spark, sf, "embeddings")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"), F.col("label").alias("next_label"))
    j = v.join(after, "vec_id", "left").withColumn("hypothetical", F.when(F.col("label") == F.col("next_label"), F.col("next")))
    return j.select("vec_id", F.round(tx.cosine(dense.first_valid_vector("hypothetical", "embedding", 64), F.col("embedding")), 6).alias("cosine"))


def seed_cover(spark, sf):
    """Hits of the benchmark items that cover the items' long words; the shortest hits are overviews."""
    h = _hits(spark, sf, 10)
    words = F.filter(tx.content_tokens(F.col("query")), lambda t: F.length(t) > 8)
    items = h.select("query_id", "chunk_id", "rank", F.array_intersect(words, tx.tokens(F.col("content"))).alias("items"), (F.length("content") < 600).alias("overview"))
    return catalog_tables.seed_cover(items, 6)


def seed_cover_catalog(spark, sf):
    """Hits as catalogue rows: their length's hundreds are the year, language and source the places, long words the names."""
    h = _hits(spark, sf, 10)
    names = F.filter(tx.content_tokens(F.col("content")), lambda t: F.length(t) > 12)
    year = F.array((F.length("content") % 3 + 2020).cast("int"))
    asked = F.when(F.length("query") % 2 == 0, F.array(F.lit(2021))).otherwise(F.array().cast("array<int>"))
    rows = h.select("query_id", "chunk_id", "rank", year.alias("years"), F.array("lang", "source").alias("places"), names.alias("names"), asked.alias("asked_years"))
    return catalog_tables.seed_cover_catalog(rows, 4)


def citation_details(spark, sf):
    h = _hits(spark, sf, 10)
    a, _ = _answers_of(spark, sf, h)
    answers = a.join(_benchmark(spark, sf), "query_id")
    none = F.lit(None).cast("string")
    title = F.when(F.length("content") % 2 == 0, F.col("lang"))
    sources = h.select("query_id", "chunk_id", "content", "score", title.alias("title"), "source", none.alias("source_url"), F.lit("document").alias("source_type"), F.col("chunk_id").alias("doc_id"), F.lit(1).alias("page_number"), F.col("lang").alias("section"), none.alias("published_at"), none.alias("retrieved_at"))
    cited = context.citations_for_answers(a, h.select("query_id", (F.col("rank") - 1).alias("place"), "chunk_id"))
    d = context.citation_details(cited, answers, sources)
    return d.select("answer_id", "marker", "chunk_id", "title", "source_type", "doc_id", "page", "section", F.round("score", 4).alias("score"), F.length("snippet").between(1, 362).alias("has_snippet"))


def numbered_lists(spark, sf):
    """Conversations as numbered lists: a line a turn, of a system turn none; the first line declares the turns, every other
    one too few of them."""
    c = read_table(spark, sf, "conversations")
    line = F.when(F.col("role") != "system", F.concat((F.col("turn") + 1).cast("string"), F.lit(". "), F.trim(F.regexp_replace("text", r"\s+", " "))))
    n = c.groupBy("conv_id").agg((F.max("turn") + 1 - F.col("conv_id") % 2).alias("n"))
    items = c.select(F.col("conv_id").alias("query_id"), line.alias("content")).where("content is not null")
    said = n.select(F.col("conv_id").alias("query_id"), F.concat(F.col("n").cast("string"), F.lit(" turns:")).alias("content"))
    m = context.numbered_methods(items.unionByName(said), r"^(\d+) turns:$", r"^(\d+)\. (.*)$", longest=100_000)
    return m.select("query_id", "number", F.md5("text").alias("digest"))


def _table_chunks(spark, sf):
    """Chunks of every fiftieth document: runs of five are the parts of a table, and every other run is plain chunks."""
    c = chunking.chunk_fixed(docs(spark, sf).where("doc_id % 50 = 0"))
    run = F.floor(F.col("chunk_index") / 5)
    return c.select("doc_id", "chunk_id", "chunk_index", F.when(run % 2 == 0, run).alias("table_index"), (F.col("chunk_index") % 5 + 1).alias("table_part"), F.array(F.lit("x")).alias("heading_path"), F.lit("text").alias("chunk_type"), (F.col("doc_id") * 1000000 + F.col("chunk_index")).alias("corpus_pos"))


def expand_in_order(spark, sf):
    """A document's chunks as one query's hits, every third first: each brings its table's parts or its neighbours, 12 in all."""
    c = _table_chunks(spark, sf)
    place = Window.partitionBy("doc_id").orderBy(F.col("chunk_index") % 3, "chunk_index")
    hits = c.select(F.col("doc_id").alias("query_id"), "chunk_id", F.row_number().over(place).alias("pos"), (1 / (F.col("chunk_index") + 1)).alias("score"), F.lit(12).alias("limit"))
    seeds = hits.select("query_id", "chunk_id")
    siblings = fusion.table_sibling_join(seeds, c).select("query_id", "seed_id", "chunk_id", F.lit("table_sibling").alias("kind"), F.col("table_part").alias("place"))
    near = fusion.neighbor_join(seeds, c).select("query_id", "seed_id", "chunk_id", F.lit("neighbor").alias("kind"), "place")
    return embedding.expand_in_order(hits, siblings.unionByName(near)).withColumn("score", F.round("score", 6))


def last_writes(spark, sf):
    """Of each source the text of its last document, at the place of its first."""
    d = docs(spark, sf).select("source", F.col("doc_id").alias("pos"), "text")
    return dense.last_write_wins(d, "source").select("source", "pos", F.md5("text").alias("digest"))


def partial_recrawl(spark, sf):
    """Pages in two crawls: the second asked for every third page, whose links are carried over."""
    p = read_table(spark, sf, "pages").withColumns({"source_url": F.col("url"), "http_status": F.when(F.length("html") > 1500, 200).otherwise(404), "attachments": F.when(quality.is_pdf_link(F.col("url")), F.array("url"))})
    old = p.where("page_id % 5 <> 4").select("page_id", "source_url", "http_status", "attachments")
    new = p.where("page_id % 3 = 0").select("page_id", "source_url", "http_status", F.lit(None).cast("array<string>").alias("attachments"))
    merged = quality.merge_partial_recrawl(old, new, new.select("source_url"))
    return merged.select("page_id", "http_status", F.coalesce(F.size("attachments"), F.lit(0)).alias("n_attachments"))


def page_documents(spark, sf):
    """Documents in pages of 2,000 characters, each page with text as a document of its own."""
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / 2000).cast("int"))
    pages = F.transform(starts, lambda k: F.struct((k + 1).alias("page_number"), F.substring(F.col("text"), k * 2000 + 1, F.lit(2000)).alias("text")))
    e = chunking.explode_pages(docs(spark, sf).select("doc_id", pages.alias("pages")))
    return e.select("doc_id", "parent_doc_id", "page_number", "content_hash")


def headings_from_words(spark, sf):
    """Order lines as words on a page: two a text line, set in the size of their quantity."""
    w = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_number"), F.floor(F.col("l_linenumber") / 2).cast("double").alias("top"), F.col("l_linenumber").cast("double").alias("x0"), (F.col("l_quantity").cast("double") / 4).alias("size"), F.concat_ws(" ", F.col("l_linenumber").cast("string"), "l_returnflag").alias("text"))
    h = chunking.headings_from_words(w)
    return h.select("doc_id", F.col("line").cast("int").alias("line"), "text", "level")


def clean_extracted_tables(spark, sf):
    """Conversations as extracted tables: system turns are blank rows, their roles null."""
    c = read_table(spark, sf, "conversations")
    cells = F.array(F.when(F.col("role") != "system", F.col("role")), F.when(F.col("role") == "system", " ").otherwise(F.when(F.col("turn") % 2 == 0, F.col("text"))))
    t = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", cells.alias("cells")))), lambda r: r["cells"]).alias("rows"))
    kept = chunking.clean_extracted_tables(t)
    return kept.select("conv_id", F.size("rows").alias("n_rows"), F.md5(F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n")).alias("digest"))


def first_sentences(spark, sf):
    s = corpus.section_documents(docs(spark, sf).select("doc_id", F.col("text").alias("body")), r"^([^.]*\.)", "first")
    return s.select("doc_id", "parent_doc_id", "section", F.md5("body").alias("digest"))


def composed_pages(spark, sf):
    d = docs(spark, sf).select("doc_id", F.when(F.col("doc_id") % 9 != 0, F.col("source")).alias("title"), F.lit(1).alias("page_number"), "text", F.array("lang").alias("tables_md"), F.when(F.col("n_chars") > 1000, F.array("source", "lang")).otherwise(F.array().cast("array<string>")).alias("pdf_links"))
    return d.select("doc_id", F.md5(embedding.composed_page()).alias("digest"))


def parsed_scalars(spark, sf):
    """The words of every text as frontmatter scalars, counted by kind, numbers added up."""
    words = docs(spark, sf).select(F.explode(F.split("text", r"[ \n]+")).alias("w")).select(tx.parsed_scalar(F.col("w")).alias("s"))
    return words.groupBy(F.col("s.kind").alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length("s.text")).alias("chars"), F.sum(F.col("s.number").cast("double")).alias("total"))


def pages_with_text(spark, sf):
    p = read_table(spark, sf, "pages").withColumn("extraction_status", F.when(F.length("html") < 1500, "no_text_detected").when(F.col("page_id") % 4 != 0, "ok"))
    kept, removed = quality.split_no_text_pages(p)
    of = lambda df, name: df.select("page_id", F.lit(name).alias("side"))
    return of(kept, "kept").unionByName(of(removed, "removed"))


def pages_with_tables(spark, sf):
    """Pages with more than two bold parts, which stand in for tables; the given pages have none."""
    p = read_table(spark, sf, "pages").select("page_id", F.col("url").alias("source_url"), (F.regexp_count("html", F.lit("<b>")) - 2).alias("source_table_count"))
    return quality.pages_of_sources_with_tables(p.select("page_id", "source_url"), p).select("page_id")


def tabular_chunks(spark, sf):
    c = chunking.chunk_fixed(docs(spark, sf))
    return quality.tabular_chunks(c, "the", ["|", "ing "]).select("doc_id", "chunk_index")


def frontmatter(spark, sf):
    """Every document as a Markdown file, read back: ids and hashes of the block, where it has them, and the body."""
    d = docs(spark, sf)
    fields = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("title"), F.col("source"), F.lit("lang"), F.col("lang"))).otherwise(F.create_map(F.lit("doc_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.lit("title"), F.col("source")))
    files = d.select(F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), fields.alias("fields"), F.col("text").alias("body")).select("path", corpus.markdown_document().alias("raw"))
    return corpus.parsed_frontmatter(files).select("path", "doc_id", "content_hash", F.col("fields")["title"].alias("title"), F.size("fields").alias("n_fields"))


def raw_metadata(spark, sf):
    """Pages with their crawl records: each is nested two attachments deep in the record of its hundred."""
    p = read_table(spark, sf, "pages")
    own = F.struct(F.concat(F.lit("raw/"), F.col("page_id").cast("string"), F.lit(".html")).alias("raw_file"), "url")
    raw = p.groupBy(F.floor(F.col("page_id") / 100).alias("g")).agg(F.to_json(F.struct(F.lit("list.json").alias("raw_file"), F.array(F.struct(F.array_sort(F.collect_list(own)).alias("attachments"))).alias("attachments"))).alias("json"))
    files = p.select("page_id", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("RAW\\"), F.col("page_id").cast("string"), F.lit(".html"))).otherwise(F.concat(F.lit("other/"), F.col("page_id").cast("string"), F.lit(".HTML"))).alias("path"))
    m = corpus.attach_raw_metadata(files, corpus.flattened_records(raw))
    return m.select("page_id", F.get_json_object("meta", "$.url").alias("url"))


def catalog_profiles(spark, sf):
    """The messages of each role as an entry of its own, as a profile of its conversation's turns."""
    c = read_table(spark, sf, "conversations").withColumn("t", F.trim(F.regexp_replace("text", r"\s+", " ")))
    e = c.select(F.col("conv_id").alias("query_id"), F.col("role").alias("campus"), F.lit("2024").alias("admission_year"), F.col("turn").alias("row"), (F.col("turn") + 1).alias("marker"), F.array(F.lit("turn"), F.lit("text")).alias("labels"), F.array(F.col("turn").cast("string"), "t").alias("cells"), F.when(F.col("turn") < 2, "Start").alias("section"), F.lit(None).cast("string").alias("subsection"))
    return catalog_tables.render_profile(e).select("query_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def evidence_rules(spark, sf):
    """Documents as evidence of themselves: short ones have no quote, those of one source no address; pages count from 0."""
    d = docs(spark, sf).select(F.md5("text").alias("chunk_id"), "doc_id", F.col("lang").alias("title"), F.when(F.col("source") != "src3", F.col("source")).alias("source_url"), F.when(F.col("n_chars") > 60, F.col("text")).alias("quote"), (F.col("doc_id") % 50).alias("page"))
    f = evaluation.evidence_findings(d)
    return f.groupBy("rule").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        min_score, expand_guarded, expand_in_order, hydrate_guarded, vector_fallback, seed_cover, seed_cover_catalog, citation_details, numbered_lists, last_writes, partial_recrawl, page_documents, headings_from_words, clean_extracted_tables,
        first_sentences, composed_pages, parsed_scalars, pages_with_text, pages_with_tables, tabular_chunks, frontmatter, raw_metadata, catalog_profiles, evidence_rules,
    )
}

_NEAR = _near_sql("a", "true", 10)
_LONG = f"list_distinct(list_filter({sql_tokens('query')}, lambda t: length(t) > 8))"


def _claim(x: str) -> str:
    bare = f"regexp_replace({x}, '\\[\\d+\\]', ' ', 'g')"
    return f"list_distinct(list_filter({sql_tokens(bare)}, lambda t: length(t) > 1 OR regexp_full_match(t, '\\p{{N}}+')))"


def _specific(x: str) -> str:
    words = f"regexp_extract_all(regexp_replace({x}, '\\[\\d+\\]', ' ', 'g'), '[\\p{{L}}\\p{{N}}_./%+-]+')"
    return f"list_distinct(list_transform(list_filter({words}, lambda t: regexp_matches(t, '\\p{{N}}') OR (length(t) >= 2 AND regexp_matches(t, '\\p{{L}}') AND upper(t) = t)), lambda t: replace(lower(t), 'ß', 'ss')))"


#: as the operator of the seed covers folds: a hit adds if it has an item that no hit before it has
_COVER = f"""
{_found(10)}, it AS (SELECT query_id, chunk_id, rank, length(text) < 600 AS overview, list_intersect({_LONG}, {sql_tokens('text')}) AS items FROM h),
lo AS (SELECT query_id, min(rank) AS lead FROM it WHERE overview AND len(items) > 0 GROUP BY 1), o AS (SELECT it.*, rank = lead AS first FROM it LEFT JOIN lo USING (query_id)),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(first, false) DESC, rank) AS k FROM o),
e AS (SELECT query_id, k, unnest(items) AS item FROM n), f AS (SELECT query_id, item, min(k) AS k FROM e GROUP BY 1, 2), adds AS (SELECT DISTINCT query_id, k FROM f),
picked AS (SELECT n.query_id, chunk_id, row_number() OVER (PARTITION BY n.query_id ORDER BY CASE WHEN first THEN 0 WHEN adds.k IS NOT NULL THEN 1 ELSE 2 END, rank) - 1 AS place FROM n LEFT JOIN adds ON adds.query_id = n.query_id AND adds.k = n.k)"""

_CATALOG_COVER = f"""
{_found(10)}, y AS (SELECT query_id, chunk_id, rank, length(text) % 3 + 2020 AS year, [lang, source] AS places, list_distinct(list_filter({sql_tokens('text')}, lambda t: length(t) > 12)) AS names, length(query) % 2 = 0 AS asks FROM h),
own AS (SELECT * FROM y WHERE len(names) > 0 AND (NOT asks OR year = 2021)), c AS MATERIALIZED (SELECT * FROM own WHERE true QUALIFY year = max(year) OVER (PARTITION BY query_id)),
picks AS (
  SELECT query_id, 0 AS step, CAST(NULL AS BIGINT) AS chunk_id, CAST([] AS VARCHAR[]) AS places, CAST([] AS VARCHAR[]) AS names FROM c GROUP BY query_id
  UNION ALL
  SELECT query_id, step, chunk_id, places, names FROM (
    SELECT picks.query_id, picks.step + 1 AS step, c.chunk_id, list_concat(picks.places, c.places) AS places, list_concat(picks.names, c.names) AS names, len(list_filter(c.places, lambda x: NOT list_contains(picks.places, x))) AS p, len(list_filter(c.names, lambda x: NOT list_contains(picks.names, x))) AS n, c.rank
    FROM picks JOIN c USING (query_id) WHERE picks.step < 4) WHERE p > 0 OR n > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY p DESC, n DESC, rank) = 1)"""

_EXCERPTS = f"""
{_search_sql(_ITEMS, 3)}, h AS (SELECT query_id, query, chunk_id, rank, text FROM hits JOIN q USING (query_id) JOIN documents d ON d.doc_id = hits.chunk_id),
l AS (SELECT *, string_split(regexp_replace(regexp_replace(text, '([.!?;])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)) AS raws FROM h),
u AS (SELECT query_id, query, chunk_id, rank, unnest(raws) AS raw, unnest(generate_series(1, len(raws))) AS spot FROM l),
pt AS (SELECT *, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS part FROM u WHERE NOT regexp_matches(raw, '^\\s*\\|?(?:\\s*:?-{{3,}}:?\\s*\\|?)+\\s*$')),
wd AS (SELECT *, {_claim('part')} AS w, {_claim('query')} AS c, {_specific('query')} AS cs, {_specific('part')} AS ps FROM pt WHERE part <> ''),
m AS (SELECT *, len(list_intersect(ps, cs)) AS special, len(list_intersect(w, c)) AS shared, len(list_intersect(w, c)) / greatest(1, len(w)) AS dense FROM wd),
best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY special DESC, shared DESC, dense DESC, abs(length(part) - 220), rank, spot) = 1),
anchored AS (SELECT *, coalesce(list_min(list_filter(list_transform(c, lambda t: strpos(replace(lower(part), 'ß', 'ss'), t)), lambda k: k > 0)) - 1, 0) AS anchor FROM best WHERE shared > 0 AND (len(cs) = 0 OR special > 0)),
s2 AS (SELECT *, greatest(0, least(anchor - 120, length(part) - 360)) AS start FROM anchored)"""

ORACLE_SQL = {
    "best_excerpt": f"WITH {_EXCERPTS} SELECT query_id AS claim_id, chunk_id, CASE WHEN length(part) <= 360 THEN part ELSE concat(CASE WHEN start > 0 THEN '…' ELSE '' END, trim(substr(part, start + 1, 360)), CASE WHEN start + 360 < length(part) THEN '…' ELSE '' END) END AS excerpt FROM s2",
    "embed_chunks": f"WITH {CHUNKS_SQL} SELECT left(sha256(doc_id || chr(31) || chunk_index || chr(31) || content), 24) AS chunk_id, 256 AS dim, true AS valid FROM chunks",
    "min_score": f"WITH {_NEAR} SELECT query_id, vec_id AS chunk_id, score FROM a WHERE score >= 0.3",
    "expand_guarded": f"""
WITH {_NEAR}, m AS (SELECT query_id, vec_id AS chunk_id, rank AS pos, score, 'exact' AS kind, 0 AS place FROM a
  UNION ALL SELECT query_id, e.vec_id, rank, score - 0.000001, 'table_sibling', CASE WHEN e.vec_id < a.vec_id THEN 0 ELSE 1 END FROM a JOIN embeddings e ON abs(e.vec_id - a.vec_id) = 1 AND e.label = a.label
  UNION ALL SELECT query_id, e.vec_id, rank, score - 0.00001, 'neighbor', CASE WHEN e.vec_id < a.vec_id THEN 0 ELSE 1 END FROM a JOIN embeddings e ON abs(e.vec_id - a.vec_id) = 2 AND e.label = a.label),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kind <> 'exact', pos, kind <> 'table_sibling', place, chunk_id) AS n FROM m),
f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY n) = 1), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n) AS INT) AS rank FROM f)
SELECT query_id, chunk_id, round(score, 6) AS score, kind AS expansion_type, rank FROM r WHERE rank <= 14""",
    "hydrate_guarded": f"WITH {_NEAR} SELECT query_id, CASE WHEN a.vec_id % 7 = 0 OR a.vec_id % 2 <> query_id % 2 OR e.vec_id IS NULL THEN a.vec_id ELSE e.vec_id END AS chunk_id, min(rank) AS pos, max(score) AS score FROM a LEFT JOIN embeddings e ON e.vec_id = a.label * 10 GROUP BY 1, 2",
    "vector_fallback": "SELECT v.vec_id, CASE WHEN n.label = v.label THEN round(list_cosine_similarity(CAST(n.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) + 0.0 ELSE 1.0 END AS cosine FROM embeddings v LEFT JOIN embeddings n ON n.vec_id = v.vec_id + 1",
    "seed_cover": f"WITH {_COVER} SELECT query_id, chunk_id, CAST(place AS INT) AS place FROM picked WHERE place < 6",
    "seed_cover_catalog": f"WITH RECURSIVE {_CATALOG_COVER} SELECT query_id, chunk_id, CAST(step - 1 AS INT) AS place FROM picks WHERE step > 0",
    "citation_details": f"""
WITH {_found(10)} SELECT query_id AS answer_id, rank AS marker, chunk_id, CASE WHEN length(text) % 2 = 0 THEN lang ELSE source END AS title, 'document' AS source_type, CAST(chunk_id AS VARCHAR) AS doc_id, 1 AS page, lang AS section, round(score, 4) AS score, true AS has_snippet
FROM h WHERE contains(text, query)""",
    "numbered_lists": r"""
WITH w AS (SELECT conv_id, max(turn) + 1 - conv_id % 2 AS n, count(DISTINCT turn) FILTER (WHERE role <> 'system') AS d, count(*) FILTER (WHERE role <> 'system') AS m, min(turn) FILTER (WHERE role <> 'system') AS least, max(turn) FILTER (WHERE role <> 'system') AS last,
  bool_or(role <> 'system' AND regexp_matches(text, '[<>\[\]]|https?://')) AS unsafe FROM conversations GROUP BY 1)
SELECT conv_id AS query_id, turn + 1 AS number, md5(trim(regexp_replace(text, '\s+', ' ', 'g'), ' .:;')) AS digest FROM conversations JOIN w USING (conv_id) WHERE n = d AND m = d AND least = 0 AND last = n - 1 AND n <= 10 AND NOT unsafe""",
    "expand_in_order": f"""
WITH RECURSIVE {CHUNKS_SQL}, c AS (SELECT doc_id, chunk_index AS i, left(sha256(doc_id || chr(31) || chunk_index || chr(31) || content), 24) AS id FROM chunks WHERE doc_id % 50 = 0),
n AS (SELECT doc_id, max(i) AS last FROM c GROUP BY 1),
o AS (SELECT c.doc_id, i, row_number() OVER (PARTITION BY c.doc_id ORDER BY i % 3, i) AS pos, 1 / (i + 1) AS score,
  CASE WHEN i // 5 % 2 = 0 THEN list_transform(list_filter(range(i // 5 * 5, i // 5 * 5 + 5), lambda x: x <= last), lambda x: {{'i': x, 's': 1 / (i + 1) - 1e-6, 'k': CASE WHEN x = i THEN 'exact' ELSE 'table_sibling' END}})
  ELSE [{{'i': i, 's': 1 / (i + 1), 'k': 'exact'}}] || list_transform(list_filter([i - 1, i + 1, i - 2, i + 2], lambda x: x BETWEEN 0 AND last), lambda x: {{'i': x, 's': 1 / (i + 1) - 1e-5, 'k': 'neighbor'}}) END AS brings FROM c JOIN n USING (doc_id)),
f AS (SELECT doc_id, CAST(0 AS BIGINT) AS pos, o.brings[1:0] AS out FROM o WHERE pos = 1
  UNION ALL SELECT f.doc_id, o.pos, CASE WHEN len(out) >= 12 OR list_contains(list_transform(out, lambda x: x.i), o.i) THEN out ELSE (out || list_filter(brings, lambda x: NOT list_contains(list_transform(out, lambda y: y.i), x.i)))[1:12] END FROM f JOIN o ON o.doc_id = f.doc_id AND o.pos = f.pos + 1),
w AS (SELECT doc_id, unnest(out) AS x, generate_subscripts(out, 1) AS rank FROM (SELECT doc_id, arg_max(out, pos) AS out FROM f GROUP BY 1))
SELECT w.doc_id AS query_id, c.id AS chunk_id, round(x.s, 6) AS score, x.k AS expansion_type, CAST(rank AS INT) AS rank FROM w JOIN c ON c.doc_id = w.doc_id AND c.i = x.i""",
    "last_writes": "SELECT source, min(doc_id) AS pos, md5(arg_max(text, doc_id)) AS digest FROM documents GROUP BY source",
    "partial_recrawl": r"""
WITH p AS (SELECT *, CASE WHEN length(html) > 1500 THEN 200 ELSE 404 END AS st, regexp_matches(url, '(?i)\.pdf(?:$|[?#])') AS pdf FROM pages),
old AS (SELECT * FROM p WHERE page_id % 5 <> 4), fresh AS (SELECT * FROM p WHERE page_id % 3 = 0)
SELECT page_id, st AS http_status, CAST(pdf AS INT) AS n_attachments FROM old WHERE st = 200 AND url NOT IN (SELECT url FROM fresh)
UNION ALL SELECT page_id, st, CAST(url IN (SELECT url FROM old WHERE pdf) AS INT) FROM fresh""",
    "page_documents": """
WITH k AS (SELECT doc_id, text, unnest(generate_series(0, CAST(greatest(length(text) - 1, 0) // 2000 AS BIGINT))) AS k FROM documents), p AS (SELECT doc_id, k + 1 AS n, substr(text, k * 2000 + 1, 2000) AS t FROM k)
SELECT doc_id || '-p' || printf('%03d', n) AS doc_id, CAST(doc_id AS VARCHAR) AS parent_doc_id, CAST(n AS INT) AS page_number, sha256(t) AS content_hash FROM p WHERE trim(t) <> ''""",
    "headings_from_words": """
WITH w AS (SELECT l_orderkey AS doc_id, l_linenumber // 2 AS line, avg(CAST(l_quantity AS DOUBLE) / 4) AS size, string_agg(l_linenumber || ' ' || l_returnflag, ' ' ORDER BY l_linenumber, l_returnflag) AS text FROM lineitem GROUP BY 1, 2),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY size, line) - 1 AS spot, count(*) OVER (PARTITION BY doc_id) AS n FROM w), d AS (SELECT *, max(CASE WHEN spot = n // 2 THEN size END) OVER (PARTITION BY doc_id) AS middle FROM m)
SELECT doc_id, CAST(line AS INT) AS line, text, CASE WHEN size - middle > 4.0 THEN 1 WHEN size - middle > 1.5 THEN 2 ELSE 3 END AS level FROM d""",
    "clean_extracted_tables": """
WITH r AS (SELECT conv_id, turn, role || '|' || CASE WHEN turn % 2 = 0 THEN text ELSE '' END AS line FROM conversations WHERE role <> 'system')
SELECT conv_id, CAST(count(*) AS INT) AS n_rows, md5(string_agg(line, chr(10) ORDER BY turn)) AS digest FROM r GROUP BY conv_id""",
    "first_sentences": r"""
WITH s AS (SELECT doc_id, trim(regexp_extract(text, '^([^.]*\.)', 1)) AS body FROM documents)
SELECT left(sha256(doc_id || chr(31) || 'first'), 24) AS doc_id, doc_id AS parent_doc_id, 'first' AS section, md5(body) AS digest FROM s WHERE body <> ''""",
    "composed_pages": """
SELECT doc_id, md5(concat_ws(chr(10) || chr(10), CASE WHEN doc_id % 9 <> 0 AND trim(source) <> '' THEN '# ' || source END, '## Page 1', CASE WHEN trim(text) <> '' THEN text END, lang,
  CASE WHEN n_chars > 1000 THEN '## Attachments' || chr(10) || '- ' || source || chr(10) || '- ' || lang END)) AS digest FROM documents""",
    "parsed_scalars": r"""
WITH w AS (SELECT unnest(string_split(regexp_replace(text, '[ \n]+', ' ', 'g'), ' ')) AS w FROM documents),
k AS (SELECT w, CASE WHEN w = '' THEN 'null' WHEN regexp_full_match(w, '(?s)".*"') THEN 'json_string' WHEN regexp_full_match(w, '-?\d+') THEN 'int' WHEN lower(w) IN ('true', 'false') THEN 'bool' ELSE 'string' END AS kind FROM w)
SELECT kind, count(*) AS n, sum(CASE kind WHEN 'string' THEN length(w) WHEN 'json_string' THEN length(w) - 2 END) AS chars, CAST(sum(CASE WHEN kind = 'int' THEN CAST(w AS DOUBLE) END) AS DOUBLE) AS total FROM k GROUP BY kind""",
    "pages_with_text": "SELECT page_id, CASE WHEN length(html) < 1500 THEN 'removed' ELSE 'kept' END AS side FROM pages",
    "pages_with_tables": "SELECT page_id FROM pages WHERE (length(html) - length(replace(html, '<b>', ''))) / 3 > 2",
    "tabular_chunks": f"WITH {CHUNKS_SQL} SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index FROM chunks WHERE contains(lower(content), 'the') AND (contains(content, '|') OR contains(lower(content), 'ing '))",
    "frontmatter": r"""
WITH f AS (SELECT doc_id, source, 'in/' || doc_id || '.md' AS path, regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '^\s+|\s+$', '', 'g') AS body FROM documents)
SELECT path, CASE WHEN doc_id % 3 = 0 THEN left(sha256(path), 24) ELSE 'd' || doc_id END AS doc_id, sha256(body) AS content_hash, source AS title, 2 AS n_fields FROM f""",
    "raw_metadata": "SELECT page_id, url FROM pages",
    "catalog_profiles": r"""
WITH c AS (SELECT conv_id, role, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations),
good AS (SELECT conv_id FROM c GROUP BY 1 HAVING NOT bool_or(regexp_matches(t, '[<>\[\]\\\x00-\x1f\x7f]|https?://'))),
b AS (SELECT conv_id, role, turn, CASE WHEN turn < 2 THEN '**Start** [' || (turn + 1) || '].' || chr(10) || chr(10) ELSE '' END || '| turn | text [' || (turn + 1) || '] |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || turn || ' | ' || t || ' [' || (turn + 1) || '] |' AS block FROM c JOIN good USING (conv_id)),
f AS (SELECT conv_id, role, '### Admission 2024, ' || role || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY turn) AS part FROM b GROUP BY 1, 2),
w AS (SELECT conv_id, string_agg(part, chr(10) || chr(10) ORDER BY role) AS text FROM f GROUP BY 1) SELECT conv_id AS query_id, CAST(length(text) AS INT) AS n_chars, md5(text) AS digest FROM w""",
    "evidence_rules": """
WITH r AS (SELECT 'blank_source_url' AS rule FROM documents WHERE source = 'src3' UNION ALL SELECT 'blank_quote' FROM documents WHERE n_chars <= 60 OR trim(text) = ''
  UNION ALL SELECT 'page_not_positive' FROM documents WHERE doc_id % 50 = 0 UNION ALL SELECT 'repeated_id' FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1))
SELECT rule, count(*) AS n FROM r GROUP BY rule""",
}
