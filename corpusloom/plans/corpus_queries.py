"""Registered queries over documents: tokens, chunks, versions, duplicates, audits, index agreement; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import catalog_tables, chunking, context, dense, evaluation, fusion, html_pages, quality, rerank
from corpusloom.runtime import read_table


def sql_tokens(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(replace(lower({x}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '), lambda t: t <> '')"


CHUNKS_SQL = r"""
chunks AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk_index, content
  FROM (SELECT doc_id, start, substr(text, start + 1, 500) AS content
        FROM (SELECT doc_id, text, unnest(generate_series(0, CAST(greatest(0, ceil((length(text) - 500) / 400.0)) AS BIGINT) * 400, 400)) AS start
              FROM documents WHERE length(text) > 0))
  WHERE length(regexp_replace(content, '\s+', '', 'g')) > 0)"""


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents")


def tokenize_stats(spark, sf):
    t = docs(spark, sf).select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


def content_token_counts(spark, sf):
    t = tx.content_tokens(F.col("text"), ("the", "and", "of", "que", "de", "der", "les"), digits=False)
    return docs(spark, sf).select("doc_id", F.size(t).alias("n_terms"))


def chunk_fixed(spark, sf):
    c = chunking.chunk_fixed(docs(spark, sf))
    return c.select("doc_id", "chunk_index", "chunk_id", F.length("content").alias("n_chars"))


def document_chunk_count(spark, sf):
    c = chunking.with_document_chunk_count(chunking.chunk_fixed(docs(spark, sf)))
    return c.select("doc_id", "chunk_index", "document_chunk_count")


def manifest_counts(spark, sf):
    c = chunking.chunk_fixed(docs(spark, sf)).withColumns({"chunk_type": F.lit("text"), "page_number": F.floor(F.col("chunk_index") / 4)})
    return quality.manifest_counts(c).select("documents", "pages", "chunks", "text_chunks")


def years_of_documents(spark, sf):
    y = tx.years(F.col("text"))
    return docs(spark, sf).select("doc_id", y.alias("y")).select("doc_id", F.array_join("y.values", ",").alias("years"), F.col("y.kind").alias("kind"))


def codes_of_documents(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(tx.codes(F.col("text")), ",").alias("codes"))


def normalized_duplicates(spark, sf):
    n = docs(spark, sf).groupBy(F.sha2(tx.normalized_space(F.col("text")), 256).alias("norm")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    return n.where("n > 1")


def mark_duplicates(spark, sf):
    d = docs(spark, sf).select("doc_id", F.sha2("text", 256).alias("content_hash"), F.col("doc_id").alias("pos"))
    return quality.mark_duplicates(d).select("doc_id", "duplicate_of")


def document_version(spark, sf):
    d = docs(spark, sf).select("doc_id", F.col("source").alias("base_path"), F.sha2("text", 256).alias("content_hash"), F.col("doc_id").alias("seen_at"))
    return quality.document_version(d).select("doc_id", "base_path", "version")


def load_status(spark, sf):
    d = docs(spark, sf).select((F.col("doc_id") % 997).alias("doc_id"), F.format_string("%012d", "doc_id").alias("path"), F.when(F.col("doc_id") % 10 == 0, "x").alias("duplicate_of"), F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("body"))
    return quality.split_load_status(d).select("path", "doc_id", "status")


def _observed(spark, sf):
    d = docs(spark, sf).select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("payload"))
    changed = F.when(F.col("id") % 11 == 0, F.lit("changed")).otherwise(F.col("payload"))
    kept = d.where("id % 7 <> 0").select("id", changed.alias("payload"))
    return d, kept.unionByName(kept.where("id % 13 = 0")).unionByName(d.where("id % 17 = 0").select((-F.col("id") - 1).alias("id"), "payload"))


def index_diff(spark, sf):
    return quality.index_diff(*_observed(spark, sf))


def index_diff_summary(spark, sf):
    return quality.diff_summary(quality.index_diff(*_observed(spark, sf))).select("finding", "n", F.array_join("first", ",").alias("first_keys"))


def stale_ids(spark, sf):
    d = docs(spark, sf).select("doc_id", "source")
    return quality.stale_ids(d, d.where("source <> 'src3'"), "doc_id")


def index_count_check(spark, sf):
    d, o = _observed(spark, sf)
    return quality.index_count_check(o, d)


def upsert(spark, sf):
    d = docs(spark, sf)
    now = d.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("pos"), F.col("lang").alias("content"))
    new = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") + 1000000).alias("pos"), F.upper("lang").alias("content"))
    return dense.upsert(now, new)


def duplicate_ids(spark, sf):
    d = docs(spark, sf).select(F.when(F.col("doc_id") % 19 == 0, " ").otherwise((F.col("doc_id") % 500).cast("string")).alias("chunk_id"))
    return quality.duplicate_ids(d)


def quality_report(spark, sf):
    d = docs(spark, sf)
    body = F.when(F.col("doc_id") % 23 == 0, "").otherwise(F.col("text"))
    d = d.select(
        "doc_id", F.when(F.col("doc_id") % 29 != 0, F.col("source")).alias("title"), F.lit("u").alias("source_url"), body.alias("body"), F.sha2("text", 256).alias("content_hash"), F.lit("r").alias("raw_file"),
        F.lit("a").alias("raw_sha256"), F.when(F.col("doc_id") % 31 == 0, "b").otherwise("a").alias("response_sha256"), F.when(F.col("n_chars") < 60, "no_text_detected").otherwise("ok").alias("extraction_status"),
        F.lit(1).alias("source_table_count"), (F.col("doc_id") % 5).alias("markdown_table_count"), F.lit(100).alias("source_numeric_token_count"), (F.col("doc_id") % 200).alias("markdown_numeric_token_count"),
        F.when(F.col("doc_id") % 37 == 0, 404).otherwise(200).alias("http_status"), F.lit(None).cast("string").alias("supersedes"),
    )
    return quality.findings_report(quality.quality_findings(d)).select(F.coalesce("rule", F.lit("(all)")).alias("rule"), "n")


def missing_pages(spark, sf):
    s = docs(spark, sf).select("doc_id", F.ceil(F.col("n_chars") / 1000).cast("int").alias("n_pages"))
    p = chunking.chunk_fixed(docs(spark, sf), 1000, 0).select("doc_id", (F.col("chunk_index") + 1).alias("page_number")).where("(doc_id + page_number) % 6 <> 0")
    return quality.missing_pages(s, p)


def metadata_filter(spark, sf):
    d = dense.metadata_filter(docs(spark, sf), {"lang": ["fr", "de"], "n_chars": {"gte": 200, "lt": 5000}})
    return d.groupBy("lang", "source").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest"))


def term_filter(spark, sf):
    return quality.term_filter(docs(spark, sf), ["the", "que"], ["$", "!!"], "text").select("doc_id", "lang")


def url_hosts(spark, sf):
    return read_table(spark, sf, "pages").groupBy(tx.url_host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


def pdf_links(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", quality.is_pdf_link(F.col("url")).alias("is_pdf"))


def html_text(spark, sf):
    return html_pages.html_text(read_table(spark, sf, "pages"))


def html_markdown(spark, sf):
    return html_pages.html_to_markdown(read_table(spark, sf, "pages")).select("page_id", "title", "markdown", "table_count", "numeric_tokens", "status")


def corpus_fingerprint(spark, sf):
    return quality.corpus_fingerprint(docs(spark, sf))


def session_history(spark, sf):
    return catalog_tables.session_history(read_table(spark, sf, "conversations"), 2).select("conv_id", "turn", "role")


def golden_summary(spark, sf):
    c = read_table(spark, sf, "labels").select(F.col("quality").cast("string").alias("expected_route"), F.col("toxic").cast("string").alias("difficulty"), (F.col("doc_id") % 4).cast("string").alias("category"))
    return evaluation.golden_summary(c)


def latency_medians(spark, sf):
    return evaluation.latency_medians(read_table(spark, sf, "events").select(F.col("event_type").alias("case_id"), F.col("value").alias("ms"))).withColumn("median_ms", F.round("median_ms", 6))


def _turn_hits(spark, sf):
    c = read_table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("pos"), F.concat_ws("-", F.col("conv_id"), F.col("turn")).alias("chunk_id"), F.col("text").alias("content"), F.when(F.col("role") == "user", "exact").when(F.col("role") == "assistant", "parent").otherwise("neighbor").alias("expansion_type"), F.col("role").alias("title"), F.lit(0.5).alias("score"), F.col("turn").alias("place"), F.col("conv_id").alias("doc_id"))


def pack_context(spark, sf):
    return context.pack_context(_turn_hits(spark, sf), 1500, locators=("doc_id",))


def trim_context_tail(spark, sf):
    return context.trim_context_tail(_turn_hits(spark, sf), 2500).select("query_id", "chunk_id", "place")


def render_context(spark, sf):
    r = context.render_context(_turn_hits(spark, sf))
    return r.select("query_id", F.length("context").alias("n_chars"), F.md5("context").alias("digest"))


def neighbor_join(spark, sf):
    c = chunking.chunk_fixed(docs(spark, sf)).select("chunk_id", "doc_id", "chunk_index", F.array(F.floor(F.col("chunk_index") / 6).cast("string")).alias("heading_path"), F.lit("text").alias("chunk_type"), (F.col("doc_id") * 100000 + F.col("chunk_index")).alias("corpus_pos"))
    seeds = c.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "chunk_id")
    return fusion.neighbor_join(seeds, c)


def table_sibling_join(spark, sf):
    c = chunking.chunk_fixed(docs(spark, sf)).select("chunk_id", "doc_id", F.floor(F.col("chunk_index") / 5).alias("table_index"), (F.col("chunk_index") % 5 + 1).alias("table_part"), "chunk_index")
    seeds = c.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "chunk_id")
    return fusion.table_sibling_join(seeds, c)


def widest_table(spark, sf):
    f = docs(spark, sf).select("lang", "source", "doc_id", F.col("n_chars").alias("rows"), (F.col("doc_id") % 3 > 0).alias("complete"))
    return catalog_tables.widest_table(f, "lang", "source").select("lang", "source", "doc_id", "rows")


def search_text(spark, sf):
    d = docs(spark, sf).select("doc_id", F.col("lang").alias("title"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(F.col("source")).alias("section"), F.array("lang", "source").alias("heading_path"), F.lit(None).cast("string").alias("heading"), F.col("text").alias("content"))
    return d.select("doc_id", F.length(rerank.search_text()).alias("n_chars"), F.md5(rerank.search_text()).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_stats, content_token_counts, chunk_fixed, document_chunk_count, manifest_counts, years_of_documents, codes_of_documents, normalized_duplicates, mark_duplicates, document_version, load_status,
        index_diff, index_diff_summary, stale_ids, index_count_check, upsert, duplicate_ids, quality_report, missing_pages, metadata_filter, term_filter, url_hosts, pdf_links, html_text, html_markdown,
        corpus_fingerprint, session_history, golden_summary, latency_medians, pack_context, trim_context_tail, render_context, neighbor_join, table_sibling_join, widest_table, search_text,
    )
}

_OBSERVED = """
want AS (SELECT doc_id AS id, sha256(text) AS payload FROM documents),
kept AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'changed' ELSE payload END AS payload FROM want WHERE id % 7 <> 0),
seen AS (SELECT * FROM kept UNION ALL SELECT * FROM kept WHERE id % 13 = 0 UNION ALL SELECT -id - 1, payload FROM want WHERE id % 17 = 0)"""

_DIFF = f"""{_OBSERVED},
o AS (SELECT id, count(*) AS n, max(payload) AS has FROM seen GROUP BY id),
diff AS (
  SELECT 'missing' AS finding, id AS key FROM want WHERE id NOT IN (SELECT id FROM o)
  UNION ALL SELECT 'unexpected', id FROM o WHERE id NOT IN (SELECT id FROM want)
  UNION ALL SELECT 'duplicate', id FROM o WHERE n > 1
  UNION ALL SELECT 'payload_mismatch', o.id FROM o JOIN want USING (id) WHERE o.has <> want.payload)"""

_TURNS = r"""
turns AS (SELECT conv_id AS query_id, turn AS place, conv_id || '-' || turn AS chunk_id,
  format('<document index="{}" title="{}" score="0.5000">{}{}{}</document>', turn + 1, role, chr(10), text, chr(10)) AS block FROM conversations)"""

ORACLE_SQL = {
    "tokenize_stats": f"SELECT doc_id, CAST(len(t) AS INT) AS n_tokens, CAST(len(list_distinct(t)) AS INT) AS n_distinct FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)",
    "content_token_counts": f"SELECT doc_id, CAST(len(list_filter(list_distinct({sql_tokens('text')}), lambda t: length(t) >= 2 AND t NOT IN ('the','and','of','que','de','der','les') AND NOT regexp_full_match(t, '\\p{{N}}+'))) AS INT) AS n_terms FROM documents",
    "chunk_fixed": f"WITH {CHUNKS_SQL} SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, left(sha256(doc_id || chr(31) || chunk_index || chr(31) || content), 24) AS chunk_id, CAST(length(content) AS INT) AS n_chars FROM chunks",
    "document_chunk_count": f"WITH {CHUNKS_SQL} SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS document_chunk_count FROM chunks",
    "manifest_counts": f"WITH {CHUNKS_SQL} SELECT count(DISTINCT doc_id) AS documents, count(DISTINCT (doc_id, chunk_index // 4)) AS pages, count(*) AS chunks, count(*) AS text_chunks FROM chunks",
    "years_of_documents": r"""
WITH y AS (SELECT doc_id, list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(text, '\d+'), lambda d: length(d) = 4 AND left(d, 2) IN ('19','20','21')), lambda d: CAST(d AS INT)))) AS v,
  regexp_extract_all(text, '(?:19|20|21)\d{2}\s*[-–—/]\s*(?:19|20|21)\d{2}') AS r FROM documents)
SELECT doc_id, array_to_string(v, ',') AS years, CASE WHEN len(v) = 0 THEN 'missing' WHEN len(v) = 1 THEN 'single'
  WHEN len(v) = 2 AND len(r) = 1 AND CAST(right(r[1], 4) AS INT) = CAST(left(r[1], 4) AS INT) + 1 THEN 'academic_range' ELSE 'multi' END AS kind FROM y""",
    "codes_of_documents": f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter({sql_tokens('text')}, lambda t: regexp_full_match(t, '[a-z]{{1,6}}\\d{{1,4}}|\\d{{7}}')))), ',') AS codes FROM documents",
    "normalized_duplicates": r"SELECT sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'))) AS norm, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "mark_duplicates": "SELECT doc_id, CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN min(doc_id) OVER (PARTITION BY text) END AS duplicate_of FROM documents",
    "document_version": "WITH f AS (SELECT source, text, min(doc_id) AS first FROM documents GROUP BY 1, 2), n AS (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY first) AS v FROM f) SELECT doc_id, d.source AS base_path, v AS version FROM documents d JOIN n ON d.source = n.source AND d.text = n.text",
    "load_status": """
WITH d AS (SELECT doc_id % 997 AS doc_id, printf('%012d', doc_id) AS path, doc_id % 10 = 0 AS skipped, (doc_id % 7 = 0 OR trim(text) = '') AS empty FROM documents),
c AS (SELECT *, min(CASE WHEN NOT skipped AND NOT empty THEN path END) OVER (PARTITION BY doc_id) AS first FROM d)
SELECT path, doc_id, CASE WHEN skipped THEN 'skipped' WHEN first < path THEN 'repeated_id' WHEN empty THEN 'empty' ELSE 'good' END AS status FROM c""",
    "index_diff": f"WITH {_DIFF} SELECT finding, key FROM diff",
    "index_diff_summary": f"WITH {_DIFF}, r AS (SELECT finding, key, row_number() OVER (PARTITION BY finding ORDER BY key) AS r FROM diff) SELECT finding, count(*) AS n, string_agg(CASE WHEN r <= 10 THEN CAST(key AS VARCHAR) END, ',' ORDER BY key) AS first_keys FROM r GROUP BY finding",
    "stale_ids": "SELECT doc_id FROM documents WHERE source = 'src3'",
    "index_count_check": f"WITH {_OBSERVED} SELECT a AS index_rows, b AS chunk_rows, a = b AS equal FROM (SELECT count(*) AS a FROM seen), (SELECT count(*) AS b FROM want)",
    "upsert": "SELECT doc_id AS chunk_id, CASE WHEN doc_id % 3 <> 0 THEN doc_id ELSE doc_id + 1000000 END AS pos, CASE WHEN doc_id % 2 = 0 THEN upper(lang) ELSE lang END AS content FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0",
    "duplicate_ids": "WITH k AS (SELECT CASE WHEN doc_id % 19 <> 0 THEN CAST(doc_id % 500 AS VARCHAR) END AS key FROM documents) SELECT key, count(*) AS n FROM k GROUP BY key HAVING count(*) > 1 OR key IS NULL",
    "quality_report": """
WITH f AS (
  SELECT 'missing_title' AS rule FROM documents WHERE doc_id % 29 = 0
  UNION ALL SELECT 'body_hash_mismatch' FROM documents WHERE doc_id % 23 = 0 AND text <> ''
  UNION ALL SELECT 'raw_hash_mismatch' FROM documents WHERE doc_id % 31 = 0
  UNION ALL SELECT 'no_text' FROM documents WHERE n_chars < 60
  UNION ALL SELECT 'table_loss' FROM documents WHERE doc_id % 5 < 1
  UNION ALL SELECT 'numeric_loss' FROM documents WHERE doc_id % 200 < 90
  UNION ALL SELECT 'url_failed' FROM documents WHERE doc_id % 37 = 0
  UNION ALL SELECT 'repeated_content' FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1))
SELECT coalesce(rule, '(all)') AS rule, count(*) AS n FROM f GROUP BY ROLLUP (rule)""",
    "missing_pages": r"""
WITH s AS (SELECT doc_id, CAST(ceil(n_chars / 1000.0) AS INT) AS n FROM documents),
e AS (SELECT doc_id, CAST(unnest(generate_series(1, n)) AS INT) AS page_number FROM s),
w AS (SELECT doc_id, substr(text, start + 1, 1000) AS c, start FROM (SELECT doc_id, text, unnest(generate_series(0, CAST(greatest(0, ceil((length(text) - 1000) / 1000.0)) AS BIGINT) * 1000, 1000)) AS start FROM documents WHERE length(text) > 0)),
p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS page_number FROM w WHERE length(regexp_replace(c, '\s+', '', 'g')) > 0)
SELECT doc_id, page_number FROM e WHERE (doc_id, page_number) NOT IN (SELECT (doc_id, page_number) FROM p WHERE (doc_id + page_number) % 6 <> 0)""",
    "metadata_filter": "SELECT lang, source, count(*) AS n, max(n_chars) AS longest FROM documents WHERE lang IN ('fr', 'de') AND n_chars >= 200 AND n_chars < 5000 GROUP BY 1, 2",
    "term_filter": "SELECT doc_id, lang FROM (SELECT *, lower(text) AS t FROM documents) WHERE (contains(t, 'the') OR contains(t, 'que')) AND NOT (contains(t, '$') OR contains(t, '!!'))",
    "url_hosts": r"SELECT lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1",
    "pdf_links": r"SELECT page_id, regexp_matches(url, '(?i)\.pdf(?:$|[?#])') AS is_pdf FROM pages",
    "corpus_fingerprint": """
WITH r AS (SELECT sha256(to_json({'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars, 'source': source, 'text': text})) AS d FROM documents),
s AS (SELECT count(*) AS n, list_transform([sum(CAST('0x' || substr(d, 1, 16) AS UBIGINT)), sum(CAST('0x' || substr(d, 17, 16) AS UBIGINT)), sum(CAST('0x' || substr(d, 33, 16) AS UBIGINT)), sum(CAST('0x' || substr(d, 49, 16) AS UBIGINT))],
  lambda x: lpad(lower(to_hex(CAST(x % 18446744073709551616 AS UBIGINT))), 16, '0')) AS q FROM r)
SELECT n AS documents, array_to_string(q, '') AS fingerprint FROM s""",
    "session_history": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role IN ('user', 'assistant', 'system')) WHERE n <= 4",
    "golden_summary": "SELECT expected_route, difficulty, category, count(*) AS n FROM (SELECT CAST(quality AS VARCHAR) AS expected_route, CAST(toxic AS VARCHAR) AS difficulty, CAST(doc_id % 4 AS VARCHAR) AS category FROM labels) GROUP BY GROUPING SETS ((expected_route), (difficulty), (category))",
    "latency_medians": "SELECT event_type AS case_id, round(median(value), 6) AS median_ms FROM events GROUP BY 1",
    "pack_context": r"""
WITH RECURSIVE o AS (
  SELECT conv_id AS query_id, conv_id || '-' || turn AS chunk_id, length(text) AS n,
    row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END, turn) AS k,
    row_number() OVER (PARTITION BY conv_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g')) ORDER BY CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END, turn) AS again
  FROM conversations WHERE trim(text) <> ''),
g AS (SELECT query_id, chunk_id, n, row_number() OVER (PARTITION BY query_id ORDER BY k) AS k FROM o WHERE again = 1),
f AS (SELECT query_id, chunk_id, n, k, n <= 1500 AS kept, CASE WHEN n <= 1500 THEN n ELSE 0 END AS used FROM g WHERE k = 1
  UNION ALL SELECT g.query_id, g.chunk_id, g.n, g.k, f.used + g.n <= 1500, CASE WHEN f.used + g.n <= 1500 THEN f.used + g.n ELSE f.used END FROM f JOIN g ON g.query_id = f.query_id AND g.k = f.k + 1)
SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY k) - 1 AS INT) AS place, CAST(n AS INT) AS n_chars FROM f WHERE kept""",
    "trim_context_tail": f"WITH {_TURNS} SELECT query_id, chunk_id, place FROM (SELECT *, sum(length(block) + 2) OVER (PARTITION BY query_id ORDER BY place) - 2 AS used FROM turns) WHERE used <= 2500",
    "render_context": f"WITH {_TURNS} SELECT query_id, CAST(length(c) AS INT) AS n_chars, md5(c) AS digest FROM (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY place) AS c FROM turns GROUP BY query_id)",
    "neighbor_join": f"""
WITH {CHUNKS_SQL}, c AS (SELECT *, left(sha256(doc_id || chr(31) || chunk_index || chr(31) || content), 24) AS chunk_id FROM chunks)
SELECT s.doc_id AS query_id, s.chunk_id AS seed_id, n.chunk_id, CAST(n.chunk_index - s.chunk_index AS INT) AS step, CAST(CASE n.chunk_index - s.chunk_index WHEN -1 THEN 0 WHEN 1 THEN 1 WHEN -2 THEN 2 ELSE 3 END AS INT) AS place
FROM c s JOIN c n ON n.doc_id = s.doc_id AND n.chunk_index - s.chunk_index IN (-1, 1, -2, 2) AND n.chunk_index // 6 = s.chunk_index // 6 WHERE s.doc_id % 50 = 0""",
    "table_sibling_join": f"""
WITH {CHUNKS_SQL}, c AS (SELECT *, left(sha256(doc_id || chr(31) || chunk_index || chr(31) || content), 24) AS chunk_id FROM chunks)
SELECT s.doc_id AS query_id, s.chunk_id AS seed_id, n.chunk_id, CAST(n.chunk_index % 5 + 1 AS INT) AS table_part FROM c s JOIN c n ON n.doc_id = s.doc_id AND n.chunk_index // 5 = s.chunk_index // 5 WHERE s.doc_id % 50 = 0""",
    "widest_table": "SELECT lang, source, doc_id, rows FROM (SELECT *, count(*) OVER (PARTITION BY lang, source) AS n FROM (SELECT lang, source, doc_id, n_chars AS rows, rank() OVER (PARTITION BY lang, source ORDER BY n_chars DESC) AS r FROM documents WHERE doc_id % 3 > 0) WHERE r = 1) WHERE n = 1",
    "search_text": r"""
SELECT doc_id, CAST(length(s) AS INT) AS n_chars, md5(s) AS digest FROM (
  SELECT doc_id, concat_ws(chr(10), lang, CASE WHEN doc_id % 2 <> 0 AND source <> lang THEN source END, lang || ' > ' || source, CASE WHEN trim(text) <> '' THEN text END) AS s FROM documents)""",
}
