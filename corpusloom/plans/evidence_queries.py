"""Registered queries of scope, evidence, citations, split tables, guards and audits; each with its SQL.

Questions are benchmark items and user turns, sources the documents; scopes come from customers, orders and regions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import scope, text as tx
from corpusloom.operators import answers, catalog_tables, context, dense, embedding, evaluation, quality, rerank
from corpusloom.plans.corpus_queries import docs, sql_tokens
from corpusloom.plans.search_queries import _benchmark, _ITEMS, _search_sql, bm25_searched, documents, golden_pairs, with_documents
from corpusloom.runtime import read_table


def folded_text(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(tx.fold(F.col("text"))).alias("digest"), F.md5(tx.normalized_markdown(F.col("text"))).alias("plain_digest"))


def text_ids(spark, sf):
    t, page, none = F.col("text"), F.floor(F.col("n_chars") / 1000).cast("int") + 1, F.lit(None).cast("string")
    return docs(spark, sf).select(
        "doc_id", tx.slug(t).alias("slug"), tx.document_id(F.col("source"), F.col("n_chars"), F.col("lang"), t, F.lit(1), page).alias("made_id"),
        tx.stable_chunk_id(F.col("doc_id"), F.lit("text"), page, F.col("lang"), none, F.lit(0), t).alias("chunk_id"), tx.point_id(F.concat_ws("/", "source", "doc_id")).alias("point_id"),
        tx.canonical_map(F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))).alias("payload"),
    )


def facts_of_documents(spark, sf):
    f = tx.facts(F.col("text"))
    return docs(spark, sf).select("doc_id", F.size(f).alias("n_facts"), F.md5(F.array_join(f, " ")).alias("digest"), tx.numeric_token_count(F.col("text")).cast("long").alias("numbers"))


def abbreviations(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(tx.expand_abbreviations(F.col("text"), {"une": "one", "ist": "is (being)"})).alias("digest"))


def search_steps(spark, sf):
    """What the steps before a search say of each user turn: list or overview question, live state, place names, text to search for, hash for logs."""
    q = F.col("text")
    turns = read_table(spark, sf, "conversations").where("role = 'user'")
    overview = embedding.asks_overview(q, r"\bthe\b|\bder\b", ["and", "of", "in", "und"])
    rewrite = F.when(F.length(q) > 200, tx.normalized_space(q))
    return turns.select(
        "conv_id", "turn", embedding.asks_for_list(q, "which of|quels", ["que", "und"]).alias("is_list"), overview.alias("overview"), rerank.asks_live_state(q, "now|on ", "the|de").alias("live"),
        F.array_join(tx.labels_by_alias(q, {"north": "st", "south": r"ouo|er\b"}), ",").alias("places"), F.md5(embedding.retrieval_query(q, overview, "list of all", rewrite)).alias("search_digest"), tx.question_hash(q).alias("question_hash"),
    )


def _hits(spark, sf, k):
    """The best documents of every benchmark item with their texts."""
    return with_documents(spark, sf, bm25_searched(spark, sf, _benchmark(spark, sf), k)).join(_benchmark(spark, sf), "query_id")


def cited_evidence(spark, sf):
    """Hits of one language and content as one piece of evidence, ranked as citations by coverage, overlap, score and place."""
    h = _hits(spark, sf, 10).withColumn("pos", F.col("rank")).withColumn("tokens", tx.content_tokens(F.col("content")))
    groups = context.group_evidence(h, ("lang",)).join(_benchmark(spark, sf), "query_id")
    q = tx.content_tokens(F.col("query"))
    coverage = F.round(F.size(F.array_intersect(q, "tokens")) / F.size(q), 9)
    scored = groups.withColumns({"coverage": coverage, "overlap": F.round(rerank.lexical_overlap(q, F.col("tokens")), 9)})
    return context.citation_order(scored).select("query_id", "chunk_id", "pos", "score", F.size("tokens").alias("n_tokens"), "coverage", "overlap", "rank")


def citation_id_collisions(spark, sf):
    d = docs(spark, sf).select(F.col("source").alias("query_id"), F.sha2("text", 256).alias("chunk_id"), "lang", "doc_id")
    return context.citation_id_collisions(d, ("lang", "doc_id"))


def _answers(spark, sf) -> tuple[DataFrame, DataFrame]:
    """An answer for each item that quotes the hits which contain it by number, and one number that is no source."""
    return _answers_of(spark, sf, _hits(spark, sf, 10))


def _answers_of(spark, sf, h) -> tuple[DataFrame, DataFrame]:
    marks = F.array_sort(F.collect_list(F.when(F.contains("content", "query"), F.col("rank"))))
    text = F.concat_ws(" ", F.transform(marks, lambda r: F.concat(F.lit("see ["), r.cast("string"), F.lit("]"))))
    quoted = h.groupBy("query_id").agg(text.alias("t"))
    a = _benchmark(spark, sf).join(quoted, "query_id", "left").select(F.col("query_id").alias("answer_id"), "query_id", F.concat_ws(" ", F.when(F.col("t") != "", F.col("t")), F.when(F.length("query") % 2 == 0, F.lit("[99]"))).alias("text"))
    return a, h.select("query_id", (F.col("rank") - 1).alias("place"), "chunk_id")


def citations(spark, sf):
    return context.citations_for_answers(*_answers(spark, sf))


def accepted_answers(spark, sf):
    """Answers to the items from their first three hits: some name hits that don't cite the item, some lack its words, some abstain in
    words and some don't."""
    q = F.col("query")
    h = _hits(spark, sf, 3).withColumn("cites", F.contains("content", "query"))
    ranks = F.sort_array(F.collect_list(F.when(F.col("cites") | (F.length("query") % 3 == 0), F.col("rank"))))
    marks = h.groupBy("query_id").agg(F.bool_or("cites").alias("found"), F.array_join(F.transform(ranks, lambda r: F.concat(F.lit(" ["), r.cast("string"), F.lit("]"))), "").alias("marks"))
    told = F.when(F.col("found"), F.concat(F.when(F.length(q) % 7 == 0, F.lit("See")).otherwise(F.concat(F.lit("It is  "), F.upper(q))), "marks")).when(F.length(q) % 5 == 0, "nothing").otherwise("Sorry, NO answer\nfound.")
    a = _benchmark(spark, sf).join(marks, "query_id", "left").select(
        F.col("query_id").alias("answer_id"), told.alias("text"), F.when(F.coalesce("found", F.lit(False)), "answer").otherwise("out_of_scope").alias("route"),
        F.when(F.coalesce("found", F.lit(False)) | (F.length(q) % 11 == 0), "answer").otherwise("out_of_scope").alias("expected_route"), F.coalesce(F.col("found").cast("int"), F.lit(0)).alias("expected_evidence"), F.array(F.substring(q, 1, 12)).alias("required_terms"),
    )
    cited = h.where("cites").select(F.col("query_id").alias("answer_id"), F.col("rank").alias("marker"), F.substring("query", 1, 40).alias("quote"), "content")
    return evaluation.response_acceptance(a, cited, ("no answer found",))


def evidence_membership(spark, sf):
    h = _hits(spark, sf, 3)
    e = h.select("chunk_id", F.col("chunk_id").alias("doc_id"), F.col("source").alias("title"), F.lit(1).alias("page"), F.col("lang").alias("source_url"), F.col("query").alias("quote"))
    c = documents(spark, sf).select("chunk_id", F.col("chunk_id").alias("doc_id"), F.col("source").alias("title"), F.lit(1).alias("page_number"), F.col("lang").alias("source_url"), "content")
    return quality.evidence_membership(e, c).groupBy("chunk_id", "status").agg(F.count("*").alias("n"))


def precision_at_k(spark, sf):
    want = golden_pairs(spark, sf).groupBy("case_id").agg(F.collect_set("chunk_id").alias("r"))
    cases = _benchmark(spark, sf).select(F.col("query_id").alias("case_id")).join(want, "case_id", "left").select("case_id", F.coalesce("r", F.array().cast("array<bigint>")).alias("relevant"))
    run = bm25_searched(spark, sf, _benchmark(spark, sf), 10).withColumnRenamed("query_id", "case_id")
    return evaluation.precision_at_k(run, cases, 5)


def _entities(spark, sf):
    words = F.filter(tx.content_tokens(F.col("query")), lambda t: F.length(t) > 8)
    return _benchmark(spark, sf).select(F.col("query_id").alias("case_id"), F.explode(words).alias("entity"))


def list_metrics(spark, sf):
    h = _hits(spark, sf, 10).select(F.col("query_id").alias("case_id"), F.sha2("content", 256).alias("chunk_id"), F.col("source").alias("doc_id"), "content")
    return evaluation.list_metrics(h, _entities(spark, sf))


def terms_by_branch(spark, sf):
    h = _hits(spark, sf, 10).select(F.col("query_id").alias("case_id"), F.col("lang").alias("branch"), "content")
    t = evaluation.terms_by_branch(h, _entities(spark, sf).withColumnRenamed("entity", "term"))
    return t.select("case_id", "branch", F.array_join("found", " ").alias("found"), F.size("missed").alias("n_missed"))


def candidate_chars(spark, sf):
    return evaluation.candidate_char_stats(_hits(spark, sf, 10))


def retrieval_report(spark, sf):
    return evaluation.retrieval_report(_hits(spark, sf, 10).select("query_id", "chunk_id", "rank", "score", F.col("source").alias("title"), "content"))


def golden_findings(spark, sf):
    """The rules that the benchmark items break as a golden set whose evidence is where they are found."""
    pairs = golden_pairs(spark, sf)
    found = pairs.groupBy("case_id").agg(F.array_sort(F.collect_list(F.col("chunk_id").cast("string"))).alias("evidence_ids"))
    first = F.slice(tx.tokens(F.col("query")), 1, 2)
    c = _benchmark(spark, sf).join(found, F.col("query_id") == F.col("case_id"), "left").select(
        F.col("query_id").cast("string").alias("id"), F.col("query").alias("question"), F.when(F.col("case_id").isNotNull(), F.col("query")).otherwise("").alias("ground_truth"), F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"),
        first.alias("required_terms"), F.when(F.col("case_id").isNull(), "abstain").otherwise("answer").alias("expected_route"), F.when(F.length("query") > 200, "hard").otherwise("easy").alias("difficulty"),
        F.lit("all").alias("category"), F.array(F.substring("query", 1, 1)).alias("tags"),
    )
    e = pairs.join(_benchmark(spark, sf), F.col("case_id") == F.col("query_id")).select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("query").alias("quote"))
    return evaluation.golden_findings(c, e, "answer", "abstain", ("easy", "hard"), "negative", "no answer")


def _table_parts(spark, sf):
    """Each conversation as a table of its turns, split into parts of three rows; a system turn is a label row."""
    c = read_table(spark, sf, "conversations").withColumn("t", F.trim(F.regexp_replace("text", r"[\s|\\]+", " ")))
    line = F.when(F.col("role") == "system", F.concat(F.lit("| "), "t", F.lit(" |  |  |"))).otherwise(F.concat(F.lit("| "), F.col("turn").cast("string"), F.lit(" | "), "role", F.lit(" | "), "t", F.lit(" |")))
    rows = c.select(F.col("conv_id").alias("doc_id"), "turn", F.floor(F.col("turn") / 3).cast("int").alias("part"), line.alias("line"))
    part = rows.groupBy("doc_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("body"), F.min("turn").alias("lo"), F.max("turn").alias("hi"))
    count = rows.groupBy("doc_id").agg((F.max("part") + 1).alias("table_part_count"), F.count_if(F.col("line").contains("| assistant |")).alias("answers"))
    host = F.concat(F.lit("https://"), F.when(F.col("answers") > 2, "long").otherwise("short"), F.lit(".example.org/t"))
    return part.join(count, "doc_id").select(
        "doc_id", F.lit(0).alias("table_index"), (F.col("part") + 1).alias("table_part"), "table_part_count", (F.col("lo") + 1).alias("row_start"), (F.col("hi") + 1).alias("row_end"),
        F.concat(F.lit("| turn | role | text |\n| --- | --- | --- |\n"), "body").alias("content"), F.lit("t").alias("title"), host.alias("source_url"),
        F.lit("2024").alias("admission_year"), F.col("doc_id").cast("string").alias("campus"),
    )


def table_families(spark, sf):
    return catalog_tables.table_family_check(_table_parts(spark, sf)).select("doc_id", "complete", "rows")


def catalog_sections(spark, sf):
    c = catalog_tables.carry_sections(catalog_tables.catalog_rows(_table_parts(spark, sf)))
    return c.select("doc_id", "row", F.md5(F.array_join("cells", "|")).alias("digest"), F.md5("section").alias("section"), F.md5("subsection").alias("subsection"))


def catalog_texts(spark, sf):
    """The rows of each conversation on the allowed host as one rendered list."""
    c = catalog_tables.complete_catalog(_table_parts(spark, sf), ["long.example.org"])
    r = catalog_tables.render_catalog(c.withColumn("query_id", F.col("doc_id")))
    return r.select("query_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def named_entries(spark, sf):
    """The rows whose role cell is a requested name; names are roles as the messages have them, in capitals."""
    rows = catalog_tables.catalog_rows(_table_parts(spark, sf))
    names = read_table(spark, sf, "conversations").select(F.col("role").alias("query_id"), F.upper("role").alias("name")).distinct()
    return catalog_tables.named_entry_lookup(rows, names, [1]).select("query_id", "doc_id", "row")


def preflight(spark, sf):
    """The checks before a rebuild of three stored indexes: of the same documents, of all but the French ones, and of the same
    manifest with the short documents lost."""
    d = docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), F.sha2("text", 256).alias("payload"), F.col("text").alias("content"))
    older, lost = docs(spark, sf).where("lang IS DISTINCT FROM 'fr'"), F.length("content") > 100
    older = older.select(F.col("doc_id").alias("chunk_id"), F.sha2("text", 256).alias("payload"), F.col("text").alias("content"))
    config = {"size": 500}
    evidence = read_table(spark, sf, "labels").select(F.col("doc_id").alias("chunk_id"))
    findings = _benchmark(spark, sf).where("length(query) > 300")
    out = None
    for name, stored, of in (("same", d, d), ("older", older, older), ("lost", d.where(lost), d)):
        manifest = quality.corpus_fingerprint(of, "chunk_id").select(F.col("documents").alias("chunk_count"), F.col("fingerprint").alias("corpus_fingerprint"), F.lit(quality.build_fingerprint(config)).alias("build_fingerprint"))
        checks = quality.preflight_report(d, stored, manifest, config, findings if name == "lost" else findings.limit(0), evidence)
        checks = checks.select(F.lit(name).alias("stored"), "check", "severity", "n")
        out = checks if out is None else out.unionByName(checks)
    status = F.when(F.max(F.when((F.col("severity") == "error") & (F.col("n") > 0), 1)) == 1, "blocked").when(F.sum("n") > 0, "ready_for_rebuild").otherwise("current")
    folded = out.groupBy("stored").agg(status.alias("severity"), F.sum("n").alias("n")).select("stored", F.lit("status").alias("check"), "severity", "n")
    return out.unionByName(folded)


def deletes(spark, sf):
    toxic = read_table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    left = dense.delete_by_ids(docs(spark, sf), toxic, "doc_id")
    return dense.delete_by_source(left.withColumn("source_file", F.col("source")), "src3").select("doc_id")


def validated_batch(spark, sf):
    c = docs(spark, sf).select("doc_id", F.md5("text").alias("chunk_id"), F.col("text").alias("content"))
    return dense.validated_batch(c).select("doc_id", "reject")


def appended_messages(spark, sf):
    """The messages that follow if each conversation's last question is answered by its first answer."""
    c = read_table(spark, sf, "conversations")
    a = c.groupBy("conv_id").agg((F.max("turn") + 1).alias("next_turn"), F.max_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("question"), F.min_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("answer"))
    return answers.session_messages(a).select("conv_id", "turn", "role", F.md5("text").alias("digest"))


def _rewrites(spark, sf):
    """Candidate rewrites of each benchmark item: small letters, its first sentence, the item with a year added."""
    q = F.col("query")
    made = F.array(F.lower(q), F.split_part(q, F.lit("."), F.lit(1)), F.concat(q, F.lit(" 2024")))
    return _benchmark(spark, sf).select("query_id", q.alias("original"), F.posexplode(made).alias("candidate_pos", "candidate"))


def query_variants(spark, sf):
    v = rerank.safe_query_variants(_rewrites(spark, sf), ("the", "and", "of"))
    return v.select("query_id", "place", F.md5("variant").alias("digest"))


def protected_of_documents(spark, sf):
    t = tx.protected_terms(F.col("text"), ("the", "von"))
    return docs(spark, sf).select("doc_id", t.alias("t")).select("doc_id", F.size("t").alias("n_terms"), F.md5(F.array_join("t", " ")).alias("digest"))


def accepted_rewrites(spark, sf):
    return rerank.accepted_rewrite(_rewrites(spark, sf)).select("query_id", "candidate_pos", F.md5("accepted").alias("digest"))


def text_lengths(queries: list[str], texts: list[str]) -> list[float]:
    """A scorer for reranking: the shorter the text, the better."""
    return [-float(len(t)) for t in texts]


def model_rerank(spark, sf):
    return rerank.model_rerank(_hits(spark, sf, 10), text_lengths, 4).select("query_id", "chunk_id", "model_score", "rank")


def rerank_faults(spark, sf):
    """What a check says of hits handed out by retrieval score as if lexical overlap had ordered them."""
    h = _hits(spark, sf, 10)
    overlap = F.round(rerank.lexical_overlap(tx.content_tokens(F.col("query")), tx.content_tokens(F.col("content"))), 9)
    r = h.select("query_id", "chunk_id", "score", "rank", overlap.alias("model_score"))
    return rerank.check_rerank_output(h.where("rank <= 8"), r)


def named_entity_gate(spark, sf):
    hits = _hits(spark, sf, 3).select("query_id", "content")
    return rerank.named_entity_gate(_benchmark(spark, sf), hits, r"([a-z]+ [a-z]+)[^a-z]*$")


#: market segments ask in different ways; orders say their years and places by status
_VOCABULARY = scope.Vocabulary(
    places={n.lower(): rf"\b{n.lower()}\b" for n in ("AFRICA", "AMERICA", "ASIA", "EUROPE")}, intents={"price": "building|machinery"},
    sections={"price": "urgent|high"}, off_topic="low", strict_intents=("price",), place_required=("price",),
)


def _assessed(spark, sf):
    """Each order against what its customer asks: a region, years of their orders, or both."""
    t = lambda name: read_table(spark, sf, name)
    regions = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    year = F.year("o_orderdate").cast("string")
    span = t("orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("lo"), F.max(F.year("o_orderdate")).alias("hi"))
    lo, hi, seg = F.col("lo").cast("string"), F.col("hi").cast("string"), F.col("c_mktsegment")
    asked = F.when(seg == "BUILDING", "").when(seg == "AUTOMOBILE", hi).when(seg == "MACHINERY", F.concat(lo, F.lit("-"), (F.col("lo") + 1).cast("string"))).when(seg == "HOUSEHOLD", F.concat(lo, F.lit(" and "), hi)).otherwise(lo)
    where = F.when(seg.isin("FURNITURE"), "").otherwise(F.col("r_name"))
    q = t("customer").join(span, F.col("c_custkey") == F.col("o_custkey")).join(regions, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("query_id"), F.concat_ws(" ", seg, where, asked).alias("query"))
    firsts = t("lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s"))
    place = firsts.join(t("supplier"), F.col("s") == F.col("s_suppkey")).join(regions, F.col("s_nationkey") == F.col("n_nationkey")).select("l_orderkey", F.col("r_name").alias("campus"))
    none, status = F.lit(None).cast("string"), F.col("o_orderstatus")
    s = t("orders").join(place, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("chunk_id"), F.col("o_totalprice").alias("score"), F.when(status == "F", year).alias("admission_year"),
        F.when(status == "F", F.concat((F.year("o_orderdate") - 1).cast("string"), F.lit("-"), year)).when(status == "O", F.concat(year, F.lit("-"), (F.year("o_orderdate") + 1).cast("string"))).alias("academic_year"),
        none.alias("year"), F.col("o_orderpriority").alias("title"), F.when(status != "P", F.col("campus")).alias("campus"), none.alias("campus_code"), none.alias("campuses"),
        F.col("o_orderpriority").alias("heading"), F.array("o_orderpriority").alias("heading_path"), none.alias("section"), F.concat_ws(" ", "o_orderpriority", "campus").alias("content"), status.alias("mode"),
    )
    return scope.assess(s.join(scope.with_scope(q, _VOCABULARY), "query_id"), _VOCABULARY)


def scope_assess(spark, sf):
    return _assessed(spark, sf).select("query_id", "chunk_id", "eligible", F.array_join("ambiguities", ",").alias("ambiguities"), F.array_join("exclusions", ",").alias("exclusions"), F.round(scope.factor_product(F.col("factors")), 6).alias("factor"))


def domain_rerank(spark, sf):
    return rerank.domain_rerank(_assessed(spark, sf), 5).select("query_id", "chunk_id", F.round("domain_score", 6).alias("domain_score"), "rank")


def scope_errors(spark, sf):
    return evaluation.scope_error_rates(_assessed(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (
        folded_text, text_ids, facts_of_documents, abbreviations, search_steps, cited_evidence, citation_id_collisions, citations, accepted_answers, evidence_membership, precision_at_k, list_metrics, terms_by_branch,
        candidate_chars, retrieval_report, golden_findings, table_families, catalog_sections, catalog_texts, named_entries, preflight, deletes, validated_batch, appended_messages, query_variants, accepted_rewrites, protected_of_documents,
        model_rerank, rerank_faults, named_entity_gate, scope_assess, domain_rerank, scope_errors,
    )
}


def _ct(x: str) -> str:
    return f"list_distinct(list_filter({sql_tokens(x)}, lambda t: length(t) >= 2))"


def _spaced(x: str) -> str:
    return f"trim(regexp_replace(replace(lower({x}), 'ß', 'ss'), '\\s+', ' ', 'g'))"


def _unmarked(x: str) -> str:
    """As normalized_markdown: without its signs."""
    return _spaced(f"regexp_replace({x}, '[*_`\\\\]', '', 'g')")


def _fold(x: str) -> str:
    return f"replace(strip_accents(replace(lower({x}), 'ß', 'ss')), 'đ', 'd')"


def _marked(x: str) -> str:
    """Each word between chr(1) and chr(2), for there is no looking around in DuckDB's patterns."""
    return f"regexp_replace({x}, '([\\p{{L}}\\p{{N}}_]+)', chr(1) || '\\1' || chr(2), 'g')"


def _numbers(x: str) -> str:
    return f"list_transform(regexp_extract_all({_marked(x)}, '\\x01[0-9]+\\x02(?:[.,:/-]\\x01[0-9]+\\x02)*'), lambda s: replace(replace(s, chr(1), ''), chr(2), ''))"


def _facts(x: str) -> str:
    mixed = f"list_filter(regexp_extract_all({_marked(x)}, '\\x01([A-Za-z0-9_]+)\\x02', 1), lambda s: regexp_matches(s, '[A-Za-z]') AND regexp_matches(s, '[0-9]'))"
    capitals = f"regexp_extract_all({_marked(x)}, '\\x01(\\p{{Lu}}{{2,}})\\x02', 1)"
    quoted = f"flatten(list_transform(regexp_extract_all({x}, '[\"“]([^\"”]+)[\"”]', 1), lambda s: {sql_tokens('s')}))"
    every = f"list_concat(list_concat({_numbers(x)}, {capitals}), list_concat({mixed}, {quoted}))"
    return f"list_sort(list_distinct(list_transform({every}, lambda s: replace(lower(s), 'ß', 'ss'))))"


def _found(k: int) -> str:
    """hits with their documents (h) and the places of the items (g)."""
    return f"""{_search_sql(_ITEMS, k)},
h AS MATERIALIZED (SELECT query_id, query, chunk_id, score, rank, text, source, lang FROM hits JOIN q USING (query_id) JOIN documents d ON d.doc_id = hits.chunk_id)"""


_GOLDEN = "g AS MATERIALIZED (SELECT item_id AS case_id, doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_ENTITIES = f"e AS (SELECT query_id, unnest(list_filter({_ct('query')}, lambda t: length(t) > 8)) AS entity FROM q)"
_SLUG = f"regexp_replace(substr(regexp_replace(regexp_replace({_fold('text')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 90), '-+$', '')"
_TABLES = r"""
c AS (SELECT conv_id AS doc_id, turn, role, trim(regexp_replace(text, '[\s|\\]+', ' ', 'g')) AS t FROM conversations),
whole AS (SELECT doc_id, count(*) AS rows, min(turn) = 0 AND count(*) = max(turn) + 1 AND count(DISTINCT turn) = count(*) AS complete, count(*) FILTER (WHERE role = 'assistant') AS answers FROM c GROUP BY doc_id),
r AS (SELECT c.*, answers, CASE WHEN role = 'system' AND t <> '' THEN t END AS label, CASE WHEN role = 'system' THEN [t, '', ''] ELSE [CAST(turn AS VARCHAR), role, t] END AS cells FROM c JOIN whole USING (doc_id) WHERE complete)"""
_SCOPE = f"""
regions AS (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
span AS (SELECT o_custkey, min(year(o_orderdate)) AS lo, max(year(o_orderdate)) AS hi FROM orders GROUP BY 1),
cq AS (SELECT c_custkey, c_mktsegment AS seg, CASE WHEN c_mktsegment <> 'FURNITURE' AND r_name IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE') THEN r_name END AS q_place,
  CASE c_mktsegment WHEN 'BUILDING' THEN CAST([] AS BIGINT[]) WHEN 'AUTOMOBILE' THEN [hi] WHEN 'MACHINERY' THEN [lo, lo + 1] WHEN 'HOUSEHOLD' THEN CASE WHEN lo = hi THEN [lo] ELSE [lo, hi] END ELSE [lo] END AS ys,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'missing' WHEN 'MACHINERY' THEN 'academic_range' WHEN 'HOUSEHOLD' THEN CASE WHEN lo = hi THEN 'single' ELSE 'multi' END ELSE 'single' END AS qk,
  c_mktsegment IN ('BUILDING', 'MACHINERY') AS price,
  concat_ws(' ', c_mktsegment, CASE WHEN c_mktsegment <> 'FURNITURE' THEN r_name END, CASE c_mktsegment WHEN 'BUILDING' THEN NULL WHEN 'AUTOMOBILE' THEN hi || '' WHEN 'MACHINERY' THEN lo || '-' || (lo + 1) WHEN 'HOUSEHOLD' THEN lo || ' and ' || hi ELSE lo || '' END) AS query
  FROM customer JOIN span ON c_custkey = o_custkey JOIN regions ON c_nationkey = n_nationkey),
pl AS (SELECT l_orderkey, r_name AS campus FROM (SELECT l_orderkey, min(l_suppkey) AS s FROM lineitem GROUP BY 1) JOIN supplier ON s = s_suppkey JOIN regions ON s_nationkey = n_nationkey),
j AS (SELECT cq.*, o_orderkey, o_totalprice, o_orderstatus AS mode, o_orderpriority AS head, campus,
  CASE WHEN o_orderstatus <> 'P' AND campus IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE') THEN campus END AS s_place,
  CASE WHEN o_orderstatus = 'F' AND qk = 'academic_range' THEN [year(o_orderdate) - 1, year(o_orderdate)] WHEN o_orderstatus = 'F' THEN [year(o_orderdate)] WHEN o_orderstatus = 'O' THEN [year(o_orderdate), year(o_orderdate) + 1] ELSE CAST([] AS BIGINT[]) END AS sy
  FROM orders JOIN cq ON o_custkey = c_custkey LEFT JOIN pl ON o_orderkey = l_orderkey),
k AS (SELECT *, CASE WHEN len(ys) = 0 THEN NULL WHEN len(sy) = 0 THEN 'year_missing'
    WHEN qk = 'academic_range' AND len(sy) = 2 THEN CASE WHEN ys = sy THEN 'academic_range' ELSE 'wrong_academic_range' END
    WHEN qk = 'single' AND len(sy) = 2 THEN CASE WHEN list_contains(ys, sy[1]) THEN 'academic_start' ELSE 'wrong_admission_year' END
    WHEN qk = 'academic_range' AND NOT list_contains(sy, ys[1]) THEN 'wrong_academic_start'
    WHEN NOT list_has_any(ys, sy) THEN 'wrong_year' ELSE 'year_match' END AS y,
  CASE WHEN q_place IS NOT NULL AND s_place IS NULL THEN 'campus_missing' WHEN q_place <> s_place THEN 'wrong_campus' WHEN q_place IS NOT NULL THEN 'campus_match' WHEN s_place IS NULL AND price THEN 'campus_unspecified' END AS p,
  price AND head IN ('1-URGENT', '2-HIGH') AS section, price AND head = '5-LOW' AS off FROM j),
a AS (SELECT *, CASE y WHEN 'year_missing' THEN 8e-1 WHEN 'academic_range' THEN 125e-2 WHEN 'academic_start' THEN 11e-1 WHEN 'year_match' THEN 125e-2 ELSE 1e0 END
    * CASE p WHEN 'campus_missing' THEN 8e-1 WHEN 'campus_match' THEN 12e-1 ELSE 1e0 END * CASE WHEN section THEN 15e-1 WHEN off THEN 5e-1 ELSE 1e0 END AS product,
  concat_ws(',', CASE WHEN y = 'year_missing' THEN y WHEN y = 'year_match' AND qk = 'academic_range' THEN 'academic_range_unconfirmed' END, CASE WHEN p IN ('campus_missing', 'campus_unspecified') THEN p END) AS ambiguities,
  concat_ws(',', CASE WHEN y LIKE 'wrong%' THEN y END, CASE WHEN p = 'wrong_campus' THEN p WHEN p = 'campus_missing' AND price THEN 'cutoff_campus_unconfirmed' END) AS exclusions FROM k)"""
_DOMAIN_OVERLAP = f"len(list_intersect({_ct('query')}, {_ct('concat_ws(chr(32), head, campus)')}))"
def _lowered(x: str) -> str:
    return f"list_distinct(list_transform({x}, lambda w: replace(lower(w), 'ß', 'ss')))"


_JOINED = r"[\p{L}\p{N}]+(?:[-./][\p{L}\p{N}]+)*"


def _joined(x: str) -> str:
    return _lowered(f"regexp_extract_all({x}, '{_JOINED}')")


def _protected(x: str, known: tuple[str, ...] = ()) -> str:
    """Numbers are what is left of digits when words with a letter are gone; the rest is looked for among the words."""
    numbers = rf"regexp_extract_all(regexp_replace({x}, '[\p{{L}}\p{{N}}_]*[\p{{L}}_][\p{{L}}\p{{N}}_]*', ' ', 'g'), '[0-9]+(?:[.,][0-9]+)*')"
    bare = "regexp_replace(w, '[-./]', '', 'g')"
    kept = rf"list_contains({list(known)!r}::VARCHAR[], lower(w)) OR (regexp_matches({bare}, '\p{{L}}') AND (regexp_matches({bare}, '[0-9]') OR (length({bare}) >= 2 AND regexp_matches({bare}, '\p{{Lu}}') AND NOT regexp_matches({bare}, '\p{{Ll}}'))))"
    quoted = f"""flatten(list_transform(regexp_extract_all({x}, '["“”'']([^"“”'']+)["“”'']', 1), lambda q: regexp_extract_all(q, '{_JOINED}')))"""
    words = f"regexp_extract_all({x}, '{_JOINED}')"
    return f"list_sort({_lowered(f'{numbers} || list_filter({words}, lambda w: {kept}) || {quoted}')})"


_REWRITES = f"rw AS (SELECT query_id, query AS original, unnest([0, 1, 2]) AS pos, unnest([lower(query), split_part(query, '.', 1), query || ' 2024']) AS candidate FROM ({_ITEMS}))"


def _topics(x: str) -> str:
    return f"list_filter(list_distinct({sql_tokens(x)}), lambda t: t NOT IN ('the', 'and', 'of'))"


ORACLE_SQL = {
    "folded_text": f"SELECT doc_id, md5({_fold('text')}) AS digest, md5({_unmarked('text')}) AS plain_digest FROM documents",
    "text_ids": f"""
WITH s AS (SELECT *, {_SLUG} AS slug, CAST(n_chars // 1000 + 1 AS INT) AS page, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(source || '/' || doc_id)) AS u FROM documents)
SELECT doc_id, slug, source || '-' || n_chars || '-' || lang || '-' || slug || '-v1-p' || printf('%03d', page) AS made_id, left(sha256(concat_ws(chr(31), doc_id, 'text', page, lang, '', 0, text)), 24) AS chunk_id,
  substr(u, 1, 8) || '-' || substr(u, 9, 4) || '-5' || substr(u, 14, 3) || '-' || (['8', '9', 'a', 'b'])[(strpos('0123456789abcdef', substr(u, 17, 1)) - 1) % 4 + 1] || substr(u, 18, 3) || '-' || substr(u, 21, 12) AS point_id,
  '{{"lang":"' || lang || '","source":"' || source || '"}}' AS payload FROM s""",
    "facts_of_documents": f"SELECT doc_id, CAST(len(f) AS INT) AS n_facts, md5(array_to_string(f, ' ')) AS digest, numbers FROM (SELECT doc_id, {_facts('text')} AS f, len({_numbers('text')}) AS numbers FROM documents)",
    "abbreviations": f"SELECT doc_id, md5(replace(replace(regexp_replace(regexp_replace({_marked('text')}, '(?i)\\x01(ist)\\x02', chr(1) || '\\1' || chr(2) || ' (is (being))', 'g'), '(?i)\\x01(une)\\x02', chr(1) || '\\1' || chr(2) || ' (one)', 'g'), chr(1), ''), chr(2), '')) AS digest FROM documents",
    "search_steps": f"""
WITH t AS (SELECT conv_id, turn, text, {_fold('text')} AS f, {sql_tokens('text')} AS w FROM conversations WHERE role = 'user'),
o AS (SELECT *, regexp_matches(f, '\\bthe\\b|\\bder\\b') AND len(list_filter({sql_tokens("regexp_replace(f, '\\bthe\\b|\\bder\\b', ' ', 'g')")}, lambda x: x NOT IN ('and', 'of', 'in', 'und'))) = 0 AS overview FROM t)
SELECT conv_id, turn, regexp_matches(lower(text), 'which of|quels') OR list_has_any(w, ['que', 'und']) AS is_list, overview, regexp_matches(f, 'now|on ') AND regexp_matches(f, 'the|de') AS live,
  concat_ws(',', CASE WHEN regexp_matches(f, 'st') THEN 'north' END, CASE WHEN regexp_matches(f, 'ouo|er\\b') THEN 'south' END) AS places,
  md5(CASE WHEN overview THEN text || ' list of all' WHEN length(text) > 200 AND trim({_spaced('text')}) <> '' THEN {_spaced('text')} ELSE text END) AS search_digest, sha256(text) AS question_hash FROM o""",
    "cited_evidence": f"""
WITH {_found(10)}, x AS (SELECT query_id, {_spaced('text')} AS norm, lang, max(score) AS score, min(rank) AS pos, arg_min(chunk_id, rank) AS chunk_id, list_distinct(flatten(list({_ct('text')}))) AS tok, {_ct('any_value(query)')} AS qt FROM h GROUP BY 1, 2, 3),
m AS (SELECT *, len(list_intersect(qt, tok)) AS shared FROM x), scored AS (SELECT *, round(shared / len(qt), 9) AS coverage, CASE WHEN len(qt) > 0 AND len(tok) > 0 THEN round(shared / len(qt) + 0.25 * shared / len(tok), 9) ELSE 0.0 END AS overlap FROM m)
SELECT query_id, chunk_id, pos, score, CAST(len(tok) AS INT) AS n_tokens, coverage, overlap, CAST(row_number() OVER (PARTITION BY query_id ORDER BY coverage DESC, overlap DESC, score DESC, pos) AS INT) AS rank FROM scored""",
    "citation_id_collisions": "SELECT source AS query_id, sha256(text) AS chunk_id, count(DISTINCT (lang, doc_id)) AS identities FROM documents GROUP BY 1, 2 HAVING count(DISTINCT (lang, doc_id)) > 1",
    "citations": f"WITH {_found(10)} SELECT query_id AS answer_id, rank AS marker, chunk_id FROM h WHERE contains(text, query)",
    "accepted_answers": f"""
WITH {_found(3)}, ahs AS (SELECT *, contains(text, query) AS cites FROM h),
am AS (SELECT query_id, bool_or(cites) AS found, count(*) FILTER (WHERE cites) AS n, coalesce(list(rank ORDER BY rank) FILTER (WHERE cites OR length(query) % 3 = 0), []) AS marks, coalesce(list(rank ORDER BY rank) FILTER (WHERE cites), []) AS told FROM ahs GROUP BY 1),
aa AS (SELECT q.query_id, query, coalesce(found, false) AS found, CASE WHEN coalesce(found, false) THEN len(marks) ELSE 0 END AS n_marks, CASE WHEN coalesce(found, false) THEN marks = told ELSE true END AS maps, coalesce(found, false) OR length(query) % 11 = 0 AS expected,
  CASE WHEN coalesce(found, false) THEN CASE WHEN length(query) % 7 = 0 THEN 'See' ELSE 'It is  ' || upper(query) END WHEN length(query) % 5 = 0 THEN 'nothing' ELSE 'Sorry, NO answer found.' END AS said FROM q LEFT JOIN am USING (query_id)),
ab AS (SELECT *, trim(regexp_replace(replace(lower(said), 'ß', 'ss'), '\\s+', ' ', 'g')) AS folded, trim(regexp_replace(replace(lower(left(query, 12)), 'ß', 'ss'), '\\s+', ' ', 'g')) AS term FROM aa),
ar AS (SELECT query_id AS answer_id, expected, found = expected AS route_matches_expected, true AS answer_nonempty, contains(folded, 'no answer found') AS answer_is_abstention, contains(folded, term) AS required_terms_present, found AS evidence_required, n_marks = 0 AS no_inline_markers, NOT found AS no_citations, maps AS marker_mapping_valid, found AS citation_support_valid FROM ab)
SELECT * EXCLUDE (expected), CASE WHEN NOT expected THEN route_matches_expected AND answer_is_abstention AND no_inline_markers AND no_citations ELSE route_matches_expected AND required_terms_present AND (NOT evidence_required OR (NOT no_inline_markers AND NOT no_citations AND marker_mapping_valid AND citation_support_valid)) END AS accepted FROM ar""",
    "evidence_membership": f"WITH {_found(3)}, b AS (SELECT chunk_id, CASE WHEN contains({_unmarked('text')}, {_unmarked('query')}) THEN 'ok' ELSE 'quote_missing' END AS status FROM h) SELECT chunk_id, status, count(*) AS n FROM b GROUP BY 1, 2",
    "precision_at_k": f"""
WITH {_found(10)}, {_GOLDEN}, n AS (SELECT query_id, count(*) AS n, count(*) FILTER (WHERE (query_id, chunk_id) IN (SELECT (case_id, chunk_id) FROM g)) AS good FROM h WHERE rank <= 5 GROUP BY 1)
SELECT query_id AS case_id, CAST(round(CASE WHEN query_id NOT IN (SELECT case_id FROM g) THEN CASE WHEN n IS NULL THEN 1 ELSE 0 END WHEN n > 0 THEN good / n ELSE 0 END, 6) AS DOUBLE) AS precision FROM q LEFT JOIN n USING (query_id)""",
    "list_metrics": f"""
WITH {_found(10)}, {_ENTITIES}, f AS (SELECT DISTINCT e.query_id, entity FROM e JOIN h USING (query_id) WHERE contains(lower(text), entity)),
er AS (SELECT e.query_id, round(avg(CASE WHEN f.entity IS NULL THEN 0.0 ELSE 1.0 END), 6) AS entity_recall FROM e LEFT JOIN f ON f.query_id = e.query_id AND f.entity = e.entity GROUP BY 1),
d AS (SELECT query_id, count(DISTINCT source) AS source_coverage, round(1 - count(DISTINCT sha256(text)) / count(*), 6) AS duplicate_ratio FROM h GROUP BY 1)
SELECT query_id AS case_id, entity_recall, source_coverage, duplicate_ratio FROM er LEFT JOIN d USING (query_id)""",
    "terms_by_branch": f"""
WITH {_found(10)}, {_ENTITIES}, b AS (SELECT DISTINCT query_id, lang FROM h), t AS (SELECT query_id, count(*) AS n FROM e GROUP BY 1),
f AS (SELECT DISTINCT query_id, lang, entity FROM e JOIN h USING (query_id) WHERE contains(lower(text), entity)), s2 AS (SELECT query_id, lang, string_agg(entity, ' ' ORDER BY entity) AS found, count(*) AS m FROM f GROUP BY 1, 2)
SELECT query_id AS case_id, lang AS branch, coalesce(found, '') AS found, CAST(n - coalesce(m, 0) AS INT) AS n_missed FROM b JOIN t USING (query_id) LEFT JOIN s2 USING (query_id, lang)""",
    "candidate_chars": f"WITH {_found(10)} SELECT query_id, count(*) AS candidates, round(avg(length(text)), 6) AS mean_chars, CAST(max(length(text)) AS INT) AS most_chars FROM h GROUP BY 1",
    "retrieval_report": f"WITH {_found(10)} SELECT query_id, rank, chunk_id, source AS title, round(score, 4) AS score, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 240) AS snippet FROM h WHERE rank <= 5",
    "golden_findings": f"""
WITH {_GOLDEN}, n AS (SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT case_id FROM g))
SELECT CAST(item_id AS VARCHAR) AS id, unnest(['blank_truth', 'abstains_but_not_negative', 'abstains_with_evidence', 'negative_without_fallback']) AS rule FROM n
UNION ALL SELECT CAST(item_id AS VARCHAR), 'repeated_question' FROM (SELECT item_id, count(*) OVER (PARTITION BY {_unmarked('text')}) AS n FROM benchmark) WHERE n > 1
UNION ALL SELECT NULL, 'number_of_cases' FROM (SELECT count(*) AS n FROM benchmark) WHERE n NOT BETWEEN 30 AND 50""",
    "table_families": f"WITH {_TABLES} SELECT doc_id, complete, rows FROM whole",
    "catalog_sections": rf"""
WITH {_TABLES}, m AS (SELECT *, coalesce(regexp_matches(label, '^(?i:[ivxlc]+)[.)\s]'), false) AS roman FROM r), n AS (SELECT *, sum(CAST(roman AS INT)) OVER (PARTITION BY doc_id ORDER BY turn) AS nth FROM m),
o AS (SELECT *, CASE WHEN roman OR nth = 0 THEN label END AS own FROM n),
s AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY turn) AS section, last_value(CASE WHEN own IS NULL THEN label END IGNORE NULLS) OVER (PARTITION BY doc_id, nth ORDER BY turn) AS subsection FROM o)
SELECT doc_id, turn + 1 AS row, md5(array_to_string(cells, '|')) AS digest, md5(section) AS section, md5(subsection) AS subsection FROM s WHERE label IS NULL""",
    "catalog_texts": f"""
WITH {_TABLES}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn) AS k FROM r WHERE answers > 2 AND label IS NULL),
t AS (SELECT doc_id, string_agg(k || '. turn: ' || cells[1] || '; role: ' || cells[2] || '; text: ' || cells[3], chr(10) ORDER BY k) AS text FROM n GROUP BY 1) SELECT doc_id AS query_id, CAST(length(text) AS INT) AS n_chars, md5(text) AS digest FROM t""",
    "named_entries": f"WITH {_TABLES} SELECT role AS query_id, doc_id, turn + 1 AS row FROM r WHERE role <> 'system'",
    "preflight": """
WITH base AS (SELECT count(*) AS n, count(*) FILTER (WHERE lang = 'fr') AS fr, count(*) FILTER (WHERE length(text) > 100 IS NOT TRUE) AS short FROM documents),
golden AS (SELECT count(DISTINCT doc_id) AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)), long AS (SELECT count(*) AS n FROM benchmark WHERE length(text) > 300),
c AS (SELECT * FROM base, (VALUES ('same'), ('older'), ('lost')) v(stored), (VALUES ('manifest_missing', 'error'), ('manifest_count', 'error'), ('corpus_changed', 'warning'), ('build_changed', 'warning'), ('proposed_repeated_ids', 'error'), ('stored_repeated_ids', 'error'), ('golden_findings', 'error'), ('golden_ids_missing', 'error'), ('stored_differs', 'error')) w(name, severity)),
r AS (SELECT stored, name, severity, CAST(CASE WHEN name = 'golden_ids_missing' THEN (SELECT n FROM golden) WHEN name = 'golden_findings' AND stored = 'lost' THEN (SELECT n FROM long) WHEN name = 'corpus_changed' AND stored = 'older' THEN CAST(fr > 0 AS INT) WHEN name = 'manifest_count' AND stored = 'lost' THEN CAST(short > 0 AS INT) WHEN name = 'stored_differs' AND stored = 'lost' THEN short ELSE 0 END AS BIGINT) AS n FROM c)
SELECT stored, name AS "check", severity, n FROM r
UNION ALL SELECT stored, 'status', CASE WHEN bool_or(severity = 'error' AND n > 0) THEN 'blocked' WHEN sum(n) > 0 THEN 'ready_for_rebuild' ELSE 'current' END, CAST(sum(n) AS BIGINT) FROM r GROUP BY stored""",
    "deletes": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND source IS DISTINCT FROM 'src3'",
    "validated_batch": "SELECT doc_id, CASE WHEN trim(text) = '' THEN 'blank_content' WHEN count(*) OVER (PARTITION BY text) > 1 THEN 'repeated_id' END AS reject FROM documents",
    "appended_messages": """
WITH a AS (SELECT conv_id, max(turn) + 1 AS n, md5(arg_max(text, turn) FILTER (WHERE role = 'user')) AS question, md5(arg_min(text, turn) FILTER (WHERE role = 'assistant')) AS answer FROM conversations GROUP BY 1)
SELECT conv_id, n AS turn, 'user' AS role, question AS digest FROM a UNION ALL SELECT conv_id, n + 1, 'assistant', answer FROM a""",
    "query_variants": f"""
WITH {_REWRITES}, w AS (SELECT *, {_topics('original')} AS o, {_topics('candidate')} AS c FROM rw),
good AS (SELECT query_id, pos, candidate AS v FROM w WHERE {_facts('original')} = {_facts('candidate')} AND len(list_intersect(o, c)) >= greatest(1, ceil(0.6 * len(o)))),
every AS (SELECT DISTINCT query_id, -1 AS pos, original AS v FROM rw UNION ALL SELECT * FROM good), once AS (SELECT query_id, {_spaced('v')} AS norm, min(pos) AS pos, arg_min(v, pos) AS v FROM every GROUP BY 1, 2)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos, norm) AS INT) AS place, md5(v) AS digest FROM once QUALIFY place <= 3""",
    "accepted_rewrites": f"WITH {_REWRITES} SELECT query_id, pos AS candidate_pos, md5(CASE WHEN trim(candidate) <> '' AND list_has_all({_joined('candidate')}, {_joined('original')}) AND list_has_all({_joined('candidate')}, {_protected('original')}) AND list_has_all({_protected('original')}, {_protected('candidate')}) THEN candidate ELSE original END) AS digest FROM rw",
    "protected_of_documents": f"SELECT doc_id, CAST(len(t) AS INT) AS n_terms, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_protected('text', ('the', 'von'))} AS t FROM documents)",
    "model_rerank": f"WITH {_found(10)} SELECT query_id, chunk_id, -CAST(length(text) AS DOUBLE) AS model_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY length(text), score DESC, chunk_id) AS INT) AS rank FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(text), score DESC, chunk_id) <= 4",
    "rerank_faults": f"""
WITH {_found(10)}, t AS (SELECT *, {_ct('query')} AS a, {_ct('text')} AS b FROM h), o AS (SELECT query_id, rank, CASE WHEN len(a) > 0 AND len(b) > 0 THEN round(len(list_intersect(a, b)) / len(a) + 0.25 * len(list_intersect(a, b)) / len(b), 9) ELSE 0.0 END AS m FROM t)
SELECT DISTINCT query_id, 'not_a_candidate' AS fault FROM h WHERE rank > 8 UNION ALL SELECT DISTINCT query_id, 'out_of_order' FROM (SELECT query_id, m, lag(m) OVER (PARTITION BY query_id ORDER BY rank) AS b FROM o) WHERE b < m""",
    "named_entity_gate": f"""
WITH {_found(3)}, n AS (SELECT query_id, nullif(trim(regexp_extract({_fold('query')}, '([a-z]+ [a-z]+)[^a-z]*$', 1)), '') AS name FROM q), x AS (SELECT query_id, ' ' || array_to_string({sql_tokens(_fold('text'))}, ' ') || ' ' AS words FROM h)
SELECT query_id, name, name IS NULL OR EXISTS (SELECT 1 FROM x WHERE x.query_id = n.query_id AND contains(words, ' ' || name || ' ')) AS passes FROM n""",
    "scope_assess": f"WITH {_SCOPE} SELECT c_custkey AS query_id, o_orderkey AS chunk_id, exclusions = '' AS eligible, ambiguities, exclusions, round(least(4e0, greatest(25e-2, product)), 6) AS factor FROM a",
    "domain_rerank": f"""
WITH {_SCOPE}, v AS (SELECT *, {_DOMAIN_OVERLAP} AS shared, len({_ct('query')}) AS nq, len({_ct('concat_ws(chr(32), head, campus)')}) AS nc FROM a WHERE exclusions = ''),
d AS (SELECT c_custkey AS query_id, o_orderkey AS chunk_id, o_totalprice, round(o_totalprice * least(4e0, greatest(25e-2, (1 + 2 * (shared / nq + 25e-2 * shared / nc)) * product)), 9) AS s FROM v)
SELECT query_id, chunk_id, round(s, 6) AS domain_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, o_totalprice DESC, chunk_id) AS INT) AS rank FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, o_totalprice DESC, chunk_id) <= 5""",
    "scope_errors": f"WITH {_SCOPE} SELECT mode, round(avg(CASE WHEN y LIKE 'wrong%' THEN 1e0 ELSE 0e0 END), 6) AS wrong_year, round(avg(CASE WHEN p = 'wrong_campus' THEN 1e0 ELSE 0e0 END), 6) AS wrong_place FROM a GROUP BY mode",
}
