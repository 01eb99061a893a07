"""Retrieval evaluation: metrics per case and mode, golden-set rules, timings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import normalized_markdown, normalized_space
from corpusloom.runtime import rank_in_groups


def retrieval_metrics(run: DataFrame, golden: DataFrame, cases: DataFrame) -> DataFrame:
    """(mode, case_id, recall, coverage, rr): per case with evidence.

    ``run`` has (mode, case_id, chunk_id, parent_id, rank), ``golden`` (case_id, chunk_id), ``cases`` (case_id, mode).
    Recall counts exact ids; coverage also a parent of the evidence; rr is one over the first covering rank, else 0.
    """
    asked = cases.join(golden, "case_id")
    hit = run.select("mode", "case_id", "chunk_id", "parent_id", "rank")
    exact = asked.join(hit.select("mode", "case_id", "chunk_id", F.col("rank").alias("r")), ["mode", "case_id", "chunk_id"], "left")
    exact = exact.groupBy("mode", "case_id", "chunk_id").agg(F.min("r").alias("exact_rank"))
    above = hit.where("parent_id is not null").groupBy("mode", "case_id", F.col("parent_id").alias("chunk_id")).agg(F.min("rank").alias("parent_rank"))
    both = exact.join(above, ["mode", "case_id", "chunk_id"], "left").withColumn("rank", F.least("exact_rank", "parent_rank"))
    return both.groupBy("mode", "case_id").agg(
        F.round(F.avg(F.col("exact_rank").isNotNull().cast("double")), 6).alias("recall"),
        F.round(F.avg(F.col("rank").isNotNull().cast("double")), 6).alias("coverage"),
        F.round(F.coalesce(1 / F.min("rank"), F.lit(0.0)), 6).alias("rr"),
    )


def mean_metrics(per_case: DataFrame) -> DataFrame:
    """(mode, cases, recall, coverage, mrr): means over cases; nulls are left out as by avg."""
    return per_case.groupBy("mode").agg(F.count("*").alias("cases"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("coverage"), 6).alias("coverage"), F.round(F.avg("rr"), 6).alias("mrr"))


def scope_error_rates(hits: DataFrame) -> DataFrame:
    """(mode, wrong_year, wrong_place): shares of assessed hits with such an exclusion."""
    has = lambda p: F.avg(F.exists("exclusions", lambda e: e.startswith(p)).cast("double"))
    years = F.avg(F.exists("exclusions", lambda e: e.startswith("wrong_") & (e != "wrong_campus")).cast("double"))
    return hits.groupBy("mode").agg(F.round(years, 6).alias("wrong_year"), F.round(has("wrong_campus"), 6).alias("wrong_place"))


def negative_false_positive_rate(cases: DataFrame, run: DataFrame) -> DataFrame:
    """(mode, rate): the share of out-of-scope cases that returned something. ``cases``: (case_id, mode, negative).

    A mode whose cases are all in scope has a null rate.
    """
    returned = run.select("mode", "case_id").distinct().withColumn("hit", F.lit(1.0))
    joined = cases.join(returned, ["mode", "case_id"], "left")
    return joined.groupBy("mode").agg(F.round(F.avg(F.when(F.col("negative"), F.coalesce("hit", F.lit(0.0)))), 6).alias("rate"))


def precision_at_k(run: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """(case_id, precision): relevant hits among the first k; a case that expects nothing scores 1 only if it returned nothing.

    ``expected`` has one row per case: (case_id, relevant array<chunk id>).
    """
    own = run.where(F.col("rank") <= k).groupBy("case_id").agg(F.collect_set("chunk_id").alias("got"), F.count("*").alias("n"))
    j = expected.join(own, "case_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = F.size(F.array_intersect("got", "relevant")) / F.col("n")
    value = F.when(F.size("relevant") == 0, (F.col("n") == 0).cast("double")).otherwise(F.when(F.col("n") > 0, share).otherwise(0.0))
    return j.select("case_id", F.round(value, 6).alias("precision"))


def list_metrics(hits: DataFrame, entities: DataFrame) -> DataFrame:
    """(case_id, entity_recall, source_coverage, duplicate_ratio) of list questions."""
    text = hits.groupBy("case_id").agg(F.count_distinct("doc_id").alias("source_coverage"), F.round(1 - F.count_distinct("chunk_id") / F.count("*"), 6).alias("duplicate_ratio"))
    found = entities.join(hits.select("case_id", F.lower("content").alias("t")), "case_id").where(F.contains("t", F.lower("entity"))).select("case_id", "entity").distinct().withColumn("hit", F.lit(1.0))
    recall = entities.join(found, ["case_id", "entity"], "left").groupBy("case_id").agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("entity_recall"))
    return recall.join(text, "case_id", "left")


def terms_by_branch(hits: DataFrame, terms: DataFrame) -> DataFrame:
    """(case_id, branch, found, missed): expected terms that each branch's hits show."""
    shown = hits.join(terms, "case_id").where(F.contains(F.lower("content"), F.lower("term"))).groupBy("case_id", "branch").agg(F.array_sort(F.collect_set("term")).alias("found"))
    every = terms.groupBy("case_id").agg(F.array_sort(F.collect_set("term")).alias("all")).join(hits.select("case_id", "branch").distinct(), "case_id")
    found = F.coalesce("found", F.array().cast("array<string>"))
    return every.join(shown, ["case_id", "branch"], "left").select("case_id", "branch", found.alias("found"), F.array_except("all", found).alias("missed"))


def latency_medians(timings: DataFrame) -> DataFrame:
    """(case_id, median_ms) over runs: the value, or mean of the two values, in the middle of each case; null without values.

    Runs get their rank by ranges, so no task holds the values of a case; only the middle ones are taken on.
    """
    runs = timings.where(F.col("ms").isNotNull()).select("case_id", F.col("ms").cast("double").alias("ms"))
    n = timings.groupBy(F.col("case_id").alias("c")).agg(F.count("ms").alias("n"))
    ranked = rank_in_groups(runs, ["case_id"], ["ms"], "r").join(n, F.col("case_id").eqNullSafe(F.col("c")))
    middle = ranked.where((F.col("r") == F.floor((F.col("n") + 1) / 2)) | (F.col("r") == F.floor(F.col("n") / 2) + 1))
    found = middle.groupBy(F.col("case_id").alias("of")).agg(F.avg("ms").alias("median_ms"))
    return n.join(found, F.col("c").eqNullSafe(F.col("of")), "left").select(F.col("c").alias("case_id"), "median_ms")


def golden_summary(cases: DataFrame) -> DataFrame:
    """(route, difficulty, category, n): counts by each of the three alone."""
    return cases.groupingSets([["expected_route"], ["difficulty"], ["category"]], "expected_route", "difficulty", "category").agg(F.count("*").alias("n"))


#: What a case and a piece of evidence of a golden set must have, and the version of its layout.
CASE_FIELDS = ("id", "category", "difficulty", "question", "expected_route", "ground_truth", "evidence_ids", "required_terms", "tags")
EVIDENCE_FIELDS = ("chunk_id", "doc_id", "title", "page", "source_url", "quote")
GOLDEN_VERSION = 1


def _blank(c: F.Column) -> F.Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit(""))) == ""


def _listed(rows: DataFrame, key: str, *rules: F.Column) -> DataFrame:
    """(key, rule): one row for each rule of a row that isn't null."""
    return rows.select(key, F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("rule"))


def golden_findings(cases: DataFrame, evidence: DataFrame, answered: str, abstained: str, difficulties: tuple[str, ...], negative: str, fallback: str, least: int = 30, most: int = 50) -> DataFrame:
    """(id, rule): rules that the cases of a golden set break; rules of the whole set have a null id.

    ``cases`` has CASE_FIELDS; a case that lacks one is told so and nothing else. An answered case quotes its terms from
    evidence and names them in its truth; any other case is of the negative difficulty, has neither evidence nor terms, and
    its truth is the fallback. Ids and questions that several cases share are told of each of them.
    """
    lacks = F.exists(F.array(*(F.col(c).isNull() for c in CASE_FIELDS)), lambda x: x)
    whole = cases.where(~lacks)
    named = whole.select("id", F.explode("evidence_ids").alias("chunk_id"))
    unknown = named.join(evidence.select("chunk_id"), "chunk_id", "left_anti").select("id").distinct().withColumn("unknown", F.lit(True))
    quotes = named.join(evidence.select("chunk_id", "quote"), "chunk_id").groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(normalized_markdown(F.col("quote")))), " ").alias("quotes"))
    rows = whole.join(quotes, "id", "left").join(unknown, "id", "left")
    answer = F.col("expected_route") == answered
    truth = normalized_markdown(F.col("ground_truth"))
    absent = lambda where: F.exists("required_terms", lambda t: ~F.contains(F.coalesce(where, F.lit("")), normalized_markdown(t)))
    own = _listed(
        rows, "id",
        F.when(~F.col("id").rlike(r"^[a-z0-9][a-z0-9_-]*$"), "id_not_a_slug"),
        F.when(~F.col("expected_route").isin(answered, abstained), "unknown_route"),
        F.when(~F.col("difficulty").isin(*difficulties, negative), "unknown_difficulty"),
        F.when(normalized_markdown(F.col("question")) == "", "blank_question"),
        F.when(_blank(F.col("ground_truth")), "blank_truth"),
        F.when(F.exists("tags", lambda t: F.coalesce(t, F.lit("")) == ""), "blank_tag"),
        F.when(F.exists("required_terms", _blank), "blank_term"),
        F.when(F.col("unknown"), "unknown_evidence"),
        F.when(F.size(F.array_distinct("evidence_ids")) < F.size("evidence_ids"), "repeated_evidence"),
        F.when(answer & (F.size("evidence_ids") == 0), "answer_without_evidence"),
        F.when(answer & (F.size("required_terms") == 0), "answer_without_terms"),
        F.when(answer & absent(F.col("quotes")), "term_not_quoted"),
        F.when(answer & absent(truth), "term_not_in_truth"),
        F.when(~answer & (F.col("difficulty") != negative), "abstains_but_not_negative"),
        F.when(~answer & ((F.size("evidence_ids") > 0) | (F.size("required_terms") > 0)), "abstains_with_evidence"),
        F.when(~answer & (F.col("ground_truth") != fallback), "negative_without_fallback"),
    )
    twice = lambda rows, c, rule: rows.select("id", F.count("*").over(Window.partitionBy(c)).alias("n")).where("n > 1").select("id", F.lit(rule).alias("rule"))
    norm = normalized_markdown(F.col("question"))
    total = cases.agg(F.count("*").alias("n")).where((F.col("n") < least) | (F.col("n") > most)).select(F.lit(None).cast("string").alias("id"), F.lit("number_of_cases").alias("rule"))
    missing = cases.where(lacks).select("id", F.lit("missing_field").alias("rule"))
    return own.unionByName(missing).unionByName(twice(whole, F.col("id"), "repeated_id")).unionByName(twice(whole.where(norm != ""), norm, "repeated_question")).unionByName(total)


def evidence_findings(evidence: DataFrame) -> DataFrame:
    """(chunk_id, rule): pieces of evidence that lack a field or have a blank one, whose page isn't positive, or whose id repeats."""
    times = F.count("*").over(Window.partitionBy("chunk_id"))
    texts = [F.when(_blank(F.col(c)), f"blank_{c}") for c in EVIDENCE_FIELDS if c != "page"]
    return _listed(evidence.withColumn("__times", times), "chunk_id", *texts, F.when(F.coalesce(F.col("page") <= 0, F.lit(True)), "page_not_positive"), F.when(F.col("__times") > 1, "repeated_id"))


def golden_header_findings(header: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """(rule): what is wrong with a golden set's one row (schema_version, fingerprint, evidence), the number of its pieces of evidence.

    ``manifest`` is the index's one row with its corpus_fingerprint; without one only the form is looked at.
    """
    known = header.crossJoin(manifest.select("corpus_fingerprint")) if manifest is not None else header.withColumn("corpus_fingerprint", F.col("fingerprint"))
    rules = _listed(
        known.withColumn("key", F.lit(1)), "key",
        F.when(~F.col("schema_version").eqNullSafe(GOLDEN_VERSION), "schema_version"),
        F.when(~F.coalesce(F.col("fingerprint").rlike("^[0-9a-f]{64}$"), F.lit(False)), "fingerprint_not_sha256"),
        F.when(~F.col("fingerprint").eqNullSafe(F.col("corpus_fingerprint")), "fingerprint_differs"),
        F.when(F.coalesce(F.col("evidence") <= 0, F.lit(True)), "no_evidence"),
    )
    return rules.select("rule")


ACCEPTANCE = ("route_matches_expected", "answer_nonempty", "answer_is_abstention", "required_terms_present", "evidence_required", "no_inline_markers", "no_citations", "marker_mapping_valid", "citation_support_valid")


def response_acceptance(answers: DataFrame, citations: DataFrame, abstentions: tuple[str, ...], out_of_scope: str = "out_of_scope") -> DataFrame:
    """(answer_id, the booleans of ACCEPTANCE, accepted) of every answer.

    ``answers`` has (answer_id, text, route, expected_route, expected_evidence, required_terms); ``citations`` a row a citation:
    (answer_id, marker, quote, content), content being the cited source's (null: there is none). An answer's markers are the [n] in
    its text. Markers map if they are just the citations' markers, each there once; a citation is supported if its quote isn't blank
    and stands in its source (white space and Markdown signs aside). An answer out of scope must abstain in words, without markers and
    citations; any other must have its route, a text and its required terms (case-folded), and where evidence is expected
    markers and citations that map and are supported. Support is never inferred where there are no citations.
    """
    folded = normalized_space(F.coalesce("text", F.lit("")))
    found = F.transform(F.regexp_extract_all("text", F.lit(r"\[(\d{1,6})\]"), 1), lambda m: m.cast("int"))
    markers = F.sort_array(F.array_distinct(F.coalesce(found, F.array().cast("array<int>"))))
    supports = (F.trim(F.coalesce("quote", F.lit(""))) != "") & F.contains(normalized_markdown(F.col("content")), normalized_markdown(F.col("quote")))
    cited = citations.groupBy(F.col("answer_id").alias("__a")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.col("marker").cast("int"))).alias("told"), F.bool_and(F.coalesce(supports, F.lit(False))).alias("supported"))
    rows = answers.join(cited, F.col("answer_id").eqNullSafe(F.col("__a")), "left").withColumn("markers", markers)
    terms = F.coalesce("required_terms", F.array().cast("array<string>"))
    rules = {
        "route_matches_expected": F.col("route").eqNullSafe(F.col("expected_route")),
        "answer_nonempty": F.trim(folded) != "",
        "answer_is_abstention": F.coalesce(reduce(lambda a, b: a | b, [F.contains(folded, normalized_space(F.lit(p))) for p in abstentions], F.lit(False)), F.lit(False)),
        "required_terms_present": F.forall(terms, lambda t: F.coalesce(F.contains(folded, normalized_space(t)), F.lit(False))),
        "evidence_required": F.coalesce(F.col("expected_evidence") > 0, F.lit(False)),
        "no_inline_markers": F.size("markers") == 0,
        "no_citations": F.col("n").isNull(),
        "marker_mapping_valid": F.coalesce(F.col("told") == F.col("markers"), F.size("markers") == 0),
        "citation_support_valid": F.coalesce("supported", F.lit(False)),
    }
    rows = rows.select("answer_id", "expected_route", *(c.alias(k) for k, c in rules.items()))
    abstains = F.col("route_matches_expected") & F.col("answer_nonempty") & F.col("answer_is_abstention") & F.col("no_inline_markers") & F.col("no_citations")
    proved = ~F.col("no_inline_markers") & ~F.col("no_citations") & F.col("marker_mapping_valid") & F.col("citation_support_valid")
    answers_well = F.col("route_matches_expected") & F.col("answer_nonempty") & F.col("required_terms_present") & (~F.col("evidence_required") | proved)
    return rows.select("answer_id", *ACCEPTANCE, F.when(F.col("expected_route").eqNullSafe(out_of_scope), abstains).otherwise(answers_well).alias("accepted"))


def candidate_char_stats(hits: DataFrame) -> DataFrame:
    """(query_id, candidates, mean_chars, most_chars): how long each query's candidates are; a null content has no characters."""
    n = F.length(F.coalesce("content", F.lit("")))
    return hits.groupBy("query_id").agg(F.count("*").alias("candidates"), F.round(F.avg(n), 6).alias("mean_chars"), F.max(n).alias("most_chars"))


def retrieval_report(hits: DataFrame, k: int = 5, snippet: int = 240) -> DataFrame:
    """(query_id, rank, chunk_id, title, score, snippet): what a reader of a run sees, white space of the snippet made one line."""
    line = F.trim(F.regexp_replace("content", r"\s+", " "))
    return hits.where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "title", F.round("score", 4).alias("score"), F.substring(line, 1, snippet).alias("snippet"))
