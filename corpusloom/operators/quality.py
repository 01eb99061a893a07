"""Corpus quality: load status, versions, duplicates, audits, fingerprints, and the index's agreement with the corpus."""

from __future__ import annotations

import hashlib
import json
from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import normalized_markdown
from corpusloom.runtime import broadcast_if_small, checkpointed, rank_in_groups


def split_load_status(docs: DataFrame, path: str = "path") -> DataFrame:
    """Add status: skipped (marked as a duplicate), repeated_id, empty or good; checked in this order by path.

    A document that is skipped or empty never claims its id. Claims are counted before any shuffle and joined back; null ids
    are one id.
    """
    skipped = F.coalesce(F.trim("duplicate_of"), F.lit("")) != ""
    empty = F.trim(F.coalesce("body", F.lit(""))) == ""
    first = docs.where(~skipped & ~empty).groupBy(F.col("doc_id").alias("__id")).agg(F.min(path).alias("__first"))
    status = F.when(skipped, "skipped").when(F.col("__first") < F.col(path), "repeated_id").when(empty, "empty").otherwise("good")
    return docs.join(first, F.col("doc_id").eqNullSafe(F.col("__id")), "left").select(*docs.columns, status.alias("status"))


def mark_duplicates(docs: DataFrame, hash_col: str = "content_hash", pos: str = "pos", id_col: str = "doc_id") -> DataFrame:
    """Add duplicate_of: the first id with the same content hash, null for the first itself and for null hashes."""
    first = docs.where(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(F.min_by(id_col, pos).alias("__first"), F.min(pos).alias("__pos"), F.count("*").alias("__n")).where("__n > 1")
    joined = docs.join(first, hash_col, "left")
    return joined.withColumn("duplicate_of", F.when(F.col(pos) > F.col("__pos"), F.col("__first"))).drop("__first", "__pos", "__n")


def document_version(docs: DataFrame, base: str = "base_path", hash_col: str = "content_hash", seen: str = "seen_at") -> DataFrame:
    """Add version: the place of a content among the distinct contents of its base path, by first appearance.

    A base path may hold any share of the rows: places come from ranges, not from one task per path.
    """
    first = docs.groupBy(base, hash_col).agg(F.min(seen).alias("__first"))
    numbered = rank_in_groups(first, [base], ["__first", hash_col], "version")
    return docs.join(numbered.select(base, hash_col, "version"), [base, hash_col])


def stale_ids(previous: DataFrame, current: DataFrame, key: str = "chunk_id", build_errors: int = 0) -> DataFrame:
    """Ids of the previous build that the new one lacks; none if the new build had errors."""
    gone = previous.select(key).distinct().join(current.select(key), key, "left_anti")
    return gone if not build_errors else gone.limit(0)


def index_diff(expected: DataFrame, observed: DataFrame, key: str = "id", payload: str = "payload") -> DataFrame:
    """(finding, key): missing, unexpected, duplicate and payload_mismatch of an index against what it should hold."""
    e = expected.groupBy(key).agg(F.max(payload).alias("want"))
    o = observed.groupBy(key).agg(F.max(payload).alias("has"), F.min(payload).alias("least"), F.count("*").alias("times"))
    both = e.join(o, key, "full_outer")
    missing, extra = F.col("times").isNull(), F.col("want").isNull() & F.col("times").isNotNull()
    found = F.array(
        F.when(missing, "missing"),
        F.when(extra, "unexpected"),
        F.when(F.col("times") > 1, "duplicate"),
        F.when(~missing & ~extra & (~F.col("want").eqNullSafe(F.col("has")) | ~F.col("has").eqNullSafe(F.col("least"))), "payload_mismatch"),
    )
    return both.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("finding"), F.col(key).alias("key"))


def diff_summary(diff: DataFrame, samples: int = 10) -> DataFrame:
    """(finding, n, first): the number of each finding and its first keys in order."""
    order = Window.partitionBy("finding").orderBy("key")
    shown = diff.withColumn("r", F.row_number().over(order)).where(F.col("r") <= samples)  # limited before the shuffle too
    first = shown.groupBy("finding").agg(F.array_sort(F.collect_list("key")).alias("first"))
    return diff.groupBy("finding").agg(F.count("*").alias("n")).join(first, "finding")


def index_count_check(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row (index_rows, chunk_rows, equal)."""
    counted = index.agg(F.count("*").alias("index_rows")).crossJoin(chunks.agg(F.count("*").alias("chunk_rows")))
    return counted.withColumn("equal", F.col("index_rows") == F.col("chunk_rows"))


def duplicate_ids(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, n): ids that occur more than once, and null or blank ids however often."""
    named = F.when(F.trim(key) == "", None).otherwise(F.col(key))
    return chunks.groupBy(named.alias("key")).agg(F.count("*").alias("n")).where("n > 1 or key is null")


def manifest_counts(chunks: DataFrame) -> DataFrame:
    """One row: documents, pages, chunks and, by type, text, table, parent and child chunks."""
    kind = lambda k: F.count_if(F.col("chunk_type") == k).alias(f"{k}_chunks")
    return chunks.agg(F.count_distinct("doc_id").alias("documents"), F.count_distinct("doc_id", "page_number").alias("pages"), F.count("*").alias("chunks"), *(kind(k) for k in ("text", "table", "parent", "child")))


def row_fingerprints(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, digest) of every row: its columns by name as JSON, body included."""
    return docs.select(F.col(id_col).alias("id"), F.sha2(F.to_json(F.struct(*sorted(docs.columns))), 256).alias("digest"))


def corpus_fingerprint(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row (documents, fingerprint), equal for equal corpora in any partitioning.

    The four quarters of the rows' digests are added up, each modulo 2^64 (the incremental multiset hash of Clarke et al.,
    2003), so partial sums meet and no task holds the digests. Repeated rows count.
    """
    rows = row_fingerprints(docs, id_col)
    quarter = lambda k: F.conv(F.substring("digest", 16 * k + 1, 16), 16, 10).cast("decimal(38,0)")
    sums = rows.agg(F.count("*").alias("documents"), *(F.coalesce(F.sum(quarter(k)), F.lit(0)).cast("decimal(38,0)").alias(f"s{k}") for k in range(4)))
    hexed = lambda k: F.lower(F.lpad(F.conv((F.col(f"s{k}") % F.lit(Decimal(2**64))).cast("decimal(20,0)").cast("string"), 10, 16), 16, "0"))
    return sums.select("documents", F.concat(*(hexed(k) for k in range(4))).alias("fingerprint"))


def build_fingerprint(config: dict) -> str:
    """SHA-256 of a build's settings as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def stale_reasons(manifest: DataFrame, expected: dict[str, str]) -> DataFrame:
    """One row (reasons): why an index is out of date; empty if it is current. ``manifest`` has 0 or 1 rows.

    Keys: revision, build_fingerprint, corpus_fingerprint.
    """
    one = manifest.agg(F.count("*").alias("n"), *(F.first(k, ignorenulls=True).alias(k) for k in expected))
    why = [F.when(F.col("n") == 0, "manifest_missing")]
    for key, value in expected.items():
        why.append(F.when((F.col("n") > 0) & F.col(key).isNull(), f"{key}_missing").when((F.col("n") > 0) & (F.col(key) != value), f"{key}_changed"))
    return one.select(F.filter(F.array(*why), lambda x: x.isNotNull()).alias("reasons"))


def preflight_status(checks: DataFrame) -> DataFrame:
    """One row (status, failed): blocked, ready_for_rebuild or current, from (check, severity, ok) rows."""
    worst = F.max(F.when(~F.col("ok"), F.when(F.col("severity") == "error", 2).otherwise(1)).otherwise(0))
    agg = checks.agg(worst.alias("w"), F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("check")))).alias("failed"))
    return agg.select(F.when(F.col("w") == 2, "blocked").when(F.col("w") == 1, "ready_for_rebuild").otherwise("current").alias("status"), "failed")


def preflight_report(proposed: DataFrame, stored: DataFrame, manifest: DataFrame, config: dict, golden: DataFrame, evidence: DataFrame, load_errors: DataFrame | None = None, payload: str = "payload") -> DataFrame:
    """(check, severity, n): what stands between the stored index and a rebuild or its use; ``preflight_status`` folds it.

    ``proposed`` and ``stored`` are chunks (chunk_id, payload, and what ``corpus_fingerprint`` reads), ``manifest`` has at most one
    row (chunk_count, corpus_fingerprint, build_fingerprint), ``golden`` the findings of the golden set and ``evidence`` its
    (chunk_id). Errors: load errors, repeated ids in the proposed or stored chunks, a manifest without row or with another count,
    golden findings, golden ids that the proposed chunks lack, stored chunks that differ from what the manifest's own
    corpus should hold. Warnings (a rebuild is due): another corpus or build fingerprint. n is the number of findings, 0 for none.
    """
    count = lambda df: df.agg(F.count("*").alias("n"))
    times = lambda df: count(duplicate_ids(df))
    one = manifest.agg(F.count("*").alias("rows"), *(F.first(c, ignorenulls=True).alias(c) for c in ("chunk_count", "corpus_fingerprint", "build_fingerprint")))
    has = count(stored).select(F.col("n").alias("has"))
    now = corpus_fingerprint(proposed, "chunk_id").select(F.col("fingerprint").alias("now"))
    same = F.col("corpus_fingerprint").eqNullSafe(F.col("now")) & F.col("build_fingerprint").eqNullSafe(build_fingerprint(config))
    told = one.crossJoin(has).crossJoin(now).select(F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.lit(s).alias("severity"), ok.cast("long").alias("n")) for c, s, ok in (
        ("manifest_missing", "error", F.col("rows") == 0),
        ("manifest_count", "error", (F.col("rows") > 0) & ~F.col("chunk_count").eqNullSafe(F.col("has"))),
        ("corpus_changed", "warning", (F.col("rows") > 0) & ~F.col("corpus_fingerprint").eqNullSafe(F.col("now"))),
        ("build_changed", "warning", (F.col("rows") > 0) & ~F.col("build_fingerprint").eqNullSafe(build_fingerprint(config))),
    )))).alias("c")).select("c.*")
    differs = index_diff(proposed.select(F.col("chunk_id").alias("id"), payload), stored.select(F.col("chunk_id").alias("id"), payload), payload=payload)
    # stored chunks of another corpus are due for a rebuild; of the same they must agree
    wrong = count(differs).crossJoin(one.crossJoin(now).select(same.alias("same"))).select(F.when(F.col("same"), F.col("n")).otherwise(0).alias("n"))
    found = [("proposed_repeated_ids", times(proposed)), ("stored_repeated_ids", times(stored)), ("golden_findings", count(golden)), ("golden_ids_missing", count(evidence.select("chunk_id").distinct().join(proposed.select("chunk_id").distinct(), "chunk_id", "left_anti"))), ("stored_differs", wrong)]
    if load_errors is not None:
        found.append(("load_errors", count(load_errors)))
    rows = [df.select(F.lit(name).alias("check"), F.lit("error").alias("severity"), F.col("n").cast("long").alias("n")) for name, df in found]
    return reduce(DataFrame.unionByName, rows, told)


def quality_findings(docs: DataFrame, required: tuple[str, ...] = ("doc_id", "title", "source_url")) -> DataFrame:
    """(rule, key): documents that miss a required value, whose stored hash is not their body's, whose content repeats,
    whose page text is missing, or that lost tables or a tenth of their numbers on the way to Markdown.

    Every rule is a column of one pass; only repeated hashes are grouped.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    rules = [F.when(blank(c), f"missing_{c}") for c in required]
    rules += [
        F.when(F.sha2(F.coalesce("body", F.lit("")), 256) != F.col("content_hash"), "body_hash_mismatch"),
        F.when(blank("raw_file"), "missing_raw"),
        F.when(F.col("raw_sha256") != F.col("response_sha256"), "raw_hash_mismatch"),
        F.when(F.col("extraction_status") == "no_text_detected", "no_text"),
        F.when(F.col("markdown_table_count") < F.col("source_table_count"), "table_loss"),
        F.when(F.col("markdown_numeric_token_count") < 0.9 * F.col("source_numeric_token_count"), "numeric_loss"),
        F.when(~F.col("http_status").between(200, 299), "url_failed"),
        F.when(~blank("supersedes"), "superseded_source"),
    ]
    by_row = docs.select(F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("rule"), F.col("doc_id").alias("key"))
    repeated = docs.where("content_hash is not null").groupBy("content_hash").agg(F.count("*").alias("n")).where("n > 1").select("content_hash")
    return by_row.unionByName(docs.join(repeated, "content_hash", "left_semi").select(F.lit("repeated_content").alias("rule"), F.col("doc_id").alias("key")))


def findings_report(findings: DataFrame) -> DataFrame:
    """(rule, n) with a total row whose rule is null."""
    return findings.rollup("rule").agg(F.count("*").alias("n"))


def write_report(report: DataFrame, path: str, files: int = 1) -> None:
    """A report (findings, metrics by case) as JSON lines in a few files; a report written before is replaced."""
    report.coalesce(files).write.mode("overwrite").json(path)


def tabular_chunks(chunks: DataFrame, needed: str, either: list[str], content: str = "content") -> DataFrame:
    """Chunks whose content has one word and at least one of some others, case-insensitive."""
    has = lambda w: F.contains(F.lower(content), F.lit(w.lower()))
    return chunks.where(has(needed) & reduce(lambda a, w: a | has(w), either, F.lit(False)))


def missing_pages(sources: DataFrame, processed: DataFrame) -> DataFrame:
    """(doc_id, page_number): pages that a source should have and no processed row has."""
    expected = sources.where("n_pages > 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.col("n_pages"))).alias("page_number"))
    return expected.join(processed.select("doc_id", "page_number"), ["doc_id", "page_number"], "left_anti")


def merge_partial_recrawl(old: DataFrame, new: DataFrame, requested: DataFrame) -> DataFrame:
    """Old good sources that were not asked for again, and the new ones; attachments are carried over where the new row has none."""
    kept = old.where("http_status = 200").join(requested.select("source_url"), "source_url", "left_anti")
    before = old.groupBy("source_url").agg(F.max_by("attachments", F.col("attachments").isNotNull()).alias("__before"))
    fresh = new.join(before, "source_url", "left").withColumn("attachments", F.coalesce("attachments", "__before")).select(*old.columns)
    return kept.select(*old.columns).unionByName(fresh)


def split_no_text_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): pages with text, and those whose extraction found none; an unknown status is kept."""
    none = F.coalesce(F.col("extraction_status") == "no_text_detected", F.lit(False))
    return pages.where(~none), pages.where(none)


def pages_of_sources_with_tables(pages: DataFrame, sources: DataFrame, key: str = "source_url") -> DataFrame:
    """The pages of sources whose HTML had tables."""
    return pages.join(sources.where("source_table_count > 0").select(key).distinct(), key, "left_semi")


def term_filter(docs: DataFrame, include: list[str], exclude: list[str], title: str = "title") -> DataFrame:
    """Rows whose title has one of the include terms and none of the exclude terms, case-insensitive."""
    has = lambda terms: reduce(lambda a, t: a | F.contains(F.lower(title), F.lit(t.lower())), terms, F.lit(False))
    return docs.where(has(include) & ~has(exclude))


def is_pdf_link(url: F.Column) -> F.Column:
    return F.coalesce(url.rlike(r"(?i)\.pdf(?:$|[?#])"), F.lit(False))


def evidence_membership(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, status): whether quoted evidence is in its chunk: ok, no_chunk, field_differs or quote_missing.

    Only the chunks that are named are shuffled, with their texts.
    """
    named = checkpointed(evidence.select("chunk_id").distinct())
    c = chunks.join(broadcast_if_small(named, named.count()), "chunk_id", "left_semi").select(F.col("chunk_id").alias("c_id"), *(F.col(n).alias(f"c_{n}") for n in ("doc_id", "title", "page_number", "source_url", "content")))
    j = evidence.join(c, F.col("chunk_id") == F.col("c_id"), "left")
    same = F.col("doc_id").eqNullSafe(F.col("c_doc_id")) & F.col("title").eqNullSafe(F.col("c_title")) & F.col("page").eqNullSafe(F.col("c_page_number")) & F.col("source_url").eqNullSafe(F.col("c_source_url"))
    inside = F.contains(normalized_markdown(F.col("c_content")), normalized_markdown(F.col("quote")))
    return j.select("chunk_id", F.when(F.col("c_id").isNull(), "no_chunk").when(~same, "field_differs").when(~F.coalesce(inside, F.lit(False)), "quote_missing").otherwise("ok").alias("status"))
