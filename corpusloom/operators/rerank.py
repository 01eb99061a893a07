"""Reranking of candidates, gates on evidence, and guards on rewritten queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.scope import factor_product
from corpusloom.functions.text import codes, content_tokens, facts, fold, joined_words, normalized_space, protected_terms, tokens


def search_text() -> Column:
    """title, section if it differs, heading path if not yet part (else heading), content: one a line, blanks left out."""
    some = lambda c: F.when(F.trim(c) != "", c)
    title, section = F.col("title"), F.col("section")
    path = F.array_join("heading_path", " > ")
    heading = F.coalesce(some(path), some(F.col("heading")))
    shown = F.when(~F.coalesce(heading.eqNullSafe(title) | heading.eqNullSafe(section), F.lit(False)), heading)
    return F.concat_ws("\n", some(title), some(F.when(~section.eqNullSafe(title), section)), shown, some(F.col("content")))


def lexical_overlap(query_tokens: Column, text_tokens: Column) -> Column:
    """Share of the query's tokens found, plus a quarter of the share of the text's tokens that are the query's."""
    both = F.size(F.array_intersect(query_tokens, text_tokens))
    return F.when((F.size(query_tokens) > 0) & (F.size(text_tokens) > 0), both / F.size(query_tokens) + 0.25 * both / F.size(text_tokens)).otherwise(0.0)


def domain_rerank(assessed: DataFrame, k: int) -> DataFrame:
    """Best k by retrieval score times the bounded product of (1 + 2 * overlap) and the scope factors.

    Rows that the scope excludes are dropped. Order: domain score, retrieval score, chunk_id. Columns needed: query,
    content, score, factors, eligible.
    """
    overlap = lexical_overlap(content_tokens(F.col("query")), content_tokens(F.col("content")))
    product = F.least(F.lit(4.0), F.greatest(F.lit(0.25), (1 + 2 * overlap) * factor_product(F.col("factors"), 0.0, float("inf"))))
    scored = assessed.where("eligible").withColumn("domain_score", F.round(F.col("score") * product, 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("domain_score"), F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def lexical_rerank(pairs: DataFrame, k: int) -> DataFrame:
    """Best k by lexical overlap of query and content alone; ties by chunk_id."""
    scored = pairs.withColumn("overlap", F.round(lexical_overlap(content_tokens(F.col("query")), content_tokens(F.col("content"))), 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("overlap"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def model_rerank(pairs: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], k: int) -> DataFrame:
    """Best k by a supplied scorer of (queries, texts), run in Arrow batches; one finite score a row or an error.

    Order: model score, retrieval score, chunk_id. Columns needed: query_id, query, chunk_id, content, score.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [float(x) for x in scorer(batch.column(1).to_pylist(), batch.column(3).to_pylist())]
            if len(scores) != batch.num_rows or any(x != x or abs(x) == float("inf") for x in scores):
                raise ValueError("the scorer gives one finite score a row")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(4), pa.array(scores)], names=["query_id", "chunk_id", "score", "model_score"])

    kinds = dict(pairs.dtypes)
    schema = f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double, model_score double"
    scored = pairs.select("query_id", "query", "chunk_id", "content", F.col("score").cast("double")).mapInArrow(run, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("model_score"), F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def check_rerank_output(candidates: DataFrame, reranked: DataFrame) -> DataFrame:
    """(query_id, fault): rows that are no candidates (with multiplicity), and scores out of order."""
    keys = ["query_id", "chunk_id", "score"]
    foreign = reranked.select(*keys).exceptAll(candidates.select(*keys)).select("query_id", F.lit("not_a_candidate").alias("fault"))
    before = F.lag("model_score").over(Window.partitionBy("query_id").orderBy("rank"))
    unordered = reranked.withColumn("b", before).where("b < model_score").select("query_id", F.lit("out_of_order").alias("fault"))
    return foreign.union(unordered).distinct()


def lexical_evidence_gate(queries: DataFrame, hits: DataFrame, coverage: float = 0.34, query_col: str = "query", text_cols: tuple[str, ...] = ("content",), stopwords: tuple[str, ...] = (), demand_codes: bool = True) -> DataFrame:
    """(query_id, wanted, found, passes): whether enough of a query's tokens occur in its hits taken together.

    Enough is max(1, ceil(tokens * coverage)) of the tokens of two characters or more that are neither numbers nor stop
    words; a query without any does not pass. With ``demand_codes`` every code that the query names must stand in a hit.
    ``text_cols`` are searched together (title, section, content, say).
    """
    own = lambda c: content_tokens(c, stopwords, digits=False)
    asked = queries.select("query_id", own(F.col(query_col)).alias("q"), (codes(F.col(query_col)) if demand_codes else F.array().cast("array<string>")).alias("codes"))
    need = asked.select("query_id", F.size("q").alias("wanted"), F.explode_outer(F.concat(F.transform("q", lambda t: F.struct(t.alias("term"), F.lit(False).alias("code"))), F.transform("codes", lambda t: F.struct(t.alias("term"), F.lit(True).alias("code"))))).alias("n"))
    text = F.concat_ws("\n", *text_cols)
    seen = hits.select("query_id", F.explode(F.array_union(own(text), codes(text))).alias("term")).distinct().withColumn("hit", F.lit(True))
    met = need.select("query_id", "wanted", "n.term", "n.code").join(seen, ["query_id", "term"], "left")
    counted = met.groupBy("query_id", "wanted").agg(F.count_if(F.col("hit") & ~F.col("code")).alias("found"), F.count_if(F.col("code") & F.col("hit").isNull()).alias("codes_missing"))
    enough = (F.col("wanted") > 0) & (F.col("found") >= F.greatest(F.lit(1), F.ceil(F.col("wanted") * coverage))) & (F.col("codes_missing") == 0)
    return counted.select("query_id", "wanted", "found", enough.alias("passes"))


def named_entity_gate(queries: DataFrame, hits: DataFrame, name_pattern: str, query_col: str = "query", text_col: str = "content") -> DataFrame:
    """(query_id, name, passes): a query that asks for a name (first group of the pattern on folded text) needs it, whole, in a hit."""
    name = F.trim(F.regexp_replace(F.regexp_extract(fold(F.col(query_col)), name_pattern, 1), r"\s+", " "))
    asked = queries.select("query_id", F.when(name != "", name).alias("name"))
    words = lambda c: F.concat(F.lit(" "), F.array_join(tokens(fold(c)), " "), F.lit(" "))
    shown = hits.select("query_id", words(F.col(text_col)).alias("t"))
    found = asked.where("name is not null").join(shown, "query_id").where(F.contains("t", words(F.col("name")))).select("query_id").distinct().withColumn("found", F.lit(True))
    return asked.join(found, "query_id", "left").select("query_id", "name", (F.col("name").isNull() | F.coalesce("found", F.lit(False))).alias("passes"))


def asks_live_state(query: Column, now: str, stock: str) -> Column:
    """Whether a question asks for the present state of a stock, which an index can't know (two patterns on folded text)."""
    folded = F.coalesce(fold(query), F.lit(""))
    return folded.rlike(now) & folded.rlike(stock)


def safe_query_variants(pairs: DataFrame, stopwords: tuple[str, ...] = (), most: int = 3, intents: tuple[tuple[str, ...], ...] = ()) -> DataFrame:
    """(query_id, place, variant): the original, then candidates of the same scope.

    Same scope: equal facts; the intents (groups of phrases, found as whole words) of an original that has some; and at
    least max(1, ceil(0.6 * n)) of its n topic words, which are all words but stop words. An original without topic words
    has no safe candidate. Variants equal after normalising count once; at most ``most`` stay.
    """
    stop = F.array(*(F.lit(s) for s in stopwords)).cast("array<string>")
    topic = lambda c: F.array_except(F.array_distinct(tokens(F.col(c))), stop)
    padded = lambda c: F.concat(F.lit(" "), F.array_join(tokens(c), " "), F.lit(" "))
    said = lambda c: F.array(*(reduce(Column.__or__, (F.contains(padded(F.col(c)), padded(F.lit(p))) for p in group)) for group in intents)).cast("array<boolean>")
    need = F.greatest(F.lit(1), F.ceil(0.6 * F.size(topic("original"))))
    kept = F.size(F.array_intersect(topic("original"), topic("candidate"))) >= need
    same_intents = ~F.array_contains(said("original"), True) | (said("original") == said("candidate"))
    good = pairs.where((facts(F.col("candidate")) == facts(F.col("original"))) & kept & same_intents)
    every = pairs.select("query_id", F.lit(-1).alias("pos"), F.col("original").alias("variant")).unionByName(good.select("query_id", F.col("candidate_pos").alias("pos"), F.col("candidate").alias("variant")))
    first = every.groupBy("query_id", normalized_space(F.col("variant")).alias("norm")).agg(F.min(F.struct("pos", "variant")).alias("v"))
    ranked = first.select("query_id", F.col("v.variant").alias("variant"), F.row_number().over(Window.partitionBy("query_id").orderBy("v.pos", "norm")).alias("place"))
    return ranked.where(F.col("place") <= most).select("query_id", "place", "variant")


def accepted_rewrite(pairs: DataFrame, abbreviations: tuple[str, ...] = ()) -> DataFrame:
    """Add ``accepted``: the rewrite if it isn't blank, keeps every word and protected term of the original and brings no new protected
    term, else the original."""
    old, new = F.col("original"), F.col("candidate")
    lost = lambda a, b: F.size(F.array_except(a, b))
    keeps = (lost(joined_words(old), joined_words(new)) == 0) & (lost(protected_terms(old, abbreviations), joined_words(new)) == 0) & (lost(protected_terms(new, abbreviations), protected_terms(old, abbreviations)) == 0)
    return pairs.withColumn("accepted", F.when(F.coalesce(keeps & (F.trim(new) != ""), F.lit(False)), new).otherwise(old))
