"""Rank fusion of search branches, and the joins that widen hits: parents, neighbours, table parts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.sparse import top_k


def unique_rank(hits: DataFrame) -> DataFrame:
    """(query_id, branch, chunk_id, rank): rank within a branch by position; a repeated chunk keeps its first place only."""
    first = hits.groupBy("query_id", "branch", "chunk_id").agg(F.min("pos").alias("pos"))
    return first.select("query_id", "branch", "chunk_id", F.row_number().over(Window.partitionBy("query_id", "branch").orderBy("pos")).alias("rank"))


def rrf_fuse(hits: DataFrame, k: float = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): sums of weight / (k + rank), best first, ties by chunk_id.

    Branches not in ``weights`` weigh 1; a branch of weight 0 still brings its chunks, at score 0.
    """
    values = list((weights or {}).values())
    if not (math.isfinite(k) and k >= 0) or any(not math.isfinite(w) or w < 0 for w in values):
        raise ValueError("k and weights are finite and not negative")
    weight = F.lit(1.0)
    for branch, w in (weights or {}).items():
        weight = F.when(F.col("branch") == branch, float(w)).otherwise(weight)
    fused = unique_rank(hits).groupBy("query_id", "chunk_id").agg(F.round(F.sum(weight / (k + F.col("rank"))), 9).alias("score"))
    return top_k(fused, 2**31 - 1, "chunk_id")


def branch_union(hits: DataFrame, order: list[str]) -> DataFrame:
    """One row a chunk with the payload of the first branch, in the given order, that has it."""
    others = [c for c in hits.columns if c not in ("query_id", "chunk_id")]
    place = F.array_position(F.array(*(F.lit(b) for b in order)), F.col("branch"))
    best = hits.groupBy("query_id", "chunk_id").agg(F.min_by(F.struct(*others), place).alias("v"))
    return best.select("query_id", "chunk_id", *(F.col("v")[c].alias(c) for c in others))


def candidate_limit(top_k_col: str, wide_col: str, factor: int = 3, most: int = 360) -> F.Column:
    """How many candidates each branch brings: top_k times the factor, twice that for list questions, up to a cap."""
    wanted = F.col(top_k_col) * factor * F.when(F.col(wide_col), 2).otherwise(1)
    return F.least(F.lit(most), wanted)


def hybrid_candidates(hits: DataFrame, queries: DataFrame, k: float = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """Fuse each branch's best candidates; the union is not cut after fusion. ``queries`` has query_id, top_k, wide."""
    limits = queries.select("query_id", candidate_limit("top_k", "wide").alias("candidates"))
    near = hits.join(F.broadcast(limits), "query_id").where(F.col("pos") <= F.col("candidates"))
    return rrf_fuse(near, k, weights)


def hydrate_parents(hits: DataFrame, parents: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Replace a text child by its parent where there is one that is no table; a chunk keeps its best position.

    ``allowed`` has the (chunk_id, parent_chunk_id) pairs of each query_id that the scope guard passes; without it all pass.
    """
    up = parents.where("chunk_type <> 'table'").select(F.col("chunk_id").alias("p_id"))
    joined = hits.join(up, hits["parent_chunk_id"] == up["p_id"], "left")
    if allowed is not None:
        pairs = allowed.select("query_id", "chunk_id", "parent_chunk_id").distinct().withColumn("passes", F.lit(True))
        joined = joined.join(pairs, ["query_id", "chunk_id", "parent_chunk_id"], "left").withColumn("p_id", F.when(F.col("passes"), F.col("p_id")))
    chunk = F.when(F.col("chunk_type") == "table", F.col("chunk_id")).otherwise(F.coalesce("p_id", "chunk_id"))
    return joined.groupBy("query_id", chunk.alias("chunk_id")).agg(F.min("pos").alias("pos"), F.max("score").alias("score"))


def neighbor_join(hits: DataFrame, chunks: DataFrame, budget: int = 2) -> DataFrame:
    """(query_id, seed_id, chunk_id, step, place): chunks beside a hit in its document, nearest first, the one before it first.

    Neighbours have the hit's heading path and kind. Where one index occurs twice in a document, the last in the corpus counts.
    """
    steps = [s for d in range(1, budget + 1) for s in (-d, d)]
    own = chunks.groupBy("doc_id", "chunk_index").agg(F.max_by(F.struct("chunk_id", "heading_path", "chunk_type"), "corpus_pos").alias("n"))
    seeds = hits.join(chunks.select("chunk_id", "doc_id", "chunk_index", "heading_path", "chunk_type"), "chunk_id")
    wanted = seeds.select("query_id", F.col("chunk_id").alias("seed_id"), "doc_id", "chunk_index", "heading_path", "chunk_type", F.posexplode(F.array(*(F.lit(s) for s in steps))).alias("place", "step"))
    wanted = wanted.withColumn("chunk_index", F.col("chunk_index") + F.col("step"))
    near = wanted.join(own, ["doc_id", "chunk_index"])
    parent = lambda c: c == "parent"
    ok = F.col("heading_path").eqNullSafe(F.col("n.heading_path")) & (parent(F.col("chunk_type")) == parent(F.col("n.chunk_type")))
    return near.where(ok).select("query_id", "seed_id", F.col("n.chunk_id").alias("chunk_id"), "step", "place")


def table_sibling_join(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, seed_id, chunk_id, table_part): all parts of a hit's table, in order."""
    parts = chunks.where("table_index is not null").select("doc_id", "table_index", "table_part", F.col("chunk_id").alias("sibling"))
    seeds = hits.select("query_id", "chunk_id").join(chunks.select("chunk_id", "doc_id", "table_index"), "chunk_id")
    return seeds.join(parts, ["doc_id", "table_index"]).select("query_id", F.col("chunk_id").alias("seed_id"), F.col("sibling").alias("chunk_id"), "table_part")


def diversity_rounds(hits: DataFrame) -> DataFrame:
    """Reorder each query's hits: first the first hit of each group (parent, else document and headings, else chunk), then the rest."""
    group = F.coalesce(F.col("parent_chunk_id"), F.when(F.col("doc_id").isNotNull(), F.concat_ws("\x1f", F.col("doc_id").cast("string"), F.array_join("heading_path", "\x1f"))), F.col("chunk_id").cast("string"))
    first = F.row_number().over(Window.partitionBy("query_id", group).orderBy("pos"))
    ordered = hits.withColumn("__later", (first > 1).cast("int"))
    return ordered.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("__later", "pos"))).drop("__later")


def expand_guarded(hits: DataFrame, siblings: DataFrame, neighbours: DataFrame, allowed: DataFrame, limit_col: str = "limit") -> DataFrame:
    """Seeds first, then allowed table parts (score less 1e-6), then allowed neighbours (score less 1e-5), up to the limit.

    ``allowed`` has the (query_id, seed_id, chunk_id) pairs that the scope guard passes; a chunk comes once, at its first
    place.
    """
    def more(df: DataFrame, kind: str, less: float, place: str) -> DataFrame:
        ok = df.join(allowed, ["query_id", "seed_id", "chunk_id"], "left_semi")
        seed = hits.select("query_id", F.col("chunk_id").alias("seed_id"), "pos", "score", limit_col)
        return ok.join(seed, ["query_id", "seed_id"]).select("query_id", "chunk_id", "pos", (F.col("score") - less).alias("score"), F.lit(kind).alias("expansion_type"), F.col(place).alias("place"), limit_col)

    own = hits.select("query_id", "chunk_id", "pos", "score", F.lit("exact").alias("expansion_type"), F.lit(0).alias("place"), limit_col)
    every = own.unionByName(more(siblings, "table_sibling", 1e-6, "table_part")).unionByName(more(neighbours, "neighbor", 1e-5, "place"))
    order = [F.col("expansion_type") != "exact", F.col("pos"), F.col("expansion_type") != "table_sibling", F.col("place"), F.col("chunk_id")]
    first = every.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy(*order))).where("__n = 1").drop("__n")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= F.col(limit_col)).select("query_id", "chunk_id", "score", "expansion_type", "rank")
