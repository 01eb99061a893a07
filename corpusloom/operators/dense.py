"""Exact vector search for a table of queries, and the vector table's upkeep."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import valid_vector
from corpusloom.operators.sparse import top_k

#: Queries and vectors in one block: bounds the scores that a task holds at once.
QUERIES_AT_ONCE, VECTORS_AT_ONCE = 4096, 1024
#: Queries of at most so many bytes are broadcast.
BROADCAST_BYTES = 64 << 20


def metadata_filter(df: DataFrame, spec: dict | None) -> DataFrame:
    """Rows that fulfil every entry: a value (equal), a list (one of), or a range with gt, gte, lt, lte.

    None keeps all rows; an empty list, an empty range or an unknown range key is an error.
    """
    compare = {"gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__}
    for name, wanted in (spec or {}).items():
        if isinstance(wanted, dict):
            if not wanted or set(wanted) - set(compare):
                raise ValueError(f"{name}: a range has gt, gte, lt or lte")
            for key, value in wanted.items():
                df = df.where(compare[key](F.col(name), value))
        elif isinstance(wanted, (list, tuple, set)):
            if not wanted:
                raise ValueError(f"{name}: the list of values is empty")
            df = df.where(F.col(name).isin(*wanted))
        else:
            df = df.where(F.col(name) == wanted)
    return df


def _packed(df: DataFrame, id_col: str, rows_at_once: int) -> DataFrame:
    """(block, ids, width, unit): runs of rows of one partition as one row; zero and non-finite vectors become zeros, others
    unit length. Vectors of different lengths in a run are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                own = batch.slice(at, rows_at_once)
                rows = np.array(own.column(1).to_pylist(), dtype=np.float64)
                length = np.linalg.norm(rows, axis=1)
                usable = np.isfinite(length) & (length > 0)
                unit = np.where(usable[:, None], rows / np.where(usable, length, 1)[:, None], 0)
                ids = pa.array([own.column(0).to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + n], pa.int64()), ids, pa.array([rows.shape[1]], pa.int32()), pa.array([unit.tobytes()], pa.binary())], names=["block", "ids", "width", "unit"])
                n += 1

    return df.select(id_col, "embedding").mapInArrow(run, "block long, ids array<long>, width int, unit binary")


def _best_of_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """The best k of a task's vectors for each query that it meets: partial results that the caller ranks.

    A task holds k places for each of its queries beside one pair of blocks; only these leave it.
    """

    def best(found: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((found, -scores), axis=1)[:, :k]
        return np.take_along_axis(found, order, 1), np.take_along_axis(scores, order, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block, ids, width, unit, q_ids, q_width, q_unit in zip(*batch.columns, strict=True):
                if width.as_py() != q_width.as_py():
                    raise ValueError("queries and vectors have different lengths")
                own = np.array(q_ids.as_py(), np.int64)
                x, y = (np.frombuffer(u.as_buffer(), np.float64).reshape(len(i), width.as_py()) for u, i in ((q_unit, q_ids), (unit, ids)))
                scores = np.round(x @ y.T, 6) + 0.0
                found, scores = best(np.broadcast_to(np.array(ids.as_py(), np.int64), scores.shape), scores)
                _, old, old_scores = kept.get(block.as_py(), (own, np.empty((len(own), 0), np.int64), np.empty((len(own), 0))))
                kept[block.as_py()] = (own, *best(np.hstack([old, found]), np.hstack([old_scores, scores])))
        for own, found, scores in kept.values():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, found.shape[1])), pa.array(found.reshape(-1)), pa.array(scores.reshape(-1))], names=["query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, "query_id long, vec_id long, score double")


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = 10, strict: bool = False, dim: int | None = None, spec: dict | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank) by cosine rounded to six digits; ties in the order of vec_id.

    Zero or non-finite vectors and queries score 0, vectors are an error if ``strict``. Vectors or queries of another length than
    ``dim`` are an error. Blocks of queries meet blocks of vectors in the tasks; neither comes to the driver, each task keeps its
    own best k a query, and only these are shuffled. Blocks of queries are broadcast while they are small by their number and
    length, else the pairs of blocks are dealt out.
    """
    if k <= 0:
        return vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    vectors = metadata_filter(vectors, spec)
    checked = F.raise_error(F.lit("a vector of the wrong length, or not finite, or zero"))
    if strict:
        vectors = vectors.withColumn("embedding", F.when(valid_vector(F.col("embedding"), dim), F.col("embedding")).otherwise(checked))
    elif dim:
        vectors = vectors.withColumn("embedding", F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(checked))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding").where(F.col("embedding").isNotNull())
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    blocks = _packed(asked.repartition(max(1, -(-size.n // QUERIES_AT_ONCE))), "query_id", QUERIES_AT_ONCE)
    blocks = blocks.select("block", F.col("ids").alias("q_ids"), F.col("width").alias("q_width"), F.col("unit").alias("q_unit"))
    small = 8 * size.n * (size.width or 0) <= BROADCAST_BYTES
    blocks = F.broadcast(blocks) if small else blocks.hint("shuffle_replicate_nl")
    packed = _packed(vectors.where(F.col("embedding").isNotNull()), "vec_id", VECTORS_AT_ONCE).drop("block")
    pairs = packed.crossJoin(blocks).select("block", "ids", "width", "unit", "q_ids", "q_width", "q_unit")
    return top_k(_best_of_pairs(pairs, k), k, "vec_id")


def first_valid_vector(hypothetical: str, own: str, dim: int | None = None) -> Column:
    """The hypothetical document's vector if valid, else the query's; an error if neither is."""
    error = F.raise_error(F.lit("neither vector is valid"))
    return F.when(valid_vector(F.col(hypothetical), dim), F.col(hypothetical)).when(valid_vector(F.col(own), dim), F.col(own)).otherwise(error)


def upsert(current: DataFrame, changes: DataFrame, key: str = "chunk_id", pos: str = "pos") -> DataFrame:
    """Last write wins, first position kept. ``pos`` orders the writes within each table; changes follow the current rows."""
    both = current.withColumn("__late", F.lit(0)).unionByName(changes.withColumn("__late", F.lit(1)))
    others = [c for c in current.columns if c not in (key, pos)]
    newest = F.max_by(F.struct(*others), F.struct("__late", pos)).alias("v")
    return both.groupBy(key).agg(F.min(F.struct("__late", pos)).alias("p"), newest).select(key, F.col("p")[pos].alias(pos), *(F.col("v")[c].alias(c) for c in others)).select(*current.columns)


def delete_by_ids(current: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    return current.join(ids.select(key).distinct(), key, "left_anti")


def delete_by_source(current: DataFrame, source_file: str) -> DataFrame:
    """Rows of other source files; rows without one stay."""
    return current.where(~F.col("source_file").eqNullSafe(source_file))


def last_write_wins(rows: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """Each key's last row at its first position."""
    others = [c for c in rows.columns if c not in (key, pos)]
    return rows.groupBy(key).agg(F.min(pos).alias(pos), F.max_by(F.struct(*others), pos).alias("v")).select(key, pos, *(F.col("v")[c].alias(c) for c in others)).select(*rows.columns)


def validated_batch(chunks: DataFrame) -> DataFrame:
    """Add ``reject``: blank_id, blank_content, repeated_id, or null for a good row.

    Repeated ids are counted before any shuffle and joined back, so blank and null ids never meet in one task.
    """
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    again = chunks.where(~blank("chunk_id")).groupBy(F.col("chunk_id").alias("__id")).agg(F.count("*").alias("__times")).where("__times > 1")
    rule = F.when(blank("chunk_id"), "blank_id").when(blank("content"), "blank_content").when(F.col("__times").isNotNull(), "repeated_id")
    return chunks.join(again, F.col("chunk_id") == F.col("__id"), "left").select(*chunks.columns, rule.alias("reject"))
