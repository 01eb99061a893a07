"""A bounded, repeatable sample of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: tuple[int, int], rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label) of at most ``rows`` labelled rows that are not held out, chosen by a hash of their id.

    ``held_out`` is (modulus, remainder) of crc32 of the id. Rows with a null label or id are left out; an id labelled
    twice counts with its larger label. The chosen ids are at most ``rows``, so they are broadcast.
    """
    modulus, kept_back = held_out
    chosen = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).where(remainder(id_col, modulus) != kept_back)
    chosen = chosen.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label).cast("int")).alias("label")).orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "id")
