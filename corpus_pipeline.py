"""Training-corpus pipeline over the documents table: drop poor, toxic and near-duplicate documents, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import mixing, ngram_join, piece_codec, quality_cnn, queries, toxicity
from corpusloom.runtime import read_table, shared_folder


#: Segments that a tokenizing worker remembers: workers go on to other stages, and what they hold stays beside those.
REMEMBERED = 150_000


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality_cnn.keep_good(docs, queries.quality_model(spark, sf_dir), queries.QUALITY_FROM)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject."""
    return toxicity.keep_clean(docs, queries.toxicity_model(spark, sf_dir), queries.TOXIC_FROM)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return ngram_join.keep_one_per_group(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix to the target weights takes them."""
    scored = quality_cnn.score(docs, queries.quality_model(spark, sf_dir), output="quality", keep=("doc_id", "text", "source"))
    return mixing.mixed_rows(docs, scored=scored, quality_col="quality")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's number of ids and the digests of ids and decoded text."""
    outputs = ("n_tokens", "ids_sha256", "decoded_sha256")
    return piece_codec.encode_and_decode(docs, queries.tokenizer_path("piece_bpe_32k.model"), keep=("doc_id", "lang", "source"), outputs=outputs, remembered=REMEMBERED)


STAGES = [("quality", good), ("toxicity", clean), ("near_duplicates", distinct), ("mixing", mixed), ("encoding", encoded)]

#: Trained models, the similarity join and the tokenizer can't be expressed in SQL; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    top = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{i}_{name}")
        docs = spark.read.parquet(f"{top}/{i}_{name}")
    return docs
