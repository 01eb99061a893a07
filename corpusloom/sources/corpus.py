"""Corpus files and index snapshots: Markdown with frontmatter, raw metadata, and Parquet snapshots with a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import joined_digest
from corpusloom.operators.quality import build_fingerprint, corpus_fingerprint
from corpusloom.runtime import checkpointed

SCHEMA_VERSION = "1"


class SnapshotError(ValueError):
    """A snapshot that doesn't agree with its manifest."""


def parsed_frontmatter(files: DataFrame) -> DataFrame:
    """(path, doc_id, content_hash, body, fields) from (path, raw) rows: Markdown with a leading --- block.

    ``fields`` holds the block's keys as strings (JSON quotes removed). A missing doc_id is the first 24 hex digits of the
    path's SHA-256; a missing content_hash is the body's SHA-256.
    """
    raw = F.replace(F.col("raw"), F.lit("\r\n"), F.lit("\n"))
    block = F.regexp_extract(raw, r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)", 1)
    body = F.regexp_replace(F.regexp_replace(raw, r"(?s)\A---[ \t]*\n.*?\n---[ \t]*(?:\n|\z)", ""), r"\A\s+|\s+\z", "")
    lines = F.filter(F.split(block, "\n"), lambda s: s.rlike(r"^\s*[^:#\s][^:]*:"))
    bare = lambda v: F.regexp_replace(F.trim(v), r'^"(.*)"$', "$1")
    entries = F.transform(lines, lambda s: F.struct(F.trim(F.regexp_extract(s, r"^([^:]+):", 1)), bare(F.regexp_extract(s, r"^[^:]+:(.*)$", 1))))
    fields = F.map_from_entries(F.filter(entries, lambda e: e["col1"] != ""))
    some = lambda c: F.when(c != "", c)
    rows = files.select("path", body.alias("body"), fields.alias("fields"))
    return rows.select(
        "path",
        F.coalesce(some(F.col("fields")["doc_id"]), F.substring(F.sha2("path", 256), 1, 24)).alias("doc_id"),
        F.coalesce(some(F.col("fields")["content_hash"]), F.sha2("body", 256)).alias("content_hash"),
        F.col("fields")["duplicate_of"].alias("duplicate_of"),
        "body",
        "fields",
    )


def read_markdown_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Every *.md file below a path, one row each."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    return parsed_frontmatter(files)


def markdown_document(ordered: tuple[str, ...] = ("doc_id", "title", "source_url")) -> F.Column:
    """A document as Markdown: ordered frontmatter keys, the rest sorted, then the body."""
    rest = F.array_sort(F.array_except(F.map_keys("fields"), F.array(*(F.lit(k) for k in ordered))))
    keys = F.concat(F.filter(F.array(*(F.lit(k) for k in ordered)), lambda k: F.map_contains_key("fields", k)), rest)
    lines = F.transform(keys, lambda k: F.concat(k, F.lit(": "), F.to_json(F.array(F.element_at("fields", k))).substr(F.lit(2), F.length(F.to_json(F.array(F.element_at("fields", k)))) - 2)))
    return F.concat_ws("\n", F.lit("---"), F.array_join(lines, "\n"), F.lit("---"), F.lit(""), F.col("body"))


#: What stands between two documents of a bundle.
RECORD_END = "\n\x1e\n"


def write_markdown_corpus(docs: DataFrame, path: str) -> None:
    """Documents as Markdown bundles (many documents a file, RECORD_END between them), partitioned by category."""
    docs.select("category", markdown_document().alias("value")).write.partitionBy("category").text(path, lineSep=RECORD_END)


def read_markdown_bundles(spark: SparkSession, path: str) -> DataFrame:
    """The documents that write_markdown_corpus wrote, as read_markdown_corpus gives them, and their category.

    A document's path is its file's with a digest of the document, for a file holds many.
    """
    rows = spark.read.text(path, lineSep=RECORD_END).where("trim(value) <> ''")
    files = rows.select(F.concat_ws("#", "_metadata.file_path", F.sha2("value", 256)).alias("path"), F.col("value").alias("raw"), "category")
    return parsed_frontmatter(files.select("path", "raw")).join(files.select("path", "category").distinct(), "path")


def preferred_folder(spark: SparkSession, processed: str, raw: str) -> str:
    """The folder of processed files if it has a Markdown file, else that of raw ones."""
    files = spark.read.format("binaryFile").options(pathGlobFilter="*.md", recursiveFileLookup=True)
    try:
        found = bool(files.load(processed).select("path").limit(1).count())
    except Exception as e:  # noqa: BLE001 - Spark has one class for analysis errors of every kind
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = False
    return processed if found else raw


def write_stage(df: DataFrame, path: str, fingerprint: str) -> DataFrame:
    """Write a stage (such as vectors) for a fingerprint, and read it back; reusable_stage finds it after an interruption."""
    df.write.mode("overwrite").parquet(f"{path}/{fingerprint}")
    return df.sparkSession.read.parquet(f"{path}/{fingerprint}")


def attach_raw_metadata(files: DataFrame, records: DataFrame) -> DataFrame:
    """Join (raw_file, pos, meta) records to files by normalised path, else by base name; of several with one name the last counts."""
    norm = lambda c: F.lower(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"^(?:\./)+|/+$", ""))
    base = lambda c: F.regexp_extract(norm(c), r"([^/]+)$", 1)
    by = lambda key, name: records.groupBy(key.alias(f"__{name}")).agg(F.max_by("meta", "pos").alias(f"__{name}_meta"))
    keyed = files.withColumns({"__p": norm(F.col("path")), "__b": base(F.col("path"))})
    joined = keyed.join(by(norm(F.col("raw_file")), "path"), F.col("__p") == F.col("__path"), "left").join(by(base(F.col("raw_file")), "base"), F.col("__b") == F.col("__base"), "left")
    return joined.withColumn("meta", F.coalesce("__path_meta", "__base_meta")).select(*files.columns, "meta")


def flattened_records(raw: DataFrame, column: str = "json") -> DataFrame:
    """(raw_file, pos, meta) of every object in a JSON value, at any depth, that has a raw_file.

    ``pos`` is the path of positions to the object: arrays compare in the order in which the text has the objects. One
    round a level of nesting; only the number of values left reaches the driver.
    """
    # A table's values stand in the order of their rows' texts, so that reruns agree.
    level = raw.select(F.col(column).alias("value"), F.array(F.xxhash64(column)).alias("pos"))
    found = None
    while True:
        level = checkpointed(level)
        if not level.limit(1).count():
            return found
        is_object, is_list = F.ltrim("value").startswith("{"), F.ltrim("value").startswith("[")
        objects = level.where(is_object)
        own = objects.select(F.get_json_object("value", "$.raw_file").alias("raw_file"), "pos", F.col("value").alias("meta")).where("raw_file is not null and raw_file <> ''")
        found = own if found is None else found.unionByName(own)
        of_objects = objects.select("pos", F.posexplode(F.map_values(F.from_json("value", "map<string,string>"))).alias("k", "value"))
        of_lists = level.where(is_list).select("pos", F.posexplode(F.from_json("value", "array<string>")).alias("k", "value"))
        below = of_objects.unionByName(of_lists).where(F.ltrim("value").rlike(r"^[\[{]"))
        level = below.select("value", F.concat("pos", F.array(F.col("k").cast("long"))).alias("pos"))


def write_index_snapshot(chunks: DataFrame, path: str, config: dict) -> None:
    """Chunks with their vectors in one table (rows can't lose their vectors), and a one-row manifest beside it."""
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    stored = chunks.sparkSession.read.parquet(f"{path}/chunks")
    manifest = corpus_fingerprint(stored, "chunk_id").select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(build_fingerprint(config)).alias("build_fingerprint"), F.col("documents").alias("rows"), F.col("fingerprint").alias("corpus_fingerprint")
    )
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_index_snapshot(spark: SparkSession, path: str, config: dict) -> DataFrame:
    """The chunks, after their number and digest, the schema version and the settings have been checked against the manifest."""
    chunks = spark.read.parquet(f"{path}/chunks")
    said = spark.read.json(f"{path}/manifest").first()
    have = corpus_fingerprint(chunks, "chunk_id").first()
    if said.schema_version != SCHEMA_VERSION or said.build_fingerprint != build_fingerprint(config):
        raise SnapshotError("another schema version or other settings")
    if (said.rows, said.corpus_fingerprint) != (have.documents, have.fingerprint):
        raise SnapshotError("the chunks are not those of the manifest")
    return chunks


def reusable_stage(spark: SparkSession, path: str, fingerprint: str) -> DataFrame | None:
    """A staged table written for the same fingerprint, or None."""
    try:
        return spark.read.parquet(f"{path}/{fingerprint}")
    except Exception as e:  # noqa: BLE001 - Spark has one class for analysis errors of every kind
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def section_documents(docs: DataFrame, pattern: str, name: str) -> DataFrame:
    """One section (first group of the pattern) of each document as a document of its own, with the parent's id."""
    cut = F.regexp_extract("body", pattern, 1)
    return docs.where(F.length(F.trim(cut)) > 0).select(joined_digest(F.col("doc_id"), F.lit(name)).alias("doc_id"), F.col("doc_id").alias("parent_doc_id"), F.lit(name).alias("section"), F.trim(cut).alias("body"))
