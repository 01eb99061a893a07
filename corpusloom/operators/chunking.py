"""Fixed windows, headings of set pages, and page tables, in column expressions; ``structure`` chunks by headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import joined_digest


def chunk_fixed(docs: DataFrame, size: int = 500, overlap: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_index, chunk_id, content): sliding windows of characters; blank windows are left out and not numbered.

    The last window is the first that reaches the end. Null and empty texts have no chunks. All within a row: no shuffle.
    """
    if size <= 0 or overlap >= size:
        raise ValueError("the size is positive and greater than the overlap")
    step = size - overlap
    n = F.length(text_col)
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)) * step
    windows = F.transform(F.sequence(F.lit(0), last.cast("int"), F.lit(step)), lambda at: F.substring(F.col(text_col), at + 1, F.lit(size)))
    kept = F.filter(windows, lambda w: F.length(F.regexp_replace(w, r"\s+", "")) > 0)
    rows = docs.where(n > 0).select(F.col(id_col).alias("doc_id"), F.posexplode(kept).alias("chunk_index", "content"))
    return rows.select("doc_id", "chunk_index", joined_digest(F.col("doc_id"), F.col("chunk_index"), F.col("content")).alias("chunk_id"), "content")


def with_document_chunk_count(chunks: DataFrame) -> DataFrame:
    """Add the number of a document's chunks to each of them."""
    return chunks.withColumn("document_chunk_count", F.count("*").over(Window.partitionBy("doc_id")))


def headings_from_words(words: DataFrame) -> DataFrame:
    """(doc_id, page_number, line, text, level) of lines set larger than their page's middle size, or numbered.

    Words of one rounded top make a line. The middle is the element n // 2 of the page's line sizes; more than 4 above it
    is level 1, more than 1.5 level 2, a numbered line level 3.
    """
    line = words.withColumn("line", F.bround("top", 2)).groupBy("doc_id", "page_number", "line")
    lines = line.agg(F.avg("size").alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ").alias("text"))
    page = Window.partitionBy("doc_id", "page_number")
    at = F.row_number().over(page.orderBy("size", "line")) - 1
    middle = F.max(F.when(F.col("at") == F.floor(F.col("n") / 2), F.col("size"))).over(page)
    sized = lines.withColumn("at", at).withColumn("n", F.count("*").over(page)).withColumn("middle", middle)
    over = F.col("size") - F.col("middle")
    level = F.when(over > 4.0, 1).when(over > 1.5, 2).when(F.col("text").rlike(r"^\s*(?:\d+(?:\.\d+)*[.)]?|[IVXLC]+\.)\s+\S"), 3)
    return sized.withColumn("level", level).where("level is not null").select("doc_id", "page_number", "line", "text", "level")


def clean_extracted_tables(tables: DataFrame, rows_col: str = "rows") -> DataFrame:
    """Null cells become empty, blank rows and tables without rows go."""
    filled = F.transform(F.col(rows_col), lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit(""))))
    kept = F.filter(filled, lambda r: F.exists(r, lambda c: F.trim(c) != ""))
    return tables.withColumn(rows_col, kept).where(F.size(rows_col) > 0)


def explode_pages(docs: DataFrame) -> DataFrame:
    """One document per page that has text: id {doc_id}-pNNN, parent_doc_id, and the body's hash."""
    pages = docs.select("doc_id", F.explode("pages").alias("p")).where(F.length(F.trim(F.coalesce("p.text", F.lit("")))) > 0)
    return pages.select(F.format_string("%s-p%03d", F.col("doc_id").cast("string"), "p.page_number").alias("doc_id"), F.col("doc_id").cast("string").alias("parent_doc_id"), "p.page_number", F.col("p.text").alias("text"), F.sha2("p.text", 256).alias("content_hash"))
