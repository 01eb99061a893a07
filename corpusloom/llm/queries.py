"""The registered queries of the operators in this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import chat_format, fill_middle, fingerprints, main_text, media, mixing, ngram_join, piece_codec, quality_cnn, token_counts, toxicity, turn_repair, warc
from corpusloom.llm.training_sample import labelled_sample, remainder
from corpusloom.runtime import checkpointed, read_table, shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: (modulus, remainder) of crc32 of the id: rows whose labels are never learnt from.
TOXIC_HELD_OUT, QUALITY_HELD_OUT = (3, 1), (5, 0)
#: Scores from which a row counts as toxic, and as good.
TOXIC_FROM, QUALITY_FROM = 0.7, 0.3


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.FactorizationMachine:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return toxicity.train(labelled_sample(docs, labels, "toxic", TOXIC_HELD_OUT, toxicity.TRAIN_ROWS))


def quality_model(spark: SparkSession, sf_dir: str) -> quality_cnn.Network:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return quality_cnn.train(labelled_sample(docs, labels, "quality", QUALITY_HELD_OUT, quality_cnn.TRAIN_ROWS))


def judged(scored: DataFrame, held_out: tuple[int, int], threshold: float) -> DataFrame:
    modulus, kept_back = held_out
    return scored.select("doc_id", (remainder("doc_id", modulus) == kept_back).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every whole text."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer_path("piece_bpe_32k.model"), keep=("doc_id",))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(toxicity.score(docs, toxicity_model(spark, sf_dir), keep=("doc_id",)), TOXIC_HELD_OUT, TOXIC_FROM)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text.extract_main_text(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=("page_id", "url"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as transcripts, their roles recovered from the lines and rendered canonically."""
    written = checkpointed(chat_format.written_transcripts(read_table(spark, sf_dir, "conversations")))
    known = written.where(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 2 == 0)
    return chat_format.parse_conversations(written, chat_format.fit(known))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix to the target weights takes of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(quality_cnn.score(docs, quality_model(spark, sf_dir), output="quality"), quality_col="quality")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(quality_cnn.score(docs, quality_model(spark, sf_dir), keep=("doc_id",)), QUALITY_HELD_OUT, QUALITY_FROM)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by a shingle similarity of 0.75 or more."""
    return ngram_join.jaccard_components(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text."""
    return fingerprints.fingerprint_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text; digests of the ids and of the decoded text."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_codec.encode_and_decode(docs, tokenizer_path("piece_bpe_32k.model"), keep=("doc_id",), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text stored as lossless WebP and read back."""
    outputs = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    return media.through_webp(read_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=("doc_id",), outputs=outputs)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text rearranged for fill-in-the-middle, and rebuilt."""
    made = fill_middle.fill_in_middle(read_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=("doc_id",))
    back = F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), back.alias("restored_sha256"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives in the shared folder, and the archives read back."""
    archives = warc.write_archives(read_table(spark, sf_dir, "pages"), f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")
    read = warc.resolved(warc.read_archives(archives, payloads=False))
    return read.select(warc.unbroken(F.col("page_id")).cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").cast("long").alias("refers_to"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged, its faults counted and its structure repaired at least cost."""
    given = read_table(spark, sf_dir, "conversations")
    rows = turn_repair.damaged(given)
    found = checkpointed(turn_repair.reports(rows))
    digests = turn_repair.repaired_digests(rows, found).select(F.col("conv_id").alias("d"), "repaired_sha256")
    told = found.withColumnRenamed("conv_id", "c")
    ids = given.select("conv_id").distinct()
    whole = ids.join(told, F.col("conv_id").eqNullSafe(F.col("c")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("d")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in turn_repair.COUNTS]
    return whole.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


# What SQL can say of the operators' results --------------------------------------------------------------------------


def mixed_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of documents and sources in op5_mixing."""
    return op5_mixing(spark, sf_dir).select("doc_id", "size", "source_size")


def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set sizes in op7_ngram_jaccard."""
    return op7_ngram_jaccard(spark, sf_dir).select("doc_id", "n_shingles")


def edited_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and edited texts in op8_fingerprints."""
    return op8_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def payload_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads read back in op10_media."""
    return op10_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_toxicity": op2_toxicity,
    "op3_main_text": op3_main_text,
    "op4_chat_format": op4_chat_format,
    "op5_mixing": op5_mixing,
    "op6_quality_cnn": op6_quality,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_fingerprints": op8_fingerprints,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_media": op10_media,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_warc": op12_warc,
    "op13_turn_repair": op13_turn_repair,
    "mixed_sizes": mixed_sizes,
    "shingle_counts": shingle_counts,
    "edited_digests": edited_digests,
    "payload_digests": payload_digests,
}

_WORDS = r"""regexp_extract_all({}, '[^\x20\x09-\x0D]+')"""

ORACLE_SQL: dict[str, str] = {
    "op11_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
k AS (SELECT doc_id, t, regexp_extract_all(t, '(?s)[A-Za-z]+|[^A-Za-z]') AS w, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS i, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS j,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT doc_id, t, form, len(w) AS n, array_to_string(w[1:i], '') AS pre, array_to_string(w[i + 1:j], '') AS mid, array_to_string(w[j + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "op12_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS f FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN f IS NOT NULL AND page_id IS DISTINCT FROM f THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM f THEN f END AS refers_to FROM f""",
    "op13_turn_repair": r"""
WITH RECURSIVE bits AS (SELECT i, i AS c, 0 AS k FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT i, xor(c >> 1, 3988292384 * (c & 1)), k + 1 FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS x, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
hit AS (SELECT g.*, xor(list_reduce(list_transform(range(1, length(key) + 1), lambda p: CAST(ord(key[p]) AS BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 20 AS k FROM given g, crc_table),
dealt AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE r END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(x, '.!?', '') ELSE x END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hit WHERE k <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(CAST(length(role) AS VARCHAR) || ':' || role || text)) AS i, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM dealt),
judged AS (SELECT *, role[1] AS y, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
best AS (
  SELECT conv_id, n + 1 AS i, {'c': 0, 's': '', 'o': ''} AS v0, {'c': 4, 's': 'II', 'o': 'user:' || chr(10) || 'assistant:' || chr(10)} AS v1, {'c': 2, 's': 'I', 'o': 'assistant:' || chr(10)} AS v2, {'c': 0, 's': '', 'o': ''} AS v3 FROM counts
  UNION ALL
  SELECT conv_id, i, list_min([w0, {'c': 2 + u.c, 's': 'I' || u.s, 'o': 'user:' || chr(10) || u.o}]), list_min([w1, {'c': 2 + u.c, 's': 'I' || u.s, 'o': 'user:' || chr(10) || u.o}]), u, a FROM (
    SELECT *, list_min([w2, {'c': 2 + w3.c, 's': 'I' || w3.s, 'o': 'assistant:' || chr(10) || w3.o}]) AS u, list_min([w3, {'c': 2 + w2.c, 's': 'I' || w2.s, 'o': 'user:' || chr(10) || w2.o}]) AS a FROM (
      SELECT b.conv_id, j.i,
        list_min([{'c': 3 + v0.c, 's': 'D' || v0.s, 'o': v0.o}, {'c': more + v2.c + 2, 's': 'R' || v2.s, 'o': 'user:' || text || chr(10) || v2.o}, CASE y WHEN 's' THEN {'c': more + v1.c, 's': 'K' || v1.s, 'o': line || v1.o} WHEN 'u' THEN {'c': more + v2.c, 's': 'K' || v2.s, 'o': line || v2.o} END]) AS w0,
        list_min([{'c': 3 + v1.c, 's': 'D' || v1.s, 'o': v1.o}, {'c': more + v2.c + 2, 's': 'R' || v2.s, 'o': 'user:' || text || chr(10) || v2.o}, CASE y WHEN 'u' THEN {'c': more + v2.c, 's': 'K' || v2.s, 'o': line || v2.o} END]) AS w1,
        list_min([{'c': 3 + v2.c, 's': 'D' || v2.s, 'o': v2.o}, {'c': more + v3.c + 2, 's': 'R' || v3.s, 'o': 'assistant:' || text || chr(10) || v3.o}, CASE y WHEN 'a' THEN {'c': more + v3.c, 's': 'K' || v3.s, 'o': line || v3.o} END]) AS w2,
        list_min([{'c': 3 + v3.c, 's': 'D' || v3.s, 'o': v3.o}, {'c': more + v2.c + 2, 's': 'R' || v2.s, 'o': 'user:' || text || chr(10) || v2.o}, CASE y WHEN 'u' THEN {'c': more + v2.c, 's': 'K' || v2.s, 'o': line || v2.o} END]) AS w3
      FROM best b JOIN (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000 WHEN fault = 'truncated' THEN 1 ELSE 0 END AS more, role || ':' || text || chr(10) AS line FROM judged) j ON b.conv_id IS NOT DISTINCT FROM j.conv_id AND j.i = b.i - 1)))
SELECT g.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(v0.c, 0) AS BIGINT) AS cost, coalesce(v0.s, '') AS audit, sha256(coalesce(left(v0.o, length(v0.o) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN counts c ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON g.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = 1""",
    "mixed_sizes": f"SELECT doc_id, size, CAST(sum(size) OVER (PARTITION BY source) AS BIGINT) AS source_size FROM (SELECT doc_id, source, CAST(coalesce(len({_WORDS.format('text')}), 0) AS BIGINT) AS size FROM documents)",
    "shingle_counts": f"""
WITH w AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w)
SELECT doc_id, count(DISTINCT g) AS n_shingles FROM documents LEFT JOIN s USING (doc_id) GROUP BY doc_id""",
    "edited_digests": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS other FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(left(t, n - n // 3) || left(other, n // 3)) AS edited_sha256 FROM n""",
    "payload_digests": r"""
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, b, octet_length(b) AS n, CASE WHEN octet_length(b) = 0 THEN 64 ELSE (64 - octet_length(b) % 64) % 64 END AS more FROM b)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(n + more AS BIGINT) AS payload_bytes, sha256(b || repeat('\x00'::BLOB, CAST(more AS BIGINT))) AS payload_sha256 FROM p""",
}
