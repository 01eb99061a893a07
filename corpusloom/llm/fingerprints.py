"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Every five-word shingle is hashed once; the hash's high bits name one of 128 bins and a bin keeps its smallest hash.
An empty bin takes the value of the first non-empty bin on its own sequence of hashed bin numbers (optimal
densification); after ``ATTEMPTS`` misses it takes the non-empty bin with the smallest hash of both bin numbers, which
is the same draw without repetition. A fingerprint is the low eight bits of each bin, packed into hex. The share of
equal bins overstates the similarity by chance hits; the likeness is corrected for that.

Defined results: words are runs of non-space characters; a text with fewer than five words has the one shingle of its
whole sequence; a null or blank text has the empty fingerprint, whose likeness is 1 to itself and 0 to others. In the
order of documents a null id comes last, rows of one id follow a hash of their text, and rows equal in id and text
stand as one, so all of them have the same next document. The next document of a single row is itself. An empty table
gives an empty result. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.runtime import checkpointed

#: Bins are 2**7; 64 - 7 bits of a hash are its value in the bin.
BINS, VALUE_BITS = 128, 57
ATTEMPTS = 8
#: Chance that two different values have the same low eight bits.
CHANCE = 1 / 256
#: Ids that one task orders, about.
IDS_PER_RANGE = 200_000


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(text: Column) -> Column:
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def grams(h: Column) -> Column:
        whole = F.transform(F.slice(h, 1, F.size(h) - 4), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2), F.get(h, i + 3), F.get(h, i + 4)))
        return F.when(F.size(h) >= 5, whole).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return bound(F.transform(words, lambda w: F.xxhash64(w)), grams)


def _bin(x: Column) -> Column:
    return F.shiftright(x, VALUE_BITS) + BINS // 2


def _low(x: Column) -> Column:
    return (x.bitwiseAND(255) - 128).cast("tinyint")


def fingerprint(text: Column) -> Column:
    """The fingerprint as 128 signed bytes (array<tinyint>); empty for a text without words."""

    def smallest(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, VALUE_BITS) != F.shiftright(F.get(s, i - 1), VALUE_BITS)))

    def gap(n: Column) -> Column:
        return F.array_repeat(F.lit(None).cast("tinyint"), n.cast("int"))

    def spread(m: Column) -> Column:
        ahead = F.flatten(F.transform(m, lambda x, i: F.concat(F.array(_low(x)), gap(F.coalesce(_bin(F.get(m, i + 1)), F.lit(BINS)) - _bin(x) - 1))))
        return F.concat(gap(_bin(F.get(m, F.lit(0)))), ahead)

    def densified(m: Column) -> Column:
        def borrowed(d: Column, b: Column) -> Column:
            tries = F.transform(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)), lambda t: F.get(d, F.pmod(F.xxhash64(b, t), F.lit(BINS)).cast("int")))
            hit = F.get(F.filter(tries, lambda v: v.isNotNull()), F.lit(0))
            least = F.array_min(F.transform(m, lambda x: F.struct(F.xxhash64(b, _bin(x)).alias("k"), _low(x).alias("v"))))
            return F.coalesce(hit, least.getField("v"))

        return bound(spread(m), lambda d: F.when(F.size(m) == BINS, d).otherwise(F.transform(d, lambda v, b: F.when(v.isNull(), borrowed(d, b)).otherwise(v))))

    return bound(bound(F.sort_array(shingle_hashes(text)), smallest), lambda m: F.when(F.size(m) == 0, F.array().cast("array<tinyint>")).otherwise(densified(m)))


def packed(bits: Column) -> Column:
    """The fingerprint as lower-case hex, two digits a bin."""
    return F.lower(F.array_join(F.transform(bits, lambda v: F.substring(F.hex(v.cast("int") + 384), 2, 2)), ""))


def likeness(a: Column, b: Column) -> Column:
    """The similarity of two texts estimated from their fingerprints, corrected for chance hits; 0 to 1."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    corrected = F.greatest(F.lit(0.0), (equal / BINS - CHANCE) / (1 - CHANCE))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(corrected)


def next_in_order(ids: DataFrame) -> DataFrame:
    """(id, row, next_id, next_row) of distinct (id, row): the one after it in descending order, the last's is the first.

    Ranges of the order lie in partitions; the next of a range's last one is the first of the next range. Only the
    ranges' firsts (one row per partition) are ordered together.
    """
    count = ids.count()
    ranges = max(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), count // IDS_PER_RANGE + 1)
    ranged = checkpointed(ids.repartitionByRange(ranges, F.desc("id"), "row").withColumn("range", F.spark_partition_id()))
    here = F.struct("id", "row")
    order = F.struct(F.col("id").isNull(), F.bitwise_not("id"), F.col("row"))
    firsts = ranged.groupBy("range").agg(F.min_by(here, order).alias("first"))
    all_ranges = Window.orderBy("range")
    firsts = firsts.select("range", F.coalesce(F.lead("first").over(all_ranges), F.first("first").over(all_ranges)).alias("after"))
    within = Window.partitionBy("range").orderBy(F.desc_nulls_last("id"), "row")
    follow = ranged.withColumn("next", F.lead(here).over(within)).join(F.broadcast(firsts), "range")
    follow = follow.withColumn("next", F.coalesce("next", "after"))
    return follow.select("id", "row", F.col("next.id").alias("next_id"), F.col("next.row").alias("next_row"))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text (its last third replaced by the next document's start)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("row", F.xxhash64("id", "text"))
    ids = base.select("id", "row", F.floor(F.length("text") / 3).cast("int").alias("cut"))
    distinct = checkpointed(ids.distinct())
    repeats = ids.count() != distinct.count()
    base = base.select("id", "row", "text", fingerprint(F.col("text")).alias("bits"))
    one_each = base.dropDuplicates(["id", "row"]) if repeats else base
    # both joins deal out the same rows by the same keys, so the texts are shuffled once
    follow = next_in_order(distinct.select("id", "row")).join(distinct.withColumnsRenamed({"id": "c_id", "row": "c_row"}), (F.col("row") == F.col("c_row")) & F.col("id").eqNullSafe(F.col("c_id")))
    follow = follow.select(F.col("id").alias("h_id"), F.col("row").alias("h_row"), "next_id", "next_row", "cut")
    heads = one_each.join(follow, (F.col("row") == F.col("next_row")) & F.col("id").eqNullSafe(F.col("next_id")))
    heads = heads.select("h_id", "h_row", F.substring("text", F.lit(1), F.col("cut")).alias("head"), F.col("bits").alias("next_bits"))
    both = base.join(heads, (F.col("row") == F.col("h_row")) & F.col("id").eqNullSafe(F.col("h_id")))
    size = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), size - F.floor(size / 3).cast("int")), "head")
    made = both.select("id", size.cast("long").alias("n_chars"), "bits", "next_bits", edited.alias("edited")).withColumn("edited_bits", fingerprint(F.col("edited")))
    return made.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        packed(F.col("bits")).alias("fingerprint"),
        packed(F.col("edited_bits")).alias("edited_fingerprint"),
        likeness(F.col("bits"), F.col("edited_bits")).alias("near_edited"),
        likeness(F.col("bits"), F.col("next_bits")).alias("near_next"),
    )
