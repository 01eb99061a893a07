"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share the size of everything; a target
stops at ``max_epochs`` times its source's size and the excess goes to the others by weight until none is above.

Draw: a document's key is an exponential variate divided by its quality weight; within a source the keys in ascending
order are a weighted sample without replacement. A target holds so many complete epochs of its source, then the
documents in key order up to the rest. The variate comes from a hash of id and text, so reruns agree. The weight is 0.5
more than a quality column between 0 and 1 (a classifier's score, say), in steps of ``WEIGHT_STEP`` so that the last
digits of a score decide nothing; without such a column all documents weigh alike.

Scale: the running sum never sorts a source in one task. Keys fall into ``CELLS`` cells of about equal mass per source;
the cells' sums are accumulated (a small table) and only within a cell are documents ordered. Sources may be as many as
hosts: they are ranked by ranges and reshared by aggregations.

Defined results: the size is the number of words; a null, empty or blank text has size 0 and takes 0; a null source is a
source; a null or NaN quality counts as 0; an empty table gives an empty result; repeated rows count each, in an order
fixed by key, id and text; other columns are dropped by ``mix_plan`` and kept by ``mixed_rows``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.runtime import broadcast_if_small, checkpointed, free_name, quoted, rank_in_groups

#: Cells of the key order in each source; a cell is ordered within one task.
CELLS = 4096
#: Times that a document may be taken at most.
MAX_EPOCHS = 3
#: Steps of the quality weight.
WEIGHT_STEP = 0.05


def quality_weight(quality: F.Column) -> F.Column:
    """A document's sampling weight between 0.5 and 1.5."""
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(F.coalesce(quality.cast("double"), F.lit(0.0)), F.lit(0.0))))
    return F.lit(0.5) + F.round(bounded / WEIGHT_STEP) * WEIGHT_STEP


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, size): one row per source.

    A source gets its weight times the level, or its cap. The level shares what the capped sources leave among the
    others; each round caps what is above it, until none is. Levels only rise, so no source is freed again.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.select("source", "source_size", F.col("source").isNull().alias("nameless"), F.encode("source", "UTF-8").alias("name"))
    ranked = rank_in_groups(per, [], ["nameless", "name"], "place")
    weight = ((F.col("place") - 1) % 3 + 1).cast("double").alias("w")
    ranked = checkpointed(ranked.select("source", "source_size", weight, (F.col("source_size") * F.lit(float(max_epochs))).alias("cap")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        above = F.col("cap") <= F.col("w") * F.lit(level)
        r = ranked.agg(F.sum(F.when(above, F.col("cap"))).alias("full"), F.count_if(above).alias("n"), F.sum(F.when(~above, F.col("w"))).alias("w")).first()
        if r.n == capped or not r.w:
            break
        level, capped = (total - (r.full or 0.0)) / r.w, r.n
    return ranked.select("source", "source_size", F.least("cap", F.col("w") * F.lit(level)).alias("target"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cells: int = CELLS, max_epochs: int = MAX_EPOCHS, quality_col: str | None = None) -> DataFrame:
    """(id, row, size, source_size, target, taken, times) of every row; ``row`` is a hash of the text, which tells rows of one id apart."""
    text, doc = F.col(quoted(text_col)).cast("string"), F.col(quoted(id_col))
    variate = (F.xxhash64(doc.cast("string"), text, F.lit(17)).bitwiseAND((1 << 53) - 1) + 0.5) / float(1 << 53)
    weight = F.lit(1.0) if quality_col is None else quality_weight(F.col(quoted(quality_col)))
    keyed = docs.select(
        doc.alias("id"),
        F.xxhash64(text).alias("row"),
        F.col(quoted(source_col)).alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        (-F.log(variate) / weight).alias("key"),
    ).withColumn("cell", F.least(F.lit(cells - 1), ((1 - F.exp(-F.col("key"))) * cells).cast("int")))
    keyed = checkpointed(keyed)
    targets = checkpointed(source_targets(keyed.select("source", "size"), max_epochs))
    below = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy("source", "cell").agg(F.sum("size").alias("cell_size")).withColumn("before_cell", F.coalesce(F.sum("cell_size").over(below), F.lit(0)))
    per_source = broadcast_if_small(targets.withColumnRenamed("source", "of"), targets.count())
    plan = sums.join(per_source, F.col("source").eqNullSafe(F.col("of"))).select(F.col("source").alias("s"), F.col("cell").alias("c"), "before_cell", "source_size", "target")
    placed = keyed.join(plan, keyed["source"].eqNullSafe(F.col("s")) & (keyed["cell"] == F.col("c")))
    within = Window.partitionBy("source", "cell").orderBy("key", "id", "row").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("before_cell") + F.coalesce(F.sum("size").over(within), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(max_epochs), F.floor(F.col("target") / F.greatest("source_size", F.lit(1)) + 1e-9))).otherwise(0)
    rest = F.col("target") - epochs * F.col("source_size")
    times = epochs + F.when((before + F.col("size") / 2 <= rest) & (epochs < max_epochs), 1).otherwise(0)
    return placed.select("id", "row", "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"), times.cast("int").alias("times"))


def mix_sources(docs: DataFrame, **names) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    return mix_plan(docs, **names).select(F.col("id").alias(names.get("id_col", "doc_id")), "size", "source_size", "target", "taken")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", scored: DataFrame | None = None, quality_col: str | None = None) -> DataFrame:
    """The mix itself: every row as often as it is taken, all columns kept. Rows without words are never taken.

    ``scored`` has the same rows with their quality; it may have fewer columns.
    """
    plan = mix_plan(docs if scored is None else scored, id_col, text_col, source_col, quality_col=quality_col).where("taken > 0")
    own, kept_id, kept_row, times, copy = (free_name(docs, c) for c in ("own_row", "kept_id", "kept_row", "times_taken", "copy"))
    plan = plan.groupBy(F.col("id").alias(kept_id), F.col("row").alias(kept_row)).agg(F.max("times").alias(times))
    keyed = docs.withColumn(own, F.xxhash64(F.col(quoted(text_col)).cast("string")))
    rows = keyed.join(plan, F.col(quoted(id_col)).eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_row)))
    columns = [F.col(quoted(c)) for c in docs.columns]
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*columns)
