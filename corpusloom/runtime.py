"""Session helpers shared by every job: table reads, the shared checkpoint folder, size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast only when it has at most this many rows of a few scalar columns; larger sides are shuffled.
BROADCAST_ROWS = 1_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where the session names none, a session on one machine (tests) gets a temporary one; on a cluster it is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast when the counted rows are within BROADCAST_ROWS; else leave the choice to the optimizer."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the DataFrame doesn't have yet (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def quoted(name: str) -> str:
    """A column name as Spark reads it whole, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def rank_in_groups(df: DataFrame, groups: list[str], order: list[str], output: str = "rank") -> DataFrame:
    """Add each row's place (from 1) in its group by the order columns, without one task per group.

    Ranges of (group, order) lie in partitions; a range's offset within a group comes from the counts of the ranges
    before it, one row per group and range; rows are numbered within a range. The order must tell rows apart.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(df.repartitionByRange(n, *groups, *order).withColumn("__range", F.spark_partition_id()))
    before = Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(*groups, "__range").agg(F.count("*").alias("__n"))
    offsets = offsets.select(*(F.col(g).alias(f"__g_{g}") for g in groups), F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(*groups, "__range").orderBy(*order))
    same = F.col("__range") == F.col("__r")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    placed = ranged.withColumn("__own", own).join(offsets, same)
    return placed.select(*df.columns, (F.col("__before") + F.col("__own")).alias(output))
