"""Connected components of a link table by iterated minimum labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import checkpointed


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable by links, for every node that has a link.

    Each round takes the smallest label among a node's neighbours and then jumps to that label's own label, so chains
    shorten geometrically; rounds go on until no label changes. Labels and links stay distributed; only the number of
    changes reaches the driver. Links with a null end and self links are ignored; repeated links count once; without
    links the result is empty.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    both = checkpointed(pairs.union(pairs.select("b", "a")).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component"))
    labels = checkpointed(labels)
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        pulled = labels.join(seen, "node").select("node", "component", F.least("component", "near").alias("pulled"))
        root = labels.select(F.col("node").alias("pulled"), F.col("component").alias("jumped"))
        moved = checkpointed(pulled.join(root, "pulled").select("node", F.col("component").alias("was"), F.least("pulled", "jumped").alias("component")))
        changed = moved.where("was <> component").limit(1).count()
        labels = moved.select("node", "component")
        if not changed:
            return labels
