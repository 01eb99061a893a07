"""Tables in hash buckets that change by whole buckets: a keyed sink whose versions are published by a manifest.

Rows lie in folders by bucket. A change writes the new content of the buckets that it touches to a folder of its own,
and then a manifest file that names every bucket's folder, renamed to its final name last. Readers take the newest
manifest, so a write that fails anywhere leaves the version before it as it was, and a finished one is seen as a whole; of two
writers of one version the second fails. Folders that no manifest names may be deleted at any time.

What goes through the driver is a manifest: one line a bucket. Files are reached by Spark and its file systems only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "__bucket"


def bucket_of(key: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


@dataclass
class Version:
    """One published state: its number, schema, each bucket's folder, and what its writer told."""

    number: int
    schema: str
    paths: dict[int, str]
    told: dict = field(default_factory=dict)


class BucketedTable:
    """The newest published version of a table in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm

    def version(self) -> Version | None:
        """The newest version, None before the first."""
        found = self._fs.globStatus(self._path(f"{self.folder}/version-*.json"))
        names = sorted(s.getPath().getName() for s in found or [])
        if not names:
            return None
        stream = self._fs.open(self._path(f"{self.folder}/{names[-1]}"))
        try:
            said = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(said["number"], said["schema"], {int(b): p for b, p in said["paths"].items()}, said["told"])

    def read(self, buckets: Iterable[int] | None = None, version: Version | None = None) -> DataFrame:
        """The rows of all buckets or of some; only their folders are listed and read."""
        version = version or self.version()
        if version is None:
            raise ValueError(f"nothing was published in {self.folder}")
        wanted = version.paths if buckets is None else {b: version.paths[b] for b in buckets if b in version.paths}
        if not wanted:
            return self.spark.createDataFrame([], version.schema)
        return self.spark.read.schema(version.schema).parquet(*(f"{self.folder}/{p}" for p in wanted.values()))

    def publish(self, rows: DataFrame, touched: Iterable[int] | None = None, order: tuple[str, ...] = (), told: dict | None = None) -> Version:
        """Write the whole content of the touched buckets (None: of all) and publish it; rows have a column BUCKET."""
        version = self.write(rows, touched, order, told)
        self.commit(version)
        return version

    def write(self, rows: DataFrame, touched: Iterable[int] | None = None, order: tuple[str, ...] = (), told: dict | None = None) -> Version:
        """As ``publish``, but the version is not published yet: it can be read, and told more, before ``commit``.

        Rows are dealt by bucket; the optimizer splits a bucket that is too large for one task into several files.
        """
        old = self.version()
        data = f"data-{uuid.uuid4().hex}"
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != BUCKET)
        rows.hint("rebalance", F.col(BUCKET)).sortWithinPartitions(BUCKET, *order).write.partitionBy(BUCKET).parquet(f"{self.folder}/{data}")
        written = self._fs.globStatus(self._path(f"{self.folder}/{data}/{BUCKET}=*"))
        fresh = {int(name.partition("=")[2]): f"{data}/{name}" for name in (s.getPath().getName() for s in written or [])}
        kept = {} if old is None or touched is None else {b: p for b, p in old.paths.items() if b not in set(touched)}
        return Version(0 if old is None else old.number + 1, schema, kept | fresh, told or {})

    def commit(self, version: Version) -> None:
        draft, final = self._path(f"{self.folder}/draft-{uuid.uuid4().hex}"), self._path(f"{self.folder}/version-{version.number:012d}.json")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps({"number": version.number, "schema": version.schema, "paths": version.paths, "told": version.told}).encode()))
        finally:
            stream.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {version.number} of {self.folder} was published by another writer")


def touched_buckets(*rows: DataFrame) -> list[int]:
    """The buckets that rows lie in: at most as many numbers as there are buckets."""
    found: set[int] = set()
    for df in rows:
        found |= {r[0] for r in df.select(BUCKET).distinct().collect()}
    return sorted(found)


def write_vectors(rows: DataFrame, folder: str, key: str = "chunk_id", buckets: int = 64) -> Version:
    """Upsert keyed rows (vectors and their payloads) into the table in ``folder``.

    Of rows with one key any one of the greatest in all columns' digest is taken, so a repeated write gives equal rows. Only
    buckets in which a row is new or differs are rewritten; if there are none nothing is published. Null keys are an
    error. The number of buckets is fixed by the first write.
    """
    spark = rows.sparkSession
    table = BucketedTable(spark, folder)
    old = table.version()
    buckets = buckets if old is None else old.told["buckets"]
    columns = rows.columns
    own = F.sha2(F.to_json(F.struct(*(F.col(c) for c in columns if c != key)), {"ignoreNullFields": "false"}), 256)
    checked = F.when(F.col(key).isNull(), F.raise_error(F.lit("a row has no key"))).otherwise(F.col(key))
    new = rows.withColumn(key, checked).withColumn("__own", own).groupBy(key).agg(F.max_by(F.struct(*columns, "__own"), "__own").alias("r"))
    new = new.select("r.*").withColumn(BUCKET, bucket_of(key, buckets))
    told = {"buckets": buckets, "key": key}
    if old is None:
        return table.publish(new.select(*columns, "__own", BUCKET), None, (key,), told)
    before = table.read(version=old).select(F.col(key).alias("__k"), F.col("__own").alias("__was"))
    changed = new.join(before, (F.col(key) == F.col("__k")) & (F.col("__own") == F.col("__was")), "left_anti")
    touched = touched_buckets(changed)
    if not touched:
        return old
    current = table.read(touched, old).withColumn(BUCKET, bucket_of(key, buckets))
    kept = current.join(new.select(key), key, "left_anti")
    return table.publish(kept.select(*columns, "__own", BUCKET).unionByName(new.where(F.col(BUCKET).isin(touched)).select(*columns, "__own", BUCKET)), touched, (key,), told)


def read_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the newest version."""
    return BucketedTable(spark, folder).read().drop("__own")
