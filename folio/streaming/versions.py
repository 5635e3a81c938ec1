"""A table that a stream changes exactly once: partitions with versions, and a log that says which of them count.

A commit writes new versions of the partitions that it changes and then, in one step, a log entry that names the version of every
partition. A table has one writer at a time, as a stream is; a second one fails where it meets an entry of the first. Without the entry nothing has happened: what a dead attempt left is never read and
is written over by the next. A batch that is replayed finds its own entry and does nothing. Everything goes through
Hadoop's file system.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Log:
    """Numbered JSON entries of a folder. The last one is the state."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.fs_of = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.disk = self.fs_of.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.fs_of.Path(f"{self.path}/{name}")

    def names(self) -> list[str]:
        if not self.disk.exists(self.fs_of.Path(self.path)):
            return []
        return sorted(s.getPath().getName() for s in self.disk.listStatus(self.fs_of.Path(self.path)) if s.getPath().getName().endswith(".json"))

    def read(self, name: str) -> dict:
        stream = self.disk.open(self.at(name))
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def last(self) -> dict:
        found = self.names()
        return self.read(found[-1]) if found else {}

    def entry_of(self, batch: str) -> dict | None:
        """A batch's own entry. Names end with the batch, so no entry need be opened to look."""
        own = [n for n in self.names() if n.split("-", 1)[1] == f"{batch}.json"]
        return self.read(own[-1]) if own else None

    def append(self, batch: str, entry: dict) -> None:
        """Make the next entry; fails if another writer made it first."""
        found = self.names()
        number = int(found[-1].split("-", 1)[0]) + 1 if found else 0
        held = self.at(f".{uuid.uuid4().hex}")
        out = self.disk.create(held, True)
        out.write(bytearray(json.dumps(entry | {"number": number, "batch": batch}).encode()))
        out.close()
        wanted = self.at(f"{number:012d}-{batch}.json")
        if any(n.startswith(f"{number:012d}-") for n in self.names()) or not self.disk.rename(held, wanted):
            self.disk.delete(held, False)
            raise OSError(f"another writer made entry {number} of {self.path}")


class VersionedTable:
    """Rows by key in hash partitions; a commit writes only the partitions in which keys change."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = 64):
        self.spark, self.path, self.key, self.schema = spark, path, key, schema
        self.log = Log(spark, f"{path}/log")
        self.buckets = self.log.last().get("buckets", buckets)  # as the table was made

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self, only: list[int] | None = None) -> DataFrame:
        versions = self.log.last().get("versions", {})
        paths = [f"{self.path}/data/{v}/bucket={b}" for b, v in versions.items() if only is None or int(b) in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def changed(self, keys: DataFrame) -> list[int]:
        """Partitions of the keys: `buckets` at most."""
        return sorted(r[0] for r in keys.select(self.bucket()).distinct().collect())

    def upsert(self, batch: str, rows: DataFrame, more: dict | None = None) -> dict:
        """Put rows in the place of those with their keys, once for a batch; returns the batch's entry."""
        if (done := self.log.entry_of(batch)) is not None:
            return done
        last = self.log.last()
        touched = self.changed(rows.select(self.key))
        versions = dict(last.get("versions", {}))
        if touched:
            kept = self.read(touched).join(rows.select(self.key), self.key, "left_anti")
            now = kept.unionByName(rows.select(*kept.columns)).withColumn("bucket", self.bucket())
            version = f"{last.get('number', -1) + 1}-{batch}"
            now.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{version}")
            versions |= {str(b): version for b in touched}
        entry = {"buckets": self.buckets, "versions": versions} | (more or {})
        self.log.append(batch, entry)
        return entry
