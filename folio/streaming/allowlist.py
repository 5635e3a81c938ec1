"""A static side of a stream, read again after a time."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.streaming.versions import Log


class Refetched:
    """Call it in each micro-batch: the rows of read(), read again once `seconds` have passed.

    What was read is written as a version of a table, however large, and the batches read that version: a source that goes missing
    meanwhile doesn't fail them. If reading fails, the last version stays, also one of an earlier run, and the next batch
    tries again. Without any version there are no rows, or with `needed`, the error is raised, so that a list of what is
    forbidden never counts as empty. Versions but the last two are deleted.
    """

    def __init__(self, spark: SparkSession, read: Callable[[], DataFrame], schema: str, seconds: float, path: str, needed: bool = False, now: Callable[[], float] = time.monotonic):
        self.spark, self.read, self.schema, self.seconds, self.path, self.needed, self.now = spark, read, schema, seconds, path, needed, now
        self.log = Log(spark, f"{path}/log")
        self.at: float | None = None
        self.failed: Exception | None = None

    def __call__(self) -> DataFrame:
        if self.at is None or self.now() - self.at >= self.seconds:
            try:
                version = uuid.uuid4().hex
                self.read().write.parquet(f"{self.path}/data/{version}")
                older = [n.split("-", 1)[1].removesuffix(".json") for n in self.log.names()]
                self.log.append(version, {"version": version})
                for v in older[:-1]:
                    self.log.disk.delete(self.log.fs_of.Path(f"{self.path}/data/{v}"), True)
                self.at, self.failed = self.now(), None
            except Exception as e:  # whatever the source raises, the stream goes on with what it has
                self.failed = e
        version = self.log.last().get("version")
        if version is None:
            if self.needed:
                raise self.failed
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{version}")
