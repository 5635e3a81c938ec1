"""Tables between the steps of an operator, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may go without: it gets a new local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='folio-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(remove, spark, found)
    return found


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system. At exit the session may have stopped before."""
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def read_part(path: str, part: str, columns: list[str], rows: int = 65_536) -> Iterator[pa.RecordBatch]:
    """Rows of one folder (name=value) of a table that was written by that column, where a task reads them. None if there is no such folder."""
    system, folder = fs.FileSystem.from_uri(path)
    for f in system.get_file_info(fs.FileSelector(f"{folder}/{part}", allow_not_found=True)):
        if f.path.endswith(".parquet"):
            with system.open_input_file(f.path) as file:
                yield from pq.ParquetFile(file).iter_batches(rows, columns=columns)


class Scratch:
    """Tables written once to the shared folder, so that lost executors cost only the job at hand.

    They stay until the driver ends, since DataFrames that an operator returned still read them;
    tables that only an iteration needs are dropped by name.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(remove, spark, self.path)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        remove(self.spark, f"{self.path}/{name}")
