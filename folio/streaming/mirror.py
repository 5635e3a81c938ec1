"""Idempotent mirror of a feed: micro-batches into a keyed table, guarded against lists and other people's edits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators.merge import by_rank, edited_by_others
from folio.streaming.versions import Log, VersionedTable


def classify(items: DataFrame, blocked: DataFrame, state: DataFrame, bot: str, key: str = "slug", url: str = "link", body: str = "body") -> DataFrame:
    """Adds `action` to each item: blocked, guarded, unchanged, update or create.

    blocked(url), compared in any case; state(key, hash, email, login): what the target has and who wrote it last.
    Bodies are compared by a hash that leaves the day of the run out.
    """
    deny = blocked.select(F.lower("url").alias("__url")).distinct().withColumn("__blocked", F.lit(True))
    have = state.select(F.col(key).alias("__key"), F.col("hash").alias("__hash"), "email", "login", F.lit(True).alias("__there"))
    j = items.withColumn("hash", content_hash(F.col(body))).join(deny, F.lower(url) == F.col("__url"), "left").join(have, F.col(key) == F.col("__key"), "left")
    guarded = edited_by_others(F.col("login"), F.col("email"), F.coalesce("__there", F.lit(False)), bot)
    action = F.when(F.col("__blocked"), "blocked").when(guarded, "guarded").when(F.col("__hash") == F.col("hash"), "unchanged").when(F.col("__there"), "update").otherwise("create")
    return j.withColumn("action", action).drop("__url", "__blocked", "__key", "__hash", "email", "login", "__there")


def content_hash(body: Column) -> Column:
    return F.sha2(F.regexp_replace(body, r"(?m)^imported_on:.*$", ""), 256)


STATE = "link string, body string, hash string, email string, login string"


def mirror_table(spark: SparkSession, path: str, key: str = "slug", buckets: int = 64) -> VersionedTable:
    return VersionedTable(spark, path, key, f"{key} string, {STATE}", buckets)


def upsert(spark: SparkSession, batch: DataFrame, table: VersionedTable, name: str, blocked: DataFrame, bot: str) -> DataFrame:
    """Write a batch's creates and updates into the table, once for a name; returns counts by action, those of the first time if the batch is replayed.

    A key that comes twice in a batch takes its last item. Items without a key, an address or a body are counted as failed
    and stop no others. Only partitions whose keys change are read and written.
    """
    if (done := table.log.entry_of(name)) is None:
        key = table.key
        whole = F.col(key).isNotNull() & F.col("link").isNotNull() & F.col("body").isNotNull()
        items = by_rank(batch.filter(whole), [key], [F.col("seq").desc(), "body"]).drop("seq")
        marked = classify(items, blocked, table.read(table.changed(items.select(key))), bot, key).persist()
        try:
            failed = batch.filter(~whole).select(F.lit("failed").alias("action"))
            outcomes = {r[0]: r[1] for r in marked.select("action").unionByName(failed).groupBy("action").count().collect()}  # six rows at most
            new = marked.filter(F.col("action").isin("create", "update")).select(key, "link", "body", "hash", F.lit(bot).alias("email"), F.lit(bot).alias("login"))
            done = table.upsert(name, new, {"outcomes": outcomes})
        finally:
            marked.unpersist()
    return spark.createDataFrame(list(done["outcomes"].items()), "action string, n long")


def run(spark: SparkSession, source: str, schema: str, table: str, checkpoint: str, blocked: DataFrame | Callable[[], DataFrame], bot: str, most: int = 10, name: str = "feed"):
    """Mirror what is new in a folder of JSON items, `most` files in a micro-batch, then stop. A callable is asked for the blocked addresses in each batch.

    Batches are named by the stream's name and their number, so a new checkpoint needs a new name.
    """
    items = spark.readStream.schema(schema).option("maxFilesPerTrigger", most).json(source)
    kept = mirror_table(spark, table)

    def each(batch: DataFrame, number: int) -> None:
        upsert(spark, batch, kept, f"{name}-{number}", blocked() if callable(blocked) else blocked, bot)

    return items.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_ids(items: DataFrame, emitted: DataFrame, key: str = "id") -> DataFrame:
    """Resume: what isn't in the sink yet."""
    return items.join(emitted.select(key), key, "left_anti")


class Ledger:
    """An append-only sink whose rows are announced to `commit(rows, id)` once `least` of them wait.

    A batch has a folder of its own, so a replay writes over what it wrote; its log entry makes it count, and holds how many rows wait.
    An announcement is logged before it is made and again after it. One that a crash cut off is made again with the same id, by which
    the other side can tell.
    """

    def __init__(self, spark: SparkSession, path: str, commit: Callable[[int, str], None], least: int = 20):
        self.spark, self.path, self.commit, self.least, self.log = spark, path, commit, least, Log(spark, f"{path}/log")

    def add(self, batch: DataFrame, name: str) -> None:
        self.announce()
        if self.log.entry_of(name) is not None:
            return
        folder = f"{self.path}/data/{name}"
        batch.write.mode("overwrite").parquet(folder)
        waiting = self.log.last().get("waiting", 0) + self.spark.read.schema(batch.schema).parquet(folder).count()
        due = waiting >= self.least
        self.log.append(name, {"waiting": 0 if due else waiting, "due": waiting if due else 0, "folder": name})
        self.announce()

    def announce(self) -> None:
        """Make the announcement that the last entry owes."""
        last = self.log.last()
        if last.get("due"):
            self.commit(last["due"], str(last["number"]))
            self.log.append(f"announced.{last['number']}", {"waiting": last["waiting"], "due": 0})

    def finish(self) -> None:
        """Announce the rest."""
        self.announce()
        if waiting := self.log.last().get("waiting", 0):
            self.log.append(f"rest.{self.log.last()['number']}", {"waiting": 0, "due": waiting})
            self.announce()

    def read(self, schema: str) -> DataFrame:
        folders = [f"{self.path}/data/{e['folder']}" for n in self.log.names() if "folder" in (e := self.log.read(n))]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)


def commit_in_batches(stream: DataFrame, path: str, checkpoint: str, commit: Callable[[int, str], None], least: int = 20, name: str = "stream") -> Ledger:
    """Append a stream to a ledger until it has nothing new, then announce the rest."""
    ledger = Ledger(stream.sparkSession, path, commit, least)
    query = stream.writeStream.foreachBatch(lambda batch, number: ledger.add(batch, f"{name}-{number}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    ledger.finish()
    return ledger
