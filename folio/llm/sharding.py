"""Sharding by proportional stratified interleaving.

Each source's rows are shuffled by a seeded hash and ranked; a row's fractional rank is (rank + u) / rows of its source,
with a seeded u between 0 and 1 for each source, so that small sources spread over the whole range. Sorting all rows by it
interleaves the sources in proportion, and cutting that order into equal runs gives shards that all have the mixture of the
whole, each source within one row or two of its share.

Law `rows`: shard sizes differ by one row at most. Null strata form one stratum. Rows equal in every ordering column
are interchangeable. Texts aren't read here, so their length doesn't matter. Extra columns pass, but for names that begin
with two underscores, which are taken. An empty table gives an empty result; more shards than rows leave the last ones empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.llm.common import ROWS_PER_BUCKET, Scratch, null_safe_join, seeded, spread_rank


def interleave(df: DataFrame, shards: int, stratum: str = "source", key: str = "doc_id", ties: tuple[str, ...] = (), seed: int = 17, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Add `shard` and `slot` to every row; all other columns pass through.

    The order within a stratum is by a hash of the key and `ties`, then by these themselves. Both ranks are
    taken in buckets of some ten thousand rows, so neither a large source nor the whole table meets in one task.
    A column named like `shard` or `slot` is replaced.
    """
    scratch = Scratch(df.sparkSession, "shard")
    rows = df.drop(shard, slot)
    named = [key, *ties]
    sizes = scratch.save(rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("__size")), "sizes")
    h = seeded(seed, *[F.col(c) for c in named])
    ranked = spread_rank(
        null_safe_join(rows, sizes, [stratum]).withColumn("__h", h), [stratum], "__size", [F.col("__h"), *[F.col(c) for c in named]], F.col("__h"), "__rank"
    )
    ranked = scratch.save(ranked, "ranked")
    total = ranked.count()
    parts = max(1, -(-total // ROWS_PER_BUCKET))
    offset = (F.pmod(seeded(seed + 1, F.col(stratum)), F.lit(1 << 20)) + 0.5) / float(1 << 20)
    ranked = ranked.withColumn("__f", (F.col("__rank") + offset) / F.col("__size")).withColumn("__part", F.floor(F.col("__f") * parts))
    before = (
        ranked.groupBy("__part")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("__n")
    )
    place = F.row_number().over(Window.partitionBy("__part").orderBy("__f", F.col(stratum), "__h", *named)) - 1
    at = F.col("__before") + F.col("__place")
    cut = F.expr(f"(__at * {shards}L) div {max(1, total)}L")
    return (
        ranked.withColumn("__place", place)
        .join(before, "__part")
        .withColumn("__at", at)
        .withColumn(shard, cut.cast("int"))
        .withColumn(slot, F.col("__at") - F.expr(f"(`{shard}` * {total}L + {shards - 1}L) div {shards}L"))
        .drop("__size", "__h", "__rank", "__f", "__part", "__before", "__place", "__at")
    )


def write_shards(df: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """One folder for each shard, its files sorted by slot."""
    df.repartition(shard).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
