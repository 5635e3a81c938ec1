"""Spread-out ranks and small helpers of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.scratch import Scratch, remove, shared_dir  # noqa: F401  the operators take them from here

#: Rows that one window of a spread-out rank holds, about.
ROWS_PER_BUCKET = 20_000

#: Pattern of a word wherever this subpackage counts words.
WORD = r"[^\x20\x09-\x0D]+"


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the table doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def seeded(seed: int, *cols: Column) -> Column:
    """A 64-bit hash of the columns under a seed; equal rows hash alike on every run."""
    return F.xxhash64(F.lit(seed), *cols)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; the right side's keys go."""
    other = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(other, on, how).drop(*[f"__r_{k}" for k in keys])


def spread_rank(df: DataFrame, strata: list[str], size: str, order: list[Column], bucket_hash: Column, out: str) -> DataFrame:
    """Rank 0.. within each stratum, without one task for a large stratum.

    `size` names a column with the stratum's row count. Rows go to ceil(size / ROWS_PER_BUCKET) buckets by
    their hash; the rank is the count of the buckets before plus the place inside. Stratum and bucket are
    ordered first, `order` inside. Rows that tie in everything take their places in any order.
    The rows are dealt out by stratum and bucket even if they come dealt by stratum, which would do for the window.
    """
    b, before, place = "__bucket", "__before", "__place"
    n = F.greatest(F.lit(1), F.ceil(F.col(size) / ROWS_PER_BUCKET))
    rows = df.withColumn(b, F.pmod(bucket_hash, n))
    offsets = (
        rows.groupBy(*strata, b)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn(before, F.sum("__n").over(Window.partitionBy(*strata).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)))
        .select(*strata, b, F.coalesce(before, F.lit(0)).alias(before))
    )
    ranked = rows.repartition(*strata, b).withColumn(place, F.row_number().over(Window.partitionBy(*strata, b).orderBy(*order)) - 1)
    return null_safe_join(ranked, offsets, [*strata, b]).withColumn(out, F.col(before) + F.col(place)).drop(b, before, place)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
