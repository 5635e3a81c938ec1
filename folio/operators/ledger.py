"""Run ledgers: totals, groupings, counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summary(rows: DataFrame, keys: list[str], ok: Column, seconds: Column) -> DataFrame:
    """keys, events, ok, errors, total, mean; the last two to three digits."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("errors"), F.round(F.sum(seconds), 3).alias("total"), F.round(F.sum(seconds) / F.greatest(F.count(F.lit(1)), F.lit(1)), 3).alias("mean")
    )


def grouping_sets(rows: DataFrame, keys: list[str], seconds: Column) -> DataFrame:
    """One grouping by each key and one of all rows; `*` stands where a key isn't grouped by."""
    cols = [F.col(k) for k in keys]
    sets = [[c] for c in cols] + [[]]
    made = rows.withColumn("__s", seconds).groupingSets(sets, *cols).agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("__s"), 3).alias("total"))
    return made.select(*[F.coalesce(F.col(k).cast("string"), F.lit("*")).alias(k) for k in keys], "events", "total")


def counters(rows: DataFrame, status: str) -> DataFrame:
    return rows.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def loop_guard(no_progress: Column, dispatches: Column, budget: int, extent: Column, least: float = 0.3) -> Column:
    """Why a continuation loop stops, or null."""
    return reduce(lambda out, x: out.when(x[0], x[1]), [(dispatches >= budget, "budget"), (extent < least, "extent")], F.when(no_progress >= 2, "no-progress")).otherwise(F.lit(None).cast("string"))
