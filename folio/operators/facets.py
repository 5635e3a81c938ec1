"""Facets: predicates, counts, histograms, explicit orders."""

from __future__ import annotations

from functools import reduce
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def predicate(facets: dict[str, list[str]], lists: set[str] = frozenset()) -> Column:
    """Any value inside a facet, all facets together; an empty facet passes. Facets in `lists` are arrays."""
    parts = [F.arrays_overlap(F.col(k), F.array(*[F.lit(x) for x in v])) if k in lists else F.col(k).isin(v) for k, v in facets.items() if v]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def from_url(query: str) -> dict[str, list[str]]:
    return {k: [x for x in v.split(",") if x] for k, v in parse_qsl(query)}


def to_url(facets: dict[str, list[str]]) -> str:
    return urlencode({k: ",".join(v) for k, v in facets.items() if v}, safe=",")


def counts(df: DataFrame, facet: str, many: bool = False) -> DataFrame:
    """value, n. An array counts every occurrence, a repeated one twice."""
    value = F.explode(facet) if many else F.col(facet)
    return df.select(value.alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def with_expected(df: DataFrame, facet: str, expected: list[str]) -> DataFrame:
    """value, n, place, expected: listed values first, in their order and even without rows, then the others."""
    spark = df.sparkSession
    listed = spark.createDataFrame([(v, i) for i, v in enumerate(expected)], "value string, place int")
    found = counts(df, facet)
    return found.join(listed, "value", "full").select("value", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("place", F.lit(len(expected))).alias("place"), F.col("place").isNotNull().alias("expected"))


def place_in(order: list[str], c: Column) -> Column:
    """1.. in the declared order, 0 for values that aren't in it."""
    return F.array_position(F.array(*[F.lit(x) for x in order]), c).cast("int")
