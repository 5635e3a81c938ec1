"""Upserts, precedence unions, survivors, redirects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def is_empty(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def insert_new(target: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The target and those new rows whose key it lacks."""
    return target.unionByName(new.join(target.select(key), key, "left_anti"))


def first_run_wins(old: DataFrame, new: DataFrame, key: str, fields: list[str], override: frozenset[str] = frozenset()) -> DataFrame:
    """Old rows with each field filled where it was empty, alike or overridden; `<field>_status` is wrote, preserved or skipped."""
    other = new.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    df = old.join(other, key, "left")
    for f in fields:
        a, b = F.col(f), F.col(f"__{f}")
        status = F.when(is_empty(b), "skipped").when(is_empty(a) | (a == b) | F.lit(f in override), "wrote").otherwise("preserved")
        df = df.withColumn(f"{f}_status", status).withColumn(f, F.when(F.col(f"{f}_status") == "wrote", b).otherwise(a))
    return df.drop(*[f"__{f}" for f in fields])


def confidence_gated(old: Column, new: Column, confidence: Column) -> Column:
    return F.when(confidence.isin("high", "medium"), new).otherwise(old)


def needs_review(flag: Column, *confidences: Column) -> Column:
    out = F.coalesce(flag, F.lit(False))
    for c in confidences:
        out = out | ~F.coalesce(c == "high", F.lit(False))
    return out


def by_rank(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in the order. The order needs a unique end to be the same on each run."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def precedence_union(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first part that has the key; `precedence` is that part's number."""
    both = None
    for i, p in enumerate(parts):
        p = p.withColumn("precedence", F.lit(i))
        both = p if both is None else both.unionByName(p)
    return by_rank(both, [key], [F.col("precedence")])


def redirect(refs: Column, moved: Column, deleted: Column) -> Column:
    """An array of references after a clean-up: moved ones renamed, deleted ones gone, each once."""
    return F.array_distinct(F.array_except(F.transform(refs, lambda r: F.coalesce(F.try_element_at(moved, r), r)), deleted))


def edited_by_others(login: Column, email: Column, known: Column, bot: str) -> Column:
    """No history: false. A missing address: true. Else whether it isn't the bot's, in any case."""
    return F.when(~known, False).when(email.isNull(), True).otherwise(F.lower(email) != bot.lower())


def union_edges(edges: DataFrame, keys: list[str], evidence: str, others: list[str], order: str) -> DataFrame:
    """One edge for each key: evidence united and sorted, other fields of its first row."""
    first = [F.min_by(c, order).alias(c) for c in others]
    return edges.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(evidence)))).alias(evidence), *first)


def suffix_duplicates(df: DataFrame, keys: list[str], slug: str, order: list[str]) -> DataFrame:
    """Later rows of a slug get -2, -3, .. at its end."""
    n = F.row_number().over(Window.partitionBy(*keys, slug).orderBy(*order))
    return df.withColumn("__n", n).withColumn(slug, F.when(F.col("__n") > 1, F.concat_ws("-", F.col(slug), F.col("__n").cast("string"))).otherwise(F.col(slug))).drop("__n")
