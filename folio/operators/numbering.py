"""Unique ids by counters: in order, each row takes its base, or else the first of base-2, base-3, .. that is free."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators.order import rank_within
from folio.scratch import Scratch

#: A base less its numbers; bases of one stem are the only ones that can want the same id.
STEM = r"(-[0-9]+)+$"


def numbered(rows: pd.DataFrame) -> pd.DataFrame:
    """The counter, row by row, for the rows of one stem that come first."""
    used, following, out = set(), {}, []
    for base in rows.sort_values("order")["base"]:
        taken, n = base, following.get(base, 1)
        while taken in used:
            n += 1
            taken = f"{base}-{n}"
        following[base] = n
        used.add(taken)
        out.append((taken, n))
    made = rows.sort_values("order").assign(id=[x for x, _ in out], n=[n for _, n in out])
    return made[["order", "base", "rank", "id", "n"]]


def counter_ids(rows: DataFrame, order: str, base: str, out: str) -> DataFrame:
    """Adds `out`, as a loop over the rows in `order` (a number, unique) would.

    Where a stem has one base only, a row's number is its rank in the base. Where some of a base's numbered ids stand as bases of their own
    (x and x-2), they and the counter contend. That ends at the largest such number that the counter can reach: rows of a
    higher rank have nothing but the counter, and are as far ahead of their rank as the last row before them. So only the
    first rows of such stems are walked, each stem for itself.
    """
    scratch = Scratch(rows.sparkSession, "ids")
    ranked = scratch.save(rank_within(rows.select(F.col(order).alias("order"), F.col(base).alias("base")), ["base"], "order", "rank"), "ranked")
    bases = ranked.groupBy("base").agg(F.count(F.lit(1)).alias("rows")).withColumn("stem", F.regexp_replace("base", STEM, ""))
    bases = scratch.save(bases, "bases")
    several = bases.groupBy("stem").agg(F.count(F.lit(1)).alias("bases")).filter("bases > 1").select("stem")
    contended = scratch.save(bases.join(several, "stem"), "contended")
    # numbers of a base that stand as bases
    tails = contended.select(F.regexp_replace("base", "-[0-9]+$", "").alias("of"), F.try_to_number(F.regexp_extract("base", "-([1-9][0-9]{0,17})$", 1), F.lit("9" * 18)).cast("long").alias("n")).filter("n >= 2")
    reach = contended.join(tails, F.col("base") == F.col("of"), "left").groupBy("base", "stem", "rows").agg(F.collect_list("n").alias("ns"))
    # the counter gets no further than its rows and the numbers that others took
    last = F.array_max(F.filter("ns", lambda n: n <= F.col("rows") + F.size("ns") + 1))
    heads = scratch.save(reach.select("base", "stem", F.greatest(F.lit(1), F.coalesce(last, F.lit(1))).alias("head")), "heads")
    known = ranked.join(heads, "base")
    walked = known.filter(F.col("rank") <= F.col("head")).groupBy("stem").applyInPandas(lambda pdf: numbered(pdf), "order long, base string, rank long, id string, n long")
    walked = scratch.save(walked, "walked")
    ahead = walked.groupBy("base").agg(F.max_by(F.col("n") - F.col("rank"), "rank").alias("ahead"))
    spelled = lambda n: F.when(n == 1, F.col("base")).otherwise(F.concat_ws("-", "base", n.cast("string")))
    rest = known.filter(F.col("rank") > F.col("head")).join(ahead, "base").select("order", "base", spelled(F.col("rank") + F.col("ahead")).alias("id"))
    alone = ranked.join(heads.select("base"), "base", "left_anti").select("order", "base", spelled(F.col("rank")).alias("id"))
    made = alone.unionByName(rest).unionByName(walked.select("order", "base", "id"))
    return rows.join(made.select(F.col("order").alias("__o"), F.col("id").alias(out)), F.col(order) == F.col("__o")).drop("__o")
