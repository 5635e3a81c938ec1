"""Redirects of merged or deleted entries: followed to their end, then applied to all references of a table in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.scratch import Scratch

#: Letters of a slug.
SLUG = "[a-z0-9-]+"


def followed(redirects: DataFrame, loser: str = "loser", winner: str = "winner") -> DataFrame:
    """loser, target, cyclic: the end of each chain. A loser has one winner. What leads into a circle has no end: target null.

    Pointers jump twice as far in each round, so a chain of n takes log2(n) rounds; what still points to a loser then is cyclic.
    """
    scratch = Scratch(redirects.sparkSession, "redirects")
    now = scratch.save(redirects.select(F.col(loser).alias("loser"), F.col(winner).alias("target")).filter("loser is not null and target is not null").distinct(), "step0")
    for k in range(1, now.count().bit_length() + 2):
        now = now.select("loser", "target")
        onward = now.select(F.col("loser").alias("at"), F.col("target").alias("up"))
        now = scratch.save(now.join(onward, F.col("target") == F.col("at"), "left").select("loser", F.coalesce("up", "target").alias("target"), F.col("up").isNotNull().alias("open")), f"step{k}")
        if now.filter("open").isEmpty():
            break
    ends = redirects.select(F.col(loser).alias("at")).distinct()
    return now.select("loser", "target").join(ends, F.col("target") == F.col("at"), "left").select("loser", F.when(F.col("at").isNull(), F.col("target")).alias("target"), F.col("at").isNotNull().alias("cyclic"))


def linked(text: Column, collections: list[str]) -> Column:
    """Slugs of links to entries of the collections."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"/(?:{'|'.join(collections)})/({SLUG})"), F.lit(1))


def named(json: Column) -> Column:
    """Whole string values and keys of a JSON text that could be slugs."""
    return F.regexp_extract_all(F.coalesce(json, F.lit("")), F.lit(f'"({SLUG})"'), F.lit(1))


def swept(rows: DataFrame, key: str, moved: DataFrame, deleted: DataFrame, scalars: list[str] = (), arrays: list[str] = (), texts: list[str] = (), jsons: list[str] = (), collections: list[str] = ("thinkers",)) -> DataFrame:
    """The table with its references after a clean-up. moved: loser, target; deleted: slug. Other columns, the key among them, stay.

    Scalars and items of arrays are renamed, or emptied and dropped if deleted. In texts only links /<collection>/<slug>/ are
    renamed; a deleted one stays, as a broken link is better than a wrong one. In JSON, strings that equal a moved slug are
    renamed, but those under the name id. A row's references are looked up once for the row, and rows without any don't move.
    """
    none = F.array().cast("array<string>")
    refs = F.concat(F.array_compact(F.array(*[F.col(c) for c in scalars])) if scalars else none, *[F.coalesce(F.col(c), none) for c in arrays], *[linked(F.col(c), list(collections)) for c in texts], *[named(F.col(c)) for c in jsons])
    fate = moved.filter("target is not null").select(F.col("loser").alias("__ref"), F.col("target").alias("__to")).unionByName(deleted.select(F.col("slug").alias("__ref"), F.lit(None).cast("string").alias("__to")))
    found = rows.select(key, F.explode(F.array_distinct(refs)).alias("__ref")).join(fate, "__ref").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("__ref", "__to"))).alias("__fate"))
    out = rows.join(found, key, "left").withColumn("__fate", F.coalesce("__fate", F.create_map().cast("map<string,string>")))
    fated = F.col("__fate")
    has = lambda c: F.map_contains_key(fated, c)
    renames = F.filter(F.map_entries(fated), lambda e: e["value"].isNotNull())
    each = lambda c, pattern, to: F.aggregate(renames, F.col(c), lambda acc, e: F.regexp_replace(acc, pattern(e["key"]), to(e["value"])))
    changes = {}
    for c in scalars:
        changes[c] = F.when(F.coalesce(has(F.col(c)), F.lit(False)), F.coalesce(F.try_element_at(fated, F.col(c)), F.lit(""))).otherwise(F.col(c))
    for c in arrays:
        kept = F.filter(F.col(c), lambda x: ~F.coalesce(has(x), F.lit(False)) | F.try_element_at(fated, x).isNotNull())
        changes[c] = F.array_distinct(F.transform(kept, lambda x: F.coalesce(F.try_element_at(fated, x), x)))
    for c in texts:
        changes[c] = each(c, lambda k: F.concat(F.lit(f"/({'|'.join(collections)})/"), k, F.lit("(?![a-z0-9-])")), lambda v: F.concat(F.lit("/$1/"), v))
    for c in jsons:
        changes[c] = each(c, lambda k: F.concat(F.lit(r'(?<!"id"\s{0,9}:\s{0,9})"'), k, F.lit(r'"(?!\s*:)')), lambda v: F.concat(F.lit('"'), v, F.lit('"')))
    return out.withColumns(changes).drop("__fate")


def absorbed(people: DataFrame, merged: DataFrame, key: str, name: str, aliases: str) -> DataFrame:
    """people(key, name, aliases) after merged(loser, target): losers go, and winners take their names and aliases, less their own name. Names are united before they are gathered."""
    losers = merged.filter("target is not null").join(people, F.col("loser") == F.col(key))
    more = losers.select(F.col("target").alias("__w"), F.explode(F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>")))).alias("__a")).filter("__a is not null")
    united = more.groupBy("__w").agg(F.collect_set("__a").alias("__more"))
    kept = people.join(merged.filter("target is not null").select(F.col("loser").alias(key)), key, "left_anti").join(united, F.col(key) == F.col("__w"), "left")
    empty = F.array().cast("array<string>")
    return kept.select(key, name, F.array_sort(F.array_except(F.array_distinct(F.concat(F.coalesce(aliases, empty), F.coalesce("__more", empty))), F.array(name))).alias(aliases))
