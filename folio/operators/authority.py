"""Names and labels held against an authority: nearest titles, known recommendations, themes, canonical forms, access."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.operators.titles import best_titles, shape
from folio.scratch import Scratch


def nearest_titles(misses: DataFrame, key: str, title: str, inventory: DataFrame, other: str, other_title: str, top: int = 3) -> DataFrame:
    """key, other, score, rank: for each miss the `top` titles of the best token-set ratio (cut to whole numbers), whatever their year and whether or not they share a word.

    Titles are normalised. Equal scores are taken in the order of `other`.
    """
    scratch = Scratch(misses.sparkSession, "nearest")
    # written: both are read several times
    asked = scratch.save(misses.select(F.col(key), shape(F.col(title)).alias("__t")), "asked")
    # of rows with one title no more than `top` can count
    first = Window.partitionBy("__o").orderBy(other)
    rows = inventory.select(F.col(other), shape(F.col(other_title)).alias("__o")).withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= top)
    rows = scratch.save(rows, "rows")
    mine = asked.select(F.lit(0).alias("part"), F.col("__t").alias("title"))
    stock = rows.filter("__n = 1").select(F.lit(0).alias("part"), F.col("__o").alias("title"), F.col(other).alias("least"))
    found = best_titles(mine, stock, top, whole=True, scratch=scratch)
    w = Window.partitionBy("__t").orderBy(F.col("score").desc(), other)
    best = found.select(F.col("title").alias("__t"), F.col("other_title").alias("__o"), F.col("score").cast("int").alias("score")).join(rows.drop("__n"), "__o").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return asked.join(best, "__t").select(key, other, "score", "rank")


def already_known(records: DataFrame, key: str, additions: str, lookup: DataFrame, name: str, slug: str) -> DataFrame:
    """key, at, verbatim, known_as: recommended thinkers whose name the authority has. additions: array of (kind, verbatim); at counts from 0."""
    rows = records.select(key, F.posexplode(additions).alias("at", "__a")).filter("__a.kind = 'thinker' and __a.verbatim <> ''").select(key, "at", "__a.verbatim")
    bare = F.regexp_replace(F.lower("verbatim"), r"(?U)[^\w\s]", "")
    rows = rows.withColumn("__k", F.trim(F.regexp_replace(bare, r"(?U)\s+", " ")))
    return rows.join(lookup.select(F.col(name).alias("__k"), F.col(slug).alias("known_as")), "__k").select(key, "at", "verbatim", "known_as")


def theme_key(theme: Column, vocabulary: list[str]) -> Column:
    """The vocabulary's theme that a label is a spelling of, else the label in lower case with hyphens."""
    spellings: dict[str, str] = {}
    for v in vocabulary:
        words = v.split("-")
        titled = [w.title() for w in words]
        spellings |= dict.fromkeys((v, "_".join(words), "".join(titled), "_".join(titled), " ".join(words), " ".join(titled)), v)
    kebab = F.regexp_replace(F.lower(F.regexp_replace(theme, "(?<=[a-z0-9])(?=[A-Z])", "-")), "[_ ]", "-")
    shape = F.regexp_replace(F.regexp_replace(kebab, "-+", "-"), "^-|-$", "")
    if not spellings:
        return shape
    known = F.create_map(*[F.lit(x) for pair in spellings.items() for x in pair])
    return F.coalesce(F.try_element_at(known, theme), F.try_element_at(known, F.lower(theme)), shape)


def canonical_of(winner: Column, losers: Column) -> Column:
    """The winner's name, or where it has no dots the first loser's of the same letters that has."""
    letters = lambda c: F.regexp_replace(F.lower(c), "[^a-z]", "")
    dotted = F.filter(losers, lambda x: F.contains(x, F.lit(".")) & (letters(x) == letters(winner)))
    return F.when(F.contains(winner, F.lit(".")), winner).otherwise(F.coalesce(F.try_element_at(dotted, F.lit(1)), winner))


def access_tier(users: DataFrame, email: str, supers: list[str], subs: DataFrame, sub_email: str) -> DataFrame:
    """users with `tier`: super, sub or none, by addresses in any case and without blanks around them."""
    plain = lambda c: F.lower(F.trim(c))
    known = subs.select(plain(F.col(sub_email)).alias("__e")).distinct().filter("__e is not null")
    tier = F.when(plain(F.col(email)).isin([s.strip().lower() for s in supers]), "super").when(F.col("__e").isNotNull(), "sub").otherwise("none")
    return users.join(known, plain(F.col(email)) == F.col("__e"), "left").withColumn("tier", tier).drop("__e")


def slugged_categories(categories: Column, slug: Callable[[Column], Column], most: int = 60) -> Column:
    """Distinct slugs in their first order, none of them empty."""
    return F.array_distinct(F.filter(F.transform(categories, lambda c: F.left(slug(c), F.lit(most))), lambda s: s != ""))
