"""Where people and themes occur in nested records: one long table of occurrences, its edges, counts and first contexts.

A record has authors, editors and contributors, and mentions and themes either in its own summary or in those of its essays.
All places are put into one array of a record, so that a record is read and exploded once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters of a mention's context.
CONTEXT = 200


def people_in(record: DataFrame, slug: str = "slug") -> DataFrame:
    """slug, at, person, role, confidence, page, context, kind (contributor or cites) of every person named in a record, in the order of its places.

    record: authors, editors (array<struct<thinker_id, confidence>>), contributors (.. role ..), summary_structured
    (struct<cross_thinker_mentions: array<struct<thinker_id, page, context>>, ..>), essays_summarized (array<struct<summary_structured>>). Any may be null.
    """

    def place(who: Column, role: Column, confidence: Column | None, page: Column | None = None, context: Column | None = None, kind: str = "contributor") -> Column:
        null = F.lit(None)
        parts = [who, role, null if confidence is None else confidence, null if page is None else page, null if context is None else context]
        names = [("person", "string"), ("role", "string"), ("confidence", "string"), ("page", "int"), ("context", "string")]
        return F.struct(*[p.cast(k).alias(n) for p, (n, k) in zip(parts, names, strict=True)], F.lit(kind).alias("kind"))

    sure = lambda x: F.coalesce(F.nullif(x["confidence"], F.lit("")), F.lit("medium"))
    listed = lambda c, role: F.coalesce(F.transform(c, lambda x: place(x["thinker_id"], role(x), sure(x))), F.array())
    mention = lambda m: place(m["thinker_id"], F.lit("body_text_mention"), F.lit("high"), m["page"], F.left(F.coalesce(m["context"], F.lit("")), F.lit(CONTEXT)), "cites")
    of_summary = lambda s: F.coalesce(F.transform(s["cross_thinker_mentions"], mention), F.array())
    places = F.concat(
        listed(F.col("authors"), lambda x: F.lit("author")),
        listed(F.col("editors"), lambda x: F.lit("editor")),
        listed(F.col("contributors"), lambda x: F.coalesce(F.nullif(x["role"], F.lit("")), F.lit("contributor"))),
        of_summary(F.col("summary_structured")),
        F.coalesce(F.flatten(F.transform("essays_summarized", lambda e: of_summary(e["summary_structured"]))), F.array()),
    )
    return record.select(slug, F.posexplode(places).alias("at", "x")).select(slug, "at", "x.*").filter("person <> ''")


def themes_in(record: DataFrame, slug: str = "slug") -> DataFrame:
    """slug, theme: each theme of a record once, wherever it stands."""
    lists = lambda *cs: [F.coalesce(c, F.array().cast("array<string>")) for c in cs]
    of = lambda s: F.concat(*lists(s["themes_confirmed"], s["theme_proposed_new"]))
    essays = F.coalesce(F.flatten(F.transform("essays_summarized", lambda e: of(e["summary_structured"]))), F.array().cast("array<string>"))
    every = F.concat(*lists(F.col("themes"), F.col("theme_proposed_new")), of(F.col("summary_structured")), essays)
    return record.select(slug, F.explode(F.array_distinct(every)).alias("theme")).filter("theme is not null")


def edges_of(occurrences: DataFrame, slug: str = "slug") -> DataFrame:
    """source, target, kind, confidence, context: the edge of each occurrence. A contributor's context is the role."""
    context = F.when(F.col("kind") == "contributor", F.col("role")).otherwise(F.col("context"))
    return occurrences.select(F.col(slug).alias("source"), F.col("person").alias("target"), "kind", "confidence", context.alias("context"))


def first_of(rows: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of each key, with `rank`. Tasks keep no more than k rows of a key before rows move, so a frequent key is no hot group."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def person_summary(occurrences: DataFrame, slug: str = "slug", k: int = 3) -> DataFrame:
    """person, works, authored, mentions, contexts: how many records name a person, as what, and the first k contexts by record and place."""
    role = F.col("role")
    counts = occurrences.groupBy("person").agg(
        F.count_distinct(slug).alias("works"), F.count_if(role == "author").alias("authored"), F.count_if(role == "body_text_mention").alias("mentions")
    )
    first = first_of(occurrences.filter(role == "body_text_mention"), ["person"], [slug, "at"], k).groupBy("person").agg(F.sort_array(F.collect_list(F.struct("rank", "context"))).alias("c"))
    return counts.join(first, "person", "left").select("person", "works", "authored", "mentions", F.coalesce(F.transform("c", lambda x: x["context"]), F.array().cast("array<string>")).alias("contexts"))
