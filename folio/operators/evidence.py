"""Mentions whose quotes must stand in the entry's text: what is kept of each, and why the rest is dropped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUOTES = 80  # characters of a quote in the log


def verified(entries: DataFrame, key: str, authority: DataFrame, slug: str, normal_body: Callable[[Column], Column], normal_quote: Callable[[Column], Column]) -> DataFrame:
    """key, kept, dropped, related of each entry(key, body, byline_authors, self_referents, mentions).

    mentions: array<struct<thinker_id, role, reasoning, evidence: array<struct<quote, context>>, key_passages: array<struct<quote, what_it_shows>>>>.
    People that the authority lacks and byline authors go. A quote stays if it stands in the body, both normalised; each that
    doesn't is logged. A subject without a passage left goes, and so does a mention or an author without evidence left.
    `dropped` is array<struct<thinker, reason, quote>>; `related` are the people kept less the entry's own.

    Bodies are normalised once an entry and never copied: only slugs meet the authority, and what it knows of an entry's comes back as one array.
    """
    asked = entries.select(key, F.explode(F.array_distinct("mentions.thinker_id")).alias("__s"))
    known = asked.join(authority.select(F.col(slug).alias("__s")).distinct(), "__s").groupBy(key).agg(F.collect_set("__s").alias("__known"))
    rows = entries.join(known, key, "left").withColumn("__known", F.coalesce("__known", F.array().cast("array<string>")))
    role = lambda m: F.coalesce(m["role"], F.lit("mention"))
    none = F.array().cast("array<struct<thinker:string,reason:string,quote:string>>")
    mention_type = entries.schema["mentions"].dataType.elementType
    empty = {c: F.array().cast(mention_type[c].dataType.simpleString()) for c in ("evidence", "key_passages")}

    def said(thinker: Column, reason: Column | str, quote: Column | None = None) -> Column:
        return F.struct(thinker.alias("thinker"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), F.left(F.lit("") if quote is None else quote, F.lit(QUOTES)).alias("quote"))

    def judged(m: Column, body: Column) -> Column:
        found = lambda q: F.coalesce(F.contains(body, F.nullif(normal_quote(q["quote"]), F.lit(""))), F.lit(False))
        marked = lambda c: F.transform(c, lambda q: F.struct(q.alias("q"), found(q).alias("ok")))
        return F.struct(m.alias("m"), marked(F.coalesce(m["evidence"], empty["evidence"])).alias("e"), marked(F.coalesce(m["key_passages"], empty["key_passages"])).alias("p"))

    def outcome(j: Column) -> Column:
        m = j["m"]
        good = lambda c: F.transform(F.filter(c, lambda x: x["ok"]), lambda x: x["q"])
        bad = lambda c, reason: F.transform(F.filter(c, lambda x: ~x["ok"]), lambda x: said(m["thinker_id"], reason, x["q"]["quote"]))
        evidence, passages = good(j["e"]), good(j["p"])
        stranger, own = ~F.array_contains(F.col("__known"), F.coalesce(m["thinker_id"], F.lit(""))), F.array_contains(F.coalesce("byline_authors", F.array().cast("array<string>")), F.coalesce(m["thinker_id"], F.lit("")))
        bare = ((role(m) == "subject") & (F.size(passages) == 0)) | (role(m).isin("mention", "author") & (F.size(evidence) == 0))
        log = F.concat(bad(j["e"], "evidence"), bad(j["p"], "key_passage"))
        kept = F.struct(m["thinker_id"].alias("thinker"), role(m).alias("role"), F.coalesce(m["reasoning"], F.lit("")).alias("reasoning"), evidence.alias("evidence"), passages.alias("key_passages"))
        return F.struct(
            F.when(~stranger & ~own & ~bare, kept).alias("kept"),
            F.when(stranger, F.array(said(m["thinker_id"], "unknown"))).when(own, F.array(said(m["thinker_id"], "byline"))).otherwise(F.concat(log, F.when(bare, F.array(said(m["thinker_id"], "unproved"))).otherwise(none))).alias("dropped"),
        )

    mentions = F.coalesce("mentions", F.array().cast(entries.schema["mentions"].dataType.simpleString()))
    # the body is bound to a name before the mentions are walked, so it is normalised once
    bodies = F.array(F.coalesce(normal_body(F.col("body")), F.lit("")))
    results = F.flatten(F.transform(bodies, lambda b: F.transform(mentions, lambda m: outcome(judged(m, b)))))
    made = rows.select(key, "self_referents", results.alias("r"))
    kept = F.filter(F.transform("r", lambda x: x["kept"]), lambda x: x.isNotNull())
    made = made.select(key, "self_referents", kept.alias("kept"), F.flatten(F.transform("r", lambda x: x["dropped"])).alias("dropped"))
    related = F.array_sort(F.array_except(F.array_distinct(F.transform("kept", lambda x: x["thinker"])), F.coalesce("self_referents", F.array().cast("array<string>"))))
    return made.select(key, "kept", "dropped", related.alias("related"))
