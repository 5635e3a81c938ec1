"""Profiles of a collection's taxonomy, records for classification, and entries reshaped for another collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import text as tx
from folio.functions import values as vl
from folio.operators.merge import is_empty
from folio.operators.occurrences import first_of


def taxonomy_profile(rows: DataFrame, by: str, key: str, kind: str, url: str, terms: str, k: int = 3) -> DataFrame:
    """by, n, samples, missing, kinds, extensions of each group: its size, its first k keys, rows without a term, and counts by kind and by the url's extension.

    One pass counts by group, kind and extension; samples are picked before rows move, so no group is gathered.
    """
    extension = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"\.([A-Za-z0-9]{1,5})(?:[?#]|$)", 1))
    bare = F.coalesce(F.size(terms), F.lit(0)) <= 0
    cells = rows.groupBy(F.col(by), F.col(kind).alias("__kind"), extension.alias("__ext")).agg(F.count(F.lit(1)).alias("__n"), F.count_if(bare).alias("__bare"))

    def histogram(of: str) -> DataFrame:
        counted = cells.filter(F.coalesce(F.col(of), F.lit("")) != "").groupBy(by, of).agg(F.sum("__n").alias("__n"))
        # as many as there are kinds or extensions
        return counted.groupBy(by).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", of, F.col("__n").cast("string")))), ",").alias(f"{of}s"))

    sizes = cells.groupBy(by).agg(F.sum("__n").alias("n"), F.sum("__bare").alias("missing"))
    first = first_of(rows.select(by, key), [by], [key], k).groupBy(by).agg(F.sort_array(F.collect_list(key)).alias("samples"))
    out = sizes
    for side in (first, histogram("__kind"), histogram("__ext")):
        same = side.withColumnRenamed(by, "__by")
        out = out.join(same, F.col(by).eqNullSafe(F.col("__by")), "left").drop("__by")
    return out.select(by, "n", "samples", "missing", F.coalesce("__kinds", F.lit("")).alias("kinds"), F.coalesce("__exts", F.lit("")).alias("extensions"))


def classification_records(entries: DataFrame, works: DataFrame, key: str, most: int) -> DataFrame:
    """key, collection, title, year_hint, body_excerpt, context of every entry that isn't a draft.

    entries: key, collection, title, body, pub_year, draft, author, subject, excerpt_of; works: work, year. An excerpt from a
    work has that work's year, others their own. The body ends at its last paragraph, else its last line, within `most` characters. The context has what is filled.
    """
    j = entries.join(works.select(F.col("work").alias("__w"), F.col("year").alias("__y")), F.col("excerpt_of") == F.col("__w"), "left")
    hint = F.coalesce(F.when((F.col("collection") == "musings") & (F.col("__y") != 0), F.col("__y")), F.col("pub_year"))
    names = ["author", "subject", "excerpt_of"]
    pairs = F.array_compact(F.array(*[F.when(~is_empty(F.col(c)), F.struct(F.lit(c).alias("key"), F.col(c).alias("value"))) for c in names]))
    return j.filter(~F.coalesce("draft", F.lit(False))).select(key, "collection", "title", hint.alias("year_hint"), tx.cut_at_paragraph(F.col("body"), most).alias("body_excerpt"), F.map_from_entries(pairs).alias("context"))


def interview_as_work(slug: Column, id_: Column, title: Column, subject: Column, published: Column, language: Column, draft: Column, url: Column, status: Column, description: Column) -> dict[str, Column]:
    """An interview's fields in the shape of a work."""
    blank = lambda c: F.when(~is_empty(c), F.trim(c))
    return {
        "id": F.coalesce(F.nullif(id_, F.lit("")), slug), "title": F.struct(F.coalesce(title, slug).alias("main")), "work_type": F.lit("interview"), "authors": F.array_compact(F.array(blank(subject))),
        "publication": F.struct(F.coalesce(F.nullif(language, F.lit("")), F.lit("en")).alias("language"), vl.year_of(published).alias("year")),
        "needs_review": F.lit(True), "draft": F.coalesce(draft, F.lit(False)), "transcript_status": status, "url": blank(url), "description": description,
    }


def migrated(rows: DataFrame, target: DataFrame, key: str, shape: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows reshaped whose key the target lacks, and the keys of those that it has. A source that comes twice with a key moves once, by its shape's order."""
    free = rows.join(target.select(key), key, "left_anti")
    made = free.select(F.col(key).alias("__key"), *[c.alias(n) for n, c in shape.items()])
    return made.withColumnRenamed("__key", "source_key").dropDuplicates(["source_key"]), rows.join(target.select(key), key, "left_semi").select(key)
