"""Author notes at the end of a body: found, taken out, linked to contributors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.names import ascii_fold

#: The forms of a note.
PHOTO = r"!\[\]\((https?://[^)]+\.(?:jpg|jpeg|png|webp))\)\s*\n+\s*\*\*([^*\n]+?)\s*\*\*\s*\n+((?:[^\n]+\n?){1,15})"
NAMED = r"\n\*\*([A-Z][A-Za-z. \-]{4,60}?)\s*\*\*\s*\n+([A-Z][^\n]{60,}(?:\n[^\n]+)*+)"
PHOTO_OPENER = r"\n!\[\]\(https?://[^)]+\.(?:jpg|jpeg|png|webp)\)\s*\n+\s*\*\*([^*\n]+?)\s*\*\*\s*\n"
NAMED_OPENER = r"\n\*\*([A-Z][A-Za-z. \-]{4,60}?)\s*\*\*\s*\n+[A-Z][^\n]{60,}"
STRAY_LINK = r"\n\[\]\(https?://[^)]*/attachment/bio/?\)\s*\n"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def every(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def bio_block(body: Column, not_names: list[str], least: int = 80) -> Column:
    """name, bio, photo_url of the last note (headings and titles set in bold that look like names are `not_names`, the archive's own list) of `least` characters or more; one with a photo comes before any without. Null if there is none."""

    def last(names: Column, bios: Column, photos: Column) -> Column:
        both = F.zip_with(names, bios, lambda n, b: F.struct(stripped(n).alias("name"), stripped(b).alias("bio")))
        all_ = F.zip_with(both, photos, lambda x, p: F.struct(x["name"].alias("name"), x["bio"].alias("bio"), p.alias("photo_url")))
        return F.try_element_at(F.filter(all_, lambda x: ~x["name"].isin(not_names) & (F.char_length(x["bio"]) >= least)), F.lit(-1))

    named = every(body, NAMED, 1)
    no_photo = F.transform(named, lambda _: F.lit(None).cast("string"))
    return F.coalesce(last(every(body, PHOTO, 2), every(body, PHOTO, 3), every(body, PHOTO, 1)), last(named, every(body, NAMED, 2), no_photo))


def without_bio(body: Column, not_names: list[str]) -> Column:
    """The body up to its last note, less the empty link that may stand before it. Without a note the body stays."""

    def last_opener(c: Column, pattern: str) -> Column:
        found = F.zip_with(every(c, pattern, 0), every(c, pattern, 1), lambda m, n: F.struct(m.alias("m"), stripped(n).alias("n")))
        return F.try_element_at(F.filter(found, lambda x: ~x["n"].isin(not_names)), F.lit(-1))["m"]

    c = F.regexp_replace(body, STRAY_LINK, "\n")
    opener = F.coalesce(last_opener(c, PHOTO_OPENER), last_opener(c, NAMED_OPENER))
    after = F.call_function("substring_index", c, opener, F.lit(-1))
    before = F.left(c, F.char_length(c) - F.char_length(after) - F.char_length(opener))
    return F.when(opener.isNull(), c).otherwise(F.concat(F.regexp_replace(before, r"\s+\z", ""), F.lit("\n")))


def contributor_slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(ascii_fold(name)), "[^a-z0-9]+", "-"), "^-|-$", "")


def wire_contributors(entries: DataFrame, key: str, body: str, contributors: DataFrame, slug: str) -> DataFrame:
    """key, author: the contributor that the first note with a photo names, else the last without, if there is such a contributor; else null."""
    have = contributors.select(F.col(slug).alias("__s")).distinct()
    photo = F.try_element_at(every(F.col(body), PHOTO_OPENER, 1), F.lit(1))
    named = F.try_element_at(every(F.col(body), NAMED_OPENER, 1), F.lit(-1))
    e = entries.select(key, contributor_slug(photo).alias("__p"), contributor_slug(named).alias("__n"))
    by_photo = e.join(have.withColumnRenamed("__s", "__a"), F.col("__p") == F.col("__a"), "left")
    both = by_photo.join(have.withColumnRenamed("__s", "__b"), F.col("__n") == F.col("__b"), "left")
    return both.select(key, F.coalesce("__a", "__b").alias("author"))
