"""Rules of the archive: routing, promotion, labels, stubs, migrations, mentions, redirects."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from folio.operators.merge import is_empty


def linked(references: list[Column], arrays: list[Column]) -> Column:
    """Whether any scalar or list of references is filled."""
    out = F.lit(False)
    for c in references:
        out = out | ~is_empty(c)
    for c in arrays:
        out = out | (F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0)
    return out


def route_category(categories: Column, dropped: list[str], mapped: dict[str, str], wrappers: list[str], default: str) -> Column:
    """A dropped category: null. Else the first mapped one's collection. Only wrappers: null. None at all: the default. Else null."""
    known = F.create_map(*[F.lit(x) for kv in mapped.items() for x in kv])
    first = F.try_element_at(F.filter(F.transform(categories, lambda c: F.try_element_at(known, c)), lambda x: x.isNotNull()), F.lit(1))
    none = F.lit(None).cast("string")
    return F.when(F.exists(categories, lambda c: c.isin(dropped)), none).when(first.isNotNull(), first).when(F.size(categories) == 0, F.lit(default)).when(F.forall(categories, lambda c: c.isin(wrappers)), none).otherwise(none)


def language_of(primary: Column, secondary: Column, codes: dict[str, str], default: str = "en") -> Column:
    """The code of the first term that has one. The second taxonomy counts only where the first is empty."""
    known = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    terms = F.when(F.coalesce(F.size(primary), F.lit(0)) > 0, primary).otherwise(secondary)
    return F.coalesce(F.try_element_at(F.filter(F.transform(terms, lambda t: F.try_element_at(known, t)), lambda c: c.isNotNull()), F.lit(1)), F.lit(default))


def title_of(*shapes: Column) -> Column:
    """The first filled shape of a title."""
    return F.coalesce(*[F.when(~is_empty(c), c) for c in shapes])


def wants_curator(vision: Column, confidence: Column, stubs: Column, collisions: Column, method: Column, authors: Column) -> Column:
    """Nulls don't ask for a curator, except as nobody named by a method that ran."""
    no = lambda c: F.coalesce(c, F.lit(False))
    return no(vision) | no(confidence != "high") | no(F.size(stubs) > 0) | no(F.size(collisions) > 0) | (method.isNotNull() & (F.coalesce(F.size(authors), F.lit(0)) <= 0))


def real_name(name: Column, markers: list[str]) -> Column:
    """Neither short nor long, of five words at most, without ? and !, and without a marker anywhere in it, letter for letter."""
    words = F.size(F.split(F.trim(F.regexp_replace(name, r"\s+", " ")), " "))
    out = F.char_length(name).between(3, 60) & ~name.rlike(r"[?!]") & (words <= 5)
    for m in markers:
        out = out & ~F.contains(F.lower(name), F.lit(m))
    return out


def route_roles(matches: Column) -> Column:
    """array<struct<slug, role>> -> struct<authors, contributors>, each in order and once."""
    slugs = lambda keep: F.array_distinct(F.transform(F.filter(matches, keep), lambda m: m["slug"]))
    is_author = lambda m: F.coalesce(m["role"], F.lit("author")) == "author"
    return F.struct(slugs(is_author).alias("authors"), slugs(lambda m: ~is_author(m)).alias("contributors"))


def promote_authors(authors: Column, contributors: Column) -> Column:
    """Contributors in the role of an author join the authors, after them and once."""
    return F.array_distinct(F.concat(authors, F.transform(F.filter(contributors, lambda c: c["role"] == "author"), lambda c: c["slug"])))


def within(value: Column, allowed: list[str], default: str) -> Column:
    return F.when(value.isin(allowed), value).otherwise(F.lit(default))


def split_labels(themes: Column, labels: dict[str, str]) -> Column:
    """struct<themes, channel>: themes that are channel labels go; the first of them names the channel."""
    names = F.array(*[F.lit(x) for x in labels])
    to = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    first = F.try_element_at(F.filter(themes, lambda x: F.array_contains(names, x)), F.lit(1))
    return F.struct(F.array_except(themes, names).alias("themes"), F.try_element_at(to, first).alias("channel"))


#: What marks a body that was recognised page by page.
OCR_MARKERS = ["## Original text", "OCR", "## Page "]


def reset_body(body: Column, placeholder: str, markers: list[str] = OCR_MARKERS) -> tuple[Column, Column]:
    """A body with any of the markers is replaced and must be extracted anew."""
    hit = F.lit(False)
    for m in markers:
        hit = hit | F.coalesce(F.contains(body, F.lit(m)), F.lit(False))
    return F.when(hit, F.lit(placeholder)).otherwise(body), hit


def year_hint(works: DataFrame, key: str, parent: str, year: str, inferred: str, published: str) -> DataFrame:
    """key, hint, via: the year of the work that an excerpt comes from, else the inferred one, else that of publication."""
    source = works.select(F.col(key).alias("__k"), F.col(year).alias("__y"))
    j = works.join(source, F.col(parent) == F.col("__k"), "left")
    hint = F.coalesce("__y", inferred, published)
    return j.select(key, hint.alias("hint"), F.when(F.col("__y").isNotNull(), "source-work").when(F.col(inferred).isNotNull(), "inferred").when(F.col(published).isNotNull(), "published").otherwise("none").alias("via"))


def project_mentions(mentions: Column, excluded: Column) -> Column:
    """Resolved mentions less those who wrote, edited or contributed, in first-seen order."""
    return F.array_except(F.array_distinct(F.filter(mentions, lambda m: m.isNotNull())), excluded)


def stubs(matches: DataFrame, authority: DataFrame, key: str, origin: str) -> DataFrame:
    """key, outcome of each distinct match: reference for a pipeline stub, collision for a curated entry, created for an unknown one."""
    have = authority.select(F.col(key).alias("__k"), F.col(origin).alias("__o"), F.lit(True).alias("__there"))
    j = matches.select(key).distinct().join(have, F.col(key) == F.col("__k"), "left")
    return j.select(key, F.when(F.col("__there").isNull(), "created").when(F.col("__o") == "pipeline", "reference").otherwise("collision").alias("outcome"))


def demote_unknown(display: Column, slug: Column, known: Column) -> Column:
    """struct<thinker, unresolved>: a known slug refers; else the display text, or the slug in words, stays as text."""
    text = F.coalesce(F.nullif(F.trim(display), F.lit("")), F.initcap(F.replace(slug, F.lit("-"), F.lit(" "))))
    return F.struct(F.when(known, slug).alias("thinker"), F.when(~known, text).alias("unresolved"))


def latest_by_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Whole rows, the last of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).filter("__n = 1").drop("__n")


def additions_merged(old: Column, new: Column) -> Column:
    """Recommendations array<struct<kind, verbatim>>, those of one kind whose words differ only in case or blanks around them once, the first of them."""
    key = lambda x: F.concat_ws("\n", F.lower(x["kind"]), F.lower(F.trim(x["verbatim"])))
    both = F.filter(F.concat(old, new), lambda x: F.trim(x["verbatim"]) != "")
    keys = F.transform(both, key)
    return F.filter(both, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def with_self(translations: Column, lang: Column, id_: Column) -> Column:
    """A map of translations with the entry itself, which replaces one of its own language."""
    return F.map_concat(F.map_filter(translations, lambda k, _: k != lang), F.create_map(lang, id_))


def pruned_json(**fields: Column) -> Column:
    """JSON without nulls, empty texts and empty lists."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def filled(c: Column, many: bool = False) -> Column:
    return F.when(F.size(c) > 0, c) if many else F.when(c != "", c)


@F.pandas_udf(T.StructType([T.StructField("record", T.StringType()), T.StructField("fixed", T.ArrayType(T.StringType()))]))
def fix_confidence(s: pd.Series) -> pd.DataFrame:
    """A JSON record with every {value, confidence} whose confidence isn't of the enumeration set to low, at any depth, and the paths."""

    def walk(v, path, fixed):
        if isinstance(v, dict):
            if "value" in v and "confidence" in v and v["confidence"] not in ("high", "medium", "low"):
                v["confidence"] = "low"
                fixed.append(path or "$")
            for k, x in v.items():
                walk(x, f"{path}.{k}" if path else k, fixed)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, f"{path}[{i}]", fixed)

    out = []
    for t in s:
        fixed: list[str] = []
        try:
            value = json.loads(t) if t is not None else None
        except ValueError:
            out.append((t, fixed))
            continue
        walk(value, "", fixed)
        out.append((json.dumps(value, ensure_ascii=False, sort_keys=True) if t is not None else None, fixed))
    return pd.DataFrame(out, columns=["record", "fixed"])
