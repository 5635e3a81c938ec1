"""Validators that return what is left and what was wrong, coverage, agreement and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLUG = r"^[a-z][a-z0-9]*(-[a-z0-9]+)*$"


def reasons(named: dict[str, Column]) -> Column:
    """Names of the conditions that hold, in order; null conditions don't."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named.items()]))


def split_vocabulary(values: Column, vocabulary: Column) -> Column:
    """struct<kept, proposed, dropped>: known values sorted; others of slug shape; the rest."""
    others = F.array_except(F.array_distinct(values), vocabulary)
    return F.struct(
        F.array_sort(F.array_intersect(values, vocabulary)).alias("kept"),
        F.array_sort(F.filter(others, lambda v: v.rlike(SLUG))).alias("proposed"),
        F.array_sort(F.filter(others, lambda v: ~v.rlike(SLUG))).alias("dropped"),
    )


def validate_record(df: DataFrame, vocabulary: list[str], this_year: int, stances: list[str]) -> DataFrame:
    """Soft validation of id, themes, key_concepts, pull_quote, stance, source_year: clean STRUCT (null if a hard rule breaks) and warnings."""
    known = F.array(*[F.lit(v) for v in vocabulary])
    parts = split_vocabulary(F.coalesce("themes", F.array().cast("array<string>")), known)
    quote_ok = F.char_length("pull_quote").between(50, 250)
    year_ok = F.col("source_year").between(1800, this_year + 1)
    clean = F.struct(
        F.col("id"),
        parts["kept"].alias("themes"),
        parts["proposed"].alias("proposed_themes"),
        F.slice(F.array_distinct(F.coalesce("key_concepts", F.array().cast("array<string>"))), 1, 5).alias("key_concepts"),
        F.when(quote_ok, F.col("pull_quote")).alias("pull_quote"),
        F.when(F.col("stance").isin(stances), F.col("stance")).alias("stance"),
        F.when(year_ok, F.col("source_year")).alias("source_year"),
    )
    warn = reasons(
        {
            "theme-proposed": F.size(parts["proposed"]) > 0,
            "theme-dropped": F.size(parts["dropped"]) > 0,
            "quote-length": ~quote_ok,
            "stance-unknown": F.col("stance").isNotNull() & ~F.col("stance").isin(stances),
            "year-range": ~year_ok,
        }
    )
    hard = F.col("id").isNull() | F.col("themes").isNull()
    return df.select("*", F.when(~hard, clean).alias("clean"), F.when(hard, F.array(F.lit("hard-error"))).otherwise(warn).alias("warnings"))


def strict_errors(named: dict[str, Column]) -> Column:
    """Error names where the check isn't true; null counts as an error."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in named.items()]))


def coerce(value: Column, allowed: list[str], aliases: dict[str, str], default: str, field: str) -> tuple[Column, Column]:
    """The value in the enumeration, and struct<field, original, coerced, rule> where it was changed."""
    alias = F
    for k, v in aliases.items():
        alias = alias.when(F.lower(F.trim(value)) == k, v)
    alias = alias.otherwise(F.lit(None)) if aliases else F.lit(None).cast("string")
    out = F.when(value.isin(allowed), value).when(alias.isNotNull(), alias).otherwise(F.lit(default))
    rule = F.when(alias.isNotNull(), "alias").otherwise("default")
    return out, F.when(~F.coalesce(value.isin(allowed), F.lit(False)), F.struct(F.lit(field).alias("field"), value.alias("original"), out.alias("coerced"), rule.alias("rule")))


def page_order(entries: Column, total: Column) -> Column:
    """Entries array<struct<page_start, page_end>>: an end before its start goes, pages past the total go; with flags."""
    return F.transform(
        entries,
        lambda e: e.withField("page_end", F.when((e["page_end"] < e["page_start"]) | (e["page_end"] > total), F.lit(None)).otherwise(e["page_end"]))
        .withField("page_start", F.when(e["page_start"] > total, F.lit(None)).otherwise(e["page_start"]))
        .withField("overflow", F.coalesce((e["page_start"] > total) | (e["page_end"] > total), F.lit(False)))
        .withField("reversed", F.coalesce(e["page_end"] < e["page_start"], F.lit(False))),
    )


def coverage(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    """dimension, populated, total, percent (whole, rounded down) in one pass."""
    one = df.agg(F.count(F.lit(1)).alias("__total"), *[F.count_if(c).alias(n) for n, c in named.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(n).alias("populated")) for n in named])
    return one.select(F.explode(pairs).alias("p"), "__total").select("p.dimension", "p.populated", F.col("__total").alias("total"), F.floor(100 * F.col("p.populated") / F.greatest(F.col("__total"), F.lit(1))).alias("percent"))


def agreement(pairs: DataFrame, named: dict[str, Column], gate: float = 80.0) -> DataFrame:
    """axis, percent, passed over joined predictions."""
    one = pairs.agg(*[F.round(100 * F.avg(F.coalesce(c, F.lit(False)).cast("int")), 1).alias(n) for n, c in named.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("axis"), F.col(n).alias("percent")) for n in named])).alias("p")).select("p.axis", "p.percent", (F.col("p.percent") >= gate).alias("passed"))


def toc_drift(old: DataFrame, new: DataFrame, keys: list[str], title: str, page: str, shift: int = 5) -> DataFrame:
    """keys and the reasons why an entry moved: missing, title, page."""
    other = new.select(*keys, F.col(title).alias("__t"), F.col(page).alias("__p"), F.lit(True).alias("__there"))
    found = reasons({"missing": F.col("__there").isNull(), "title": F.col(title) != F.col("__t"), "page": F.abs(F.col(page) - F.col("__p")) >= shift})
    return old.join(other, keys, "left").select(*keys, found.alias("drift")).filter(F.size("drift") > 0)


#: Patterns of an article's title among names.
TITLE_PATTERNS = [" - ", " on ", ": ", " – ", r"\?", "!"]
#: How such titles start; an archive adds its own.
TITLE_STARTS = ["how i ", "the new ", "an auxiliary"]


def fake_name(name: Column, starts: list[str] = TITLE_STARTS) -> Column:
    """The first reason why a name looks like a title, else null."""
    words = F.size(F.split(F.regexp_replace(name, r"^\s+|\s+$", ""), r"\s+"))
    out = F.when(F.coalesce(name, F.lit("")) == "", F.lit(None).cast("string")).when(words > 5, F.concat_ws(" ", F.lit("name is"), words.cast("string"), F.lit("words")))
    for pattern in TITLE_PATTERNS:
        out = out.when(name.rlike(pattern), f"matches title pattern '{pattern.strip()}'")
    for start in starts:
        out = out.when(F.lower(F.regexp_replace(name, r"^\s+", "")).startswith(start), f"starts with article phrase '{start}'")
    return out.when(F.char_length(name) > 60, F.concat_ws(" ", F.lit("name is"), F.char_length(name).cast("string"), F.lit("chars long"))).otherwise(F.lit(None).cast("string"))
