"""Dates, numbers, arrays, maps and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first year after each period.
PERIODS = [(1948, "pre-independence"), (1965, "nehruvian-era"), (1985, "late-license-raj"), (2005, "reform-era")]


def first_year(c: Column) -> Column:
    """The first year from 1900 to 2099 that stands alone in a text."""
    return F.expr("try_cast(null as int)") if c is None else F.nullif(F.regexp_extract(c, r"\b((?:19|20)\d{2})\b", 1), F.lit("")).cast("int")


def year_of(c: Column) -> Column:
    """The year of an ISO date, else the first year in the text."""
    return F.coalesce(F.year(F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd"))), first_year(c))


def rfc822(c: Column) -> Column:
    """A feed's date; null if it can't be read."""
    numeric = F.regexp_replace(F.regexp_replace(c, r"^\s*[A-Za-z]{3},\s*", ""), r"(?:GMT|UTC?|Z)\s*$", "+0000")
    return F.try_to_timestamp(numeric, F.lit("d MMM yyyy HH:mm:ss Z"))


def reset_seconds(c: Column, now: Column) -> Column:
    """Seconds until a clock time such as `resets 4:10am (Asia/Kolkata)`, half a minute added, 25 hours at most."""
    g = lambda k: F.regexp_extract(c, r"(?i)resets\s+(\d{1,2})(?::(\d{2}))?\s*(am|pm)\s*\(([^)]+)\)", k)
    hour = (g(1).try_cast("int") % 12) + F.when(F.lower(g(3)) == "pm", 12).otherwise(0)
    minute = F.coalesce(g(2).try_cast("int"), F.lit(0))
    zone = F.nullif(g(4), F.lit(""))
    local = F.from_utc_timestamp(now, zone)
    at = F.make_timestamp(F.year(local), F.month(local), F.dayofmonth(local), hour, minute, F.lit(0))
    wait = F.unix_seconds(at) - F.unix_seconds(local)
    return F.least(F.when(wait <= 0, wait + 86400).otherwise(wait) + 30, F.lit(25 * 3600))


def period_of(year: Column) -> Column:
    out = F.when(year.isNull(), F.lit(None).cast("string"))
    for end, name in PERIODS:
        out = out.when(year < end, name)
    return out.otherwise("post-reform")


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def decade_label(year: Column) -> Column:
    return F.coalesce(F.concat(decade(year).cast("string"), F.lit("s")), F.lit("Undated"))


def clamp(arr: Column, n: int) -> Column:
    return F.slice(arr, 1, n)


def expand_aliases(values: Column, alias_map: Column, canonical: Column) -> Column:
    """Each value or what it stands for, only canonical ones, sorted."""
    many = F.flatten(F.transform(values, lambda x: F.coalesce(F.try_element_at(alias_map, x), F.array(x))))
    return F.array_sort(F.array_distinct(F.array_intersect(many, canonical)))


def jaccard(a: Column, b: Column) -> Column:
    """Two empty arrays are alike."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def page_windows(total: Column, step: int = 20) -> Column:
    """Runs of pages, 1 to `step` and so on, as array<struct<lo, hi>>."""
    starts = F.when(total > 0, F.sequence(F.lit(1), total, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("lo"), F.least(s + step - 1, total).alias("hi")))


def unwrap(v: Column) -> Column:
    """The value of a variant {value, ..} or {verbatim, ..}, or of a plain string."""
    return F.coalesce(F.try_variant_get(v, "$.value", "string"), F.try_variant_get(v, "$.verbatim", "string"), F.try_variant_get(v, "$", "string"), F.lit(""))


def ordered_union(*arrays: Column) -> Column:
    return F.array_distinct(F.concat(*arrays))


def label_dates(born: Column, died: Column) -> Column:
    """`b–d`, `b. y` or nothing."""
    return F.when(born.isNotNull() & died.isNotNull(), F.concat_ws("–", born.cast("string"), died.cast("string"))).when(born.isNotNull(), F.concat(F.lit("b. "), born.cast("string"))).otherwise("")
