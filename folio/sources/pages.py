"""Scraped pages: links and details."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.values import first_year


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, link: the distinct site-relative targets of anchors, without query and fragment."""
    found = F.array_distinct(F.regexp_extract_all(html, F.lit(r'<a\s+href="(/[^"#?]*)'), 1))
    return pages.select(key, F.explode(found).alias("link"))


def details(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """key, title, heading, host, pdf (the first link to one), year (of the title, else of the first 2000 characters), byline (the first 500)."""
    pick = lambda p: F.regexp_extract(html, p, 1)
    title, heading = pick(r"(?is)<title>(.*?)</title>"), pick(r"(?is)<h1[^>]*>(.*?)</h1>")
    body = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1>|<!--.*?-->", " "), "<[^>]+>", " "), r"\s+", " "))
    name = F.coalesce(F.nullif(F.trim(heading), F.lit("")), title)
    return pages.select(
        key,
        title.alias("title"),
        heading.alias("heading"),
        F.regexp_extract(url, r"^https?://([^/?#]*)", 1).alias("host"),
        F.nullif(pick(r'(?i)href="([^"#?]+\.pdf)["#?]'), F.lit("")).alias("pdf"),
        F.coalesce(first_year(name), first_year(F.substring(body, 1, 2000))).alias("year"),
        F.substring(body, 1, 500).alias("byline"),
    )
