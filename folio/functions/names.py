"""Name and text normalisers N1 to N11. They look alike and differ; a join must use one on both sides.

Column functions throughout. Unicode decomposition is no built-in of Spark, so the four that fold accents take it from
an Arrow UDF and belong on short columns such as names and titles.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Honorifics that N7 drops anywhere, and that N8 strips from the front.
HONORIFICS_ANYWHERE = ["prof", "dr", "mr", "mrs", "ms", "shri", "sri", "sir", "lord", "lady", "the late"]
HONORIFICS_LEADING = ["prof", "dr", "sir", "mr", "mrs", "ms", "smt", "shri", "the hon", "lord", "justice"]
#: Typographic marks and their plain forms.
PLAIN_MARKS = {"“": '"', "”": '"', "‘": "'", "’": "'", "–": "-", "—": "-"}


@F.pandas_udf(T.StringType())
def ascii_fold(s: pd.Series) -> pd.Series:
    """Compatibility decomposition, then only what ASCII has."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


@F.pandas_udf(T.StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    """Marks go, whatever letter they are on; letters of their own such as ß and ø stay, unlike with `ascii_fold`. As DuckDB's strip_accents."""
    bare = lambda x: "".join(ch for ch in unicodedata.normalize("NFD", x) if unicodedata.category(ch)[0] != "M")
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", bare(x)))


@F.pandas_udf(T.StringType())
def compose(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def hyphenate(c: Column) -> Column:
    """Runs of anything but a-z and 0-9 become one hyphen; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def n1_slug(c: Column, untitled: bool = False, fold: Callable[[Column], Column] = ascii_fold) -> Column:
    out = hyphenate(fold(c))
    return F.coalesce(F.nullif(out, F.lit("")), F.lit("untitled")) if untitled else out


def n2_kebab(c: Column) -> Column:
    return hyphenate(c)


def n3_vocab_key(c: Column) -> Column:
    """Keeps punctuation, which the slug check refuses later."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[_\s]+", "-"), "-+", "-")


def n4_alias_key(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(c), r"[.,\-]", " "), "['’]", ""))


def n5_seed_key(c: Column, fold: Callable[[Column], Column] = ascii_fold) -> Column:
    """Unlike N4, full stops and commas go without leaving a space."""
    return squeeze(F.regexp_replace(F.lower(fold(c)), "[.,]", ""))


def n6_letters(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", ""))


def n7_duplicate_key(c: Column) -> Column:
    """Honorifics go wherever they stand, punctuation becomes space, and runs of single letters become one word."""
    no_titles = F.regexp_replace(F.lower(F.trim(c)), rf"\b({'|'.join(HONORIFICS_ANYWHERE)})\b\.?", "")
    words = squeeze(F.regexp_replace(no_titles, r"[.,'’\-–—/]", " "))
    return F.regexp_replace(words, r"(?<=\b\p{L}) (?=\p{L}\b)", "")


def n8_mention_key(c: Column) -> Column:
    front = rf"(?i)^(?:(?:{'|'.join(HONORIFICS_LEADING)})\.?\s+){{1,3}}"
    return squeeze(F.replace(F.lower(squeeze(F.regexp_replace(F.trim(c), front, ""))), F.lit("."), F.lit("")))


def n9_title_key(c: Column) -> Column:
    """The article goes before the trimming, so one after a quotation mark stays."""
    spaced = F.regexp_replace(F.lower(ascii_fold(c)), r"\p{Punct}", " ")
    return squeeze(F.regexp_replace(spaced, r"^(the|a|an)\s+", ""))


def n10_quote_text(c: Column) -> Column:
    for mark, plain in PLAIN_MARKS.items():
        c = F.replace(c, F.lit(mark), F.lit(plain))
    return squeeze(F.regexp_replace(c, "[*_`>~]", ""))


def n11_quote_text(c: Column) -> Column:
    return n10_quote_text(compose(c))


def n11_quote_key(c: Column) -> Column:
    """The quote's side: closing marks go, then quotation marks around it."""
    return F.regexp_replace(F.regexp_replace(n11_quote_text(c), "[.,;:।]+$", ""), "^[\"']+|[\"']+$", "")


def surname_of_slug(c: Column) -> Column:
    return F.element_at(F.split(c, "-"), -1)


def sort_name(c: Column) -> Column:
    """Last word first; a suffix stays with the surname."""
    words = F.split(squeeze(c), " ")
    n = F.size(words)
    suffix = F.element_at(words, -1).rlike(r"(?i)^(jr|sr|ii|iii|iv)\.?$") & (n > 2)
    tail = F.when(suffix, F.concat_ws(" ", F.slice(words, n - 1, 2))).otherwise(F.element_at(words, -1))
    head = F.slice(words, F.lit(1), n - F.when(suffix, 2).otherwise(1))
    return F.when(n < 2, squeeze(c)).otherwise(F.concat(tail, F.lit(", "), F.concat_ws(" ", head)))
