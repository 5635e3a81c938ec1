"""Headers edited in place: lines, blocks, links from a manifest. What else a file holds stays as it is, to the letter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.operators.merge import by_rank

HEADER = r"(?s)\A---\n(.*?)\n---\n?(.*)\z"


def parts(c: Column, pattern: str) -> tuple[Column, Column, Column]:
    """Before a pattern's first match at the start of a line, the match with all before it (empty if there is none), and after it."""
    whole = rf"(?s)\A(|.*?\n)(?:{pattern})"
    through = F.regexp_extract(c, whole, 0)
    return F.regexp_extract(c, whole, 1), through, F.substring(c, F.char_length(through) + 1, F.char_length(c))


def ended(c: Column) -> Column:
    return F.concat(c, F.when((c == "") | F.endswith(c, F.lit("\n")), "").otherwise("\n"))


def set_line(header: Column, key: str, line: Column) -> Column:
    """The header with its first `key:` line replaced, or with the line at its end. Null leaves it."""
    before, through, after = parts(header, rf"{key}:[^\n]*")
    new = F.when(through != "", F.concat(before, line, after)).otherwise(F.concat(ended(header), line, F.lit("\n")))
    return F.when(line.isNull(), header).otherwise(new)


def set_block(header: Column, key: str, block: Column) -> Column:
    """The header with its first `key:` block (indented lines, or []) replaced, or with the block at its end. Null leaves it."""
    before, through, after = parts(header, rf"{key}:[ \t]*(?:\[\]|(?:\n[ \t]+[^\n]*)++)\n?")
    made = F.concat(F.regexp_replace(block, r"\s+\z", ""), F.lit("\n"))
    new = F.when(through != "", F.concat(before, made, after)).otherwise(F.concat(ended(header), made))
    return F.when(block.isNull(), header).otherwise(new)


def insert_url(text: Column, url: Column, force: bool = False, field: str = "pdf_url", block: str = "provenance") -> Column:
    """text, status: a link in the header, put after a block or at the end.

    inserted; replaced (only with force); skip-existing; skip-no-frontmatter. A block that ends the header is passed whole, and an
    empty field is one line, though a looser pattern would take the line after it too.
    """
    header, body = F.regexp_extract(text, HEADER, 1), F.regexp_extract(text, HEADER, 2)
    line = F.concat(F.lit(f"{field}: "), url)
    before, through, after = parts(header, rf"{field}:[^\n]*")
    _, passed, rest = parts(header, rf"{block}:\n(?:[ \t]+[^\n]*(?:\n|\z))++")
    at_end = F.concat(F.regexp_replace(header, r"\n+\z", ""), F.lit("\n"), line)
    placed = F.when((passed == "") | (rest == ""), at_end).otherwise(F.concat(passed, line, F.lit("\n"), rest))
    there = F.regexp_like(text, F.lit(HEADER))
    status = F.when(~there, "skip-no-frontmatter").when((through != "") & F.lit(not force), "skip-existing").when(through != "", "replaced").otherwise("inserted")
    new = F.when(status == "replaced", F.concat(before, line, after)).when(status == "inserted", placed)
    return F.struct(F.coalesce(F.concat(F.lit("---\n"), new, F.lit("\n---\n"), body), text).alias("text"), status.alias("status"))


def apply_urls(entries: DataFrame, key: str, text: str, links: DataFrame, accepted: list[str], force: bool = False) -> DataFrame:
    """key, text, status for entries with a usable link.

    links(key, url, confidence, notes, seq): only accepted confidences with a link and without a DUPLICATE note count. Of several for one
    entry the first is inserted and, with force, the last stands in the end.
    """
    usable = links.filter(F.col("confidence").isin(accepted) & (F.coalesce("url", F.lit("")) != "") & ~F.contains(F.coalesce("notes", F.lit("")), F.lit("DUPLICATE")))
    one = by_rank(usable, [key], [F.col("seq").desc() if force else F.col("seq").asc()])
    made = entries.select(key, text).join(one.select(key, "url"), key).select(key, insert_url(F.col(text), F.col("url"), force).alias("__m"))
    return made.select(key, F.col("__m.text").alias(text), "__m.status")


def qualifies_for_entities(body: Column, least: int = 200) -> Column:
    """Whether the prose before the key points and the generator's footer has `least` characters without marks."""
    prose = F.regexp_replace(F.regexp_replace(body, r"(?is)\n##\s+Key\s+points\b.*", ""), r"(?s)\n\*Generated by.*", "")
    plain = F.regexp_replace(F.regexp_replace(prose, "[*_`>#]+", ""), r"\s+", " ")
    return F.coalesce(F.char_length(F.trim(plain)) >= least, F.lit(False))


def preview(content: Column, most: int = 500) -> Column:
    return F.left(F.regexp_replace(F.coalesce(content, F.lit("")), r"\s+", " "), F.lit(most))
