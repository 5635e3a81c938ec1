"""Collections of header-plus-body files, JSON records, tables, media folders and feeds as DataFrames."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADER = r"(?s)\A---\n(.*?)\n---\n(.*)\z"


def split_entry(text: Column) -> tuple[Column, Column]:
    """Header and body; without a header all is body."""
    has = text.rlike(HEADER)
    return F.when(has, F.regexp_extract(text, HEADER, 1)).otherwise(""), F.when(has, F.regexp_extract(text, HEADER, 2)).otherwise(text)


def header_value(header: Column, field: str) -> Column:
    """A top-level scalar of a header without parsing it; null if absent or empty."""
    return F.nullif(F.regexp_extract(header, rf"(?m)^{field}:[ \t]*[\"']?([^\"'\n]*?)[\"']?[ \t]*$", 1), F.lit(""))


@F.pandas_udf(T.StringType())
def yaml_json(s: pd.Series) -> pd.Series:
    """A YAML header as JSON text; a broken one, or one that is no mapping, as {}."""
    import yaml

    def one(t):
        try:
            value = yaml.safe_load(t or "")
        except yaml.YAMLError:
            value = None
        return json.dumps(value if isinstance(value, dict) else {}, default=str, ensure_ascii=False)

    return s.map(one)


def entries(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """collection, slug, header, body of every markdown file below a folder; with a schema also `fm`, the header as a struct.

    The collection is the folder that holds the file; the slug is the header's id or the file's name.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,mdx}").text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    header, body = split_entry(F.col("value"))
    parts = F.split("path", "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.mdx?$", "")
    out = files.select(F.element_at(parts, -2).alias("collection"), F.coalesce(header_value(header, "id"), stem).alias("slug"), header.alias("header"), body.alias("body"))
    return out.withColumn("fm", F.from_json(yaml_json("header"), schema)) if schema else out


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines; blank, broken and non-object lines go."""
    lines = spark.read.text(path).filter(F.ltrim("value").startswith("{")).filter(F.try_parse_json("value").isNotNull())
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def first_that_parses(rows: DataFrame, keys: list[str], text: str, rank: str) -> DataFrame:
    """keys, record (variant): of several JSON texts the one of least rank that parses."""
    return rows.withColumn("record", F.try_parse_json(text)).filter("record is not null").groupBy(*keys).agg(F.min_by(text, rank).alias("__t")).select(*keys, F.parse_json("__t").alias("record"))


def collection_edges(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Edges of JSON files of the form {edges: [..]}."""
    return spark.read.schema(f"edges array<{schema}>").option("multiLine", True).json(path).select(F.explode("edges").alias("e")).select("e.*")


def confident_links(spark: SparkSession, path: str, confidences: list[str]) -> DataFrame:
    """Rows of a tab-separated manifest with an accepted confidence, a url and no mark as a duplicate."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    return rows.filter(F.col("confidence").isin(confidences) & (F.coalesce("pdf_url", F.lit("")) != "") & ~F.contains(F.upper(F.coalesce("notes", F.lit(""))), F.lit("DUPLICATE")))


def media_manifest(spark: SparkSession, path: str, extensions: list[str]) -> DataFrame:
    """name, extension, size, path of media files below a folder. Only their listing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), ext.alias("extension"), F.col("length").alias("size"), "path").filter(F.col("extension").isin(extensions))


FEED = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "link", "guid", "pubDate", "author", "dc:creator", "description", "content:encoded")] + [T.StructField("category", T.ArrayType(T.StringType()))])


def feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of a feed: those without title or link go; guid falls back on link, author on creator's plain form, content on description."""
    rows = spark.read.format("xml").option("rowTag", "item").schema(FEED).load(path)
    return rows.filter((F.coalesce("title", F.lit("")) != "") & (F.coalesce("link", F.lit("")) != "")).select(
        "title", "link", F.coalesce("guid", "link").alias("guid"), "pubDate", F.coalesce("`dc:creator`", "author").alias("author"), "description", F.coalesce("`content:encoded`", "description").alias("content_html"), F.coalesce("category", F.array().cast("array<string>")).alias("categories")
    )


def mined_entities(sources: list[tuple[str, DataFrame]], key, least: int = 5) -> DataFrame:
    """key, name, sources, confidence: names of several sources in order of precedence; short keys go. Two sources make one canonical."""
    rows = None
    for i, (label, df) in enumerate(sources):
        part = df.select(F.col("name"), F.lit(label).alias("source"), F.lit(i).alias("rank"))
        rows = part if rows is None else rows.unionByName(part)
    keyed = rows.withColumn("key", key(F.col("name"))).filter(F.char_length("key") >= least)
    out = keyed.groupBy("key").agg(F.min_by("name", F.struct("rank", "name")).alias("name"), F.array_sort(F.collect_set("source")).alias("sources"))
    return out.withColumn("confidence", F.when(F.size("sources") >= 2, "canonical").otherwise(F.element_at("sources", 1)))


def byline_of_file_name(name: Column) -> Column:
    """What follows -by- in a file name, up to a date or -on-; null if it can't be a name."""
    months = "january|february|march|april|may|june|july|august|september|october|november|december"
    raw = F.regexp_extract(F.lower(name), rf"-by-(.+?)(?=-(?:{months}|(?:19|20)\d\d|on)(?:-|\.|$)|\.[a-z]+$|$)", 1)
    words = F.filter(F.split(raw, "[-_]"), lambda w: w != "")
    ok = (F.char_length(raw) >= 4) & F.size(words).between(2, 6) & ~raw.rlike(r"\d{3}|various|unknown")
    return F.when(ok, F.initcap(F.array_join(words, " ")))
