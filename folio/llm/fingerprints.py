"""Document fingerprints by consistent weighted sampling, with DataFrame operations only.

A text's terms are its phrases: stretches that end at a mark or line end, or after a word whose last letter is one of
ENDINGS, so cuts depend on the letters at them and the same phrases come back wherever they are moved; only stretches without
either are cut every 80 characters. A term weighs its number of occurrences times its characters. For each of SAMPLES samples
a term draws r and c from Gamma(2, 1) and b from the unit interval, all from a hash of term and sample;
t = floor(ln w / r + b), and the term with the smallest ln c - r (t - b + 1) wins. Two texts draw the same (term, t) in a
sample with a probability of their generalised Jaccard similarity: the sum over all terms of the lesser weight by that of
the greater.

A fingerprint is SAMPLES times four hexadecimal digits of a hash of (term, t). Empty and null texts have no terms; their
fingerprint is zeros, alike with one another and, but for chance, with nothing else. Equal texts have equal fingerprints.
Repeated rows and rows with a null key stay; next to one another, rows of equal keys stand in the order of their texts, null
keys last. A very long text is one row of many terms, which are counted and drawn for one by one. Extra columns go. An empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.llm.common import ROWS_PER_BUCKET, Scratch

SAMPLES = 48
#: Samples that one pass over a term takes; a term gets a row for each pass. Few at a time keep the generated code small.
AT_ONCE = 4
#: Letters that end a phrase at the end of a word, about one word in five: Latin ones, then as many Greek and Cyrillic ones.
ENDINGS = "gynlcάηιкйы"
#: A phrase: up to 80 characters that end at the first ending, else all up to 80 and the marks after them.
PHRASE = rf"[^.,;|!\n]{{0,78}}?[{ENDINGS}]\x20|[^.,;|!\n]{{1,80}}+[.,;|!\n]*+|[.,;|!\n]++"
#: Gamma draws are the midpoints of this many equally likely parts, found by bits of a hash.
PARTS = 1024
#: Scores are kept in this many steps a unit, above 16 bits of signature.
STEPS = 1 << 28


def gamma_quantiles(parts: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1), whose distribution function is 1 - exp(-x) (1 + x), by Newton's method."""
    u = (np.arange(parts) + 0.5) / parts
    x = np.full(parts, 1.5)
    for _ in range(200):
        x = np.maximum(x - (1 - np.exp(-x) * (1 + x) - u) / (x * np.exp(-x)), x / 10)
    return x


def sample(h: Column, log_weight: Column) -> Column:
    """A long that sorts by the score of a term; h is a hash of term and sample. Its lowest 16 bits are the signature of (term, t)."""
    x = gamma_quantiles(PARTS)
    bits = lambda shift, n: F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << n) - 1))
    pick = lambda table, shift: F.get(F.lit(np.round(table, 6)), bits(shift, 10).cast("int"))
    b = bits(20, 20) / float(1 << 20)
    t = F.floor(log_weight * pick(1 / x, 0) + b)
    score = pick(np.log(x), 10) - pick(x, 0) * (t - b + 1)
    mark = F.shiftrightunsigned(h, 48).bitwiseXOR(t).bitwiseAND(F.lit(0xFFFF))
    return F.shiftleft(F.floor(score * float(STEPS)), 16).bitwiseOR(mark)


def phrases(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PHRASE), 0)


def signatures(terms: DataFrame, keys: list[str], term: str = "term") -> DataFrame:
    """keys and `fingerprint`: the smallest sample of each over a table of (keys, term), repeats counted. A null term stands for a text without terms."""
    weighed = terms.groupBy(*keys, F.xxhash64(term).alias("__h")).agg(F.sum(F.char_length(term)).cast("double").alias("__w")).withColumn("__w", F.log("__w"))
    passes = F.explode(F.sequence(F.lit(0), F.lit(SAMPLES // AT_ONCE - 1))).alias("__pass")
    rows = weighed.select("*", passes)
    draw = lambda i: F.when(F.col("__w").isNotNull(), sample(F.xxhash64("__h", "__pass", F.lit(i)), F.col("__w")))
    least = rows.groupBy(*keys, "__pass").agg(*[F.min(draw(i)).alias(f"__{i}") for i in range(AT_ONCE)])
    digits = F.concat(*[F.lpad(F.lower(F.hex(F.coalesce(F.col(f"__{i}"), F.lit(0)).bitwiseAND(F.lit(0xFFFF)))), 4, "0") for i in range(AT_ONCE)])
    parts = F.array_sort(F.collect_list(F.struct("__pass", digits.alias("digits"))))
    return least.groupBy(*keys).agg(parts.alias("__parts")).select(*keys, F.array_join(F.transform("__parts", lambda p: p["digits"]), "").alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples: an estimate of the generalised Jaccard similarity, 0 to 1."""
    return sum(F.when(F.substring(a, 4 * k + 1, 4) == F.substring(b, 4 * k + 1, 4), 1.0).otherwise(0.0) for k in range(SAMPLES)) / float(SAMPLES)


def fingerprint(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, fingerprint: one row for each row. Each distinct text is drawn for once."""
    named = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__text")).withColumn("__id", F.xxhash64("__text")).withColumn("__n", F.char_length("__text"))
    one = named.groupBy("__id", "__n").agg(F.first("__text").alias("__text"))
    made = signatures(one.select("__id", "__n", F.explode_outer(phrases(F.col("__text"))).alias("term")), ["__id", "__n"])
    return named.select(key, "__id", "__n").join(made, ["__id", "__n"]).select(key, "fingerprint")


KNOTS = 64


def key_buckets(df: DataFrame, key: str) -> tuple[Column, int]:
    """A monotone bucket number of an integer key, with about ROWS_PER_BUCKET rows each, and how many there are.

    KNOTS quantiles come to the driver; between two of them the key is cut evenly.
    """
    n, knots = df.agg(F.count(key), F.percentile_approx(key, [i / KNOTS for i in range(KNOTS + 1)], 1000)).first()
    if not n:
        return F.lit(0), 1
    cuts = sorted(set(knots))
    each = max(1, -(-n // (ROWS_PER_BUCKET // 10 * KNOTS)))
    at = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(key)))
    low = F.element_at(F.array(*[F.lit(c) for c in [cuts[0], *cuts]]), at + 1)
    high = F.element_at(F.array(*[F.lit(c) for c in [*cuts, cuts[-1]]]), at + 1)
    inside = F.floor((F.col(key) - low).cast("double") / F.greatest(F.lit(1), high - low) * each)
    return (at * each + F.least(F.lit(each - 1), F.greatest(F.lit(0), inside))).cast("long"), (len(cuts) + 1) * each


def with_next(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, text, bucket, turned, next_text, place: each document and the one next to it in descending key, after the last the first.

    Keys are integers. Texts are dealt out once, by a bucket of neighbouring keys; the first row of each bucket is also sent
    to the bucket above, where it comes last (`turned` is 1), and the first of all to the lowest bucket (2). Null keys stand
    in the lowest bucket of all. Rows of one key are in the order of their texts' hashes; equal rows in any. `place` counts
    the rows of a bucket.
    """
    named = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text)).withColumn("__h", F.xxhash64(text))
    bucket, _ = key_buckets(named, key)
    named = named.withColumn("bucket", F.coalesce(bucket, F.lit(-1)))
    first = F.struct(F.col(key).isNotNull().alias("some"), F.col(key).alias("key"), F.col("__h").alias("h"))
    tops = named.groupBy("bucket").agg(F.max(first).alias("t"))
    # a row for each bucket: some thousands for each ten million documents
    w = Window.orderBy("bucket")
    tops = tops.select(F.col("t.key").alias("__top"), F.col("t.h").alias("__top_h"), F.col("bucket").alias("__b"), F.lead("bucket").over(w).alias("__above"), F.min("bucket").over(Window.partitionBy(F.lit(0))).alias("__lowest"))
    tops = tops.select("__top", "__top_h", "__b", F.coalesce("__above", "__lowest").alias("__to"), F.col("__above").isNull().alias("__wraps"))
    # written, so that its size is known and a small one spares the texts another exchange
    tops = Scratch(df.sparkSession, "fingerprints").save(tops, "tops")
    sent = named.join(tops, (F.col("bucket") == F.col("__b")) & F.col(key).eqNullSafe(F.col("__top")) & (F.col("__h") == F.col("__top_h")), "left")
    own = F.struct(F.col("bucket"), F.lit(0).alias("turned"))
    other = F.struct(F.col("__to").alias("bucket"), F.when(F.col("__wraps"), 2).otherwise(1).alias("turned"))
    dealt = sent.select(key, text, "__h", F.explode(F.when(F.col("__to").isNull(), F.array(own)).otherwise(F.array(own, other))).alias("s")).select(key, text, "__h", "s.bucket", "s.turned")
    down = Window.partitionBy("bucket").orderBy("turned", F.col(key).desc_nulls_last(), F.col("__h").desc())
    return dealt.withColumn("next_text", F.lead(text).over(down)).withColumn("place", F.row_number().over(down)).drop("__h")


def compare_with_edited(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last third is the beginning of the next document, and their likeness.

    Everything after the one exchange of texts stays inside the bucket; a row is known there by its place.
    """
    rows = with_next(df, text, key)
    third = F.floor(F.char_length(text) / 3).cast("int")
    edited = F.concat(F.expr(f"substring(`{text}`, 1, char_length(`{text}`) - cast(floor(char_length(`{text}`) / 3) as int))"), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third))
    rows = rows.select("bucket", "place", "turned", key, F.char_length(text).cast("long").alias("n_chars"), F.col(text).alias("a"), F.when(F.col("turned") == 0, edited).alias("b"))
    ids = ["bucket", "place"]
    both = rows.select(*ids, F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("a").alias("t")), F.struct(F.lit(1).alias("which"), F.col("b").alias("t")))).alias("x")).select(*ids, "x.which", "x.t").filter("t is not null")
    made = signatures(both.select(*ids, "which", F.explode_outer(phrases(F.col("t"))).alias("term")), [*ids, "which"])
    pair = made.groupBy(*ids).agg(F.max(F.when(F.col("which") == 0, F.col("fingerprint"))).alias("fingerprint"), F.max(F.when(F.col("which") == 1, F.col("fingerprint"))).alias("edited_fingerprint"))
    pair = pair.withColumn("__next", F.lead("fingerprint").over(Window.partitionBy("bucket").orderBy("place")))
    named = rows.filter("turned = 0").select(*ids, key, "n_chars", F.sha2("b", 256).alias("edited_sha256"))
    return named.join(pair, ids).select(key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("__next")).alias("near_next"))
