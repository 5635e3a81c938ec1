"""Spelling variants: words one edit apart, found by a rare-first prefix filter over positional bigrams.

Bigrams are ordered by the number of places they have in the words, the rarest first. One edit destroys two bigrams at
most, so of the three rarest places of a word at least one survives in every near word; and the words' prefixes in that
order, each with all places of its last bigram, share a bigram whose places differ by what the edit shifts. (Say the one
prefix's last bigram is not rarer than the other's: the surviving bigram is then in both.)

The surviving place limits where the edit can lie: before the bigram or after it, and there in the first half or in the
second. All other letters are equal in both words, so they go into the join's key with the length of the shorter word, and
a bucket holds words that agree but for one zone. An exact edit check follows inside the join, so that no candidates are
written. No bucket is capped.

Null texts have no words. A null key counts as empty in the hash. Repeated rows count once each, as every row does. Very
long texts are taken whole; rows are made of words in the JVM and summed before the shuffle, so a frequent word is no hot
group. Only distinct words go on from there. Extra columns go. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import Scratch

#: Letters of a word; A to Z are lower-cased, no others.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Places of the rarest bigrams that a word is found by: one more than an edit can destroy.
RAREST = 3


def typed(word: Column, key: Column, every: int) -> Column:
    """The word, or without one letter where `every` divides the hash of key and word."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = F.pmod(h, F.char_length(word)).cast("int")
    cut = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))
    return F.when(F.pmod(h, F.lit(every)) == 0, cut).otherwise(word)


def counted_words(df: DataFrame, text: str = "text", key: str = "doc_id", least_letters: int = 6, least_count: int = 5, every: int = 199) -> DataFrame:
    """word, n: the words of the texts with as many letters and occurrences at least. Shorter runs cannot give a word, so they make no rows."""
    runs = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(f"[{LETTERS}]{{{least_letters},}}"), F.lit(0))
    words = df.select(F.col(key).alias("key"), F.explode(runs).alias("run")).select(typed(F.col("run"), F.col("key"), every).alias("word"))
    counts = words.filter(F.char_length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= least_count)


def prefixes(words: DataFrame, scratch: Scratch) -> DataFrame:
    """word, places: the places (from 0) of each word's RAREST rarest bigrams, and all of the last one's."""
    length = F.char_length("word")
    grams = words.select("word", F.explode(F.sequence(F.lit(0), length - 2)).alias("place")).withColumn("gram", F.substring("word", F.col("place") + 1, F.lit(2)))
    # at most the square of the alphabet's 90 letters; written, so that the join knows how few
    order = scratch.save(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("places")), "grams")
    ranked = grams.join(order, "gram").groupBy("word").agg(F.sort_array(F.collect_list(F.struct("places", "gram", "place"))).alias("all"))  # as many as the word has letters
    last = F.get("all", F.lit(RAREST - 1))
    rare = F.filter("all", lambda x: (x["places"] < last["places"]) | ((x["places"] == last["places"]) & (x["gram"] <= last["gram"])))
    return ranked.select("word", F.transform(rare, lambda x: x["place"]).alias("places"))


def zones(places: DataFrame, shorter: list[int]) -> DataFrame:
    """word, zone: what is equal in a near word if the edit lies in one of four zones around a bigram, hashed, for a pair whose shorter word has this word's length less one of `shorter`."""
    word, place, length, less = F.col("word"), F.col("place"), F.char_length("word"), F.col("less")
    rows = places.select("word", F.explode("places").alias("place")).withColumn("less", F.explode(F.array(*[F.lit(x) for x in shorter])))
    after, before = length - less - place - 2, place - less  # letters of the shorter word on either side of the bigram
    half = F.floor(F.col("side") / 2).cast("int")
    head = lambda n: F.substring(word, F.lit(1), n)
    tail = lambda n: F.when(n > 0, F.substring(word, length - n + 1, n)).otherwise("")
    hashed = lambda kind, *parts: F.xxhash64(F.lit(kind), length - less, *parts)
    right = rows.withColumn("side", after).filter("side >= 0").select(
        "word", F.explode(F.array(hashed(0, head(place + 2 + half)), hashed(1, head(place + 2), tail(F.col("side") - half)))).alias("zone")
    )
    left = rows.withColumn("side", before).filter("side >= 0").select(
        "word", F.explode(F.array(hashed(2, tail(length - place + F.col("side") - half)), hashed(3, tail(length - place), head(half)))).alias("zone")
    )
    return right.unionByName(left).distinct()


def near_pairs(words: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b: pairs of words exactly one edit apart; the shorter first, or the smaller of two equally long.

    Spark takes the zones' size from the file of the places, which they exceed many times. So the join is told to merge.
    """
    places = scratch.save(prefixes(words, scratch), "places")
    a = zones(places, [0]).withColumnRenamed("word", "a")
    b = zones(places, [0, 1]).withColumnRenamed("word", "b")
    long = F.char_length("b") - F.char_length("a")
    wanted = ((long == 1) | ((long == 0) & (F.col("a") < F.col("b")))) & (F.levenshtein("a", "b", 1) == 1)
    return a.join(b.hint("merge"), (a["zone"] == b["zone"]) & wanted).select("a", "b").distinct()


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root of each word that has a form, by pointer jumping. Every step multiplies the count, so the chains are short and the rounds few."""
    now, k = scratch.save(forms.select("word", F.col("form").alias("root")), "roots0"), 0
    while True:
        up = now.select(F.col("word").alias("at"), F.col("root").alias("up"))
        k += 1
        following = scratch.save(now.join(up.hint("merge"), F.col("root") == F.col("at"), "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), f"roots{k}")
        if following.filter("moved").isEmpty():
            return following.select("word", "root")
        now = following.select("word", "root")


def spelling_variants(df: DataFrame, text: str = "text", key: str = "doc_id", least_letters: int = 6, least_count: int = 5, ratio: int = 5, every: int = 199) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word.

    The form is the most frequent near word (of several the smallest), if its count is `ratio` times the word's own or
    more; the root is what following the forms ends at. Words have RAREST bigrams at least; the ratio is above 1.
    """
    if least_letters <= RAREST or ratio <= 1:
        raise ValueError(f"words need more than {RAREST} letters, and a ratio above 1 keeps forms from going in circles")
    scratch = Scratch(df.sparkSession, "spelling")
    words = scratch.save(counted_words(df, text, key, least_letters, least_count, every), "words")
    pairs = scratch.save(near_pairs(words.select("word"), scratch), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    with_n = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")).hint("merge"), "near")
    best = with_n.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    most = -F.col("best.less")
    formed = most >= ratio * F.col("n")
    known = words.join(best.hint("merge"), "word", "left").select(
        "word", F.when(formed, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, most).alias("form_n")
    )
    known = scratch.save(known, "known")
    ends = roots(known.filter("form IS NOT NULL").select("word", "form"), scratch)
    return known.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
