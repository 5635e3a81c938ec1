"""Dictionary, cascade, n-gram, fuzzy and containment joins, and the audits made of them.

Sides that a catalogue makes small are left to Spark's own size check; nothing here forces a broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.operators.titles import best_titles, shape
from folio.scratch import Scratch


def first_writer_wins(aliases: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """One value for each key, that of the smallest order."""
    return aliases.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value)).filter(F.col(key).isNotNull() & (F.col(key) != ""))


def last_writer_wins(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def probe_in_turn(df: DataFrame, lookup: DataFrame, probes: list[Column], key: str, value: str, out: str) -> DataFrame:
    """Left joins on each probe; the first that hits gives `out`."""
    hits = []
    for i, probe in enumerate(probes):
        side = lookup.select(F.col(key).alias(f"__k{i}"), F.col(value).alias(f"__v{i}"))
        df = df.withColumn(f"__p{i}", probe).join(side, F.col(f"__p{i}") == F.col(f"__k{i}"), "left")
        hits.append(F.col(f"__v{i}"))
    return df.withColumn(out, F.coalesce(*hits)).drop(*[f"__{x}{i}" for x in "kvp" for i in range(len(probes))])


def split_and_resolve(df: DataFrame, ids: list[str], text: str, lookup: DataFrame, key: str, value: str, normal: Callable[[Column], Column], pattern: str = r"\s*(?:,|;|&|\band\b)\s*") -> DataFrame:
    """ids and `resolved`: the distinct values of a list of names, in the order of the names."""
    parts = df.select(*ids, F.posexplode(F.split(text, pattern)).alias("__pos", "__name")).withColumn("__key", normal(F.col("__name")))
    hits = parts.join(lookup.select(F.col(key).alias("__k"), F.col(value).alias("__v")), F.col("__key") == F.col("__k"))
    found = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__v"))), lambda x: x["__v"]))
    return hits.groupBy(*ids).agg(found.alias("resolved"))


def cascade(df: DataFrame, ids: list[str], candidates: Column, lookup: DataFrame, key: str, value: str) -> DataFrame:
    """ids, value, via: the first of array<struct<ord, cand, via>> that the lookup knows."""
    rows = df.select(*ids, F.explode(candidates).alias("c")).select(*ids, "c.ord", "c.cand", "c.via")
    hits = rows.join(lookup.select(F.col(key).alias("cand"), F.col(value).alias(value)), "cand")
    best = hits.groupBy(*ids).agg(F.min_by(F.struct(value, "via"), "ord").alias("b"))
    return best.select(*ids, f"b.{value}", "b.via")


def runs_of(tokens: Column, k: int) -> Column:
    """All runs of k tokens as arrays."""
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(tokens) - k + 1)), lambda i: i + k - 1 <= F.size(tokens))
    return F.transform(starts, lambda i: F.slice(tokens, i, F.lit(k)))


def windows_of(tokens: Column, least: int, most: int) -> Column:
    """All runs of `least` to `most` tokens, shorter ones first."""
    return F.concat(*[runs_of(tokens, k) for k in range(least, most + 1)])


def name_keys(tokens: Column, runs: Column) -> Column:
    """Keys under which tokens may name someone: hyphenated tokens; initials and the name after them; runs of two or
    more; runs of three or more less one inner initial. In that order, as array<string>; `runs` are the windows of the tokens."""
    single = F.filter(tokens, lambda t: F.contains(t, F.lit("-")))
    joined = F.transform(runs, lambda w: F.concat_ws("-", w))
    initials = F.transform(F.filter(runs, lambda w: F.forall(F.slice(w, F.lit(1), F.size(w) - 1), lambda t: F.char_length(t) == 1) & (F.char_length(F.element_at(w, -1)) > 1)), lambda w: F.concat_ws("-", w))

    def without_inner(w: Column) -> Column:
        inner = F.filter(F.sequence(F.lit(2), F.size(w) - 1), lambda j: F.char_length(F.element_at(w, j)) == 1)
        return F.transform(inner, lambda j: F.concat_ws("-", F.slice(w, F.lit(1), j - 1), F.slice(w, j + 1, F.size(w) - j)))

    dropped = F.flatten(F.transform(F.filter(runs, lambda w: F.size(w) >= 3), without_inner))
    return F.concat(single, initials, joined, dropped)


def ngram_join(df: DataFrame, ids: list[str], tokens: Column, lookup: DataFrame, key: str, value: str, most: int = 6) -> DataFrame:
    """ids, matches (distinct, in order), route: resolved for one, ambiguous for more, deferred for none."""
    parts = df.select(*ids, tokens.alias("__tokens")).withColumn("__runs", windows_of(F.col("__tokens"), 2, most))
    rows = parts.select(*ids, F.posexplode_outer(name_keys(F.col("__tokens"), F.col("__runs"))).alias("__pos", "__cand"))
    hits = rows.join(lookup.select(F.col(key).alias("__k"), F.col(value).alias("__v")), F.col("__cand") == F.col("__k"), "left")
    found = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("__v").isNotNull(), F.struct("__pos", "__v")))), lambda x: x["__v"]))
    out = hits.groupBy(*ids).agg(found.alias("matches"))
    n = F.size("matches")
    return out.withColumn("route", F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("deferred"))


def expand_aliases(base: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Adds keys without honorifics and with compact initials spelled out, where no key of that name exists."""
    bare = F.regexp_replace(key, "^(?:prof|dr|sir|mr|mrs|ms|smt|shri)-", "")
    spelled = lambda c: F.when(c.rlike(r"^[a-z]{2,3}-[a-z0-9]{4,}"), F.concat(F.regexp_replace(F.substring_index(c, "-", 1), "(?<=.)(?=.)", "-"), F.substring(c, F.char_length(F.substring_index(c, "-", 1)) + 1, F.char_length(c))))
    forms = F.array_compact(F.array(F.struct(F.lit(0).alias("rank"), F.col(key).alias("k")), *[F.when(c.isNotNull() & (c != F.col(key)), F.struct(F.lit(i).alias("rank"), c.alias("k"))) for i, c in enumerate((bare, spelled(bare), spelled(F.col(key))), 1)]))
    rows = base.select(F.explode(forms).alias("f"), F.col(value), F.col(order)).select("f.rank", F.col("f.k").alias(key), value, order)
    w = Window.partitionBy(key).orderBy(F.when(F.col("rank") == 0, 0).otherwise(1), F.when(F.col("rank") == 0, -F.col(order)).otherwise(F.col(order)), "rank")
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").select(key, value)


def fuzzy_tiers(left: DataFrame, right: DataFrame, high: float = 92, medium: float = 80, tried: int = 5) -> DataFrame:
    """left(id, slug, title, year, surname) by right(rid, rslug, rtitle, ryear, byline, url): id, rid, tier.

    Equal slugs are exact (page-only without a url). The rest is compared inside the same year only; of each left row
    the best `tried` count: high from `high` on, medium from `medium` on if the surname stands in the byline.
    Each two different titles of a year are compared once, however many rows have them, and scored only while they can be among the best.
    """
    # only the least rid of a slug can be taken, so rows of one slug aren't paired each with each
    first = right.groupBy("rslug").agg(F.min(F.struct("rid", F.col("url").isNull().alias("bare"))).alias("r"))
    exact = left.join(first, F.col("slug") == F.col("rslug")).select("id", "r.rid", F.when(F.col("r.bare"), "page-only").otherwise("exact").alias("tier"), F.lit(0).alias("rank"))
    shaped = right.select("rid", F.col("ryear").alias("year"), shape(F.col("rtitle")).alias("rtitle"), "byline").filter("year is not null")
    # of rows with one title no more than `tried` can count
    few = shaped.withColumn("__n", F.row_number().over(Window.partitionBy("year", "rtitle").orderBy("rid"))).filter(F.col("__n") <= tried)
    mine = left.select("id", "year", shape(F.col("title")).alias("title"), "surname")
    stock = few.filter("__n = 1").select(F.col("year").alias("part"), F.col("rtitle").alias("title"), F.col("rid").alias("least"))
    found = best_titles(mine.select(F.col("year").alias("part"), "title"), stock, tried)
    w = Window.partitionBy("year", "title").orderBy(F.col("score").desc(), "rid")
    top = found.select(F.col("part").alias("year"), "title", F.col("other_title").alias("rtitle"), "score").join(few, ["year", "rtitle"]).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= tried)
    best = mine.join(top.select("year", "title", "rid", "byline", "score", "rank"), ["year", "title"])
    tier = F.when(F.col("score") >= high, "high").when((F.col("score") >= medium) & (F.col("surname") != "") & F.contains(F.lower("byline"), F.lower("surname")), "medium")
    rest = best.withColumn("tier", tier).filter("tier is not null").select("id", "rid", "tier", "rank")
    order = Window.partitionBy("id").orderBy("rank", "rid")
    return exact.unionByName(rest).withColumn("__n", F.row_number().over(order)).filter("__n = 1").select("id", "rid", "tier")


def claimed_twice(links: DataFrame, right: str) -> DataFrame:
    """Links whose right side several rows claim, all of them marked."""
    return links.withColumn("collision", F.count(F.lit(1)).over(Window.partitionBy(right)) > 1)


def contains_normal(body: Column, quote: Column, normal_body: Callable[[Column], Column], normal_quote: Callable[[Column], Column]) -> Column:
    """Whether the quote stands in the body, both normalised; an empty one doesn't."""
    q = F.coalesce(normal_quote(quote), F.lit(""))
    return (q != "") & F.contains(F.coalesce(normal_body(body), F.lit("")), q)


def passages_in(docs: DataFrame, doc: str, body: str, passages: DataFrame, item: str, quote: str) -> DataFrame:
    """doc, item: which documents hold which passages, exactly. Empty passages are in none.

    The words of a passage but its first and last stand whole and side by side wherever it does, so a hash of them (of no more than
    five) pairs it with the documents that have that run; containment decides. Documents are exploded into hashes only, of the
    lengths that passages have, and only pairs carry texts. Passages of one or two words may begin and end inside words:
    the words of all documents that hold the longer one are looked up first, and each of these is a run of one.
    """
    scratch = Scratch(docs.sparkSession, "passages")
    words = lambda c: F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")
    run = lambda w, i, k: F.xxhash64(F.array_join(F.slice(w, i, k), " "))
    # written, so that what is known of a passage's hash isn't asked of documents
    listed = scratch.save(passages.select(F.col(item).alias("item"), F.col(quote).alias("q")).filter("q <> ''").withColumn("w", words(F.col("q"))), "listed")
    lengths = {r.k for r in listed.select(F.greatest(F.lit(0), F.least(F.lit(5), F.size("w") - 2)).alias("k")).distinct().collect()}  # six at most
    k = F.least(F.lit(5), F.size("w") - 2)
    wanted = listed.filter(F.size("w") > 2).select("item", run(F.col("w"), F.lit(2), k).alias("h"))
    mine = docs.select(F.col(doc).alias("doc"), words(F.col(body)).alias("w"))
    if 0 in lengths:
        tiny = listed.filter((F.size("w") < 3) & (F.get("w", F.lit(0)) != "")).withColumn("piece", F.reduce("w", F.lit(""), lambda x, y: F.when(F.char_length(y) > F.char_length(x), y).otherwise(x)))
        known = scratch.save(mine.select(F.explode_outer("w").alias("word")).distinct().filter("word <> ''"), "words")
        at = lambda n: F.transform(F.sequence(F.lit(1), F.char_length("word")), lambda i: F.substring("word", i, F.lit(n)))
        grams = known.select("word", F.explode_outer(F.array_distinct(F.concat(at(1), at(2), at(3)))).alias("g"))
        holds = grams.join(tiny.select("item", "piece", F.left("piece", F.lit(3)).alias("g")), "g").filter(F.contains("word", F.col("piece")))
        wanted = wanted.unionByName(holds.select("item", F.xxhash64("word").alias("h")))
    wanted = scratch.save(wanted.distinct(), "wanted")
    # hashes are told apart as numbers: distinct structs would be compared each with each
    of = lambda n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: run(F.col("w"), i, F.lit(n))))
    runs = [F.when(F.size("w") >= n, of(n)).otherwise(F.array().cast("array<long>")) for n in sorted({max(1, n) for n in lengths})]
    found = listed.select(F.lit(None).cast(docs.schema[doc].dataType).alias("doc"), "item").limit(0)
    if runs:
        found = mine.select("doc", F.explode_outer(F.concat(*runs)).alias("h")).join(wanted, "h").select("doc", "item")
    # blanks alone stand wherever there are as many
    blank = listed.filter((F.size("w") == 1) & (F.get("w", F.lit(0)) == "")).select("item")
    if 0 in lengths:
        found = found.unionByName(docs.select(F.col(doc).alias("doc")).crossJoin(blank))
    found = scratch.save(found.distinct(), "found")
    texts = docs.select(F.col(doc).alias("doc"), F.col(body).alias("b"))
    return found.join(listed.select("item", "q"), "item").join(texts, "doc").filter(F.contains("b", F.col("q"))).select(F.col("doc").alias(doc), F.col("item").alias(item))


def whole_word(text: Column, name: Column) -> Column:
    """Whether a name of ASCII letters stands in the text as words, in any case. The name is quoted for the pattern."""
    quoted = F.regexp_replace(name, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    return F.regexp_like(text, F.concat(F.lit(r"(?i)\b"), quoted, F.lit(r"\b")))


def discrepancies(refs: DataFrame, prose: DataFrame, keys: list[str], rows_per_task: int = 500_000) -> DataFrame:
    """keys and `found`: ref-only or prose-only, each key once; null keys equal each other.

    Both sides are dealt by key once, to tasks that hold about so many rows however long the tables are.
    """
    rows = refs.select(*keys, F.lit(1).alias("__side")).unionByName(prose.select(*keys, F.lit(2).alias("__side")))
    dealt = rows.repartition(max(1, -(-rows.count() // rows_per_task)), *keys)
    sides = dealt.groupBy(*keys).agg(F.min("__side").alias("__low"), F.max("__side").alias("__high")).filter("__low = __high")
    return sides.select(*keys, F.when(F.col("__low") == 1, "ref-only").otherwise("prose-only").alias("found"))


def token_overlap(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text_left: str, text_right: str, least_token: int = 4, least: int = 5) -> DataFrame:
    """left_id, right_id, overlap: the right row that shares the most letters in words of `least_token` or more."""
    words = lambda df, id_, text: df.select(id_, F.explode(F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.char_length(w) >= least_token))).alias("word"))
    shared = words(left, left_id, text_left).join(words(right, right_id, text_right), "word").groupBy(left_id, right_id).agg(F.sum(F.char_length("word")).alias("overlap")).filter(F.col("overlap") >= least)
    w = Window.partitionBy(left_id).orderBy(F.col("overlap").desc(), right_id)
    return shared.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
