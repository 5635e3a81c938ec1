"""Secret scans by a battery of randomness tests, with DataFrame operations only.

Patterns find the usual spellings (assignments of a password or token, access keys, long hexadecimal runs). Beyond
these, every run of 20 or more key characters is a candidate if its characters fit an encoding. Three tests ask
whether it could be uniformly random over that alphabet: chi-squared uniformity, runs above and below the middle,
serial correlation at lag one. The last two depend on one another, so the smaller of their p-values, doubled, stands for
both; Fisher's method combines it with the first, and a candidate that fails is no key.

Passing such tests says little of a short string. So each survivor gets a second p-value, of a text as clumped as
words are showing so few coincidences of characters at that length; within each class of lengths the procedure of
Benjamini and Hochberg picks the candidates, counted over all documents, so short strings can't lean on long ones.
It works on a histogram of log p with fixed bins, of which a candidate counts with its bin's upper edge.

Null text counts as empty. Repeated rows get equal spans and each count. Very long texts, candidates and lists of
matches cost in proportion to their length: statistics come from counts of characters and from pieces of PIECE characters,
spans from blocks of BLOCK matches. All other columns stay as they are, whatever their names; the text goes and a column
named like the spans is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import Scratch

#: The patterns and least lengths of the base rules. Hexadecimal runs and access keys are as long as they
#: can be wherever they begin, so the least length can stand in the pattern; for assignments it holds for group 2 afterwards.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE = 6

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: encoding: what a candidate looks like, its alphabet, the coincidence rate that words or made-up names have at least
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = {
    "hex": (r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", DIGITS + "abcdef", 2 / 16),
    "hex_upper": (r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", DIGITS + "ABCDEF", 2 / 16),
    "base32": (r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", UPPER + "234567", 2 / 32),
    "lower36": (r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$", LOWER + DIGITS, 0.065),
    "upper36": (r"^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$", UPPER + DIGITS, 0.065),
    "base64url": (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_", 0.05),
    "base64": (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/", 0.05),
}
#: Least p-value of the battery; rate of false discoveries; lower ends of the classes of length; bins of -ln p, and their width.
BATTERY, RATE, LENGTHS, BINS, WIDTH = 0.001, 0.05, (20, 32, 64), 400, 0.25

#: Characters of a candidate that are spelled out at a time, and matches of a text that are placed at a time.
PIECE, BLOCK = 4096, 256

SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"


def tail(z: Column) -> Column:
    """Upper tail of the standard normal, by the usual polynomial in 1 / (1 + 0.2316419 z)."""
    a = F.least(F.abs(z), F.lit(37.0))
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    p = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly
    return F.greatest(F.lit(1e-300), F.when(z >= 0, p).otherwise(1 - p))


def matches(text: Column, pattern: str, kind: int, value_group: int = 0) -> Column:
    """Spans of all matches in code points. The text between matches and the matches themselves add up to the positions."""
    empty = F.array().cast(SPAN)
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("found"), F.regexp_extract_all(text, F.lit(pattern), value_group).alias("value"))
    # the last gap has no match after it
    pairs = F.filter(pairs, lambda x: x["found"].isNotNull())

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.char_length(x["gap"])
        end = start + F.char_length(x["found"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"))

    # every step copies what it has, so steps go by blocks, and blocks by whole results
    cut = lambda ps: F.transform(F.sequence(F.lit(0), F.floor((F.size(ps) - 1) / BLOCK).cast("int")), lambda i: F.slice(ps, i * BLOCK + 1, F.lit(BLOCK)))
    blocks = F.flatten(F.transform(F.array(pairs), cut))  # a lambda's argument is worked out once

    def add(acc: Column, block: Column) -> Column:
        start = F.struct(F.coalesce(F.try_element_at(acc, F.lit(-1))["pos"], F.lit(0)).alias("pos"), empty.alias("out"))
        return F.concat(acc, F.array(F.aggregate(block, start, step)))

    whole = F.aggregate(blocks, F.array().cast(f"array<struct<pos:int,out:{SPAN}>>"), add, lambda acc: F.flatten(F.transform(acc, lambda x: x["out"])))
    return F.when(text.rlike(pattern), whole).otherwise(empty)


def base_spans(text: Column) -> Column:
    assign = F.filter(matches(text, ASSIGN, 0, 2), lambda s: F.char_length(s["value"]) >= LEAST_VALUE)
    return F.concat(assign, matches(text, ACCESS, 1), matches(text, HEX, 2))


def spelled(spans: Column) -> Column:
    """kind:start:end by start, then by kind as listed."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def battery(df: DataFrame, token: str = "value") -> DataFrame:
    """Add encoding, length_class, p_random and p_words to a table of candidates; those that fit no encoding go.

    Sums over the characters' places in the alphabet come from how often each character occurs; runs are what is left of
    a candidate of two letters when each run is written as one; only products of neighbours are taken place by place.
    """
    encoding = F.coalesce(*[F.when(F.col(token).rlike(p), F.lit(name)) for name, (p, _, _) in ENCODINGS.items()])
    pick = lambda i: F.coalesce(*[F.when(F.col("encoding") == name, F.lit(x[i])) for name, x in ENCODINGS.items()])
    halves = F.coalesce(*[F.when(F.col("encoding") == name, F.translate(token, a, "L" * (len(a) // 2) + "H" * (len(a) - len(a) // 2))) for name, (_, a, _) in ENCODINGS.items()])
    rows = df.withColumn("encoding", encoding).filter(F.col("encoding").isNotNull())
    rows = rows.withColumn("__alphabet", pick(1)).withColumn("__length", F.char_length(token)).withColumn("__n", F.col("__length").cast("double")).withColumn("__k", F.char_length("__alphabet").cast("double"))
    rows = rows.withColumn("__counts", F.expr(f"transform(split(__alphabet, ''), c -> cast(__length - char_length(replace({token}, c, '')) as double))"))
    rows = rows.withColumn("__squares", F.expr("aggregate(__counts, 0D, (a, m) -> a + m * m)"))
    rows = rows.withColumn("__sum", F.expr("aggregate(transform(__counts, (m, i) -> m * i), 0D, (a, m) -> a + m)")).withColumn("__sum2", F.expr("aggregate(transform(__counts, (m, i) -> m * i * i), 0D, (a, m) -> a + m)"))
    rows = rows.withColumn("__halves", halves).withColumn("__n1", F.expr("cast(__length - char_length(replace(__halves, 'H', '')) as double)"))
    rows = rows.withColumn("__runs", F.char_length(F.regexp_replace("__halves", "L++|H++", "x")).cast("double")).drop("__halves")
    # pieces, each with the first character of the one behind it
    rows = rows.withColumn("__pieces", F.regexp_extract_all(token, F.lit(f".{{1,{PIECE}}}"), 0))
    rows = rows.withColumn("__codes", F.expr("transform(__pieces, (p, i) -> transform(split(p || left(coalesce(get(__pieces, i + 1), ''), 1), ''), c -> locate(c, __alphabet) - 1))")).drop("__pieces")
    rows = rows.withColumn("__ends", F.expr("cast(__codes[0][0] + element_at(element_at(__codes, -1), -1) as double)"))
    products = "aggregate(zip_with(slice(c, 1, greatest(size(c) - 1, 0)), slice(c, 2, greatest(size(c) - 1, 0)), (x, y) -> x * y), 0L, (a, x) -> a + x)"
    rows = rows.withColumn("__products", F.expr(f"cast(aggregate(__codes, 0L, (b, c) -> b + {products}) as double)")).drop("__codes")
    mean = F.col("__sum") / F.col("__n")
    rows = rows.withColumn("__var", F.col("__sum2") - F.col("__sum") * mean).withColumn("__cov", F.col("__products") - mean * (2 * F.col("__sum") - F.col("__ends")) + (F.col("__n") - 1) * mean * mean)
    n, k, n1 = F.col("__n"), F.col("__k"), F.col("__n1")
    chi = k / n * F.col("__squares") - n
    free = k - 1
    # the cube root of chi-squared is close to normal in its tail too (Wilson and Hilferty)
    z_chi = (F.cbrt(F.greatest(F.lit(0.0), chi) / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    expect = 2 * n1 * (n - n1) / n + 1
    spread = F.sqrt(F.greatest(F.lit(1e-9), (expect - 1) * (expect - 2) / (n - 1)))
    z_runs = (F.col("__runs") - expect) / spread
    z_serial = F.when(F.col("__var") > 0, F.col("__cov") / F.col("__var") * F.sqrt(n)).otherwise(F.sqrt(n))
    two = lambda z: F.least(F.lit(1.0), 2 * tail(F.abs(z)))
    order = F.least(F.lit(1.0), 2 * F.least(two(z_runs), two(z_serial)))
    x = -(F.log(tail(z_chi)) + F.log(order))
    p_random = F.exp(-x) * (1 + x)
    pairs, rate = n * (n - 1), pick(2)
    seen = (F.col("__squares") - n) / pairs
    # pairs of places share characters, which adds the second part of the variance
    sd = F.sqrt(2 * rate * (1 - rate) / pairs + 4 * rate * rate / n)
    p_words = tail((rate - seen) / sd)
    return rows.withColumn("p_random", p_random).withColumn("p_words", p_words).drop(*[c for c in rows.columns if c.startswith("__")])


def length_class(value: Column) -> Column:
    return sum((F.char_length(value) >= n).cast("int") for n in LENGTHS)


def log_bin(p: Column) -> Column:
    """Bin b holds WIDTH * b <= -ln p < WIDTH * (b + 1)."""
    return F.least(F.lit(BINS), F.floor(-F.log(p) / WIDTH)).cast("int")


def least_bins(tested: DataFrame) -> dict[int, int]:
    """For each class of lengths the least bin that counts as found. At most len(LENGTHS) * (BINS + 1) rows come here."""
    counts = tested.groupBy(length_class(F.col("value")).alias("c"), F.when(F.col("p_random") >= BATTERY, log_bin(F.col("p_words"))).otherwise(0).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    by: dict[int, dict[int, int]] = {}
    for c, b, n in counts.collect():
        by.setdefault(c, {})[b] = n
    found = {}
    for c, bins in by.items():
        total, above = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):
            above += bins[b]
            if math.exp(-WIDTH * b) <= above * RATE / total:
                found[c] = b
    return found


def scan(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Replace the text by `spans`, an array of struct<kind, start, end, value>; all other columns stay.

    kind counts into KINDS. Random spans that overlap a base span are left out: they add nothing.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    others = [c for c in df.columns if c not in (text, spans)]
    made = df.select(*others, base_spans(whole).alias("__base"), matches(whole, CANDIDATE, 3).alias("__more"))
    fits = "|".join(f"(?:{p})" for p, _, _ in ENCODINGS.values())
    clear = F.filter("__more", lambda m: m["value"].rlike(fits) & ~F.exists("__base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    scratch = Scratch(df.sparkSession, "secrets")
    made = scratch.save(made.withColumn("__more", clear).withColumn("__key", F.monotonically_increasing_id()), "spans")
    values = made.select(F.explode("__more").alias("m")).select(F.col("m.value").alias("value"))
    # a value met often is tested once; a distinct value is one discovery
    tested = scratch.save(battery(values.distinct()), "tested")
    least = least_bins(tested)
    good = F.lit(False)
    for c, b in least.items():
        good = good | ((length_class(F.col("value")) == c) & (log_bin(F.col("p_words")) >= b))
    found = tested.filter((F.col("p_random") >= BATTERY) & good).select(F.col("value").alias("__v"))
    hits = made.filter(F.size("__more") > 0).select("__key", F.explode("__more").alias("m")).join(found, F.col("m.value") == F.col("__v")).groupBy("__key").agg(F.collect_list("m").alias("__hits"))
    return made.join(hits, "__key", "left").withColumn(spans, F.concat("__base", F.coalesce("__hits", F.array().cast(SPAN)))).drop("__key", "__base", "__more", "__hits")
