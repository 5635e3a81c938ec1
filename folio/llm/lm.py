"""Language-model scoring from a log-frequency Bloom filter.

Counts of words and of word pairs are quantised to powers of BASE; an n-gram of level q is entered q times, as (n-gram,
1) to (n-gram, q), and read back by asking for (n-gram, 1), (n-gram, 2), .. until one is missing. The filter is made in
slices of SLICE_BITS, as many as the n-grams need, so it holds all of them; the slices are files of the shared folder and
come neither to the driver nor into a broadcast. A task that scores gathers the n-grams of AT_ONCE tokens and reads slice
after slice, one at a time; the larger the filter, the more is read for each of these lots.

A word's probability is (count + 1/2) / (N + (V + 1) / 2); after a word h it is (pairs(h, w) + strength p(w)) /
(count(h) + strength): an estimate that leans on the pair as far as h was seen. Each text ends with an end token, and
its first word follows another.

The base score needs exact counts of all words. Those of words that make up most of the text are broadcast, at most
HOT of them; other words' occurrences are sent, summed for each document, to where the counts are, and back.

Null text counts as empty: one end token. Repeated rows are scored each for itself and learned from each time. An empty
table gives an empty result; without training rows N and V are zero.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from math import ceil, log10

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.llm.common import Scratch

END = b"\n"  # no word has white space
BASE, PROBES, STRENGTH = 1.25, 3, 20.0
#: Bits of a slice of the filter; tokens whose n-grams are looked up together; words whose exact counts are broadcast at most.
SLICE_BITS, AT_ONCE, HOT = 1 << 24, 1 << 21, 200_000
#: Entries that a bit may take, PROBES bits each: half of the bits may be set.
ENTRIES_A_BIT = 0.7 / 2 / PROBES
MIX = np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64 bits of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * np.uint64(0x9E3779B97F4A7C15) + b)


def levels(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log to BASE): 1 for a count of one."""
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


def typical(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for, 0 for level 0."""
    low = BASE ** np.maximum(level - 1.0, 0)
    high = np.maximum(np.ceil(low * BASE) - 1, np.ceil(low))
    return np.where(level > 0, (np.ceil(low - 1e-9) + high) / 2, 0.0)


class LogFrequencyFilter:
    """Bits, and the two operations. An n-gram's slice is given by its upper bits, its places inside by the rest."""

    def __init__(self, bits: int, slices: int):
        self.slices, self.span = slices, bits // slices

    def slice_of(self, grams: np.ndarray) -> np.ndarray:
        return (mixed(grams) >> np.uint64(40)).astype(np.int64) % self.slices

    def places(self, grams: np.ndarray, level: int) -> np.ndarray:
        """PROBES bit places inside the slice for (n-gram, level)."""
        h = mixed(grams ^ mixed(np.array([level], np.uint64)))
        step = (h >> np.uint64(32)) | np.uint64(1)
        return np.stack([(h + np.uint64(k) * step) % np.uint64(self.span) for k in range(PROBES)])

    def enter(self, grams: np.ndarray, level: np.ndarray) -> bytes:
        """One slice's bits."""
        bits = np.zeros(self.span, dtype=bool)
        for q in range(1, int(level.max(initial=0)) + 1):
            grams, level = grams[level >= q], level[level >= q]
            bits[self.places(grams, q)] = True
        return np.packbits(bits, bitorder="little").tobytes()

    def read(self, data: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Levels by repeated membership probes."""
        return self.probe(data, grams, self.slice_of(grams) * self.span)

    def probe(self, data: np.ndarray, grams: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Levels where the n-grams' slices start at the bits `start`."""
        out = np.zeros(len(grams), dtype=np.int64)
        at = np.arange(len(grams))
        q = 1
        while len(at):
            where = self.places(grams[at], q).astype(np.int64) + start[at]
            here = np.ones(len(at), dtype=bool)
            for w in where:
                here &= (data[w >> 3] >> (w & 7).astype(np.uint8)) & 1 > 0
            at = at[here]
            out[at] = q
            q += 1
        return out


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def is_held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5 == 1


def gram_hashes(words: list[bytes], hash_of: dict[bytes, int]) -> np.ndarray:
    """Hashes of the words and the end token."""
    digest = xxhash.xxh64_intdigest
    get = hash_of.get
    found = [get(w) or hash_of.setdefault(w, digest(w)) for w in words]
    found.append(get(END) or hash_of.setdefault(END, digest(END)))
    return np.array(found, dtype=np.uint64)


REMEMBERED = 500_000


def count_grams(train: DataFrame, text: str) -> DataFrame:
    """gram, n: how often each word and each pair of neighbours occurs, by hash. Tasks sum before they send."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of: dict[bytes, int] = {}
        held, size = [], 0

        def summed():
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n)], names=["gram", "n"])

        for batch in batches:
            for t in batch.column(0).cast(pa.binary()):
                if len(hash_of) > REMEMBERED:
                    hash_of.clear()
                h = gram_hashes(words_of(t.as_py()), hash_of)
                held += [h, pair(np.concatenate([h[-1:], h[:-1]]), h)]
                size += 2 * len(h)
                if size > 4_000_000:
                    yield summed()
                    held, size = [], 0
        if held:
            yield summed()

    return train.select(text).mapInArrow(make, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def level_of(n: Column) -> Column:
    return (1 + F.floor(F.log(n.cast("double")) / float(np.log(BASE)) + 1e-9)).cast("int")


def slice_table(grams: DataFrame, filter_: LogFrequencyFilter) -> DataFrame:
    """slice, data: the bits of each slice that has n-grams. A task holds the n-grams of one slice at a time."""

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        now = -1

        def made() -> pa.RecordBatch:
            data = filter_.enter(np.concatenate([g for g, _ in held]).view(np.uint64), levels(np.concatenate([n for _, n in held])))
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([data], pa.binary())], names=["slice", "data"])

        for batch in batches:
            s, g, n = (c.to_numpy() for c in batch.columns)
            edges = [0, *(np.flatnonzero(np.diff(s)) + 1), len(s)]
            for i, j in zip(edges, edges[1:]):
                if i == j:
                    continue
                if held and s[i] != now:
                    yield made()
                    held.clear()
                now = int(s[i])
                held.append((g[i:j], n[i:j]))
        if held:
            yield made()

    @F.pandas_udf("int")
    def slice_of(g):
        import pandas as pd

        return pd.Series(filter_.slice_of(g.to_numpy().view(np.uint64)).astype(np.int32))

    dealt = grams.select(slice_of("gram").alias("slice"), "gram", "n").repartition(filter_.slices, "slice").sortWithinPartitions("slice")
    return dealt.mapInArrow(enter, "slice int, data binary")


def fit_filter(grams: DataFrame, bits: int, slices: int) -> tuple[bytes, int]:
    """The bits of a filter of a given size, and the least level that it holds: those below stay out. Scoring takes `store_filter`."""
    filter_ = LogFrequencyFilter(bits, slices)
    sizes = {r[0]: r[1] for r in grams.groupBy(level_of(F.col("n")).alias("q")).agg(F.count(F.lit(1))).collect()}
    room, least = bits * ENTRIES_A_BIT, 1
    for q in sorted(sizes, reverse=True):
        room -= q * sizes[q]
        if room < 0:
            least = q + 1
            break
    parts = {r[0]: bytes(r[1]) for r in slice_table(grams.filter(level_of(F.col("n")) >= least), filter_).collect()}
    return b"".join(parts.get(i, bytes(filter_.span // 8)) for i in range(slices)), least


class StoredFilter:
    """A filter in slices below a folder that driver and executors share."""

    def __init__(self, path: str, slices: int, slice_bits: int):
        self.path, self.filter = path, LogFrequencyFilter(slices * slice_bits, slices)

    def load(self, number: int) -> np.ndarray | None:
        """The bytes of a slice, None where it has no n-grams."""
        system, folder = fs.FileSystem.from_uri(self.path)
        found = [f.path for f in system.get_file_info(fs.FileSelector(f"{folder}/slice={number}", allow_not_found=True)) if f.path.endswith(".parquet")]
        if not found:
            return None
        with system.open_input_file(found[0]) as f:
            return np.frombuffer(pq.ParquetFile(f).read(["data"]).column(0)[0].as_py(), dtype=np.uint8)

    def read(self, grams: np.ndarray) -> np.ndarray:
        """Levels, slice by slice."""
        s = self.filter.slice_of(grams).astype(np.uint16 if self.filter.slices <= 1 << 16 else np.int64)
        order = np.argsort(s, kind="stable")
        out = np.zeros(len(grams), dtype=np.int64)
        edges = [0, *(np.flatnonzero(np.diff(s[order])) + 1), len(s)]
        for i, j in zip(edges, edges[1:]):
            if i < j and (data := self.load(int(s[order[i]]))) is not None:
                mine = order[i:j]
                out[mine] = self.filter.probe(data, grams[mine], np.zeros(len(mine), dtype=np.int64))
        return out


def store_filter(grams: DataFrame, scratch: Scratch, slice_bits: int = SLICE_BITS) -> StoredFilter:
    """The filter of all n-grams, sized by how many entries they make."""
    entries = grams.agg(F.sum(level_of(F.col("n")).cast("long"))).first()[0] or 0
    slices = max(1, ceil(entries / (slice_bits * ENTRIES_A_BIT)))
    path = f"{scratch.path}/filter"
    slice_table(grams, LogFrequencyFilter(slices * slice_bits, slices)).write.partitionBy("slice").option("compression", "uncompressed").parquet(path)
    return StoredFilter(path, slices, slice_bits)


def scores(df: DataFrame, text: str = "text", key: str = "doc_id", held_out: Column | None = None, hot: int = HOT) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row."""
    spark = df.sparkSession
    scratch = Scratch(spark, "lm")
    held_out = is_held_out(F.col(key)) if held_out is None else held_out
    rows = df.select(key, F.coalesce(held_out, F.lit(False)).alias("held_out"), text)
    train = rows.filter(~F.col("held_out"))
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = train.select(F.explode(F.split(lowered, r"[\x20\x09-\x0D]+")).alias("word")).filter("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("c"))
    counts = scratch.save(counts, "words")
    ends = train.count()
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = tokens + ends, distinct + (ends > 0)
    lower = float(np.log10(n + 0.5 * (v + 1)))

    grams = scratch.save(count_grams(train, text), "grams")
    stored = store_filter(grams, scratch)
    scratch.drop("grams")
    # words by falling count, as far as HOT of them go: whole classes of equal counts, so the choice is the same on each run
    classes = counts.groupBy("c").agg(F.count(F.lit(1)).alias("m")).withColumn("upto", F.sum("m").over(Window.orderBy(F.col("c").desc())))
    floor = classes.filter(F.col("upto") <= hot).agg(F.min("c")).first()[0]
    floor = floor if floor is not None else 1 << 62
    common = {r[0].encode(): log10(r[1] + 0.5) for r in counts.filter(F.col("c") >= floor).collect()}  # at most `hot` words
    exact = spark.sparkContext.broadcast(common)
    strength = STRENGTH

    def finish(lots: list) -> Iterator[pa.RecordBatch]:
        """Probabilities of the texts of some lots, whose n-grams are looked up together, each of them once."""
        h, lengths = (np.concatenate([lot[k] for lot in lots]) for k in (0, 1))
        first = np.cumsum(lengths) - lengths
        before = np.arange(len(h)) - 1
        before[first] = first + lengths - 1
        singles, back = np.unique(h, return_inverse=True)
        pairs, back2 = np.unique(pair(h[before], h), return_inverse=True)
        found = typical(stored.read(np.concatenate([singles, pairs])))
        c = found[: len(singles)][back]
        c_before = c[before]
        p = (c + 0.5) / (n + 0.5 * (v + 1))
        p = (np.minimum(found[len(singles) :][back2], c_before) + strength * p) / (c_before + strength)
        total = np.add.reduceat(np.log10(p), first) if len(first) else np.zeros(0)
        at = 0
        for _, mine, columns in lots:
            yield pa.RecordBatch.from_arrays([*columns[:5], pa.array(total[at : at + len(mine)]), columns[5]], names=[key, "held_out", "n_tokens", "hot_known", "hot_sum", "score", "rare"])
            at += len(mine)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = exact.value
        hash_of: dict[bytes, int] = {}
        lots, held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                some = batch.slice(at, 128)
                n_tokens, n_known, base, rare_at, rare_words, rare_n, hashes = [], [], [], [0], [], [], []
                for t in some.column(0).cast(pa.binary()):
                    if len(hash_of) > REMEMBERED:
                        hash_of.clear()
                    words = words_of(t.as_py())
                    hashes.append(gram_hashes(words, hash_of))
                    n_tokens.append(len(words) + 1)
                    sum_, seen = log10(ends + 0.5), 1 if ends else 0
                    for w, m in Counter(words).items():
                        if (c := known.get(w)) is not None:
                            sum_ += m * c
                            seen += m
                        else:
                            rare_words.append(w)
                            rare_n.append(m)
                    rare_at.append(len(rare_words))
                    base.append(sum_)
                    n_known.append(seen)
                lengths = np.array(n_tokens)
                h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
                lists = pa.ListArray.from_arrays(
                    pa.array(rare_at, pa.int32()),
                    pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()).cast(pa.string()), pa.array(rare_n, pa.int64())], names=["word", "n"]),
                )
                lots.append((h, lengths, [some.column(1), some.column(2), pa.array(lengths), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), lists]))
                held += len(h)
                if held >= AT_ONCE:
                    yield from finish(lots)
                    lots, held = [], 0
        if lots:
            yield from finish(lots)

    kind = df.schema[key].dataType.simpleString()
    scored = rows.select(text, key, "held_out").mapInArrow(score, f"`{key}` {kind}, held_out boolean, n_tokens long, hot_known long, hot_sum double, score double, rare array<struct<word:string,n:long>>")
    scored = scratch.save(scored.withColumn("uid", F.monotonically_increasing_id()), "scored")
    occurrences = scored.select("uid", F.explode("rare").alias("r")).select("uid", "r.word", "r.n")
    sums = occurrences.join(counts.filter(F.col("c") < floor), "word", "left").groupBy("uid").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_sum"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("rare_known")
    )
    zero = F.lit(0)
    return scored.drop("rare").join(sums, "uid", "left").select(
        key,
        "held_out",
        "n_tokens",
        (F.col("hot_known") + F.coalesce("rare_known", zero)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("hot_sum") + F.coalesce("rare_sum", F.lit(0.0)) - F.col("n_tokens") * lower).alias("base_score"),
        "score",
    )
