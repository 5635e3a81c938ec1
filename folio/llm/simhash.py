"""SimHash near-duplicates by covering locality-sensitive hashing.

For radius r the 64 bit positions get random vectors of r + 1 bits, and each of the 2^(r+1) - 1 other vectors v gives a
mask: the positions whose vector has an odd inner product with v. Two fingerprints that differ in r positions or fewer
leave some v orthogonal to all of these, so they agree under that mask: no pair within the radius is missed.

Copies are gathered before any search: fingerprints are compared, not documents. A bucket of a table is a hash of the
table and the masked fingerprint. Large buckets are dealt out in blocks, each pair of blocks a group of its own, and
of every group only the links of a spanning forest are written, so a group of near copies costs links in proportion to
its members. Components are then found by star contraction in the shared folder.

Large groups of near copies meet under nearly all masks. So a first pass links what it can under a few masks, in time and
rows linear in the fingerprints: each is held against those next to it in the order of its bucket and some pivots. The
second pass then leaves out the buckets whose members are all of one component by then. Their pairs could add nothing, so
the components are those of all pairs within the radius.

A text may have several fingerprints of independent hashes; texts are linked if any two of the same number are near. One
pair's bits differ by chance around what their likeness gives, so more fingerprints find what a larger radius would, with
masks that grow by the number instead of doubling with each bit.

Joins whose both sides grow with the texts are told to merge: a compressed file says little of the memory that its rows take.

Null text counts as empty. A text with fewer words than a shingle is one shingle; one without words has fingerprint
zero and is linked like any other. Very long texts are hashed whole. Rows that share a doc_id or have none are linked by
their own texts. Extra columns go, so their names can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import Scratch

BITS = 64
#: Fingerprints that a block of a bucket holds, about. A group compares two blocks.
BLOCK = 2048
#: Fingerprints that one task spells out under all masks.
SPELLED = 20_000
#: Masks of the first pass; fingerprints next to it in its bucket, and pivots of the bucket, that one is held against.
FIRST, NEXT, PIVOTS = 8, 4, 16
#: Links that rounds of components may hold in memory, if Spark thinks so; with more, joins merge.
SMALL = 200_000
#: Bytes of a word that counts among a text's distinct words; shorter ones are the same in all texts of a language, whose
#: fingerprints would then meet in more buckets than chance has them meet.
LONG = 4


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64 bits of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_fingerprints(text: bytes | None, count: int, seed: int = 42) -> list[int]:
    """Majority bits of the hashes of the distinct words of LONG bytes or more (of any, if none is); further ones of the hashes mixed anew."""
    words = set((text or b"").lower().split())
    if not words:
        return [0] * count
    hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in {w for w in words if len(w) >= LONG} or words], dtype="<u8")
    return [majority(mixed(hashes ^ np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))) if k else hashes) for k in range(count)]


def fingerprint(text: bytes | None, shingle: int, seed: int = 42) -> int:
    """Majority bits of the hashes of all shingles."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if n <= shingle:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], dtype="<u8")
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    set_ = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        set_ += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_ * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int | None = 5, count: int = 1) -> DataFrame:
    """`keep` columns, fingerprints (signed 64 bits each): one of shingles, or `count` of words."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t.as_py() for t in batch.column(0).cast(pa.binary()))
            found = [word_fingerprints(t, count) if shingle is None else [fingerprint(t, shingle)] for t in texts]
            n = count if shingle is None else 1
            flat = pa.array(np.array(found, dtype=np.uint64).reshape(-1).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, n), pa.int32()), flat)], names=[*keep, "fingerprints"])

    return df.select(F.col(text), *keep).mapInArrow(make, ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep], "fingerprints array<long>"]))


def masks(radius: int, seed: int = 9) -> list[int]:
    """2^(radius+1) - 1 masks as signed 64-bit numbers."""
    vectors = np.random.default_rng(seed).integers(0, 1 << (radius + 1), BITS)
    out = []
    for v in range(1, 1 << (radius + 1)):
        bits = np.array([bin(int(x) & v).count("1") & 1 for x in vectors], dtype=np.uint8)
        out.append(int(np.packbits(bits, bitorder="little").view("<i8")[0]))
    return out


def forest(prints: np.ndarray, sides: np.ndarray | None, radius: int) -> tuple[list[int], list[int]]:
    """Links (places) of a spanning forest of the pairs within the radius; with sides, only pairs across them were missing."""
    n = len(prints)
    if n == 2:
        near = np.bitwise_count(prints[0] ^ prints[1]) <= radius and (sides is None or sides[0] != sides[1])
        return ([0], [1]) if near else ([], [])
    label, a, b = np.arange(n), [], []
    for i in range(n - 1):
        near = np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= radius
        if sides is not None:
            near &= sides[i + 1 :] != sides[i]
        at = np.flatnonzero(near) + i + 1
        if not len(at):
            continue
        other, first = np.unique(label[at], return_index=True)
        fresh = other != label[i]
        if fresh.any():
            a += [i] * int(fresh.sum())
            b += at[first[fresh]].tolist()
            label[np.isin(label, other)] = label[i]
    return a, b


def groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[np.ndarray]]:
    """Stretches of sorted rows that hold whole groups only; the first `width` columns are the group."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy() for c in batch.columns]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        changed = np.zeros(len(cols[0]) - 1, dtype=bool)
        for c in cols[:width]:
            changed |= c[1:] != c[:-1]
        ends = np.flatnonzero(changed)
        cut = int(ends[-1]) + 1 if len(ends) else 0
        if cut:
            yield [c[:cut] for c in cols]
        rest = [c[cut:] for c in cols]
    if rest is not None and len(rest[0]):
        yield rest


def neighbours(bucket: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (places) within the radius in buckets that lie in stretches: one at most to a row before and one to a pivot, for each row."""
    n, free, a, b = len(bucket), np.ones(len(bucket), dtype=bool), [], []
    for k in range(1, min(NEXT + 1, n)):
        at = np.flatnonzero((bucket[k:] == bucket[:-k]) & free[k:] & (np.bitwise_count(prints[k:] ^ prints[:-k]) <= radius))
        free[at + k] = False
        a.append(at)
        b.append(at + k)
    bounds = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [n]])
    for s in np.flatnonzero(np.diff(bounds) > NEXT):
        lo, hi = int(bounds[s]), int(bounds[s + 1])
        free = np.ones(hi - lo, dtype=bool)
        for p in np.unique(np.linspace(lo, hi - 1, PIVOTS).astype(int)):
            at = np.flatnonzero(free & (np.bitwise_count(prints[lo:hi] ^ prints[p]) <= radius))
            free[at] = False
            a.append(np.full(len(at), p))
            b.append(at + lo)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, dtype=int), np.zeros(0, dtype=int))


def first_links(classes: DataFrame, n: int, radius: int) -> DataFrame:
    """Links (a, b) within the radius that neighbours under the first masks give; some are missed. Large buckets are split by fingerprint."""

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, prints, reps in groups(batches, 1):
            a, b = neighbours(bucket, prints.view(np.uint64), radius)
            ends = np.sort(np.stack([reps[a], reps[b]]), axis=0)
            ends = np.unique(ends[:, ends[0] != ends[1]], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in ends], names=["a", "b"])

    dealt = spelled(classes, masks(radius)[:FIRST], "rep")
    ordered = dealt.repartitionByRange(max(1, -(-n // SPELLED)), "bucket", "fingerprint").sortWithinPartitions("bucket", "fingerprint")
    return ordered.mapInArrow(connect, "a long, b long").distinct()


def spelled(classes: DataFrame, under: list[int], *more: str) -> DataFrame:
    """bucket, fingerprint and more columns of each fingerprint under each mask. A bucket that two masked fingerprints share by chance costs a look at them."""
    table = F.posexplode(F.array(*[F.lit(m) for m in under])).alias("__t", "__mask")
    hashed = F.xxhash64("which", "__t", F.col("fingerprint").bitwiseAND(F.col("__mask")))
    return classes.select("which", "fingerprint", *more, table).select(F.shiftrightunsigned(hashed, 16).alias("bucket"), "fingerprint", *more)


def in_open_buckets(dealt: DataFrame) -> DataFrame:
    """bucket, fingerprint, rep of the buckets that are still of several parts. dealt: these and part.

    Spark takes a table's size from its files, which the masks multiply. So the join is told to merge: such buckets are too many for the driver.
    """
    open_ = dealt.groupBy("bucket").agg(F.min("part").alias("least"), F.max("part").alias("most")).filter("least < most").select("bucket")
    return dealt.join(open_.hint("merge"), "bucket").select("bucket", "fingerprint", "rep")


def links(classes: DataFrame, radius: int, scratch: Scratch, known: DataFrame | None = None) -> DataFrame:
    """Links (a, b) of representatives that connect all fingerprints of one number within the radius. classes: which, fingerprint, rep, one row for each of the first two.

    `known` are links that hold anyhow; they come back among the others.
    """
    n = classes.count()
    # few bytes in the file, many rows under the masks: dealt out first, so that the tasks grow in number and not in size
    classes = classes.repartition(max(1, -(-n // SPELLED)), "fingerprint")
    early = first_links(classes, n, radius)
    early = scratch.save(early if known is None else early.unionByName(known), "early")
    found = scratch.save(components(early, scratch, "early"), "found")
    classes = scratch.save(classes.join(found.hint("merge"), F.col("rep") == F.col("node"), "left").select("which", "fingerprint", "rep", F.coalesce("component", "rep").alias("part")), "parts")
    # the join may have dealt the rows by rep or into few tasks
    classes = classes.repartition(max(1, -(-n // SPELLED)), "fingerprint")
    shared = scratch.save(in_open_buckets(spelled(classes, masks(radius), "rep", "part")), "shared")
    sizes = shared.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK)
    shared = shared.join(sizes, "bucket", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int"))
    own = F.pmod(F.xxhash64(F.lit(3), "fingerprint"), F.col("blocks")).cast("int")
    blocked = (
        shared.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fingerprint", "rep")
    )

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, i, j, own, prints, reps in groups(batches, 3):
            prints = prints.view(np.uint64)
            edge = np.flatnonzero((bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            bounds = np.concatenate([[0], edge, [len(bucket)]])
            a, b = [], []
            # groups of two, by far the most, all at once
            two = bounds[:-1][np.diff(bounds) == 2]
            near = two[(np.bitwise_count(prints[two] ^ prints[two + 1]) <= radius) & ((i[two] == j[two]) | (own[two] != own[two + 1]))]
            a.append(reps[near])
            b.append(reps[near + 1])
            for s in np.flatnonzero(np.diff(bounds) > 2):
                lo, hi = bounds[s], bounds[s + 1]
                x, y = forest(prints[lo:hi], None if i[lo] == j[lo] else own[lo:hi], radius)
                a.append(reps[lo:hi][x])
                b.append(reps[lo:hi][y])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).astype(np.int64)), pa.array(np.concatenate(b).astype(np.int64))], names=["a", "b"])

    ordered = blocked.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "fingerprint")
    return scratch.save(ordered.mapInArrow(connect, "a long, b long").distinct(), "links").unionByName(early)


def components(edges: DataFrame, scratch: Scratch, name: str = "star") -> DataFrame:
    """node, component (its smallest node) of an undirected graph, by large-star and small-star rounds.

    Nodes without an edge don't show. A round joins a node's links with its smallest neighbour, found by a
    partial aggregation, so a hub is split like any skewed join. The rounds grow as the logarithm of the size.
    """
    now = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), f"{name}0")
    before, k, n = None, 0, now.count()
    while True:
        side = (lambda rows: rows.hint("merge")) if n > SMALL else (lambda rows: rows)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(side(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(side(least), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        k += 1
        following = scratch.save(small, f"{name}{k}")
        state = following.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}{k - 1}")
        if state == before:
            return following.select(F.col("u").alias("node"), F.col("v").alias("component"))
        now, before, n = following, state, state[0]


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int | None = 5, radius: int = 4, count: int = 1, tie: str | None = None) -> DataFrame:
    """key, fingerprint (the first), component_id (the smallest key that links of `radius` differing bits or fewer reach): one row for each row.

    The key is an integer. Rows without one link others like any row; their component_id is null where no row of the component has a key.
    With `tie`, a column that tells rows of one key apart, also that column, n (rows that are equal in key and tie) and
    `stays`: whether the row is the component's first by key (nulls last) and tie.
    """
    scratch = Scratch(df.sparkSession, "simhash")
    keep = (key,) if tie is None else (key, tie)
    made = scratch.save(fingerprints(df, text, keep, shingle, count), "fingerprints")
    place = F.struct(F.col(key).isNull().alias("none"), F.col(key).cast("long").alias("key"), *([F.col(tie).alias("tie")] if tie else []))
    # a class's own number, fixed once it is written
    classes = scratch.save(made.groupBy("fingerprints").agg(F.min(place).alias("first")).withColumn("rep", F.monotonically_increasing_id()), "classes")
    each = classes.select("rep", F.posexplode("fingerprints").alias("which", "fingerprint"))
    single = scratch.save(each.groupBy("which", "fingerprint").agg(F.min("rep").alias("rep")), "single")
    known = None
    if count > 1:  # classes may share one fingerprint and not the others
        known = each.join(single.withColumnRenamed("rep", "a").hint("merge"), ["which", "fingerprint"]).filter("rep != a").select("a", F.col("rep").alias("b"))
    found = components(links(single, radius, scratch, known), scratch)
    grouped = scratch.save(classes.join(found.hint("merge"), F.col("rep") == F.col("node"), "left").select("fingerprints", "first", F.coalesce("component", "rep").alias("component")), "grouped")
    least = grouped.select("fingerprints", "component").join(grouped.groupBy("component").agg(F.min("first").alias("first")).hint("merge"), "component").select("fingerprints", "first")
    rows = made if tie is None else made.groupBy(*keep, "fingerprints").agg(F.count(F.lit(1)).alias("n"))
    more = [] if tie is None else [F.col(tie), F.col("n"), place.eqNullSafe(F.col("first")).alias("stays")]
    return rows.join(least.hint("merge"), "fingerprints").select(key, F.get("fingerprints", F.lit(0)).alias("fingerprint"), F.col("first.key").alias("component_id"), *more)
