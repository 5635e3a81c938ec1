"""The best titles of an inventory for each of many others by token-set ratio, exactly, with bounds instead of scoring all pairs.

Titles that share no word can be alike too, so an index of words isn't enough. Distinct titles of a part (a year, or the whole
inventory) are dealt into blocks by length. A block has postings of its words, and of its letters by occurrence (the second "e" of a
title is a letter of its own). For one title the postings give, for all titles of the block at once, the shared words, which
settle two of the ratio's three comparisons, and the letters in common, which no common subsequence can exceed. Titles are scored in the order of that
bound until it falls below the last of the best so far; subsequences take one step for each letter, with the title in the bits
of a number. Letters of shared words are left out there: bits that match nothing in the one title, steps that do nothing for the other.

Every title first visits the block of its own length. With what it finds there it goes on to the blocks that hold one of its
words, and to those of lengths that could still do as well without one. What leaves a task are the best few titles.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.functions.text import common_letters
from folio.scratch import Scratch

#: Titles of a block, and visitors that one task takes, about; titles that are scored together first; most letters and words of titles that are scored together.
BLOCK, VISITORS, FIRST, PLACES, WORDS = 4096, 2048, 128, 64, 31
#: Letters whose places a block remembers; tasks for each core.
LETTERS, TILES = 512, 8
COLUMNS = ["part", "block", "slice", "task", "kind", "title", "least", "floor"]


def shape(title: Column) -> Column:
    """Distinct words in order, joined by one space: all that the ratio looks at. Null counts as empty."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce(title, F.lit("")), r"\s+"), lambda w: w != ""))), " ")


class Postings:
    """Where words and letters stand in the titles of a block."""

    def __init__(self, titles: list[str], least: list):
        self.titles, self.least = titles, least
        self.words = [t.split(" ") if t else [] for t in titles]
        self.lengths, self.sizes = np.array([len(t) for t in titles]), np.array([len(w) for w in self.words])
        of_word: dict = {}
        for i, words in enumerate(self.words):
            for k, w in enumerate(words):
                of_word.setdefault(w, []).append((i, k))
        self.of_word = {k: np.array(v).T for k, v in of_word.items()}
        self.simple = (self.lengths <= PLACES) & (self.sizes <= WORDS)
        self.long = {i: Counter(titles[i]) for i in np.flatnonzero(self.lengths > PLACES).tolist()}
        # the other titles' letters as code points, a row for each place; 0 where a title has ended
        most, n = max(1, int(self.lengths[self.lengths <= PLACES].max(initial=0))), len(titles)
        self.letters = np.ascontiguousarray(np.array(["" if i in self.long else t for i, t in enumerate(titles)], dtype=f"U{most}").view(np.uint32).reshape(n, most).T)
        # a word's letters in its title, as bits, with the space before it; and that space alone
        self.of_place, self.gap = np.zeros((2, max(1, int(self.sizes[self.simple].max(initial=0))), n), dtype=np.uint64)
        at, word = np.arange(n), np.zeros(n, dtype=np.int64)
        for k in range(most):
            space = self.letters[k] == ord(" ")
            word += space
            here = self.simple & (k < self.lengths)
            self.of_place[word[here], at[here]] |= np.uint64(1 << k)
            here &= space
            self.gap[word[here], at[here]] = np.uint64(1 << k)
        self.kept: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def row(self, letter: str) -> tuple[np.ndarray, np.ndarray]:
        """The letter's places in each title of PLACES letters at most, as bits, and how often it is in any."""
        if letter not in self.kept:
            if len(self.kept) >= LETTERS:
                self.kept.clear()
            there = (self.letters == ord(letter)) & (np.arange(len(self.letters))[:, None] < self.lengths)
            bits = np.zeros(len(self.titles), dtype=np.uint64)
            for k, x in enumerate(there):
                bits |= x.astype(np.uint64) << np.uint64(k)
            count = there.sum(axis=0, dtype=np.uint8 if self.lengths.max(initial=0) < 256 else np.uint32)
            for i, letters in self.long.items():
                count[i] = letters[letter]
            self.kept[letter] = bits, count
        return self.kept[letter]

    def overlap(self, title: str) -> np.ndarray:
        """Letters in common with each title, in any order."""
        out = np.zeros(len(self.titles), dtype=np.uint8 if len(title) < 256 else np.uint32)
        for letter, n in Counter(title).items():
            count = self.row(letter)[1]
            out += np.minimum(count, count.dtype.type(min(n, np.iinfo(count.dtype).max))).astype(out.dtype)
        return out.astype(np.int64)

    def best(self, title: str, floor: float, whole: bool, top: int) -> list[tuple[int, float]]:
        """(place, score) of the `top` best titles here by score and then `least`, of those with at least `floor`."""
        n, mine = len(self.titles), title.split(" ") if title else []
        if not mine or not n:
            return self.nothing_alike(top) if floor <= 0 else []
        shared, letters = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        here, there = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)  # which of the words are shared, as bits
        for k, w in enumerate(mine):
            if (both := self.of_word.get(w)) is not None:
                at, place = both
                shared[at] += 1
                letters[at] += len(w)
                here[at] |= np.uint64(1 << min(k, WORDS))
                there[at] |= np.uint64(1) << np.minimum(place, WORDS).astype(np.uint64)
        base = letters + np.maximum(shared - 1, 0)
        shorter, both = np.minimum(len(title), self.lengths), len(title) + self.lengths
        known = np.where(shared > 0, 200.0 * base / np.maximum(1, base + shorter), 0.0)
        full = (shared > 0) & ((shared == len(mine)) | (shared == self.sizes))
        limit = np.where(full, 100.0, np.maximum(known, 200.0 * shorter / both)) + 1e-9
        if (np.floor(limit) if whole else limit).max() < floor:
            return []
        limit = np.where(full, 100.0, np.maximum(known, 200.0 * np.minimum(self.overlap(title), shorter) / both)) + 1e-9
        limit = np.floor(limit) if whole else limit
        found: list[tuple[float, object, int]] = []
        left = np.flatnonzero(limit >= floor)
        # the most promising raise the floor for the others
        head = np.argpartition(-limit[left], FIRST)[:FIRST] if len(left) > 2 * FIRST else np.arange(len(left))
        for some in (left[head], np.delete(left, head)):
            worst = -found[-1][0] if len(found) == top else floor
            some = some[limit[some] >= worst]
            if not len(some):
                continue
            x = np.where(full, 100.0, 0.0)[some]
            asked = np.flatnonzero(~full[some])
            at = some[asked]
            x[asked] = np.maximum(known[at], self.scores(title, mine, at, base[at], here[at], there[at]))
            x = np.floor(x) if whole else x
            good = np.flatnonzero(x >= worst)
            if len(good) > top:  # the last of the best, and all as good
                good = good[x[good] >= np.partition(x[good], len(good) - top)[len(good) - top]]
            found = sorted([*found, *((-v, self.least[i], i) for i, v in zip(some[good].tolist(), x[good].tolist(), strict=True))])[:top]
        return [(i, -s) for s, _, i in found]

    def scores(self, title: str, mine: list[str], at: np.ndarray, base: np.ndarray, here: np.ndarray, there: np.ndarray) -> np.ndarray:
        """The ratio of the title and those at these places, which have words that aren't shared on both sides; shared words are a prefix of both.

        All at once, the titles in the bits of numbers, a step for each letter of the one. Bits of shared words match nothing, and steps of one do nothing.
        """
        simple = self.simple[at] if len(mine) <= WORDS else np.zeros(len(at), dtype=bool)
        out = np.zeros(len(at))
        for k in np.flatnonzero(~simple).tolist():
            out[k] = self.rest(mine, int(at[k]), int(base[k]))
        if not simple.any():
            return out
        at, base, here, there = at[simple], base[simple], here[simple], there[simple]
        one, every = np.uint64(1), len(at) == len(self.titles)
        # the bits of what is left: words with the space before them, but for the first that is left
        keep, started = np.zeros(len(at), dtype=np.uint64), np.zeros(len(at), dtype=bool)
        for k in range(min(int(self.sizes[at].max()), len(self.of_place))):
            left = ((there >> np.uint64(k)) & one == 0) & (k < self.sizes[at])
            bits = self.of_place[k, at]
            keep |= np.where(left, np.where(started, bits, bits & ~self.gap[k, at]), np.uint64(0))
            started |= left
        rows = {c: self.row(c)[0] if every else self.row(c)[0][at] for c in {*title, " "}}
        free = np.full(len(at), ~np.uint64(0))
        more = np.zeros(len(at), dtype=bool)  # a word before this one is left
        steps = np.zeros(len(at), dtype=np.int64)
        some_shared = here.any()
        for k, word in enumerate(mine):
            left = (here >> np.uint64(k)) & one == 0 if some_shared else np.ones(len(at), dtype=bool)
            for text, works in ((" ", left & more), (word, left)):
                if works.any():
                    steps += works * len(text)
                    now = keep if works.all() else np.where(works, keep, np.uint64(0))
                    for c in text:
                        hit = rows[c] & now
                        hit &= free
                        free = (free + hit) | (free - hit)
            more |= left
        common = np.bitwise_count(~free & keep).astype(np.int64)
        ahead = np.where(here > 0, base + 1, 0)
        out[simple] = 200.0 * (ahead + common) / (2 * ahead + steps + np.bitwise_count(keep))
        return out

    def nothing_alike(self, top: int) -> list[tuple[int, float]]:
        return [(i, 0.0) for i in sorted(range(len(self.titles)), key=self.least.__getitem__)[:top]]

    def rest(self, mine: list[str], i: int, base: int) -> float:
        """The ratio of the shared words and either rest; the shared words are a prefix of both."""
        other = set(self.words[i])
        a, b = " ".join(w for w in mine if w not in other), " ".join(w for w in self.words[i] if w not in set(mine))
        ahead = base + 1 if base else 0
        return 200.0 * (ahead + common_letters(a, b)) / (2 * ahead + len(a) + len(b)) if a or b or base else 0.0


def score_tiles(rows: DataFrame, tasks: int, whole: bool, top: int) -> DataFrame:
    """part, title, other_title, score of the best in each block, from inventory rows (kind 0) and visitors (kind 1) of tiles."""
    rows = rows.select(*COLUMNS).repartition(tasks, "part", "block", "slice", "task").sortWithinPartitions("part", "block", "slice", "task", "kind")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, titles, least, postings = None, [], [], None
        for batch in batches:
            out = []
            for part, block, slice_, task, kind, title, first, floor in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now != (part, block, slice_, task):
                    now, titles, least, postings = (part, block, slice_, task), [], [], None
                if kind == 0:
                    titles.append(title)
                    least.append(first)
                    continue
                postings = postings or Postings(titles, least)
                out += [(part, title, titles[i], s) for i, s in postings.best(title, floor, whole, top)]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = [batch.schema.field("part").type, pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "title", "other_title", "score"])

    return rows.mapInArrow(work, f"part {rows.schema['part'].dataType.simpleString()}, title string, other_title string, score double")


def best_titles(left: DataFrame, right: DataFrame, top: int, whole: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """part, title, other_title, score: for each (part, title) of `left` titles of `right` (part, title, least) that hold its `top` best by score and `least`.

    Titles are shapes; each of `right` comes once in a part, with the smallest key of its rows. With `whole`, scores are cut to whole numbers.
    Null parts match nothing. An empty title is 0 alike to all.
    """
    spark = left.sparkSession
    scratch = scratch or Scratch(spark, "titles")
    length = F.char_length("title")
    right = scratch.save(right.filter("part is not null"), "inventory")
    counts = right.groupBy("part", length.alias("length")).agg(F.count(F.lit(1)).alias("n"))
    # a row for each length that occurs in a part
    before = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("length").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = counts.select("part", "length", F.floor(before / BLOCK).cast("int").alias("block"), F.ceil(F.col("n") / BLOCK).cast("int").alias("slices"))
    plan = scratch.save(plan.withColumn("longest", F.max("length").over(Window.partitionBy("part"))), "plan")
    dealt = right.join(plan.withColumnRenamed("part", "p"), (F.col("part") == F.col("p")) & (length == F.col("length")))
    stock = scratch.save(dealt.select("part", "block", F.pmod(F.xxhash64("title"), F.col("slices")).cast("int").alias("slice"), "title", "least"), "stock")
    blocks = scratch.save(stock.groupBy("part", "block", "slice").agg(F.min(length).alias("low"), F.max(length).alias("high")), "blocks")
    mine = scratch.save(left.filter("part is not null").select("part", "title").distinct(), "mine")

    def tiles(visits: DataFrame, name: str) -> DataFrame:
        tasks = scratch.save(visits.groupBy("part", "block", "slice").agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("tasks")), name)
        keys = ["part", "block", "slice"]
        visitors = visits.join(tasks, keys).withColumns({"task": F.pmod(F.xxhash64("title"), F.col("tasks")).cast("int"), "kind": F.lit(1), "least": F.lit(None).cast(right.schema["least"].dataType)})
        hosts = stock.join(tasks, keys).withColumns({"task": F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)), "kind": F.lit(0), "floor": F.lit(None).cast("double")})
        # some tiles share a task if they are many
        n = min(tasks.agg(F.sum("tasks")).first()[0] or 1, TILES * spark.sparkContext.defaultParallelism)
        return score_tiles(hosts.select(*COLUMNS).unionByName(visitors.select(*COLUMNS)), n, whole, top)

    # the block of the nearest length that occurs, and that of the shortest titles, which are the likeliest to stand whole in others: one of their slices
    lengths = mine.select("part", length.alias("own")).distinct()
    at = F.struct("block", "slices")
    near = lengths.join(plan, "part").groupBy("part", "own").agg(
        F.array_distinct(F.array(F.min_by(at, F.struct(F.abs(F.col("length") - F.col("own")), "length")), F.min_by(at, "length"))).alias("at")
    )
    home_of = mine.withColumn("own", length).join(near, ["part", "own"]).select("part", "title", F.explode("at").alias("at"))
    home_of = home_of.select("part", "title", "at.block", F.pmod(F.xxhash64("title"), F.col("at.slices")).cast("int").alias("slice")).distinct()
    # a length may lack in a slice of its block
    home_of = scratch.save(home_of.join(blocks.select("part", "block", "slice"), ["part", "block", "slice"], "left_semi"), "home_of")
    home = scratch.save(tiles(home_of.withColumn("floor", F.lit(0.0)), "home_tasks"), "home")
    # nothing below the last of the best so far can come in; without as many, anything can
    found = home.groupBy("part", "title").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(top - 1)).alias("floor"))
    asked = mine.join(found, ["part", "title"], "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    stands = stock.select("part", "block", "slice", F.explode(F.split("title", " ")).alias("word")).distinct()
    by_word = asked.withColumn("word", F.explode(F.split("title", " "))).join(stands, ["part", "word"]).select("part", "title", "floor", "block", "slice")
    # without a shared word the score is at most 200 times the shorter length by the sum of both
    ratio = (200 - F.col("floor")) / F.greatest(F.col("floor"), F.lit(1e-9))
    longest = plan.select("part", "longest").distinct()
    low = F.floor(F.char_length("title") / ratio).cast("int")
    span = F.sequence(low, F.least(F.col("longest").cast("double"), F.char_length("title") * ratio + 2).cast("int"))
    ranged = asked.join(longest, "part").filter((low <= F.col("longest")) & (F.char_length("title") > 0)).withColumn("length", F.explode(span))
    empty = asked.join(longest, "part").filter(F.char_length("title") == 0).withColumn("length", F.explode(F.sequence(F.lit(0), F.col("longest"))))
    covers = blocks.select("part", "block", "slice", F.explode(F.sequence("low", "high")).alias("length"))
    by_length = ranged.unionByName(empty).join(covers, ["part", "length"]).select("part", "title", "floor", "block", "slice")
    visits = by_word.unionByName(by_length).distinct().join(home_of.select("part", "title", "block", "slice"), ["part", "title", "block", "slice"], "left_anti")
    away = tiles(scratch.save(visits, "visits"), "tasks")
    return home.unionByName(away)
