"""Best-fit-decreasing packing of token sequences.

Pieces are at most `capacity` tokens long, so all that the choice of bins depends on is how many pieces there are
of each length: a histogram of `capacity` rows at most, whatever the corpus. Best fit decreasing runs on it,
longest first, each time in the tightest open bin. A segment tree over remaining capacities finds that bin in
logarithmic time; equal pieces that go to equal bins take one step together. The steps come out as runs
(length, first rank, bins), and every piece finds its run by its rank among the pieces of its length.

Null text counts as empty. Every document ends with the end token, so an empty one is one token long.
Repeated rows are packed each for itself. An empty table gives no sequences.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import Scratch, free_name, spread_rank

#: Words whose ids a worker remembers in a generation, and half as many pieces. It keeps two: what is met again moves from the older to the newer.
REMEMBERED = 250_000


class TightestBin:
    """Segment tree over remaining capacities 0..capacity: which have an open bin, and the smallest at or above a need."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1).bit_length()
        self.open = np.zeros(2 * self.leaves, dtype=bool)

    def put(self, room: int, is_open: bool) -> None:
        i = room + self.leaves
        self.open[i] = is_open
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def at_least(self, need: int) -> int | None:
        i = need + self.leaves
        if self.open[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def plan(histogram: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """Runs by length: (first rank, first bin, pieces a bin, offset of a bin's first piece), ordered by first rank.

    A group is a range of bins filled alike. Placing n pieces of one length fills whole groups or splits one, so
    the number of runs depends on the capacity and the lengths, not on the number of pieces.
    """
    tree = TightestBin(capacity)
    groups: dict[int, list[tuple[int, int]]] = {}  # room -> ranges of bins (first, count)
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    bins = 0

    def add(room: int, first: int, count: int) -> None:
        if room and count:
            if not groups.get(room):
                tree.put(room, True)
            groups.setdefault(room, []).append((first, count))

    for length in sorted(histogram, reverse=True):
        left, done = histogram[length], 0
        out = runs.setdefault(length, [])
        while left:
            room = tree.at_least(length)
            if room is None:
                room = capacity
                first, count = bins, -(-left // (capacity // length))
                bins += count
            else:
                first, count = groups[room].pop()
                if not groups[room]:
                    tree.put(room, False)
            each = room // length
            full = min(count, left // each)
            if full:
                out.append((done, first, each, capacity - room))
                add(room - each * length, first, full)
                done, left, first, count = done + full * each, left - full * each, first + full, count - full
            if left and count:
                out.append((done, first, left, capacity - room))
                add(room - left * length, first, 1)
                done, left, first, count = done + left, 0, first + 1, count - 1
            add(room, first, count)
    return runs


#: Byte-level BPE's printable stand-ins: a byte that is no printable Latin-1 character is written as one from U+0100 on.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: chr(b) for b in PRINTABLE} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in set(PRINTABLE))}


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: A lower-case word of Latin-1 letters and the marks after it: two pre-tokens, which the model alone can encode.
PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([.,;:!?#$%&*|]*)")
#: Text that must be encoded as a whole: special tokens, and separators at which only Python splits.
WHOLE = re.compile("<\\||[\x1c-\x1f]")


class Encoder:
    """Little-endian 32-bit ids of whole texts. White space ends every pre-token of this tokenizer, so words are encoded once and remembered."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered, self.tokenizer = remembered, tokenizer(path)
        self.model, self.words, self.older_words, self.plain, self.older_plain = self.tokenizer.model, {}, {}, {}, {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def piece(self, letters: str) -> bytes:
        """A pre-token in the byte-level alphabet, where only bytes outside printable ASCII are written otherwise."""
        if (found := self.plain.get(letters)) is None:
            if len(self.plain) > self.remembered // 2:
                self.plain, self.older_plain = {}, self.plain
            if (found := self.older_plain.get(letters)) is None:
                spelled = letters if letters.isascii() else "".join(BYTE_CHARS[b] for b in letters.encode())
                found = np.array([x.id for x in self.model.tokenize(spelled)], dtype="<u4").tobytes()
            self.plain[letters] = found
        return found

    def word(self, word: str) -> bytes:
        if (found := self.older_words.get(word)) is not None:
            pass
        elif m := PLAIN.fullmatch(word.lower()):
            found = self.piece(m[1]) + (self.piece(m[2]) if m[2] else b"")
        else:
            found = self.whole(word)
        self.words[word] = found
        return found

    def ids(self, texts: list[str | None]) -> Iterator[bytes]:
        for text in texts:
            if not text:
                yield b""
            elif WHOLE.search(text):
                yield self.whole(text)
            else:
                if len(self.words) > self.remembered:
                    self.words, self.older_words = {}, self.words
                known, word = self.words.get, self.word
                yield b"".join([known(w) or word(w) for w in text.split()])


def pieces(df: DataFrame, tokenizer_path: str, capacity: int, end_id: int, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True, remembered: int = REMEMBERED) -> DataFrame:
    """`keep` columns, piece, start, length, ids_crc32 and, if asked for, ids: documents cut where they exceed the capacity."""
    kept = df.select(*keep)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]
    schema = ", ".join([*fields, "piece int", "start long", "length long", "ids_crc32 long", *(["ids array<int>"] if with_ids else [])])
    end = np.array([end_id], dtype="<u4").tobytes()
    step = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path, remembered)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                rows, numbers, parts = [], [], []
                for i, ids in enumerate(encoder.ids(some.column(0).to_pylist())):
                    ids += end
                    for p in range(0, len(ids), step):
                        rows.append(i)
                        numbers.append(p // step)
                        parts.append(ids[p : p + step])
                lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
                numbers = np.array(numbers, dtype=np.int32)
                columns = [some.column(k + 1).take(pa.array(rows)) for k in range(len(keep))]
                columns += [pa.array(numbers), pa.array(numbers.astype(np.int64) * capacity), pa.array(lengths), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), dtype="<i4"))))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    return df.select(F.col(text), *keep).mapInArrow(cut, schema)


def pack(rows: DataFrame, capacity: int, length: str = "length", key: tuple[str, ...] = ("doc_id", "piece"), sequence: str = "sequence_id", offset: str = "offset", seed: int = 23) -> DataFrame:
    """Add `sequence` and `offset` to every piece. Only the histogram of lengths comes to the driver.

    The rows are read twice, so pass a table that is cheap to read. Lengths lie in 1..capacity.
    """
    # at most `capacity` rows; written, so that the join knows how few
    sizes = Scratch(rows.sparkSession, "lengths").save(rows.groupBy(length).agg(F.count(F.lit(1)).alias("__size")), "sizes")
    histogram = {r[0]: r[1] for r in sizes.collect()}
    runs = plan(histogram, capacity)
    h = F.xxhash64(F.lit(seed), *[F.col(c) for c in key])
    ranked = spread_rank(
        rows.join(sizes, length).withColumn("__h", h), [length], "__size", [F.col("__h"), *[F.col(c) for c in key]], F.col("__h"), "__rank"
    ).drop("__size", "__h")
    starts = {n: [r[0] for r in found] for n, found in runs.items()}

    @F.pandas_udf("sequence long, offset long")
    def place(lengths, ranks):
        import pandas as pd

        out = np.empty((2, len(lengths)), dtype=np.int64)
        for i, (n, rank) in enumerate(zip(lengths.tolist(), ranks.tolist(), strict=True)):
            first, bin_, each, at = runs[n][bisect_right(starts[n], rank) - 1]
            out[0, i], out[1, i] = bin_ + (rank - first) // each, at + (rank - first) % each * n
        return pd.DataFrame({"sequence": out[0], "offset": out[1]})

    spot = free_name(ranked, "__spot")
    return ranked.withColumn(spot, place(F.col(length), F.col("__rank"))).withColumns({sequence: F.col(f"{spot}.sequence"), offset: F.col(f"{spot}.offset")}).drop(spot, "__rank")


def pack_documents(df: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = True, keep: tuple[str, ...] = ("doc_id",), remembered: int = REMEMBERED) -> DataFrame:
    """Tokenize, cut and pack: a row for each piece with its place. Tokens are made once and kept in the shared folder. `remembered` trades memory for time."""
    made = Scratch(df.sparkSession, "pack").save(pieces(df, tokenizer_path, capacity, end_id, keep=keep, with_ids=with_ids, remembered=remembered), "pieces")
    return pack(made, capacity, key=(*keep, "piece", "ids_crc32"))
