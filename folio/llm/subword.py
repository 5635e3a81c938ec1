"""SentencePiece encoding and decoding with a table of distinct chunks.

White space is written as a marker before each word. Where no piece of the model holds a marker after another letter,
pieces cannot cross from one marked word into the next, so a text's ids are those of its marked words one after another.
A task keeps a table of the distinct marked words (chunks) that it has met: for each lot of documents the new ones are
segmented once, all together, and the documents' ids are joined from the table by position. The table holds REMEMBERED
chunks at most and is then begun anew, which costs time and changes nothing. Words repeat within any stretch of text, so
tables of tasks save almost what one table of the corpus would, and no position of any text moves between machines.

A model whose pieces can cross markers, or which changes texts before it segments them, is used on whole texts.

Null text counts as empty and has no ids. Very long texts are encoded whole; a long run without spaces is one chunk, which
is not remembered. Repeated rows are encoded each for itself. Names of columns made must not be among those kept. An empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Chunks that a task's table holds, and letters of the longest that it remembers.
REMEMBERED, LONGEST = 400_000, 64
#: Documents and letters that are encoded at a time, about.
LOT, LETTERS = 256, 4_000_000
#: A marked word without its first marker, which the library puts before any text: further markers and what isn't one.
CHUNK = re.compile(f"{MARK}({MARK}*[^{MARK}]*)")


@lru_cache(maxsize=2)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def separable(path: str) -> bool:
    """Whether marked words can be segmented apart: texts are only marked before, and no piece holds a marker after another letter."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    rules, user_defined = model.normalizer_spec, 4
    only_marks = rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces and not rules.precompiled_charsmap
    return bool(only_marks) and not model.trainer_spec.treat_whitespace_as_suffix and all(p.type != user_defined and MARK not in p.piece.lstrip(MARK) for p in model.pieces)


def chunks(text: str) -> list[str]:
    """Marked words of the text in order, each without its first marker."""
    if not text:
        return []
    if MARK not in text and "  " not in text and text[0] != " ":
        return text.split(" ")
    return CHUNK.findall(MARK + text.replace(" ", MARK))


class ChunkTable:
    """Little-endian 32-bit ids of distinct chunks."""

    def __init__(self, path: str):
        self.model, self.apart = processor(path), separable(path)
        self.alone = np.array([self.model.piece_to_id(MARK)], dtype="<i4").tobytes()
        self.ids = {"": self.alone}  # the library makes nothing of an empty text; after a marker it is that marker

    def learn(self, new: list[str]) -> dict[str, bytes]:
        return {c: np.array(x, dtype="<i4").tobytes() for c, x in zip(new, self.model.encode(new, num_threads=1), strict=True)}

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.apart:
            return [np.array(x, dtype="<i4").tobytes() for x in self.model.encode(texts, num_threads=1)]
        parts = [chunks(t) for t in texts]
        distinct = set().union(*parts)
        new = [c for c in distinct if c not in self.ids]
        if len(self.ids) + len(new) > REMEMBERED:
            self.ids, new = {"": self.alone}, list(distinct - {""})
        self.ids |= self.learn(new)
        known = self.ids.__getitem__
        joined = [b"".join(map(known, p)) for p in parts]
        for c in new:
            if len(c) > LONGEST:
                del self.ids[c]
        return joined


def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about LOT rows and LETTERS letters of the first column."""
    for batch in batches:
        at, n, letters = 0, 0, 0
        for length in pc.binary_length(batch.column(0)).to_pylist():
            if n and (n == LOT or letters + (length or 0) > LETTERS):
                yield batch.slice(at, n)
                at, n, letters = at + n, 0, 0
            n, letters = n + 1, letters + (length or 0)
        if n:
            yield batch.slice(at, n)


def schema_of(df: DataFrame, keep: list[str]) -> list[str]:
    return [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]


def encode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """`keep` columns and ids: those that the library gives, without begin or end."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(path)
        for some in lots(batches):
            made = table.encode([t or "" for t in some.column(0).to_pylist()])
            ends = np.cumsum([0, *map(len, made)]) // 4
            flat = pa.array(np.frombuffer(b"".join(made), dtype="<i4"))
            yield pa.RecordBatch.from_arrays([*some.columns[1:], pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)], names=[*keep, ids])

    return df.select(F.col(text), *keep).mapInArrow(work, ", ".join([*schema_of(df, list(keep)), f"`{ids}` array<int>"]))


def decode(df: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), text: str = "decoded") -> DataFrame:
    """`keep` columns and the text that the library's decode makes of the ids; of null ids, the empty text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = processor(path)
        for batch in batches:
            for at in range(0, batch.num_rows, LOT):
                some = batch.slice(at, LOT)
                texts = [model.decode(x) if x else "" for x in some.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns[1:], pa.array(texts, pa.string())], names=[*keep, text])

    return df.select(F.col(ids), *keep).mapInArrow(work, ", ".join([*schema_of(df, list(keep)), f"`{text}` string"]))
