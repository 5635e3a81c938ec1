"""Line dedup by content-defined chunks of lines.

A text's lines are hashed, and a rolling hash over neighbouring line hashes puts a chunk boundary wherever it meets a
pattern, so boundaries depend on the lines near them and not on what stands before. A paragraph written as one long
line is wrapped at its sentence ends first, and a long stretch without such ends at words picked by their hash; such a
paragraph begins and ends a chunk, so that a passage is cut alike wherever it is inserted. Chunks whose hash occurs again
anywhere are compared byte by byte. Neighbouring repeated chunks make a run, which is then extended, line by line and
sentence by sentence, as far as what stands beside it equals what stands beside the first occurrence. Runs of
`least_words` words and more go. The passage stays in the document with the smallest key, at its first place there.

Null texts and texts without a repeated passage pass unchanged; a text that consists of one becomes empty. Rows never
go. Rows that share a key count as one document; rows equal in key and text are treated alike. Of null keys the
same holds, and they come last. A very long text is one row: it is chunked in one pass and cut in one. An empty table
gives an empty result; extra columns pass, but for one named removed_chars, which is replaced, and names that begin with
two underscores, which the operator takes for itself.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.llm.common import Scratch

#: Lines longer than this many bytes are wrapped at sentence ends; sentences longer than the second, at picked words.
WRAP, LONG = 160, 480
#: One line in so many ends a chunk, about; one word in so many ends a line of a long sentence.
DIVISOR, WORDS_A_LINE = 3, 16
SENTENCE = re.compile(rb"[.!?]+ ")
PIECE = re.compile(rb"\n|[.!?]+ ")
SPACED = re.compile(rb"(\S+)\s*")
MULTIPLIER = 0x9E3779B97F4A7C15
FULL, HALF = (1 << 64) - 1, 1 << 63
#: A hash with more than its part of all repeated chunks is hot, so at most HOT are; it is dealt out in SALTS parts.
HOT, SALTS = 2000, 64
#: Texts that a task turns into Python objects at once.
AT_ONCE = 128


def wrapped(text: bytes, start: int, end: int, ends: re.Pattern) -> list[tuple[int, int]]:
    """(start, end) of the sentences between two places, long ones cut at picked words."""
    out, at = [], start
    for stop in [*[m.end() for m in ends.finditer(text, start, end)], end]:
        if stop - at > LONG:
            for m in SPACED.finditer(text, at, stop):
                if zlib.crc32(m[1]) % WORDS_A_LINE == 0 and m.end() < stop:
                    out.append((at, m.end()))
                    at = m.end()
        if at < stop:
            out.append((at, stop))
        at = stop
    return out


def chunks(text: bytes) -> list[tuple[int, int, int]]:
    """(start, end, hash) of each chunk; together they are the text. The hash leaves out white space at the chunk's end.

    Lines include their line ends. A wrapped line begins and ends a chunk.
    """
    out, size, start, first, before = [], len(text), 0, 0, 0
    digest = xxhash.xxh64_intdigest
    while start < size:
        end = text.find(b"\n", start) + 1 or size
        if end - start <= WRAP:
            wraps, lines = False, ((start, end),)
        else:
            wraps, lines = True, wrapped(text, start, end, SENTENCE)
            if first < start:
                out.append((first, start, digest(text[first:start].rstrip()) - HALF))
            first, before = start, 0
        for a, b in lines:
            h = digest(text[a:b].rstrip())
            # the rolling hash of this line and the one before
            if (((before * MULTIPLIER + h) * MULTIPLIER & FULL) >> 32) % DIVISOR == 0 or wraps and b == end:
                # a chunk of one line has the line's hash
                out.append((first, b, (h if first == a else digest(text[first:b].rstrip())) - HALF))
                first = b
            before = h
        if wraps:
            before = 0
        start = end
    if first < size:
        out.append((first, size, digest(text[first:].rstrip()) - HALF))
    return out


def hash_table(df: DataFrame, text: str, key: str) -> DataFrame:
    """key, row (hash of the text) and the hashes of the chunks in their order."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, hashes = [0], []
            for t in batch.column(0).cast(pa.binary()):
                hashes += [x[2] for x in chunks(t.as_py() or b"")]
                at.append(len(hashes))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(hashes, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), lists], names=["key", "row", "hashes"])

    return df.select(F.col(text), F.col(key), F.xxhash64(text)).mapInArrow(make, f"key {df.schema[key].dataType.simpleString()}, row long, hashes array<long>")


def find_runs(asked, n: int) -> list[dict]:
    """Runs of neighbouring repeated chunks (numbers begin to stop), and which chunks of other texts they should equal.

    A chunk that stays, as the first of its class, ends a run, and nothing is taken from it: others lean on it. What
    stands between two such stretches, from `floor` and up to `ceiling`, may be taken from both sides. A run asks for
    stretches of the texts that hold its chunks first, and for what stands beside them where there is anything to compare.
    """
    stretches: list[list] = []
    for x in asked:
        if x["stays"]:
            stretches.append([x])
        elif stretches and not stretches[-1][0]["stays"] and stretches[-1][-1]["no"] + 1 == x["no"]:
            stretches[-1].append(x)
        else:
            stretches.append([x])
    out, floor = [], 0
    for k, run in enumerate(stretches):
        begin, stop = run[0]["no"], run[-1]["no"] + 1
        ceiling = stretches[k + 1][0]["no"] if k + 1 < len(stretches) else n
        if not run[0]["stays"]:
            asks: list[dict] = []
            for x in run:
                if asks and (asks[-1]["at"], asks[-1]["at_row"], asks[-1]["at_stop"]) == (x["at"], x["at_row"], x["at_no"]):
                    asks[-1]["at_stop"] += 1
                    asks[-1]["salt"] = max(asks[-1]["salt"], x["salt"])
                else:
                    asks.append({"at": x["at"], "at_row": x["at_row"], "at_begin": x["at_no"], "at_stop": x["at_no"] + 1, "salt": x["salt"], "left": False, "right": False})
            asks[0]["left"], asks[-1]["right"] = begin > floor, stop < ceiling
            out.append({"begin": begin, "stop": stop, "floor": floor, "ceiling": ceiling, "asks": asks})
        floor = stop
    return out


def dedup_lines(df: DataFrame, text: str = "text", key: str = "doc_id", least_words: int = 40) -> DataFrame:
    """The rows with repeated passages taken out of the text. Adds removed_chars (code points).

    Only hashes are dealt out for all chunks. They tell each document its runs and where these stand first; the bytes of
    those places, and what is beside them, are sent to the runs that asked and compared there. Of texts there is one
    exchange, which both uses share. A passage in a third of all documents is counted with partial aggregations, and dealt
    out in SALTS parts wherever it is joined.
    """
    scratch = Scratch(df.sparkSession, "lines")
    kind = df.schema[key].dataType.simpleString()
    others = [c for c in df.columns if c != "removed_chars"]
    # one struct, so that column pruning leaves the exchange of both uses alike
    docs = df.select(F.col(key).alias("__key"), F.xxhash64(text).alias("__row"), F.struct(*others).alias("__doc"))
    made = scratch.save(hash_table(df, text, key), "chunks")
    each = made.select("key", "row", F.size("hashes").alias("n"), F.posexplode("hashes").alias("no", "hash"))
    again = scratch.save(each.groupBy("hash").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "again")
    repeats = again.agg(F.sum("m")).first()[0] or 0
    hot = [r[0] for r in again.filter(F.col("m") > repeats // HOT + SALTS).select("hash").collect()]  # at most HOT
    is_hot = F.col("hash").isin(hot)
    one = F.when(is_hot, F.pmod(F.xxhash64("key", "row"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)).alias("salt")
    every = F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt")

    # the chunks worth comparing, each with the first place of its hash
    place = F.struct(F.col("key").isNull().alias("none"), "key", "row", "no")
    found = each.select("*", one).join(again.select("hash", every), ["hash", "salt"]).withColumn("first", F.min(place).over(Window.partitionBy("hash", "salt")))
    if hot:
        of_hot = found.filter(is_hot).groupBy("hash").agg(F.min("first").alias("of_hot"))  # at most HOT rows
        found = found.join(F.broadcast(of_hot), "hash", "left").withColumn("first", F.coalesce("of_hot", "first"))
    own = F.col("first.key").eqNullSafe(F.col("key"))
    chunk = F.struct("no", "hash", own.alias("own"), F.col("first.key").alias("at"), F.col("first.row").alias("at_row"), F.col("first.no").alias("at_no"), "salt")
    asked = found.groupBy("key", "row", "n").agg(F.array_sort(F.collect_set(chunk)).alias("asked"))
    ask = f"struct<at:{kind},at_row:long,at_begin:int,at_stop:int,salt:int,left:boolean,right:boolean>"

    @F.pandas_udf(f"array<struct<begin:int,stop:int,floor:int,ceiling:int,asks:array<{ask}>>>")
    def runs(asked: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for mine, m in zip(asked, n, strict=True):
            seen: set[int] = set()
            for x in mine:
                x["stays"] = x["own"] and x["hash"] not in seen
                seen.add(x["hash"])
            out.append(find_runs(mine, m))
        return pd.Series(out)

    # a deterministic function would be called by the filter and again by what it lets through
    plan = scratch.save(asked.select("key", "row", runs.asNondeterministic()("asked", "n").alias("runs")).filter(F.size("runs") > 0), "runs")
    asks = plan.select("key", "row", F.posexplode("runs").alias("run_no", "run")).select("key", "row", "run_no", F.posexplode("run.asks").alias("part", "ask")).select("key", "row", "run_no", "part", "ask.*")
    wanted = asks.groupBy("at", "at_row").agg(F.collect_set(F.struct("at_begin", "at_stop", "salt", "left", "right")).alias("wanted"))

    parts = pa.list_(pa.struct([(c, pa.int32()) for c in ("at_begin", "at_stop", "salt")] + [("left", pa.bool_()), ("right", pa.bool_()), ("bodies", pa.list_(pa.binary())), ("before", pa.binary()), ("behind", pa.binary())]))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(start, AT_ONCE)
                made = [answer(t, w) for t, w in zip(some.column(2).field(text).to_pylist(), some.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(made, parts)], names=["__at", "at_row", "a"])

    @F.pandas_udf("string")
    def cut(texts: pd.Series, runs: pd.Series, answers: pd.Series) -> pd.Series:
        return pd.Series([t if r is None or a is None else without(t, r, a, least_words) for t, r, a in zip(texts, runs, answers, strict=True)])

    asked_for = docs.join(wanted, F.col("__key").eqNullSafe(F.col("at")) & (F.col("__row") == F.col("at_row")))
    part = "struct<at_begin:int,at_stop:int,salt:int,left:boolean,right:boolean,bodies:array<binary>,before:binary,behind:binary>"
    answers = asked_for.select("at", "at_row", "__doc", "wanted").mapInArrow(stretches, f"__at {kind}, at_row long, a array<{part}>").select("__at", "at_row", F.explode("a").alias("a")).select("__at", "at_row", "a.*")
    answers = asks.join(answers, ["at_row", "at_begin", "at_stop", "salt", "left", "right"]).filter(F.col("at").eqNullSafe(F.col("__at")))
    answers = answers.groupBy("key", "row").agg(F.collect_set(F.struct("run_no", "part", "bodies", "before", "behind")).alias("answers"))
    full = plan.join(answers.withColumnsRenamed({"key": "k", "row": "r"}), F.col("key").eqNullSafe(F.col("k")) & (F.col("row") == F.col("r"))).select("key", "row", "runs", "answers")
    final = docs.join(full, F.col("__key").eqNullSafe(F.col("key")) & (F.col("__row") == F.col("row")), "left").select("__doc", "runs", "answers")
    # only texts that lose something go to Python
    kept = F.when(F.col("runs").isNull(), F.col("__doc")[text]).otherwise(cut(F.when(F.col("runs").isNotNull(), F.col("__doc")[text]), F.col("runs"), F.col("answers")))
    removed = F.coalesce(F.char_length(F.col("__doc")[text]) - F.char_length("__text"), F.lit(0)).alias("removed_chars")
    return final.withColumn("__text", kept).select(*[F.col("__text").alias(c) if c == text else F.col("__doc")[c].alias(c) for c in others], removed)


def answer(text: str, wanted) -> list[dict]:
    """The chunks of each stretch wanted, two chunks before it and one behind it.

    A passage's first boundary depends on the line before the passage, so its beginning may lie in two chunks.
    """
    body = text.encode()
    cuts = [x[0] for x in chunks(body)] + [len(body)]
    out = []
    for w in wanted:
        i, j = w["at_begin"], w["at_stop"]
        before = body[cuts[max(0, i - 2)] : cuts[i]] if w["left"] else b""
        behind = body[cuts[j] : cuts[min(j + 1, len(cuts) - 1)]] if w["right"] else b""
        out.append({**w, "bodies": [body[cuts[k] : cuts[k + 1]] for k in range(i, j)], "before": before, "behind": behind})
    return out


def equal_ahead(mine: Iterator[bytes], other: Iterator[bytes]) -> int:
    """How many of the first lines are equal; blank ones count only with a filled one behind them."""
    n = 0
    for k, (x, y) in enumerate(zip(mine, other), 1):
        if x.rstrip() != y.rstrip():
            break
        n = k if x.strip() else n
    return n


def without(text: str, runs, answers, least_words: int) -> str:
    """The text less its runs, each with the lines beside it that are equal to those beside its first place.

    A run whose bytes differ from those of the first places, by a collision of hashes, stays.
    """
    body = text.encode()
    cuts = [x[0] for x in chunks(body)] + [len(body)]
    parts: dict[int, list] = {}
    for x in sorted(answers, key=lambda x: (x["run_no"], x["part"])):
        parts.setdefault(x["run_no"], []).append(x)
    keep, at, taken = [], 0, 0
    for k, run in enumerate(runs):
        begin, stop, mine = cuts[run["begin"]], cuts[run["stop"]], parts.get(k, ())
        if [body[cuts[i] : cuts[i + 1]].rstrip() for i in range(run["begin"], run["stop"])] != [x.rstrip() for p in mine for x in p["bodies"]]:
            continue
        if other := mine[0]["before"]:
            lines = wrapped(body, max(taken, cuts[run["floor"]]), begin, PIECE)[::-1]
            n = equal_ahead((body[a:b] for a, b in lines), (other[a:b] for a, b in wrapped(other, 0, len(other), PIECE)[::-1]))
            begin = lines[n - 1][0] if n else begin
        if other := mine[-1]["behind"]:
            lines = wrapped(body, stop, cuts[run["ceiling"]], PIECE)
            n = equal_ahead((body[a:b] for a, b in lines), (other[a:b] for a, b in wrapped(other, 0, len(other), PIECE)))
            stop = lines[n - 1][1] if n else stop
        taken = stop
        if len(body[begin:stop].split()) >= least_words:
            keep.append(body[at:begin])
            at = stop
    return b"".join([*keep, body[at:]]).decode()
