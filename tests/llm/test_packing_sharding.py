"""Packing and sharding against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folio.llm import packing, sharding
from folio.llm.queries import QUERIES, tokenizer_path


def best_fit_decreasing(lengths, capacity):
    """One piece at a time into the tightest open bin; the number of bins."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        best = min((r for r in range(len(rooms)) if rooms[r] >= n), key=lambda r: rooms[r], default=None)
        if best is None:
            rooms.append(capacity)
            best = len(rooms) - 1
        rooms[best] -= n
    return len(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 64, 100])
    lengths = [r.choice([1, 3, capacity, r.randint(1, capacity), r.randint(1, capacity // 3)]) for _ in range(r.randint(0, 400))]
    runs = packing.plan(Counter(lengths), capacity)
    bins = defaultdict(list)
    for n, found in runs.items():
        total = Counter(lengths)[n]
        for i, (first, bin_, each, at) in enumerate(found):
            upto = found[i + 1][0] if i + 1 < len(found) else total
            for rank in range(first, upto):
                bins[bin_ + (rank - first) // each].append((at + (rank - first) % each * n, n))
    assert sum(map(len, bins.values())) == len(lengths)
    for parts in bins.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= capacity
    assert len(bins) == best_fit_decreasing(lengths, capacity)


def test_segment_tree_finds_the_tightest_bin():
    tree = packing.TightestBin(100)
    open_ = set()
    r = random.Random(1)
    for _ in range(500):
        x = r.randint(0, 100)
        tree.put(x, x not in open_)
        open_ ^= {x}
        need = r.randint(0, 100)
        assert tree.at_least(need) == min((o for o in open_ if o >= need), default=None)


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    texts = ["Hello, world!! Thé <|endoftext|> x", "", "a\x1cb\x85c", "don't we'll 1234 ¿qué? ÀÉÎ ﬁ é İ ΣΑΣ", " \n\t ", "日本語 x²y", "of%%% le*** x|y"]
    import numpy as np

    for text, ids in zip(texts, packing.Encoder(tokenizer_path()).ids(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_op1_round_trip(spark, sf_dir):
    import numpy as np
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op1_best_fit_packing"](spark, sf_dir).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append((r.offset, r.length))
    for d, text in docs.items():
        ids = t.encode(text, add_special_tokens=False).ids + [1]
        parts = sorted(by_doc[d], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(-(-len(ids) // 4096)))
        for r in parts:
            mine = ids[r.start : r.start + r.length]
            assert r.start == 4096 * r.piece and len(mine) == min(4096, len(ids) - r.start)
            assert r.ids_crc32 == zlib.crc32(np.array(mine, "<u4").tobytes())
    for parts in by_bin.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 4096
    assert len(by_bin) == best_fit_decreasing([r.length for r in rows], 4096)


def test_pack_hostile_rows(spark):
    df = spark.createDataFrame([(None, None, "x"), (1, "", "y"), (1, "", "y"), (2, "word " * 9000, "z")], "doc_id long, text string, sequence_id string")
    rows = packing.pack_documents(df, tokenizer_path(), with_ids=True).collect()
    assert sorted((r.doc_id or 0, r.piece, r.length, len(r.ids)) for r in rows) == [(0, 0, 1, 1), (1, 0, 1, 1), (1, 0, 1, 1), (2, 0, 4096, 4096), (2, 1, 4096, 4096), (2, 2, 809, 809)]
    assert len({(r.sequence_id, r.offset) for r in rows}) == 6
    assert packing.pack_documents(df.limit(0), tokenizer_path()).count() == 0


def test_op2_rows_law_and_mixture(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op2_sharding"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    by = defaultdict(list)
    for r in rows:
        text = docs[r.doc_id].text or ""
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text.encode()) + 1, zlib.crc32(text.encode()), "rows", None)
        by[r.shard].append(r)
    assert set(by) == set(range(16))
    sizes = [len(x) for x in by.values()]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    total = Counter(d.source for d in docs.values())
    for x in by.values():
        here = Counter(docs[r.doc_id].source for r in x)
        assert all(abs(here[s] - n / 16) <= 2 for s, n in total.items())


def test_interleave_brute_force(spark):
    r = random.Random(3)
    data = [(i if i % 50 else None, r.choice(["a"] * 8 + ["b", None]), "old", "p") for i in range(700)] + [(7, "a", "old", "p")] * 5
    df = spark.createDataFrame(data, "doc_id long, source string, shard string, extra string")
    small = sharding.ROWS_PER_BUCKET
    from folio.llm import common

    common.ROWS_PER_BUCKET = sharding.ROWS_PER_BUCKET = 40  # many buckets
    try:
        rows = sharding.interleave(df, 7).withColumn("h", F.xxhash64(F.lit(17), "doc_id")).collect()
    finally:
        common.ROWS_PER_BUCKET = sharding.ROWS_PER_BUCKET = small
    assert Counter((x.doc_id, x.source, x.extra) for x in rows) == Counter((a, b, d) for a, b, _, d in data)
    sizes = Counter(x.shard for x in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(7):
        assert sorted(x.slot for x in rows if x.shard == s) == list(range(sizes[s]))
    total = Counter(b for _, b, _, _ in data)
    for (s, b), n in Counter((x.shard, x.source) for x in rows).items():
        assert abs(n - total[b] / 7) <= 2
    assert sharding.interleave(df.limit(0), 3).count() == 0


def test_sources_of_one_row_spread_over_the_shards(spark):
    rows = spark.createDataFrame([(i, f"s{i}") for i in range(4000)] + [(i, "large") for i in range(4000, 8000)], "doc_id long, source string")
    made = sharding.interleave(rows, 8).collect()
    for k in range(8):
        mine = [r for r in made if r.shard == k]
        assert len(mine) == 1000 and 400 < sum(r.source == "large" for r in mine) < 600
