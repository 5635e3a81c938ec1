"""Bounded searches in tiles against scoring all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.functions import text as tx
from folio.operators import authority, cosine, related, titles


def plain_greedy(scores, group, total, each):
    out, taken = [], {}
    for b, s in sorted(scores.items(), key=lambda x: (-x[1], x[0])):
        if taken.get(group[b], 0) < each and len(out) < total:
            taken[group[b]] = taken.get(group[b], 0) + 1
            out.append((b, s))
    return out


@pytest.mark.parametrize(("block", "visitors", "themes"), [(7, 3, 3), (20, 1000, 30), (1000, 10, 1)])
def test_nearest_by_cosine_equals_all_pairs(spark, monkeypatch, block, visitors, themes):
    """Also with copies, documents that resemble none, and a collection that holds most."""
    monkeypatch.setattr(cosine, "VISITORS", visitors)
    rng = random.Random(block)
    words = {k: [f"t{k}w{i}" for i in range(12)] for k in range(themes)}
    docs = {i: [*rng.choices(words[rng.randrange(themes)], k=rng.randint(1, 8)), *rng.choices(["x", "y", "z"], k=2)] for i in range(90)}
    docs |= {90 + i: docs[5] for i in range(9)} | {200: ["alone"]}
    group = {i: None if i == 3 else "big" if i % 3 else f"c{i % 5}" for i in docs}
    vectors = {}
    for i, ws in docs.items():
        w = {t: rng.random() + 0.2 if i < 90 or i == 200 else vectors[5][t] for t in dict.fromkeys(ws)}
        norm = sum(x * x for x in w.values()) ** 0.5
        vectors[i] = {t: x / norm for t, x in w.items()}
    df = spark.createDataFrame([(i, t, x) for i, v in vectors.items() for t, x in v.items()], "doc int, term string, weight double")
    groups = spark.createDataFrame(list(group.items()), "doc int, col string")
    got = {}
    for r in related.top_related(cosine.nearest(df, "doc", groups, "col", block=block), groups, "doc", "col").collect():
        got.setdefault(r.a, {})[r.rank] = (r.b, r.score)
    for a, v in vectors.items():
        scores = {b: round(sum(x * u.get(t, 0) for t, x in v.items()), 9) for b, u in vectors.items() if b != a}
        want = plain_greedy({b: s for b, s in scores.items() if s >= 0.05}, group, 5, 3)
        assert got.get(a, {}) == {k: (b, round(s, 4)) for k, (b, s) in enumerate(want, 1)}, a


def test_bounds_spare_most_of_the_heavy_terms():
    """With a high floor a block scores few documents with the terms that all of them have."""
    rng = np.random.default_rng(1)
    terms = [np.array([i // 4, 200 + i % 3, *range(300, 330)]) for i in range(400)]
    weights = [np.array([0.9, 0.3, *rng.random(30) / 25]) for _ in range(400)]
    weights = [w / np.linalg.norm(w) for w in weights]
    block = cosine.Block(list(range(400)), ["a"] * 400, terms, weights)
    seen = []
    block.exact = lambda alive, at, w, f=block.exact: (seen.append(len(alive)), f(alive, at, w))[1]
    picked = block.best(0, terms[0], weights[0], 0.7, 5, 5)
    assert {i for i, _ in picked} == {1, 2, 3} and seen and seen[0] <= 8


def test_nearest_of_nothing(spark):
    df = spark.createDataFrame([], "doc int, term string, weight double")
    assert cosine.nearest(df, "doc", spark.createDataFrame([], "doc int, col string"), "col").count() == 0


WORDS = "the road to freedom ruin at midnight on liberty and a of law order state market free india essay letters zebra".split()


@pytest.mark.parametrize(("block", "visitors"), [(4, 3), (25, 10), (4096, 512)])
def test_nearest_titles_equal_all_pairs(spark, monkeypatch, block, visitors):
    monkeypatch.setattr(titles, "BLOCK", block)
    monkeypatch.setattr(titles, "VISITORS", visitors)
    rng = random.Random(block)
    make = lambda: " ".join(rng.choices(WORDS, k=rng.randint(1, 7)))
    inventory = [make() for _ in range(110)] + ["qqq", "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz", "", None, "road road road"]
    inventory = list(enumerate(inventory + rng.choices(inventory, k=40)))
    misses = [make() for _ in range(30)] + ["freedum rode", "vvv", "", None, "zzz qqq", "roadtofreedom", inventory[7][1], inventory[7][1]]
    df = spark.createDataFrame(list(enumerate(misses)), "k int, t string")
    got = authority.nearest_titles(df, "k", "t", spark.createDataFrame(inventory, "o int, u string"), "o", "u").collect()
    want = []
    for k, m in enumerate(misses):
        scored = sorted((-int(tx.token_set_ratio(m or "", u or "")), o) for o, u in inventory)
        want += [(k, o, -s, r) for r, (s, o) in enumerate(scored[:3], 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert any(not set((misses[k] or "").split()) & set((dict(inventory)[o] or "").split()) and s > 0 for k, o, s, _ in want)


def test_few_titles(spark):
    inventory = spark.createDataFrame([(1, "a b"), (2, "c")], "o int, u string")
    got = authority.nearest_titles(spark.createDataFrame([(1, "b"), (2, "x")], "k int, t string"), "k", "t", inventory, "o", "u").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 100, 1), (1, 2, 0, 2), (2, 1, 0, 1), (2, 2, 0, 2)]
    assert authority.nearest_titles(inventory.limit(0), "o", "u", inventory.withColumnRenamed("o", "p"), "p", "u").count() == 0


def test_common_letters_equals_cells():
    rng = random.Random(5)
    for _ in range(500):
        a, b = ("".join(rng.choices("abcdé ", k=rng.randint(0, 90))) for _ in "ab")
        row = [0] * (len(b) + 1)
        for ch in a:
            before = 0
            for j, x in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if ch == x else max(row[j], row[j - 1])
        assert tx.common_letters(a, b) == row[-1]


def test_no_rows_of_pairs(spark, sf_dir):
    """No join on a term or a word carries both documents of a pair."""
    docs = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.lower("p_name").alias("t"))
    plan = authority.nearest_titles(docs, "p_partkey", "t", docs.withColumnsRenamed({"p_partkey": "o", "t": "u"}), "o", "u")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
