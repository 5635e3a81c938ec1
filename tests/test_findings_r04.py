"""Cases of the findings of round 4."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from folio.functions import text as tx
from folio.operators import authority, cosine, lexicon, titles


@pytest.mark.parametrize("people,docs,held", [(100_000, 10_000, 1 << 27), (1, 1, 1), (2, 10_000, 1), (1, 10_000, 1 << 27)])
def test_names_move_no_texts(spark, monkeypatch, people, docs, held):
    """F5. Texts are looked up where they lie, in all blocks of people; only where keys come again do their rows move, once, and add up, also over chunks."""
    for c, v in (("PEOPLE", people), ("DOCS", docs), ("HELD", held)):
        monkeypatch.setattr(lexicon, c, v)
    names = [(w, f) for w, f in enumerate(["Ann Rao", "bo", "rao", "rao-bo", "nobody", "ann", "..."])] + [(1, "Bo Lee"), (None, "rao")]
    forms = spark.createDataFrame(names, "w int, f string")
    texts = ["ann rao and Bo", "Bo Lee rao-bo", "", None, "ANN", "Rao; ann\nrao"]
    found = [{0: 1, 1: 1, 2: 1, 5: 1, None: 1}, {1: 2, 2: 1, 3: 1, None: 1}, {}, {}, {5: 1}, {2: 1, 5: 1, None: 1}]

    def want(keys):
        out = {}
        for d, f in zip(keys, itertools.cycle(found)):
            for w, n in f.items():
                out[d, w] = out.get((d, w), 0) + n
        return {(d, w, n) for (d, w), n in out.items()}

    def got(keys, slices):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
        try:
            rows = spark.createDataFrame(list(zip(keys, itertools.cycle(texts))), "d int, t string").repartition(slices)
            made = lexicon.names_in(rows, "d", "t", forms, "w", "f")
            listed = [tuple(r) for r in made.collect()]
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(listed) == len(set((d, w) for d, w, _ in listed))
        return set(listed), made._jdf.queryExecution().optimizedPlan().toString()

    once = [*range(23), None]
    rows, plan = got(once, 2)
    assert rows == want(once) and "RepartitionByExpression" not in plan and "Join" not in plan
    again = [None] * 13 + [1] * 40 + [2, 3, 3, 4] + [5] * 7
    rows, plan = got(again, 3)
    assert rows == want(again) and plan.count("RepartitionByExpression") == 1 and "Join" not in plan and "Aggregate" not in plan
    assert got([], 1)[0] == set()


@pytest.mark.parametrize("letters", ["ab ", "théndof ", "ab\0 "])
def test_titles_of_any_length_are_scored_as_one_by_one(letters):
    """F3. The block's titles in the bits of numbers: titles of 64 letters, of more, of many words, of none."""
    rng = random.Random(letters)
    make = lambda k: " ".join(sorted({w for w in "".join(rng.choices(letters, k=k)).split(" ") if w}))
    shapes = sorted({make(rng.choice([0, 1, 3, 20, 40, 64, 65, 120])) for _ in range(150)} | {"a" * n for n in (63, 64, 65, 300)} | {" ".join(sorted(f"w{i}" for i in range(n))) for n in (31, 32, 40)})
    block = titles.Postings(shapes, list(range(len(shapes))))
    for mine in [*rng.sample(shapes, 12), "", "a" * 64, "a" * 300, make(300), " ".join(sorted(f"w{i}" for i in range(35)))]:
        scored = sorted((-round(tx.token_set_ratio(mine, other), 9), i) for i, other in enumerate(shapes))
        for floor in (0.0, 55.0, 100.0):
            got = block.best(mine, floor, False, 4)
            assert [(i, round(s, 9)) for i, s in got] == [(i, -s) for s, i in scored[:4] if -s >= floor]


def test_titles_that_stand_whole_in_others_spare_visits(spark, monkeypatch):
    """F3. Titles of one word give the highest score early, so blocks of other lengths are not visited."""
    monkeypatch.setattr(titles, "BLOCK", 4)
    seen, save = {}, titles.Scratch.save
    monkeypatch.setattr(titles.Scratch, "save", lambda self, df, name: (seen.setdefault(name, df.count()), save(self, df, name))[1])
    stock = ["abc", "bcd", "cde", *("x" * k + "y" * (k % 3) for k in range(8, 60))]
    inventory = spark.createDataFrame(list(enumerate(stock)), "o int, u string")
    got = authority.nearest_titles(spark.createDataFrame([(1, "abc bcd cde def efg fgh xyz")], "k int, t string"), "k", "t", inventory, "o", "u").collect()
    assert {(r.o, r.score) for r in got} == {(0, 100), (1, 100), (2, 100)}
    assert seen["home_of"] == 2 and seen["visits"] <= 1


def test_vectors_are_made_once_and_blocks_read_by_fewer_tasks(spark, monkeypatch):
    """F4. Weights aren't made for the frequencies and again, and where blocks are many a task visits all with the documents of some."""
    docs, plans, tasks = 40, {}, []
    vectors = spark.createDataFrame([(i, t, 0.6 if t == "all" else 0.8) for i in range(docs) for t in ("all", f"t{i // 3}")], "doc int, term string, weight double").filter(F.xxhash64("doc", "term") != 7)
    groups = spark.createDataFrame([(i, f"g{i}") for i in range(docs)], "doc int, col string")
    save, mapped = cosine.Scratch.save, type(vectors).mapInArrow
    monkeypatch.setattr(cosine.Scratch, "save", lambda self, df, name: (plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()), save(self, df, name))[1])
    monkeypatch.setattr(type(vectors), "mapInArrow", lambda self, f, *a, **b: (tasks.append(self.rdd.getNumPartitions()), mapped(self, f, *a, **b))[1])
    found = cosine.nearest(vectors, "doc", groups, "col", block=1).collect()
    assert sorted(r.b for r in found if r.a == 4 and r.score > 0.9) == [3, 5] and len(found) == 5 * docs
    assert sum("xxhash64(doc" in p and "term" in p for n, p in plans.items() if n != "nearest") == 1
    assert tasks == [20]
