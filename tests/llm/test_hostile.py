"""Null keys, repeated rows and input order in near-dedup, mixing and the pipeline's stages."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folio.llm import mixing, simhash

WORDS = [f"word{i}" for i in range(400)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, __row int, epoch int"


def prose(seed, n=300):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def near(text):
    return text.replace("word7 ", "word8 ")


@pytest.mark.parametrize("settings", [{"shingle": 4, "radius": 4}, {"shingle": None, "radius": 5, "count": 4}])
def test_near_duplicates_with_null_keys(spark, settings):
    a, b = prose(1), prose(2)
    rows = [(None, a), (5, near(a)), (3, a), (None, b), (None, near(b)), (9, prose(3)), (-4, prose(3))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(df, **settings).collect())
    if settings["shingle"] is None:
        assert got == Counter({(None, 3): 1, (5, 3): 1, (3, 3): 1, (None, None): 2, (9, -4): 1, (-4, -4): 1})
    else:  # copies only are sure to be linked
        assert got[None, 3] == got[3, 3] == got[9, -4] == got[-4, -4] == 1 and sum(got.values()) == len(rows)


def hostile(spark):
    a, b = prose(1), prose(2)
    rows = [
        (None, a, "en", "src1"), (5, near(a), "en", None), (3, a, "en", "src1"), (3, a, "en", "src1"), (None, b, None, "src2"), (None, near(b), "en", "src2"), (7, None, "en", "src1"), (8, "", None, None),
        (9, " \n ", "de", "src3"), (10, prose(4, 30_000), "en", "src4"), (11, prose(5), "en", "src1"), (11, prose(6), "en", "src1"), (11, prose(6), "en", "src1"),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "x", 1, 2) for r in rows], DOCS).repartition(3)


def test_near_dedup_keeps_one_row_of_each_group(spark, tmp_path):
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, hostile(spark), "").collect())
    a, b = prose(1), prose(2)
    expected = Counter({(3, a): 1, (7, None): 1, (10, prose(4, 30_000)): 1, (11, prose(5)): 1, (11, prose(6)): 1})
    last = kept - expected
    assert expected <= kept and sum(last.values()) == 1 and next(iter(last)) in {(None, b), (None, near(b))}


def test_pipeline_stages_on_hostile_rows(spark, tmp_path):
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, hostile(spark), "")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert made.columns == corpus_pipeline.COLUMNS
        assert made.count() > 0, name
        assert stage(spark, hostile(spark).limit(0), "").count() == 0, name


def test_mixing_does_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2]), prose(rng.randrange(9), rng.randint(1, 30)), "en", rng.choice(["src1", "src2", None]), rng.randrange(3)) for _ in range(300)]
    found = set()
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, __h int").repartition(seed + 1)
        made = mixing.mix(df, ["lang", "source"], fraction=0.6, max_epochs=2)
        assert made.columns == ["doc_id", "text", "lang", "source", "__h", "n_tokens", "epoch", "start_token", "leaf_quota"]
        found.add(frozenset(Counter(tuple(r) for r in made.collect()).items()))
    assert len(found) == 1


def test_mixed_prefixes_equal_plain_sums(spark):
    """Each epoch's rows begin where the sums of the rows before them end, whole up to the quota."""
    rows = [(i % 7, prose(i, i % 11), "en", "src1") for i in range(80)]
    made = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), ["source"], fraction=0.5, max_epochs=1).orderBy("start_token", "n_tokens").collect()
    at = 0
    for r in made:
        assert r.start_token == at
        at += r.n_tokens
    total = sum(len(t.split()) for _, t, *_ in rows)
    assert total * 0.5 <= at < total * 0.5 + 11
