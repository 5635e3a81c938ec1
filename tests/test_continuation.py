"""Continuation loops against a plain loop, as a batch and as keyed state; small rules of records."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folio.operators import profile, rules
from folio.streaming import continuation
from tests.test_sources_streams import Held


def plain_log(places, toc, budget):
    rendered, merges, idle, out = set(), 0, 0, []
    for seq, place in enumerate(places, 1):
        if merges >= budget:
            out.append((seq, "spent", len(toc) - len(rendered), budget - merges))
            break
        if place is None:
            out.append((seq, "skipped", len(toc) - len(rendered), budget - merges))
            continue
        merges += 1
        fresh = place in toc and place not in rendered
        idle = 0 if fresh else idle + 1
        rendered |= {place} if fresh else set()
        out.append((seq, "stalled" if idle == 2 else "merged" if fresh else "repeated", len(toc) - len(rendered), budget - merges))
        if idle == 2:
            break
    return out


def works(n, seed):
    rng = random.Random(seed)
    return {w: ([rng.choice([None, 0, 1, 2, 3, 4, 5]) for _ in range(rng.randint(1, 12))], list(range(rng.randint(0, 5)))) for w in range(n)}


@pytest.mark.parametrize("budget", [0, 3, 9])
def test_batch_equals_the_loop(spark, budget):
    made = works(120, budget)
    rows = [(w, at, p, toc) for w, (places, toc) in made.items() for at, p in enumerate(places)]
    random.Random(1).shuffle(rows)
    got = {}
    for r in continuation.progress(spark.createDataFrame(rows, "work long, at int, toc_index int, toc array<int>"), ["at"], budget).orderBy("work", "seq").collect():
        got.setdefault(r.work, []).append((r.seq, r.event, r.left, r.budget))
    assert got == {w: plain_log(places, toc, budget) for w, (places, toc) in made.items()}


class Places(Held):
    """Two states of one key."""

    def __init__(self):
        super().__init__()
        self.kept = {}

    def getListState(self, name, schema):
        return self.kept.setdefault(name, Held())

    def getValueState(self, name, schema):
        return self.kept.setdefault(name, Value())


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


@pytest.mark.parametrize("budget", [3, 9])
def test_state_equals_the_loop_however_chunks_are_dealt(budget):
    rng = random.Random(budget)
    for places, toc in works(60, budget + 1).values():
        loop, held, out, at = continuation.Continuation(budget), Places(), [], 0
        loop.init(held)
        while at < len(places):
            n = rng.randint(1, 4)
            df = pd.DataFrame({"at": range(at, min(len(places), at + n)), "toc_index": places[at : at + n], "toc": [toc] * len(places[at : at + n])})
            for made in loop.handleInputRows((7,), iter([df]), held):
                out += [tuple(x)[1:] for x in made.itertuples(index=False)]
            at += n
        assert out == plain_log(places, toc, budget)


def test_outcomes(spark):
    log = spark.createDataFrame([(1, 1, "merged", 0), (2, 1, "stalled", 3), (3, 1, "spent", 1), (4, 1, "skipped", 2)], "work long, seq long, event string, left long")
    pages = spark.createDataFrame([(1, 10, 100), (2, 30, 100), (3, 0, 100), (4, 5, 0)], "work long, rendered int, total int")
    got = {r.work: tuple(r)[1:] for r in continuation.outcomes(log, pages).collect()}
    assert got == {1: ("complete", 0, False, True), 2: ("no_progress", 3, True, False), 3: ("dispatch_budget_exceeded", 1, True, False), 4: ("open", 2, False, False)}


def test_language_takes_the_first_term_of_the_row(spark):
    codes = {"english": "en", "hindi": "hi", "gujarati": "gu"}
    rows = [(["hindi", "english"], None), (["other"], ["hindi"]), ([], ["other", "gujarati"]), (None, ["hindi"]), (None, None), ([None, "hindi"], [])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>").coalesce(1)
    assert [r.x for r in df.select(rules.language_of(F.col("a"), F.col("b"), codes).alias("x")).collect()] == ["hi", "en", "gu", "hi", "en", "hi"]


def test_markers_of_names_mean_their_letters(spark):
    df = spark.createDataFrame([("Anna Rao",), ("A.N.A. Rao",), ("The (ed.) Rao",), ("How? Rao",), ("Jo",), ("a b c d e f",)], "n string").coalesce(1)
    assert [r.x for r in df.select(rules.real_name(F.col("n"), ["a.na", "(ed.", "a.n.a"]).alias("x")).collect()] == [True, False, False, False, False, False]


def test_marked_bodies(spark):
    df = spark.createDataFrame([("a\n## Original text\nb",), ("an OCR b",), ("## Page 2",), ("## page ocr",), (None,)], "b string").coalesce(1)
    body, again = rules.reset_body(F.col("b"), "-")
    assert [tuple(r) for r in df.select(body, again).collect()] == [("-", True), ("-", True), ("-", True), ("## page ocr", False), (None, False)]


def test_interviews_reshaped(spark):
    rows = [("i1", None, "T", " Asha ", "1999-05-01", None, None, " u ", "complete"), ("i2", "own", None, "  ", "soon", "hi", True, None, "none"), ("i3", None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "slug string, id string, title string, subject string, published string, language string, draft boolean, url string, status string")
    shape = profile.interview_as_work(*[F.col(c) for c in df.columns], F.lit(None).cast("string"))
    made, taken = profile.migrated(df, spark.createDataFrame([("i3",)], "slug string"), "slug", shape)
    got = {r.source_key: (r.id, r.title.main, r.authors, r.publication.language, r.publication.year, r.draft, r.url, r.needs_review) for r in made.collect()}
    assert got == {"i1": ("i1", "T", ["Asha"], "en", 1999, False, "u", True), "i2": ("own", "i2", [], "hi", None, True, None, True)} and [r.slug for r in taken.collect()] == ["i3"]


def test_taxonomy_profile_gathers_no_group(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, "hot").alias("g"), F.lit("k").alias("kind"), F.concat(F.lit("/a.pdf?"), F.col("id").cast("string")).alias("url"), F.array(F.lit("t")).alias("terms"))
    got = {r.g: (r.n, list(r.samples), r.missing, r.kinds, r.extensions) for r in profile.taxonomy_profile(rows, "g", "id", "kind", "url", "terms").collect()}
    assert got == {"hot": (3333, [1, 2, 4], 0, "k:3333", "pdf:3333"), None: (1667, [0, 3, 6], 0, "k:1667", "pdf:1667")}
