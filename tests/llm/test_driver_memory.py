"""Joins whose both sides grow with the texts are not left to the size of a file, which is far below that of the rows."""

import pytest

from folio.llm import simhash, spelling

WORDS = "alpha beta gamma delta epsilon zeta theta kappa lambda omega".split()


@pytest.fixture
def plans(monkeypatch):
    """The plan of each table that an operator writes, by its name."""
    found, save = {}, simhash.Scratch.save

    def kept(self, df, name):
        found[name] = df._jdf.queryExecution().executedPlan().toString()
        return save(self, df, name)

    monkeypatch.setattr(simhash.Scratch, "save", kept)
    return found


def test_near_duplicates_broadcast_no_buckets(spark, plans, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", 0)
    texts = [" ".join(WORDS[(i // 2 * k) % 10] for k in range(1, 30)) + f" {i // 2}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = simhash.near_duplicates(docs, shingle=4)
    plans["made"] = made._jdf.queryExecution().executedPlan().toString()
    of = {r.doc_id: r.component_id for r in made.collect()}
    assert len(of) == 40 and all(of[i] == of[i - 1] for i in range(1, 40, 2))
    for name in ("parts", "shared", "grouped", "made"):
        assert "SortMergeJoin" in plans[name] and "BroadcastExchange" not in plans[name], name
    assert not [n for n, p in plans.items() if n.startswith(("early", "star")) and "BroadcastExchange" in p]


def test_spelling_variants_broadcast_no_zones(spark, plans):
    words = [w * 2 for w in WORDS] + [w * 2 + "s" for w in WORDS]
    docs = spark.createDataFrame([(i, " ".join(words[:10] * 5 + words[10:])) for i in range(5)], "doc_id long, text string")
    made = spelling.spelling_variants(docs, every=10**9)
    plans["made"] = made._jdf.queryExecution().executedPlan().toString()
    got = {r.word: (r.form, r.root, r.n, r.n_near) for r in made.collect()}
    assert got == {w: (None, w, 25, 1) for w in words[:10]} | {w: (w[:-1], w[:-1], 5, 1) for w in words[10:]}
    for name in ("pairs", "known", "roots1", "made"):
        assert "SortMergeJoin" in plans[name] and "BroadcastExchange" not in plans[name], name
