"""Cases of the findings of round 3."""

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from folio.functions.text import common_letters
from folio.llm import linededup, lm
from folio.operators import cosine, joins, lexicon, titles
from folio.queries import ORACLE, QUERIES
from folio.streaming import breaker
from tests.compare import difference


def same_as_sql(spark, tmp_path, name, **tables):
    """None if a query over these small tables gives the rows of its SQL."""
    import duckdb

    connection = duckdb.connect()
    connection.sql("SET TimeZone = 'UTC'")
    for t, rows in tables.items():
        pq.write_table(rows if isinstance(rows, pa.Table) else pa.Table.from_pylist(rows), f"{tmp_path}/{t}.parquet")
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    return difference(spark, connection, QUERIES[name], ORACLE[name], str(tmp_path))


def test_breaker_counts_microseconds(spark, tmp_path):
    """F7. Two failures ten days apart to the microsecond, a microsecond less and more, in the same second or not."""
    at, day = 1_704_067_200_300_000, 86_400_000_000
    times = [(u, at + k) for u, gap in enumerate((10 * day, 10 * day - 1, 10 * day + 1, 10 * day + 600_000, 10 * day + 700_000)) for k in (0, gap)]
    rows = pa.table({"event_id": range(len(times)), "user_id": [u for u, _ in times], "event_type": ["error"] * len(times), "ts": pa.array([t for _, t in times], pa.timestamp("us"))})
    assert same_as_sql(spark, tmp_path, "circuit_breaker_batch", events=rows) is None
    df = spark.createDataFrame([("k", 0, 300_000, True, False), ("k", 1, 60_300_001, True, False)], "k string, i int, t long, bad boolean, good boolean").withColumn("ts", F.timestamp_micros("t"))
    assert [r.tripped for r in breaker.tripped(df, "k", ["ts", "i"], failures=2).orderBy("i").collect()] == [False, False]


def test_slugs_of_letters_without_accents_to_strip(spark, tmp_path):
    """F8. Letters of their own, ligatures, marks alone and Hangul."""
    texts = ["Enberßen oß", "Ørsted Łódź Æon", "ﬁn ½ ™ K", "Éclair & Co", "İstanbul ıx", "हिन्दी a", "e\u0301tude\u20dd x", "한글 b", "-", "", None]
    rows = [{"doc_id": i, "text": x, "lang": "en"} for i, x in enumerate(texts)]
    assert same_as_sql(spark, tmp_path, "title_slugs", documents=rows) is None
    people = [{"s_suppkey": i, "s_name": x} for i, x in enumerate(texts[:4])]
    assert same_as_sql(spark, tmp_path, "name_keys", supplier=people) is None


def test_passages_of_all_lengths(spark):
    """F5, F6. Passages cut from texts anywhere, also inside words, with blanks around, and of blanks alone; keys that come from an Arrow UDF."""
    import random

    from folio.functions import names
    from folio.operators import joins

    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abc", k=rng.randint(1, 4)))
    texts = [rng.choice([" ", "", "\n"]) + "".join(word() + rng.choice([" ", " ", "\n", "  "]) for _ in range(rng.randint(0, 14))) for _ in range(60)] + [None, "", "  ", "abcabc"]
    cuts = [(t := rng.choice([x for x in texts[:60] if x]))[(i := rng.randrange(len(t))) : i + rng.randint(1, 30)] for _ in range(120)] + ["", " ", "\n", "a", " b ", "zz", None]
    docs, quotes = spark.createDataFrame(list(enumerate(texts)), "d int, b string"), spark.createDataFrame(list(enumerate(cuts)), "i int, q string")
    for some in (cuts, [c for c in cuts if c and len(c.split()) > 2]):
        asked = quotes.filter(quotes.i.isin([i for i, c in enumerate(cuts) if c in some]))
        got = sorted(map(tuple, joins.passages_in(docs, "d", "b", asked, "i", "q").collect()))
        assert got == [(d, i) for d, b in enumerate(texts) for i, q in enumerate(cuts) if q and b is not None and q in some and q in b]
    keyed = quotes.select("i", names.compose(F.col("q")).alias("q")).filter("q <> ''")
    assert joins.passages_in(docs, "d", "b", keyed, "i", "q").count() == sum(q in b for b in texts if b is not None for q in cuts if q)


def test_records_carry_no_more_of_a_text_than_is_shown(spark, sf_dir):
    """F9 to F12. Whole texts don't travel with the records, and themes read no documents."""
    from folio.operators.occurrences import CONTEXT
    from folio.plans.base import Tables
    from folio.plans.synthesis import records

    said = records(Tables(spark, sf_dir)).select(F.explode("summary_structured.cross_thinker_mentions.context").alias("c"))
    assert said.agg(F.max(F.char_length("c"))).first()[0] == CONTEXT
    assert not any("documents.parquet" in f for f in QUERIES["theme_occurrences"](spark, sf_dir).inputFiles())


def test_discrepancies_in_tasks_of_so_many_rows(spark):
    """F14. Keys that repeat or are null, and more tasks for more rows."""
    from folio.operators import joins

    sides = ([(1, 1), (1, 1), (None, 2), (3, None), (4, 4)], [(1, 1), (None, 2), (5, 5), (5, 5)])
    made = joins.discrepancies(*[spark.createDataFrame(s, "k int, s int") for s in sides], ["k", "s"], rows_per_task=2)
    assert sorted(map(str, map(tuple, made.collect()))) == ["(3, None, 'ref-only')", "(4, 4, 'ref-only')", "(5, 5, 'prose-only')"]
    assert made.rdd.getNumPartitions() == 5


def test_works_in_tasks_of_so_many_rows(spark, sf_dir, monkeypatch):
    """F13. The number of tasks follows the table, with the rows of the SQL."""
    from folio.plans import catalogue
    from tests.compare import oracle

    monkeypatch.setattr(catalogue, "ROWS_PER_TASK", 500)
    assert difference(spark, oracle(sf_dir), QUERIES["works_authored"], ORACLE["works_authored"], sf_dir) is None
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert QUERIES["works_authored"](spark, sf_dir).rdd.getNumPartitions() == -(-rows // 500)


def test_one_exact_row_for_each_left_row_of_a_common_slug(spark):
    """F3. Rows of one slug are not paired each with each; the least rid counts, and its url."""
    left = spark.createDataFrame([(i, "s", "t", 1, "n") for i in range(300)] + [(900, "other", "t", 1, "n"), (901, None, "t", None, "n")], "id int, slug string, title string, year int, surname string")
    right = spark.createDataFrame([(5, "s", "x", 2, "b", "u"), (4, "s", "x", 2, "b", None), (3, "other", "x", 2, "b", "u"), *((i, "s", "x", 2, "b", "u") for i in range(10, 310))], "rid int, rslug string, rtitle string, ryear int, byline string, url string")
    made = joins.fuzzy_tiers(left, right)
    assert {tuple(r) for r in made.collect()} == {(i, 4, "page-only") for i in range(300)} | {(900, 3, "exact")}
    assert "Aggregate [rslug" in made._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("people", "docs"), [(100_000, 10_000), (2, 2)])
def test_names_are_counted_where_the_text_is(spark, monkeypatch, people, docs):
    """F1. Only texts and names are moved, not their pairs; rows of one document count together, in several blocks too."""
    monkeypatch.setattr(lexicon, "PEOPLE", people)
    monkeypatch.setattr(lexicon, "DOCS", docs)
    texts = [(1, "ann rao met Bo."), (1, "Bo, ann  rao"), (2, "ANN"), (3, None), (4, "rao-bo (c) x"), (5, "Ann Rao Bo Lee"), (None, "bo")]
    forms = [(1, "Ann Rao"), (1, "ann"), (2, "bo"), (3, "BO"), (3, "bo"), (4, "(c)"), (5, "x(c"), (6, "rao-bo"), (7, "ann rao bo"), (8, "c"), (9, "lee ann"), (None, "lee")]
    made = lexicon.names_in(spark.createDataFrame(texts, "d int, t string"), "d", "t", spark.createDataFrame(forms, "w int, f string"), "w", "f")
    want = {(1, 1, 3), (1, 2, 2), (1, 3, 4), (2, 1, 1), (4, 2, 1), (4, 3, 2), (4, 6, 1), (4, 8, 1), (5, 1, 2), (5, 2, 1), (5, 3, 2), (5, 7, 1), (5, None, 1), (None, 2, 1), (None, 3, 2)}
    assert {tuple(r) for r in made.collect()} == want
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan and "Aggregate" not in plan
    none = lexicon.names_in(spark.createDataFrame(texts, "d int, t string"), "d", "t", spark.createDataFrame([(1, "...")], "w int, f string"), "w", "f")
    assert none.count() == 0


def test_titles_that_share_words_are_scored_together(monkeypatch):
    """F4. Titles with shared words, all at once, against one at a time; none is scored alone while it has few words."""
    words = ["a", "an", "ana", "bé", "cab", "b", "abc", "nab"]
    shapes = [" ".join(sorted(set(c))) for n in range(5) for c in itertools.islice(itertools.combinations(words, n), 40)]
    block = titles.Postings(shapes, list(range(len(shapes))))

    def plain(mine, other):
        a, b = mine.split(), other.split()
        both = [w for w in a if w in b]
        if both and (len(both) == len(a) or len(both) == len(b)):
            return 100.0
        base = sum(map(len, both)) + max(len(both) - 1, 0)
        known = 200.0 * base / max(1, base + min(len(mine), len(other))) if both else 0.0
        x, y, ahead = " ".join(w for w in a if w not in both), " ".join(w for w in b if w not in both), base + 1 if base else 0
        return max(known, 200.0 * (ahead + common_letters(x, y)) / (2 * ahead + len(x) + len(y)))

    monkeypatch.setattr(titles.Postings, "rest", None)
    for mine in ("a an nab", "ana bé cab zz", "b", "abc bé x y", "qq"):
        got = block.best(mine, 0.0, False, 7)
        want = sorted((-plain(mine, other), i) for i, other in enumerate(shapes))[:7]
        assert [(i, round(s, 9)) for i, s in got] == [(i, round(-s, 9)) for s, i in want]


def test_ngrams_are_looked_up_once(spark, monkeypatch):
    """op6. However many texts repeat an n-gram, it is looked up once for the tokens that are looked up together."""
    asked = []
    monkeypatch.setattr(lm.StoredFilter, "read", lambda self, grams: asked.append(len(grams)) or np.zeros(len(grams), dtype=np.int64))
    made = {}
    rows = spark.createDataFrame([(i, "one two one") for i in range(700)], "doc_id long, text string")
    monkeypatch.setattr(type(rows), "mapInArrow", kept(type(rows).mapInArrow, made))
    lm.scores(rows)
    batch = pa.RecordBatch.from_arrays([pa.array(["one two one"] * 700), pa.array(range(700), pa.int64()), pa.array([False] * 700)], names=["text", "doc_id", "held_out"])
    assert sum(b.num_rows for b in made["score"](iter([batch]))) == 700
    assert asked == [3 + 4]  # two words and the end; end-one, one-two, two-one, one-end


def kept(real, made):
    def run(self, f, *args, **more):
        made[f.__name__] = f
        return real(self, f, *args, **more)

    return run


def test_vectors_do_not_move_for_each_block(spark, monkeypatch):
    """F2. However many blocks a document visits, its vector is handed to one task once."""
    docs = 40
    vectors = spark.createDataFrame([(i, t, 0.6 if t == "all" else 0.8) for i in range(docs) for t in ("all", f"t{i // 3}")], "doc int, term string, weight double")
    groups = spark.createDataFrame([(i, f"g{i}") for i in range(docs)], "doc int, col string")
    handed, real = [], type(vectors).mapInArrow
    monkeypatch.setattr(type(vectors), "mapInArrow", lambda self, f, *a, **b: (handed.append(self.count()), real(self, f, *a, **b))[1])
    found = cosine.nearest(vectors, "doc", groups, "col", block=8).collect()
    assert handed == [docs]
    assert sorted(r.b for r in found if r.a == 4 and r.score > 0.9) == [3, 5] and len(found) == 5 * docs


@pytest.mark.parametrize("alone", [0, 8, 1000])
def test_visitors_scored_at_once_are_scored_as_one_by_one(monkeypatch, alone):
    """F2. Copies, ties, full collections, thresholds of each visitor's own, and terms that the block lacks."""
    monkeypatch.setattr(cosine, "ALONE", alone)
    monkeypatch.setattr(cosine, "FIRST", 9)
    rng = np.random.default_rng(3)
    terms = [np.unique(np.concatenate([rng.integers(0, 12, 5), 100 + rng.integers(0, 300, rng.integers(1, 20))])) for _ in range(300)]
    terms[40:60] = [terms[3]] * 20
    weights = [rng.random(len(t)) + 0.1 for t in terms]
    weights[40:60] = [weights[3]] * 20
    weights = [w / np.linalg.norm(w) for w in weights]
    keys, groups = list(range(300)), [None if i % 11 == 0 else "" if i % 5 == 0 else f"g{i % 3}" for i in range(300)]
    block = cosine.Block(keys[:200], groups[:200], terms[:200], weights[:200])
    least = rng.choice([0.05, 0.2, 0.5, 0.99], 300)
    got = dict(block.best_of(keys, terms, weights, least, 5, 3))
    want = {i: p for i in keys if (p := block.best(i, terms[i], weights[i], float(least[i]), 5, 3))}
    assert got.keys() == want.keys() and len(got) > 100
    for i, p in want.items():
        assert [x for x, _ in got[i]] == [x for x, _ in p] and np.allclose([s for _, s in got[i]], [s for _, s in p], atol=2e-9)


def test_tokens_are_made_once(spark, tmp_path):
    """F15. Also texts at the least number of tokens, below it, null and in another language; terms in one document and in nearly all."""
    from folio.operators import related
    from folio.plans import archive
    from folio.plans.base import Tables

    words = [f"{a}{b}{c}" for a in "bcd" for b in "aeiou" for c in "nrst"]
    texts = [" ".join([*words[i : i + 12], *words[3 * i : 3 * i + n], "also"]) for i, n in enumerate((8, 6, 7, 20, 0, 9))]
    rows = [{"doc_id": i, "text": x, "lang": "en", "source": "s"} for i, x in enumerate([*texts, None, "", texts[3]])] + [{"doc_id": 90, "text": texts[0], "lang": "de", "source": "s"}]
    assert same_as_sql(spark, tmp_path, "tfidf_vectors", documents=rows) is None
    counts = related.term_counts(archive.tokenised(Tables(spark, str(tmp_path))), "doc_id", "tokens")
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1
    assert {r.doc_id for r in counts.collect()} == {i for i, n in enumerate((8, 6, 7, 20, 0, 9)) if 13 + n >= 20} | {8}


def test_a_chunk_of_one_line_is_hashed_once(monkeypatch):
    """op8. A line's hash is that of a chunk that has no other line."""
    hashed, real = [], linededup.xxhash.xxh64_intdigest
    monkeypatch.setattr(linededup.xxhash, "xxh64_intdigest", lambda x: (hashed.append(x), real(x))[1])
    text = b"".join(b"line %d \n" % i for i in range(300)) + b" ".join(b"A sentence of some words %d." % i for i in range(90))
    made = linededup.chunks(text)
    alone = sum(hashed.count(x) == 1 for x in (text[a:b].rstrip() for a, b, _ in made))
    assert len(hashed) < 390 + len(made) and alone > 60
    assert all(h == real(text[a:b].rstrip()) - (1 << 63) for a, b, h in made)
