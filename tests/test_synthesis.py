"""Occurrences, verified mentions, redirects, names in prose and counters on small cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folio.operators import evidence, lexicon, numbering, occurrences, redirects, scripts

SUMMARY = "struct<cross_thinker_mentions:array<struct<thinker_id:string,page:int,context:string>>,themes_confirmed:array<string>,theme_proposed_new:array<string>>"
RECORD = f"""slug string, authors array<struct<thinker_id:string,confidence:string>>, editors array<struct<thinker_id:string,confidence:string>>, contributors array<struct<thinker_id:string,role:string,confidence:string>>,
themes array<string>, theme_proposed_new array<string>, summary_structured {SUMMARY}, essays_summarized array<struct<summary_structured:{SUMMARY}>>"""


def test_occurrences_of_both_shapes(spark):
    rows = [
        ("one", [("p1", None), (None, "high"), ("", "high")], [("p2", "low")], [("p3", None, ""), ("p3", "translator", "high")], ["t1", None, "t2"], ["t1"], ([("p1", 4, "x" * 300), ("p4", None, None)], ["t3"], None), None),
        ("many", None, None, None, None, None, None, [(([("p1", 1, "a")], ["t1"], ["t9"]),), (None,), (([("p1", 2, "b"), ("p5", 3, "c")], None, ["t9"]),)]),
        ("bare", None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, RECORD)
    found = [tuple(r) for r in occurrences.people_in(df).orderBy("slug", "at").drop("at").collect()]
    assert found == [
        ("many", "p1", "body_text_mention", "high", 1, "a", "cites"), ("many", "p1", "body_text_mention", "high", 2, "b", "cites"), ("many", "p5", "body_text_mention", "high", 3, "c", "cites"),
        ("one", "p1", "author", "medium", None, None, "contributor"), ("one", "p2", "editor", "low", None, None, "contributor"), ("one", "p3", "contributor", "medium", None, None, "contributor"), ("one", "p3", "translator", "high", None, None, "contributor"),
        ("one", "p1", "body_text_mention", "high", 4, "x" * 200, "cites"), ("one", "p4", "body_text_mention", "high", None, "", "cites"),
    ]
    assert {tuple(r) for r in occurrences.themes_in(df).collect()} == {("one", "t1"), ("one", "t2"), ("one", "t3"), ("many", "t1"), ("many", "t9")}
    people = occurrences.people_in(df)
    assert {(r.person, r.works, r.authored, r.mentions, tuple(r.contexts)) for r in occurrences.person_summary(people, k=2).collect()} >= {("p1", 2, 1, 3, ("a", "b")), ("p2", 1, 0, 0, ())}
    assert {(r.source, r.target, r.context) for r in occurrences.edges_of(people).filter("kind = 'contributor'").collect()} == {("one", "p1", "author"), ("one", "p2", "editor"), ("one", "p3", "contributor"), ("one", "p3", "translator")}
    assert occurrences.people_in(df.limit(0)).count() == 0


def test_first_rows_are_picked_before_they_move(spark):
    rows = spark.range(1000).select((F.col("id") % 1).alias("k"), "id")
    made = occurrences.first_of(rows, ["k"], ["id"], 3)
    assert [r.id for r in made.orderBy("id").collect()] == [0, 1, 2]
    assert "WindowGroupLimit" in made._jdf.queryExecution().executedPlan().toString()


MENTIONS = "array<struct<thinker_id:string,role:string,reasoning:string,evidence:array<struct<quote:string,context:string>>,key_passages:array<struct<quote:string,what_it_shows:string>>>>"


def test_quotes_and_roles(spark):
    body = "He **wrote** of liberty,\n and of markets."
    mentions = [
        ("known", "mention", "why", [("he wrote", "c"), ("He wrote of liberty, and", "c")], []), ("known", "subject", None, [("markets", None)], [("nowhere", "x")]), ("known", "subject", None, None, [("of *markets*", "x")]),
        ("byline", "mention", None, [("markets", None)], []), ("stranger", "mention", None, [("markets", None)], []), (None, "mention", None, [], []), ("self", None, None, [("", None), ("liberty", None)], None), ("known", "critic", None, [], []),
    ]
    rows = [(1, body, ["byline"], ["self"], mentions), (2, None, None, None, mentions[:1]), (3, body, None, None, None)]
    entries = spark.createDataFrame(rows, f"id int, body string, byline_authors array<string>, self_referents array<string>, mentions {MENTIONS}")
    authority = spark.createDataFrame([("known",), ("byline",), ("self",), ("known",)], "slug string")
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "[*_`>~]", ""), r"\s+", " "))
    got = {r.id: r for r in evidence.verified(entries, "id", authority, "slug", plain, plain).collect()}
    kept = [(k.thinker, k.role, [e.quote for e in k.evidence], [p.quote for p in k.key_passages]) for k in got[1].kept]
    assert kept == [("known", "mention", ["He wrote of liberty, and"], []), ("known", "subject", [], ["of *markets*"]), ("self", "mention", ["liberty"], []), ("known", "critic", [], [])]
    assert [tuple(d) for d in got[1].dropped] == [("known", "evidence", "he wrote"), ("known", "key_passage", "nowhere"), ("known", "unproved", ""), ("byline", "byline", ""), ("stranger", "unknown", ""), (None, "unknown", ""), ("self", "evidence", "")]
    assert got[1].related == ["known"] and got[2].kept == [] and got[2].related == [] and len(got[2].dropped) == 3


def test_redirects_of_chains_and_circles(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(20)]
    rows = chain + [("x", "y"), ("y", "z"), ("z", "x"), ("into", "x"), ("self", "self"), ("a", "b"), (None, "q"), ("q", None)]
    got = {r.loser: (r.target, r.cyclic) for r in redirects.followed(spark.createDataFrame(rows, "loser string, winner string")).collect()}
    assert got == {f"c{i}": ("c20", False) for i in range(20)} | {k: (None, True) for k in ("x", "y", "z", "into", "self")} | {"a": ("b", False)}
    assert redirects.followed(spark.createDataFrame([], "loser string, winner string")).count() == 0


def test_sweep(spark):
    moved = spark.createDataFrame([("old", "new", False), ("old-2", "two", False), ("loop", None, True)], "loser string, target string, cyclic boolean")
    gone = spark.createDataFrame([("dead",)], "slug string")
    text = "/thinkers/old/ /thinkers/old-2 /thinkers/older/ /works/old/ old /thinkers/dead/ /organisations/old."
    rows = [("old", "old", ["old-2", "x", "dead", "two"], text, '{"id": "old", "thinker_id":"old", "n": ["old-2", "olds", "dead"], "old": 1}'), ("k2", "dead", None, None, None), ("k3", None, [], "", "{"), ("k4", "loop", ["loop"], "/thinkers/loop/", '["loop"]')]
    df = spark.createDataFrame(rows, "id string, author string, related array<string>, body string, record string")
    got = {r.id: tuple(r)[1:] for r in redirects.swept(df, "id", moved, gone, ["author"], ["related"], ["body"], ["record"], ["thinkers", "organisations"]).collect()}
    assert got["old"] == ("new", ["two", "x"], "/thinkers/new/ /thinkers/two /thinkers/older/ /works/old/ old /thinkers/dead/ /organisations/new.", '{"id": "old", "thinker_id":"new", "n": ["two", "olds", "dead"], "old": 1}')
    assert got["k2"] == ("", None, None, None) and got["k3"] == (None, [], "", "{") and got["k4"] == ("loop", ["loop"], "/thinkers/loop/", '["loop"]')


def test_absorbed_aliases(spark):
    people = spark.createDataFrame([("a", "Ann", ["A."]), ("b", "Anne", None), ("c", "Ann", ["Annie", "A."])], "id string, name string, aliases array<string>")
    merged = spark.createDataFrame([("b", "a"), ("c", "a"), ("lost", None)], "loser string, target string")
    assert [tuple(r) for r in redirects.absorbed(people, merged, "id", "name", "aliases").collect()] == [("a", "Ann", ["A.", "Anne", "Annie"])]


def test_names_in_prose_equal_the_pattern(spark):
    texts = [None, "", "J. R. D. Tata spoke.", "j. r. d. tata's", "Tata", "TATA tatas", "MÉNARD and Ménards", "a+b (c)", "Anna  Rao", "Anna Rao", "anna\nrao", "xAnna Rao", "Rao, Anna Rao!"]
    forms = [(1, "J. R. D. Tata"), (1, "Tata"), (2, "Ménard"), (3, "a+b"), (3, "(c)"), (4, "Anna Rao"), (4, "Anna Rao"), (5, "..."), (6, r"\Q\E"), (7, "nobody"), (8, None)]
    docs = spark.createDataFrame(list(enumerate(texts)), "d int, t string")
    got = {tuple(r) for r in lexicon.names_in(docs, "d", "t", spark.createDataFrame(forms, "w int, f string"), "w", "f").collect()}
    want = {}
    for d, t in enumerate(texts):
        for w, f in set(forms):
            if f and re.search(r"\w", f) and re.search(rf"\b{re.escape(f)}\b", t or "", re.I):
                want[d, w] = want.get((d, w), 0) + 1
    assert got == {(d, w, n) for (d, w), n in want.items()}


def plain_ids(bases):
    used, out = set(), []
    for base in bases:
        taken, n = base, 2
        while taken in used:
            taken, n = f"{base}-{n}", n + 1
        used.add(taken)
        out.append(taken)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_counter_ids_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    names = ["x", "x-2", "x-3", "x-2-2", "x-1", "x-02", "x-40", "x-2019", "y", "z-2", "z", "w", "x-"]
    bases = [rng.choice(names[:3] if seed == 0 else names) for _ in range(400)] + [f"u{i}" for i in range(20)] * (seed % 2)
    got = numbering.counter_ids(spark.createDataFrame(list(enumerate(bases)), "k long, b string").repartition(5), "k", "b", "id").orderBy("k").collect()
    want = plain_ids(bases)
    assert [r.id for r in got] == want and len(set(want)) == len(want)


def test_counter_walks_only_what_is_contended(spark):
    """A base with many rows and one that stands as a number of it: rows beyond that number aren't walked."""
    bases = ["x"] * 500 + ["x-3"] * 2 + ["x"] * 500
    seen = []
    real = numbering.Scratch.save
    try:
        numbering.Scratch.save = lambda self, df, name: (lambda made: (seen.append(made.count()) if name == "walked" else None, made)[1])(real(self, df, name))
        got = numbering.counter_ids(spark.createDataFrame(list(enumerate(bases)), "k long, b string"), "k", "b", "id").orderBy("k").collect()
    finally:
        numbering.Scratch.save = real
    assert [r.id for r in got] == plain_ids(bases) and seen[0] <= 10


NAMES = [
    ("जवाहरलाल नेहरू", "javāharalāla neharū", "javaharalala neharu"), ("कृष्णमाचारी", "kṛṣṇamācārī", "krsnamacari"), ("শরৎ", "śarat", "sarat"), ("মহাত্মা গান্ধী", "mahātmā gāndhī", "mahatma gandhi"),
    ("ગાંધી", "gāṃdhī", "gamdhi"), ("મિનૂ મસાણી", "minū masāṇī", "minu masani"), ("দুঃখ ১৯", "duḥkha 19", "duhkha 19"), ("क़लम।", "kalama.", "kalama"), ("B. R. Ménard", "B. R. Ménard", "b r ménard"), ("", "", ""),
]


def test_transliteration(spark):
    df = spark.createDataFrame([(n,) for n, *_ in NAMES], "n string").coalesce(1)
    assert [(r.a, r.b) for r in df.select(scripts.to_iast(F.col("n")).alias("a"), scripts.latin_form(F.col("n")).alias("b")).collect()] == [(a, b) for _, a, b in NAMES]
    assert spark.createDataFrame([(None,)], "n string").select(scripts.to_iast(F.col("n")).alias("a")).first().a is None


def test_names_are_probed_in_turn(spark):
    names = ["नेहरू", "गांधी", "मसाणी", "શરદ", "Nehru", "nobody", "अज्ञात", None]
    direct = spark.createDataFrame([("नेहरू",)], "n string").select(scripts.lookup_key(F.col("n")).alias("k")).first().k
    lookup = [(direct, "written"), ("neharu", "late"), ("gāṃdhī", "marked"), ("gamdhi", "late"), ("masani", "plain"), ("sarada", "gujarati"), ("nehru", "latin")]
    got = scripts.resolve_names(spark.createDataFrame([(n,) for n in names], "n string"), "n", spark.createDataFrame(lookup, "k string, v string"), "k", "v", "who")
    assert {r.n: r.who for r in got.collect()} == {"नेहरू": "written", "गांधी": "marked", "मसाणी": "plain", "શરદ": "gujarati", "Nehru": "latin", "nobody": None, "अज्ञात": None, None: None}


def test_folding_follows_unicode():
    import unicodedata

    for letter, base in zip(*scripts.folded_letters(), strict=True):
        stripped = "".join(c for c in unicodedata.normalize("NFD", letter) if unicodedata.category(c) != "Mn")
        assert stripped == base, letter
