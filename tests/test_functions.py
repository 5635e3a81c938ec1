"""Cases of the archive's functions."""

import pytest
from pyspark.sql import functions as F

from folio.functions import names, text, values
from folio.operators import facets, joins, merge, quality, scripts


def one(spark, expr, **cols):
    """The value of a column expression over one row; strings unless a tuple gives the type."""
    schema = ", ".join(f"{k} {v[1] if isinstance(v, tuple) else 'string'}" for k, v in cols.items()) or "x int"
    row = tuple(v[0] if isinstance(v, tuple) else v for v in cols.values()) or (1,)
    return spark.createDataFrame([row], schema).select(expr.alias("v")).first().v


@pytest.mark.parametrize(
    "f, given, want",
    [
        (names.n1_slug, "  Éclair & Co. ", "eclair-co"), (names.n2_kebab, "Éclair", "clair"), (names.n2_kebab, "A.D. Shroff", "a-d-shroff"), (names.n3_vocab_key, " Free_Trade  now! ", "free-trade-now!"),
        (names.n4_alias_key, "A.D. O'Neil-Ray", "a d oneil ray"), (names.n5_seed_key, "A.D. Shroff", "ad shroff"), (names.n6_letters, "Hello, World!", "hello world"), (names.n7_duplicate_key, "Prof. A D Shroff", "ad shroff"),
        (names.n7_duplicate_key, "A.D. Shroff", "ad shroff"), (names.n8_mention_key, "Prof. Dr. P. T. Bauer", "p t bauer"), (names.n9_title_key, "The Café — of \"X\"", "cafe of x"), (names.n10_quote_text, "*a*  “b” – c", 'a "b" - c'),
        (names.n11_quote_key, "“inner। word।”", 'inner। word।'), (names.surname_of_slug, "b-r-shenoy", "shenoy"), (names.sort_name, "Ada Lovelace", "Lovelace, Ada"), (names.sort_name, "Sammy Davis Jr", "Davis Jr, Sammy"), (names.sort_name, "Plato", "Plato"),
    ],
)
def test_normalisers(spark, f, given, want):
    assert one(spark, f(F.col("s")), s=given) == want


@pytest.mark.parametrize(
    "body, quote, want",
    [("*Hayek* argued for spontaneous order.", "Hayek argued for spontaneous order", True), ("he said “yes”", 'said "yes"', True), ("one\n\ntwo", "one two", True), ("a — b", "a - b", True), ("order", "Order", False), ("body", "", False), ("", "quote", False), ("a paraphrase", "the phrase", False), ("x अंत। y अंत। z", "x अंत। y अंत।", True)],
)
def test_quotes(spark, body, quote, want):
    assert one(spark, joins.contains_normal(F.col("b"), F.col("q"), names.n11_quote_text, names.n11_quote_key), b=body, q=quote) is want


def test_tokens(spark):
    t = "The `code` [linked words](http://x) ![img](y) <b>Bold</b> don't कखग\n```\nfence\n```\n# Head ab"
    assert one(spark, text.tokens(F.col("s")), s=t) == ["linked", "words", "bold", "कखग", "head"]


def test_name_candidates(spark):
    got = one(spark, text.name_candidates(F.col("a"), F.col("b")), a="Economics by Prof. A.D. Shroff, March 1956 – III", b="economics-a-d-shroff-march-15-1956")
    assert got == ["economics", "a-d", "shroff", "a", "d"]


@pytest.mark.parametrize("s, n, want", [("a\n\nb\n\nc d e", 8, "a\n\nb"), ("a\nb c d e", 5, "a"), ("abcdef", 3, "abc"), ("ab  ", 9, "ab")])
def test_cut_at_paragraph(spark, s, n, want):
    assert one(spark, text.cut_at_paragraph(F.col("s"), n), s=s) == want


def test_cut_at_sentence(spark):
    early, good = "Short. " + "x" * 2000, ("y" * 800 + ". ") + "z" * 2000
    assert one(spark, text.cut_at_sentence(F.col("s")), s=early) == early[:1197].rstrip() + "…"
    assert one(spark, text.cut_at_sentence(F.col("s")), s=good) == "y" * 800 + "."


def test_middle_cut(spark):
    got = one(spark, text.middle_cut(20, "|")(F.col("s")), s="é" * 30)
    assert got == "é" * 5 + "|" + "é" * 5


def test_headings(spark):
    body = "# A. Name\n\nText"
    assert one(spark, text.strip_heading(F.col("b"), F.array(F.lit("other"), F.lit("a. name"))), b=body) == "Text"
    assert one(spark, text.strip_heading(F.col("b"), F.array(F.lit("x"))), b=body) == body
    assert one(spark, text.strip_title_byline(F.col("b")), b="# T\n\n*By X*\n\nBody\n\n\n\nEnd") == "Body\n\nEnd"


def test_html(spark):
    h = '<h2>Head</h2><p>A <b>bold</b> <a href="/x">link</a> &amp; &#233;</p><ul><li>one</li><li>two</li></ul><script>no()</script>'
    assert one(spark, text.html_to_markdown(F.col("h")), h=h) == "## Head\n\nA **bold** [link](/x) & é\n\n- one\n- two"
    f = "<h2>H</h2><p><em>x</em></p><blockquote><p>q1</p><p>q2</p></blockquote><ol><li>a</li><li>b</li></ol>"
    assert one(spark, text.feed_html_to_markdown(F.col("h")), h=f) == "## H\n\n*x*\n\n> q1\n> q2\n\n1. a\n2. b"
    assert one(spark, text.inline_html(F.col("h")), h="a < **b** & *c*") == "a &lt; <strong>b</strong> &amp; <em>c</em>"


def test_slugs_and_titles(spark):
    assert one(spark, text.slug_tail_grams(F.col("s")), s="on-trade-by-b-r-shenoy-march-1956")[:2] == ["trade-by-b-r-shenoy", "by-b-r-shenoy"]
    assert one(spark, text.author_from_title(F.col("s")), s="Trade by John Doe (1950)") == "John Doe"
    assert one(spark, text.subject_from_title(F.col("s"), "^Interview: "), s="Interview: Jane Roe (part 1) by X") == "Jane Roe"
    url = lambda u: one(spark, text.slug_from_url(F.col("u"), F.col("t"), "opinion"), u=u, t="A Title Here")
    assert [url("https://x.org/opinion/my-piece/123/"), url("https://x.org/a/b/456"), url("https://x.org/99")] == ["my-piece", "b", "a-title-here"]
    assert one(spark, text.video_id(F.col("s")), s="see https://youtu.be/abcdefghijk?t=1") == "abcdefghijk"


@pytest.mark.parametrize("s, want", [("hello", "latin"), ("नमस्ते", "devanagari"), ("नमस्ते hello there", "mixed"), ("123", "none")])
def test_script(spark, s, want):
    assert one(spark, text.script_of(F.col("s")), s=s) == want


def test_transliteration(spark):
    assert one(spark, text.strip_diacritics(scripts.to_iast(F.col("s"))), s="शरद जोशी") == "sarada josi"


def test_token_set_ratio():
    got = text.token_set_ratio("indian currency reform proposals", "proposals for indian currency stabilisation")
    assert got == pytest.approx(87.719, abs=0.01)
    assert text.token_set_ratio("blueprint for eradication of poverty", "blueprint for eradication of poverty 1980") == 100.0
    assert text.token_set_ratio("", "x") == 0.0


def test_first_json_object(spark):
    assert one(spark, text.first_json_object(F.col("s")), s='Sure: {bad} ```json\n{"a": {"b": 1}}\n``` more') == '{"a": {"b": 1}}'
    assert one(spark, text.first_json_object(F.col("s")), s="none {") is None


@pytest.mark.parametrize("s, want", [("in 1956 and 1960", 1956), ("no year", None), ("12056", None), ("(2099)", 2099), ("1899", None)])
def test_first_year(spark, s, want):
    assert one(spark, values.first_year(F.col("s")), s=s) == want


@pytest.mark.parametrize("y, want", [(1947, "pre-independence"), (1948, "nehruvian-era"), (1964, "nehruvian-era"), (1965, "late-license-raj"), (1984, "late-license-raj"), (1985, "reform-era"), (2004, "reform-era"), (2005, "post-reform"), (None, None)])
def test_periods(spark, y, want):
    assert one(spark, values.period_of(F.col("y")), y=(y, "int")) == want


def test_dates(spark):
    assert str(one(spark, values.rfc822(F.col("s")), s="Tue, 03 Jun 2008 11:05:30 GMT")) == "2008-06-03 11:05:30"
    assert one(spark, values.rfc822(F.col("s")), s="garbage") is None
    wait = one(spark, values.reset_seconds(F.col("s"), F.lit("2026-01-01 00:00:00").cast("timestamp")), s="resets 4:10am (UTC)")
    assert wait == 4 * 3600 + 600 + 30


def test_arrays(spark):
    a = lambda *x: F.array(*[F.lit(i) for i in x]).cast("array<string>")
    assert [one(spark, values.jaccard(p, q)) for p, q in ((a("x"), a("x")), (a("x"), a("y")), (a(), a()), (a(), a("y")))] == [1.0, 0.0, 1.0, 0.0]
    assert [tuple(w) for w in one(spark, values.page_windows(F.lit(45)))] == [(1, 20), (21, 40), (41, 45)]
    assert one(spark, values.page_windows(F.lit(0))) == []
    assert [one(spark, values.unwrap(F.parse_json("j")), j=j) for j in ('{"value": "v"}', '{"verbatim": "w"}', '"plain"', "null")] == ["v", "w", "plain", ""]
    assert one(spark, values.label_dates(F.lit(1900), F.lit(None).cast("int"))) == "b. 1900"


def test_name_keys(spark):
    def keys(*tokens):
        c = F.array(*[F.lit(t) for t in tokens])
        return one(spark, joins.name_keys(c, joins.windows_of(c, 2, 6)))

    assert "a-d-shroff" in keys("a", "d", "shroff")
    got = keys("crisis", "murarji", "j", "vaidya")
    assert "murarji-vaidya" in got
    assert "patel" not in keys("equity", "global", "patel")
    assert keys("a-d-shroff", "x")[0] == "a-d-shroff"


def test_ngram_routes(spark):
    lookup = spark.createDataFrame([("a-d-shroff", "ads"), ("nani-palkhivala", "nap")], "k string, v string")
    df = spark.createDataFrame([(1, ["a", "d", "shroff"]), (2, ["a-d-shroff", "nani", "palkhivala"]), (3, ["equity", "patel"])], "id int, t array<string>")
    got = {r.id: (r.matches, r.route) for r in joins.ngram_join(df, ["id"], F.col("t"), lookup, "k", "v").collect()}
    assert got == {1: (["ads"], "resolved"), 2: (["ads", "nap"], "ambiguous"), 3: ([], "deferred")}


def test_alias_expansion(spark):
    got = {r.k: r.v for r in joins.expand_aliases(spark.createDataFrame([("prof-cn-vakil", "x", 1), ("cn-vakil", "y", 2)], "k string, v string, ord int"), "k", "v", "ord").collect()}
    assert got == {"prof-cn-vakil": "x", "cn-vakil": "y", "c-n-vakil": got["c-n-vakil"]}


def test_fuzzy_tiers(spark):
    left = spark.createDataFrame([(1, "same", "x", 1980, ""), (2, "q", "indian currency reform proposals", 1952, "shenoy"), (3, "r", "blueprint for eradication of poverty", 1980, ""), (4, "s", "unrelated words here", 1980, ""), (5, "t", "blueprint for eradication of poverty", None, "")], "id int, slug string, title string, year int, surname string")
    right = spark.createDataFrame([(10, "same", "zzz", 1900, "", None), (11, "o", "proposals for indian currency stabilisation", 1952, "B. R. Shenoy", "u"), (12, "p", "blueprint for eradication of poverty 1980", 1980, "", "u")], "rid int, rslug string, rtitle string, ryear int, byline string, url string")
    got = {r.id: (r.rid, r.tier) for r in joins.fuzzy_tiers(left, right).collect()}
    assert got == {1: (10, "page-only"), 2: (11, "medium"), 3: (12, "high")}


def test_merges(spark):
    old = spark.createDataFrame([("1", "profile", None), ("2", "", "s")], "id string, kind string, stance string")
    new = spark.createDataFrame([("1", "commentary", "pro"), ("2", "essay", None)], "id string, kind string, stance string")
    got = {r.id: r for r in merge.first_run_wins(old, new, "id", ["kind", "stance"]).collect()}
    assert (got["1"].kind, got["1"].kind_status, got["1"].stance) == ("profile", "preserved", "pro")
    assert (got["2"].kind, got["2"].stance, got["2"].stance_status) == ("essay", "s", "skipped")
    forced = merge.first_run_wins(old, new, "id", ["kind", "stance"], frozenset({"kind"}))
    assert {r.id: r.kind for r in forced.collect()}["1"] == "commentary"
    again = merge.first_run_wins(forced.select("id", "kind", "stance"), new, "id", ["kind", "stance"], frozenset({"kind"})).select("id", "kind", "stance")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, forced.select("id", "kind", "stance").collect()))
    g = lambda e, k: one(spark, merge.edited_by_others(F.lit("l"), F.col("e"), F.lit(k), "Bot@x"), e=e)
    assert [g("bot@X", True), g("me@x", True), g(None, True), g(None, False)] == [False, True, True, False]


def test_facet_urls():
    assert facets.from_url("a=x,y&b=") == {"a": ["x", "y"]} and facets.to_url({"a": ["x", "y"], "b": []}) == "a=x,y"


def test_validation(spark):
    long = "q" * 60
    df = spark.createDataFrame([("1", ["liberty", "123-bad-slug", "new-theme"], ["a", "b", "c", "a", "d", "e", "f"], "short", "pro", 1700), ("2", ["liberty"], None, long, "x", 1950), (None, ["liberty"], None, None, None, None), ("4", None, None, None, None, None)], "id string, themes array<string>, key_concepts array<string>, pull_quote string, stance string, source_year int")
    a, b, c, d = quality.validate_record(df, ["liberty"], 2026, ["pro"]).collect()
    assert (a.clean.themes, a.clean.proposed_themes, a.clean.key_concepts, a.clean.pull_quote, a.clean.source_year) == (["liberty"], ["new-theme"], list("abcde"), None, None)
    assert a.warnings == ["theme-proposed", "theme-dropped", "quote-length", "year-range"]
    assert b.clean.pull_quote == long and b.clean.stance is None and b.warnings == ["stance-unknown"]
    assert c.clean is None and d.clean is None and c.warnings == ["hard-error"]


def test_fake_names(spark):
    assert one(spark, quality.fake_name(F.col("n")), n="How I Learned To Love The Market") == "name is 7 words"
    assert one(spark, quality.fake_name(F.col("n")), n="Trade: A View") == "matches title pattern ':'"
    assert one(spark, quality.fake_name(F.col("n")), n="A.D. Shroff - Champion") == "matches title pattern '-'"
    assert one(spark, quality.fake_name(F.col("n")), n="Who was he?") == "matches title pattern '\\?'"
    assert one(spark, quality.fake_name(F.col("n")), n="The New Deal") == "starts with article phrase 'the new '"
    assert one(spark, quality.fake_name(F.col("n")), n="x" * 61) == "name is 61 chars long"
    assert one(spark, quality.fake_name(F.col("n")), n="A & B") is None and one(spark, quality.fake_name(F.col("n")), n="") is None
    assert one(spark, quality.fake_name(F.col("n")), n="Minoo Masani") is None


def test_related_equals_a_greedy_walk(spark):
    import random

    from folio.operators import related

    r = random.Random(1)
    pairs = [(a, b, round(r.random(), 3)) for a in range(12) for b in range(12) if a != b]
    group = {b: f"c{b % 3}" for b in range(12)}
    df = spark.createDataFrame(pairs, "a int, b int, score double")
    got = {(x.a, x.rank): x.b for x in related.top_related(df, spark.createDataFrame(list(group.items()), "doc int, col string"), "doc", "col").collect()}
    for a in range(12):
        seen, out = {}, []
        for _, b, s in sorted((p for p in pairs if p[0] == a), key=lambda p: (-p[2], p[1])):
            if len(out) < 5 and seen.get(group[b], 0) < 3:
                out.append(b)
                seen[group[b]] = seen.get(group[b], 0) + 1
        assert [got[a, i + 1] for i in range(len(out))] == out
