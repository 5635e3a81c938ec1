"""Operators over whole tables: ranks, fuzzy titles, listings."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from folio.functions import text
from folio.operators import joins
from folio.operators.order import rank_over
from folio.queries import QUERIES


@pytest.mark.parametrize("rows", [7, 10**6])
def test_rank_over(spark, rows):
    said = [(i, None if i % 50 == 0 else float(i * i % 97), i % 3) for i in range(900)]
    df = spark.createDataFrame(said, "id int, at double, x int")
    got = {r.id: r.place for r in rank_over(df, F.col("at"), [F.col("at").asc_nulls_last(), F.col("x").desc(), F.col("id")], "place", rows).collect()}
    want = sorted(said, key=lambda r: (r[1] is None, r[1] or 0, -r[2], r[0]))
    assert got == {r[0]: n for n, r in enumerate(want, 1)}
    assert rank_over(df.limit(0), F.col("at"), [F.col("id")], "place").count() == 0


def test_fuzzy_tiers_equal_brute_force(spark):
    titles = ["red ring", "ring red", "blue bolt", "blue bolt small", "green"]
    left = [(i, f"a{i}", titles[i % 5], i % 2, "ring") for i in range(20)]
    right = [(100 + i, f"b{i}", titles[(i + i // 7) % 5], i % 2, "by ring" if i % 3 else "none", None) for i in range(40)]
    a = spark.createDataFrame(left, "id int, slug string, title string, year int, surname string")
    b = spark.createDataFrame(right, "rid int, rslug string, rtitle string, ryear int, byline string, url string")
    scores = {(r.x, r.y): r.s for r in spark.createDataFrame(list(product(titles, titles)), "x string, y string").select("x", "y", text.token_set_score(F.col("x"), F.col("y")).alias("s")).collect()}
    want = {}
    for i, _, title, year, surname in left:
        best = sorted((-scores[title, t], rid, by) for rid, _, t, y, by, _ in right if y == year)[:5]
        for s, rid, by in best:
            tier = "high" if -s >= 92 else "medium" if -s >= 80 and surname in by else None
            if tier:
                want[i] = (rid, tier)
                break
    assert {r.id: (r.rid, r.tier) for r in joins.fuzzy_tiers(a, b).collect()} == want


@pytest.mark.parametrize(("name", "table"), [("sorted_listing", "orders"), ("years", "orders"), ("polymorphic_references", "lineitem"), ("page_order", "lineitem")])
def test_all_rows_pass(spark, sf_dir, name, table):
    assert QUERIES[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


def test_fuzzy_titles_takes_all_parts(spark, sf_dir):
    assert QUERIES["fuzzy_titles"](spark, sf_dir).filter("id % 7 <> 0").count() > 0


@pytest.mark.parametrize(("name", "column"), [("markdown_sibling", "page"), ("corpus_dump", "entry"), ("inline_html", "html"), ("stripped_headings", "no_title")])
def test_long_texts_keep_their_ends(spark, tmp_path, name, column):
    long = [(1, " " * 150 + "body " * 400 + "the end", "en", "src9", 2157), (2, "short", "en", None, 5)]
    spark.createDataFrame(long, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert any((r[column] or "").endswith("the end") for r in QUERIES[name](spark, str(tmp_path)).filter("doc_id = 1").collect())
    if name == "corpus_dump":
        assert {r.doc_id: r.section for r in QUERIES[name](spark, str(tmp_path)).collect()} == {1: 1, 2: 2}


@pytest.mark.parametrize("name", ["round_robin_batches", "contiguous_batches", "sorted_listing"])
def test_no_window_over_all_rows(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    over = [x for x in plan.splitlines() if "Window [" in x and "row_number" in x]
    assert over and all("__bucket" in x for x in over)
