"""The archive's rules as queries: routing, promotion, labels, stubs, migrations, mentions, redirects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import text as tx
from folio.functions import values as vl
from folio.operators import rules
from folio.plans.base import Tables, query



def joined(c: Column) -> Column:
    return F.array_join(c, ",")


def when_array(condition: str, *values: Column) -> Column:
    return F.when(F.expr(condition), F.array(*values)).otherwise(F.array().cast("array<string>"))


@query("SELECT c_custkey, NOT (c_custkey % 3 = 0 OR c_nationkey > 12) AS unlinked FROM customer")
def unlinked_entries(t: Tables) -> DataFrame:
    reference = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).when(F.col("c_custkey") % 3 == 1, "")
    return t.customer.select("c_custkey", (~rules.linked([reference], [when_array("c_nationkey > 12", F.col("c_name"))])).alias("unlinked"))


@query(
    """WITH w AS (SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN [] WHEN p_size % 9 = 1 THEN ['hub'] ELSE string_split(p_name, ' ') END AS c FROM part),
m AS (SELECT *, list_filter(list_transform(c, lambda x: CASE x WHEN 'ring' THEN 'musings' WHEN 'blue' THEN 'essays' END), lambda x: x IS NOT NULL) AS m FROM w)
SELECT p_partkey, CASE WHEN list_contains(c, 'red') THEN NULL WHEN len(m) > 0 THEN m[1] WHEN len(c) = 0 THEN 'opinion' END AS collection FROM m"""
)
def category_router(t: Tables) -> DataFrame:
    n = F.col("p_size") % 9
    c = F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(F.lit("hub"))).otherwise(F.split("p_name", " "))
    return t.part.select("p_partkey", rules.route_category(c, ["red"], {"ring": "musings", "blue": "essays"}, ["hub"], "opinion").alias("collection"))


@query(
    """WITH t AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN [] ELSE list_concat(string_split(p_name, ' '), [p_type]) END AS a, [p_type, p_brand] AS b FROM part),
m AS (SELECT p_partkey, list_transform(CASE WHEN len(a) > 0 THEN a ELSE b END, lambda x: CASE x WHEN 'ECONOMY' THEN 'hi' WHEN 'SMALL' THEN 'gu' WHEN 'red' THEN 'mr' WHEN 'ring' THEN 'bn' END) AS m FROM t)
SELECT p_partkey, coalesce(list_filter(m, lambda x: x IS NOT NULL)[1], 'en') AS lang FROM m"""
)
def first_language(t: Tables) -> DataFrame:
    """Names' words in their order before the type; parts of some sizes have only the second taxonomy."""
    first = F.when(F.col("p_size") % 4 != 0, F.concat(F.split("p_name", " "), F.array("p_type"))).otherwise(F.array().cast("array<string>"))
    return t.part.select("p_partkey", rules.language_of(first, F.array("p_type", "p_brand"), {"ECONOMY": "hi", "SMALL": "gu", "red": "mr", "ring": "bn"}).alias("lang"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_name WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END AS title FROM part")
def titles_by_shape(t: Tables) -> DataFrame:
    first = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_name"))
    return t.part.select("p_partkey", rules.title_of(first, F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), F.col("p_type")).alias("title"))


@query(
    """SELECT p_partkey, p_size % 10 = 0 OR p_size % 3 = 1 OR p_size % 7 = 0 OR (p_size % 4 = 0 AND p_size % 5 = 0) AS wanted FROM part"""
)
def curator_queue(t: Tables) -> DataFrame:
    n = F.col("p_size")
    none = F.array().cast("array<string>")
    wanted = rules.wants_curator(n % 10 == 0, F.when(n % 3 == 0, "high").when(n % 3 == 1, "low"), when_array("p_size % 7 = 0", F.lit("x")), none, F.when(n % 4 == 0, "vision"), when_array("p_size % 5 <> 0", F.lit("a")))
    return t.part.select("p_partkey", wanted.alias("wanted"))


@query(
    r"""WITH n AS (SELECT doc_id, trim(regexp_replace(left(coalesce(text, ''), 10 + doc_id % 70), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS name FROM documents)
SELECT doc_id, length(name) BETWEEN 3 AND 60 AND NOT regexp_matches(name, '[?!]') AND len(string_split(name, ' ')) <= 5 AND NOT contains(lower(name), 'a.') AND NOT contains(lower(name), '(the') AND NOT contains(lower(name), 'er ') AS real FROM n"""
)
def real_names(t: Tables) -> DataFrame:
    """The first letters of documents, more or fewer of them, as names; markers that would mean something in a pattern."""
    name = F.trim(F.regexp_replace(F.left(F.coalesce("text", F.lit("")), (F.col("doc_id") % 70 + 10).cast("int")), r"\s+", " "))
    return t.documents.select("doc_id", rules.real_name(name, ["a.", "(the", "er "]).alias("real"))


MATCHES_SQL = """SELECT l_orderkey, list({'slug': 's' || l_suppkey, 'role': CASE l_returnflag WHEN 'A' THEN 'author' WHEN 'R' THEN 'editor' END} ORDER BY l_linenumber, l_suppkey, l_partkey) AS m FROM lineitem GROUP BY 1"""


def matches(t: Tables) -> DataFrame:
    role = F.when(F.col("l_returnflag") == "A", "author").when(F.col("l_returnflag") == "R", "editor")
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("slug"), role.alias("role"))))
    return t.lineitem.groupBy("l_orderkey").agg(F.transform(rows, lambda x: F.struct(x["slug"].alias("slug"), x["role"].alias("role"))).alias("m"))


def first_seen(c: str) -> str:
    """The distinct items of a DuckDB list in their order."""
    return f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"


OF_AUTHORS, OF_OTHERS = ("list_transform(list_filter(m, lambda y: coalesce(y.role, 'author') %s 'author'), lambda y: y.slug)" % op for op in ("=", "<>"))


@query(f"WITH r AS ({MATCHES_SQL}), s AS (SELECT l_orderkey, {OF_AUTHORS} AS a, {OF_OTHERS} AS b FROM r) SELECT l_orderkey, array_to_string({first_seen('a')}, ',') AS authors, array_to_string({first_seen('b')}, ',') AS contributors FROM s")
def role_routing(t: Tables) -> DataFrame:
    r = matches(t).select("l_orderkey", rules.route_roles(F.col("m")).alias("r"))
    return r.select("l_orderkey", joined(F.col("r.authors")).alias("authors"), joined(F.col("r.contributors")).alias("contributors"))


@query(f"WITH r AS ({MATCHES_SQL}), s AS (SELECT l_orderkey, list_concat(['s1', 's2'], list_transform(list_filter(m, lambda y: y.role = 'author'), lambda y: y.slug)) AS a FROM r) SELECT l_orderkey, array_to_string({first_seen('a')}, ',') AS authors FROM s")
def authors_promoted(t: Tables) -> DataFrame:
    return matches(t).select("l_orderkey", joined(rules.promote_authors(F.array(F.lit("s1"), F.lit("s2")), F.col("m"))).alias("authors"))


@query("SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'other' END AS kind FROM events")
def enum_fallback(t: Tables) -> DataFrame:
    return t.events.select("event_id", rules.within(F.col("event_type"), ["view", "click"], "other").alias("kind"))


@query("SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda x: x NOT IN ('red', 'blue')), ',') AS themes, list_filter(list_transform(string_split(p_name, ' '), lambda x: CASE x WHEN 'red' THEN 'r' WHEN 'blue' THEN 'b' END), lambda x: x IS NOT NULL)[1] AS channel FROM (SELECT p_partkey, array_to_string(" + first_seen("string_split(p_name, ' ')") + ", ' ') AS p_name FROM part)")
def labels_split(t: Tables) -> DataFrame:
    s = t.part.select("p_partkey", rules.split_labels(F.split("p_name", " "), {"red": "r", "blue": "b"}).alias("s"))
    return s.select("p_partkey", joined(F.col("s.themes")).alias("themes"), "s.channel")


@query(
    """WITH d AS (SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN chr(10) || '## Page 3' WHEN 1 THEN ' OCR' WHEN 2 THEN '## Original text' WHEN 3 THEN ' ocr ## page ' ELSE '' END AS text FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, contains(text, '## Original text') OR contains(text, 'OCR') OR contains(text, '## Page ') AS again FROM d) SELECT doc_id, CASE WHEN again THEN '[again]' ELSE text END AS body, again FROM h"""
)
def bodies_reset(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 5
    text = F.concat("text", F.when(k == 0, "\n## Page 3").when(k == 1, " OCR").when(k == 2, "## Original text").when(k == 3, " ocr ## page ").otherwise(""))
    body, again = rules.reset_body(text, "[again]")
    return t.documents.filter("text is not null").select("doc_id", body.alias("body"), again.alias("again"))


@query(
    """WITH w AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey - 1 END AS parent, CASE WHEN o_orderkey % 3 = 0 THEN year(o_orderdate) END AS y, CASE WHEN o_orderkey % 5 = 0 THEN 1950 END AS i, CASE WHEN o_orderkey % 7 <> 0 THEN 2020 END AS p FROM orders)
SELECT a.k, coalesce(b.y, a.i, a.p)::INT AS hint, CASE WHEN b.y IS NOT NULL THEN 'source-work' WHEN a.i IS NOT NULL THEN 'inferred' WHEN a.p IS NOT NULL THEN 'published' ELSE 'none' END AS via FROM w a LEFT JOIN w b ON a.parent = b.k"""
)
def excerpt_years(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    w = t.orders.select(k.alias("k"), F.when(k % 2 == 0, k - 1).alias("parent"), F.when(k % 3 == 0, F.year("o_orderdate")).alias("y"), F.when(k % 5 == 0, 1950).alias("i"), F.when(k % 7 != 0, 2020).alias("p"))
    return rules.year_hint(w, "k", "parent", "y", "i", "p")


@query(f"WITH r AS ({MATCHES_SQL}), s AS (SELECT l_orderkey, list_transform(m, lambda y: y.slug) AS a, {OF_AUTHORS} AS b FROM r) SELECT l_orderkey, array_to_string(list_filter({first_seen('a')}, lambda z: NOT list_contains(b, z)), ',') AS mentions FROM s")
def mentions_projected(t: Tables) -> DataFrame:
    r = matches(t).select("l_orderkey", F.transform("m", lambda y: y["slug"]).alias("a"), rules.route_roles(F.col("m"))["authors"].alias("b"))
    return r.select("l_orderkey", joined(rules.project_mentions(F.col("a"), F.col("b"))).alias("mentions"))


@query(
    """WITH m AS (SELECT DISTINCT l_suppkey % 200 AS k FROM lineitem), a AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'pipeline' ELSE 'curated' END AS origin FROM supplier WHERE s_suppkey % 3 > 0)
SELECT k, CASE WHEN origin IS NULL THEN 'created' WHEN origin = 'pipeline' THEN 'reference' ELSE 'collision' END AS outcome FROM m LEFT JOIN a USING (k)"""
)
def stubs_for_unknown(t: Tables) -> DataFrame:
    have = t.supplier.filter("s_suppkey % 3 > 0").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 2 == 0, "pipeline").otherwise("curated").alias("origin"))
    return rules.stubs(t.lineitem.select((F.col("l_suppkey") % 200).alias("k")), have, "k", "origin")


@query("SELECT c_custkey, CASE WHEN c_nationkey < 12 THEN 'n-' || c_nationkey END AS thinker, CASE WHEN c_nationkey >= 12 THEN CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'N ' || c_nationkey END END AS unresolved FROM customer")
def unknown_demoted(t: Tables) -> DataFrame:
    display = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(" ")
    d = rules.demote_unknown(display, F.concat(F.lit("n-"), F.col("c_nationkey").cast("string")), F.col("c_nationkey") < 12)
    return t.customer.select("c_custkey", d.alias("d")).select("c_custkey", "d.thinker", "d.unresolved")


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def later_wins(t: Tables) -> DataFrame:
    return rules.latest_by_key(t.events, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@query("SELECT doc_id, unnest(CASE WHEN lang = 'en' THEN ['en', 'fr'] ELSE ['en', 'fr', lang] END) AS lang, unnest(CASE WHEN lang = 'en' THEN [doc_id, 2] WHEN lang = 'fr' THEN [1, doc_id, NULL] ELSE [1, 2, doc_id] END) AS id FROM documents WHERE lang <> 'fr' UNION ALL SELECT doc_id, unnest(['en', 'fr']), unnest([1, doc_id]) FROM documents WHERE lang = 'fr'")
def translations_with_self(t: Tables) -> DataFrame:
    others = F.create_map(F.lit("en"), F.lit(1).cast("long"), F.lit("fr"), F.lit(2).cast("long"))
    return t.documents.filter("lang is not null").select("doc_id", F.explode(rules.with_self(others, F.col("lang"), F.col("doc_id"))).alias("lang", "id"))


@query("SELECT p_partkey, array_to_string(" + first_seen("list_concat(string_split(p_name, ' '), string_split(p_brand, ' '), ['red', 'ring'])") + "[1:3], ',') AS clamped FROM part")
def ordered_union_clamped(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", joined(vl.clamp(vl.ordered_union(F.split("p_name", " "), F.split("p_brand", " "), F.array(F.lit("red"), F.lit("ring"))), 3)).alias("clamped"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '""'), '&#39;', chr(39)), '&amp;', '&'), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '[ \t]+', ' ', 'g')) AS body FROM documents".replace("'\"\"'", "'\"'"))
def ocr_cleaned(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.ocr_clean(F.col("text")).alias("body"))
