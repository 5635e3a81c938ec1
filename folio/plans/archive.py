"""Facets, filters, orders, sections, related documents and search over the documents table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.functions import text as tx
from folio.functions import values as vl
from folio.operators import cosine, facets, related
from folio.operators.order import rank_over
from folio.plans.base import Tables, query
from folio.scratch import Scratch

STOP_SQL = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
#: The token rule in DuckDB; the documents have no markup but marks.
TOKENS_SQL = rf"""list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  text, '```.*?```', ' ', 'gs'), '`[^`]*`', ' ', 'g'), '<[^>]+>', ' ', 'g'), '!\[[^\]]*\]\([^)]+\)', ' ', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '[#>*_~|]+', ' ', 'g'),
  '[A-Za-z\x{{0900}}-\x{{097F}}\x{{0A80}}-\x{{0AFF}}\x{{0980}}-\x{{09FF}}]{{3,}}'), lambda x: lower(x)), lambda x: x NOT IN ({STOP_SQL}))"""


def tokenised(t: Tables) -> DataFrame:
    return t.documents.filter("lang = 'en'").select("doc_id", "source", tx.tokens(F.col("text")).alias("tokens"))


VECTORS_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, source, {TOKENS_SQL} AS tokens FROM documents WHERE lang = 'en'),
e AS (SELECT * FROM d WHERE len(tokens) >= 20),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM e) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM e),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2 AND count(*) < 0.7 * (SELECT n FROM n)),
w AS (SELECT doc_id, term, (1 + ln(tf)) * ln((SELECT n FROM n)::DOUBLE / df) AS w FROM tf JOIN df USING (term)),
v AS MATERIALIZED (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)
"""


def vectors(t: Tables) -> tuple[DataFrame, DataFrame]:
    counts = Scratch(t.spark, "vectors").save(related.term_counts(tokenised(t), "doc_id", "tokens"), "counts")
    return t.documents.select("doc_id", "source"), related.weights(counts, "doc_id")


@query(
    VECTORS_SQL
    + """,
p AS (SELECT a.doc_id AS a, b.doc_id AS b, round(sum(a.weight * b.weight), 9) AS s FROM v a JOIN v b ON a.term = b.term AND a.doc_id <> b.doc_id GROUP BY ALL HAVING sum(a.weight * b.weight) >= 0.05),
r AS (SELECT a, b, source AS collection, s, row_number() OVER (PARTITION BY a, source ORDER BY s DESC, b) AS r1 FROM p JOIN d ON d.doc_id = b),
k AS (SELECT a, b, collection, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rank FROM r WHERE r1 <= 3)
SELECT a, rank, b, collection, round(s, 4) AS score FROM k WHERE rank <= 5"""
)
def related_documents(t: Tables) -> DataFrame:
    docs, vec = vectors(t)
    return related.top_related(cosine.nearest(vec, "doc_id", docs, "source"), docs, "doc_id", "source")


@query(VECTORS_SQL + " SELECT doc_id, count(*) AS terms, round(sum(weight), 6) AS total FROM v GROUP BY doc_id")
def tfidf_vectors(t: Tables) -> DataFrame:
    _, vec = vectors(t)
    return vec.groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum("weight"), 6).alias("total"))


@query(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({TOKENS_SQL}) AS term FROM documents WHERE lang = 'en') GROUP BY term")
def document_frequency(t: Tables) -> DataFrame:
    return tokenised(t).select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query(f"SELECT doc_id, len(tokens) AS n_tokens, array_to_string(tokens[1:8], ' ') AS first_tokens FROM (SELECT doc_id, {TOKENS_SQL} AS tokens FROM documents)")
def tokenise_documents(t: Tables) -> DataFrame:
    tok = tx.tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(tok).cast("long").alias("n_tokens"), F.array_join(F.slice(tok, 1, 8), " ").alias("first_tokens"))


@query(
    f"""WITH d AS (SELECT doc_id, {TOKENS_SQL} AS tokens FROM documents WHERE lang = 'en'),
s AS (SELECT count(*)::DOUBLE AS n, avg(len(tokens)) AS m FROM d),
i AS (SELECT doc_id, len(tokens) AS length, term, count(*) AS tf FROM (SELECT doc_id, tokens, unnest(tokens) AS term FROM d) WHERE term IN ('ering', 'thing', 'eran', 'station') GROUP BY doc_id, tokens, term),
f AS (SELECT term, count(*) AS df FROM i GROUP BY term)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / m))), 6) AS score
FROM i JOIN f USING (term), s GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 12"""
)
def search_documents(t: Tables) -> DataFrame:
    docs = tokenised(t)
    n, mean = docs.agg(F.count(F.lit(1)), F.avg(F.size("tokens"))).first()
    terms = ["ering", "thing", "eran", "station"]
    return related.search(related.inverted_index(docs, "doc_id", "tokens", ["source"], terms), "doc_id", terms, n, mean or 1.0)


@query("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND NOT (n_chars < 60)")
def visible_documents(t: Tables) -> DataFrame:
    return t.documents.filter((F.col("lang") == "en") & ~(F.col("n_chars") < 60)).select("doc_id", "source", "n_chars")


@query(f"SELECT doc_id FROM documents WHERE lang = 'en' AND len({TOKENS_SQL}) >= 20")
def eligible_documents(t: Tables) -> DataFrame:
    return tokenised(t).filter(F.size("tokens") >= 20).select("doc_id")


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'fr') AND source IN ('src1', 'src2', 'src3') AND list_has_any([lang, source], ['fr', 'src3'])")
def faceted_documents(t: Tables) -> DataFrame:
    wanted = facets.from_url("lang=en,fr&source=src1,src2,src3&labels=fr,src3&period=")
    rows = t.documents.withColumn("labels", F.array("lang", "source"))
    return rows.filter(facets.predicate(wanted, {"labels"})).select("doc_id", "lang", "source")


@query("SELECT source AS value, count(*) AS n FROM documents GROUP BY 1")
def facet_counts(t: Tables) -> DataFrame:
    return facets.counts(t.documents, "source")


@query("SELECT value, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS value FROM part) GROUP BY 1")
def facet_counts_many(t: Tables) -> DataFrame:
    return facets.counts(t.part.select(F.split("p_name", " ").alias("words")), "words", many=True)


@query("SELECT CASE WHEN o_totalprice < 1000 THEN 'Undated' ELSE (floor(year(o_orderdate) / 10) * 10)::INT || 's' END AS label, count(*) AS n FROM orders GROUP BY 1")
def decade_histogram(t: Tables) -> DataFrame:
    y = F.when(F.col("o_totalprice") < 1000, F.lit(None)).otherwise(F.year("o_orderdate"))
    return t.orders.groupBy(vl.decade_label(y).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT value, coalesce(n, 0) AS n, coalesce(place, 4) AS place, place IS NOT NULL AS expected
FROM (SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1) FULL JOIN (VALUES ('view', 0), ('click', 1), ('purchase', 2), ('refund', 3)) e(value, place) USING (value)"""
)
def distribution_with_unexpected(t: Tables) -> DataFrame:
    return facets.with_expected(t.events, "event_type", ["view", "click", "purchase", "refund"])


@query("SELECT doc_id, coalesce(list_position(['en', 'de', 'fr'], lang), 0)::INT AS place FROM documents")
def explicit_order(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", facets.place_in(["en", "de", "fr"], F.col("lang")).alias("place"))


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 6")
def latest_six(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_orderdate", "o_totalprice").orderBy(F.col("o_orderdate").desc_nulls_last(), "o_orderkey").limit(6)


@query(
    """SELECT o_orderkey, row_number() OVER (ORDER BY date_trunc('day', o_orderdate) DESC NULLS LAST, o_totalprice, o_orderkey) AS place FROM orders"""
)
def sorted_listing(t: Tables) -> DataFrame:
    day = F.date_trunc("day", "o_orderdate")
    # falling days, and inside a day the price as far as it is below ten million
    price = F.least(F.lit(9_999_999.0), F.greatest(F.lit(0.0), F.coalesce(F.col("o_totalprice").cast("double"), F.lit(0.0))))
    at = price - F.unix_date(day.cast("date")) * 10_000_000.0
    return rank_over(t.orders, at, [day.desc_nulls_last(), F.col("o_totalprice"), F.col("o_orderkey")], "place").select("o_orderkey", "place")


@query("SELECT (floor(year(o_orderdate) / 10) * 10)::INT AS decade, min(o_orderkey) AS first_key, count(*) AS n FROM orders GROUP BY 1")
def decade_sections(t: Tables) -> DataFrame:
    return t.orders.groupBy(vl.decade(F.year("o_orderdate")).alias("decade")).agg(F.min("o_orderkey").alias("first_key"), F.count(F.lit(1)).alias("n"))


@query(
    """SELECT doc_id, lang, CASE WHEN lang = 'en' THEN '/d/' || doc_id ELSE '/' || lang || '/d/' || doc_id END AS path, lang IN ('fr', 'es') AS noindex FROM documents"""
)
def language_paths(t: Tables) -> DataFrame:
    path = F.concat(F.lit("/d/"), F.col("doc_id").cast("string"))
    return t.documents.select("doc_id", "lang", tx.language_path(path, F.col("lang")).alias("path"), F.col("lang").isin("fr", "es").alias("noindex"))


@query(
    """WITH g AS (SELECT doc_id // 4 AS work, lang, min(doc_id) AS id FROM documents GROUP BY 1, 2)
SELECT work, hreflang, id FROM (SELECT work, lang AS hreflang, id FROM g UNION ALL SELECT work, 'x-default', coalesce(min(id) FILTER (lang = 'en'), min(id)) FROM g GROUP BY work)"""
)
def hreflang_alternates(t: Tables) -> DataFrame:
    g = t.documents.groupBy(F.expr("doc_id div 4").alias("work"), "lang").agg(F.min("doc_id").alias("id"))
    maps = g.groupBy("work").agg(F.map_from_entries(F.collect_list(F.struct("lang", "id"))).alias("m"))
    default = F.coalesce(F.try_element_at("m", F.lit("en")), F.array_min(F.map_values("m")))
    return maps.select("work", F.explode(F.map_concat("m", F.create_map(F.lit("x-default"), default))).alias("hreflang", "id"))


@query(
    """SELECT dense_rank() OVER (ORDER BY source NULLS LAST)::INT AS section, doc_id, '# ' || doc_id || chr(10) || text AS entry FROM documents WHERE lang = 'en'"""
)
def corpus_dump(t: Tables) -> DataFrame:
    d = t.documents.filter("lang = 'en'")
    # a row for each source
    sections = d.select(F.col("source").alias("s")).distinct().select("s", F.row_number().over(Window.orderBy(F.col("s").asc_nulls_last())).alias("section"))
    return d.join(sections, F.col("source").eqNullSafe(F.col("s"))).select("section", "doc_id", F.concat(F.lit("# "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text")).alias("entry"))


@query("SELECT 1 AS rank, '- ' || s_name || ': /s/' || s_suppkey AS line FROM supplier WHERE s_acctbal >= 0 UNION ALL SELECT 2, '- ' || p_name || ': /p/' || p_partkey FROM part WHERE p_size > 10")
def short_index(t: Tables) -> DataFrame:
    line = lambda name, prefix, key: F.concat(F.lit("- "), F.col(name), F.lit(prefix), F.col(key).cast("string"))
    a = t.supplier.filter("s_acctbal >= 0").select(F.lit(1).alias("rank"), line("s_name", ": /s/", "s_suppkey").alias("line"))
    return a.unionByName(t.part.filter("p_size > 10").select(F.lit(2).alias("rank"), line("p_name", ": /p/", "p_partkey").alias("line")))


@query(
    """SELECT doc_id, '# ' || doc_id || chr(10) || chr(10) || '<!-- source: ' || source || ' -->' || chr(10) || chr(10) ||
CASE WHEN trim(text) = '' THEN '{"doc_id":' || doc_id || ',"lang":"' || lang || '"}' ELSE text END AS page FROM documents"""
)
def markdown_sibling(t: Tables) -> DataFrame:
    return sibling_pages(t, F.col("text"))


def sibling_pages(t: Tables, body: Column) -> DataFrame:
    fence = F.to_json(F.struct("doc_id", "lang"))
    return t.documents.select(
        "doc_id",
        F.concat(F.lit("# "), F.col("doc_id").cast("string"), F.lit("\n\n<!-- source: "), F.col("source"), F.lit(" -->\n\n"), F.when(F.trim(body) == "", fence).otherwise(body)).alias("page"),
    )


@query(
    """WITH c AS (SELECT n_regionkey, count(DISTINCT n_nationkey) AS nations, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1)
SELECT r_name AS section, r_regionkey AS place, nations, suppliers FROM c JOIN region ON r_regionkey = n_regionkey WHERE suppliers > 0"""
)
def sections_with_stats(t: Tables) -> DataFrame:
    c = t.nation.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_regionkey").agg(F.countDistinct("n_nationkey").alias("nations"), F.count("s_suppkey").alias("suppliers"))
    return c.join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).filter("suppliers > 0").select(F.col("r_name").alias("section"), F.col("r_regionkey").alias("place"), "nations", "suppliers")


@query("SELECT r_name, string_agg(n_nationkey || ' :: ' || n_name, chr(10) ORDER BY n_nationkey || ' :: ' || n_name) AS listing FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def listing_strings(t: Tables) -> DataFrame:
    line = F.concat(F.col("n_nationkey").cast("string"), F.lit(" :: "), F.col("n_name"))
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("listing"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS body, count(*) AS pages FROM conversations GROUP BY 1")
def ordered_concat(t: Tables) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("body"), F.count(F.lit(1)).alias("pages"))


@query(
    """SELECT doc_id, CASE WHEN lang NOT IN ('fr', 'es') OR n_chars <= 100 THEN 'unchecked' WHEN r > 0.7 THEN 'corrupted' ELSE 'partial' END AS quality FROM (
SELECT *, length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g'))::DOUBLE / greatest(1, length(regexp_replace(text, '[ \\t\\n\\r\\f\\v]', '', 'g'))) AS r FROM documents)""".replace("\\\\", "\\")
)
def script_ratio_quality(t: Tables) -> DataFrame:
    ratio = F.char_length(F.regexp_replace("text", "[^A-Za-z0-9]", "")) / F.greatest(F.lit(1), F.char_length(F.regexp_replace("text", r"[ \t\n\r\f\x0B]", "")))
    return t.documents.select("doc_id", F.when(~F.col("lang").isin("fr", "es") | (F.col("n_chars") <= 100), "unchecked").when(ratio > 0.7, "corrupted").otherwise("partial").alias("quality"))
