"""Continuation loops and their log, merged recommendations, batch records, profiles, reshaped entries, small record rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import text as tx
from folio.operators import ledger, profile, rules
from folio.plans.base import Tables, query
from folio.streaming import continuation

#: Every order is a work whose lines are chunks; some have no place, some come twice.
CHUNKS_SQL = """
WITH c AS (SELECT l_orderkey AS work, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice) AS seq, CASE WHEN l_suppkey % 9 > 0 THEN l_partkey % 5 END AS place FROM lineitem),
f AS (SELECT *, coalesce(place < 4 AND row_number() OVER (PARTITION BY work, place ORDER BY seq) = 1, FALSE) AS fresh, count(place) OVER (PARTITION BY work ORDER BY seq) AS merges FROM c),
i AS (SELECT *, merges - coalesce(max(merges) FILTER (fresh) OVER (PARTITION BY work ORDER BY seq), 0) AS idle, merges - CASE WHEN place IS NULL THEN 0 ELSE 1 END >= 4 AS spent FROM f),
e AS (SELECT *, CASE WHEN spent THEN 'spent' WHEN place IS NOT NULL AND idle >= 2 THEN 'stalled' WHEN place IS NULL THEN 'skipped' WHEN fresh THEN 'merged' ELSE 'repeated' END AS event,
  4 - count(*) FILTER (fresh AND NOT spent) OVER (PARTITION BY work ORDER BY seq) AS rest, greatest(0, 4 - merges) AS budget FROM i),
l AS (SELECT work, seq, event, rest AS "left", budget FROM e x WHERE NOT EXISTS (SELECT 1 FROM e y WHERE y.work = x.work AND y.seq < x.seq AND y.event IN ('spent', 'stalled')))
"""


def chunk_log(t: Tables) -> DataFrame:
    place = F.when(F.col("l_suppkey") % 9 > 0, (F.col("l_partkey") % 5).cast("int"))
    rows = t.lineitem.select(F.col("l_orderkey").alias("work"), "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", place.alias("toc_index"), F.array(*[F.lit(i) for i in range(4)]).alias("toc"))
    return continuation.progress(rows, ["l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice"], budget=4)


@query(CHUNKS_SQL + "SELECT * FROM l")
def continuation_log(t: Tables) -> DataFrame:
    return chunk_log(t)


@query(
    CHUNKS_SQL
    + """, p AS (SELECT l_orderkey AS work, sum(l_quantity) AS rendered FROM lineitem GROUP BY 1)
SELECT work, CASE arg_max(event, seq) WHEN 'spent' THEN 'dispatch_budget_exceeded' WHEN 'stalled' THEN 'no_progress' ELSE CASE min("left") WHEN 0 THEN 'complete' ELSE 'open' END END AS state, min("left") AS "left",
  arg_max(event, seq) IN ('spent', 'stalled') AS review, any_value(rendered) / 300 < 0.3 AS caveat FROM l JOIN p USING (work) GROUP BY 1"""
)
def continuation_outcomes(t: Tables) -> DataFrame:
    pages = t.lineitem.groupBy(F.col("l_orderkey").alias("work")).agg(F.sum("l_quantity").alias("rendered")).withColumn("total", F.lit(300))
    return continuation.outcomes(chunk_log(t), pages)


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def run_counters(t: Tables) -> DataFrame:
    return ledger.counters(t.events.withColumnRenamed("event_type", "status"), "status")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 >= 2 THEN 'no-progress' WHEN o_custkey % 10 >= 6 THEN 'budget' WHEN o_totalprice / 100000 < 0.3 THEN 'extent' END AS stops FROM orders")
def loop_guards(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", ledger.loop_guard(F.col("o_orderkey") % 4, F.col("o_custkey") % 10, 6, F.col("o_totalprice") / 100000).alias("stops"))


@query(
    """WITH t AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_brand || ': ' || p_name WHEN 1 THEN p_name || ' - ' || p_type || ' on  ' || p_brand WHEN 2 THEN p_type || ' of ' || p_name || ' and ' || p_brand ELSE p_name || '  ' || p_type END AS x FROM part),
c AS (SELECT p_partkey, [CASE WHEN strpos(x, ':') > 1 THEN trim(split_part(x, ':', 1)) END, CASE WHEN strpos(x, ' - ') > 1 THEN trim(split_part(x, ' - ', 1)) END, CASE WHEN strpos(x, ' on ') > 1 THEN trim(split_part(x, ' on ', 1)) END,
  CASE WHEN len(string_split(regexp_replace(x, ' +', ' ', 'g'), ' ')) <= 4 THEN regexp_replace(x, ' +', ' ', 'g') END] AS c FROM t)
SELECT p_partkey, array_to_string(list_filter(c, lambda x, i: x IS NOT NULL AND list_position(c, x) = i), '|') AS prefixes FROM c"""
)
def title_prefixes(t: Tables) -> DataFrame:
    n = F.col("p_size") % 4
    title = F.when(n == 0, F.concat("p_brand", F.lit(": "), "p_name")).when(n == 1, F.concat("p_name", F.lit(" - "), "p_type", F.lit(" on  "), "p_brand")).when(n == 2, F.concat("p_type", F.lit(" of "), "p_name", F.lit(" and "), "p_brand")).otherwise(F.concat("p_name", F.lit("  "), "p_type"))
    return t.part.select("p_partkey", F.array_join(tx.title_prefixes(title), "|").alias("prefixes"))


@query(
    """SELECT c_custkey, '{"a": {"confidence": "' || CASE WHEN c_nationkey % 3 = 0 THEN 'high' ELSE 'low' END || '", "value": "' || c_name || '"}, "list": [{"confidence": "low", "value": 1}, {"confidence": "medium", "value": 2}], "n": ' || c_nationkey || '}' AS record,
CASE WHEN c_nationkey % 3 = 0 THEN 'list[0]' ELSE 'a,list[0]' END AS fixed FROM customer"""
)
def confidence_fixed(t: Tables) -> DataFrame:
    said = F.when(F.col("c_nationkey") % 3 == 0, F.lit('"high"')).when(F.col("c_nationkey") % 3 == 1, F.lit("null")).otherwise(F.lit('"sure"'))
    record = F.concat(F.lit('{"n":'), F.col("c_nationkey").cast("string"), F.lit(',"a":{"value":"'), "c_name", F.lit('","confidence":'), said, F.lit('},"list":[{"value":1,"confidence":7},{"value":2,"confidence":"medium"}]}'))
    made = t.customer.select("c_custkey", rules.fix_confidence(record).alias("x"))
    return made.select("c_custkey", "x.record", F.array_join("x.fixed", ",").alias("fixed"))


@query(
    """SELECT p_partkey, '{"name":"' || p_name || '"' || CASE WHEN p_size % 3 > 0 THEN ',"brand":"' || p_brand || '"' ELSE '' END || CASE WHEN p_size % 2 = 0 THEN ',"words":["' || replace(p_name, ' ', '","') || '"]' ELSE '' END || '}' AS record FROM part"""
)
def pruned_records(t: Tables) -> DataFrame:
    words = F.when(F.col("p_size") % 2 == 0, F.split("p_name", " ")).otherwise(F.array().cast("array<string>"))
    brand = F.when(F.col("p_size") % 3 > 0, F.col("p_brand")).otherwise("")
    return t.part.select("p_partkey", rules.pruned_json(name=F.col("p_name"), brand=rules.filled(brand), words=rules.filled(words, many=True)).alias("record"))


@query(
    """WITH a AS (SELECT p_partkey, ['thinker', 'work'] AS k, [p_name, upper(p_name)] AS o, [' ' || upper(p_name), lower(p_type), '  '] AS n FROM part)
SELECT p_partkey, 'thinker:' || p_name || '|work:' || upper(p_name) || '|thinker:' || lower(p_type) AS additions FROM part JOIN a USING (p_partkey)"""
)
def recommendations_merged(t: Tables) -> DataFrame:
    item = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("verbatim"))
    old = F.array(item("thinker", F.col("p_name")), item("work", F.upper("p_name")))
    new = F.array(item("thinker", F.concat(F.lit(" "), F.upper("p_name"))), item("thinker", F.lower("p_type")), item("thinker", F.lit("  ")))
    made = F.transform(rules.additions_merged(old, new), lambda x: F.concat_ws(":", x["kind"], x["verbatim"]))
    return t.part.select("p_partkey", F.array_join(made, "|").alias("additions"))


@query(
    r"""WITH p AS (SELECT doc_id, source, lang, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'https://x.org/a.b/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.html?x=1' ELSE '' END END AS url, doc_id % 5 = 0 AS bare FROM documents),
e AS (SELECT *, lower(regexp_extract(coalesce(url, ''), '\.([A-Za-z0-9]{1,5})([?#]|$)', 1)) AS ext FROM p),
k AS (SELECT source, array_to_string(list(lang || ':' || n ORDER BY lang || ':' || n), ',') AS kinds FROM (SELECT source, lang, count(*) AS n FROM e WHERE coalesce(lang, '') <> '' GROUP BY 1, 2) GROUP BY 1),
x AS (SELECT source, array_to_string(list(ext || ':' || n ORDER BY ext || ':' || n), ',') AS extensions FROM (SELECT source, ext, count(*) AS n FROM e WHERE ext <> '' GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT source, count(*) AS n, array_to_string(list(doc_id ORDER BY doc_id)[1:3], ',') AS samples, count(*) FILTER (bare) AS missing FROM e GROUP BY 1)
SELECT s.source, n, samples, missing, coalesce(kinds, '') AS kinds, coalesce(extensions, '') AS extensions FROM s LEFT JOIN k ON k.source IS NOT DISTINCT FROM s.source LEFT JOIN x ON x.source IS NOT DISTINCT FROM s.source"""
)
def taxonomy_profile(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    url = F.when(k % 4 != 0, F.concat(F.lit("https://x.org/a.b/"), k.cast("string"), F.when(k % 3 == 0, ".PDF").when(k % 3 == 1, ".html?x=1").otherwise("")))
    terms = F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("lang"))
    made = profile.taxonomy_profile(t.documents.select("doc_id", "source", "lang", url.alias("url"), terms.alias("terms")), "source", "doc_id", "lang", "url", "terms")
    return made.withColumn("samples", F.array_join(F.col("samples").cast("array<string>"), ","))


@query(
    """WITH w AS (SELECT o_orderkey AS work, CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE year(o_orderdate) END AS year FROM orders),
e AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'musings' ELSE 'essays' END AS collection, CASE WHEN doc_id % 3 > 0 THEN doc_id END AS excerpt_of, doc_id % 7 = 0 AS draft FROM documents)
SELECT doc_id, collection, 'T' || doc_id AS title, coalesce(CASE WHEN collection = 'musings' AND year <> 0 THEN year END, 2000 + doc_id % 20)::INT AS year_hint, excerpt_of::VARCHAR AS excerpt_of,
  coalesce(nullif(lang, ''), '') AS author FROM e LEFT JOIN w ON work = excerpt_of WHERE NOT draft"""
)
def classification_records(t: Tables) -> DataFrame:
    """Excerpts of documents are held by `cut_paragraphs`; here the hints and contexts."""
    k = F.col("doc_id")
    entries = t.documents.select("doc_id", F.when(k % 2 == 0, "musings").otherwise("essays").alias("collection"), F.concat(F.lit("T"), k.cast("string")).alias("title"), F.col("text").alias("body"), (k % 20 + 2000).cast("int").alias("pub_year"), (k % 7 == 0).alias("draft"), F.col("lang").alias("author"), F.lit(" ").alias("subject"), F.when(k % 3 > 0, k.cast("string")).alias("excerpt_of"))
    works = t.orders.select(F.col("o_orderkey").cast("string").alias("work"), F.when(F.col("o_orderkey") % 6 == 0, 0).otherwise(F.year("o_orderdate")).alias("year"))
    made = profile.classification_records(entries, works, "doc_id", 1500)
    of = lambda c: F.try_element_at("context", F.lit(c))
    return made.select("doc_id", "collection", "title", "year_hint", of("excerpt_of").alias("excerpt_of"), F.coalesce(of("author"), F.lit("")).alias("author"))


@query(
    r"""WITH i AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE ' ' || source || ' ' END AS subject, CASE WHEN doc_id % 4 > 0 THEN (1990 + doc_id % 30) || '-05-01' END AS published FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL))
SELECT doc_id AS source_key, 'i' || doc_id AS id, coalesce('T' || n_chars, 'i' || doc_id) AS main, coalesce(nullif(trim(subject), ''), '') AS authors, coalesce(nullif(lang, ''), 'en') AS language, CASE WHEN published IS NOT NULL THEN 1990 + doc_id % 30 END::INT AS year, doc_id % 5 = 0 AS draft, 'u' || doc_id AS url FROM i"""
)
def collection_migration(t: Tables) -> DataFrame:
    """Documents without a label move as interviews become works."""
    k = F.col("doc_id")
    subject = F.when(k % 3 == 1, "  ").when(k % 3 == 2, F.concat(F.lit(" "), "source", F.lit(" ")))
    published = F.when(k % 4 > 0, F.concat((k % 30 + 1990).cast("string"), F.lit("-05-01")))
    slug = F.concat(F.lit("i"), k.cast("string"))
    shape = profile.interview_as_work(slug, F.lit(None).cast("string"), F.concat(F.lit("T"), F.col("n_chars").cast("string")), subject, published, F.col("lang"), F.when(k % 5 == 0, True), F.concat(F.lit(" u"), k.cast("string")), F.lit("none"), F.lit(None).cast("string"))
    made, _ = profile.migrated(t.documents, t.labels.filter("doc_id is not null"), "doc_id", shape)
    return made.select("source_key", "id", "title.main", F.array_join("authors", ",").alias("authors"), "publication.language", "publication.year", "draft", "url")
