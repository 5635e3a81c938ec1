"""Text functions, upserts, validators, audits, ledgers and page queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.functions import names
from folio.functions import text as tx
from folio.functions import values as vl
from folio.operators import joins, ledger, merge, occurrences, quality
from folio.plans.base import Tables, query
from folio.sources import pages as page_source
from folio.streaming import breaker


def r(sql: str) -> str:
    """SQL with a doubled backslash written for a single one."""
    return sql.replace("\\\\", "\\")


@query(
    r("""SELECT s_suppkey, regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS kebab,
regexp_replace(regexp_replace(lower(trim(s_name)), '[_\\s]+', '-', 'g'), '-+', '-', 'g') AS vocab_key,
trim(regexp_replace(regexp_replace(regexp_replace(lower(s_name), '[.,\\-]', ' ', 'g'), '[''’]', '', 'g'), '\\s+', ' ', 'g')) AS alias_key,
trim(regexp_replace(regexp_replace(lower(strip_accents(s_name)), '[.,]', '', 'g'), '\\s+', ' ', 'g')) AS seed_key FROM supplier""")
)
def name_keys(t: Tables) -> DataFrame:
    n = F.col("s_name")
    return t.supplier.select("s_suppkey", names.n2_kebab(n).alias("kebab"), names.n3_vocab_key(n).alias("vocab_key"), names.n4_alias_key(n).alias("alias_key"), names.n5_seed_key(n, names.strip_accents).alias("seed_key"))


@query(
    r("""SELECT doc_id, regexp_replace(regexp_replace(lower(strip_accents(substr(text, 1, 40))), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM documents WHERE lang IN ('en', 'fr', 'es')""")
)
def title_slugs(t: Tables) -> DataFrame:
    return t.documents.filter("lang in ('en', 'fr', 'es')").select("doc_id", names.n1_slug(F.substring("text", 1, 40), fold=names.strip_accents).alias("slug"))


@query(r("SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[*_`>~]', '', 'g'), '\\s+', ' ', 'g')) AS quote_text FROM documents WHERE lang = 'en'"))
def quote_normal_form(t: Tables) -> DataFrame:
    return t.documents.filter("lang = 'en'").select("doc_id", names.n10_quote_text(F.col("text")).alias("quote_text"))


@query("SELECT p_partkey, string_split(p_name, ' ')[-1] || ', ' || array_to_string(string_split(p_name, ' ')[1:-2], ' ') AS sort_name, string_split(replace(p_name, ' ', '-'), '-')[-1] AS surname FROM part")
def sort_names(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", names.sort_name(F.col("p_name")).alias("sort_name"), names.surname_of_slug(names.n2_kebab(F.col("p_name"))).alias("surname"))


@query(r("SELECT doc_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '`[^`]*`', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[#>*_~|]+', ' ', 'g'), '\\s+', ' ', 'g')), 1, 200) AS excerpt FROM documents WHERE lang = 'en'"))
def excerpts(t: Tables) -> DataFrame:
    return t.documents.filter("lang = 'en'").select("doc_id", tx.excerpt(F.col("text"), 200).alias("excerpt"))


@query(
    r("""WITH h AS (SELECT doc_id, text, substr(text, 1, 600) AS h FROM documents)
SELECT doc_id, regexp_replace(CASE WHEN length(text) <= 600 THEN text WHEN regexp_matches(h, '(?s)^.+\\n\\n') THEN regexp_extract(h, '(?s)^(.*)\\n\\n', 1) WHEN regexp_matches(h, '(?s)^.+\\n') THEN regexp_extract(h, '(?s)^(.*)\\n', 1) ELSE h END, '\\s+$', '') AS cut FROM h""")
)
def truncated_at_paragraph(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.cut_at_paragraph(F.col("text"), 600).alias("cut"))


@query(
    r("""WITH s AS (SELECT doc_id, text, regexp_extract(substr(text, 1, 1200), '(?s)^(.*\\.) ', 1) AS s FROM documents)
SELECT doc_id, CASE WHEN length(text) <= 1200 THEN text WHEN length(s) >= 600 THEN s ELSE rtrim(substr(text, 1, 1197)) || '…' END AS cut FROM s""")
)
def truncated_at_sentence(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.cut_at_sentence(F.col("text")).alias("cut"))


@query(
    r("""WITH d AS (SELECT doc_id, '# ' || source || chr(10) || '*By ' || lang || '*' || chr(10) || text AS body, source FROM documents)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN regexp_replace(body, '^\\s*#[^\\n]*\\n*', '') ELSE body END AS no_heading, regexp_replace(regexp_replace(body, '^\\s*#\\s+[^\\n]*(?:\\n+|$)(?:\\*By [^\\n]*\\*[ \\t]*(?:\\n+|$))?', ''), '\\n{3,}', chr(10) || chr(10), 'g') AS no_title FROM d""")
)
def stripped_headings(t: Tables) -> DataFrame:
    return without_headings(t, F.col("text"))


def without_headings(t: Tables, text: Column) -> DataFrame:
    d = t.documents.select("doc_id", "source", F.concat(F.lit("# "), F.col("source"), F.lit("\n*By "), F.col("lang"), F.lit("*\n"), text).alias("body"))
    known = F.array(F.lit("other"), F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise("none"))
    return d.select("doc_id", tx.strip_heading(F.col("body"), known).alias("no_heading"), tx.strip_title_byline(F.col("body")).alias("no_title"))


@query(
    r("""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, 'Licensed under [^\\n]*', '', 'g'), '[#%&$*]{3}', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS body FROM documents""")
)
def without_boilerplate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.strip_markers(F.col("text"), [r"Licensed under [^\n]*", r"[#%&$*]{3}"]).alias("body"))


@query(r("SELECT doc_id, list_extract(regexp_extract_all(text, '([A-Za-z0-9._]+@[A-Za-z0-9.]+)', 1), -1) AS last_mail FROM documents"))
def last_match(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.last_match(F.col("text"), r"([A-Za-z0-9._]+@[A-Za-z0-9.]+)").alias("last_mail"))


@query(
    r("""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\\n[^\\n]*$', '')) AS c FROM documents) SELECT doc_id, CASE WHEN length(regexp_replace(c, '\\s', '', 'g')) >= 80 THEN c END AS body FROM c""")
)
def tail_or_null(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.tail_or_null(F.col("text"), r"\n[^\n]*\z").alias("body"))


@query(r("SELECT doc_id, regexp_replace(regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\\*\\*([^*]+)\\*\\*', '<strong>\\1</strong>', 'g'), '\\*([^*]+)\\*', '<em>\\1</em>', 'g') AS html FROM documents"))
def inline_html(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.inline_html(F.col("text")).alias("html"))


@query(
    r("""WITH f AS (SELECT doc_id, trim(regexp_extract(text, '(?i)\\bby\\s+([^(|\\-]+)', 1)) AS f FROM (SELECT doc_id, regexp_replace(substr(text, 1, 120), '\\s', ' ', 'g') AS text FROM documents WHERE lang = 'en')) SELECT doc_id, CASE WHEN length(f) BETWEEN 3 AND 80 THEN f END AS author FROM f""")
)
def author_from_title(t: Tables) -> DataFrame:
    d = t.documents.filter("lang = 'en'").select("doc_id", F.regexp_replace(F.substring("text", 1, 120), r"[ \t\n\x0B\f\r]", " ").alias("title"))
    return d.select("doc_id", tx.author_from_title(F.col("title")).alias("author"))


@query(
    """WITH c AS (SELECT doc_id, text, CASE WHEN text LIKE '%purchase%' THEN 'buy' END AS x FROM documents) SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\\b(?:station|ation)\\b') THEN 'place' WHEN regexp_matches(text, '(?i)\\b(?:thing|ering)\\b') THEN 'object' WHEN regexp_matches(text, '(?i)\\b(?:the)\\b') THEN 'article' END AS label FROM c WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"""
)
def first_keyword(t: Tables) -> DataFrame:
    return t.documents.filter("lang = 'en'").select("doc_id", tx.first_label(F.col("text"), [("station|ation", "place"), ("thing|ering", "object"), ("the", "article")]).alias("label"))


@query(
    r("""WITH p AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS p FROM pages)
SELECT page_id, coalesce(list_extract(p, nullif(list_position(p, 'en'), 0) + 1), list_extract(list_filter(p, lambda x: NOT regexp_matches(x, '^\\d+$')), -1), 'page-' || page_id) AS slug FROM p""")
)
def slug_from_url(t: Tables) -> DataFrame:
    p = t.pages.withColumn("url", F.regexp_replace("url", r"[^\x21-\x7E]", ""))
    return p.select("page_id", tx.slug_from_url(F.col("url"), F.concat(F.lit("page "), F.col("page_id").cast("string")), "en").alias("slug"))


@query("SELECT doc_id, (length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 0) AS latin, CASE WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 0 THEN 'latin' ELSE 'none' END AS script FROM documents")
def scripts(t: Tables) -> DataFrame:
    s = tx.script_of(F.col("text"))
    return t.documents.select("doc_id", (s == "latin").alias("latin"), s.alias("script"))


@query(
    r("""SELECT o_orderkey, CASE WHEN regexp_matches(c, '\\b((?:19|20)[0-9]{2})\\b') THEN regexp_extract(c, '\\b((?:19|20)[0-9]{2})\\b', 1)::INT END AS y, year(o_orderdate) AS iso_year,
CASE WHEN year(o_orderdate) < 1994 THEN 'a' WHEN year(o_orderdate) < 1997 THEN 'b' ELSE 'c' END AS band FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 'no year ' || o_orderkey ELSE 'in ' || strftime(o_orderdate, '%Y') || ' done' END AS c FROM orders)""")
)
def years(t: Tables) -> DataFrame:
    return years_of(t.orders)


def years_of(orders: DataFrame) -> DataFrame:
    c = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("no year "), F.col("o_orderkey").cast("string"))).otherwise(F.concat(F.lit("in "), F.date_format("o_orderdate", "yyyy"), F.lit(" done")))
    y = F.year("o_orderdate")
    return orders.select("o_orderkey", vl.first_year(c).alias("y"), vl.year_of(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("iso_year"), F.when(y < 1994, "a").when(y < 1997, "b").otherwise("c").alias("band"))


@query("SELECT p_partkey, 1900 + p_partkey % 150 AS y, CASE WHEN y <= 1947 THEN 'pre-independence' WHEN y < 1965 THEN 'nehruvian-era' WHEN y < 1985 THEN 'late-license-raj' WHEN y < 2005 THEN 'reform-era' ELSE 'post-reform' END AS period, (y // 10) * 10 AS decade FROM part")
def periods(t: Tables) -> DataFrame:
    y = (1900 + F.col("p_partkey") % 150).alias("y")
    return t.part.select("p_partkey", y).select("p_partkey", "y", vl.period_of(F.col("y")).alias("period"), vl.decade(F.col("y")).cast("long").alias("decade"))


@query("SELECT p_partkey, i AS lo, least(i + 19, p_size * 3) AS hi FROM part, LATERAL (SELECT unnest(range(1, p_size * 3 + 1, 20)) AS i)")
def page_windows(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.explode(vl.page_windows(F.col("p_size") * 3)).alias("w")).select("p_partkey", "w.lo", "w.hi")


@query(
    """WITH m AS (SELECT p_partkey, list_transform(string_split(p_name, ' '), lambda x: CASE x WHEN 'red' THEN ['crimson', 'scarlet'] WHEN 'blue' THEN ['azure'] ELSE [x] END) AS l FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(flatten(l), lambda x: x IN ('crimson', 'scarlet', 'azure', 'ring', 'bolt', 'small')))), ',') AS places FROM m"""
)
def alias_expansion(t: Tables) -> DataFrame:
    m = F.create_map(F.lit("red"), F.array(F.lit("crimson"), F.lit("scarlet")), F.lit("blue"), F.array(F.lit("azure")))
    known = F.array(*[F.lit(x) for x in ("crimson", "scarlet", "azure", "ring", "bolt", "small")])
    return t.part.select("p_partkey", F.array_join(vl.expand_aliases(F.split("p_name", " "), m, known), ",").alias("places"))


@query("SELECT user_id, count(*) AS events, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 3) AS total, round(sum(value) / greatest(count(*), 1), 3) AS mean FROM events GROUP BY 1")
def ledger_by_user(t: Tables) -> DataFrame:
    return ledger.summary(t.events, ["user_id"], F.col("event_type") != "error", F.col("value"))


@query(
    """SELECT coalesce(event_type, '*') AS event_type, coalesce(day::VARCHAR, '*') AS day, count(*) AS events, round(sum(value), 3) AS total FROM (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM events) GROUP BY GROUPING SETS ((event_type), (day), ())"""
)
def ledger_grouping_sets(t: Tables) -> DataFrame:
    return ledger.grouping_sets(t.events.withColumn("day", F.date_format("ts", "yyyy-MM-dd")), ["event_type", "day"], F.col("value"))


@query(
    """WITH l AS (SELECT user_id, event_type AS latest FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT CASE latest WHEN 'error' THEN 'low' WHEN 'purchase' THEN 'high' ELSE 'mixed' END AS bucket, count(*) AS n FROM l GROUP BY 1"""
)
def latest_per_id_buckets(t: Tables) -> DataFrame:
    last = t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"))
    return last.groupBy(F.when(F.col("latest") == "error", "low").when(F.col("latest") == "purchase", "high").otherwise("mixed").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH e AS (SELECT user_id, ts, event_id, event_type = 'error' AS bad, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events)
SELECT user_id, event_id, count(*) FILTER (bad) OVER (PARTITION BY user_id, run ORDER BY epoch(ts) RANGE BETWEEN 864000 PRECEDING AND CURRENT ROW) >= 2 AS tripped FROM e"""
)
def circuit_breaker_batch(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", "ts", (F.col("event_type") == "error").alias("bad"), (F.col("event_type") == "purchase").alias("good"))
    return breaker.tripped(rows, "user_id", ["ts", "event_id"], failures=2, seconds=864_000).select("user_id", "event_id", "tripped")


@query("SELECT dimension, populated, total, 100 * populated // greatest(total, 1) AS percent FROM (SELECT count(*) AS total, count(*) FILTER (quality = 1) AS q, count(*) FILTER (toxic = 1) AS t, count(*) FILTER (lang = 'en') AS e FROM documents LEFT JOIN labels USING (doc_id)), LATERAL (VALUES ('quality', q), ('toxic', t), ('english', e)) v(dimension, populated)")
def coverage_table(t: Tables) -> DataFrame:
    d = t.documents.join(t.labels, "doc_id", "left")
    return quality.coverage(d, {"quality": F.col("quality") == 1, "toxic": F.col("toxic") == 1, "english": F.col("lang") == "en"})


@query("SELECT axis, percent, percent >= 80 AS passed FROM (SELECT round(100 * avg((quality = (n_chars > 300)::INT)::INT), 1) AS q, round(100 * avg((toxic = 0)::INT), 1) AS t FROM labels JOIN documents USING (doc_id)), LATERAL (VALUES ('quality', q), ('toxic', t)) v(axis, percent)")
def agreement_gate(t: Tables) -> DataFrame:
    j = t.labels.join(t.documents, "doc_id")
    return quality.agreement(j, {"quality": F.col("quality") == (F.col("n_chars") > 300).cast("int"), "toxic": F.col("toxic") == 0})


@query("SELECT source, count(*) AS total, count(quality) AS labelled, round(count(quality)::DOUBLE / greatest(count(*), 1), 4) AS mean, CASE WHEN count(quality) >= 10 THEN 'OK' ELSE 'LO' END AS mark FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def coverage_by_collection(t: Tables) -> DataFrame:
    g = t.documents.join(t.labels, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count("quality").alias("labelled"))
    return g.withColumn("mean", F.round(F.col("labelled") / F.greatest("total", F.lit(1)), 4)).withColumn("mark", F.when(F.col("labelled") >= 10, "OK").otherwise("LO"))


@query(
    """WITH q AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '2-HIGH' GROUP BY 1), c AS (SELECT c_custkey, c_mktsegment, coalesce(n, 0) AS quotes FROM customer LEFT JOIN q ON o_custkey = c_custkey)
SELECT c_mktsegment, count(*) FILTER (quotes > 0) AS with_quotes, count(*) FILTER (quotes = 0) AS without, CAST(sum(quotes) AS BIGINT) AS total FROM c GROUP BY 1"""
)
def inbound_quotes_crosstab(t: Tables) -> DataFrame:
    q = t.orders.filter("o_orderpriority = '2-HIGH'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    c = t.customer.join(q, F.col("o_custkey") == F.col("c_custkey"), "left").withColumn("quotes", F.coalesce("n", F.lit(0)))
    return c.groupBy("c_mktsegment").agg(F.count_if(F.col("quotes") > 0).alias("with_quotes"), F.count_if(F.col("quotes") == 0).alias("without"), F.sum("quotes").alias("total"))


@query(
    """WITH o AS (SELECT doc_id, source AS a, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN NULL ELSE lang END AS b FROM documents), n AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'src1' END AS a, 'good' AS b FROM labels)
SELECT doc_id, CASE WHEN sa = 'wrote' THEN na ELSE a END AS a, CASE WHEN sb = 'wrote' THEN nb ELSE b END AS b, sa AS a_status, sb AS b_status FROM (
SELECT o.doc_id, o.a, o.b, n.a AS na, n.b AS nb, CASE WHEN n.a IS NULL OR trim(n.a) = '' THEN 'skipped' WHEN o.a IS NULL OR trim(o.a) = '' OR o.a = n.a THEN 'wrote' ELSE 'preserved' END AS sa,
CASE WHEN n.b IS NULL OR trim(n.b) = '' THEN 'skipped' WHEN o.b IS NULL OR trim(o.b) = '' OR o.b = n.b OR FALSE THEN 'wrote' ELSE 'preserved' END AS sb FROM o LEFT JOIN n USING (doc_id))"""
)
def first_run_wins(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 3
    old = t.documents.select("doc_id", F.col("source").alias("a"), F.when(k == 0, "").when(k == 2, F.col("lang")).alias("b"))
    new = t.labels.select("doc_id", F.when(F.col("quality") == 1, "src1").alias("a"), F.lit("good").alias("b"))
    return merge.first_run_wins(old, new, "doc_id", ["a", "b"])


@query("SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 4 = 0 THEN '' ELSE source END), ''), 'unknown-' || lang) AS source FROM documents")
def fill_if_empty(t: Tables) -> DataFrame:
    old = F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("source"))
    return t.documents.select("doc_id", F.coalesce(F.nullif(F.trim(old), F.lit("")), F.concat(F.lit("unknown-"), F.col("lang"))).alias("source"))


@query("SELECT doc_id, CASE WHEN c IN ('high', 'medium') THEN lang ELSE source END AS field, c <> 'high' AS review FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS c FROM documents)")
def confidence_gated_write(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 3
    c = F.when(k == 0, "high").when(k == 1, "medium").otherwise("low")
    return t.documents.select("doc_id", merge.confidence_gated(F.col("source"), F.col("lang"), c).alias("field"), merge.needs_review(F.lit(False), c).alias("review"))


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN FALSE WHEN toxic = 1 THEN TRUE ELSE lower(source) <> 'src1' END AS guarded FROM documents LEFT JOIN labels USING (doc_id)")
def admin_edit_guard(t: Tables) -> DataFrame:
    d = t.documents.join(t.labels, "doc_id", "left")
    mail = F.when(F.col("toxic") == 1, F.lit(None)).otherwise(F.upper("source"))
    return d.select("doc_id", merge.edited_by_others(F.lit("x"), mail, F.col("quality").isNotNull(), "SRC1").alias("guarded"))


@query("SELECT doc_id, source, lang FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'new', 'xx' FROM labels WHERE doc_id % 2 = 1")
def insert_without_overwrite(t: Tables) -> DataFrame:
    return merge.insert_new(t.documents.filter("doc_id % 2 = 0").select("doc_id", "source", "lang"), t.labels.select("doc_id", F.lit("new").alias("source"), F.lit("xx").alias("lang")), "doc_id")


@query(
    """WITH b AS (SELECT o_custkey AS k, list_distinct(list_transform(list(o_orderpriority ORDER BY o_orderkey), lambda x: CASE x WHEN '1-URGENT' THEN '2-HIGH' ELSE x END)) AS p FROM orders GROUP BY 1)
SELECT k, array_to_string(list_sort(list_filter(p, lambda x: x <> '5-LOW')), ',') AS refs FROM b"""
)
def reference_rewriting(t: Tables) -> DataFrame:
    b = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderpriority").alias("refs"))
    moved = F.create_map(F.lit("1-URGENT"), F.lit("2-HIGH"))
    return b.select("k", F.array_join(F.array_sort(merge.redirect(F.col("refs"), moved, F.array(F.lit("5-LOW")))), ",").alias("refs"))


@query(
    """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'core' WHEN 'SMALL' THEN 'extended' ELSE lower(p_type) END AS kind, coalesce(CASE WHEN p_size > 25 THEN p_size END, 0) AS pages, TRUE AS needs_review FROM part"""
)
def schema_evolution(t: Tables) -> DataFrame:
    kind = F.when(F.col("p_type") == "ECONOMY", "core").when(F.col("p_type") == "SMALL", "extended").otherwise(F.lower("p_type"))
    return t.part.select("p_partkey", kind.alias("kind"), F.coalesce(F.when(F.col("p_size") > 25, F.col("p_size")), F.lit(0)).alias("pages"), F.lit(True).alias("needs_review"))


@query(
    """WITH v AS (SELECT p_partkey, string_split(p_name || ' 9' || p_size, ' ') AS th, p_size, p_type, p_brand FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(th, lambda x: x IN ('red', 'ring', 'bolt')))), ',') AS themes,
array_to_string(list_sort(list_distinct(list_filter(th, lambda x: x NOT IN ('red', 'ring', 'bolt') AND regexp_matches(x, '^[a-z][a-z0-9]*(-[a-z0-9]+)*$')))), ',') AS proposed,
CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN p_type END AS stance, CASE WHEN 1770 + p_size BETWEEN 1800 AND 2027 THEN 1770 + p_size END AS source_year,
array_to_string(list_filter([CASE WHEN len(list_filter(th, lambda x: x NOT IN ('red', 'ring', 'bolt') AND regexp_matches(x, '^[a-z]'))) > 0 THEN 'theme-proposed' END, 'theme-dropped', CASE WHEN p_type NOT IN ('ECONOMY', 'SMALL') THEN 'stance-unknown' END, CASE WHEN 1770 + p_size < 1800 THEN 'year-range' END], lambda x: x IS NOT NULL), ',') AS warnings FROM v"""
)
def soft_validation(t: Tables) -> DataFrame:
    rec = t.part.select(
        "p_partkey", F.col("p_partkey").cast("string").alias("id"), F.split(F.concat(F.col("p_name"), F.lit(" 9"), F.col("p_size").cast("string")), " ").alias("themes"), F.array().cast("array<string>").alias("key_concepts"),
        F.lit(None).cast("string").alias("pull_quote"), F.col("p_type").alias("stance"), (1770 + F.col("p_size")).alias("source_year"),
    )
    v = quality.validate_record(rec, ["red", "ring", "bolt"], 2026, ["ECONOMY", "SMALL"])
    return v.select("p_partkey", F.array_join("clean.themes", ",").alias("themes"), F.array_join("clean.proposed_themes", ",").alias("proposed"), "clean.stance", "clean.source_year", F.array_join("warnings", ",").alias("warnings"))


@query("SELECT doc_id, array_to_string(list_filter([CASE WHEN NOT (n_chars >= 100) THEN 'summary' END, CASE WHEN NOT (len(string_split(text, chr(10))) >= 3) THEN 'points' END, CASE WHEN NOT (lang IN ('en', 'fr')) THEN 'lang' END], lambda x: x IS NOT NULL), ',') AS errors FROM documents")
def strict_validation(t: Tables) -> DataFrame:
    e = quality.strict_errors({"summary": F.col("n_chars") >= 100, "points": F.size(F.split("text", "\n")) >= 3, "lang": F.col("lang").isin("en", "fr")})
    return t.documents.select("doc_id", F.array_join(e, ",").alias("errors"))


@query(
    """SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN p_type WHEN p_type = 'MEDIUM' THEN 'SMALL' ELSE 'OTHER' END AS value, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN NULL WHEN p_type = 'MEDIUM' THEN 'alias' ELSE 'default' END AS rule FROM part"""
)
def metadata_coercion(t: Tables) -> DataFrame:
    value, change = quality.coerce(F.col("p_type"), ["ECONOMY", "SMALL"], {"medium": "SMALL"}, "OTHER", "p_type")
    return t.part.select("p_partkey", value.alias("value"), change["rule"].alias("rule"))


@query(
    """WITH a AS (SELECT l_orderkey AS w, l_linenumber AS i, min(l_partkey) AS page, min(l_returnflag) AS title FROM lineitem GROUP BY 1, 2), b AS (SELECT l_orderkey AS w, l_linenumber AS i, max(l_partkey) AS page, max(l_returnflag) AS title FROM lineitem WHERE l_quantity > 5 GROUP BY 1, 2)
SELECT w, i, drift FROM (SELECT w, i, array_to_string(list_filter([CASE WHEN b.page IS NULL THEN 'missing' END, CASE WHEN a.title <> b.title THEN 'title' END, CASE WHEN abs(a.page - b.page) >= 5 THEN 'page' END], lambda x: x IS NOT NULL), ',') AS drift FROM a LEFT JOIN b USING (w, i)) WHERE drift <> ''"""
)
def toc_drift(t: Tables) -> DataFrame:
    side = lambda rows, f: rows.groupBy(F.col("l_orderkey").alias("w"), F.col("l_linenumber").alias("i")).agg(f("l_partkey").alias("page"), f("l_returnflag").alias("title"))
    d = quality.toc_drift(side(t.lineitem, F.min), side(t.lineitem.filter("l_quantity > 5"), F.max), ["w", "i"], "title", "page")
    return d.select("w", "i", F.array_join("drift", ",").alias("drift"))


@query(
    """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN l_partkey > 1500 THEN NULL ELSE l_partkey END AS page_start, CASE WHEN l_suppkey * 20 < l_partkey OR l_suppkey * 20 > 1500 THEN NULL ELSE l_suppkey * 20 END AS page_end FROM lineitem"""
)
def page_order(t: Tables) -> DataFrame:
    return pages_in_order(t.lineitem)


def pages_in_order(lines: DataFrame) -> DataFrame:
    li = lines.withColumn("e", F.array(F.struct(F.col("l_partkey").alias("page_start"), (F.col("l_suppkey") * 20).alias("page_end"))))
    fixed = quality.page_order(F.col("e"), F.lit(1500))
    return li.withColumn("f", F.element_at(fixed, 1)).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "f.page_start", "f.page_end")


@query(
    r("""WITH n AS (SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN replace(p_name, ' ', ': ') WHEN 1 THEN replace(p_name, ' ', ' - ') WHEN 2 THEN replace(p_name, ' ', ' on ') WHEN 3 THEN p_name || '?'
  WHEN 4 THEN 'How I ' || p_name WHEN 5 THEN p_name || repeat('x', 60) WHEN 6 THEN p_name || ' a b c d' ELSE p_name END AS name FROM part),
c AS (SELECT *, len(regexp_split_to_array(trim(name), '\\s+')) AS words, 'matches title pattern ' || chr(39) AS p, 'starts with article phrase ' || chr(39) AS s, chr(39) AS q FROM n)
SELECT p_partkey, CASE WHEN words > 5 THEN 'name is ' || words || ' words' WHEN contains(name, ' - ') THEN p || '-' || q WHEN contains(name, ' on ') THEN p || 'on' || q
  WHEN contains(name, ': ') THEN p || ':' || q WHEN contains(name, ' – ') THEN p || '–' || q WHEN contains(name, '?') THEN p || chr(92) || '?' || q WHEN contains(name, '!') THEN p || '!' || q
  WHEN lower(trim(name)) LIKE 'how i %' THEN s || 'how i ' || q WHEN lower(trim(name)) LIKE 'the new %' THEN s || 'the new ' || q
  WHEN length(name) > 60 THEN 'name is ' || length(name) || ' chars long' END AS reason FROM c""")
)
def fake_names(t: Tables) -> DataFrame:
    n, k = F.col("p_name"), F.col("p_size") % 8
    put = lambda by: F.replace(n, F.lit(" "), F.lit(by))
    name = F.when(k == 0, put(": ")).when(k == 1, put(" - ")).when(k == 2, put(" on ")).when(k == 3, F.concat(n, F.lit("?"))).when(k == 4, F.concat(F.lit("How I "), n))
    name = name.when(k == 5, F.concat(n, F.lit("x" * 60))).when(k == 6, F.concat(n, F.lit(" a b c d"))).otherwise(n)
    return t.part.select("p_partkey", quality.fake_name(name).alias("reason"))


@query("SELECT word AS value, n, CASE WHEN word IN ('red', 'blue') THEN 'accepted' WHEN NOT regexp_matches(word, '^[a-z][a-z0-9]*$') THEN 'bad-shape' ELSE 'candidate' END AS bucket FROM (SELECT unnest(string_split(p_name || ' X' || p_size, ' ')) AS word, count(*) AS n FROM part GROUP BY 1)")
def vocabulary_candidates(t: Tables) -> DataFrame:
    w = t.part.select(F.explode(F.split(F.concat(F.col("p_name"), F.lit(" X"), F.col("p_size").cast("string")), " ")).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return w.withColumn("bucket", F.when(F.col("value").isin("red", "blue"), "accepted").when(~F.col("value").rlike(quality.SLUG), "bad-shape").otherwise("candidate"))


@query(
    """WITH h AS (SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text))
SELECT item_id, count(doc_id) AS documents, count(doc_id) > 0 AS verified FROM benchmark LEFT JOIN h USING (item_id) GROUP BY 1"""
)
def quote_verification(t: Tables) -> DataFrame:
    hits = joins.passages_in(t.documents, "doc_id", "text", t.benchmark, "item_id", "text").groupBy("item_id").agg(F.count("doc_id").alias("n"))
    return t.benchmark.join(hits, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("documents"), (F.coalesce("n", F.lit(0)) > 0).alias("verified"))


@query(r("""SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<a\\s+href="(/[^"#?]*)', 1))) AS link FROM pages"""))
def page_links(t: Tables) -> DataFrame:
    return page_source.links(t.pages, "page_id", "html")


@query(
    r("""SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS heading, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host FROM pages""")
)
def page_details(t: Tables) -> DataFrame:
    return page_source.details(t.pages, "page_id", "url", "html").select("page_id", "title", "heading", "host")


@query()
def page_markdown(t: Tables) -> DataFrame:
    return t.pages.select("page_id", tx.html_to_markdown(F.col("html")).alias("markdown"))


@query()
def fuzzy_titles(t: Tables) -> DataFrame:
    a = t.part.select(F.col("p_partkey").alias("id"), names.n2_kebab(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"), F.concat_ws(" ", "p_name", "p_type").alias("title"), F.col("p_size").alias("year"), F.element_at(F.split("p_name", " "), -1).alias("surname"))
    b = t.part.select(F.col("p_partkey").alias("rid"), names.n2_kebab(F.concat_ws(" ", "p_name", "p_brand")).alias("rslug"), F.concat_ws(" ", "p_type", "p_name").alias("rtitle"), F.col("p_size").alias("ryear"), F.col("p_name").alias("byline"), F.when(F.col("p_partkey") % 2 == 0, "u").alias("url"))
    return joins.fuzzy_tiers(a, b)


@query("SELECT coalesce(event_type, '?') AS event_type, coalesce(props_key, '?') AS k, count(*) AS n FROM (SELECT event_type, json_keys(props)[1] AS props_key FROM events) GROUP BY 1, 2")
def json_keys(t: Tables) -> DataFrame:
    key = F.try_element_at(F.json_object_keys("props"), F.lit(1))
    return t.events.groupBy("event_type", F.coalesce(key, F.lit("?")).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, array_to_string(list_sort(list(doc_id) )[1:3], ',') AS samples, count(*) AS n FROM documents GROUP BY 1")
def taxonomy_samples(t: Tables) -> DataFrame:
    first = occurrences.first_of(t.documents.select("source", "doc_id"), ["source"], ["doc_id"], 3).groupBy(F.col("source").alias("__s")).agg(F.sort_array(F.collect_list("doc_id")).cast("array<string>").alias("s"))
    sizes = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(first, F.col("source").eqNullSafe(F.col("__s"))).select("source", F.array_join("s", ",").alias("samples"), "n")


@query(
    """WITH e AS (SELECT window_start, event_type, count(*) AS n FROM (SELECT date_trunc('day', ts) AS window_start, event_type FROM events) GROUP BY 1, 2) SELECT strftime(window_start, '%Y-%m-%d') AS day, event_type, n FROM e"""
)
def extension_daily_windows(t: Tables) -> DataFrame:
    """An extension: the reference has no event-time windows."""
    w = F.window("ts", "1 day")
    return t.events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, coalesce(floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))), 0)::BIGINT AS gap FROM events")
def extension_gaps(t: Tables) -> DataFrame:
    """An extension: lag over a user's events."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("user_id", "event_id", F.row_number().over(w).alias("place"), F.coalesce(F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lag("ts").over(w).cast("timestamp")), F.lit(0)).alias("gap"))
