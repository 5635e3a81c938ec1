"""Joins, counts, ranks and set operations over the catalogue tables (people, works, organisations and their references)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.functions import names, values
from folio.operators import joins, merge
from folio.operators.order import rank_over
from folio.plans.base import Tables, query

#: Rows that one task takes, about, where the number of tasks follows the table.
ROWS_PER_TASK = 500_000


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def inner_lookup(t: Tables) -> DataFrame:
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS orders, count(*) AS n FROM orders GROUP BY 1")
def bucket_one_to_many(t: Tables) -> DataFrame:
    keys = F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: k.cast("string"))
    return t.orders.groupBy("o_custkey").agg(F.array_join(keys, ",").alias("orders"), F.count(F.lit(1)).alias("n"))


@query("SELECT s_suppkey, coalesce(n_name, 'Unknown') AS nation FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON s_nationkey = n_nationkey")
def left_with_default(t: Tables) -> DataFrame:
    return t.supplier.join(t.nation.filter("n_nationkey < 20"), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.lit("Unknown")).alias("nation"))


ALIASES_SQL = """
names AS (SELECT s_suppkey AS id, 0 AS ord, lower(replace(s_name, '#', ' ')) AS k FROM supplier
  UNION ALL SELECT s_suppkey, 1, 'dr ' || lower(replace(s_name, '#', ' ')) FROM supplier WHERE s_suppkey % 3 = 0
  UNION ALL SELECT s_suppkey, 2, 'nation ' || s_nationkey FROM supplier),
alias AS (SELECT k, arg_min(id, (ord, id)) AS id FROM names GROUP BY k)"""


def aliases(t: Tables) -> DataFrame:
    base = names.n4_alias_key(F.replace("s_name", F.lit("#"), F.lit(" ")))
    s = t.supplier
    rows = (
        s.select(F.col("s_suppkey").alias("id"), F.lit(0).alias("ord"), base.alias("k"))
        .unionByName(s.filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("id"), F.lit(1).alias("ord"), F.concat(F.lit("dr "), base).alias("k")))
        .unionByName(s.select(F.col("s_suppkey").alias("id"), F.lit(2).alias("ord"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("k")))
    )
    return joins.first_writer_wins(rows, "k", "id", ["ord", "id"])


@query(f"WITH {ALIASES_SQL} SELECT k, id FROM alias")
def alias_table(t: Tables) -> DataFrame:
    return aliases(t)


@query(
    f"""WITH {ALIASES_SQL},
q AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Prof. Supplier ' || lpad((c_custkey % 150)::VARCHAR, 9, '0') WHEN 1 THEN 'Nation, ' || c_nationkey ELSE c_name END AS byline FROM customer),
p AS (SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(byline), '[.,-]', ' ', 'g'), '\\s+', ' ', 'g')) AS p0, trim(regexp_replace(regexp_replace(regexp_replace(lower(byline), '[.,-]', ' ', 'g'), '^(prof|dr) ', '', 'g'), '\\s+', ' ', 'g')) AS p1 FROM q)
SELECT c_custkey, coalesce(a.id, b.id) AS resolved FROM p LEFT JOIN alias a ON p0 = a.k LEFT JOIN alias b ON p1 = b.k""".replace("\\\\", "\\")
)
def alias_lookup(t: Tables) -> DataFrame:
    n = F.col("c_custkey") % 3
    byline = F.when(n == 0, F.concat(F.lit("Prof. Supplier "), F.lpad((F.col("c_custkey") % 150).cast("string"), 9, "0"))).when(n == 1, F.concat(F.lit("Nation, "), F.col("c_nationkey").cast("string"))).otherwise(F.col("c_name"))
    q = t.customer.select("c_custkey", byline.alias("byline"))
    direct = names.n4_alias_key(F.col("byline"))
    bare = names.squeeze(F.regexp_replace(F.regexp_replace(F.lower("byline"), "[.,-]", " "), "^(prof|dr) ", ""))
    return joins.probe_in_turn(q, aliases(t), [direct, bare], "k", "id", "resolved").select("c_custkey", "resolved")


@query(
    f"""WITH {ALIASES_SQL},
q AS (SELECT l_orderkey, string_agg('nation ' || s_nationkey || CASE WHEN l_linenumber % 2 = 0 THEN ',' ELSE ' and' END, ' ' ORDER BY l_linenumber, l_suppkey, l_partkey) AS byline FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
x AS (SELECT l_orderkey, u.name, u.pos FROM q, (SELECT unnest(regexp_split_to_array(byline, '\\s*(?:,|;|&|\\band\\b)\\s*')) AS name, generate_subscripts(regexp_split_to_array(byline, '\\s*(?:,|;|&|\\band\\b)\\s*'), 1) AS pos) u),
m AS (SELECT l_orderkey, alias.id, min(pos) AS pos FROM x JOIN alias ON trim(name) = k GROUP BY 1, 2)
SELECT l_orderkey, string_agg(id::VARCHAR, ',' ORDER BY pos) AS resolved FROM m GROUP BY 1""".replace("\\\\", "\\")
)
def split_bylines(t: Tables) -> DataFrame:
    return resolved_bylines(t, t.lineitem)


def resolved_bylines(t: Tables, lines: DataFrame) -> DataFrame:
    li = lines.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    part = F.concat(F.lit("nation "), F.col("s_nationkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, ",").otherwise(" and"))
    said = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", part.alias("s"))))
    q = li.groupBy("l_orderkey").agg(F.array_join(F.transform(said, lambda x: x["s"]), " ").alias("byline"))
    found = joins.split_and_resolve(q, ["l_orderkey"], "byline", aliases(t), "k", "id", names.n4_alias_key)
    return found.select("l_orderkey", F.array_join(F.transform("resolved", lambda x: x.cast("string")), ",").alias("resolved"))


@query(
    """WITH c AS (SELECT p_partkey, unnest([{'ord': 0, 'cand': string_split(p_name, ' ')[2], 'via': 'tail'}, {'ord': 1, 'cand': string_split(p_name, ' ')[1], 'via': 'prefix'}, {'ord': 2, 'cand': lower(p_type), 'via': 'body'}]) AS c FROM part),
k AS (SELECT 'ring' AS w, 1 AS id UNION ALL SELECT 'red', 2 UNION ALL SELECT 'economy', 3 UNION ALL SELECT 'small', 4)
SELECT p_partkey, arg_min(id, c.ord) AS id, arg_min(c.via, c.ord) AS via FROM c JOIN k ON c.cand = w GROUP BY 1"""
)
def candidate_cascade(t: Tables) -> DataFrame:
    known = t.spark.createDataFrame([("ring", 1), ("red", 2), ("economy", 3), ("small", 4)], "w string, id int")
    words = F.split("p_name", " ")
    c = F.array(*[F.struct(F.lit(i).alias("ord"), x.alias("cand"), F.lit(v).alias("via")) for i, (x, v) in enumerate(((F.try_element_at(words, F.lit(2)), "tail"), (F.try_element_at(words, F.lit(1)), "prefix"), (F.lower("p_type"), "body")))])
    return joins.cascade(t.part, ["p_partkey"], c, known, "w", "id")


@query(
    """WITH b AS (SELECT p_partkey, string_split(lower(p_name || ' ' || p_type), ' ') AS tk FROM part),
w AS (SELECT p_partkey, array_to_string(tk[i:i+k-1], '-') AS key, k * 10 + i AS pos FROM b, range(2, 4) t1(k), range(1, 4) t2(i) WHERE i + k - 1 <= len(tk)),
l AS (SELECT DISTINCT replace(lower(p_name), ' ', '-') AS key, length(p_name) AS v FROM part),
h AS (SELECT p_partkey, v, min(pos) AS pos FROM w JOIN l USING (key) GROUP BY 1, 2)
SELECT p_partkey, coalesce(string_agg(v::VARCHAR, ',' ORDER BY pos) FILTER (v IS NOT NULL), '') AS matches, CASE count(v) WHEN 0 THEN 'deferred' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS route
FROM part LEFT JOIN h USING (p_partkey) GROUP BY 1"""
)
def ngram_resolution(t: Tables) -> DataFrame:
    lookup = t.part.select(F.replace(F.lower("p_name"), F.lit(" "), F.lit("-")).alias("key"), F.char_length("p_name").alias("v")).distinct()
    tokens = F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")
    m = joins.ngram_join(t.part, ["p_partkey"], tokens, lookup, "key", "v")
    return m.select("p_partkey", F.array_join(F.transform("matches", lambda x: x.cast("string")), ",").alias("matches"), "route")


@query(
    """WITH l AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_quantity > 45)
SELECT l_suppkey, l_partkey, count(*) OVER (PARTITION BY l_partkey) > 1 AS collision FROM l"""
)
def reverse_collisions(t: Tables) -> DataFrame:
    return joins.claimed_twice(t.lineitem.filter("l_quantity > 45").select("l_suppkey", "l_partkey").distinct(), "l_partkey")


@query(
    """WITH b AS (SELECT item_id, regexp_replace(trim(regexp_replace(regexp_replace(text, '[*_`>~]', '', 'g'), '\\s+', ' ', 'g')), '[.,;:]+$', '') AS q FROM benchmark),
d AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[*_`>~]', '', 'g'), '\\s+', ' ', 'g')) AS body FROM documents)
SELECT doc_id, item_id FROM d JOIN b ON contains(body, q)""".replace("\\\\", "\\")
)
def quotes_in_documents(t: Tables) -> DataFrame:
    """Which benchmark passages stand in which documents, typography and closing marks aside."""
    quotes = t.benchmark.select("item_id", names.n11_quote_key(F.col("text")).alias("q")).filter("q <> ''")
    docs = t.documents.select("doc_id", names.n10_quote_text(F.col("text")).alias("body"))
    return joins.passages_in(docs, "doc_id", "body", quotes, "item_id", "q")


@query(
    r"""WITH b AS (SELECT item_id, array_to_string(string_split(text, ' ')[2:4], ' ') AS q FROM benchmark UNION ALL SELECT -1, 'ati' UNION ALL SELECT -2, 'e t')
SELECT doc_id, item_id FROM documents JOIN b ON q <> '' AND contains(text, q)"""
)
def short_quotes(t: Tables) -> DataFrame:
    """Three words of each passage, and two bits of text that begin inside words."""
    quotes = t.benchmark.select("item_id", F.array_join(F.slice(F.split("text", " "), 2, 3), " ").alias("q")).unionByName(t.spark.createDataFrame([(-1, "ati"), (-2, "e t")], "item_id long, q string"))
    return joins.passages_in(t.documents.select("doc_id", "text"), "doc_id", "text", quotes, "item_id", "q")


@query(
    """WITH a AS (SELECT DISTINCT p_partkey AS l, w FROM (SELECT p_partkey, unnest(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z0-9]+')) AS w FROM part) WHERE length(w) >= 4),
b AS (SELECT DISTINCT p_brand AS r, w FROM (SELECT p_brand, unnest(regexp_split_to_array(lower(p_name), '[^a-z0-9]+')) AS w FROM part) WHERE length(w) >= 4),
s AS (SELECT l, r, sum(length(w)) AS overlap FROM a JOIN b USING (w) GROUP BY 1, 2 HAVING sum(length(w)) >= 5)
SELECT l, r, overlap FROM s QUALIFY row_number() OVER (PARTITION BY l ORDER BY overlap DESC, r) = 1"""
)
def token_overlap_match(t: Tables) -> DataFrame:
    # parts share few texts, and a brand's names few words
    a = t.part.select(F.col("p_partkey").alias("l"), F.concat_ws(" ", "p_name", "p_type").alias("a"))
    b = t.part.groupBy(F.col("p_brand").alias("r")).agg(F.array_join(F.array_sort(F.collect_set("p_name")), " ").alias("b"))
    found = joins.token_overlap(a.select(F.col("a").alias("x"), "a").distinct(), b, "x", "r", "a", "b")
    return a.join(found, F.col("a") == F.col("x")).select("l", "r", "overlap")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_join(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.filter("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_resume(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id")


@query("SELECT p_partkey, coalesce(n, 0) = 0 AS draft FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity = 50 GROUP BY 1) ON p_partkey = l_partkey")
def orphans_become_drafts(t: Tables) -> DataFrame:
    n = t.lineitem.filter("l_quantity = 50").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return t.part.join(n, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", (F.coalesce("n", F.lit(0)) == 0).alias("draft"))


@query("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def unused_authority(t: Tables) -> DataFrame:
    return t.nation.join(t.supplier.filter("s_acctbal > 5000"), F.col("n_nationkey") == F.col("s_nationkey"), "left_anti").select("n_nationkey")


@query(
    """WITH a AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS s FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS s FROM lineitem WHERE l_linestatus = 'F')
SELECT k, s, 'ref-only' AS found FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT k, s, 'prose-only' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"""
)
def both_way_discrepancies(t: Tables) -> DataFrame:
    rows = lambda c: t.lineitem.filter(c).select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("s"))
    return joins.discrepancies(rows("l_returnflag = 'A'"), rows("l_linestatus = 'F'"), ["k", "s"])


ROLE_SQL = """edges AS (SELECT l_suppkey AS person, l_orderkey AS work, min(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) AS r FROM lineitem GROUP BY 1, 2)"""


def role_edges(t: Tables) -> DataFrame:
    """person, work, r: author before subject before mention, one role for each person in a work."""
    rank = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return t.lineitem.select(F.col("l_suppkey").alias("person"), F.col("l_orderkey").alias("work"), rank.alias("r")).groupBy("person", "work").agg(F.min("r").alias("r"))


@query(f"WITH {ROLE_SQL} SELECT person, count(*) FILTER (r = 0) AS author, count(*) FILTER (r = 1) AS subject, count(*) FILTER (r = 2) AS mention FROM edges GROUP BY 1")
def reverse_references(t: Tables) -> DataFrame:
    return role_edges(t).groupBy("person").agg(*[F.count_if(F.col("r") == i).alias(n) for i, n in enumerate(("author", "subject", "mention"))])


@query(f"WITH {ROLE_SQL} SELECT person, work, CASE r WHEN 0 THEN 'author' WHEN 1 THEN 'subject' ELSE 'mention' END AS role FROM edges")
def role_priority(t: Tables) -> DataFrame:
    return role_edges(t).select("person", "work", F.element_at(F.array(F.lit("author"), F.lit("subject"), F.lit("mention")), F.col("r") + 1).alias("role"))


@query(f"WITH {ROLE_SQL} SELECT person, string_agg(role || ' ' || n, ', ' ORDER BY n DESC, role) AS roles FROM (SELECT person, 'r' || r AS role, count(*) AS n FROM edges GROUP BY 1, 2) GROUP BY 1")
def role_distribution(t: Tables) -> DataFrame:
    n = role_edges(t).groupBy("person", F.concat(F.lit("r"), F.col("r").cast("string")).alias("role")).agg(F.count(F.lit(1)).alias("n"))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "role", "n")))
    return n.groupBy("person").agg(F.array_join(F.transform(parts, lambda x: F.concat_ws(" ", x["role"], x["n"].cast("string"))), ", ").alias("roles"))


@query(
    """WITH w AS (SELECT DISTINCT l_suppkey AS person, l_orderkey AS work, year(o_orderdate) AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT person, work, y, row_number() OVER (PARTITION BY person ORDER BY y DESC NULLS LAST, work) AS rank FROM w QUALIFY rank <= 20"""
)
def works_authored(t: Tables) -> DataFrame:
    # as many tasks as the rows need, so that one holds no more of a longer table
    n = max(1, -(-t.lineitem.count() // ROWS_PER_TASK))
    edges = t.lineitem.select(F.col("l_suppkey").alias("person"), F.col("l_orderkey").alias("work")).repartition(n, "work").distinct()
    years = t.orders.select(F.col("o_orderkey").alias("work"), F.year("o_orderdate").alias("y")).repartition(n, "work")
    w = edges.join(years, "work").select("person", "work", "y").distinct().repartition(n, "person")
    return w.withColumn("rank", F.row_number().over(Window.partitionBy("person").orderBy(F.col("y").desc_nulls_last(), "work"))).filter("rank <= 20")


@query(f"WITH {ROLE_SQL} SELECT person, work, r FROM edges QUALIFY row_number() OVER (PARTITION BY person ORDER BY r, work) <= 10")
def mention_contexts(t: Tables) -> DataFrame:
    w = Window.partitionBy("person").orderBy("r", "work")
    return role_edges(t).withColumn("n", F.row_number().over(w)).filter("n <= 10").select("person", "work", "r")


@query(
    """WITH e AS (SELECT o_custkey, o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT o_custkey, o_orderkey, n FROM e QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderkey) <= 3"""
)
def top_by_evidence(t: Tables) -> DataFrame:
    e = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "o_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return e.withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("n").desc(), "o_orderkey"))).filter("k <= 3").drop("k")


@query(
    """SELECT p_name, arg_min(p_partkey, (-p_size, -length(p_type), p_partkey)) AS survivor, count(*) AS members FROM part GROUP BY 1"""
)
def duplicate_survivors(t: Tables) -> DataFrame:
    order = [F.col("p_size").desc(), F.char_length("p_type").desc(), F.col("p_partkey")]
    best = merge.by_rank(t.part, ["p_name"], order).select("p_name", F.col("p_partkey").alias("survivor"))
    return best.join(t.part.groupBy("p_name").agg(F.count(F.lit(1)).alias("members")), "p_name")


@query("SELECT s_suppkey, (row_number() OVER (ORDER BY s_suppkey) - 1) % 10 AS batch FROM supplier")
def round_robin_batches(t: Tables) -> DataFrame:
    ranked = rank_over(t.supplier, F.col("s_suppkey"), [F.col("s_suppkey").asc_nulls_last()], "place")
    return ranked.select("s_suppkey", ((F.col("place") - 1) % 10).cast("long").alias("batch"))


@query("SELECT s_suppkey, (row_number() OVER (ORDER BY s_suppkey) - 1) // CAST(ceil((SELECT count(*) FROM supplier) / 10.0) AS BIGINT) AS batch FROM supplier")
def contiguous_batches(t: Tables) -> DataFrame:
    size = max(1, -(-t.supplier.count() // 10))
    ranked = rank_over(t.supplier, F.col("s_suppkey"), [F.col("s_suppkey").asc_nulls_last()], "place")
    return ranked.select("s_suppkey", F.floor((F.col("place") - 1) / size).alias("batch"))


@query("SELECT p_partkey, CASE WHEN n > 1 THEN slug || '-' || n ELSE slug END AS slug FROM (SELECT p_partkey, replace(p_name, ' ', '-') AS slug, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)")
def slug_suffixes(t: Tables) -> DataFrame:
    return merge.suffix_duplicates(t.part.select("p_partkey", names.n2_kebab(F.col("p_name")).alias("slug")), [], "slug", ["p_partkey"])


@query("SELECT event_type, arg_max(value, ts) AS value, max(ts) AS ts FROM (SELECT event_type, ts, max(value) AS value FROM events GROUP BY 1, 2) GROUP BY 1")
def last_write_wins(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.max_by("value", F.struct("ts", "value")).alias("value"), F.max("ts").alias("ts"))


@query(
    """WITH a AS (SELECT doc_id, 'high' AS c FROM documents WHERE doc_id % 3 = 0), b AS (SELECT doc_id, 'label' AS c FROM labels WHERE quality = 1), d AS (SELECT doc_id, 'default' AS c FROM documents)
SELECT doc_id, c, precedence FROM (SELECT *, 0 AS precedence FROM a UNION ALL SELECT *, 1 FROM b UNION ALL SELECT *, 2 FROM d) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY precedence) = 1"""
)
def precedence_union(t: Tables) -> DataFrame:
    parts = [t.documents.filter("doc_id % 3 = 0").select("doc_id", F.lit("high").alias("c")), t.labels.filter("quality = 1").select("doc_id", F.lit("label").alias("c")), t.documents.select("doc_id", F.lit("default").alias("c"))]
    return merge.precedence_union(parts, "doc_id")


@query("SELECT name FROM (SELECT lower(s_name) AS name FROM supplier INTERSECT SELECT lower(c_name) FROM customer)")
def slugs_disjoint(t: Tables) -> DataFrame:
    return t.supplier.select(F.lower("s_name").alias("name")).intersect(t.customer.select(F.lower("c_name")))


SETS_SQL = """s AS (SELECT l_orderkey AS k, list_sort(list_distinct(list(l_suppkey) FILTER (l_returnflag = 'A'))) AS a, list_sort(list_distinct(list(l_suppkey) FILTER (l_returnflag <> 'A'))) AS b FROM lineitem GROUP BY 1),
z AS (SELECT k, coalesce(a, []) AS a, coalesce(b, []) AS b FROM s)"""


def two_sets(t: Tables) -> DataFrame:
    of = lambda c, n: F.array_sort(F.collect_set(F.when(c, F.col("l_suppkey")))).alias(n)
    return t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(of(F.col("l_returnflag") == "A", "a"), of(F.col("l_returnflag") != "A", "b"))


def text_of(c) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query(
    f"""WITH {SETS_SQL} SELECT k, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS minus, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS both,
array_to_string(list_sort(list_filter(list_distinct(list_concat(a, b)), lambda x: NOT (list_contains(a, x) AND list_contains(b, x)))), ',') AS only_one,
CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END AS jaccard FROM z"""
)
def array_sets(t: Tables) -> DataFrame:
    minus, other, both = F.array_except("a", "b"), F.array_except("b", "a"), F.array_union("a", "b")
    return two_sets(t).select("k", text_of(F.array_sort(minus)).alias("minus"), text_of(F.array_sort(both)).alias("both"), text_of(F.array_sort(F.array_union(minus, other))).alias("only_one"), values.jaccard(F.col("a"), F.col("b")).alias("jaccard"))


@query(
    """WITH e AS (SELECT l_suppkey AS f, l_partkey % 20 AS t, list_sort(list_distinct(list(l_orderkey))) AS evidence, arg_min(l_returnflag, (l_orderkey, l_linenumber, l_returnflag)) AS context FROM lineitem GROUP BY 1, 2)
SELECT f, t, array_to_string(evidence, ',') AS evidence, context FROM e"""
)
def edges_merged(t: Tables) -> DataFrame:
    e = t.lineitem.select(F.col("l_suppkey").alias("f"), (F.col("l_partkey") % 20).alias("t"), F.array("l_orderkey").alias("evidence"), F.col("l_returnflag").alias("context"), F.struct("l_orderkey", "l_linenumber", "l_returnflag").alias("ord"))
    return merge.union_edges(e, ["f", "t"], "evidence", ["context"], "ord").select("f", "t", text_of(F.col("evidence")).alias("evidence"), "context")


@query("SELECT r_name, count(DISTINCT s_suppkey) AS people, count(*) AS entries, (100 * count(*) // greatest(count(DISTINCT s_suppkey), 1)) AS per_hundred FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def histogram_by_joined_attribute(t: Tables) -> DataFrame:
    # lines are counted per supplier before anything is joined to them
    n = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    j = n.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    g = j.groupBy("r_name").agg(F.count(F.lit(1)).alias("people"), F.sum("n").alias("entries"))
    return g.withColumn("per_hundred", F.floor(100 * F.col("entries") / F.greatest("people", F.lit(1))))


@query(
    """SELECT s_suppkey AS id, 'supplier' AS kind FROM supplier WHERE s_nationkey = 3 UNION SELECT c_custkey, 'customer' FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'MACHINERY'"""
)
def organisation_catalogue(t: Tables) -> DataFrame:
    a = t.supplier.filter("s_nationkey = 3").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind"))
    return a.unionByName(t.customer.filter("c_nationkey = 3 AND c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"))).distinct()


@query(
    """SELECT l_orderkey, l_linenumber, coalesce(s_name, c_name) AS name, coalesce(s_name, c_name) IS NULL AS unresolved FROM lineitem
LEFT JOIN supplier ON l_returnflag <> 'R' AND s_suppkey = l_suppkey LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) c ON l_returnflag = 'R' AND c_custkey = l_suppkey"""
)
def polymorphic_references(t: Tables) -> DataFrame:
    return named_by_kind(t, t.lineitem)


def named_by_kind(t: Tables, li: DataFrame) -> DataFrame:
    j = li.join(t.supplier, (F.col("l_returnflag") != "R") & (F.col("s_suppkey") == F.col("l_suppkey")), "left")
    j = j.join(t.customer.filter("c_custkey % 2 = 0"), (F.col("l_returnflag") == "R") & (F.col("c_custkey") == F.col("l_suppkey")), "left")
    name = F.coalesce("s_name", "c_name")
    return j.select("l_orderkey", "l_linenumber", name.alias("name"), name.isNull().alias("unresolved"))


@query(
    """WITH a AS (SELECT l_orderkey AS w, l_linenumber AS i, min(l_partkey) AS p FROM lineitem WHERE l_quantity < 40 GROUP BY 1, 2), b AS (SELECT l_orderkey AS w, l_linenumber AS i, min(l_partkey) + 1 AS p FROM lineitem WHERE l_quantity > 10 GROUP BY 1, 2)
SELECT coalesce(a.w, b.w) AS w, coalesce(a.i, b.i) AS i, CASE WHEN a.w IS NULL THEN 'only-b' WHEN b.w IS NULL THEN 'only-a' WHEN a.p <> b.p THEN 'page' ELSE 'same' END AS state FROM a FULL JOIN b ON a.w = b.w AND a.i = b.i"""
)
def self_consistency(t: Tables) -> DataFrame:
    side = lambda c, p, n: t.lineitem.filter(c).groupBy(F.col("l_orderkey").alias("w"), F.col("l_linenumber").alias("i")).agg(p.alias(n))
    j = side("l_quantity < 40", F.min("l_partkey"), "pa").join(side("l_quantity > 10", F.min("l_partkey") + 1, "pb"), ["w", "i"], "full")
    return j.select("w", "i", F.when(F.col("pa").isNull(), "only-b").when(F.col("pb").isNull(), "only-a").when(F.col("pa") != F.col("pb"), "page").otherwise("same").alias("state"))


@query("SELECT o_orderkey, name AS period FROM orders JOIN (VALUES (0, 1994, 'early'), (1995, 1997, 'middle'), (1998, 9999, 'late')) p(lo, hi, name) ON year(o_orderdate) BETWEEN lo AND hi")
def range_join_periods(t: Tables) -> DataFrame:
    periods = t.spark.createDataFrame([(0, 1994, "early"), (1995, 1997, "middle"), (1998, 9999, "late")], "lo int, hi int, name string")
    return t.orders.join(periods, F.year("o_orderdate").between(F.col("lo"), F.col("hi"))).select("o_orderkey", F.col("name").alias("period"))


@query("SELECT c_custkey, c_name, n_name, count(o_orderkey) AS works, max(o_orderdate) AS latest FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3")
def contributor_works(t: Tables) -> DataFrame:
    works = t.orders.groupBy("o_custkey").agg(F.count("o_orderkey").alias("works"), F.max("o_orderdate").alias("latest"))
    j = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(works, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.select("c_custkey", "c_name", "n_name", F.coalesce("works", F.lit(0)).alias("works"), "latest")


@query(
    """WITH a AS (SELECT l_orderkey AS w, l_linenumber AS i, min(l_partkey) AS essay FROM lineitem GROUP BY 1, 2), b AS (SELECT l_orderkey AS w, l_linenumber AS i, max(l_suppkey) AS toc FROM lineitem WHERE l_quantity > 25 GROUP BY 1, 2)
SELECT w, i, essay, toc, coalesce('t' || toc, 'Essay ' || i) AS title FROM a LEFT JOIN b USING (w, i)"""
)
def essays_with_toc(t: Tables) -> DataFrame:
    a = t.lineitem.groupBy(F.col("l_orderkey").alias("w"), F.col("l_linenumber").alias("i")).agg(F.min("l_partkey").alias("essay"))
    b = t.lineitem.filter("l_quantity > 25").groupBy(F.col("l_orderkey").alias("w"), F.col("l_linenumber").alias("i")).agg(F.max("l_suppkey").alias("toc"))
    title = F.coalesce(F.concat(F.lit("t"), F.col("toc").cast("string")), F.concat(F.lit("Essay "), F.col("i").cast("string")))
    return a.join(b, ["w", "i"], "left").select("w", "i", "essay", "toc", title.alias("title"))


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY CASE WHEN s_acctbal > 9000 THEN 0 WHEN s_acctbal > 5000 THEN 1 ELSE 2 END, s_suppkey LIMIT 60")
def authority_subset(t: Tables) -> DataFrame:
    rank = F.when(F.col("s_acctbal") > 9000, 0).when(F.col("s_acctbal") > 5000, 1).otherwise(2)
    return t.supplier.orderBy(rank, "s_suppkey").limit(60).select("s_suppkey", "s_name")


@query(
    """WITH e AS (SELECT l_orderkey AS w, min(l_linenumber) AS lo, max(l_linenumber) AS hi, count(DISTINCT l_linenumber) AS pages FROM lineitem GROUP BY 1) SELECT w, hi - lo + 1 AS extent, pages FROM e"""
)
def page_extent(t: Tables) -> DataFrame:
    e = t.lineitem.groupBy(F.col("l_orderkey").alias("w")).agg(F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"), F.countDistinct("l_linenumber").alias("pages"))
    return e.select("w", (F.col("hi") - F.col("lo") + 1).alias("extent"), "pages")
