"""The editor's desk as queries: author notes, links and headers, themes, known names, previews, access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.operators import authority, bylines, headers
from folio.plans.base import Tables, query

BIO = "Writes on trade, farms and the law for several papers, and taught economics at two colleges before that.\nLives in Pune.\n"
#: What stands after each fifth of the texts; {n} is the document's number modulo 40.
TAILS = [
    "\n\n![](https://x.org/p.jpg)\n\n**Author {n} **\n\n" + BIO,
    "\n[](https://x.org/attachment/bio/)\n\n**Ravi K. Das**\n\n" + BIO,
    "\n**References**\n\n" + BIO,
    "",
    "\n**Ravi K. Das**\n\nToo short.\n",
]
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
PUBLIC = [p.replace("*+", "*") for p in (bylines.PHOTO, bylines.NAMED, bylines.PHOTO_OPENER, bylines.NAMED_OPENER, bylines.STRAY_LINK)]
PHOTO, NAMED, PHOTO_OPENER, NAMED_OPENER, STRAY_LINK = PUBLIC
BODIES = "SELECT doc_id, coalesce(text, '') || CASE doc_id % 5 " + " ".join(f"WHEN {k} THEN replace('{s}', '{{n}}', (doc_id % 40)::VARCHAR)" for k, s in enumerate(TAILS)) + " END AS body FROM documents"


def bodies(t: Tables) -> DataFrame:
    n = F.col("doc_id")
    tail = F.lit(None).cast("string")
    for k, s in enumerate(TAILS):
        tail = F.when(n % 5 == k, F.replace(F.lit(s), F.lit("{n}"), (n % 40).cast("string"))).otherwise(tail)
    return t.documents.select("doc_id", F.concat(F.coalesce("text", F.lit("")), tail).alias("body"))


HEADINGS = ["Introduction", "References", "Conclusion", "Background", "Way forward", "Summing Up"]
NOT_NAMES = ", ".join(f"'{n}'" for n in HEADINGS)


def notes(names: str, bios: str, photos: str) -> str:
    made = f"list_transform(range(1, len({names}) + 1), lambda i: {{'name': trim({names}[i], {BLANKS}), 'bio': trim({bios}[i], {BLANKS}), 'photo': {photos}}})"
    return f"list_filter({made}, lambda x: x.name NOT IN ({NOT_NAMES}) AND length(x.bio) >= 80)[-1]"


@query(
    f"""WITH b AS ({BODIES}), m AS (SELECT doc_id, regexp_extract_all(body, '{PHOTO}', 1) AS pp, regexp_extract_all(body, '{PHOTO}', 2) AS pn, regexp_extract_all(body, '{PHOTO}', 3) AS pb,
regexp_extract_all(body, '{NAMED}', 1) AS nn, regexp_extract_all(body, '{NAMED}', 2) AS nb FROM b), s AS (SELECT doc_id, coalesce({notes('pn', 'pb', 'pp[i]')}, {notes('nn', 'nb', 'NULL::VARCHAR')}) AS x FROM m)
SELECT doc_id, x.name AS name, x.bio AS bio, x.photo AS photo_url FROM s"""
)
def bio_blocks(t: Tables) -> DataFrame:
    return bodies(t).select("doc_id", bylines.bio_block(F.col("body"), HEADINGS).alias("x")).select("doc_id", "x.name", "x.bio", "x.photo_url")


def last_opener(pattern: str) -> str:
    made = f"list_transform(range(1, len(regexp_extract_all(body, '{pattern}')) + 1), lambda i: {{'m': regexp_extract_all(body, '{pattern}')[i], 'n': trim(regexp_extract_all(body, '{pattern}', 1)[i], {BLANKS})}})"
    return f"list_filter({made}, lambda x: x.n NOT IN ({NOT_NAMES}))[-1].m"


@query(
    f"""WITH b AS (SELECT doc_id, regexp_replace(body, '{STRAY_LINK}', chr(10), 'g') AS body FROM ({BODIES})), m AS (SELECT *, coalesce({last_opener(PHOTO_OPENER)}, {last_opener(NAMED_OPENER)}) AS m FROM b)
SELECT doc_id, CASE WHEN m IS NULL THEN body ELSE rtrim(left(body, length(body) - length(string_split(body, m)[-1]) - length(m)), {BLANKS}) || chr(10) END AS body FROM m"""
)
def bios_stripped(t: Tables) -> DataFrame:
    return bodies(t).select("doc_id", bylines.without_bio(F.col("body"), HEADINGS).alias("body"))


def slug_sql(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '-')"


@query(
    f"""WITH c AS (SELECT 'author-' || n_nationkey AS s FROM nation UNION ALL SELECT 'ravi-k-das'),
m AS (SELECT doc_id, {slug_sql(f"regexp_extract_all(body, '{PHOTO_OPENER}', 1)[1]")} AS p, {slug_sql(f"regexp_extract_all(body, '{NAMED_OPENER}', 1)[-1]")} AS n FROM ({BODIES}))
SELECT doc_id, CASE WHEN p IN (SELECT s FROM c) THEN p WHEN n IN (SELECT s FROM c) THEN n END AS author FROM m"""
)
def contributors_wired(t: Tables) -> DataFrame:
    have = t.nation.select(F.concat(F.lit("author-"), F.col("n_nationkey").cast("string")).alias("slug")).unionByName(t.spark.range(1).select(F.lit("ravi-k-das").alias("slug")))
    return bylines.wire_contributors(bodies(t), "doc_id", "body", have, "slug")


#: Texts of the fifths of the parts, by size.
FILES = [
    "plain text",
    "---\nid: p\n---\nBody",
    "---\nid: p\npdf_url: old\nlang: en\n---\nBody",
    "---\nid: p\nprovenance:\n  by: x\n  at: y\nlang: en\n---\nBody",
    "---\nid: p\nprovenance:\n  by: x\n---\nBody",
]
FILES_SQL = "CASE p_size % 5 " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(FILES)) + " END || p_name"


def fifths(texts: list[str]) -> Column:
    n = F.col("p_size") % 5
    out = F.lit(None).cast("string")
    for k, s in enumerate(texts):
        out = F.when(n == k, F.lit(s)).otherwise(out)
    return out


def url_sql(force: bool) -> str:
    end = "replace(text, '\n---\nBody', '\npdf_url: ' || url || '\n---\nBody')"
    return f"""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN text WHEN 2 THEN {"replace(text, 'pdf_url: old', 'pdf_url: ' || url)" if force else "text"} WHEN 3 THEN replace(text, '\nlang', '\npdf_url: ' || url || '\nlang') ELSE {end} END AS text,
CASE p_size % 5 WHEN 0 THEN 'skip-no-frontmatter' WHEN 2 THEN '{"replaced" if force else "skip-existing"}' ELSE 'inserted' END AS status
FROM (SELECT p_partkey, p_size, {FILES_SQL} AS text, 'https://x.org/' || {"8" if force else "5"} || '/' || p_partkey AS url FROM part WHERE p_partkey % 7 NOT IN (0, 1, 2))"""


def urls_applied(t: Tables, force: bool) -> DataFrame:
    k = F.col("p_partkey")
    entries = t.part.select("p_partkey", F.concat(fifths(FILES), F.col("p_name")).alias("text"))
    seq = F.explode(F.sequence(F.lit(4), F.lit(9)))
    url = F.when(k % 7 != 0, F.concat(F.lit("https://x.org/"), F.col("seq").cast("string"), F.lit("/"), k.cast("string")))
    confidence = F.when((k % 7 == 1) | (F.col("seq") == 4), "low").otherwise("high")
    notes_ = F.when((k % 7 == 2) | (F.col("seq") == 9), "DUPLICATE: also matched by another")
    links = t.part.select("p_partkey", seq.alias("seq")).select("p_partkey", "seq", url.alias("url"), confidence.alias("confidence"), notes_.alias("notes"))
    return headers.apply_urls(entries, "p_partkey", "text", links, ["exact", "high", "medium"], force)


@query(url_sql(False))
def urls_inserted(t: Tables) -> DataFrame:
    return urls_applied(t, False)


@query(url_sql(True))
def urls_forced(t: Tables) -> DataFrame:
    return urls_applied(t, True)


HEADERS = ["", "id: p", "id: p\nlang: en\nx: 1\n", "kinds:\n  - a\n  - b\nid: p\n", "id: p\nkinds: []"]
LINED = ["lang: hi\n", "id: p\nlang: hi\n", "id: p\nlang: hi\nx: 1\n", "kinds:\n  - a\n  - b\nid: p\nlang: hi\n", "id: p\nkinds: []\nlang: hi\n"]
BLOCKED = ["kinds:\n  - z\n", "id: p\nkinds:\n  - z\n", "id: p\nlang: en\nx: 1\nkinds:\n  - z\n", "kinds:\n  - z\nid: p\n", "id: p\nkinds:\n  - z\n"]


def fifths_sql(texts: list[str]) -> str:
    return "CASE p_size % 5 " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(texts)) + " END"


@query(f"SELECT p_partkey, {fifths_sql(LINED)} AS lined, CASE WHEN p_partkey % 3 = 0 THEN {fifths_sql(HEADERS)} ELSE {fifths_sql(BLOCKED)} END AS blocked FROM part")
def header_upserts(t: Tables) -> DataFrame:
    h = fifths(HEADERS)
    block = F.when(F.col("p_partkey") % 3 != 0, F.lit("kinds:\n  - z\n\n"))
    return t.part.select("p_partkey", headers.set_line(h, "lang", F.lit("lang: hi")).alias("lined"), headers.set_block(h, "kinds", block).alias("blocked"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'A. D. Shroff' WHEN 1 THEN 'A.D. Shroff' ELSE 'BK Nehru' END AS canonical FROM part")
def canonical_in_cluster(t: Tables) -> DataFrame:
    n = F.col("p_size") % 3
    winner = F.when(n == 0, "AD Shroff").when(n == 1, "A.D. Shroff").otherwise("BK Nehru")
    return t.part.select("p_partkey", authority.canonical_of(winner, F.array(F.lit("X.Y."), F.lit("A. D. Shroff"), F.lit("A.D. Shroff"))).alias("canonical"))


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'section-377' WHEN 1 THEN 'free-markets' WHEN 2 THEN 'free-markets' WHEN 3 THEN 'rule-of-law' ELSE replace(p_name, ' ', '-') END AS theme FROM part")
def theme_keys(t: Tables) -> DataFrame:
    n = F.col("p_size") % 5
    theme = F.when(n == 0, "Section377").when(n == 1, "FreeMarkets").when(n == 2, "FREE MARKETS").when(n == 3, "_Rule__of law-").otherwise(F.initcap("p_name"))
    return t.part.select("p_partkey", authority.theme_key(theme, ["section-377", "free-markets"]).alias("theme"))


@query("SELECT c_custkey, 1 AS \"at\", 'Mr.  Nation ' || c_nationkey AS verbatim, n_name AS known_as FROM customer JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3")
def known_recommendations(t: Tables) -> DataFrame:
    name = F.concat(F.lit("Mr.  Nation "), F.col("c_nationkey").cast("string"))
    one = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("verbatim"))
    records = t.customer.select("c_custkey", F.array(one("place", name), one("thinker", name), one("thinker", F.lit(""))).alias("additions"))
    lookup = t.nation.filter("n_regionkey < 3").select(F.concat(F.lit("mr nation "), F.col("n_nationkey").cast("string")).alias("name"), "n_name")
    return authority.already_known(records, "c_custkey", "additions", lookup, "name", "n_name")


@query(r"""SELECT doc_id, coalesce(length(trim(regexp_replace(regexp_replace(text, '[*_`>#]+', '', 'g'), '\s+', ' ', 'g'))) >= 200, FALSE) AS qualifies FROM documents""")
def entity_scope(t: Tables) -> DataFrame:
    tail = F.when(F.col("doc_id") % 2 == 0, F.lit("\n## KEY points\n- " + "x" * 300)).otherwise(F.lit("\n*Generated by a pipeline*" + "y" * 300))
    return t.documents.select("doc_id", headers.qualifies_for_entities(F.concat("text", tail)).alias("qualifies"))


@query(r"SELECT doc_id, coalesce(length(text), 0) AS content_length, left(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), 500) AS content_preview FROM documents WHERE lang = 'en' AND source IS NOT NULL")
def post_previews(t: Tables) -> DataFrame:
    c = F.coalesce("text", F.lit(""))
    return t.documents.filter("lang = 'en' and source is not null").select("doc_id", F.char_length(c).cast("long").alias("content_length"), headers.preview(F.col("text")).alias("content_preview"))


@query("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'super' WHEN c_nationkey % 5 = 1 THEN 'sub' ELSE 'none' END AS tier FROM customer")
def access_tiers(t: Tables) -> DataFrame:
    mail = lambda n: F.concat(F.lit("n"), n.cast("string"), F.lit("@x.org"))
    users = t.customer.select("c_custkey", F.concat(F.lit(" "), F.upper(mail(F.col("c_nationkey")))).alias("email"))
    subs = t.nation.filter("n_nationkey % 5 = 1 or n_nationkey = 3").select(F.concat(mail(F.col("n_nationkey")), F.lit(" ")).alias("mail"))
    return authority.access_tier(users, "email", ["N3@x.org "], subs, "mail").select("c_custkey", "tier")


@query("SELECT p_partkey, array_to_string(list_distinct(['free-' || replace(p_name, ' ', '-')]), ',') || CASE WHEN p_size % 2 = 0 THEN ',b' ELSE '' END AS themes FROM part")
def feed_categories(t: Tables) -> DataFrame:
    slug = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")
    free = F.concat(F.lit("Free "), F.col("p_name"))
    categories = F.array(free, F.lit("--"), F.when(F.col("p_size") % 2 == 0, "B!").otherwise(free), F.upper(free))
    return t.part.select("p_partkey", F.array_join(authority.slugged_categories(categories, slug), ",").alias("themes"))


@query("SELECT l_orderkey, string_agg(l_linenumber || ':' || l_suppkey, ',' ORDER BY l_linenumber, l_suppkey) AS mentions FROM lineitem GROUP BY 1")
def mentions_by_entry(t: Tables) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey")))
    said = F.transform(rows, lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_suppkey"].cast("string")))
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(said, ",").alias("mentions"))


@query()
def nearest_titles(t: Tables) -> DataFrame:
    """Searches of every twentieth document's opening words among those of all documents."""
    opening = F.array_join(F.slice(F.split(F.lower(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}\s]+", ""))), r"\s+", 7), 1, 6), " ")
    titles = t.documents.select("doc_id", opening.alias("title"))
    misses = titles.filter("doc_id % 20 = 0")
    return authority.nearest_titles(misses, "doc_id", "title", titles.select(F.col("doc_id").alias("other"), F.col("title").alias("o_title")), "other", "o_title")
