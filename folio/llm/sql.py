"""SQL of the longer queries."""

from __future__ import annotations


def crc32(text: str) -> str:
    """CRC-32 of an SQL expression's UTF-8 bytes, bit by bit."""
    byte = lambda at: f"(instr('123456789ABCDEF', substr(hex(encode({text})), {at}, 1)))"
    octets = f"list_transform(range(1, 2 * strlen({text}), 2), lambda i: CAST(16 * {byte('i')} + {byte('i + 1')} AS BIGINT))"
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, k: xor(v >> 1, (v & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, b: {step}), 4294967295)"


SPACES = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def best(*choices: str) -> str:
    """The least (cost, edits) of those that there are; written out in full, so edits are compared as strings."""
    return f"list_min(list_filter([{', '.join(choices)}], lambda x: x.c IS NOT NULL))"


def after(state: str, cost: str, edits: str) -> str:
    return f"{{'c': {cost} + {state}.c, 'e': {edits} || {state}.e}}"


def repair_sql() -> str:
    """Recursion from the last row to the first; a state holds the cheapest edits of what follows a retained role."""
    s, u, a = (after(f"d.{r}", f"CASE WHEN f.fault IN (1, 2) THEN NULL WHEN f.i1 = '{r}' THEN 0 ELSE {'NULL' if r == 's' else 1} END + CASE f.fault WHEN 3 THEN 5 ELSE 0 END", f"CASE WHEN f.i1 = '{r}' THEN 'K' ELSE 'R' END") for r in "sua")
    gone = lambda r: after(f"d.{r}", "2", "'D'")
    put = lambda x: after("o." + x, "5", "'I'")
    return rf"""
WITH RECURSIVE original AS (SELECT DISTINCT conv_id FROM conversations),
dealt AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations),
damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, copy,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM dealt, (VALUES (0), (1)) copies(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
numbered AS (SELECT *, left(role, 1) AS i1, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM damaged),
f AS (SELECT *, lag(i1) OVER (PARTITION BY conv_id ORDER BY i) AS i0,
  CASE WHEN rtrim(text, {SPACES}) = '' THEN 1 WHEN again THEN 2 WHEN right(rtrim(text, {SPACES}), 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM numbered),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
  count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (i0 IS NOT NULL AND i0 || i1 NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
dp AS (
  SELECT conv_id, n + 1 AS i, {{'c': 0, 'e': ''}} AS o, {{'c': 10, 'e': 'II'}} AS s, {{'c': 5, 'e': 'I'}} AS u, {{'c': 0, 'e': ''}} AS a FROM counts
  UNION ALL
  SELECT conv_id, i, {best('o', 's1', 'u1', after('a1', '5', "'I'"))}, {best('s', 'u1', after('a1', '5', "'I'"))}, {best('u', 'a1', after('u1', '5', "'I'"))}, {best('a', 'u1', after('a1', '5', "'I'"))}
  FROM (SELECT f.conv_id, f.i, {gone('o')} AS o, {gone('s')} AS s, {gone('u')} AS u, {gone('a')} AS a, {s} AS s1, {u} AS u1, {a} AS a1
    FROM dp d JOIN f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.i = d.i - 1)),
plan AS (SELECT conv_id, CAST(o.c AS BIGINT) AS cost, o.e AS audit FROM dp WHERE i = 1),
edits AS (SELECT conv_id, j, substr(audit, CAST(j AS INT), 1) AS edit FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM plan)),
placed AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS i, count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id ORDER BY j) AS p FROM edits),
retained AS (SELECT e.conv_id, e.j, e.edit, e.p, f.role, f.text, f.i1 FROM placed e LEFT JOIN f ON e.edit <> 'I' AND f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i WHERE e.edit <> 'D'),
shifted AS (SELECT *, max(CASE WHEN p = 1 AND edit = 'K' AND i1 = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS s FROM retained),
written AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (p - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE edit WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS repaired FROM shifted GROUP BY conv_id)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired, sha256('')) AS repaired_sha256
FROM original g LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN plan p ON p.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN written w ON w.conv_id IS NOT DISTINCT FROM g.conv_id
"""


def spelling_sql() -> str:
    """Near words by equal remainders after a deletion, roots by recursion."""
    return rf"""
WITH RECURSIVE runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]{{6,}}')) AS run FROM documents),
hashed AS (SELECT run, length(run) AS l, {crc32("doc || ':' || run")} AS h FROM runs),
typed AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % l AS INT)) || substr(run, CAST(h % l + 2 AS INT)) ELSE run END AS word FROM hashed),
words AS (SELECT word, count(*) AS n, length(word) AS l FROM typed WHERE length(word) >= 6 GROUP BY word, length(word) HAVING count(*) >= 5),
cut AS (SELECT word, l, p, left(word, CAST(p - 1 AS INT)) || substr(word, CAST(p + 1 AS INT)) AS rest FROM (SELECT word, l, unnest(range(1, l + 1)) AS p FROM words)),
shorter AS (SELECT DISTINCT c.word AS a, w.word AS b FROM cut c JOIN words w ON w.word = c.rest),
near AS (SELECT a AS word, b AS near FROM shorter UNION SELECT b, a FROM shorter UNION SELECT c.word, d.word FROM cut c JOIN cut d ON c.rest = d.rest AND c.p = d.p AND c.word <> d.word),
best AS (SELECT x.word, count(*) AS n_near, max(w.n) AS top, arg_min(w.word, (-w.n, w.word)) AS form FROM near x JOIN words w ON w.word = x.near GROUP BY x.word),
known AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * w.n THEN form END AS form, CASE WHEN top >= 5 * w.n THEN top END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (SELECT word, word AS root FROM known WHERE form IS NULL UNION ALL SELECT k.word, c.root FROM known k JOIN chain c ON k.form = c.word)
SELECT k.word, form, root, n, n_near, form_n FROM known k JOIN chain c ON c.word = k.word
"""
