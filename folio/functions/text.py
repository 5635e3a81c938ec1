"""String functions of the archive: tokens, excerpts, truncation, boilerplate, markdown and links."""

from __future__ import annotations

import html as html_module
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions.names import n2_kebab, squeeze

#: Words that carry no subject.
STOPWORDS = """
a about above after again against all am an and any are as at be because been before being below between both but by can
cannot could did do does doing don down during each few for from further had has have having he her here hers herself him
himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our
ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they
this those through to too under until up very was we were what when where which while who whom why will with would you
your yours yourself yourselves
""".split()
#: Letters of a token, Latin and three Indic blocks.
TOKEN = r"[A-Za-zऀ-ॿ઀-૿ঀ-৿]{3,}"
#: Title words that are no names.
HONORIFICS = ["dr", "dr.", "mr", "mr.", "mrs", "mrs.", "ms", "ms.", "prof", "prof.", "shri", "sir", "sri", "smt", "lady", "lord"]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec"]
ROMAN = r"^(?=..)m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"


def without_markup(c: Column) -> Column:
    """Fences, inline code, tags and images go; of links the text stays; marks become spaces."""
    for pattern, to in ((r"(?s)```.*?```", " "), ("`[^`]*`", " "), ("<[^>]+>", " "), (r"!\[[^\]]*\]\([^)]+\)", " "), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"[#>*_~|]+", " ")):
        c = F.regexp_replace(c, pattern, to)
    return c


def tokens(c: Column) -> Column:
    """Lower-case tokens of three letters or more that aren't stopwords, in order, repeats included."""
    found = F.transform(F.regexp_extract_all(without_markup(c), F.lit(TOKEN), 0), F.lower)
    return F.filter(found, lambda t: ~t.isin(*STOPWORDS))


def name_candidates(title: Column, slug: Column) -> Column:
    """Parts of a title and slug that may be of a name: no honorifics, months, years, days or Roman numerals."""
    spaced = F.regexp_replace(F.regexp_replace(F.concat_ws(" ", title, slug), r"[—–\-·:,/]", " "), r"(?i)\bby\b", " ")
    parts = F.transform(F.split(squeeze(spaced), " "), n2_kebab)
    keep = lambda p: (p != "") & ~p.isin(*HONORIFICS, *MONTHS) & ~p.rlike(r"(?:19|20)\d\d") & ~p.rlike(rf"^(?:{'|'.join(MONTHS)})-?\d") & ~p.rlike(r"^\d{1,2}(st|nd|rd|th)?$") & ~p.rlike(ROMAN)
    return F.array_distinct(F.filter(parts, keep))


def excerpt(c: Column, n: int) -> Column:
    """Plain text of a markdown body, cut after n characters."""
    return F.substring(squeeze(without_markup(c)), 1, n)


def cut_at_paragraph(c: Column, n: int) -> Column:
    """At most n characters, cut at the last blank line, else the last line end, else at n."""
    head = F.substring(c, 1, n)
    at_blank, at_line = (F.regexp_extract(head, p, 1) for p in (r"(?s)^(.*)\n\n", r"(?s)^(.*)\n"))
    cut = F.when(head.rlike(r"(?s)^.+\n\n"), at_blank).when(head.rlike(r"(?s)^.+\n"), at_line).otherwise(head)
    return F.regexp_replace(F.when(F.char_length(c) <= n, c).otherwise(cut), r"\s+$", "")


def cut_at_sentence(c: Column, most: int = 1200, least: int = 600, hard: int = 1197) -> Column:
    """Longer texts end after the last sentence before `most`; if that is early, at `hard` with an ellipsis."""
    head = F.substring(c, 1, most)
    sentences = F.regexp_extract(head, r"(?s)^(.*\.) ", 1)
    return F.when(F.char_length(c) <= most, c).when(F.char_length(sentences) >= least, sentences).otherwise(F.concat(F.rtrim(F.substring(c, 1, hard)), F.lit("…")))


def middle_cut(most_bytes: int = 80_000, marker: str = "\n\n[...]\n\n"):
    """UDF: the first and last halves of a text that has more bytes; broken characters at the cuts go."""

    @F.pandas_udf(T.StringType())
    def cut(s: pd.Series) -> pd.Series:
        def one(t):
            if t is None or len(b := t.encode()) <= most_bytes:
                return t
            half = most_bytes // 2
            return b[:half].decode(errors="ignore") + marker + b[-half:].decode(errors="ignore")

        return s.map(one)

    return cut


def strip_heading(body: Column, names: Column) -> Column:
    """The first line goes if it is `# name` for one of the names, in any case."""
    first = F.regexp_extract(body, r"^\s*#\s+([^\n]*?)[ \t]*(?:\n|$)", 1)
    named = F.array_contains(F.transform(names, lambda x: F.lower(F.trim(x))), F.lower(F.trim(first)))
    return F.when(named & (first != ""), F.regexp_replace(body, r"^\s*#[^\n]*\n*", "")).otherwise(body)


def strip_title_byline(body: Column) -> Column:
    """A first heading and an italic `By ..` line after it go; three line ends or more become two."""
    cut = F.regexp_replace(body, r"^\s*#\s+[^\n]*(?:\n+|$)(?:\*By [^\n]*\*[ \t]*(?:\n+|$))?", "")
    return F.regexp_replace(cut, r"\n{3,}", "\n\n")


def strip_markers(body: Column, patterns: list[str]) -> Column:
    for p in patterns:
        body = F.regexp_replace(body, p, "")
    return F.trim(F.regexp_replace(body, r"\n{3,}", "\n\n"))


def last_match(c: Column, pattern: str, group: int = 1, keep=None) -> Column:
    """The last match that passes."""
    found = F.regexp_extract_all(c, F.lit(pattern), group)
    return F.element_at(F.filter(found, keep) if keep else found, -1) if keep else F.try_element_at(found, F.lit(-1))


def tail_or_null(c: Column, tail: str, least: int = 80) -> Column:
    """Without an export's tail; null if too little is left."""
    cut = F.trim(F.regexp_replace(c, tail, ""))
    return F.when(F.char_length(F.regexp_replace(cut, r"\s", "")) >= least, cut)


def inline_html(c: Column) -> Column:
    """Escaped text with bold and italic marks as tags."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(c, r"\*\*([^*]+)\*\*", "<strong>$1</strong>"), r"\*([^*]+)\*", "<em>$1</em>")


def author_from_title(c: Column) -> Column:
    """What follows the word by, up to a bracket, bar or dash; null unless 3 to 80 characters."""
    found = F.trim(F.regexp_extract(c, r"(?i)\bby\s+([^(|\-]+)", 1))
    return F.when(F.char_length(found).between(3, 80), found)


def subject_from_title(c: Column, prefix: str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, prefix, ""), r"(?i)\s+by\s.*$", ""), r"\([^)]*\)", ""))


def slug_tail_grams(slug: Column) -> Column:
    """Ends of five to two parts, longest first, then inner runs of three and two, after dates at the end went."""
    parts = F.split(F.regexp_replace(slug, rf"(?:-(?:(?:19|20)\d\d|\d{{1,2}}|{'|'.join(MONTHS)}))+$", ""), "-")
    n = F.size(parts)
    ends = F.transform(F.filter(F.sequence(F.lit(5), F.lit(2)), lambda k: k <= n), lambda k: F.concat_ws("-", F.slice(parts, n - k + 1, k)))

    def inner_runs(k: int) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), n - k)), lambda i: i + k <= n)
        return F.transform(starts, lambda i: F.concat_ws("-", F.slice(parts, i, F.lit(k))))

    inner = [inner_runs(k) for k in (3, 2)]
    return F.array_distinct(F.concat(ends, *inner))


def title_prefixes(title: Column, short: int = 4) -> Column:
    """What stands before a colon, a dash or the word on; all of a short title."""
    before = [F.when(F.instr(title, s) > 1, F.trim(F.substring_index(title, s, 1))) for s in (":", " - ", "–", "—", " on ")]
    whole = F.when(F.size(F.split(squeeze(title), " ")) <= short, squeeze(title))
    return F.array_distinct(F.array_compact(F.array(*before, whole)))


def script_of(c: Column) -> Column:
    """The script of most letters; `mixed` where Latin letters come to half of the Indic ones."""
    count = lambda cls: F.char_length(F.regexp_replace(c, f"[^{cls}]", ""))
    deva, gujr, beng = count(r"ऀ-ॿ"), count(r"઀-૿"), count(r"ঀ-৿")
    latin, indic = count("A-Za-z"), deva + gujr + beng
    best = F.when((deva >= gujr) & (deva >= beng), "devanagari").when(gujr >= beng, "gujarati").otherwise("bengali")
    return F.when((indic == 0) & (latin == 0), "none").when(indic == 0, "latin").when(latin * 2 >= indic, "mixed").otherwise(best)


def ocr_clean(c: Column) -> Column:
    """Five entities decoded, control characters gone, blanks in a line collapsed."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return F.trim(F.regexp_replace(c, r"[ \t]+", " "))


@F.pandas_udf(T.StringType())
def decode_entities(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else html_module.unescape(t))


def html_to_markdown(c: Column) -> Column:
    """Headings, emphasis, links, images, lists and paragraphs of an importer's HTML; entities last."""
    c = F.regexp_replace(c, r"(?is)<(script|style|head)\b.*?</\1>|<!--.*?-->", "")
    c = F.regexp_replace(c, r"\[/?[a-z_]+[^\]]*\]", "")
    c = F.regexp_replace(c, r'(?is)<img\b[^>]*?src="([^"]*)"[^>]*?alt="([^"]*)"[^>]*>', r"![$2]($1)")
    c = F.regexp_replace(c, r'(?is)<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', r"[$2]($1)")
    for k in range(6, 0, -1):
        c = F.regexp_replace(c, rf"(?is)<h{k}\b[^>]*>(.*?)</h{k}>", "\n\n" + "#" * k + " $1\n\n")
    c = F.regexp_replace(c, r"(?is)<(strong|b)\b[^>]*>(.*?)</\1>", r"**$2**")
    c = F.regexp_replace(c, r"(?is)<(em|i)\b[^>]*>(.*?)</\1>", "_$2_")
    c = F.regexp_replace(c, r"(?is)<li\b[^>]*>(.*?)</li>", "\n- $1")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
    c = F.regexp_replace(c, r"(?i)</?(p|div|ul|ol|blockquote|article|section)\b[^>]*>", "\n\n")
    c = decode_entities(F.regexp_replace(c, r"(?s)<[^>]+>", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"), F.lit("\n \t"))


def feed_html_to_markdown(c: Column) -> Column:
    """A feed's HTML: two heading levels, `*em*`, quoted blocks and numbered lists written as such."""
    c = F.regexp_replace(c, r"(?is)<h2\b[^>]*>(.*?)</h2>", "\n\n## $1\n\n")
    c = F.regexp_replace(c, r"(?is)<h3\b[^>]*>(.*?)</h3>", "\n\n### $1\n\n")
    c = F.regexp_replace(c, r"(?is)<(strong|b)\b[^>]*>(.*?)</\1>", r"**$2**")
    c = F.regexp_replace(c, r"(?is)<(em|i)\b[^>]*>(.*?)</\1>", "*$2*")
    c = F.regexp_replace(c, r'(?is)<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', r"[$2]($1)")
    c = feed_blocks(c)
    c = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
    c = F.regexp_replace(c, r"(?i)</?p\b[^>]*>", "\n\n")
    c = decode_entities(F.regexp_replace(c, r"(?s)<[^>]+>", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"), F.lit("\n \t"))


@F.pandas_udf(T.StringType())
def feed_blocks(s: pd.Series) -> pd.Series:
    """Numbering and line prefixes need a counter, which no expression has."""
    item = re.compile(r"(?is)<li\b[^>]*>(.*?)</li>")

    def numbered(m):
        return "\n\n" + "\n".join(f"{i}. {x.strip()}" for i, x in enumerate(item.findall(m[1]), 1)) + "\n\n"

    def quoted(m):
        body = re.sub(r"(?i)</?p\b[^>]*>", "\n", m[1]).strip()
        return "\n\n" + "\n".join(f"> {x.strip()}" for x in body.split("\n") if x.strip()) + "\n\n"

    def one(t):
        if t is None:
            return None
        t = re.sub(r"(?is)<ol\b[^>]*>(.*?)</ol>", numbered, t)
        t = re.sub(r"(?is)<ul\b[^>]*>(.*?)</ul>", lambda m: "\n\n" + "\n".join(f"- {x.strip()}" for x in item.findall(m[1])) + "\n\n", t)
        return re.sub(r"(?is)<blockquote\b[^>]*>(.*?)</blockquote>", quoted, t)

    return s.map(one)


def language_path(path: Column, lang: Column, default: str = "en") -> Column:
    return F.when(lang == default, path).otherwise(F.concat(F.lit("/"), lang, path))


def slug_from_url(url: Column, title: Column, marker: str, most: int = 80) -> Column:
    """The part after the marker, else the last part that is no number, else the title's slug."""
    parts = F.filter(F.split(F.parse_url(url, F.lit("PATH")), "/"), lambda p: p != "")
    at = F.array_position(parts, marker)
    after = F.when(at > 0, F.get(parts, at.cast("int")))
    words = F.filter(parts, lambda p: ~p.rlike(r"^\d+$"))
    return F.coalesce(after, F.try_element_at(words, F.lit(-1)), F.substring(n2_kebab(title), 1, most))


def video_id(c: Column) -> Column:
    found = F.regexp_extract(c, r"(?:youtu\.be/|[?&]v=|/embed/|/shorts/)([A-Za-z0-9_-]{11})", 1)
    return F.nullif(found, F.lit(""))


def first_label(c: Column, patterns: list[tuple[str, str]]) -> Column:
    """The label of the first pattern, in the list's order, that stands in the text as words."""
    out = F
    for pattern, label in patterns:
        out = out.when(c.rlike(rf"(?i)\b(?:{pattern})\b"), label)
    return out.otherwise(F.lit(None).cast("string"))


def token_set_ratio(a: str, b: str) -> float:
    """0 to 100: the best likeness among the shared words, and the shared words with either rest."""
    if not a or not b:
        return 0.0
    x, y = set(a.split()), set(b.split())
    both, only_x, only_y = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not only_x or not only_y):
        return 100.0
    base = " ".join(both)
    texts = [base, " ".join([*both, *only_x]), " ".join([*both, *only_y])]
    return max(indel_ratio(p, q) for p, q in ((texts[0], texts[1]), (texts[0], texts[2]), (texts[1], texts[2])))


def common_letters(a: str, b: str) -> int:
    """Length of the longest common subsequence. The bits of one number stand for the letters of a, so each letter of b is one step."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    whole = free = (1 << len(a)) - 1
    for ch in b:
        hit = free & places.get(ch, 0)
        free = (free + hit | free - hit) & whole
    return len(a) - free.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 times twice the longest common subsequence by both lengths."""
    return 200.0 * common_letters(a, b) / (len(a) + len(b)) if a or b else 100.0


@F.pandas_udf(T.DoubleType())
def token_set_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def first_json_object(s: pd.Series) -> pd.Series:
    """The first balanced {...} of a reply that parses, fences removed."""
    import json

    def one(t):
        if t is None:
            return None
        t, decoder = re.sub(r"```(?:json)?", "", t), json.JSONDecoder()
        for m in re.finditer(r"\{", t):
            try:
                value, _ = decoder.raw_decode(t, m.start())
                return json.dumps(value, ensure_ascii=False, sort_keys=True)
            except ValueError:
                continue
        return None

    return s.map(one)


@F.pandas_udf(T.StringType())
def strip_diacritics(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))
