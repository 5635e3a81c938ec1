"""The quality rules' distances and verdicts, and the packing stage, against plain counts."""

import re
from collections import Counter
from math import log2

import corpus_pipeline
from folio.llm import quality
from folio.llm.queries import QUERIES

SPACES = " \t\n\x0b\x0c\r"


def class_of(ch):
    if ch in SPACES:
        return "space"
    if ch.isascii() and ch.isalpha():
        return "lower" if ch.islower() else "upper"
    if ch.isascii() and ch.isdigit():
        return "digit"
    return "mark" if ch in ".,;:!?'\"()-" else "other" if ch.isascii() else "beyond"


def common_bins(words, lang):
    known = {}
    for i, w in enumerate(quality.COMMON[lang]):
        for form in (w, w.capitalize()):
            for mark in ("", ".", ","):
                known[form + mark] = min(i, 10)
    return Counter(known.get(w, "none") for w in words)


def entropy(c):
    n = sum(c.values())
    return -sum(x / n * log2(x / n) for x in c.values() if x)


def js(p, q):
    """By entropies: of the mean less the mean of both."""
    n, m = sum(p.values()), sum(q.values())
    if not n or not m:
        return 0.0
    mean = {k: p.get(k, 0) / n / 2 + q.get(k, 0) / m / 2 for k in {*p, *q}}
    return max(0.0, entropy(mean) - (entropy(p) + entropy(q)) / 2) ** 0.5


def plain_verdicts(docs):
    """doc -> (class distance, word distance, kept)"""
    of, refs = {}, {}
    for d, text, lang in docs:
        words = [w for w in re.split(f"[{SPACES}]+", text or "") if w]
        classes = Counter(map(class_of, text or ""))
        common = common_bins(words, lang) if lang in quality.COMMON else None
        of[d] = len(words), classes, common, lang
        if len(words) >= 20 and sum(classes.values()) >= 50:
            refs.setdefault("all", Counter()).update(classes)
            if common is not None:
                refs.setdefault(("classes", lang), Counter()).update(classes)
                refs.setdefault(("words", lang), Counter()).update(common)
    out = {}
    for d, (n, classes, common, lang) in of.items():
        chars = sum(classes.values())
        ref = refs.get(("classes", lang) if common is not None else "all")
        dc = js(classes, ref) if ref and chars >= 50 else 0.0
        dw = js(common, refs["words", lang]) if common is not None and ("words", lang) in refs and n >= 20 else 0.0
        out[d] = dc, dw, dc <= 0.15 + 2.5 / max(1, chars) ** 0.5 and dw <= 0.07 + 2.0 / max(1, n) ** 0.5
    return out


def test_distances_and_verdicts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    want = plain_verdicts(docs)
    got = QUERIES["op10_quality_rules"](spark, sf_dir).collect()
    assert len(got) == len(want)
    for r in got:
        dc, dw, good = want[r.doc_id]
        assert abs(r.class_distance - dc) < 1e-9 and abs(r.word_distance - dw) < 1e-9, r.doc_id
        assert r.kept == (good and not r.base_failed), r.doc_id
    assert {r.kept for r in got} == {True, False} and any(not r.base_failed and not r.kept for r in got)


def test_unlisted_languages_are_held_to_all_documents(spark):
    text = "Many words of one kind and another, told over and over again so that there are more than twenty of them in it. "
    docs = [(1, text * 5, "en"), (2, text * 3, "xx"), (3, "12345 67890 " * 40, "xx"), (4, None, None), (5, "", "fr"), (6, "short", "en"), (7, "9 " * 200, "en")]
    got = {r.doc_id: (round(r.class_distance, 9), round(r.word_distance, 9)) for r in quality.verdicts(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert got == {d: (round(a, 9), round(b, 9)) for d, (a, b, _) in plain_verdicts(docs).items()}


def test_packing_stage_holds_every_token_once(spark, sf_dir):
    """Sequences are gapless, no longer than their capacity, and as few as best-fit decreasing over the same lengths makes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = corpus_pipeline.pack(spark, docs, sf_dir).collect()
    assert all(len(r.ids) == r.length for r in rows)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    open_ = []
    for n in sorted((r.length for r in rows), reverse=True):
        fits = [i for i, room in enumerate(open_) if room >= n]
        i = min(fits, key=open_.__getitem__, default=None)
        if i is None:
            open_.append(4096 - n)
        else:
            open_[i] -= n
    assert len(bins) == len(open_) and {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}
