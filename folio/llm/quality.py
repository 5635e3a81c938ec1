"""Quality rules by distribution divergence.

Two histograms of a document, its character classes and its common words, are compared with those of its language
by Jensen-Shannon distance. The references are counts over every document of the language that reaches the
minimum lengths. A histogram of n events strays from its reference by about 1/sqrt(n), so the limits widen so, and
below the minimum length a histogram has no say. A language without a list of common words is held to the character classes
of all documents together.

Null text has no words and fails the base rules. Repeated rows get equal verdicts. An empty table has no references
and no rows. Columns named like the results are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Common words by language.
COMMON = {
    "en": "the of and to in is that it for on with as was by be at are this from or an a not have has but which they you he we his her",
    "fr": "le la les de des du un une et en est que qui dans pour par sur pas au aux avec ce il elle ne se plus son sa ou mais nous",
    "de": "der die das und in zu den von mit ist im des ein eine für auf sich dem nicht auch es als an wird aus bei nach sie er um einer",
    "es": "el la los las de del y en que un una es por con para se su no al lo como más pero sus le ya o este sí porque esta entre",
}
COMMON = {k: v.split() for k, v in COMMON.items()}
SPELLINGS = {k: [[(x + mark).encode() for x in (w, w.capitalize()) for mark in ("", ".", ",")] for w in v] for k, v in COMMON.items()}
#: The reference that languages without a list share.
OTHER = "*"
#: Common words are counted one by one up to this place, then together; the last bin has all other words.
SINGLE = 10
WORD_BINS = SINGLE + 2
#: Distance limits for an endless document, and what 1/sqrt(n) adds to them for n words or characters; least lengths to be judged.
WORD_LIMIT, WORD_SLACK, CLASS_LIMIT, CLASS_SLACK, LEAST_WORDS, LEAST_CHARS = 0.07, 2.0, 0.15, 2.5, 20, 50

#: Character classes by UTF-8 byte; the first byte of a character stands for it, the others for nothing.
CLASS_BYTES = [range(ord("a"), ord("z") + 1), range(ord("A"), ord("Z") + 1), range(ord("0"), ord("9") + 1), [0x20, *range(0x09, 0x0E)], list(b".,;:!?'\"()-"), [], range(0xC0, 0x100)]
SPACE, REST = 3, 5
CLASS_OF = np.zeros((256, len(CLASS_BYTES)), dtype=np.int64)
for _k, _bytes in enumerate(CLASS_BYTES):
    CLASS_OF[list(_bytes), _k] = 1
CLASS_OF[:0x80, REST] = 1 - CLASS_OF[:0x80].sum(axis=1)
SYMBOLS = list(b"#*$%&|<>")

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeat_words(words: list[bytes], distinct: Counter) -> int:
    """Words that lie in a window of three words found at least twice in the text."""
    n, v = len(words), len(distinct)
    if n < 4:
        return 0
    number = dict(zip(distinct, range(v), strict=True))
    ids = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=n)
    pairs = ids[:-1] * v + ids[1:]
    if v >= 2_000_000:  # three of them would not fit into 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * v + ids[2:]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    again = np.isin(windows, twice)
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def dup_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    return sum(n - 1 for x, n in Counter(lines).items() if n > 1 and x.split())


def histograms(text: bytes, words: Counter, n_words: int, lang: str | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Counts of bytes, and of common words where the language has a list: small or with a capital, a full stop or comma after them or not."""
    common = None
    if lang in COMMON:
        common = np.zeros(WORD_BINS, dtype=np.int64)
        for i, spellings in enumerate(SPELLINGS[lang]):
            common[min(i, SINGLE)] += sum(words[w] for w in spellings)
        common[-1] = n_words - common.sum()
    return np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256), common


def measure(text: bytes | None, lang: str | None) -> tuple[list[int], np.ndarray, np.ndarray | None]:
    """Base counts, character classes, common words."""
    text = text or b""
    words = text.split()
    distinct = Counter(words)
    seen, common = histograms(text, distinct, len(words), lang)
    classes = seen @ CLASS_OF
    return [len(words), int(classes.sum() - classes[SPACE]), int(seen[SYMBOLS].sum()), dup_lines(text), repeat_words(words, distinct)], classes, common


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance to base 2: 0 for equal histograms, 1 for disjoint ones."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = [np.where(x > 0, x * np.log2(x / m), 0.0).sum() for x in (p, q)]
    return float(np.sqrt(max(0.0, sum(kl) / 2)))


def group_of(lang: str | None) -> str:
    return lang if lang in COMMON else OTHER


def references(df: DataFrame, text: str = "text", lang: str = "lang") -> dict[tuple[str, str], np.ndarray]:
    """Histograms of each listed language, and of all documents, over every text of the minimum lengths.

    A row for each language, histogram and bin: some hundred numbers, however large the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], np.ndarray] = {}
        for batch in batches:
            for t, g in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), strict=True):
                t = t.as_py() or b""
                words = t.split()
                seen, common = histograms(t, Counter(words) if g in COMMON else Counter(), len(words), g)
                classes = seen @ CLASS_OF
                if len(words) < LEAST_WORDS or classes.sum() < LEAST_CHARS:
                    continue
                for key, found in ((("classes", OTHER), classes), *(((("classes", g), classes), (("words", g), common)) if common is not None else ())):
                    sums[key] = sums.get(key, 0) + found
        rows = [(kind, g, i, int(n)) for (kind, g), x in sums.items() for i, n in enumerate(x)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int64())], names=["kind", "lang", "bin", "n"])

    parts = df.select(F.col(text), F.col(lang)).mapInArrow(count, "kind string, lang string, bin int, n long")
    out: dict[tuple[str, str], np.ndarray] = {}
    for kind, g, i, n in parts.groupBy("kind", "lang", "bin").agg(F.sum("n")).collect():
        out.setdefault((kind, g), np.zeros(WORD_BINS if kind == "words" else len(CLASS_BYTES), dtype=np.int64))[i] = n
    return out


def verdicts(df: DataFrame, text: str = "text", lang: str = "lang", refs: dict | None = None) -> DataFrame:
    """Add the base counts, base_failed, class_distance, word_distance and kept to every row."""
    refs = references(df, text, lang) if refs is None else refs

    @F.pandas_udf(f"{BASE}, class_distance double, word_distance double, base_failed boolean, kept boolean")
    def judge(texts: pd.Series, langs: pd.Series) -> pd.DataFrame:
        rows = []
        for t, g in zip(texts, langs, strict=True):
            counts, classes, common = measure(t.encode() if t is not None else None, g)
            failed = base_failed(counts[0], counts[4])
            ref = refs.get(("classes", group_of(g)))
            dc = distance(classes, ref) if ref is not None and classes.sum() >= LEAST_CHARS else 0.0
            ref = refs.get(("words", g))
            dw = distance(common, ref) if common is not None and ref is not None and counts[0] >= LEAST_WORDS else 0.0
            good = dc <= CLASS_LIMIT + CLASS_SLACK / max(1, int(classes.sum())) ** 0.5 and dw <= WORD_LIMIT + WORD_SLACK / max(1, counts[0]) ** 0.5
            rows.append((*counts, dc, dw, failed, not failed and good))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in BASE.split(", ")] + ["class_distance", "word_distance", "base_failed", "kept"])

    found = judge(F.col(text), F.col(lang))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept"]
    return df.drop(*names).withColumn("__q", found).select(*[F.col(c) for c in df.columns if c not in names], *[F.col(f"__q.{n}").alias(n) for n in names])
