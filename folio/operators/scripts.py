"""Indic names in Latin letters, and the keys under which an authority may know them. All of it columns, no UDF."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import script_of
from folio.operators.joins import probe_in_turn

#: The three blocks hold the same letters at the same places; this many places each.
DEVANAGARI, BENGALI, GUJARATI, PLACES = 0x0900, 0x0980, 0x0A80, 0x80
VIRAMA, NUKTA = "्", "़"
#: Letters of Devanagari in IAST.
VOWELS = dict(zip("अआइईउऊऋॠऌएऐओऔऍऑ", "a ā i ī u ū ṛ ṝ ḷ e ai o au ê ô".split(), strict=True))
SIGNS = dict(zip("ािीुूृॄॢेैोौॅॉ", "ā i ī u ū ṛ ṝ ḷ e ai o au ê ô".split(), strict=True))
CONSONANTS = dict(zip("कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसहळ", "k kh g gh ṅ c ch j jh ñ ṭ ṭh ḍ ḍh ṇ t th d dh n p ph b bh m y r l v ś ṣ s h ḻ".split(), strict=True))
MARKS = {"ं": "ṃ", "ः": "ḥ", "ँ": "m̐", "ऽ": "'", "।": ".", "॥": "..", "ॐ": "oṃ", VIRAMA: "", NUKTA: ""}
DIGITS = {chr(DEVANAGARI + 0x66 + i): str(i) for i in range(10)}


def as_devanagari(c: Column) -> Column:
    """Bengali and Gujarati letters as those of Devanagari; letters with a dot below as letter and dot."""
    c = F.replace(c, F.lit("ৎ"), F.lit("ত্"))
    for start in (BENGALI, GUJARATI):
        c = F.translate(c, "".join(chr(start + i) for i in range(PLACES)), "".join(chr(DEVANAGARI + i) for i in range(PLACES)))
    for i in range(0x58, 0x60):
        c = F.replace(c, F.lit(chr(DEVANAGARI + i)), F.lit(unicodedata.normalize("NFD", chr(DEVANAGARI + i))))
    return c


def to_iast(c: Column) -> Column:
    """Devanagari, Bengali and Gujarati in IAST. A consonant has an a unless a sign or a virama follows; other letters stay."""
    plain = as_devanagari(c)
    bare = rf"([{''.join(CONSONANTS)}]{NUKTA}?)(?![{''.join(SIGNS)}{VIRAMA}{NUKTA}])"
    spelled = F.regexp_replace(plain, bare, "$1\x01")  # the inherent vowel, which no letter of the text can be
    known = F.create_map(*[F.lit(x) for kv in (VOWELS | SIGNS | CONSONANTS | MARKS | DIGITS | {"\x01": "a"}).items() for x in kv])
    return F.array_join(F.transform(F.split(spelled, ""), lambda ch: F.coalesce(F.try_element_at(known, ch), ch)), "")


def folded_letters() -> tuple[str, str]:
    """Latin letters with marks, and their bases, by Unicode's own decomposition."""
    pairs = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base.isascii():
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


def without_marks(c: Column) -> Column:
    """Marks go from Latin letters, then everything that isn't ASCII."""
    return F.regexp_replace(F.translate(c, *folded_letters()), r"[^\x00-\x7F]", "")


def lookup_key(c: Column) -> Column:
    """Lower case without punctuation and marks of their own, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def latin_form(c: Column) -> Column:
    """The key of a name in Latin letters: an Indic one transliterated and without marks, another as it is."""
    indic = script_of(c).isin("devanagari", "bengali", "gujarati")
    return F.when(indic, lookup_key(without_marks(to_iast(c)))).otherwise(lookup_key(c))


def resolve_names(names: DataFrame, name: str, lookup: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Adds `out`: whom the lookup (normal keys) knows by the name as written, else transliterated, else also without marks. The last two only for Indic names."""
    indic = script_of(F.col(name)).isin("devanagari", "bengali", "gujarati")
    iast = to_iast(F.col(name))
    probes = [lookup_key(F.col(name)), F.when(indic, lookup_key(iast)), F.when(indic, lookup_key(without_marks(iast)))]
    return probe_in_turn(names, lookup, probes, key, value, out)
