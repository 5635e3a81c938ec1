"""SentencePiece chunks, conversation repair and spelling variants against brute force."""

import functools
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.llm import repair, spelling, subword
from folio.llm.common import Scratch
from folio.llm.queries import ORACLE, QUERIES, tokenizer_path
from tests.compare import difference, oracle

PIECES = tokenizer_path("piece_bpe_32k.model")


@pytest.mark.parametrize("name", ["op12_conversation_repair", "op13_spelling_variants"])
def test_equals_sql(spark, sf_dir, name):
    assert difference(spark, oracle(sf_dir), QUERIES[name], ORACLE[name], sf_dir) is None


# op11


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t▁aeinrst.1<>"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=6))
def test_chunk_table_equals_library(texts):
    found = subword.ChunkTable(PIECES).encode(texts)
    assert [list(memoryview(x).cast("i")) for x in found] == subword.processor(PIECES).encode(texts)


def test_chunk_table_begun_anew_changes_nothing(monkeypatch):
    monkeypatch.setattr(subword, "REMEMBERED", 3)
    table, model = subword.ChunkTable(PIECES), subword.processor(PIECES)
    for texts in (["one two three four five"], ["", "one  one", "six"], ["x" * 500 + " two", " "]):
        assert [list(memoryview(x).cast("i")) for x in table.encode(texts)] == model.encode(texts)
        assert not [c for c in table.ids if len(c) > subword.LONGEST]


def test_models_whose_pieces_cross_markers_encode_whole(monkeypatch):
    monkeypatch.setattr(subword, "separable", lambda path: False)
    assert [list(memoryview(x).cast("i")) for x in subword.ChunkTable(PIECES).encode(["a  b", ""])] == subword.processor(PIECES).encode(["a  b", ""])


def test_op11_hostile_rows(spark):
    rows = [(1, None, "x"), (1, "", "y"), (None, "Tie tie\n tie", None), (2, "Tie tie\n tie", "z"), (2, "Tie tie\n tie", "z"), (3, "word " * 40_000 + "x" * 30_000, "long"), (4, "<s>▁▁ \x00 漢字🙂", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    made = subword.decode(subword.encode(df, PIECES), PIECES, keep=("doc_id", "ids")).collect()
    model = subword.processor(PIECES)
    want = Counter((d, tuple(model.encode(t or "")), model.decode(model.encode(t or ""))) for d, t, _ in rows)
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in made) == want
    assert subword.decode(subword.encode(df.limit(0), PIECES), PIECES, keep=("doc_id", "ids")).count() == 0


def test_op11_query(spark, sf_dir):
    model, docs = subword.processor(PIECES), spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = [model.encode(t or "") for _, t in docs]
    want = {(d, len(i), sha(",".join(map(str, i))), sha(model.decode(i) if i else "")) for (d, _), i in zip(docs, ids)}
    assert {tuple(r) for r in QUERIES["op11_sentencepiece_round_trip"](spark, sf_dir).collect()} == want


# op12


def plain_repair(initials, faults):
    """Cheapest cost and least edits by trying every edit at every row, whole strings compared."""

    @functools.cache
    def best(i, last, inserted):
        found = [(0, "")] if i == len(initials) and last in ("", "a") else []
        follows = {"": "u", "s": "u", "u": "a", "a": "u"}[last]
        if inserted < 3:
            c, e = best(i, follows, inserted + 1)
            found.append((c + 5, "I" + e))
        if i < len(initials):
            c, e = best(i + 1, last, 0)
            found.append((c + 2, "D" + e))
            if faults[i] not in (repair.BLANK, repair.DUPLICATE):
                extra = 5 if faults[i] == repair.TRUNCATED else 0
                for role in {follows} | ({"s"} if last == "" and initials[i] == "s" else set()):
                    c, e = best(i + 1, role, 0)
                    kept = initials[i] == role
                    found.append((c + extra + (0 if kept else 1), ("K" if kept else "R") + e))
        return min(found, default=(10**6, ""))

    return best(0, "", 0)


def test_retained_subsequence_equals_all_edits():
    rng = random.Random(4)
    cases = [("".join(x), f) for n in range(4) for x in itertools.product("sua-", repeat=n) for f in itertools.product(range(4), repeat=n)]
    cases += [("".join(rng.choices("suuaa-", k=n)), tuple(rng.choices(range(4), (6, 1, 1, 2), k=n))) for n in range(4, 30) for _ in range(40)]
    for initials, faults in cases:
        made = repair.Retained(initials, bytes(faults))
        assert (made.cost, "".join(e for e, _ in made.edits())) == plain_repair(initials, faults), (initials, faults)


def plain_report(rows):
    """Counts and repaired rows of one conversation's rows in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        faults.append(1 if not last else 2 if (role, text) in seen else 3 if last not in ".!?" else 0)
        seen.add((role, text))
    first = [r[:1] for _, r, _ in rows]
    cost, audit = plain_repair("".join(x if x and x in "sua" else "-" for x in first), tuple(faults))
    turns = [t for t, _, _ in rows if t is not None]
    kept, i, out = audit.replace("D", ""), iter(rows), []
    shift = 0
    for e in audit:
        row = None if e == "I" else next(i)
        if e == "D":
            continue
        if not out and e == "K" and row[1][:1] == "s":
            shift = 1
            out.append(f"{row[1]}:{row[2]}")
            continue
        role = "user" if (len(out) - shift) % 2 == 0 else "assistant"
        out.append(f"{row[1] if e == 'K' else role}:{'' if row is None else row[2]}")
    assert len(out) == len(kept)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(first))
    return (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()), out


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def by_conversation(rows):
    order = lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest())
    found = {}
    for r in sorted(rows, key=order):
        found.setdefault(r[0], []).append(r[1:])
    return found


def test_op12_hostile_rows(spark):
    rng = random.Random(8)
    texts = [None, "", " \n", "Yes.", "No", "Yes.", "Well!  ", "é?", "long " * 20_000 + "end."]
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, *range(12)]), rng.choice([None, "", "user", "assistant", "system", "tool"]), rng.choice(texts)) for _ in range(700)]
    rows += rows[:40] + [(99, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(3000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, copy int").repartition(5)
    want = {c: plain_report(x)[0] for c, x in by_conversation(plain_damage(rows)).items() if c != 99}
    got = {r.conv_id: tuple(r)[1:] for r in repair.report(df, damage=True).collect()}
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert set(got) == {r[0] for r in rows}
    assert {c: x for c, x in got.items() if c != 99} == {c: want.get(c, empty) for c in got if c != 99}
    assert len(got[99][6]) >= 2700 and got[99][5] < 2700

    said = {c: plain_report(x) for c, x in by_conversation([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c != 99]).items()}
    places = {}
    for r in sorted(repair.repair(df.filter("conv_id is null or conv_id <> 99")).collect(), key=lambda r: r.place):
        places.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert places == {c: out for c, (_, out) in said.items() if out}
    assert repair.report(df.limit(0), damage=True).count() == 0 == repair.repair(df.limit(0)).count()


def test_op12_moves_texts_once(spark):
    df = spark.createDataFrame([(1, 1, "user", "a.")], "conv_id long, turn long, role string, text string")
    plan = repair.report(df, damage=True)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 3 and "SinglePartition" not in plan  # light rows, distinct conversations, all rows


# op13


def plain_words(rows, every=199, letters=6, count=5):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= letters and k >= count}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    of = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, xs in of.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), words[w], len(of[w]), words[form[w]] if form[w] else None) for w in words}


def edited(word, rng, letters):
    i, kind = rng.randrange(len(word)), rng.randrange(3)
    return word[:i] + ["", rng.choice(letters), rng.choice(letters) + word[i]][kind] + word[i + 1 :]


@pytest.mark.parametrize("letters", ["ab", "abé", "abcdefghijklmnopqrstuvwxyzßàÿ×"])
def test_op13_equals_all_pairs(spark, letters):
    """Few letters make the same bigrams stand several times in a word and in nearly all words."""
    rng = random.Random(len(letters))
    words = {"".join(rng.choices(letters, k=rng.randint(6, 14))) for _ in range(150)}
    words |= {edited(w, rng, letters) for w in list(words) for _ in range(2)}
    words |= {edited(w, rng, letters) for w in list(words)}
    words = sorted(w for w in words if len(w) >= 6)
    got = spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string"), Scratch(spark, "test")).collect()
    assert len(got) == len(set(got)) and {frozenset(r) for r in got} == {frozenset(p) for p in itertools.combinations(words, 2) if near(*p)}


def test_op13_hostile_rows(spark):
    rng = random.Random(2)
    rows = [(None, "Colour colour COLOUR colours"), (1, None), (2, ""), (2, "ÀÉÎÕÜß àéîõüß " * 9), (3, "recieve " * 7 + "receive " * 50), (3, "recieve " * 7 + "receive " * 50), (4, "relieve " * 300), (5, "a1b " * 10 + "x" * 4000 + " ")]
    rows += [(k, " ".join(rng.choice(["Planet", "planets", "plannets", "plnets", "colour", "color", "couleur"]) for _ in range(300))) for k in range(6, 60)]
    rows += [(61, "abcdefg " * 6 + "abcdefh " * 60 + "abcdexh " * 600)]
    rows += [(k, "x" * 4000 + " tie-tied-aaaaaa aaaaab aaaaac") for k in range(60, 70)]
    df = spark.createDataFrame([(*r, "n", "w") for r in rows], "doc_id long, text string, n string, word string").repartition(5)
    got = spelling.spelling_variants(df).collect()
    want = plain_variants(plain_words(rows))
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert any(f and f != r for _, f, r, *_ in want), "no chain of two forms"
    assert spelling.spelling_variants(df.limit(0)).count() == 0


def test_op13_short_words(spark):
    rows = [(1, "abab abba aaaa aaab baab abbab aabb " * 2), (2, "abaab bbbb bbba " + "bbbbb aaaaa " * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = spelling.spelling_variants(df, least_letters=4, least_count=1, every=10**9)
    assert {tuple(r) for r in got.collect()} == plain_variants(plain_words(rows, 10**9, 4, 1))
    with pytest.raises(ValueError):
        spelling.spelling_variants(df, least_letters=3)


def test_op13_writes_no_candidates(spark, sf_dir):
    words = spelling.counted_words(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("word")
    plan = spelling.near_pairs(words, Scratch(spark, "test"))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert words.groupBy().agg(F.count("*")).first()[0] > 100
