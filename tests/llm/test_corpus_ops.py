"""SimHash, line dedup, language model, mixing and the pipeline against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from folio.llm import linededup, lm, mixing, quality, simhash
from folio.llm.common import Scratch
from folio.llm.queries import DOMAIN_WEIGHTS, LANG_WEIGHTS, QUERIES

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_print(text, k):
    words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_word_prints(text, count):
    words = set(WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode())))
    words = {w for w in words if len(w) >= 4} or words
    out = []
    for k in range(count):
        sums = [0] * 64
        for w in words:
            x = xxhash.xxh64_intdigest(w, 42)
            if k:
                x ^= 0x9E3779B97F4A7C15 * k % 2**64
                x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
                x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
                x ^= x >> 31
            for b in range(64):
                sums[b] += 1 if x >> b & 1 else -1
        out.append(sum(1 << b for b in range(64) if sums[b] > 0))
    return out


def plain_groups(prints, radius):
    """doc -> smallest doc reachable, where any fingerprint may link."""
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(sorted(prints), 2):
        if any((x ^ y).bit_count() <= radius for x, y in zip(prints[a], prints[b])):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: find(d) for d in prints}


def plain_components(prints, radius):
    """doc -> smallest doc reachable."""
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: find(d) for d in prints}


def test_op7(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {d: plain_print(t, 4) for d, t in docs.items()}
    want = plain_components(prints, 4)
    rows = QUERIES["op7_simhash_near_dedup"](spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {d: (f"{prints[d]:016x}", want[d]) for d in docs}


def test_masks_cover_every_pair():
    for radius in (4, 6):
        masks = [m & (1 << 64) - 1 for m in simhash.masks(radius)]
        assert len(masks) == 2 ** (radius + 1) - 1
        r = random.Random(0)
        for _ in range(3000):
            bits = sum(1 << b for b in r.sample(range(64), r.randint(0, radius)))
            assert any(bits & m == 0 for m in masks)


@pytest.mark.parametrize("block", [2, 5, 2048])
def test_links_of_dense_groups(spark, block):
    """Large buckets in several blocks lose no link."""
    r = random.Random(block)
    centre = r.getrandbits(64)
    values = {centre}
    while len(values) < 60:
        x = r.choice(sorted(values))
        for b in r.sample(range(64), r.randint(1, 5)):
            x ^= 1 << b
        values.add(x)
    values |= {r.getrandbits(64) for _ in range(60)}
    prints = dict(enumerate(r.sample(sorted(values), len(values))))
    df = spark.createDataFrame([(0, v - (1 << 64) if v >> 63 else v, d) for d, v in prints.items()], "which int, fingerprint long, rep long")
    was, simhash.BLOCK = simhash.BLOCK, block
    try:
        scratch = Scratch(spark, "test")
        found = {x.node: x.component for x in simhash.components(simhash.links(df, 4, scratch), scratch).collect()}
    finally:
        simhash.BLOCK = was
    assert {d: found.get(d, d) for d in prints} == plain_components(prints, 4)


def test_neighbours_are_true_links():
    """The first pass links only within a bucket and the radius, and finds a dense bucket whole."""
    r = np.random.default_rng(3)
    centre = np.uint64(0x0123456789ABCDEF)
    dense = np.sort(np.array([centre ^ np.uint64(1 << int(b)) for b in r.permutation(64)[:40]], dtype=np.uint64))
    prints = np.concatenate([dense, r.integers(0, 1 << 63, 30).astype(np.uint64), dense[:1]])
    bucket = np.repeat([1, 2, 3], [40, 30, 1])
    a, b = simhash.neighbours(bucket, prints, 4)
    assert all(bucket[x] == bucket[y] and int(prints[x] ^ prints[y]).bit_count() <= 4 for x, y in zip(a, b, strict=True))
    assert plain_reached({*range(40)}, zip(a.tolist(), b.tolist(), strict=True)) == {*range(40)}
    assert len(simhash.neighbours(bucket[:1], prints[:1], 4)[0]) == 0


def plain_reached(nodes, edges):
    edges, reached = list(edges), {0}
    while more := {y for x, y in edges if x in reached} | {x for x, y in edges if y in reached} - reached:
        if more <= reached:
            break
        reached |= more
    return reached & nodes


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(200, x) for x in range(201, 260)] + [(7, 7), (5, 300), (300, 259)]
    found = {r.node: r.component for r in simhash.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    assert all(found[i] == 100 for i in range(101, 141)) and all(found[x] == 5 for x in [*range(200, 260), 300]) and 7 not in found
    assert simhash.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


def test_near_duplicates_hostile_rows(spark):
    data = [(3, None, 1), (4, "", 1), (5, " \n", 1), (6, "A b", 1), (7, "a  B", 1), (7, "a  B", 1), (8, "w" * 50_000, 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, component_id int")
    assert Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(df, shingle=None, radius=5, count=4).collect())[7, 6] == 2
    assert simhash.near_duplicates(df.limit(0), shingle=None, count=4).count() == 0
    rows = simhash.near_duplicates(df).collect()
    assert Counter((r.doc_id, r.component_id) for r in rows) == Counter({(3, 3): 1, (4, 3): 1, (5, 3): 1, (6, 6): 1, (7, 6): 2, (8, 8): 1})
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def plain_pieces(text, ends):
    """Sentences (or lines and sentences), those over 480 bytes cut after words whose CRC-32 is a multiple of 16."""
    out = []
    for part in filter(None, re.split(ends, text)):
        words = re.findall(rb"^\s+|\S+\s*", part) if len(part) > 480 else [part]
        now = b""
        for k, w in enumerate(words):
            now += w
            if k == len(words) - 1 or w.strip() != w and w.strip() and zlib.crc32(w.strip()) % 16 == 0:
                out.append(now)
                now = b""
    return out


def plain_chunks(text):
    """Bodies whose sum is the text."""
    out, now, last = [], [], 0

    def close():
        if now:
            out.append(b"".join(now))
            now.clear()

    for line in re.findall(rb"[^\n]*\n|[^\n]+", text):
        parts = [line] if len(line) <= 160 else plain_pieces(line, rb"(?<=[.!?] )")
        if len(line) > 160:
            close()
            last = 0
        for part in parts:
            h = xxhash.xxh64_intdigest(part.rstrip())
            rolled = (last * 0x9E3779B97F4A7C15 + h) * 0x9E3779B97F4A7C15 % 2**64
            now.append(part)
            last = h
            if (rolled >> 32) % 3 == 0:
                close()
        if len(line) > 160:
            close()
            last = 0
    close()
    return out


def test_word_fingerprints_find_edited_copies(spark):
    """Copies with two words in a hundred changed are found, strangers aren't."""
    r = random.Random(12)
    data, edited = [], []
    for d in range(60):
        words = [f"word{min(r.randrange(3000), r.randrange(3000))}" for _ in range(r.randint(80, 600))]
        copy = [f"x{r.randrange(10**6)}" if r.random() < 0.02 else w for w in words]
        data += [(2 * d, " ".join(words)), (2 * d + 1, " ".join(copy))]
        edited.append(copy != words)
    rows = {x.doc_id: x.component_id for x in simhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), shingle=None, radius=5, count=4).collect()}
    assert all(rows[2 * d] == 2 * d and rows[2 * d + 1] in (2 * d, 2 * d + 1) for d in range(60))
    assert sum(rows[2 * d + 1] == 2 * d for d in range(60)) >= 54 and sum(edited) > 50


def plain_line_dedup(docs, least_words):
    """doc -> text, by looking chunks up in one dictionary of their bytes. Keys are distinct."""
    parts = {d: plain_chunks(t.encode()) for d, t in docs.items() if t is not None}
    count, first = Counter(), {}
    for d in sorted(parts):
        for k, c in enumerate(parts[d]):
            count[c.rstrip()] += 1
            first.setdefault(c.rstrip(), (d, k))
    out = dict(docs)
    for d in parts:
        mine = parts[d]
        state = ["own" if count[c.rstrip()] < 2 else "first" if first[c.rstrip()] == (d, k) else "again" for k, c in enumerate(mine)]
        text, k, gap = [], 0, []  # gap: pieces that stay, since the last repeated chunk

        def stripped(pieces):
            return [p.rstrip() for p in pieces]

        def shared(a, b):
            n = 0
            for i, (x, y) in enumerate(zip(stripped(a), stripped(b)), 1):
                if x != y:
                    break
                n = i if x else n
            return n

        eaten = 0
        while k < len(mine):
            if state[k] != "again":
                if state[k] == "first":
                    text.append(b"".join(gap) + mine[k])
                    gap = []
                else:
                    gap.append(mine[k])
                k += 1
                continue
            stop = k
            while stop < len(mine) and state[stop] == "again":
                stop += 1
            (fd, fk), (ld, lk) = first[mine[k].rstrip()], first[mine[stop - 1].rstrip()]
            before = plain_pieces(b"".join(gap), rb"(?<=[.!?] )|(?<=\n)")
            left = plain_pieces(b"".join(parts[fd][max(0, fk - 2) : fk]), rb"(?<=[.!?] )|(?<=\n)")
            n = shared(before[::-1], left[::-1])
            after = stop
            while after < len(mine) and state[after] == "own":
                after += 1
            behind = plain_pieces(b"".join(mine[stop:after]), rb"(?<=[.!?] )|(?<=\n)")
            right = plain_pieces(parts[ld][lk + 1], rb"(?<=[.!?] )|(?<=\n)") if lk + 1 < len(parts[ld]) else []
            m = shared(behind, right)
            run = b"".join(before[len(before) - n :] + mine[k:stop] + behind[:m])
            text.append(b"".join(before[: len(before) - n]) + (b"" if len(run.split()) >= least_words else run))
            gap, k = behind[m:], after
        text += gap
        out[d] = b"".join(text).decode()
    return out


def test_op8(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = plain_line_dedup(docs, 40)
    rows = {r.doc_id: r.text for r in QUERIES["op8_line_dedup"](spark, sf_dir).collect()}
    assert rows == want and want != docs


def test_chunks_are_the_text_and_shift_with_it():
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    sentence = lambda: " ".join(r.choices(words, k=r.randint(3, 15))) + ". "
    passage = "".join(sentence() for _ in range(12)).strip().encode()
    inside = []
    for _ in range(8):
        before, after = ("".join(sentence() + r.choice(["\n", ""]) for _ in range(r.randint(0, 6))).encode() for _ in range(2))
        text = before + b"\n" + passage + b"\n" + after
        found = linededup.chunks(text)
        assert b"".join(text[a:b] for a, b, _ in found) == text
        inside.append([text[a:b].rstrip() for a, b, _ in found if len(before) + 1 <= a and b <= len(before) + len(passage) + 2])
    assert all(x == inside[0] and b"".join(w + b" " for w in x).strip() == passage for x in inside)
    for text in (b"", b"\n", b"\n\n\n", b"x" * 100_000, b". " * 500, b"a\n" * 300, b"word other thing more " * 400, b" " * 2000 + b"x " * 900):
        assert b"".join(text[a:b] for a, b, _ in linededup.chunks(text)) == text
        assert [text[a:b] for a, b, _ in linededup.chunks(text)] == plain_chunks(text)


def test_passages_in_other_contexts_go_whole(spark):
    """A passage inside other paragraphs, a paragraph of one sentence, a long stretch without sentence ends."""
    r = random.Random(8)
    sentence = lambda n=0: " ".join(f"w{r.randrange(5000)}" for _ in range(n or r.randint(8, 15))) + "."
    inside, alone, flat = " ".join(sentence() for _ in range(14)), sentence(60), " ".join(f"w{r.randrange(5000)}" for _ in range(300))
    made = lambda d: [f"{sentence()} own{d} {sentence()} {inside} {sentence()} end{d}. {sentence()}", f"{sentence()}\n{alone}\n{sentence()}", f"start{d} {sentence(40)[:-1]} {flat} {sentence(40)}"]
    texts = {(d, k): t for d in range(6) for k, t in enumerate(made(d))}
    df = spark.createDataFrame([(d * 3 + k, t) for (d, k), t in texts.items()], "doc_id long, text string")
    got = {divmod(x.doc_id, 3): x.text for x in linededup.dedup_lines(df).collect()}
    for (d, k), t in texts.items():
        if d == 0:
            assert got[d, k] == t
        elif k == 2:  # up to the first and from the last picked word on
            assert len(got[d, k].split()) < 81 + 2 * 60 and f"start{d}" in got[d, k]
        else:
            assert " ".join(got[d, k].split()) == " ".join(t.replace(inside if k == 0 else alone, " ").split())


def test_extension_leaves_first_occurrences(spark):
    """What is repeated beside a run goes, but for chunks that other documents lean on."""
    r = random.Random(3)
    p, q = (" ".join(f"w{r.randrange(900)}" for _ in range(50)) + "." for _ in range(2))
    texts = [f"{p}\n{p}\n{q}\n{p}", f"{q}\n{p}\n{q}", f"a\n\n{p}\n\nb", f"c\n\n{p}\n\nb\n\nb"]
    got = [x.text for x in linededup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [f"{p}\n{q}\n", "", "a\n\n\nb", "c\n\nb"]


def test_hot_passages_are_salted(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()}
    monkeypatch.setattr(linededup, "HOT", 1 << 40)
    monkeypatch.setattr(linededup, "SALTS", 2)
    assert {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()} == want


def test_line_dedup_hostile_rows(spark):
    passage = " ".join(f"word{i}{'.' if i % 7 == 6 else ''}" for i in range(60)) + "."
    data = [(5, f"intro five\n{passage}\nend five"), (2, f"x\n{passage}"), (9, passage), (None, f"null key\n{passage}"), (7, f"{passage}\n{passage}\nend"), (7, "other row of seven"), (1, None), (3, ""), (4, "short. repeated line."), (6, "short. repeated line."), (2, f"x\n{passage}")]
    df = spark.createDataFrame([(*d, "e", 5) for d in data], "doc_id long, text string, extra string, removed_chars int")
    rows = linededup.dedup_lines(df).collect()
    got = Counter((r.doc_id, r.text) for r in rows)
    assert got == Counter({(5, "intro five\nend five"): 1, (2, f"x\n{passage}"): 2, (9, ""): 1, (None, "null key\n"): 1, (7, "end"): 1, (7, "other row of seven"): 1, (1, None): 1, (3, ""): 1, (4, "short. repeated line."): 1, (6, "short. repeated line."): 1})
    assert all(r.extra == "e" for r in rows)
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_op6_base_and_model(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    tokens = {d: [w for w in WORD.findall((t or "").encode().lower())] + [None] for d, t in docs.items()}
    held = {d for d in docs if zlib.crc32(str(d).encode()) % 5 == 1}
    c = Counter(w for d in docs if d not in held for w in tokens[d])
    n, v = sum(c.values()), len(c)
    for hot in (lm.HOT, 50):
        rows = {r.doc_id: r for r in lm.scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), hot=hot).collect()}
        for d, words in tokens.items():
            r = rows[d]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (d in held, len(words), sum(c[w] > 0 for w in words), n)
            assert r.base_score == pytest.approx(sum(log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), rel=1e-9)
    # the model, with exact counts
    pairs = Counter(p for d in docs if d not in held for p in zip([tokens[d][-1], *tokens[d]], tokens[d]))
    model = base = plain = 0
    for d in held:
        p = [(pairs[h, w] + lm.STRENGTH * (c[w] + 0.5) / (n + 0.5 * (v + 1))) / (c[h] + lm.STRENGTH) for h, w in zip([tokens[d][-1], *tokens[d]], tokens[d])]
        plain += sum(map(log10, p))
        model += rows[d].score
        base += rows[d].base_score
    assert model == pytest.approx(plain, rel=0.02) and model > base


def test_filter_reads_back_levels():
    f = lm.LogFrequencyFilter(1 << 20, 8)
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    counts = rng.integers(1, 2000, 4000)
    q, s = lm.levels(counts), f.slice_of(grams)
    data = np.frombuffer(b"".join(f.enter(grams[s == i], q[s == i]) for i in range(8)), np.uint8)
    got = f.read(data, grams)
    assert (got >= q).all() and (got == q).mean() > 0.9
    assert (f.read(data, rng.integers(0, 1 << 63, 4000).astype(np.uint64)) == 0).mean() > 0.9
    assert (np.abs(lm.typical(q) / counts - 1) < 0.2).all() and lm.typical(np.array([0, 1]))[0] == 0 and lm.typical(np.array([1]))[0] == 1


def test_lm_small_filter_keeps_frequent_grams(spark):
    grams = spark.createDataFrame([(i, 1 if i % 40 else 1000) for i in range(20_000)], "gram long, n long")
    data, least = lm.fit_filter(grams, bits=1 << 18, slices=8)
    assert len(data) == 1 << 15 and least > 1
    f = lm.LogFrequencyFilter(1 << 18, 8)
    got = f.read(np.frombuffer(data, np.uint8), np.arange(0, 20_000, 40).astype(np.uint64))
    assert (got >= lm.levels(np.array([1000]))).all()


def test_lm_filter_grows_with_its_grams(spark):
    for rows in (2_000, 40_000):
        grams = spark.createDataFrame([(i, 1 if i % 40 else 1000) for i in range(rows)], "gram long, n long")
        stored = lm.store_filter(grams, Scratch(spark, "test"), slice_bits=1 << 15)
        want = lm.levels(np.array([1 if i % 40 else 1000 for i in range(rows)]))
        got = stored.read(np.arange(rows).astype(np.uint64))
        assert (got >= want).all() and (got == want).mean() > 0.9
        assert (stored.read(np.arange(10**6, 10**6 + 4000).astype(np.uint64)) == 0).mean() > 0.9
        assert stored.filter.slices >= rows / (1 << 15) * 8


def test_lm_lots_score_alike(spark, sf_dir, monkeypatch):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: r.score for r in lm.scores(df).collect()}
    monkeypatch.setattr(lm, "AT_ONCE", 1000)
    assert {r.doc_id: r.score for r in lm.scores(df).collect()} == pytest.approx(want, rel=1e-9)


def test_lm_hostile_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (1, None, 1), (2, "", 2), (3, "x " * 30_000, 3), (None, "Ab aB\x0bab", 4)], "doc_id long, text string, score int")
    rows = lm.scores(df, held_out=F.lit(False)).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == Counter({(1, 1): 2, (2, 1): 1, (3, 30_001): 1, (None, 4): 1})
    assert all(r.n_known == r.n_tokens and np.isfinite(r.score) for r in rows)
    assert lm.scores(df.limit(0)).count() == 0
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in lm.scores(df, held_out=F.lit(True)).collect())


def fill(children, given):
    """Water-filling by bisection on the level."""
    if sum(room for room, _ in children) <= given:
        return [float(room) for room, _ in children]
    lo, hi = 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(room, mid * w) for room, w in children) < given else (lo, mid)
    return [min(room, lo * w) for room, w in children]


def plain_mix(docs, budget, epochs, weights, seed):
    """docs: (id, path, tokens). Rows (id, epoch)."""
    have = defaultdict(int)
    for _, path, n in docs:
        for i in range(4):
            have[path[:i]] += n
    got = {(): min(budget, have[()] * epochs)}
    for i in range(3):
        for parent in [p for p in have if len(p) == i]:
            kids = sorted(p for p in have if len(p) == i + 1 and p[:i] == parent)
            for kid, g in zip(kids, fill([(have[k] * epochs, weights[i].get(k[i], 1.0)) for k in kids], got[parent]), strict=True):
                got[kid] = g
    out = {}
    for leaf in [p for p in have if len(p) == 3]:
        at = 0
        for e in range(epochs):
            for _, d, n in sorted((hashlib.md5(f"{seed}:{e}:{d}".encode()).hexdigest(), d, n) for d, p, n in docs if p == leaf):
                if at < got[leaf] - 1e-6:
                    out[d, e] = at
                at += n
    return out


def test_op9(spark, sf_dir):
    docs = []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        digit = r.source[-1]
        docs.append((r.doc_id, ("web" if digit in "0123" else "books" if digit in "456" else "code", r.lang, r.source), len(WORD.findall((r.text or "").encode()))))
    want = plain_mix(docs, sum(n for _, _, n in docs), 4, [DOMAIN_WEIGHTS, LANG_WEIGHTS, {}], 5)
    rows = QUERIES["op9_source_mixing"](spark, sf_dir).collect()
    assert {(r.doc_id, r.epoch): r.start_token for r in rows} == want and len(rows) == len(want)


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 1000), ("a", "y", "1", 1000), ("b", "x", "1", 1000), ("b", None, "1", 0)], "d string, l string, s string, t long")
    got = {(r.d, r.l, r.s): round(r.quota, 6) for r in mixing.quotas(leaves, ["d", "l", "s"], "t", 800, 1, {}).collect()}
    # a gets 400, its x 200: leaf 1 has only 10, so its sibling takes 190
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 190, ("a", "y", "1"): 200, ("b", "x", "1"): 400, ("b", None, "1"): 0}


def test_mix_hostile_rows(spark):
    data = [(1, None, "a", None), (2, "", "a", "s"), (2, "", "a", "s"), (3, "w " * 20_000, None, "s"), (4, "one two", None, "s")]
    df = spark.createDataFrame([(*d, 9) for d in data], "doc_id long, text string, lang string, source string, epoch int")
    rows = mixing.mix(df, ["lang", "source"], fraction=1.0, max_epochs=2).collect()
    assert {r.doc_id for r in rows if r.n_tokens} == {3, 4}
    assert mixing.mix(df.limit(0), ["lang", "source"], fraction=1.0).count() == 0


def test_pipeline_stages(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    scratch = Scratch(spark, "test")
    df, stages = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        df = scratch.save(f(spark, df, sf_dir), f"s{k}")
        stages.append(df.collect())
        assert k == 4 or df.columns == corpus_pipeline.COLUMNS
    kept = {r.doc_id for r in quality.verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet")).filter("kept").collect()}
    assert {r.doc_id for r in stages[0]} == kept and all(r == docs[r.doc_id] for r in stages[0])
    texts = plain_line_dedup({r.doc_id: r.text for r in stages[0]}, 40)
    assert {r.doc_id: r.text for r in stages[1]} == texts and all(r.n_chars == len(r.text) for r in stages[1])
    groups = plain_groups({d: plain_word_prints(t, corpus_pipeline.PRINTS) for d, t in texts.items()}, corpus_pipeline.RADIUS)
    assert {r.doc_id for r in stages[2]} == {d for d, g in groups.items() if d == g}
    assert {r.doc_id for r in stages[3]} <= {r.doc_id for r in stages[2]} and 0 < len(stages[3]) < len(stages[2])
    assert {r.doc_id for r in stages[4]} == {r.doc_id for r in stages[3]}
    assert corpus_pipeline.run(spark, sf_dir).count() == len(stages[4])
