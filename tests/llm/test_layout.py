"""Periodic runs, packing and ranked search against brute force and the libraries."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from breachlens.llm import packing, ranked, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FILE = public_tokenizers.path("word_bpe_49k.json")
ENCODER, LIBRARY = packing.Encoder(open(FILE, "rb").read()), Tokenizer.from_file(FILE)


# ---- periodic runs -------------------------------------------------------------------------------


def brute_runs(words, least=12):
    """[(start, length, period)]: every stretch of every period, of equal stretches the smallest period."""
    found, n = {}, len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i >= p and j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted((start, length, p) for (start, length), p in found.items())


def collapsed(words, found):
    gone = {i for start, length, p in found for i in range(start + p, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def tiled_runs(codes, least):
    """What the tiles of all octaves give, joined in place of the shuffle."""
    codes, fragments, octave = np.array(codes, np.int32), [], 0
    while 2 << octave <= len(codes):
        shortest = 1 << octave
        core = max(8 * shortest, runs.CORE)
        for first in range(0, len(codes), core):
            low, past = max(0, first - 2 * shortest), min(len(codes), first + core)
            tile = codes[low : min(len(codes), first + core + 4 * shortest)]
            if shortest < runs._FAR:
                some = runs.near_fragments(tile, range(shortest, 2 * shortest))
            else:
                begin = -(-first // shortest) * shortest
                some = runs.far_fragments(tile, shortest, range(begin - low, past - low, shortest))
            fragments += [(p, low + a, low + b) for p, a, b in some]
        octave += 1
    return sorted((a, b - a, p) for p, a, b in runs._joined(fragments) if b - a >= max(least, 2 * p))


@pytest.mark.parametrize("far, gram, core", [(32, 16, 1024), (8, 4, 16), (4, 2, 8)])
def test_tiles_find_every_run(monkeypatch, far, gram, core):
    monkeypatch.setattr(runs, "_FAR", far), monkeypatch.setattr(runs, "_GRAM", gram), monkeypatch.setattr(runs, "CORE", core)
    r = random.Random(core)
    for _ in range(150):
        letters, n = r.choice([1, 2, 3, 5]), r.randint(0, 220)
        codes = [r.randrange(letters) for _ in range(n)]
        if r.random() < 0.7:
            p, a = r.randint(1, n // 3 + 1), r.randrange(n + 1)
            codes = [codes[i] if i < a else codes[a + (i - a) % p] for i in range(n)]
        least = r.choice([12, 4, 2]) if core < 1024 else 12
        assert tiled_runs(codes, least) == brute_runs(codes, least)


@given(st.lists(st.integers(0, 2), max_size=60))
@settings(max_examples=200, deadline=None)
def test_z_values(s):
    wanted = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) if i else 0 for i in range(len(s))]
    assert runs.z_values(s) == wanted


@pytest.fixture(scope="module")
def repetitive():
    r = random.Random(4)
    base = [f"w{r.randrange(400)}" for _ in range(3000)]
    return [
        "", None, " \t\n", "no " * 11, "no " * 12, "a b " * 6 + "c", "x " + "p q r s t u " * 2, "x " + "p q r s t u " * 2 + "p q", " ".join(base),
        " ".join(base[:700] * 2 + base[:30]), "\x0b".join((base[:45] * 9)[:380]) + "\n end", " ".join(["é", "漢"] * 40 + base[:20] + ["é", "漢"] * 40), "no " * 5000, " ".join(base + base),
    ]


@pytest.mark.parametrize("spread", [100_000, 20])
def test_runs_of_documents(spark, monkeypatch, repetitive, spread):
    monkeypatch.setattr(runs, "SPREAD", spread)
    rows = [(i, t, "x", "y") for i, t in enumerate(repetitive)] + [(3, repetitive[4], None, None), (5, repetitive[5], "x", "y"), (None, repetitive[9], None, None), (None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, words string, key string").repartition(3)
    found = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(frame).collect()), key=repr)
    wanted = []
    for identity, text, *_ in rows:
        words = WORD.findall(text or "")
        own = brute_runs(words)
        wanted.append((identity, own, collapsed(words, own)))
    assert found == sorted(wanted, key=repr)


def test_run_query_against_brute_force(spark, repetitive):
    """The whole query on a few documents, the repeated words of one in ten included."""
    rows = [(i, repetitive[i % len(repetitive)]) for i in range(60)] + [(None, "no " * 30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: tuple(r)[1:] for r in runs.digests(runs.periodic_runs(runs.extended(frame))).collect()}
    extended = 0
    for identity, text in rows:
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(identity).encode())
        if identity is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            extended += 1
        own = brute_runs(words)
        best = min(own, key=lambda x: (-x[1], x[0], x[2]), default=None)
        first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{length},{p}\n" for s, length, p in own)
        assert found[identity] == (len(own), *first, *[hashlib.sha256(x.encode()).hexdigest() for x in (lines, collapsed(words, own))])
    assert extended > 2


# ---- packing -------------------------------------------------------------------------------------

TEXT = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n'’.,!²½ßéİŉǅлж漢\x1c\x85\xa0́st<|>AZ09")), max_size=60)


@given(st.lists(st.one_of(TEXT, st.text(st.sampled_from("abcés '"), max_size=200)), max_size=4))
@settings(max_examples=300, deadline=None)
def test_word_ids_are_the_librarys(texts):
    wanted = [np.array(LIBRARY.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert ENCODER.encode_all(texts) == wanted


def test_special_strings_are_as_the_library_has_them():
    texts = ["a <|endoftext|> b", "<|startoftext|>", "don't we'll I'M", "x" * 200, "é" * 40, "İstanbul"]
    assert [np.frombuffer(x, "<u4").tolist() for x in ENCODER.encode_all(texts)] == [LIBRARY.encode(x, add_special_tokens=False).ids for x in texts]


@given(st.lists(st.integers(1, 40), max_size=120))
@settings(max_examples=150, deadline=None)
def test_plans_hold_all_pieces(lengths):
    """Every piece once, no sequence above its room, the bound below the plan and below what is ever possible."""
    counts = np.bincount(lengths, minlength=41)
    plan, bound = packing.planned(counts, 40)
    used = np.zeros(41, int)
    for sequences, inside in plan:
        assert sequences > 0 and sum(n * c for n, c in inside) <= 40
        for n, c in inside:
            used[n] += sequences * c
    assert (used == counts).all()
    total = sum(x for x, _ in plan)
    assert bound <= total + 1e-9 and sum(lengths) / 40 <= bound + 1e-9
    assert total <= -(-11 * math.ceil(bound - 1e-9) // 9) + 1


def test_the_knapsack_answers_for_every_room():
    r = random.Random(1)
    prices = np.full(31, -np.inf)
    for n in (3, 5, 11, 14):
        prices[n] = r.random() * n
    worth, last = packing.priced(prices, 30)
    best = [0.0]
    for room in range(1, 31):
        best.append(max([best[room - 1], *[prices[n] + best[room - n] for n in (3, 5, 11, 14) if n <= room]]))
    assert np.allclose(worth, best)


def test_the_program_does_most_of_the_packing():
    """Many pieces of many lengths: nearly all come from the program, and the plan is within one in a thousand of the bound."""
    r = np.random.default_rng(2)
    counts = np.bincount(np.clip(r.lognormal(4.2, 1.0, 200_000).astype(int), 1, 512), minlength=513)
    fractions, bound = packing.fractional(counts, 512)
    plan, _ = packing.planned(counts, 512)
    assert sum(fractions.values()) > 0.9 * bound
    assert sum(x for x, _ in plan) <= 1.001 * bound + 1


def check_packed(rows, texts, most):
    """Rows of ``packed`` against the library, one by one; the number of sequences."""
    pieces, sequences = Counter(), {}
    for row in rows:
        sequences.setdefault(row.sequence_id, []).append((row.offset, row.length))
        pieces[row.doc_id, row.piece, row.start, row.length, row.ids_crc32] += 1
    for inside in sequences.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= most
    wanted = Counter()
    for identity, text in texts:
        ids = np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for number, at in enumerate(range(0, len(ids), most)):
            part = ids[at : at + most]
            wanted[identity, number, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert pieces == wanted
    return len(sequences)


def test_packing_on_messy_rows(messy):
    texts = [(r.doc_id, r.text) for r in messy.collect()]
    for most in (4096, 64, 7):
        rows = packing.packed(messy, FILE, most=most).collect()
        used = check_packed(rows, texts, most)
        assert used <= 1.02 * sum(r.length for r in rows) / most + 2


def test_packed_ids_can_be_had(spark):
    texts = [(i, f"text number {i} " * (i % 40)) for i in range(120)]
    rows = packing.packed(spark.createDataFrame(texts, "doc_id long, text string"), FILE, most=50, with_ids=True).collect()
    check_packed(rows, texts, 50)
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)


# ---- ranked search -------------------------------------------------------------------------------


def brute_rank(documents, items, k):
    """{item: [(score, doc_id)]}; documents and items are (id, text)."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda text: TERM.findall((text or "").translate(low))
    counted = [(i, Counter(words(t))) for i, t in documents]
    total, n = sum(1 for _, c in counted if c), sum(sum(c.values()) for _, c in counted)
    df = Counter(term for _, c in counted for term in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = {}
    for item, terms in asked.items():
        scores = []
        for identity, c in counted:
            if c:
                m = 50 + (50 * sum(c.values()) * total) // n
                score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
                if score > 0:
                    scores.append((score, identity))
        out[item] = sorted(scores, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
    return {item: rows for item, rows in out.items() if rows}


def found_rank(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (repr(r.item_id), r.rank)):
        out.setdefault(r.item_id, []).append((r.score, r.doc_id))
        assert r.rank == len(out[r.item_id])
    return out


def corpus(seed, n, words=300):
    r = random.Random(seed)
    texts = [" ".join(f"w{int(r.paretovariate(0.7)) % words}" for _ in range(r.randint(0, 60))) for _ in range(n)]
    return [(i, texts[i // 3 * 3] if i % 10 == 0 else texts[i]) for i in range(n)]


@pytest.mark.parametrize("seed, limit", [(20, 5), (2, 5), (100_000, 50)])
def test_ranking_is_brute_forces(spark, monkeypatch, seed, limit):
    """Small slabs, blocks and seeds, so that lists are left out and blocks skipped; items in several passes."""
    monkeypatch.setattr(ranked, "SEED", seed), monkeypatch.setattr(ranked, "PASS", 120)
    documents, items = corpus(1, 400), [(i, t + " Unseen") for i, t in corpus(2, 12)]
    frames = [spark.createDataFrame(x, f"{name} long, text string").repartition(4) for x, name in ((documents, "doc_id"), (items, "item_id"))]
    assert found_rank(ranked.rank(*frames, k=limit)) == brute_rank(documents, items, limit)


def test_ranking_on_messy_rows(spark, messy):
    documents = [(r.doc_id, r.text) for r in messy.collect()]
    items = [(1, "The QUICK brown fox"), (1, "potion"), (2, None), (3, ""), (None, "fox 漢字 l'été"), (4, "nothing-of_this zzz"), (5, "no"), (5, "no")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    assert found_rank(ranked.rank(messy, frame, k=4)) == brute_rank(documents, items, 4)
    assert found_rank(ranked.rank(messy, frame.withColumn("score", frame.text).withColumn("rank", frame.text), k=50)) == brute_rank(documents, items, 50)


def test_blocks_are_skipped_by_exact_bounds_only():
    """For any threshold a slab gives exactly the documents that reach it, and skips a block if and only if its summary does not."""
    r, dimensions = random.Random(5), 40
    rows = [sorted(r.sample(range(1, dimensions + 1), r.randint(1, 8))) for _ in range(200)]
    terms = np.array([t for row in rows for t in row], np.int32)
    gains = np.array([r.randint(1, 1000) for _ in terms], np.int32)
    at = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    own, weights = np.array([2, 5, 7, 11, 30]), np.array([9, 1, 4, 300, 50])
    slab = ranked.build(terms, gains, at, {t: own for t in own.tolist()}, dimensions)
    scores = ranked.dense(terms, gains, at, dimensions)[:, own].astype(np.int64) @ weights
    skipped = []
    for threshold in (1, 200, 5_000, 100_000, 10**9):
        documents, found, passed = ranked.search(slab, own, weights, set(own.tolist()), threshold, dimensions)
        assert documents.tolist() == np.flatnonzero(scores >= threshold).tolist() and (found == scores[documents]).all()
        skipped.append(passed)
    assert skipped[0] == 0 and skipped == sorted(skipped) and skipped[-1] == len(slab.of_block) - 1 > skipped[-2] > 0


def test_lists_left_out_can_not_reach_the_threshold():
    weights, most, df = (np.array([0, *x]) for x in ((1, 2, 3, 10), (5, 5, 5, 5), (9, 9, 9, 0)))
    assert ranked.lists_to_read([1, 2, 3, 4], weights, most, df, 16) == {3}
    assert ranked.lists_to_read([1, 2, 3, 4], weights, most, df, 15) == {2, 3}
    assert ranked.lists_to_read([1, 2, 3, 4], weights, most, df, 1) == {1, 2, 3}


# ---- nothing to work on --------------------------------------------------------------------------


@pytest.mark.parametrize("operator", ["runs", "packing", "ranking", "no items", "no terms"])
def test_no_rows(spark, empty, messy, operator):
    items = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    blank = spark.createDataFrame([(1, "..."), (2, None)], "doc_id long, text string")
    found = {
        "runs": lambda: runs.digests(runs.periodic_runs(runs.extended(empty))),
        "packing": lambda: packing.packed(empty, FILE),
        "ranking": lambda: ranked.rank(empty, items),
        "no items": lambda: ranked.rank(messy, items.limit(0)),
        "no terms": lambda: ranked.rank(blank, items),
    }[operator]()
    assert found.count() == 0
