"""Operators on single texts against brute force, the libraries, or held-out rows."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from breachlens.llm import language, quality_model, quality_rules
from breachlens.llm.common import bounded_sample
from breachlens.llm.pieces import CHECK_EVERY, Pieces, _checked, encoded
from breachlens.llm.token_counts import Vocabulary, token_counts

DATA = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTES, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
VOCABULARY, PIECES = Vocabulary(open(BYTES, "rb").read()), Pieces(open(MODEL, "rb").read())
LIBRARY, SPM = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=MODEL)
TEXT = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n'’.,!²½ßéλж漢▁\xa0​st<|>")), max_size=60)


def brute_counts(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)} if len(windows) < 3000 else set()
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@given(st.lists(st.text(st.sampled_from("ab é#\n\t|"), max_size=50), max_size=4))
@settings(max_examples=150, deadline=None)
def test_counts(texts):
    assert [tuple(c) for c in quality_rules.base_counts([t.encode() for t in texts])] == [brute_counts(t) for t in texts]


def test_quality_rules_on_messy_rows(messy):
    found = quality_rules.quality(messy).collect()
    assert len(found) == messy.count()
    for row, text in zip(sorted(found, key=lambda r: (r.doc_id or -1, r.n_words)), [r.text or "" for r in sorted(messy.collect(), key=lambda r: (r.doc_id or -1, len(WORD.findall(r.text or ""))))], strict=True):
        if len(text) < 100_000:
            assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == brute_counts(text)
        assert row.base_failed == (row.n_words < 10 or 100 * row.n_repeat_words > 20 * row.n_words)
        assert row.kept == (row.rejected_by is None) and (not row.base_failed or row.rejected_by == "base")
    kept = quality_rules.keep_quality(messy)
    assert kept.columns == messy.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in found if r.kept)


def test_the_order_of_rules_changes_no_verdict(messy):
    orders = [list(range(len(quality_rules.RULES))), list(range(len(quality_rules.RULES)))[::-1]]
    a, b = ({(r.doc_id, r.n_words): r.kept for r in quality_rules.quality(messy, order=o).collect()} for o in orders)
    assert a == b


def test_rules_rejecting_most_for_least_come_first():
    rare = quality_rules.Rule("rare", lambda text, c: sum(range(20_000)) < 0)
    often = quality_rules.Rule("often", lambda text, c: True)
    texts = [f"some words that stand for text number {i} and go on for a while".encode() for i in range(30)]
    assert quality_rules.rule_order(texts, (rare, often)) == [1, 0]


@pytest.mark.parametrize("operator", ["rules", "tokens", "pieces", "language", "model"])
def test_no_rows(spark, empty, operator):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = {
        "rules": lambda: quality_rules.quality(empty),
        "tokens": lambda: token_counts(empty, BYTES),
        "pieces": lambda: encoded(empty, MODEL, keep=True),
        "language": lambda: language.languages(empty),
        "model": lambda: quality_model.quality_scores(empty, labels),
    }[operator]()
    assert found.count() == 0


@given(st.one_of(TEXT, st.text(alphabet="ab", max_size=300)))
@settings(max_examples=400, deadline=None)
def test_token_counts_are_the_librarys(text):
    assert VOCABULARY.count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_token_counts_on_messy_rows(messy):
    found = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(messy, BYTES).collect()}
    wanted = set()
    for r in messy.collect():
        n = len(LIBRARY.encode(r.text or "", add_special_tokens=False).ids)
        wanted.add((r.doc_id, len((r.text or "").encode()), n, n > 1024))
    assert found == wanted


@given(st.one_of(TEXT, st.text(alphabet="the \n", max_size=300)))
@settings(max_examples=400, deadline=None)
def test_pieces_are_the_librarys(text):
    packed = PIECES.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == SPM.encode(text, add_bos=True, add_eos=True)
    assert PIECES.decode(packed).decode() == SPM.decode(SPM.encode(text, add_bos=True, add_eos=True))


def test_pieces_on_messy_rows(messy):
    for r in encoded(messy, MODEL, keep=True, check_every=1).collect():
        ids = SPM.encode(r.text or "", add_bos=True, add_eos=True)
        assert r.ids == ids and r.n_tokens == len(ids) and r.agrees and r.decoded == SPM.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
    assert {r.agrees for r in encoded(messy, MODEL, check_every=0).collect()} == {None}


def test_every_row_is_compared_with_the_library(spark):
    texts = [f"text number {i}" for i in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert {r.agrees for r in encoded(rows, MODEL).collect()} == {True}
    ids = [PIECES.encode(x) for x in texts]
    back = [PIECES.decode(x) for x in ids]
    ids[38] += ids[38][-4:]
    with pytest.raises(ValueError, match=r"1 of 40 .*\[38\]"):
        _checked(PIECES, range(40), texts, ids, back, CHECK_EVERY)


def test_quality_model_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    scores = quality_model.quality_scores(spark.read.parquet(f"{DATA}/documents.parquet"), labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for r in scores)
    held = [r for r in scores if r.held_out]
    assert sum(r.predicted == r.quality for r in held) >= 0.93 * len(held)


def test_quality_model_on_messy_rows(spark, messy):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, 1, 0), (7, None, 0), (None, 1, 0), (40, 0, 1), (99999, 0, 0)], "doc_id long, quality int, toxic int")
    found = quality_model.quality_scores(messy, labels).collect()
    assert len(found) == messy.count() and all(0 <= r.score <= 1 for r in found)
    none = quality_model.quality_scores(messy, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = language.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in found) >= 0.97 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_on_messy_rows(messy):
    found = {(r.doc_id, r.lang_pred, r.score > 0) for r in language.languages(messy).collect()}
    text = {r.doc_id: r.text for r in messy.collect()}
    for identity, lang, sure in found:
        lettered = any(x.isalpha() for x in text[identity] or "") if identity is not None else sure
        assert (lang == "und") == (not lettered) and sure == lettered


def test_sample_keeps_rare_labels(spark):
    """Ten labels, nine of 4,000 to 12,000 rows and one of 60, of which 8,000 rows are taken; what fits whole is the sample as it was."""
    sizes = {f"l{n}": 4_000 + 1_000 * n for n in range(9)} | {"rare": 60}
    rows = spark.createDataFrame([(f"{label}-{i}", label) for label, size in sizes.items() for i in range(size)], "_id string, lang string")
    found = [tuple(r) for r in bounded_sample(rows, "lang", "_id", 1500, 8000).collect()]
    taken = {label: sum(x == label for _, x in found) for label in sizes}
    assert len(set(found)) == 8000 and taken["rare"] == 60
    assert all(abs(taken[label] - 7940 / 9) < 1 for label in sizes if label != "rare")
    four = bounded_sample(rows.filter("lang in ('l1', 'l2', 'l3', 'rare')"), "lang", "_id", 1500, 8000)
    assert four.filter("lang = 'rare'").count() == 60 and 4_200 < four.count() < 4_900


@pytest.mark.parametrize("n", [1, 2, 3, 5, 9, 40])
def test_codewords_differ(n):
    code = language.codewords(n)
    assert len(code) == n == len({tuple(x) for x in code})
    if n > 5:
        assert min((code[a] != code[b]).sum() for a in range(n) for b in range(a)) >= code.shape[1] // 5


def test_a_rejected_text_is_counted_no_further(messy):
    """``keep_quality`` keeps what ``quality`` keeps, in any order of its rules; rules behind a rejection ask for nothing."""
    asked = []
    spy = quality_rules.Rule("spy", lambda text, c: asked.append(text) or False)
    short, long = b"too few words", " ".join(f"word{i} stands here" for i in range(9)).encode()
    assert not quality_rules.passes(short, [*quality_rules.BASE_RULES, spy]) and asked == []
    assert quality_rules.passes(long, [*quality_rules.BASE_RULES, spy]) and asked == [long]
    lazy = quality_rules.Lazy(long)
    assert quality_rules.BASE_RULES[0].rejects(long, lazy) is False and "n_repeat_words" not in lazy.__dict__
    n = len(quality_rules.BASE_RULES + quality_rules.RULES)
    wanted = sorted(r.doc_id or -1 for r in quality_rules.quality(messy).filter("kept").collect())
    for order in (list(range(n)), list(range(n))[::-1]):
        assert sorted(r.doc_id or -1 for r in quality_rules.keep_quality(messy, order=order).collect()) == wanted


def test_rules_are_timed_with_the_counts_they_need():
    """Of two rules that reject nothing, the one that hashes every word comes after the one that looks for a mark."""
    texts = [" ".join(f"w{i}x{j}" for j in range(3000)).encode() for i in range(10)]
    both = (quality_rules.BASE_RULES[1], quality_rules.RULES[-1])
    assert quality_rules.rule_order(texts, both) == [1, 0]
