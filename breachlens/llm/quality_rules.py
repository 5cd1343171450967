"""Quality rules as a short-circuit cascade, ordered by what a sample says each rule rejects per cost."""

import time
from collections.abc import Callable
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, byte_slices, text_groups, window_hashes, word_hashes

#: Rows of the sample from which costs and selectivities are taken.
SAMPLE_ROWS = 256
MIN_WORDS, REPEAT_WINDOW, MOST_REPEATED_PERCENT = 10, 5, 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, bool)
_LETTER[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_LETTER[128:] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_SMALL = np.zeros(256, bool)
_SMALL[97:123] = True
_GAP = b" \t\n\r\x0b\x0c"


class Counts(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int


class Lazy:
    """The same counts of one text, each made when a rule first asks for it."""

    def __init__(self, text: bytes):
        self.text = text

    n_words = cached_property(lambda self: len(self.text.split()))
    word_chars = cached_property(lambda self: _word_chars(self.text))
    n_symbols = cached_property(lambda self: _share(_SYMBOL, self.text))
    n_dup_lines = cached_property(lambda self: _repeated_lines(self.text))
    n_repeat_words = cached_property(lambda self: _repeated_words(word_hashes([self.text])[0]))


class Rule(NamedTuple):
    """``rejects(text bytes, counts)`` says whether the document goes; it asks ``counts`` (``Counts`` or ``Lazy``) for what it needs."""

    name: str
    rejects: Callable[[bytes, Counts], bool]


def base_counts(texts: list[bytes]) -> list[Counts]:
    """The counts of each text; see ``quality``."""
    out = []
    for first, last in text_groups(texts):
        words, counts = word_hashes(texts[first:last])
        ends = np.cumsum(counts)
        for text, begin, end in zip(texts[first:last], ends - counts, ends, strict=True):
            out.append(Counts(int(end - begin), _word_chars(text), _share(_SYMBOL, text), _repeated_lines(text), _repeated_words(words[begin:end])))
    return out


def _word_chars(text):
    solid = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    return int(np.count_nonzero(solid)) - sum(text.count(g) for g in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"))


def _repeated_lines(text):
    seen, repeated = set(), 0
    for line in text.split(b"\n"):
        if line.strip(_GAP):
            if line in seen:
                repeated += 1
            else:
                seen.add(line)
    return repeated


def _repeated_words(words):
    if len(words) <= REPEAT_WINDOW:
        return 0
    windows = window_hashes(words, REPEAT_WINDOW)
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(windows, twice))
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + REPEAT_WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(covered)))


def base_failed(counts: Counts) -> bool:
    return counts.n_words < MIN_WORDS or 100 * counts.n_repeat_words > MOST_REPEATED_PERCENT * counts.n_words


def _share(mask, text):
    return int(np.count_nonzero(mask[np.frombuffer(text, np.uint8)]))


def _shouted(text, counts):
    capital, small = _share(_CAPITAL, text), _share(_SMALL, text)
    return capital > 50 and capital > small


def _no_letters(text, counts):
    return 2 * _share(_LETTER, text) < len(text) - text.count(b" ") - text.count(b"\n")


#: The rules behind the base check: widely published limits, none of which ordinary prose comes near.
RULES = (
    Rule("symbols", lambda text, c: 2 * c.n_symbols > c.n_words),
    Rule("word_length", lambda text, c: not 2 * c.n_words <= c.word_chars <= 15 * c.n_words),
    Rule("repeated_lines", lambda text, c: c.n_dup_lines > 3 and 3 * c.n_dup_lines > text.count(b"\n") + 1),
    Rule("shouted", _shouted),
    Rule("few_letters", _no_letters),
    Rule("exclamations", lambda text, c: 2 * text.count(b"!") > c.n_words),
)


#: The base check as rules of the cascade, for a caller that wants no counts.
BASE_RULES = (
    Rule("few_words", lambda text, c: c.n_words < MIN_WORDS),
    Rule("repeated_words", lambda text, c: 100 * c.n_repeat_words > MOST_REPEATED_PERCENT * c.n_words),
)


def rule_order(texts: list[bytes], rules=RULES, counted: bool = False) -> list[int]:
    """The rules' positions by rejections per second over ``texts``, the best first; ties by position.

    A rule is timed together with the counts it asks for; with ``counted`` without them, over the texts that pass the base check, as
    where all counts are there already. Half a rejection is added to each, so that of rules that reject nothing here the cheapest comes first.
    """
    if counted:
        counts = base_counts(texts)
        texts, counts = [t for t, c in zip(texts, counts, strict=True) if not base_failed(c)], [c for c in counts if not base_failed(c)]
    worth = []
    for position, rule in enumerate(rules):
        measured = list(zip(texts, counts if counted else map(Lazy, texts), strict=True))
        began = time.perf_counter()
        rejected = sum(rule.rejects(text, c) for text, c in measured)
        worth.append((-(rejected + 0.5) / (time.perf_counter() - began + 1e-9), position))
    return [position for _, position in sorted(worth)]


_COUNTED = ", ".join(f"{name} long" for name in Counts._fields) + ", base_failed boolean, kept boolean, rejected_by string"


def verdict(text: bytes, counts: Counts, rules) -> str | None:
    """The first rule of the cascade that rejects; later ones are not run."""
    if base_failed(counts):
        return "base"
    return next((rule.name for rule in rules if rule.rejects(text, counts)), None)


def passes(text: bytes, rules) -> bool:
    """Does no rule reject? What later rules would count is not counted once one has rejected."""
    counts = Lazy(text)
    return not any(rule.rejects(text, counts) for rule in rules)


def _kept(batches, text_at, order, rules):
    ranked = [rules[i] for i in order]
    for batch in byte_slices(batches, text_at):
        yield batch.filter(pa.array([passes(text, ranked) for text in as_bytes(batch.column(text_at))], pa.bool_()))


def _judged(batches, text_at, order, rules):
    ranked = [rules[i] for i in order]
    for batch in byte_slices(batches, text_at):
        texts = as_bytes(batch.column(text_at))
        counts = base_counts(texts)
        found = [verdict(text, c, ranked) for text, c in zip(texts, counts, strict=True)]
        columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(Counts._fields))]
        columns += [pa.array([x == "base" for x in found], pa.bool_()), pa.array([x is None for x in found], pa.bool_()), pa.array(found, pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *Counts._fields, "base_failed", "kept", "rejected_by"])


def sampled_order(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules=RULES, rows: int = SAMPLE_ROWS, counted: bool = False
) -> list[int]:
    """``rule_order`` over the ``rows`` documents whose hashed ids are smallest, measured in a task."""
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("rules")), F.lit(1 << 40)) / float(1 << 40)
    share = 4.0 * rows / max(1, documents.count())  # so few rows pass that sorting them is nothing, whatever the table's size
    near = documents.select(place.alias("_place"), F.col(text_col).alias("_text")).filter(F.col("_place") < share)
    sample = near.orderBy("_place").limit(rows)

    def measure(batches):
        texts = [text for batch in batches for text in as_bytes(batch.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array([rule_order(texts, rules, counted)], pa.list_(pa.int32()))], names=["order"])

    found = sample.select("_text").coalesce(1).mapInArrow(measure, "order array<int>").first()
    return list(found.order) if found else list(range(len(rules)))


def quality(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules=RULES, order: list[int] | None = None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by) per row.

    All counts are made of every document, since they are returned; the rules behind the base check run as a cascade in the sampled order. The verdict does not depend on
    that order, only ``rejected_by`` does. A null or empty text has no words and fails the base check. Rows may repeat;
    other columns are not looked at. An empty table gives no rows.
    """
    if order is None:
        order = sampled_order(documents, id_col=id_col, text_col=text_col, rules=rules, counted=True)
    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        lambda batches: _judged(batches, 1, order, rules), f"doc_id {dict(documents.dtypes)[id_col]}, {_COUNTED}"
    )


def keep_quality(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules=RULES, order: list[int] | None = None) -> DataFrame:
    """The documents that pass the base check and that no rule rejects, with all their columns; nothing is shuffled.

    Here the base check is two rules of the cascade among the others. Each rule makes the counts it needs, its cost on the sample
    includes them, and a document that a rule has rejected is not counted any further. ``order`` is over ``BASE_RULES + rules``.
    """
    rules = (*BASE_RULES, *rules)
    if order is None:
        order = sampled_order(documents, id_col=id_col, text_col=text_col, rules=rules)
    at = documents.columns.index(text_col)
    return documents.mapInArrow(lambda batches: _kept(batches, at, order, rules), documents.schema)
