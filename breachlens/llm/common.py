"""What several operators here share: word and shingle hashes in numpy, hash order, sampling, skew-safe attachment."""

import ctypes
import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space of the contracts, as a Java and a Python pattern; every other character belongs to a word.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text worked on at a time inside a task; each needs about 40 bytes of arrays.
WINDOW = 1 << 20

_U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ANY_SPACE = re.compile(rb"[\x09-\x0D\x20]")
_random = np.random.default_rng(20240607)
_BYTE = _random.integers(0, 2**63, 256, dtype=_U64) * _U64(2) + _U64(1)
_STEP = _U64(0x9E3779B97F4A7C15)
_MIX = _U64(0xFF51AFD7ED558CCD)
_PLACE = _random.integers(0, 2**63, 64, dtype=_U64) * _U64(2) + _U64(1)
_powers = np.ones(1, _U64)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    values = (values ^ (values >> _U64(33))) * _MIX
    return values ^ (values >> _U64(29))


def _steps(longest: int) -> np.ndarray:
    global _powers
    if len(_powers) < longest:
        _powers = np.concatenate([np.ones(1, _U64), np.multiply.accumulate(np.full(2 * longest, _STEP, _U64))])
    return _powers


def _windows(texts):
    """Lists of (text number, bytes) of about ``WINDOW`` bytes; a longer text is cut where white space stands."""
    held, size = [], 0
    for number, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > WINDOW:
                gap = _ANY_SPACE.search(text, at + WINDOW)
                end = gap.start() if gap else end
            held.append((number, text[at:end]))
            size += end - at
            at = end
            if size >= WINDOW:
                yield held
                held, size = [], 0
    if held:
        yield held


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word in order, and the number of words of each text.

    Words are runs of bytes other than space and \\x09-\\x0D. ``lower`` folds A-Z.
    """
    hashes, counts = [], np.zeros(len(texts), np.int64)
    for held in _windows(texts):
        data = np.frombuffer(b" " + b" ".join(t for _, t in held) + b" ", np.uint8)
        gap = _SPACE[data]
        turns = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        starts, ends = turns[0::2], turns[1::2]
        if not len(starts):
            continue
        lengths = ends - starts
        first = np.cumsum(lengths) - lengths
        letters = data[~gap]
        if lower:
            letters = _LOWER[letters]
        place = np.arange(len(letters)) - np.repeat(first, lengths)
        hashes.append(mixed(np.add.reduceat(_BYTE[letters] * _steps(int(lengths.max()))[place], first)))
        begins = np.cumsum([1] + [len(t) + 1 for _, t in held])
        per_window = np.diff(np.searchsorted(starts, begins))
        np.add.at(counts, [n for n, _ in held], per_window)
    return (np.concatenate(hashes) if hashes else np.empty(0, _U64)), counts


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` words; of the whole sequence when it is shorter and not empty."""
    n = len(words)
    if n == 0:
        return words
    if n < width:
        return mixed((words * _PLACE[:n]).sum(dtype=_U64, keepdims=True) + _PLACE[32 + n])
    total = words[: n - width + 1] * _PLACE[0]
    for k in range(1, width):
        total += words[k : n - width + 1 + k] * _PLACE[k]
    return mixed(total)


def text_groups(texts: list[bytes], most: int = 4 * WINDOW):
    """(first, past the last) index of runs of texts of at most ``most`` bytes together, or of one longer text."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > most:
            yield first, i
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def byte_slices(batches, at: int, most: int = 4 * WINDOW):
    """The batches cut to at most ``most`` bytes of the text column ``at`` (or one longer text), so that what a task holds of them is bounded.

    When a task has seen all of them it gives the memory it no longer uses back to the machine, since its process is kept for later stages.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first, before = 0, 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(first, last - first)
            first, before = last, int(ends[last - 1])
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Kept(dict):
    """What ``make`` gives for a key, kept in two generations of about ``most`` bytes each; a key that is asked for again stays."""

    def __init__(self, make, most: int):
        self.make, self.most, self.size, self.older = make, most, 0, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        return self._keep(key, value)

    def unknown(self, keys) -> list:
        """Those of ``keys`` for which nothing is kept."""
        return [key for key in keys if key not in self and key not in self.older]

    def put(self, found):
        for key, value in found:
            self._keep(key, value)

    def _keep(self, key, value):
        self.size += len(key) + 220  # the two objects and their place in the table
        if self.size > self.most:
            self.older, self.size = dict(self), 0
            self.clear()
        self[key] = value
        return value


def ragged_rows(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A matrix with a row of ``values`` for each of ``sizes``, filled up with -1, one place wider than the longest."""
    rows = np.full((len(sizes), int(sizes.max(initial=0)) + 1), -1)
    rows[np.arange(rows.shape[1]) < sizes[:, None]] = values
    return rows


class Merges:
    """Merging of adjacent symbols in many short rows at once, from ``{left << 32 | right: (order, symbol)}``.

    Every row has an agenda, the orders of its adjacent pairs. In each step every row merges its pair of least order, the leftmost of
    equals; a row without a pair is done.
    """

    _BITS, _NONE = 20, 1 << 40

    def __init__(self, made: dict):
        self.keys = np.array([-1, *sorted(made)], np.int64)
        self.values = np.array([self._NONE, *[made[key][0] << self._BITS | made[key][1] for key in self.keys[1:].tolist()]], np.int64)

    def _pairs(self, left, right):
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.values[at], self._NONE)

    def run(self, symbols: np.ndarray):
        """(row, symbols left as little-endian unsigned 32-bit integers); rows as of ``ragged_rows``."""
        rows, places = np.arange(len(symbols)), np.arange(symbols.shape[1])
        agenda = np.full(symbols.shape, self._NONE)
        agenda[:, :-1] = self._pairs(symbols[:, :-1], symbols[:, 1:])
        while len(rows):
            best = (agenda >> self._BITS).argmin(axis=1)
            every = np.arange(len(rows))
            merged = agenda[every, best]
            done = merged == self._NONE
            if done.any():
                lines = symbols[done]
                used = lines >= 0
                packed, begin = lines[used].astype("<u4").tobytes(), 0
                for row, end in zip(rows[done].tolist(), (4 * used.sum(axis=1).cumsum()).tolist(), strict=True):
                    yield row, packed[begin:end]
                    begin = end
                rows, symbols, agenda, best, merged = (x[~done] for x in (rows, symbols, agenda, best, merged))
                every = np.arange(len(rows))
            # The symbol behind the pair's first goes, and all behind it move up.
            move = np.minimum(places + (places > best[:, None]), places[-1])
            symbols, agenda = np.take_along_axis(symbols, move, 1), np.take_along_axis(agenda, move, 1)
            symbols[every, best] = merged = merged & ((1 << self._BITS) - 1)
            agenda[every, best] = self._pairs(merged, symbols[every, np.minimum(best + 1, places[-1])])
            before = np.maximum(best - 1, 0)
            agenda[every, before] = np.where(best > 0, self._pairs(symbols[every, before], merged), agenda[every, before])


def as_bytes(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def held_out(doc_id) -> Column:
    """Rows that no model may learn from: crc32 of the id's text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def bounded_sample(rows: DataFrame, label: str, identity: str, per_label: int, most: int) -> DataFrame:
    """About ``per_label`` rows of each label, ``most`` in all: those whose hashed identity is smallest.

    One count per label sets a threshold on the hash, so no label is gathered in one task. Where the labels' rows are more than
    ``most`` together, the first row of every label goes before any second one and so on: labels with few rows keep them all, the
    others share what is left evenly. Only of more than ``most`` labels some have none. Same rows at every run.
    """
    place = (F.pmod(F.xxhash64(F.col(identity).cast("string"), F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)).alias("_place")
    shares = rows.groupBy(label).agg((F.lit(float(per_label)) / F.count("*")).alias("_share"))
    picked = rows.select("*", place).join(shares, rows[label].eqNullSafe(shares[label]), "left_outer").drop(shares[label])
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_place", identity))
    ranked = picked.filter("_place < _share").withColumn("_rank", rank)
    return ranked.orderBy("_rank", "_place", identity).limit(most).drop("_place", "_share", "_rank")


def attach(rows: DataFrame, groups: DataFrame, key: str, spread: str, lanes: int = 64) -> DataFrame:
    """Inner join of ``rows`` to ``groups`` (one row per key) that holds when one key owns a large share of the rows.

    Rows are first reduced to the (key, lane) pairs that occur, the groups are joined to those, and the rows are joined on
    both columns; ``spread`` (an id) chooses a row's lane, so a hot key is dealt to ``lanes`` tasks.
    """
    laned = rows.withColumn("_lane", F.pmod(F.xxhash64(spread), F.lit(lanes)).cast("int"))
    pairs = laned.select(key, "_lane").distinct().join(groups, key)
    return laned.join(pairs, [key, "_lane"]).drop("_lane")
