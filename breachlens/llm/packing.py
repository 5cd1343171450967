"""Packing of documents into sequences: a configuration linear program over the length histogram, rounded, the rest best fit."""

import functools
import json
import os
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ids import with_dense_ids
from ..session import staged
from .common import Kept, Merges, byte_slices, ragged_rows
from .token_counts import _L, _N, _S, _letters

#: Tokens of a sequence, and the id that closes a document.
MOST, END = 4096, 1
#: Bytes of words and their ids kept per Python worker and generation, and the longest word (in bytes) that is merged here.
KEPT, SHORT = 128 << 20, 32
#: Rounds of the weights, how strongly a round changes them, how far below the best a configuration may be worth to be taken, and a step of it.
ROUNDS, RATE, SLACK, NEAR = 16, 0.002, 0.004, 1e-4
_NOTHING = 1e-9
#: Share of the tokens that may be left to the rounding and the best fit.
LEFT = 0.002

# ---- ids -----------------------------------------------------------------------------------------

# The split of the vocabularies with word ends, which is looked for in the file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]

_WESTERN = re.compile(r"[\x00-\u024f]*").fullmatch
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+").findall


class Encoder:
    """Ids of texts as the tokenizers library gives them, as little-endian unsigned 32-bit integers.

    Where the file describes the known split of lower-cased words, a word's ids do not depend on its neighbours, so each distinct word
    is encoded once: by the file's merges, many short words together; longer ones by the library. Texts with characters from U+0250 on or with an added
    token, and all texts of other files, are given to the library whole.
    """

    def __init__(self, file: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        described = json.loads(file)
        self.library = Tokenizer.from_str(file.decode())
        self.library.no_truncation()
        self.library.no_padding()
        split = (described.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_words = (
            split[0].get("pattern") == {"Regex": PATTERN}
            and [x.get("type") for x in split[1:]] == ["ByteLevel"]
            and not (split[1].get("use_regex", True) or split[1].get("add_prefix_space", True))
            and (described.get("normalizer") or {}).get("normalizers") == NORMALIZERS
            and not any(x["normalized"] for x in described["added_tokens"])
        )
        model = described["model"]
        self.by_words &= model["end_of_word_suffix"] == "</w>" and not (model["dropout"] or model["ignore_merges"] or model["continuing_subword_prefix"])
        if self.by_words:
            pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
            known = model["vocab"]
            self.merges = Merges({known[a] << 32 | known[b]: (rank, known[a + b]) for rank, (a, b) in reversed(list(enumerate(pairs)))})
            letters = _letters()
            self.inner = np.array([known[letters[b]] for b in range(256)])
            self.last = np.array([known[letters[b] + "</w>"] for b in range(256)])
        added = [re.escape(x["content"]) for x in described["added_tokens"]]
        self.added = re.compile("|".join(added)).search if added else lambda text: None
        self.kept = Kept(lambda word: self._whole([word])[0], KEPT)

    def _whole(self, texts):
        return [np.array(x.ids, "<u4").tobytes() for x in self.library.encode_batch(texts, add_special_tokens=False)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        words = [self._words(text) for text in texts]
        new = self.kept.unknown(set().union(*filter(None, words)))
        for least, most in ((0, 6), (6, 11), (11, SHORT)):
            some = [x for x in new if least < len(x.encode()) <= most]
            for first in range(0, len(some), 4096):
                self.kept.put(self._merged(some[first : first + 4096]))
        known = self.kept.__getitem__
        return [self._whole([text])[0] if found is None else b"".join(map(known, found)) for text, found in zip(texts, words, strict=True)]

    def _merged(self, words):
        bytes_of = [x.encode() for x in words]
        sizes = np.array([len(x) for x in bytes_of])
        data = np.frombuffer(b"".join(bytes_of), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[data[ends]]
        return ((words[row], ids) for row, ids in self.merges.run(ragged_rows(symbols, sizes)))

    def _words(self, text):
        if not self.by_words or self.added(text):
            return None
        lowered = text.lower()
        return _SPLIT(lowered) if _WESTERN(lowered) else None


@functools.lru_cache(maxsize=2)
def _encoder(file: bytes) -> Encoder:
    return Encoder(file)


def _pieces(file, most, end, with_ids):
    def cut(batches):
        encoder, closing = _encoder(file.value), np.array([end], "<u4").tobytes()
        for batch in byte_slices(batches, 1, 1 << 20):
            rows, numbers, starts, lengths, sums, ids = [], [], [], [], [], []
            for row, packed in enumerate(encoder.encode_all([x or "" for x in batch.column(1).to_pylist()])):
                packed += closing
                for number, at in enumerate(range(0, len(packed), 4 * most)):
                    piece = packed[at : at + 4 * most]
                    rows.append(row)
                    numbers.append(number)
                    starts.append(at // 4)
                    lengths.append(len(piece) // 4)
                    sums.append(zlib.crc32(piece))
                    if with_ids:
                        ids.append(np.frombuffer(piece, "<i4"))
            columns = [
                batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()),
                pa.array(lengths, pa.int64()), pa.array(sums, pa.int64()),
            ]
            columns += [pa.array(ids, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return cut


# ---- the plan: numbers of lengths only -------------------------------------------------------------


def priced(prices: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For every room up to ``most`` the greatest worth of lengths that fit into it, and a length that is last among them (0: one place stays empty).

    ``prices[n]`` is what a length of n is worth, minus infinity for those that are not there; each may be taken as often as it fits.
    """
    worth, last = np.zeros(most + 1), np.zeros(most + 1, np.int64)
    backwards = prices[::-1].copy()  # so both parts of a sum are read in the same direction
    for room in range(1, most + 1):
        sums = backwards[most - room : most] + worth[:room]
        at = int(sums.argmax())
        if sums[at] > worth[room - 1]:
            worth[room], last[room] = sums[at], room - at
        else:
            worth[room] = worth[room - 1]
    return worth, last


def _filled(first, prices, worth, last, share):
    """A configuration with the length ``first`` that is worth nearly the most, as {length: times}, or None.

    It is read off the dynamic program from the full sequence down; of the lengths that go on with the greatest worth (within ``NEAR``) the one
    of which the greatest share is not covered yet is taken. Without any, there is none.
    """
    found, room = {first: 1}, len(worth) - 1 - first
    while room:
        if not last[room]:
            room -= 1
            continue
        sums = prices[1 : room + 1] + worth[:room][::-1]
        open_ = np.where(sums >= worth[room] - NEAR, share[1 : room + 1], -1.0)
        length = int(open_.argmax()) + 1
        if open_[length - 1] <= 0:
            return None
        found[length] = found.get(length, 0) + 1
        room -= length
    return found


def fractional(counts: np.ndarray, most: int, rounds: int = ROUNDS) -> tuple[dict, float]:
    """({configuration: how often}, a lower bound on the number of sequences) for ``counts[n]`` pieces of length n.

    The program asks for the least number of sequences so that every length is covered; a configuration is a set of lengths that
    fit into one sequence, given as ((length, times), ...). Prices start as the lengths. Each round solves the knapsack for the prices by dynamic programming,
    which answers for every length at once what goes best beside it; of these configurations those worth nearly the best are taken, as often
    as the least covered of their lengths allows. Prices are then multiplied up where much of a length is left.
    Any prices bound the program from below by what all pieces are worth, divided by the best configuration's worth.
    """
    sizes = np.flatnonzero(counts)
    if not len(sizes):
        return {}, 0.0
    whole = np.maximum(counts, 1).astype(float)
    left = counts.astype(float)
    total, taken, bound = float((sizes * whole[sizes]).sum()), {}, 0.0
    weight = np.ones(most + 1)
    for _ in range(rounds):
        prices = np.where(counts > 0, np.arange(most + 1) / most * weight, -np.inf)
        worth, last = priced(prices, most)
        bound = max(bound, float((prices[sizes] * whole[sizes]).sum() / worth[most]))
        gone = (left < _NOTHING) & (counts > 0)
        if gone.any():  # what has nothing left is no longer offered; the bound is over all lengths
            prices[gone] = -np.inf
            worth, last = priced(prices, most)
        share, used = left / whole, 0
        for value, n in sorted(((prices[n] + worth[most - n], n) for n in sizes.tolist() if not gone[n]), reverse=True):
            if value < (1 - SLACK) * worth[most]:
                break
            found = _filled(n, prices, worth, last, share) if left[n] >= _NOTHING else None
            if found is None:
                continue
            times = min(left[k] / c for k, c in found.items())
            configuration = tuple(sorted(found.items(), reverse=True))
            taken[configuration] = taken.get(configuration, 0.0) + times
            for k, c in found.items():
                left[k] = left[k] - times * c
                share[k] = left[k] / whole[k] if left[k] >= _NOTHING else -1.0
            used += 1
        if not used or (left * np.arange(most + 1)).sum() <= LEFT * total:
            break
        weight *= np.exp(RATE * left / whole)
        weight /= weight.max()
    return taken, bound


def best_fit(counts: dict, most: int) -> list:
    """[(how many sequences, ((length, times), ...))] by best fit, the longest first, over all pieces of one length at a time."""
    free, groups, full = [], {}, []

    def put(room, sequences, inside):
        if room == 0:
            full.append((sequences, inside))
            return
        if room not in groups:
            groups[room] = []
            insort(free, room)
        groups[room].append((sequences, inside))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(free, length)
            if at < len(free):
                room = free[at]
                sequences, inside = groups[room].pop()
                if not groups[room]:
                    del groups[room], free[at]
            else:
                room, inside = most, ()
                sequences = -(-n // (most // length))
            each = room // length
            filled = min(sequences, n // each)
            if filled:
                put(room - each * length, filled, (*inside, (length, each)))
                n -= filled * each
            if n and filled < sequences:
                put(room - n * length, 1, (*inside, (length, n)))
                filled, n = filled + 1, 0
            if filled < sequences and inside:
                put(room, sequences - filled, inside)
    return full + [group for room in free for group in groups[room]]


def planned(counts: np.ndarray, most: int = MOST) -> tuple[list, float]:
    """([(how many sequences, ((length, times), ...))], the lower bound): the program's solution rounded to the nearest whole numbers
    that the pieces allow, and the best fit of what that leaves. The work depends on ``most``, not on how many pieces there are."""
    fractions, bound = fractional(counts, most)
    left = {int(n): int(counts[n]) for n in np.flatnonzero(counts)}
    plan = []
    for configuration, share in sorted(fractions.items(), key=lambda x: (-x[1], x[0])):
        times = min(int(share + 0.5), *(left[n] // c for n, c in configuration))
        if times > 0:
            plan.append((times, configuration))
            for n, c in configuration:
                left[n] -= times * c
    return plan + best_fit({n: c for n, c in left.items() if c}, most), bound


def places(plan: list, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where the pieces go, by their place in the order of the lengths: (first place, length, times, first sequence, offset) of each stretch of places."""
    next_place = np.cumsum(counts) - counts
    rows, sequence = [], 0
    for sequences, inside in plan:
        offset = 0
        for length, times in inside:
            rows.append((int(next_place[length]), length, times, sequence, offset))
            next_place[length] += sequences * times
            offset += times * length
        sequence += sequences
    rows.sort()
    return tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else tuple(np.empty(0, np.int64) for _ in range(5))


# ---- the operator ----------------------------------------------------------------------------------


def packed(
    documents: DataFrame, vocabulary: str, *, most: int = MOST, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece, and its ``ids`` where asked for.

    A document is its ids with the vocabulary file at that path and the closing id; one of more than ``most`` is cut, the last piece may be shorter.
    Pieces of one sequence follow each other without a gap from offset 0. The plan comes from the number of pieces of each length, at most
    ``most`` numbers, which are all that the driver sees. Pieces are numbered in the order of their lengths by range partitions, so
    a length that a third of the rows have is spread over tasks, and a piece's number alone says where it goes. Without ``with_ids`` only the numbers
    are shuffled, never ids. Null and empty texts are the closing id alone. Rows may repeat, ids may be null. An empty table gives no rows.
    """
    if most < 1:
        raise ValueError("a sequence has at least one token")
    with open(vocabulary, "rb") as handle:
        file = documents.sparkSession.sparkContext.broadcast(handle.read())
    kind = dict(documents.dtypes)[id_col]
    ids = ", ids array<int>" if with_ids else ""
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long{ids}"
    texts = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    pieces = staged(texts.mapInArrow(_pieces(file, most, end, with_ids), schema), "pack-pieces")
    counts = np.zeros(most + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``most`` rows
        counts[row["length"]] = row["count"]
    plan, _ = planned(counts, most)
    table = documents.sparkSession.sparkContext.broadcast(places(plan, counts))
    numbered = with_dense_ids(pieces, ["length", "doc_id", "piece", "ids_crc32"], 0, "_place")

    def place(batches):
        first, length, times, sequence, offset = table.value
        for batch in batches:
            at = batch.column("_place").to_numpy()
            row = np.searchsorted(first, at, "right") - 1
            inside = at - first[row]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in range(batch.num_columns - 1)],
                    pa.array(sequence[row] + inside // times[row]),
                    pa.array(offset[row] + inside % times[row] * length[row]),
                ],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    return numbered.select(*pieces.columns, "_place").mapInArrow(place, f"{schema}, sequence_id long, offset long")
