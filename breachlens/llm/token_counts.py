"""Token counts of a byte-level vocabulary, by byte-pair merging over a heap and a linked list."""

import functools
import heapq
import json
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The split of the byte-level vocabularies before merging; a fixed, published pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Counts of this many distinct pieces are kept per Python worker.
KEPT = 600_000


class Vocabulary:
    """Merge ranks by pair of symbols, and the strings that are one token wherever they stand.

    Symbols are numbers, bytes first; a pair is ``left << 32 | right`` and ``product[rank]`` is the symbol it becomes.
    """

    def __init__(self, file: bytes):
        described = json.loads(file)
        symbol = {letter: byte for byte, letter in _letters().items()}
        self.ranks, self.product = {}, []
        for rank, pair in enumerate(described["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(symbol[left] << 32 | symbol[right], rank)
            self.product.append(symbol.setdefault(left + right, len(symbol)))
        added = sorted((x["content"] for x in described["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.counts = _Counts(self)

    def count(self, text: str) -> int:
        parts, total = [text], 0
        if self.added is not None and self.added.search(text):
            total = len(self.added.findall(text))
            parts = self.added.split(text)
        if len(self.counts) > KEPT:
            self.counts.clear()
        return total + sum(sum(map(self.counts.__getitem__, pieces(part))) for part in parts)


def _letters():
    """How byte-level vocabularies write a byte: printable Latin-1 as itself, the others as the code points from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


# The same pattern with its classes written out for texts without a character from U+0250 on; re is twice as fast.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", r" \t-\r\x85\xa0"
_WESTERN = re.compile(r"[\x00-\u024f]*").fullmatch
_SPLIT_WESTERN = re.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{_S}{_L}{_N}]").replace(r"\p{L}", f"[{_L}]").replace(r"\p{N}", f"[{_N}]").replace(r"\s+(?!\S)", f"[{_S}]+(?![^{_S}])").replace(r"\s", f"[{_S}]")).findall
_SPLIT = regex.compile(PATTERN).findall


def pieces(text: str) -> list[str]:
    """The pieces of a text that merges do not cross."""
    return _SPLIT_WESTERN(text) if _WESTERN(text) else _SPLIT(text)


class _Counts(dict):
    def __init__(self, vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, piece):
        count = self[piece] = merged_count(piece.encode(), self.vocabulary.ranks, self.vocabulary.product)
        return count


def merged_count(piece: bytes, ranks: dict, product: list) -> int:
    """Symbols left when adjacent pairs of lowest rank, leftmost first, are merged until none has a rank.

    Symbols form a linked list over their first positions. The heap holds ``rank << 32 | position``; an entry is passed over if
    the pair that begins there has another rank by now. The count is the number of bytes less one per merge.
    """
    n, rank_of = len(piece), ranks.get
    symbols, live, heap = list(piece), [-1] * n, []
    for i in range(n - 1):
        rank = rank_of(symbols[i] << 32 | symbols[i + 1])
        if rank is not None:
            live[i] = rank
            heap.append(rank << 32 | i)
    if not heap:
        return n
    heapq.heapify(heap)
    after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
    while heap:
        entry = heapq.heappop(heap)
        i, rank = entry & 0xFFFFFFFF, entry >> 32
        if live[i] != rank:
            continue
        j = after[i]
        merged = symbols[i] = product[rank]
        live[i] = live[j] = -1
        merges += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            rank = rank_of(merged << 32 | symbols[k])
            if rank is not None:
                live[i] = rank
                heapq.heappush(heap, rank << 32 | i)
        h = before[i]
        if h >= 0:
            rank = rank_of(symbols[h] << 32 | merged)
            live[h] = -1
            if rank is not None:
                live[h] = rank
                heapq.heappush(heap, rank << 32 | h)
    return n - merges


@functools.lru_cache(maxsize=2)
def _vocabulary(file: bytes) -> Vocabulary:
    return Vocabulary(file)


def token_counts(documents: DataFrame, vocabulary: str, *, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row, as the library would count with the vocabulary file at that path.

    Whole texts are counted, without begin, end or padding; the vocabulary's own special strings inside a text are one
    token each. A null text counts as empty and has no tokens. Ids are passed on as they are, null or repeated; other
    columns are not looked at. An empty table gives no rows. The file, of fixed size, is read once and sent to the tasks.
    """
    with open(vocabulary, "rb") as handle:
        file = documents.sparkSession.sparkContext.broadcast(handle.read())

    def count(batches):
        known = _vocabulary(file.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = [known.count(text) if text else 0 for text in texts]
            sizes = [len(text.encode()) if text else 0 for text in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    schema = f"doc_id {dict(documents.dtypes)[id_col]}, n_bytes long, n_tokens long, over_limit boolean"
    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, schema)
