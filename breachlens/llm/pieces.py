"""SentencePiece encoding and decoding for merge-type vocabularies, by an agenda of adjacent symbol pairs."""

import functools
import hashlib
import heapq
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Kept, Merges, byte_slices, ragged_rows

#: Bytes of chunks and their ids kept per Python worker and generation.
KEPT = 48 << 20
#: Chunks up to this length that are not known yet are encoded many at once.
SHORT = 24
#: Of the rows of an Arrow batch, one in so many is compared with the library: each.
CHECK_EVERY = 1
#: The visible space of the vocabularies.
SPACE = "▁"


class Pieces:
    """Symbols, and what two adjacent ones become: ``made[left << 32 | right] = (order, symbol)``, the best score first.

    The library's own processor gives the pieces and is the judge in ``agrees``; it does none of the encoding.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        known = range(self.library.get_piece_size())
        normal = [i for i in known if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i))]
        ids = {self.library.id_to_piece(i): i for i in normal}
        letters = {x for piece in ids for x in piece}
        # A symbol below ``first_letter`` is a piece's id; letters that are no piece, or that no piece has, come behind.
        self.symbol = ids | {x: len(known) + n for n, x in enumerate(sorted(letters - ids.keys()))}
        self.first_letter = len(known)
        order = {score: n for n, score in enumerate(sorted({self.library.get_score(i) for i in normal}, reverse=True))}
        self.made = {}
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                left, right = self.symbol.get(piece[:cut]), self.symbol.get(piece[cut:])
                if left is not None and right is not None:
                    self.made[left << 32 | right] = (order[self.library.get_score(i)], i)
        self.byte_ids = {self.library.piece_to_id(f"<0x{b:02X}>"): b for b in range(256)}
        self.of_byte = {b: i for i, b in self.byte_ids.items()}
        written = [self._written(i) for i in known]
        self.letters_of = np.frombuffer(b"".join(written), np.uint8)
        self.width_of = np.array([len(x) for x in written], np.int64)
        self.begin_of = np.cumsum(self.width_of) - self.width_of
        self.chunks = _cutter(ids)
        self.ids = Kept(lambda chunk: _packed(chunk_ids(chunk.replace(" ", SPACE), self)), KEPT)
        self.agendas = _Agendas(self)
        self.begin, self.end = _packed([self.library.bos_id()]), _packed([self.library.eos_id()])

    def _written(self, i):
        if i in self.byte_ids:
            return bytes([self.byte_ids[i]])
        if self.library.is_control(i):
            return b""
        if self.library.is_unknown(i):
            return " ⁇ ".encode()
        return self.library.id_to_piece(i).replace(SPACE, " ").encode()

    def encode(self, text: str) -> bytes:
        """The ids, with begin and end, as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """``encode`` for each text; chunks that are not known yet are encoded together."""
        cut = [self.chunks(text) if text else [] for text in texts]
        self.ids.put(self.agendas.ids(self.ids.unknown(set().union(*cut))))
        known = self.ids.__getitem__
        return [self.begin + b"".join(map(known, chunks)) + self.end for chunks in cut]

    def decode(self, packed: bytes) -> bytes:
        """The text of ids, in UTF-8: the space put in front goes, byte pieces are put together."""
        return self.decode_all([packed])[0]

    def decode_all(self, packed: list[bytes]) -> list[bytes]:
        """``decode`` for each row of ids."""
        ids = np.frombuffer(b"".join(packed), "<u4")
        widths = self.width_of[ids]
        ends = np.concatenate([[0], np.cumsum(widths)])
        text = self.letters_of[np.repeat(self.begin_of[ids] - ends[:-1], widths) + np.arange(ends[-1])].tobytes()
        cuts = ends[np.cumsum([0, *[len(x) // 4 for x in packed]])].tolist()
        return [text[a + 1 : b] if text[a:b][:1] == b" " else text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def agrees(self, texts: list[str], encoded: list[bytes], decoded: list[bytes]) -> list[bool]:
        """Does the library give the same ids and texts?"""
        theirs = self.library.encode(texts, add_bos=True, add_eos=True, num_threads=1)
        back = self.library.decode(theirs, num_threads=1) if theirs else []
        return [_packed(ids) == mine and text.encode() == own for ids, mine, text, own in zip(theirs, encoded, back, decoded, strict=True)]


def _cutter(known):
    """A function that cuts a text where no piece goes across, so that merges of the whole text are those of its chunks.

    Which characters stand next to each other inside pieces is read off the vocabulary. Where it allows, a chunk is
    spaces, then marks, then letters; letters behind which a mark occurs in a piece make a text be cut at spaces only.
    Texts without a character from U+0250 on are cut by a pattern that is several times as fast as the general one.
    """
    beside = {pair for piece in known for pair in zip(piece, piece[1:], strict=False)}
    letters = {x for pair in beside for x in pair if x.isalnum()}
    marks = {x for piece in known for x in piece if not x.isalnum() and x != SPACE}
    glued = {x for x in letters if any((x, mark) in beside for mark in marks)}
    if any(right == SPACE and left != SPACE for left, right in beside):
        return lambda text: [" " + text]
    line = "" if any("\n" in piece for piece in known) else "\n"

    def pattern(space, marks):
        mark = "".join(map(re.escape, sorted(marks)))
        ends = f"|{line}+" if line else ""
        return re.compile(f"{space}*[{mark}]*[^{space}{mark}{line}]+|{space}+[{mark}]*|[{mark}]+{ends}").findall

    coarse = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
    fine = pattern(SPACE, marks)
    quick = pattern(" ", {x for x in marks if x < "\u0250"})
    has_glue = re.compile("[" + "".join(map(re.escape, sorted(glued))) + "]").search if glued else lambda text: None
    western = re.compile(r"[\x00-\u024f]*").fullmatch

    def cut(text):
        if has_glue(text):
            return coarse(SPACE + text.replace(" ", SPACE))
        return quick(" " + text) if western(text) else fine(SPACE + text.replace(" ", SPACE))

    return cut


def _packed(ids) -> bytes:
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


def chunk_ids(chunk: str, pieces: Pieces) -> list[int]:
    """Merge the adjacent pair of best score, leftmost first, until no pair is a piece; what is no piece is given as bytes.

    The agenda holds ``order << 32 | position``; symbols form a linked list over their first positions. An entry is passed over
    if the pair that begins there has another order by now.
    """
    n, made = len(chunk), pieces.made.get
    symbols = [pieces.symbol.get(x, -1) for x in chunk]
    if n == 1 or -1 in symbols:
        # A letter in no piece merges with nothing.
        if n == 1:
            return [symbols[0]] if 0 <= symbols[0] < pieces.first_letter else [pieces.of_byte[b] for b in chunk.encode()]
        at = symbols.index(-1)
        parts = (chunk[:at], chunk[at], chunk[at + 1 :])
        return [i for part in parts if part for i in chunk_ids(part, pieces)] if n < 64 else _long_ids(chunk, symbols, pieces)
    live, agenda = [-1] * n, []
    for i in range(n - 1):
        pair = made(symbols[i] << 32 | symbols[i + 1])
        if pair is not None:
            live[i] = pair[0]
            agenda.append(pair[0] << 32 | i)
    heapq.heapify(agenda)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while agenda:
        entry = heapq.heappop(agenda)
        i = entry & 0xFFFFFFFF
        if live[i] != entry >> 32:
            continue
        j = after[i]
        merged = symbols[i] = made(symbols[i] << 32 | symbols[j])[1]
        live[i] = live[j] = symbols[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            pair = made(merged << 32 | symbols[k])
            if pair is not None:
                live[i] = pair[0]
                heapq.heappush(agenda, pair[0] << 32 | i)
        h = before[i]
        if h >= 0:
            pair = made(symbols[h] << 32 | merged)
            live[h] = -1
            if pair is not None:
                live[h] = pair[0]
                heapq.heappush(agenda, pair[0] << 32 | h)
    ids, i = [], 0
    while i < n:
        if symbols[i] < pieces.first_letter:
            ids.append(symbols[i])
        else:  # a letter that only occurs inside pieces
            ids.extend(pieces.of_byte[b] for b in chunk[i].encode())
        i = after[i]
    return ids


class _Agendas:
    """``chunk_ids`` for many short chunks at once; a chunk with a letter that is no piece, or in no piece, is left to ``chunk_ids``."""

    def __init__(self, pieces: "Pieces"):
        self.merges = Merges(pieces.made)
        letters = {ord(x): i for x, i in pieces.symbol.items() if len(x) == 1 and i < pieces.first_letter}
        self.letters = np.array(sorted(letters), np.int64)
        self.symbols = np.array([letters[x] for x in sorted(letters)], np.int64)

    def ids(self, chunks: list[str]):
        """(chunk, packed ids) of the chunks this can do."""
        for least, most in ((2, 6), (7, 11), (12, SHORT)):
            some = [x for x in chunks if least <= len(x) <= most]
            for first in range(0, len(some), 4096):
                yield from self._some(some[first : first + 4096])

    def _some(self, chunks):
        sizes = np.array([len(x) for x in chunks])
        points = np.frombuffer("".join(chunks).replace(" ", SPACE).encode("utf-32-le"), "<u4").astype(np.int64)
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        symbols = ragged_rows(np.where(self.letters[at] == points, self.symbols[at], -1), sizes)
        fit = np.flatnonzero((symbols >= 0).sum(axis=1) == sizes)
        for row, ids in self.merges.run(symbols[fit]):
            yield chunks[fit[row]], ids


def _long_ids(chunk, symbols, pieces):
    """``chunk_ids`` for a chunk cut at every letter that is in no piece."""
    ids, begin = [], 0
    for at, symbol in enumerate(symbols):
        if symbol == -1:
            if at > begin:
                ids.extend(chunk_ids(chunk[begin:at], pieces))
            ids.extend(pieces.of_byte[b] for b in chunk[at].encode())
            begin = at + 1
    return ids + (chunk_ids(chunk[begin:], pieces) if begin < len(chunk) else [])


def _checked(pieces, names, texts, ids, back, every):
    """What ``agrees`` says of each row; rows the library encodes or decodes otherwise are an error that gives their ``names``."""
    found = [None] * len(texts)
    if every:
        found[::every] = pieces.agrees(texts[::every], ids[::every], back[::every])
    if False in found:
        wrong = [name for name, same in zip(names, found, strict=True) if same is False]
        raise ValueError(f"{len(wrong)} of {len(texts)} rows differ from the sentencepiece library, the first ids: {wrong[:5]}")
    return found


def _lists(packed: list[bytes]) -> pa.Array:
    """Packed ids as an Arrow column of lists, without a Python number for each."""
    offsets = array("i", [0])
    for ids in packed:
        offsets.append(offsets[-1] + len(ids) // 4)
    values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(packed))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


@functools.lru_cache(maxsize=2)
def _pieces(model: bytes) -> Pieces:
    return Pieces(model)


_NEW = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string", "agrees": "boolean"}


def encoded(
    documents: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", check_every: int = CHECK_EVERY, keep: bool = False, columns=tuple(_NEW)
) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded, ids_sha256, decoded_sha256, agrees) per row; with ``keep`` behind all columns of ``documents``.

    Of the new columns those named in ``columns`` are made.

    Whole texts are encoded with the model file at that path, with begin and end ids, and decoded again. ``ids_sha256`` is over the ids
    as little-endian unsigned 32-bit integers, ``decoded_sha256`` over the text in UTF-8. In each
    batch the first of every ``check_every`` rows is compared with the library (0: none); ``agrees`` is null for the others. A row that differs
    is an error, so none goes out. A null text counts as empty: begin and end only. Ids of rows are
    passed on, null or repeated; with ``keep``, columns of ``documents`` that have one of the new names are left out.
    An empty table gives no rows. The model, of fixed size, is read once and sent to the tasks.
    """
    with open(model, "rb") as handle:
        file = documents.sparkSession.sparkContext.broadcast(handle.read())
    names = list(columns)
    new = ", ".join(f"{name} {_NEW[name]}" for name in names)
    if keep:
        rows = documents.select(*[F.col(f"`{c}`") for c in documents.columns if c not in names])
    else:
        rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        text_col = "text"
    at, name_at = rows.columns.index(text_col), rows.columns.index(id_col if keep else "doc_id")
    kept = [f for f in rows.schema.fields if keep or f.name == "doc_id"]
    kept_at = [rows.columns.index(f.name) for f in kept]
    all_names = [*[f.name for f in kept], *names]

    def encode(batches):
        pieces = _pieces(file.value)
        for batch in byte_slices(batches, at, 1 << 20):
            texts = [x or "" for x in batch.column(at).to_pylist()]
            ids = pieces.encode_all(texts)
            back = pieces.decode_all(ids)
            agrees = _checked(pieces, batch.column(name_at).to_pylist(), texts, ids, back, check_every)
            make = {
                "n_tokens": lambda ids=ids: pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids": lambda ids=ids: _lists(ids),
                "decoded": lambda back=back: pa.array(back, pa.binary()).cast(pa.string()),
                "ids_sha256": lambda ids=ids: pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                "decoded_sha256": lambda back=back: pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
                "agrees": lambda agrees=agrees: pa.array(agrees, pa.bool_()),
            }
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept_at], *[make[name]() for name in names]], names=all_names)

    return rows.mapInArrow(encode, StructType([*kept, *StructType.fromDDL(new).fields]))
