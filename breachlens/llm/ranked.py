"""Ranked lexical search over blocks of posting lists: documents alike stand together, blocks are skipped by exact bounds."""

import heapq
import math
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import staged
from .common import as_bytes, byte_slices

#: Terms are runs of characters other than ASCII ones that are no letter and no digit; A-Z are folded.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Fixed values of the score: see ``rank``.
SCALE, GAIN, SLOPE, BASE, LENGTH = 1000, 1_000_000_000, 20, 50, 50
#: Postings of an item's rarest terms whose documents give the first threshold.
SEED = 5_000
#: Documents of a slab of the index (fewer where there are very many terms), and postings of a block.
SLAB, BLOCK = 1024, 16
#: Hyperplanes of the code by which documents are laid out.
PLANES = 16
#: (item, term) pairs answered in one pass over the index.
PASS = 200_000

_CELLS = 4 << 20
_VECTOR = "n long, terms array<int>, tfs array<int>"


class Asked(NamedTuple):
    """The items of one pass, in numbers: the terms of each, and what holds for a term over all documents."""

    items: list  # ids
    terms_of: list  # per item the numbers of its terms, ascending
    vocabulary: dict  # term -> number
    weights: np.ndarray
    most: np.ndarray  # greatest impact of each term
    df: np.ndarray


def _lists(values: np.ndarray, sizes) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _rows(column) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of an Arrow column of lists."""
    sizes = np.array([len(x) for x in column], np.int64) if len(column) else np.empty(0, np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


# ---- vectors ---------------------------------------------------------------------------------------


def _vectors(vocabulary):
    find = re.compile(TERM.encode()).findall

    def vectors(batches):
        number = vocabulary.value.get
        for batch in byte_slices(batches, 1):
            n, terms, tfs, sizes = [], [], [], []
            for text in as_bytes(batch.column(1)):
                found = find(text.lower())
                n.append(len(found))
                counted = Counter(filter(None, map(number, found)))  # numbers begin with 1
                own = sorted(counted)
                terms += own
                tfs += map(counted.__getitem__, own)
                sizes.append(len(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), _lists(np.array(terms, np.int32), sizes), _lists(np.array(tfs, np.int32), sizes)],
                names=["doc_id", "n", "terms", "tfs"],
            )

    return vectors


def impacts(tfs, lengths):
    """What an occurrence count gives before the term's weight: ``GAIN * tf div (SCALE * tf + SLOPE * m)``, 64-bit."""
    return (GAIN * tfs) // (SCALE * tfs + SLOPE * lengths)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


# ---- the index -------------------------------------------------------------------------------------


def _coded(asked, dimensions):
    """Adds to (doc_id, m, terms, tfs) the impacts and the side of each hyperplane on which the weighted vector lies."""
    planes = np.random.default_rng(11).standard_normal((dimensions + 1, PLANES)).astype(np.float32)

    def coded(batches):
        weights = asked.value.weights
        for batch in batches:
            terms, at = _rows(batch.column(2))
            tfs, _ = _rows(batch.column(3))
            m = np.repeat(batch.column(1).to_numpy(), np.diff(at))
            gains = impacts(tfs.astype(np.int64), m)
            codes = np.zeros(batch.num_rows, np.int64)
            for row in range(batch.num_rows):
                own = slice(at[row], at[row + 1])
                sides = (weights[terms[own]] * gains[own]).astype(np.float32) @ planes[terms[own]] > 0
                codes[row] = int(np.packbits(sides).view(">u2")[0]) if len(sides) else 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(codes), batch.column(2), _lists(gains.astype(np.int32), np.diff(at))], names=["doc_id", "code", "terms", "gains"]
            )

    return coded


class Slab(NamedTuple):
    """Documents that are alike, the posting lists among them cut into blocks, and each block's summary.

    Document i has the gains ``gains[at[i]:at[i + 1]]`` for ``terms[...]``. List l is of the term ``lists[l]`` and has the blocks from ``of_list[l]`` to
    ``of_list[l + 1]``; block b has the documents ``members[of_block[b]:of_block[b + 1]]`` and the greatest gains ``maxima[of_summary[b]:of_summary[b + 1]]``
    for the terms ``coordinates[...]``.
    """

    terms: np.ndarray
    gains: np.ndarray
    at: np.ndarray
    lists: np.ndarray
    of_list: np.ndarray
    members: np.ndarray
    of_block: np.ndarray
    coordinates: np.ndarray
    maxima: np.ndarray
    of_summary: np.ndarray


def dense(terms, gains, at, dimensions) -> np.ndarray:
    table = np.zeros((len(at) - 1, dimensions + 1), np.int32)
    table[np.repeat(np.arange(len(at) - 1), np.diff(at)), terms] = gains
    return table


def build(terms, gains, at, beside: dict, dimensions: int) -> Slab:
    """The slab of documents given in the order of their codes.

    ``beside`` has the terms whose lists are blocked, each with the coordinates its summaries need: the terms of all items that read the list.
    A block holds up to ``BLOCK`` postings that follow each other in that order, so they are alike; its summary is the maximum of their gains in every coordinate.
    """
    table = dense(terms, gains, at, dimensions)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.argsort(terms, kind="stable")
    present, first = np.unique(terms[order], return_index=True)
    ends = [*first[1:].tolist(), len(order)]
    lists, of_list, members, of_block, coordinates, maxima, of_summary = [], [0], [], [0], [], [], [0]
    for term, begin, end in zip(present.tolist(), first.tolist(), ends, strict=True):
        columns = beside.get(term)
        if columns is None:
            continue
        rows = owner[order[begin:end]]
        starts = np.arange(0, len(rows), BLOCK)
        summary = np.maximum.reduceat(table[rows[:, None], columns], starts, axis=0)
        block, column = np.nonzero(summary)
        coordinates.append(columns[column])
        maxima.append(summary[block, column])
        of_summary += (of_summary[-1] + np.cumsum(np.bincount(block, minlength=len(starts)))).tolist()
        members.append(rows)
        of_block += (of_block[-1] + np.append(starts[1:], len(rows))).tolist()
        lists.append(term)
        of_list.append(of_list[-1] + len(starts))
    flat = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
    numbers = [terms, gains, at, lists, of_list, flat(members), of_block, flat(coordinates), flat(maxima), of_summary]
    return Slab(*[np.asarray(x, np.int32) for x in numbers])


def _index(beside, dimensions, kind):
    schema = pa.schema([("ids", pa.list_(kind)), *[(name, pa.list_(pa.int32())) for name in Slab._fields]])

    def index(batches):
        columns = {term: np.array(x) for term, x in beside.value.items()}
        size = max(16, min(SLAB, _CELLS // (dimensions + 1)))
        for whole in batches:
            for first in range(0, whole.num_rows, size):
                batch = whole.slice(first, size)
                terms, at = _rows(batch.column(2))
                gains, _ = _rows(batch.column(3))
                slab = build(terms, gains, at, columns, dimensions)
                arrays = [pa.array([batch.column(0).to_pylist()], schema.field(0).type), *[pa.array([x], pa.list_(pa.int32())) for x in slab]]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return index


# ---- search ----------------------------------------------------------------------------------------


def search(slab: Slab, terms: np.ndarray, weights: np.ndarray, read: set, threshold: int, dimensions: int, table=None) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, blocks skipped) of a slab: all documents of the lists in ``read`` with a score of at least ``threshold`` and above 0.

    A block's bound is what a document would score that had the greatest gain of the block in every term. It is skipped if, and only
    if, that is below the threshold; documents of the other blocks are scored in full.
    """
    factor = np.zeros(dimensions + 1, np.int64)
    factor[terms] = weights
    found, skipped = [], 0
    for number in np.flatnonzero(np.isin(slab.lists, list(read))).tolist():
        first, last = int(slab.of_list[number]), int(slab.of_list[number + 1])
        begin, end = int(slab.of_summary[first]), int(slab.of_summary[last])
        bounds = np.add.reduceat(slab.maxima[begin:end] * factor[slab.coordinates[begin:end]], slab.of_summary[first:last] - begin)
        keep = np.flatnonzero(bounds >= threshold) + first
        skipped += last - first - len(keep)
        found += [slab.members[slab.of_block[b] : slab.of_block[b + 1]] for b in keep.tolist()]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), skipped
    documents = np.unique(np.concatenate(found)).astype(np.int64)
    table = dense(slab.terms, slab.gains, slab.at, dimensions) if table is None else table
    scores = table[documents[:, None], terms].astype(np.int64) @ weights
    good = (scores >= threshold) & (scores > 0)
    return documents[good], scores[good], skipped


class _Best:
    """The ``k`` best (score, doc_id) of an item that a task has met; equal scores by ascending doc_id, null last."""

    def __init__(self, k, threshold):
        self.k, self.least, self.rows = k, threshold, []

    def add(self, ids, scores):
        self.rows += zip(scores, ids, strict=True)
        if len(self.rows) > 4 * self.k:
            self.cut()

    def cut(self):
        self.rows = heapq.nsmallest(self.k, self.rows, key=lambda x: (-x[0], x[1] is None, 0 if x[1] is None else x[1]))
        if len(self.rows) == self.k:
            self.least = max(self.least, self.rows[-1][0])


def _search(asked, reads, k, item_kind, doc_kind):
    def run(batches):
        pass_, (read, thresholds) = asked.value, reads.value
        dimensions = len(pass_.vocabulary)
        best = [_Best(k, threshold) for threshold in thresholds]
        terms_of = [np.array(x, np.int64) for x in pass_.terms_of]
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column(0)[row].as_py()
                slab = Slab(*[batch.column(i + 1)[row].values.to_numpy(zero_copy_only=False) for i in range(len(Slab._fields))])
                table = dense(slab.terms, slab.gains, slab.at, dimensions)
                held = set(slab.lists.tolist())
                for item, own in enumerate(best):
                    lists = read[item] & held
                    if lists:
                        terms = terms_of[item]
                        documents, scores, _ = search(slab, terms, pass_.weights[terms], lists, own.least, dimensions, table)
                        own.add([ids[i] for i in documents.tolist()], scores.tolist())
        rows = []
        for item, own in enumerate(best):
            own.cut()
            rows += [(pass_.items[item], doc, score) for score, doc in own.rows]
        columns = zip(*rows, strict=True) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(x), t) for x, t in zip(columns, (item_kind, doc_kind, pa.int64()), strict=True)], names=["item_id", "doc_id", "score"]
        )

    return run


def _seeds(asked, k):
    """(item, score): of the documents with one of an item's rarest terms the ``k`` best of each task."""

    def seeds(batches):
        pass_ = asked.value
        dimensions = len(pass_.vocabulary)
        chosen, best = [], [[] for _ in pass_.items]
        for terms in pass_.terms_of:
            rare = sorted((t for t in terms if pass_.df[t]), key=lambda t: (pass_.df[t], t))
            enough = np.searchsorted(np.cumsum([pass_.df[t] for t in rare]), SEED) + 1 if rare else 0
            chosen.append(rare[:enough])
        size = max(16, min(SLAB, _CELLS // (dimensions + 1)))
        for whole in batches:
            for first in range(0, whole.num_rows, size):
                batch = whole.slice(first, size)
                terms, at = _rows(batch.column(2))
                tfs, _ = _rows(batch.column(3))
                table = dense(terms, impacts(tfs.astype(np.int64), np.repeat(batch.column(1).to_numpy(), np.diff(at))), at, dimensions)
                for item, own in enumerate(pass_.terms_of):
                    rows = np.flatnonzero((table[:, chosen[item]] > 0).any(axis=1)) if chosen[item] else []
                    if len(rows):
                        scores = table[rows][:, own].astype(np.int64) @ pass_.weights[own]
                        best[item] = heapq.nlargest(k, [*best[item], *scores.tolist()])
        rows = [(item, score) for item, scores in enumerate(best) for score in scores]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64()) for i in range(2)], names=["item", "score"])

    return seeds


def lists_to_read(terms: list, weights, most, df, threshold: int) -> set:
    """The terms whose lists an item has to read: the rest together can't give a document the threshold.

    Terms are left out by ascending greatest contribution while the sum stays below the threshold, so a document
    that is in none of the lists read scores less than it.
    """
    total, read = 0, set()
    for contribution, term in sorted((int(weights[t]) * int(most[t]), t) for t in terms if df[t]):
        total += contribution
        if total >= threshold:
            read.add(term)
    return read


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term), once each."""
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))
    return items.select(F.col(id_col).alias("item_id"), F.explode(F.array_distinct(found)).alias("term")).distinct()


def rank(
    documents: DataFrame, items: DataFrame, *, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item its ``k`` best documents with a score above 0, equal scores by ascending doc_id.

    N counts documents with a term, L their terms, n a document's terms, df a term's documents, tf its occurrences in one. A term weighs
    ``floor(1000 * ln((2 N + 2) / (2 df + 1)))``; a document has ``m = 100 - 50 + 50 n N div L``; its score is the sum over the item's
    terms, once each, of ``weight * (1000000000 tf div (1000 tf + 20 m))``, in 64-bit integers.

    1. Each document is counted once over the items' terms and stored; statistics are aggregates of that.
    2. Documents with an item's rarest terms are scored in full; the k-th best score is a threshold that the result can't fall below.
    3. Documents are laid out by the sides of random hyperplanes on which their vectors lie, so that like ones stand together, in slabs of bounded size.
       In a slab each posting list is cut into blocks with their summaries: the index, stored as a table.
    4. Slabs are searched where they lie: lists that can't matter are not read, blocks are skipped only by their exact bound, and the threshold
       rises with what a task finds. A task gives at most ``k`` rows per item.
    Nothing but a document's own row of numbers is ever shuffled, so no term, however frequent, is gathered anywhere. Items are the query set: they are answered in
    passes of about ``PASS`` (item, term) pairs, which is what the driver and each task hold of them.
    Null and empty texts have no terms: such documents are not counted and such items have no rows. Of several rows with one item id the terms count together;
    rows that repeat a doc_id are documents of their own, a null id comes last among equals. No items, or no documents with a term, give no rows.
    """
    spark = documents.sparkSession
    item_type, doc_type = items.schema[item_col].dataType, documents.schema[id_col].dataType
    kinds = f"item_id {item_type.simpleString()}, doc_id {doc_type.simpleString()}, score long"
    pairs = staged(item_terms(items, item_col, item_text), "rank-items")
    passes = max(1, -(-pairs.count() // PASS))
    numbered = pairs.withColumn("_pass", F.pmod(F.xxhash64("item_id"), F.lit(passes)))
    texts = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = spark.createDataFrame([], kinds)
    for number in range(passes):
        rows = numbered.filter(F.col("_pass") == number).select("item_id", "term").collect() if pairs.count() else []
        part = _one_pass(texts, rows, k, kinds, to_arrow_type(item_type), to_arrow_type(doc_type))
        found = part if number == 0 and part is not None else found if part is None else found.unionByName(part)
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _one_pass(texts, rows, k, kinds, item_kind, doc_kind):
    """(item_id, doc_id, score) with at least the best ``k`` of each item of ``rows`` (item_id, term); None if there are none."""
    spark = texts.sparkSession
    context = spark.sparkContext
    vocabulary = {term: i + 1 for i, term in enumerate(sorted({r["term"] for r in rows}))}
    dimensions, of_item = len(vocabulary), {}
    for row in rows:
        of_item.setdefault(row["item_id"], []).append(vocabulary[row["term"]])
    if not rows:
        return None
    doc_type = texts.schema["doc_id"].dataType.simpleString()
    in_bytes = context.broadcast({term.encode(): i for term, i in vocabulary.items()})
    vectors = staged(texts.mapInArrow(_vectors(in_bytes), f"doc_id {doc_type}, {_VECTOR}"), "rank-vectors")
    total = vectors.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("words")).first()
    if not total.documents:
        return None
    length = F.lit(100 - BASE) + F.expr(f"({LENGTH} * n * {total.documents}L) div {total.words}L")
    weighed = vectors.filter(F.size("terms") > 0).select("doc_id", length.alias("m"), "terms", "tfs")
    entries = weighed.select("m", F.explode(F.arrays_zip("terms", "tfs")).alias("e")).select("m", F.col("e.terms").alias("term"), F.col("e.tfs").cast("long").alias("tf"))
    gain = F.expr(f"({GAIN}L * tf) div ({SCALE} * tf + {SLOPE} * m)")
    weights, most, df = (np.zeros(dimensions + 1, np.int64) for _ in range(3))
    for row in entries.groupBy("term").agg(F.count("*").alias("df"), F.max(gain).alias("most")).collect():  # one row per term of the pass
        df[row["term"]], most[row["term"]], weights[row["term"]] = row["df"], row["most"], weight(total.documents, row["df"])
    asked = context.broadcast(Asked(list(of_item), [sorted(x) for x in of_item.values()], vocabulary, weights, most, df))
    # The k-th best of the seeds, or 1 where there are fewer: every score above 0 counts then.
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc()))
    seeds = weighed.mapInArrow(_seeds(asked, k), "item long, score long").withColumn("_place", place).filter(F.col("_place") == k)
    thresholds = [1] * len(of_item)
    for row in seeds.collect():  # one row per item of the pass
        thresholds[row["item"]] = max(1, row["score"])
    read = [lists_to_read(x, weights, most, df, threshold) for x, threshold in zip(asked.value.terms_of, thresholds, strict=True)]
    beside = {}
    for terms, lists in zip(asked.value.terms_of, read, strict=True):
        for term in lists:
            beside.setdefault(term, set()).update(terms)
    columns = context.broadcast({term: sorted(x) for term, x in beside.items()})
    coded = weighed.mapInArrow(_coded(asked, dimensions), f"doc_id {doc_type}, code long, terms array<int>, gains array<int>")
    order = ["code", F.xxhash64("doc_id")]
    laid = coded.repartitionByRange(*order).sortWithinPartitions(*order)
    fields = ", ".join(f"{name} array<int>" for name in Slab._fields)
    index = staged(laid.mapInArrow(_index(columns, dimensions, doc_kind), f"ids array<{doc_type}>, {fields}"), "rank-index")
    return index.mapInArrow(_search(asked, context.broadcast((read, thresholds)), k, item_kind, doc_kind), kinds)
