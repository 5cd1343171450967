"""Near-duplicate documents: universal hash minima, banding, checks on signatures and on full sets, components."""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ids import with_dense_ids
from ..session import staged
from .common import as_bytes, attach, byte_slices, text_groups, window_hashes, word_hashes
from .components import connected_components

#: 32 bands of 4 minima: a pair at a similarity of 0.8 shares no band once in 20 million pairs.
BANDS, ROWS = 32, 4
#: Buckets up to this size are compared pair by pair in a join; larger ones in blocks.
SMALL_BUCKET = 32
BLOCK = 256

_U64 = np.uint64
_family = np.random.default_rng(7)
_FACTOR = _family.integers(0, 2**63, BANDS * ROWS, dtype=_U64)[:, None] * _U64(2) + _U64(1)
_TERM = _family.integers(0, 2**63, BANDS * ROWS, dtype=_U64)[:, None]


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z folded."""
    for first, last in text_groups(texts):
        words, counts = word_hashes(texts[first:last], lower=True)
        ends = np.cumsum(counts)
        for begin, end in zip(ends - counts, ends, strict=True):
            yield np.unique(window_hashes(words[begin:end], width))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over a set that is not empty."""
    least = np.full(BANDS * ROWS, np.iinfo(_U64).max, _U64)
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, (_FACTOR * shingles[None, at : at + 2048] + _TERM).min(axis=1))
    return (least >> _U64(32)).astype(np.uint32).view(np.int32)


_SIGNED = "doc_id long, mark long, n_shingles long, digest binary, signature array<int>"


def _digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _sign(width):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("mark", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("signature", pa.list_(pa.int32()))]
    )

    def sign(batches):
        for batch in byte_slices(batches, 1):
            sizes, digests, signatures = [], [], []
            for found in shingle_sets(as_bytes(batch.column(1)), width):
                sizes.append(len(found))
                digests.append(_digest(found))
                signatures.append(signature(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.list_(pa.int32()))],
                schema=schema,
            )

    return sign


def _sets(width):
    schema = pa.schema([("rep", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def sets(batches):
        for batch in byte_slices(batches, 1, 1 << 20):  # a set may be as large as its text
            found = list(shingle_sets(as_bytes(batch.column(1)), width))
            # The id may stand on other texts as well; only the one with the wanted set is the representative's.
            own = [i for i, (x, wanted) in enumerate(zip(found, batch.column(2).to_pylist(), strict=True)) if _digest(x) == wanted]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(own, pa.int64())), pa.array([found[i].view(np.int64) for i in own], pa.list_(pa.int64()))], schema=schema
            )

    return sets


def least_agreement(percent: int) -> int:
    """The largest number of equal minima below which a link at ``percent`` falls no more often than it shares no band.

    Both by the binomial; a link's estimate is the same in every bucket, so a higher limit would lose it for good.
    """
    similar, minima = min(percent, 100) / 100, BANDS * ROWS
    no_band, below = (1 - similar**ROWS) ** BANDS, 0.0
    for agreeing in range(minima):
        below += math.comb(minima, agreeing) * similar**agreeing * (1 - similar) ** (minima - agreeing)
        if below > no_band:
            return agreeing
    return minima


def near_duplicates(documents: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row: documents linked at a Jaccard similarity of ``percent`` or more.

    A document's set holds its distinct ``width``-word shingles (the whole sequence if it has fewer words). Documents with equal
    sets are one representative from the start, so copies never meet as pairs. Representatives that share a band are candidates:

    1. in every bucket all members are compared with one hub, another in each band, and components are formed;
    2. buckets whose members are still in several components are compared in full: small ones as pairs in a join,
       larger ones in blocks of ``BLOCK`` members, each pair of blocks in a task of its own that gives only the links
       that join components. No bucket is capped.

    Estimates from signatures sort out pairs first, each remaining pair is confirmed on full sets.
    Null and empty texts have an empty set and are linked with nothing. A null id is a document of its own with a null
    component and ``kept`` true; rows repeating an id and text give as many rows. Where an id stands on several texts each of them
    is a document of its own, with its own links. An empty table gives no rows.
    """
    return _verdicts(documents, width, percent, id_col, text_col).drop("mark")


def _verdicts(documents, width, percent, id_col, text_col):
    """``near_duplicates`` with ``mark``, a hash of the row's text."""
    text = F.col(text_col)
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), _mark(text).alias("mark"))
    signed = staged(texts.mapInArrow(_sign(width), _SIGNED), "near-signed")
    known = signed.filter("doc_id is not null and digest is not null")
    smallest = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    # Classes are numbered in the order of their smallest ids: an id that stands on several texts may be the smallest of several classes.
    classes = staged(with_dense_ids(smallest, ["doc_id", "digest"], 0, "rep"), "near-classes")
    reps = staged(
        known.join(classes, ["doc_id", "digest"]).select("rep", "doc_id", "digest", "n_shingles", "signature").dropDuplicates(["rep"]), "near-reps"
    )
    links = _links(texts, reps, width, percent)
    component = connected_components(links)
    named = component.join(classes.select(F.col("rep").alias("component"), F.col("doc_id").alias("component_id")), "component")
    labelled = classes.join(named, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component_id", "doc_id").alias("component_id"))
    slim = signed.select("doc_id", "mark", "n_shingles", "digest")
    grouped = attach(slim.filter("doc_id is not null and digest is not null"), labelled, "digest", spread="doc_id")
    alone = slim.filter("doc_id is null or digest is null").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "mark", "n_shingles", "component_id"]
    return grouped.select(columns).unionByName(alone.select(columns)).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _mark(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _links(texts, reps, width, percent):
    """Confirmed links (a, b) that connect the representatives as all confirmed links would."""
    whose = reps.select("rep", "doc_id", "digest")
    reps = reps.drop("doc_id", "digest")
    keys = F.array(*[F.xxhash64(*[F.col("signature")[band * ROWS + row] for row in range(ROWS)]) for band in range(BANDS)])
    members = reps.select("rep", F.posexplode(keys).alias("band", "key"))
    hub = F.min(F.struct(F.xxhash64("rep", "band").alias("order"), "rep"))
    buckets = members.groupBy("band", "key").agg(F.count("*").alias("size"), hub["rep"].alias("hub")).filter("size > 1")
    shared = staged(members.join(buckets, ["band", "key"]), "near-shared")
    needed = whose.join(shared.select("rep").distinct(), "rep", "left_semi")
    sets = staged(
        texts.join(needed, "doc_id").dropDuplicates(["doc_id", "rep", "mark"]).select("rep", "text", "digest")
        .mapInArrow(_sets(width), "rep long, shingles array<long>"),
        "near-sets",
    )

    star = shared.filter("rep <> hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    first = staged(_confirmed(star, reps, sets, percent), "near-links")
    component = connected_components(first).withColumnRenamed("node", "rep")
    labelled = shared.join(component, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_buckets = labelled.groupBy("band", "key").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).filter("_low <> _high")
    left = staged(labelled.join(open_buckets.select("band", "key"), ["band", "key"], "left_semi"), "near-open")

    one = left.filter(F.col("size") <= SMALL_BUCKET).select("band", "key", F.col("rep").alias("a"), F.col("component").alias("_ca"), "hub")
    other = left.filter(F.col("size") <= SMALL_BUCKET).select("band", "key", F.col("rep").alias("b"), F.col("component").alias("_cb"))
    pairs = one.join(other, ["band", "key"]).filter("a < b and _ca <> _cb and a <> hub and b <> hub").select("a", "b").distinct()
    second = _confirmed(pairs, reps, sets, percent)

    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    units = (
        left.filter(F.col("size") > SMALL_BUCKET)
        .withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("band", "key", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "_own", "rep", "component")
    )
    third = (
        units.join(sets, "rep")
        .groupBy("band", "key", "i", "j")
        .applyInArrow(_block_links(percent), "a long, b long")
    )
    return first.unionByName(second).unionByName(third)


def _confirmed(pairs, reps, sets, percent):
    """The pairs (a, b) whose estimate does not rule a link out and whose full sets are similar enough."""
    signs = reps.select("rep", "signature")
    agree = F.aggregate(
        F.zip_with("_sa", "_sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda total, same: total + same
    )
    likely = (
        pairs.join(signs.select(F.col("rep").alias("a"), F.col("signature").alias("_sa")), "a")
        .join(signs.select(F.col("rep").alias("b"), F.col("signature").alias("_sb")), "b")
        .filter(agree >= least_agreement(percent))
        .select("a", "b")
    )
    common = F.size(F.array_intersect("_xa", "_xb")).cast("long")
    return (
        likely.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("_xa")), "a")
        .join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("_xb")), "b")
        .withColumn("_common", common)
        .filter(100 * F.col("_common") >= percent * (F.size("_xa") + F.size("_xb") - F.col("_common")))
        .select("a", "b")
    )


def _block_links(percent):
    def links(table):
        ids, component = table["rep"].to_numpy(), table["component"].to_numpy()
        lists = table["shingles"].combine_chunks()
        values, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        shared = _common_counts(values, sizes)
        similar = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
        similar &= component[:, None] != component[None, :]
        name = {c: c for c in component.tolist()}

        def root(x):
            while name[x] != x:
                name[x] = name[name[x]]
                x = name[x]
            return x

        a, b = [], []
        for x, y in zip(*np.nonzero(np.triu(similar, 1)), strict=True):
            left, right = root(int(component[x])), root(int(component[y]))
            if left != right:
                name[right] = left
                a.append(ids[x])
                b.append(ids[y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return links


def _common_counts(values, sizes, width=4096):
    """Sizes of the intersections of all sets of a block, by products of 0/1 matrices over the values that occur twice."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    dense = np.cumsum(times > 1) - 1
    keep = times[column] > 1
    owner, column = owner[keep], dense[column[keep]]
    total = np.zeros((len(sizes), len(sizes)), np.int64)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        low, high = np.searchsorted(column, [first, first + width])
        part = np.zeros((len(sizes), width), np.float32)
        part[owner[low:high], column[low:high] - first] = 1
        total += (part @ part.T).astype(np.int64)
    return total


def drop_near_duplicates(documents: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of which one stays per component, with all their columns. A null id stays; a row repeating an id stays once per row.

    Of an id that stands on several texts, only rows with a text that goes are dropped.
    """
    dropped = _verdicts(documents, width, percent, id_col, text_col).filter("not kept").select("doc_id", "mark").distinct()
    row = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"))
    keyed = row.select("_row", F.col("_row")[id_col].cast("long").alias("doc_id"), _mark(F.col("_row")[text_col]).alias("mark"))
    return keyed.join(dropped, ["doc_id", "mark"], "left_anti").select("_row.*")
