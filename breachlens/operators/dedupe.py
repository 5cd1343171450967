"""Dropping credentials that are already known.

All grouping is a two-step aggregate, so copies of one credential meet inside each input task first and
a credential that makes up a third of a feed crosses the shuffle as one row per task.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import unequal_null_key
from ..session import staged
from .buckets import beside, buckets_of, marked
from .joins import BROADCAST_ROWS, drop_matching, fits_broadcast, keep_matching

DEDUPE_KEY = ["email", "password"]


def with_match_key(rows: DataFrame, key, unique: Column) -> DataFrame:
    """Add ``_k``; together with ``key[:-1]`` it is equal exactly where SQL ``=`` holds on all of ``key``."""
    has_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in key])
    own = F.concat(F.lit("row"), unique.cast("string"))
    return rows.withColumn("_k", unequal_null_key(F.col(key[-1]).cast("string"), has_null, own))


def match_keys(store: DataFrame, key, *others) -> DataFrame:
    """The key of each stored row in the same form; rows with a NULL in it can match nothing and are left out."""
    present = store.select(*others, *key).dropna(subset=list(key))
    return present.select(*others, *key[:-1], F.concat(F.lit("="), F.col(key[-1]).cast("string")).alias("_k"))


def first_per_key(rows: DataFrame, key, order, unique: Column) -> DataFrame:
    """One row per key: ``_row``, the first along ``order``, and ``_copies``. NULL keys are never one group."""
    return (
        with_match_key(rows, key, unique)
        .groupBy(*key[:-1], "_k")
        .agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_row"), F.count("*").alias("_copies"))
    )


def copies_per_key(rows: DataFrame, key, unique: Column) -> DataFrame:
    """The key columns and ``count_seen``, the number of rows with that key; a key with a NULL is always one row."""
    counted = with_match_key(rows, key, unique).groupBy(*key, "_k").agg(F.count("*").alias("count_seen"))
    return counted.drop("_k")


def keep_first(rows: DataFrame, key=DEDUPE_KEY, *, order, unique: Column) -> DataFrame:
    """Drop later copies of a key inside one batch (W1). Where copies need no count, rows are never packed into an aggregate."""
    return _firsts(with_match_key(rows, key, unique), key, order).select(*rows.columns)


def _firsts(marked_rows, key, order):
    """The first row of each match key. Every task drops later copies before the shuffle (the window's group limit), so a hot key crosses it once per task."""
    along = Window.partitionBy(*key[:-1], "_k").orderBy(*order)
    return marked_rows.withColumn("_first", F.row_number().over(along)).filter("_first = 1").drop("_first")


def known_rows(store: DataFrame, asked: DataFrame, columns, *, max_broadcast_rows: int = BROADCAST_ROWS, small: bool | None = None) -> DataFrame:
    """The store's rows, with ``columns``, whose (email, password) is in ``asked``: one scan of the store for everything an import wants of it.

    A bucketed store is joined on the bucket as well, so a batch of bounded size has only its own buckets read.
    """
    keys, on = beside(store, asked.select(*DEDUPE_KEY).dropna().distinct(), DEDUPE_KEY)
    columns = list(dict.fromkeys([*columns, *on]))
    small = fits_broadcast(asked.select(*DEDUPE_KEY), max_broadcast_rows) if small is None else small
    rows = store.select(*columns)
    if small:
        found = rows.join(F.broadcast(keys), on, "left_semi")
    else:
        found = keep_matching(rows, keys, on, unique=F.col("id"), max_broadcast_rows=0)
    return found.select(*columns) if buckets_of(store) is None else marked(found.select(*columns), buckets_of(store))


def drop_known(
    incoming: DataFrame,
    store: DataFrame,
    key=DEDUPE_KEY,
    *,
    order,
    unique: Column,
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Drop rows whose key is stored, then later copies inside the batch.

    Exact, case-sensitive match; a NULL never matches. Only the key columns of the store are read. A batch of bounded
    size is broadcast into that scan, so the store is not shuffled; otherwise both sides are reduced to one row
    per key by the very partitioning the anti join needs: two shuffles in all and no skew in the join.
    ``key`` decides the scope: (email, password) looks at all leaks; put ``leak_id`` and ``domain`` in it for the
    narrower rule.
    """
    join_key = [*key[:-1], "_k"]
    known = match_keys(store, key)
    if fits_broadcast(incoming.select(*key), max_broadcast_rows):
        # Known keys of a bounded batch are bounded as well: its known rows go before anything of it is sorted or shuffled.
        known = known.join(F.broadcast(match_keys(incoming, key)), join_key, "left_semi").distinct()
        unknown = with_match_key(incoming, key, unique).join(F.broadcast(known), join_key, "left_anti")
        return _firsts(unknown, key, order).select(*incoming.columns)
    firsts = _firsts(with_match_key(incoming, key, unique), key, order)
    return firsts.join(known.distinct(), join_key, "left_anti").select(*incoming.columns)


def drop_stored(incoming: DataFrame, store: DataFrame, key=DEDUPE_KEY, *, unique: Column, max_broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows whose key is not stored, copies included (J1 alone)."""
    return drop_matching(incoming, store.select(*key), list(key), unique=unique, max_broadcast_rows=max_broadcast_rows)


def drop_known_in_feed(
    incoming: DataFrame,
    store: DataFrame,
    key=DEDUPE_KEY,
    *,
    stored="email_stored",
    order,
    unique: Column,
    max_broadcast_rows: int = BROADCAST_ROWS,
    narrowed: bool = False,
) -> DataFrame:
    """``drop_known`` for a feed whose addresses are stored in another spelling than they arrive in.

    ``email`` is what arrived, the column ``stored`` what is written. A row is compared by its raw address with what
    is stored, and a stored row carries the normal form. So
    - a row that is already in normal form is dropped if its key is stored, or if any earlier row that gets
      stored has the same key in normal form;
    - a row in another spelling never meets its own stored copy. It goes on, and raises the counter there.
    ``incoming`` should be a staged table: it is read once per branch. The store is scanned once for a batch of
    bounded size; ``narrowed`` says that ``store`` holds no more than the batch's own rows already.
    """
    normal = F.col("email") == F.col(stored)
    asked = incoming.select(*key)
    if not narrowed and fits_broadcast(asked, max_broadcast_rows):
        store = staged(store.select(*key).join(F.broadcast(asked), list(key), "left_semi").distinct(), "known")
    usual = drop_known(incoming.filter(normal), store, key, order=order, unique=unique, max_broadcast_rows=0)
    # The few rows in another spelling: copies must be counted, so rows are kept and only keys are reduced.
    unusual = drop_matching(
        incoming.filter(~normal), store, key, unique=unique, max_broadcast_rows=max_broadcast_rows
    )
    written = [F.col(stored).alias(c) if c == "email" else F.col(c) for c in key]
    earlier = unusual.groupBy(*written).agg(F.min(F.struct(*order)).alias("_earlier"))
    usual = usual.join(earlier, list(key), "left")
    usual = usual.filter(F.col("_earlier").isNull() | (F.struct(*order) < F.col("_earlier")))
    return usual.select(*incoming.columns).unionByName(unusual)
