"""Lookups that hold up when one key owns a large share of the rows.

The tables looked up in (VIPs, directory, asked keys, leaks) are usually small, and then a broadcast join reads the
big side once without a shuffle. That is only done behind a size check. If instead the rows are few, their keys are
broadcast into the table's scan. If both are big the rows are shuffled, except for rows of *heavy* keys:
frequent-items sketches name them, their few table rows are broadcast, and the rows themselves are spread
evenly instead of being sent to one task.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settings

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 256 << 20
#: Inputs up to this size are counted in one job.
SMALL_FILES = 64 << 20
HEAVY_KEYS = 4096
_TRACKED = 16384
_SKETCH_GROUPS = 1024
# A size check starts with this many partitions, so an ordinary small table is decided by one job.
_FIRST_LOOK = {"spark.sql.limit.initialNumPartitions": "8"}


def fits_broadcast(table: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Has ``table`` at most ``max_rows`` rows and ``max_bytes`` of cell text?

    Where the files behind ``table`` are small, one job counts rows and bytes together. Else the row check comes first; it reads no columns and only
    as many partitions as decide it (``take``, unlike ``isEmpty`` or ``count``, goes on from partition to partition), and
    the texts are only summed up for a table whose rows are few. Where ``table`` is costly to compute, hand in what it is made from.
    """
    if max_rows <= 0:
        return False
    cells = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in table.columns]
    size = F.sum(reduce(lambda a, b: a + b, cells, F.lit(16).cast("long")))
    files = file_bytes(table)
    if files is not None and files <= SMALL_FILES:
        found = table.agg(F.count("*").alias("rows"), size.alias("bytes")).first()
        return found["rows"] <= max_rows and (found["bytes"] or 0) <= max_bytes
    with settings(table.sparkSession, _FIRST_LOOK):
        if table.select(F.lit(1)).offset(max_rows).take(1):
            return False
    return (table.agg(size).first()[0] or 0) <= max_bytes


def file_bytes(table: DataFrame) -> int | None:
    """Bytes of all files that ``table`` is computed from, from their listing; None if it comes from anything but files."""
    leaves = table._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LocalRelation":
            total += int(str(leaf.stats().sizeInBytes()))
        elif leaf.getClass().getSimpleName() == "LogicalRelation":
            total += int(str(leaf.relation().sizeInBytes()))
        else:
            return None
    return total


def heavy_hashes(rows: DataFrame, keys) -> DataFrame:
    """At most ``HEAVY_KEYS`` hashes, among them those of every key that owns a large share of ``rows``.

    Each input task sends one bounded sketch and no keys; the sketches' leaders are added up. The result only
    steers where rows go; a key missed or named without need changes no result.
    """
    group = F.pmod(F.spark_partition_id(), F.lit(_SKETCH_GROUPS))
    leaders = (
        rows.select(F.xxhash64(*keys).alias("_h"), group.alias("_g"))
        .groupBy("_g")
        .agg(F.expr(f"approx_top_k(_h, {HEAVY_KEYS}, {_TRACKED})").alias("_top"))
        .select(F.inline("_top"))
    )
    ranked = leaders.groupBy("item").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "item")
    return ranked.limit(HEAVY_KEYS).select(F.col("item").alias("_h"))


def lookup(
    rows: DataFrame,
    table: DataFrame,
    keys,
    *,
    unique: Column,
    max_broadcast_rows: int = BROADCAST_ROWS,
    small: bool | None = None,
) -> DataFrame:
    """Left join ``rows`` to ``table``, which has one row per key, on equal ``keys``.

    ``unique`` tells the rows of one key apart (an id or the lineage); it is only used to spread them. Beyond the
    bound ``rows`` is read twice, so hand in a table and not a costly plan.
    NULL keys match nothing. ``small`` hands in a size check the caller has already made.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    values = [c for c in table.columns if c not in keys]
    if fits_broadcast(table, max_broadcast_rows) if small is None else small:
        return rows.join(F.broadcast(table), keys, "left").select(*rows.columns, *values)

    if fits_broadcast(rows.select(*keys), max_broadcast_rows):
        # Few rows and a big table: only the table rows they ask for are moved.
        needed = table.join(F.broadcast(rows.select(*keys)), keys, "left_semi")
        return rows.join(needed, keys, "left").select(*rows.columns, *values)

    heavy = heavy_hashes(rows, keys).withColumn("_hot", F.lit(True))
    keyed = table.withColumn("_h", F.xxhash64(*keys))
    hot = keyed.join(F.broadcast(heavy.select("_h")), "_h", "left_semi").select(
        *[F.col(k).alias(f"_hk_{k}") for k in keys], F.struct(*keys, *values).alias("_hv")
    )
    cold = keyed.select(
        *[F.col(k).alias(f"_ck_{k}") for k in keys], F.col("_h").alias("_spot2"), F.struct(*keys, *values).alias("_cv")
    )
    marked = rows.withColumn("_h", F.xxhash64(*keys)).join(F.broadcast(heavy), "_h", "left")
    with_hot = marked.join(F.broadcast(hot), _equal(keys, "_hk_"), "left")
    # A row of a heavy key, or of a NULL key, has no partner in the shuffle join: any task will do.
    anywhere = F.xxhash64(unique, F.lit("spread"))
    lost = F.col("_hot").isNotNull()
    for key in keys:
        lost = lost | F.col(key).isNull()
    spread = with_hot.withColumn("_spot", F.when(lost, anywhere).otherwise(F.col("_h")))
    joined = spread.join(cold, _equal(keys, "_ck_") & (F.col("_spot") == F.col("_spot2")), "left")
    found = F.coalesce("_hv", "_cv")
    return joined.select(*rows.columns, *[found[v].alias(v) for v in values])


def _equal(keys, prefix):
    test = F.lit(True)
    for key in keys:
        test = test & (F.col(key) == F.col(prefix + key))
    return test


def keep_matching(rows, keys_table, keys, *, unique, max_broadcast_rows=BROADCAST_ROWS) -> DataFrame:
    """Rows whose key is in ``keys_table`` (a semi join)."""
    return _marked(rows, keys_table, keys, unique, max_broadcast_rows).filter("_found").drop("_found")


def drop_matching(rows, keys_table, keys, *, unique, max_broadcast_rows=BROADCAST_ROWS) -> DataFrame:
    """Rows whose key is not in ``keys_table`` (an anti join); rows with a NULL key stay."""
    return _marked(rows, keys_table, keys, unique, max_broadcast_rows).filter(F.col("_found").isNull()).drop("_found")


def mark_matching(rows, keys_table, keys, *, unique, name, max_broadcast_rows=BROADCAST_ROWS, small=None) -> DataFrame:
    """All rows, with a boolean: is the key in ``keys_table``?"""
    marked = _marked(rows, keys_table, keys, unique, max_broadcast_rows, small)
    return marked.select(*rows.columns, F.coalesce("_found", F.lit(False)).alias(name))


def _marked(rows, keys_table, keys, unique, max_broadcast_rows, small=None):
    keys = [keys] if isinstance(keys, str) else list(keys)
    asked = keys_table.select(*keys)
    small = fits_broadcast(asked, max_broadcast_rows) if small is None else small
    table = asked.distinct().withColumn("_found", F.lit(True))
    return lookup(rows, table, keys, unique=unique, max_broadcast_rows=max_broadcast_rows, small=small)
