"""Table changes as set operations: append, update, upsert with a counter, insert-or-get.

Each is a pure function of DataFrames. ``plans.store`` writes the results.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import LEAK_DATA_KEY, LEAK_DATA_WRITABLE, LEAK_UPDATABLE
from ..session import staged
from .dedupe import first_per_key, match_keys, with_match_key
from .ids import next_id, with_dense_ids
from .joins import BROADCAST_ROWS, fits_broadcast, keep_matching, lookup, mark_matching

# ---- leaks ---------------------------------------------------------------------------------------


def append_leaks(leaks: DataFrame, new: DataFrame, *, run_ts: Column, order) -> DataFrame:
    """New leak rows with ids and ``ingestion_ts``, in the table's columns (K1). A row without a summary is an error.

    Times may come as text, with or without a zone; text that is no time is an error.
    """
    new = new.withColumns({f.name: _time(f.name) for f in new.schema if f.name in _TIMES and f.dataType.typeName() == "string"})
    missing = F.raise_error(F.lit("summary not given")).cast("string")
    stamped = new.withColumn("summary", F.coalesce("summary", missing)).withColumn("ingestion_ts", run_ts)
    numbered = with_dense_ids(stamped, order, next_id(leaks))
    have = set(numbered.columns)
    return numbered.select(*[F.col(c) if c in have else F.lit(None).alias(c) for c in leaks.columns])


_TIMES = ("breach_ts", "source_publish_ts")


def _time(name):
    value = F.col(name).try_cast("timestamp")
    wrong = F.raise_error(F.concat(F.lit(f"{name}: not a time: "), F.col(name))).cast("timestamp")
    return F.when(F.col(name).isNotNull() & value.isNull(), wrong).otherwise(value)


def update_by_id(table: DataFrame, changes: DataFrame, columns, *, order=None) -> DataFrame:
    """Replace ``columns`` in the rows ``changes`` names by id; a NULL in a change is written.

    Of several changes to one id the last along ``order`` counts; without an order they are an error. Changes to unknown ids
    touch nothing. Ids are then unique on both sides, so no task can be overloaded.
    """
    new = F.struct(*columns)
    if order is None:
        repeated = F.raise_error(F.concat(F.lit("more than one change to id "), F.col("id").cast("string")))
        one = F.when(F.count("*") > 1, repeated.cast("boolean"))
        marked = changes.groupBy("id").agg(F.any_value(new).alias("_new"), one.alias("_one")).filter("_one is null").drop("_one")
    else:
        marked = changes.groupBy("id").agg(F.max_by(new, F.struct(*order)).alias("_new"))
    if fits_broadcast(marked):
        marked = F.broadcast(marked)
    joined = table.join(marked, "id", "left")
    hit = F.col("_new").isNotNull()
    return joined.select(
        *[
            F.when(hit, F.col("_new")[c].cast(table.schema[c].dataType)).otherwise(F.col(c)).alias(c)
            if c in columns
            else F.col(c)
            for c in table.columns
        ]
    )


def update_leaks(leaks: DataFrame, changes: DataFrame, *, order=None) -> DataFrame:
    """K2: six columns are replaced, ``ingestion_ts`` is kept. A change without an id is an error."""
    return update_by_id(leaks, with_ids(changes), LEAK_UPDATABLE, order=order)


def update_credentials(store: DataFrame, changes: DataFrame, *, order=None) -> DataFrame:
    """K5: fifteen columns are replaced, ``count_seen`` and ``target_domain`` are kept."""
    return update_by_id(store, with_ids(changes), LEAK_DATA_WRITABLE, order=order)


def with_ids(changes: DataFrame) -> DataFrame:
    """Changes, each of which must name the id it is for."""
    missing = F.raise_error(F.lit("id not given; name the id to update")).cast("long")
    return changes.withColumn("id", F.coalesce(F.col("id"), missing))


def unknown_ids(table: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes that name no row of the table (the lookup answers "nothing updated")."""
    return changes.join(table.select("id"), "id", "left_anti")


def duplicate_keys(store: DataFrame, key=LEAK_DATA_KEY) -> DataFrame:
    """Keys held by more than one row: must be empty after an update. NULLs never clash."""
    return store.select(*key).dropna().groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def find_or_create_leaks(leaks: DataFrame, wanted: DataFrame, *, run_ts: Column, source_name: str):
    """``wanted`` (summary, ticket_id) -> (pairs with leak_id and ``created``, leak rows to append).

    The smallest id wins where several leaks share summary and ticket. A wanted pair without one of them is an error.
    """
    pair = ["summary", "ticket_id"]
    missing = F.raise_error(F.lit("a leak is found by summary and ticket_id; one is missing")).cast("string")
    pairs = wanted.select(*[F.coalesce(F.col(c), missing).alias(c) for c in pair]).distinct()
    held = keep_matching(leaks, pairs, pair, unique=F.col("id")).groupBy(*pair).agg(F.min("id").alias("leak_id"))
    resolved = pairs.join(held, pair, "left")
    absent = resolved.filter("leak_id is null").select(*pair, F.lit(source_name).alias("source_name"))
    created = append_leaks(leaks, absent, run_ts=run_ts, order=pair)
    answer = (
        resolved.filter("leak_id is not null")
        .withColumn("created", F.lit(False))
        .unionByName(created.select(*pair, F.col("id").alias("leak_id"), F.lit(True).alias("created")))
    )
    return answer, created


def split_by_known_leak(rows: DataFrame, leaks: DataFrame, *, unique: Column):
    """(rows whose leak exists, rows whose leak does not)."""
    marked = mark_known_leak(rows, leaks, unique=unique)
    return marked.filter("leak_known").drop("leak_known"), marked.filter("not leak_known").drop("leak_known")


def mark_known_leak(rows: DataFrame, leaks: DataFrame, *, unique: Column) -> DataFrame:
    """J7 in one pass: ``leak_known`` on every row; a row without a leak id has none."""
    return mark_matching(rows, leaks.select(F.col("id").alias("leak_id")), "leak_id", unique=unique, name="leak_known")


# ---- credentials ---------------------------------------------------------------------------------


def upsert(store: DataFrame, batch: DataFrame, *, order, unique: Column, key=LEAK_DATA_KEY) -> DataFrame:
    """K3 over the whole table: store rows with raised counters, and the batch's new keys with a count.

    A known key gets ``count_seen + copies`` and keeps every other column; a NULL counter stays NULL. A new
    key keeps its first row. Rows with a NULL in the key are always inserted. Two shuffles, both by the key.
    Extra columns: ``_touched`` (in the batch), ``_is_new``. New rows carry no id.
    """
    fresh = first_per_key(batch, key, order, unique).withColumnRenamed("_row", "_b")
    own = F.concat(F.lit("stored"), F.col("id"))
    old = with_match_key(store, key, own).select(*key[:-1], "_k", F.struct(*store.columns).alias("_t"))
    joined = old.join(fresh, [*key[:-1], "_k"], "full_outer")
    known = F.col("_t").isNotNull()
    have = set(batch.columns) - {"id", "count_seen"}

    def merged(name):
        kind = store.schema[name].dataType
        if name == "count_seen":
            added = F.coalesce("_copies", F.lit(0))
            value = F.when(known, F.col("_t")["count_seen"] + added).otherwise(F.col("_copies"))
            return value.cast(kind).alias(name)
        new = F.col("_b")[name].cast(kind) if name in have else F.lit(None).cast(kind)
        return F.when(known, F.col("_t")[name]).otherwise(new).alias(name)

    return joined.select(
        *[merged(c) for c in store.columns], F.col("_copies").isNotNull().alias("_touched"), (~known).alias("_is_new")
    )


def resolve_batch(
    store: DataFrame,
    batch: DataFrame,
    *,
    order,
    unique: Column,
    key=LEAK_DATA_KEY,
    max_broadcast_rows: int = BROADCAST_ROWS,
    small: bool | None = None,
) -> DataFrame:
    """The batch reduced to one row per key: ``_row``, ``_copies`` and the stored ``id`` (NULL if new).

    Only the id and key columns of the store are read. A batch of bounded size is broadcast into that scan;
    a bigger one meets it by one shuffle on the key, the same its own grouping has used. ``small`` hands in a size check
    of the batch's keys that the caller has already made.
    """
    join_key = [*key[:-1], "_k"]
    asked = match_keys(batch, key)
    small = fits_broadcast(batch.select(*key), max_broadcast_rows) if small is None else small
    hits = match_keys(store, key, "id").join(F.broadcast(asked) if small else asked.distinct(), join_key, "left_semi")
    return first_per_key(batch, key, order, unique).join(hits, join_key, "left")


def raises(resolved: DataFrame) -> DataFrame:
    """K3 on known keys: ``count_seen`` of ``id`` goes up by ``n``. The address says where in the store that row is."""
    return resolved.filter("id is not null").select("id", F.upper("email").alias("email_key"), F.col("_copies").alias("n"))


def inserts(resolved: DataFrame, columns, *, first_id: int, order, counted: bool = True) -> DataFrame:
    """New keys as table rows with ids; ``count_seen`` is the number of copies if ``counted``, else 1.

    ``columns`` is the table's schema; what the batch lacks is NULL.
    """
    new = resolved.filter("id is null").select("_row.*", F.col("_copies") if counted else F.lit(1).alias("_copies"))
    numbered = with_dense_ids(new, order, first_id)
    return numbered.select(*[_table_column(field, numbered.columns) for field in columns])


def _table_column(field, have):
    if field.name == "count_seen":
        return F.col("_copies").cast(field.dataType).alias("count_seen")
    value = F.col(field.name) if field.name in have else F.lit(None)
    return value.cast(field.dataType).alias(field.name)


def insert_or_get(store: DataFrame, batch: DataFrame, *, order, unique: Column, key=LEAK_DATA_KEY):
    """K4: (rows to append with ids, batch rows with the ``id`` each one now has and ``inserted``).

    On a known key nothing changes and the stored id is the answer; copies inside the batch share one id.
    """
    join_key = [*key[:-1], "_k"]
    batch = batch.drop("id")
    small = fits_broadcast(batch.select(*key))
    resolved = staged(resolve_batch(store, batch, order=order, unique=unique, key=key, small=small), "resolved")
    new = resolved.filter("id is null").select("_row.*", "_k", F.lit(1).alias("_copies"))
    new = with_dense_ids(new, order, next_id(store))
    known = resolved.filter("id is not null").select(*join_key, "id", F.lit(False).alias("inserted"))
    ids = known.unionByName(new.select(*join_key, "id", F.lit(True).alias("inserted")))
    # The ids are one row per key of the batch, so the check of the batch's keys bounds them too.
    answer = lookup(with_match_key(batch, key, unique), ids, join_key, unique=unique, small=small).drop("_k")
    return new.select(*[_table_column(field, new.columns) for field in store.schema]), answer


def touched(store_after: DataFrame) -> DataFrame:
    """the rows an import touched, from an ``upsert`` result; ``is_new`` tells inserts from raises."""
    return store_after.filter("_touched").withColumnRenamed("_is_new", "is_new").drop("_touched")
