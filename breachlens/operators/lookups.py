"""Questions to the stored tables, one at a time or a whole table of them.

A single question is a filter. Stored tables carry ``email_key`` so that the case-insensitive one reaches the
parquet scan; on any other table the key is computed. A table of questions is one pass over the store: its keys are
broadcast into the scan when their count is bounded, and shuffled with heavy keys spread out otherwise.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import match_key
from ..session import staged
from .buckets import BUCKET, beside, bucket_of, buckets_of
from .joins import BROADCAST_ROWS, fits_broadcast, keep_matching


def _email_key(store):
    return F.col("email_key") if "email_key" in store.columns else match_key(F.col("email"))


# ---- one question --------------------------------------------------------------------------------


def by_email(store: DataFrame, email: str) -> DataFrame:
    """address in any case. Of a bucketed table one bucket is read."""
    found = store.filter(_email_key(store) == F.upper(F.lit(email)))
    buckets = buckets_of(store)
    return found if buckets is None else found.filter(F.col(BUCKET) == bucket_of(F.lit(email), buckets))


def by_email_and_password(store: DataFrame, email: str, password: str) -> DataFrame:
    """address in any case, exact password."""
    return by_email(store, email).filter(F.col("password") == password)


def by_value(table: DataFrame, column: str, value) -> DataFrame:
    """Exact match on one column."""
    return table.filter(F.col(column) == value)


def by_value_any_case(table: DataFrame, column: str, value: str) -> DataFrame:
    """match on one column in any case."""
    return table.filter(match_key(F.col(column)) == F.upper(F.lit(value)))


def by_ids(table: DataFrame, ids: DataFrame) -> DataFrame:
    """the rows of a table of ids."""
    return keep_matching(table, ids, "id", unique=F.col("id"))


def count_by_email(store: DataFrame, email: str) -> DataFrame:
    """A1: one row, 0 if there is nothing."""
    return by_email(store, email).agg(F.count("*").alias("count"))


def count_by_password(store: DataFrame, password: str) -> DataFrame:
    """A2: rows where any of the three password columns is exactly this."""
    hit = (F.col("password") == password) | (F.col("password_plain") == password)
    return store.filter(hit | (F.col("password_hashed") == password)).agg(F.count("*").alias("count"))


def count_by_domain(store: DataFrame, domain: str) -> DataFrame:
    """A3: domain in any case."""
    return by_value_any_case(store, "domain", domain).agg(F.count("*").alias("count"))


def distinct_sorted(table: DataFrame, column: str) -> DataFrame:
    """A4, A5: distinct values in ascending order, NULL last."""
    return table.select(column).distinct().orderBy(F.col(column).asc_nulls_last())


# ---- a table of questions ------------------------------------------------------------------------


def rows_for_emails(store, asked, *, max_broadcast_rows=BROADCAST_ROWS) -> DataFrame:
    """F1 in bulk: store rows whose address is in ``asked.email``."""
    keys = asked.select(match_key(F.col("email")).alias("email_key"))
    keys, on = beside(store, keys, ["email_key"], "email_key")
    keyed = store.withColumn("email_key", _email_key(store))
    found = keep_matching(keyed, keys, on, unique=F.col("id"), max_broadcast_rows=max_broadcast_rows)
    return found.select(*store.columns)


def rows_for_credentials(store, asked, *, max_broadcast_rows=BROADCAST_ROWS) -> DataFrame:
    """F2 in bulk: store rows whose (address, password) is in ``asked``."""
    keys = asked.select(match_key(F.col("email")).alias("email_key"), "password")
    keys, on = beside(store, keys, ["email_key", "password"], "email_key")
    keyed = store.withColumn("email_key", _email_key(store))
    found = keep_matching(keyed, keys, on, unique=F.col("id"), max_broadcast_rows=max_broadcast_rows)
    return found.select(*store.columns)


def rows_for_values(table, asked, column, *, any_case=False, max_broadcast_rows=BROADCAST_ROWS) -> DataFrame:
    """F3-F9 in bulk: rows whose ``column`` is in ``asked.<column>``."""
    key = match_key(F.col(column)) if any_case else F.col(column)
    keyed = table.withColumn("_key", key)
    keys = asked.select(key.alias("_key"))
    return keep_matching(
        keyed, keys, "_key", unique=F.col("id"), max_broadcast_rows=max_broadcast_rows
    ).select(*table.columns)


def counts_for(values: DataFrame, asked: DataFrame, key: str, *, max_broadcast_rows=BROADCAST_ROWS) -> DataFrame:
    """Rows of ``values`` per asked key, 0 where there are none.

    Counting is two-step, so a key that owns a third of the rows reaches the shuffle as one partial
    count per task. Bounded questions first shrink the scan to their own keys.
    """
    # Asked for three times below, so written once, whatever plan they come from.
    questions = staged(asked.select(key).distinct(), "asked")
    if fits_broadcast(questions, max_broadcast_rows):
        values = values.join(F.broadcast(questions), key, "left_semi")
    counted = values.groupBy(key).agg(F.count("*").alias("count"))
    return questions.join(counted, key, "left").select(key, F.coalesce("count", F.lit(0)).alias("count"))


def counts_by_email(store, asked, **options) -> DataFrame:
    """A1 in bulk, by ``email_key``."""
    keys = asked.select(match_key(F.col("email")).alias("email_key"))
    return counts_for(store.select(_email_key(store).alias("email_key")), keys, "email_key", **options)


def counts_by_password(store, asked, **options) -> DataFrame:
    """A2 in bulk: each row counts once per password, in whichever of the three columns it stands.

    The OR over three columns becomes an equality on the distinct values of each row.
    """
    spots = F.array_distinct(F.array("password", "password_plain", "password_hashed"))
    values = store.select(F.explode(spots).alias("password")).filter("password is not null")
    return counts_for(values, asked, "password", **options)


def counts_by_domain(store, asked, **options) -> DataFrame:
    """A3 in bulk, by upper-cased domain."""
    keys = asked.select(match_key(F.col("domain")).alias("domain_key"))
    return counts_for(store.select(match_key(F.col("domain")).alias("domain_key")), keys, "domain_key", **options)
