"""Buckets of addresses: stored tables are partitioned by them, and questions join on them too, so a scan is cut to what is asked.

A bucketed table has the partition column ``key_bucket``; how many there are stands in that column's metadata.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET = "key_bucket"


def bucket_of(email: Column, buckets: int) -> Column:
    """The bucket of an address in any case; rows without one share a bucket."""
    return F.pmod(F.xxhash64(F.upper(email)), F.lit(buckets)).cast("int")


def with_bucket(rows: DataFrame, buckets: int, email: str = "email") -> DataFrame:
    return rows.withColumn(BUCKET, bucket_of(F.col(email), buckets))


def marked(rows: DataFrame, buckets: int) -> DataFrame:
    """Note the number of buckets on the column."""
    return rows.withMetadata(BUCKET, {"buckets": buckets})


def buckets_of(table: DataFrame) -> int | None:
    """How many buckets a table has; None if it is not bucketed."""
    return table.schema[BUCKET].metadata.get("buckets") if BUCKET in table.columns else None


def beside(table: DataFrame, asked: DataFrame, keys, email: str = "email") -> tuple[DataFrame, list]:
    """(``asked`` with the bucket of its addresses, the keys to join on) for a join with ``table``.

    The test on the bucket holds for every address; it tells the optimizer that the questions choose among the table's partitions.
    """
    buckets = buckets_of(table)
    if buckets is None:
        return asked, list(keys)
    return with_bucket(asked, buckets, email).filter(F.col(BUCKET) >= 0), [BUCKET, *keys]
