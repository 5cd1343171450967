"""Dense ids in a given order, without sorting everything in one task."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

_POSITION = (1 << 33) - 1


def with_dense_ids(rows: DataFrame, order, first_id: int, name: str = "id") -> DataFrame:
    """Add ``first_id, first_id + 1, ...`` along ``order``, which must be unique per row.

    Rows are range-partitioned and sorted inside the partitions; the staged copy pins their positions, so
    the second pass (one count per partition, then offsets) sees the same layout even after a lost executor.
    """
    placed = staged(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()),
        "ids",
    )
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # One row per shuffle partition: bounded by the partition count, not by the data.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + int(first_id)).alias("_before"))
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.select(
        *[c for c in rows.columns if c != name],
        (F.col("_before") + F.col("_at").bitwiseAND(F.lit(_POSITION))).alias(name),
    )


def next_id(table: DataFrame, name: str = "id") -> int:
    """The first unused id: one number, from the id column alone."""
    return (table.agg(F.max(name)).first()[0] or 0) + 1
