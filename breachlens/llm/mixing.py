"""Mixing sources to target weights by repeating documents."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import fits_broadcast
from ..session import staged
from .common import WORD

#: Weights of the sources in the order of their names (by code point, null last), repeating.
WEIGHTS = (5, 2, 1)
#: Share of all words that the mix takes, and how often a source may be repeated at most.
TOTAL_SHARE, MOST_REPEATS = 1.5, 2.0
SEED = "mix"
_LANES = 64


def n_words(text) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def place(identity, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id and the seed only."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(F.col(identity).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target, rate), one row per source, from rows of (source, size).

    A target is ``weight * level``, or ``MOST_REPEATS`` times the source's size where that is less. Sources that reach their limit
    first, in the order of limit per weight, leave the rest of the total to the others; the level is what is left per
    weight behind the last of them. This is where resharing the excess round by round ends. Works on one row per source.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    limit = F.col("source_size") * MOST_REPEATS
    weighed = per_source.withColumn("_weight", weight).withColumn("_limit", limit).withColumn("_order", F.col("_limit") / F.col("_weight"))
    fill = Window.orderBy("_order", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    filled = fill.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * TOTAL_SHARE - F.coalesce(F.sum("_limit").over(filled), F.lit(0.0))
    weights_left = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(filled), F.lit(0.0))
    levels = weighed.withColumn("_at", F.row_number().over(fill)).withColumn("_level", left / weights_left)
    # A source stays below its limit if the level is; the first such source, in this order, sets the level of all behind it.
    first = F.min(F.when(F.col("_level") < F.col("_order"), F.struct("_at", "_level"))).over(everything)
    below = F.coalesce(F.col("_at") >= first["_at"], F.lit(False))
    target = F.when(below, F.col("_weight") * first["_level"]).otherwise(F.col("_limit"))
    return levels.withColumn("target", target).select(
        "source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate")
    )


def _with_targets(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Join on the source, null included. One row per source is broadcast if a check allows it; else each hot source is salted."""
    named = targets.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if fits_broadcast(targets):
        return sized.join(F.broadcast(named), same).drop("_source")
    lanes = named.withColumn("_its_lane", F.explode(F.sequence(F.lit(0), F.lit(_LANES - 1))))
    dealt = sized.withColumn("_lane", F.pmod(F.xxhash64("doc_id"), F.lit(_LANES)).cast("int"))
    return dealt.join(lanes, same & (F.col("_lane") == F.col("_its_lane"))).drop("_source", "_lane", "_its_lane")


def mix(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, rate, copies, taken) per row.

    ``rate`` is the source's target over its size; a document is taken ``floor(rate)`` times, and once more if its seeded number is
    below the fraction. Null texts have no words; a source without words has target and rate 0. Null is a
    source of its own. Rows that repeat an id decide alike. An empty table gives no rows. Reruns agree.
    """
    sized = staged(
        documents.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text_col).alias("size")), "sizes"
    )
    targets = staged(source_targets(sized), "targets")
    return _copies(_with_targets(sized, targets), "doc_id", seed).select(
        "doc_id", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def _copies(rated, identity, seed):
    whole = F.floor("rate")
    return rated.withColumn("copies", whole.cast("long") + (place(identity, seed) < F.col("rate") - whole).cast("long"))


def mixed_documents(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with all their columns; none of their text is shuffled."""
    sized = staged(documents.select(F.col(source_col).alias("source"), n_words(text_col).alias("size")).groupBy("source").agg(F.sum("size").alias("size")), "sizes")
    targets = staged(source_targets(sized), "targets").select("source", "rate")
    row = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"))
    sourced = row.select("_row", F.col("_row")[source_col].alias("source"), F.col("_row")[id_col].alias("doc_id"))
    copies = _copies(_with_targets(sourced, targets), "doc_id", seed).filter("copies > 0")
    return copies.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
