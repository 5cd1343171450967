"""Summary statistics over the store. Extensions: the purpose is stated for the domain, no endpoint had them.

All are two-step aggregates; none sends the rows of one key to one task.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import match_key

#: Binary logarithm of a sketch's registers: at most 4 KB each.
_SKETCH = 12


def _volume():
    return [F.count("*").alias("credentials"), F.sum("count_seen").alias("times_seen")]


def partials(store: DataFrame, *also) -> DataFrame:
    """Counts per department and malware (and ``also``) that can be added up: rows, times seen, and a sketch of the addresses, about 1.6 % off."""
    address = F.hll_sketch_agg(match_key(F.col("email")), F.lit(_SKETCH)).alias("addresses")
    return store.groupBy(*also, "dg", "malware_name").agg(*_volume(), address)


def raised_partials(raised: DataFrame, *also) -> DataFrame:
    """What counter raises add to ``partials``: ``raised`` has ``n`` beside the credential's columns. A NULL counter stays NULL, so it adds nothing."""
    times = F.sum(F.when(F.col("count_seen").isNotNull(), F.col("n"))).alias("times_seen")
    counted = raised.groupBy(*also, "dg", "malware_name").agg(times)
    return counted.withColumns({"credentials": F.lit(0).cast("long"), "addresses": F.lit(None).cast("binary")})


def _merged():
    address = F.hll_sketch_estimate(F.hll_union_agg("addresses")).alias("addresses")
    return [F.sum("credentials").alias("credentials"), F.sum("times_seen").alias("times_seen"), address]


def merged_by_department(parts: DataFrame) -> DataFrame:
    """``by_department`` from ``partials``, and about how many addresses."""
    return parts.groupBy("dg").agg(*_merged())


def merged_by_malware(parts: DataFrame) -> DataFrame:
    return parts.filter("malware_name is not null").groupBy("malware_name").agg(*_merged())


def merged_department_by_malware(parts: DataFrame) -> DataFrame:
    return parts.rollup("dg", "malware_name").agg(F.grouping_id().cast("int").alias("level"), *_merged())


def by_department(store: DataFrame) -> DataFrame:
    return store.groupBy("dg").agg(*_volume())


def by_malware(store: DataFrame) -> DataFrame:
    return store.filter("malware_name is not null").groupBy("malware_name").agg(*_volume())


def department_by_malware(store: DataFrame) -> DataFrame:
    """Counts per department and malware with subtotals; ``level`` is 0 for details, 1 and 3 for totals."""
    return store.rollup("dg", "malware_name").agg(F.grouping_id().cast("int").alias("level"), *_volume())


def top_domains(store: DataFrame, n: int = 10) -> DataFrame:
    counts = store.filter("domain is not null").groupBy("domain").agg(*_volume())
    return counts.orderBy(F.desc("credentials"), "domain").limit(n)


def password_reuse(store: DataFrame, at_least: int = 2) -> DataFrame:
    """Passwords used for several addresses. The password itself is not shown, only its hash."""
    used = store.filter("password is not null").select(F.sha2("password", 256).alias("password_sha256"), "email")
    owners = used.withColumn("email_key", match_key(F.col("email"))).groupBy("password_sha256")
    return owners.agg(F.count_distinct("email_key").alias("addresses"), F.count("*").alias("credentials")).filter(
        F.col("addresses") >= at_least
    )


def leak_overlap(store: DataFrame) -> DataFrame:
    """Per leak: distinct addresses, and how many of them also stand in another leak.

    An address is shared if its smallest and largest leak differ. The window sees one row per leak of
    an address, whatever the number of its credentials; pairs of rows are never built.
    """
    seen = store.select("leak_id", match_key(F.col("email")).alias("email_key")).dropna().distinct()
    own = Window.partitionBy("email_key")
    shared = F.min("leak_id").over(own) < F.max("leak_id").over(own)
    return seen.select("leak_id", shared.alias("shared")).groupBy("leak_id").agg(
        F.count("*").alias("addresses"), F.count_if("shared").alias("shared_addresses")
    )
