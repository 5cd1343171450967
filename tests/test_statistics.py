"""Counts kept with each batch: equal to counts over the credentials, whatever has happened to the store."""

import pytest
from pyspark.sql import functions as F

from breachlens.operators import stats
from breachlens.plans.store import ConflictingWrite, Store

from .conftest import rows
from .test_plans import plan
from .test_store import Interrupted, credentials


def some(spark, first, n):
    """Credentials of several departments, some without malware, some with a NULL counter, some without a department's name."""
    made = credentials(spark, first, n)
    return made.withColumns(
        {
            "dg": F.concat(F.lit("D"), F.col("id") % 3),
            "malware_name": F.when(F.col("id") % 4 > 0, F.concat(F.lit("m"), F.col("id") % 4)),
            "count_seen": F.when(F.col("id") % 7 > 0, F.lit(1)),
        }
    )


def raised(made, n):
    return made.select("id", F.upper("email").alias("email_key"), F.lit(n).cast("long").alias("n"))


def agree(store):
    """Do all summaries agree with those over the credentials, and is none of these read?"""
    parts, whole = store.statistics(), store.credentials()
    assert "/credentials/" not in plan(parts)
    for merged, plain in (
        (stats.merged_by_department, stats.by_department),
        (stats.merged_by_malware, stats.by_malware),
        (stats.merged_department_by_malware, stats.department_by_malware),
    ):
        assert rows(merged(parts).drop("addresses")) == rows(plain(whole))
    distinct = {r.dg: r.n for r in whole.groupBy("dg").agg(F.count_distinct(F.upper("email")).alias("n")).collect()}
    about = {r.dg: r.addresses for r in stats.merged_by_department(parts).collect()}
    assert about.keys() == distinct.keys() and all(abs(about[k] - n) <= 0.08 * n for k, n in distinct.items())


def test_counts_follow_batches_raises_updates_and_compactions(spark, folder):
    store = Store(spark, folder, buckets=8, statistics=True)
    assert rows(stats.merged_by_department(store.statistics())) == []
    store.commit("one", inserts=some(spark, 1, 150))
    store.commit("two", inserts=some(spark, 151, 60), raises=raised(some(spark, 140, 20), 3))  # raises of old and of new rows
    agree(store)
    edits = some(spark, 5, 3).withColumns({"dg": F.lit("moved"), "email": F.concat(F.lit("new"), F.col("id"), F.lit("@x.co"))})
    store.update_credentials(edits)
    agree(store)
    store.commit("three", raises=raised(some(spark, 1, 40).unionByName(edits), 2).union(raised(some(spark, 900, 5), 1)))  # some address nobody
    agree(store)
    store.compact()
    agree(store)
    Store(spark, folder).commit("four", inserts=some(spark, 300, 9), raises=raised(some(spark, 1, 10), 1))  # goes on with them unasked
    agree(store)


def test_repeated_rows_and_empty_batches(spark, folder):
    store = Store(spark, folder, statistics=True)
    store.commit("none", inserts=some(spark, 1, 0), raises=raised(some(spark, 1, 0), 1))
    twice = some(spark, 1, 10).withColumn("dg", F.when(F.col("id") > 3, F.col("dg")))
    store.commit("one", inserts=twice)
    store.commit("two", raises=raised(twice, 1).union(raised(twice, 4)))
    agree(store)


def test_a_store_that_begins_to_count_later(spark, folder):
    plainly = Store(spark, folder)
    plainly.commit("one", inserts=some(spark, 1, 20))
    store = Store(spark, folder, statistics=True)
    store.commit("two", inserts=some(spark, 21, 20), raises=raised(some(spark, 1, 5), 2))
    assert "/credentials/" in plan(store.statistics())  # the first batch has no counts, so the rows are counted
    assert rows(stats.merged_by_department(store.statistics()).drop("addresses")) == rows(stats.by_department(store.credentials()))
    store.compact()
    agree(store)


def test_a_loser_leaves_no_counts(spark, folder):
    Store(spark, folder, statistics=True).commit("one", inserts=some(spark, 1, 10))
    with pytest.raises(ConflictingWrite):
        Interrupted(spark, folder).commit("two", inserts=some(spark, 11, 10))
    agree(Store(spark, folder))


def test_only_buckets_of_raised_addresses_are_read(spark, folder, monkeypatch):
    store = Store(spark, folder, buckets=8, statistics=True)
    store.commit("one", inserts=some(spark, 1, 100))
    seen, kept = [], stats.raised_partials
    monkeypatch.setattr(stats, "raised_partials", lambda rows, *by: seen.append(plan(rows)) or kept(rows, *by))
    store.commit("two", raises=raised(some(spark, 3, 1), 1))
    assert "dynamicpruning" in seen[0]
    agree(store)
