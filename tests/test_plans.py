"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from breachlens.catalog.derived import Tables
from breachlens.operators import changes, dedupe, enrich, lookups
from breachlens.plans.store import Store
from breachlens.schemas import LEAK_DATA

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning", plan(df)))


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, FOLDER)


def test_small_tables_are_broadcast(t):
    text = plan(enrich.with_person(enrich.with_vip(t.cred, t.vips, unique=F.col("id")), t.directory, unique=F.col("id")))
    assert text.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in text


def test_dedupe_and_upsert_shuffle_twice(spark, t):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = {"order": ["id"], "unique": F.col("id")}
        assert exchanges(dedupe.drop_known(t.batch, t.store, max_broadcast_rows=0, **keys)) == 2
        small = plan(dedupe.drop_known(t.batch, t.store, **keys))
        # The store meets a small batch before anything of it is shuffled.
        assert re.search(r"BroadcastHashJoin .*LeftSemi", small)
        stored = t.store.select(*LEAK_DATA.names)
        assert exchanges(changes.upsert(stored, t.batch.drop("count_seen"), order=["id"], unique=F.col("id"))) == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_counts_combine_before_the_shuffle(t):
    text = plan(lookups.counts_by_domain(t.cred, t.asked_domains))
    assert "partial_count" in text


def test_lookup_reaches_the_scan(spark, t, folder):
    store = Store(spark, folder)
    store.commit("one", inserts=t.target.limit(500))
    text = plan(lookups.by_email(store.rows(), "user3@x.co"))
    assert "EqualTo(email_key,USER3@X.CO)" in text
    narrow = plan(lookups.by_email(store.rows(), "user3@x.co").agg(F.count("*")))
    assert "ReadSchema: struct<email_key:string>" in narrow
    store.commit("two", raises=t.target.limit(500).select("id", F.upper("email").alias("email_key"), F.lit(1).alias("n")))
    counted = plan(lookups.by_email(store.credentials(), "user3@x.co"))
    assert counted.count("EqualTo(email_key,USER3@X.CO)") == 2


def test_bulk_dedupe_reads_two_columns_of_the_store(spark, t, folder):
    store = Store(spark, folder)
    store.commit("one", inserts=t.target.limit(500))
    text = plan(dedupe.drop_known(t.batch, store.rows(), order=["id"], unique=F.col("id"), max_broadcast_rows=0))
    assert "ReadSchema: struct<email:string,password:string>" in text


def test_staging_leaves_the_session_as_it_was(spark, t):
    from breachlens.session import METHOD_LIMIT, settings, staged

    key = next(iter(METHOD_LIMIT))
    before = spark.conf.get(key, None)
    spark.conf.set(key, "12345")
    try:
        copy = staged(t.cred, "test")
        assert spark.conf.get(key) == "12345" and copy.count() == t.cred.count() and copy.dtypes == t.cred.dtypes
        with pytest.raises(RuntimeError), settings(spark, {key: "1", "spark.sql.own.setting": "x"}):
            raise RuntimeError
        assert spark.conf.get(key) == "12345" and spark.conf.get("spark.sql.own.setting", None) is None
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
