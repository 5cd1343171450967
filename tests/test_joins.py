from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from breachlens.operators import enrich, joins, lookups
from breachlens.operators.ids import next_id, with_dense_ids

from .conftest import rows


def skewed(spark, n=4000):
    """A third of the rows own one key, a third have no key at all."""
    hot = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 97))
    return spark.range(n).select("id", hot.alias("key"), (F.col("id") % 5).alias("second"))


def test_heavy_keys_are_named(spark):
    found = joins.heavy_hashes(skewed(spark), ["key"])
    hot = spark.range(1).select(F.xxhash64(F.lit("hot")).alias("_h"))
    assert found.join(hot, "_h", "left_semi").count() == 1


def test_size_check(spark):
    context = spark.sparkContext
    big = spark.range(0, 10**9, 1, 500)
    context.setJobGroup("size", "size")
    assert not joins.fits_broadcast(big, 1000)
    tracker = context.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("size") for s in tracker.getJobInfo(j).stageIds]
    assert sum(tracker.getStageInfo(s).numCompletedTasks for s in stages) < 10
    assert joins.fits_broadcast(spark.range(1000), 1000) and not joins.fits_broadcast(spark.range(1001), 1000)
    assert joins.fits_broadcast(spark.range(0), 1) and not joins.fits_broadcast(spark.range(1), 0)
    wide = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("v"))
    assert joins.fits_broadcast(wide, 10, 20000) and not joins.fits_broadcast(wide, 10, 9000)


def test_lookup_is_the_same_beyond_the_bound(spark):
    facts = skewed(spark)
    table = spark.createDataFrame([("hot", 1), ("k3", 2), ("k5", None), (None, 9)], "key string, v int")
    small = joins.lookup(facts, table, "key", unique=F.col("id"))
    large = joins.lookup(facts, table, "key", unique=F.col("id"), max_broadcast_rows=0)
    assert small.columns == large.columns == ["id", "key", "second", "v"]
    assert rows(small) == rows(large) and small.count() == 4000
    # A table beyond the bound, but rows within it.
    few = facts.filter("id < 9")
    meets = joins.lookup(few, table, "key", unique=F.col("id"), max_broadcast_rows=10, small=False)
    assert rows(meets) == [r for r in rows(small) if r[0] < 9] and "approx_top_k" not in meets._jdf.queryExecution().toString()


def test_hot_rows_are_spread(spark):
    facts = skewed(spark, 30000)
    table = spark.range(2000).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = joins.lookup(facts, table, "key", unique=F.col("id"), max_broadcast_rows=0)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 30000 and max(sizes) < 30000 / 4 * 1.2


def test_semi_and_anti_with_two_keys(spark):
    facts = skewed(spark, 300)
    asked = spark.createDataFrame([("hot", 0), ("hot", 0), ("k4", 4)], "key string, second long")
    for bound in (0, 100):
        kept = joins.keep_matching(facts, asked, ["key", "second"], unique=F.col("id"), max_broadcast_rows=bound)
        left = joins.drop_matching(facts, asked, ["key", "second"], unique=F.col("id"), max_broadcast_rows=bound)
        wanted = [r for r in rows(facts) if (r[1], r[2]) in {("hot", 0), ("k4", 4)}]
        assert rows(kept) == wanted
        assert rows(left) == [r for r in rows(facts) if r not in wanted]


def test_bulk_lookups_beyond_the_bound(spark):
    store = spark.range(500).select(
        "id", F.concat(F.lit("User"), F.col("id") % 7, F.lit("@x.co")).alias("email"),
        F.concat(F.lit("p"), F.col("id") % 3).alias("password"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("p"), F.col("id") % 3)).alias("password_plain"),
        F.lit("p1").alias("password_hashed"), F.lit("x.CO").alias("domain"),
    )
    asked = spark.createDataFrame([("uSER3@X.co", "p1", "X.co"), ("none", "zz", "y")], "email string, password string, domain string")
    for ask in (lookups.rows_for_emails, lookups.rows_for_credentials, lookups.counts_by_email, lookups.counts_by_password,
                lookups.counts_by_domain):
        assert rows(ask(store, asked)) == rows(ask(store, asked, max_broadcast_rows=0))
    assert dict(rows(lookups.counts_by_password(store, asked))) == {"p1": 500, "zz": 0}
    assert lookups.count_by_password(store, "p1").first()["count"] == 500
    assert lookups.count_by_email(store, "none").first()["count"] == 0


def test_first_directory_entry_wins(spark):
    schema = "mail string, dg array<string>, ecMoniker array<string>, recordStatus array<string>, uid array<string>, cn array<string>"
    entries = spark.createDataFrame(
        [
            ("A@x.co", ["D2"], ["u2"], ["a"], ["2"], None), ("a@X.co", ["D1", "D9"], ["u1"], ["I"], ["1"], None),
            ("b@x.co", [""], None, ["a"], ["1"], None), ("c@x.co", [], [], [], ["1"], None), (None, ["D"], [], [], ["1"], None),
        ], schema,
    )
    asked = spark.createDataFrame([(1, "a@x.CO"), (2, "B@x.co"), (3, "c@x.co"), (4, "d@x.co")], "id int, email string")
    for bound in (0, 100):
        known = enrich.with_person(asked, entries, unique=F.col("id"), max_broadcast_rows=bound)
        found = known.select("id", enrich.department(), "user_id", enrich.is_active())
        assert rows(found) == [(1, "D1", "u1", False), (2, "Unknown", None, True), (3, "Unknown", None, False),
                               (4, "Unknown", None, False)]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 10**6), unique=True, max_size=60), st.integers(1, 5))
def test_dense_ids_follow_the_order(spark, keys, first):
    df = spark.createDataFrame([(k, f"v{k}") for k in keys], "k long, v string").repartition(3)
    found = {r.k: r.id for r in with_dense_ids(df, ["k"], first).collect()}
    assert found == {k: first + i for i, k in enumerate(sorted(keys))}


def test_next_id(spark):
    assert next_id(spark.range(5)) == 5
    assert next_id(spark.range(0)) == 1
