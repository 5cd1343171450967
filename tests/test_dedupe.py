from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from breachlens.functions.text import normalize_email
from breachlens.operators import dedupe
from breachlens.session import staged

from .conftest import rows

SCHEMA = "id long, email string, password string"


def batch(spark, pairs):
    return spark.createDataFrame([(i, *pair) for i, pair in enumerate(pairs)], SCHEMA)


def test_known_and_unseen(spark):
    store = batch(spark, [("mira@example.org", "first-pw")])
    asked = batch(spark, [("mira@example.org", "first-pw"), ("nobody7@example.org", "other-pw"),
                          ("Mira@example.org", "first-pw"), ("mira@example.org", None), ("mira@example.org", None),
                          ("nobody7@example.org", "other-pw"), (None, "first-pw")])
    for bound in (0, 1000):
        fresh = dedupe.drop_known(asked, store, order=["id"], unique=F.col("id"), max_broadcast_rows=bound)
        assert [r[0] for r in rows(fresh)] == [1, 2, 3, 4, 6]


def test_null_keys_never_meet_even_if_they_look_alike(spark):
    odd = batch(spark, [("a", None), ("a", "row0"), ("a", "\u0000row0"), ("a", "=x"), ("a", "x")])
    assert dedupe.keep_first(odd, order=["id"], unique=F.col("id")).count() == 5
    store = batch(spark, [("a", None), ("a", "x")])
    fresh = dedupe.drop_known(odd, store, order=["id"], unique=F.col("id"))
    assert [r[0] for r in rows(fresh)] == [0, 1, 2, 3]


def test_scope_of_the_key(spark):
    schema = SCHEMA + ", leak_id long, domain string"
    store = spark.createDataFrame([(0, "a", "p", 1, "d"), (1, "b", "p", 1, None)], schema)
    asked = spark.createDataFrame([(0, "a", "p", 1, "d"), (1, "a", "p", 2, "d"), (2, "b", "p", 1, None), (3, "b", "p", 1, None)], schema)
    narrow = dedupe.drop_known(asked, store, ["leak_id", "email", "password", "domain"], order=["id"], unique=F.col("id"))
    assert [r[0] for r in rows(narrow.select("id"))] == [1, 2, 3]
    assert dedupe.drop_known(asked, store, order=["id"], unique=F.col("id")).count() == 0


def test_a_third_of_the_rows_are_copies(spark):
    many = spark.range(9000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("u"), F.col("id"))).alias("email"),
        F.lit("p").alias("password"),
    )
    assert dedupe.keep_first(many, order=["id"], unique=F.col("id")).count() == 6001


def one_by_one(store, feed):
    """The rule as a loop: look the raw pair up, then store the normal form."""
    known, kept = set(store), []
    for position, (email, password) in enumerate(feed):
        if (email, password) in known:
            continue
        local, _, host = email.partition("@")
        known.add((f"{local}@{host.lower()}", password))
        kept.append(position)
    return kept


SPELLINGS = st.sampled_from(["a@x.co", "a@X.co", "a@X.CO", "A@x.co", "b@x.co", "b@X.co"])
PAIRS = st.lists(st.tuples(SPELLINGS, st.sampled_from(["p", "q"])), max_size=14)


@settings(max_examples=10, deadline=None)
@given(PAIRS, PAIRS, st.sampled_from([0, 1000]))
def test_feed_agrees_with_the_loop(spark, stored, feed, bound):
    incoming = staged(batch(spark, feed).withColumn("email_stored", normalize_email(F.col("email"))), "test")
    fresh = dedupe.drop_known_in_feed(
        incoming, batch(spark, stored), order=["id"], unique=F.col("id"), max_broadcast_rows=bound
    )
    assert sorted(r.id for r in fresh.select("id").collect()) == one_by_one(stored, feed)


@settings(max_examples=8, deadline=None)
@given(PAIRS, PAIRS)
def test_feed_within_one_leak_agrees_with_the_loop(spark, stored, feed):
    """The narrower key, with a domain that is sometimes missing and then never matches."""

    def with_domain(pairs):
        return batch(spark, pairs).withColumns(
            {"leak_id": F.lit(1), "domain": F.when(F.col("password") == "p", F.lit("x.co"))}
        )

    incoming = staged(with_domain(feed).withColumn("email_stored", normalize_email(F.col("email"))), "test")
    key = ["leak_id", "email", "password", "domain"]
    fresh = dedupe.drop_known_in_feed(incoming, with_domain(stored), key, order=["id"], unique=F.col("id"))
    matchable = one_by_one([s for s in stored if s[1] == "p"], [(e, p if p == "p" else i) for i, (e, p) in enumerate(feed)])
    assert sorted(r.id for r in fresh.select("id").collect()) == matchable


def test_copies_per_key(spark):
    data = batch(spark, [("a", "p"), ("a", "p"), ("a", None), ("a", None), ("b", "p")])
    counted = dedupe.copies_per_key(data, ["email", "password"], F.col("id"))
    assert rows(counted) == sorted([("a", "p", 2), ("a", None, 1), ("a", None, 1), ("b", "p", 1)], key=repr)
