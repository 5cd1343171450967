import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from breachlens.operators import changes
from breachlens.schemas import LEAK, LEAK_DATA, LEAK_DATA_KEY

from .conftest import rows

COLUMNS = "id long, leak_id long, email string, password string, domain string, browser string, count_seen long, dg string"
BATCH = "pos long, leak_id long, email string, password string, domain string, browser string"


def args():
    return {"order": ["pos"], "unique": F.col("pos")}


def store(spark, data):
    return spark.createDataFrame([(*d, "D") for d in data], COLUMNS)


def batch(spark, data):
    return spark.createDataFrame([(i, *d) for i, d in enumerate(data)], BATCH)


def test_upsert_cases(spark):
    before = store(spark, [(1, 1, "a", "p", "d", "old", 4), (2, 1, "b", "p", "d", "old", None), (3, 1, "c", "p", None, "old", 7)])
    more = batch(
        spark,
        [(1, "a", "p", "d", "new"), (1, "a", "p", "d", "new"), (1, "b", "p", "d", "new"), (1, "c", "p", None, "n1"),
         (1, "c", "p", None, "n2"), (1, "z", "p", "d", "first"), (1, "z", "p", "d", "second"), (2, "a", "p", "d", "other")],
    )
    after = changes.upsert(before, more, **args())
    found = rows(after.select("id", "leak_id", "email", "domain", "browser", "count_seen", "_is_new", "_touched"))
    assert found == sorted(
        [(1, 1, "a", "d", "old", 6, False, True), (2, 1, "b", "d", "old", None, False, True),
         (3, 1, "c", None, "old", 7, False, False), (None, 1, "c", None, "n1", 1, True, True),
         (None, 1, "c", None, "n2", 1, True, True), (None, 1, "z", "d", "first", 2, True, True),
         (None, 2, "a", "d", "other", 1, True, True)], key=repr,
    )
    assert changes.touched(after).count() == 6


KEYS = st.tuples(st.integers(1, 2), st.sampled_from("ab"), st.sampled_from("pq"), st.sampled_from(["d", None]))


@settings(max_examples=6, deadline=None)
@given(st.lists(KEYS, max_size=6), st.lists(KEYS, max_size=10), st.sampled_from([0, 1000]))
def test_both_upserts_agree_with_a_loop(spark, held, arriving, bound):
    table = {}
    for key in held:
        table[key if key[3] else (*key, len(table))] = 3
    before = store(spark, [(i + 1, *k[:4], "x", n) for i, (k, n) in enumerate(table.items())])
    ids = {k: i + 1 for i, k in enumerate(table)}
    more = batch(spark, [(*k, "y") for k in arriving])

    wanted = dict(table)
    for key in arriving:
        key = key if key[3] else (*key, "n", len(wanted))
        wanted[key] = wanted.get(key, 0) + 1
    whole = changes.upsert(before, more, **args())
    assert rows(whole.select(*LEAK_DATA_KEY, "count_seen")) == sorted(((*k[:4], n) for k, n in wanted.items()), key=repr)

    resolved = changes.resolve_batch(before, more, max_broadcast_rows=bound, **args())
    raised = dict(rows(changes.raises(resolved).select("id", "n")))
    assert raised == {ids[k]: n - table[k] for k, n in wanted.items() if k in table and n > table[k]}
    new = changes.inserts(resolved, before.schema, first_id=len(ids) + 1, order=["pos"])
    expected = [(len(ids) + 1 + i, *k[:4], n) for i, (k, n) in enumerate((k, n) for k, n in wanted.items() if k not in table)]
    assert rows(new.select("id", *LEAK_DATA_KEY, "count_seen")) == sorted(expected, key=repr)


def test_twice_the_same_batch_adds_no_rows(spark):
    more = batch(spark, [(1, "a", "p", "d", "x"), (1, "a", "p", "d", "x"), (1, "b", "p", "d", "x")])
    empty = store(spark, [])
    once = changes.upsert(empty, more, **args()).drop("_touched", "_is_new")
    twice = changes.upsert(once.withColumn("id", F.lit(1).cast("long")), more, **args())
    assert rows(once.select("email", "count_seen")) == [("a", 2), ("b", 1)]
    assert rows(twice.select("email", "count_seen")) == [("a", 4), ("b", 2)]


def test_insert_or_get(spark):
    before = store(spark, [(5, 1, "a", "p", "d", "old", 4)])
    more = batch(spark, [(1, "b", "p", "d", "n"), (1, "a", "p", "d", "n"), (1, "b", "p", "d", "n"), (1, "a", "p", None, "n")])
    added, answer = changes.insert_or_get(before, more, **args())
    assert rows(answer.select("pos", "id", "inserted")) == [(0, 6, True), (1, 5, False), (2, 6, True), (3, 7, True)]
    assert rows(added.select("id", "email", "domain", "browser", "count_seen")) == [(6, "b", "d", "n", 1), (7, "a", None, "n", 1)]


def leaks(spark, data):
    return spark.createDataFrame([(i, None, None, "2024-01-01", s, t, r, None) for i, s, t, r in data],
                                 "id long, breach_ts string, source_publish_ts string, ingestion_ts string, summary string, "
                                 "ticket_id string, reporter_name string, source_name string").select(
        *[F.col(f.name).cast(f.dataType) for f in LEAK])


def test_update_writes_nulls_and_keeps_the_rest(spark):
    before = leaks(spark, [(1, "s1", "t1", "r1"), (2, "s2", "t2", "r2")])
    edits = leaks(spark, [(2, "new", None, None), (9, "none", None, None)]).drop("ingestion_ts")
    after = changes.update_leaks(before, edits)
    assert rows(after.select("id", "summary", "ticket_id", "reporter_name")) == [(1, "s1", "t1", "r1"), (2, "new", None, None)]
    assert after.filter("ingestion_ts is null").count() == 0
    assert rows(changes.unknown_ids(before, edits).select("id")) == [(9,)]


def test_new_leaks(spark):
    before = leaks(spark, [(4, "s", "t", None)])
    new = spark.createDataFrame([(1, "b", "t2"), (0, "a", "t1")], "pos int, summary string, ticket_id string")
    added = changes.append_leaks(before, new, run_ts=F.lit("2024-03-01").cast("timestamp"), order=["pos"])
    assert rows(added.select("id", "summary", "ticket_id", "source_name")) == [(5, "a", "t1", None), (6, "b", "t2", None)]
    assert added.filter("ingestion_ts is null").count() == 0
    with pytest.raises(Exception, match="summary not given"):
        nameless = new.withColumn("summary", F.lit(None).cast("string"))
        changes.append_leaks(before, nameless, run_ts=F.lit("2024-03-01").cast("timestamp"), order=["pos"])


def test_update_needs_an_id(spark):
    before = leaks(spark, [(1, "s1", "t1", "r1")])
    with pytest.raises(Exception, match="id not given"):
        changes.update_leaks(before, leaks(spark, [(None, "x", None, None)])).collect()


def test_update_of_credentials_keeps_counter_and_target(spark):
    row = {f.name: None for f in LEAK_DATA} | {"id": 1, "leak_id": 1, "email": "a", "password": "p", "dg": "D", "count_seen": 5,
                                               "target_domain": "t", "domain": "d"}
    before = spark.createDataFrame([row, row | {"id": 2, "email": "b"}], LEAK_DATA)
    edits = spark.createDataFrame([row | {"id": 2, "count_seen": 99, "target_domain": "changed"}], LEAK_DATA)
    after = changes.update_credentials(before, edits)
    assert rows(after.select("id", "email", "count_seen", "target_domain")) == [(1, "a", 5, "t"), (2, "a", 5, "t")]
    assert changes.duplicate_keys(after).count() == 1 and changes.duplicate_keys(before).count() == 0


def test_find_or_create(spark):
    before = leaks(spark, [(3, "s", "t", None), (2, "s", "t", None), (4, "s", "other", None)])
    wanted = spark.createDataFrame([("s", "t"), ("s", "t"), ("s", "new"), ("a", "t")], "summary string, ticket_id string")
    answer, created = changes.find_or_create_leaks(
        before, wanted, run_ts=F.lit("2024-03-01").cast("timestamp"), source_name="SpyCloud"
    )
    assert rows(answer) == [("a", "t", 5, True), ("s", "new", 6, True), ("s", "t", 2, False)]
    assert rows(created.select("id", "source_name", "summary")) == [(5, "SpyCloud", "a"), (6, "SpyCloud", "s")]
    assert [f.name for f in created.schema] == [f.name for f in LEAK]
    half = spark.createDataFrame([("s", None)], "summary string, ticket_id string")
    with pytest.raises(Exception, match="one is missing"):
        changes.find_or_create_leaks(before, half, run_ts=F.lit("2024-03-01").cast("timestamp"), source_name="SpyCloud")


def test_times_as_text(spark):
    before = leaks(spark, [(4, "s", "t", None)])
    new = spark.createDataFrame(
        [(0, "a", "2024-05-01T10:00:00Z"), (1, "b", "2024-05-01 12:00:00+02:00"), (2, "c", None)], "pos int, summary string, breach_ts string"
    )
    options = {"run_ts": F.lit("2024-03-01").cast("timestamp"), "order": ["pos"]}
    added = changes.append_leaks(before, new, **options)
    assert [str(r.t) for r in added.orderBy("id").select(F.col("breach_ts").cast("string").alias("t")).collect()] == [
        "2024-05-01 10:00:00", "2024-05-01 10:00:00", "None"
    ]
    with pytest.raises(Exception, match="not a time"):
        changes.append_leaks(before, new.withColumn("breach_ts", F.lit("soon")), **options).collect()


def test_split_by_known_leak(spark):
    creds = spark.createDataFrame([(1, 1), (2, 7), (3, None)], "id long, leak_id long")
    good, bad = changes.split_by_known_leak(creds, leaks(spark, [(1, "s", "t", None)]), unique=F.col("id"))
    assert rows(good) == [(1, 1)] and rows(bad) == [(2, 7), (3, None)]
