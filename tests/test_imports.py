import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from breachlens.functions.values import SPYCLOUD_SOURCE
from breachlens.operators import changes, lookups
from breachlens.plans import imports
from breachlens.plans.store import ConflictingWrite, KeyClash, Store
from breachlens.schemas import DIRECTORY, LEAK_CSV_COLUMNS, LEAK_DATA, SPYCLOUD_COLUMNS
from breachlens.streaming.folder import stream_import

from .conftest import rows

HEADER = "breach_title,email,domain,password,email_domain,email_username,password_plaintext,ip_addresses,password_type"


def line(email, password="pw", title="B", host="x.co", ip="-"):
    return f"{title},{email},x.co,{password},{host},u,{password},{ip},plaintext"


def write(folder, name, lines, header=HEADER):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as handle:
        handle.write("\n".join([header, *lines]) + "\n")
    return path


def run_ts():
    return F.lit("2024-03-01 00:00:00").cast("timestamp")


@pytest.fixture()
def reference(spark):
    entry = {"mail": "vip@x.co", "dg": ["D1"], "ecMoniker": ["u"], "recordStatus": ["A"], "uid": ["1"]}
    directory = spark.createDataFrame([{f.name: entry.get(f.name) for f in DIRECTORY}], DIRECTORY)
    return imports.Reference(vips=spark.createDataFrame([("VIP@X.CO",)], "email_key string"), directory=directory)


def load(spark, store, path, reference, batch="b1", **options):
    return imports.import_spycloud_files(
        spark, store, path, ticket_id="T-1", summary="feed", reference=reference, run_ts=run_ts(), batch=batch, **options
    )


LINES = [
    line("vip@x.co"), line("vip@x.co"), line("Vip@X.co"), line("Vip@X.co"), line("bob@europa.eu", ip="1.2.3.4"),
    line("eve@x.co", ip="999.1.1.1"), line("eve@x.co"), line("no address"), line("sam@x.co", password="-"),
    line("tim@x.co", title="-"), line("too@x.co") + ",extra",
]


def test_feed_end_to_end(spark, folder, reference):
    store = Store(spark, folder + "/store")
    result = load(spark, store, write(folder, "a.csv", LINES), reference)
    report = result.report.first()
    assert (report.rows_in, report["count"], report.duplicates, report.filtered, report.rejected) == (11, 5, 1, 0, 5)
    assert (report.inserted, report.raised, report.success) == (4, 0, True)
    reasons = {r.error_msg for r in result.rejected.collect()}
    assert reasons == {"ip: not an address", "email: not a valid address", "password: field required",
                       "breach_title: field required", "too many fields"}
    assert result.rejected.filter("original_line is null").count() == 0
    outcome = {r.email: r for r in result.outcome.collect()}
    assert outcome["vip@x.co"].is_vip and outcome["vip@x.co"].dg == "D1" and outcome["vip@x.co"].is_active_account
    assert not outcome["vip@x.co"].notify and outcome["bob@europa.eu"].notify
    assert outcome["bob@europa.eu"].report_to == ["bob@europa.eu"] and outcome["bob@europa.eu"].dg == "Unknown"
    assert outcome["bob@europa.eu"].credential_type == ["EU Login"]
    found = rows(store.credentials().select("id", "leak_id", "email", "count_seen", "dg", "password_plain", "ip"))
    # The other spelling is stored in normal form: its second copy meets the first and raises the counter.
    assert found == [
        (1, 1, "vip@x.co", 1, "D1", "pw", None), (2, 1, "Vip@x.co", 2, "D1", "pw", None),
        (3, 1, "bob@europa.eu", 1, "Unknown", "pw", "1.2.3.4"), (4, 1, "eve@x.co", 1, "Unknown", "pw", None),
    ]
    leak = store.leaks().first()
    assert (leak.id, leak.summary, leak.ticket_id, leak.source_name) == (1, "feed", "T-1", SPYCLOUD_SOURCE)


MAIL = st.sampled_from(["a@x.co", "a@X.co", "A@x.co", "b@x.co", "not one", None])
FEED = st.lists(st.tuples(MAIL, st.sampled_from(["p", "q", None]), st.sampled_from(["x.co", "y.co"])), max_size=16)
HELD = st.lists(
    st.tuples(st.sampled_from([1, 2]), st.sampled_from(["a@x.co", "a@X.co", "b@x.co"]), st.sampled_from("pq"),
              st.sampled_from(["x.co", None])),
    max_size=3, unique_by=lambda h: h[:3],
)


def one_by_one(held, feed):
    """The import as the loop it replaces: check, look up, normalize, insert or count."""
    table = {key: [i + 1, 1] for i, key in enumerate(held)}
    pairs = {(email, password) for _, email, password, _ in held}
    bad = dropped = 0
    for email, password, domain in feed:
        if email in (None, "not one") or password is None:
            bad += 1
        elif (email, password) in pairs:
            dropped += 1
        else:
            local, host = email.split("@")
            stored = f"{local}@{host.lower()}"
            pairs.add((stored, password))
            slot = table.setdefault((1, stored, password, domain), [len(table) + 1, 0])
            slot[1] += 1
    return bad, dropped, table


@settings(max_examples=6, deadline=None)
@given(HELD, FEED, st.sampled_from([0, 1000]))
def test_feed_import_agrees_with_the_loop(spark, held, feed, bound):
    stored = spark.createDataFrame(
        [(i + 1, *key, 1) for i, key in enumerate(held)],
        "id long, leak_id long, email string, password string, domain string, count_seen long",
    )
    cells = "email string, password string, email_domain string, src_ord long"
    arriving = spark.createDataFrame([(*r, i) for i, r in enumerate(feed)], cells).withColumns(
        {"src_file": F.lit("f"), "src_block": F.lit(0).cast("long")}
        | {c: F.lit("x") for c in ("breach_title", "domain", "email_username")}
    )
    scan = arriving.withColumns({c: F.lit(None).cast("string") for c in SPYCLOUD_COLUMNS if c not in arriving.columns})
    nobody = imports.Reference(
        vips=spark.createDataFrame([], "email_key string"), directory=spark.createDataFrame([], DIRECTORY)
    )
    result = imports.import_feed(scan, stored=stored, leak_id=1, reference=nobody, max_broadcast_rows=bound)
    bad, dropped, table = one_by_one(held, feed)
    report = result.report.first()
    assert (report.rejected, report.duplicates) == (bad, dropped)
    raised = dict(rows(result.raises.select("id", "n")))
    after = {
        (r.leak_id, r.email, r.password, r.domain): [r.id, r.count_seen + raised.get(r.id, 0)]
        for r in stored.unionByName(result.inserts.select(*stored.columns)).collect()
    }
    assert after == table


def test_second_import_finds_the_leak_and_drops_known_rows(spark, folder, reference):
    store = Store(spark, folder + "/store")
    path = write(folder, "a.csv", LINES)
    load(spark, store, path, reference)
    again = load(spark, store, path, reference, batch="b2")
    report = again.report.first()
    # Only the other spelling passes the dedupe again, and raises its own stored row.
    assert (report["count"], report.duplicates, report.inserted, report.raised) == (2, 4, 0, 1)
    assert store.leaks().count() == 1
    assert dict(rows(store.credentials().select("email", "count_seen")))["Vip@x.co"] == 4
    assert rows(imports.touched_rows(store.credentials(), again).select("email", "is_new")) == [("Vip@x.co", False)]
    third = load(spark, store, write(folder, "b.csv", [line("new@x.co")]), reference, batch="b3")
    assert rows(imports.touched_rows(store.credentials(), third).select("id", "is_new")) == [(5, True)]


def test_large_path_gives_the_same(spark, folder, reference):
    path = write(folder, "a.csv", LINES)
    results = []
    for name, bound in (("one", 0), ("two", 1000)):
        store = Store(spark, f"{folder}/{name}")
        load(spark, store, path, reference, max_broadcast_rows=bound)
        load(spark, store, path, reference, batch="b2", max_broadcast_rows=bound)
        results.append(rows(store.credentials()))
    assert results[0] == results[1]


def test_a_batch_counts_once(spark, folder, reference):
    store = Store(spark, folder + "/store")
    path = write(folder, "a.csv", LINES)
    load(spark, store, path, reference)
    before = rows(store.credentials())
    load(spark, store, path, reference)
    assert rows(store.credentials()) == before


def test_nothing_is_visible_before_the_log_row(spark, folder, reference, monkeypatch):
    store = Store(spark, folder + "/store")
    path = write(folder, "a.csv", LINES)

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(Store, "_publish", dies)
        with pytest.raises(RuntimeError):
            load(spark, store, path, reference)
    assert store.credentials().count() == 0 and store.leaks().count() == 0
    load(spark, store, path, reference)
    assert store.credentials().count() == 4


def test_filter_strict_and_arguments(spark, folder, reference):
    store = Store(spark, folder + "/store")
    path = write(folder, "a.csv", LINES)
    with pytest.raises(imports.BadRows):
        load(spark, store, path, reference, strict=True)
    with pytest.raises(ValueError):
        imports.import_spycloud_files(
            spark, store, path, ticket_id="", summary="s", reference=reference, run_ts=run_ts(), batch="b"
        )
    result = load(spark, store, path, reference, row_filter=F.col("email") != "eve@x.co")
    report = result.report.first()
    assert (report.filtered, report["count"]) == (1, 4)


def test_hooks(spark, folder, reference):
    """Own collector, parser, enricher and output."""
    from breachlens.operators import normalize
    from breachlens.sources.files import scan_spycloud

    store, seen, used = Store(spark, folder + "/store"), [], []

    def collector(spark, paths):
        used.append("collector")
        return scan_spycloud(spark, paths).filter("email like '%@x.co'")

    result = load(
        spark, store, write(folder, "a.csv", LINES), reference, collector=collector,
        parser=lambda scan: normalize.parse_spycloud(scan, normalize.BY_NAME_MAPPING),
        enrichers=[lambda df: df.withColumn("malware_name", F.lit("stealer"))], outputs=[lambda df: seen.append(df.count())],
    )
    assert used == ["collector"] and seen == [result.outcome.count()]
    assert rows(store.credentials().select("malware_name", "password_plain").distinct()) == [("stealer", None)]


def leak_line(email, password="pw", verified="t", domain="x.co", ip="1.1.1.1"):
    return f"{email},{password},{password},,,T-9,{verified},f,{ip},{domain},Chrome 1,,host 1,D"


def test_import_by_leak(spark, folder, reference):
    store = Store(spark, folder + "/store")
    load(spark, store, write(folder, "a.csv", [line("bob@europa.eu")]), reference)
    header = ",".join(LEAK_CSV_COLUMNS)
    lines = [leak_line("bob@europa.eu"), leak_line("amy@x.co", "000123"), leak_line("amy@x.co", "000123"),
             leak_line("nod@x.co", domain=""), leak_line("nod@x.co", domain=""), leak_line("bad@x.co", verified="maybe"),
             leak_line("", "x"), leak_line("ip@x.co", ip="x")]
    path = write(folder, "b.csv", lines, header)
    with pytest.raises(imports.UnknownLeak):
        imports.import_leak_files(spark, store, path, leak_id=77, batch="b2")
    result = imports.import_leak_files(spark, store, path, leak_id=1, batch="b2")
    report = result.report.first()
    assert (report.rows_in, report["count"], report.rejected, report.duplicates) == (8, 5, 3, 0)
    found = imports.touched_rows(store.credentials(), result)
    assert rows(found.select("id", "email", "password", "count_seen", "email_verified", "is_new")) == [
        (1, "bob@europa.eu", "pw", 2, False, False), (2, "amy@x.co", "000123", 2, True, True),
        (3, "nod@x.co", "pw", 1, True, True), (4, "nod@x.co", "pw", 1, True, True),
    ]


def test_update_and_compact(spark, folder, reference):
    store = Store(spark, folder + "/store")
    path = write(folder, "a.csv", LINES)
    load(spark, store, path, reference)
    load(spark, store, path, reference, batch="b2")
    before = rows(store.credentials())
    store.compact()
    assert rows(store.credentials()) == before and [r.kind for r in store.log()] == ["base"]
    # A folded batch is still known.
    load(spark, store, path, reference, batch="b2")
    assert rows(store.credentials()) == before
    edits = store.credentials().filter("id = 3").withColumn("browser", F.lit("Edge"))
    store.update_credentials(edits)
    assert [r.browser for r in lookups.by_value(store.credentials(), "id", 3).collect()] == ["Edge"]
    assert store.leaks().count() == 1 and store.next_id() == 5
    load(spark, store, write(folder, "c.csv", [line("late@x.co")]), reference, batch="b4")
    assert store.credentials().count() == 5


def test_names_of_batches_are_never_mixed_up(spark, folder, reference):
    store = Store(spark, folder + "/store")
    names = [("x/1", "batch"), ("x:1", "batch"), ("base", "batch"), ("x:1", "stream"), ("", "batch")]
    inserts = spark.createDataFrame([{"id": 1, "email": "a@x.co", "count_seen": 1}], "id long, email string, count_seen int")
    full = inserts.select(*[F.col(f.name) if f.name in inserts.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in LEAK_DATA])
    for n, (name, kind) in enumerate(names):
        assert not store.has(name, kind)
        assert store.commit(name, kind=kind, inserts=full.withColumn("id", F.lit(n + 1)))
        if n == 2:
            store.compact()
        assert store.has(name, kind) and not store.commit(name, kind=kind, inserts=full)
    assert store.credentials().count() == len(names)
    with pytest.raises(ValueError):
        store.commit("x", kind="base")


def test_the_second_of_two_racing_writers_fails(spark, folder, reference):
    store = Store(spark, folder + "/store")
    seen = store.mark()
    load(spark, store, write(folder, "a.csv", LINES), reference)
    before = rows(store.credentials())
    with pytest.raises(ConflictingWrite):
        Store(spark, folder + "/store").commit("other", inserts=store.credentials().drop("email_key"), since=seen)
    assert rows(store.credentials()) == before and not store.has("other")


def test_a_known_batch_is_not_worked_through_again(spark, folder, reference):
    store, path = Store(spark, folder + "/store"), write(folder, "a.csv", LINES)
    assert not load(spark, store, path, reference).already_applied
    assert load(spark, store, folder + "/not-there.csv", reference, collector=lambda spark, paths: None).already_applied


def test_outputs_get_the_same_rows_after_a_crash(spark, folder, reference):
    store, path, seen = Store(spark, folder + "/store"), write(folder, "a.csv", LINES), []

    def dies(df):
        raise InterruptedError

    with pytest.raises(InterruptedError):
        load(spark, store, path, reference, outputs=[dies])
    assert store.credentials().count() == 4
    for _ in range(2):
        load(spark, store, path, reference, outputs=[lambda df: seen.append(df.count())])
    assert seen == [5]


def test_failed_enrichment_is_flagged_and_not_stored(spark, folder, reference):
    store = Store(spark, folder + "/store")
    lines = [line("amy@x.co"), line("amy@x.co"), line("bob@x.co"), line("cat@x.co")]

    def enricher(df):
        failed = F.when(F.col("src_ord") == df.agg(F.min("src_ord")).first()[0], F.lit("directory down"))
        return df.withColumn("error_msg", failed).withColumn("email", F.when(F.col("email") == "cat@x.co", F.lit("no address")).otherwise(F.col("email")))

    result = load(spark, store, write(folder, "a.csv", lines), reference, enrichers=[enricher])
    assert rows(store.credentials().select("email")) == [("amy@x.co",), ("bob@x.co",)]
    assert rows(result.flagged.select("notify", "needs_human_intervention")) == [(False, True)] * 2
    assert rows(result.rejected.select("error_msg")) == [("directory down",), ("email: not a valid address",)]
    report = result.report.first()
    assert (report.rows_in, report["count"], report.duplicates, report.rejected) == (4, 2, 0, 2)


def test_update_checks_keys_and_repeats(spark, folder, reference):
    store = Store(spark, folder + "/store")
    load(spark, store, write(folder, "a.csv", [line("amy@x.co"), line("bob@x.co")]), reference)
    amy = store.credentials().filter("email = 'amy@x.co'").drop("email_key")
    with pytest.raises(KeyClash):
        store.update_credentials(amy.withColumn("id", F.lit(3) - F.col("id")))
    twice = amy.withColumn("browser", F.lit("A")).unionByName(amy.withColumn("browser", F.lit("B")))
    with pytest.raises(Exception, match="more than one change"):
        store.update_credentials(twice)
    store.update_credentials(twice, order=["browser"])
    assert rows(store.credentials().select("email", "browser")) == [("amy@x.co", "B"), ("bob@x.co", None)]


def test_bulk_lookup_over_raises(spark, folder, reference):
    store, path = Store(spark, folder + "/store"), write(folder, "a.csv", LINES)
    load(spark, store, path, reference)
    load(spark, store, path, reference, batch="b2")
    asked = spark.createDataFrame([("VIP@x.co",), ("nobody@x.co",), (None,)], "email string")
    found = rows(lookups.rows_for_emails(store.credentials(asked), asked))
    assert found == rows(lookups.rows_for_emails(store.credentials(), asked)) and len(found) == 2


def test_stream_equals_batch(spark, folder, reference):
    everything = LINES + [line(f"user{i}@x.co") for i in range(20)]
    for i in range(3):
        write(folder + "/landing", f"{i}.csv", everything[i * 11 : (i + 1) * 11])
    streamed = Store(spark, folder + "/streamed")

    def run():
        stream_import(
            spark, streamed, folder + "/landing", name="s", checkpoint=folder + "/checkpoint", ticket_id="T-1", summary="feed",
            reference=reference, run_ts=run_ts(), header=HEADER.split(","), files_per_batch=1,
        ).awaitTermination()

    run()
    whole = Store(spark, folder + "/whole")
    load(spark, whole, write(folder, "all.csv", everything), reference)
    columns = ["leak_id", "email", "password", "domain", "count_seen", "dg"]
    assert rows(streamed.credentials().select(columns)) == rows(whole.credentials().select(columns))
    assert len(streamed.log()) == 3
    run()
    assert len(streamed.log()) == 3
    # More files later continue the same store.
    write(folder + "/landing", "9.csv", [line("later@x.co"), line("user1@x.co")])
    run()
    assert streamed.credentials().count() == whole.credentials().count() + 1
