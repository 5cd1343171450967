"""The stored tables: one winner per number of the log, buckets, and what is kept with a batch."""

import os
import re

import pytest
from pyspark.sql import functions as F

from breachlens.catalog.derived import Tables
from breachlens.operators import dedupe, lookups
from breachlens.operators.buckets import bucket_of, buckets_of
from breachlens.plans import imports
from breachlens.plans.store import ConflictingWrite, Store
from breachlens.schemas import LEAK_DATA
from breachlens.session import collected_scratch, remove_scratch, staged
from breachlens.streaming.folder import stream_import

from .conftest import rows
from .test_imports import HEADER, LINES, leak_line, line, load, reference, run_ts, write  # noqa: F401


def credentials(spark, first, n, browser=None):
    """``n`` credentials with ids from ``first`` on, one address each."""
    values = {"id": F.col("id"), "leak_id": F.lit(1), "email": F.concat(F.lit("u"), F.col("id"), F.lit("@x.co")), "password": F.lit("pw"), "domain": F.lit("x.co")}
    values |= {"dg": F.lit("D"), "count_seen": F.lit(1), "browser": F.lit(browser)}
    return spark.range(first, first + n).select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in LEAK_DATA])


def ids(store):
    return sorted(r.id for r in store.credentials().select("id").collect())


class Interrupted(Store):
    """Somebody else commits when this one has written its tables and not yet its entry."""

    def _write_all(self, log, label, tables):
        written = super()._write_all(log, label, tables)
        Store(self.spark, self.root).commit("late", inserts=credentials(self.spark, 101, 10))
        return written


@pytest.mark.parametrize("change", ["compact", "update", "leaks", "commit"])
def test_what_is_committed_meanwhile_is_never_lost(spark, folder, change):
    store = Store(spark, folder)
    store.commit("one", inserts=credentials(spark, 1, 10))
    edits = credentials(spark, 3, 2, "Edge")
    run = {
        "compact": lambda s: s.compact(),
        "update": lambda s: s.update_credentials(edits),
        "leaks": lambda s: s.update_leaks(s.leaks().limit(0)),
        "commit": lambda s: s.commit("two", inserts=credentials(spark, 11, 10)),
    }[change]
    with pytest.raises(ConflictingWrite):
        run(Interrupted(spark, folder))
    assert ids(store) == [*range(1, 11), *range(101, 111)] and store.has("late") and not store.has("two")
    assert len(os.listdir(f"{folder}/credentials")) == 2  # nothing is left of the attempt
    run(store)
    assert set(ids(store)) >= {*range(1, 11), *range(101, 111)} and store.has("late")


def test_two_writers_with_one_mark_give_no_id_twice(spark, folder):
    first, second = Store(spark, folder), Store(spark, folder)
    seen, start = second.mark(), second.next_id()
    assert first.mark() == seen and first.next_id() == start
    first.commit("one", inserts=credentials(spark, start, 5), since=seen)
    with pytest.raises(ConflictingWrite):
        second.commit("two", inserts=credentials(spark, start, 5), since=seen)

    class Later(Store):
        def _log(self):  # has looked before the other one committed
            return self.seen

    third = Later(spark, folder)
    third.seen = Store(spark, folder)._log()
    Store(spark, folder).commit("three", inserts=credentials(spark, 6, 5))
    with pytest.raises(ConflictingWrite):
        third.commit("four", inserts=credentials(spark, 6, 5), since=third.seen.mark)
    assert ids(first) == list(range(1, 11))


def test_the_log_stays_short_and_forgets_no_batch(spark, folder):
    store = Store(spark, folder)
    for round_ in range(3):
        for n in range(4):
            store.commit(f"{round_}-{n}", inserts=credentials(spark, 1 + 40 * round_ + 10 * n, 10), outcome=credentials(spark, n, 1))
        store.compact()
        assert len(store.log()) == 1
    assert ids(store) == list(range(1, 121)) and store.next_id() == 121
    assert all(store.has(f"{r}-{n}") for r in range(3) for n in range(4)) and not store.has("3-0")
    assert store.outcome("0-1").count() == 1
    fresh = Store(spark, folder)
    fresh.journal.read()
    assert len(fresh.journal._known) == 1  # entries before the last compaction are not even read
    assert len(os.listdir(f"{folder}/log")) >= 4
    os.remove(f"{folder}/log/current")
    assert ids(Store(spark, folder)) == list(range(1, 121))


def test_an_update_writes_the_buckets_it_touches(spark, folder):
    store = Store(spark, folder, buckets=8)
    store.commit("one", inserts=credentials(spark, 1, 200))
    store.commit("two", raises=credentials(spark, 1, 200).select("id", F.upper("email").alias("email_key"), F.lit(3).alias("n")))
    edits = credentials(spark, 7, 2, "Edge").withColumn("email", F.when(F.col("id") == 7, F.lit("moved@y.co")).otherwise(F.col("email")))
    store.update_credentials(edits)
    where = lambda emails: {r[0] for r in emails.select(bucket_of(F.col("email"), 8)).collect()}
    touched = where(credentials(spark, 7, 2)) | where(edits)
    entry = store.log()[-1]
    assert set(entry.replaces) == touched and len(touched) < 8
    assert {int(x.split("=")[1]) for x in os.listdir(f"{folder}/credentials/batch={entry.label}") if "=" in x} <= touched
    assert entry.rows["credentials"] < 200
    found = {r.id: (r.email, r.browser, r.count_seen) for r in store.credentials().collect()}
    assert found[7] == ("moved@y.co", "Edge", 4) and found[8] == ("u8@x.co", "Edge", 4) and found[9] == ("u9@x.co", None, 4) and len(found) == 200
    # Later raises count, an update of the same rows again replaces the first, unknown ids change nothing, and a compaction keeps it all.
    store.commit("three", raises=edits.select("id", F.upper("email").alias("email_key"), F.lit(1).alias("n")))
    store.update_credentials(edits.withColumn("browser", F.lit("Opera")))
    store.update_credentials(credentials(spark, 900, 3))
    before = rows(store.credentials())
    assert {(r[0], r[-1]) for r in store.credentials().filter("browser = 'Opera'").select("id", "count_seen").collect()} == {(7, 5), (8, 5)}
    store.compact()
    assert rows(store.credentials()) == before and buckets_of(store.rows()) == 8 and Store(spark, folder, buckets=99).buckets == 8


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_batch_reads_its_own_buckets_in_one_scan(spark, folder):
    store = Store(spark, folder, buckets=32)
    store.commit("one", inserts=credentials(spark, 1, 300))
    asked = credentials(spark, 5, 1).select("email", "password")
    found = dedupe.known_rows(store.rows(), staged(asked, "asked"), ["id", "email", "password"])
    text = plan(found)
    assert text.count("credentials/batch=") == 1 and "dynamicpruning" in text and "BroadcastHashJoin" in text
    assert rows(found.select("id")) == [(5,)]
    bulk = lookups.rows_for_emails(store.rows(), staged(asked, "asked"))
    assert "dynamicpruning" in plan(bulk) and rows(bulk.select("id")) == [(5,)]
    one = plan(lookups.by_email(store.rows(), "U5@x.co"))
    assert re.search(r"PartitionFilters: \[[^\]]*key_bucket", one)
    whole = dedupe.known_rows(store.rows(), asked, ["id", "email", "password"], max_broadcast_rows=0)
    assert rows(whole.select("id")) == [(5,)]


def test_an_import_scans_the_store_once(spark, folder, reference, monkeypatch):  # noqa: F811
    store, scans = Store(spark, folder + "/store"), []
    load(spark, store, write(folder, "a.csv", LINES), reference)
    original = Store._read
    monkeypatch.setattr(Store, "_read", lambda self, log, kind: scans.append(kind) or original(self, log, kind))
    calls = []
    known = dedupe.known_rows
    monkeypatch.setattr(dedupe, "known_rows", lambda *a, **k: calls.append(1) or known(*a, **k))
    result = load(spark, store, write(folder, "b.csv", [line("vip@x.co"), line("new@x.co")]), reference, batch="b2")
    assert scans.count("credentials") == 1 and scans.count("raises") == 0 and calls == [1]
    assert (result.report.first().inserted, result.report.first().duplicates) == (1, 1)


def test_first_rows_are_not_packed_into_an_aggregate(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    keys = {"order": ["id"], "unique": F.col("id")}
    for bound in (0, 1000):
        text = plan(dedupe.drop_known(t.batch, t.store, max_broadcast_rows=bound, **keys))
        assert "SortAggregate" not in text and text.count("WindowGroupLimit") == 2
    assert "SortAggregate" not in plan(dedupe.keep_first(t.batch, **keys))


def test_rows_set_aside_stay_with_the_batch(spark, folder, reference):  # noqa: F811
    store, path = Store(spark, folder + "/store"), write(folder, "a.csv", [*LINES, line("bad address", "a long secret"), line("over@x.co", "another secret") + ",x"])
    with load(spark, store, path, reference) as result:
        wanted = rows(result.rejected.select("error_msg"))
        books = tuple(result.report.drop("duration").first())
    store.compact()
    again = load(spark, store, path, reference)
    assert again.already_applied and rows(again.rejected.select("error_msg")) == wanted
    assert tuple(again.report.drop("duration").first()) == books and again.outcome.count() == 5
    lines = [r.original_line for r in again.rejected.collect()]
    assert not any("secret" in x for x in lines) and any('"password":"a**********et"' in x and '"email":"bad address"' in x for x in lines)
    # What was staged is gone, and the answer with it.
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        result.outcome.collect()


def test_a_batch_without_an_outcome_has_none(spark, folder, reference):  # noqa: F811
    store, seen = Store(spark, folder + "/store"), []
    store.commit("b1", inserts=credentials(spark, 1, 2))
    again = load(spark, store, "nowhere", reference, collector=lambda *_: None, outputs=[seen.append])
    assert again.already_applied and again.outcome is None and again.rejected is None and again.report is None and seen == []
    assert imports.answered(spark, lambda: again)[0].first().success


def test_each_output_gets_each_batch_once(spark, folder, reference):  # noqa: F811
    store, path, got = Store(spark, folder + "/store"), write(folder, "a.csv", LINES), []
    first, second = (lambda df: got.append(("first", df.count()))), (lambda df: got.append(("second", df.count())))

    def dies(df):
        raise InterruptedError

    with pytest.raises(InterruptedError):
        load(spark, store, path, reference, outputs={"first": first, "second": dies})
    load(spark, store, path, reference, outputs={"first": first, "second": second})
    load(spark, store, path, reference, outputs={"first": first, "second": second, "third": second})
    assert got == [("first", 5), ("second", 5), ("second", 5)]
    leaks = write(folder, "b.csv", [leak_line("amy@x.co")], "email,password,password_plain,password_hashed,hash_algo,ticket_id,email_verified,"
                  "password_verified_ok,ip,domain,browser,malware_name,infected_machine,dg")  # fmt: skip
    imports.import_leak_files(spark, store, leaks, leak_id=1, batch="b2", outputs={"first": first})
    assert got[-1] == ("first", 1) and store.report("b2").first().inserted == 1


def test_a_failed_import_gives_an_answer(spark, folder, reference):  # noqa: F811
    store, path = Store(spark, folder + "/store"), write(folder, "a.csv", LINES)
    envelope, result = imports.answered(spark, lambda: load(spark, store, path, reference, strict=True))
    row = envelope.first()
    assert result is None and (row.success, row.errormsg, row["count"]) == (False, "the feed has rows that fail a check", None)
    envelope, _ = imports.answered(spark, lambda: load(spark, store, folder + "/absent.csv", reference))
    assert (envelope.first().success, envelope.first().errormsg) == (False, "PATH_NOT_FOUND")
    envelope, result = imports.answered(spark, lambda: load(spark, store, path, reference))
    assert envelope.first().success and envelope.first()["count"] == 5 and not result.already_applied


def test_scratch_is_collected_and_removed(spark):
    paths = []
    with collected_scratch(paths):
        kept = staged(spark.range(3), "one")
    other = staged(spark.range(3), "two")
    assert len(paths) == 1 and kept.count() == 3
    remove_scratch(spark, paths)
    assert paths == [] and other.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        kept.collect()


def test_a_stream_takes_files_of_any_known_header(spark, folder, reference):  # noqa: F811
    names = HEADER.split(",")
    cells = line("back@x.co").split(",")
    write(folder + "/landing", "a.csv", [line("amy@x.co")])
    write(folder + "/landing", "b.csv", [",".join(cells[::-1])], ",".join(names[::-1]))
    write(folder + "/landing", "c.csv", ["1,2"], "some,thing")
    store = Store(spark, folder + "/store")

    def run(**options):
        stream_import(
            spark, store, folder + "/landing", name="s", checkpoint=folder + "/checkpoint", ticket_id="T-1", summary="feed",
            reference=reference, run_ts=run_ts(), **options,
        ).awaitTermination()

    run()
    assert rows(store.credentials().select("email")) == [("amy@x.co",), ("back@x.co",)]
    aside = store.rejected("s-0", "stream").select("original_line", "error_msg").collect()
    assert [tuple(r) for r in aside] == [("s*******ng", "unknown header")]
    # Many small batches do not pile up in the log.
    for n in range(3):
        write(folder + "/landing", f"d{n}.csv", [line(f"user{n}@x.co")])
    run(files_per_batch=1, compact_after=2)
    assert len(store.log()) <= 2 and store.credentials().count() == 5 and store.has("s-0", "stream")




def rows_read(spark, df):
    """Rows that the scans of a frame give: whole row groups."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("*")
        df.collect()
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_files_without_the_value_are_passed_over(spark, folder):
    """Five batches whose values lie between each other's, so minima and maxima tell nothing: a question for one password or address reads one of them."""
    store = Store(spark, folder, buckets=1)
    for n in range(5):
        rows_of = credentials(spark, 1 + 200 * n, 200)
        mixed = F.concat(F.col("id") % 200, F.lit(f"-{n}"))
        named = rows_of.withColumns({"email": F.concat(F.lit("a"), mixed, F.lit("@x.co")), "password": F.concat(F.lit("p"), mixed)})
        store.commit(str(n), inserts=named.withColumn("password_hashed", F.sha2("password", 256)))
    asked = lookups.count_by_password(store.rows(), "p17-3")
    assert "Or(Or(EqualTo(password,p17-3)" in plan(asked)
    assert asked.first()["count"] == 1 and rows_read(spark, lookups.count_by_password(store.rows(), "p17-3")) == 200
    assert rows_read(spark, lookups.count_by_password(store.rows(), "absent")) == 0
    assert rows_read(spark, lookups.by_email(store.rows(), "A17-3@X.co")) == 200
    assert sum(os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(folder) for f in names) < 4 << 20
