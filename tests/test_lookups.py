"""The questions an operator asks, on a small seed of invented rows."""

import pytest
from pyspark.sql import functions as F

from breachlens.operators import lookups, stats
from breachlens.schemas import LEAK, LEAK_DATA
from breachlens.sources.files import scan_directory

from .conftest import rows

LEAKS = [
    (1, "2020-10-01", "first dump", "T-1", "ann", "DarkFeed"),
    (2, "2020-10-02", "second dump", "T-1", "ben", "darkfeed"),
    (3, "2020-10-03", "third dump", "T-3", None, "Pastes"),
]
CREDENTIALS = [
    # id, leak, email, password, plain, hashed, ticket, domain, malware, dg, seen
    (1, 1, "amy@example.com", "12345", "12345", None, "C-1", "example.com", None, "D1", 2),
    (2, 1, "bob@example.com", "123456", "123456", None, "C-1", "example.com", "m1", "D1", 3),
    (3, 2, "Amy@Example.com", "00123", None, "12345", "C-2", "Example.com", "m1", "D2", 25),
    (4, 2, "cid@other.org", "12345", None, None, "C-3", "other.org", None, "D2", 1),
    (5, 2, "dan@other.org", "x", "12345", "12345", None, None, "m2", "D1", 1),
    (6, 1, "eve@example.com", "12345", None, None, None, "example.com", None, "D1", None),
]


@pytest.fixture(scope="module")
def leak(spark):
    names = "id long, breach_ts string, summary string, ticket_id string, reporter_name string, source_name string"
    df = spark.createDataFrame(LEAKS, names).withColumns(
        {"source_publish_ts": F.lit(None), "ingestion_ts": F.lit("2021-01-01")}
    )
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LEAK])


@pytest.fixture(scope="module")
def cred(spark):
    names = ("id long, leak_id long, email string, password string, password_plain string, password_hashed string, "
             "ticket_id string, domain string, malware_name string, dg string, count_seen long")
    df = spark.createDataFrame(CREDENTIALS, names)
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in LEAK_DATA])


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_credentials(cred):
    assert ids(lookups.by_email(cred, "AMY@example.COM")) == [1, 3]
    assert ids(lookups.by_email(cred, "nobody@example.com")) == []
    assert ids(lookups.by_email_and_password(cred, "amy@example.com", "00123")) == [3]
    assert ids(lookups.by_email_and_password(cred, "amy@example.com", "123")) == []
    assert ids(lookups.by_value(cred, "id", 4)) == [4]
    assert ids(lookups.by_value(cred, "ticket_id", "C-1")) == [1, 2]
    assert ids(lookups.by_value(cred, "ticket_id", "c-1")) == []


def test_counts(cred):
    def one(df):
        found = df.collect()
        assert len(found) == 1
        return found[0]["count"]

    assert one(lookups.count_by_email(cred, "amy@EXAMPLE.com")) == 2
    assert one(lookups.count_by_email(cred, "nobody")) == 0
    # A row counts once, in whichever of the three columns the text stands.
    assert one(lookups.count_by_password(cred, "12345")) == 5
    assert one(lookups.count_by_password(cred, "1234")) == 0
    assert one(lookups.count_by_domain(cred, "EXAMPLE.com")) == 4
    assert one(lookups.count_by_domain(cred, "example")) == 0


def test_leaks(leak):
    assert ids(leak) == [1, 2, 3]
    assert ids(lookups.by_value(leak, "ticket_id", "T-1")) == [1, 2]
    assert ids(lookups.by_value(leak, "summary", "first dump")) == [1]
    assert ids(lookups.by_value(leak, "summary", "First dump")) == []
    assert ids(lookups.by_value(leak, "reporter_name", "ben")) == [2]
    assert ids(lookups.by_value_any_case(leak, "source_name", "DARKFEED")) == [1, 2]
    assert ids(lookups.by_value(leak, "id", 99)) == []


def test_sorted_values_put_null_last(leak):
    assert [r[0] for r in lookups.distinct_sorted(leak, "reporter_name").collect()] == ["ann", "ben", None]
    assert [r[0] for r in lookups.distinct_sorted(leak, "source_name").collect()] == ["DarkFeed", "Pastes", "darkfeed"]


def test_tables_of_questions(spark, cred, leak):
    asked = spark.createDataFrame([("AMY@example.com", "00123", "Other.ORG", 3), ("zed@x.co", "12345", "none", 9)],
                                  "email string, password string, domain string, id long")
    assert ids(lookups.rows_for_emails(cred, asked)) == [1, 3]
    assert ids(lookups.rows_for_credentials(cred, asked)) == [3]
    assert ids(lookups.by_ids(cred, asked)) == [3]
    assert dict(rows(lookups.counts_by_email(cred, asked))) == {"AMY@EXAMPLE.COM": 2, "ZED@X.CO": 0}
    assert dict(rows(lookups.counts_by_password(cred, asked))) == {"00123": 1, "12345": 5}
    assert dict(rows(lookups.counts_by_domain(cred, asked))) == {"OTHER.ORG": 1, "NONE": 0}
    sources = spark.createDataFrame([("DARKfeed",), ("DARKfeed",)], "source_name string")
    assert ids(lookups.rows_for_values(leak, sources, "source_name", any_case=True)) == [1, 2]


def test_statistics(cred):
    assert rows(stats.by_department(cred)) == [("D1", 4, 6), ("D2", 2, 26)]
    assert rows(stats.by_malware(cred)) == [("m1", 2, 28), ("m2", 1, 1)]
    assert ("D1", None, 1, 4, 6) in rows(stats.department_by_malware(cred))
    assert [r.domain for r in stats.top_domains(cred, 2).collect()] == ["example.com", "Example.com"]
    reuse = stats.password_reuse(cred).collect()
    assert [(r.addresses, r.credentials) for r in reuse] == [(3, 3)]
    assert rows(stats.leak_overlap(cred)) == [(1, 3, 1), (2, 3, 1)]


def test_directory_snapshot(spark, folder):
    path = folder + "/entries.json"
    with open(path, "w", encoding="utf-8") as handle:
        handle.write('{"mail": "a@x.co", "dg": ["D1", "D2"], "recordStatus": ["A"], "other": 1}\n')
    found = scan_directory(spark, path).select("mail", "dg", "ecMoniker").first()
    assert (found.mail, found.dg, found.ecMoniker) == ("a@x.co", ["D1", "D2"], None)
