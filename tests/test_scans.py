import os

import pytest

from breachlens.operators import normalize
from breachlens.sources import files

from .conftest import rows


def write(folder, name, content):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as handle:
        handle.write(content)
    return path


def test_columns_are_bound_by_name(spark, folder):
    path = write(folder, "a.csv", "password,unknown,email\n000123,x,a@b.co\n")
    scan = files.scan_csv(spark, path, ["email", "password", "ip"])
    assert rows(scan.select("email", "password", "ip", "bad_line")) == [("a@b.co", "000123", None, None)]


def test_tokens_and_quotes(spark, folder):
    path = write(folder, "a.csv", 'email,password\n"a@b.co","say ""hi"", you"\n-,n/a\n#N/A,nan\n')
    scan = files.scan_spycloud(spark, path).select("email", "password")
    assert rows(scan) == sorted([("a@b.co", 'say "hi", you'), (None, None), (None, "nan")], key=repr)
    generic = files.scan_csv(spark, path, ["email", "password"]).select("email", "password")
    assert rows(generic) == sorted([("a@b.co", 'say "hi", you'), ("-", None), (None, None)], key=repr)


def test_long_lines_are_set_aside_and_short_ones_padded(spark, folder):
    path = write(folder, "a.csv", 'a,b,c\n1,2,3\n4,5\n6,7,8,9\n"x,y",2,3\n"x,y",2,"3,4",5\n')
    good, bad = files.split_bad_lines(files.scan_csv(spark, path, ["a", "b", "c"]))
    assert rows(good.select("a", "b", "c")) == [("1", "2", "3"), ("4", "5", None), ("x,y", "2", "3")]
    assert rows(good.select("a")) == [("1",), ("4",), ("x,y",)]
    assert rows(bad.select("original_line", "error_msg")) == [
        ('"x,y",2,"3,4",5', "too many fields"), ("6,7,8,9", "too many fields")
    ]


def test_line_breaks_in_quotes(spark, folder):
    path = write(folder, "a.csv", 'a,b\n"one\ntwo",2\n')
    assert rows(files.scan_csv(spark, path, ["a", "b"], multi_line=True).select("a", "b")) == [("one\ntwo", "2")]


def test_other_separator(spark, folder):
    path = write(folder, "a.csv", "a;b\n1;2\n3;4;5\n")
    good, bad = files.split_bad_lines(files.scan_csv(spark, path, ["a", "b"], sep=";"))
    assert rows(good.select("a", "b")) == [("1", "2")] and bad.count() == 1


def test_a_file_with_another_header_than_the_given_one_is_refused(spark, folder):
    write(folder, "a.csv", "email,password\na@b.co,1\n")
    write(folder, "b.csv", "password,email\n2,c@d.co\n")
    with pytest.raises(Exception, match="header"):
        files.scan_csv(spark, folder, ["email", "password"], header=["email", "password"]).collect()


def test_files_are_bound_by_their_own_headers(spark, folder):
    """Other orders, parts of the columns, unknown ones, a blank name, compressed and empty files."""
    import gzip

    write(folder, "a.csv", "email,password\na@b.co,1\n")
    write(folder, "b.csv", "\npassword,email\n2,c@d.co\n3,e@f.co,extra\n")
    write(folder, "c c.csv", "email\ng@h.co\n")
    write(folder, "d.csv", "x,email,password\n,i@j.co,4\n")
    write(folder, "empty.csv", "")
    with gzip.open(os.path.join(folder, "e.csv.gz"), "wt") as handle:
        handle.write("password,email\n5,k@l.co\n")
    scan = files.scan_csv(spark, folder, ["email", "password"])
    good, bad = files.split_bad_lines(scan)
    assert rows(good.select("email", "password")) == [
        ("a@b.co", "1"), ("c@d.co", "2"), ("g@h.co", None), ("i@j.co", "4"), ("k@l.co", "5")
    ]
    assert rows(bad.select("original_line")) == [("3,e@f.co,extra",)]
    assert scan.select(*files.LINEAGE).distinct().count() == 6
    assert sorted(len(some) for _, some in files.by_header(spark, folder)) == [1, 1, 1, 2]


def test_lineage_follows_the_lines(spark, folder):
    lines = "".join(f"u{i}@b.co,{i}\n" for i in range(3000))
    path = write(folder, "a.csv", "email,password\n" + lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        scan = files.scan_csv(spark, path, ["email", "password"])
        assert scan.rdd.getNumPartitions() > 3
        found = [int(r.password) for r in scan.orderBy(*files.LINEAGE).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == list(range(3000))


def test_collect_reports_what_went_wrong(spark, folder):
    path = write(folder, "a.csv", "email,password\na@b.co,1\n")
    status, found = files.collect_csv(spark, path, ["email", "password"])
    assert status == "OK" and found.count() == 1
    status, nothing = files.collect_csv(spark, folder + "/absent.csv", ["email", "password"])
    assert "absent" in status and nothing.count() == 0 and nothing.columns == found.columns


def test_leak_csv_is_tagged(spark, folder):
    path = write(folder, "a.csv", "email,password\na@b.co,1\nc@d.co,\n")
    scan = files.scan_leak_csv(spark, path, 5, ["email", "password"])
    assert rows(scan.select("leak_id", "email", "password")) == [(5, "a@b.co", "1"), (5, "c@d.co", None)]


def test_vips(spark, folder):
    path = write(folder, "vips.txt", "mira@example.com\n  Eve@Example.com\t\nMIRA@example.com")
    assert rows(files.scan_vips(spark, path)) == [("EVE@EXAMPLE.COM",), ("MIRA@EXAMPLE.COM",)]
    assert files.scan_vips(spark, folder + "/absent.txt").count() == 0


def test_combo_lines(spark, folder):
    write(folder, "one/a.txt", "a@b.co:pw\nsp ace@b.co:http://y:z \n\nü&#39;x@b.co:$(id)\n")
    write(folder, "one/two/b.txt", "nocolon\nc@d.co:\n")
    write(folder, "one/two/c.log", "ignored:1\n")
    found = rows(files.scan_combo(spark, folder, "*.txt").select("email", "password"))
    assert found == sorted(
        [("a@b.co", "pw"), ("sp ace@b.co", "http://y:z "), ("ü&#39;x@b.co", "$(id)"), ("nocolon", None), ("c@d.co", "")],
        key=repr,
    )


def test_checks_and_mappings(spark, folder):
    header = "breach_title,breach_date,email,domain,password,email_domain,email_username,sighting,ip_addresses,password_type"
    path = write(
        folder, "s.csv",
        f"{header}\nB,Unknown,a@mail.b.co,b.co,pw,mail.b.co,a,3,-,sha1\nB,2020-01-01,,b.co,pw,b.co,a,many,1.1.1.1,plain\n",
    )
    checked = normalize.check_input(normalize.clear_sentinels(files.scan_spycloud(spark, path)))
    good, bad = [r.asDict() for r in checked.orderBy("src_ord").collect()]
    assert good["error_msg"] is None and good["notify"] and not good["needs_human_intervention"]
    assert good["breach_date"] is None and good["original_line"] is None
    assert bad["error_msg"] == "email: field required; sighting: not an integer"
    assert not bad["notify"] and bad["needs_human_intervention"] and '"sighting":"many"' in bad["original_line"]
    full = normalize.to_internal(checked).orderBy("src_ord").first()
    assert (full.domain, full.hash_algo, full.ip, full.count_seen) == ("mail.b.co", "sha1", None, 1)
    narrow = normalize.to_internal(checked, normalize.BY_NAME_MAPPING).orderBy("src_ord").first()
    assert (narrow.domain, narrow.hash_algo, narrow.password) == ("mail.b.co", None, "pw")


def test_nan(spark):
    df = spark.createDataFrame([(float("nan"), "nan"), (1.0, "x")], "a double, b string")
    assert rows(normalize.clear_nan(df)) == sorted([(None, "nan"), (1.0, "x")], key=repr)


def test_masked_leaves_other_columns(spark):
    df = spark.createDataFrame([("a@b.co", "secret1")], "email string, password string")
    assert rows(normalize.masked(df)) == [("a@b.co", "s****t1")]
