import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from breachlens.functions import text
from breachlens.functions.rules import EXAMPLE_RULES, ContactRule, report_to


def apply(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_mask(spark):
    given_, wanted = ["12345678", "123", "12", "", None, "1234"], ["1*****78", "123", "12", "", None, "1*34"]
    assert apply(spark, given_, text.mask) == wanted


@pytest.mark.parametrize(
    "address, internal",
    [
        ("foobar.example@ext.ec.europa.eu", True), ("ec.europa.eu", True), ("A@JRC.IT", True),
        ("a@xeuropa.eu", True), ("mira@example.com", False), ("a@europa.eu.com", False),
    ],
)
def test_internal(spark, address, internal):
    assert apply(spark, [address], text.is_internal) == [internal]
    assert apply(spark, [address], text.is_external) == [not internal]


def test_contacts(spark):
    asked = ["a@example.com", "a@example.ec.europa.eu", "a@x.ec.europa.eu", "a@example.ec.europa.eu.evil", "nobody"]
    desk = EXAMPLE_RULES[0].contacts
    found = apply(spark, asked, report_to)
    assert found == [[asked[0]], desk, [asked[2]], desk, ["nobody"]]
    strict = apply(spark, asked, lambda e: report_to(e, full_match=True))
    assert strict[3] == [asked[3]] and strict[1] == desk


def test_contacts_first_rule_wins_and_none_matches(spark):
    rules = [ContactRule("a", ["first"]), ContactRule("ab", ["second"])]
    assert apply(spark, ["u@abc", "u@b", "x@y@abc"], lambda e: report_to(e, rules)) == [["first"], [""], ["first"]]


def test_email_syntax(spark):
    good = ["a@b.co", "a.b+c@x-y.example.com", "o'neil@example.org", "ü@example.com"]
    bad = ["a", "a@b", "a@@b.co", "a b@c.de", ".a@b.co", "a.@b.co", "a@-b.co", "a@b.c1", "@b.co", None, "a@b..co", "a" * 65 + "@b.co"]
    assert apply(spark, good + bad, text.email_is_valid) == [True] * len(good) + [False] * len(bad)


def test_email_normal_form(spark):
    asked = [" A.B@EXAMPLE.Com\t", "Jane Doe <J@X.ORG>", "nohost", None]
    assert apply(spark, asked, text.normalize_email) == ["A.B@example.com", "J@x.org", "nohost", None]


def test_ip_known_cases(spark):
    good = ["1.2.3.4", "255.255.255.255", "::", "::1", "1::", "2001:db8::8a2e:370:7334", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "1:2:3:4:5:6:7::"]
    bad = ["256.1.1.1", "1.2.3", "1.2.3.4.5", "01.2.3.4", ":::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", "g::", "x", ""]
    assert apply(spark, good + bad, text.ip_is_valid) == [True] * len(good) + [False] * len(bad)


@settings(max_examples=300, deadline=None)
@given(st.ip_addresses(v=6), st.booleans())
def test_ip_pattern_takes_every_address(address, exploded):
    assert re.fullmatch(text.IP_PATTERN, address.exploded if exploded else str(address))


@settings(max_examples=2000, deadline=None)
@given(st.text(alphabet="01f:.", max_size=20))
def test_ip_pattern_agrees_with_the_standard_library(candidate):
    import ipaddress

    try:
        ipaddress.ip_address(candidate)
        valid = True
    except ValueError:
        valid = False
    assert bool(re.fullmatch(text.IP_PATTERN, candidate)) == valid


def test_blank_tokens_only_match_whole_cells(spark):
    assert apply(spark, ["-", "a-b", "", None, "nan", "NaN "], lambda c: text.blank_to_null(c, ["-", "", "nan"])) == [
        None, "a-b", None, None, None, "NaN "
    ]


def test_flags(spark):
    assert apply(spark, ["t", "f", "true", "0", "maybe", None], text.flag) == [True, False, True, False, None, None]
