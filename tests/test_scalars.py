import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S


def values(spark, f, inputs):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string").select("i", f(F.col("v")).alias("x")).collect()
    return [r.x for r in sorted(rows)]


def test_canonical_path(spark):
    cases = {
        "/a/b": "/a/b", "/a/./b": "/a/b", "/a/b/../c": "/a/c", "//admin": "/admin", "/admin/.": "/admin/", "/admin/x/..": "/admin/", "/admin/..": "/", "/../../x": "/x",
        "/admin%2Fx": "/admin/x", "/%2561dmin": "/admin", "/a%zz": "/a%zz", "/%2e%2e/x": "/x", "/a+b%2Fc": "/a+b/c", "/%ff": "/%ff", "/.well-known": "/.well-known", "/a//": "/a/", "/%25252e": "/%2e", None: None,
    }
    assert values(spark, S.canonical_path, list(cases)) == list(cases.values())


def test_addresses(spark):
    v4 = {"1.2.3.4": 16909060, "01.2.3.4": None, "1.2.3": None, "256.1.1.1": None, "0.0.0.0": 0, "255.255.255.255": 2**32 - 1, "x": None, None: None}
    assert values(spark, S.ipv4_number, list(v4)) == list(v4.values())
    v6 = {"::1": "0" * 31 + "1", "2001:db8::ff00:42:8329": "20010db8000000000000ff0000428329", "fe80::1%eth0": "fe80" + "0" * 27 + "1", "::ffff:1.2.3.4": "0" * 20 + "ffff01020304", "1:2:3:4:5:6:7:8": "00010002000300040005000600070008", "1:2:3": None, "1::2::3": None, "12345::": None, "::": "0" * 32, "1:2:3:4:5:6:7::8": None, "1.2.3.4": None, None: None}
    assert values(spark, S.ipv6_hex, list(v6)) == list(v6.values())
    ranges = {"10.0.0.9/24": (167772160, 167772415), "10.0.0.1": (167772161, 167772161), "0.0.0.0/0": (0, 2**32 - 1), "10.0.0.0/33": None, "10.0.0.0/x": None, "10.0.0.0/": None}
    assert [tuple(x) if x else None for x in values(spark, S.cidr_range, list(ranges))] == list(ranges.values())


def test_query_strings(spark):
    cases = {"a=1&b=2&a=3": [("a", "1"), ("b", "2"), ("a", "3")], "x": [("x", "")], "a=b=c": [("a", "b=c")], "a+b=c%20d": [("a b", "c d")], "%zz=%41": [("%zz", "A")], "": [], "&&": [], None: []}
    assert [[tuple(p) for p in x] for x in values(spark, S.parse_query, list(cases))] == list(cases.values())


@pytest.mark.parametrize("pattern,topic,hit", [("a/#", "a/b/c", True), ("a/#", "a", True), ("+/b", "a/b", True), ("+/b", "a/c/b", False), ("a/+", "a", False), ("#", "x/y", True), ("a.b", "axb", False)])
def test_topics(spark, pattern, topic, hit):
    assert values(spark, lambda c: S.topic_matches(c, pattern), [topic]) == [hit]


def test_regex_safety():
    assert S.unsafe_regex(r"(a)\1") and S.unsafe_regex("a(?=b)") and S.unsafe_regex("(") and not S.unsafe_regex("^/a[0-9]+(?:b|c)$")


def test_times_and_buckets(spark):
    assert values(spark, S.epoch_ms, ["2024-01-01T00:00:00Z", "12.5", "2024-01-01", "x", None]) == [1704067200000.0, 12.5, None, None, None]
    want = []
    for t in ("", "abc", "a longer text that wraps around"):
        h = 0
        for c in t:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        want.append(abs(h - (1 << 32) if h >> 31 else h) % 97)
    assert values(spark, lambda c: S.size_bucket(c, 97), ["", "abc", "a longer text that wraps around"]) == want
