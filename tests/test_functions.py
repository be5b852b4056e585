from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidestore.functions import numbers, paths
from tidestore.model import Match, StoreConfig, TagMatcher, check_codec, duration_us
from tidestore.operators.matchers import anchored, find_metrics


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column).first()[0]


SHARDS = {
    "snmp/fs/Servers/node1/eth0/mib2-X-interfaces": "snmp/fs/Servers/node1/eth0/mib2-X-interfaces",
    "snmp:0:jvm:name=unknown": "snmp%3A0%3Ajvm%3Aname%3Dunknown",
    ".": "%2E",
    "a/../b": "a/%2E%2E/b",
    "/snmp//1/": "snmp/1",
    "///": "",
    "é 😀": "%C3%A9%20%F0%9F%98%80",
}


def test_shard_paths(spark):
    rows = spark.createDataFrame([(k,) for k in SHARDS], "r string").select("r", paths.shard_path("r")).collect()
    assert dict(map(tuple, rows)) == SHARDS
    with pytest.raises(Exception, match="empty"):
        one(spark, paths.shard_path("r"), r="")


@pytest.mark.parametrize(("duration", "label"), [("P1D", "p=2026-07-06"), ("PT1H", "p=2026-07-06-14"), ("PT15M", "p=2026-07-06-14-15")])
def test_labels_and_back(spark, duration, label):
    us = duration_us(duration)
    time = datetime(2026, 7, 6, 14, 23, 45)
    df = spark.createDataFrame([(time,)], "t timestamp_ntz")
    assert df.select(paths.partition_name("t", us)).first()[0] == label
    assert "p=" + paths.python_label(time, us) == label
    start = df.select(paths.partition_start(F.lit(label))).first()[0]
    assert start <= time and (time - start).total_seconds() * 1e6 < us


def test_names_that_are_no_partition(spark):
    names = [None, "data", "p=not-a-date", "p=2026-13-40", "p=2026-07", "p=2026-07-06-14-15-16", "p=2026-7-6--", "p="]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(paths.partition_start("n")).collect()
    assert [r[0] for r in rows] == [None] * 6 + [datetime(2026, 7, 6), None]


@settings(max_examples=30, deadline=None)
@given(st.datetimes(datetime(1900, 1, 1), datetime(2100, 1, 1)), st.integers(1, 3000))
def test_labels_hold_their_instant(time, minutes):
    us = minutes * 60_000_000
    label = paths.python_label(time, us)
    parts = [int(x) for x in label.split("-")]
    start = datetime(*parts[:3], *(parts[3:] or []))
    assert (time - start).total_seconds() * 1e6 < us and start <= time


def test_numbers(spark):
    texts = [" U ", "nan", "UNKN", "inf", "-Inf", "1.5", "x", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(numbers.parse_double("t"), numbers.parse_long("t"), numbers.format_double(numbers.parse_double("t"))).collect()
    assert [str(r[0]) for r in rows] == ["None", "nan", "nan", "inf", "-inf", "1.5", "None", "None"]
    assert [r[1] for r in rows] == [None, None, None, 2**63 - 1, -(2**63), None, None, None]
    assert [r[2] for r in rows] == [None, "NaN", "NaN", "inf", "-inf", "1.5", None, None]
    with pytest.raises(Exception, match="unknown name"):
        one(spark, numbers.parse_enum("e", numbers.CF_V1), e="HWPREDICT")
    assert one(spark, numbers.parse_enum("e", numbers.CF_V3), e=" HWPREDICT ") == "HWPREDICT"


def test_resource_paths(spark):
    df = spark.createDataFrame([("a/b/c//",), ("",), ("x",)], "t string").withColumn("e", paths.path_elements("t"))
    rows = df.select("e", paths.path_name("e"), paths.has_parent("e"), paths.relative_depth(F.array(F.lit("a")), F.col("e"))).collect()
    assert [tuple(r) for r in rows] == [(["a", "b", "c"], "c", True, 2), ([], None, False, -1), (["x"], "x", False, -1)]
    with pytest.raises(Exception, match="no parent"):
        one(spark, paths.path_text(paths.path_parent(F.array(F.lit("x")))))


@pytest.mark.parametrize(
    ("path", "mode", "want"),
    [
        ("snmp/5/eth0-04/mib2", False, "snmp/5/eth0-04/mib2"),
        ("snmp/5/eth0-04/mib2", True, "snmp/fs/MyReq/node5/eth0-04/mib2"),
        ("snmp/fs/MyReq/node5/mib2", True, "snmp/fs/MyReq/node5/mib2"),
        ("snmp/999/mib2", True, None),
        ("response/192.168.1.1/icmp", True, "response/192.168.1.1/icmp"),
    ],
)
def test_import_paths(spark, path, mode, want):
    nodes = spark.createDataFrame([(5, "MyReq", "node5")], "node int, fs string, fid string")
    df = spark.createDataFrame([(path,)], "t string").withColumn("e", paths.path_elements("t"))
    joined = df.join(nodes, paths.node_of("e") == F.col("node"), "left")
    assert joined.select(paths.path_text(paths.import_path("e", mode, F.col("fs"), F.col("fid")))).first()[0] == want


def test_matchers(spark):
    tag = lambda k, v: {"key": k, "value": v}
    kind = "array<struct<key: string, value: string>>"
    rows = [(str(n), [tag("name", "n"), tag("resourceId", f"r:{n}")], [tag("host", f"myHost{n}")] if n else [tag(None, "bare")], [tag("ext", "e")]) for n in range(3)]
    m = spark.createDataFrame(rows, f"metric_key string, intrinsic {kind}, meta {kind}, external {kind}")
    found = lambda *x: sorted(r[0] for r in find_metrics(m, x).select("metric_key").collect())
    assert found(TagMatcher("name", "n")) == ["0", "1", "2"]
    assert found(TagMatcher("host", "myHost1", Match.NOT_EQUALS)) == ["2"]
    assert found(TagMatcher("host", "Host1", Match.EQUALS_REGEX)) == []
    assert found(TagMatcher("host", "x|myHost[12]", Match.EQUALS_REGEX), TagMatcher("resourceId", "r:2")) == ["2"]
    assert found(TagMatcher("host", ".*2", Match.NOT_EQUALS_REGEX)) == ["1"]
    assert found(TagMatcher(None, "bare")) == ["0"]
    assert found(TagMatcher("ext", "e")) == []
    with pytest.raises(ValueError):
        find_metrics(m, [])
    with pytest.raises(TypeError):
        find_metrics(m, None)


@pytest.mark.parametrize("pattern", [r"(a)\1", "(?=a)", "(?<!a)b", "a++", "(", "[a"])
def test_patterns_that_are_refused(pattern):
    with pytest.raises(ValueError):
        anchored(pattern)


@pytest.mark.parametrize("pattern", [r"a\.b", "[+*]+", "(?i)x", "a|b"])
def test_patterns_that_pass(pattern):
    assert pattern in anchored(pattern)


def test_settings():
    assert duration_us("P1DT2H3M4.5S") == ((26 * 60 + 3) * 60 + 4) * 1_000_000 + 500_000
    for bad in ("1 day", "P", "PT", "P1Y", ""):
        with pytest.raises(ValueError):
            duration_us(bad)
    c = StoreConfig().with_text(base_dir=" /x ", partition="", flush_rows="10", compression="lz4_raw", compact_on="false", compaction="PT2H")
    assert (c.base_dir, c.partition_us, c.flush_rows, c.compression, c.compact_on, c.compaction_us) == ("/x", 86_400_000_000, 10, "lz4_raw", False, 7_200_000_000)
    for bad in ({"flush_rows": "0"}, {"partition": "PT30S"}, {"compression": "GZIP"}, {"nothing": "1"}):
        with pytest.raises(ValueError):
            StoreConfig().with_text(**bad)
    assert check_codec("uncompressed") == "uncompressed"
