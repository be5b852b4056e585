"""One query an operator over the driver's tables. Times are epoch microseconds, so that no zone can matter."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidestore.functions import numbers, paths
from tidestore.model import Match, StoreConfig, TagMatcher, duration_us
from tidestore.operators import catalog as cat
from tidestore.operators import matchers as match
from tidestore.operators import rrd
from tidestore.operators import samples as ops
from tidestore.plans import tables
from tidestore.sources.store import SampleStore
from tidestore.streaming.ingest import ingest, read_stream

Query = Callable[[SparkSession, str], DataFrame]
DAY = duration_us("P1D")
START, END = datetime(2024, 1, 5), datetime(2024, 1, 12, 6, 30)
NOW = datetime(2001, 1, 1)
RETENTION = duration_us("P365D")
FLAGSHIP = [TagMatcher("host", "myHost[1-4]", Match.EQUALS_REGEX), TagMatcher("name", "error", Match.NOT_EQUALS), TagMatcher("mtype", "gauge")]

QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _us(c: str = "time") -> Column:
    return paths.epoch_micros(c)


def _points(df: DataFrame) -> DataFrame:
    return df.withColumn("time_us", _us()).drop("time")


# ---- finding metrics


def _find(name: str, matchers: list[TagMatcher]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return match.find_metrics(tables.event_metrics(spark, sf_dir), matchers).select("metric_key")

    run.__name__ = name
    query(run)


FIND = {
    "find_equals": [TagMatcher("name", "error")],
    "find_and": [TagMatcher("name", "click"), TagMatcher("host", "myHost3")],
    "find_meta": [TagMatcher("mtype", "count")],
    "find_not_equals": [TagMatcher("host", "myHost1", Match.NOT_EQUALS)],
    "find_regex": [TagMatcher("resourceId", "events/user/1[0-9]*|events/user/2.", Match.EQUALS_REGEX)],
    "find_not_regex": [TagMatcher("host", "myHost[0-6]", Match.NOT_EQUALS_REGEX)],
    "find_keyless": [TagMatcher(None, "keyless")],
}
for _name, _matchers in FIND.items():
    _find(_name, _matchers)


@query
def find_by_tag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.find_keys(tables.event_tags(spark, sf_dir), FLAGSHIP)


@query
def find_external_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match.find_metrics(tables.event_metrics(spark, sf_dir), [TagMatcher("band", "band-1")])
    return found.agg(F.count("*").alias("n"))


# ---- reading samples


@query
def fetch_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(ops.fetch_many(tables.event_samples(spark, sf_dir), tables.event_metrics(spark, sf_dir), FLAGSHIP, START, END))


@query
def fetch_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(ops.fetch(tables.event_samples(spark, sf_dir), tables.event_metrics(spark, sf_dir), "name=click,resourceId=events/user/3", START, END + timedelta(days=9)))


@query
def range_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(ops.read_series(tables.event_samples(spark, sf_dir), "events/user/8", "error", START, END))


@query
def range_read_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both bounds are sample times, and both are left out."""
    samples = tables.event_samples(spark, sf_dir)
    bounds = samples.groupBy("resource_id", "name").agg(F.min("time").alias("lo"), F.max("time").alias("hi"))
    inside = samples.join(bounds, ["resource_id", "name"]).where((F.col("time") > F.col("lo")) & (F.col("time") < F.col("hi")))
    return _points(inside.select("resource_id", "name", "time", "value"))


@query
def read_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(tables.line_samples(spark, sf_dir).where(ops.in_range(datetime(1996, 1, 1), datetime(1997, 1, 1))))


@query
def read_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deleted metric's samples are hidden at once."""
    metrics = tables.event_metrics(spark, sf_dir)
    left = cat.remove(metrics, match.find_metrics(metrics, [TagMatcher("host", "myHost2")]))
    return _points(ops.fetch_many(tables.event_samples(spark, sf_dir), left, [TagMatcher("name", "view")], START, END).drop("metric_key"))


@query
def samples_with_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = tables.event_metrics(spark, sf_dir).where("metric_key = 'name=click,resourceId=events/user/3'")
    points = ops.fetch(tables.event_samples(spark, sf_dir), metrics, "name=click,resourceId=events/user/3", START, END)
    return _points(ops.with_metric(points, metrics)).select("metric_key", "time_us", "value", F.size("intrinsic").alias("n_intrinsic"), F.size("meta").alias("n_meta"))


# ---- labels and paths


def _partition(name: str, duration: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tables.event_samples(spark, sf_dir).groupBy(paths.partition_name("time", duration_us(duration)).alias("p")).agg(F.count("*").alias("n"))

    run.__name__ = name
    query(run)


PARTITIONS = {"partition_daily": ("P1D", "%Y-%m-%d"), "partition_hourly": ("PT1H", "%Y-%m-%d-%H"), "partition_quarter_hour": ("PT15M", "%Y-%m-%d-%H-%M"), "partition_36h": ("PT36H", "%Y-%m-%d-%H")}
for _name, (_duration, _) in PARTITIONS.items():
    _partition(_name, _duration)


@query
def partition_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, and names that are none, back to instants."""
    e = tables.table(spark, sf_dir, "events")
    day, n = F.date_format("ts", "yyyy-MM-dd"), F.col("event_id") % 6
    name = (
        F.when(n == 0, F.concat(F.lit("p="), day))
        .when(n == 1, F.concat(F.lit("p="), F.date_format("ts", "yyyy-MM-dd-HH")))
        .when(n == 2, F.concat(F.lit("p="), F.date_format("ts", "yyyy-MM-dd-HH-mm")))
        .when(n == 3, day)
        .when(n == 4, F.concat(F.lit("p="), F.date_format("ts", "yyyy"), F.lit("-13-40")))
        .otherwise(F.lit("p=not-a-date"))
    )
    return e.select("event_id", name.alias("name")).select("event_id", "name", _us(paths.partition_start("name")).alias("start_us"))


@query
def shard_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = tables.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("resource_id"))
    texts = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("/"), F.col("source"), F.lit("//../"), F.regexp_replace("text", r"[/\n]", " ")).alias("resource_id"))
    return urls.unionByName(texts).select("id", "resource_id", paths.shard_path("resource_id").alias("shard"))


@query
def partition_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.event_samples(spark, sf_dir).select(paths.partition_path("resource_id", "time", DAY).alias("path")).distinct()


@query
def epoch_micros(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = tables.event_samples(spark, sf_dir).select(_us().alias("time_us"))
    return us.select("time_us", (_us(paths.from_micros("time_us")) - F.col("time_us")).alias("lost"))


@query
def resource_path_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.table(spark, sf_dir, "pages").select("page_id", paths.path_elements("url").alias("e"))
    parent = F.when(paths.has_parent("e"), F.slice("e", F.lit(1), F.size("e") - 1))
    prefix = F.array(F.lit("http:"), F.lit(""))
    return p.select(
        "page_id", F.size("e").cast("long").alias("depth"), paths.path_name("e").alias("last"), paths.path_text(parent).alias("parent"),
        paths.relative_depth(prefix, F.col("e")).cast("long").alias("below"), paths.path_text(paths.child_path("e", F.lit("x"))).alias("child"),
    )


@query
def path_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "pages").select("page_id", paths.sanitize_name("url").alias("name"), paths.remove_extension("url").alias("stem"))


@query
def node_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import paths under foreign sources; unknown nodes have none."""
    nodes = tables.table(spark, sf_dir, "nation").where("n_nationkey % 3 != 0").select(F.col("n_nationkey").alias("node"), F.concat(F.lit("req"), F.col("n_regionkey").cast("string")).alias("fs"), F.col("n_name").alias("fid"))
    s = tables.table(spark, sf_dir, "supplier")
    kind = F.col("s_suppkey") % 3
    text = F.when(kind == 0, F.concat(F.lit("snmp/"), F.col("s_nationkey").cast("string"), F.lit("/eth0"))).when(kind == 1, F.concat(F.lit("snmp/fs/a/"), F.col("s_name"))).otherwise(F.concat(F.lit("response/"), F.col("s_name")))
    p = s.select("s_suppkey", paths.path_elements(text).alias("e")).withColumn("_n", paths.node_of("e"))
    joined = p.join(nodes, F.col("_n") == F.col("node"), "left")
    return joined.select("s_suppkey", paths.path_text(paths.import_path("e", True, F.col("fs"), F.col("fid"))).alias("path"))


# ---- catalog


def _tag_text(tags: str) -> Column:
    return F.array_join(F.array_sort(F.transform(tags, lambda t: F.concat(F.coalesce(t["key"], F.lit("")), F.lit("="), t["value"]))), ";")


@query
def catalog_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.event_metrics(spark, sf_dir).select("metric_key", *(_tag_text(t).alias(t) for t in ("intrinsic", "meta", "external")))


@query
def catalog_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.to_tags(tables.event_metrics(spark, sf_dir)).select("metric_key", "tag_type", F.coalesce("tag_key", F.lit("")).alias("tag_key"), "tag_value")


@query
def catalog_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.event_metrics(spark, sf_dir)
    return m.select("metric_key", cat.metric_key().alias("derived"), cat.resource_of().alias("resource_id"), cat.name_of().alias("name"))


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renamed hosts for a third of the users, twice, and new metrics."""
    m = tables.event_metrics(spark, sf_dir).withColumn("user", F.regexp_extract("metric_key", r"(\d+)$", 1).cast("long"))
    host = lambda v: F.array(F.struct(F.lit("host").alias("key"), F.lit(v).alias("value")))
    some = m.where("user % 3 = 0")
    first = some.withColumn("meta", host("renamed1")).withColumn("seq", F.lit(1).cast("long"))
    second = some.where("user % 6 = 0").withColumn("meta", host("renamed2")).withColumn("seq", F.lit(2).cast("long"))
    new = m.where("user = 1").withColumn("metric_key", F.concat(F.lit("new:"), F.col("metric_key"))).withColumn("seq", F.lit(3).cast("long"))
    return first.unionByName(second).unionByName(new).drop("user")


@query
def catalog_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.upsert(tables.event_metrics(spark, sf_dir), _incoming(spark, sf_dir)).select("metric_key", _tag_text("meta").alias("meta"))


@query
def catalog_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = tables.event_metrics(spark, sf_dir)
    new = cat.remove(cat.upsert(old, _incoming(spark, sf_dir)), old.where("metric_key like '%/4'"))
    return cat.diff(old, new)


@query
def catalog_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of resources that still have samples after the tenth day."""
    with_data = tables.event_samples(spark, sf_dir).where(F.col("time") > F.lit(datetime(2024, 1, 29)).cast("timestamp_ntz")).select("resource_id").distinct()
    return cat.prune(tables.event_metrics(spark, sf_dir), with_data).select("metric_key")


# ---- writing and maintenance


@query
def bulk_partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.bucket_counts(tables.event_samples(spark, sf_dir), DAY)


@query
def flush_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = ops.flush_batches(tables.event_samples(spark, sf_dir), DAY, 4)
    return batches.groupBy("resource_id", "p", "batch").agg(F.count("*").alias("n"))


@query
def compact_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of live series only."""
    metrics = tables.event_metrics(spark, sf_dir)
    live = cat.live_series(cat.remove(metrics, match.find_metrics(metrics, [TagMatcher("name", "signup")])))
    return _points(ops.live_only(tables.event_samples(spark, sf_dir), live))


@query
def compact_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions of several files, with events dealt to files by id."""
    e = tables.table(spark, sf_dir, "events").withColumn("p", paths.partition_label("ts", duration_us("PT6H")))
    return e.groupBy("p").agg(F.count_distinct(F.col("event_id") % 40).alias("files")).where("files >= 2")


def _expired(p: str) -> Column:
    return ops.expired(F.concat(F.lit("p="), F.col(p)), DAY, NOW - timedelta(microseconds=RETENTION))


def _line_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.line_samples(spark, sf_dir).groupBy(paths.partition_label("time", DAY).alias("p")).agg(F.count("*").alias("n"))


@query
def retention_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_partitions(spark, sf_dir).where(_expired("p"))


@query
def retention_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_partitions(spark, sf_dir).where(~_expired("p"))


def _scratch(spark: SparkSession) -> str:
    """A new folder that all machines see; a local one only where all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster see")
        root = "file:///tmp/checkpoints"
    return f"{root.rstrip('/')}/store-{uuid.uuid4().hex}"


def _store(spark: SparkSession, **settings: str) -> SampleStore:
    return SampleStore(spark, StoreConfig().with_text(base_dir=_scratch(spark), **settings)).open()


@query
def lz4_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, compression="LZ4_RAW")
    store.bulk_import(tables.event_samples(spark, sf_dir))
    return _points(store.samples())


@query
def compact_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writes a partition, merged: every row stays."""
    store = _store(spark, partition="PT240H")
    samples = tables.event_samples(spark, sf_dir)
    store.bulk_import(samples.where("value < 10"))
    store.bulk_import(samples.where("value >= 10"))
    store.compact()
    return _points(store.samples().drop("p"))


@query
def store_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query on a stored and pruned layout."""
    store = _store(spark)
    store.bulk_import(tables.event_samples(spark, sf_dir))
    store.replace_catalog(tables.event_metrics(spark, sf_dir))
    return _points(store.fetch_many(FLAGSHIP, START, END))


@query
def store_delete_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleting a metric and compacting removes its rows."""
    store = _store(spark, partition="PT240H")
    store.bulk_import(tables.event_samples(spark, sf_dir))
    store.replace_catalog(tables.event_metrics(spark, sf_dir))
    store.delete("name=click,resourceId=events/user/3")
    store.compact()
    return store.samples().groupBy("name").agg(F.count("*").alias("n"))


@query
def store_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = StoreConfig().with_text(base_dir=_scratch(spark), partition="P30D")
    store = SampleStore(spark, config, now=lambda: NOW).open()
    store.bulk_import(tables.line_samples(spark, sf_dir))
    store.sweep()
    return store.samples().groupBy("p").agg(F.count("*").alias("n"))


@query
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark)
    store.bulk_import(tables.event_samples(spark, sf_dir))
    store.replace_catalog(tables.event_metrics(spark, sf_dir))
    return store.stats().where(F.col("measure").isin("catalog_size", "partitions", "samples_written"))


@query
def stream_ingest_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through a stream into a store, read back."""
    store = _store(spark)
    schema = tables.table(spark, sf_dir, "events").schema
    source = _scratch(spark)
    tables.table(spark, sf_dir, "events").write.parquet(source)
    stream = read_stream(spark, source, schema)
    samples = stream.select(F.concat(F.lit("events/user/"), F.col("user_id").cast("string")).alias("resource_id"), F.col("event_type").alias("name"), F.col("ts").cast("timestamp_ntz").alias("time"), "value")
    ingest(samples, store, f"{_scratch(spark)}/state").awaitTermination()
    return _points(store.samples())


# ---- round-robin archives


@query
def rrd_number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events")
    n = F.col("event_id") % 6
    text = F.when(n == 0, F.lit(" U ")).when(n == 1, F.lit("inf")).when(n == 2, F.lit("-INF")).when(n == 3, F.concat(F.lit(" "), F.col("event_id").cast("string"))).when(n == 4, F.lit("1.5e3")).otherwise(F.lit("x"))
    p = e.select("event_id", text.alias("text"))
    number = numbers.parse_double("text")
    return p.select("event_id", F.when(number.isin(float("inf"), float("-inf")), F.lit(None)).otherwise(number).alias("number"), numbers.format_double(numbers.parse_double("text")).isin("inf", "-inf").alias("infinite"), numbers.parse_long("text").alias("whole"))


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rrd.archives(tables.dumps(spark, sf_dir), ["file"])


@query
def rrd_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _archives(spark, sf_dir).select("file", F.col("pos").cast("long").alias("pos"), "k", "n", F.col("first").alias("first_ts"), F.col("last").alias("last_ts"))


@query
def rrd_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rrd.select_archives(_archives(spark, sf_dir), ["file"]).select("file", F.col("pos").cast("long").alias("pos"), "cf", "k")


@query
def rrd_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rrd.stitch_bounds(rrd.select_archives(_archives(spark, sf_dir), ["file"]), ["file"]).select("file", "k", F.col("begin").alias("begin_ts"), F.col("until").alias("until_ts"))


@query
def rrd_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = rrd.history(tables.dumps(spark, sf_dir), ["file"])
    return h.where("type = 'GAUGE'").select("file", "ts", "value")


@query
def rrd_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = rrd.history(tables.dumps(spark, sf_dir), ["file"])
    return h.where("type = 'COUNTER'").select("file", "ts", "value")


@query
def rrd_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sources of every archive."""
    h = rrd.history(tables.dumps(spark, sf_dir), ["file"])
    s = rrd.import_samples(h, F.concat(F.lit("snmp/"), F.col("file").cast("string")), F.lit("net"))
    return _points(s.select("resource_id", "name", "time", "value", _tag_text("meta").alias("meta")))


@query
def rrd_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = tables.dumps(spark, sf_dir).select("file", F.posexplode(rrd.split_dump(F.col("dump"))).alias("i", "d"))
    cells = F.aggregate(F.flatten(F.flatten(F.transform("d.rra", lambda a: a["rows"]))), F.lit(0.0), lambda s, v: s + F.when(F.isnan(v), F.lit(0.0)).otherwise(v))
    return one.select("file", F.col("d.ds")[0]["name"].alias("ds"), cells.alias("total"))


@query
def rrd_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump that has lost all its cells gets them back from its own parts."""
    d = tables.dumps(spark, sf_dir).select("file", "dump", rrd.split_dump(F.col("dump")).alias("parts"))
    m = d.select("file", rrd.merge_many(rrd.reset_dump(F.col("dump")), F.col("parts")).alias("dump"))
    cells = F.aggregate(F.flatten(F.flatten(F.transform("dump.rra", lambda a: a["rows"]))), F.lit(0.0), lambda s, v: s + F.when(F.isnan(v), F.lit(0.0)).otherwise(v))
    return m.select("file", cells.alias("total"))
