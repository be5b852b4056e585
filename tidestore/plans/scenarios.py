"""Queries of operators that work on files, sessions and settings: small stores and trees, and what they then hold.

Each returns (step, fact) pairs of text; the expected pairs are stated beside it and are its SQL twin.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidestore import cli
from tidestore.functions import numbers, paths
from tidestore.model import CATALOG_TAGS, METRICS, SAMPLES, FetchRequest, Match, StoreConfig, TagMatcher
from tidestore.operators import matchers as match
from tidestore.operators import rrd
from tidestore.operators import samples as ops
from tidestore.plans.queries import _scratch
from tidestore.sources import rrd_files
from tidestore.sources.maintenance import Timers
from tidestore.sources.store import SampleStore
from tidestore.streaming.ingest import ingest, read_stream

Facts = list[tuple[str, object]]
SCENARIOS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
EXPECTED: dict[str, list[tuple[str, str]]] = {}
T0 = datetime(2026, 7, 6, 12)


def scenario(*expected: tuple[str, object]) -> Callable:
    def register(f: Callable[[SparkSession], Facts]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return spark.createDataFrame([(step, str(fact)) for step, fact in f(spark)], "step string, fact string")

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        SCENARIOS[f.__name__] = run
        EXPECTED[f.__name__] = [(step, str(fact)) for step, fact in expected]
        return run

    return register


def oracle(pairs: list[tuple[str, str]]) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return "select * from (values " + ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in pairs) + ") as t(step, fact)"


def _samples(spark: SparkSession, n: int, rid: str = "snmp/1", name: str = "in", start: datetime = T0) -> DataFrame:
    return spark.createDataFrame([(rid, name, start + timedelta(seconds=i), i * 1.5) for i in range(n)], SAMPLES)


def _metrics(spark: SparkSession, *names: str, rid: str = "snmp/1") -> DataFrame:
    tag = lambda k, v: {"key": k, "value": v}
    rows = [(f"{rid}:{n}", [tag("name", n), tag("resourceId", rid)], [tag("host", "h")], [tag(None, "bare")]) for n in names]
    return spark.createDataFrame(rows, METRICS).withColumn("seq", F.lit(1).cast("long"))


def _store(spark: SparkSession, base: str | None = None, clock: list[datetime] | None = None, **settings: str) -> SampleStore:
    config = StoreConfig().with_text(base_dir=base or _scratch(spark), **settings)
    return SampleStore(spark, config, now=(lambda: clock[0]) if clock else None).open()


def _outcome(run: Callable[[], object]) -> str:
    try:
        run()
    except Exception as e:
        return type(e).__name__
    return "none"


def _files(store: SampleStore) -> int:
    return sum(map(len, store._partitions().values()))


# ---- sources


@scenario(("rows", 4), ("rows after compaction", 4), ("files left", 2), ("unreadable", 1))
def scan_bad_files(spark: SparkSession) -> Facts:
    """Empty, damaged and hidden files beside good ones."""
    store = _store(spark)
    for _ in range(2):
        store.bulk_import(_samples(spark, 2))
    folder = f"{store.data}/p=2026-07-06"
    for name, text in (("part-empty.parquet", ""), ("part-damaged.parquet", "no parquet"), (".part-hidden.tmp", "x")):
        store.files.write_text(f"{folder}/{name}", text)
    before = store.samples().count()
    store.compact()
    bad = store.stats().where("measure = 'unreadable_files'").first()["value"]
    return [("rows", before), ("rows after compaction", store.samples().count()), ("files left", _files(store)), ("unreadable", bad)]


def _tree(spark: SparkSession) -> str:
    """An import tree: two groups of one resource, one of an unknown node, a response, and a broken dump."""
    root = f"{_scratch(spark)}/rrd"
    store = SampleStore(spark, StoreConfig(base_dir=root))
    ds = "<ds><name>{0}</name><type>{1}</type><minimal_heartbeat>600</minimal_heartbeat><min>U</min><max>inf</max><last_ds>U</last_ds><value>0</value><unknown_sec>0</unknown_sec></ds>"
    rra = "<rra><cf>{0}</cf><pdp_per_row>1</pdp_per_row><params><xff>0.5</xff></params><cdp_prep/><database><row><v>1</v></row><row><v>NaN</v></row><row><v>3</v></row></database></rra>"
    dump = lambda name, kind="GAUGE", cf="AVERAGE", version="0003": f"<rrd><version>{version}</version><step>300</step><lastupdate>1700000000</lastupdate>{ds.format(name, kind)}{rra.format(cf)}</rrd>"
    put = store.files.write_text
    for node in ("snmp/5/eth0", "snmp/9/eth0", "response/10.0.0.1"):
        store.files.make(f"{root}/{node}")
        put(f"{root}/{node}/ds.properties", "# sources\nload=net\nother = net\n\n! none\nocts: bytes\n")
        put(f"{root}/{node}/strings.properties", "alias=up link\n")
        put(f"{root}/{node}/net.xml", dump("load"))
    put(f"{root}/snmp/5/eth0/octs.meta", "GROUP=bytes\nX=1\n")
    put(f"{root}/snmp/5/eth0/none.meta", "X=1\n")
    put(f"{root}/snmp/5/eth0/octs.xml", dump("octs"))
    put(f"{root}/snmp/5/eth0/broken.xml", "<rrd")
    for name, text in (("kind", dump("k", "WRONG")), ("cf", dump("k", cf="WRONG")), ("old", dump("k", cf="HWPREDICT", version="0001")), ("new", dump("k", cf="HWPREDICT"))):
        store.files.make(f"{root}/other")
        put(f"{root}/other/{name}.xml", text)
    return root


def _pairs(rows: DataFrame, root: str) -> Facts:
    return [(r[0], "; ".join(map(str, r[1:]))) for r in rows.withColumn("directory", F.regexp_extract("directory", "rrd/(.*)$", 1)).collect()]


@scenario(("snmp/5/eth0", "net"), ("snmp/5/eth0", "bytes"), ("snmp/9/eth0", "net"), ("snmp/9/eth0", "bytes"), ("response/10.0.0.1", "net"), ("response/10.0.0.1", "bytes"))
def walk_groups(spark: SparkSession) -> Facts:
    root = _tree(spark)
    return _pairs(rrd_files.groups_by_directory(spark, root), root)


@scenario(("snmp/5/eth0", "octs; bytes"))
def walk_metrics(spark: SparkSession) -> Facts:
    root = _tree(spark)
    return _pairs(rrd_files.groups_by_metric(spark, root), root)


@scenario(*((d, "alias=up link") for d in ("snmp/5/eth0", "snmp/9/eth0", "response/10.0.0.1")))
def walk_external_tags(spark: SparkSession) -> Facts:
    root = _tree(spark)
    text = F.array_join(F.transform("external", lambda t: F.concat(t["key"], F.lit("="), t["value"])), ",")
    return _pairs(rrd_files.external_tags(spark, root).select("directory", text), root)


@scenario(("broken.xml", "None"), ("cf.xml", "None"), ("kind.xml", "None"), ("old.xml", "None"), ("new.xml", "k HWPREDICT 3"), *[("net.xml", "load AVERAGE 3")] * 3, ("octs.xml", "octs AVERAGE 3"))
def dump_parse(spark: SparkSession) -> Facts:
    """Dumps as nested rows; broken ones and unknown names of types and consolidations are none."""
    d = rrd_files.read_dumps(spark, _tree(spark)).select(F.regexp_extract("file", "([^/]*)$", 1).alias("file"), F.col("dump.ds")[0]["name"].alias("ds"), F.col("dump.rra")[0].alias("a"))
    rows = d.select("file", F.concat_ws(" ", "ds", "a.cf", F.size("a.rows").cast("string")).alias("t"), F.col("ds").isNull().alias("none")).collect()
    return [(r["file"], None if r["none"] else r["t"]) for r in rows]


@scenario(("archive", "HWPREDICT 0.5 0.1 4 None"), ("point", "1.5 None 3"), ("unreadable", "None"))
def archive_state(spark: SparkSession) -> Facts:
    """Parameters and prepared points that a dump keeps beside its rows."""
    params = "<params><xff>0.5</xff><hw_alpha>0.1</hw_alpha><dependent_rra_idx> 4 </dependent_rra_idx></params>"
    points = "<cdp_prep><ds><primary_value>1.5</primary_value><value>U</value><unknown_datapoints>3</unknown_datapoints></ds></cdp_prep>"
    text = f"<rrd><version>0003</version><step>300</step><lastupdate>1</lastupdate><ds><name>a</name><type>GAUGE</type></ds><rra><cf>HWPREDICT</cf><pdp_per_row>1</pdp_per_row>{params}{points}<database/></rra></rrd>"
    rows = spark.createDataFrame([(0, text), (1, "<rrd")], "n int, xml string").select("n", rrd_files.parse_state("xml").alias("s")).orderBy("n").collect()
    a, p = rows[0]["s"][0], rows[0]["s"][0]["points"][0]
    return [
        ("archive", f"{a['cf']} {a['xff']} {a['hw_alpha']} {a['dependent_rra_idx']} {a['window_length']}"),
        ("point", f"{p['primary_value']} {p['value']} {p['unknown_datapoints']}"), ("unreadable", rows[1]["s"]),
    ]


@scenario(
    ("counts", "files 5, skipped 4, samples 4"), ("response/10.0.0.1/net", "load 1.0"), ("response/10.0.0.1/net", "load 3.0"),
    ("snmp/fs/Req/n5/eth0/net", "load 1.0"), ("snmp/fs/Req/n5/eth0/net", "load 3.0"), ("tags", "mtype=gauge alias=up link"),
)
def import_tree(spark: SparkSession) -> Facts:
    """A whole tree by group, nodes renamed, dumps of unknown nodes left out."""
    root, nodes = _tree(spark), spark.createDataFrame([(5, "Req", "n5")], cli.NODES)
    store = _store(spark)
    got = cli.import_dumps(store, root, nodes=nodes)
    rows = [(r["resource_id"], f"{r['name']} {r['value']}") for r in store.samples().collect()]
    tags = {" ".join(f"{t['key']}={t['value']}" for t in [*m["meta"], *m["external"]]) for m in store.metrics().collect()}
    return [("counts", ", ".join(f"{k} {v}" for k, v in got.items())), *rows, *(("tags", t) for t in tags)]


@scenario(("snmp/5/eth0/bytes", "octs"), ("response/10.0.0.1/net", "load"))
def import_tree_by_metric(spark: SparkSession) -> Facts:
    store = _store(spark)
    cli.import_dumps(store, _tree(spark), by_metric=True)
    return [tuple(r) for r in store.samples().select("resource_id", "name").distinct().collect()]


# ---- arguments, settings and life cycle


@scenario(("no matchers", "ValueError"), ("null matchers", "TypeError"), ("bad pattern", "ValueError"), ("aggregation", "ValueError"), ("no aggregation", "none"))
def argument_checks(spark: SparkSession) -> Facts:
    metrics, rows = _metrics(spark, "in"), _samples(spark, 1)
    return [
        ("no matchers", _outcome(lambda: match.find_metrics(metrics, []))),
        ("null matchers", _outcome(lambda: match.find_metrics(metrics, None))),
        ("bad pattern", _outcome(lambda: match.find_metrics(metrics, [TagMatcher("host", "(", Match.EQUALS_REGEX)]))),
        ("aggregation", _outcome(lambda: ops.fetch(rows, metrics, "k", T0, T0, "AVERAGE"))),
        ("no aggregation", _outcome(lambda: ops.fetch(rows, metrics, "k", T0, T0))),
    ]


@scenario(
    ("defaults", "86400000000 31536000000000 86400000000 uncompressed True 8192 60000000 True 3600000000"), ("text", "/x 3600000000 10 lz4_raw False"),
    ("partition", "ValueError"), ("codec", "ValueError"), ("flush_rows", "ValueError"), ("unknown", "ValueError"),
)
def store_settings(spark: SparkSession) -> Facts:
    c, d = StoreConfig(), StoreConfig().with_text(base_dir=" /x ", partition="PT1H", retention="", flush_rows="10", compression="LZ4_raw", compact_on="false")
    return [
        ("defaults", f"{c.partition_us} {c.retention_us} {c.sweep_us} {c.compression} {c.prune_catalog} {c.flush_rows} {c.flush_us} {c.compact_on} {c.compaction_us}"),
        ("text", f"{d.base_dir} {d.partition_us} {d.flush_rows} {d.compression} {d.compact_on}"),
        ("partition", _outcome(lambda: c.with_text(partition="PT30S"))),
        ("codec", _outcome(lambda: c.with_text(compression="GZIP"))),
        ("flush_rows", _outcome(lambda: c.with_text(flush_rows="0"))),
        ("unknown", _outcome(lambda: c.with_text(nothing="1"))),
    ]


@scenario(("no folder", "StorageError"), ("not open", "StorageError"), ("stored", 0), ("reopened", 2), ("closed", "StorageError"), ("null samples", "TypeError"))
def life_cycle(spark: SparkSession) -> Facts:
    """A store must be open; closing it writes what it buffers."""
    shut = SampleStore(spark, StoreConfig(base_dir=_scratch(spark)))
    facts: Facts = [("no folder", _outcome(SampleStore(spark, StoreConfig()).open)), ("not open", _outcome(shut.samples))]
    with shut as s:
        s.store(_samples(spark, 2), _metrics(spark, "in"))
        facts.append(("stored", s.samples().count()))
    with SampleStore(spark, shut.config) as s:
        facts += [("reopened", s.samples().count()), ("null samples", _outcome(lambda: s.store(None)))]
    return [*facts, ("closed", _outcome(shut.compact))]


@scenario(("data", "/b/data"), ("catalog", "/b/catalog"), ("file path", "snmp/1/a:b"), ("other file path", "snmp\\1\\a_b"), ("equal", True), ("not equal", False), ("null resource", "PySparkException"), ("samples", "resource_id, name, time, value"), ("tags", "metric_key, tag_type, tag_key, tag_value"))
def store_paths(spark: SparkSession) -> Facts:
    one = lambda c: spark.range(1).select(c).first()[0]
    e = paths.path_elements(F.lit("snmp/1/a:b"))
    bad = _outcome(lambda: one(paths.shard_path(F.lit(None).cast("string"))))
    return [
        ("data", paths.data_root("/b/")), ("catalog", paths.catalog_root("/b")), ("file path", one(paths.file_path(e))), ("other file path", one(paths.file_path(e, "\\"))),
        ("equal", one(e == paths.path_elements(F.lit("snmp/1/a:b/")))), ("not equal", one(e == paths.path_elements(F.lit("snmp/1")))),
        ("null resource", "none" if bad == "none" else "PySparkException"), ("samples", ", ".join(SAMPLES.names)), ("tags", ", ".join(CATALOG_TAGS.names)),
    ]


@scenario(("7", "7"), ("inf", "inf"), ("-inf", "-inf"), ("U", "None"), (" HWPREDICT ", "HWPREDICT"), ("first version", "error"), ("unknown", "error"), ("null", "None"))
def number_and_name_forms(spark: SparkSession) -> Facts:
    one = lambda c: spark.range(1).select(c).first()[0]
    name = lambda x, allowed: one(numbers.parse_enum(F.lit(x).cast("string"), allowed))
    fails = lambda run: "none" if _outcome(run) == "none" else "error"
    return [
        *((x, one(numbers.format_long(numbers.parse_long(F.lit(x))))) for x in ("7", "inf", "-inf", "U")),
        (" HWPREDICT ", name(" HWPREDICT ", numbers.CF_V3)), ("first version", fails(lambda: name("HWPREDICT", numbers.CF_V1))),
        ("unknown", fails(lambda: name("SUM", numbers.DS_V3))), ("null", name(None, numbers.DS_V3)),
    ]


# ---- buffering


@scenario(("buffered", 0), ("full bucket", "many 12"), ("drained", "few 7, many 12"), ("flushed", "few 7, late 1, many 12"), ("written", 20), ("partitions", 2))
def buffer_buckets(spark: SparkSession) -> Facts:
    """Only the bucket that is full is written; one is drained; the rest is flushed."""
    store = _store(spark, flush_rows="10")
    counts = lambda: ", ".join(f"{r['resource_id']} {r['count']}" for r in store.samples().groupBy("resource_id").count().orderBy("resource_id").collect())
    store.store(_samples(spark, 7, "few"))
    store.store(_samples(spark, 6, "many"))
    facts: Facts = [("buffered", store.samples().count())]
    store.store(_samples(spark, 6, "many", start=T0 + timedelta(minutes=5)))
    facts.append(("full bucket", counts()))
    store.store(_samples(spark, 1, "late", start=T0 + timedelta(days=1)))
    store.drain("few", "2026-07-06")
    facts.append(("drained", counts()))
    store.flush()
    return [*facts, ("flushed", counts()), ("written", store.counters["samples_written"]), ("partitions", store.counters["partitions_created"])]


@scenario(("before", "[] 0"), ("after a minute", "['flush'] 2"), ("after an hour", "['compact'] 1"), ("after a month", "['compact', 'sweep'] 0"))
def timed_maintenance(spark: SparkSession) -> Facts:
    clock = [T0]
    store = _store(spark, clock=clock, flush="PT60S", compaction="PT1H", sweep="P1D", retention="P30D")
    timers = Timers(store)
    store.store(_samples(spark, 2))
    facts: Facts = [("before", f"{timers.tick()} {store.samples().count()}")]
    clock[0] += timedelta(seconds=61)
    facts.append(("after a minute", f"{timers.tick()} {store.samples().count()}"))
    store.bulk_import(_samples(spark, 2))
    clock[0] += timedelta(hours=1)
    facts.append(("after an hour", f"{timers.tick()} {_files(store)}"))
    clock[0] += timedelta(days=40)
    return [*facts, ("after a month", f"{sorted(timers.tick())} {store.samples().count()}")]


@scenario(("while failing", 0), ("once it works", 3))
def failed_flush_keeps_rows(spark: SparkSession) -> Facts:
    class Full(SampleStore):
        broken = True

        def bulk_import(self, samples: DataFrame) -> int:
            if self.broken:
                raise OSError("no space")
            return super().bulk_import(samples)

    with Full(spark, StoreConfig(base_dir=_scratch(spark))) as store:
        store.store(_samples(spark, 3))
        _outcome(store.flush)
        facts: Facts = [("while failing", store.samples().count())]
        store.broken = False
        store.flush()
        return [*facts, ("once it works", store.samples().count())]


# ---- maintenance


@scenario(("P1D", 3), ("PT1H", 5), ("P30D", 7), ("PT15M", 9))
def read_across_durations(spark: SparkSession) -> Facts:
    """Rows of partitions of any duration that has been in use are found."""
    base, facts = _scratch(spark), []
    request = FetchRequest("snmp/1:in", T0 - timedelta(hours=1), T0 + timedelta(hours=1))
    for n, duration in ((3, "P1D"), (2, "PT1H"), (2, "P30D"), (2, "PT15M")):
        with _store(spark, base, partition=duration) as store:
            store.upsert(_metrics(spark, "in"))
            store.bulk_import(_samples(spark, n, start=T0 + timedelta(minutes=20)))
            facts.append((duration, store.fetch(request).count()))
    return facts


@scenario(("hidden", 0), ("purged", "in"), ("added meanwhile", 1), ("purged next", 0), ("left", 0))
def purge_set(spark: SparkSession) -> Facts:
    """Tombstones are dropped once their rows are gone, and not before."""

    class Busy(SampleStore):
        def _rewrite(self, *a: object) -> None:
            super()._rewrite(*a)
            self.delete("snmp/1:in")

    with Busy(spark, StoreConfig(base_dir=_scratch(spark))) as store:
        store.upsert(_metrics(spark, "in", "out"))
        store.bulk_import(_samples(spark, 3).unionByName(_samples(spark, 3, name="out")))
        store.delete("snmp/1:out")
        facts: Facts = [("hidden", store.fetch(FetchRequest("snmp/1:out", T0 - timedelta(days=1), T0 + timedelta(days=1))).count())]
        store.compact()
        facts.append(("purged", ",".join(sorted({r["name"] for r in store.samples().collect()}))))
        tombs = lambda: sum(e.name.startswith("part-") and e.size > 0 for e in store.files.list(f"{store.config.base_dir}/tombstones"))
        facts.append(("added meanwhile", min(1, tombs())))
        SampleStore.compact(store)
        return [*facts, ("purged next", store.samples().count()), ("left", tombs())]


@scenario(("before", 6), ("files", 1), ("after", 6), ("staged", 0))
def recovery(spark: SparkSession) -> Facts:
    """A compaction that broke off after its journal was written is finished by the next session."""

    class Lost(SampleStore):
        def _publish(self, journal: str) -> tuple[int, int]:
            if "compact-" in journal:
                raise RuntimeError("lost")
            return super()._publish(journal)

    base = _scratch(spark)
    with Lost(spark, StoreConfig(base_dir=base)) as store:
        for _ in range(2):
            store.bulk_import(_samples(spark, 3))
        _outcome(store.compact)
        facts: Facts = [("before", store.samples().count())]
    with _store(spark, base) as store:
        staged = sum(e.name.startswith(".stage-") for e in store.files.list(base))
        return [*facts, ("files", _files(store)), ("after", store.samples().count()), ("staged", staged)]


@scenario(("compacted", 1), ("failed", 1), ("files", 3), ("rows of the good one", 4))
def compaction_keeps_failures_apart(spark: SparkSession) -> Facts:
    """One partition that can't be read doesn't keep the others from being merged."""

    class Bad(SampleStore):
        def samples(self, paths: list[str] | None = None, whole: bool = False) -> DataFrame:
            rows = super().samples(paths, whole)
            return rows.withColumn("value", F.when(F.col("p") == "2026-07-06", F.raise_error(F.lit("bad page")).cast("double")).otherwise(F.col("value"))) if whole else rows

    with Bad(spark, StoreConfig(base_dir=_scratch(spark))) as store:
        for day in (0, 1):
            for _ in range(2):
                store.bulk_import(_samples(spark, 2, start=T0 + timedelta(days=day)))
        done = store.compact()
        return [("compacted", done), ("failed", store.counters["compaction_failures"]), ("files", _files(store)), ("rows of the good one", store.samples().where("p = '2026-07-07'").count())]


@scenario(("expired", 0), ("kept", "snmp/1:in"))
def sweep_prunes_always(spark: SparkSession) -> Facts:
    """Metrics without data go on every sweep; what is buffered counts as data."""
    store = _store(spark, clock=[T0])
    store.upsert(_metrics(spark, "in").unionByName(_metrics(spark, "in", rid="never")))
    store.store(_samples(spark, 1))
    return [("expired", store.sweep()), ("kept", ",".join(r["metric_key"] for r in store.metrics().collect()))]


@scenario(("busy", "0 0"), ("free", "1 0"))
def maintained_by_one(spark: SparkSession) -> Facts:
    base = _scratch(spark)
    with _store(spark, base, clock=[T0]) as one, _store(spark, base, clock=[T0]) as two:
        for _ in range(2):
            one.bulk_import(_samples(spark, 1))
        with one._lease():
            facts: Facts = [("busy", f"{two.compact()} {two.sweep()}")]
        return [*facts, ("free", f"{two.compact()} {two.sweep()}")]


@scenario(("a", 4), ("b", 2))
def two_streams(spark: SparkSession) -> Facts:
    """Batches of streams are stored once each, also if numbers of their batches are equal."""
    store, state = _store(spark), _scratch(spark)
    for name in ("a", "b", "a"):
        _samples(spark, 2, name).write.mode("append").parquet(f"{state}/source-{name}")
        ingest(read_stream(spark, f"{state}/source-{name}", SAMPLES), store, f"{state}/state-{name}").awaitTermination()
    return [(r["resource_id"], r["count"]) for r in store.samples().groupBy("resource_id").count().collect()]


@scenario(("first", 1), ("again", 0), ("rows", 3), ("written", 3), ("read", 3), ("measures", "tidestore_samples_read 3"))
def batch_once_and_counters(spark: SparkSession) -> Facts:
    store = _store(spark)
    store.upsert(_metrics(spark, "in"))
    first = store.import_batch(_samples(spark, 3), "s", 0)
    again = store.import_batch(_samples(spark, 3), "s", 0)
    rows = len(store.fetch(FetchRequest("snmp/1:in", T0 - timedelta(days=1), T0 + timedelta(days=1))).collect())
    stats = {r["measure"]: r["value"] for r in store.stats().collect()}
    store.export_stats(f"{store.config.base_dir}/metrics.txt")
    lines = store.files.read_text(f"{store.config.base_dir}/metrics.txt").splitlines()
    return [("first", first), ("again", again), ("rows", rows), ("written", stats["samples_written"]), ("read", stats["samples_read"]), ("measures", next(x for x in lines if "samples_read" in x))]


# ---- archives


@scenario(("same", True), ("part", False), ("other type, plain", True), ("other type, typed", False), ("merged", "1.0 2.0 NaN 4.0 NaN NaN"), ("blank", "NaN NaN NaN NaN NaN NaN"), ("no mate", "error"), ("index", 1))
def archive_merge_one(spark: SparkSession) -> Facts:
    """One archive filled from another, and when two have one format."""
    ds = "array<struct<name: string, type: string, heartbeat: bigint, min: double, max: double, last_ds: double, value: double, unknown_sec: bigint, cdef: string>>"
    kind = f"struct<version: string, step: bigint, lastupdate: bigint, ds: {ds}, rra: array<struct<cf: string, k: bigint, xff: double, rows: array<array<double>>>>>"
    source = lambda name, type_="GAUGE": {"name": name, "type": type_, "heartbeat": 600, "min": None, "max": None, "last_ds": 1.0, "value": 0.0, "unknown_sec": 0, "cdef": None}
    nan = float("nan")
    dump = lambda types=("GAUGE", "GAUGE"), cf="AVERAGE": {"version": "0003", "step": 300, "lastupdate": 1_700_000_000, "ds": [source("a", types[0]), source("b", types[1])], "rra": [{"cf": cf, "k": 1, "xff": 0.5, "rows": [[1.0, 2.0], [nan, 4.0], [nan, nan]]}]}
    d = spark.createDataFrame([(dump(), dump(("GAUGE", "COUNTER")), dump(cf="MAX"))], f"d {kind}, typed {kind}, other {kind}")
    blank, cells = rrd.reset_dump(F.col("d")), lambda x: F.array_join(F.flatten(F.flatten(F.transform(x["rra"], lambda a: a["rows"]))), " ")
    r = d.select(
        rrd.format_equals(F.col("d"), blank).alias("same"), rrd.format_equals(F.col("d"), rrd.split_dump(F.col("d"))[0]).alias("part"),
        rrd.format_equals(F.col("d"), F.col("typed")).alias("plain"), rrd.format_equals(F.col("d"), F.col("typed"), typed=True).alias("strict"),
        cells(rrd.merge_one(blank, F.col("d"))).alias("merged"), cells(blank).alias("blank"), rrd.source_index(F.col("d"), "b").alias("at"),
    ).first()
    bad = _outcome(lambda: d.select(cells(rrd.merge_one(blank, F.col("other")))).collect())
    return [
        ("same", r["same"]), ("part", r["part"]), ("other type, plain", r["plain"]), ("other type, typed", r["strict"]),
        ("merged", r["merged"]), ("blank", r["blank"]), ("no mate", "none" if bad == "none" else "error"), ("index", r["at"]),
    ]


@scenario(("compact", "partitions compacted: 1"), ("sweep", "partitions deleted: 0"), ("stats", "files: 1"), ("no confirmation", "SystemExit"))
def commands(spark: SparkSession) -> Facts:
    """The command line on a store."""
    import contextlib
    import io

    with _store(spark, clock=[T0]) as store:
        for _ in range(2):
            store.bulk_import(_samples(spark, 1, start=datetime.now().replace(microsecond=0)))
    facts: Facts = []
    for command in ("compact", "sweep", "stats"):
        said = io.StringIO()
        with contextlib.redirect_stdout(said):
            cli.main(["--base-dir", store.config.base_dir, command])
        facts.append((command, next(x for x in said.getvalue().splitlines() if command != "stats" or x.startswith("files"))))
    try:
        with contextlib.redirect_stderr(io.StringIO()):
            cli.main(["--base-dir", "x", "import", "y"])
    except SystemExit:
        facts.append(("no confirmation", "SystemExit"))
    return facts


ORACLES = {name: oracle(pairs) for name, pairs in EXPECTED.items()}
