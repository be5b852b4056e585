import time
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidestore.functions.paths import encode_element
from tidestore.model import FetchRequest, Match, StorageError, StoreConfig, TagMatcher
from tidestore.sources.files import Files
from tidestore.sources.maintenance import Timers
from tidestore.sources.store import SampleStore, read_sharded_layout
from tidestore.streaming.ingest import ingest, read_stream

T0 = datetime(2026, 7, 6, 12)
KIND = "array<struct<key: string, value: string>>"


def samples(spark, n, name="in", rid="snmp/1", start=T0, step=1.0):
    rows = [(rid, name, start + timedelta(seconds=i), i * step) for i in range(n)]
    return spark.createDataFrame(rows, "resource_id string, name string, time timestamp_ntz, value double")


def metrics(spark, *names, rid="snmp/1", host="h"):
    tag = lambda k, v: {"key": k, "value": v}
    rows = [(f"{rid}:{n}", [tag("name", n), tag("resourceId", rid)], [tag("host", host)], [tag(None, "keyless")], 1) for n in names]
    return spark.createDataFrame(rows, f"metric_key string, intrinsic {KIND}, meta {KIND}, external {KIND}, seq long")


@pytest.fixture
def store(spark, tmp_path):
    with SampleStore(spark, StoreConfig(base_dir=f"file://{tmp_path}", flush_rows=10)) as s:
        yield s


def files(store):
    return sorted(Path(store.data.removeprefix("file://")).glob("p=*/part-*.parquet"))


def test_buffer_is_invisible_until_it_is_full(spark, store):
    store.store(samples(spark, 3), metrics(spark, "in"))
    assert store.samples().count() == 0
    store.store(samples(spark, 8))
    assert store.samples().count() == 11
    assert store.counters["samples_written"] == 11 and store.counters["partitions_created"] == 1


def test_close_writes_the_buffer(spark, tmp_path):
    config = StoreConfig(base_dir=f"file://{tmp_path}")
    with SampleStore(spark, config) as s:
        s.store(samples(spark, 2))
    with SampleStore(spark, config) as s:
        assert s.samples().count() == 2


def test_not_open_and_no_base_dir(spark, tmp_path):
    with pytest.raises(StorageError):
        SampleStore(spark, StoreConfig()).open()
    with pytest.raises(StorageError):
        SampleStore(spark, StoreConfig(base_dir=f"file://{tmp_path}")).compact()


def test_fetch_leaves_out_both_bounds(spark, store):
    store.upsert(metrics(spark, "in"))
    store.bulk_import(samples(spark, 5))
    got = store.fetch(FetchRequest("snmp/1:in", T0, T0 + timedelta(seconds=4))).collect()
    assert [r["value"] for r in got] == [1.0, 2.0, 3.0]
    with pytest.raises(ValueError):
        store.fetch(FetchRequest("snmp/1:in", T0, T0, aggregation="AVERAGE"))
    assert store.fetch(FetchRequest("unknown", T0, T0 + timedelta(days=1))).count() == 0


def test_samples_need_a_resource(spark, store):
    with pytest.raises(Exception, match="resourceId"):
        store.bulk_import(samples(spark, 1).withColumn("resource_id", F.lit(None).cast("string")))
    assert store.samples().count() == 0


def test_one_file_a_partition_and_compaction(spark, store):
    both = samples(spark, 3).unionByName(samples(spark, 4, start=T0 + timedelta(days=1)))
    assert store.bulk_import(both) == 2
    store.bulk_import(samples(spark, 3))
    assert len(files(store)) == 3
    assert store.compact() == 1
    assert len(files(store)) == 2 and store.samples().count() == 10
    assert store.compact() == 0


def test_bad_files_are_skipped(spark, store):
    for _ in range(2):
        store.bulk_import(samples(spark, 2))
    folder = files(store)[0].parent
    (folder / "part-empty.parquet").touch()
    (folder / "part-corrupt.parquet").write_text("not parquet")
    (folder / ".part-x.tmp").write_text("hidden")
    assert store.samples().count() == 4
    assert store.compact() == 1
    assert store.samples().count() == 4
    left = {f.name for f in files(store)}
    assert "part-corrupt.parquet" in left and "part-empty.parquet" not in left and len(left) == 2
    assert {r["measure"]: r["value"] for r in store.stats().collect()}["unreadable_files"] == 1


def test_delete_hides_at_once_and_purges_later(spark, tmp_path):
    config = StoreConfig(base_dir=f"file://{tmp_path}")
    with SampleStore(spark, config) as s:
        s.upsert(metrics(spark, "in", "out"))
        s.bulk_import(samples(spark, 3).unionByName(samples(spark, 3, "out")))
        s.delete("snmp/1:out")
        s.delete("unknown")
        assert s.find([TagMatcher("host", "h")]).count() == 1
        assert s.samples().count() == 6
    with SampleStore(spark, config) as s:  # the purge outlives a restart
        assert s.compact() == 1
        assert {r["name"] for r in s.samples().collect()} == {"in"}


def test_deleted_and_stored_again_keeps_rows(spark, store):
    store.upsert(metrics(spark, "in"))
    store.bulk_import(samples(spark, 3))
    store.delete("snmp/1:in")
    store.upsert(metrics(spark, "in"))
    store.compact()
    assert store.samples().count() == 3


def test_broken_compaction_is_finished_on_open(spark, tmp_path, monkeypatch):
    config = StoreConfig(base_dir=f"file://{tmp_path}")
    with SampleStore(spark, config) as s:
        for _ in range(2):
            s.bulk_import(samples(spark, 3))
        monkeypatch.setattr(SampleStore, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            s.compact()
        monkeypatch.undo()
    with SampleStore(spark, config) as s:
        assert s.samples().count() == 6 and len(files(s)) == 1


def test_catalog_upsert_replaces_and_survives(spark, tmp_path):
    config = StoreConfig(base_dir=f"file://{tmp_path}")
    with SampleStore(spark, config) as s:
        assert s.upsert(metrics(spark, "a", "b")) == 2
        assert s.upsert(metrics(spark, "a", "b")) == 0
        assert s.upsert(metrics(spark, "a", host="renamed")) == 1
    with SampleStore(spark, config) as s:
        assert s.metrics().count() == 2
        assert [r["metric_key"] for r in s.find([TagMatcher("host", "ren.*", Match.EQUALS_REGEX)]).collect()] == ["snmp/1:a"]
        assert s.tags().where("tag_key is null").count() == 2


def test_retention_boundary_and_prune(spark, tmp_path):
    now = datetime(2026, 7, 6)
    config = StoreConfig(base_dir=f"file://{tmp_path}").with_text(retention="P30D")
    with SampleStore(spark, config, now=lambda: now) as s:
        s.upsert(metrics(spark, "in").unionByName(metrics(spark, "in", rid="old")))
        for day in (datetime(2026, 5, 1), datetime(2026, 6, 5), datetime(2026, 6, 6), datetime(2026, 7, 5)):
            s.bulk_import(samples(spark, 1, start=day))
        s.bulk_import(samples(spark, 1, rid="old", start=datetime(2026, 5, 1)))
        (Path(str(tmp_path)) / "data" / "stray").mkdir()
        assert s.sweep() == 2
        assert sorted(r["p"] for r in s.samples().collect()) == ["2026-06-06", "2026-07-05"]
        assert [r["metric_key"] for r in s.metrics().collect()] == ["snmp/1:in"]
        assert (Path(str(tmp_path)) / "data" / "stray").exists()


def test_sharded_layout(spark, tmp_path):
    rid = "snmp:0/a b"
    encoded = spark.range(1).select(F.concat(encode_element(F.lit("snmp:0")), F.lit("/"), encode_element(F.lit("a b")))).first()[0]
    rows = spark.createDataFrame([(1_000_000, "in", 1.0), (2_000_000, "in", 2.0)], "time bigint, name string, value double")
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/data/{encoded}/p=1970-01-01")
    got = read_sharded_layout(spark, f"file://{tmp_path}", metrics(spark, "in", rid=rid)).orderBy("time").collect()
    assert [(r["resource_id"], r["p"], r["value"]) for r in got] == [(rid, "1970-01-01", 1.0), (rid, "1970-01-01", 2.0)]
    assert got[0]["time"] == datetime(1970, 1, 1, 0, 0, 1)


def test_a_partition_with_a_damaged_page_stays_and_others_are_compacted(spark, store):
    for i in range(2):
        store.store(samples(spark, 2000, rid=f"snmp/{i}"))
        store.flush()
    damaged = files(store)[0]
    raw = bytearray(damaged.read_bytes())
    raw[4:60] = bytes(255 - x for x in raw[4:60])
    damaged.write_bytes(raw)
    (damaged.parent / f".{damaged.name}.crc").unlink(missing_ok=True)
    spark.read.parquet(f"file://{damaged}").schema  # noqa: B018  the footer is whole
    for _ in range(2):
        store.bulk_import(samples(spark, 5, start=T0 + timedelta(days=3)))
    assert store.compact() == 1
    assert store.counters["compaction_failures"] == 1
    assert len(files(store)) == 3 and damaged.read_bytes() == bytes(raw)
    assert not list(damaged.parent.parent.parent.glob(".stage-*"))


def test_rows_of_another_partition_duration_are_found(spark, tmp_path):
    config = StoreConfig(base_dir=f"file://{tmp_path}")
    with SampleStore(spark, config) as s:
        s.upsert(metrics(spark, "in"))
        s.bulk_import(samples(spark, 3))
    request = FetchRequest("snmp/1:in", T0 - timedelta(hours=1), T0 + timedelta(hours=1))
    for duration in ("PT1H", "P30D", "PT15M"):
        with SampleStore(spark, config.with_text(partition=duration)) as s:
            before = s.fetch(request).count()
            s.bulk_import(samples(spark, 2, start=T0 + timedelta(minutes=20)))
            assert s.fetch(request).count() == before + 2
            plan = s.fetch(request)._jdf.queryExecution().toString()
            assert "PartitionFilters: [isnotnull(p" in plan
    assert before == 7


def test_two_streams_into_one_store(spark, store, tmp_path):
    for name in ("a", "b", "a"):
        source = f"file://{tmp_path}/source-{name}"
        samples(spark, 2, rid=f"snmp/{name}").write.mode("append").parquet(source)
        schema = samples(spark, 1).schema
        ingest(read_stream(spark, source, schema), store, f"file://{tmp_path}/state-{name}").awaitTermination()
    assert sorted((r["resource_id"], r["count"]) for r in store.samples().groupBy("resource_id").count().collect()) == [("snmp/a", 4), ("snmp/b", 2)]


@pytest.mark.parametrize("step", ["move", "write_text"])
def test_a_batch_that_breaks_off_is_stored_once(spark, store, monkeypatch, step):
    rows = samples(spark, 3).unionByName(samples(spark, 3, start=T0 + timedelta(days=1)))
    whole, seen = getattr(Files, step), []

    def breaks(self, *a):
        seen.append(a)
        if len(seen) == (4 if step == "move" else 2):  # in the middle of publishing, and before the marker
            raise OSError("lost")
        return whole(self, *a)

    monkeypatch.setattr(Files, step, breaks)
    with pytest.raises(OSError, match="lost"):
        store.import_batch(rows, "s", 0)
    monkeypatch.undo()
    store.import_batch(rows, "s", 0)
    store.import_batch(rows, "s", 0)
    assert store.samples().count() == 6
    store.import_batch(rows, "t", 0)
    assert store.samples().count() == 12


def test_only_full_buckets_are_written(spark, store):
    store.store(samples(spark, 4, rid="few"))
    store.store(samples(spark, 6, rid="many"))
    assert store.samples().count() == 0
    store.store(samples(spark, 6, rid="many", start=T0 + timedelta(seconds=50)))
    assert {r["resource_id"] for r in store.samples().collect()} == {"many"} and store.samples().count() == 12
    store.store(samples(spark, 3, rid="few"))
    assert store.samples().count() == 12
    store.drain("few", "2026-07-06")
    assert store.samples().count() == 19
    store.flush()
    assert store.samples().count() == 19
    assert not list(Path(store.config.base_dir.removeprefix("file://")).glob(".buffer-*"))


def test_a_failing_flush_keeps_its_rows(spark, store, monkeypatch):
    store.store(samples(spark, 3))
    monkeypatch.setattr(SampleStore, "bulk_import", lambda *a: (_ for _ in ()).throw(OSError("disk full")))
    with pytest.raises(OSError):
        store.flush()
    monkeypatch.undo()
    store.flush()
    assert store.samples().count() == 3


def test_a_sample_without_resource_buffers_nothing(spark, store):
    with pytest.raises(Exception, match="resourceId"):
        store.store(samples(spark, 1).withColumn("resource_id", F.lit(None).cast("string")))
    store.flush()
    assert store.samples().count() == 0


def test_a_tombstone_added_while_compacting_stays(spark, store, monkeypatch):
    store.upsert(metrics(spark, "in", "out"))
    store.bulk_import(samples(spark, 3).unionByName(samples(spark, 3, "out")))
    store.delete("snmp/1:out")
    rewrite = SampleStore._rewrite

    def meanwhile(self, *a):
        rewrite(self, *a)
        self.delete("snmp/1:in")

    monkeypatch.setattr(SampleStore, "_rewrite", meanwhile)
    assert store.compact() == 1
    monkeypatch.undo()
    assert {r["name"] for r in store.samples().collect()} == {"in"}
    assert store.compact() == 1
    assert store.samples().count() == 0


def test_tombstones_stay_while_a_file_of_theirs_is_unreadable(spark, store):
    store.upsert(metrics(spark, "in"))
    store.bulk_import(samples(spark, 3))
    store.delete("snmp/1:in")
    (files(store)[0].parent / "part-corrupt.parquet").write_text("not parquet")
    assert store.compact() == 1
    assert store.files.list(f"{store.config.base_dir}/tombstones")


def test_a_store_that_another_session_maintains(spark, tmp_path):
    config = StoreConfig(base_dir=f"file://{tmp_path}")
    with SampleStore(spark, config) as one, SampleStore(spark, config) as two:
        for _ in range(2):
            one.bulk_import(samples(spark, 3))
        with one._lease() as mine:
            assert mine
            (tmp_path / ".stage-compact-live").mkdir()
            assert two.compact() == 0 and two.sweep() == 0
            with SampleStore(spark, config):
                assert (tmp_path / ".stage-compact-live").exists()
        assert two.compact() == 1
        with SampleStore(spark, config):
            assert not (tmp_path / ".stage-compact-live").exists()
        (tmp_path / "lease.json").write_text('{"owner": "gone", "until": 0}')
        one.bulk_import(samples(spark, 3))
        assert two.compact() == 1 and one.samples().count() == 9


def test_pruning_does_not_wait_for_a_partition_to_expire(spark, tmp_path):
    with SampleStore(spark, StoreConfig(base_dir=f"file://{tmp_path}"), now=lambda: T0) as s:
        s.upsert(metrics(spark, "in").unionByName(metrics(spark, "in", rid="never stored")))
        s.store(samples(spark, 1))
        assert s.sweep() == 0
        assert [r["metric_key"] for r in s.metrics().collect()] == ["snmp/1:in"]


def test_timed_maintenance(spark, tmp_path):
    clock = [T0]
    config = StoreConfig(base_dir=f"file://{tmp_path}").with_text(flush="PT60S", compaction="PT1H", sweep="P1D", retention="P30D")
    with SampleStore(spark, config, now=lambda: clock[0]) as s:
        timers = Timers(s)
        assert timers.tick() == []
        s.store(samples(spark, 2))
        clock[0] += timedelta(seconds=61)
        assert timers.tick() == ["flush"] and s.samples().count() == 2
        s.bulk_import(samples(spark, 2))
        clock[0] += timedelta(hours=1)
        assert timers.tick() == ["compact"] and len(files(s)) == 1
        clock[0] += timedelta(days=40)
        assert sorted(timers.tick()) == ["compact", "sweep"] and s.samples().count() == 0
        with timers.running(0.05):
            clock[0] += timedelta(days=1)
            for _ in range(200):
                if s.counters["sweeps"] > 1:
                    break
                time.sleep(0.1)
        assert s.counters["sweeps"] > 1
