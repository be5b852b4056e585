"""A store of samples: Parquet partitioned by time label, a versioned catalog, and tombstones.

Layout under ``base_dir``::

    data/p=<label>/part-*.parquet     resource_id, name, time, value
    catalog/v=<n>/part-*.parquet      tag rows; the newest complete version counts
    tombstones/part-*.parquet         deleted series whose rows are still to be purged
    durations/<microseconds>          the partition durations that have been in use
    journals/<id>.json                files that are staged and will be published, and what they replace
    batches/<stream>/<n>              batches of streams that have been published
    .stage-<id>, .buffer-<id>         staged files, and rows that a session still buffers
    lease.json                        who maintains the store just now, and until when

Rows of a partition lie sorted by series and time, so that row groups can be skipped. Readers take only
``part-*.parquet`` and skip files that aren't readable. Every write is staged, named in a journal and then
moved in, so that what breaks off anywhere is either finished on the next ``open`` or leaves nothing behind.
"""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidestore.functions.paths import catalog_root, data_root, partition_label
from tidestore.model import CATALOG_TAGS, METRICS, STORED_SAMPLES, FetchRequest, StorageError, StoreConfig, TagMatcher
from tidestore.operators import catalog as cat
from tidestore.operators import samples as ops
from tidestore.operators.matchers import find_metrics
from tidestore.sources.files import Files

TOMBSTONES = "resource_id string, name string"
SAMPLE_COLUMNS = ("resource_id", "name", "time", "value")


LEASE_SECONDS = 120
#: Rows that a broadcast side may have; beyond it Spark shuffles.
SMALL_ROWS = 100_000


def _rows_of(seen: Observation) -> int:
    """The observed count. A plan that Spark finds to be empty is not run and measures nothing."""
    try:
        return seen.get["n"]
    except Py4JJavaError:
        return 0


class RewriteError(RuntimeError):
    """Partitions couldn't be read or staged; nothing has been changed."""


class SampleStore:
    """Use as a context manager, or ``open`` and ``close``. Its methods may be called from several threads."""

    def __init__(self, spark: SparkSession, config: StoreConfig, now=None) -> None:
        self.spark, self.config = spark, config
        self.files = Files(spark)
        self.counters: Counter = Counter()
        self.compaction_seconds: list[float] = []
        self._now = now or (lambda: datetime.now(timezone.utc).replace(tzinfo=None))
        self._open = False
        self._session = uuid.uuid4().hex
        self._lock = threading.RLock()
        self._durations: list[int] = []
        self._reads: list[Observation] = []
        self._clear()

    def _clear(self) -> None:
        self._buffer: list[DataFrame] = []
        self._counts: DataFrame | None = None
        self._since: datetime | None = None
        self._held = 0

    # -- life cycle

    def open(self) -> SampleStore:
        if not self.config.base_dir.strip():
            raise StorageError("base_dir isn't set")
        try:
            for d in (data_root(self.config.base_dir), catalog_root(self.config.base_dir)):
                self.files.make(d)
        except Exception as e:
            raise StorageError(f"base_dir {self.config.base_dir!r} can't be used: {e}") from e
        self._open = True
        self._know_duration()
        with self._lease() as mine:
            if mine:
                self._recover()
        return self

    def _know_duration(self) -> None:
        """Partitions may have been written with other durations than the present one; readers must know them all."""
        folder = f"{self.config.base_dir}/durations"
        self.files.make(folder)
        if not self.files.exists(f"{folder}/{self.config.partition_us}"):
            self.files.claim(f"{folder}/{self.config.partition_us}", "")
        self._durations = sorted(int(e.name) for e in self.files.list(folder) if e.name.isdigit())

    @contextmanager
    def _lease(self) -> Iterator[bool]:
        """Whether this session may maintain the store. A lease that its holder has stopped renewing runs out."""
        path = f"{self.config.base_dir}/lease.json"
        with self._lock:
            text = lambda: json.dumps({"owner": self._session, "until": time.time() + LEASE_SECONDS})
            mine = self.files.claim(path, text())
            if not mine:
                try:
                    held = json.loads(self.files.read_text(path))
                except Exception:  # it has just gone, or is being written
                    held = {"until": time.time() + LEASE_SECONDS}
                if held["until"] < time.time():
                    self.files.delete(path)
                    mine = self.files.claim(path, text())
            if not mine:
                yield False
                return
            ended = threading.Event()

            def renew() -> None:
                while not ended.wait(LEASE_SECONDS / 4):
                    self.files.write_text(path, text())

            renewing = threading.Thread(target=renew, daemon=True)
            renewing.start()
            try:
                yield True
            finally:
                ended.set()
                renewing.join()
                self.files.delete(path)

    def close(self) -> None:
        if self._open:
            self.flush()
            self._open = False

    def __enter__(self) -> SampleStore:
        return self.open()

    def __exit__(self, *exc: object) -> None:
        self.close()

    def _need_open(self) -> None:
        if not self._open:
            raise StorageError("the store isn't open")

    @property
    def data(self) -> str:
        return data_root(self.config.base_dir)

    # -- catalog

    def _versions(self) -> list[int]:
        found = self.files.list(catalog_root(self.config.base_dir))
        return sorted(int(e.name[2:]) for e in found if e.is_dir and e.name.startswith("v=") and e.name[2:].isdigit() and self.files.exists(f"{e.path}/_SUCCESS"))

    def tags(self) -> DataFrame:
        """Tag rows of the newest complete version; none without one."""
        self._need_open()
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], CATALOG_TAGS)
        return self.spark.read.schema(CATALOG_TAGS).parquet(f"{catalog_root(self.config.base_dir)}/v={versions[-1]}")

    def metrics(self) -> DataFrame:
        return cat.to_metrics(self.tags())

    def get(self, metric_key: str) -> DataFrame:
        return self.metrics().where(F.col("metric_key") == metric_key)

    def replace_catalog(self, metrics: DataFrame) -> None:
        """A new version beside the old one; the one before stays for readers that have begun on it."""
        self._need_open()
        versions = self._versions()
        root, n = catalog_root(self.config.base_dir), (versions[-1] if versions else 0) + 1
        cat.to_tags(metrics).write.mode("overwrite").option("compression", "uncompressed").parquet(f"{root}/v={n}")
        for old in versions[:-1]:
            self.files.delete(f"{root}/v={old}")

    def upsert(self, metrics: DataFrame) -> int:
        """Put metrics (with a ``seq`` that orders equal keys); returns how many were new or changed, and writes only then."""
        old = self.metrics()
        new = cat.upsert(old, metrics)
        changed = cat.diff(old, new).count()
        if changed:
            self.replace_catalog(new)
        return changed

    def find(self, matchers: Sequence[TagMatcher]) -> DataFrame:
        self._need_open()
        return find_metrics(self.metrics(), matchers)

    def delete(self, metric_key: str) -> None:
        """Hide a metric at once; its rows go with the next compaction, even after a restart."""
        self._need_open()
        metrics = self.metrics()
        gone = metrics.where(F.col("metric_key") == metric_key)
        if gone.isEmpty():
            return
        cat.series(gone).where("resource_id is not null").select("resource_id", "name").write.mode("append").parquet(f"{self.config.base_dir}/tombstones")
        self.replace_catalog(metrics.where(F.col("metric_key") != metric_key))

    # -- writing

    def store(self, samples: DataFrame, metrics: DataFrame | None = None) -> None:
        """Catalog the metrics and buffer the samples.

        A bucket, one resource's partition, is written once it holds ``flush_rows``; the others stay. All is written
        once the oldest rows have been held for ``flush_us``. Buffered rows are in files of the store's file system,
        computed once; each call counts only its own rows.
        """
        self._need_open()
        if samples is None:
            raise TypeError("samples are missing")
        with self._lock:
            rows = self._hold(self._checked(samples))
            if metrics is not None:
                self.upsert(metrics)
            self._buffer.append(rows)
            self._since = self._since or self._now()
            new = ops.bucket_counts(rows, self.config.partition_us)
            both = new if self._counts is None else self._counts.unionByName(new).groupBy("resource_id", "p").agg(F.sum("n").alias("n"))
            self._counts = self._hold(both)
            full = self._counts.where(F.col("n") >= self.config.flush_rows).select("resource_id", "p")
            if not full.isEmpty():
                self.flush(full)
            self.flush_due()

    def _hold(self, rows: DataFrame) -> DataFrame:
        self._held += 1
        path = f"{self.config.base_dir}/.buffer-{self._session}/{self._held}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _buffered(self) -> DataFrame:
        rows = self._buffer[0]
        for more in self._buffer[1:]:
            rows = rows.unionByName(more)
        return rows

    def flush_due(self) -> bool:
        """Write all that is buffered if the oldest of it has waited for ``flush_us``."""
        with self._lock:
            due = self._since is not None and self._now() - self._since >= timedelta(microseconds=self.config.flush_us)
            if due:
                self.flush()
            return due

    def flush(self, buckets: DataFrame | None = None) -> None:
        """Write what is buffered, or only the given buckets (resource_id, p). A failing write keeps the buffer."""
        with self._lock:
            if not self._open or not self._buffer:
                return
            rows, folder = self._buffered(), f"{self.config.base_dir}/.buffer-{self._session}"
            if buckets is None:
                self.bulk_import(rows)
                self._clear()
                self.files.delete(folder)
                return
            key = ["resource_id", "p"]
            labelled = rows.withColumn("p", partition_label("time", self.config.partition_us))
            rest = self._hold(labelled.join(buckets, key, "left_anti").select(*rows.columns))
            counts = self._hold(self._counts.join(buckets, key, "left_anti"))
            self.bulk_import(labelled.join(buckets, key, "left_semi").select(*rows.columns))
            self._buffer, self._counts = [rest], counts
            if counts.isEmpty():
                self._clear()
                self.files.delete(folder)

    def drain(self, resource_id: str, p: str) -> None:
        """Write one bucket's buffered rows."""
        if self._buffer:
            self.flush(self._counts.where((F.col("resource_id") == resource_id) & (F.col("p") == p)).select("resource_id", "p"))

    def bulk_import(self, samples: DataFrame) -> int:
        """Write samples past the buffer; returns the files written."""
        return self._import(samples, f"import-{uuid.uuid4().hex}", None)

    def import_batch(self, samples: DataFrame, stream: str, number: int) -> int:
        """Write a batch of a stream exactly once, however often it is tried; returns the files this try has published."""
        self._need_open()
        marker = f"{self.config.base_dir}/batches/{stream}/{number}"
        if self.files.exists(marker):
            return 0
        self.files.make(f"{self.config.base_dir}/batches/{stream}")
        return self._import(samples, f"batch-{stream}-{number}", marker)

    def _import(self, samples: DataFrame, job: str, marker: str | None) -> int:
        self._need_open()
        journal, staging = f"{self.config.base_dir}/journals/{job}.json", f"{self.config.base_dir}/.stage-{job}"
        if not self.files.exists(journal):
            self.files.delete(staging)  # of a try that broke off
            written = self._write(self._checked(samples), staging)
            self._journal(journal, {"staging": staging, "inputs": {}, "marker": marker})
            self.counters["samples_written"] += written
        files, created = self._publish(journal)
        self.counters["partitions_created"] += created
        return files

    def _journal(self, path: str, plan: dict) -> None:
        self.files.make(f"{self.config.base_dir}/journals")
        self.files.write_text(path, json.dumps(plan))

    def _checked(self, samples: DataFrame) -> DataFrame:
        """The stored columns; a row without a resource, or with an empty one, is an error before anything is written."""
        missing = F.col("resource_id").isNull() | (F.col("resource_id") == "")
        resource = F.when(missing, F.raise_error(F.lit("sample without resourceId")).cast("string")).otherwise(F.col("resource_id"))
        return samples.select(resource.alias("resource_id"), F.coalesce("name", F.lit("")).alias("name"), F.col("time").cast("timestamp_ntz").alias("time"), F.col("value").cast("double").alias("value"))

    def _write(self, rows: DataFrame, path: str) -> int:
        seen = Observation()
        labelled = rows.withColumn("p", partition_label("time", self.config.partition_us)).observe(seen, F.count(F.lit(1)).alias("n"))
        self._lay(labelled, path)
        return _rows_of(seen)

    def _lay(self, rows: DataFrame, path: str) -> None:
        """One file a partition where it is small; Spark parts large ones over tasks by size and puts small ones together."""
        laid = rows.hint("rebalance", "p").sortWithinPartitions("p", "resource_id", "name", "time")
        laid.write.mode("append").partitionBy("p").option("compression", self.config.compression).parquet(path)

    # -- reading

    def samples(self, paths: list[str] | None = None, whole: bool = False) -> DataFrame:
        """All stored rows with their partition label ``p``; what can't be read is left out, or an error if ``whole``."""
        self._need_open()
        if not paths and not any(e.name.startswith("p=") for e in self.files.list(self.data)):
            return self.spark.createDataFrame([], STORED_SAMPLES)
        reader = self.spark.read.schema(STORED_SAMPLES).option("basePath", self.data).option("pathGlobFilter", "part-*.parquet")
        reader = reader.option("ignoreCorruptFiles", str(not whole).lower())
        if whole:
            reader = reader.option("ignoreMissingFiles", "false")
        return reader.parquet(*(paths or [self.data]))

    def fetch(self, request: FetchRequest) -> DataFrame:
        """time, value of one catalogued metric, by time."""
        return self._counted(ops.fetch)(self.samples(), self.metrics(), request.metric_key, request.start, request.end, request.aggregation, self._durations)

    def fetch_many(self, matchers: Sequence[TagMatcher], start: datetime, end: datetime) -> DataFrame:
        return self._counted(ops.fetch_many)(self.samples(), self.metrics(), matchers, start, end, partition_us=self._durations)

    def _counted(self, read: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        """The rows of a read count as ``samples_read`` the first time that the returned frame runs."""

        def run(*args: object, **named: object) -> DataFrame:
            seen = Observation()
            self._reads.append(seen)
            return read(*args, **named).observe(seen, F.count(F.lit(1)).alias("n"))

        return run

    def _count_reads(self) -> None:
        open_ = []
        for seen in self._reads:
            if seen._jo is not None and seen._jo.future().isCompleted():
                self.counters["samples_read"] += _rows_of(seen)
            else:
                open_.append(seen)
        self._reads = open_

    def samples_of(self, request: FetchRequest) -> DataFrame:
        """Samples with their metric's tags: the points joined to the one metric."""
        return ops.with_metric(self.fetch(request), self.get(request.metric_key))

    # -- maintenance

    def _partitions(self) -> dict[str, list]:
        return {e.name: [f for f in self.files.list(e.path) if f.name.startswith("part-") and f.name.endswith(".parquet") and not f.is_dir] for e in self.files.list(self.data) if e.is_dir and e.name.startswith("p=")}

    def _unreadable(self, paths: list[str]) -> set[str]:
        """Those of the files that have no readable footer, found by one job."""
        if not paths:
            return set()
        seen = self.samples(paths).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count("*")).select("f")
        good = {self._plain(r["f"]) for r in seen.collect()}
        return {p for p in paths if self._plain(p) not in good}

    @staticmethod
    def _plain(path: str) -> str:
        return re.sub("^[a-z0-9+.-]*:/*", "/", unquote(path), flags=re.I)

    def compact(self, min_files: int = 2) -> int:
        """Merge the files of partitions that have ``min_files`` and drop deleted series' rows; returns partitions changed.

        All partitions are rewritten by one job. The result is staged, named in a journal, moved in and
        only then the inputs go; ``open`` finishes a compaction that broke off after its journal was
        written. Empty files go; those without a readable footer are skipped and stay. If a read fails later,
        the partitions are tried in halves until those that fail stand alone; they stay as they are and count as
        ``compaction_failures``. Tombstones go once every partition that has rows of theirs has been rewritten; those
        that are added meanwhile stay. While another session maintains the store nothing is done.
        """
        self._need_open()
        if min_files < 2:
            raise ValueError("min_files must be 2 at least")
        began = datetime.now()
        with self._lease() as mine:
            if not mine:
                self.counters["compactions_skipped"] += 1
                return 0
            done = self._compact(min_files)
        self.counters["partitions_compacted"] += done
        self.compaction_seconds.append((datetime.now() - began) / timedelta(seconds=1))
        return done

    def _compact(self, min_files: int) -> int:
        buried = [e.path for e in self.files.list(f"{self.config.base_dir}/tombstones") if e.name.startswith("part-")]
        dead = self._tombstones(buried) if buried else None
        doomed = self._partitions_of(dead) if dead is not None else set()
        chosen: dict[str, list[str]] = {}
        for name, files in self._partitions().items():
            for f in files:
                if not f.size:
                    self.files.delete(f.path)
            full = [f.path for f in files if f.size]
            if full and (name[2:] in doomed or len(full) >= min_files):
                chosen[name] = full
        bad = self._unreadable([f for files in chosen.values() for f in files])
        good = {name: [f for f in files if f not in bad] for name, files in chosen.items()}
        inputs = {name: files for name, files in good.items() if len(files) >= (1 if name[2:] in doomed else min_files)}
        failed = self._rewrite_apart(inputs, dead)
        self.counters["compaction_failures"] += len(failed)
        purged = not any(name[2:] in doomed and (name in failed or bad & set(files)) for name, files in chosen.items())
        for path in buried if purged else []:
            self.files.delete(path)
        return len(inputs) - len(failed)

    def _rewrite_apart(self, inputs: dict[str, list[str]], dead: DataFrame | None) -> list[str]:
        """Rewrite partitions, in halves where that fails; returns those that fail alone."""
        if not inputs:
            return []
        try:
            self._rewrite(inputs, dead)
            return []
        except RewriteError as e:
            if self.spark.sparkContext._jsc.sc().isStopped():
                raise
            names = sorted(inputs)
            if len(names) == 1:
                print(f"compaction of {names[0]}: {e}")
                return names
            half = len(names) // 2
            return [x for part in (names[:half], names[half:]) for x in self._rewrite_apart({n: inputs[n] for n in part}, dead)]

    def _tombstones(self, paths: list[str]) -> DataFrame | None:
        """Deleted series that haven't been stored and catalogued again since; none without any."""
        dead = self.spark.read.schema(TOMBSTONES).parquet(*paths).distinct().join(cat.live_series(self.metrics()), ["resource_id", "name"], "left_anti")
        few = dead.limit(SMALL_ROWS + 1).count()
        return None if not few else F.broadcast(dead) if few <= SMALL_ROWS else dead

    def _partitions_of(self, dead: DataFrame) -> set[str]:
        """Labels of the partitions with rows of deleted series. Their least and largest ids let row groups be skipped."""
        lo, hi = dead.agg(F.min("resource_id"), F.max("resource_id")).first()
        rows = self.samples().where(F.col("resource_id").between(lo, hi))
        return {r["p"] for r in rows.join(dead, ["resource_id", "name"], "left_semi").select("p").distinct().collect()}

    def _rewrite(self, inputs: dict[str, list[str]], dead: DataFrame | None) -> None:
        job = f"compact-{uuid.uuid4().hex}"
        staging = f"{self.config.base_dir}/.stage-{job}"
        rows = self.samples([f for files in inputs.values() for f in files], whole=True)
        if dead is not None:
            rows = rows.join(dead, ["resource_id", "name"], "left_anti")
        try:
            self._lay(rows.select(*SAMPLE_COLUMNS, "p"), staging)
        except Exception as e:
            self.files.delete(staging)
            raise RewriteError(str(e).splitlines()[0][:200]) from e
        journal = f"{self.config.base_dir}/journals/{job}.json"
        self._journal(journal, {"staging": staging, "inputs": inputs, "marker": None})
        self._publish(journal)

    def _publish(self, journal: str) -> tuple[int, int]:
        """Move staged files in, then delete their inputs; can be run again after breaking off anywhere. Files moved, partitions new."""
        plan, moved, created = json.loads(self.files.read_text(journal)), 0, 0
        for p in self.files.list(plan["staging"]):
            parts = [f for f in self.files.list(p.path) if f.name.startswith("part-")] if p.is_dir else []
            if parts and not self.files.exists(f"{self.data}/{p.name}"):
                self.files.make(f"{self.data}/{p.name}")
                created += 1
            for f in parts:
                self.files.move(f.path, f"{self.data}/{p.name}/{f.name}")
                moved += 1
        for files in plan["inputs"].values():
            for f in files:
                self.files.delete(f)
        if plan["marker"]:
            self.files.write_text(plan["marker"], "")
        self.files.delete(plan["staging"])
        self.files.delete(journal)
        return moved, created

    def _recover(self) -> None:
        """Finish what sessions that are gone have left. Imports hold no lease, so theirs are left alone while they are young."""
        old = time.time() * 1000 - 1000 * LEASE_SECONDS
        mine = lambda e: self._session in e.name
        for e in self.files.list(f"{self.config.base_dir}/journals"):
            if e.name.endswith(".json") and (e.name.startswith("compact-") or e.modified < old):
                self._publish(e.path)
        for e in self.files.list(self.config.base_dir):
            stale = e.modified < old and not self.files.exists(f"{self.config.base_dir}/journals/{e.name[7:]}.json")
            if e.is_dir and e.name.startswith(".stage-") and (e.name.startswith(".stage-compact-") or (stale and self._ages(e) < old)):
                self.files.delete(e.path)
            if e.is_dir and e.name.startswith(".buffer-") and not mine(e) and e.modified < time.time() * 1000 - 2 * self.config.sweep_us / 1000:
                self.files.delete(e.path)

    def _ages(self, folder) -> int:  # noqa: ANN001
        """When anything in a folder was last changed."""
        inside = self.files.list(folder.path)
        return max([folder.modified, *(self._ages(e) if e.is_dir else e.modified for e in inside)])

    def sweep(self) -> int:
        """Delete partitions that ended before the retention's cutoff, and prune the catalog; returns partitions deleted.

        A partition ends after the longest duration that has been in use. The catalog is pruned whether or not one went.
        """
        self._need_open()
        with self._lease() as mine:
            if not mine:
                self.counters["sweeps_skipped"] += 1
                return 0
            return self._sweep()

    def _sweep(self) -> int:
        names = [(n,) for n in self._partitions()]
        cutoff = self._now() - timedelta(microseconds=self.config.retention_us)
        ended = ops.expired(F.col("name"), max(self._durations), cutoff)
        gone = [r["name"] for r in self.spark.createDataFrame(names, "name string").where(ended).collect()] if names else []
        for name in gone:
            self.files.delete(f"{self.data}/{name}")
        for e in self.files.list(self.data):
            if e.is_dir and e.name.startswith("p=") and not self.files.list(e.path):
                self.files.delete(e.path)
        if self.config.prune_catalog and self._versions():
            with_data = self.samples().select("resource_id")
            for rows in self._buffer:
                with_data = with_data.unionByName(rows.select("resource_id"))
            old = self.metrics()
            kept = cat.prune(old, with_data.distinct())
            if not cat.diff(old, kept).isEmpty():
                self.replace_catalog(kept.select(*METRICS.names))
        self.counters["partitions_deleted"] += len(gone)
        return len(gone)

    def maintain(self) -> dict[str, int]:
        """Retention, then compaction, as one timed round does; a failing part is reported and the other still runs."""
        done: dict[str, int] = {}
        for name, run in (("deleted", self.sweep), ("compacted", self.compact if self.config.compact_on else None)):
            if run is None:
                continue
            try:
                done[name] = run()
            except StorageError:
                raise
            except Exception as e:
                self.counters[f"{name}_failures"] += 1
                print(f"maintenance: {name}: {e}")
        return done

    def stats(self) -> DataFrame:
        """measure, value: sizes of the store and the counters of this session."""
        self._need_open()
        self._count_reads()
        partitions = self._partitions()
        skipped = sum(not f.size for files in partitions.values() for f in files)
        skipped += len(self._unreadable([f.path for files in partitions.values() for f in files if f.size]))
        values = {
            "catalog_size": cat.to_metrics(self.tags()).count(),
            "partitions": len(partitions),
            "files": sum(map(len, partitions.values())),
            "bytes": sum(f.size for files in partitions.values() for f in files),
            "unreadable_files": skipped,
            "compactions": len(self.compaction_seconds),
            **{k: self.counters[k] for k in ("samples_written", "samples_read", "partitions_created", "partitions_compacted", "partitions_deleted", "compaction_failures")},
        }
        return self.spark.createDataFrame([(k, int(v)) for k, v in values.items()], "measure string, value long")

    def export_stats(self, path: str) -> None:
        """Write the measures of ``stats``, one line each, to a file that a collector can read."""
        lines = [f"tidestore_{r['measure']} {r['value']}" for r in self.stats().collect()]
        self.files.write_text(path, "\n".join(lines) + "\n")


def read_sharded_layout(spark: SparkSession, base_dir: str, metrics: DataFrame) -> DataFrame:
    """Samples of a store that has one directory tree a resource: ``data/<encoded resource>/p=<label>/part-*``.

    Encoded paths aren't decoded but joined with the encoding of the catalog's resources. Files there have
    time (epoch microseconds), name and value.
    """
    from tidestore.functions.paths import from_micros, shard_path

    files = spark.read.schema("time bigint, name string, value double").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*.parquet").option("ignoreCorruptFiles", "true").parquet(data_root(base_dir))
    path = F.regexp_extract(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")), r"/data/(.*)/(p=[^/]*)/[^/]*$", 1)
    label = F.regexp_extract("_metadata.file_path", r"/(p=[^/]*)/[^/]*$", 1)
    rows = files.select(path.alias("_shard"), F.substring(label, 3, 64).alias("p"), "name", from_micros("time").alias("time"), "value")
    shards = cat.series(metrics).where("resource_id is not null").select("resource_id", shard_path("resource_id").alias("_shard")).distinct()
    return rows.join(shards, "_shard").select("resource_id", "name", "time", "value", "p")
