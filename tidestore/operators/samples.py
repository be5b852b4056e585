"""Reading series: open time ranges of one or many metrics in a single plan."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidestore.functions.paths import DAY_US, partition_label, partition_start, python_label, window_of
from tidestore.model import MINUTE_US, TagMatcher
from tidestore.operators.catalog import series
from tidestore.operators.matchers import find_metrics


#: The partition durations that stored rows may have; without any, nothing is pruned.
Durations = int | Iterable[int] | None


def check_aggregation(aggregation: str) -> None:
    if aggregation != "NONE":
        raise ValueError(f"aggregation {aggregation!r} isn't supported")


def in_range(start: datetime, end: datetime, time: str = "time") -> Column:
    """Strictly between two instants: neither bound belongs to the range."""
    return (F.col(time) > F.lit(start).cast("timestamp_ntz")) & (F.col(time) < F.lit(end).cast("timestamp_ntz"))


def in_partitions(start: datetime, end: datetime, *partition_us: int) -> Column:
    """Bounds of the partition column that a time range implies, for pruning, whichever of the durations a partition has.

    A shorter label is the beginning of a longer one of the same instant, and so sorts before it. Hence the day of the earliest
    window that holds the start is a lower bound for labels of all durations, and the end to the minute an upper one.
    """
    first = min(window_of(start, us) for us in partition_us)
    return F.col("p").between(python_label(first, DAY_US), python_label(end, MINUTE_US))


def read_series(samples: DataFrame, resource_id: str, name: str, start: datetime, end: datetime, partition_us: Durations = ()) -> DataFrame:
    """time, value of one series, by time. Equal times all stay."""
    rows = samples.where((F.col("resource_id") == resource_id) & (F.col("name") == name) & in_range(start, end))
    return _pruned(rows, start, end, partition_us).select("time", "value").orderBy("time", "value")


def fetch(samples: DataFrame, metrics: DataFrame, metric_key: str, start: datetime, end: datetime, aggregation: str = "NONE", partition_us: Durations = ()) -> DataFrame:
    """time, value of a catalogued metric, by time; empty if the catalog doesn't have it (any more)."""
    check_aggregation(aggregation)
    wanted = metrics.where(F.col("metric_key") == metric_key)
    return _of(samples, wanted, start, end, partition_us).select("time", "value").orderBy("time", "value")


def fetch_many(samples: DataFrame, metrics: DataFrame, matchers: Sequence[TagMatcher], start: datetime, end: datetime, aggregation: str = "NONE", partition_us: Durations = ()) -> DataFrame:
    """metric_key, resource_id, name, time, value of all metrics that the matchers select, in one plan.

    The catalog side is small only if the matchers are selective, so how to join is left to the
    optimizer's size estimate.
    """
    check_aggregation(aggregation)
    return _of(samples, find_metrics(metrics, matchers), start, end, partition_us)


def _pruned(rows: DataFrame, start: datetime, end: datetime, partition_us: Durations) -> DataFrame:
    durations = [partition_us] if isinstance(partition_us, int) else [*(partition_us or ())]
    return rows.where(in_partitions(start, end, *durations)) if durations and "p" in rows.columns else rows


def _of(samples: DataFrame, wanted: DataFrame, start: datetime, end: datetime, partition_us: Durations) -> DataFrame:
    rows = _pruned(samples.where(in_range(start, end)), start, end, partition_us)
    keys = series(wanted).where("resource_id is not null")
    return rows.join(keys, ["resource_id", "name"]).select("metric_key", "resource_id", "name", "time", "value")


def with_metric(points: DataFrame, metric: DataFrame) -> DataFrame:
    """Data points as samples of one metric (a frame of one row)."""
    return points.crossJoin(F.broadcast(metric.limit(1)))


def live_only(samples: DataFrame, live: DataFrame) -> DataFrame:
    """The samples of series that ``live`` (resource_id, name) has."""
    return samples.join(live.select("resource_id", "name").distinct(), ["resource_id", "name"], "left_semi")


def expired(name: Column | str, partition_us: int, cutoff: datetime) -> Column:
    """Whether the window of a ``p=`` name ended at or before the cutoff; null if the name isn't one."""
    return partition_start(name) + F.make_dt_interval(secs=F.lit(partition_us / 1_000_000)) <= F.lit(cutoff).cast("timestamp_ntz")


def flush_batches(samples: DataFrame, partition_us: int, rows: int, order: str = "time") -> DataFrame:
    """The file, numbered from 0 in each bucket, that buffering would put each sample in.

    A bucket is one resource's partition and is written at ``rows`` samples; ``order`` is the order of arrival.
    """
    bucket = samples.withColumn("p", partition_label("time", partition_us))
    w = Window.partitionBy("resource_id", "p").orderBy(order, "name", "value")
    return bucket.withColumn("batch", F.floor((F.row_number().over(w) - 1) / rows).cast("long"))


def bucket_counts(samples: DataFrame, partition_us: int) -> DataFrame:
    """resource_id, p, n: what one bulk write puts in each partition."""
    return samples.groupBy("resource_id", partition_label("time", partition_us).alias("p")).agg(F.count("*").alias("n"))
