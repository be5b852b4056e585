"""The driver's tables as samples, a catalog and round-robin archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidestore.operators.catalog import to_metrics


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series a user and event type."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("events/user/"), F.col("user_id").cast("string")).alias("resource_id"), F.col("event_type").alias("name"), F.col("ts").cast("timestamp_ntz").alias("time"), "value")


def line_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series a supplier and return flag, with equal times."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("lineitem/supplier/"), F.col("l_suppkey").cast("string")).alias("resource_id"), F.concat(F.lit("qty_"), F.col("l_returnflag")).alias("name"), F.col("l_shipdate").cast("timestamp_ntz").alias("time"), F.col("l_quantity").alias("value"))


def event_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag rows of the event series. Every seventh user has no host; some metrics have a keyless tag."""
    series = table(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    user = F.col("user_id").cast("string")
    tag = lambda kind, key, value: F.struct(F.lit(kind).alias("tag_type"), F.lit(key).cast("string").alias("tag_key"), value.alias("tag_value"))
    tags = F.array_compact(
        F.array(
            tag("intrinsic", "name", F.col("event_type")),
            tag("intrinsic", "resourceId", F.concat(F.lit("events/user/"), user)),
            tag("meta", "mtype", F.when(F.col("event_type").isin("purchase", "signup"), "count").otherwise("gauge")),
            F.when(F.col("user_id") % 7 != 0, tag("meta", "host", F.concat(F.lit("myHost"), (F.col("user_id") % 10).cast("string")))),
            F.when(F.col("user_id") % 5 == 0, tag("meta", None, F.lit("keyless"))),
            tag("external", "band", F.concat(F.lit("band-"), (F.col("user_id") % 3).cast("string"))),
        )
    )
    key = F.concat(F.lit("name="), F.col("event_type"), F.lit(",resourceId=events/user/"), user)
    return series.select(key.alias("metric_key"), F.explode(tags).alias("t")).select("metric_key", "t.*")


def event_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_metrics(event_tags(spark, sf_dir))


def dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives built by rule, one a supplier: a gauge and a counter at two resolutions and a third that collides.

    A cell is a whole number from its file, archive, row and source, and unknown now and then.
    """
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file"))
    nan, step = F.lit(float("nan")), 300

    def cell(arch: int, i, d: int):
        x = (F.col("file") * 31 + arch * 17 + i.cast("bigint") * 7 + d * 5) % 101
        return F.when(x % 13 == 0, nan).otherwise(x.cast("double"))

    def archive(no: int, cf: str, k: int, n: int):
        rows = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array(cell(no, i, 0), cell(no, i, 1)))
        return F.struct(F.lit(cf).alias("cf"), F.lit(k).cast("bigint").alias("k"), F.lit(0.5).alias("xff"), rows.alias("rows"))

    def source(name: str, kind: str, last):
        none = F.lit(None).cast("double")
        return F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), F.lit(600).cast("bigint").alias("heartbeat"), none.alias("min"), none.alias("max"), last.alias("last_ds"), F.lit(0.0).alias("value"), F.lit(0).cast("bigint").alias("unknown_sec"), F.lit(None).cast("string").alias("cdef"))

    dump = F.struct(
        F.lit("0003").alias("version"),
        F.lit(step).cast("bigint").alias("step"),
        (F.lit(1_700_000_000) + F.col("file") * 77).cast("bigint").alias("lastupdate"),
        F.array(source("load", "GAUGE", F.lit(1.0)), source("octets", "COUNTER", (F.col("file") * 1_000_003 % 9_000_000).cast("double"))).alias("ds"),
        F.array(archive(0, "MAX", 1, 20), archive(1, "AVERAGE", 1, 12), archive(2, "AVERAGE", 4, 15), archive(3, "AVERAGE", 12, 10), archive(4, "MIN", 4, 8)).alias("rra"),
    )
    return s.select("file", dump.alias("dump"))
