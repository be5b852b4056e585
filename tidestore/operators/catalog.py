"""The catalog: metrics and their tags, as tag rows or as one row a metric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidestore.model import TAG_TYPES, TAGS


def _tag(key: str | Column, value: str | Column) -> Column:
    return F.struct((F.col(key) if isinstance(key, str) else key).alias("key"), (F.col(value) if isinstance(value, str) else value).alias("value"))


def metric_key(intrinsic: str | Column = "intrinsic") -> Column:
    """Identity of a metric: its intrinsic tags in order, with keyless ones first."""
    tags = F.array_sort(F.col(intrinsic) if isinstance(intrinsic, str) else intrinsic)
    escape = lambda c: F.regexp_replace(c, r"([\\=,])", r"\\$1")
    return F.array_join(F.transform(tags, lambda t: F.concat(F.when(t["key"].isNull(), F.lit("")).otherwise(F.concat(escape(t["key"]), F.lit("="))), escape(t["value"]))), ",")


def first_value(tags: str, key: str) -> Column:
    """Value of the first tag with a key; null without any."""
    return F.get(F.filter(F.col(tags), lambda t: t["key"] == key), F.lit(0))["value"]


def resource_of(tags: str = "intrinsic") -> Column:
    """The resource id; a metric without one is an error."""
    found = first_value(tags, "resourceId")
    return F.when(found.isNull(), F.raise_error(F.lit("metric without resourceId")).cast("string")).otherwise(found)


def name_of(tags: str = "intrinsic") -> Column:
    return F.coalesce(first_value(tags, "name"), F.lit(""))


def to_metrics(tags: DataFrame) -> DataFrame:
    """Tag rows to one row a metric; a tag type outside the three is an error."""
    bad = F.raise_error(F.concat(F.lit("unknown tag type: "), F.coalesce("tag_type", F.lit("null")))).cast("string")
    checked = tags.withColumn("tag_type", F.when(F.col("tag_type").isin(*TAG_TYPES), F.col("tag_type")).otherwise(bad))
    of = lambda t: F.array_sort(F.collect_set(F.when(F.col("tag_type") == t, _tag("tag_key", "tag_value")))).cast(TAGS).alias(t)
    return checked.groupBy("metric_key").agg(*(of(t) for t in TAG_TYPES))


def to_tags(metrics: DataFrame) -> DataFrame:
    """One row a metric to tag rows: intrinsic, meta, external. A metric without tags leaves none."""
    typed = lambda t: F.transform(F.col(t), lambda x: F.struct(F.lit(t).alias("tag_type"), x["key"].alias("tag_key"), x["value"].alias("tag_value")))
    return metrics.select("metric_key", F.explode(F.concat(*(typed(t) for t in TAG_TYPES))).alias("t")).select("metric_key", "t.*")


def upsert(catalog: DataFrame, incoming: DataFrame, order: str = "seq") -> DataFrame:
    """The catalog with incoming metrics; the last of a key by ``order`` replaces all its tag sets."""
    old = catalog.withColumn(order, F.lit(None).cast(incoming.schema[order].dataType))
    both = old.select(*incoming.columns).unionByName(incoming)
    last = F.max_by(F.struct(*TAG_TYPES), F.struct(F.col(order).isNotNull(), F.col(order))).alias("last")
    return both.groupBy("metric_key").agg(last).select("metric_key", "last.*")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """metric_key, change: 'new' and 'removed' metrics and those whose meta or external tags 'changed'."""
    a = old.select("metric_key", *(F.array_sort(t).alias(f"old_{t}") for t in TAG_TYPES), F.lit(True).alias("was"))
    b = new.select("metric_key", *(F.array_sort(t).alias(f"new_{t}") for t in TAG_TYPES), F.lit(True).alias("is"))
    changed = ~F.col("old_meta").eqNullSafe(F.col("new_meta")) | ~F.col("old_external").eqNullSafe(F.col("new_external"))
    change = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "removed").when(changed, "changed")
    return a.join(b, "metric_key", "full").withColumn("change", change).where("change is not null").select("metric_key", "change")


def remove(catalog: DataFrame, keys: DataFrame) -> DataFrame:
    """The catalog (either form) without the metrics of ``keys``; unknown keys do nothing."""
    return catalog.join(keys.select("metric_key").distinct(), "metric_key", "left_anti")


def series(metrics: DataFrame) -> DataFrame:
    """metric_key, resource_id, name of every metric; resource_id is null where the tag is missing."""
    return metrics.select("metric_key", first_value("intrinsic", "resourceId").alias("resource_id"), name_of().alias("name"))


def live_series(metrics: DataFrame) -> DataFrame:
    return series(metrics).where("resource_id is not null").select("resource_id", "name").distinct()


def prune(metrics: DataFrame, resources_with_data: DataFrame) -> DataFrame:
    """The metrics whose resource still has data, and those without a resource."""
    there = resources_with_data.select(F.col("resource_id").alias("_rid")).distinct()
    return metrics.withColumn("_r", first_value("intrinsic", "resourceId")).join(there, F.col("_r") == F.col("_rid"), "left").where("_r is null or _rid is not null").drop("_r", "_rid")
