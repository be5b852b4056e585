"""Round-robin archives: sample history out of consolidated rows, and merging and splitting of archives.

A dump is a struct of version, step, lastupdate, ds (array of sources) and rra (array of archives, each with
cf, k (steps a row), xff and rows (array of one value a source)).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidestore.functions.numbers import is_average, is_counter, metric_type
from tidestore.functions.paths import from_micros

INT_MAX = 2147483647
WRAP = float(2**64)


def archive_step(step: Column, k: Column) -> Column:
    return step * k


def archive_end(step: Column, lastupdate: Column, k: Column) -> Column:
    """Time of an archive's last row."""
    return lastupdate - lastupdate % (step * k)


def archive_start(step: Column, lastupdate: Column, k: Column, n: Column) -> Column:
    return archive_end(step, lastupdate, k) - step * k * (n - 1)


def time_of_row(start: Column, step: Column, index: Column) -> Column:
    return start + step * index


def row_at(start: Column, step: Column, n: Column, time: Column) -> Column:
    """Index of the row at a time, with times between rows counting for the one before; null outside."""
    offset = time - start
    index = (offset - offset % step) / step
    return F.when((index >= 0) & (index < n), index.cast("bigint"))


def archives(dumps: DataFrame, keys: list[str]) -> DataFrame:
    """One row an archive: ``keys``, pos, cf, k, n, rows, ds, step, lastupdate, row_step, first, last."""
    s, u, k, n = F.col("step"), F.col("lastupdate"), F.col("a.k"), F.size("a.rows").cast("bigint")
    flat = dumps.select(*keys, F.col("dump.step").alias("step"), F.col("dump.lastupdate").alias("lastupdate"), F.col("dump.ds").alias("ds"), F.posexplode("dump.rra").alias("pos", "a"))
    return flat.select(*keys, "pos", F.col("a.cf").alias("cf"), k.alias("k"), n.alias("n"), F.col("a.rows").alias("rows"), "ds", "step", "lastupdate", (s * k).alias("row_step"), archive_start(s, u, k, n).alias("first"), archive_end(s, u, k).alias("last"))


def select_archives(archive: DataFrame, keys: list[str]) -> DataFrame:
    """One archive a resolution: the longest of one step a row, whatever it consolidates, else averages."""
    longest = Window.partitionBy(*keys).orderBy(F.desc("n"), "pos")
    fine = archive.where("k = 1").withColumn("_r", F.row_number().over(longest)).where("_r = 1").withColumn("_r", F.lit(0))
    average = archive.where(is_average("cf")).withColumn("_r", F.lit(1))
    first = Window.partitionBy(*keys, "k").orderBy("_r", "pos")
    return fine.unionByName(average).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_r", "_n")


def _ceil_times(value: Column, unit: Column) -> Column:
    """Least multiple of ``unit`` from ``value`` up, by way of a 32-bit quotient."""
    return F.least(F.ceil(value.cast("double") / unit.cast("double")).cast("bigint"), F.lit(INT_MAX)) * unit


def stitch_bounds(selected: DataFrame, keys: list[str]) -> DataFrame:
    """Adds begin (inclusive) and until (exclusive, null without): the part of each archive that counts.

    Only neighbours in resolution are compared.
    """
    by_k = Window.partitionBy(*keys).orderBy("k")
    lower = F.lag(F.struct("k", "n")).over(by_k)
    higher = F.lead("row_step").over(by_k)
    known = selected.withColumn("_low", lower).withColumn("_high", higher)
    low_start = F.col("lastupdate") - F.col("_low.k") * F.col("step") * F.col("_low.n")
    begin = F.when(F.col("_high").isNull(), F.col("first")).otherwise(_ceil_times(F.col("first"), F.col("_high")))
    return known.withColumn("until", F.when(F.col("_low").isNotNull(), _ceil_times(low_start, F.col("row_step")))).withColumn("begin", begin).drop("_low", "_high")


def _counter_history(rates: pd.Series, last: pd.Series, step: pd.Series) -> pd.Series:
    """Raw counter values at every row, from the newest back: each rate takes off what it added."""
    out = []
    for rate, newest, width in zip(rates, last, step, strict=True):
        rate = np.asarray(rate, float)
        values = np.full(len(rate), np.nan)
        if len(rate):
            newest = 0.0 if newest is None or pd.isna(newest) else float(newest)
            now = newest - float(np.fmod(newest, width))
            values[-1] = now
            for j in range(len(rate) - 1, 0, -1):
                unknown = np.isnan(rate[j])
                now -= 0.0 if unknown else rate[j] * width
                if now < 0:
                    now += WRAP
                if not unknown:
                    values[j - 1] = now
        out.append(values)
    return pd.Series(out)


def counter_history(rates: Column, last: Column, step: Column) -> Column:
    """Array of raw counter values from an array of rates; NaN where unknown. Built-in folds would copy the array for each row."""
    return F.pandas_udf(_counter_history, "array<double>")(rates, last, step.cast("double"))


def archive_samples(archive: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, k, ds_no, ds, type, ts, value: each source's values at each row of each archive, NaN included."""
    flat = archive.select(*keys, "k", "row_step", "first", "rows", F.posexplode("ds").alias("ds_no", "d"))
    rates = F.transform("rows", lambda r: F.get(r, F.col("ds_no")))
    of_ds = flat.select(*keys, "k", "row_step", "first", "ds_no", F.col("d.name").alias("ds"), F.col("d.type").alias("type"), F.col("d.last_ds").alias("last_ds"), rates.alias("rates"))
    gauges = of_ds.where(~is_counter("type")).withColumn("values", F.col("rates"))
    counters = of_ds.where(is_counter("type")).withColumn("values", counter_history(F.col("rates"), F.col("last_ds"), F.col("row_step")))
    both = gauges.unionByName(counters).select(*keys, "k", "row_step", "first", "ds_no", "ds", "type", F.posexplode("values").alias("_i", "value"))
    return both.select(*keys, "k", "ds_no", "ds", "type", (F.col("first") + F.col("row_step") * F.col("_i")).alias("ts"), F.coalesce("value", F.lit(float("nan"))).alias("value"))


def history(dumps: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ds_no, ds, type, ts, value: the stitched history of each source, without unknown values.

    Where two archives have a row at one time, all of the coarser one's row counts, even what is unknown in it.
    """
    parts = stitch_bounds(select_archives(archives(dumps, keys), keys), keys)
    slots = parts.where("n > 0").select(*keys, "k", "row_step", "begin", "until", F.explode(F.sequence(F.col("first"), F.col("last"), F.col("row_step"))).alias("ts"))
    counting = slots.where((F.col("ts") >= F.col("begin")) & (F.col("until").isNull() | (F.col("ts") < F.col("until"))))
    winner = counting.groupBy(*keys, "ts").agg(F.max("k").alias("k"))
    values = archive_samples(parts.where("n > 0"), keys).where(~F.isnan("value"))
    return values.join(winner, [*keys, "ts", "k"]).select(*keys, "ds_no", "ds", "type", "ts", "value")


def import_samples(values: DataFrame, resource: str | Column, group: str | Column, external: str | Column | None = None) -> DataFrame:
    """resource_id, name, time, value and the tag arrays of imported values."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    rid = F.concat_ws("/", as_col(resource), as_col(group))
    tag = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    none = F.array().cast("array<struct<key: string, value: string>>")
    return values.where(~F.isnan("value")).select(
        rid.alias("resource_id"),
        F.col("ds").alias("name"),
        from_micros(F.col("ts") * 1_000_000).alias("time"),
        "value",
        F.array(tag("name", F.col("ds")), tag("resourceId", rid)).alias("intrinsic"),
        F.array(tag("mtype", metric_type("type"))).alias("meta"),
        (F.coalesce(as_col(external), none) if external is not None else none).alias("external"),
    )


# ---- archives as values ----------------------------------------------------------------------------


def all_nan(row: Column) -> Column:
    return F.forall(row, lambda v: F.isnan(v))


def mergeable(a: Column, b: Column) -> Column:
    """Same resolution and consolidation."""
    return (a["k"] == b["k"]) & (a["cf"] == b["cf"])


def _mate(rras: Column, a: Column) -> Column:
    return F.get(F.filter(rras, lambda b: mergeable(a, b)), F.lit(0))


def has_mergeable(a: Column, b: Column) -> Column:
    """Whether any archive of dump ``a`` has a mate in dump ``b``."""
    return F.exists(a["rra"], lambda x: F.exists(b["rra"], lambda y: mergeable(x, y)))


def _start(dump: Column, rra: Column) -> Column:
    return archive_start(dump["step"], dump["lastupdate"], rra["k"], F.size(rra["rows"]).cast("bigint"))


def _with_rows(rra: Column, rows: Column) -> Column:
    return F.struct(rra["cf"].alias("cf"), rra["k"].alias("k"), rra["xff"].alias("xff"), rows.alias("rows"))


def _rebuilt(dump: Column, rra: Column, ds: Column | None = None) -> Column:
    return F.struct(dump["version"].alias("version"), dump["step"].alias("step"), dump["lastupdate"].alias("lastupdate"), (dump["ds"] if ds is None else ds).alias("ds"), rra.alias("rra"))


def _refuse(test: Column, text: str, otherwise: Column) -> Column:
    """``otherwise`` where ``test`` holds, else an error."""
    return F.when(F.when(test, F.lit(True)).otherwise(F.raise_error(F.lit(text)).cast("boolean")), otherwise)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merge_one(local: Column, source: Column) -> Column:
    """``local`` with every row that ``source`` knows anything of, by time."""

    def archive(a: Column) -> Column:
        step = local["step"] * a["k"]

        def rows(known: Column) -> Column:
            def row(r: Column, i: Column) -> Column:
                at = row_at(known["start"], step, F.size(known["rows"]).cast("bigint"), time_of_row(known["first"], step, i))
                other = F.get(known["rows"], at.cast("int"))
                return F.when(other.isNotNull() & ~all_nan(other), other).otherwise(r)

            return F.transform(a["rows"], row)

        known = _let(_mate(source["rra"], a), lambda m: F.struct(m["rows"].alias("rows"), _start(source, m).alias("start"), _start(local, a).alias("first")))
        return _with_rows(a, _let(known, rows))

    return _refuse(has_mergeable(local, source), "no mergeable archives", _rebuilt(local, F.transform(local["rra"], archive)))


def merge_many(local: Column, sources: Column) -> Column:
    """``local`` with the known cells of an array of dumps, one for each of its sources, by name and time."""
    named = lambda name: F.get(F.filter(sources, lambda s: F.get(s["ds"], F.lit(0))["name"] == name), F.lit(0))

    def archive(a: Column) -> Column:
        step = local["step"] * a["k"]

        def of_source(d: Column) -> Column:
            found = lambda s: _let(_mate(s["rra"], a), lambda m: F.struct(F.transform(m["rows"], lambda r: F.get(r, F.lit(0))).alias("values"), _start(s, m).alias("start")))
            return _let(named(d["name"]), found)

        def cells(mates: Column) -> Column:
            def row(r: Column, i: Column) -> Column:
                time = time_of_row(mates["first"], step, i)

                def cell(v: Column, j: Column) -> Column:
                    mate = F.get(mates["of"], j)
                    at = row_at(mate["start"], step, F.size(mate["values"]).cast("bigint"), time)
                    other = F.get(mate["values"], at.cast("int"))
                    return F.when(other.isNotNull() & ~F.isnan(other), other).otherwise(v)

                return F.transform(r, cell)

            return F.transform(a["rows"], row)

        known = F.struct(_start(local, a).alias("first"), F.transform(local["ds"], of_source).alias("of"))
        return _with_rows(a, _let(known, cells))

    fits = (
        (F.size(sources) == F.size(local["ds"]))
        & F.forall(sources, lambda s: (s["step"] == local["step"]) & (s["version"] == local["version"]) & (F.size(s["ds"]) == 1) & has_mergeable(local, s))
        & F.forall(local["ds"], lambda d: F.exists(sources, lambda s: F.get(s["ds"], F.lit(0))["name"] == d["name"]))
    )
    return _refuse(fits, "archives can't be merged", _rebuilt(local, F.transform(local["rra"], archive)))


def split_dump(dump: Column) -> Column:
    """Array of dumps, one a source; an error for fewer than two sources."""

    def single(d: Column, i: Column) -> Column:
        return _rebuilt(dump, F.transform(dump["rra"], lambda a: single_archive(a, i)), F.array(d))

    return _refuse(F.size(dump["ds"]) > 1, "at least two sources are needed", F.transform(dump["ds"], single))


def single_archive(rra: Column, index: Column) -> Column:
    """An archive with the values of one source."""
    return _with_rows(rra, F.transform(rra["rows"], lambda r: F.array(F.get(r, index))))


def reset_dump(dump: Column) -> Column:
    """All cells unknown."""
    blank = lambda a: _with_rows(a, F.transform(a["rows"], lambda r: F.transform(r, lambda _: F.lit(float("nan")))))
    return _rebuilt(dump, F.transform(dump["rra"], blank))


def source_index(dump: Column, name: str) -> Column:
    """Position of a source, -1 if there is none."""
    return (F.array_position(F.transform(dump["ds"], lambda d: d["name"]), name) - 1).cast("int")


def source_format(ds: Column, typed: bool = False) -> Column:
    """What two sources must share to have one format: name, heartbeat and bounds; if ``typed``, type and formula too."""
    return F.struct(ds["name"], ds["heartbeat"], ds["min"], ds["max"], *([F.trim(ds["type"]), F.trim(ds["cdef"])] if typed else []))


def archive_format(rra: Column, typed: bool = False) -> Column:
    """What two archives must share to have one format: resolution and rows; if ``typed``, consolidation too."""
    return F.struct(rra["k"], F.size(rra["rows"]), *([F.trim(rra["cf"])] if typed else []))


def format_equals(a: Column, b: Column, typed: bool = False) -> Column:
    """Same step, sources and archives, in order."""
    shape = lambda d: F.transform(d["ds"], lambda s: source_format(s, typed))
    size = lambda d: F.transform(d["rra"], lambda r: archive_format(r, typed))
    return a["step"].eqNullSafe(b["step"]) & shape(a).eqNullSafe(shape(b)) & size(a).eqNullSafe(size(b))
