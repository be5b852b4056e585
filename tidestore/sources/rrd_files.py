"""Round-robin archive dumps: XML text to nested rows, and the files of an import tree."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidestore.functions.numbers import CF_V1, CF_V3, DS_V1, DS_V3, known_enum, parse_double, parse_long
from tidestore.functions.paths import remove_extension

_DS = "struct<name: string, type: string, minimal_heartbeat: string, min: string, max: string, last_ds: string, value: string, unknown_sec: string, cdef: string>"
_PARAMS = "struct<xff: string, hw_alpha: string, hw_beta: string, dependent_rra_idx: string, seasonal_gamma: string, seasonal_smooth_idx: string, smoothing_window: string, failure_threshold: string, window_length: string>"
_CDP = "struct<ds: array<struct<primary_value: string, secondary_value: string, value: string, unknown_datapoints: string, history: string>>>"
_RRA = f"struct<cf: string, pdp_per_row: string, xff: string, params: {_PARAMS}, cdp_prep: {_CDP}, database: struct<row: array<struct<v: array<string>>>>>"
DUMP_XML = f"struct<version: string, step: string, lastupdate: string, ds: array<{_DS}>, rra: array<{_RRA}>>"


def parse_dump(xml: Column | str) -> Column:
    """A dump's XML as nested columns, null if it can't be read or names an unknown source type or consolidation.

    Document types are cut off, not loaded. Dumps of the first version know fewer names.

    Numbers are read as text first, since ``U`` would void a whole record.
    """
    xml = F.col(xml) if isinstance(xml, str) else xml
    raw = F.from_xml(_bare(xml), DUMP_XML, {"rowTag": "rrd", "mode": "PERMISSIVE"})
    trimmed = lambda c: F.trim(c)
    ds = F.transform(
        raw["ds"],
        lambda d: F.struct(
            trimmed(d["name"]).alias("name"), trimmed(d["type"]).alias("type"), parse_long(d["minimal_heartbeat"]).alias("heartbeat"),
            parse_double(d["min"]).alias("min"), parse_double(d["max"]).alias("max"), parse_double(d["last_ds"]).alias("last_ds"),
            parse_double(d["value"]).alias("value"), parse_long(d["unknown_sec"]).alias("unknown_sec"), d["cdef"].alias("cdef"),
        ),
    )
    rra = F.transform(
        raw["rra"],
        lambda a: F.struct(
            trimmed(a["cf"]).alias("cf"), parse_long(a["pdp_per_row"]).alias("k"),
            F.coalesce(parse_double(a["xff"]), parse_double(a["params"]["xff"])).alias("xff"),
            F.coalesce(F.transform(a["database"]["row"], lambda r: F.transform(r["v"], lambda v: F.coalesce(parse_double(v), F.lit(float("nan"))))), F.array().cast("array<array<double>>")).alias("rows"),
        ),
    )
    whole = F.struct(trimmed(raw["version"]).alias("version"), parse_long(raw["step"]).alias("step"), parse_long(raw["lastupdate"]).alias("lastupdate"), ds.alias("ds"), F.coalesce(rra, F.array()).alias("rra"))
    first = F.coalesce(trimmed(raw["version"]) == "0001", F.lit(False)) | F.coalesce(raw["version"].contains("JRobin"), F.lit(False))
    names = lambda part, field, allowed: F.forall(F.coalesce(part, F.array()), lambda x: known_enum(x[field], allowed))
    known = F.when(first, names(raw["ds"], "type", DS_V1) & names(raw["rra"], "cf", CF_V1)).otherwise(names(raw["ds"], "type", DS_V3) & names(raw["rra"], "cf", CF_V3))
    return F.when(raw["step"].isNotNull() & raw["lastupdate"].isNotNull() & raw["ds"].isNotNull() & known, whole)


def parse_state(xml: Column | str) -> Column:
    """The running state that a dump of the third version keeps for each archive: parameters and prepared points, as numbers.

    Null where the dump can't be read; an archive without state has null members.
    """
    xml = F.col(xml) if isinstance(xml, str) else xml
    raw = F.from_xml(_bare(xml), DUMP_XML, {"rowTag": "rrd", "mode": "PERMISSIVE"})
    whole = ("dependent_rra_idx", "seasonal_smooth_idx", "failure_threshold", "window_length")
    names = [f.split(":")[0] for f in _PARAMS.removeprefix("struct<").removesuffix(">").split(", ")]
    number = lambda c, name: (parse_long(c[name]) if name in whole else parse_double(c[name])).alias(name)
    point = lambda d: F.struct(*(number(d, n) for n in ("primary_value", "secondary_value", "value")), parse_long(d["unknown_datapoints"]).alias("unknown_datapoints"), F.trim(d["history"]).alias("history"))
    return F.transform(raw["rra"], lambda a: F.struct(F.trim(a["cf"]).alias("cf"), *(number(a["params"], n) for n in names), F.transform(a["cdp_prep"]["ds"], point).alias("points")))


def _bare(xml: Column) -> Column:
    """Without document types and comments."""
    return F.regexp_replace(F.regexp_replace(xml, r"(?s)<!DOCTYPE[^>\[]*(\[.*?\])?[^>]*>", ""), r"(?s)<!--.*?-->", "")


def dump_binaries(spark: SparkSession, path: str, program: str = "rrdtool", glob: str = "*.rrd", seconds: float = 60.0) -> DataFrame:
    """file, dump of every binary archive under a directory, as ``program dump`` writes it; null where that fails.

    The program must be installed on the executors. It gets a copy in the task's own temporary folder, which goes at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import subprocess
        import tempfile

        for batch in batches:
            texts = []
            for content in batch.column(1).to_pylist():
                with tempfile.NamedTemporaryFile(suffix=".rrd") as f:
                    f.write(content)
                    f.flush()
                    try:
                        done = subprocess.run([program, "dump", f.name], capture_output=True, timeout=seconds)
                        texts.append(done.stdout.decode("utf-8", "replace") if done.returncode == 0 else None)
                    except (OSError, subprocess.TimeoutExpired):
                        texts.append(None)
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["file", "xml"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select(F.col("_metadata.file_path").alias("file"), "content").mapInArrow(run, "file string, xml string").select("file", parse_dump("xml").alias("dump"))


def read_dumps(spark: SparkSession, path: str, glob: str = "*.xml") -> DataFrame:
    """file, dump of every XML dump under a directory; dump is null where a file can't be read."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("file"), parse_dump("value").alias("dump"))


def _properties(text: Column) -> Column:
    """Key and value of each line of a properties file; comments and blank lines don't count."""
    lines = F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: (F.trim(x) != "") & ~F.ltrim(x).rlike("^[#!]"))
    return F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^\s*([^=:\s]+)", 1)).alias("key"), F.trim(F.regexp_replace(x, r"^\s*[^=:\s]+\s*[=:\s]\s*", "")).alias("value")))


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    at = F.col("_metadata.file_path")
    return files.select(F.regexp_replace(at, "/[^/]*$", "").alias("directory"), F.regexp_extract(at, "([^/]*)$", 1).alias("file"), _properties(F.col("value")).alias("entries"))


def groups_by_directory(spark: SparkSession, path: str) -> DataFrame:
    """directory, grp: the distinct values in each directory's ``ds.properties`` are its groups."""
    return _files(spark, path, "ds.properties").select("directory", F.explode("entries").alias("e")).select("directory", F.col("e.value").alias("grp")).distinct()


def groups_by_metric(spark: SparkSession, path: str) -> DataFrame:
    """directory, metric, grp of every ``*.meta`` file that names its group."""
    group = F.get(F.filter("entries", lambda e: e["key"] == "GROUP"), F.lit(0))["value"]
    return _files(spark, path, "*.meta").select("directory", remove_extension("file").alias("metric"), group.alias("grp")).where("grp is not null")


def external_tags(spark: SparkSession, path: str) -> DataFrame:
    """directory, external: the entries of each directory's ``strings.properties``."""
    return _files(spark, path, "strings.properties").select("directory", F.col("entries").alias("external"))
