"""DataFrame helpers shared by the operators."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch, from which on it is sent to Python; one longer row still is a batch.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return freed memory to the system: Spark keeps Python workers for later tasks, and executors hold them beside their heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """For ``applyInArrow``: a group leaves no memory behind."""

    def one(group: pa.Table) -> pa.Table:
        try:
            return run(group)
        finally:
            give_back()

    return one


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` in batches of bounded bytes (unless the session sets its own bound), whose tasks leave no memory behind."""
    if df.sparkSession.conf.get(_BATCH_SETTING, None) is None:
        df.sparkSession.conf.set(_BATCH_SETTING, str(BATCH_BYTES))

    def all_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(all_, schema)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, the folder that every machine of the cluster sees.

    Only where that setting is missing and all runs on one machine, as in tests, a local folder is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster see")
        root = "file:///tmp/checkpoints"
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and cut off from its lineage by a table in the shared folder."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def collect_garbage(spark: SparkSession) -> None:
    """Shuffle files, broadcasts and heap of finished steps are kept until the driver collects its garbage; loops ask for it."""
    spark.sparkContext._jvm.System.gc()


def text_bytes(df: DataFrame, col: str = "text") -> Column:
    return F.coalesce(F.octet_length(F.col(col)), F.lit(0)).cast("long")


def crc_of_id(col: str = "doc_id") -> Column:
    return F.crc32(F.col(col).cast("string"))


def own_names(df: DataFrame) -> str:
    """A prefix that no column of ``df`` starts with, for columns that an operator adds for itself."""
    prefix = "_op_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix
