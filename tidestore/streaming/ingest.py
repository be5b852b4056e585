"""Streaming ingest: micro-batches of samples appended to a store.

Late rows are accepted and go to the partition of their own time, so no watermark is needed. The
checkpoint makes a batch that broke off run again. A batch is staged and published under the stream's own id and
its number, so it is stored exactly once however often it runs, and streams never take each other's
batches for their own. A checkpoint that is deleted begins a new stream.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidestore.sources.store import SampleStore


def read_stream(spark: SparkSession, path: str, schema: StructType, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def ingest(samples: DataFrame, store: SampleStore, checkpoint: str, interval_us: int | None = None, catalog: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Append a stream of samples (and what ``catalog`` derives from each batch) to ``store``.

    Without ``interval_us`` everything that is there is taken and the query ends.
    """

    def append(batch: DataFrame, number: int) -> None:
        stream = json.loads(store.files.read_text(f"{checkpoint}/metadata"))["id"]
        if catalog is not None:
            store.upsert(catalog(batch).withColumn("seq", F.lit(number).cast("long")))
        store.import_batch(batch, stream, number)

    writer = samples.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": f"{max(1, interval_us // 1_000_000)} seconds"} if interval_us else {"availableNow": True}
    return writer.trigger(**trigger).start()
