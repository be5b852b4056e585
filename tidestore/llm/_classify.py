"""What the two text classifiers share: the bounded labelled sample and broadcast scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidestore.llm._frames import mapped
from tidestore.llm._text import binary_column, chunks

#: (data, offs) of a chunk -> sorted distinct feature numbers of its documents, and their borders.
Extract = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def distinct_per_doc(feature: np.ndarray, doc: np.ndarray, n_docs: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.sort((doc.astype(np.int64) << bits) | feature.astype(np.int64))
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return (key & ((1 << bits) - 1)).astype(np.int32), np.searchsorted(key, np.arange(n_docs + 1, dtype=np.int64) << bits)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, class_bytes: int) -> DataFrame:
    """At most ``per_class`` rows and ``class_bytes`` of text of each class: those whose ids hash lowest, so that reruns agree.

    Rows of ``labels`` without an id or with a label other than 0 and 1 are left out; an id that is
    labelled twice counts with its larger label, and one that several documents have with the text that
    hashes lowest. A class's first document counts whatever its size. Only the picked ids, ``2 * per_class`` at
    most, go to the driver and are broadcast, so no text is shuffled.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    lowest = [one.where(F.col("_label") == y).withColumn("_order", F.xxhash64("doc_id")).orderBy("_order", "doc_id").limit(per_class) for y in (0, 1)]
    few = lowest[0].unionByName(lowest[1]).withColumnRenamed("doc_id", "_id")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("_of"))
    there = texts.join(F.broadcast(few), F.col("doc_id") == F.col("_id")).select("_id", "_label", "_order", F.struct("_of", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).alias("x"))
    rows = there.groupBy("_id", "_label", "_order").agg(F.min("x").alias("x")).collect()
    picked, used = [], [0, 0]
    for r in sorted(rows, key=lambda r: (r["_order"], r["_id"])):
        y = r["_label"]
        if not used[y] or used[y] + r["x"]["n"] <= class_bytes:
            picked.append((r["_id"], y, r["x"]["_of"]))
            used[y] += max(1, r["x"]["n"])
    keys = docs.sparkSession.createDataFrame(picked, "_id long, _label int, _hash long")
    found = texts.join(F.broadcast(keys), (F.col("doc_id") == F.col("_id")) & (F.col("_of") == F.col("_hash")))
    return found.select("doc_id", "text", "_label").dropDuplicates(["doc_id"])


def collect_features(sample: DataFrame, extract: Extract) -> tuple[np.ndarray, list[np.ndarray]]:
    """Labels and feature lists of the bounded sample, in the order of the ids' hashes, on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in chunks(batch):
                feature, at = extract(data, offs)
                rows = [feature[at[i] : at[i + 1]].tobytes() for i in range(b - a)]
                yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(rows, pa.binary())], ["doc_id", "label", "features"])

    got = mapped(sample, run, "doc_id long, label int, features binary").toArrow()
    ids = got.column("doc_id").to_numpy()
    order = np.argsort(ids * np.int64(-7046029254386353131), kind="stable") if len(ids) else np.zeros(0, np.int64)
    data, offs = binary_column(got.column("features"))
    return got.column("label").to_numpy()[order], [data[offs[i] : offs[i + 1]].view(np.int32) for i in order]


def score_documents(docs: DataFrame, extract: Extract, score: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """doc_id and score of every whole text. ``score`` maps features and borders to one number a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in chunks(batch):
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(score(*extract(data, offs)), pa.float64())], ["doc_id", "score"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of each document's values; 0 for a document without any."""
    total = np.concatenate(([0.0], np.cumsum(values)))
    return total[at[1:]] - total[at[:-1]]
