"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are indicators of lower-cased words, of neighbouring word pairs and of pairs with one word
between them, hashed to ``2 ** bits`` coordinates. Every coordinate has a learning rate of its own; the
L1 term leaves most weights at exactly zero, so the model travels as a short list of coordinates and
weights in the task closure. Scoring is one pass over all texts without any shuffle.

The fit uses a bounded, documented sample (``ToxicityParams.per_class`` rows and ``class_bytes`` of text of each
class), with both classes of equal weight.

Edge cases: null and empty texts have no features and score the intercept; without labelled rows of both
classes every score is 0.0 or 1.0 as the one class says (0.0 if there is none). A null id is never labelled
and not held out. Repeated ids are scored row by row; of the texts of a labelled id one is learnt from. A
very long text is a chunk of its own; its features are at most ``2 ** bits``. Empty tables give empty results.
Extra columns are ignored by the report and kept by ``drop_toxic``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidestore.llm._classify import collect_features, distinct_per_doc, labelled_sample, score_documents, sums
from tidestore.llm._frames import crc_of_id, give_back, mapped
from tidestore.llm._text import chunks, mix, ngrams, words


@dataclass(frozen=True)
class ToxicityParams:
    bits: int = 20
    per_class: int = 6000  # bound of the labelled sample, for each class
    class_bytes: int = 64 << 20  # bound of its text, for each class
    alpha: float = 1.0  # learning rate
    beta: float = 1.0
    l1: float = 0.0025  # for each row of the sample
    l2: float = 0.1
    epochs: int = 6
    threshold: float = 0.7


@dataclass(frozen=True)
class ToxicityModel:
    coordinate: np.ndarray  # sorted, of the weights that are not zero
    weight: np.ndarray
    bias: float


def _extractor(bits: int):
    def extract(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = words(data, offs)
        parts = [(mix(w.hash), w.doc), ngrams(w.hash, w.doc, (0, 1)), ngrams(w.hash, w.doc, (0, 2))]
        feature = np.concatenate([h for h, _ in parts]) >> np.uint64(64 - bits)
        return distinct_per_doc(feature, np.concatenate([d for _, d in parts]), len(offs) - 1, bits)

    return extract


def ftrl_proximal(label: np.ndarray, rows: list[np.ndarray], weight: np.ndarray, params: ToxicityParams) -> tuple[np.ndarray, float]:
    """Weights and intercept after ``epochs`` passes in a fixed shuffled order."""
    size = 1 << params.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    rng, threshold = np.random.default_rng(7), max(0.5, params.l1 * len(rows))

    def current(x: np.ndarray) -> np.ndarray:
        own, l1 = z[x], np.where(x == size, 0.0, threshold)
        return np.where(np.abs(own) <= l1, 0.0, -(own - np.sign(own) * l1) / ((params.beta + np.sqrt(n[x])) / params.alpha + params.l2))

    for _ in range(params.epochs):
        for i in rng.permutation(len(rows)):
            x = np.append(rows[i], np.int32(size))  # the last coordinate is the intercept
            w = current(x)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = (p - label[i]) * weight[i]
            sigma = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / params.alpha
            z[x] += g - sigma * w
            n[x] += g * g
    everything = current(np.arange(size + 1))
    return everything[:-1], float(everything[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Fit on the bounded sample of ``labels`` (all of whose rows may be learnt from)."""
    y, rows = collect_features(labelled_sample(docs, labels, label, params.per_class, params.class_bytes), _extractor(params.bits))
    if len(set(y.tolist())) < 2:
        return ToxicityModel(np.zeros(0, np.int32), np.zeros(0, np.float32), 40.0 if len(y) and y[0] else -40.0)
    each = np.array([len(y) / (2 * (y == c).sum()) for c in (0, 1)])
    w, bias = ftrl_proximal(y, rows, each[y], params)
    kept = np.flatnonzero(w)
    model = ToxicityModel(kept.astype(np.int32), w[kept].astype(np.float32), bias)
    del rows, w
    give_back()
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """doc_id, score of every row of ``docs``."""

    def score(feature: np.ndarray, at: np.ndarray) -> np.ndarray:
        weight = np.zeros(1 << params.bits, np.float32)
        weight[model.coordinate] = model.weight
        margin = sums(weight[feature].astype(float), at) + model.bias
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))

    return score_documents(docs, _extractor(params.bits), score)


def toxicity_report(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """Scores of all documents by a model that has learnt from the ids outside fold 1 of 3 only."""
    model = fit_toxicity(docs, labels.where(crc_of_id() % 3 != 1), "toxic", params)
    return score_toxicity(docs, model, params).select(
        "doc_id",
        F.coalesce(crc_of_id() % 3 == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= params.threshold).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """The documents whose score stays under the threshold, with all their columns.

    Ids need not be unique or present: the score travels with the row, not through a join.
    """
    model = fit_toxicity(docs, labels, "toxic", params)
    extract = _extractor(params.bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << params.bits, np.float32)
        dense[model.coordinate] = model.weight
        for batch in batches:
            keep = []
            for _, _, data, offs in chunks(batch):
                feature, at = extract(data, offs)
                margin = sums(dense[feature].astype(float), at) + model.bias
                keep.append(1 / (1 + np.exp(-np.clip(margin, -40, 40))) < params.threshold)
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return mapped(docs, run, docs.schema)
