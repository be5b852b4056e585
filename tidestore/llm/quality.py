"""Quality classifier: Naive Bayes support vectors (NB-SVM).

A document is a set of hashed n-gram indicators: byte n-grams of orders 1 to 3, lower-cased word n-grams of
orders 1 and 2, and n-grams of word lengths of orders 2 to 4. Each indicator is scaled by its class log-count ratio, every document is
brought to length one, and a linear hinge-loss model is fitted by dual coordinate descent. A logistic
curve, fitted on rows that the descent has not seen, turns margins into scores from 0 to 1.

The fit uses a bounded, documented sample (``QualityParams.per_class`` rows and ``class_bytes`` of text of each
class); a fifth of it is kept apart for the curve and enters neither ratios nor descent. Scoring is one pass over all texts with the model (1 MB) broadcast in the task closure: no shuffle of any text.

Edge cases: a null text is an empty one; an empty text has no features and scores the calibrated
intercept. Without labelled rows of both classes every score is the share of label 1 seen (1.0 if none
were). A null id is never labelled and not held out. Repeated ids are scored row by row; of the texts of a
labelled id one is learnt from. A very long text is a chunk of its own; its features are at most ``2 ** bits``.
Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidestore.llm._classify import collect_features, labelled_sample, score_documents, sums
from tidestore.llm._frames import crc_of_id, give_back
from tidestore.llm._text import mix, ngrams, words


@dataclass(frozen=True)
class QualityParams:
    bits: int = 17  # of the hashed feature space
    per_class: int = 5000  # bound of the labelled sample, for each class
    class_bytes: int = 64 << 20  # bound of its text, for each class
    alpha: float = 1.0  # added to every indicator count
    cost: float = 1.0  # upper bound of the dual variables
    epochs: int = 12
    threshold: float = 0.3


@dataclass(frozen=True)
class QualityModel:
    weight: np.ndarray  # of each feature, ratio included
    ratio2: np.ndarray  # squared log-count ratios, for the length of a document
    bias: float
    slope: float
    shift: float


def _extractor(bits: int):
    def extract(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offs) - 1
        low, side = np.uint64(64 - bits), []
        seen = np.zeros(1 << bits, bool)
        code = np.zeros(len(data), np.uint64)
        for order in (1, 2, 3):
            code = (code[: len(data) - order + 1] << np.uint64(8)) | data[order - 1 :]
            side.append((((code + np.uint64(order << 32)) * np.uint64(0x9E3779B97F4A7C15)) >> low).astype(np.int32))
        w = words(data, offs)
        pair, pair_doc = ngrams(w.hash, w.doc, (0, 1))
        size = np.minimum(w.length, 31).astype(np.uint64)
        shapes = [ngrams(size, w.doc, tuple(range(order))) for order in (2, 3, 4)]
        groups = [((mix(h) >> low).astype(np.int32), np.searchsorted(d, np.arange(n + 1))) for h, d in ((w.hash, w.doc), (pair, pair_doc), *shapes)]
        out, at = [], [0]
        for i in range(n):
            for order, s in zip((1, 2, 3), side, strict=True):
                seen[s[offs[i] : max(offs[i], offs[i + 1] - order + 1)]] = True
            for g, border in groups:
                seen[g[border[i] : border[i + 1]]] = True
            own = np.flatnonzero(seen)
            seen[own] = False
            out.append(own.astype(np.int32))
            at.append(at[-1] + len(own))
        return np.concatenate(out) if out else np.zeros(0, np.int32), np.array(at)

    return extract


def log_count_ratio(label: np.ndarray, rows: list[np.ndarray], size: int, alpha: float) -> np.ndarray:
    counts = [np.full(size, alpha), np.full(size, alpha)]
    for y, x in zip(label, rows, strict=True):
        counts[y][x] += 1
    p, q = counts[1], counts[0]
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_coordinate_descent(sign: np.ndarray, rows: list[np.ndarray], ratio: np.ndarray, cost: float, epochs: int) -> tuple[np.ndarray, float]:
    """Linear hinge-loss model over unit-length rows with a constant feature of 1; weights by feature."""
    w, b = np.zeros(len(ratio)), 0.0
    scaled = [ratio[x] / max(np.sqrt(np.sum(ratio[x] ** 2)), 1e-12) for x in rows]
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(1)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            x, v = rows[i], scaled[i]
            gradient = sign[i] * (w[x] @ v + b) - 1
            new = min(max(alpha[i] - gradient / (float(v @ v) + 1.0), 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[x] += step * v
                b += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, b


def fit_logistic(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the margins, by damped Newton steps."""
    hit, miss = weight[label == 1].sum(), weight[label == 0].sum()
    target = np.where(label == 1, (hit + 1) / (hit + 2), 1 / (miss + 2))
    x, theta = np.stack([margin, np.ones_like(margin)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (weight * (target - p)) - 1e-3 * theta)
        theta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", params: QualityParams = QualityParams()) -> QualityModel:
    """Fit on the bounded sample of ``labels`` (all of whose rows may be learnt from)."""
    size = 1 << params.bits
    y, rows = collect_features(labelled_sample(docs, labels, label, params.per_class, params.class_bytes), _extractor(params.bits))
    share = {r[label]: r["count"] for r in labels.where(F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    if len(set(y.tolist())) < 2:
        p = float(y[0]) if len(y) else 1.0
        return QualityModel(np.zeros(size, np.float32), np.zeros(size, np.float32), 0.0, 1.0, 20.0 if p else -20.0)
    apart = np.arange(len(y)) % 5 == 0  # rows for the curve
    fit = np.flatnonzero(~apart) if len(set(y[~apart].tolist())) == 2 and len(set(y[apart].tolist())) == 2 else np.arange(len(y))
    test = np.setdiff1d(np.arange(len(y)), fit) if len(fit) < len(y) else fit
    ratio = log_count_ratio(y[fit], [rows[i] for i in fit], size, params.alpha)
    w, b = dual_coordinate_descent(2 * y[fit] - 1, [rows[i] for i in fit], ratio, params.cost, params.epochs)
    w *= ratio
    norm = [max(np.sqrt(np.sum(ratio[rows[i]] ** 2)), 1e-12) for i in test]
    margin = np.array([w[rows[i]].sum() / s for i, s in zip(test, norm, strict=True)]) + b
    per = {c: share[c] / max(1, int((y == c).sum())) for c in (0, 1)}
    weight = np.array([per[int(c)] for c in y[test]])
    slope, shift = fit_logistic(margin, y[test], weight / weight.mean())
    del rows
    give_back()
    return QualityModel(w.astype(np.float32), (ratio**2).astype(np.float32), float(b), slope, shift)


def score_quality(docs: DataFrame, model: QualityModel, params: QualityParams = QualityParams()) -> DataFrame:
    """doc_id, score of every row of ``docs``."""

    def score(feature: np.ndarray, at: np.ndarray) -> np.ndarray:
        norm = np.sqrt(np.maximum(sums(model.ratio2[feature].astype(float), at), 1e-24))
        margin = sums(model.weight[feature].astype(float), at) / norm + model.bias
        return 1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -40, 40)))

    return score_documents(docs, _extractor(params.bits), score)


def quality_report(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """Scores of all documents by a model that has learnt from the ids outside fold 0 of 5 only."""
    model = fit_quality(docs, labels.where(crc_of_id() % 5 != 0), "quality", params)
    return score_quality(docs, model, params).select(
        "doc_id",
        F.coalesce(crc_of_id() % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= params.threshold).cast("int").alias("predicted"),
    )
