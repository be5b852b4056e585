import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidestore.llm import _classify, quality, toxicity

from .conftest import words


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture
def rows():
    out, labels = [], []
    for i in range(240):
        bad, toxic = i % 4 == 0, i % 3 == 0
        text = words(30 + i % 40, i)
        if bad:
            text = " ".join(f"{w}%%%" for w in text.split())
        if toxic:
            w = text.split()
            w[i % len(w)] = "Moron" if i % 2 else "scum"
            w.append("idiot")
            text = " ".join(w)
        out.append((i, text))
        labels.append((i, 0 if bad else 1, 1 if toxic else 0))
    return out, labels


def test_held_out_rows_are_told_apart(spark, make_docs, rows):
    docs, labels = make_docs(rows[0]), spark.createDataFrame(rows[1], "doc_id long, quality int, toxic int")
    for report, column, n, rest in ((quality.quality_report, 1, 5, 0), (toxicity.toxicity_report, 2, 3, 1)):
        got = report(docs, labels).collect()
        assert len(got) == len(rows[0])
        truth = {x[0]: x[column] for x in rows[1]}
        for r in got:
            assert r["held_out"] == (fold(r["doc_id"], n) == rest) and 0 <= r["score"] <= 1
        held = [r for r in got if r["held_out"]]
        assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) >= 0.9


def test_labels_of_held_out_rows_are_never_read(spark, make_docs, rows):
    docs = make_docs(rows[0])
    flipped = [(i, 1 - q if fold(i, 5) == 0 else q, 1 - t if fold(i, 3) == 1 else t) for i, q, t in rows[1]]
    for report in (quality.quality_report, toxicity.toxicity_report):
        a, b = ({r["doc_id"]: r["score"] for r in report(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()} for x in (rows[1], flipped))
        assert a == b


def test_odd_rows_have_scores(spark, make_docs, rows):
    odd = [(1000, None), (1001, ""), (None, "no id"), (1002, "  \n "), (1003, "x" * 200_000), (0, rows[0][0][1])]
    docs = make_docs([*rows[0], *odd])
    labels = spark.createDataFrame([*rows[1], (1, 1, 0), (None, 0, 1), (2, None, None), (3, 7, 7)], "doc_id long, quality int, toxic int")
    for report in (quality.quality_report, toxicity.toxicity_report):
        got = report(docs, labels).collect()
        assert len(got) == len(rows[0]) + len(odd)
        assert all(0 <= r["score"] <= 1 for r in got)
        empty = {r["score"] for r in got if r["doc_id"] in (1000, 1001)}
        assert len(empty) == 1
        assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]


def test_without_labels_or_documents(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = make_docs([(1, "a b c")])
    assert quality.quality_report(docs, none).first()["predicted"] == 1
    assert toxicity.toxicity_report(docs, none).first()["predicted"] == 0
    assert quality.quality_report(docs.limit(0), none).count() == 0


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(12, 4, replace=False)).astype(np.int32) for _ in range(60)]
    sign = np.array([1 if 0 in x or 1 in x else -1 for x in rows])
    w, b = quality.dual_coordinate_descent(sign, rows, np.ones(12), 1.0, 500)
    x = np.array([[1.0 if j in r else 0.0 for j in range(12)] + [2.0] for r in rows]) / 2
    v = np.append(w, b)
    primal = 0.5 * v @ v + np.maximum(0, 1 - sign * (x @ v)).sum()
    for _ in range(200):
        u = v + rng.normal(0, 0.05, 13)
        assert 0.5 * u @ u + np.maximum(0, 1 - sign * (x @ u)).sum() >= primal - 1e-2


def pieces(text, groups):
    """Distinct word groups of a text, by plain loops."""
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", w) if x]
    return {(g, tuple(w[i + k] for k in g)) for g in groups for i in range(len(w) - max(g))}


def test_features_are_the_distinct_groups(rows):
    texts = [t for _, t in rows[0][:60]] + ["", "one", "one one one", "a b a b a"]
    raw = [t.encode() for t in texts]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    feature, at = toxicity._extractor(30)(data, offs)
    seen = {}
    for i, t in enumerate(texts):
        own = pieces(t, [(0,), (0, 1), (0, 2)])
        assert at[i + 1] - at[i] == len(own), t
        for p in own:
            seen.setdefault(p, set(feature[at[i] : at[i + 1]].tolist())).intersection_update(feature[at[i] : at[i + 1]].tolist())
    assert all(seen.values())  # a group has the same number wherever it occurs
    feature, at = quality._extractor(24)(data, offs)
    for i, (t, r) in enumerate(zip(texts, raw, strict=True)):
        grams = {r[k : k + n] for n in (1, 2, 3) for k in range(len(r) - n + 1)}
        lengths = [min(31, len(x.encode())) for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        shapes = {tuple(lengths[k : k + n]) for n in (2, 3, 4) for k in range(len(lengths) - n + 1)}
        lost = len(grams) + len(pieces(t, [(0,), (0, 1)])) + len(shapes) - (at[i + 1] - at[i])
        assert 0 <= lost <= 1  # two features of a document may share a number


def test_ftrl_equals_plain_loops():
    rng, params = np.random.default_rng(3), toxicity.ToxicityParams(bits=8, epochs=3, l1=0.02)
    rows = [np.sort(rng.choice(40, 6, replace=False)).astype(np.int32) for _ in range(80)]
    label = np.array([int(3 in x or 5 in x) for x in rows])
    weight = np.where(label == 1, 1.7, 0.6)
    got, bias = toxicity.ftrl_proximal(label, rows, weight, params)
    z, n, order = Counter(), Counter(), np.random.default_rng(7)
    l1 = max(0.5, params.l1 * len(rows))

    def w(j):
        least = 0.0 if j == "bias" else l1
        if abs(z[j]) <= least:
            return 0.0
        return -(z[j] - math.copysign(least, z[j])) / ((params.beta + math.sqrt(n[j])) / params.alpha + params.l2)

    for _ in range(params.epochs):
        for i in order.permutation(len(rows)):
            x = [*rows[i].tolist(), "bias"]
            own = {j: w(j) for j in x}
            g = (1 / (1 + math.exp(-sum(own.values()))) - label[i]) * weight[i]
            for j in x:
                sigma = (math.sqrt(n[j] + g * g) - math.sqrt(n[j])) / params.alpha
                z[j] += g - sigma * own[j]
                n[j] += g * g
    assert bias == pytest.approx(w("bias"))
    assert got[:40].tolist() == pytest.approx([w(j) for j in range(40)])
    assert 0 < np.count_nonzero(got) < 30  # L1 leaves most at zero


def test_log_count_ratios_and_scores_equal_plain_loops(spark, make_docs, rows):
    params = quality.QualityParams(bits=12)
    docs, labels = make_docs(rows[0]), spark.createDataFrame(rows[1], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, labels, "quality", params)
    raw = {i: t.encode() for i, t in rows[0]}
    extract = quality._extractor(params.bits)
    one = {i: extract(np.frombuffer(r, np.uint8), np.array([0, len(r)]))[0].tolist() for i, r in raw.items()}
    truth = {i: q for i, q, _ in rows[1]}
    order = sorted(one, key=lambda i: (i * -7046029254386353131 + 2**63) % 2**64)
    fit = [i for k, i in enumerate(order) if k % 5]
    count = {c: Counter(f for i in fit if truth[i] == c for f in one[i]) for c in (0, 1)}
    total = {c: sum(count[c].values()) + params.alpha * 2**params.bits for c in (0, 1)}
    ratio = [math.log((count[1][f] + params.alpha) / total[1]) - math.log((count[0][f] + params.alpha) / total[0]) for f in range(2**params.bits)]
    assert np.sqrt(model.ratio2).tolist() == pytest.approx([abs(r) for r in ratio], abs=1e-5)
    assert all(r == 0 or w == 0 or np.isfinite(w / r) for w, r in zip(model.weight, ratio, strict=True))
    for r in quality.score_quality(docs, model, params).collect():
        own = one[r["doc_id"]]
        margin = sum(float(model.weight[f]) for f in own) / math.sqrt(sum(ratio[f] ** 2 for f in own)) + model.bias
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-(model.slope * margin + model.shift))), abs=1e-4)


def test_the_sample_is_bounded(spark, make_docs):
    docs = make_docs([(i % 50, words(30, i)) for i in range(200)])  # ids occur four times
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    sample = lambda n, size: _classify.labelled_sample(docs, labels, "quality", n, size).collect()
    assert Counter(r["_label"] for r in sample(10, 1 << 20)) == {0: 10, 1: 10}
    few = sample(25, 500)
    assert 0 < len(few) <= 8 and sorted(few) == sorted(sample(25, 500))
    assert len({r["doc_id"] for r in sample(25, 1 << 20)}) == len(sample(25, 1 << 20)) == 50


def test_drop_toxic_keeps_clean_rows_and_all_columns(spark, make_docs, rows):
    docs = make_docs([*rows[0], (None, "fine words"), (5000, None)])
    labels = spark.createDataFrame(rows[1], "doc_id long, quality int, toxic int")
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    left = {r["doc_id"] for r in kept.collect()}
    assert {i for i, _, t in rows[1] if not t} <= left and {None, 5000} <= left
    assert not left & {i for i, _, t in rows[1] if t}
