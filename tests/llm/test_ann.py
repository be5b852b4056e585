import math

import numpy as np
import pytest

from tidestore.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, v string, id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, x, 0, "v", "id") for i, x in rows], SCHEMA).repartition(3)


def brute(rows, queries, k=5):
    out = {}
    for q, x in queries:
        scored = sorted((-float(np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y))), i) for i, y in rows if i != q)
        out[q] = [i for _, i in scored[:k]]
    return out


def vectors(n, d, seed):
    rng = np.random.default_rng(seed)
    return [(i, [float(v) for v in rng.standard_normal(d).astype(np.float32)]) for i in range(n)]


def test_small_blocks_are_exact(spark):
    rows = vectors(300, 16, 0)
    got = {}
    for r in ann.ann_report(frame(spark, rows)).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    want = brute(rows, [r for r in rows if r[0] % 50 == 0])
    assert {q: [g[k] for k in sorted(g)] for q, g in got.items()} == want


def test_recall_of_the_query_s_own_setting(spark):
    """Unrelated directions, the hardest case: few candidates, most neighbours."""
    rows = vectors(51_000, 64, 1)
    v = ann.usable_vectors(frame(spark, rows)).cache()
    few = v.where("id % 500 = 0")
    got = {}
    for r in ann.nearest(v, few).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    x = np.array([y for _, y in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = {q: set(np.argsort(-(x @ x[q]))[1:6].tolist()) for q in range(0, 51_000, 500)}
    assert got.keys() == want.keys()
    recall = np.mean([len(got[q] & w) / 5 for q, w in want.items()])
    print("recall", recall)
    assert recall >= 0.9
    params = ann.ForestParams()
    strings = ann.hash_strings(x, params)
    shares = []
    for q in list(want)[:20]:
        alike = np.zeros(len(x), np.int64)
        total = np.zeros(33, np.int64)
        for keys in strings:
            same = 32 - np.ceil(np.log2((keys ^ keys[q]).astype(np.float64) + 1)).astype(int)
            total += np.bincount(same, minlength=33)[::-1].cumsum()[::-1]
            alike = np.maximum(alike, same)
        depth = max(d for d in range(33) if total[d] >= params.candidates)
        shares.append((alike >= depth).mean())
    print("ranked", np.mean(shares))
    assert np.mean(shares) <= 0.2


@pytest.mark.parametrize(("part_rows", "candidates"), [(100, 3000), (40, 60), (100, 10**9)])
def test_parts_give_what_one_tree_gives(spark, part_rows, candidates):
    rows = vectors(700, 16, 4)
    rows += [(1000 + i, [v + 1e-6 * i for v in rows[5][1]]) for i in range(300)]  # a crowded part
    params = ann.ForestParams(trees=6, candidates=candidates, part_rows=part_rows, block_rows=64, query_rows=7)
    v = ann.usable_vectors(frame(spark, rows))
    got = {}
    for r in ann.nearest(v, v.where("id % 50 = 0"), params).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = np.array([y for _, y in rows]).astype(np.float32).astype(float)
    ids, strings = np.array([i for i, _ in rows]), ann.hash_strings(x, params)
    for j, q in enumerate(ids):
        if q % 50:
            continue
        alike = np.array([[32 - int(k ^ own[j]).bit_length() for k in own.tolist()] for own in (s.astype(object) for s in strings)])
        depth = max((d for d in range(33) if (alike >= d).sum() >= candidates), default=0)
        met = np.flatnonzero((alike >= depth).any(axis=0))
        score = ann.cosine(x[met], x[j])
        best = [(ids[met[i]], score[i]) for i in np.lexsort((ids[met], -score)) if ids[met[i]] != q][:5]
        mine = sorted(got.get(q, []))
        assert [i for _, i, _ in mine] == [i for i, _ in best], q
        assert [s for _, _, s in mine] == pytest.approx([s for _, s in best])


def test_copies_ties_and_rows_that_take_no_part(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [(i, a) for i in range(100, 160)] + [(7, [2.0, 0.0]), (8, b), (200, None), (201, [0.0, 0.0]), (202, [None, 1.0]), (203, [math.nan, 1.0]), (204, [math.inf, 1.0]), (205, [1.0]), (300, [3.0]), (None, a), (8, b)]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 12)) for r in ann.ann_report(frame(spark, rows)).collect())
    assert got == sorted([(q, k + 1, i, 1.0) for q, ids in ((100, [7, 101, 102, 103, 104]), (150, [7, 100, 101, 102, 103]), (300, [205])) for k, i in enumerate(ids)])


def test_an_id_with_two_vectors_has_one_ranking(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (3, [-1.0, 0.0])]
    got = [(r["rank"], r["vec_id"]) for r in sorted(ann.ann_report(frame(spark, rows)).collect(), key=lambda r: r["rank"])]
    assert got == [(1, 1), (2, 2), (3, 3)]


def test_few_or_no_vectors(spark):
    assert ann.ann_report(frame(spark, [(0, [1.0, 2.0]), (3, [2.0, 1.0])])).count() == 1
    assert ann.ann_report(frame(spark, [(0, None)])).count() == 0
    assert ann.ann_report(frame(spark, [(0, [1.0])]).limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2])
def test_answers_do_not_depend_on_partitions(spark, n):
    rows = vectors(200, 8, 5)
    a, b = (sorted(map(tuple, ann.ann_report(frame(spark, rows).repartition(k)).collect())) for k in (n, 5))
    assert a == b
