import math
from collections import Counter, defaultdict
from hashlib import md5

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidestore.llm import mixing

from .conftest import words


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=12))
def test_targets(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    got = mixing.water_fill(sizes, weights, 1.5, 2)
    assert all(t <= 2 * s for t, s in zip(got, sizes, strict=True))
    assert sum(got) == pytest.approx(1.5 * sum(sizes))
    free = {round(t / w, 6) for t, s, w in zip(got, sizes, weights, strict=True) if t < 2 * s}
    assert len(free) <= 1 and all(t / w <= max(free, default=float("inf")) + 1e-6 for t, w in zip(got, weights, strict=True))


def rows():
    sources = ["b", "a", "B", None, "é", "a", "a", "a"]
    out = [(i, words(1 + i % 37, i), sources[i % 8]) for i in range(400)]
    return [*out, (None, "no id", "a"), (500, None, "a"), (501, "", "empty"), (7, words(8, 7), "b")]


def test_takes_meet_targets(make_docs):
    data = rows()
    got = mixing.mix_plan(make_docs(data), mixing.MixParams(bucket_rows=16)).collect()
    assert len(got) == len(data)
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"] and (all(r[p] is None or 0 <= r[p] <= 1 for p in ("first_position", "second_position")))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = mixing.water_fill([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5, 2)
    assert [target[s] for s in order] == want
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in order)


def test_positions_follow_the_schedule(make_docs):
    params = mixing.MixParams(slopes=(0.5, 0.0, -0.5), bucket_rows=16)
    got = mixing.mix_plan(make_docs([(i, words(10, i), "abc"[i % 3]) for i in range(900)]), params).collect()
    for source, slope in zip("abc", params.slopes, strict=True):
        mine = sorted((r for r in got if r["source"] == source), key=lambda r: r["key"])
        place = 0
        for column, take in (("first_position", "first_take"), ("second_position", "second_take")):
            for r in mine:
                t, y = r[column], min(1, place / r["target"])
                assert (t is None) == (r[take] == 0)
                assert t is None or (1 - slope) * t + slope * t * t == pytest.approx(y, abs=1e-9)
                place += r["size"]


def test_buckets_change_nothing(make_docs):
    docs = make_docs(rows())
    a, b = (sorted(mixing.mix_plan(docs, mixing.MixParams(bucket_rows=n)).select("doc_id", "size", "taken", "first_position", "second_position").collect(), key=str) for n in (4, 100_000))
    assert a == b


def test_documents_of_the_mix(spark, make_docs):
    docs = make_docs(rows(), 5)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    times = Counter((r["doc_id"], r["text"]) for r in mixed.collect())
    per_row = defaultdict(list)
    for r in mixing.mix_plan(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        per_row[(r["doc_id"], r["text"])].append(sum(2 * r[c] >= r["size"] > 0 for c in ("first_take", "second_take")))
    assert all(times[k] == sum(v) for k, v in per_row.items() if k[0] not in (None, 500))
    again = [(r["doc_id"], r["text"]) for r in mixing.mix_documents(docs).collect()]
    assert again == [(r["doc_id"], r["text"]) for r in mixed.collect()]


def test_nothing_to_mix(make_docs):
    docs = make_docs(rows())
    assert mixing.mix_report(docs.limit(0)).count() == 0
    assert mixing.mix_documents(docs.limit(0)).count() == 0
    got = mixing.mix_report(docs.withColumn("text", F.lit(None).cast("string")))
    assert {(r["target"], r["taken"]) for r in got.collect()} == {(0.0, 0)}


def test_order_of_the_mix_equals_brute_force(make_docs):
    sizes = {"long": [900, 1, 2, 40, 3, 700, 5, 0, 9], "one": [60], "even": [7] * 60, "two": [1, 300]}
    data = [(100 * k + i, words(n, 100 * k + i), s) for k, (s, own) in enumerate(sizes.items()) for i, n in enumerate(own)]
    data += [(None, words(n, 900 + n), "even") for n in (3, 50, 120)] + [(205, words(33, 1), "even")]
    slopes, want = (0.5, 0.0, -0.5), []
    names = sorted(sizes)
    of = {s: [d for d in data if d[2] == s] for s in names}
    total = {s: sum(len(d[1].split()) for d in of[s]) for s in names}
    targets = mixing.water_fill([total[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5, 2)
    for k, (s, target) in enumerate(zip(names, targets, strict=True)):
        slope, place, mine = slopes[k % 3], 0, []
        for again in (0, 1):
            for d in sorted(of[s], key=lambda d: (md5(str("" if d[0] is None else d[0]).encode()).hexdigest(), len(d[1].split()))):
                n = len(d[1].split())
                left = min(n, int(target + 0.5) - place)
                if left > 0 and 2 * left >= n:
                    y = min(1, place / target)
                    at = y if slope == 0 else (math.sqrt((1 - slope) ** 2 + 4 * slope * y) - (1 - slope)) / (2 * slope)
                    mine.append((at, d[0], d[1]))
                place += n
        want += mine
    want.sort(key=lambda x: x[0])
    got = [(r["doc_id"], r["text"]) for r in mixing.mix_documents(make_docs(data)).collect() if r["text"]]
    assert Counter(got) == Counter(x[1:] for x in want)
    left = defaultdict(list)
    for t, *row in want:
        left[tuple(row)].append(t)
    places = [left[row].pop(0) for row in got]
    assert all(a <= b + 1e-9 for a, b in zip(places, places[1:], strict=False))
