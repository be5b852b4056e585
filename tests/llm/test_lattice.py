import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidestore.llm import lattice_lm as lm

from .conftest import words


@pytest.fixture(scope="module")
def tiny():
    pieces = (b" a", b" ab", b" ", b"b", b"bc", b"c", b"abc", b"")
    return lm.Vocabulary(pieces, lm.Vocabulary(pieces, np.zeros(8)).normalised(np.array([4.0, 2, 1, 3, 2, 2, 1, 3])))


def segmentations(word, pieces):
    if not word:
        yield []
    for i, p in enumerate(pieces):
        if p and word.startswith(p):
            for rest in segmentations(word[len(p) :], pieces):
                yield [i, *rest]


def chunk(texts):
    batch = pa.record_batch([pa.array(texts)], ["word"])
    return list(lm._units(batch, 3))


def test_forward_sums_all_segmentations(tiny):
    texts = ["abc", "a", "abbc", "bcbcabc", "c"]
    lattice, log_p = lm.Lattice(tiny), np.log(tiny.weight)
    for pick, unit, offs in chunk(texts):
        for i, value in zip(pick, lattice.forward(unit, offs, log_p), strict=True):
            want = sum(math.prod(tiny.weight[j] for j in s) for s in segmentations(b" " + texts[i].encode(), tiny.pieces))
            assert math.exp(value) == pytest.approx(want)


def test_expected_counts_are_posteriors(tiny):
    texts, times = ["abc", "abbc", "bcbcabc"], np.array([1.0, 5.0, 2.0])
    lattice, log_p, want = lm.Lattice(tiny), np.log(tiny.weight), np.zeros(8)
    for t, n in zip(texts, times, strict=True):
        all_ = [(math.prod(tiny.weight[j] for j in s), s) for s in segmentations(b" " + t.encode(), tiny.pieces)]
        total = sum(p for p, _ in all_)
        for p, s in all_:
            for j in s:
                want[j] += n * p / total
    got = sum(lattice.expected(unit, offs, log_p, times[pick]) for pick, unit, offs in chunk(texts))
    assert got == pytest.approx(want)


def test_word_probabilities_sum_to_one(tiny):
    """Over all words of the tiny alphabet, by length, with the stop."""
    lattice, log_p, total = lm.Lattice(tiny), np.log(tiny.weight), 0.0
    level = [""]
    for _ in range(9):
        level = [w + c for w in level for c in "abc"]
        keep = [w for w in level if any(True for _ in segmentations(b" " + w.encode(), tiny.pieces))]
        for _, unit, offs in chunk(keep):
            total += float(np.exp(lattice.forward(unit, offs, log_p)).sum()) * tiny.weight[-1]
        level = keep or level
    assert 0.5 < total <= 1 + 1e-9


def slow_log10(texts, held, vocabulary, rounds, smoothing=0.1):
    """log10 probability of each text by plain loops: expected counts, then the sum over segmentations."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    token = lambda t: [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))]
    counts = Counter(w for i, t in texts if not held(i) for w in token(t))
    ends, n = sum(not held(i) for i, _ in texts), sum(counts.values())
    at = {p: k for k, p in enumerate(vocabulary.pieces) if p}
    longest, p = max(map(len, at)), vocabulary.weight

    def sums(word):
        ahead, behind = [1.0] + [0.0] * len(word), [0.0] * len(word) + [1.0]
        arcs = [(i, j, at[word[i:j]]) for i in range(len(word)) for j in range(i + 1, min(len(word), i + longest) + 1) if word[i:j] in at]
        for i, j, k in arcs:
            ahead[j] += ahead[i] * p[k]
        for i, j, k in sorted(arcs, key=lambda x: -x[0]):
            behind[i] += p[k] * behind[j]
        return ahead, behind, arcs

    for _ in range(rounds):
        uses = np.full(len(p), smoothing)
        for w, c in counts.items():
            ahead, behind, arcs = sums(b" " + w)
            for i, j, k in arcs:
                uses[k] += c * ahead[i] * p[k] * behind[j] / ahead[-1]
        uses[-1] += n
        p = vocabulary.normalised(uses)
    word = lambda w: math.log10(sums(b" " + w)[0][-1] * p[-1] * n / (n + ends))
    return {i: sum(map(word, token(t))) + math.log10(ends / (n + ends)) for i, t in texts}


def test_scores_equal_plain_loops(make_docs):
    rows = [(i, words(12 + i % 5, i % 17) + " the Éa") for i in range(40)] + [(500, None), (502, "unseen wörds")]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    got = {r["doc_id"]: r["score"] for r in lm.lattice_report(make_docs(rows)).collect()}
    assert got == pytest.approx(slow_log10(rows, held, lm.read_vocabulary(lm.default_vocabulary()), lm.LatticeParams().rounds), rel=1e-9)


def test_report(make_docs):
    rows = [(i, words(40 + i % 9, i % 30) + " The the É") for i in range(120)] + [(500, None), (501, ""), (None, "no id"), (502, "z" * 3000), (7, words(40 + 7 % 9, 7) + " The the É")]
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    token = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not held(i) for w in token(t))
    ends = sum(not held(i) for i, _ in rows)
    n, v = sum(c.values()) + ends, len(c) + 1
    params = lm.LatticeParams(frequent=20, merge_rows=100, batch_words=50)
    got = lm.lattice_scores(make_docs(rows), ~lm.F.coalesce(lm.crc_of_id() % 10 == 0, lm.F.lit(False)), lm.default_vocabulary(), params).collect()
    assert len(got) == len(rows) and {r["train_tokens"] for r in got} == {n}
    texts = dict(rows)
    for r in got:
        w = token(texts[r["doc_id"]])
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w) + math.log10((ends + 0.1) / (n + 0.1 * (v + 1)))
        assert r["base_score"] == pytest.approx(base) and r["n_tokens"] == len(w) + 1 and r["n_known"] == sum(c[x] > 0 for x in w) + 1
        assert -1e6 < r["score"] < 0
    again = {r["doc_id"]: r["score"] for r in lm.lattice_scores(make_docs(rows, 2), ~lm.F.coalesce(lm.crc_of_id() % 10 == 0, lm.F.lit(False)), lm.default_vocabulary()).collect()}
    assert all(r["score"] == pytest.approx(again[r["doc_id"]], rel=1e-9) for r in got)


def test_nothing_to_learn_from(make_docs):
    docs = make_docs([(1, "a b"), (2, None)])
    got = lm.lattice_scores(docs, lm.F.lit(False), lm.default_vocabulary()).collect()
    assert all(r["train_tokens"] == 0 and r["base_score"] == 0 and r["score"] < 0 for r in got)
    assert lm.lattice_report(docs.limit(0)).count() == 0
