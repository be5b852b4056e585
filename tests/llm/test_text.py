import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidestore.llm import _text

TEXT = st.text(alphabet=" \t\n\rABab1é😀\x1f\x85", max_size=30)


def chunk(texts):
    batch = pa.record_batch([pa.array(texts, pa.string())], ["text"])
    (a, b, data, offs), = _text.chunks(batch, limit=1 << 30)
    return data, offs


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | TEXT, min_size=1, max_size=5))
def test_words_are_the_regular_expression(texts):
    data, offs = chunk(texts)
    w = _text.words(data, offs)
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    want = [(i, x) for i, t in enumerate(texts) for x in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))]
    got = _text.spans(w.lowered, w.start, w.length).to_pylist()
    assert list(zip(w.doc.tolist(), got, strict=True)) == want
    hashes = dict(zip(got, w.hash.tolist(), strict=True))
    assert len(set(hashes.values())) == len(hashes)
    assert [hashes[x] for _, x in want] == w.hash.tolist()


def test_chunks_hold_whole_rows_and_every_row():
    texts = ["a" * 5, None, "b" * 100, "", "cc"]
    batch = pa.record_batch([pa.array(texts)], ["text"]).slice(1)
    parts = list(_text.chunks(batch, limit=10))
    assert [x for a, b, _, _ in parts for x in range(a, b)] == [0, 1, 2, 3]
    assert b"".join(d.tobytes() for _, _, d, _ in parts) == b"b" * 100 + b"cc"


def test_hash_index():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 5000, dtype=np.uint64))
    index = _text.HashIndex(keys[:3000])
    assert index.find(keys).tolist() == [*range(3000), *[-1] * (len(keys) - 3000)]
    assert _text.HashIndex(keys[:0]).find(keys[:2]).tolist() == [-1, -1]
