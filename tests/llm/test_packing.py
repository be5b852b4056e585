import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidestore.llm import packing

from .conftest import words

PARTS = ["'", "s", "re", "ll", "'ve", " ", "  ", "\n", "\t", "a", "B", "é", "12", "½", ".", "!?", "“", "中", "😀", "\xa0", "\x85", "word", " the", "<|endoftext|>", "\x1f", "ก็"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    t.encode_special_tokens = True
    return t


def test_ids_are_the_library_s(library):
    rng = random.Random(0)
    texts = ["".join(rng.choices(PARTS, k=rng.randrange(30))) for _ in range(3000)] + [words(500, 1), ""]
    raw = [t.encode() for t in texts]
    offs = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    encoder = packing.Encoder(packing.default_tokenizer())
    for _ in range(2):  # the second time from the cache
        ids, at = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), offs)
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def piece(n, doc=0):
    return packing.Piece(doc, 0, np.arange(n), n)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_classes_take_a_fixed_number(lengths):
    packer = packing.HarmonicPacker(64)
    placed = [x for n in lengths for x in packer.add(piece(n))]
    bins = defaultdict(list)
    for p, sequence, offset in placed:
        assert offset == sum(bins[sequence])
        bins[sequence].append(len(p.ids))
    assert all(len({64 // n for n in b}) == 1 and len(b) == 64 // b[0] for b in bins.values())
    rest = packer.finish(cut=False)
    assert sorted(len(p.ids) for p, _, _ in [*placed, *rest]) == sorted(lengths)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 6000), max_size=40), st.sampled_from([1 / 64, 1 / 8, None]))
def test_cuts_bound_the_padding(totals, slack):
    packer, bins, ids = packing.HarmonicPacker(2048), defaultdict(list), defaultdict(dict)
    pieces = 0
    placed = []
    for d, t in enumerate(totals):
        start = 0
        for n in packing.cut_lengths(t, 2048, slack):
            placed += packer.add(packing.Piece(d, start, np.arange(start, start + n), t))
            start, pieces = start + n, pieces + 1
        assert start == t
    full = {s for _, s, _ in placed}
    for p, sequence, offset in placed + packer.finish(slack is not None):
        assert offset == sum(bins[sequence])
        bins[sequence].append(len(p.ids))
        assert p.start not in ids[p.doc] and p.ids.tolist() == list(range(p.start, p.start + len(p.ids)))
        ids[p.doc][p.start] = len(p.ids)
    assert all(sum(ids[d].values()) == t for d, t in enumerate(totals))
    size = {s: sum(b) for s, b in bins.items()}
    assert all(n <= 2048 for n in size.values())
    if slack is not None:
        assert all(n & (n - 1) == 0 for s, n in size.items() if s not in full)
        assert sum(2048 - size[s] for s in full) <= slack * sum(totals) + pieces


def test_report(make_docs, library):
    rows = [(i, words(1 + i * 13 % 700, i)) for i in range(60)] + [(100, None), (101, ""), (102, "x" * 50_000), (103, "中文 " * 900)]
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    pieces = packing.pack_report(make_docs(rows)).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append(p)
    assert set(docs) == set(ids)
    for i, own in docs.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[i])
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[i][p["start"] : at], "<u4").tobytes())
        assert at == len(ids[i])
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
    sizes = [sum(p["length"] for p in own) for own in sequences.values()]
    padding = sum(2048 - n for n in sizes if n & (n - 1))
    assert padding <= sum(sizes) / 64 + len(pieces)
    assert len(pieces) <= 3 * len(rows) + sum(sizes) / 2048 + 12 * len({p["sequence_id"] >> 32 for p in pieces})


def test_odd_rows(make_docs):
    rows = [(None, "a"), (1, "same"), (1, "same")]
    got = packing.pack_report(make_docs(rows)).collect()
    assert sum(p["length"] for p in got if p["doc_id"] == 1) == 2 * next(p["doc_tokens"] for p in got if p["doc_id"] == 1)
    assert any(p["doc_id"] is None for p in got)
    assert packing.pack_report(make_docs(rows).limit(0)).count() == 0
