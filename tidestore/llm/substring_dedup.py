"""Suffix-array dedup: bytes of long strings that also start in a document with a smaller id.

A byte goes if any string of ``length`` bytes that covers it also starts in a document with a smaller id.
Strings are judged on the input; matches never cross documents.

1. Equal texts: all but the first of them go as a whole (if they hold a string at all); the rest works on
   the first ones.
2. Every string of ``length`` bytes has one anchor: of its ``gram``-byte grams, the leftmost with the
   least hash. Equal strings have equal anchors, and neighbouring strings mostly share theirs. Anchors
   are hashed to buckets, and a bucket tells which of them occur in several documents. A string whose
   anchor does not occurs in one document only, and no suffix array needs it.
3. For the others the *context* of the anchor, the run of bytes that holds all strings with that anchor,
   is kept once by content in each batch, with its least document id, and dealt to shards by anchor, so
   that equal strings meet in a shard. A shard with more bytes than ``shard_bytes``, which a frequent passage
   makes, is parted into as many as it needs. Texts and contexts are compressed before they are shuffled.
4. A shard has suffix arrays of bounded size, one a block. One is refined from eight-byte
   ranks by doubling, as Larsson and Sadakane do: only groups that are still tied are sorted again.
   Kasai's recursion, run in lockstep over many stretches of the text, gives the common prefixes. Suffixes
   that agree in ``length`` bytes are one string, known by a 128-bit fingerprint, with a least document id.
   The sorted strings of all blocks are merged by binary search.
5. The parts of a parted shard are merged across tasks: every part deals its sorted strings to ranges of
   fingerprints, a range merges what all parts sent by binary search, and the parts get back their least ids.
6. Contexts get the least id of each of their strings; what a smaller id covers is joined to spans.

No step holds more than a batch of documents, a bucket, a shard's part or a range. A frequent passage costs
each batch one entry a distinct anchor or context; what grows with its copies are their own rows (five
numbers each), which are joined by content, where Spark splits a hot key.

Edge cases: null and empty texts have no bytes; texts shorter than ``length`` lose nothing. A very long text
is a chunk of its own. Rows without an id lose nothing and make none lose. Rows that share an id never make
each other lose; equal rows give equal results. Ties of anchors' hashes only add candidates; strings are
equal if their fingerprints are. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidestore.llm._frames import lean, mapped, text_bytes, written
from tidestore.llm._text import _BASE, _BYTE_VALUE, CHUNK_BYTES, chunks, mix

_POSITION = np.uint64((1 << 31) - 1)  # a text has fewer bytes


@dataclass(frozen=True)
class SubstringParams:
    length: int = 50
    gram: int = 20
    bucket_bytes: int = 48 << 20  # of text for each bucket of anchors
    text_bytes: int = 16 << 20  # of text for each shard of contexts
    shard_bytes: int = 16 << 20  # of compressed contexts in a shard, from which on it is parted
    block_bytes: int = 512 << 10  # of contexts in one suffix array
    context_bytes: int = 16 << 20  # of contexts that leave a task together
    batch_bytes: int = 32 << 20  # of text whose anchors leave a task together
    broadcast_bytes: int = 16 << 20


# ---- anchors ---------------------------------------------------------------------------------------


def _words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one big-endian number; zeros after the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data),), ">u8", padded.tobytes(), strides=(1,)).astype(np.uint64)


def anchors(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(hash, first string, past last string, document) of every run of strings with one anchor."""
    n, window = len(data), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return np.zeros(0, np.uint64), none, none, none
    v = _words8(data)
    h = v * np.uint64(0x9E3779B97F4A7C15)
    for at in (*range(8, gram - 7, 8), *([gram - 8] if gram % 8 else [])):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        h[: n - at] += v[at:]
    h = mix(h)[: n - gram + 1]
    least = (h & ~_POSITION) | (np.arange(len(h), dtype=np.uint64) & _POSITION)
    width = 1
    while width * 2 <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < window:
        least = np.minimum(least[: len(least) - (window - width)], least[window - width :])
    start = np.arange(len(least))
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(least)]
    inside = start + length <= offs[1:][doc]
    start, doc, least = start[inside], doc[inside], least[inside]
    if not len(start):
        return np.zeros(0, np.uint64), none, none, none
    place = start + (((least & _POSITION) - (start.astype(np.uint64) & _POSITION)) & _POSITION).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]))))
    last = np.append(first[1:], len(start)) - 1
    return h[place[first]], start[first], start[last] + 1, doc[first]


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(34)) % np.uint64(buckets)).astype(np.int64)


def _low(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


_FLAGS = "bucket int, ids binary, rows binary, counts binary, hashes binary, flagged boolean"


def _by_row(key: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of equal values."""
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    return zip(at.tolist(), np.append(at[1:], len(key)).tolist(), strict=True)


def _pack(bucket: int, ids: np.ndarray, rows: np.ndarray, hashes: np.ndarray, flagged: bool) -> tuple:
    """Hashes of several rows, ordered by row, as one record."""
    first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    counts = np.diff(first, append=len(rows)).astype(np.int32)
    return bucket, ids[first].tobytes(), rows[first].tobytes(), counts.tobytes(), hashes.tobytes(), flagged


def shared_anchors(rows: DataFrame, buckets: int, params: SubstringParams) -> DataFrame:
    """row, hashes (32-bit): the anchors of each row that other documents have too."""
    length, gram, most = params.length, params.gram, params.batch_bytes

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = left_so_far = 0

        def leave() -> pa.RecordBatch:
            nonlocal left_so_far
            h, ids, keys = (np.concatenate([x[i] for x in held]) for i in range(3))
            held.clear()
            left_so_far += 1
            out = []
            bucket, low = _bucket(h, buckets), _low(h)
            key = (bucket << 32) | low
            order = np.argsort(key)
            ranked = key[order]
            first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
            many = np.diff(first, append=len(key))
            own = ids[order]
            least, largest = np.minimum.reduceat(own, first), np.maximum.reduceat(own, first)
            several = np.zeros(len(key), bool)
            several[order] = np.repeat(least != largest, many)
            # an anchor that this batch already has in several documents is settled for all of them; two tell the bucket
            ends = (own == np.repeat(least, many)) | (own == np.repeat(largest, many))
            told = np.zeros(len(key), bool)
            told[order] = ends
            at = np.flatnonzero(told)
            at = at[np.argsort(bucket[at], kind="stable")]  # rows stay in order
            out.extend(_pack(int(bucket[at[x]]), ids[at[x:y]], keys[at[x:y]], low[at[x:y]], False) for x, y in _by_row(bucket[at]))
            if several.any():  # a group of its own, below zero
                own_bucket = -1 - ((TaskContext.get().partitionId() * 1009 + left_so_far) & 0x7FFFFFFF)
                out.append(_pack(own_bucket, ids[several], keys[several], low[several], True))
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 4, pa.bool_()), strict=True)], [f.split()[0] for f in _FLAGS.split(", ")])

        for batch in batches:
            row, doc_id = (batch.column(i).to_numpy() for i in (0, 1))
            for a, b, data, offs in chunks(batch):
                h, _, _, doc = anchors(data, offs, length, gram)
                if len(h):
                    held.append((h, doc_id[a:b][doc], row[a:b][doc]))
                size += len(data)
                if size > most and held:
                    yield leave()
                    size = 0
        if held:
            yield leave()

    def per_row(keys: np.ndarray, low: np.ndarray) -> pa.Table:
        parts = [(int(keys[x]), low[x:y].tobytes()) for x, y in _by_row(keys)]
        return pa.table([pa.array([p[0] for p in parts], pa.int64()), pa.array([p[1] for p in parts], pa.binary())], ["row", "hashes"])

    def settle(group: pa.Table) -> pa.Table:
        blobs = [[np.frombuffer(x, t) for x in group.column(c).to_pylist()] for c, t in (("ids", np.int64), ("rows", np.int64), ("counts", np.int32), ("hashes", np.uint32))]
        ids, keys, counts, low = map(np.concatenate, blobs)
        ids, keys = np.repeat(ids, counts), np.repeat(keys, counts)
        if group.column("flagged")[0].as_py():
            order = np.argsort(keys, kind="stable")
            return per_row(keys[order], low[order])
        order = np.argsort(low)
        first = np.flatnonzero(np.concatenate(([True], low[order][1:] != low[order][:-1])))
        own = ids[order]
        several = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)
        flagged = np.zeros(len(low), bool)
        flagged[order] = np.repeat(several, np.diff(first, append=len(low)))
        low, keys = low[flagged], keys[flagged]
        order = np.argsort(keys, kind="stable")
        return per_row(keys[order], low[order])

    found = mapped(rows.select("row", "doc_id", "text"), gather, _FLAGS).groupBy("bucket").applyInArrow(lean(settle), "row long, hashes binary")
    return found.groupBy("row").agg(F.collect_list("hashes").alias("hashes"))


def _runs(offs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of spans of about a chunk of bytes together."""
    x = 0
    while x < len(offs) - 1:
        y = max(x + 1, int(np.searchsorted(offs, offs[x] + CHUNK_BYTES, "right")) - 1)
        yield x, y
        x = y


def span_hashes(body: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each span of ``body``."""
    size = np.diff(offs)
    out = np.zeros((2, len(size)), np.uint64)
    for x, y in _runs(offs):
        own, own_size = body[offs[x] : offs[y]], size[x:y]
        begin = offs[x:y] - offs[x]
        place = np.arange(len(own)) - np.repeat(begin, own_size)
        for i, (base, turn) in enumerate(((_BASE, 0), (np.uint64(0xD6E8FEB86659FD93), 101))):
            powers = np.multiply.accumulate(np.full(int(own_size.max()), base, np.uint64))
            value = np.roll(_BYTE_VALUE, turn)[own] * powers[place]
            out[i, x:y] = mix(np.add.reduceat(value, begin) + own_size.astype(np.uint64))
    return out[0], out[1]


def gather_spans(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans end to end, and their borders."""
    offs = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
    out = np.empty(offs[-1], np.uint8)
    for x, y in _runs(offs):
        out[offs[x] : offs[y]] = data[np.repeat(start[x:y] - offs[x:y], size[x:y]) + np.arange(offs[x], offs[y])]
    return out, offs


#: Rows of ``contexts`` with this in ``shard`` are a document's use of a context.
USE = -1
_CONTEXTS = "shard int, c1 long, c2 long, row long, doc_id long, start long, body binary, sizes binary, ids binary, several binary"


def packed_texts(rows: DataFrame) -> DataFrame:
    """row, doc_id, packed: texts compressed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3, write_content_size=True)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = [pack.compress((t or "").encode()) for t in part.column(2).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.binary())], ["row", "doc_id", "packed"])

    return mapped(rows.select("row", "doc_id", "text"), run, "row long, doc_id long, packed binary")


def contexts(rows: DataFrame, shared: DataFrame, shards: int, params: SubstringParams) -> DataFrame:
    """The contexts of shared anchors: packed by batch and shard, and one row for each use of one."""
    length, gram, most = params.length, params.gram, params.context_bytes
    names = [f.split()[0] for f in _CONTEXTS.split(", ")]
    kinds = [pa.int32(), *[pa.int64()] * 5, *[pa.binary()] * 4]

    def records(n: int, **columns: object) -> pa.RecordBatch:
        return pa.record_batch([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack, unpack = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def leave() -> Iterator[pa.RecordBatch]:
            body = np.concatenate([x[0] for x in held])
            width, c1, c2, shard, ids = (np.concatenate([x[i] for x in held]) for i in range(1, 6))
            held.clear()
            offs = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))
            order = np.lexsort((c2, c1))
            first = np.flatnonzero(np.concatenate(([True], (c1[order][1:] != c1[order][:-1]) | (c2[order][1:] != c2[order][:-1]))))
            least, largest = np.minimum.reduceat(ids[order], first), np.maximum.reduceat(ids[order], first)
            one, several = order[first], (least != largest).astype(np.uint8)
            by_shard = np.argsort(shard[one], kind="stable")
            one, least, several = one[by_shard], least[by_shard], several[by_shard]
            rows = {c: [] for c in ("shard", "body", "sizes", "ids", "several")}
            for x, y in _by_row(shard[one]):
                mine = one[x:y]
                own, _ = gather_spans(body, offs[mine], width[mine])
                rows["shard"].append(int(shard[mine[0]]))
                rows["body"].append(pack.compress(own.tobytes()))
                rows["sizes"].append(width[mine].astype(np.int32).tobytes())
                rows["ids"].append(least[x:y].tobytes())
                rows["several"].append(several[x:y].tobytes())
            yield records(len(rows["shard"]), **rows)

        for batch in batches:
            packed, a = np.array([len(z) for z in batch.column(2).to_pylist()]), 0
            while a < batch.num_rows:  # about a chunk of text at a time
                b = a + max(1, int(np.searchsorted(np.cumsum(packed[a:]), CHUNK_BYTES // 2, "right")))
                part = batch.slice(a, b - a)
                a = b
                texts = [unpack.decompress(z) for z in part.column(2).to_pylist()]
                offs = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
                data = np.frombuffer(b"".join(texts), np.uint8)
                h, first, past, doc = anchors(data, offs, length, gram)
                wanted = [b"".join(z) for z in part.column(3).to_pylist()]
                of = np.repeat(np.arange(len(wanted)), [len(z) // 4 for z in wanted])
                keep = np.isin((doc << 32) | _low(h), (of << 32) | np.frombuffer(b"".join(wanted), np.uint32))
                h, first, past, doc = h[keep], first[keep], past[keep], doc[keep]
                if not len(h):
                    continue
                width = past - first + length - 1
                body, at = gather_spans(data, first, width)
                c1, c2 = span_hashes(body, at)
                row, ids = (part.column(i).to_numpy()[doc] for i in (0, 1))
                yield records(len(h), shard=np.full(len(h), USE, np.int32), c1=c1.view(np.int64), c2=c2.view(np.int64), row=row, doc_id=ids, start=first - offs[doc])
                held.append((body, width, c1, c2, (mix(h) % np.uint64(shards)).astype(np.int64), ids))
                size += len(body)
                if size > most:
                    yield from leave()
                    size = 0
        if held:
            yield from leave()

    joined = packed_texts(rows).join(shared, "row").select("row", "doc_id", "packed", "hashes")
    return mapped(joined, run, _CONTEXTS)


# ---- suffix arrays ---------------------------------------------------------------------------------


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffixes of ``data`` in order.

    The order is complete, since Kasai's bound does not hold for suffixes that are sorted by a prefix. Ranks
    start from eight bytes and double in depth; as Larsson and Sadakane refine, suffixes that stand alone in
    their group are final and only those of larger groups are sorted again, by the rank of the suffix that
    many bytes on. A rank is the place of its group's last suffix.
    """
    n = len(data)
    rank, done = np.empty(n, np.int64), 8
    order, where = np.arange(n), np.arange(n)
    key = _words8(data)
    while len(where):
        again = np.argsort(key)
        key, suffix = key[again], order[where][again]
        order[where] = suffix
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(begin, append=len(where))
        rank[suffix] = np.repeat(where[begin + size - 1], size)
        where = where[np.repeat(size > 1, size)]
        suffix = order[where]
        beyond = suffix + done
        nxt = np.where(beyond < n, rank[np.minimum(beyond, n - 1)], -1) + 1 if len(where) else suffix
        key = rank[suffix] * (n + 1) + nxt  # by group, and in it by the rank that far on
        done *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int, lanes: int = 4096) -> np.ndarray:
    """Bytes, ``most`` at most, that each suffix shares with the one before it in ``order``.

    Kasai's recursion: in text order a common prefix is at least the last one less one byte. The text is
    cut into ``lanes`` stretches that are walked in lockstep; a match is extended eight bytes a step.
    """
    n = len(data)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = np.where(place > 0, order[place - 1], -1)
    v = np.concatenate((_words8(data), np.zeros(1, np.uint64)))
    bounds = [np.uint64(1 << (56 - 8 * k)) for k in range(8)]
    stride = -(-n // min(lanes, n))
    at = np.arange(0, n, stride)
    h = np.zeros(len(at), np.int64)
    for step in range(stride):
        i = at + step
        if i[-1] >= n:
            i = i[i < n]
            h = h[: len(i)]
        j = before[i]
        h = np.where(j < 0, 0, h)
        open_ = np.flatnonzero((j >= 0) & (h < most))
        while len(open_):
            x, y = i[open_] + h[open_], j[open_] + h[open_]
            left = n - np.maximum(x, y)  # beyond the end nothing is shared
            differ = v[np.minimum(x, n)] ^ v[np.minimum(y, n)]
            same = sum((differ < bound).astype(np.int64) for bound in bounds)  # equal leading bytes
            gain = np.minimum(np.minimum(same, np.maximum(left, 0)), most - h[open_])
            h[open_] += gain
            open_ = open_[(gain == 8) & (h[open_] < most)]
        out[place[i]] = h
        h = np.maximum(h - 1, 0)
    return out


def fingerprints(data: np.ndarray, at: np.ndarray, length: int, turn: int) -> np.ndarray:
    """64-bit hashes of the ``length`` bytes from each place on."""
    powers = np.multiply.accumulate(np.full(len(data), _BASE, np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(np.roll(_BYTE_VALUE, turn)[data] * powers)))
    back = np.multiply.accumulate(np.full(len(data), np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64))
    return mix((sums[at + length] - sums[at]) * back[at])


@dataclass
class Block:
    """Distinct strings of a block, by rising fingerprint, with the least document id of each."""

    high: np.ndarray
    low: np.ndarray
    least: np.ndarray
    of_start: np.ndarray  # index of the string of each start of a string, in the order of the text


def sort_block(body: np.ndarray, offs: np.ndarray, ids: np.ndarray, length: int) -> Block:
    """Suffix array, common prefixes and groups of the contexts that lie end to end in ``body``."""
    order = suffix_array(body)
    shared = common_prefixes(body, order, length)
    owner = np.repeat(np.arange(len(ids)), np.diff(offs))
    whole = np.arange(len(body)) + length <= offs[1:][owner]  # suffixes that hold a whole string of their context
    # the prefix shared by two strings is the least of the values between them, also across suffixes that are left out
    groups = np.cumsum(shared < length)
    mine = whole[order]
    suffix, group = order[mine], groups[mine]
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    least = np.minimum.reduceat(ids[owner[suffix]], first)
    high, low = (fingerprints(body, suffix[first], length, turn) for turn in (0, 101))
    rising = np.lexsort((low, high))
    place = np.empty(len(first), np.int64)
    place[rising] = np.arange(len(first))
    of_start = np.empty(len(body), np.int64)
    of_start[suffix] = np.repeat(place, np.diff(first, append=len(group)))
    return Block(high[rising], low[rising], least[rising], of_start[whole])


def merge_sorted(runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(high, low, least) of the distinct strings of several sorted runs, and the place of each run's strings there.

    Fingerprints are found by binary search of their high halves; strings that only share that half are told
    apart by the next places.
    """
    high, low = (np.concatenate([r[i] for r in runs]) for i in (0, 1))
    order = np.argsort(high)
    high, low = high[order], low[order]
    same = np.flatnonzero(high[1:] == high[:-1])
    if len(same) and (low[same] != low[same + 1]).any():  # two strings share the high half
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
    new = np.concatenate((np.ones(min(1, len(high)), bool), (high[1:] != high[:-1]) | (low[1:] != low[:-1])))
    high, low = high[new], low[new]
    least, places = np.full(len(high), np.iinfo(np.int64).max), []
    for run_high, run_low, run_least in runs:
        at = np.searchsorted(high, run_high)
        while len(wrong := np.flatnonzero(low[at] != run_low)):
            at[wrong] += 1
        least[at] = np.minimum(least[at], run_least)
        places.append(at)
    return high, low, least, places


_SORTED = "kind int, shard int, part int, slot int, c1 binary, c2 binary, sizes binary, index binary, high binary, low binary, least binary, doc_ids binary, several binary"
ANSWERS, STRINGS, CONTEXTS = range(3)
_LISTS = "c1 long, c2 long, least array<bigint>"


def _answers(c1: np.ndarray, c2: np.ndarray, strings: np.ndarray, least: np.ndarray, ids: np.ndarray, several: np.ndarray) -> pa.RecordBatch:
    """Contexts that any document must know of: used by several, or with a string of a smaller id."""
    if not len(strings):
        return pa.record_batch([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64()))], ["c1", "c2", "least"])
    needed = several | (np.minimum.reduceat(least, np.cumsum(strings) - strings) < ids)
    borders = np.concatenate(([0], np.cumsum(strings[needed]))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(borders), pa.array(least[np.repeat(needed, strings)]))
    return pa.record_batch([pa.array(c1[needed].view(np.int64)), pa.array(c2[needed].view(np.int64)), lists], ["c1", "c2", "least"])


def sorted_shards(packed: DataFrame, params: SubstringParams) -> DataFrame:
    """One task a part of a shard: its contexts with the least ids of their strings, or, where a shard has several
    parts, its sorted strings by range of fingerprints and where its contexts find theirs."""
    length, most = params.length, params.block_bytes
    names = [f.split()[0] for f in _SORTED.split(", ")]
    kinds = [pa.int32()] * 4 + [pa.binary()] * 9

    def record(**columns: object) -> dict:
        return {c: columns[c].tobytes() if isinstance(columns.get(c), np.ndarray) else columns.get(c) for c in names}

    def run(group: pa.Table) -> pa.Table:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        body = np.frombuffer(b"".join(unpack.decompress(z) for z in group.column("body").to_pylist()), np.uint8)
        width, ids, several = (np.frombuffer(b"".join(group.column(c).to_pylist()), t) for c, t in (("sizes", np.int32), ("ids", np.int64), ("several", np.uint8)))
        shard, part, parts = (group.column(c)[0].as_py() for c in ("shard", "part", "parts"))
        offs = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))
        c1, c2 = span_hashes(body, offs)
        order = np.lexsort((c2, c1))
        first = np.flatnonzero(np.concatenate(([True], (c1[order][1:] != c1[order][:-1]) | (c2[order][1:] != c2[order][:-1]))))
        least, largest = np.minimum.reduceat(ids[order], first), np.maximum.reduceat(ids[order], first)
        one = order[first]
        several = (np.add.reduceat(several[order].astype(np.int64), first) > 0) | (least != largest)
        ids, c1, c2, width = least, c1[one], c2[one], width[one].astype(np.int64)
        body, offs = gather_spans(body, offs[:-1][one], width)
        cuts, a = [], 0
        while a < len(ids):
            b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1)
            cuts.append((a, b))
            a = b
        blocks = [sort_block(body[offs[a] : offs[b]], offs[a : b + 1] - offs[a], ids[a:b], length) for a, b in cuts]
        high, low, least, places = merge_sorted([(x.high, x.low, x.least) for x in blocks])
        index = np.concatenate([at[x.of_start] for at, x in zip(places, blocks, strict=True)])
        strings = (width - length + 1).astype(np.int32)
        common = {"shard": shard, "part": part}
        held = {"c1": c1, "c2": c2, "sizes": strings, "doc_ids": ids, "several": several.astype(np.uint8)}
        if parts == 1:
            rows = [record(kind=ANSWERS, least=least[index], **common, **held)]
        else:
            borders = np.searchsorted(high >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64) * np.uint64(1 << 32) // np.uint64(parts))
            rows = [record(kind=STRINGS, slot=k, high=high[x:y], low=low[x:y], least=least[x:y], **common) for k, (x, y) in enumerate(zip(borders[:-1], borders[1:], strict=True))]
            rows.append(record(kind=CONTEXTS, index=index, **common, **held))
        return pa.table([pa.array([r[c] for r in rows], kind) for c, kind in zip(names, kinds, strict=True)], names)

    return packed.groupBy("shard", "part").applyInArrow(lean(run), _SORTED)


def merged_ranges(strings: DataFrame) -> DataFrame:
    """shard, part, slot, least: what all parts of a shard know of the strings of a range, for each part in its order."""

    def run(group: pa.Table) -> pa.Table:
        runs = [tuple(np.frombuffer(group.column(c)[i].as_py(), t) for c, t in (("high", np.uint64), ("low", np.uint64), ("least", np.int64))) for i in range(group.num_rows)]
        _, _, least, places = merge_sorted(runs)
        return group.select(["shard", "part", "slot"]).append_column("least", pa.array([least[at].tobytes() for at in places], pa.binary()))

    return strings.groupBy("shard", "slot").applyInArrow(lean(run), "shard int, part int, slot int, least binary")


def least_ids(packed: DataFrame, params: SubstringParams) -> DataFrame:
    """c1, c2, least (one id for each string of the context) of the contexts that any document must know of."""
    bytes_ = packed.groupBy("shard").agg(F.sum(F.octet_length("body")).alias("n"))
    large = written(bytes_.where(F.col("n") > params.shard_bytes).select("shard", F.ceil(F.col("n") / params.shard_bytes).cast("int").alias("parts")))
    parted = large.limit(1).count() > 0
    dealt = packed.select("shard", "body", "sizes", "ids", "several")
    dealt = dealt.join(large, "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1))) if parted else dealt.withColumn("parts", F.lit(1))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("body"), F.col("parts")).cast("int"))
    found = sorted_shards(dealt, params)
    if parted:
        found = written(found)
    binary = (("c1", np.uint64), ("c2", np.uint64), ("sizes", np.int32), ("least", np.int64), ("doc_ids", np.int64), ("several", np.uint8))

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c1, c2, strings, least, ids, several = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in binary)
                yield _answers(c1, c2, strings, least, ids, several > 0)

    whole = mapped(found.where(F.col("kind") == ANSWERS).select(*(c for c, _ in binary)), unpacked, _LISTS)
    if not parted:
        return whole

    def finished(contexts: pa.Table, ranges: pa.Table) -> pa.Table:
        merged = b"".join(x for _, x in sorted(zip(ranges.column("slot").to_pylist(), ranges.column("least").to_pylist(), strict=True)))
        c1, c2, strings, ids, several, index = (np.frombuffer(contexts.column(c)[0].as_py(), t) for c, t in (*(x for x in binary if x[0] != "least"), ("index", np.int64)))
        return pa.Table.from_batches([_answers(c1, c2, strings, np.frombuffer(merged, np.int64)[index], ids, several > 0)])

    ranges = written(merged_ranges(found.where(F.col("kind") == STRINGS).select("shard", "part", "slot", "high", "low", "least")))
    contexts_ = found.where(F.col("kind") == CONTEXTS).select("shard", "part", "c1", "c2", "sizes", "doc_ids", "several", "index")
    across = contexts_.groupBy("shard", "part").cogroup(ranges.groupBy("shard", "part")).applyInArrow(finished, _LISTS)
    return whole.unionByName(across)


# ---- the operator ----------------------------------------------------------------------------------


def _covered(parts: DataFrame, length: int) -> DataFrame:
    """row, spans: maximal runs (start, end) of the bytes that strings of smaller ids cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, doc_id, start = (batch.column(i).to_numpy() for i in range(3))
            lists = batch.column(3)
            size = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(len(size)), size)
            at = start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
            hit = np.flatnonzero(lists.flatten().to_numpy() < doc_id[owner])
            own, at = owner[hit], at[hit]
            new = np.concatenate((np.ones(min(1, len(own)), bool), (own[1:] != own[:-1]) | (np.diff(at) > length)))
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(own))[: len(first)] - 1
            yield pa.record_batch([pa.array(row[own[first]]), pa.array(at[first]), pa.array(at[last] + length)], ["row", "first", "past"])

    runs = mapped(parts.select("row", "doc_id", "start", "least"), run, "row long, first long, past long")
    listed = runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("first", "past"))).alias("runs"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for own in batch.column(1).to_pylist():
                merged: list[list[int]] = []
                for x in own:
                    if merged and x["first"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x["past"])
                    else:
                        merged.append([x["first"], x["past"]])
                spans.append([{"first": x, "past": y} for x, y in merged])
            kind = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))
            yield pa.record_batch([batch.column(0), pa.array(spans, kind)], ["row", "spans"])

    return mapped(listed, join, "row long, spans array<struct<first: bigint, past: bigint>>")


def _small(df: DataFrame, bytes_: Column, limit: int) -> DataFrame:
    total = df.agg(F.sum(bytes_.cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= limit else df


def repeated_spans(docs: DataFrame, params: SubstringParams = SubstringParams()) -> DataFrame:
    """row, doc_id, n_bytes, spans of every row of ``docs`` that loses bytes. ``row`` is a hash of id and text."""
    keyed = _keyed(docs).where(F.col("doc_id").isNotNull() & (F.col("n_bytes") >= params.length))
    firsts = written(keyed.groupBy("t1", "t2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max("n_bytes").alias("n_bytes"), F.count("*").alias("n")))
    total = firsts.agg(F.sum("n_bytes")).first()[0] or 0
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_bytes").alias("past")))
    later = keyed.drop("text").join(firsts.where("first != last").select("t1", "t2", "first"), ["t1", "t2"]).where("doc_id > first")
    copies = later.select("row", whole.alias("spans")).distinct()
    gone = _small(written(copies.select("row")), F.lit(8), params.broadcast_bytes)
    reps = keyed.join(gone, "row", "left_anti").select("row", "doc_id", "text").where("text is not null")
    buckets = max(12, math.ceil(total / params.bucket_bytes))
    shards = max(12, math.ceil(total / params.text_bytes))
    shared = written(shared_anchors(reps, buckets, params))
    found = written(contexts(reps, shared, shards, params))
    answers = least_ids(found.where(F.col("shard") != USE), params)
    parts = found.where(F.col("shard") == USE).select("c1", "c2", "row", "doc_id", "start").join(answers, ["c1", "c2"])
    return _covered(parts, params.length).unionByName(copies)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_bytes(docs).alias("n_bytes"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(3), text).alias("t2"))
    return keyed.withColumn("row", F.xxhash64("doc_id", "t1", "t2"))


def dedup_substrings(docs: DataFrame, params: SubstringParams = SubstringParams()) -> DataFrame:
    """doc_id, n_bytes, spans, kept (the bytes that stay) of every row of ``docs``."""
    spans = written(repeated_spans(docs, params))
    spans = _small(spans, F.size("spans") * 16 + 40, params.broadcast_bytes)
    joined = _keyed(docs).join(spans, "row", "left").select("doc_id", "text", "spans")
    kind = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in chunks(batch):
                spans = batch.column(2).slice(a, b - a).to_pylist()
                kept = []
                for i, own in enumerate(spans):
                    text, at, parts = data[offs[i] : offs[i + 1]].tobytes(), 0, []
                    for x in own or []:
                        parts.append(text[at : x["first"]])
                        at = x["past"]
                    kept.append(b"".join([*parts, text[at:]]))
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(np.diff(offs)), pa.array([s or [] for s in spans], kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return mapped(joined, run, "doc_id long, n_bytes long, spans array<struct<first: bigint, past: bigint>>, kept binary")


def substring_report(docs: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["past"] - x["first"])
    return dedup_substrings(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
