"""Harmonic packing of token sequences.

Lengths are parted into reciprocal-capacity classes: class k holds the lengths in
``(capacity / (k + 1), capacity / k]``, and each of its bins takes exactly k of them. A bin never
depends on another class or another worker, so packing is one pass over the documents with no shuffle;
a worker keeps at most one open bin a class, 2048 bins of 2048 tokens at most.

A document is cut at multiples of ``capacity``. What is left stays whole if a bin full of such pieces wastes
little: at most ``slack`` of the document's tokens for its piece. Otherwise the longest length of the next
class that fills its bins is cut off, and the shorter rest is judged alike. So most documents are one
or two pieces, and padding is at most ``slack`` of all tokens and one token a piece. Without ``slack`` a
document is cut above ``capacity`` only.

What is left in the open bins at a worker's end is laid end to end from the longest piece down and cut at
sequence ends; the last tokens of a worker go to sequences whose lengths are powers of two.

Token ids come from a public byte-level BPE file by the ``tokenizers`` library. Texts are parted into
the pretokens of that file's pattern with array operations and each distinct pretoken is encoded once
a task; a document with characters that Unicode has added or reclassified since version 3.2 goes
through the library as a whole. Both give the same ids.

Edge cases: null and empty texts are one end token; a very long text is one chunk of its own; equal documents and repeated ids are packed row by
row; a null id stays null; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidestore.llm._frames import mapped
from tidestore.llm._text import _BASE, _BYTE_VALUE, chunks, mix

OTHER, LETTER, NUMBER, SPACE, UNKNOWN = range(5)
#: Unicode's White_Space property.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: The contractions of the pattern.
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")
_SLOT_BITS = 20
_MAX_CACHED_IDS = 4 << 20
_CHUNK_BYTES = 512 << 10


def _classes() -> np.ndarray:
    """Class of each code point under 0x30000; UNKNOWN where Unicode 3.2 and today's disagree."""
    out = np.full(0x30000, UNKNOWN, np.uint8)
    kind = {"L": LETTER, "N": NUMBER}
    for c in range(0x30000):
        now, old = unicodedata.category(chr(c)), unicodedata.ucd_3_2_0.category(chr(c))
        if old not in ("Cn", "Cs") and kind.get(now[0], OTHER) == kind.get(old[0], OTHER):
            out[c] = kind.get(now[0], OTHER)
    out[list(WHITE_SPACE)] = SPACE
    return out


def pretoken_starts(points: np.ndarray, cls: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a pretoken starts at each character; ``first`` marks the first characters of documents."""
    n = len(points)
    white, blank = cls == SPACE, points == 32
    before_white = np.concatenate(([False], white[:-1]))
    before_blank = np.concatenate(([False], blank[:-1]))
    changed = np.concatenate(([True], cls[1:] != cls[:-1]))
    next_solid = np.concatenate((~white[1:] & ~first[1:], [False]))
    start = np.where(white, ~before_white | next_solid, np.where(before_white, ~before_blank, changed)) | first
    for i in np.flatnonzero((points == 39) & start):
        for letters in CONTRACTIONS:
            end = i + 1 + len(letters)
            if end <= n and all(points[i + 1 + k] == ord(x) for k, x in enumerate(letters)) and not first[i + 1 : end].any():
                start[i + 1 : end] = False
                if end < n and cls[end] == LETTER:
                    start[end] = True
                break
    return start


class Encoder:
    """Ids of the documents of a chunk, with a cache of pretokens."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.classes = _classes()
        self.forget()

    def forget(self) -> None:
        """An empty cache: slots by hash, each with the place of its ids."""
        self.key = np.zeros(1 << _SLOT_BITS, np.uint64)
        self.at = np.zeros(1 << _SLOT_BITS, np.int64)
        self.many = np.zeros(1 << _SLOT_BITS, np.int32)
        self.ids = np.zeros(1 << 18, np.int32)
        self.used = 0

    def learn(self, hashes: np.ndarray, pretokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encode and keep pretokens; places and lengths of their ids."""
        got = self.tokenizer.encode(pretokens, is_pretokenized=True, add_special_tokens=False)
        many = np.bincount(np.array(got.word_ids, np.int64), minlength=len(pretokens)).astype(np.int32)
        new = np.array(got.ids, np.int32)
        if self.used + len(new) > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.used], np.zeros(max(len(self.ids), len(new)), np.int32)))
        self.ids[self.used : self.used + len(new)] = new
        at = self.used + np.cumsum(many) - many
        self.used += len(new)
        slot = hashes >> np.uint64(64 - _SLOT_BITS)
        slot ^= (self.key[slot] != 0).astype(np.uint64)  # where the first place is taken, the one beside it
        self.key[slot], self.at[slot], self.many[slot] = hashes, at, many
        return at, many

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Where each hash is, if it is anywhere: its own place or the one beside it."""
        slot = hashes >> np.uint64(64 - _SLOT_BITS)
        beside = np.flatnonzero(self.key[slot] != hashes)
        slot[beside] ^= np.uint64(1)
        return slot

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the documents end to end, and their borders."""
        n = len(offs) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        if self.used > _MAX_CACHED_IDS:
            self.forget()
        text = data.tobytes()
        points = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
        byte_of = np.flatnonzero((data & 0xC0) != 0x80)
        char_offs = np.searchsorted(byte_of, offs)
        cls = self.classes[np.minimum(points, len(self.classes) - 1)]
        strange = np.flatnonzero((cls == UNKNOWN) | (points >= len(self.classes)))
        by_library = np.unique(np.searchsorted(char_offs, strange, "right") - 1)
        first = np.zeros(len(points), bool)
        first[char_offs[:-1][char_offs[:-1] < char_offs[1:]]] = True
        begin = byte_of[np.flatnonzero(pretoken_starts(points, cls, first))]
        length = np.diff(begin, append=len(data))
        place = np.arange(len(data)) - np.repeat(begin, length)
        powers = np.multiply.accumulate(np.full(int(length.max()), _BASE, np.uint64))
        h = mix(np.add.reduceat(_BYTE_VALUE[data] * powers[place], begin) + length.astype(np.uint64))
        slot = self.slots(h)
        at, many = self.at[slot], self.many[slot]
        missing = np.flatnonzero(self.key[slot] != h)
        if len(missing):
            fresh, where, back = np.unique(h[missing], return_index=True, return_inverse=True)
            first_at = missing[where]
            new_at, new_many = self.learn(fresh, [text[b : b + m].decode() for b, m in zip(begin[first_at].tolist(), length[first_at].tolist(), strict=True)])
            at[missing], many[missing] = new_at[back], new_many[back]
        ends = np.concatenate(([0], np.cumsum(many, dtype=np.int64)))
        ids = self.ids[np.repeat(at - ends[:-1], many) + np.arange(ends[-1])]
        borders = ends[np.searchsorted(begin, offs)]
        if not len(by_library):
            return ids, borders
        parts = [ids[borders[i] : borders[i + 1]] for i in range(n)]
        texts = [text[offs[i] : offs[i + 1]].decode() for i in by_library]
        for i, got in zip(by_library, self.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
            parts[i] = np.array(got.ids, np.int32)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


def cut_lengths(total: int, capacity: int, slack: float | None) -> list[int]:
    """Whole capacities, then pieces whose classes waste at most ``slack`` of ``total`` a piece, longest first."""
    out, rest = [capacity] * (total // capacity), total % capacity
    while rest:
        fixed = capacity // rest
        if slack is None or capacity / fixed - rest <= max(1.0, slack * total):
            return [*out, rest]
        out.append(capacity // (fixed + 1))
        rest -= out[-1]
    return out


@dataclass(frozen=True)
class Piece:
    doc: int | None
    start: int
    ids: np.ndarray
    total: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[:n], self.total), Piece(self.doc, self.start + n, self.ids[n:], self.total)


@dataclass
class HarmonicPacker:
    """Places pieces in bins; ``add`` and ``finish`` give (piece, sequence, offset) for what is settled."""

    capacity: int
    first_sequence: int = 0
    open: dict[int, list[Piece]] = field(default_factory=dict)
    sequences: int = 0

    def _close(self, pieces: list[Piece]) -> list[tuple[Piece, int, int]]:
        sequence, offset, out = self.first_sequence + self.sequences, 0, []
        self.sequences += 1
        for piece in pieces:
            out.append((piece, sequence, offset))
            offset += len(piece.ids)
        return out

    def add(self, piece: Piece) -> list[tuple[Piece, int, int]]:
        fixed = self.capacity // len(piece.ids)
        bin_ = self.open.setdefault(fixed, [])
        bin_.append(piece)
        return self._close(self.open.pop(fixed)) if len(bin_) == fixed else []

    def finish(self, cut: bool = True) -> list[tuple[Piece, int, int]]:
        """What the open bins hold: end to end, or without ``cut`` one bin a class."""
        bins = [self.open[k] for k in sorted(self.open)]
        self.open = {}
        if not cut:
            return [x for b in bins for x in self._close(b)]
        rest = sorted((p for b in bins for p in b), key=lambda p: -len(p.ids))
        left, out, now, room = sum(len(p.ids) for p in rest), [], [], 0
        for piece in rest:
            while True:
                if not room:
                    room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                    left -= room
                if len(piece.ids) <= room:
                    break
                head, piece = piece.cut(room)
                out += self._close([*now, head])
                now, room = [], 0
            now.append(piece)
            room -= len(piece.ids)
            if not room:
                out += self._close(now)
                now = []
        return out


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, slack: float | None = 1 / 64) -> DataFrame:
    """One row a piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset."""
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def table(settled: list[tuple[Piece, int, int]]) -> pa.RecordBatch:
        rows = [(p.doc, p.start, len(p.ids), p.ids.astype("<u4").tobytes(), p.total, sequence, offset) for p, sequence, offset in settled]
        return pa.record_batch([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = HarmonicPacker(capacity, TaskContext.get().partitionId() << 32)
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(tokenizer_path)
            for a, b, data, offs in chunks(batch, limit=_CHUNK_BYTES):
                ids, at = encoder.encode(data, offs)
                settled = []
                for i, doc in enumerate(batch.column(0).slice(a, b - a).to_pylist()):
                    own, start = np.append(ids[at[i] : at[i + 1]], np.int32(end_id)), 0
                    for length in cut_lengths(len(own), capacity, slack):
                        settled += packer.add(Piece(doc, start, own[start : start + length], len(own)))
                        start += length
                yield table(settled)
        yield table(packer.finish(slack is not None))

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack_report(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    pieces = pack_documents(docs, tokenizer_path or default_tokenizer())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
