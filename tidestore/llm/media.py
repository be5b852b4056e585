"""Media columns: Ogg bitstreams of 8-bit samples.

``encode_media`` stores a text's UTF-8 bytes, padded to a positive multiple of 64, as mono 8-bit samples
in an Ogg physical stream of two logical streams: samples, and a small one that says how many bytes are
not padding. ``decode_media`` reads such a column back: page checksums are verified, packets are
reassembled from lacing values (also across pages), logical streams are demultiplexed by serial number
and every packet gets its time from the granule positions.

A page with a wrong checksum or a cut-off end is dropped and counted, and with it the packets that it
holds a part of; reading goes on at the next page that is whole. Both directions work on one row at a
time, so memory is bounded by the longest text. Serial numbers derive from the payload: equal texts
give equal bytes.

Edge cases: null and empty texts are 64 zero bytes; null media decodes to nulls; a very long text is many pages;
rows are independent, so repeated rows and null ids just pass; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidestore.llm._frames import mapped
from tidestore.llm._text import chunks

#: Fixed values of the container format: capture pattern, header flags, header layout.
CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
HEADER, HEADER_SIZE = "<4sBBqIIIB", 27
NO_GRANULE = -1
#: Of the sample stream's first packet: magic, rate, channels, bits.
SAMPLES = "<8sIBB"
SAMPLES_MAGIC = b"PCM8mono"
LENGTH = "<8sQ"
LENGTH_MAGIC = b"unpadded"
RATE = 8000
PACKET = 2048
PAD = 64

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def ogg_checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, most significant bit first, from 0 and without final inversion.

    zlib's is the same polynomial with bits reversed and inverted ends; reversing bits in and out and
    undoing the inversions gives this one at C speed.
    """
    raw = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_REVERSED), "big")


def write_page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    blank = struct.pack(HEADER, CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return blank[:22] + struct.pack("<I", ogg_checksum(blank)) + blank[26:]


def write_pages(serial: int, packets: list[bytes], granules: list[int], alone: int = 1) -> list[bytes]:
    """Pages of one logical stream. The first ``alone`` packets end their pages; granules are of packet ends."""
    pages, lacing, body, flags, granule = [], bytearray(), bytearray(), FIRST, NO_GRANULE

    def close(carried: bool, last: bool = False) -> None:
        nonlocal flags, granule
        pages.append(write_page(flags | (LAST if last else 0), granule, serial, len(pages), bytes(lacing), bytes(body)))
        lacing.clear()
        body.clear()
        flags, granule = CONTINUED if carried else 0, NO_GRANULE

    for i, (packet, end) in enumerate(zip(packets, granules, strict=True)):
        values, at = len(packet) // 255 + 1, 0
        for v in range(values):
            if len(lacing) == 255:
                close(carried=v > 0)
            size = 255 if v < values - 1 else len(packet) % 255
            lacing.append(size)
            body += packet[at : at + size]
            at += size
        granule = end
        if i < alone and i < len(packets) - 1:
            close(carried=False)
    close(carried=False, last=True)
    return pages


def encode_payload(payload: bytes, unpadded: int) -> bytes:
    serial = zlib.crc32(payload) & 0x7FFFFFFF
    parts = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    ends = [min(len(payload), i + PACKET) for i in range(0, len(payload), PACKET)]
    sound = write_pages(serial, [struct.pack(SAMPLES, SAMPLES_MAGIC, RATE, 1, 8), *parts], [0, *ends])
    count = write_pages(serial | 0x80000000, [struct.pack(LENGTH, LENGTH_MAGIC, unpadded)], [0])
    return b"".join([sound[0], count[0], *sound[1:]])


@dataclass
class Packet:
    data: bytes
    end: int  # granule position of its last sample


@dataclass
class LogicalStream:
    packets: list[Packet] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    lost: int = 0  # gaps in the page numbers
    _next: int | None = None
    _open: bytearray | None = None


def read_ogg(media: bytes) -> tuple[dict[int, LogicalStream], int]:
    """Logical streams by serial number, and how many damaged places were skipped."""
    streams: dict[int, LogicalStream] = {}
    at, damaged = 0, 0
    while at < len(media):
        if media[at : at + 4] != CAPTURE or at + HEADER_SIZE > len(media):
            damaged += 1
            at = media.find(CAPTURE, at + 1)
            if at < 0:
                break
            continue
        _, version, flags, granule, serial, number, checksum, n = struct.unpack_from(HEADER, media, at)
        body_at = at + HEADER_SIZE + n
        lacing = media[at + HEADER_SIZE : body_at]
        end = body_at + sum(lacing)
        if version or len(lacing) < n or end > len(media) or ogg_checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != checksum:
            damaged += 1
            at = media.find(CAPTURE, at + 1)
            if at < 0:
                break
            continue
        _take_page(streams.setdefault(serial, LogicalStream()), flags, granule, number, lacing, media, body_at)
        at = end
    return streams, damaged


def _take_page(s: LogicalStream, flags: int, granule: int, number: int, lacing: bytes, media: bytes, at: int) -> None:
    if s._next is not None and number != s._next:
        s.lost += 1
        s._open = None
    s._next, s.pages, s.ended = number + 1, s.pages + 1, bool(flags & LAST)
    if not flags & CONTINUED:
        s._open = None
    skipping = bool(flags & CONTINUED) and s._open is None  # the rest of a packet whose start is lost
    done: list[bytes] = []
    start = at
    for size in lacing:
        at += size
        if size == 255:
            continue
        part = media[start:at]
        start = at
        if skipping:
            skipping = False
            continue
        if s._open is not None:
            part, s._open = bytes(s._open) + part, None
        done.append(part)
    if lacing and lacing[-1] == 255 and not skipping:
        s._open = (s._open or bytearray()) + media[start:at]
    for i, part in enumerate(done):  # the page's granule position is that of its last whole packet
        later = 0 if granule <= 0 else sum(len(p) for p in done[i + 1 :])
        s.packets.append(Packet(part, max(0, granule) - later))


def decode_payload(media: bytes) -> dict:
    """Payload, its unpadded length, and features of the samples and of the container."""
    streams, damaged = read_ogg(media)
    payload, unpadded, rate, times, packets = b"", None, 0, [], 0
    for serial in sorted(streams):
        own = streams[serial].packets
        if own and own[0].data[:8] == LENGTH_MAGIC and len(own[0].data) == struct.calcsize(LENGTH):
            unpadded = struct.unpack(LENGTH, own[0].data)[1]
        elif own and own[0].data[:8] == SAMPLES_MAGIC and len(own[0].data) == struct.calcsize(SAMPLES):
            _, rate, _, _ = struct.unpack(SAMPLES, own[0].data)
            payload, packets = b"".join(p.data for p in own[1:]), len(own) - 1
            times = [(p.end - len(p.data)) * 1_000_000 // rate for p in own[1:]]
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    above = x >= 128
    feature = {
        "rate": rate, "samples": len(x), "duration_us": len(x) * 1_000_000 // rate if rate else 0, "streams": len(streams),
        "pages": sum(s.pages for s in streams.values()), "packets": packets, "last_packet_us": times[-1] if times else 0, "in_order": int(times == sorted(times)),
        "ended": int(all(s.ended for s in streams.values())), "lost": sum(s.lost for s in streams.values()), "damaged": damaged,
        "sum": int(x.sum()), "energy": int((x * x).sum()), "peak": int(x.max()) if len(x) else 0, "crossings": int((above[1:] != above[:-1]).sum()),
    }
    return {"payload": payload, "unpadded": unpadded, "feature": ";".join(f"{k}={v}" for k, v in feature.items())}


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, media of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in chunks(batch):
                media = []
                for i in range(b - a):
                    text = data[offs[i] : offs[i + 1]].tobytes()
                    media.append(encode_payload(text + bytes(PAD if not text else -len(text) % PAD), len(text)))
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(media, pa.binary())], ["doc_id", "media"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, media binary")


def decode_media(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload, feature, media of every row of ``media`` (doc_id, media)."""
    schema = "doc_id long, n_bytes long, payload binary, feature string, media binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                got = [decode_payload(m) if m is not None else {"unpadded": None, "payload": None, "feature": None} for m in part.column(1).to_pylist()]
                columns = [pa.array([g[k] for g in got], kind) for k, kind in (("unpadded", pa.int64()), ("payload", pa.binary()), ("feature", pa.string()))]
                yield pa.record_batch([part.column(0), *columns, part.column(1)], ["doc_id", "n_bytes", "payload", "feature", "media"])

    return mapped(media.select("doc_id", "media"), run, schema)


def media_report(docs: DataFrame) -> DataFrame:
    """Digests of what is stored and of what is read back."""
    tail = F.expr("substring(payload, greatest(1, length(payload) - 63), 64)")
    return decode_media(encode_media(docs)).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
