import hashlib
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tidestore.llm import media


def bitwise_checksum(data):
    r = 0
    for x in data:
        r ^= x << 24
        for _ in range(8):
            r = ((r << 1) ^ 0x04C11DB7 if r & 0x80000000 else r << 1) & 0xFFFFFFFF
    return r


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=300))
def test_checksum(data):
    assert media.ogg_checksum(data) == bitwise_checksum(data)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=6))
def test_packets_of_any_size_survive(sizes):
    packets = [bytes([i % 251]) * n for i, n in enumerate(sizes)] or [b""]
    ends = [sum(len(p) for p in packets[: i + 1]) for i in range(len(packets))]
    streams, damaged = media.read_ogg(b"".join(media.write_pages(7, packets, ends)))
    assert damaged == 0 and streams[7].ended and not streams[7].lost
    assert [p.data for p in streams[7].packets] == packets


def test_streams_are_demultiplexed_and_timed():
    payload = bytes(range(256)) * 500
    got = media.decode_payload(media.encode_payload(payload, 123))
    assert got["payload"] == payload and got["unpadded"] == 123
    f = dict(x.split("=") for x in got["feature"].split(";"))
    assert f["streams"] == "2" and f["in_order"] == "1" and f["lost"] == f["damaged"] == "0"
    last = len(payload) - (len(payload) % media.PACKET or media.PACKET)
    assert int(f["last_packet_us"]) == last * 1_000_000 // media.RATE


def page(flags, granule, serial, number, lacing, body):
    """A page by the format's description, byte for byte."""
    head = b"OggS" + bytes([0, flags]) + granule.to_bytes(8, "little", signed=True) + serial.to_bytes(4, "little") + number.to_bytes(4, "little")
    rest = bytes([len(lacing), *lacing]) + body
    return head + bitwise_checksum(head + bytes(4) + rest).to_bytes(4, "little") + rest


def test_pages_made_by_hand():
    """Two streams, interleaved; a packet over three pages, one of exactly 255 bytes, an empty one, a page that ends none."""
    long, edge = bytes(range(256)) * 3, b"e" * 255
    bits = [
        page(2, 0, 1, 0, [4], b"head"),
        page(2, 0, 9, 0, [2], b"hi"),
        page(0, -1, 1, 1, [255], long[:255]),
        page(0, 7, 9, 1, [0, 3], b"abc"),
        page(1, -1, 1, 2, [255], long[255:510]),
        page(1, 1000, 1, 3, [255, 3, 255, 0], long[510:] + edge),
        page(4, 1100, 1, 4, [100], b"z" * 100),
        page(4, 9, 9, 2, [2], b"yo"),
    ]
    streams, damaged = media.read_ogg(b"".join(bits))
    assert damaged == 0 and [streams[s].lost for s in (1, 9)] == [0, 0] and all(s.ended for s in streams.values())
    assert [p.data for p in streams[1].packets] == [b"head", long, edge, b"z" * 100]
    assert [p.end for p in streams[1].packets] == [0, 1000 - 255, 1000, 1100]
    assert [(p.data, p.end) for p in streams[9].packets] == [(b"hi", 0), (b"", 4), (b"abc", 7), (b"yo", 9)]


def plain_payload(bits):
    """The sample stream's packets after its first, by a reader that trusts its input."""
    at, first, body, open_ = 0, None, b"", {}
    while at < len(bits):
        assert bits[at : at + 4] == b"OggS"
        serial, n = int.from_bytes(bits[at + 14 : at + 18], "little"), bits[at + 26]
        lacing, at = bits[at + 27 : at + 27 + n], at + 27 + n
        first = serial if first is None else first
        for size in lacing:
            open_[serial] = open_.get(serial, b"") + bits[at : at + size]
            at += size
            if size < 255:
                packet = open_.pop(serial)
                if serial == first and not packet.startswith(b"PCM8mono"):
                    body += packet
    return body


def test_stored_bytes_hold_the_padded_text(make_docs):
    rows = [(1, "abc"), (2, None), (3, "é" * 5000), (4, "x" * 70_000)]
    for r in media.encode_media(make_docs(rows)).collect():
        raw = (dict(rows)[r["doc_id"]] or "").encode()
        assert plain_payload(bytes(r["media"])) == raw + bytes(64 if not raw else -len(raw) % 64)


def test_a_damaged_page_costs_its_packets_only():
    packets = [bytes([i]) * 2048 for i in range(100)]
    pages = media.write_pages(7, packets, [2048 * (i + 1) for i in range(100)])
    assert len(pages) > 3
    broken = bytearray(pages[2])
    broken[-5] ^= 1
    streams, damaged = media.read_ogg(b"junk" + b"".join([*pages[:2], bytes(broken), *pages[3:]])[:-1])
    assert damaged >= 2 and streams[7].lost == 1
    whole = [p.data for p in streams[7].packets]
    assert 30 < len(whole) < 100 and all(p in packets for p in whole)


def test_report_round_trip(make_docs):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "é" * 64), (5, "x" * 300_000), (None, "abc"), (1, "abc")]
    got = media.media_report(make_docs(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next((t for i, t in rows if i == r["doc_id"]), None) or ""
        raw = text.encode()
        padded = raw + bytes(64 if not raw else -len(raw) % 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        stored = media.encode_payload(padded, len(raw))
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(padded[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
    assert len({r["feature"] for r in got if r["n_bytes"] == 3}) == 1
    assert media.media_report(make_docs(rows).limit(0)).count() == 0
