"""Media columns in Ogg containers.

A media value is one physical Ogg stream: logical stream A carries 8-bit PCM
packets, logical stream B a comment packet that describes it. Pages have
checksums, packets are split by lacing values, the logical streams are
interleaved, and granule positions count samples, which gives timestamps.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

RATE = 8000
UNIT = 64
PACKET = 4096
#: Segments a page holds at most, by the container format.
MAX_SEGMENTS = 255
HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    """The bytes aren't a whole Ogg stream."""


def page_crc(page: bytes) -> int:
    """The container's CRC-32 (generator 0x04c11db7, high bit first, no inversion).

    zlib's CRC has the same generator with bits mirrored, so mirrored input and
    output give this one at C speed.
    """
    raw = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(serial: int, seq: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(b"OggS", 0, flags, granule, serial, seq, 0, len(lacing)) + lacing
    crc = page_crc(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def mux_stream(packets: list[tuple[bytes, int]], serial: int) -> list[bytes]:
    """Pages of one logical stream from (packet, granule at its end)."""
    segments: list[tuple[bytes, int, bool]] = []
    for data, granule in packets:
        for i in range(0, len(data) + 1, 255):
            part = data[i : i + 255]
            segments.append((part, granule, len(part) < 255))
    pages, inside = [], False
    for k in range(0, len(segments), MAX_SEGMENTS):
        part = segments[k : k + MAX_SEGMENTS]
        ends = [g for _, g, end in part if end]
        flags = (CONTINUED if inside else 0) | (FIRST if k == 0 else 0) | (LAST if k + MAX_SEGMENTS >= len(segments) else 0)
        pages.append(_page(serial, len(pages), ends[-1] if ends else -1, flags, bytes(len(p) for p, _, _ in part), b"".join(p for p, _, _ in part)))
        inside = not part[-1][2]
    return pages


def write_media(payload: bytes) -> bytes:
    """The stored form of a payload whose length is a positive multiple of 64."""
    serial = int.from_bytes(hashlib.sha256(payload).digest()[:4], "little")
    packets = [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    sound = mux_stream([(b"PCM8" + struct.pack("<IQ", RATE, len(payload)), 0), *packets], serial)
    notes = mux_stream([(b"NOTE" + struct.pack("<I", serial), 0)], serial ^ 0xFFFFFFFF)
    return b"".join([sound[0], *notes, *sound[1:]])


def read_pages(data: bytes):
    """(serial, sequence, granule, flags, lacing values, body) of each page, checksums verified."""
    at = 0
    while at < len(data):
        if data[at : at + 4] != b"OggS" or at + 27 > len(data):
            raise OggError(f"no page at byte {at}")
        _, version, flags, granule, serial, seq, crc, n = HEADER.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if version or len(lacing) < n or end > len(data):
            raise OggError(f"broken page at byte {at}")
        if page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError(f"wrong checksum at byte {at}")
        yield serial, seq, granule, flags, lacing, data[at + 27 + n : end]
        at = end


def demux(data: bytes) -> dict[int, list[tuple[bytes, int]]]:
    """Packets of each logical stream with the granule of the page they end on."""
    streams: dict[int, list[tuple[bytes, int]]] = {}
    parts: dict[int, list[bytes]] = {}
    last: dict[int, int] = {}
    closed: set[int] = set()
    for serial, seq, granule, flags, lacing, body in read_pages(data):
        if (serial not in streams) != bool(flags & FIRST) or seq != last.get(serial, -1) + 1:
            raise OggError(f"page {seq} of stream {serial} is out of order")
        if bool(flags & CONTINUED) != bool(parts.get(serial)):
            raise OggError(f"page {seq} of stream {serial} doesn't continue its packet")
        last[serial] = seq
        out, open_ = streams.setdefault(serial, []), parts.setdefault(serial, [])
        at = 0
        for n in lacing:
            open_.append(body[at : at + n])
            at += n
            if n < 255:
                out.append((b"".join(open_), granule))
                open_.clear()
        if flags & LAST:
            closed.add(serial)
    if closed != set(streams) or any(parts.values()):
        raise OggError("a stream isn't closed")
    return streams


def timestamps(packets: list[tuple[bytes, int]], rate: int) -> list[tuple[int, int]]:
    """Begin and end in milliseconds of each packet behind the header.

    A page's granule position is the sample at which the last packet that ends
    on it ends; packets before that on the page end as many samples earlier as
    follow them there.
    """
    ends, last, granule = [], len(packets) - 1, None
    for k in range(last, 0, -1):
        data, on_page = packets[k]
        if k == last or on_page != packets[k + 1][1]:
            granule = on_page
        ends.append(granule)
        granule -= len(data)
    ends.reverse()
    if any(b < a for a, b in zip(ends, ends[1:], strict=False)) or granule:
        raise OggError("granule positions and packets differ")
    return [(a * 1000 // rate, b * 1000 // rate) for a, b in zip([0, *ends], ends, strict=False)]


def read_media(data: bytes) -> tuple[bytes, dict]:
    """Payload and features of a stored value."""
    streams = demux(data)
    sound = [s for s in streams.values() if s and s[0][0][:4] == b"PCM8"]
    if len(sound) != 1:
        raise OggError("not one sound stream")
    rate, total = struct.unpack("<IQ", sound[0][0][0][4:16])
    payload = b"".join(p for p, _ in sound[0][1:])
    stamps = timestamps(sound[0], rate)
    if len(payload) != total or stamps[-1][1] != total * 1000 // rate:
        raise OggError("granule positions and samples differ")
    x = np.frombuffer(payload, np.uint8).astype(np.float64)
    return payload, {
        "streams": len(streams),
        "packets": sum(map(len, streams.values())),
        "rate": rate,
        "ms": stamps[-1][1],
        "mean": round(float(x.mean()), 4),
        "std": round(float(x.std()), 4),
        "crossings": int(np.count_nonzero(np.diff((x >= 128).astype(np.int8)))),
    }


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with bytes 0 up to a positive multiple of 64, and the length before that."""
    raw = (text or "").encode("utf-8")
    return raw + b"\0" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and the stored ``media`` of each row; narrow.

    Null and empty texts are 64 zero bytes, very long texts are stored whole,
    repeated rows give equal rows, null ids stay null, an empty table gives no
    rows; other columns, whatever their names, are ignored.
    """

    def rows(cols):
        ids, texts = cols
        made = [payload_of(t) for t in texts]
        return [ids, [n for _, n in made], [write_media(p) for p, _ in made]]

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return map_rows(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), rows, f"id {kind}, n_bytes long, media binary"
    ).withColumnRenamed("id", id_col)


def decode(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Payload digests and features read back from ``media``; a broken stream raises OggError."""

    def rows(cols):
        ids, n_bytes, stored = cols
        out = [[] for _ in range(8)]
        for i, n, m in zip(ids, n_bytes, stored, strict=True):
            payload, feature = read_media(m)
            for col, v in zip(
                out,
                (i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), ";".join(f"{k}={v}" for k, v in feature.items())),
                strict=True,
            ):
                col.append(v)
        return out

    kind = media.select(id_col).schema[0].dataType.simpleString()
    return map_rows(
        media.select(F.col(id_col).alias("id"), "n_bytes", "media"),
        rows,
        f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    ).withColumnRenamed("id", id_col)


def contract(docs: DataFrame) -> DataFrame:
    """Each document stored and read back; ``encode`` defines nulls, empty and long texts, ties, repeats, empty tables and further columns."""
    return decode(encode(docs))
