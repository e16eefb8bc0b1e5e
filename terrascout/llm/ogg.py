"""Media columns: payload bytes as 8-bit samples in Ogg pages, written and read back.

A file holds two logical streams: stream 0 carries the samples, stream 1 an
index of block digests.  Every page has its own checksum, packets are cut into
lacing values of at most 255 bytes and may go on over page borders, and a page's
granule position is the number of samples that are complete at its end.
"""

from __future__ import annotations

import json
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascout.llm.common import map_batches, sha256

RATE = 8000         # samples a second
BLOCK = 16_384      # samples of one packet
LACES = 255         # lacing values of a full page
HEAD = b"PCM8"      # identification packet: mark, rate, number of samples
INDEX = b"INDX"
CONTINUED, FIRST, LAST = 1, 2, 4
_FLIP = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class MediaError(ValueError):
    """A stream that can't be read: bad mark, checksum, order or an open packet."""


def page_checksum(data: bytes) -> int:
    """CRC-32 of an Ogg page: polynomial 0x04c11db7, most significant bit first, no inversion.

    zlib's CRC has the same polynomial with bits mirrored; mirroring input and
    result, and undoing both inversions, gives the same number.
    """
    mirrored = zlib.crc32(data.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_FLIP), "big")


def _page(flags: int, granule: int, serial: int, number: int, laces: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBqIIIB", b"OggS", 0, flags, granule, serial, number, 0, len(laces)) + laces
    crc = page_checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def _pages(packets: list[tuple[bytes, int]], serial: int) -> list[bytes]:
    """Pages of one logical stream; a packet comes with the granule position at its end."""
    pages, laces, body, granule, open_packet, number = [], bytearray(), bytearray(), -1, False, 0

    def flush(last: bool) -> None:
        nonlocal laces, body, granule, number, starts_open
        flags = CONTINUED * starts_open | FIRST * (number == 0) | LAST * last
        pages.append(_page(flags, granule, serial, number, bytes(laces), bytes(body)))
        number, laces, body, granule, starts_open = number + 1, bytearray(), bytearray(), -1, open_packet

    starts_open = False
    for k, (packet, end) in enumerate(packets):
        at = 0
        while True:
            if len(laces) == LACES:
                flush(False)
            take = min(255, len(packet) - at)
            laces.append(take)
            body += packet[at:at + take]
            at += take
            open_packet = take == 255
            if not open_packet:
                granule = end
                break
        if k == 0 and len(packets) > 1:
            flush(False)  # the identification packet has a page of its own
    flush(True)
    return pages


def write(payload: bytes, rate: int = RATE) -> bytes:
    """The Ogg file of a payload; a function of the payload alone."""
    blocks = [payload[i:i + BLOCK] for i in range(0, len(payload), BLOCK)]
    seed = zlib.crc32(payload)
    ends = [min(len(payload), (i + 1) * BLOCK) for i in range(len(blocks))]
    sound = _pages([(HEAD + struct.pack("<IQ", rate, len(payload)), 0), *zip(blocks, ends)], seed)
    index = _pages([(INDEX + struct.pack("<I", len(blocks)), 0),
                    *((struct.pack("<I", zlib.crc32(b)), e) for b, e in zip(blocks, ends))], seed ^ 0xFFFFFFFF)
    # Both streams begin before either goes on; then pages alternate.
    order = [sound[0], index[0]]
    for i in range(1, max(len(sound), len(index))):
        order += sound[i:i + 1] + index[i:i + 1]
    return b"".join(order)


@dataclass
class Stream:
    """One logical stream: whole packets and the granule position of each page."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    part: bytearray | None = None
    ended: bool = False


def demultiplex(data: bytes) -> dict[int, Stream]:
    """Logical streams by serial number; raises MediaError where a page is damaged, lost or out of order."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if data[at:at + 4] != b"OggS" or len(data) < at + 27:
            raise MediaError(f"no page at byte {at}")
        _, version, flags, granule, serial, number, crc, n = struct.unpack_from("<4sBBqIIIB", data, at)
        laces = data[at + 27:at + 27 + n]
        start = at + 27 + n
        end = start + sum(laces)
        page = data[at:end]
        if version or len(laces) < n or end > len(data) or page_checksum(page[:22] + bytes(4) + page[26:]) != crc:
            raise MediaError(f"damaged page at byte {at}")
        stream = streams.setdefault(serial, Stream())
        if (number != stream.pages or stream.ended or bool(flags & FIRST) != (number == 0)
                or bool(flags & CONTINUED) != (stream.part is not None)):
            raise MediaError(f"page out of order at byte {at}")
        stream.pages += 1
        part, closed = stream.part or bytearray(), stream.part is None
        pos = start
        for lace in laces:
            part += data[pos:pos + lace]
            pos += lace
            closed = lace < 255
            if closed:
                stream.packets.append(bytes(part))
                part = bytearray()
        stream.part = None if closed else part
        if granule >= 0:
            stream.granules.append(granule)
        stream.ended = bool(flags & LAST)
        at = end
    for serial, stream in streams.items():
        if stream.part is not None or not stream.ended:
            raise MediaError(f"stream {serial} has no end")
    return streams


@dataclass
class Sound:
    payload: bytes
    rate: int
    page_times: list[float]
    streams: int
    pages: int
    packets: int


def read(data: bytes) -> Sound:
    """The samples of a file with the times (seconds) at which its pages end."""
    streams = demultiplex(data)
    sound = [s for s in streams.values() if s.packets and s.packets[0][:4] == HEAD]
    index = [s for s in streams.values() if s.packets and s.packets[0][:4] == INDEX]
    if len(sound) != 1 or len(index) != 1:
        raise MediaError("one sample stream and one index are needed")
    rate, size = struct.unpack("<IQ", sound[0].packets[0][4:])
    blocks = sound[0].packets[1:]
    digests = [struct.unpack("<I", p)[0] for p in index[0].packets[1:]]
    payload = b"".join(blocks)
    if len(payload) != size or sound[0].granules[-1] != size or digests != [zlib.crc32(b) for b in blocks]:
        raise MediaError("samples, granule positions and index disagree")
    return Sound(payload, rate, [g / rate for g in sound[0].granules], len(streams),
                 sum(s.pages for s in streams.values()), sum(len(s.packets) for s in streams.values()))


def features(sound: Sound) -> str:
    """Facts of the samples and the container as compact JSON."""
    x = np.frombuffer(sound.payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    level = np.arange(256)
    n, total, squares = len(x), int(counts @ level), int(counts @ (level * level))
    up = x >= 128
    return json.dumps({
        "ms": round(1000 * sound.page_times[-1]), "samples": n, "sum": total, "squares": squares,
        "peak": int(x.max()), "low": int(x.min()), "kinds": int((counts > 0).sum()),
        "crossings": int(np.count_nonzero(up[1:] != up[:-1])), "streams": sound.streams,
        "pages": sound.pages, "packets": sound.packets}, separators=(",", ":"))


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with zeros up to a positive multiple of 64, and the length before."""
    raw = (text or "").encode("utf-8")
    return raw + bytes(-len(raw) % 64 if raw else 64), len(raw)


def media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media binary) for every row: the stored form of each text.

    NULL is an empty text, whose payload is 64 zeros; repeated rows are stored one
    by one; ids may be NULL; other columns are not read.
    """
    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [payload_of(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([n for _, n in made], pa.int64()),
             pa.array([write(p) for p, _ in made], pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, each, f"doc_id {kind}, n_bytes long, media binary")


def inspect(stored: DataFrame) -> DataFrame:
    """Read the ``media`` column back: payload digests, size and features.

    A NULL or damaged file gives NULL results and its reason in ``error``.
    """
    def row(data: bytes | None) -> tuple:
        if data is None:
            return None, None, None, None, None, None, "no media"
        try:
            sound = read(data)
        except MediaError as e:
            return None, None, None, len(data), sha256(data), None, str(e)
        return (len(sound.payload), sha256(sound.payload), zlib.crc32(sound.payload[-64:]), len(data),
                sha256(data), features(sound), None)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = list(zip(*(row(m) for m in batch.column(2).to_pylist())))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))],
            names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes",
                   "media_sha256", "feature", "error"])

    kind = stored.schema["doc_id"].dataType.simpleString()
    return map_batches(stored.select("doc_id", "n_bytes", "media"), each,
                       f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
                       "media_bytes long, media_sha256 string, feature string, error string")
