"""Media columns in Ogg containers.

A row's bytes become the 8-bit samples of one logical stream; a second stream,
multiplexed with it, holds the unpadded length. Reading back verifies every page's
checksum, cuts the pages' bodies into packets by their lacing values, sorts them by
serial number and turns granule positions into timestamps.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column

FRAME = 576
RATE = 8000
#: Fixed values of the container format (RFC 3533).
CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
SAMPLES, LENGTH = 1, 2  # serial numbers of the two streams
_HEAD = "<4sBBqIIIB"
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """The checksum of a page: polynomial 04C11DB7, most significant bit first, start 0, no final complement.

    zlib has the same polynomial, mirrored: mirror the bits of each byte, then those of the result.
    """
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack(_HEAD, CAPTURE, 0, kind, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_crc(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def write_stream(packets: list[tuple[bytes, int]], serial: int, segments: int = 255) -> list[bytes]:
    """Pages of one logical stream. packets: bytes and the granule position at their end. The first packet has a page of its own."""
    pages, number = [], 0
    lacing, body, granule, continued = bytearray(), bytearray(), -1, False

    def flush(kind: int) -> None:
        nonlocal number, lacing, body, granule, continued
        pages.append(_page(kind | (CONTINUED if continued else 0) | (FIRST if number == 0 else 0), granule, serial, number, bytes(lacing), bytes(body)))
        number += 1
        lacing, body, granule, continued = bytearray(), bytearray(), -1, False

    for i, (packet, at) in enumerate(packets):
        start = 0
        sizes = [255] * (len(packet) // 255) + [len(packet) % 255]
        for j, n in enumerate(sizes):
            if len(lacing) == segments:
                flush(0)
                continued = j > 0
            lacing.append(n)
            body += packet[start : start + n]
            start += n
        granule = at
        if i == len(packets) - 1:
            flush(LAST)
        elif i == 0:
            flush(0)
    return pages


def read_pages(data: bytes) -> Iterator[tuple[int, int, int, int, bytes, int]]:
    """(flags, granule, serial, number, lacing, offset of the body) of each page; ValueError for a page that isn't whole."""
    at = 0
    while at < len(data):
        if len(data) - at < struct.calcsize(_HEAD):
            raise ValueError(f"page at {at} is cut off")
        mark, version, kind, granule, serial, number, crc, n = struct.unpack_from(_HEAD, data, at)
        if mark != CAPTURE or version:
            raise ValueError(f"no page at {at}")
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise ValueError(f"page at {at} is cut off")
        if page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise ValueError(f"page at {at}: checksum differs")
        yield kind, granule, serial, number, lacing, at + 27 + n
        at = end


def demultiplex(data: bytes) -> dict[int, list[tuple[bytes, int]]]:
    """Packets of each logical stream with the granule position known at their end (-1: none ended a page there).

    ValueError for pages out of order, marks of first and last pages that are wrong or missing, and packets that don't end.
    """
    streams: dict[int, list] = {}
    rest: dict[int, bytearray] = {}
    due: dict[int, int] = {}
    ended: set[int] = set()
    for kind, granule, serial, number, lacing, at in read_pages(data):
        if serial in ended:
            raise ValueError(f"stream {serial}: page {number} after its last page")
        if bool(kind & FIRST) != (number == 0):
            raise ValueError(f"stream {serial}: page {number} and its mark of a first page disagree")
        if kind & LAST:
            ended.add(serial)
        if number != due.get(serial, 0):
            raise ValueError(f"stream {serial}: page {number} where {due.get(serial, 0)} was due")
        due[serial] = number + 1
        packets, part = streams.setdefault(serial, []), rest.pop(serial, None)
        if bool(kind & CONTINUED) != (part is not None):
            raise ValueError(f"stream {serial}: page {number} and the one before it disagree on a continued packet")
        part = part if part is not None else bytearray()
        for n in lacing:
            part += data[at : at + n]
            at += n
            if n < 255:
                packets.append((bytes(part), -1))
                part = bytearray()
        if lacing and lacing[-1] == 255:
            rest[serial] = part
        if granule >= 0 and packets:
            packets[-1] = (packets[-1][0], granule)
    if rest:
        raise ValueError("a packet doesn't end")
    if cut_off := sorted(due.keys() - ended):
        raise ValueError(f"streams {cut_off} lack their last page")
    return streams


def encode(raw: bytes, frame: int = FRAME, rate: int = RATE) -> bytes:
    """The stored form: payload padded with 255 up to a positive multiple of ``frame``, a packet for each frame."""
    payload = raw + b"\xff" * ((-len(raw)) % frame or (0 if raw else frame))
    head = b"PCM8" + struct.pack("<IHH", rate, frame, 1)
    packets = [(head, 0)] + [(payload[i : i + frame], i + frame) for i in range(0, len(payload), frame)]
    a = write_stream(packets, SAMPLES)
    b = write_stream([(b"LEN8" + struct.pack("<Q", len(raw)), 0)], LENGTH)
    return b"".join([a[0], *b, *a[1:]])  # first pages first, as the format asks


def decode(data: bytes) -> tuple[bytes, int, list[float], int]:
    """(payload, unpadded bytes, timestamps in seconds of the packets that end pages, sampling rate)."""
    streams = demultiplex(data)
    if streams.keys() != {SAMPLES, LENGTH}:
        raise ValueError(f"streams {sorted(streams)} where samples and length were due")
    head, *frames = streams[SAMPLES]
    rate, frame, _ = struct.unpack("<IHH", head[0][4:])
    (n,) = struct.unpack("<Q", streams[LENGTH][0][0][4:])
    payload = b"".join(x for x, _ in frames)
    times = [g / rate for _, g in frames if g >= 0]
    if not times or round(times[-1] * rate) != len(payload):
        raise ValueError("the last granule position isn't the number of samples")
    if len(payload) != max(1, -(-n // frame)) * frame or payload[n:].strip(b"\xff"):
        raise ValueError(f"{len(payload)} samples don't hold {n} bytes and their padding")
    return payload, n, times, rate


def feature(payload: bytes, times: list[float]) -> str:
    """Duration by the granule positions, and mean, root mean square and sign changes of the samples about 128."""
    x = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    n = len(x)
    up = x >= 0
    return f"s={times[-1]:.6f};mean={int(x.sum()) / n:.6f};rms={(int(np.dot(x.astype(np.int64), x)) / n) ** 0.5:.6f};zc={int(np.count_nonzero(up[1:] != up[:-1]))}"


def to_ogg(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, media): the text's UTF-8 in an Ogg container.

    Null and empty texts become one frame of 255. A very long text becomes one long container, held whole by its task.
    Repeated rows and null ids stay; other columns are left behind; an empty table gives no rows.
    """

    def run(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            yield pa.record_batch([ids, pa.array([encode(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in texts], pa.binary())], ["doc_id", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(column(id_col).alias("doc_id"), column(text).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, media binary")


def from_ogg(media: DataFrame) -> DataFrame:
    """Read the stored bytes of ``media(doc_id, media)`` back: lengths, digests and a feature for each row.

    A null container gives nulls; a damaged one, an empty one among them, fails the job. Repeated rows and null ids stay;
    other columns are left behind; an empty table gives no rows.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seconds"]

    def run(batches):
        for b in batches:
            rows = []
            for x in b.column(1):
                if not x.is_valid:
                    rows.append((None,) * 8)
                    continue
                data = x.as_buffer().to_pybytes()
                payload, n, times, _ = decode(data)
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload, times), times[-1]))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            yield pa.record_batch([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double")
