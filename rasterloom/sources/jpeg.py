"""JPEG in numpy: an encoder with Huffman tables fitted to each image, and a decoder of sequential files.

Pixels become planes, planes 8x8 blocks, and blocks coefficients in whole-array steps;
the encoder's entropy coding is whole-array too. Only the decoder's Huffman reading
goes symbol by symbol, about a second for a megapixel.
"""

from __future__ import annotations

import struct

import numpy as np

from ..functions.colour import rgb_to_ycc

#: The example quantisation tables of ITU-T T.81, annex K, row by row.
LUMA = [
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMA = [
    17, 18, 24, 47, 99, 99, 99, 99,
    18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99,
    47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
]
SUBSAMPLING = {444: (1, 1), 422: (2, 1), 420: (2, 2)}  # luma samples for each chroma sample, across and down
LONGEST = 16  # bits of a code

_ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
_K = np.arange(8)
_DCT = np.where(_K[:, None] == 0, 0.125**0.5, 0.5 * np.cos((2 * _K + 1) * _K[:, None] * np.pi / 16))


class NotSequential(Exception):
    """A JPEG process other than sequential Huffman coding of 8-bit samples."""


def quantisers(quality: int) -> list[np.ndarray]:
    """Luma and chroma tables, row by row. Quality 50 is the standard's example, 100 no quantisation."""
    q = min(max(int(quality), 1), 100)
    percent = 5000 // q if q < 50 else 200 - 2 * q
    return [np.clip((np.array(t) * percent + 50) // 100, 1, 255) for t in (LUMA, CHROMA)]


def code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Lengths of the best prefix code of at most 16 bits (package-merge). One code of the longest, all ones, stays free, as the format asks."""
    coins = sorted([(n, (s,)) for s, n in counts.items()] + [(0, (256,))])
    level = coins
    for _ in range(LONGEST - 1):
        pairs = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(level[::2], level[1::2], strict=False)]
        level = sorted(coins + pairs, key=lambda c: c[0])
    out = dict.fromkeys([*counts, 256], 0)
    for _, symbols in level[: 2 * len(coins) - 2]:
        for s in symbols:
            out[s] += 1
    return out


def _canonical(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Codes and lengths by symbol, and the table as it is stored."""
    code, size = np.zeros(256, np.int64), np.zeros(256, np.int64)
    order = sorted(lengths, key=lambda s: (lengths[s], s))  # the free code, 256, is the last
    at = last = 0
    for s in order:
        at <<= lengths[s] - last
        last = lengths[s]
        if s < 256:
            code[s], size[s] = at, last
        at += 1
    order.remove(256)
    return code, size, bytes(int(np.count_nonzero(size == n)) for n in range(1, LONGEST + 1)) + bytes(order)


def _bit_sizes(v: np.ndarray) -> np.ndarray:
    """Bits of each magnitude."""
    return np.ceil(np.log2(np.abs(v) + 1.0)).astype(np.int64)


def _packed(value: np.ndarray, size: np.ndarray) -> bytes:
    """Values of ``size`` bits each, one after the other, filled up with ones; a zero follows each byte of ones."""
    bits = [np.zeros(0, np.uint8)]
    for lo in range(0, len(value), 1 << 17):
        v, n = value[lo : lo + (1 << 17)], size[lo : lo + (1 << 17)]
        ends = np.cumsum(n)
        left = np.repeat(ends, n) - 1 - np.arange(int(ends[-1]))
        bits.append(((np.repeat(v, n) >> left) & 1).astype(np.uint8))
    flat = np.concatenate(bits)
    return np.packbits(np.r_[flat, np.ones(-len(flat) % 8, np.uint8)]).tobytes().replace(b"\xff", b"\xff\0")


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


def _symbols(units: np.ndarray, chroma: np.ndarray, dc: np.ndarray):
    """(table, symbol, extra bits, their number) in coding order. Tables: 0 luma DC, 1 luma AC, 2 chroma DC, 3 chroma AC."""
    n = len(units)
    bits = _bit_sizes(dc)
    rows = [(np.arange(n) * 1024, chroma * 2, bits, dc, bits)]
    own, at = np.nonzero(units[:, 1:])
    at += 1
    value = units[own, at]
    before = np.where(np.r_[False, own[1:] == own[:-1]], np.r_[0, at[:-1]], 0)
    gap = at - before - 1
    bits = _bit_sizes(value)
    key = own * 1024 + at * 8
    rows.append((key + 4, chroma[own] * 2 + 1, gap % 16 * 16 + bits, value, bits))
    for k in range(1, 4):  # sixteen zeros
        far = gap >= 16 * k
        z = np.zeros(int(far.sum()), np.int64)
        rows.append((key[far] + k - 1, chroma[own[far]] * 2 + 1, z + 0xF0, z, z))
    last = np.zeros(n, np.int64)
    np.maximum.at(last, own, at)
    short = np.flatnonzero(last < 63)
    z = np.zeros(len(short), np.int64)
    rows.append((short * 1024 + 1023, chroma[short] * 2 + 1, z, z, z))  # the end of a block
    key, table, symbol, value, bits = (np.concatenate(c) for c in zip(*rows, strict=True))
    order = np.argsort(key, kind="stable")
    extra = np.where(value < 0, value + (1 << bits) - 1, value)
    return table[order], symbol[order], extra[order], bits[order]


def encode(px: np.ndarray, quality: int = 90, subsample: int = 420, icc: bytes | None = None) -> bytes:
    """Grey or BGR bytes. Sides from 1 to 65535; alpha has to be composed away before."""
    h, w = px.shape[:2]
    px = px.reshape(h, w, -1)
    if px.shape[2] not in (1, 3) or not 0 < h < 65536 or not 0 < w < 65536:
        raise ValueError(f"JPEG holds grey and BGR images of up to 65535 by 65535, not {w} by {h} with {px.shape[2]} channels")
    grey = px.shape[2] == 1
    across, down = (1, 1) if grey else SUBSAMPLING[subsample]
    padded = np.pad(px, ((0, -h % (8 * down)), (0, -w % (8 * across)), (0, 0)), mode="edge").astype(float)
    if grey:
        planes = [padded[..., 0] - 128]
    else:
        planes = list(np.moveaxis(padded[..., ::-1] @ rgb_to_ycc(0.299, 0.114).T, 2, 0))
        planes[0] -= 128
        planes[1:] = [p.reshape(p.shape[0] // down, down, p.shape[1] // across, across).mean((1, 3)) for p in planes[1:]]
    tables = quantisers(quality)[: 1 if grey else 2]
    mcu_rows, mcu_cols = padded.shape[0] // (8 * down), padded.shape[1] // (8 * across)
    units, dc, kinds = [], [], []
    for k, plane in enumerate(planes):
        v, u = plane.shape[0] // 8 // mcu_rows, plane.shape[1] // 8 // mcu_cols
        blocks = plane.reshape(mcu_rows, v, 8, mcu_cols, u, 8).transpose(0, 3, 1, 4, 2, 5)
        q = np.rint(_DCT @ blocks @ _DCT.T / tables[min(k, 1)].reshape(8, 8)).astype(np.int64)
        q = q.reshape(mcu_rows * mcu_cols, v * u, 64)[..., _ZIGZAG]
        q[..., 1:] = np.clip(q[..., 1:], -1023, 1023)
        units.append(q)
        dc.append(np.diff(q[..., 0].ravel(), prepend=0).reshape(q.shape[:2]))
        kinds.append(np.full(q.shape[:2], min(k, 1)))
    table, symbol, extra, bits = _symbols(np.concatenate(units, 1).reshape(-1, 64), np.concatenate(kinds, 1).ravel(), np.concatenate(dc, 1).ravel())
    code, size = np.zeros((4, 256), np.int64), np.zeros((4, 256), np.int64)
    stored = b""
    for t in range(2 if grey else 4):
        found, n = np.unique(symbol[table == t], return_counts=True)
        code[t], size[t], body = _canonical(code_lengths(dict(zip(found.tolist(), n.tolist(), strict=True))))
        stored += _segment(0xC4, bytes([t % 2 << 4 | t // 2]) + body)
    head = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    if icc:
        parts = [icc[i : i + 65000] for i in range(0, len(icc), 65000)]
        head += b"".join(_segment(0xE2, b"ICC_PROFILE\0" + bytes([i + 1, len(parts)]) + p) for i, p in enumerate(parts))
    head += b"".join(_segment(0xDB, bytes([i]) + bytes(t[_ZIGZAG].tolist())) for i, t in enumerate(tables))
    comps = range(len(planes))
    head += _segment(0xC0, struct.pack(">BHHB", 8, h, w, len(planes)) + b"".join(bytes([k + 1, (across << 4 | down) if k == 0 else 0x11, min(k, 1)]) for k in comps))
    scan = _segment(0xDA, bytes([len(planes)]) + b"".join(bytes([k + 1, min(k, 1) * 0x11]) for k in comps) + b"\0\x3f\0")
    return head + stored + scan + _packed(code[table, symbol] << bits | extra, size[table, symbol] + bits) + b"\xff\xd9"


# decoding ------------------------------------------------------------------------------


def _lookup(body: bytes) -> tuple[list[int], int]:
    """For every 16 bits the code they begin with: length * 256 + symbol, 0 where there is none; and the bytes the table took."""
    counts = body[:LONGEST]
    n = sum(counts)
    lengths = np.repeat(np.arange(1, LONGEST + 1), list(counts))
    entries = np.repeat(lengths * 256 + np.frombuffer(body, np.uint8, n, LONGEST), 1 << (LONGEST - lengths))
    if len(entries) > 1 << LONGEST:
        raise ValueError("a Huffman table holds too many codes")
    return np.r_[entries, np.zeros((1 << LONGEST) - len(entries), np.int64)].tolist(), LONGEST + n


def _read_scan(data: bytes, mcus: int, units: list, restart: int, out: list[dict]) -> None:
    """Coefficients of one scan. units: for each block of an MCU (component, DC table, AC table, first blocks by MCU)."""
    parts, at = [], 0
    mark = data.find(b"\xff")
    while mark >= 0 and mark + 1 < len(data):
        if 0xD0 <= data[mark + 1] <= 0xD7:  # a restart mark
            parts.append(data[at:mark])
            at = mark + 2
        mark = data.find(b"\xff", mark + 2)
    parts.append(data[at:])
    every = restart or mcus
    for k, part in enumerate(parts):
        part = part.replace(b"\xff\0", b"\xff") + b"\xff" * 8
        acc = have = pos = 0
        before = [0] * len(out)
        for m in range(k * every, min((k + 1) * every, mcus)):
            for comp, dc, ac, where in units:
                block, store, i = int(where[m]) * 64, out[comp], 0
                while i < 64:
                    if have < 32:
                        acc = (acc & ((1 << have) - 1)) << 32 | int.from_bytes(part[pos : pos + 4].ljust(4, b"\xff"), "big")
                        pos += 4
                        have += 32
                        if pos > len(part) + 4:
                            raise ValueError("the scan ends too early")
                    hit = (ac if i else dc)[acc >> (have - 16) & 0xFFFF]
                    if not hit:
                        raise ValueError("no such Huffman code")
                    have -= hit >> 8
                    n = hit & 15
                    if i:
                        run = hit >> 4 & 15
                        if n == 0 and run < 15:
                            break
                        i += run
                    value = 0
                    if n:
                        have -= n
                        value = acc >> have & ((1 << n) - 1)
                        if value < 1 << (n - 1):
                            value -= (1 << n) - 1
                    if i == 0:
                        before[comp] += value
                        value = before[comp]
                    if value and i < 64:
                        store[block + i] = value
                    i += 1


def decode(data: bytes) -> tuple[np.ndarray, bytes | None, bytes | None]:
    """(pixels, colour profile, EXIF) of a sequential Huffman file; chroma samples are repeated, not blended."""
    at, restart, frame, adobe, exif, profile = 2, 0, None, None, None, {}
    quant: dict[int, np.ndarray] = {}
    huff: dict[int, list[int]] = {}
    coefs: list[dict] = []
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError(f"no marker at {at}")
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        if mark == 0xD9:
            break
        n = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if mark == 0xDB:
            while body:
                wide = body[0] >> 4
                table = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                quant[body[0] & 15] = table
                body = body[65 + 64 * bool(wide) :]
        elif mark == 0xC4:
            while body:
                huff[body[0]], took = _lookup(body[1:])
                body = body[1 + took :]
        elif mark in (0xC0, 0xC1):
            bits, h, w, count = struct.unpack_from(">BHHB", body)
            if bits != 8 or not h or not w:
                raise NotSequential(f"{bits} bits, {w} by {h}")
            frame = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(count)]
            wide, tall = max(c[1] for c in frame), max(c[2] for c in frame)
            cols, rows = -(-w // (8 * wide)), -(-h // (8 * tall))
            coefs = [{} for _ in frame]
        elif 0xC2 <= mark <= 0xCF and mark != 0xC8:
            raise NotSequential(f"process {mark - 0xC0}")
        elif mark == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif mark == 0xE1 and body[:6] == b"Exif\0\0":
            exif = body[6:]
        elif mark == 0xE2 and body[:12] == b"ICC_PROFILE\0":
            profile[body[12]] = body[14:]
        elif mark == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif mark == 0xDA:
            if frame is None:
                raise ValueError("a scan before the frame header")
            end = at
            while (end := data.find(b"\xff", end)) >= 0 and end + 1 < len(data) and (data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7):
                end += 2
            end = end if end >= 0 else len(data)
            names = [c[0] for c in frame]
            chosen = [(names.index(body[1 + 2 * k]), body[2 + 2 * k]) for k in range(body[0])]
            units, mcus = [], rows * cols
            for k, tables in chosen:
                _, u, v, _ = frame[k]
                if len(chosen) == 1:  # alone, a component has a block for each MCU and no padding
                    across, down = -(-(-(-w * u // wide)) // 8), -(-(-(-h * v // tall)) // 8)
                    mcus = across * down
                    m = np.arange(mcus)
                    where = [m // across * (cols * u) + m % across]
                else:
                    m = np.arange(mcus)
                    where = [(m // cols * v + y) * (cols * u) + m % cols * u + x for y in range(v) for x in range(u)]
                units += [(k, huff[tables >> 4], huff[0x10 | tables & 15], b) for b in where]
            _read_scan(data[at:end], mcus, units, restart, coefs)
            at = end
    if frame is None:
        raise ValueError("no frame header")
    planes = []
    for (_, u, v, q), found in zip(frame, coefs, strict=True):
        if wide % u or tall % v:
            raise NotSequential("fractional subsampling")
        flat = np.zeros(rows * v * cols * u * 64)
        flat[list(found.keys())] = list(found.values())
        blocks = np.zeros((rows * v * cols * u, 64))
        blocks[:, _ZIGZAG] = flat.reshape(-1, 64) * quant[q]
        blocks = _DCT.T @ blocks.reshape(rows * v, cols * u, 8, 8) @ _DCT
        plane = blocks.transpose(0, 2, 1, 3).reshape(rows * v * 8, cols * u * 8) + 128
        planes.append(np.repeat(np.repeat(plane, tall // v, 0), wide // u, 1)[:h, :w])
    if len(planes) == 3 and adobe != 0:
        ycc = np.stack([planes[0], planes[1] - 128, planes[2] - 128], 2)
        px = (ycc @ np.linalg.inv(rgb_to_ycc(0.299, 0.114)).T)[..., ::-1]
    elif len(planes) in (1, 3):
        px = np.stack(planes[::-1], 2)
    else:
        raise NotSequential(f"{len(planes)} components")
    return np.clip(np.rint(px), 0, 255).astype(np.uint8), b"".join(profile[k] for k in sorted(profile)) or None, exif
