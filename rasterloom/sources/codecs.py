"""Containers in plain Python and numpy: PNG/APNG, GIF, BMP, TGA, TIFF, JPEG; and a registry for more.

decode(bytes) gives frames, each (height, width, channels) bytes in BGR(A) or grey order;
encode(frame) gives bytes. Formats whose libraries are not at hand are registered and raise.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from . import jpeg


@dataclass
class Frame:
    """pixels: height, width, channels (1 grey, 3 BGR, 4 BGRA)."""

    pixels: np.ndarray
    left: int = 0
    top: int = 0
    duration: tuple[int, int] = (0, 1)  # seconds, as a fraction
    disposal: int = 0
    blend: int = 0
    orientation: int = 1  # of a page with a directory of its own


@dataclass
class Image:
    mime: str
    frames: list[Frame]
    width: int
    height: int
    loop: int = 0
    background: int = 0
    icc: bytes | None = None
    exif: bytes | None = None
    gamma: int | None = None
    chroma: tuple[float, ...] | None = None  # x and y of white, red, green and blue
    notes: dict = field(default_factory=dict)


class Unsupported(Exception):
    """The format is known, but no codec for it is at hand."""


# PNG ---------------------------------------------------------------------------------

_PNG = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def png_chunks(data: bytes):
    if data[:8] != _PNG:
        raise ValueError("not a PNG")
    at = 8
    while at + 12 <= len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(body) < n or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError(f"chunk {kind!r} is damaged")
        yield kind, body
        at += 12 + n


def _wave(lines: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Undo filters of any kind, all rows at once: a pixel needs those left, above and between, so pixels with one sum of row and column can go together."""
    h, stride = lines.shape
    w = stride // step
    px = np.zeros((h + 1, w + 1, step), np.int16)  # with a row and a column of zeros before
    px[1:, 1:] = lines.reshape(h, w, step)
    kinds = kinds[:, None]
    for t in range(h + w - 1):
        y = np.arange(max(0, t - w + 1), min(h, t + 1))
        x = t - y
        left, above, corner, k = px[y + 1, x], px[y, x + 1], px[y, x], kinds[y]
        da, db, dc = np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)
        near = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, above, corner))
        guess = np.where(k == 4, near, np.where(k == 3, (left + above) >> 1, np.where(k == 2, above, np.where(k == 1, left, 0))))
        px[y + 1, x + 1] = (px[y + 1, x + 1] + guess) & 255
    return px[1:, 1:].reshape(h, stride).astype(np.uint8)


def _unfilter(raw: bytes, rows: int, stride: int, step: int) -> tuple[np.ndarray, int]:
    table = np.frombuffer(raw, np.uint8, rows * (stride + 1)).reshape(rows, stride + 1)
    if (table[:, 0] > 2).any():
        if (table[:, 0] > 4).any():
            raise ValueError(f"filter {table[:, 0].max()}")
        return _wave(table[:, 1:], table[:, 0], step), rows * (stride + 1)
    out = np.zeros((rows, stride), np.uint8)
    above, at = np.zeros(stride, np.int64), 0
    for y in range(rows):
        kind, line = raw[at], np.frombuffer(raw, np.uint8, stride, at + 1).astype(np.int64)
        at += 1 + stride
        if kind == 2:
            line = (line + above) & 255
        elif kind == 1:
            for s in range(step):
                line[s::step] = np.cumsum(line[s::step]) & 255
        out[y], above = line, line
    return out, at


def _samples(rows: np.ndarray, width: int, depth: int, channels: int) -> np.ndarray:
    if depth == 8:
        return rows.reshape(len(rows), width, channels)
    if depth == 16:
        return rows.reshape(len(rows), width, channels, 2)[..., 0]
    bits = np.unpackbits(rows, axis=1).reshape(len(rows), -1, depth)
    values = bits @ (1 << np.arange(depth - 1, -1, -1))
    return values[:, : width * channels].reshape(len(rows), width, channels).astype(np.uint8)


#: Fixed values of interlacing: first column and row, and the steps, of each pass.
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _png_pixels(raw: bytes, w: int, h: int, depth: int, kind: int, interlaced: int) -> np.ndarray:
    ch = _CHANNELS[kind]
    step = max(1, depth * ch // 8)
    if not interlaced:
        return _samples(_unfilter(raw, h, -(-w * ch * depth // 8), step)[0], w, depth, ch)
    out, at = np.zeros((h, w, ch), np.uint8), 0
    for x0, y0, dx, dy in _PASSES:
        pw, ph = -(-(w - x0) // dx), -(-(h - y0) // dy)
        if pw > 0 and ph > 0:
            rows, n = _unfilter(raw[at:], ph, -(-pw * ch * depth // 8), step)
            at += n
            out[y0::dy, x0::dx] = _samples(rows, pw, depth, ch)
    return out


def decode_png(data: bytes) -> Image:
    plte = trns = icc = exif = gamma = chroma = None
    parts: list[tuple[dict | None, bytearray]] = []
    loop = 0
    for kind, body in png_chunks(data):
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            plte = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            trns = body
        elif kind == b"gAMA":
            (gamma,) = struct.unpack(">I", body)
        elif kind == b"cHRM":
            chroma = tuple(v / 100_000 for v in struct.unpack(">8I", body))
        elif kind == b"iCCP":
            icc = zlib.decompress(body[body.index(0) + 2 :])
        elif kind == b"eXIf":
            exif = body
        elif kind == b"acTL":
            loop = struct.unpack(">II", body)[1]
        elif kind == b"fcTL":
            _, fw, fh, left, top, num, den, dispose, blend = struct.unpack(">IIIIIHHBB", body)
            parts.append(({"w": fw, "h": fh, "left": left, "top": top, "num": num, "den": den or 100, "dispose": dispose, "blend": blend}, bytearray()))
        elif kind == b"IDAT":
            if not parts:
                parts.append((None, bytearray()))
            parts[0 if parts[0][0] is None else -1][1].extend(body)
        elif kind == b"fdAT":
            parts[-1][1].extend(body[4:])
    frames = []
    for info, packed in parts:
        if info is None and len(parts) > 1:
            continue  # a still image that is no frame of the animation
        fw, fh = (info["w"], info["h"]) if info else (w, h)
        px = _png_pixels(zlib.decompress(bytes(packed)), fw, fh, depth, colour, interlaced)
        if colour == 3:
            table = np.full((256, 4), 255, np.uint8)
            table[: len(plte), :3] = plte[:, ::-1]
            if trns:
                table[: len(trns), 3] = np.frombuffer(trns, np.uint8)
            px = table[px[..., 0]]
            px = px if trns else px[..., :3]
        elif depth < 8:
            px = (px.astype(int) * 255 // ((1 << depth) - 1)).astype(np.uint8)
        if colour == 4:
            px = np.concatenate([px[..., :1]] * 3 + [px[..., 1:]], axis=2)
        elif colour in (2, 6):
            px = np.concatenate([px[..., 2::-1], px[..., 3:]], axis=2)
        frames.append(Frame(px, **({"left": info["left"], "top": info["top"], "duration": (info["num"], info["den"]), "disposal": info["dispose"] + 1, "blend": info["blend"]} if info else {})))
    return Image("image/png", frames, w, h, loop, icc=icc, exif=exif, gamma=gamma, chroma=chroma)


def _png_chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _filtered(px: np.ndarray, code: int) -> bytes:
    """Rows of RGB(A), grey or indices, each behind the number of its filter."""
    h, w, ch = px.shape
    rows = px.reshape(h, w * ch).astype(np.int16)
    left, above = np.zeros_like(rows), np.zeros_like(rows)
    left[:, ch:], above[1:] = rows[:, :-ch], rows[:-1]
    corner = np.zeros_like(rows)
    corner[1:, ch:] = rows[:-1, :-ch]
    if code == 4:
        da, db, dc = np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)
        guess = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, above, corner))
    else:
        guess = (0, left, above, (left + above) >> 1)[code]
    return np.concatenate([np.full((h, 1), code, np.uint8), ((rows - guess) & 255).astype(np.uint8)], axis=1).tobytes()


def _packed(px: np.ndarray, code: int, interlaced: bool, level: int) -> bytes:
    """The compressed samples of one image or frame of BGR(A), grey or indices."""
    px = px.reshape(*px.shape[:2], -1)
    rgb = px if px.shape[2] == 1 else np.concatenate([px[..., 2::-1], px[..., 3:]], axis=2)
    parts = [rgb[y::dy, x::dx] for x, y, dx, dy in _PASSES] if interlaced else [rgb]
    return zlib.compress(b"".join(_filtered(p, code) for p in parts if p.size), level)


def encode_apng(frames: list[Frame], size: tuple[int, int], loop: int = 0, level: int = 6) -> bytes:
    """An animation of BGR or BGRA frames, all of the same channels; the first fills the screen."""
    kind = {3: 2, 4: 6}[frames[0].pixels.shape[2]]
    out = [_PNG, _png_chunk(b"IHDR", struct.pack(">IIBBBBB", *size, 8, kind, 0, 0, 0)), _png_chunk(b"acTL", struct.pack(">II", len(frames), loop))]
    number = 0
    for i, f in enumerate(frames):
        h, w = f.pixels.shape[:2]
        out.append(_png_chunk(b"fcTL", struct.pack(">IIIIIHHBB", number, w, h, f.left, f.top, *f.duration, max(0, f.disposal - 1), f.blend)))
        body, number = _packed(f.pixels, 2, False, level), number + 1
        out.append(_png_chunk(b"IDAT", body) if i == 0 else _png_chunk(b"fdAT", struct.pack(">I", number) + body))
        number += i > 0
    return b"".join([*out, _png_chunk(b"IEND", b"")])


def encode_png(px: np.ndarray, palette: np.ndarray | None = None, icc: bytes | None = None, level: int = 6, filter_kind: str = "up", interlaced: bool = False) -> bytes:
    """Grey, BGR or BGRA; with ``palette`` (n, 3 or 4; BGR(A)), px holds indices. filter_kind: none, sub, up, average or paeth."""
    h, w = px.shape[:2]
    px = px.reshape(h, w, -1)
    kind = 3 if palette is not None else {1: 0, 3: 2, 4: 6}[px.shape[2]]
    code = 0 if kind == 3 else ("none", "sub", "up", "average", "paeth").index(filter_kind)
    body = [_PNG, _png_chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, int(interlaced)))]
    if icc:
        body.append(_png_chunk(b"iCCP", b"profile\0\0" + zlib.compress(icc)))
    if palette is not None:
        body.append(_png_chunk(b"PLTE", palette[:, 2::-1].astype(np.uint8).tobytes()))
        if palette.shape[1] == 4:
            body.append(_png_chunk(b"tRNS", palette[:, 3].astype(np.uint8).tobytes()))
    return b"".join([*body, _png_chunk(b"IDAT", _packed(px, code, interlaced, level)), _png_chunk(b"IEND", b"")])


# GIF ---------------------------------------------------------------------------------


def lzw_unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    clear, end = 1 << bits, (1 << bits) + 1
    table: list[bytes] = []
    out, width, last = bytearray(), bits + 1, b""
    hold = have = 0
    for byte in data:
        hold |= byte << have
        have += 8
        while have >= width:
            code = hold & ((1 << width) - 1)
            hold >>= width
            have -= width
            if code == clear:
                table = [bytes([i]) for i in range(clear)] + [b"", b""]
                width, last = bits + 1, b""
                continue
            if code == end or len(out) >= count:
                return np.frombuffer(bytes(out[:count]), np.uint8)
            if not table:
                raise ValueError("no clear code first")
            if code < len(table):
                entry = table[code]
            elif code == len(table) and last:
                entry = last + last[:1]
            else:
                raise ValueError("code out of range")
            out += entry
            if last and len(table) < 4096:
                table.append(last + entry[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            last = entry
    return np.frombuffer(bytes(out[:count]), np.uint8)


def lzw_pack(values: bytes, bits: int) -> bytes:
    clear, end = 1 << bits, (1 << bits) + 1
    out, hold, have, width = bytearray(), 0, 0, bits + 1

    def put(code: int) -> None:
        nonlocal hold, have
        hold |= code << have
        have += width
        while have >= 8:
            out.append(hold & 255)
            hold >>= 8
            have -= 8

    put(clear)
    table = {bytes([i]): i for i in range(clear)}
    following, run = end + 1, b""
    for v in values:
        longer = run + bytes([v])
        if longer in table:
            run = longer
            continue
        put(table[run])
        if following < 4096:
            table[longer] = following
            if following == 1 << width and width < 12:
                width += 1
            following += 1
        else:
            put(clear)
            table, following, width = {bytes([i]): i for i in range(clear)}, end + 1, bits + 1
        run = bytes([v])
    if run:
        put(table[run])
        if following == 1 << width and width < 12:
            width += 1
    put(end)
    if have:
        out.append(hold & 255)
    return bytes(out)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = bytearray()
    while data[at]:
        out += data[at + 1 : at + 1 + data[at]]
        at += 1 + data[at]
    return bytes(out), at + 1


def _colours(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 2 << (flags & 7)
    return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n


def gif_blocks(data: bytes) -> tuple[Image, list[tuple]]:
    """The screen without frames, and of each frame its place and size, its flags, colours, code bits, packed pixels, delay, disposal and clear index."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    w, h, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    shared, at = _colours(data, 13, flags)
    image, frames = Image("image/gif", [], w, h, 1, background), []
    delay, disposal, clear = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = _blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, struct.unpack_from("<H", body, 1)[0]
                clear = body[3] if body[0] & 1 else None
            elif label == 0xFF and body[:11] == b"NETSCAPE2.0" and len(body) >= 14:
                image.loop = struct.unpack_from("<H", body, 12)[0]
        elif data[at] == 0x2C:
            left, top, fw, fh, ff = struct.unpack_from("<HHHHB", data, at + 1)
            own, at = _colours(data, at + 10, ff)
            bits = data[at]
            packed, at = _blocks(data, at + 1)
            frames.append((left, top, fw, fh, ff, own if own is not None else shared, bits, packed, delay, disposal, clear))
            delay, disposal, clear = 0, 0, None
        else:
            raise ValueError(f"block {data[at]:#x}")
    return image, frames


def decode_gif(data: bytes) -> Image:
    image, frames = gif_blocks(data)
    for left, top, fw, fh, ff, colours, bits, packed, delay, disposal, clear in frames:
        idx = lzw_unpack(packed, bits, fw * fh)
        idx = np.r_[idx, np.zeros(fw * fh - len(idx), np.uint8)].reshape(fh, fw)
        if ff & 0x40:
            order = np.r_[0:fh:8, 4:fh:8, 2:fh:4, 1:fh:2]
            still = np.empty_like(idx)
            still[order] = idx
            idx = still
        table = np.zeros((256, 4), np.uint8)
        if colours is not None:
            table[: len(colours), :3], table[: len(colours), 3] = colours[:, ::-1], 255
        if clear is not None:
            table[clear] = 0
        px = table[idx]
        image.frames.append(Frame(px if clear is not None else px[..., :3], left, top, (delay, 100), disposal))
    return image


def encode_gif(frames: list[tuple[np.ndarray, int, int]], palette: np.ndarray, size: tuple[int, int], loop: int = 0, delay: int = 10, clear: int | None = None, disposal: int = 1) -> bytes:
    """frames: indices, left, top, and a delay if not all have the same; one palette (n, 3; BGR) for all; delay in hundredths."""
    bits = max(2, (len(palette) - 1).bit_length())
    table = np.zeros((1 << bits, 3), np.uint8)
    table[: len(palette)] = palette[:, 2::-1]
    out = [b"GIF89a" + struct.pack("<HHBBB", *size, 0xF0 | (bits - 1), 0, 0), table.tobytes()]
    if len(frames) > 1:
        out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", loop) + b"\0")
    for idx, left, top, *own in frames:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), own[0] if own else delay, clear or 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", left, top, idx.shape[1], idx.shape[0], 0) + bytes([bits]))
        packed = lzw_pack(idx.astype(np.uint8).tobytes(), bits)
        out += [bytes([len(packed[i : i + 255])]) + packed[i : i + 255] for i in range(0, len(packed), 255)] + [b"\0"]
    return b"".join([*out, b"\x3b"])


# BMP, TGA, TIFF ------------------------------------------------------------------------


def decode_bmp(data: bytes) -> Image:
    at, head, w, h, _, bpp, packing = struct.unpack_from("<I", data, 10) + struct.unpack_from("<IiiHHI", data, 14)
    if packing not in (0, 3) or bpp not in (8, 24, 32):
        raise Unsupported(f"BMP with {bpp} bits, compression {packing}")
    stride = (w * bpp // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), at).reshape(abs(h), stride)[:, : w * bpp // 8]
    px = rows.reshape(abs(h), w, bpp // 8)
    if bpp == 8:
        n = (at - 14 - head) // 4
        px = np.frombuffer(data, np.uint8, 4 * n, 14 + head).reshape(n, 4)[px[..., 0], :3]
    return Image("image/bmp", [Frame(np.ascontiguousarray(px[::-1] if h > 0 else px))], w, abs(h))


def encode_bmp(px: np.ndarray) -> bytes:
    h, w = px.shape[:2]
    px = px.reshape(h, w, -1)
    px = np.repeat(px, 3, axis=2) if px.shape[2] == 1 else px
    bpp = 8 * px.shape[2]
    stride = (w * px.shape[2] + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : w * px.shape[2]] = px[::-1].reshape(h, -1)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, bpp, 0, rows.size, 3780, 3780, 0, 0) + rows.tobytes()


def decode_tga(data: bytes) -> Image:
    ident, mapped, kind, _, entries, depth, _, _, w, h, bpp, flags = struct.unpack_from("<BBBHHBHHHHBB", data)
    at, n = 18 + ident, bpp // 8
    table = None
    if mapped:
        table = np.frombuffer(data, np.uint8, entries * depth // 8, at).reshape(entries, depth // 8)
        at += table.size
    if kind not in (1, 2, 3, 9, 10, 11) or bpp not in (8, 24, 32):
        raise Unsupported(f"TGA kind {kind}, {bpp} bits")
    if kind < 8:
        flat = np.frombuffer(data, np.uint8, w * h * n, at)
    else:
        out = bytearray()
        while len(out) < w * h * n:
            count = (data[at] & 127) + 1
            if data[at] & 128:
                out += data[at + 1 : at + 1 + n] * count
                at += 1 + n
            else:
                out += data[at + 1 : at + 1 + n * count]
                at += 1 + n * count
        flat = np.frombuffer(bytes(out[: w * h * n]), np.uint8)
    px = flat.reshape(h, w, n)
    if table is not None and kind in (1, 9):
        px = table[px[..., 0]]
    px = px if flags & 0x20 else px[::-1]
    return Image("image/x-tga", [Frame(np.ascontiguousarray(px[:, ::-1] if flags & 0x10 else px))], w, h)


def encode_tga(px: np.ndarray, rle: bool = False) -> bytes:
    h, w = px.shape[:2]
    px = px.reshape(h, w, -1).astype(np.uint8)
    n = px.shape[2]
    kind = (3 if n == 1 else 2) + 8 * rle
    head = struct.pack("<BBBHHBHHHHBB", 0, 0, kind, 0, 0, 0, 0, 0, w, h, 8 * n, 0x20 | (8 if n == 4 else 0))
    if not rle:
        return head + px.tobytes()
    out = bytearray()
    for row in px:
        x = 0
        while x < w:
            run = 1
            while run < 128 and x + run < w and (row[x + run] == row[x]).all():
                run += 1
            if run > 1:
                out += bytes([127 + run]) + row[x].tobytes()
            else:
                while x + run < w and run < 128 and not (x + run + 1 < w and (row[x + run] == row[x + run + 1]).all()):
                    run += 1
                out += bytes([run - 1]) + row[x : x + run].tobytes()
            x += run
    return head + bytes(out)


def tiff_pages(data: bytes) -> list[dict[int, tuple]]:
    """The numbers of each page's tags."""
    e = {b"II": "<", b"MM": ">"}[data[:2]]
    (at,) = struct.unpack_from(e + "I", data, 4)
    pages, seen = [], set()
    while at and at not in seen:
        seen.add(at)
        tags = {}
        (n,) = struct.unpack_from(e + "H", data, at)
        for i in range(n):
            tag, kind, count = struct.unpack_from(e + "HHI", data, at + 2 + 12 * i)
            size, code = {1: (1, "B"), 3: (2, "H"), 4: (4, "I")}.get(kind, (0, ""))
            if size:
                where = at + 10 + 12 * i if size * count <= 4 else struct.unpack_from(e + "I", data, at + 10 + 12 * i)[0]
                tags[tag] = struct.unpack_from(e + code * count, data, where)
        pages.append(tags)
        follow = at + 2 + 12 * n
        at = struct.unpack_from(e + "I", data, follow)[0] if follow + 4 <= len(data) else 0
    return pages


def decode_tiff(data: bytes) -> Image:
    """Uncompressed strips, 8 bits a sample: grey, RGB or RGBA. Each page is a frame."""
    frames = []
    for tags in tiff_pages(data):
        if tags.get(259, (1,))[0] != 1 or set(tags.get(258, (8,))) != {8}:
            raise Unsupported("TIFF that is compressed or hasn't 8 bits a sample")
        w, h, ch = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
        flat = b"".join(data[o : o + c] for o, c in zip(tags[273], tags[279], strict=True))
        px = np.frombuffer(flat, np.uint8, w * h * ch).reshape(h, w, ch)
        if tags.get(262, (1,))[0] == 0:
            px = 255 - px
        frames.append(Frame(np.concatenate([px[..., 2::-1], px[..., 3:]], axis=2) if ch >= 3 else px, orientation=tags.get(274, (1,))[0]))
    return Image("image/tiff", frames, frames[0].pixels.shape[1], frames[0].pixels.shape[0])


def encode_tiff(px: np.ndarray, orientation: int = 1) -> bytes:
    h, w = px.shape[:2]
    px = px.reshape(h, w, -1)
    ch = px.shape[2]
    body = (np.concatenate([px[..., 2::-1], px[..., 3:]], axis=2) if ch >= 3 else px).astype(np.uint8).tobytes()
    depth = struct.pack("<" + "H" * ch, *[8] * ch)
    start = 8 + len(depth) + len(depth) % 2
    # for three and more channels the value of tag 258 is the offset of the depths, which is 8 too
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, ch, 8), (259, 3, 1, 1), (262, 3, 1, 1 if ch == 1 else 2), (273, 4, 1, start), (274, 3, 1, orientation), (277, 3, 1, ch), (278, 4, 1, h), (279, 4, 1, len(body))]
    entries = b"".join(struct.pack("<HHII", *t) for t in tags)
    return b"II*\0" + struct.pack("<I", start + len(body)) + depth + b"\0" * (len(depth) % 2) + body + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0)


# Registry ------------------------------------------------------------------------------


def decode_jpeg(data: bytes) -> Image:
    """Sequential files only; progressive ones raise Unsupported and can be read through Spark's image source."""
    try:
        px, icc, exif = jpeg.decode(data)
    except jpeg.NotSequential as e:
        raise Unsupported(f"JPEG: {e}") from e
    return Image("image/jpeg", [Frame(px)], px.shape[1], px.shape[0], icc=icc, exif=exif)


def _absent(name: str) -> Callable:
    def run(*_, **__):
        raise Unsupported(f"{name}: no library for it is at hand")

    return run


DECODERS: dict[str, Callable[[bytes], Image]] = {"png": decode_png, "gif": decode_gif, "bmp": decode_bmp, "tga": decode_tga, "tiff": decode_tiff, "jpeg": decode_jpeg, **{k: _absent(k) for k in ("webp", "jxl", "heif", "avif")}}
ENCODERS: dict[str, Callable] = {"png": encode_png, "gif": encode_gif, "bmp": encode_bmp, "tga": encode_tga, "tiff": encode_tiff, "jpeg": jpeg.encode, **{k: _absent(k) for k in ("webp", "jxl")}}


def register(name: str, decode: Callable | None = None, encode: Callable | None = None) -> None:
    """Add a codec or replace one."""
    if decode:
        DECODERS[name] = decode
    if encode:
        ENCODERS[name] = encode
