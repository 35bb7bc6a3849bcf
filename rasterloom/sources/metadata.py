"""EXIF and colour-profile metadata."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.colour import GAMMA, PROFILES, adaptation, rgb_to_xyz

#: EXIF types by number: name, struct code.
TYPES = {1: ("byte", "B"), 2: ("ascii", "s"), 3: ("short", "H"), 4: ("long", "I"), 5: ("rational", "II"), 6: ("sbyte", "b"), 7: ("undefined", "s"), 8: ("sshort", "h"), 9: ("slong", "i"), 10: ("srational", "ii"), 11: ("float", "f"), 12: ("double", "d"), 13: ("ifd", "I"), 16: ("long8", "Q"), 17: ("slong8", "q"), 18: ("ifd8", "Q"), 129: ("utf8", "s")}
POINTERS = {0x8769: "exif", 0x8825: "gps", 0xA005: "interop"}
ORIENTATION, X_RESOLUTION, Y_RESOLUTION, UNIT, COLOUR_SPACE = 0x0112, 0x011A, 0x011B, 0x0128, 0xA001


def read_exif(data: bytes) -> list[tuple[str, int, str, int, bytes]]:
    """(directory, tag, type, count, little-endian value) of all entries. Loops and offsets that leave the data end the walk."""
    if data[:6] == b"Exif\0\0":
        data = data[6:]
    e = {b"II": "<", b"MM": ">"}.get(data[:2])
    if e is None or len(data) < 8:
        return []
    out, seen = [], set()
    todo = [("ifd0", struct.unpack_from(e + "I", data, 4)[0])]
    while todo:
        name, at = todo.pop(0)
        if at in seen or at + 2 > len(data) or at < 8:
            continue
        seen.add(at)
        (n,) = struct.unpack_from(e + "H", data, at)
        for i in range(n):
            where = at + 2 + 12 * i
            if where + 12 > len(data):
                break
            tag, kind, count = struct.unpack_from(e + "HHI", data, where)
            if kind not in TYPES:
                continue
            label, code = TYPES[kind]
            size = struct.calcsize("<" + code) * count
            start = where + 8 if size <= 4 else struct.unpack_from(e + "I", data, where + 8)[0]
            if start + size > len(data):
                continue
            raw = data[start : start + size]
            if code != "s" and e == ">":
                values = struct.unpack(e + code * count, raw)
                raw = struct.pack("<" + code * count, *values)
            out.append((name, tag, label, count, raw))
            if tag in POINTERS and label in ("long", "ifd") and count == 1:
                todo.append((POINTERS[tag], struct.unpack("<I", raw)[0]))
        follow = at + 2 + 12 * n
        if name == "ifd0" and follow + 4 <= len(data):
            todo.append(("ifd1", struct.unpack_from(e + "I", data, follow)[0]))
    return out


def write_exif(entries: list[tuple[int, str, bytes]]) -> bytes:
    """A little-endian block with one directory: (tag, type, little-endian value)."""
    kinds = {v[0]: (k, struct.calcsize("<" + v[1])) for k, v in TYPES.items()}
    entries = sorted(entries)
    at = 8 + 2 + 12 * len(entries) + 4
    head, tail = struct.pack("<2sHIH", b"II", 42, 8, len(entries)), b""
    for tag, label, raw in entries:
        kind, size = kinds[label]
        head += struct.pack("<HHI", tag, kind, len(raw) // size)
        if len(raw) <= 4:
            head += raw.ljust(4, b"\0")
        else:
            head += struct.pack("<I", at + len(tail))
            tail += raw + b"\0" * (len(raw) % 2)
    return head + b"\0\0\0\0" + tail


def number(entries, tag: int, default: float | None = None) -> float | None:
    """The first number of a tag, as a float."""
    for _, t, label, count, raw in entries:
        if t == tag and count:
            code = next(c for n, c in TYPES.values() if n == label)
            if code == "s":
                return default
            v = struct.unpack_from("<" + code, raw)
            return float(v[0]) if len(v) == 1 else v[0] / v[1] if v[1] else default
    return default


def orientation(entries) -> int:
    """1-8; anything else is upright."""
    o = number(entries, ORIENTATION, 1)
    return int(o) if o in range(1, 9) else 1


def to_dpi(value: Column, unit: Column) -> Column:
    """unit: inch, centimeter, meter, or anything else for a multiple of 96."""
    return F.when(unit == "inch", value).when(unit == "centimeter", value * 2.54).when(unit == "meter", value / 39.37).otherwise(value * 96.0)


def to_dpm(value: Column, unit: Column) -> Column:
    return F.when(unit == "inch", value * 39.37).when(unit == "centimeter", value * 100.0).when(unit == "meter", value).otherwise(value * 3779.53)


def copied(mode_orientation: str, mode_profile: str) -> list[str]:
    """Which metadata a result keeps: resolution always, orientation only when preserved, the profile by mode."""
    out = ["resolution"]
    if mode_orientation == "preserve":
        out.append("orientation")
    if mode_profile in ("preserve", "normalizeandembed"):
        out.append("profile")
    return out


class UnsupportedProfile(Exception):
    """The profile needs a colour management module (tables, CMYK)."""


def _s15(data: bytes, at: int) -> float:
    return struct.unpack_from(">i", data, at)[0] / 65536


def read_profile(data: bytes) -> dict:
    """A version 2 or 4 matrix or grey profile: space, version, matrix (RGB to XYZ D50), curves as functions' parameters."""
    if len(data) < 132 or data[36:40] != b"acsp":
        raise ValueError("not a colour profile")
    space, version = data[16:20].decode().strip(), data[8]
    tags = {}
    (n,) = struct.unpack_from(">I", data, 128)
    for i in range(n):
        name, at, size = struct.unpack_from(">4sII", data, 132 + 12 * i)
        tags[name.decode("latin-1")] = data[at : at + size]
    if space not in ("RGB", "GRAY"):
        raise UnsupportedProfile(space)
    out = {"space": space, "version": version, "curves": []}
    if space == "GRAY":
        out["curves"] = [read_curve(tags["kTRC"])] if "kTRC" in tags else []
        return out
    if not {"rXYZ", "gXYZ", "bXYZ"} <= tags.keys():
        raise UnsupportedProfile("tables only")
    out["matrix"] = np.array([[_s15(tags[f"{c}XYZ"], 8 + 4 * k) for c in "rgb"] for k in range(3)])
    out["curves"] = [read_curve(tags[f"{c}TRC"]) for c in "rgb"]
    return out


def read_curve(tag: bytes) -> tuple[str, list[float]]:
    """('gamma', [g]), ('table', points) or ('para0'..'para4', parameters)."""
    if tag[:4] == b"curv":
        (n,) = struct.unpack_from(">I", tag, 8)
        if n == 0:
            return "gamma", [1.0]
        values = struct.unpack_from(f">{n}H", tag, 12)
        return ("gamma", [values[0] / 256]) if n == 1 else ("table", [v / 65535 for v in values])
    if tag[:4] == b"para":
        (kind,) = struct.unpack_from(">H", tag, 8)
        if kind > 4:
            raise ValueError(f"parametric curve {kind}")
        return f"para{kind}", [_s15(tag, 12 + 4 * i) for i in range((1, 3, 4, 5, 7)[kind])]
    raise ValueError(f"curve {tag[:4]!r}")


def apply_curve(curve: tuple[str, list[float]], x: np.ndarray) -> np.ndarray:
    """Device value 0-1 to linear light."""
    kind, p = curve
    if kind == "gamma":
        return x ** p[0]
    if kind == "table":
        return np.interp(x, np.linspace(0, 1, len(p)), p)
    g, a, b, c, d, e, f = (*p, *[0.0] * (7 - len(p)))[:7]
    up = lambda: np.maximum(a * x + b, 0) ** g
    if kind == "para0":
        return x**g
    if kind == "para1":
        return np.where(x >= -b / a, up(), 0)
    if kind == "para2":
        return np.where(x >= -b / a, up() + c, c)
    if kind == "para3":
        return np.where(x >= d, up(), c * x)
    return np.where(x >= d, up() + e, c * x + f)


def source_profile(icc: bytes | None, exif: bytes | None, gamma: int | None = None, chroma: tuple[float, ...] | None = None) -> dict | None:
    """The profile that a file's metadata name: its own, Adobe RGB by EXIF, or one made of gamma and chromaticities; None is sRGB. Profiles of tables raise UnsupportedProfile."""
    if icc:
        return read_profile(icc)
    entries = read_exif(exif) if exif else []
    space = number([e for e in entries if e[0] == "exif"], COLOUR_SPACE, 1)
    index = next((raw for name, tag, *_, raw in entries if name == "interop" and tag == 1), b"")
    if space == 2 or (space == 65535 and index[:3] == b"R03"):
        return {"space": "RGB", "matrix": PROFILES["adobergb"], "curves": [("gamma", [GAMMA["adobergb"]])] * 3}
    if gamma or chroma:
        matrix = PROFILES["srgb"]
        if chroma:
            white, *primaries = [(x / y, 1.0, (1 - x - y) / y) for x, y in zip(chroma[::2], chroma[1::2], strict=True)]
            matrix = adaptation(white) @ rgb_to_xyz(*primaries, white)
        curve = ("gamma", [100_000 / gamma]) if gamma else ("para3", [2.4, 1 / 1.055, 0.055 / 1.055, 1 / 12.92, 0.04045])
        return {"space": "RGB", "matrix": matrix, "curves": [curve] * 3}
    return None


def to_srgb(px: np.ndarray, profile: dict | None) -> np.ndarray:
    """Bytes (h, w, 1, 3 or 4; BGR(A)) in a matrix or grey profile as sRGB; alpha stays."""
    if profile is None or not profile["curves"] or (profile["space"] == "GRAY") != (px.shape[2] == 1):
        return px
    level = np.arange(256) / 255
    tables = [np.clip(apply_curve(c, level), 0, 1) for c in profile["curves"]]
    if px.shape[2] == 1:
        light = tables[0][px]
    else:
        light = np.stack([tables[k][px[..., 2 - k]] for k in range(3)], -1) @ (np.linalg.inv(PROFILES["srgb"]) @ profile["matrix"]).T
    light = np.clip(light, 0, 1)
    out = np.floor(np.where(light <= 0.04045 / 12.92, light * 12.92, 1.055 * light ** (1 / 2.4) - 0.055) * 255 + 0.5).astype(np.uint8)
    return out if px.shape[2] == 1 else np.concatenate([out[..., ::-1], px[..., 3:]], 2)


def target_profile(space: Column, wide: Column, mode: Column) -> Column:
    """What pixels are normalised to: grey stays grey, wide gamuts go to Display P3, the rest to sRGB; ``ignore`` and ``preserve`` change nothing."""
    return F.when(mode.isin("ignore", "preserve"), None).when(space == "GRAY", "sgrey").when(wide & (mode != "converttosrgb"), "displayp3").otherwise("srgb")
