"""Whole images: formats written and read back, palettes, animations, profiles, headers, damaged files."""

import hashlib
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import colour as curves
from rasterloom.functions import numbers
from rasterloom.operators import geometry, palette
from rasterloom.plans import formats, process, requests
from rasterloom.sources import codecs, images, jpeg, metadata

rng = np.random.default_rng(2)
PX = rng.integers(0, 256, (37, 53, 3), dtype=np.uint8)


@pytest.mark.parametrize("kind", ["none", "sub", "up", "average", "paeth"])
@pytest.mark.parametrize("interlaced", [False, True])
def test_png_filters(kind, interlaced):
    for px in (PX, PX[..., :1], np.concatenate([PX, PX[..., :1]], 2), PX[:1, :1]):
        assert (codecs.decode_png(codecs.encode_png(px, filter_kind=kind, interlaced=interlaced)).frames[0].pixels == px).all()


def test_apng():
    frames = [codecs.Frame(PX, 0, 0, (1, 10), 1, 0), codecs.Frame(PX[5:20, 3:30].copy(), 3, 5, (3, 10), 2, 0)]
    back = codecs.decode_png(codecs.encode_apng(frames, (53, 37), loop=4))
    assert back.loop == 4 and [(f.left, f.top, f.duration, f.disposal) for f in back.frames] == [(0, 0, (1, 10), 1), (3, 5, (3, 10), 2)]
    assert all((a.pixels == b.pixels).all() for a, b in zip(back.frames, frames, strict=True))


def test_to_pixels_is_linear(spark):
    """A strip of 64 rows by 1000 pixels, and one of 4000, by position."""
    took = []
    for width in (1000, 4000):
        px = rng.integers(0, 256, (64, width, 3), dtype=np.uint8)
        df = spark.createDataFrame([(1, 0, "all", 128, 64, width, "Bgr24", bytearray(px.tobytes()))], "image_id long, frame_no int, plane string, y0 int, rows int, width int, fmt string, data binary")
        began = time.perf_counter()
        got = images.to_pixels(df).toPandas()
        took.append(time.perf_counter() - began)
        out = np.zeros_like(px)
        out[got.y - 128, got.x] = got[["b", "g", "r"]].to_numpy()
        assert (out == px).all() and got.a.isna().all()
    assert took[1] < 20


def test_pad_makes_the_border_only(spark):
    px = spark.createDataFrame([(1, 0, 0, 9)], "id long, y int, x int, v int")
    out = geometry.pad(px, ["id"], 1, 1, 0, 32767, 1, 0, {"v": 7})
    assert out.count() == 32768 * 2 and out.where("v = 9").count() == 1 and geometry.pad(px, ["id"], 1, 1, 0, 0, 0, 0, {"v": 7}).collect() == px.collect()


def test_dither_by_definition():
    """Error diffusion, pixel by pixel in plain numbers."""
    pal = np.array([(0, 0, 0), (255, 255, 255), (30, 120, 210)])
    img = np.concatenate([PX[:9, :11], np.full((2, 11, 3), 77, np.uint8)])
    errors = {}
    want = np.zeros(img.shape[:2], int)
    for y in range(img.shape[0]):
        carry, last = (0, 0, 0), None
        for x in range(img.shape[1]):
            c = tuple(min(max(int(img[y, x, k]) * 16 + errors.get((y, x), (0, 0, 0))[k] + 7 * carry[k] + 7, 0), 4095) >> 4 for k in range(3))
            if c == last:
                want[y, x], carry = want[y, x - 1], (0, 0, 0)
                continue
            far = [(r - c[2]) ** 2 * (1024 + r + c[2]) + (g - c[1]) ** 2 * 2048 + (b - c[0]) ** 2 * (1536 - r - c[2]) for b, g, r in pal.tolist()]
            want[y, x], last = far.index(min(far)), c
            carry = tuple(c[k] - int(pal[want[y, x]][k]) for k in range(3))
            for dx, part in ((-1, 2), (0, 4), (1, 1)):
                old = errors.get((y + 1, x + dx), (0, 0, 0))
                errors[y + 1, x + dx] = tuple(old[k] + part * carry[k] for k in range(3))
    assert (palette.diffuse(img, pal) == want).all()


def test_quantize():
    (idx,), colours, clear = palette.quantize([PX[..., :1]])
    assert (colours[idx][..., 0] == PX[..., 0]).all() and clear is None  # grey keeps its levels
    few = PX // 128 * 100
    (idx,), colours, clear = palette.quantize([few])
    assert len(colours) <= 8 and (colours[idx] == few).all()
    (idx,), colours, clear = palette.quantize([PX], 16)
    assert len(colours) == 16 and idx.max() < 16
    given = np.array([(0, 0, 0), (255, 255, 255)], np.uint8)
    (idx,), colours, _ = palette.quantize([PX], palette=given, dither="none")
    assert (colours == given).all() and (idx[0, 0] == np.argmin(palette.distances(given.astype(int), PX[0, 0].astype(int)))).all()
    soft = np.concatenate([few, np.where(few[..., :1] > 0, 255, 84).astype(np.uint8)], 2)
    (idx,), colours, clear = palette.quantize([soft])
    assert ((idx == clear) == (soft[..., 3] < 85)).all() and colours[clear, 3] == 0


def test_palette_like_the_histogram(spark):
    """The palette of whole images is that of the grouped histogram."""
    px = spark.createDataFrame([(1, *map(int, p)) for p in PX.reshape(-1, 3)], "id long, b int, g int, r int")
    want = palette.reduce_palette(palette.histogram(px, ["id"]), ["id"], 40).orderBy("idx").collect()
    got, exact = palette.colours_of(PX.reshape(-1, 3), 40)
    assert not exact and sorted(map(tuple, got.tolist())) == sorted((r.b, r.g, r.r) for r in want)


def test_animation(spark):
    y, x = np.mgrid[0:40, 0:60]
    frames = [np.stack([x // 16 * 60, y // 16 * 60, np.full_like(x, 60 * i)], 2).astype(np.uint8) for i in range(3)] * 2
    frames[4] = frames[3]
    made = process.animation(frames, [3, 4, 5, 6, 7, 8], formats.AnimationOptions(denoise=False, loop=2))
    back = codecs.decode_gif(made)
    assert back.loop == 2 and [f.duration[0] for f in back.frames] == [3, 4, 5, 6, 7, 8] and back.frames[4].pixels.shape[:2] == (1, 1)
    assert all((a[..., :3] == b).all() for a, b in zip(process.screens(back), frames, strict=True))
    df = spark.createDataFrame([("a", "gif", bytearray(made)), ("b", "gif", bytearray(made[:40]))], "path string, kind string, content binary")
    out = {r.path: r for r in process.animate(df, "w=30&sharpen=false").collect()}
    assert (out["a"].width, out["a"].height, out["a"].frames, out["a"].error) == (30, 20, 6, None) and len(codecs.decode_gif(out["a"].content).frames) == 6
    assert out["b"].error and out["b"].content is None
    noisy = [np.full((1, 1, 3), v, np.uint8) for v in (10, 12, 11, 30, 11)]
    assert [int(f[0, 0, 0]) for f in process.denoise(noisy)] == [10, 11, 11, 30, 11]


def test_profiles():
    srgb = metadata.to_srgb(PX, {"space": "RGB", "matrix": curves.PROFILES["srgb"], "curves": [("para3", [2.4, 1 / 1.055, 0.055 / 1.055, 1 / 12.92, 0.04045])] * 3})
    assert np.abs(srgb.astype(int) - PX).max() <= 1
    adobe = metadata.source_profile(None, b"II*\0" + struct.pack("<IH", 8, 1) + struct.pack("<HHII", 0x8769, 4, 1, 26) + bytes(4) + struct.pack("<H", 1) + struct.pack("<HHII", 0xA001, 3, 1, 2) + bytes(4))
    red = metadata.to_srgb(np.array([[[0, 0, 200]]], np.uint8), adobe)[0, 0]
    assert red[2] > 200 and metadata.source_profile(None, None) is None
    gamma = metadata.source_profile(None, None, 100_000)  # linear light
    assert metadata.to_srgb(np.array([[[55, 55, 55]]], np.uint8), gamma)[0, 0, 0] == 128
    chroma = (0.3127, 0.329, 0.64, 0.33, 0.3, 0.6, 0.15, 0.06)
    assert np.abs(metadata.to_srgb(PX, metadata.source_profile(None, None, None, chroma)).astype(int) - PX).max() <= 1
    tags = {"rXYZ": (0.4360, 0.2225, 0.0139), "gXYZ": (0.3851, 0.7169, 0.0971), "bXYZ": (0.1431, 0.0606, 0.7141)}
    fixed = lambda v: struct.pack(">i", round(v * 65536))
    bodies = {k: b"XYZ " + bytes(4) + b"".join(map(fixed, v)) for k, v in tags.items()} | {f"{c}TRC": b"curv" + bytes(4) + struct.pack(">IH", 1, 256) for c in "rgb"}
    at, table, data = 128 + 4 + 12 * len(bodies), b"", b""
    for k, v in bodies.items():
        table += k.encode() + struct.pack(">II", at + len(data), len(v))
        data += v + bytes(-len(v) % 4)
    head = bytearray(128)
    head[8], head[16:20], head[36:40] = 2, b"RGB ", b"acsp"
    icc = bytes(head) + struct.pack(">I", len(bodies)) + table + data
    shown = next(process.screens(codecs.decode_png(codecs.encode_png(np.full((2, 2, 3), 55, np.uint8), icc=icc))))
    assert abs(int(shown[0, 0, 0]) - 127) <= 1  # gamma 1 and sRGB's primaries


def test_headers():
    anim = process.animation([PX, PX[::-1].copy()], [1, 1])
    for kind, data, n in (("gif", anim, 2), ("bmp", codecs.encode_bmp(PX), 1), ("tga", codecs.encode_tga(PX), 1), ("tiff", codecs.encode_tiff(PX, 6), 1), ("png", codecs.encode_png(PX), 1)):
        found = images.header(kind, data)
        assert len(found) == n and found[0][1:3] == ((37, 53) if kind == "tiff" else (53, 37)), kind
        if kind in ("bmp", "tga"):
            assert images.header(kind, data[:60]) == found  # no pixel is read


def test_load_reports_unreadable_files(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(jpeg.encode(PX, 90, 444))
    (tmp_path / "b.jpg").write_bytes(b"\xff\xd8 no picture")
    out = {r.path[-5:]: r for r in process.batch(process.load(spark, str(tmp_path)), "w=20").collect()}
    assert out["a.jpg"].width == 20 and out["a.jpg"].error is None and "no image" in out["b.jpg"].error and out["b.jpg"].content is None


def test_options():
    assert formats.FrameOptions(1, None).of(4) == range(1, 4) and formats.FrameOptions(9, 2).of(4) == range(4, 4)
    for bad in (lambda: formats.IndexedOptions(most=1), lambda: formats.IndexedOptions(dither="x"), lambda: formats.FrameOptions(3, 2).of(4, strict=True)):
        with pytest.raises(ValueError):
            bad()


def test_path_hash(spark):
    df = spark.createDataFrame([("/images/test1.jpg",), ("a",), (None,), ("",)], "p string")
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

    def plain(text):
        n = int.from_bytes(hashlib.blake2b(text.encode("utf-16-le"), digest_size=5).digest(), "big")
        return "".join(digits[n >> (35 - 5 * i) & 31] for i in range(8))

    got = [r[0] for r in df.select(numbers.short_hashes(F.col("p"))).collect()]
    assert got == ["L3SC75Z7", "ENU7SIT3", None, plain("")] and got[0] == plain("/images/test1.jpg")


def test_cache_paths(spark):
    df = spark.createDataFrame([("/a/b/c.jpg", 4, 3, "KEY", ".png")], "path string, outer_w int, outer_h int, cache_key string, ext string")
    hashed = numbers.short_hash("/a/b/c.jpg")
    got = df.select(*[requests.cache_path(s).alias(s) for s in ("mirror", "1k", "1m")]).first()
    assert tuple(got) == ("/a/b/KEY.c.4x3.png", f"/{hashed[:2]}/KEY.c.4x3.png", f"/{hashed[:2]}/{hashed[2:4]}/KEY.c.4x3.png")
