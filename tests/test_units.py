"""Kernels, codecs, metadata, settings: hand-made cases and invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import colour as curves
from rasterloom.functions import kernels, numbers
from rasterloom.operators import geometry
from rasterloom.plans import pipeline, process, settings
from rasterloom.sources import codecs, images, jpeg, metadata

rng = np.random.default_rng(1)


@pytest.mark.parametrize("name", sorted(kernels.PRESETS))
@pytest.mark.parametrize("sizes", [(8, 4), (4, 8), (2, 4), (7, 3), (1, 5), (100, 33)])
def test_weights_sum_to_one(name, sizes):
    totals = {}
    for o, i, w in kernels.weights(*sizes, kernels.PRESETS[name]):
        assert 0 <= i < sizes[0]
        totals[o] = totals.get(o, 0) + w
    assert set(totals) == set(range(sizes[1])) and all(abs(t - 1) < 1e-9 for t in totals.values())


def test_kernel_cases():
    got = lambda n, m, f: [{i: round(w, 6) for oo, i, w in kernels.weights(n, m, kernels.PRESETS[f]) if oo == o and abs(w) > 1e-12} for o in range(m)]
    assert got(4, 2, "average") == [{0: 0.5, 1: 0.5}, {2: 0.5, 3: 0.5}]
    assert got(4, 2, "linear") == [{0: 0.5, 1: 0.375, 2: 0.125}, {1: 0.125, 2: 0.375, 3: 0.5}]
    assert got(2, 4, "linear") == [{0: 1.0}, {0: 0.75, 1: 0.25}, {0: 0.25, 1: 0.75}, {1: 1.0}]
    assert got(8, 4, "catmullrom")[0] == {0: 0.5, 1: 0.433594, 2: 0.113281, 3: -0.035156, 4: -0.011719}


SOLVER = [
    ((3000, 2000), {"width": 300}, (0, 0, 3000, 2000), (300, 200), (300, 200)),
    ((3000, 2000), {"width": 300, "height": 300, "mode": "max"}, (0, 0, 3000, 2000), (300, 200), (300, 200)),
    ((3000, 2000), {"width": 300, "crop_w": 3000, "crop_h": 2000}, (0, 0, 3000, 2000), (300, 200), (300, 200)),
    ((640, 480), {"width": 100, "height": 100}, (80, 0, 480, 480), (100, 100), (100, 100)),
    ((640, 480), {"width": 100, "height": 100, "anchor_x": "left", "anchor_y": "top"}, (0, 0, 480, 480), (100, 100), (100, 100)),
    ((640, 480), {"width": 100, "height": 100, "mode": "contain"}, (0, 0, 640, 480), (100, 75), (100, 75)),
    ((640, 480), {"width": 100, "height": 100, "mode": "pad"}, (0, 0, 640, 480), (100, 75), (100, 100)),
    ((640, 480), {"width": 100, "height": 100, "mode": "stretch"}, (0, 0, 640, 480), (100, 100), (100, 100)),
    ((640, 480), {"width": 1000, "height": 1000, "mode": "max"}, (0, 0, 640, 480), (640, 480), (640, 480)),
    ((640, 480), {"width": 1000, "height": 1000, "mode": "contain"}, (0, 0, 640, 480), (1000, 750), (1000, 750)),
    ((640, 480), {"width": 100, "mode": "pad"}, (0, 0, 640, 480), (100, 75), (100, 75)),
    ((10, 5), {"width": 5}, (0, 0, 10, 5), (5, 2), (5, 2)),
    ((5, 3), {"width": 2}, (0, 0, 5, 3), (2, 1), (2, 1)),
    ((640, 480), {"crop_x": 10, "crop_y": 20, "crop_h": -30}, (10, 20, 630, 430), (630, 430), (630, 430)),
    ((640, 480), {"width": 160, "crop_x": 5, "crop_y": 5, "crop_w": 10, "crop_h": 10, "basis_w": 100, "basis_h": 100}, (32, 24, 64, 48), (160, 120), (160, 120)),
    ((640, 480), {"crop_x": 600, "crop_w": 100, "crop_h": 100}, (0, 0, 640, 480), (640, 480), (640, 480)),
]


def test_solver(spark):
    base = {"width": 0, "height": 0, "mode": "crop", "anchor_x": "center", "anchor_y": "center", "crop_x": 0, "crop_y": 0, "crop_w": 0, "crop_h": 0, "basis_w": 0, "basis_h": 0}
    table = [(i, w, h, *(base | s).values()) for i, ((w, h), s, *_) in enumerate(SOLVER)]
    kinds = ", ".join(f"{k} {'string' if isinstance(v, str) else 'int'}" for k, v in base.items())
    df = spark.createDataFrame(table, f"id int, image_w int, image_h int, {kinds}")
    for r in settings.fixup(df).collect():
        *_, crop, inner, outer = SOLVER[r.id]
        assert ((r.crop_x, r.crop_y, r.crop_w, r.crop_h), (r.inner_w, r.inner_h), (r.outer_w, r.outer_h)) == (crop, inner, outer), SOLVER[r.id]


def test_hybrid_ratio(spark):
    cases = {2: (1, 1, 2), 6: (2, 2, 4), 10: (2, 4, 8), 24: (8, 8, 16), 200: (32, 32, 32)}
    df = spark.createDataFrame([(float(k),) for k in cases], "r double")
    got = df.select("r", *[settings.hybrid_ratio(F.col("r"), F.lit(m)).alias(m) for m in ("favorquality", "favorspeed", "turbo")]).collect()
    assert {int(r.r): tuple(r[1:]) for r in got} == cases


def test_hashes():
    assert numbers.short_hash("/images/test1.jpg") == "L3SC75Z7" and numbers.short_hash("a") == "ENU7SIT3"
    assert numbers.rational(0.04) == (1, 25) and numbers.rational(-1.5) == (-3, 2)


def test_curves():
    assert abs(curves.curve_table(True)[255] - 1) < 1e-12 and np.allclose(curves.PROFILES["srgb"].sum(1), curves.D50, atol=1e-3)


@pytest.mark.parametrize("channels", [1, 3, 4])
@pytest.mark.parametrize("kind", ["png", "bmp", "tga", "tiff"])
def test_codecs(kind, channels):
    px = rng.integers(0, 256, (13, 17, channels), dtype=np.uint8)
    got = codecs.DECODERS[kind](codecs.ENCODERS[kind](px)).frames[0].pixels
    want = np.repeat(px, 3, axis=2) if kind == "bmp" and channels == 1 else px
    assert (got == want).all()


def test_tga_runs():
    px = np.repeat(rng.integers(0, 3, (9, 50, 3), dtype=np.uint8), 4, axis=1)
    data = codecs.encode_tga(px, rle=True)
    assert (codecs.decode_tga(data).frames[0].pixels == px).all() and len(data) < px.size


@pytest.mark.parametrize("colours", [2, 5, 256])
def test_gif(colours):
    pal = rng.integers(0, 256, (colours, 3), dtype=np.uint8)
    idx = [rng.integers(0, colours, (40, 60)) for _ in range(3)]
    image = codecs.decode_gif(codecs.encode_gif([(i, 0, 0) for i in idx], pal, (60, 40), loop=3))
    assert image.loop == 3 and all((f.pixels == pal[i]).all() for f, i in zip(image.frames, idx, strict=True))


def test_png_filters_and_palette():
    px = rng.integers(0, 256, (9, 7, 3), dtype=np.uint8)
    for f in ("none", "sub", "up"):
        assert (codecs.decode_png(codecs.encode_png(px, filter_kind=f)).frames[0].pixels == px).all()
    pal = rng.integers(0, 256, (10, 4), dtype=np.uint8)
    idx = rng.integers(0, 10, (5, 6), dtype=np.uint8)
    assert (codecs.decode_png(codecs.encode_png(idx, pal)).frames[0].pixels == pal[idx]).all()
    with pytest.raises(ValueError):
        codecs.decode_png(codecs.encode_png(px)[:-20] + b"x" * 20)
    with pytest.raises(codecs.Unsupported):
        codecs.DECODERS["webp"](b"")


def test_exif():
    block = metadata.write_exif([(metadata.ORIENTATION, "short", b"\6\0"), (metadata.X_RESOLUTION, "rational", (300).to_bytes(4, "little") + (2).to_bytes(4, "little"))])
    entries = metadata.read_exif(block)
    assert metadata.orientation(entries) == 6 and metadata.number(entries, metadata.X_RESOLUTION) == 150
    assert metadata.read_exif(b"junk") == [] and metadata.read_exif(block[:20]) == []


def test_scan(spark, tmp_path):
    px = rng.integers(0, 256, (70, 20, 3), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(codecs.encode_png(px))
    (tmp_path / "b.bmp").write_bytes(codecs.encode_bmp(px))
    (tmp_path / "c.txt").write_bytes(b"no image, but long enough")
    loaded = images.load(spark, str(tmp_path))
    info = {r.path[-5:]: r for r in images.file_info(loaded).collect()}
    assert (info["a.png"].width, info["a.png"].height, info["b.bmp"].kind) == (20, 70, "bmp") and info["c.txt"].error
    only = loaded.where("kind = 'png'").withColumn("image_id", F.lit(1).cast("long"))
    long = images.to_pixels(images.decode(only))
    assert long.count() == 1400
    assert all(tuple(px[r.y, r.x]) == (r.b, r.g, r.r) for r in long.sample(0.05, 1).collect())
    back = images.encode(long.select("image_id", "y", "x", "b", "g", "r")).first().content
    assert (codecs.decode_png(back).frames[0].pixels == px).all()


def test_orientations_undo(spark):
    px = spark.createDataFrame([(y, x, 5 * y + x) for y in range(3) for x in range(5)], "y int, x int, v int")
    for o in range(1, 9):
        w, h = (3, 5) if o > 4 else (5, 3)
        there = geometry.orient(px, o, 5, 3)
        assert sorted(map(tuple, geometry.orient(there, geometry.inverse(o), w, h).collect())) == sorted(map(tuple, px.collect()))


def test_pipeline(spark):
    px = spark.createDataFrame([(1, y, x, 7.0) for y in range(12) for x in range(16)], "image_id int, y int, x int, v double")
    p = pipeline.plan(px, ["image_id"], (16, 12), {"crop_x": 2, "crop_y": 2, "crop_w": 12, "crop_h": 8, "inner_w": 6, "inner_h": 4, "outer_w": 8, "outer_h": 4, "filter": "lanczos", "orientation": 3}, ["v"])
    assert [n for n, _ in p.steps] == ["crop", "scale", "orient", "pad"]
    got = p.pixels.collect()
    assert len(got) == 32 and sorted({round(r.v, 9) for r in got}) == [0.0, 7.0]
    with pytest.raises(RuntimeError):
        p.add("late", lambda df: df)


def picture(h, w):
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([127 + 120 * np.sin(x / 17), 127 + 120 * np.cos(y / 23 + x / 40), (x + y) % 256 * 0.5 + 40], 2).clip(0, 255).astype(np.uint8)


def psnr(a, b):
    return 10 * np.log10(255**2 / max(1e-9, ((a.astype(float) - b) ** 2).mean()))


@pytest.mark.parametrize("subsample", [444, 422, 420])
def test_jpeg_is_read_by_others(spark, tmp_path, subsample):
    px = picture(83, 121)
    for name, data in (("a", jpeg.encode(px, 90, subsample, icc=b"p" * 70_000)), ("b", jpeg.encode(px[..., :1], 90))):
        (tmp_path / f"{name}.jpg").write_bytes(data)
    got = {r.image.origin[-5]: r.image for r in spark.read.format("image").load(str(tmp_path)).collect()}
    for name, want in (("a", px), ("b", px[..., :1])):
        i = got[name]
        assert psnr(np.frombuffer(bytes(i.data), np.uint8).reshape(i.height, i.width, i.nChannels), want) > 33
    assert jpeg.decode((tmp_path / "a.jpg").read_bytes())[1] == b"p" * 70_000


def test_jpeg_of_others_is_read(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(codecs.encode_png(picture(83, 121)))
    jvm = spark._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.File(str(tmp_path / "a.png")))
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(tmp_path / "a.jpg")))
    px, _, _ = jpeg.decode((tmp_path / "a.jpg").read_bytes())
    assert psnr(px, picture(83, 121)) > 30


def test_jpeg_edges():
    rng = np.random.default_rng(1)
    for shape in ((1, 1, 1), (1, 1, 3), (8, 17, 3), (65, 3, 3)):
        px = rng.integers(0, 256, shape, dtype=np.uint8)
        assert np.abs(jpeg.decode(jpeg.encode(px, 100, 444))[0].astype(int) - px).max() <= 3
    sizes = [len(jpeg.encode(picture(64, 64), q)) for q in (1, 30, 60, 90, 100)]
    assert sizes == sorted(sizes)
    for bad in (np.zeros((4, 4, 4), np.uint8), np.zeros((0, 4, 3), np.uint8)):
        with pytest.raises(ValueError):
            jpeg.encode(bad)
    with pytest.raises(ValueError):
        jpeg.decode(b"no image")
    lengths = jpeg.code_lengths({s: 2**s for s in range(40)})
    assert max(lengths.values()) == 16 and sum(2.0**-n for n in lengths.values()) == 1


def test_unsharp_keeps_alpha(spark):
    px = spark.createDataFrame([(1, y, x, *[float((x * 40) % 256)] * 3, float(y * 60)) for y in range(4) for x in range(4)], "image_id int, y int, x int, b double, g double, r double, a double")
    p = pipeline.plan(px, ["image_id"], (4, 4), {"unsharp_amount": 50, "unsharp_radius": 1.0, "unsharp_threshold": 0}, list("bgra"))
    assert all(r.a == r.y * 60 for r in p.pixels.collect())


def test_process_files(spark, tmp_path):
    px = picture(300, 400)
    (tmp_path / "a.jpg").write_bytes(jpeg.encode(px, 95, 444))
    (tmp_path / "b.png").write_bytes(codecs.encode_png(np.concatenate([px, np.full((300, 400, 1), 128, np.uint8)], 2)))
    (tmp_path / "c.txt").write_bytes(b"no image, but long enough")
    loaded = process.load(spark, str(tmp_path))
    assert "Exchange" not in process.batch(loaded, "w=100")._jdf.queryExecution().toString()
    out = {r.path[-5]: r for r in process.batch(loaded, "w=100&h=60&mode=pad&bg=red").collect()}
    assert "no image" in out["c"].error and out["c"].content is None
    assert {k: (r.format, r.width, r.height, r.error) for k, r in out.items() if k != "c"} == {"a": ("jpeg", 100, 60, None), "b": ("jpeg", 100, 60, None)}
    a = jpeg.decode(out["a"].content)[0]
    assert np.abs(a[30, 2].astype(int) - (0, 0, 255)).max() < 8  # the border
    small = {r.path[-5]: r for r in process.batch(loaded, "w=200&sharpen=false&gamma=companded&filter=average&hybrid=off&format=png").collect()}
    mean = px.reshape(150, 2, 200, 2, 3).mean((1, 3))
    got = codecs.decode_png(small["a"].content).frames[0].pixels
    assert psnr(got, mean) > 40
    assert codecs.decode_png(small["b"].content).frames[0].pixels.shape == (150, 200, 4)
    asked = spark.createDataFrame([(1, f"file:{tmp_path}/a.jpg", "w=50"), (2, f"file:{tmp_path}/a.jpg", "crop=0,0,20,10&format=bmp"), (3, "nowhere", "w=5")], "request_id long, path string, query string")
    known = loaded.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/"))
    got = {r.request_id: (r.format, r.width, r.height) for r in process.answer(asked, known).collect()}
    assert got == {1: ("jpeg", 50, 38), 2: ("bmp", 20, 10)}


def test_process_bytes(spark):
    px = picture(64, 48)
    rows = [(1, "jpeg", jpeg.encode(px)), (2, "png", b"damaged"), (3, None, None), (4, "bmp", codecs.encode_bmp(px)), (4, "bmp", codecs.encode_bmp(px))]
    table = spark.createDataFrame(rows, "path long, kind string, content binary")
    out = sorted((r.path, r.width, r.height, r.error is None) for r in process.batch(process.decoded(table), "h=32").collect())
    assert out == [(1, 24, 32, True), (2, None, None, False), (3, None, None, False), (4, 24, 32, True), (4, 24, 32, True)]
    assert process.batch(process.decoded(table.limit(0)), "h=32").count() == 0


def turned_jpeg(px, orientation):
    body = b"Exif\0\0" + metadata.write_exif([(metadata.ORIENTATION, "short", bytes([orientation, 0]))])
    data = jpeg.encode(px, 95, 444)
    return data[:2] + b"\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body + data[2:]


def test_process_turns_upright(spark, tmp_path):
    px = picture(40, 60)
    show = {1: px, 2: px[:, ::-1], 3: px[::-1, ::-1], 4: px[::-1], 5: px.transpose(1, 0, 2), 6: np.rot90(px, -1), 7: px[::-1, ::-1].transpose(1, 0, 2), 8: np.rot90(px)}
    for o in show:
        (tmp_path / f"a b{o}.jpg").write_bytes(turned_jpeg(px, o))
    loaded = process.load(spark, str(tmp_path))
    table = spark.createDataFrame([(f"{o}.jpg", "jpeg", turned_jpeg(px, o)) for o in show], "path string, kind string, content binary")
    for source in (loaded, process.decoded(table)):
        assert "Exchange" not in process.batch(source, "w=30")._jdf.queryExecution().toString()
        whole = {int(r.path[-5]): r for r in process.batch(source, "format=png").collect()}
        assert set(whole) == set(show)
        for o, r in whole.items():
            got = codecs.decode_png(r.content).frames[0].pixels
            assert got.shape == show[o].shape and psnr(got, show[o]) > 30, o
        assert {int(r.path[-5]): (r.width, r.height) for r in process.batch(source, "w=30").collect()} == {o: (30, 20) if o < 5 else (30, 45) for o in show}


def test_process_frames(spark):
    palette = np.array([[0, 0, 255], [0, 255, 0], [255, 0, 0], [1, 2, 3]], np.uint8)
    full, small = np.zeros((8, 8), np.uint8), np.ones((2, 2), np.uint8)
    gif = codecs.encode_gif([(full, 0, 0), (small, 4, 2), (small + 1, 0, 0)], palette, (8, 8))
    first, second = (codecs.encode_tiff(np.full((4, 6, 3), v, np.uint8)) for v in (10, 20))
    at = int.from_bytes(second[4:8], "little") + len(first)  # the second file behind the first, its offsets moved on
    n = int.from_bytes(second[at - len(first) : at - len(first) + 2], "little")
    moved = bytearray(first + second)
    for i in range(n):
        where = at + 2 + 12 * i
        tag = int.from_bytes(moved[where : where + 2], "little")
        if tag in (258, 273):
            moved[where + 8 : where + 12] = (int.from_bytes(moved[where + 8 : where + 12], "little") + len(first)).to_bytes(4, "little")
    moved[len(first) - 4 : len(first)] = at.to_bytes(4, "little")
    table = spark.createDataFrame([("gif", "gif", gif), ("tiff", "tiff", bytes(moved)), ("bad", "gif", b"bad")], "path string, kind string, content binary")
    frames = process.decoded(table)
    got = lambda query: {r.path: (codecs.decode_png(r.content).frames[0].pixels if r.content else None, r.error) for r in process.batch(frames, query).collect()}
    zero, one, two, three = (got(f"format=png&{q}") for q in ("", "page=1", "frame=2", "frame=3"))
    want = np.broadcast_to(palette[0], (8, 8, 3)).copy()
    assert (zero["gif"][0] == want).all() and (zero["tiff"][0] == 10).all() and (one["tiff"][0] == 20).all()
    want[2:4, 4:6] = palette[1]
    assert (one["gif"][0] == want).all()
    want[:2, :2] = palette[2]
    assert (two["gif"][0] == want).all() and two["tiff"] == (None, "ValueError: frame 2 of 2")
    assert three["gif"] == (None, "ValueError: frame 3 of 3") and all(x["bad"][0] is None for x in (zero, one, two, three))
    still = spark.createDataFrame([("x", 2, 2, 3, bytes(12))], "path string, image_w int, image_h int, channels int, data binary")
    assert [r.error for r in process.batch(still, "page=1").collect()] == ["ValueError: frame 1: only the first was read"]


def test_halving_rounds_as_told():
    assert process.halve(np.array([[[0], [0]], [[1], [0]]], np.uint8)).tolist() == [[[0]]]
    assert process.halve(np.array([[[1], [2]], [[2], [3]]], np.uint8)).tolist() == [[[2]]]
    assert process.halve(np.full((3, 5, 3), 7, np.uint8)).shape == (2, 3, 3)
