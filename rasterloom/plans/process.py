"""Whole images through the pipeline, one row each: decoded, solved, scaled, sharpened, encoded.

Sizes and defaults are solved in columns; the pixels then go through one Arrow pass
with no shuffle, and a task holds one batch of images (Spark bounds a batch's bytes).
Files are decoded by Spark's image source in the JVM, bytes at hand by our own codecs.
Images are turned upright as EXIF says and their colours are turned into sRGB; of several frames the asked one is
answered, as a still image, and ``animate`` answers animations as GIF.
"""

from __future__ import annotations

import json
from dataclasses import replace
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import PRESETS, blur_weights, weights
from ..operators.dense import matrix
from ..operators.geometry import ORIENTATIONS
from ..operators.palette import quantize
from ..sources import codecs, images as files, metadata
from . import formats, settings

LUMA = (0.114, 0.587, 0.299)  # of b, g, r
SOLVED = ("crop_x", "crop_y", "crop_w", "crop_h", "inner_w", "inner_h", "outer_w", "outer_h", "filter", "hybrid_ratio", "gamma", "unsharp_amount", "unsharp_radius", "unsharp_threshold", "matte", "quality", "subsample", "format", "indexed")


def load(spark: SparkSession, path: str) -> DataFrame:
    """(path, image_w, image_h, channels, data, orientation, error) of image files as stored: bytes by rows, grey or BGR(A). A file that can't be read has an error and no data.

    Only the first frame is read; asking for another is an error (``decoded`` has all). Spark's image source leaves EXIF
    out, so the headers are read first; the paths of images that aren't upright come to the driver.
    """
    raw = spark.read.format("image").option("dropInvalid", "false").load(path).select("image.*", F.col("_metadata.file_path").alias("__file"))
    turned = {r.file: r.orientation for r in _orientations(spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), "content")).collect()}
    orientation = F.coalesce(F.element_at(F.from_json(F.lit(json.dumps(turned)), "map<string,int>"), F.col("__file")), F.lit(1)) if turned else F.lit(1)
    good = F.col("width") > 0
    known = lambda c: F.when(good, F.col(c))
    return raw.select(F.col("origin").alias("path"), known("width").alias("image_w"), known("height").alias("image_h"), known("nChannels").alias("channels"), known("data").alias("data"), orientation.alias("orientation"), F.when(~good, "no image that can be read").alias("error"))


def _orientations(found: DataFrame) -> DataFrame:
    """(file, orientation) of those of (file, content) that aren't upright."""

    def run(batches):
        for b in batches:
            out = []
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = content.as_py() or b""
                try:
                    if data[:4] in (b"II*\0", b"MM\0*"):
                        o = metadata.orientation([x for x in metadata.read_exif(data) if x[0] == "ifd0"])
                    else:
                        o = files.header("jpeg" if data[:2] == b"\xff\xd8" else "png", data)[0][-1]
                except Exception:  # noqa: BLE001 - no header that can be read: as stored
                    o = 1
                if o != 1:
                    out.append((file, o))
            yield pa.record_batch([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int32())], ["file", "orientation"])

    return found.mapInArrow(run, "file string, orientation int")


def upright(px: np.ndarray, orientation: int) -> np.ndarray:
    swap, flip_x, flip_y = ORIENTATIONS.get(orientation, ORIENTATIONS[1])
    px = px.transpose(1, 0, 2) if swap else px
    px = px[:, ::-1] if flip_x else px
    return px[::-1] if flip_y else px


def _bgra(px: np.ndarray) -> np.ndarray:
    px = np.repeat(px, 3, 2) if px.shape[2] == 1 else px
    return px if px.shape[2] == 4 else np.concatenate([px, np.full((*px.shape[:2], 1), 255, np.uint8)], 2)


def screens(image: codecs.Image):
    """What is shown at each frame, upright: pages as they are, frames of an animation drawn over those before."""
    profile = metadata.source_profile(image.icc, image.exif, image.gamma, image.chroma)
    if profile:
        image = replace(image, frames=[replace(f, pixels=metadata.to_srgb(f.pixels, profile)) for f in image.frames])
    exif = metadata.orientation([x for x in metadata.read_exif(image.exif) if x[0] == "ifd0"]) if image.exif else 1
    size = (image.height, image.width)
    if image.mime not in ("image/gif", "image/png") or len(image.frames) == 1 and image.frames[0].pixels.shape[:2] == size:
        for f in image.frames:
            yield upright(f.pixels, f.orientation if f.orientation != 1 else exif)
        return
    clear = any(f.pixels.shape[2] == 4 for f in image.frames)
    screen = np.zeros((*size, 4), np.uint8)
    for f in image.frames:
        before = screen.copy() if f.disposal == 3 else None
        part = screen[f.top : f.top + f.pixels.shape[0], f.left : f.left + f.pixels.shape[1]]
        new = _bgra(f.pixels)[: part.shape[0], : part.shape[1]]
        if image.mime == "image/gif" or f.blend:
            a, under = new[..., 3:].astype(np.float32) / 255, part[..., 3:].astype(np.float32) / 255
            alpha = a + under * (1 - a)
            colour = (new[..., :3] * a + part[..., :3] * under * (1 - a)) / np.maximum(alpha, 1e-6)
            new = np.concatenate([_bytes(colour), _bytes(alpha * 255)], 2)
        part[:] = new
        yield upright(screen.copy() if clear or (screen[..., 3] < 255).any() else screen[..., :3].copy(), exif)
        if f.disposal == 2:
            part[:] = 0
        elif before is not None:
            screen = before


def decoded(images: DataFrame, key: str = "path") -> DataFrame:
    """(key, image_w, image_h, channels, data, error, frame_no, frames): an upright row for each frame of (key, kind, content); a damaged or unknown file has one with an error and no data."""
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.int32(), pa.int32()]
    names = [key, "image_w", "image_h", "channels", "data", "error", "frame_no", "frames"]

    def run(batches):
        for b in batches:
            rows, of, held = [], [], 0

            def batch(b=b):
                cols = list(zip(*rows, strict=True)) if rows else [()] * 7
                return pa.record_batch([b.column(0).take(pa.array(of, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

            for j, (kind, content) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                done = len(rows)
                try:
                    image = codecs.DECODERS[kind](content)
                    shown = list(screens(image))
                    if not shown:
                        raise ValueError("no frames")
                    rows += [(px.shape[1], px.shape[0], px.shape[2], px.tobytes(), None, i, len(shown)) for i, px in enumerate(shown)]
                except Exception as e:  # noqa: BLE001 - a file can be damaged in any way
                    rows.append((None, None, None, None, f"{type(e).__name__}: {e}", 0, None))
                of += [j] * (len(rows) - done)
                held += sum(len(r[3] or b"") for r in rows[done:])
                if held > 1 << 26:
                    yield batch()
                    rows, of, held = [], [], 0
            yield batch()

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, "kind", "content").mapInArrow(run, f"{key} {kind}, image_w int, image_h int, channels int, data binary, error string, frame_no int, frames int")


@lru_cache(64)
def _kernel(isize: int, osize: int, name: str) -> np.ndarray:
    return matrix(weights(isize, osize, PRESETS[name]), osize, isize)


@lru_cache(64)
def _soft(size: int, radius: float) -> np.ndarray:
    return matrix(blur_weights(size, radius), size, size)


def halve(px: np.ndarray) -> np.ndarray:
    """Means of 2x2 bytes, rounded up downwards and down across; the last row and column are repeated where a side is odd."""
    px = np.pad(px, ((0, px.shape[0] % 2), (0, px.shape[1] % 2), (0, 0)), mode="edge").astype(np.uint16)
    px = (px[::2] + px[1::2] + 1) >> 1
    return ((px[:, ::2] + px[:, 1::2]) >> 1).astype(np.uint8)


def _axes(x: np.ndarray, my: np.ndarray | None, mx: np.ndarray | None) -> np.ndarray:
    h, w, ch = x.shape
    if my is not None:
        x = (my @ x.reshape(h, w * ch)).reshape(len(my), w, ch)
    return x if mx is None else np.matmul(mx, x)


_LINEAR = np.where(np.arange(256) <= 0.04045 * 255, np.arange(256) / 255 / 12.92, ((np.arange(256) / 255 + 0.055) / 1.055) ** 2.4)
#: Columns that are doubles at a time while an image is scaled down its rows.
STRIP = 256


def _companded(x: np.ndarray) -> np.ndarray:
    x = np.maximum(x, 0)
    return np.where(x <= 0.04045 / 12.92, x * 12.92, 1.055 * x ** (1 / 2.4) - 0.055)


def _bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8)


def _weighted(px: np.ndarray, linear: bool) -> np.ndarray:
    """Bytes as doubles, 0 to 255 (colours in linear light 0 to 1), times alpha where there is one: single precision and parts of 255 would move halves."""
    x = _LINEAR[px[..., :3]] if linear else px[..., :3].astype(np.float64)
    return np.concatenate([x * px[..., 3:], px[..., 3:]], 2) if px.shape[2] == 4 else x


def scale(px: np.ndarray, width: int, height: int, name: str = "catmullrom", halvings: int = 1, linear: bool = False) -> np.ndarray:
    """Bytes to bytes. Halved first while ``halvings`` says so; colours are weighted by alpha, and scaled in linear light if asked."""
    if (px.shape[1], px.shape[0]) == (width, height):
        return px
    while halvings > 1:
        px, halvings = halve(px), halvings // 2
    h, w, ch = px.shape
    my, mx = _kernel(h, height, name) if h != height else None, _kernel(w, width, name) if w != width else None
    x = np.concatenate([_axes(_weighted(px[:, i : i + STRIP], linear), my, None) for i in range(0, w, STRIP)], 1)
    x = _axes(x, None, mx)
    if ch == 4:
        a = np.clip(x[..., 3:], 0, 255)
        x = np.concatenate([np.where(a > 255 / 512, x[..., :3] / np.maximum(a, 255 / 512), 0), a], 2)
    if linear:
        x[..., :3] = _companded(x[..., :3]) * 255
    return _bytes(x)


def sharpen(px: np.ndarray, amount: float, radius: float, threshold: float = 0) -> np.ndarray:
    """Luma minus blurred luma, times amount %, added to every colour channel where it is over the threshold."""
    x = px.astype(np.float64)
    luma = x[..., :1] if px.shape[2] == 1 else (x[..., :3] @ np.array(LUMA))[..., None]
    dif = luma - _axes(luma, _soft(px.shape[0], radius), _soft(px.shape[1], radius))
    gain = np.where(np.abs(dif) > threshold, dif, 0) * (amount / 100) if threshold else dif * (amount / 100)
    return np.concatenate([_bytes(x[..., :3] + gain), px[..., 3:]], 2)


def render(px: np.ndarray, s: dict) -> np.ndarray:
    """One image by its solved settings: crop, halve, scale, sharpen, matte, pad."""
    px = px[s["crop_y"] : s["crop_y"] + s["crop_h"], s["crop_x"] : s["crop_x"] + s["crop_w"]]
    px = scale(px, s["inner_w"], s["inner_h"], s["filter"], s["hybrid_ratio"], s["gamma"] == "linear")
    if s["unsharp_amount"]:
        px = sharpen(px, s["unsharp_amount"], s["unsharp_radius"], s["unsharp_threshold"])
    pad_w, pad_h = s["outer_w"] - s["inner_w"], s["outer_h"] - s["inner_h"]
    matte = s["matte"]
    if (pad_w or pad_h) and px.shape[2] != 4:  # the border is transparent until a matte fills it
        px = np.concatenate([px if px.shape[2] == 3 else np.repeat(px, 3, 2), np.full((*px.shape[:2], 1), 255, np.uint8)], 2)
    if pad_w or pad_h:
        px = np.pad(px, ((pad_h // 2, pad_h - pad_h // 2), (pad_w // 2, pad_w - pad_w // 2), (0, 0)))
    if px.shape[2] == 4 and (matte is not None or s["format"] == "jpeg"):  # JPEG has no alpha: black stands behind it unless a colour is named
        m = matte if matte is not None else 0xFF000000
        a = px[..., 3:] / 255
        over = _LINEAR[px[..., :3]] * a + _LINEAR[[m & 255, m >> 8 & 255, m >> 16 & 255]] * (1 - a)
        px = _bytes(_companded(over) * 255)
    return px


def _write(px: np.ndarray, s: dict) -> bytes:
    if s["format"] == "jpeg":
        return codecs.ENCODERS["jpeg"](px, s["quality"], s["subsample"])
    if s["format"] == "gif" or (s["format"] == "png" and s["indexed"]):
        (idx,), colours, clear = quantize([px])
        if s["format"] == "png":
            return codecs.encode_png(idx, colours)
        return codecs.encode_gif([(idx, 0, 0)], colours, (px.shape[1], px.shape[0]), clear=clear)
    return codecs.ENCODERS[s["format"]](px)


def denoise(frames: list[np.ndarray], threshold: int = 9) -> list[np.ndarray]:
    """Bytes that stand out from the (already treated) frame before and the one after move towards those within the threshold."""
    out = [f.astype(np.int16) for f in frames]
    for i in range(1, len(out) - 1):
        dp, dn = out[i - 1] - out[i], out[i + 1] - out[i]
        p, n = np.abs(dp) <= threshold, np.abs(dn) <= threshold
        new = np.where(p & n, (8 * out[i] + 3 * dp + 3 * dn + 4) >> 3, np.where(p, (2 * out[i] + dp + 1) >> 1, np.where(n, (2 * out[i] + dn + 1) >> 1, out[i])))
        out[i] = np.where(dp.astype(np.int32) * dn > 0, new, out[i])
    return [f.astype(np.uint8) for f in out]


def animation(frames: list[np.ndarray], delays: list[int], options: formats.AnimationOptions = formats.AnimationOptions()) -> bytes:
    """A GIF of rendered frames of one size: denoised, what doesn't change left clear, cut to the changed rectangle, in one palette.

    Frames are drawn over those before; where a clear pixel follows a solid one, nothing is deduplicated and each frame clears the screen.
    """
    frames = [np.repeat(f, 3, 2) if f.shape[2] == 1 else f for f in frames]
    if options.denoise:
        frames = denoise(frames)
    frames = [_bgra(f) for f in frames]
    solid = [f[..., 3] >= 85 for f in frames]
    kept = options.dedupe and all((b | ~a).all() for a, b in pairwise(solid))
    parts, places = [frames[0]], [(0, 0)]
    for before, now in pairwise(frames):
        if not kept:
            parts.append(now)
            places.append((0, 0))
            continue
        new = (before != now).any(2)
        rows, cols = np.flatnonzero(new.any(1)), np.flatnonzero(new.any(0))
        y0, y1, x0, x1 = (rows[0], rows[-1] + 1, cols[0], cols[-1] + 1) if len(rows) else (0, 1, 0, 1)
        part = now[y0:y1, x0:x1].copy()
        part[~new[y0:y1, x0:x1]] = 0
        parts.append(part)
        places.append((int(x0), int(y0)))
    o = options.indexed
    idx, colours, clear = quantize(parts, o.most, np.array(o.palette, np.uint8) if o.palette else None, o.dither)
    made = [(i, x, y, d) for i, (x, y), d in zip(idx, places, delays, strict=True)]
    return codecs.encode_gif(made, colours, frames[0].shape[1::-1], options.loop, options.delay, clear, 1 if kept else 2)


def animate(images: DataFrame, query: str, key: str = "path", options: formats.AnimationOptions = formats.AnimationOptions()) -> DataFrame:
    """(key, width, height, frames, content, error): every animation of (key, kind, content) as a GIF by one settings string; one image at a time in memory. Damaged files have an error."""
    kinds = images.schema[key].dataType.simpleString()

    def sizes(batches):
        for b in batches:
            found = []
            for kind, content in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                try:
                    found.append(files.header(kind, content)[0][1:3])
                except Exception:  # noqa: BLE001 - the decoder says what is wrong
                    found.append((1, 1))
            yield pa.record_batch([*b.columns, pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32())], [key, "kind", "content", "image_w", "image_h"])

    def work(batches):
        for b in batches:
            for j in range(b.num_rows):
                row = {n: b.column(i)[j].as_py() for i, n in enumerate(b.schema.names)}
                try:
                    image = codecs.DECODERS[row["kind"]](row["content"])
                    frames = [render(px, row) for px in screens(image)]
                    delays = [round(100 * f.duration[0] / f.duration[1]) if f.duration[0] else options.delay for f in image.frames]
                    made = (frames[0].shape[1], frames[0].shape[0], len(frames), animation(frames, delays, options), None)
                except Exception as e:  # noqa: BLE001 - one bad image must not end the batch
                    made = (None, None, None, None, f"{type(e).__name__}: {e}")
                types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
                yield pa.record_batch([b.column(0).slice(j, 1), *(pa.array([v], t) for v, t in zip(made, types, strict=True))], [key, "width", "height", "frames", "content", "error"])

    sized = images.select(key, "kind", "content").mapInArrow(sizes, f"{key} {kinds}, kind string, content binary, image_w int, image_h int")
    parsed = settings.parse(sized.withColumn("query", F.lit(query)))
    solved = settings.defaults(settings.fixup(parsed)).withColumn("format", F.lit("gif"))
    return solved.select(key, "kind", "content", *SOLVED).mapInArrow(work, f"{key} {kinds}, width int, height int, frames int, content binary, error string")


def run(solved: DataFrame, key: str = "path") -> DataFrame:
    """(key, format, width, height, content, error) of rows with image_w, image_h, channels, data and the solved settings. A row that fails has an error and no content; rows without data keep their error."""
    kept = [c for c in ("error", "orientation") if c in solved.columns]

    def work(batches):
        for b in batches:
            given = {c: b.column(i + 5).to_pylist() for i, c in enumerate((*SOLVED, *kept))}
            rows = []
            for j, (w, h, ch, data) in enumerate(zip(*(b.column(i) for i in range(1, 5)), strict=True)):
                s = {c: v[j] for c, v in given.items()}
                try:
                    if not data.is_valid:
                        raise ValueError(s.get("error") or "no pixels")
                    px = np.frombuffer(data.as_buffer(), np.uint8).reshape(h.as_py(), w.as_py(), ch.as_py())
                    out = render(upright(px, s.get("orientation") or 1), s)
                    rows.append((s["format"], out.shape[1], out.shape[0], _write(out, s), None))
                except Exception as e:  # noqa: BLE001 - one bad image must not end the batch
                    rows.append((s["format"], None, None, None, f"{type(e).__name__}: {e}"))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
            yield pa.record_batch([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [key, "format", "width", "height", "content", "error"])

    kind = solved.schema[key].dataType.simpleString()
    return solved.select(key, "image_w", "image_h", "channels", "data", *SOLVED, *kept).mapInArrow(work, f"{key} {kind}, format string, width int, height int, content binary, error string")


def _asked(df: DataFrame) -> DataFrame:
    """Of each image the row of the asked frame; where it has no such frame its first, with an error and no data."""
    for name, value in (("frame_no", F.lit(0)), ("frames", F.lit(None).cast("int")), ("error", F.lit(None).cast("string"))):
        if name not in df.columns:
            df = df.withColumn(name, value)
    beyond = F.col("frame") >= F.coalesce("frames", F.lit(1))
    df = df.where((F.col("frame_no") == F.col("frame")) | (beyond & (F.col("frame_no") == 0)))
    why = F.when(F.col("frames").isNull(), F.concat(F.lit("frame "), "frame", F.lit(": only the first was read"))).otherwise(F.concat(F.lit("frame "), "frame", F.lit(" of "), "frames"))
    return df.withColumns({"error": F.when(F.col("error").isNull() & beyond, why).otherwise(F.col("error")), "data": F.when(~beyond, F.col("data"))})


def _solve(df: DataFrame) -> DataFrame:
    df = _asked(df)
    turned = F.col("orientation") > 4 if "orientation" in df.columns else F.lit(False)
    df = df.withColumns({"_upright_w": F.when(turned, F.col("image_h")).otherwise(F.col("image_w")), "_upright_h": F.when(turned, F.col("image_w")).otherwise(F.col("image_h"))})
    df = settings.defaults(settings.fixup(df, "_upright_w", "_upright_h")).withColumns({"mime": F.lit("image/jpeg"), "has_alpha": F.col("channels") == 4})
    return df.withColumn("format", settings.guess_format(df))


def batch(images: DataFrame, query: str, key: str = "path") -> DataFrame:
    """Every image by one and the same settings string, such as ``w=150&format=jpg``: a scan and one pass, no shuffle. ``format=png8`` and ``format=gif`` are written with a palette."""
    return run(_solve(settings.parse(images.withColumn("query", F.lit(query)))), key)


def answer(requests: DataFrame, images: DataFrame) -> DataFrame:
    """(request_id, ...) for requests (request_id, path, query): each is answered by the image at its path; unknown paths have no answer."""
    parsed = settings.parse(requests).drop("query")
    return run(_solve(parsed.join(images, "path")), "request_id")
