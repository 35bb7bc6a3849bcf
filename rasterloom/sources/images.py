"""Scans and sinks of image files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from . import codecs, metadata
from .sniff import sniff


def load(spark: SparkSession, path: str) -> DataFrame:
    """images: path, file_size, file_date, content, kind. Spark prunes ``content`` where nothing reads it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", F.col("length").alias("file_size"), F.col("modificationTime").alias("file_date"), "content", sniff(F.col("content")).alias("kind"))


def _jpeg_info(data: bytes) -> tuple[int, int, bytes | None]:
    at, exif = 2, None
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            break
        mark, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if mark == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            exif = data[at + 10 : at + 2 + n]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack_from(">HH", data, at + 5)
            return w, h, exif
        at += 2 + n
    raise ValueError("no frame header")


def header(kind: str, data: bytes) -> list[tuple[int, int, int, bool, int]]:
    """(frame, width, height, has_alpha, orientation) from headers only where the format allows; width and height are those of the upright image."""
    if kind == "jpeg":
        w, h, exif = _jpeg_info(data)
        o = metadata.orientation(metadata.read_exif(exif)) if exif else 1
        return [(0, h, w, False, o) if o > 4 else (0, w, h, False, o)]
    if kind == "png":
        w, h, colour, alpha, frames, o = 0, 0, 0, False, 1, 1
        for name, body in codecs.png_chunks(data):
            if name == b"IHDR":
                w, h, _, colour = struct.unpack_from(">IIBB", body)
            elif name == b"tRNS":
                alpha = True
            elif name == b"acTL":
                frames = struct.unpack_from(">I", body)[0]
            elif name == b"eXIf":
                o = metadata.orientation(metadata.read_exif(body))
        return [(k, *((h, w) if o > 4 else (w, h)), alpha or colour in (4, 6), o) for k in range(frames)]
    if kind == "tiff":  # pages have sizes of their own
        out = []
        for k, tags in enumerate(codecs.tiff_pages(data)):
            w, h, o = tags[256][0], tags[257][0], tags.get(274, (1,))[0]
            out.append((k, *((h, w) if o in range(5, 9) else (w, h)), tags.get(277, (1,))[0] == 4, o if o in range(1, 9) else 1))
        return out
    if kind == "gif":
        w, h = struct.unpack_from("<HH", data, 6)
        return [(k, w, h, clear is not None, 1) for k, (*_, clear) in enumerate(codecs.gif_blocks(data)[1])]
    if kind == "bmp":
        w, h, _, bpp = struct.unpack_from("<iiHH", data, 18)
        return [(0, w, abs(h), bpp == 32, 1)]
    if kind == "tga":
        w, h, bpp = struct.unpack_from("<HHB", data, 12)
        return [(0, w, h, (data[7] if data[1] else bpp) == 32, 1)]
    if kind in codecs.DECODERS:  # a codec that was added: it alone knows its headers
        image = codecs.DECODERS[kind](data)
        return [(k, image.width, image.height, f.pixels.shape[2] == 4, 1) for k, f in enumerate(image.frames)]
    raise codecs.Unsupported(kind)


def file_info(images: DataFrame) -> DataFrame:
    """A row for each frame of each image of (path, kind, content); damaged and unknown files give one row with an error."""

    def run(batches):
        for b in batches:
            rows = []
            for path, kind, content in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    rows += [(path, kind, *f, None) for f in header(kind or "", content or b"")]
                except Exception as e:  # noqa: BLE001 - a file can be damaged in any way
                    rows.append((path, kind, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.string()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["path", "kind", "frame_no", "width", "height", "has_alpha", "orientation", "error"])

    return images.select("path", "kind", "content").mapInArrow(run, "path string, kind string, frame_no int, width int, height int, has_alpha boolean, orientation int, error string")


def decode(images: DataFrame, rows_per_strip: int = 64) -> DataFrame:
    """strips of all frames of (image_id, kind, content): a large image becomes many rows, so no row grows with it."""

    def run(batches):
        for b in batches:
            for image_id, kind, content in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                image = codecs.DECODERS[kind](content)
                for k, f in enumerate(image.frames):
                    h, w, ch = f.pixels.shape
                    fmt = {1: "Grey8", 3: "Bgr24", 4: "Bgra32"}[ch]
                    y0 = list(range(0, h, rows_per_strip))
                    n = len(y0)
                    cuts = [f.pixels[y : y + rows_per_strip] for y in y0]
                    yield pa.record_batch(
                        [pa.array([image_id] * n, pa.int64()), pa.array([k] * n, pa.int32()), pa.array(["all"] * n), pa.array(y0, pa.int32()), pa.array([len(c) for c in cuts], pa.int32()), pa.array([w] * n, pa.int32()), pa.array([fmt] * n), pa.array([c.tobytes() for c in cuts], pa.binary())],
                        ["image_id", "frame_no", "plane", "y0", "rows", "width", "fmt", "data"],
                    )

    return images.select("image_id", "kind", "content").mapInArrow(run, "image_id long, frame_no int, plane string, y0 int, rows int, width int, fmt string, data binary")


def to_pixels(strips: DataFrame) -> DataFrame:
    """Strips of bytes as long pixels: each strip's bytes become columns in one pass over them, and a batch is a strip."""

    def run(batches):
        for b in batches:
            for image_id, frame_no, plane, y0, rows, width, fmt, data in zip(*(b.column(i).to_pylist() for i in range(7)), b.column(7), strict=True):
                ch = {"Grey8": 1, "Bgr24": 3}.get(fmt, 4)
                n = rows * width
                px = np.frombuffer(data.as_buffer(), np.uint8, n * ch).reshape(n, ch).astype(np.int32)
                y, x = np.divmod(np.arange(n, dtype=np.int32), np.int32(width))
                same = [pa.repeat(pa.scalar(v, t), n) for v, t in ((image_id, pa.int64()), (frame_no, pa.int32()), (plane, pa.string()))]
                cols = [pa.array(np.ascontiguousarray(px[:, k])) if k < ch else pa.nulls(n, pa.int32()) for k in range(4)]
                yield pa.record_batch([*same, pa.array(y + np.int32(y0)), pa.array(x), *cols], ["image_id", "frame_no", "plane", "y", "x", "b", "g", "r", "a"])

    return strips.select("image_id", "frame_no", "plane", "y0", "rows", "width", "fmt", "data").mapInArrow(run, "image_id long, frame_no int, plane string, y int, x int, b int, g int, r int, a int")


def encode(frames: DataFrame, kind: str = "png", **options) -> DataFrame:
    """Pixels (image_id, y, x, b[, g, r[, a]]) to (image_id, content): one image at a time in memory. options go to the encoder.

    GIF takes b as the index into ``palette`` (rows of BGR), which is a grey ramp unless given.
    """
    channels = [c for c in "bgra" if c in frames.columns]

    def run(key, pdf):
        import pandas as pd

        h, w = int(pdf.y.max()) + 1, int(pdf.x.max()) + 1
        px = np.zeros((h, w, len(channels)), np.uint8)
        px[pdf.y, pdf.x] = pdf[channels].to_numpy()
        return pd.DataFrame({"image_id": [key[0]], "content": [_written(px, kind, options)]})

    return frames.groupBy("image_id").applyInPandas(run, "image_id long, content binary")


def _written(px: np.ndarray, kind: str, options: dict) -> bytes:
    if kind != "gif":
        return codecs.ENCODERS[kind](px, **options)
    ramp = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
    return codecs.encode_gif([(px[..., 0], 0, 0)], size=(px.shape[1], px.shape[0]), **{"palette": ramp} | options)


class ImageSource(DataSource):
    """``spark.read.format("rasterloom").load(folder)`` and ``df.write.format("rasterloom").save(folder)`` for local or mounted folders.

    Reading gives strips; writing takes (name, content). For other stores read with ``load`` and ``decode``.
    """

    @classmethod
    def name(cls) -> str:
        return "rasterloom"

    def schema(self) -> str:
        return "path string, frame_no int, y0 int, rows int, width int, fmt string, data binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


_HEADS = {"png": b"\x89PNG", "gif": b"GIF8", "bmp": b"BM", "tiff": (b"II*\0", b"MM\0*"), "jpeg": b"\xff\xd8"}


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]

    def partitions(self):
        import os

        names = sorted(os.path.join(d, f) for d, _, files in os.walk(self.folder) for f in files if not f.startswith(("_", ".")))
        return [InputPartition(names[i : i + 64]) for i in range(0, len(names), 64)] or [InputPartition([])]

    def read(self, partition) -> Iterator[tuple]:
        for path in partition.value:
            with open(path, "rb") as f:
                data = f.read()
            kind = next((k for k, head in _HEADS.items() if data.startswith(head)), "tga")
            for k, frame in enumerate(codecs.DECODERS[kind](data).frames):
                h, w, ch = frame.pixels.shape
                for y in range(0, h, 64):
                    part = frame.pixels[y : y + 64]
                    yield path, k, y, len(part), w, {1: "Grey8", 3: "Bgr24", 4: "Bgra32"}[ch], part.tobytes()


class _Writer(DataSourceWriter):
    def __init__(self, options):
        self.folder = options["path"]

    def write(self, rows) -> WriterCommitMessage:
        import os
        import uuid

        made = []
        for row in rows:
            final = os.path.join(self.folder, row["name"])
            os.makedirs(os.path.dirname(final), exist_ok=True)
            part = f"{final}.{uuid.uuid4().hex}.part"
            with open(part, "wb") as f:
                f.write(row["content"])
            made.append((part, final))
        return _Made(made)

    def commit(self, messages) -> None:
        import os

        for m in messages:
            for part, final in m.files if m else []:
                os.replace(part, final)

    def abort(self, messages) -> None:
        import os

        for m in messages:
            for part, _ in m.files if m else []:
                os.path.exists(part) and os.remove(part)


class _Made(WriterCommitMessage):
    def __init__(self, files):
        self.files = files
