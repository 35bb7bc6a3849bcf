"""Container kinds by their first bytes, extensions and media types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (kind, byte offset, pattern, mask or None), tried in order.
SIGNATURES = (
    ("jpeg", 0, "ffd8", None),
    ("png", 0, "89504e470d0a1a0a", None),
    ("gif", 0, "474946383761", None),
    ("gif", 0, "474946383961", None),
    ("webp", 0, "524946460000000057454250", "ffffffff00000000ffffffff"),
    ("jxl", 0, "ff0a", None),
    ("jxl", 0, "0000000c4a584c200d0a870a", None),
    ("heif", 4, "6674797068656963", None),
    ("heif", 4, "6674797068657663", None),
    ("avif", 4, "6674797061766966", None),
    ("heif", 4, "667479706d696631", None),
    ("heif", 4, "667479706d696166", None),
    ("bmp", 0, "424d", None),
    ("tiff", 0, "49492a00", None),
    ("tiff", 0, "4d4d002a", None),
)
MIME = {"jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "jxl": "image/jxl", "heif": "image/heif", "avif": "image/avif", "bmp": "image/bmp", "tiff": "image/tiff", "tga": "image/x-tga"}
#: The first kind that claims an extension has it.
EXTENSIONS = {"jpeg": (".jpg", ".jpeg", ".jpe", ".jfif", ".exif"), "png": (".png", ".apng"), "gif": (".gif",), "webp": (".webp",), "jxl": (".jxl",), "heif": (".heic", ".heif"), "avif": (".avif",), "bmp": (".bmp", ".dib"), "tiff": (".tif", ".tiff"), "tga": (".tga",)}
NEEDS = 16  # bytes


def _tga(hexed: Column) -> Column:
    """A plausible header: no or one colour map, kinds 1-3 and 9-11, 8-32 bits. It has no magic, so it comes last."""
    return hexed.rlike("^..(00(02|03|0a|0b)|01(01|09)).{26}") & hexed.rlike("^.{28}")


def sniff(content: Column) -> Column:
    """The container's kind, ``too short`` under 16 bytes, null if none accepts it. Only the header is looked at."""
    head = F.lower(F.hex(F.substring(content, 1, NEEDS)))
    out = F.when(_tga(head), "tga")
    for kind, at, pattern, mask in reversed(SIGNATURES):
        if mask is None:
            hit = F.substring(head, 2 * at + 1, len(pattern)) == pattern
        else:
            runs = [(i, pattern[i : i + 8]) for i in range(0, len(pattern), 8) if mask[i : i + 8] == "ffffffff"]
            hit = F.lit(True)
            for i, part in runs:
                hit = hit & (F.substring(head, 2 * at + 1 + i, 8) == part)
        out = F.when(hit, kind).otherwise(out)
    return F.when(F.octet_length(content) < NEEDS, "too short").otherwise(out)


def codec_for(df: DataFrame, name: str = "path") -> DataFrame:
    """Add the codec that an output path's extension names, without regard to case: a join with a small table."""
    rows = [(e, k) for k, es in EXTENSIONS.items() for e in es]
    table = df.sparkSession.createDataFrame(rows, "ext string, codec string")
    ext = F.lower(F.regexp_extract(F.col(name), r"(\.[^./\\]+)$", 1))
    return df.withColumn("ext", ext).join(F.broadcast(table), "ext", "left")
