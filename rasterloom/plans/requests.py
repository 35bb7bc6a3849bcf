"""Thumbnail requests: routing, limits, cache keys, and what is left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import short_hashes
from . import settings

MAX_PIXELS = 10_000_000


def device_pixel_ratio(df: DataFrame, dpr: Column, enlarge: bool = False) -> DataFrame:
    """Scale the asked size by a ratio between 1 and 5, unless that would enlarge; JPEG quality falls by 10 for each step of ratio.

    The quality falls from the default of the size, as documented for users, not from zero.
    """
    r = F.least(F.greatest(F.coalesce(dpr.try_cast("double"), F.lit(1.0)), F.lit(1.0)), F.lit(5.0))
    w, h = F.floor(F.col("width") * r).cast("int"), F.floor(F.col("height") * r).cast("int")
    fits = F.lit(enlarge) | ((w <= F.col("image_w")) & (h <= F.col("image_h")))
    go = (r > 1) & fits
    return df.withColumns({"quality_less": F.when(go, F.bround((r - 1) * 10, 0)).otherwise(0.0).cast("int"), "width": F.when(go, w).otherwise(F.col("width")), "height": F.when(go, h).otherwise(F.col("height"))})


def route(requests: DataFrame, folders: list[tuple[str, bool, int]], path: str = "path", method: str | None = None) -> DataFrame:
    """Add the first folder (prefix, without case) that holds the path, and a status so far: 404 outside, 405 for methods but GET and HEAD."""
    found = F.lit(None).cast("int")
    for i, (prefix, _, _) in reversed(list(enumerate(folders))):
        found = F.when(F.lower(F.col(path)).startswith(prefix.lower()), i).otherwise(found)
    allowed = F.lit(True) if method is None else F.upper(F.col(method)).isin("GET", "HEAD")
    return requests.withColumn("folder", found).withColumn("status", F.when(found.isNull(), 404).when(~allowed, 405).otherwise(200))


def limited(df: DataFrame, most: int = MAX_PIXELS) -> DataFrame:
    """Status 400 where the solved size has more pixels than allowed."""
    area = F.col("outer_w").cast("long") * F.col("outer_h")
    return df.withColumn("status", F.when((F.col("status") == 200) & (area > most), 400).otherwise(F.col("status")))


def canonical() -> Column:
    """The solved settings in a fixed order, as text to be hashed."""
    names = ("crop_x", "crop_y", "crop_w", "crop_h", "inner_w", "inner_h", "outer_w", "outer_h", "mode", "gamma", "hybrid", "format", "quality", "subsample", "frame", "matte", "filter", "sharpen")
    return F.concat_ws("|", *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names])


def with_cache_key(df: DataFrame) -> DataFrame:
    return df.withColumn("cache_key", short_hashes(canonical()))


def cache_path(strategy: str = "mirror", path: str = "path", ext: str = "ext") -> Column:
    """Where a result is kept: ``mirror`` keeps the folder, ``1k`` and ``1m`` spread over one or two levels of two hash signs."""
    name = F.regexp_extract(F.col(path), r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    if strategy == "mirror":
        folder = F.regexp_replace(F.col(path), r"/[^/]*$", "")
    else:
        hashed = short_hashes(F.col(path))
        first = F.concat(F.lit("/"), F.substring(hashed, 1, 2))
        folder = first if strategy == "1k" else F.concat(first, F.lit("/"), F.substring(hashed, 3, 2))
    size = F.concat_ws("x", F.col("outer_w").cast("string"), F.col("outer_h").cast("string"))
    return F.concat(folder, F.lit("/"), F.concat_ws(".", F.col("cache_key"), stem, size), F.col(ext))


def to_do(requests: DataFrame, cached: DataFrame, key: str = "cache_key") -> DataFrame:
    """Requests that no cached result answers, one for each key: identical requests share their result."""
    return requests.join(cached.select(key).distinct(), key, "left_anti").dropDuplicates([key])


def lookup(requests: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """Requests with what is known of their files: found, file_size, file_date. Each path is looked up once, however many requests name it; ``files`` is a listing such as ``images.load`` without contents, and may be cached."""
    asked = requests.select(path).distinct()
    known = asked.join(files.select(F.col("path").alias(path), "file_size", "file_date", F.lit(True).alias("found")), path, "left")
    return requests.join(known, path, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def pass_through(parsed: DataFrame) -> DataFrame:
    """``as_is`` tells which of the parsed requests ask for nothing and are answered by the file itself."""
    return parsed.withColumn("as_is", settings.is_empty())


def answer(requests: DataFrame, images: DataFrame, folders, defaults: dict[str, str] | None = None) -> DataFrame:
    """Route, parse, join the images' sizes, solve, limit and key a table of requests."""
    df = settings.parse(route(requests, folders), defaults=defaults)
    df = settings.fixup(df.join(images, "path", "left").where("image_w is not null"))
    df = settings.defaults(df)
    return with_cache_key(limited(df))
