"""Weighted sums: resampling, box halving, blur, sharpening.

A separable filter is a join of pixels with a small weight table and a sum, once for each
axis. The axis that shrinks the data most goes first, so the second shuffle is small. A
same-size axis is skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import Interpolator, blur_weights, table, weights
from ..functions.numbers import ONE
from .colour import grey


def _axis(px: DataFrame, kernel: DataFrame, axis: str, keys: list[str], values: list[str]) -> DataFrame:
    other = "x" if axis == "y" else "y"
    joined = px.join(kernel, F.col(axis) == F.col("i"))
    out = joined.groupBy(*keys, other, "o").agg(*[F.sum(F.col(v) * F.col("w")).alias(v) for v in values])
    return out.withColumnRenamed("o", axis).select(*keys, "y", "x", *values)


def resample(px: DataFrame, keys: list[str], isize: tuple[int, int], osize: tuple[int, int], f: Interpolator, values: list[str] | None = None) -> DataFrame:
    """Scale all images of ``isize`` (width, height) to ``osize``."""
    values = values or ["v"]
    spark = px.sparkSession
    axes = [(axis, i, o) for axis, i, o in zip("xy", isize, osize, strict=True) if i != o]
    for axis, i, o in sorted(axes, key=lambda t: t[2] / t[1]):
        px = _axis(px, table(spark, weights(i, o, f)), axis, keys, values)
    return px


def resample_alpha(px: DataFrame, keys: list[str], isize: tuple[int, int], osize: tuple[int, int], f: Interpolator) -> DataFrame:
    """Scale b, g, r weighted by alpha, so that clear pixels lend no colour."""
    pre = px.withColumns({c: F.col(c) * F.col("a") for c in "bgr"})
    out = resample(pre, keys, isize, osize, f, ["b", "g", "r", "a"])
    return out.withColumns({c: F.when(F.abs("a") > 1e-12, F.col(c) / F.col("a")).otherwise(0.0) for c in "bgr"})


def resample_mixed(px: DataFrame, shapes: DataFrame, keys: list[str], f: Interpolator, values: list[str] | None = None) -> DataFrame:
    """Scale images of many sizes together. shapes: keys, iw, ih, ow, oh.

    Only the distinct (in, out) pairs come to the driver; each pair's kernel is made once and joined by its name.
    """
    values = values or ["v"]
    spark = px.sparkSession
    for axis, i, o in (("x", "iw", "ow"), ("y", "ih", "oh")):
        pairs = shapes.select(i, o).distinct().collect()
        rows = [(f"{r[0]}:{r[1]}", *w) for r in pairs for w in weights(r[0], r[1], f)]
        kernel = spark.createDataFrame(rows, "kernel_id string, o int, i int, w double")
        named = px.join(shapes.select(*keys, F.concat_ws(":", i, o).alias("kernel_id")), keys)
        other = "x" if axis == "y" else "y"
        joined = named.join(kernel, (named["kernel_id"] == kernel["kernel_id"]) & (F.col(axis) == F.col("i")))
        px = joined.groupBy(*keys, other, "o").agg(*[F.sum(F.col(v) * F.col("w")).alias(v) for v in values]).withColumnRenamed("o", axis).select(*keys, "y", "x", *values)
    return px


def hybrid_half(px: DataFrame, keys: list[str], size: tuple[int, int], values: list[str] | None = None) -> DataFrame:
    """Halve byte images by 2x2 means, the last row and column repeated at odd sizes. Rounds up along y, then down along x."""
    values = values or ["v"]
    y, x = F.floor(F.col("y") / 2).cast("int"), F.floor(F.col("x") / 2).cast("int")
    at = lambda v, dy, dx: F.max(F.when((F.col("y") % 2 == dy) & (F.col("x") % 2 == dx), F.col(v)))
    aggs = [at(v, dy, dx).alias(f"_{v}{dy}{dx}") for v in values for dy in (0, 1) for dx in (0, 1)]
    out = px.withColumns({"_y": y, "_x": x}).groupBy(*keys, F.col("_y").alias("y"), F.col("_x").alias("x")).agg(*aggs)
    for v in values:
        a, b = F.col(f"_{v}00"), F.coalesce(f"_{v}01", f"_{v}00")
        c, d = F.coalesce(f"_{v}10", f"_{v}00"), F.coalesce(f"_{v}11", f"_{v}01", f"_{v}10", f"_{v}00")
        out = out.withColumn(v, F.shiftright(F.shiftright(a + c + 1, 1) + F.shiftright(b + d + 1, 1), 1).cast("int"))
    return out.select(*keys, "y", "x", *values)


def hybrid(px: DataFrame, keys: list[str], size: tuple[int, int], ratio: int, values: list[str] | None = None) -> tuple[DataFrame, tuple[int, int]]:
    """Halve until ``ratio``, a power of two, is reached; the image and its new size."""
    while ratio > 1:
        px, size, ratio = hybrid_half(px, keys, size, values), (-(-size[0] // 2), -(-size[1] // 2)), ratio // 2
    return px, size


def resample_uq15(px: DataFrame, keys: list[str], isize: tuple[int, int], osize: tuple[int, int], f: Interpolator, values: list[str] | None = None) -> DataFrame:
    """``resample`` of UQ15 values in whole numbers: weights are rounded to UQ15, and each axis' sum back from it."""
    values = values or ["v"]
    for axis, i, o in sorted((t for t in zip("xy", isize, osize, strict=True) if t[1] != t[2]), key=lambda t: t[2] / t[1]):
        kernel = table(px.sparkSession, weights(i, o, f)).withColumn("w", F.bround(F.col("w") * ONE, 0).cast("long"))
        px = _axis(px, kernel, axis, keys, values)
        px = px.withColumns({v: F.least(F.greatest(F.shiftright(F.col(v) + ONE // 2, 15), F.lit(0)), F.lit(65535)).cast("int") for v in values})
    return px


def blur_by_window(px: DataFrame, keys: list[str], size: tuple[int, int], radius: float, value: str = "v") -> DataFrame:
    """``gaussian_blur`` by windows that slide along rows and columns: no join, one sort for each axis. Neighbours beyond an edge count as the edge."""
    for axis, n in zip("xy", size, strict=True):
        other = "y" if axis == "x" else "x"
        middle = [(i - n, w) for o, i, w in blur_weights(2 * n + 1, radius) if o == n]
        reach = max(abs(i) for i, _ in middle)
        w = Window.partitionBy(*keys, other).orderBy(axis)
        row, at = F.collect_list(value).over(w.rowsBetween(-reach, reach)), F.col(axis)
        first = F.greatest(at - reach, F.lit(0))
        whole = F.collect_list(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) if reach >= n else row
        start = F.lit(0) if reach >= n else first
        terms = [F.get(whole, F.least(F.greatest(at + i, F.lit(0)), F.lit(n - 1)) - start) * c for i, c in middle]
        out = terms[0]
        for t in terms[1:]:
            out = out + t
        px = px.withColumn("_sum", out).withColumn(value, F.col("_sum")).drop("_sum")
    return px


def gaussian_blur(px: DataFrame, keys: list[str], size: tuple[int, int], radius: float, values: list[str] | None = None) -> DataFrame:
    values = values or ["v"]
    spark = px.sparkSession
    for axis, n in zip("xy", size, strict=True):
        px = _axis(px, table(spark, blur_weights(n, radius)), axis, keys, values)
    return px


def unsharp_linear(px: DataFrame, keys: list[str], size: tuple[int, int], amount: float, radius: float, threshold: float = 0.0, values: list[str] | None = None) -> DataFrame:
    """``unsharp`` of linear light: differences are of the luma's roots, and are added to the roots of the channels. Alpha stays as it is."""
    values = values or ["v"]
    luma = F.col(values[0]) if len(values) == 1 else grey(True)
    base = px.withColumn("_luma", F.sqrt(F.greatest(luma, F.lit(0.0))))
    soft = gaussian_blur(base.select(*keys, "y", "x", F.col("_luma").alias("_soft")), keys, size, radius, ["_soft"])
    both = base.join(soft, [*keys, "y", "x"])
    dif = F.col("_luma") - F.col("_soft")
    gain = F.when(F.abs(dif) > threshold, dif * (amount / 100)).otherwise(0.0) if threshold else dif * (amount / 100)
    root = lambda v: F.greatest(F.sqrt(F.greatest(F.col(v), F.lit(0.0))) + gain, F.lit(0.0))
    return both.select(*keys, "y", "x", *[F.col(v) if v == "a" else (root(v) * root(v)).alias(v) for v in values])


def unsharp(px: DataFrame, keys: list[str], size: tuple[int, int], amount: float, radius: float, threshold: int = 0, values: list[str] | None = None) -> DataFrame:
    """Add (luma - blurred luma) * amount% to each channel where the difference is over the threshold (0: everywhere). Values are bytes; alpha stays as it is."""
    values = values or ["v"]
    luma = F.col(values[0]) if len(values) == 1 else grey()
    base = px.withColumn("_luma", luma.cast("double"))
    soft = gaussian_blur(base.select(*keys, "y", "x", F.col("_luma").alias("_soft")), keys, size, radius, ["_soft"])
    both = base.join(soft, [*keys, "y", "x"])
    dif = F.col("_luma") - F.col("_soft")
    gain = F.when(F.abs(dif) > threshold, dif * (amount / 100)).otherwise(0.0) if threshold else dif * (amount / 100)
    return both.select(*keys, "y", "x", *[F.col(v) if v == "a" else F.least(F.greatest(F.col(v) + gain, F.lit(0.0)), F.lit(255.0)).alias(v) for v in values])
