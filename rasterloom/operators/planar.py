"""Planes Y, Cb, Cr."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.colour import YCC, rgb_to_ycc

SUBSAMPLE = {420: (2, 2), 422: (2, 1), 444: (1, 1)}


def to_bgr(planes: DataFrame, keys: list[str], standard: str = "rec601") -> DataFrame:
    """Planes (keys, plane, y, x, v) of one size to b, g, r bytes: one grouped pivot instead of three-way joins."""
    at = lambda p: F.max(F.when(F.col("plane") == p, F.col("v")))
    wide = planes.groupBy(*keys, "y", "x").agg(at("Y").alias("_y"), at("Cb").alias("_cb"), at("Cr").alias("_cr"))
    wide = wide.where("_y is not null and _cb is not null and _cr is not null")
    m = np.linalg.inv(rgb_to_ycc(*YCC[standard]))
    terms = ("_y", "_cb", "_cr")
    shift = (0, 128, 128)
    out = {c: sum((F.col(t) - s) * float(m[k][j]) for j, (t, s) in enumerate(zip(terms, shift, strict=True))) for k, c in enumerate("rgb")}
    return wide.select(*keys, "y", "x", *[F.least(F.greatest(F.floor(out[c] + 0.5), F.lit(0)), F.lit(255)).cast("int").alias(c) for c in "bgr"])


def from_bgr(px: DataFrame, keys: list[str], standard: str = "rec601") -> DataFrame:
    m = rgb_to_ycc(*YCC[standard])
    value = lambda k, shift: F.least(F.greatest(F.floor(F.round(sum(F.col(c) * float(m[k][j]) for j, c in enumerate("rgb")) + shift, 6) + 0.5), F.lit(0)), F.lit(255)).cast("int")
    planes = F.array(*[F.struct(F.lit(p).alias("plane"), value(k, s).alias("v")) for k, (p, s) in enumerate((("Y", 0), ("Cb", 128), ("Cr", 128)))])
    return px.select(*keys, "y", "x", F.explode(planes).alias("_p")).select(*keys, "_p.plane", "y", "x", "_p.v")


def subsample(planes: DataFrame, keys: list[str], mode: int) -> DataFrame:
    """Mean chroma over the mode's cells; luma passes."""
    rx, ry = SUBSAMPLE[mode]
    if rx == ry == 1:
        return planes
    chroma = planes.where("plane <> 'Y'").groupBy(*keys, "plane", F.floor(F.col("y") / ry).cast("int").alias("y"), F.floor(F.col("x") / rx).cast("int").alias("x"))
    small = chroma.agg(F.floor(F.avg("v") + 0.5).cast("int").alias("v"))
    return planes.where("plane = 'Y'").select(*keys, "plane", "y", "x", "v").unionByName(small)
