"""Frames over time: denoise, dedupe, changed area, replay of disposals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD = 9
DISPOSE = {"unspecified": 0, "preserve": 1, "background": 2, "previous": 3}


def frame_range(frames: DataFrame, first: int, count: int = 1) -> DataFrame:
    return frames.where((F.col("frame_no") >= first) & (F.col("frame_no") < first + count))


def denoised(now: Column, before: Column, after: Column) -> Column:
    """A byte that stands out from both neighbours in time moves towards those within the threshold; one between them stays."""
    dp, dn = before - now, after - now
    out = (dp * dn) > 0
    near_p, near_n = F.abs(dp) <= THRESHOLD, F.abs(dn) <= THRESHOLD
    both = F.shiftright(now * 8 + dp * 3 + dn * 3 + 4, 3)
    return F.when(~out | before.isNull() | after.isNull(), now).when(near_p & near_n, both).when(near_p, F.shiftright(now * 2 + dp + 1, 1)).when(near_n, F.shiftright(now * 2 + dn + 1, 1)).otherwise(now).cast("int")


def denoise(px: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Every pixel against the untouched frames before and after it, by windows."""
    w = Window.partitionBy(*keys).orderBy("frame_no")
    return px.withColumn(value, denoised(F.col(value), F.lag(value).over(w), F.lead(value).over(w)))


def denoise_in_order(px: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """As above, but the frame before has been denoised already: an ordered fold for each pixel."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_no")
        v = pdf[value].to_numpy().astype(int)
        for i in range(1, len(v) - 1):
            dp, dn = v[i - 1] - v[i], v[i + 1] - v[i]
            if dp * dn > 0:
                p, n = abs(dp) <= THRESHOLD, abs(dn) <= THRESHOLD
                v[i] = (8 * v[i] + 3 * dp + 3 * dn + 4) >> 3 if p and n else (2 * v[i] + dp + 1) >> 1 if p else (2 * v[i] + dn + 1) >> 1 if n else v[i]
        return pdf.assign(**{value: v})

    return px.groupBy(*keys).applyInPandas(run, px.schema)


def dedupe(px: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """``same`` tells whether a pixel repeats the frame before; ``out`` is null (clear) there."""
    w = Window.partitionBy(*keys).orderBy("frame_no")
    same = F.coalesce(F.lag(value).over(w) == F.col(value), F.lit(False))
    return px.withColumn("same", same).withColumn("out", F.when(~F.col("same"), F.col(value)))


def dirty_rectangle(marked: DataFrame, frame: list[str]) -> DataFrame:
    """The least rectangle of changed pixels of each frame, one pixel at the origin if there is none."""
    changed = lambda c: F.when(~F.col("same"), F.col(c))
    out = marked.groupBy(*frame).agg(F.min(changed("x")).alias("x0"), F.min(changed("y")).alias("y0"), F.max(changed("x")).alias("x1"), F.max(changed("y")).alias("y1"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(*frame, zero("x0").alias("left"), zero("y0").alias("top"), (zero("x1") - zero("x0") + 1).alias("width"), (zero("y1") - zero("y0") + 1).alias("height"))


def run_lengths(marked: DataFrame, row: list[str], width: int) -> DataFrame:
    """Unchanged pixels at the left and right end of each row."""
    changed = F.when(~F.col("same"), F.col("x"))
    out = marked.groupBy(*row).agg(F.min(changed).alias("lo"), F.max(changed).alias("hi"))
    return out.select(*row, F.coalesce("lo", F.lit(width)).alias("left"), F.coalesce(F.lit(width - 1) - F.col("hi"), F.lit(width)).alias("right"))


def kinds(px: DataFrame, image: list[str]) -> DataFrame:
    """The least format of each animation's or image's frames together: with any clear pixel or more frames than one Bgra32, all grey Grey8, else Bgr24."""
    clear = F.bool_or(F.coalesce(F.col("a") < 255, F.lit(False))) if "a" in px.columns else F.lit(False)
    plain = F.bool_and((F.col("b") == F.col("g")) & (F.col("g") == F.col("r")))
    out = px.groupBy(*image).agg(clear.alias("any_alpha"), plain.alias("all_grey"), (F.max("frame_no") - F.min("frame_no") + 1).cast("int").alias("frame_count"))
    return out.withColumn("fmt", F.when(F.col("any_alpha") | (F.col("frame_count") > 1), "Bgra32").when(F.col("all_grey"), "Grey8").otherwise("Bgr24"))


def replay(px: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """What the screen shows where frames leave pixels out (null) and are kept: the last value drawn."""
    w = Window.partitionBy(*keys).orderBy("frame_no").rowsBetween(Window.unboundedPreceding, 0)
    return px.withColumn("shown", F.last(value, ignorenulls=True).over(w))


def replay_disposals(px: DataFrame, image: list[str], background: int = 0, value: str = "v", disposal: str = "disposal") -> DataFrame:
    """As above with disposals 2 (back to the background) and 3 (back to what was there): an ordered fold over an image's frames, the screen being its state."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_no", kind="stable")
        h, w = int(pdf.y.max()) + 1, int(pdf.x.max()) + 1
        screen = np.full((h, w), background, np.int64)
        shown = []
        for _, f in pdf.groupby("frame_no", sort=True):
            y, x = f.y.to_numpy(), f.x.to_numpy()
            v, d = f[value].to_numpy(float), f[disposal].to_numpy()
            before = screen.copy()
            drawn = ~np.isnan(v)
            screen[y[drawn], x[drawn]] = v[drawn].astype(np.int64)
            shown.append(screen[y, x])
            back = np.where(d == 2, background, np.where(d == 3, before[y, x], screen[y, x]))
            screen[y, x] = back
        return pdf.assign(shown=np.concatenate(shown).astype("int32"))

    return px.groupBy(*image).applyInPandas(run, px.withColumn("shown", F.lit(0)).schema)
