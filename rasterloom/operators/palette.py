"""Colour histograms, palettes, nearest colours, dithering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.colour import from_linear, to_byte, to_linear

ALPHA_THRESHOLD = 85
LEVELS = 7
#: Palettes have at most this many entries, so they may be broadcast.
MOST = 256


def octree_key(level: int = LEVELS) -> Column:
    """The top ``level`` bits of blue, green and red, interleaved: a level's key is a prefix of the next level's."""
    bits = []
    for k in range(level):
        for n, c in ((2, "r"), (1, "g"), (0, "b")):
            bit = F.shiftright(F.col(c).cast("int"), 7 - k).bitwiseAND(F.lit(1))
            bits.append(F.shiftleft(bit, 3 * (level - 1 - k) + n))
    key = bits[0]
    for b in bits[1:]:
        key = key.bitwiseOR(b)
    return key


def histogram(px: DataFrame, keys: list[str], level: int = LEVELS, alpha: bool = False) -> DataFrame:
    """Counts and channel sums for each octree leaf; with ``alpha``, clear pixels don't count."""
    px = px.where(F.col("a") >= ALPHA_THRESHOLD) if alpha else px
    return px.groupBy(*keys, octree_key(level).cast("int").alias("node")).agg(F.count("*").alias("n"), *[F.sum(c).cast("long").alias(f"s{c}") for c in "bgr"])


def exact(px: DataFrame, keys: list[str], most: int = MOST) -> DataFrame:
    """Whether an image's colours fit a palette, so that dithering is off."""
    return px.groupBy(*keys).agg(F.count_distinct("b", "g", "r").alias("colours")).withColumn("exact", F.col("colours") <= most)


def reduce_palette(hist: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The ``most`` weightiest leaves as colours.

    A leaf's weight is its count, times four times its distance to the first heavier sibling (by index, exclusive
    or 1 to 7) if it has one; means are taken in linear light.
    """
    parent, child = F.shiftright("node", 3), F.col("node").bitwiseAND(F.lit(7))
    lin = hist.withColumns({c: to_linear(F.col(f"s{c}") / F.col("n") / 255) for c in "bgr"})
    lin = lin.withColumns({"parent": parent, "child": child})
    family = Window.partitionBy(*keys, "parent")
    kin = F.collect_list(F.struct("child", "n", "b", "g", "r")).over(family)  # at most eight
    lin = lin.withColumn("kin", kin)
    order = lambda s: s["child"].bitwiseXOR(F.col("child"))
    heavier = F.filter("kin", lambda s: (s["n"] > F.col("n")) | ((s["n"] == F.col("n")) & (s["child"] > F.col("child"))))
    first = F.array_min(F.transform(heavier, lambda s: F.struct(order(s).alias("o"), s["b"].alias("b"), s["g"].alias("g"), s["r"].alias("r"))))
    lin = lin.withColumn("sib", first)
    own, sib = {c: from_linear(F.col(c)) for c in "bgr"}, {c: from_linear(F.col(f"sib.{c}")) for c in "bgr"}
    rr = (own["r"] + sib["r"]) / 2
    d = F.sqrt((2 + rr) * F.pow(own["r"] - sib["r"], F.lit(2)) + 4 * F.pow(own["g"] - sib["g"], F.lit(2)) + (3 - rr) * F.pow(own["b"] - sib["b"], F.lit(2)))
    lin = lin.withColumn("weight", F.when(F.col("sib").isNull(), F.col("n").cast("double")).otherwise(F.col("n") * d * 4))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.round("weight", 6), "node"))
    total = F.count("*").over(Window.partitionBy(*keys))
    kept = lin.withColumns({"rank": rank, "total": total}).where(F.col("rank") > F.col("total") - most)
    return kept.select(*keys, (F.col("rank") - F.greatest(F.col("total") - most, F.lit(0)) - 1).cast("int").alias("idx"), *[to_byte(from_linear(F.col(c))).alias(c) for c in "bgr"])


def nearest(px: DataFrame, palette: DataFrame) -> DataFrame:
    """Each pixel's nearest colour of one palette (idx, b, g, r), the lowest index on ties.

    The palette has at most MOST rows: it becomes an array in the projection, and the search never makes a row for each pair.
    """
    colours = palette.orderBy("idx").limit(MOST + 1).collect()
    if len(colours) > MOST:
        raise ValueError(f"a palette has at most {MOST} colours")
    entries = F.array(*[F.struct(F.lit(int(c["idx"])).alias("idx"), *[F.lit(int(c[k])).alias(k) for k in "bgr"]) for c in colours])

    def distance(p):
        db, dg, dr, rr = p["b"] - F.col("b"), p["g"] - F.col("g"), p["r"] - F.col("r"), p["r"] + F.col("r")
        return F.struct((dr * dr * (rr + 1024) + dg * dg * 2048 + db * db * (F.lit(1536) - rr)).alias("d"), p["idx"].alias("idx"))

    return px.withColumn("idx", F.array_min(F.transform(entries, distance))["idx"])


def distances(pal: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The weighted squares of colours' distances: pal is (n, 3), c (..., 3); b, g, r."""
    d = pal - c[..., None, :]
    rr = pal[:, 2] + c[..., None, 2]
    return d[..., 2] ** 2 * (1024 + rr) + d[..., 1] ** 2 * 2048 + d[..., 0] ** 2 * (1536 - rr)


def diffuse(img: np.ndarray, pal: np.ndarray) -> np.ndarray:
    """Indices of an image (h, w, 3) by error diffusion against colours (n, 3); b, g, r.

    Errors go 7/16 right, and below 2/16 left, 4/16 down, 1/16 right; a pixel that repeats the colour just worked on takes its index and drops the carried error.
    """
    h, w = img.shape[:2]
    img, pal = img.astype(np.int64), pal.astype(np.int64)
    out = np.zeros((h, w), np.int64)
    below = np.zeros((w + 2, 3), np.int64)
    known: dict[tuple, int] = {}
    for y in range(h):
        here, below = below, np.zeros((w + 2, 3), np.int64)
        carry, last, index = np.zeros(3, np.int64), None, 0
        for x in range(w):
            c = np.clip(img[y, x] * 16 + here[x + 1] + 7 * carry + 7, 0, 4095) >> 4
            key = tuple(c.tolist())
            if key == last:
                carry = np.zeros(3, np.int64)
            else:
                last = key
                index = known[key] if key in known else known.setdefault(key, int(np.argmin(distances(pal, c))))
                carry = c - pal[index]
                below[x] += 2 * carry
                below[x + 1] += 4 * carry
                below[x + 2] += carry
            out[y, x] = index
    return out


def dither(frames: DataFrame, keys: list[str], palette: list[tuple[int, int, int]]) -> DataFrame:
    """``diffuse`` of whole frames against one palette (b, g, r): an inherently sequential scan, one frame in memory at a time."""
    pal = np.array(palette, np.int64)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        img = np.zeros((int(pdf.y.max()) + 1, int(pdf.x.max()) + 1, 3), np.int64)
        img[pdf.y, pdf.x] = pdf[["b", "g", "r"]].to_numpy()
        res = pdf[[*keys, "y", "x"]].copy()
        res["idx"] = diffuse(img, pal)[pdf.y, pdf.x].astype("int32")
        return res

    kinds = dict(frames.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, "y", "x"]) + ", idx int"
    return frames.groupBy(*keys).applyInPandas(run, schema)


def colours_of(px: np.ndarray, most: int) -> tuple[np.ndarray, bool]:
    """At most ``most`` colours (n, 3; b, g, r) for pixels (n, 3), and whether they are exact: all there are, or the weightiest leaves as in ``reduce_palette``."""
    own = np.unique(px.reshape(-1, 3), axis=0)
    if len(own) <= most:
        return own, True
    bits = np.arange(LEVELS)
    node = sum(((((px[:, c : c + 1].astype(np.int64) >> (7 - bits)) & 1) << (3 * (LEVELS - 1 - bits) + n)).sum(1) for n, c in enumerate((0, 1, 2))), np.zeros(len(px), np.int64))
    nodes, at, n = np.unique(node, return_inverse=True, return_counts=True)
    mean = np.stack([np.bincount(at, px[:, c]) / n / 255 for c in range(3)], 1)
    lin = np.where(mean <= 0.04045, mean / 12.92, ((mean + 0.055) / 1.055) ** 2.4)
    comp = np.where(lin <= 0.04045 / 12.92, lin * 12.92, 1.055 * lin ** (1 / 2.4) - 0.055)
    weight = n.astype(float)
    number = dict(zip(nodes.tolist(), range(len(nodes)), strict=True))
    for i, k in enumerate(nodes.tolist()):
        kin = ((number.get(k ^ d), d) for d in range(1, 8))
        j = next((j for j, _ in kin if j is not None and (n[j] > n[i] or (n[j] == n[i] and nodes[j] > k))), None)
        if j is not None:
            rr = (comp[i, 2] + comp[j, 2]) / 2
            d = (comp[i] - comp[j]) ** 2
            weight[i] = n[i] * 4 * ((2 + rr) * d[2] + 4 * d[1] + (3 - rr) * d[0]) ** 0.5
    keep = np.sort(np.lexsort((nodes, np.round(weight, 6)))[-most:])
    return np.clip(np.floor(comp[keep] * 255 + 0.5), 0, 255).astype(np.uint8), False


def quantize(frames: list[np.ndarray], most: int = MOST, palette: np.ndarray | None = None, dither: str = "auto") -> tuple[list[np.ndarray], np.ndarray, int | None]:
    """Indices of each frame (h, w, 1, 3 or 4), the colours (n, 3 or 4; BGR(A)), and the index that is clear, if there is one.

    Grey frames keep their levels when the palette is free and whole; a given palette is used as it is; else the colours are those
    of all frames if they fit, or the weightiest leaves of the histogram. Errors are diffused unless ``dither`` is none or
    the colours are exact. Pixels whose alpha is under ALPHA_THRESHOLD are clear.
    """
    if palette is None and most >= 256 and all(f.shape[2] == 1 for f in frames):
        return [f[..., 0] for f in frames], np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1), None
    frames = [np.repeat(f, 3, 2) if f.shape[2] == 1 else f for f in frames]
    clear = [f[..., 3] < ALPHA_THRESHOLD if f.shape[2] == 4 else np.zeros(f.shape[:2], bool) for f in frames]
    some = any(c.any() for c in clear)
    exact = False
    if palette is None:
        solid = np.concatenate([f[~c][:, :3] for f, c in zip(frames, clear, strict=True)])
        palette, exact = colours_of(solid, most - some) if len(solid) else (np.zeros((1, 3), np.uint8), True)
    elif len(palette) + some > MOST:
        raise ValueError("the palette leaves no index for clear pixels")
    out = []
    for f, c in zip(frames, clear, strict=True):
        own, at = np.unique(f[..., :3].reshape(-1, 3), axis=0, return_inverse=True)
        if exact or dither == "none":
            near = np.concatenate([np.argmin(distances(palette.astype(np.int64), own[i : i + 4096].astype(np.int64)), 1) for i in range(0, len(own), 4096)])
            idx = near[at].reshape(f.shape[:2])
        else:
            idx = diffuse(f[..., :3], palette)
        out.append(np.where(c, len(palette), idx).astype(np.uint8))
    if some:
        palette = np.concatenate([np.c_[palette, np.full(len(palette), 255)], np.zeros((1, 4))]).astype(np.uint8)
    return out, palette, len(palette) - 1 if some else None
