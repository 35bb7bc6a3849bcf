"""Point operators on b, g, r, a (bytes unless said otherwise)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colour import GAMMA, MATRICES, PROFILES, PUBLISHED, REC601, REC709, from_linear, to_byte, to_linear
from ..functions.numbers import clamp

#: (offset, scale) of bytes.
RANGES = {"full": (0, 255), "luma_video": (16, 219), "chroma_full": (128, 255), "chroma_video": (128, 224)}


def widen(v: Column, kind: str = "full") -> Column:
    offset, scale = RANGES[kind]
    return (v - offset) / F.lit(float(scale))


def narrow(v: Column, kind: str = "full") -> Column:
    offset, scale = RANGES[kind]
    return clamp(F.floor(v * scale + offset + 0.5), 0, 255).cast("int")


def invert(px: DataFrame, *channels: str) -> DataFrame:
    return px.withColumns({c: (255 - F.col(c)).cast(dict(px.dtypes)[c]) for c in channels})


def luma_to_full(v: Column) -> Column:
    return F.least(F.expr("0") + F.floor((F.greatest(v - 16, F.lit(0)) * 255 + 109) / 219), F.lit(255)).cast("int")


def luma_to_video(v: Column) -> Column:
    return (F.floor((v * 219 + 127) / 255) + 16).cast("int")


def _about_128(v: Column, times: int, half: int, by: int) -> Column:
    u = v - 128
    n = u * times + F.when(u < 0, -half).otherwise(half)
    return clamp((n / by).cast("int") + 128, 0, 255).cast("int")


def chroma_to_full(v: Column) -> Column:
    return _about_128(v, 127, 56, 112)


def chroma_to_video(v: Column) -> Column:
    return _about_128(v, 112, 63, 127)


def swizzle(px: DataFrame, source: int, target: int, alpha: bool = False) -> DataFrame:
    """Change the number of channels. Down to one takes blue, not luma, or alpha if asked; up repeats it, and new alpha is opaque."""
    if source == 1:
        px = px.withColumns({"g": F.col("b"), "r": F.col("b")})
    if target == 4 and source < 4:
        px = px.withColumn("a", F.lit(255).cast(dict(px.dtypes)["b"]))
    if target == 1:
        return px.withColumn("b", F.col("a" if alpha else "b")).drop("g", "r", "a")
    return px.drop("a") if target == 3 else px


def swap(px: DataFrame) -> DataFrame:
    return px.withColumns({"b": F.col("r"), "r": F.col("b")})


def grey(linear: bool = False) -> Column:
    """Rec. 601 luma of companded values, or Rec. 709 of linear ones."""
    r, g, b = REC709 if linear else REC601
    return F.col("r") * r + F.col("g") * g + F.col("b") * b


def colour_matrix(px: DataFrame, matrix, alpha: bool = False) -> DataFrame:
    """Apply a 4x4 matrix (or a preset's name) to companded bytes; the fourth row shifts, and its last entry scales alpha."""
    m = MATRICES[matrix] if isinstance(matrix, str) else matrix
    out = {c: to_byte((F.col("r") * m[0][k] + F.col("g") * m[1][k] + F.col("b") * m[2][k]) / 255 + m[3][k]) for k, c in enumerate("rgb")}
    if alpha and m[3][3] != 1:
        out["a"] = to_byte(F.col("a") / 255 * m[3][3])
    return px.withColumns(out)


def matte(px: DataFrame, b: int, g: int, r: int, a: int = 255, discard_alpha: bool = False) -> DataFrame:
    """Lay the image on a solid colour, in linear light. A clear pixel becomes the matte."""
    pa, ma = F.col("a") / 255, F.lit(a / 255)
    oa = pa + ma * (1 - pa)
    out = {}
    for c, m in (("b", b), ("g", g), ("r", r)):
        mixed = (to_linear(F.col(c) / 255) * pa + to_linear(F.lit(m / 255)) * ma * (1 - pa)) / oa
        out[c] = F.when(F.col("a") == 0, F.lit(m)).when(F.col("a") == 255, F.col(c)).otherwise(to_byte(from_linear(mixed))).cast("int")
    out["a"] = F.when(F.col("a") == 0, F.lit(a)).otherwise(to_byte(oa)).cast("int")
    px = px.withColumns(out)
    return px.drop("a") if discard_alpha else px


def blend_linear(both: DataFrame) -> DataFrame:
    """Compose _b, _g, _r, _a (null: nothing) over b, g, r, a in linear light, unassociated alpha."""
    ta, ba = F.col("_a") / 255, F.col("a") / 255
    under = ba * (1 - ta)
    oa = ta + under
    keep = F.col("_a").isNull() | (F.col("_a") == 0)
    out = {}
    for c in "bgr":
        mixed = (to_linear(F.col(f"_{c}") / 255) * ta + to_linear(F.col(c) / 255) * under) / F.when(oa > 0, oa)
        out[c] = F.when(keep, F.col(c)).when(F.col("_a") == 255, F.col(f"_{c}")).otherwise(to_byte(from_linear(mixed))).cast("int")
    out["a"] = F.when(keep, F.col("a")).when(F.col("_a") == 255, F.lit(255)).otherwise(to_byte(oa)).cast("int")
    return both.withColumns(out)


def convert_profile(px: DataFrame, source: str, target: str) -> DataFrame:
    """Between matrix profiles: linearise, one 3x3 matrix (the published one, where there is one), compress again. Equal profiles cost nothing."""
    if source == target:
        return px
    import numpy as np

    m = np.array(PUBLISHED[source, target]) if (source, target) in PUBLISHED else np.linalg.inv(PROFILES[target]) @ PROFILES[source]
    open_ = lambda v: F.pow(v, F.lit(GAMMA[source])) if source in GAMMA else to_linear(v)
    close = lambda v: F.pow(v, F.lit(1 / GAMMA[target])) if target in GAMMA else from_linear(v)
    lin = {c: open_(F.col(c) / 255) for c in "rgb"}
    return px.withColumns({c: to_byte(close(clamp(sum(lin[s] * float(m[i][j]) for j, s in enumerate("rgb")), 0.0, 1.0))) for i, c in enumerate("rgb")})


#: Conversions by (source, target): functions of one channel, for channels b, g and r alike.
CONVERSIONS = {
    ("Grey8", "Grey32Float"): widen,
    ("Grey32Float", "Grey8"): narrow,
    ("Bgr24", "Bgr96Float"): widen,
    ("Bgr96Float", "Bgr24"): narrow,
    ("Grey8", "Grey32FloatLinear"): lambda v: to_linear(widen(v)),
    ("Bgr24", "Bgr96FloatLinear"): lambda v: to_linear(widen(v)),
    ("Grey32FloatLinear", "Grey8"): lambda v: narrow(from_linear(v)),
    ("Bgr96FloatLinear", "Bgr24"): lambda v: narrow(from_linear(v)),
    ("Y8Video", "Y8"): luma_to_full,
    ("Y8", "Y8Video"): luma_to_video,
    ("Cb8Video", "Cb8"): chroma_to_full,
    ("Cb8", "Cb8Video"): chroma_to_video,
    ("Cr8Video", "Cr8"): chroma_to_full,
    ("Cr8", "Cr8Video"): chroma_to_video,
}


def convert(px: DataFrame, source: str, target: str) -> DataFrame:
    """Change the pixel format. A pair that isn't known is an error."""
    if source == target:
        return px
    channels = {"Grey8": 1, "Bgr24": 3, "Bgra32": 4}
    if source in channels and target in channels:
        return swizzle(px, channels[source], channels[target])
    if (source, target) not in CONVERSIONS:
        raise ValueError(f"no conversion from {source} to {target}")
    f = CONVERSIONS[source, target]
    return px.withColumns({c: f(F.col(c)) for c in "bgr" if c in px.columns})


def premultiply(px: DataFrame) -> DataFrame:
    return px.withColumns({c: F.col(c) * F.col("a") for c in "bgr"})


def unpremultiply(px: DataFrame) -> DataFrame:
    return px.withColumns({c: F.when(F.col("a") > 0, F.col(c) / F.col("a")).otherwise(0.0) for c in "bgr"})


def by_palette(px: DataFrame, index: str = "idx", palette: str = "palette") -> DataFrame:
    """Indices to ARGB through an array column; an index past its end takes entry 0."""
    at = F.when(F.col(index) < F.size(palette), F.col(index)).otherwise(0)
    argb = F.get(F.col(palette), at.cast("int"))
    return px.withColumns({c: F.shiftright(argb, s).bitwiseAND(F.lit(255)).cast("int") for c, s in (("b", 0), ("g", 8), ("r", 16), ("a", 24))})


def palette_format(palette: str = "palette") -> Column:
    """The least format that holds a palette: with alpha, colour or grey only."""
    byte = lambda p, s: F.shiftright(p, s).bitwiseAND(F.lit(255))
    clear = F.exists(palette, lambda p: byte(p, 24) < 255)
    plain = F.forall(palette, lambda p: (byte(p, 0) == byte(p, 8)) & (byte(p, 8) == byte(p, 16)))
    return F.when(clear, "Bgra32").when(plain, "Grey8").otherwise("Bgr24")
