"""Interpolators and resampling kernels: small tables (o, i, w) that are joined to pixels."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from math import ceil, exp, pi, sin, sqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kernels with more weights than this are joined by shuffle instead of broadcast.
BROADCAST_ROWS = 2_000_000


@dataclass(frozen=True)
class Interpolator:
    name: str
    support: float
    value: Callable[[float], float]
    blur: float = 1.0


def point() -> Interpolator:
    return Interpolator("point", 1e-8, lambda d: 1.0)


def box() -> Interpolator:
    return Interpolator("box", 0.5, lambda d: 1.0 if d <= 0.5 else 0.0)


def linear() -> Interpolator:
    return Interpolator("linear", 1.0, lambda d: max(0.0, 1.0 - d))


def gaussian(sigma: float) -> Interpolator:
    if sigma <= 0:
        raise ValueError("sigma must be greater than 0")
    return Interpolator(f"gaussian({sigma})", 3 * sigma, lambda d: exp(-d * d / (2 * sigma * sigma)) / sqrt(2 * pi * sigma * sigma) if d < 3 * sigma else 0.0)


def quadratic(r: float = 1.0) -> Interpolator:
    """Two parabolas that meet at half a sample; r between 0.5 and 1.5 sets how sharp."""
    if not 0.5 <= r <= 1.5:
        raise ValueError("r must be between 0.5 and 1.5")

    def value(d: float) -> float:
        if d < 0.5:
            return (r + 1) / 2 - 2 * r * d * d
        return r * d * d - (2 * r + 0.5) * d + 0.75 * (r + 1) if d < 1.5 else 0.0

    return Interpolator(f"quadratic({r})", 1.5, value)


def cubic(b: float = 0.0, c: float = 0.5, blur: float = 1.0) -> Interpolator:
    """The Mitchell-Netravali family."""
    if b < 0 or c < 0:
        raise ValueError("b and c must not be negative")
    reach = 1.0 if b == c == 0 else 2.0

    def value(d: float) -> float:
        if d < 1:
            return ((12 - 9 * b - 6 * c) * d**3 + (12 * b + 6 * c - 18) * d**2 + 6 - 2 * b) / 6
        return ((-b - 6 * c) * d**3 + (6 * b + 30 * c) * d**2 - (12 * b + 48 * c) * d + 8 * b + 24 * c) / 6 if d < reach else 0.0

    return Interpolator(f"cubic({b},{c})", reach, value, blur)


def lanczos(lobes: int = 3) -> Interpolator:
    if lobes <= 0:
        raise ValueError("lobes must be greater than 0")
    sinc = lambda x: sin(pi * x) / (pi * x)
    return Interpolator(f"lanczos({lobes})", float(lobes), lambda d: 1.0 if d < 5e-10 else sinc(d) * sinc(d / lobes) if d < lobes else 0.0)


#: The three cubic pieces, highest power first, each over its own unit interval.
_SPLINE36 = ((13 / 11, -453 / 209, -3 / 209, 1.0), (-6 / 11, 270 / 209, -156 / 209, 0.0), (1 / 11, -45 / 209, 26 / 209, 0.0))


def spline36() -> Interpolator:
    def value(d: float) -> float:
        if d >= 3:
            return 0.0
        a, b, c, e = _SPLINE36[int(d)]
        t = d - int(d)
        return a * t**3 + b * t**2 + c * t + e

    return Interpolator("spline36", 3.0, value)


PRESETS: dict[str, Interpolator] = {
    "nearestneighbor": point(),
    "average": box(),
    "linear": linear(),
    "hermite": cubic(0, 0),
    "quadratic": quadratic(),
    "mitchell": cubic(1 / 3, 1 / 3),
    "catmullrom": cubic(0, 0.5),
    "cubic": cubic(0, 1),
    "cubicsmoother": cubic(0, 0.625, 1.15),
    "lanczos": lanczos(),
    "spline36": spline36(),
}


def effective_blur(f: Interpolator) -> float:
    if not 0.5 <= f.blur <= 1.5:
        raise ValueError("blur must be between 0.5 and 1.5")
    return 1.0 if f.support * f.blur < 0.5 else f.blur


@lru_cache(64)
def weights(isize: int, osize: int, f: Interpolator, offset: float = 0.0) -> tuple[tuple[int, int, float], ...]:
    """(output, input, weight): each output's weights sum to 1; taps beyond the edge count for the edge sample."""
    if isize < 1 or osize < 1:
        raise ValueError("sizes must be positive")
    if f.support < 1e-6:
        offset += 0.5
    scale = min(osize / isize, 1.0) / effective_blur(f)
    reach = f.support / scale
    if isize < 3 and 2 * reach > isize:
        reach = isize / 2
    taps = ceil(2 * reach)
    out: list[tuple[int, int, float]] = []
    for o in range(osize):
        at = (isize - osize) / (2 * osize) + offset + o * isize / osize
        first = int(at + reach) - taps + 1
        raw = [f.value(abs((first - at + k) * scale)) for k in range(taps)]
        total = sum(raw)
        folded: dict[int, float] = {}
        for k, v in enumerate(raw):
            i = min(max(first + k, 0), isize - 1)
            folded[i] = folded.get(i, 0.0) + v / total
        out += [(o, i, w) for i, w in sorted(folded.items())]
    return tuple(out)


def blur_weights(size: int, radius: float) -> tuple[tuple[int, int, float], ...]:
    return weights(size, size, gaussian(radius))


def table(spark: SparkSession, rows) -> DataFrame:
    """The kernel as a DataFrame, broadcast while it is small enough."""
    rows = list(rows)
    df = spark.createDataFrame(rows, "o int, i int, w double")
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df
