"""What encoders take: pixel formats, subsampling, options."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FORMATS

#: Pixel formats that each encoder writes, and its subsampling modes, in order.
WRITES = {"jpeg": ("Grey8", "Bgr24"), "png": ("Grey8", "Bgr24", "Bgra32", "Indexed8"), "gif": ("Indexed8",), "bmp": ("Bgr24", "Bgra32"), "tga": ("Grey8", "Bgr24", "Bgra32"), "tiff": ("Grey8", "Bgr24", "Bgra32")}
SUBSAMPLES = {"jpeg": (420, 422, 444)}


def ranked(fmt: str) -> tuple[str, ...]:
    """The formats that may stand for one, the nearest first: itself, with alpha where it has some, with colour, its plane in the other range."""
    _, _, _, colour, alpha, *_ = FORMATS[fmt]
    out = [fmt]
    if alpha != "none":
        out += ["Bgra32", "Rgba32"]
    if colour == "bgr" or fmt == "Grey8":
        out += ["Bgr24", "Rgb24", "Bgra32", "Rgba32"]
    elif fmt[:2] in ("Y8", "Cb", "Cr") and fmt.removesuffix("Video").endswith("8"):
        plane = fmt.removesuffix("Video")
        out += [plane, plane + "Video"]
    return tuple(dict.fromkeys(out))


def closest_format(fmt: Column, takes: Column) -> Column:
    """The first of a format's ranked stand-ins that the encoder (an array of formats) takes; the format itself where it takes none."""
    rank = F.create_map(*[x for f in FORMATS for x in (F.lit(f), F.array(*[F.lit(r) for r in ranked(f)]))])
    fits = F.filter(F.element_at(rank, fmt), lambda f: F.array_contains(takes, f))
    return F.coalesce(F.get(fits, F.lit(0)), fmt)


def closest_subsample(mode: Column, modes: Column) -> Column:
    """The first of the encoder's modes that keeps as much chroma or more; else the last that keeps less; null where it has none."""
    more = F.filter(modes, lambda m: m >= mode)
    less = F.filter(modes, lambda m: m < mode)
    return F.coalesce(F.get(more, F.lit(0)), F.element_at(F.when(F.size(less) > 0, less), -1))


def jxl_distance(quality: Column) -> Column:
    """The published curve of JPEG XL's encoder: 0.1 at 100, 0.09 for each step down to 30, and a parabola below."""
    return F.when(quality >= 100, 0.0).when(quality >= 30, 0.1 + (100 - quality) * 0.09).otherwise(53 / 3000 * quality * quality - 23 / 20 * quality + 25)


def jxl_quality(distance: Column) -> Column:
    """The way back, to whole numbers of 0 to 100."""
    near = 100 - F.least(F.greatest(F.bround((distance - 0.1) / 0.09, 0), F.lit(0)), F.lit(70))
    far = F.bround((1.15 - F.sqrt(F.greatest(F.lit(1.3225) - 4 * 53 / 3000 * (25 - distance), F.lit(0.0)))) / (2 * 53 / 3000), 0)
    return F.when(distance <= 6.4, near).otherwise(F.least(F.greatest(far, F.lit(0)), F.lit(30))).cast("int")


# Options of encoders and decoders, as records. A record's fields are the keyword arguments of ``codecs`` by the same name.


@dataclass(frozen=True)
class JpegOptions:
    quality: int = 0  # 0: by the size of the result
    subsample: int = 0  # 0: by quality


@dataclass(frozen=True)
class PngOptions:
    filter_kind: str = "up"  # none, sub, up, average or paeth
    interlaced: bool = False


@dataclass(frozen=True)
class IndexedOptions:
    """PNG with a palette, and GIF."""

    most: int = 256
    palette: tuple[tuple[int, int, int], ...] | None = None  # b, g, r; None: made from the image
    dither: str = "auto"  # auto, none or diffusion

    def __post_init__(self):
        if not 2 <= self.most <= 256 or (self.palette is not None and not 0 < len(self.palette) <= 256):
            raise ValueError("a palette has 2 to 256 colours")
        if self.dither not in ("auto", "none", "diffusion"):
            raise ValueError(f"dither {self.dither}")


@dataclass(frozen=True)
class FrameOptions:
    """Which frames or pages a decoder reads: ``first`` on, ``count`` of them (None: all)."""

    first: int = 0
    count: int | None = 1

    def of(self, frames: int, strict: bool = False) -> range:
        """The frames of a file that has so many; beyond its end an error if ``strict``, else what there is."""
        stop = frames if self.count is None else self.first + self.count
        if strict and (self.first >= frames or stop > frames):
            raise ValueError(f"frames {self.first} to {stop} of {frames}")
        return range(min(self.first, frames), min(stop, frames))


@dataclass(frozen=True)
class AnimationOptions:
    loop: int = 0
    delay: int = 10  # hundredths of a second, where frames have none
    denoise: bool = True
    dedupe: bool = True
    indexed: IndexedOptions = field(default_factory=IndexedOptions)
