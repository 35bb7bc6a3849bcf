"""A lazy chain of DataFrame steps, planned from settings before any of it runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.kernels import PRESETS
from ..operators import colour, geometry, resample

Step = Callable[[DataFrame], DataFrame]


@dataclass
class Pipeline:
    """``add`` composes until ``pixels`` is first read; from then on the plan is fixed."""

    source: DataFrame
    keys: list[str]
    size: tuple[int, int]
    steps: list[tuple[str, Step]] = field(default_factory=list)
    _pixels: DataFrame | None = None
    observed: dict[str, Observation] = field(default_factory=dict)

    def add(self, name: str, step: Step) -> Pipeline:
        if self._pixels is not None:
            raise RuntimeError("the plan is fixed: its pixels have been read")
        self.steps.append((name, step))
        return self

    @property
    def pixels(self) -> DataFrame:
        if self._pixels is None:
            df = self.source
            for name, step in self.steps:
                df = step(df)
                self.observed[name] = Observation(name)
                df = df.observe(self.observed[name], F.count(F.lit(1)).alias("pixels"))
            self._pixels = df
        return self._pixels

    def stats(self) -> dict[str, int]:
        """Pixels that each step made; known after an action on ``pixels``."""
        return {k: o.get["pixels"] for k, o in self.observed.items()}


def plan(px: DataFrame, keys: list[str], size: tuple[int, int], settings: dict, values: list[str]) -> Pipeline:
    """Steps for one solved request (see ``settings.fixup`` and ``defaults``): crop, halve, scale, matte, sharpen, orient, pad.

    Steps that would change nothing are left out; crop and scale come first, so that all others see less.
    """
    p = Pipeline(px, keys, size)
    x, y, w, h = (settings.get(k, d) for k, d in (("crop_x", 0), ("crop_y", 0), ("crop_w", size[0]), ("crop_h", size[1])))
    if (x, y, w, h) != (0, 0, *size):
        p.add("crop", lambda df: geometry.crop(df, x, y, w, h, size))
    now, target = (w, h), (settings.get("inner_w", w), settings.get("inner_h", h))
    ratio = settings.get("hybrid_ratio", 1)
    if ratio > 1 and now != target:
        start, halvings = now, ratio
        p.add("hybrid", lambda df: resample.hybrid(df, keys, start, halvings, values)[0])
        while ratio > 1:
            now, ratio = (-(-now[0] // 2), -(-now[1] // 2)), ratio // 2
    if now != target:
        f, before = PRESETS[settings.get("filter", "linear")], now
        if settings.get("gamma", "companded") == "linear" and settings.get("bytes", False):
            p.add("to_linear", lambda df: df.withColumns({v: colour.to_linear(F.col(v) / 255) for v in values}))
        p.add("scale", lambda df: resample.resample(df, keys, before, target, f, values))
        if settings.get("gamma", "companded") == "linear" and settings.get("bytes", False):
            p.add("from_linear", lambda df: df.withColumns({v: colour.to_byte(colour.from_linear(F.greatest(F.col(v), F.lit(0.0)))) for v in values}))
    if settings.get("matte") is not None and "a" in values:
        m = settings["matte"]
        p.add("matte", lambda df: colour.matte(df, m & 255, m >> 8 & 255, m >> 16 & 255, m >> 24 & 255))
    if settings.get("unsharp_amount"):
        p.add("unsharp", lambda df: resample.unsharp(df, keys, target, settings["unsharp_amount"], settings["unsharp_radius"], settings["unsharp_threshold"], values))
    o = settings.get("orientation", 1)
    if o != 1:
        p.add("orient", lambda df: geometry.orient(df, o, *target))
    ow, oh = settings.get("outer_w", target[0]), settings.get("outer_h", target[1])
    if (ow, oh) != target:
        left, top = (ow - target[0]) // 2, (oh - target[1]) // 2
        p.add("pad", lambda df: geometry.pad(df, keys, *target, top, ow - target[0] - left, oh - target[1] - top, left, {v: 0 for v in values}))
    return p
