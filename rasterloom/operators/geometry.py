"""Coordinates: crop, orientation, pad, overlay. Pixels have keys (any columns), y, x and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: EXIF orientation: (axes swapped, x flipped, y flipped), applied to the stored image to show it upright.
ORIENTATIONS = {1: (False, False, False), 2: (False, True, False), 3: (False, True, True), 4: (False, False, True), 5: (True, False, False), 6: (True, True, False), 7: (True, True, True), 8: (True, False, True)}


def crop(px: DataFrame, x: int, y: int, width: int, height: int, within: tuple[int, int] | None = None) -> DataFrame:
    """The rectangle, moved to the origin. ``within``: the image's size, which the rectangle must not leave."""
    if within and (x < 0 or y < 0 or x + width > within[0] or y + height > within[1]):
        raise ValueError("the rectangle leaves the image")
    inside = F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1)
    return px.where(inside).withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def planar_crop(px: DataFrame, x: int, y: int, width: int, height: int, ratio: tuple[int, int], size: tuple[int, int]) -> DataFrame:
    """Crop planes Y, Cb and Cr: luma snaps to the subsampling grid, chroma takes the rectangle divided by it."""
    rx, ry = ratio
    x0, y0 = x - x % rx, y - y % ry
    w = min(-(-(width + x - x0) // rx) * rx, size[0] - x0)
    h = min(-(-(height + y - y0) // ry) * ry, size[1] - y0)
    luma = crop(px.where("plane = 'Y'"), x0, y0, w, h)
    return luma.unionByName(crop(px.where("plane <> 'Y'"), x0 // rx, y0 // ry, -(-w // rx), -(-h // ry)))


def orient(px: DataFrame, orientation: int | Column, width: int | Column, height: int | Column) -> DataFrame:
    """Show a stored image of the given size upright. Orientation, width and height may be columns, so frames of all kinds go together."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    o, w, h = as_col(orientation), as_col(width), as_col(height)
    swap = o.isin(*[k for k, v in ORIENTATIONS.items() if v[0]])
    flip_x = o.isin(*[k for k, v in ORIENTATIONS.items() if v[1]])
    flip_y = o.isin(*[k for k, v in ORIENTATIONS.items() if v[2]])
    x, y = F.when(swap, F.col("y")).otherwise(F.col("x")), F.when(swap, F.col("x")).otherwise(F.col("y"))
    ow, oh = F.when(swap, h).otherwise(w), F.when(swap, w).otherwise(h)
    return px.withColumns({"x": F.when(flip_x, ow - 1 - x).otherwise(x), "y": F.when(flip_y, oh - 1 - y).otherwise(y)})


def inverse(orientation: int) -> int:
    """The orientation that undoes this one: quarter turns swap, all others undo themselves."""
    return {6: 8, 8: 6}.get(orientation, orientation)


def pad(px: DataFrame, keys: list[str], width: int, height: int, top: int, right: int, bottom: int, left: int, fill: dict[str, object]) -> DataFrame:
    """Add a border. Only the border's pixels are made, for each image; the image itself is moved, not joined."""
    if not all(0 <= v <= 32767 for v in (top, right, bottom, left)):
        raise ValueError("each side must be between 0 and 32767")
    moved = px.withColumns({"x": F.col("x") + left, "y": F.col("y") + top})
    ow = width + left + right
    # four bands round the image, each a row of cells for every y that it has
    bands = [(0, top, 0, ow), (top, height, 0, left), (top, height, left + width, right), (top + height, bottom, 0, ow)]
    bands = [b for b in bands if b[1] > 0 and b[3] > 0]
    images = px.select(*keys).distinct()
    if not bands:
        return moved

    def rows_of(y, n, x, w):
        return F.transform(F.sequence(F.lit(y), F.lit(y + n - 1)), lambda r: F.struct(r.alias("y"), F.lit(x).alias("x"), F.lit(w).alias("w")))

    rows = F.explode(F.flatten(F.array(*[rows_of(*b) for b in bands])))
    border = images.select(*keys, rows.alias("_row")).select(*keys, "_row.y", F.explode(F.sequence(F.col("_row.x"), F.col("_row.x") + F.col("_row.w") - 1)).alias("x"))
    types = dict(px.dtypes)
    return moved.unionByName(border.withColumns({c: F.lit(v).cast(types[c]) for c, v in fill.items()}).select(px.columns))


def overlay(base: DataFrame, top: DataFrame, keys: list[str], mode: str = "over", x: int = 0, y: int = 0) -> DataFrame:
    """Lay ``top`` (b, g, r, a) on ``base``: ``source`` replaces, ``over`` replaces where alpha is 128 or more, ``blend`` composes in linear light."""
    from .colour import blend_linear

    t = top.select(*keys, (F.col("y") + y).alias("y"), (F.col("x") + x).alias("x"), *[F.col(c).alias(f"_{c}") for c in "bgra"])
    both = base.join(t, [*keys, "y", "x"], "left")
    if mode == "blend":
        return blend_linear(both).select(base.columns)
    takes = F.col("_a").isNotNull() if mode == "source" else F.coalesce(F.col("_a") >= 128, F.lit(False))
    return both.select(*keys, "y", "x", *[F.when(takes, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in "bgra"])


Rectangle = tuple[Column, Column, Column, Column]  # x, y, width, height


def turned(r: Rectangle, orientation: Column, width: Column, height: Column) -> Rectangle:
    """A rectangle of the upright image (x, y, w, h) on the stored one of the given size."""
    x, y, w, h = r
    of = lambda k: orientation.isin(*[o for o, v in ORIENTATIONS.items() if v[k]])
    x, y, w, h = (F.when(of(0), b).otherwise(a) for a, b in ((x, y), (y, x), (w, h), (h, w)))
    return F.when(of(1), width - w - x).otherwise(x), F.when(of(2), height - h - y).otherwise(y), w, h


def turned_back(r: Rectangle, orientation: Column, width: Column, height: Column) -> Rectangle:
    """What ``turned`` with the same stored size undoes."""
    swap = orientation.isin(*[o for o, v in ORIENTATIONS.items() if v[0]])
    undo = F.when(orientation == 6, 8).when(orientation == 8, 6).otherwise(orientation)
    return turned(r, undo, F.when(swap, height).otherwise(width), F.when(swap, width).otherwise(height))


def snapped(r: Rectangle, ix: int, iy: int, width: Column, height: Column) -> Rectangle:
    """Outwards to multiples of two powers of two, within the image."""
    x, y, w, h = r
    floor = lambda v, n: v.bitwiseAND(F.lit(~(n - 1)))
    left, top = floor(x, ix), floor(y, iy)
    return left, top, F.least(floor(w + x - left + (ix - 1), ix), width - left), F.least(floor(h + y - top + (iy - 1), iy), height - top)


def scaled_down(r: Rectangle, rx: int, ry: int, width: Column, height: Column) -> Rectangle:
    """Divided by a subsampling ratio, no larger than the plane."""
    x, y, w, h = r
    whole = lambda v: F.floor(v).cast("int")
    return whole(x / rx), whole(y / ry), F.least(F.ceil(w / rx).cast("int"), width), F.least(F.ceil(h / ry).cast("int"), height)


def in_proportion(r: Rectangle, sw: Column, sh: Column, tw: Column, th: Column) -> Rectangle:
    """From a source's size to a target's, outwards to whole pixels."""
    x, y, w, h = r
    left, top = F.floor(x / (sw / tw)).cast("int"), F.floor(y / (sh / th)).cast("int")
    return left, top, F.least(F.ceil(w / (sw / tw)).cast("int"), tw - left), F.least(F.ceil(h / (sh / th)).cast("int"), th - top)


def relative(r: Rectangle, x: Column, y: Column) -> Rectangle:
    return r[0] - x, r[1] - y, r[2], r[3]


def sliced(r: Rectangle, y: Column, height: Column | None = None) -> Rectangle:
    """The rows from ``y`` on, or so many of them as there are up to ``height``."""
    rest = r[3] - y
    return r[0], r[1] + y, r[2], rest if height is None else F.least(height, rest)


def intersect(ax, ay, aw, ah, bx, by, bw, bh) -> list[Column]:
    """x, y, width and height of two rectangles' common part; zeros if there is none."""
    x, y = F.greatest(ax, bx), F.greatest(ay, by)
    w, h = F.least(ax + aw, bx + bw) - x, F.least(ay + ah, by + bh) - y
    some = (w >= 0) & (h >= 0)
    return [F.when(some, v).otherwise(0) for v in (x, y, w, h)]
