"""Requests as columns: parse query strings, solve sizes, fill in defaults. No row leaves the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colour import parse_colour
from ..sources.sniff import EXTENSIONS

MODES = ("crop", "max", "stretch", "pad", "contain")
#: Filter names and what they mean.
FILTERS = {"point": "nearestneighbor", "nearestneighbor": "nearestneighbor", "box": "average", "average": "average", "linear": "linear", "bilinear": "linear", "quadratic": "quadratic", "catrom": "catmullrom", "catmullrom": "catmullrom", "cubic": "cubic", "bicubic": "cubic", "lanczos": "lanczos", "lanczos3": "lanczos", "spline36": "spline36"}
WRITABLE = ("jpeg", "png", "gif", "bmp", "tga", "tiff")
#: Default quality by the greater output side, filters and sharpening by scale ratio, in the order of the tests.
QUALITY = ((160, 95), (320, 93), (480, 91), (640, 89), (1280, 87), (1920, 85))
UNSHARP = ((0.5, (40, 1.5, 0)), (1, (30, 1.0, 0)), (2, (30, 0.75, 4)), (4, (75, 0.5, 2)), (6, (50, 0.75, 2)), (8, (100, 0.6, 1)), (10, (125, 0.5, 0)))


def query_map(query: Column) -> Column:
    """Pairs of a query string, keys in lower case; the first of a repeated key counts."""
    pairs = F.filter(F.split(query, "&"), lambda p: F.length(p) > 0)
    entries = F.transform(pairs, lambda p: F.struct(F.lower(F.get(F.split(p, "=", 2), F.lit(0))).alias("key"), F.try_url_decode(F.coalesce(F.get(F.split(p, "=", 2), F.lit(1)), F.lit(""))).alias("value")))
    return F.map_from_entries(F.array_compact(F.aggregate(entries, F.array().cast("array<struct<key:string,value:string>>"), lambda acc, e: F.when(F.exists(acc, lambda a: a["key"] == e["key"]), acc).otherwise(F.concat(acc, F.array(e))))))


def parse(requests: DataFrame, query: str = "query", defaults: dict[str, str] | None = None) -> DataFrame:
    """Settings columns from query strings; what can't be read is ignored. ``defaults`` stand under what the query says."""
    df = requests.withColumn("_q", query_map(F.coalesce(F.col(query), F.lit(""))))
    if defaults:
        base = F.create_map(*[F.lit(x) for k, v in defaults.items() for x in (k, v)])
        df = df.withColumn("_q", F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key("_q", k)), "_q"))
    raw = lambda *names: F.coalesce(*[F.element_at("_q", F.lit(n)) for n in names])
    whole = lambda *names: F.greatest(F.coalesce(F.when(raw(*names).rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(raw(*names))).try_cast("int"), F.lit(0)), F.lit(0))
    one_of = lambda name, options, default: F.when(F.lower(F.trim(raw(name))).isin(*options), F.lower(F.trim(raw(name)))).otherwise(default)
    flag = F.lower(F.trim(raw("sharpen")))
    crop = F.when(raw("crop").rlike(r"^([0-9]+,){2}-?[0-9]+,-?[0-9]+$"), F.split(raw("crop"), ","))
    basis = F.when(raw("cropbasis").rlike(r"^[0-9]+,[0-9]+$"), F.split(raw("cropbasis"), ","))
    anchor = F.lower(F.coalesce(raw("anchor"), F.lit("")))
    good = anchor.rlike(r"^(top|middle|bottom)?-?(left|center|right)?$")
    part = lambda *names: F.coalesce(*[F.when(good & anchor.contains(n), n) for n in names], F.lit("center"))
    number = lambda arr, i: F.coalesce(F.get(arr, F.lit(i)).try_cast("int"), F.lit(0))
    form = F.lower(raw("format"))
    known = F.coalesce(*[F.when(F.concat(F.lit("."), form).isin(*EXTENSIONS[k]), k) for k in WRITABLE])
    names = F.create_map(*[F.lit(x) for k, v in FILTERS.items() for x in (k, v)])
    quality, sub = whole("quality", "q"), F.when(raw("subsample").rlike("^4(20|22|44)$"), raw("subsample")).try_cast("int")
    lossy = (quality > 0) | sub.isNotNull()
    return df.withColumns(
        {
            "width": whole("width", "w"),
            "height": whole("height", "h"),
            "sharpen": F.when(flag.isin("true", "false"), flag == "true").otherwise(True),
            "mode": one_of("mode", MODES, "crop"),
            "gamma": one_of("gamma", ("linear", "companded"), "linear"),
            "hybrid": one_of("hybrid", ("favorquality", "favorspeed", "turbo", "off"), "favorquality"),
            "format": F.when(form == "png8", "png").otherwise(known),
            "indexed": F.coalesce((form == "png8") & ~lossy, F.lit(False)),
            "crop_x": number(crop, 0),
            "crop_y": number(crop, 1),
            "crop_w": number(crop, 2),
            "crop_h": number(crop, 3),
            "basis_w": number(basis, 0),
            "basis_h": number(basis, 1),
            "anchor_x": part("left", "right"),
            "anchor_y": part("top", "bottom"),
            "subsample": sub,
            "quality": quality,
            "frame": whole("frame", "page"),
            "matte": parse_colour(F.trim(raw("bgcolor", "bg"))),
            "filter": F.element_at(names, F.lower(raw("filter"))),
        }
    ).drop("_q")


def _int(c: Column) -> Column:
    return c.cast("int")


def fixup(df: DataFrame, iw: str = "image_w", ih: str = "image_h") -> DataFrame:
    """Solve crop, inner and outer size for a row with settings columns and the (upright) image size.

    Whole-number rounding is half to even. Adds auto_crop, and replaces crop_*, mode and anchors by what they come to.
    """
    c = F.col
    w, h = c(iw), c(ih)
    has_crop = (c("crop_x") != 0) | (c("crop_y") != 0) | (c("crop_w") != 0) | (c("crop_h") != 0)
    based = has_crop & ((c("basis_w") != 0) | (c("basis_h") != 0))
    xr, yr = w / F.nullif(c("basis_w"), F.lit(0)), h / F.nullif(c("basis_h"), F.lit(0))
    bx, by = based & (c("basis_w") > 0), based & (c("basis_h") > 0)
    df = df.withColumn("_has", has_crop).withColumns({"_x": F.when(bx, _int(F.floor(c("crop_x") * xr))).otherwise(c("crop_x")), "_y": F.when(by, _int(F.floor(c("crop_y") * yr))).otherwise(c("crop_y"))})
    df = df.withColumns({"_w": F.when(bx, F.least(_int(F.ceil(c("crop_w") * xr)), w - c("_x"))).otherwise(c("crop_w")), "_h": F.when(by, F.least(_int(F.ceil(c("crop_h") * yr)), h - c("_y"))).otherwise(c("crop_h"))})
    # no width or height: up to the far edge; negative: that far from it
    far = lambda v, size, at: F.when(~c("_has") | (v > 0), v).when(v == 0, F.greatest(F.lit(1), size - at)).otherwise(F.least(F.greatest(size - at + v, F.lit(1)), F.greatest(F.lit(1), size - at)))
    df = df.withColumns({"_w": far(c("_w"), w, c("_x")), "_h": far(c("_h"), h, c("_y"))})
    outside = (c("_x") < 0) | (c("_y") < 0) | (c("_x") + c("_w") > w) | (c("_y") + c("_h") > h)
    df = df.withColumn("auto_crop", ~c("_has") | outside)
    df = df.withColumn("mode", F.when(((c("width") == 0) | (c("height") == 0)) & c("mode").isin("pad", "stretch"), "crop").otherwise(c("mode")))
    loose = ~c("auto_crop") | (c("mode") != "crop")
    df = df.withColumns({"anchor_x": F.when(loose, "center").otherwise(c("anchor_x")), "anchor_y": F.when(loose, "center").otherwise(c("anchor_y"))})
    tw, th = F.nullif(c("width"), F.lit(0)), F.nullif(c("height"), F.lit(0))
    df = df.withColumn("_wr", F.coalesce(w / tw, h / th)).withColumn("_hr", F.coalesce(h / th, c("_wr")))
    low = F.least("_wr", "_hr")
    fill = c("auto_crop") & (c("mode") == "crop")
    df = df.withColumns({"_ww": F.when(fill & (c("width") > 0), F.least(F.greatest(_int(F.ceil(low * c("width"))), F.lit(1)), w)).otherwise(w), "_hw": F.when(fill & (c("height") > 0), F.least(F.greatest(_int(F.ceil(low * c("height"))), F.lit(1)), h)).otherwise(h)})
    none = (c("width") == 0) & (c("height") == 0)
    place = lambda size, win, anchor, near, away: F.when(c(anchor) == near, 0).when(c(anchor) == away, size - win).otherwise(_int((size - win) / 2))
    half_even = lambda v: _int(F.bround(v, 0))
    df = df.withColumns(
        {
            "crop_x": F.when(~c("auto_crop"), c("_x")).when(fill & ~none, place(w, c("_ww"), "anchor_x", "left", "right")).otherwise(0),
            "crop_y": F.when(~c("auto_crop"), c("_y")).when(fill & ~none, place(h, c("_hw"), "anchor_y", "top", "bottom")).otherwise(0),
            "crop_w": F.when(~c("auto_crop"), c("_w")).when(fill & ~none, c("_ww")).otherwise(w),
            "crop_h": F.when(~c("auto_crop"), c("_h")).when(fill & ~none, c("_hw")).otherwise(h),
            "_tw": F.when(fill & (c("width") == 0), F.greatest(half_even(w / c("_wr")), F.lit(1))).otherwise(c("width")),
            "_th": F.when(fill & (c("height") == 0), F.greatest(half_even(h / c("_hr")), F.lit(1))).otherwise(c("height")),
        }
    )
    bound = c("mode").isin("contain", "max")
    most = 2147483647
    df = df.withColumns({"_tw": F.when((c("_tw") == 0) & bound, most).otherwise(c("_tw")), "_th": F.when((c("_th") == 0) & bound, most).otherwise(c("_th"))})
    df = df.withColumn("_wr", F.coalesce(c("crop_w") / F.nullif(c("_tw"), F.lit(0)), c("crop_h") / F.nullif(c("_th"), F.lit(0))))
    df = df.withColumn("_hr", F.coalesce(c("crop_h") / F.nullif(c("_th"), F.lit(0)), c("_wr")))
    high = F.greatest("_wr", "_hr")
    df = df.withColumn("_rat", F.when(c("mode") == "max", F.greatest(high, F.lit(1.0))).otherwise(high))
    fits = c("mode").isin("contain", "max", "pad")
    dim = F.greatest("_tw", "_th")
    side = lambda size: F.least(F.greatest(half_even(size / c("_rat")), F.lit(1)), dim)
    df = df.withColumns({"_fw": F.when(fits, side(c("crop_w"))).otherwise(c("_tw")), "_fh": F.when(fits, side(c("crop_h"))).otherwise(c("_th"))})
    inner_w = F.when(c("_fw") > 0, c("_fw")).otherwise(F.greatest(half_even(c("crop_w") / c("_wr")), F.lit(1)))
    inner_h = F.when(c("_fh") > 0, c("_fh")).otherwise(F.greatest(half_even(c("crop_h") / c("_hr")), F.lit(1)))
    df = df.withColumns({"inner_w": F.when(none, c("crop_w")).otherwise(inner_w), "inner_h": F.when(none, c("crop_h")).otherwise(inner_h)})
    keeps = c("mode").isin("crop", "contain", "max") | none
    df = df.withColumns({"outer_w": F.when(keeps, c("inner_w")).otherwise(c("width")), "outer_h": F.when(keeps, c("inner_h")).otherwise(c("height"))})
    return df.drop("_has", "_x", "_y", "_w", "_h", "_wr", "_hr", "_ww", "_hw", "_tw", "_th", "_rat", "_fw", "_fh")


def is_empty() -> Column:
    """Whether the settings ask for nothing, so that the file is answered as it is."""
    zero = [F.col(c) == 0 for c in ("width", "height", "crop_x", "crop_y", "crop_w", "crop_h", "basis_w", "basis_h", "quality", "frame")]
    out = F.col("sharpen") & ~F.col("indexed") & F.col("matte").isNull() & F.col("filter").isNull() & F.col("format").isNull() & F.col("subsample").isNull()
    for z in zero:
        out = out & z
    return out


def scale_ratio() -> Column:
    return F.least(F.col("crop_w") / F.col("inner_w"), F.col("crop_h") / F.col("inner_h"))


def hybrid_ratio(ratio: Column, mode: Column) -> Column:
    """The power of two to halve by first: 2^floor(log2(ratio / k)), between 1 and 32; k is 3, 2 or 1 for quality, speed, turbo."""
    k = F.when(mode == "favorspeed", 2).when(mode == "turbo", 1).otherwise(3)
    power = F.floor(F.log2(F.greatest(ratio / k, F.lit(1.0))))
    return F.when(mode == "off", 1).otherwise(F.least(F.pow(F.lit(2.0), power.cast("double")), F.lit(32.0))).cast("int")


def defaults(df: DataFrame) -> DataFrame:
    """Quality by size, subsampling by quality, filter and sharpening by ratio, where the request names none."""
    side = F.greatest("outer_w", "outer_h")
    quality = F.lit(83)
    for most, q in reversed(QUALITY):
        quality = F.when(side <= most, q).otherwise(quality)
    df = df.withColumn("ratio", scale_ratio()).withColumn("hybrid_ratio", hybrid_ratio(F.col("ratio"), F.col("hybrid")))
    df = df.withColumn("quality", F.when(F.col("quality") > 0, F.least(F.col("quality"), F.lit(100))).otherwise(quality))
    df = df.withColumn("subsample", F.coalesce("subsample", F.when(F.col("quality") >= 95, 444).when(F.col("quality") >= 90, 422).otherwise(420)))
    r = F.col("ratio") / F.col("hybrid_ratio")
    chosen = F.when(r == 1, "linear").when(r < 0.5, "lanczos").when(r > 16, "quadratic").when(r > 4, "catmullrom").otherwise("spline36")
    sharp = lambda i: _ladder(F.col("ratio"), i)
    on = F.col("sharpen") & (F.col("ratio") != 1)
    return df.withColumns({"filter": F.coalesce("filter", chosen), **{n: F.when(on, sharp(i)).otherwise(F.lit(0.0)) for i, n in enumerate(("unsharp_amount", "unsharp_radius", "unsharp_threshold"))}})


def _ladder(ratio: Column, i: int) -> Column:
    out = F.lit(float((150, 0.5, 0)[i]))
    for below, values in reversed(UNSHARP):
        out = F.when(ratio < below, float(values[i])).otherwise(out)
    return out


def guess_format(df: DataFrame, mime: str = "mime", alpha: str = "has_alpha") -> Column:
    """GIF stays GIF; PNG, and whatever needs alpha without an opaque matte, becomes PNG; the rest JPEG."""
    opaque = F.coalesce(F.shiftrightunsigned(F.col("matte"), 24) == 255, F.lit(False))
    bordered = (F.col("inner_w") != F.col("outer_w")) | (F.col("inner_h") != F.col("outer_h"))
    return F.coalesce("format", F.when(F.col(mime) == "image/gif", "gif").when((F.col(mime) == "image/png") | ((F.col(alpha) | bordered) & ~opaque), "png").otherwise("jpeg"))
