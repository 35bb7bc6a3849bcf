"""The registered queries and, for each that SQL can express, the same computation in SQL for another engine."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import colour as curves
from .functions import kernels, numbers
from .operators import animation, colour, dense, geometry, palette, planar, resample
from .plans import formats, pipeline, process, requests, settings, views
from .plans.views import sql
from .sources import images, synthetic
from .sources import sniff as sniffing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return keep


# SQL pieces: sRGB curves and bytes, written out for the other engine.
def _lin(x: str) -> str:
    return f"(CASE WHEN {x} <= 0.04045::DOUBLE THEN {x} / 12.92::DOUBLE ELSE pow(({x} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END)"


def _comp(x: str) -> str:
    return f"(CASE WHEN {x} <= 0.04045::DOUBLE / 12.92::DOUBLE THEN {x} * 12.92::DOUBLE ELSE 1.055::DOUBLE * pow({x}, 1::DOUBLE / 2.4::DOUBLE) - 0.055::DOUBLE END)"


def _byte(x: str) -> str:
    return f"least(greatest(floor(({x}) * 255 + 0.5::DOUBLE), 0), 255)::INT"


BGR = "image_id, y, x, {b} AS b, {g} AS g, {r} AS r"
each = lambda f: ", ".join(f"{f(c)} AS {c}" for c in "bgr")

def _six(v: str) -> Column:
    """Six places, and no negative zero."""
    return F.when(F.abs(v) < 5e-7, 0.0).otherwise(F.round(v, 6))


# geometry ------------------------------------------------------------------------------


@query("crop", sql("pb", "SELECT vec_id, y - 1 AS y, x - 2 AS x, v FROM pb WHERE x >= 2 AND x < 7 AND y >= 1 AND y < 5"))
def _(spark, d):
    return geometry.crop(views.px_byte(spark, d), 2, 1, 5, 4, (8, 8))


_PLANES = """, planes AS (SELECT image_id, 'Y' AS plane, y, x, b AS v FROM rgb UNION ALL
 SELECT image_id, 'Cb', y // 2, x // 2, g FROM rgb WHERE x % 2 = 0 AND y % 2 = 0 UNION ALL SELECT image_id, 'Cr', y // 2, x // 2, r FROM rgb WHERE x % 2 = 0 AND y % 2 = 0)"""


def _planes(spark, d):
    rgb = views.px_rgb(spark, d)
    even = rgb.where("x % 2 = 0 and y % 2 = 0").select("image_id", F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x"), "g", "r")
    part = lambda df, p, c: df.select("image_id", F.lit(p).alias("plane"), "y", "x", F.col(c).alias("v"))
    return part(rgb, "Y", "b").union(part(even, "Cb", "g")).union(part(even, "Cr", "r"))


@query("planar_crop", sql("rgb", _PLANES + """
SELECT image_id, plane, y - 2 AS y, x - 2 AS x, v FROM planes WHERE plane = 'Y' AND x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 7
UNION ALL SELECT image_id, plane, y - 1, x - 1, v FROM planes WHERE plane <> 'Y' AND x BETWEEN 1 AND 2 AND y BETWEEN 1 AND 3"""))
def _(spark, d):
    return geometry.planar_crop(_planes(spark, d), 3, 3, 3, 4, (2, 2), (8, 8))


for _o, (_name, _y, _x) in enumerate((("identity", "y", "x"), ("flip_h", "y", "7 - x"), ("rotate_180", "7 - y", "7 - x"), ("flip_v", "7 - y", "x"), ("transpose", "x", "y"), ("rotate_90", "x", "7 - y"), ("transverse", "7 - x", "7 - y"), ("rotate_270", "7 - x", "y")), 1):
    query(_name, sql("pb", f"SELECT vec_id, {_y} AS y, {_x} AS x, v FROM pb"))(lambda spark, d, o=_o: geometry.orient(views.px_byte(spark, d), o, 8, 8))


@query("orient_by_column", sql("pb", """, o AS (SELECT *, (vec_id % 8 + 1)::INT AS orientation FROM pb)
SELECT vec_id, orientation,
 CASE orientation WHEN 1 THEN y WHEN 2 THEN y WHEN 3 THEN 7 - y WHEN 4 THEN 7 - y WHEN 5 THEN x WHEN 6 THEN x ELSE 7 - x END AS y,
 CASE orientation WHEN 1 THEN x WHEN 2 THEN 7 - x WHEN 3 THEN 7 - x WHEN 4 THEN x WHEN 5 THEN y WHEN 6 THEN 7 - y WHEN 7 THEN 7 - y ELSE y END AS x, v FROM o"""))
def _(spark, d):
    px = views.px_byte(spark, d).select("vec_id", (F.col("vec_id") % 8 + 1).cast("int").alias("orientation"), "y", "x", "v")
    return geometry.orient(px, F.col("orientation"), 8, 8)


@query("pad", sql("pb", """, cells AS (SELECT DISTINCT vec_id, cy, cx FROM pb, (SELECT unnest(range(11))::INT AS cy), (SELECT unnest(range(13))::INT AS cx))
SELECT c.vec_id, cy AS y, cx AS x, coalesce(v, 7) AS v FROM cells c LEFT JOIN pb ON pb.vec_id = c.vec_id AND pb.y + 1 = cy AND pb.x + 4 = cx"""))
def _(spark, d):
    return geometry.pad(views.px_byte(spark, d), ["vec_id"], 8, 8, 1, 1, 2, 4, {"v": 7})


_TOP = ", t AS (SELECT image_id, y + 1 AS y, x + 2 AS x, r AS tb, b AS tg, g AS tr, a AS ta FROM bgra WHERE y < 6 AND x < 6)"


def _two(spark, d):
    base = views.px_bgra(spark, d)
    return base.withColumn("a", F.lit(200)), base.where("y < 6 and x < 6").select("image_id", "y", "x", F.col("r").alias("b"), F.col("b").alias("g"), F.col("g").alias("r"), "a")


for _mode, _takes in (("over", "coalesce(ta >= 128, false)"), ("source", "ta IS NOT NULL")):
    query(f"overlay_{_mode}", sql("bgra", f"{_TOP} SELECT image_id, y, x, {', '.join(f'CASE WHEN {_takes} THEN t{c} ELSE {c if c != "a" else 200} END AS {c}' for c in 'bgra')} FROM bgra LEFT JOIN t USING (image_id, y, x)"))(
        lambda spark, d, m=_mode: geometry.overlay(*_two(spark, d), ["image_id"], m, 2, 1)
    )

_U = "(200 / 255::DOUBLE * (1 - ta / 255::DOUBLE))"
_OA = f"(ta / 255::DOUBLE + {_U})"


@query("overlay_blend", sql("bgra", f"""{_TOP} SELECT image_id, y, x, {', '.join(f"CASE WHEN coalesce(ta, 0) = 0 THEN {c} WHEN ta = 255 THEN t{c} ELSE " + _byte(_comp("((" + _lin(f"(t{c} / 255::DOUBLE)") + " * (ta / 255::DOUBLE) + " + _lin(f"({c} / 255::DOUBLE)") + f" * {_U}) / {_OA})")) + f" END AS {c}" for c in "bgr")},
 CASE WHEN coalesce(ta, 0) = 0 THEN 200 WHEN ta = 255 THEN 255 ELSE {_byte(_OA)} END AS a FROM bgra LEFT JOIN t USING (image_id, y, x)"""))
def _(spark, d):
    return geometry.overlay(*_two(spark, d), ["image_id"], "blend", 2, 1)


# points ----------------------------------------------------------------------------------


@query("invert", sql("pb", "SELECT vec_id, y, x, 255 - v AS v FROM pb"))
def _(spark, d):
    return colour.invert(views.px_byte(spark, d), "v")


@query("widen_narrow", sql("pb", """SELECT vec_id, y, x, v, round(v / 255::DOUBLE, 9) AS wide, round((v - 16) / 219::DOUBLE, 9) AS video, round((v - 128) / 224::DOUBLE, 9) AS chroma,
 least(greatest(floor(v / 300::DOUBLE * 219 + 16 + 0.5::DOUBLE), 0), 255)::INT AS narrow FROM pb"""))
def _(spark, d):
    v = F.col("v")
    return views.px_byte(spark, d).select("vec_id", "y", "x", "v", F.round(colour.widen(v), 9).alias("wide"), F.round(colour.widen(v, "luma_video"), 9).alias("video"), F.round(colour.widen(v, "chroma_video"), 9).alias("chroma"), colour.narrow(v / F.lit(300.0), "luma_video").alias("narrow"))


@query("to_linear", sql("pb", f"SELECT vec_id, y, x, round({_lin('(v / 255::DOUBLE)')}, 9) AS v FROM pb"))
def _(spark, d):
    return views.px_byte(spark, d).withColumn("v", F.round(curves.to_linear(F.col("v") / 255), 9))


@query("from_linear", sql("pb", f"SELECT vec_id, y, x, {_byte(_comp('(v / 255::DOUBLE)'))} AS v FROM pb"))
def _(spark, d):
    return views.px_byte(spark, d).withColumn("v", curves.to_byte(curves.from_linear(F.col("v") / 255)))


@query("uq15", sql("pb", """, q AS (SELECT *, ((v * 32768 + 127) // 255)::INT AS fixed FROM pb)
SELECT vec_id, y, x, v, fixed, (((fixed * 255 + 16384) >> 15))::INT AS back, ((fixed * fixed + 16384) >> 15)::BIGINT AS squared FROM q"""))
def _(spark, d):
    q = views.px_byte(spark, d).withColumn("fixed", numbers.byte_to_uq15(F.col("v")))
    wide = F.col("fixed").cast("long")
    return q.withColumns({"back": numbers.uq15_to_byte(F.col("fixed")), "squared": numbers.uq15_product(wide, wide)})


@query("narrow_16", sql("pb", "SELECT vec_id, y, x, ((v * 257 + 3) >> 8)::INT AS v FROM pb"))
def _(spark, d):
    return views.px_byte(spark, d).withColumn("v", F.shiftright(F.col("v") * 257 + 3, 8))


@query("luma_range", sql("pb", "SELECT vec_id, y, x, least((greatest(v - 16, 0) * 255 + 109) // 219, 255)::INT AS \"full\", ((v * 219 + 127) // 255 + 16)::INT AS video FROM pb"))
def _(spark, d):
    return views.px_byte(spark, d).select("vec_id", "y", "x", colour.luma_to_full(F.col("v")).alias("full"), colour.luma_to_video(F.col("v")).alias("video"))


@query("chroma_range", sql("pb", """SELECT vec_id, y, x, least(greatest(trunc(((v - 128) * 127 + CASE WHEN v < 128 THEN -56 ELSE 56 END) / 112::DOUBLE) + 128, 0), 255)::INT AS "full",
 least(greatest(trunc(((v - 128) * 112 + CASE WHEN v < 128 THEN -63 ELSE 63 END) / 127::DOUBLE) + 128, 0), 255)::INT AS video FROM pb"""))
def _(spark, d):
    return views.px_byte(spark, d).select("vec_id", "y", "x", colour.chroma_to_full(F.col("v")).alias("full"), colour.chroma_to_video(F.col("v")).alias("video"))


@query("swizzle", sql("bgra", "SELECT image_id, y, x, b FROM bgra"))
def _(spark, d):
    return colour.swizzle(views.px_bgra(spark, d), 4, 1)


@query("swizzle_up", sql("pb", "SELECT vec_id, y, x, v AS b, v AS g, v AS r, 255 AS a FROM pb"))
def _(spark, d):
    return colour.swizzle(views.px_byte(spark, d).withColumnRenamed("v", "b"), 1, 4)


@query("swap_channels", sql("rgb", "SELECT image_id, y, x, r AS b, g, b AS r FROM rgb"))
def _(spark, d):
    return colour.swap(views.px_rgb(spark, d))


@query("convert_linear", sql("rgb", f"SELECT image_id, y, x, {each(lambda c: f'round({_lin(f"({c} / 255::DOUBLE)")}, 9)')} FROM rgb"))
def _(spark, d):
    px = colour.convert(views.px_rgb(spark, d), "Bgr24", "Bgr96FloatLinear")
    return px.withColumns({c: F.round(c, 9) for c in "bgr"})


@query("grey", sql("rgb", "SELECT image_id, y, x, round(r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE, 6) AS companded, round(r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE, 6) AS linear FROM rgb"))
def _(spark, d):
    return views.px_rgb(spark, d).select("image_id", "y", "x", F.round(colour.grey(), 6).alias("companded"), F.round(colour.grey(True), 6).alias("linear"))


#: Each output channel as a sum of the inputs, written out apart from the library's table.
_PRESET_SQL = {
    "grey": ("(r * 0.299 + g * 0.587 + b * 0.114) / 255", "(r * 0.299 + g * 0.587 + b * 0.114) / 255", "(r * 0.299 + g * 0.587 + b * 0.114) / 255"),
    "sepia": ("(r * 0.393 + g * 0.769 + b * 0.189) / 255", "(r * 0.349 + g * 0.686 + b * 0.168) / 255", "(r * 0.272 + g * 0.534 + b * 0.131) / 255"),
    "polaroid": ("(r * 1.438 + g * -0.122 + b * -0.016) / 255 + -0.03", "(r * -0.062 + g * 1.378 + b * -0.016) / 255 + 0.05", "(r * -0.062 + g * -0.122 + b * 1.483) / 255 + -0.02"),
    "negative": ("(255 - r) / 255", "(255 - g) / 255", "(255 - b) / 255"),
}
for _m, _sums in _PRESET_SQL.items():
    _made = ", ".join(_byte(re.sub(r"(-?[0-9]+[.][0-9]+|255$)", r"(\1::DOUBLE)", e).replace("/ 255 ", "/ 255::DOUBLE ")) + f" AS {c}" for c, e in zip("rgb", _sums, strict=True))
    query(f"colour_matrix_{_m}", sql("rgb", f"SELECT image_id, y, x, {_made} FROM rgb"))(lambda spark, d, m=_m: colour.colour_matrix(views.px_rgb(spark, d), m))

_PA, _MA = "(a / 255::DOUBLE)", "(128 / 255::DOUBLE)"
_MO = f"({_PA} + {_MA} * (1 - {_PA}))"


@query("matte", sql("bgra", f"""SELECT image_id, y, x, {', '.join(f"CASE WHEN a = 0 THEN {m} WHEN a = 255 THEN {c} ELSE " + _byte(_comp("((" + _lin(f"({c} / 255::DOUBLE)") + f" * {_PA} + " + _lin(f"({m} / 255::DOUBLE)") + f" * {_MA} * (1 - {_PA})) / {_MO})")) + f" END AS {c}" for c, m in (("b", 10), ("g", 200), ("r", 90)))},
 CASE WHEN a = 0 THEN 128 ELSE {_byte(_MO)} END AS a FROM bgra"""))
def _(spark, d):
    return colour.matte(views.px_bgra(spark, d), 10, 200, 90, 128)


#: sRGB to Display P3, as published for the web (rows r, g, b).
_P3 = ((0.8224621, 0.177538, 0.0), (0.0331941, 0.9668058, 0.0), (0.0170827, 0.0723974, 0.9105199))


@query("profile_convert", sql("rgb", "SELECT image_id, y, x, " + ", ".join(_byte(_comp(f"least(greatest({' + '.join(_lin(f'({s} / 255::DOUBLE)') + f' * ({float(_P3[i][j])!r}::DOUBLE)' for j, s in enumerate('rgb'))}, 0), 1)")) + f" AS {c}" for i, c in enumerate("rgb")) + " FROM rgb"))
def _(spark, d):
    return colour.convert_profile(views.px_rgb(spark, d), "srgb", "displayp3")


@query("palette_expand", sql("pb", "SELECT vec_id, y, x, v // 16 AS idx, CASE WHEN v // 16 < 12 THEN (v // 16) * 20 ELSE 0 END AS b, CASE WHEN v // 16 < 12 THEN 255 - (v // 16) * 20 ELSE 255 END AS g, 7 AS r, 255 AS a FROM pb"))
def _(spark, d):
    entries = F.array(*[F.lit((255 << 24) | (7 << 16) | ((255 - 20 * i) << 8) | 20 * i) for i in range(12)])
    px = views.px_byte(spark, d).withColumn("idx", F.floor(F.col("v") / 16).cast("int")).withColumn("palette", entries).drop("v")
    return colour.by_palette(px).drop("palette")


# planes ----------------------------------------------------------------------------------


@query("planar_to_bgr", sql("rgb", f"SELECT image_id, y, x, {_byte('(b + 1.772::DOUBLE * (g - 128)) / 255')} AS b, {_byte('(b - 0.114::DOUBLE * 1.772::DOUBLE / 0.587::DOUBLE * (g - 128) - 0.299::DOUBLE * 1.402::DOUBLE / 0.587::DOUBLE * (r - 128)) / 255')} AS g, {_byte('(b + 1.402::DOUBLE * (r - 128)) / 255')} AS r FROM rgb"))
def _(spark, d):
    rgb = views.px_rgb(spark, d)
    part = lambda p, c: rgb.select("image_id", F.lit(p).alias("plane"), "y", "x", F.col(c).alias("v"))
    return planar.to_bgr(part("Y", "b").union(part("Cb", "g")).union(part("Cr", "r")), ["image_id"])


_YCC = {"Y": "r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE", "Cb": "(b - (r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE)) / 1.772::DOUBLE + 128", "Cr": "(r - (r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE)) / 1.402::DOUBLE + 128"}
_FROM_BGR = ", planes AS (" + " UNION ALL ".join(f"SELECT image_id, '{p}' AS plane, y, x, least(greatest(floor(round({e}, 6) + 0.5::DOUBLE), 0), 255)::INT AS v FROM rgb" for p, e in _YCC.items()) + ")"


@query("subsample_420", sql("rgb", f"""{_FROM_BGR} SELECT * FROM planes WHERE plane = 'Y' UNION ALL
SELECT image_id, plane, (y // 2)::INT, (x // 2)::INT, floor(avg(v) + 0.5::DOUBLE)::INT FROM planes WHERE plane <> 'Y' GROUP BY ALL"""))
def _(spark, d):
    return planar.subsample(planar.from_bgr(views.px_rgb(spark, d), ["image_id"]), ["image_id"], 420)


# weights ---------------------------------------------------------------------------------

_CUBIC = lambda b, c, far=2: f"CASE WHEN d < 1 THEN ((12 - 9 * {b} - 6 * {c}) * d * d * d + (12 * {b} + 6 * {c} - 18) * d * d + 6 - 2 * {b}) / 6 WHEN d < {far} THEN ((-{b} - 6 * {c}) * d * d * d + (6 * {b} + 30 * {c}) * d * d - (12 * {b} + 48 * {c}) * d + 8 * {b} + 24 * {c}) / 6 ELSE 0 END"
_D = lambda x: f"({x!r}::DOUBLE)"
#: name: (support, blur, value of d in SQL)
_VALUES = {
    "nearestneighbor": (1e-8, 1.0, "1"),
    "average": (0.5, 1.0, "CASE WHEN d <= 0.5 THEN 1 ELSE 0 END"),
    "linear": (1.0, 1.0, "greatest(0, 1 - d)"),
    "hermite": (1.0, 1.0, _CUBIC(_D(0.0), _D(0.0), 1)),
    "quadratic": (1.5, 1.0, "CASE WHEN d < 0.5 THEN d * d * -2 + 1 WHEN d < 1.5 THEN d * d - 2.5::DOUBLE * d + 1.5::DOUBLE ELSE 0 END"),
    "mitchell": (2.0, 1.0, _CUBIC("(1::DOUBLE / 3)", "(1::DOUBLE / 3)")),
    "catmullrom": (2.0, 1.0, _CUBIC(_D(0.0), _D(0.5))),
    "cubic": (2.0, 1.0, _CUBIC(_D(0.0), _D(1.0))),
    "cubicsmoother": (2.0, 1.15, _CUBIC(_D(0.0), _D(0.625))),
    "lanczos": (3.0, 1.0, "CASE WHEN d < 5e-10 THEN 1 WHEN d < 3 THEN 3 * sin(pi() * d) * sin(pi() * d / 3) / (pi() * pi() * d * d) ELSE 0 END"),
    "spline36": (3.0, 1.0, "CASE WHEN d < 1 THEN ((13::DOUBLE / 11 * d - 453::DOUBLE / 209) * d - 3::DOUBLE / 209) * d + 1 WHEN d < 2 THEN ((-6::DOUBLE / 11 * (d - 1) + 270::DOUBLE / 209) * (d - 1) - 156::DOUBLE / 209) * (d - 1) WHEN d < 3 THEN ((1::DOUBLE / 11 * (d - 2) - 45::DOUBLE / 209) * (d - 2) + 26::DOUBLE / 209) * (d - 2) ELSE 0 END"),
}


def _kernel_sql(isize: int, osize: int, support: float, blur: float, value: str, name: str = "k") -> str:
    """The kernel's rules in SQL, from the interpolator's formula."""
    scale = min(osize / isize, 1) / (1.0 if support * blur < 0.5 else blur)
    reach = support / scale
    if isize < 3 and 2 * reach > isize:
        reach = isize / 2
    taps = math.ceil(2 * reach)
    offset = 0.5 if support < 1e-6 else 0.0
    return f""", {name}t AS (SELECT o, o * {isize}::DOUBLE / {osize} + {(isize - osize) / (2 * osize) + offset!r}::DOUBLE AS pos FROM (SELECT unnest(range({osize}))::INT AS o)),
 {name}s AS (SELECT o, pos, trunc(pos + {reach!r}::DOUBLE)::INT - {taps} + 1 AS start FROM {name}t),
 {name}d AS (SELECT o, start + j AS tap, abs((start - pos + j) * {scale!r}::DOUBLE) AS d FROM {name}s, (SELECT unnest(range({taps}))::INT AS j)),
 {name}v AS (SELECT o, tap, ({value})::DOUBLE AS raw FROM {name}d),
 {name} AS (SELECT o, least(greatest(tap, 0), {isize - 1})::INT AS i, sum(raw / total) AS w FROM {name}v JOIN (SELECT o, sum(raw) AS total FROM {name}v GROUP BY o) USING (o) GROUP BY ALL)"""


def _two_sums(kernel: str, source: str = "px", expr: str = "v", out: str = "CASE WHEN abs(sum(h.v * k.w)) < 5e-7 THEN 0 ELSE round(sum(h.v * k.w), 6) END AS v") -> str:
    return f"""{kernel}, h AS (SELECT vec_id, y, k.o AS x, sum({expr} * k.w) AS v FROM {source} p JOIN k ON k.i = p.x GROUP BY ALL)
SELECT vec_id, k.o AS y, x, {out} FROM h JOIN k ON k.i = h.y GROUP BY ALL"""


def _scaled(name: str, isize=8, osize=4):
    return lambda spark, d: resample.resample(views.px_embed(spark, d), ["vec_id"], (isize, isize), (osize, osize), kernels.PRESETS[name]).withColumn("v", _six("v"))


for _f, (_s, _b, _v) in _VALUES.items():
    query("resample_catrom" if _f == "catmullrom" else f"resample_{_f}", sql("px", _two_sums(_kernel_sql(8, 4, _s, _b, _v))))(_scaled(_f))
query("resample_up", sql("px", _two_sums(_kernel_sql(8, 13, *_VALUES["lanczos"]))))(_scaled("lanczos", 8, 13))


@query("resample_dense", sql("px", _two_sums(_kernel_sql(8, 4, *_VALUES["catmullrom"]))))
def _(spark, d):
    e = views.read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    out = dense.resample(e, "vec_id", "v", (8, 8), (4, 4), kernels.PRESETS["catmullrom"]).select("vec_id", F.posexplode("v").alias("p", "v"))
    return out.select("vec_id", F.floor(F.col("p") / 4).cast("int").alias("y"), (F.col("p") % 4).cast("int").alias("x"), _six("v").alias("v"))


@query("resample_alpha", sql("bgra", _kernel_sql(8, 4, *_VALUES["linear"]) + f""", h AS (SELECT image_id, y, k.o AS x, {', '.join(f'sum({c}::DOUBLE * a * k.w) AS {c}' for c in 'bgr')}, sum(a * k.w) AS a FROM bgra p JOIN k ON k.i = p.x GROUP BY ALL),
 z AS (SELECT image_id, k.o AS y, x, {', '.join(f'sum({c} * k.w) AS {c}' for c in 'bgra')} FROM h JOIN k ON k.i = h.y GROUP BY ALL)
SELECT image_id, y, x, {each(lambda c: f'round(CASE WHEN abs(a) > 1e-12 THEN {c} / a ELSE 0 END, 5)')}, round(a, 5) AS a FROM z"""))
def _(spark, d):
    px = resample.resample_alpha(views.px_bgra(spark, d), ["image_id"], (8, 8), (4, 4), kernels.PRESETS["linear"])
    return px.withColumns({c: F.round(c, 5) for c in "bgra"})


@query("resample_mixed", sql("px", f"""{_kernel_sql(8, 4, *_VALUES['linear'])} {_kernel_sql(8, 3, *_VALUES['linear'], name='m')},
 n AS (SELECT *, 4 AS size FROM k UNION ALL SELECT *, 3 FROM m), p AS (SELECT *, CASE WHEN vec_id % 2 = 0 THEN 4 ELSE 3 END AS size FROM px),
 h AS (SELECT vec_id, p.size, y, n.o AS x, sum(v * n.w) AS v FROM p JOIN n ON n.i = p.x AND n.size = p.size GROUP BY ALL)
SELECT vec_id, n.o AS y, x, CASE WHEN abs(sum(h.v * n.w)) < 5e-7 THEN 0 ELSE round(sum(h.v * n.w), 6) END AS v FROM h JOIN n ON n.i = h.y AND n.size = h.size GROUP BY vec_id, n.o, x"""))
def _(spark, d):
    e = views.read(spark, d, "embeddings")
    side = F.when(F.col("vec_id") % 2 == 0, 4).otherwise(3)
    shapes = e.select("vec_id", F.lit(8).alias("iw"), F.lit(8).alias("ih"), side.alias("ow"), side.alias("oh"))
    return resample.resample_mixed(views.px_embed(spark, d), shapes, ["vec_id"], kernels.PRESETS["linear"]).withColumn("v", _six("v"))


_GAUSS = _kernel_sql(8, 8, 3 * 1.25, 1.0, f"CASE WHEN d < 3.75 THEN exp(-d * d / {2 * 1.25**2!r}::DOUBLE) / {math.sqrt(2 * math.pi * 1.25**2)!r}::DOUBLE ELSE 0 END")


@query("gaussian_blur", sql("px", _two_sums(_GAUSS)))
def _(spark, d):
    return resample.gaussian_blur(views.px_embed(spark, d), ["vec_id"], (8, 8), 1.25).withColumn("v", _six("v"))


@query("blur_dense", sql("px", _two_sums(_GAUSS)))
def _(spark, d):
    e = views.read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    out = dense.gaussian_blur(e, "vec_id", "v", (8, 8), 1.25).select("vec_id", F.posexplode("v").alias("p", "v"))
    return out.select("vec_id", F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).cast("int").alias("x"), _six("v").alias("v"))


@query("unsharp", sql("pb", f"""{_GAUSS}, h AS (SELECT vec_id, y, k.o AS x, sum(v * k.w) AS v FROM pb p JOIN k ON k.i = p.x GROUP BY ALL),
 s AS (SELECT vec_id, k.o AS y, x, sum(h.v * k.w) AS soft FROM h JOIN k ON k.i = h.y GROUP BY ALL)
SELECT vec_id, y, x, round(least(greatest(v + CASE WHEN abs(v - soft) > 4 THEN (v - soft) * 0.75::DOUBLE ELSE 0 END, 0), 255), 6) AS v FROM pb JOIN s USING (vec_id, y, x)"""))
def _(spark, d):
    return resample.unsharp(views.px_byte(spark, d), ["vec_id"], (8, 8), 75, 1.25, 4).withColumn("v", F.round("v", 6))


@query("hybrid_half", sql("pb", """, c AS (SELECT vec_id, y // 2 AS y, x // 2 AS x, max(CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN v END) AS v00, max(CASE WHEN y % 2 = 0 AND x % 2 = 1 THEN v END) AS v01,
 max(CASE WHEN y % 2 = 1 AND x % 2 = 0 THEN v END) AS v10, max(CASE WHEN y % 2 = 1 AND x % 2 = 1 THEN v END) AS v11 FROM pb WHERE y < 7 AND x < 7 GROUP BY ALL)
SELECT vec_id, y::INT AS y, x::INT AS x, ((((v00 + coalesce(v10, v00) + 1) >> 1) + ((coalesce(v01, v00) + coalesce(v11, v01, v10, v00) + 1) >> 1)) >> 1)::INT AS v FROM c"""))
def _(spark, d):
    return resample.hybrid_half(geometry.crop(views.px_byte(spark, d), 0, 0, 7, 7), ["vec_id"], (7, 7))


# palettes --------------------------------------------------------------------------------


def _octree(level: int) -> str:
    return "(" + " + ".join(f"(((({c} >> {7 - k}) & 1)) << {3 * (level - 1 - k) + n})" for k in range(level) for n, c in ((2, "r"), (1, "g"), (0, "b"))) + ")::INT"


@query("histogram", sql("rgb", f"SELECT image_id, {_octree(5)} AS node, count(*) AS n, sum(b)::BIGINT AS sb, sum(g)::BIGINT AS sg, sum(r)::BIGINT AS sr FROM rgb GROUP BY ALL"))
def _(spark, d):
    return palette.histogram(views.px_rgb(spark, d), ["image_id"], 5)


@query("exact_palette", sql("rgb", "SELECT image_id, count(DISTINCT (b, g, r)) AS colours, count(DISTINCT (b, g, r)) <= 60 AS exact FROM rgb GROUP BY image_id"))
def _(spark, d):
    return palette.exact(views.px_rgb(spark, d), ["image_id"], 60)


_SIB = lambda c: _comp(f"s.{c}")


@query("palette_topn", sql("rgb", f""", hist AS (SELECT image_id, {_octree(4)} AS node, count(*) AS n, sum(b) AS sb, sum(g) AS sg, sum(r) AS sr FROM rgb GROUP BY ALL),
 lin AS (SELECT image_id, node, node >> 3 AS parent, node & 7 AS child, n, {', '.join(_lin(f'(s{c}::DOUBLE / n / 255)') + f' AS {c}' for c in 'bgr')} FROM hist),
 pairs AS (SELECT l.image_id, l.node, s.b, s.g, s.r, row_number() OVER (PARTITION BY l.image_id, l.node ORDER BY xor(s.child, l.child)) AS k FROM lin l JOIN lin s
  ON s.image_id = l.image_id AND s.parent = l.parent AND (s.n > l.n OR (s.n = l.n AND s.child > l.child))),
 own AS (SELECT l.*, {', '.join(_comp(f'l.{c}') + f' AS c{c}' for c in 'bgr')}, {', '.join(_SIB(c) + f' AS o{c}' for c in 'bgr')}, s.image_id IS NULL AS alone FROM lin l LEFT JOIN pairs s ON s.image_id = l.image_id AND s.node = l.node AND s.k = 1),
 weighed AS (SELECT *, CASE WHEN alone THEN n::DOUBLE ELSE n * sqrt((2 + (cr + "or") / 2) * (cr - "or") * (cr - "or") + 4 * (cg - og) * (cg - og) + (3 - (cr + "or") / 2) * (cb - ob) * (cb - ob)) * 4 END AS weight FROM own),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(weight, 6), node) AS rank, count(*) OVER (PARTITION BY image_id) AS total FROM weighed)
SELECT image_id, (rank - greatest(total - 6, 0) - 1)::INT AS idx, {', '.join(_byte(f'c{c}') + f' AS {c}' for c in 'bgr')} FROM ranked WHERE rank > total - 6""".replace("AS or", 'AS "or"')))
def _(spark, d):
    return palette.reduce_palette(palette.histogram(views.px_rgb(spark, d), ["image_id"], 4), ["image_id"], 6)


_PAL = [(i * 37 % 256, i * 91 % 256, i * 151 % 256) for i in range(16)]


@query("nearest_palette", sql("rgb", f""", pal AS (SELECT * FROM (VALUES {', '.join(f'({i}, {b}, {g}, {r})' for i, (b, g, r) in enumerate(_PAL))}) t(idx, pb, pg, pr)),
 m AS (SELECT image_id, y, x, b, g, r, ((pr - r) * (pr - r) * (1024 + pr + r) + (pg - g) * (pg - g) * 2048 + (pb - b) * (pb - b) * (1536 - pr - r))::BIGINT * 64 + idx AS code FROM rgb, pal)
SELECT image_id, y, x, b, g, r, (min(code) % 64)::INT AS idx FROM m GROUP BY ALL"""))
def _(spark, d):
    entries = spark.createDataFrame([(i, *c) for i, c in enumerate(_PAL)], "idx int, b int, g int, r int")
    return palette.nearest(views.px_rgb(spark, d), entries)


@query("dither")
def _(spark, d):
    return palette.dither(views.px_rgb(spark, d), ["image_id"], _PAL)


# animation -------------------------------------------------------------------------------


@query("frame_range", sql("fr", "SELECT * FROM fr WHERE frame_no >= 2 AND frame_no < 5"))
def _(spark, d):
    return animation.frame_range(views.frames(spark, d), 2, 3)


@query("dedupe", sql("pf", """, s AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY image_id, y, x ORDER BY frame_no) = v, false) AS same FROM pf)
SELECT *, CASE WHEN NOT same THEN v END AS out FROM s"""))
def _(spark, d):
    return animation.dedupe(views.px_frames(spark, d), ["image_id", "y", "x"])


_SAME = ", s AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY image_id, y, x ORDER BY frame_no) = v, false) AS same FROM pf)"


@query("dirty_rect", sql("pf", _SAME + """, c AS (SELECT image_id, frame_no, min(CASE WHEN NOT same THEN x END) AS x0, min(CASE WHEN NOT same THEN y END) AS y0, max(CASE WHEN NOT same THEN x END) AS x1, max(CASE WHEN NOT same THEN y END) AS y1 FROM s GROUP BY ALL)
SELECT image_id, frame_no, coalesce(x0, 0) AS "left", coalesce(y0, 0) AS top, coalesce(x1, 0) - coalesce(x0, 0) + 1 AS width, coalesce(y1, 0) - coalesce(y0, 0) + 1 AS height FROM c"""))
def _(spark, d):
    return animation.dirty_rectangle(animation.dedupe(views.px_frames(spark, d), ["image_id", "y", "x"]), ["image_id", "frame_no"])


@query("run_lengths", sql("pf", _SAME + """ SELECT image_id, frame_no, y, coalesce(min(CASE WHEN NOT same THEN x END), 8) AS "left", coalesce(7 - max(CASE WHEN NOT same THEN x END), 8) AS "right" FROM s GROUP BY ALL"""))
def _(spark, d):
    return animation.run_lengths(animation.dedupe(views.px_frames(spark, d), ["image_id", "y", "x"]), ["image_id", "frame_no", "y"], 8)


@query("denoise", sql("fr", """, n AS (SELECT *, lag(v) OVER w - v AS dp, lead(v) OVER w - v AS dn FROM fr WINDOW w AS (PARTITION BY user_id ORDER BY frame_no))
SELECT user_id, frame_no, (CASE WHEN dp IS NULL OR dn IS NULL OR dp * dn <= 0 THEN v WHEN abs(dp) <= 9 AND abs(dn) <= 9 THEN floor((8 * v + 3 * dp + 3 * dn + 4) / 8::DOUBLE)
 WHEN abs(dp) <= 9 THEN floor((2 * v + dp + 1) / 2::DOUBLE) WHEN abs(dn) <= 9 THEN floor((2 * v + dn + 1) / 2::DOUBLE) ELSE v END)::INT AS v FROM n"""))
def _(spark, d):
    return animation.denoise(views.frames(spark, d), ["user_id"])


@query("denoise_in_order", sql("fr", """, n AS (SELECT user_id, frame_no, v, lead(v) OVER (PARTITION BY user_id ORDER BY frame_no) AS following FROM fr),
 o AS (SELECT user_id, frame_no, v AS was, v, following FROM n WHERE frame_no = (SELECT min(frame_no) FROM fr f WHERE f.user_id = n.user_id)
  UNION ALL SELECT n.user_id, n.frame_no, n.v, (CASE WHEN n.following IS NULL OR (o.v - n.v) * (n.following - n.v) <= 0 THEN n.v
   WHEN abs(o.v - n.v) <= 9 AND abs(n.following - n.v) <= 9 THEN (8 * n.v + 3 * (o.v - n.v) + 3 * (n.following - n.v) + 4) >> 3
   WHEN abs(o.v - n.v) <= 9 THEN (n.v + o.v + 1) >> 1 WHEN abs(n.following - n.v) <= 9 THEN (n.v + n.following + 1) >> 1 ELSE n.v END)::INT, n.following FROM o JOIN n ON n.user_id = o.user_id AND n.frame_no = o.frame_no + 1)
SELECT user_id, frame_no, v FROM o""").replace("WITH ", "WITH RECURSIVE ", 1))
def _(spark, d):
    return animation.denoise_in_order(views.frames(spark, d), ["user_id"])


@query("replay", sql("pf", _SAME + ", o AS (SELECT *, CASE WHEN NOT same THEN v END AS out FROM s) SELECT *, last_value(out IGNORE NULLS) OVER (PARTITION BY image_id, y, x ORDER BY frame_no ROWS UNBOUNDED PRECEDING) AS shown FROM o"))
def _(spark, d):
    return animation.replay(animation.dedupe(views.px_frames(spark, d), ["image_id", "y", "x"]), ["image_id", "y", "x"], "out")


@query("replay_disposals")
def _(spark, d):
    px = views.px_frames(spark, d)
    px = px.withColumn("disposal", (F.col("frame_no") % 4).cast("int")).withColumn("v", F.when((F.col("frame_no") + F.col("x")) % 3 > 0, F.col("v")).cast("double"))
    return animation.replay_disposals(px, ["image_id"])


# requests --------------------------------------------------------------------------------

_LITERALS = ("w=300", "width=300&w=5", "w=-4", "w=abc", "mode=PAD", "mode=nope", "crop=1,2,3,4", "crop=1,2,-3,-4", "crop=-1,2,3,4", "anchor=top-left", "anchor=middle", "anchor=diagonal", "subsample=420", "subsample=440", "q=85", "page=2", "bg=red", "bg=%2380ff0000", "bg=12345", "filter=bicubic", "filter=hermite", "format=png8", "format=zzz", "sharpen=false", "hybrid=off", "gamma=companded")


def _requests(spark, d):
    pages = views.read(spark, d, "pages").select(F.col("page_id").alias("id"), F.regexp_extract("url", r"\?(.*)$", 1).alias("query"))
    more = spark.createDataFrame([(-1 - i, q) for i, q in enumerate(_LITERALS)], "id long, query string")
    return pages.union(more)


_GET = lambda *names: "coalesce(" + ", ".join(f"nullif(regexp_extract(query, '(^|&){n}=([^&]*)', 2), '')" for n in names) + ", '')"
_WHOLE = lambda *names: f"greatest(coalesce(TRY_CAST(CASE WHEN regexp_matches({_GET(*names)}, '^[+-]?[0-9]+$') THEN {_GET(*names)} END AS INT), 0), 0)"
_HEX = "CASE lower({0}) WHEN 'red' THEN 4294901760 ELSE CASE WHEN regexp_matches({0}, '^(%23)?[0-9A-Fa-f]{{6}}$') THEN ('0xff' || replace({0}, '%23', ''))::BIGINT WHEN regexp_matches({0}, '^(%23)?[0-9A-Fa-f]{{8}}$') THEN ('0x' || replace({0}, '%23', ''))::BIGINT END END".format(_GET("bgcolor", "bg"))
_PART = lambda i: f"(CASE WHEN regexp_matches({_GET('crop')}, '^([0-9]+,){{2}}-?[0-9]+,-?[0-9]+$') THEN string_split({_GET('crop')}, ',')[{i}]::INT ELSE 0 END)"
_OK = f"regexp_matches({_GET('anchor')}, '^(top|middle|bottom)?-?(left|center|right)?$')"


@query("settings_parse", f"""WITH q AS (SELECT page_id AS id, regexp_extract(url, '\\?(.*)$', 1) AS query FROM pages UNION ALL SELECT * FROM (VALUES {', '.join(f"({-1 - i}, '{q}')" for i, q in enumerate(_LITERALS))}) t(id, query))
SELECT id, {_WHOLE('width', 'w')} AS width, {_WHOLE('height', 'h')} AS height, {_GET('sharpen')} <> 'false' AS sharpen,
 CASE WHEN lower({_GET('mode')}) IN ('crop', 'max', 'stretch', 'pad', 'contain') THEN lower({_GET('mode')}) ELSE 'crop' END AS mode,
 CASE WHEN {_GET('gamma')} = 'companded' THEN 'companded' ELSE 'linear' END AS gamma, CASE WHEN {_GET('hybrid')} IN ('off', 'turbo', 'favorspeed') THEN {_GET('hybrid')} ELSE 'favorquality' END AS hybrid,
 CASE WHEN {_GET('format')} IN ('png', 'png8') THEN 'png' END AS format, {_GET('format')} = 'png8' AND {_WHOLE('quality', 'q')} = 0 AS indexed,
 {_PART(1)} AS crop_x, {_PART(2)} AS crop_y, {_PART(3)} AS crop_w, {_PART(4)} AS crop_h,
 CASE WHEN {_OK} AND contains({_GET('anchor')}, 'left') THEN 'left' WHEN {_OK} AND contains({_GET('anchor')}, 'right') THEN 'right' ELSE 'center' END AS anchor_x,
 CASE WHEN {_OK} AND contains({_GET('anchor')}, 'top') THEN 'top' WHEN {_OK} AND contains({_GET('anchor')}, 'bottom') THEN 'bottom' ELSE 'center' END AS anchor_y,
 CASE WHEN {_GET('subsample')} IN ('420', '422', '444') THEN {_GET('subsample')}::INT END AS subsample, {_WHOLE('quality', 'q')} AS quality, {_WHOLE('frame', 'page')} AS frame,
 {_HEX} AS matte, CASE {_GET('filter')} WHEN 'bicubic' THEN 'cubic' END AS filter FROM q""")
def _(spark, d):
    return settings.parse(_requests(spark, d)).drop("query", "basis_w", "basis_h")


_PICK = lambda n, *v: f"([{', '.join(repr(x) for x in v)}])[((p_partkey // {n}) % {len(v)} + 1)::INT]"
_SIZES = f"""WITH s AS (SELECT p_partkey AS id, (p_size * 40)::INT AS w, greatest(floor(p_retailprice % 997), 1)::INT AS h, {_PICK(1, 0, 100, 333, 1000, 37)} AS width, {_PICK(5, 0, 100, 150, 2000)} AS height,
 {_PICK(20, 'crop', 'max', 'stretch', 'pad', 'contain')} AS mode0, {_PICK(3, 'center', 'left', 'right')} AS ax0, {_PICK(7, 'top', 'center', 'bottom')} AS ay0,
 {_PICK(2, 0, 0, 10, 0, 5000)} AS cx, {_PICK(2, 0, 0, 20, 0, 0)} AS cy, {_PICK(2, 0, 30, 0, 50, 10)} AS cw, {_PICK(2, 0, 40, -3, 50, 10)} AS ch, {_PICK(11, 0, 0, 100)} AS bw, {_PICK(13, 0, 100, 50)} AS bh FROM part),
a AS (SELECT *, cx <> 0 OR cy <> 0 OR cw <> 0 OR ch <> 0 AS has FROM s),
b AS (SELECT *, CASE WHEN has AND bw > 0 THEN floor(cx * (w::DOUBLE / bw))::INT ELSE cx END AS x1, CASE WHEN has AND bh > 0 THEN floor(cy * (h::DOUBLE / bh))::INT ELSE cy END AS y1 FROM a),
c AS (SELECT *, CASE WHEN has AND bw > 0 THEN least(ceil(cw * (w::DOUBLE / bw))::INT, w - x1) ELSE cw END AS w1, CASE WHEN has AND bh > 0 THEN least(ceil(ch * (h::DOUBLE / bh))::INT, h - y1) ELSE ch END AS h1 FROM b),
e AS (SELECT *, CASE WHEN NOT has OR w1 > 0 THEN w1 WHEN w1 = 0 THEN greatest(1, w - x1) ELSE least(greatest(w - x1 + w1, 1), greatest(1, w - x1)) END AS w2,
 CASE WHEN NOT has OR h1 > 0 THEN h1 WHEN h1 = 0 THEN greatest(1, h - y1) ELSE least(greatest(h - y1 + h1, 1), greatest(1, h - y1)) END AS h2 FROM c),
f AS (SELECT *, NOT has OR x1 + w2 > w OR y1 + h2 > h AS auto_crop, CASE WHEN (width = 0 OR height = 0) AND mode0 IN ('pad', 'stretch') THEN 'crop' ELSE mode0 END AS mode, width = 0 AND height = 0 AS none FROM e),
g AS (SELECT *, auto_crop AND mode = 'crop' AS fill, coalesce(w::DOUBLE / nullif(width, 0), h::DOUBLE / nullif(height, 0)) AS wr, coalesce(h::DOUBLE / nullif(height, 0), w::DOUBLE / nullif(width, 0)) AS hr FROM f),
i AS (SELECT *, CASE WHEN fill THEN ax0 ELSE 'center' END AS anchor_x, CASE WHEN fill THEN ay0 ELSE 'center' END AS anchor_y,
 CASE WHEN fill AND width > 0 THEN least(greatest(ceil(least(wr, hr) * width)::INT, 1), w) ELSE w END AS ww, CASE WHEN fill AND height > 0 THEN least(greatest(ceil(least(wr, hr) * height)::INT, 1), h) ELSE h END AS hw FROM g),
j AS (SELECT *, CASE WHEN NOT auto_crop THEN x1 WHEN fill AND NOT none THEN CASE anchor_x WHEN 'left' THEN 0 WHEN 'right' THEN w - ww ELSE (w - ww) // 2 END ELSE 0 END AS crop_x,
 CASE WHEN NOT auto_crop THEN y1 WHEN fill AND NOT none THEN CASE anchor_y WHEN 'top' THEN 0 WHEN 'bottom' THEN h - hw ELSE (h - hw) // 2 END ELSE 0 END AS crop_y,
 CASE WHEN NOT auto_crop THEN w2 WHEN fill AND NOT none THEN ww ELSE w END AS crop_w, CASE WHEN NOT auto_crop THEN h2 WHEN fill AND NOT none THEN hw ELSE h END AS crop_h,
 CASE WHEN fill AND width = 0 AND NOT none THEN greatest(round_even(w / wr, 0)::INT, 1) ELSE width END AS tw0, CASE WHEN fill AND height = 0 AND NOT none THEN greatest(round_even(h / hr, 0)::INT, 1) ELSE height END AS th0 FROM i),
k AS (SELECT *, CASE WHEN tw0 = 0 AND mode IN ('contain', 'max') THEN 2147483647 ELSE tw0 END AS tw, CASE WHEN th0 = 0 AND mode IN ('contain', 'max') THEN 2147483647 ELSE th0 END AS th FROM j),
l AS (SELECT *, coalesce(crop_w::DOUBLE / nullif(tw, 0), crop_h::DOUBLE / nullif(th, 0)) AS wr2, coalesce(crop_h::DOUBLE / nullif(th, 0), crop_w::DOUBLE / nullif(tw, 0)) AS hr2 FROM k),
m AS (SELECT *, CASE WHEN mode = 'max' THEN greatest(wr2, hr2, 1) ELSE greatest(wr2, hr2) END AS rat FROM l),
n AS (SELECT *, CASE WHEN mode IN ('contain', 'max', 'pad') THEN least(greatest(round_even(crop_w / rat, 0)::INT, 1), greatest(tw, th)) ELSE tw END AS fw, CASE WHEN mode IN ('contain', 'max', 'pad') THEN least(greatest(round_even(crop_h / rat, 0)::INT, 1), greatest(tw, th)) ELSE th END AS fh FROM m),
p AS (SELECT *, CASE WHEN none THEN crop_w WHEN fw > 0 THEN fw ELSE greatest(round_even(crop_w / wr2, 0)::INT, 1) END AS inner_w, CASE WHEN none THEN crop_h WHEN fh > 0 THEN fh ELSE greatest(round_even(crop_h / hr2, 0)::INT, 1) END AS inner_h FROM n),
z AS (SELECT *, CASE WHEN mode IN ('crop', 'contain', 'max') OR none THEN inner_w ELSE width END AS outer_w, CASE WHEN mode IN ('crop', 'contain', 'max') OR none THEN inner_h ELSE height END AS outer_h FROM p)"""
_SOLVED = ("id", "mode", "auto_crop", "anchor_x", "anchor_y", "crop_x", "crop_y", "crop_w", "crop_h", "inner_w", "inner_h", "outer_w", "outer_h")


@query("fixup", f"{_SIZES} SELECT {', '.join(_SOLVED)} FROM z")
def _(spark, d):
    return settings.fixup(views.sizes(spark, d)).select(*_SOLVED)


_SHARP_SQL = ((0.5, (40, 1.5, 0)), (1, (30, 1.0, 0)), (2, (30, 0.75, 4)), (4, (75, 0.5, 2)), (6, (50, 0.75, 2)), (8, (100, 0.6, 1)), (10, (125, 0.5, 0)))


def _steps(ladder, default, on):
    return "CASE " + " ".join(f"WHEN {on.format(k)} THEN {v}" for k, v in ladder) + f" ELSE {default} END"


_RATIO = "least(crop_w::DOUBLE / inner_w, crop_h::DOUBLE / inner_h)"


@query("defaults", f"""{_SIZES}, r AS (SELECT id, outer_w, outer_h, {_RATIO} AS ratio FROM z),
 y AS (SELECT *, CASE WHEN ratio < 6 THEN 1 WHEN ratio < 12 THEN 2 WHEN ratio < 24 THEN 4 WHEN ratio < 48 THEN 8 WHEN ratio < 96 THEN 16 ELSE 32 END AS hybrid_ratio, {_steps(((160, 95), (320, 93), (480, 91), (640, 89), (1280, 87), (1920, 85)), 83, 'greatest(outer_w, outer_h) <= {}')} AS quality FROM r)
SELECT id, round(ratio, 6) AS ratio, hybrid_ratio, quality, CASE WHEN quality >= 95 THEN 444 WHEN quality >= 90 THEN 422 ELSE 420 END AS subsample,
 CASE WHEN ratio / hybrid_ratio = 1 THEN 'linear' WHEN ratio / hybrid_ratio < 0.5 THEN 'lanczos' WHEN ratio / hybrid_ratio > 16 THEN 'quadratic' WHEN ratio / hybrid_ratio > 4 THEN 'catmullrom' ELSE 'spline36' END AS filter,
 {', '.join(f"(CASE WHEN ratio = 1 THEN 0 ELSE {_steps([(k, v[i]) for k, v in _SHARP_SQL], (150, 0.5, 0)[i], 'ratio < {}')} END)::DOUBLE AS unsharp_{n}" for i, n in enumerate(('amount', 'radius', 'threshold')))} FROM y""")
def _(spark, d):
    nothing = {"hybrid": F.lit("favorquality"), "quality": F.lit(0), "subsample": F.lit(None).cast("int"), "filter": F.lit(None).cast("string"), "sharpen": F.lit(True)}
    out = settings.defaults(settings.fixup(views.sizes(spark, d)).withColumns(nothing))
    return out.select("id", F.round("ratio", 6).alias("ratio"), "hybrid_ratio", "quality", "subsample", "filter", "unsharp_amount", "unsharp_radius", "unsharp_threshold")


@query("guess_format", f"{_SIZES} SELECT id, CASE WHEN id % 7 = 0 THEN 'gif' WHEN id % 7 = 1 OR id % 5 = 0 OR inner_w <> outer_w OR inner_h <> outer_h THEN 'png' ELSE 'jpeg' END AS format FROM z")
def _(spark, d):
    df = settings.fixup(views.sizes(spark, d)).withColumns({"format": F.lit(None).cast("string"), "matte": F.lit(None).cast("long"), "has_alpha": F.col("id") % 5 == 0, "mime": F.when(F.col("id") % 7 == 0, "image/gif").when(F.col("id") % 7 == 1, "image/png").otherwise("image/jpeg")})
    return df.select("id", settings.guess_format(df).alias("format"))


@query("device_pixel_ratio", """WITH s AS (SELECT p_partkey AS id, p_size * 40 AS image_w, p_size * 30 AS image_h, 100 AS width, 80 AS height, least(greatest((p_partkey % 12) * 0.5::DOUBLE, 1), 5) AS r FROM part)
SELECT id, CASE WHEN r > 1 AND floor(100 * r) <= image_w AND floor(80 * r) <= image_h THEN floor(100 * r)::INT ELSE 100 END AS width, CASE WHEN r > 1 AND floor(100 * r) <= image_w AND floor(80 * r) <= image_h THEN floor(80 * r)::INT ELSE 80 END AS height,
 CASE WHEN r > 1 AND floor(100 * r) <= image_w AND floor(80 * r) <= image_h THEN round_even((r - 1) * 10, 0)::INT ELSE 0 END AS quality_less FROM s""")
def _(spark, d):
    p = views.read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 40).alias("image_w"), (F.col("p_size") * 30).alias("image_h"), F.lit(100).alias("width"), F.lit(80).alias("height"))
    return requests.device_pixel_ratio(p, ((F.col("id") % 12) * 0.5).cast("string")).select("id", "width", "height", "quality_less")


@query("route", """SELECT page_id, path, CASE WHEN starts_with(lower(path), '/en/') THEN 0 WHEN starts_with(lower(path), '/') AND (starts_with(lower(path), '/fr') OR starts_with(lower(path), '/de')) THEN CASE WHEN starts_with(lower(path), '/fr') THEN 1 ELSE 2 END END AS folder,
 CASE WHEN NOT (starts_with(lower(path), '/en/') OR starts_with(lower(path), '/fr') OR starts_with(lower(path), '/de')) THEN 404 WHEN page_id % 3 = 0 THEN 405 ELSE 200 END AS status
 FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?]*)', 1) AS path FROM pages)""")
def _(spark, d):
    p = views.read(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?]*)", 1).alias("path"))
    p = p.withColumn("method", F.when(F.col("page_id") % 3 == 0, "POST").otherwise("get"))
    return requests.route(p, [("/EN/", False, 0), ("/fr", False, 0), ("/de", False, 0)], method="method").drop("method")


@query("cache_anti_join", "SELECT min(page_id) AS page_id, url AS cache_key FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0) GROUP BY url")
def _(spark, d):
    p = views.read(spark, d, "pages").select("page_id", F.col("url").alias("cache_key"))
    first = p.groupBy("cache_key").agg(F.min("page_id").alias("page_id"))
    return requests.to_do(first, p.where("page_id % 3 = 0")).select("page_id", "cache_key")


@query("path_hash")
def _(spark, d):
    return views.read(spark, d, "pages").select("page_id", numbers.short_hashes(F.col("url")).alias("hash"))


@query("cache_path", "SELECT page_id, '/k/' || 'KEY.p' || page_id || '.4x3.png' AS mirror FROM pages")
def _(spark, d):
    p = views.read(spark, d, "pages").select("page_id", F.concat(F.lit("/k/p"), "page_id", F.lit(".jpg")).alias("path"), F.lit(4).alias("outer_w"), F.lit(3).alias("outer_h"), F.lit("KEY").alias("cache_key"), F.lit(".png").alias("ext"))
    return p.select("page_id", requests.cache_path("mirror").alias("mirror"))


@query("colour_names", "SELECT * FROM (VALUES ('red', 4294901760), ('#80ff0000', 2164195328), ('00ff00', 4278255360), ('Teal', 4278222976), ('12345', NULL), ('nope', NULL)) t(name, argb)")
def _(spark, d):
    df = spark.createDataFrame([(n,) for n in ("red", "#80ff0000", "00ff00", "Teal", "12345", "nope")], "name string")
    return df.withColumn("argb", curves.parse_colour(F.col("name")))


@query("resolution_units", """SELECT p_partkey, round(CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size * 2.54::DOUBLE WHEN 2 THEN p_size / 39.37::DOUBLE ELSE p_size * 96 END, 9) AS dpi,
 round(CASE p_partkey % 4 WHEN 0 THEN p_size * 39.37::DOUBLE WHEN 1 THEN p_size * 100 WHEN 2 THEN p_size ELSE p_size * 3779.53::DOUBLE END, 9) AS dpm FROM part""")
def _(spark, d):
    from .sources.metadata import to_dpi, to_dpm

    unit = F.element_at(F.array(*[F.lit(u) for u in ("inch", "centimeter", "meter", "virtual")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    v = F.col("p_size").cast("double")
    return views.read(spark, d, "part").select("p_partkey", F.round(to_dpi(v, unit), 9).alias("dpi"), F.round(to_dpm(v, unit), 9).alias("dpm"))


# sources ---------------------------------------------------------------------------------

_HEADS = (("jpeg", "ffd8ffe000104a46494600010101006000"), ("png", "89504e470d0a1a0a0000000d49484452"), ("gif", "47494638396110001000f00000000000"), ("webp", "52494646aabbccdd5745425056503820"), ("jxl", "0000000c4a584c200d0a870a00000014"), ("avif", "0000002066747970617669660000000a"), ("bmp", "424d3e00000000000000360000002800"), ("too short", "ffd8ffe000104a464946000101"))


@query("sniff", f"""SELECT id, kind FROM (VALUES {', '.join(f"({-1 - i}, '{k}')" for i, (k, _) in enumerate(_HEADS))}) t(id, kind)
UNION ALL SELECT page_id, CASE WHEN octet_length(encode(html)) < 16 THEN 'too short' END FROM pages UNION ALL SELECT 1000000000 + doc_id, CASE WHEN octet_length(encode(text)) < 16 THEN 'too short' WHEN starts_with(text, 'BM') THEN 'bmp' END FROM documents""")
def _(spark, d):
    heads = spark.createDataFrame([(-1 - i, h) for i, (_, h) in enumerate(_HEADS)], "id long, h string").select("id", F.unhex("h").alias("c"))
    pages = views.read(spark, d, "pages").select("page_id", F.encode("html", "UTF-8"))
    docs = views.read(spark, d, "documents").select(F.col("doc_id") + 1000000000, F.encode("text", "UTF-8"))
    return heads.union(pages).union(docs).select("id", sniffing.sniff(F.col("c")).alias("kind"))


@query("codec_for", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'tiff' END AS codec FROM pages")
def _(spark, d):
    ext = F.element_at(F.array(*[F.lit(e) for e in (".JPG", ".png", ".Tiff", ".zzz")]), (F.col("page_id") % 4 + 1).cast("int"))
    p = views.read(spark, d, "pages").select("page_id", F.concat(F.lit("/a.b/c"), ext).alias("path"))
    return sniffing.codec_for(p).select("page_id", "codec")


#: White, yellow, cyan, green, magenta, red, blue and black at 240, as 0xRRGGBB.
_BARS = [0xF0F0F0, 0xF0F000, 0x00F0F0, 0x00F000, 0xF000F0, 0xF00000, 0x0000F0, 0x000000]


@query("test_pattern", f"""WITH g AS (SELECT (i // 50)::INT AS y, (i % 50)::INT AS x FROM (SELECT unnest(range(50 * 30)) AS i)),
 b AS (SELECT y, x, {_steps([(round((k + 1) * 50 / 8), k) for k in range(7)], 7, 'x < {}')} AS bar, least(y * 8 // 30, 7) AS step FROM g),
 c AS (SELECT y, x, CASE WHEN bar >= 8 - step THEN 10526880 ELSE ({_BARS!r})[bar + 1] END AS v FROM b)
SELECT y, x, (v & 255)::INT AS b, ((v >> 8) & 255)::INT AS g, ((v >> 16) & 255)::INT AS r FROM c""")
def _(spark, d):
    return synthetic.test_pattern(spark, 50, 30)


@query("zone_plate", """WITH g AS (SELECT (i // 41)::INT AS y, (i % 41)::INT AS x FROM (SELECT unnest(range(41 * 31)) AS i)), r AS (SELECT y, x, ((x - 20) * (x - 20) + (y - 15) * (y - 15))::DOUBLE AS d FROM g)
SELECT y, x, (255 - floor(127.5::DOUBLE * (1 + (1 + tanh((15 - sqrt(d)) / 1.5::DOUBLE)) * sin(0.7::DOUBLE / 30 * pi() * d) * 0.5::DOUBLE) + 0.5::DOUBLE))::INT AS b FROM r""")
def _(spark, d):
    return synthetic.zone_plate(spark, 41, 31)


@query("broken_image", """WITH g AS (SELECT (i // 40)::INT AS y, (i % 40)::INT AS x FROM (SELECT unnest(range(40 * 30)) AS i)),
 v AS (SELECT y, x, CASE WHEN abs(x / 39::DOUBLE - y / 29::DOUBLE) <= 1.5::DOUBLE / 29 OR abs(x / 39::DOUBLE + y / 29::DOUBLE - 1) <= 1.5::DOUBLE / 29 THEN 255 ELSE 211 END AS v FROM g) SELECT y, x, v AS b, v AS g, v AS r FROM v""")
def _(spark, d):
    return synthetic.broken_image(spark, 40, 30)


# containers ----------------------------------------------------------------------------


def _stored(px: DataFrame, kind: str, **options) -> DataFrame:
    """(image_id, kind, content): each image in a container, its kind as sniffed from the bytes, or as told where bytes tell nothing."""
    made = images.encode(px.withColumn("image_id", F.col("image_id").cast("long")), kind, **options)
    return made.select("image_id", F.coalesce(sniffing.sniff(F.col("content")), F.lit(kind)).alias("kind"), "content")


def _read_back(stored: DataFrame) -> DataFrame:
    return images.to_pixels(images.decode(stored))


def _round_trip(kind: str):
    return lambda spark, d: _read_back(_stored(views.px_rgb(spark, d), kind)).select("image_id", "y", "x", "b", "g", "r")


for _k in ("png", "bmp", "tga", "tiff"):
    query(f"{_k}_round_trip", sql("rgb", "SELECT image_id, y, x, b, g, r FROM rgb"))(_round_trip(_k))


@query("gif_round_trip", sql("pb", "SELECT vec_id AS image_id, y, x, v AS b, v AS g, v AS r FROM pb"))
def _(spark, d):
    px = views.px_byte(spark, d).select(F.col("vec_id").alias("image_id"), "y", "x", F.col("v").alias("b"))
    return _read_back(_stored(px, "gif")).select("image_id", "y", "x", "b", "g", "r")


@query("jpeg_round_trip", sql("rgb", "SELECT image_id, count(*) AS pixels, true AS near FROM rgb GROUP BY image_id"))
def _(spark, d):
    """Quality 100 without subsampling: every sample comes back within 3."""
    px = views.px_rgb(spark, d)
    back = _read_back(_stored(px, "jpeg", quality=100, subsample=444)).select("image_id", "y", "x", *[F.col(c).alias(f"{c}_") for c in "bgr"])
    off = F.greatest(*[F.abs(F.col(c) - F.col(f"{c}_")) for c in "bgr"])
    return px.join(back, ["image_id", "y", "x"]).groupBy("image_id").agg(F.count("*").alias("pixels"), (F.max(off) <= 3).alias("near"))


@query("image_info", sql("rgb", """, i AS (SELECT DISTINCT image_id FROM rgb)
SELECT image_id, k AS kind, 0 AS frame_no, 8 AS width, 8 AS height, false AS has_alpha, 1 AS orientation FROM i, (VALUES ('png'), ('bmp'), ('jpeg')) t(k)"""))
def _(spark, d):
    px = views.px_rgb(spark, d)
    stored = _stored(px, "png").union(_stored(px, "bmp")).union(_stored(px, "jpeg"))
    info = images.file_info(stored.withColumn("path", F.col("image_id").cast("string")))
    return info.select(F.col("path").cast("long").alias("image_id"), "kind", "frame_no", "width", "height", "has_alpha", "orientation")


_ROUND = "least(greatest(floor(sum(h.v * k.w) + 0.5::DOUBLE), 0), 255)::INT AS v"


@query("thumbnail", sql("pb", f"""{_kernel_sql(8, 4, *_VALUES["catmullrom"])}, h AS (SELECT vec_id, y, k.o AS x, sum(v * k.w) AS v FROM pb p JOIN k ON k.i = p.x WHERE true GROUP BY ALL)
SELECT vec_id AS image_id, k.o AS y, x, {_ROUND} FROM h JOIN k ON k.i = h.y GROUP BY ALL"""))
def _(spark, d):
    """The whole way of a file: stored, sniffed, decoded, planned, scaled, rounded, stored again, and read."""
    source = _stored(views.px_byte(spark, d).select(F.col("vec_id").alias("image_id"), "y", "x", F.col("v").alias("b")), "png")
    px = _read_back(source).select("image_id", "y", "x", F.col("b").cast("double").alias("b"))
    small = pipeline.plan(px, ["image_id"], (8, 8), {"inner_w": 4, "inner_h": 4, "filter": "catmullrom"}, ["b"]).pixels
    small = small.withColumn("b", F.least(F.greatest(F.floor(F.col("b") + 0.5), F.lit(0)), F.lit(255)).cast("int"))
    return _read_back(_stored(small, "png")).select("image_id", "y", "x", F.col("b").alias("v"))


@query("thumbnail_batch", sql("pb", f"""{_kernel_sql(8, 4, *_VALUES["catmullrom"])}, h AS (SELECT vec_id, y, k.o AS x, sum(v * k.w) AS v FROM pb p JOIN k ON k.i = p.x GROUP BY ALL)
SELECT vec_id AS image_id, k.o AS y, x, {_ROUND} FROM h JOIN k ON k.i = h.y GROUP BY ALL"""))
def _(spark, d):
    """The same over whole images: no pixel is a row until the result is looked at."""
    small = process.batch(_bytes_of(spark, d), "w=4&h=4&filter=catrom&gamma=companded&sharpen=false&format=png", "image_id")
    return _read_back(small.select("image_id", F.col("format").alias("kind"), "content")).select("image_id", "y", "x", F.col("b").alias("v"))


def _bytes_of(spark: SparkSession, d: str) -> DataFrame:
    """The byte view of the embeddings as 8x8 grey images, in columns only."""
    level = lambda v: F.least(F.greatest(F.floor((v.cast("double") + 1) * 127.5), F.lit(0)), F.lit(255))
    e = views.read(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.unhex(F.array_join(F.transform("embedding", lambda v: F.lpad(F.hex(level(v)), 2, "0")), "")).alias("data"))
    return e.select("image_id", F.lit(8).alias("image_w"), F.lit(8).alias("image_h"), F.lit(1).alias("channels"), "data")


# whole images: orientation, palettes -----------------------------------------------------


@query("process_orientations", sql("rgb", """, o AS (SELECT *, (image_id % 8 + 1)::INT AS k FROM rgb)
SELECT image_id, CASE k WHEN 1 THEN y WHEN 2 THEN y WHEN 3 THEN 7 - y WHEN 4 THEN 7 - y WHEN 5 THEN x WHEN 6 THEN x ELSE 7 - x END AS y,
 CASE k WHEN 1 THEN x WHEN 2 THEN 7 - x WHEN 3 THEN 7 - x WHEN 4 THEN x WHEN 5 THEN y WHEN 6 THEN 7 - y WHEN 7 THEN 7 - y ELSE y END AS x, b, g, r FROM o"""))
def _(spark, d):
    """Files of all eight orientations through whole-image processing: read, turned upright, solved, written, read again."""
    px = views.px_rgb(spark, d)
    stored = None
    for o in range(1, 9):
        part = _stored(px.where(F.col("image_id") % 8 + 1 == o), "tiff", orientation=o)
        stored = part if stored is None else stored.union(part)
    done = process.batch(process.decoded(stored, "image_id"), "format=png&sharpen=false", "image_id")
    return _read_back(done.select("image_id", F.col("format").alias("kind"), "content")).select("image_id", "y", "x", "b", "g", "r")


def _processed(kind: str):
    def run(spark, d):
        done = process.batch(process.decoded(_stored(views.px_rgb(spark, d), "bmp"), "image_id"), f"format={kind}&sharpen=false", "image_id")
        return _read_back(done.select("image_id", F.col("format").alias("kind"), "content")).select("image_id", "y", "x", "b", "g", "r")

    return run


for _k in ("png8", "gif"):  # 64 pixels have at most 64 colours, so the palette is exact
    query(f"process_{_k}", sql("rgb", "SELECT image_id, y, x, b, g, r FROM rgb"))(_processed(_k))


# fixed point, windows, linear sharpening -------------------------------------------------


@query("resample_uq15", sql("pb", f"""{_kernel_sql(8, 4, *_VALUES["catmullrom"])}, w AS (SELECT o, i, round_even(w * 32768, 0)::BIGINT AS w FROM k), q AS (SELECT vec_id, y, x, ((v * 32768 + 127) // 255)::BIGINT AS v FROM pb),
 h AS (SELECT vec_id, y, w.o AS x, least(greatest((sum(v * w.w)::BIGINT + 16384) >> 15, 0), 65535) AS v FROM q JOIN w ON w.i = q.x GROUP BY ALL)
SELECT vec_id, w.o AS y, x, least(greatest((sum(h.v * w.w)::BIGINT + 16384) >> 15, 0), 65535)::INT AS v FROM h JOIN w ON w.i = h.y GROUP BY ALL"""))
def _(spark, d):
    px = views.px_byte(spark, d).withColumn("v", numbers.byte_to_uq15(F.col("v")))
    return resample.resample_uq15(px, ["vec_id"], (8, 8), (4, 4), kernels.PRESETS["catmullrom"]).select("vec_id", "y", "x", "v")


@query("blur_by_window", sql("px", _two_sums(_GAUSS)))
def _(spark, d):
    return resample.blur_by_window(views.px_embed(spark, d), ["vec_id"], (8, 8), 1.25).select("vec_id", "y", "x", _six("v").alias("v"))


@query("unsharp_linear", sql("pb", f"""{_GAUSS}, l AS (SELECT vec_id, y, x, v / 255::DOUBLE AS v, sqrt(v / 255::DOUBLE) AS s FROM pb), h AS (SELECT vec_id, y, k.o AS x, sum(s * k.w) AS s FROM l JOIN k ON k.i = l.x GROUP BY ALL),
 z AS (SELECT vec_id, k.o AS y, x, sum(h.s * k.w) AS soft FROM h JOIN k ON k.i = h.y GROUP BY ALL), g AS (SELECT vec_id, y, x, greatest(s + (s - soft) * 0.75::DOUBLE, 0) AS t FROM l JOIN z USING (vec_id, y, x))
SELECT vec_id, y, x, round(t * t, 6) AS v FROM g"""))
def _(spark, d):
    px = views.px_byte(spark, d).withColumn("v", F.col("v") / F.lit(255.0))
    return resample.unsharp_linear(px, ["vec_id"], (8, 8), 75, 1.25).withColumn("v", F.round("v", 6))


@query("interpolated_table", sql("px", f""", t AS (SELECT list(({_comp('(i / 16::DOUBLE)')}) ORDER BY i) AS t FROM (SELECT unnest(range(17)) AS i)), a AS (SELECT vec_id, y, x, least(greatest(v, 0), 1)::DOUBLE * 16 AS pos FROM px)
SELECT vec_id, y, x, round(t[floor(pos)::INT + 1] + (t[least(floor(pos)::INT + 2, 17)] - t[floor(pos)::INT + 1]) * (pos - floor(pos)), 9) AS v FROM a, t"""))
def _(spark, d):
    level = [i / 16 for i in range(17)]
    table = [v * 12.92 if v <= 0.04045 / 12.92 else 1.055 * v ** (1 / 2.4) - 0.055 for v in level]
    return views.px_embed(spark, d).select("vec_id", "y", "x", F.round(curves.interpolated(F.col("v").cast("double"), table), 9).alias("v"))


@query("video_gamma", sql("pb", f"SELECT vec_id, y, x, round({_lin('((least(greatest(v, 16), 235) - 16) / 219::DOUBLE)')}, 9) AS v FROM pb"))
def _(spark, d):
    table = F.array(*[F.lit(float(t)) for t in curves.video_table()])
    return views.px_byte(spark, d).withColumn("v", F.round(F.get(table, F.col("v")), 9))


@query("frame_kinds", sql("rgb", "SELECT image_id, bool_or(image_id % 3 = 0 AND x = 2) AS any_alpha, bool_and(image_id % 2 = 0 OR (b = g AND g = r)) AS all_grey, 1 AS frame_count, CASE WHEN image_id % 3 = 0 THEN 'Bgra32' WHEN bool_and(image_id % 2 = 0 OR (b = g AND g = r)) THEN 'Grey8' ELSE 'Bgr24' END AS fmt FROM rgb GROUP BY image_id"))
def _(spark, d):
    grey = F.col("image_id") % 2 == 0
    px = views.px_rgb(spark, d).withColumns({"g": F.when(grey, F.col("b")).otherwise(F.col("g")), "r": F.when(grey, F.col("b")).otherwise(F.col("r")), "frame_no": F.lit(0), "a": F.when((F.col("image_id") % 3 == 0) & (F.col("x") == 2), 0).otherwise(255)})
    return animation.kinds(px, ["image_id"])


# formats, rectangles, numbers ------------------------------------------------------------

_ASKED = ("Grey8", "Bgr24", "Bgra32", "Pbgra32", "Rgb24", "Y8Video", "Cb8", "Indexed8")
_TAKES = (("Bgr24",), ("Rgba32", "Rgb24"), ("Grey8", "Bgra32"), ("Y8", "Cb8Video"))
_NEAREST = (("Bgr24", "Rgb24", "Grey8", "Grey8"), ("Bgr24", "Rgb24", "Bgra32", "Bgr24"), ("Bgr24", "Rgba32", "Bgra32", "Bgra32"), ("Bgr24", "Rgba32", "Bgra32", "Pbgra32"), ("Rgb24", "Rgb24", "Rgb24", "Rgb24"), ("Y8Video", "Y8Video", "Y8Video", "Y8"), ("Cb8", "Cb8", "Cb8", "Cb8Video"), ("Indexed8", "Indexed8", "Indexed8", "Indexed8"))


@query("closest_format", f"SELECT p_partkey, ([{', '.join(repr(list(n)) for n in _NEAREST)}])[p_partkey % 8 + 1][p_partkey // 8 % 4 + 1] AS fmt FROM part")
def _(spark, d):
    p = views.read(spark, d, "part")
    fmt = F.element_at(F.array(*[F.lit(f) for f in _ASKED]), (F.col("p_partkey") % 8 + 1).cast("int"))
    takes = F.element_at(F.array(*[F.array(*[F.lit(f) for f in t]) for t in _TAKES]), (F.floor(F.col("p_partkey") / 8) % 4 + 1).cast("int"))
    return p.select("p_partkey", formats.closest_format(fmt, takes).alias("fmt"))


@query("closest_subsample", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CASE p_partkey // 3 % 3 WHEN 0 THEN 420 WHEN 1 THEN 444 ELSE 444 END WHEN 1 THEN 420 END AS mode FROM part")
def _(spark, d):
    p = views.read(spark, d, "part")
    asked = F.element_at(F.array(F.lit(420), F.lit(422), F.lit(444)), (F.floor(F.col("p_partkey") / 3) % 3 + 1).cast("int"))
    modes = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit(420), F.lit(444))).when(F.col("p_partkey") % 3 == 1, F.array(F.lit(420))).otherwise(F.array().cast("array<int>"))
    return p.select("p_partkey", formats.closest_subsample(asked, modes).alias("mode"))


@query("jxl_quality", "SELECT p_partkey, round(CASE WHEN q >= 30 THEN 0.1::DOUBLE + (100 - q) * 0.09::DOUBLE ELSE 53::DOUBLE / 3000 * q * q - 1.15::DOUBLE * q + 25 END, 6) AS distance, q AS quality FROM (SELECT p_partkey, (p_partkey % 100)::INT AS q FROM part)")
def _(spark, d):
    p = views.read(spark, d, "part").select("p_partkey", formats.jxl_distance((F.col("p_partkey") % 100).cast("int")).alias("distance"))
    return p.select("p_partkey", F.round("distance", 6).alias("distance"), formats.jxl_quality(F.col("distance")).alias("quality"))


@query("rectangles", """WITH p AS (SELECT p_partkey AS id, (p_partkey % 8 + 1)::INT AS o, (p_partkey % 20)::INT AS x, (p_partkey % 13)::INT AS y, p_size + 5 AS w, p_size + 3 AS h FROM part)
SELECT id, CASE o WHEN 1 THEN x WHEN 2 THEN 100 - w - x WHEN 3 THEN 100 - w - x WHEN 4 THEN x WHEN 5 THEN y WHEN 6 THEN 100 - h - y WHEN 7 THEN 100 - h - y ELSE y END AS tx,
 CASE o WHEN 1 THEN y WHEN 2 THEN y WHEN 3 THEN 80 - h - y WHEN 4 THEN 80 - h - y WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN 80 - w - x ELSE 80 - w - x END AS ty, x AS bx, y AS "by", w AS bw, h AS bh,
 x // 4 * 4 AS sx, least((w + x % 4 + 3) // 4 * 4, 100 - x // 4 * 4) AS sw, x // 2 AS dx, least((w + 1) // 2, 50) AS dw, floor(x / (100 / 30::DOUBLE))::INT AS px, least(ceil(w / (100 / 30::DOUBLE))::INT, 30 - floor(x / (100 / 30::DOUBLE))::INT) AS pw, y + 2 AS ly, least(h - 2, 9) AS lh, x - 3 AS rx,
 CASE WHEN least(x + w, 40) >= greatest(x, 10) AND least(y + h, 40) >= greatest(y, 10) THEN least(x + w, 40) - greatest(x, 10) ELSE 0 END AS iw FROM p""")
def _(spark, d):
    p = views.read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 8 + 1).cast("int").alias("o"), (F.col("p_partkey") % 20).cast("int").alias("x"), (F.col("p_partkey") % 13).cast("int").alias("y"), (F.col("p_size") + 5).alias("w"), (F.col("p_size") + 3).alias("h"))
    r, i = (F.col("x"), F.col("y"), F.col("w"), F.col("h")), F.lit
    t = geometry.turned(r, F.col("o"), i(100), i(80))
    back, snap = geometry.turned_back(t, F.col("o"), i(100), i(80)), geometry.snapped(r, 4, 4, i(100), i(80))
    down, part, slice_ = geometry.scaled_down(r, 2, 2, i(50), i(40)), geometry.in_proportion(r, i(100), i(80), i(30), i(24)), geometry.sliced(r, i(2), i(9))
    cut = geometry.intersect(*r, i(10), i(10), i(30), i(30))
    cols = {"tx": t[0], "ty": t[1], "bx": back[0], "by": back[1], "bw": back[2], "bh": back[3], "sx": snap[0], "sw": snap[2], "dx": down[0], "dw": down[2], "px": part[0], "pw": part[2], "ly": slice_[1], "lh": slice_[3], "rx": geometry.relative(r, i(3), i(0))[0], "iw": cut[2]}
    return p.select("id", *[c.alias(n) for n, c in cols.items()])


@query("whole_numbers", "SELECT p_partkey, gcd(p_partkey, p_size::BIGINT) AS divisor, p_size % 2 = 1 AS odd, round_even(p_size / 7::DOUBLE * 32768, 0)::INT AS fixed, ((p_size * 1000 + 128) >> 8)::INT AS unfixed FROM part")
def _(spark, d):
    n = F.col("p_size")
    return views.read(spark, d, "part").select("p_partkey", numbers.greatest_common_divisor(F.col("p_partkey"), n).alias("divisor"), numbers.is_odd(n).alias("odd"), numbers.fixed(n / F.lit(7.0)).alias("fixed"), numbers.unfixed(n * 1000, 8).alias("unfixed"))


@query("pass_through", f"SELECT id, query IN ('w=-4', 'w=abc', 'mode=PAD', 'mode=nope', 'crop=-1,2,3,4', 'anchor=top-left', 'anchor=middle', 'anchor=diagonal', 'subsample=440', 'bg=12345', 'filter=hermite', 'format=zzz', 'hybrid=off', 'gamma=companded') AS as_is FROM (VALUES {', '.join(f"({-1 - i}, '{q}')" for i, q in enumerate(_LITERALS))}) t(id, query)")
def _(spark, d):
    df = spark.createDataFrame([(-1 - i, q) for i, q in enumerate(_LITERALS)], "id int, query string")
    return requests.pass_through(settings.parse(df)).select("id", "as_is")


@query("path_lookup", "SELECT p.page_id, coalesce(p.page_id % 3 = 0, false) AS found, CASE WHEN p.page_id % 3 = 0 THEN p.page_id * 10 END AS file_size FROM pages p")
def _(spark, d):
    asked = views.read(spark, d, "pages").select("page_id", F.concat(F.lit("/p"), "page_id").alias("path"))
    files = asked.where("page_id % 3 = 0").select("path", (F.col("page_id") * 10).alias("file_size"), F.lit(None).cast("timestamp").alias("file_date"))
    return requests.lookup(asked, files).select("page_id", "found", "file_size")
