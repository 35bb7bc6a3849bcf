"""Transfer curves, matrices and colour names."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the sRGB curve and the luma weights.
REC601 = (0.299, 0.587, 0.114)  # r, g, b
REC709 = (0.2126, 0.7152, 0.0722)
YCC = {"rec601": (0.299, 0.114), "rec709": (0.2126, 0.0722), "rec2020": (0.2627, 0.0593), "smpte240m": (0.2122, 0.0865)}

#: 4x4 presets, a row for each input channel (r, g, b, one), a column for each output channel.
MATRICES = {
    "grey": ((0.299, 0.299, 0.299, 0), (0.587, 0.587, 0.587, 0), (0.114, 0.114, 0.114, 0), (0, 0, 0, 1)),
    "sepia": ((0.393, 0.349, 0.272, 0), (0.769, 0.686, 0.534, 0), (0.189, 0.168, 0.131, 0), (0, 0, 0, 1)),
    "polaroid": ((1.438, -0.062, -0.062, 0), (-0.122, 1.378, -0.122, 0), (-0.016, -0.016, 1.483, 0), (-0.030, 0.050, -0.020, 1)),
    "negative": ((-1, 0, 0, 0), (0, -1, 0, 0), (0, 0, -1, 0), (1, 1, 1, 1)),
}


def to_linear(v: Column) -> Column:
    """sRGB value 0-1 to linear light."""
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def from_linear(v: Column) -> Column:
    return F.when(v <= 0.04045 / 12.92, v * 12.92).otherwise(F.lit(1.055) * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def to_byte(v: Column) -> Column:
    """0-1 to 0-255: half rounds up, and what lies outside is clamped."""
    return F.least(F.greatest(F.floor(v * 255 + 0.5), F.lit(0)), F.lit(255)).cast("int")


def curve_table(linear: bool = True) -> np.ndarray:
    """The 256-entry table of one direction, made from the curve."""
    d = np.arange(256) / 255
    return np.where(d <= 0.04045, d / 12.92, ((d + 0.055) / 1.055) ** 2.4) if linear else np.where(d <= 0.04045 / 12.92, d * 12.92, 1.055 * d ** (1 / 2.4) - 0.055)


def interpolated(v: Column, table: np.ndarray) -> Column:
    """A table over 0 to 1, looked up with linear interpolation; what lies outside takes the ends."""
    values = F.array(*[F.lit(float(x)) for x in table])
    at = F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * (len(table) - 1)
    low = F.floor(at).cast("int")
    a, b = F.get(values, low), F.get(values, F.least(low + 1, F.lit(len(table) - 1)))
    return a + (b - a) * (at - low)


def video_table(linear: bool = True, size: int = 256) -> np.ndarray:
    """The curve's table for luma in 16 to 235: byte to linear light (outside taken as the ends), or ``size`` steps of light to video levels over 255."""
    if linear:
        d = (np.clip(np.arange(256), 16, 235) - 16) / 219
        return np.where(d <= 0.04045, d / 12.92, ((d + 0.055) / 1.055) ** 2.4)
    d = np.linspace(0, 1, size)
    return (np.where(d <= 0.04045 / 12.92, d * 12.92, 1.055 * d ** (1 / 2.4) - 0.055) * 219 + 16) / 255


def rgb_to_ycc(kr: float, kb: float) -> np.ndarray:
    """Rows Y, Cb, Cr; columns r, g, b."""
    kg = 1 - kr - kb
    y = np.array([kr, kg, kb])
    return np.array([y, (np.array([0, 0, 1]) - y) / (2 * (1 - kb)), (np.array([1, 0, 0]) - y) / (2 * (1 - kr))])


def rgb_to_xyz(r, g, b, white) -> np.ndarray:
    """From xyz chromaticities of the primaries and the white point (SMPTE RP 177)."""
    p = np.array([r, g, b], float).T
    return p * np.linalg.solve(p, np.asarray(white, float))


#: The Bradford matrix and the D50 white of colour profiles.
BRADFORD = np.array([[0.8951, 0.2664, -0.1614], [-0.7502, 1.7135, 0.0367], [0.0389, -0.0685, 1.0296]])
D50 = np.array([0.9642, 1.0, 0.8249])


def adaptation(white) -> np.ndarray:
    """XYZ under ``white`` to XYZ under D50."""
    return np.linalg.inv(BRADFORD) @ np.diag((BRADFORD @ D50) / (BRADFORD @ np.asarray(white, float))) @ BRADFORD


def _primaries(rx, ry, gx, gy, bx, by, wx, wy):
    xyz = lambda x, y: (x / y, 1.0, (1 - x - y) / y)
    m = rgb_to_xyz(xyz(rx, ry), xyz(gx, gy), xyz(bx, by), xyz(wx, wy))
    return adaptation(xyz(wx, wy)) @ m


#: RGB to XYZ (D50), from published primaries.
PROFILES = {
    "srgb": _primaries(0.64, 0.33, 0.30, 0.60, 0.15, 0.06, 0.3127, 0.3290),
    "adobergb": _primaries(0.64, 0.33, 0.21, 0.71, 0.15, 0.06, 0.3127, 0.3290),
    "displayp3": _primaries(0.680, 0.320, 0.265, 0.690, 0.150, 0.060, 0.3127, 0.3290),
}
GAMMA = {"adobergb": 563 / 256}
#: Linear RGB to linear RGB by (source, target), as published to seven places. They go before the products of
#: PROFILES, which differ from them in the seventh place, and so in some bytes.
PUBLISHED = {("srgb", "displayp3"): ((0.8224621, 0.177538, 0.0), (0.0331941, 0.9668058, 0.0), (0.0170827, 0.0723974, 0.9105199))}

#: Colour names of CSS, as RRGGBB.
NAMES = dict(
    x.split()
    for x in """aliceblue f0f8ff,antiquewhite faebd7,aqua 00ffff,aquamarine 7fffd4,azure f0ffff,beige f5f5dc,bisque ffe4c4,black 000000,
blanchedalmond ffebcd,blue 0000ff,blueviolet 8a2be2,brown a52a2a,burlywood deb887,cadetblue 5f9ea0,chartreuse 7fff00,chocolate d2691e,
coral ff7f50,cornflowerblue 6495ed,cornsilk fff8dc,crimson dc143c,cyan 00ffff,darkblue 00008b,darkcyan 008b8b,darkgoldenrod b8860b,
darkgray a9a9a9,darkgreen 006400,darkkhaki bdb76b,darkmagenta 8b008b,darkolivegreen 556b2f,darkorange ff8c00,darkorchid 9932cc,
darkred 8b0000,darksalmon e9967a,darkseagreen 8fbc8f,darkslateblue 483d8b,darkslategray 2f4f4f,darkturquoise 00ced1,darkviolet 9400d3,
deeppink ff1493,deepskyblue 00bfff,dimgray 696969,dodgerblue 1e90ff,firebrick b22222,floralwhite fffaf0,forestgreen 228b22,fuchsia ff00ff,
gainsboro dcdcdc,ghostwhite f8f8ff,gold ffd700,goldenrod daa520,gray 808080,green 008000,greenyellow adff2f,honeydew f0fff0,hotpink ff69b4,
indianred cd5c5c,indigo 4b0082,ivory fffff0,khaki f0e68c,lavender e6e6fa,lavenderblush fff0f5,lawngreen 7cfc00,lemonchiffon fffacd,
lightblue add8e6,lightcoral f08080,lightcyan e0ffff,lightgoldenrodyellow fafad2,lightgray d3d3d3,lightgreen 90ee90,lightpink ffb6c1,
lightsalmon ffa07a,lightseagreen 20b2aa,lightskyblue 87cefa,lightslategray 778899,lightsteelblue b0c4de,lightyellow ffffe0,lime 00ff00,
limegreen 32cd32,linen faf0e6,magenta ff00ff,maroon 800000,mediumaquamarine 66cdaa,mediumblue 0000cd,mediumorchid ba55d3,
mediumpurple 9370db,mediumseagreen 3cb371,mediumslateblue 7b68ee,mediumspringgreen 00fa9a,mediumturquoise 48d1cc,mediumvioletred c71585,
midnightblue 191970,mintcream f5fffa,mistyrose ffe4e1,moccasin ffe4b5,navajowhite ffdead,navy 000080,oldlace fdf5e6,olive 808000,
olivedrab 6b8e23,orange ffa500,orangered ff4500,orchid da70d6,palegoldenrod eee8aa,palegreen 98fb98,paleturquoise afeeee,
palevioletred db7093,papayawhip ffefd5,peachpuff ffdab9,peru cd853f,pink ffc0cb,plum dda0dd,powderblue b0e0e6,purple 800080,red ff0000,
rosybrown bc8f8f,royalblue 4169e1,saddlebrown 8b4513,salmon fa8072,sandybrown f4a460,seagreen 2e8b57,seashell fff5ee,sienna a0522d,
silver c0c0c0,skyblue 87ceeb,slateblue 6a5acd,slategray 708090,snow fffafa,springgreen 00ff7f,steelblue 4682b4,tan d2b48c,teal 008080,
thistle d8bfd8,tomato ff6347,turquoise 40e0d0,violet ee82ee,wheat f5deb3,white ffffff,whitesmoke f5f5f5,yellow ffff00,
yellowgreen 9acd32""".replace("\n", "").split(",")
)


def parse_colour(value: Column) -> Column:
    """ARGB as a long: a name, or six (opaque) or eight hex digits, with or without #. Anything else is null."""
    names = F.create_map(*[F.lit(x) for k, v in NAMES.items() for x in (k, v)])
    hexed = F.regexp_replace(value, "^#", "")
    six = hexed.rlike("^[0-9A-Fa-f]{6}$")
    eight = hexed.rlike("^[0-9A-Fa-f]{8}$")
    named = F.element_at(names, F.lower(value))
    text = F.when(named.isNotNull(), F.concat(F.lit("ff"), named)).when(six, F.concat(F.lit("ff"), hexed)).when(eight, hexed)
    return F.conv(text, 16, 10).cast("long")
