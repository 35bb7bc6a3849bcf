"""Table schemas. Pixels are the semantics layer, strips the throughput layer; both hold the same data."""

IMAGES = """image_id long, path string, mime string, file_size long, file_date timestamp, frame_count int, content binary,
anim struct<screen_w:int, screen_h:int, frame_count:int, loop_count:int, background:int, aspect:float, needs_buffer:boolean>"""
FRAMES = """image_id long, frame_no int, width int, height int, has_alpha boolean, orientation int, fmt string, icc binary,
exif array<struct<ifd:string,tag:int,type:int,count:long,value:binary>>,
anim struct<left:int, top:int, dur_num:long, dur_den:long, disposal:int, blend:int, has_alpha:boolean>"""
PIXELS = "image_id long, frame_no int, plane string, y int, x int, b double, g double, r double, a double"
STRIPS = "image_id long, frame_no int, plane string, y0 int, rows int, width int, fmt string, data binary"
KERNEL = "kernel_id string, o int, i int, w double"
PALETTE = "image_id long, idx int, b short, g short, r short, a short"
REQUESTS = "request_id long, path string, query string"

#: Pixel formats: bits per pixel, channels, numeric kind, colour, alpha, encoding, range. One-channel data are stored in b.
FORMATS = {
    "Grey8": (8, 1, "uint", "grey", "none", "companded", "full"),
    "Y8": (8, 1, "uint", "grey", "none", "companded", "full"),
    "Cb8": (8, 1, "uint", "none", "none", "chroma", "full"),
    "Cr8": (8, 1, "uint", "none", "none", "chroma", "full"),
    "Y8Video": (8, 1, "uint", "grey", "none", "companded", "video"),
    "Cb8Video": (8, 1, "uint", "none", "none", "chroma", "video"),
    "Cr8Video": (8, 1, "uint", "none", "none", "chroma", "video"),
    "Indexed8": (8, 1, "indexed", "none", "none", "companded", "full"),
    "Bgr24": (24, 3, "uint", "bgr", "none", "companded", "full"),
    "Rgb24": (24, 3, "uint", "rgb", "none", "companded", "full"),
    "Bgrx32": (32, 4, "uint", "bgr", "none", "companded", "full"),
    "Bgra32": (32, 4, "uint", "bgr", "unassociated", "companded", "full"),
    "Rgba32": (32, 4, "uint", "rgb", "unassociated", "companded", "full"),
    "Pbgra32": (32, 4, "uint", "bgr", "associated", "companded", "full"),
    "Cmyk32": (32, 4, "uint", "cmyk", "none", "companded", "full"),
    "Grey16UQ15": (16, 1, "fixed", "grey", "none", "companded", "full"),
    "Grey16UQ15Linear": (16, 1, "fixed", "grey", "none", "linear", "full"),
    "Y16UQ15Linear": (16, 1, "fixed", "grey", "none", "linear", "full"),
    "Bgr48UQ15Linear": (48, 3, "fixed", "bgr", "none", "linear", "full"),
    "Pbgra64UQ15Linear": (64, 4, "fixed", "bgr", "associated", "linear", "full"),
    "Grey32Float": (32, 1, "float", "grey", "none", "companded", "full"),
    "Grey32FloatLinear": (32, 1, "float", "grey", "none", "linear", "full"),
    "Y32Float": (32, 1, "float", "grey", "none", "companded", "full"),
    "Y32FloatLinear": (32, 1, "float", "grey", "none", "linear", "full"),
    "Cb32Float": (32, 1, "float", "none", "none", "chroma", "full"),
    "Cr32Float": (32, 1, "float", "none", "none", "chroma", "full"),
    "Bgr96Float": (96, 3, "float", "bgr", "none", "companded", "full"),
    "Bgr96FloatLinear": (96, 3, "float", "bgr", "none", "linear", "full"),
    "Bgrx128Float": (128, 4, "float", "bgr", "none", "companded", "full"),
    "Bgrx128FloatLinear": (128, 4, "float", "bgr", "none", "linear", "full"),
    "Pbgra128Float": (128, 4, "float", "bgr", "associated", "companded", "full"),
    "Pbgra128FloatLinear": (128, 4, "float", "bgr", "associated", "linear", "full"),
}


def colour_compatible(a: str, b: str) -> bool:
    """Same channels' meaning and encoding; alpha doesn't matter."""
    x, y = FORMATS[a], FORMATS[b]
    return x[2] == y[2] and x[3] == y[3] and x[5:] == y[5:]


def binary_compatible(a: str, b: str) -> bool:
    return FORMATS[a] == FORMATS[b]
