"""Colour maths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_PATTERN = r"^#?[0-9A-Fa-f]{6}$"
STRICT_HEX_PATTERN = r"^#[0-9A-Fa-f]{6}$"
# Distances are compared after rounding to this many digits, so cube-root noise never decides a tie.
DISTANCE_DIGITS = 6


def round_half_up(c: Column) -> Column:
    return F.floor(c + F.lit(0.5))


def round_distance(c: Column) -> Column:
    """Round to DISTANCE_DIGITS with plain arithmetic; the built-in goes through BigDecimal."""
    scale = float(10**DISTANCE_DIGITS)
    return F.rint(c * scale) / scale


def hex_channel(hex_col: Column, i: int) -> Column:
    digits = F.substring(F.regexp_replace(hex_col, "^#", ""), 2 * i + 1, 2)
    return F.when(hex_col.rlike(HEX_PATTERN), F.conv(digits, 16, 10).cast("int"))


def hex_to_rgb(hex_col: Column) -> Column:
    rgb = F.struct(*[hex_channel(hex_col, i).alias(n) for i, n in enumerate("rgb")])
    return F.when(hex_col.rlike(HEX_PATTERN), rgb)


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02X%02X%02X", r, g, b)


def srgb_to_linear(channel: Column) -> Column:
    n = channel / F.lit(255.0)
    return F.when(n <= 0.04045, n / 12.92).otherwise(F.pow((n + 0.055) / 1.055, F.lit(2.4)))


# The published Oklab matrices (linear sRGB to cone response, cone response to Lab).
_OKLAB_CONES = [
    (0.4122214708, 0.5363325363, 0.0514459929),
    (0.2119034982, 0.6806995451, 0.1073969566),
    (0.0883024619, 0.2817188376, 0.6299787005),
]
_OKLAB_AXES = [
    ("l", (0.2104542553, 0.7936177850, -0.0040720468)),
    ("a", (1.9779984951, -2.4285922050, 0.4505937099)),
    ("b", (0.0259040371, 0.7827717662, -0.8086757660)),
]


def _mix(weights: tuple, parts: list[Column]) -> Column:
    total = parts[0] * weights[0]
    for w, p in zip(weights[1:], parts[1:]):
        total = total + p * w
    return total


def rgb_to_oklab(r: Column, g: Column, b: Column) -> Column:
    linear = [srgb_to_linear(c) for c in (r, g, b)]
    roots = [F.cbrt(_mix(row, linear)) for row in _OKLAB_CONES]
    return F.struct(*[_mix(row, roots).alias(name) for name, row in _OKLAB_AXES])


def oklab_distance(a: Column, b: Column) -> Column:
    """Euclidean distance in Oklab, times 100, between two Oklab structs."""
    squares = [(a[n] - b[n]) * (a[n] - b[n]) for n in "lab"]
    return F.sqrt(squares[0] + squares[1] + squares[2]) * 100


def oklab_distance_rounded(a: Column, b: Column) -> Column:
    return round_distance(oklab_distance(a, b))


# Linear sRGB to XYZ (D65), white point, CIE Lab thresholds.
_XYZ_ROWS = [
    ((0.412453, 0.357580, 0.180423), 0.950456),
    ((0.212671, 0.715160, 0.072169), 1.0),
    ((0.019334, 0.119193, 0.950227), 1.088754),
]


def rgb_to_lab8(r: Column, g: Column, b: Column) -> Column:
    """CIE Lab scaled to three 8-bit values."""
    linear = [srgb_to_linear(c) for c in (r, g, b)]
    xyz = [_mix(row, linear) / white for row, white in _XYZ_ROWS]
    fx, fy, fz = [F.when(t > 0.008856, F.cbrt(t)).otherwise(t * 7.787 + 16.0 / 116.0) for t in xyz]
    lightness = F.when(xyz[1] > 0.008856, F.cbrt(xyz[1]) * 116.0 - 16.0).otherwise(xyz[1] * 903.3)
    scaled = {
        "l": lightness * 255.0 / 100.0,
        "a": (fx - fy) * 500.0 + 128.0,
        "b": (fy - fz) * 200.0 + 128.0,
    }
    # A 1e-9 nudge keeps exact halves on the same side whatever the cube root's last bit is.
    return F.struct(*[round_half_up(v + 1e-9).cast("int").alias(n) for n, v in scaled.items()])


def lab8_distance(a: Column, b: Column) -> Column:
    d = [(a[n] - b[n]).cast("double") for n in "lab"]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def hex_to_hsl(hex_col: Column) -> Column:
    """Hue in degrees, saturation and lightness in percent."""
    r, g, b = [hex_channel(hex_col, i) / F.lit(255.0) for i in range(3)]
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    spread = hi - lo
    light = (hi + lo) / 2
    hue = (
        F.when(spread == 0, F.lit(0.0))
        .when(hi == r, ((g - b) / spread + F.when(g < b, 6).otherwise(0)) / 6)
        .when(hi == g, ((b - r) / spread + 2) / 6)
        .otherwise(((r - g) / spread + 4) / 6)
    )
    sat = F.when(spread == 0, F.lit(0.0)).when(light > 0.5, spread / (F.lit(2.0) - hi - lo)).otherwise(spread / (hi + lo))
    return F.struct((hue * 360).alias("h"), (sat * 100).alias("s"), (light * 100).alias("l"))


def hue_order(hex_col: Column) -> list[Column]:
    """Total order close to the eye's: hue band of 5°, light to dark in steps of 3, vivid first."""
    hsl = hex_to_hsl(hex_col)
    return [
        F.floor(F.round(hsl["h"], 6) / 5).asc(),
        F.floor(F.round(hsl["l"], 6) / 3).desc(),
        F.round(hsl["s"], 6).desc(),
        hex_col.asc(),
    ]


def luma(r: Column, g: Column, b: Column) -> Column:
    """Rec. 709 brightness, 0…255."""
    return r * 0.2126 + g * 0.7152 + b * 0.0722


def contrast_color(hex_col: Column) -> Column:
    """Text colour readable on a background."""
    bright = luma(*[hex_channel(hex_col, i) for i in range(3)]) / 255
    return F.when(bright <= 0.5, "#FFFFFF").otherwise("#000000")


def clamp(c: Column, lo, hi) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(as_col(hi), F.greatest(c, as_col(lo)))


def distance_to_confidence(distance: Column) -> Column:
    return clamp(1 - distance / 34.0, 0.05, 0.99)


def is_near_white(r: Column, g: Column, b: Column, threshold: int = 246) -> Column:
    return (r >= threshold) & (g >= threshold) & (b >= threshold)
