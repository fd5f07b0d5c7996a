"""Scalar expressions, as SQL text that Spark compiles to native code (and that other SQL engines read too).

Arithmetic is in DOUBLE. `half(v)` rounds to the nearest binary16 value, ties to even, by exact double arithmetic.
"""

from __future__ import annotations

#: Rec. 709 luma weights and the DCI/ACES constants (fixed values).
LUMA = (0.2126, 0.7152, 0.0722)
DROP_FRAME_NUMERATORS = (24000, 30000, 60000)
LOSSY_CODECS = ("PXR24", "B44", "B44A", "DWAA", "DWAB")
DEEP_CODECS = ("NONE", "RLE", "ZIPS", "ZIP", "PIZ")
#: Codec names and scan lines per chunk, by code 0 to 11 (fixed values).
CODECS = ("NONE", "RLE", "ZIPS", "ZIP", "PIZ", "PXR24", "B44", "B44A", "DWAA", "DWAB", "HTJ2K256", "HTJ2K32")
LINES_PER_CHUNK = (1, 1, 1, 16, 32, 16, 32, 32, 32, 256, 256, 256)


def lit(x: float) -> str:
    return f"cast({x!r} as double)"


def half(v: str) -> str:
    """Nearest half-float value; 65520 and more overflow to infinity."""
    split, shift = lit(float(2**42 + 1)), lit(1.5 * 2**28)
    inf = "cast('Infinity' as double)"
    return f"case when isnan({v}) then {v} when abs({v}) >= 65520 then (case when {v} > 0 then {inf} else -{inf} end) when abs({v}) < {lit(2.0**-14)} then ({v} + {shift}) - {shift} else {v} * {split} - ({v} * {split} - {v}) end"


def luma(r: str, g: str, b: str) -> str:
    return f"({lit(LUMA[0])} * {r} + {lit(LUMA[1])} * {g} + {lit(LUMA[2])} * {b})"


def tone(v: str) -> str:
    return f"case when {v} <= 0 then {lit(0.0)} else {v} / (1 + {v}) end"


def clamp(v: str, low: float = 0.0, high: float = 1.0) -> str:
    return f"least({lit(high)}, greatest({lit(low)}, {v}))"


def to_srgb(v: str) -> str:
    c = clamp(v)
    return f"case when {c} <= {lit(0.0031308)} then {lit(12.92)} * {c} else {lit(1.055)} * pow({c}, {lit(1 / 2.4)}) - {lit(0.055)} end"


def from_srgb(v: str) -> str:
    return f"case when {v} <= {lit(0.04045)} then {v} / {lit(12.92)} else pow(({v} + {lit(0.055)}) / {lit(1.055)}, {lit(2.4)}) end"


def to_byte(v: str) -> str:
    return f"cast(floor({clamp(v)} * 255 + 0.5) as int)"


def latitude(x: str, y: str, z: str) -> str:
    """Near the poles from the distance to the axis, else from the height; 0 for the zero vector."""
    r, n = f"sqrt({x} * {x} + {z} * {z})", f"sqrt({x} * {x} + {y} * {y} + {z} * {z})"
    return f"case when {n} = 0 then {lit(0.0)} when {r} < abs({y}) then acos({r} / {n}) * sign({y}) else asin({y} / {n}) end"


def longitude(x: str, y: str, z: str) -> str:
    return f"case when {x} = 0 and {z} = 0 then {lit(0.0)} else atan2({x}, {z}) end"


def cube_face(x: str, y: str, z: str) -> str:
    """0 to 5: +X, -X, +Y, -Y, +Z, -Z by the dominant axis, earlier axes first."""
    ax, ay, az = f"abs({x})", f"abs({y})", f"abs({z})"
    return f"case when {ax} >= {ay} and {ax} >= {az} then (case when {x} > 0 then 0 else 1 end) when {ay} >= {az} then (case when {y} > 0 then 2 else 3 end) else (case when {z} > 0 then 4 else 5 end) end"


def bcd(n: str) -> str:
    return f"(({n} - {n} % 10) / 10 * 16 + {n} % 10)"
