"""Queries on values: half and short floats, colour, transforms, names, codes, hashes, timecodes and metadata.

Registered beside those of the catalogue, each with its SQL counterpart.
"""

from __future__ import annotations

import math

from lumenframe import functions as fn
from lumenframe.plans.catalogue import add, r6, scalar

_BITS = "(y * 64 + x) * 7919 % 65536"
_PI = fn.lit(math.pi)


def xor(a: str, b: str) -> str:
    return f"((({a}) | ({b})) - (({a}) & ({b})))"


def bit(t: str, n: int) -> str:
    return f"((({t}) {{idiv}} {1 << n}) % 2)"


def codes(name: str, values: dict[str, tuple[str, ...]]) -> None:
    """Code tables as rows (kind, code, label)."""
    rows = ", ".join(f"('{k}', {i}, '{v}')" for k, vs in values.items() for i, v in enumerate(vs))
    add(name, f"SELECT kind, code, label FROM (VALUES {rows}) t(kind, code, label)")


# --- half and short floats --------------------------------------------------------------------------------------------
_HALF = "WITH h AS (SELECT y, x, " + _BITS + " AS h FROM plane), p AS (SELECT y, x, h, h {idiv} 32768 AS s, h {idiv} 1024 % 32 AS e, h % 1024 AS m FROM h) "
_WIDE = "CASE WHEN s = 1 THEN -1 ELSE 1 END * CASE WHEN e = 0 THEN m * pow(cast(2 as double), -24) ELSE (1024 + m) * pow(cast(2 as double), e - 25) END"
add("sc2_half_to_float", _HALF + f"SELECT y, x, h, CASE WHEN e < 31 THEN {_WIDE} + 0 END AS v FROM p")
add("sc3_half_signs", _HALF + "SELECT y, x, h, h % 32768 AS absolute, CASE WHEN s = 1 THEN h - 32768 ELSE h + 32768 END AS negated, CASE WHEN e < 31 THEN '' WHEN m > 0 THEN 'NaN' WHEN s = 1 THEN '-Inf' ELSE '+Inf' END AS text FROM p")
add("sc4_half_bytes", _HALF + f"SELECT y, x, h % 256 AS low, h {{idiv}} 256 AS high, CASE WHEN e < 31 THEN {_WIDE} + 0 END AS v FROM p")
add("flt14_half_classes", _HALF + "SELECT y, x, e = 31 AND m > 0 AS is_nan, e = 31 AND m = 0 AS is_inf, h = 31744 AS is_pos_inf, h = 64512 AS is_neg_inf, e = 0 AND m = 0 AS is_zero, e > 0 AND e < 31 AS is_normal, e = 0 AND m > 0 AS is_subnormal, e < 31 AS is_finite, s = 1 AS is_negative FROM p")
add("flt15_half_compare", _HALF + f", v AS (SELECT y, x, CASE WHEN e = 31 AND m > 0 THEN NULL WHEN e = 31 THEN CASE WHEN s = 1 THEN -1 ELSE 1 END * cast(100000 as double) ELSE {_WIDE} END AS a, cast(floor(x - 32) as double) AS b FROM p) SELECT y, x, coalesce(a < b, false) AS lt, coalesce(a <= b, false) AS le, coalesce(a > b, false) AS gt, coalesce(a >= b, false) AS ge, coalesce(a = b, false) AS eq FROM v")
# 15 bits of mantissa, halves away from zero; e is the exponent, corrected where the logarithm was a last bit off
add("sc16_float24", "WITH a AS (SELECT y, x, v, floor(log2(abs(v))) AS g FROM plane WHERE v <> 0), e AS (SELECT y, x, v, CASE WHEN pow(cast(2 as double), g) > abs(v) THEN g - 1 WHEN pow(cast(2 as double), g + 1) <= abs(v) THEN g + 1 ELSE g END AS e FROM a) SELECT y, x, floor(abs(v) * pow(cast(2 as double), 15 - e) + 0.5) * pow(cast(2 as double), e - 15) * sign(v) AS v FROM e UNION ALL SELECT y, x, cast(0 as double) AS v FROM plane WHERE v = 0")
scalar("sc23_wrapping_math", "bytes", "doc_id, pos", add8="(b + 200) % 256", sub8="(b - 200 + 256) % 256", mul16="(b * 40503) % 65536", add32="(b + 4294967290) % 4294967296")
# --- colour -----------------------------------------------------------------------------------------------------------
_Y = fn.luma("r", "g", "b")
add("sc7_yc_to_rgb", f"WITH c AS (SELECT y, x, {_Y} AS l, r - {_Y} AS ry, b - {_Y} AS by_ FROM rgb) SELECT y, x, {r6('ry + l')} AS r, {r6(f'(l - {fn.lit(fn.LUMA[0])} * (ry + l) - {fn.lit(fn.LUMA[2])} * (by_ + l)) / {fn.lit(fn.LUMA[1])}')} AS g, {r6('by_ + l')} AS b FROM c")
scalar("sc11_preview_to_rgba", "bytes", "doc_id, pos", v=r6(fn.from_srgb(f"(b / {fn.lit(255.0)})")), a=r6(f"b / {fn.lit(255.0)}"))
#: Chromaticities of red, green, blue and white: Rec. 709 and ACES (fixed values).
PRIMARIES = {"rec709": ((0.64, 0.33), (0.3, 0.6), (0.15, 0.06), (0.3127, 0.329)), "aces": ((0.7347, 0.2653), (0.0, 1.0), (0.0001, -0.077), (0.32168, 0.33767))}
_PRIM = "(VALUES " + ", ".join(f"('{n}', " + ", ".join(fn.lit(v) for xy in p for v in xy) + ")" for n, p in PRIMARIES.items()) + ") t(name, rx, ry, gx, gy, bx, by_, wx, wy)"
add("sc14_primaries", f"SELECT name, rx, ry, gx, gy, bx, by_, wx, wy, wx AS neutral_x, wy AS neutral_y FROM {_PRIM}")
# columns of the matrix are the primaries' XYZ, scaled so that equal parts make white of luminance 1
_D = "(rx * (gy - by_) + gx * (by_ - ry) + bx * (ry - gy))"
_SCALES = {"r": f"(wx * (gy - by_) - wy * (gx - bx) + gx * by_ - bx * gy) / (wy * {_D})", "g": f"(wx * (by_ - ry) - wy * (bx - rx) + bx * ry - rx * by_) / (wy * {_D})", "b": f"(wx * (ry - gy) - wy * (rx - gx) + rx * gy - gx * ry) / (wy * {_D})"}
_XYZ = f"SELECT name, {_SCALES['r']} AS sr, {_SCALES['g']} AS sg, {_SCALES['b']} AS sb, rx, ry, gx, gy, bx, by_, wx, wy FROM {_PRIM}"
add("sc12_rgb_to_xyz", f"WITH q AS ({_XYZ}) SELECT name, " + ", ".join(f"{r6(f's{c} * {c}x')} AS x{c}, {r6(f's{c} * ' + ('by_' if c == 'b' else c + 'y'))} AS y{c}, {r6(f's{c} * (1 - {c}x - ' + ('by_' if c == 'b' else c + 'y') + ')')} AS z{c}" for c in "rgb") + " FROM q")
#: The Bradford cone response (fixed values).
BRADFORD = ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296))
_CONES = lambda w: ", ".join(f"({fn.lit(m[0])} * {w}x / {w}y + {fn.lit(m[1])} + {fn.lit(m[2])} * (1 - {w}x - {w}y) / {w}y) AS {w}{i}" for i, m in enumerate(BRADFORD))
add("sc13_adaptation_gains", f"WITH w AS (SELECT a.name AS source, b.name AS target, a.wx AS ax, a.wy AS ay, b.wx AS tx, b.wy AS ty FROM {_PRIM.replace(' t(', ' a(')} CROSS JOIN {_PRIM.replace(' t(', ' b(')}), c AS (SELECT source, target, {_CONES('a')}, {_CONES('t')} FROM w) SELECT source, target, {r6('t0 / a0')} AS rho, {r6('t1 / a1')} AS gamma, {r6('t2 / a2')} AS beta FROM c")
#: The inverse cone response, rounded to six places (fixed values).
CONES_BACK = ((0.986993, -0.147054, 0.159963), (0.432305, 0.518360, 0.049291), (-0.008529, 0.040043, 0.968487))
_TURNED = lambda m: tuple(zip(*m, strict=True))


def _adaptation(mode: str, cones: tuple, first: tuple, last: tuple) -> str:
    """Rows (source, target, mode, m11 to m33): first x gains x last, the gains being those of the whites' cone responses."""
    seen = lambda w: ", ".join(f"({fn.lit(m[0])} * {w}x / {w}y + {fn.lit(m[1])} + {fn.lit(m[2])} * (1 - {w}x - {w}y) / {w}y) AS {w}{i}" for i, m in enumerate(cones))
    cells = ", ".join(r6(" + ".join(f"{fn.lit(first[i][k] * last[k][j])} * t{k} / a{k}" for k in range(3))) + f" AS m{i + 1}{j + 1}" for i in range(3) for j in range(3))
    return f"SELECT source, target, '{mode}' AS mode, {cells} FROM (SELECT source, target, {seen('a')}, {seen('t')} FROM w) {mode}_"


# the reference form takes the cone response by columns throughout, the colorimetric one maps the source's white onto the target's
_WHITES = f"w AS (SELECT a.name AS source, b.name AS target, a.wx AS ax, a.wy AS ay, b.wx AS tx, b.wy AS ty FROM {_PRIM.replace(' t(', ' a(')} CROSS JOIN {_PRIM.replace(' t(', ' b(')})"
add("sc13_adaptation_matrix", f"WITH {_WHITES} {_adaptation('reference', _TURNED(BRADFORD), _TURNED(BRADFORD), _TURNED(CONES_BACK))} UNION ALL {_adaptation('colorimetric', BRADFORD, CONES_BACK, BRADFORD)}")
_LOG = fn.lit(2.2)
scalar("sc17_log_tables", "plane", "y, x", plinear=r6("CASE WHEN v <= 0 THEN 0 ELSE 8 * ln(v) END"), expanded=r6("exp(v / 8)"), nonlinear=r6(f"CASE WHEN abs(v) <= 1 THEN sign(v) * pow(abs(v), 1 / {_LOG}) ELSE sign(v) * (ln(abs(v)) / {_LOG} + 1) END"))
scalar("sc19_csc709", "rgb", "y, x", luma=r6(_Y), cb=r6(f"(b - {_Y}) / {fn.lit(1.8556)}"), cr=r6(f"(r - {_Y}) / {fn.lit(1.5748)}"))
scalar("sg8_identity_matrices", "(SELECT n_nationkey AS i FROM nation WHERE n_nationkey < 16) m", "i", four="CASE WHEN i {idiv} 4 = i % 4 THEN 1 ELSE 0 END", three="CASE WHEN i >= 9 THEN NULL WHEN i {idiv} 3 = i % 3 THEN 1 ELSE 0 END")
# --- transforms over planes -------------------------------------------------------------------------------------------


def zigzag() -> list[int]:
    """Places of an 8 x 8 block along its antidiagonals, every other one upwards."""
    return sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8))


_ZIG = "(VALUES " + ", ".join(f"({k}, {p})" for k, p in enumerate(zigzag())) + ") z(k, place)"
add("win7_zigzag", f"SELECT y, k, v FROM plane JOIN {_ZIG} ON place = x")
# an 8 x 8 transform in two passes of eight: along rows, then along columns
_N = "(VALUES " + ", ".join(f"({i})" for i in range(8)) + ")"
_C = lambda k, n: f"(CASE WHEN {k} = 0 THEN sqrt(cast(0.125 as double)) ELSE cast(0.5 as double) END * cos((2 * {n} + 1) * {k} * {_PI} / 16))"
add("sc18_dct_forward", f"WITH r AS (SELECT y, x {{idiv}} 8 AS i, q.u, sum(v * {_C('q.u', '(x % 8)')}) AS s FROM plane CROSS JOIN {_N} q(u) GROUP BY y, x {{idiv}} 8, q.u) SELECT y, q.w, r.u, round(sum(s * {_C('q.w', 'i')}), 5) + 0 AS c FROM r CROSS JOIN {_N} q(w) GROUP BY y, q.w, r.u")
# back again: coefficients by column, then by row, give the 8 x 8 values that they came from
add("sc18_dct_inverse", f"WITH r AS (SELECT y {{idiv}} 8 AS i, x {{idiv}} 8 AS j, y % 8 AS m, q.u, sum(v * {_C('q.u', '(x % 8)')}) AS s FROM plane CROSS JOIN {_N} q(u) GROUP BY y {{idiv}} 8, x {{idiv}} 8, y % 8, q.u), f AS (SELECT i, j, u, q.w, sum(s * {_C('q.w', 'm')}) AS c FROM r CROSS JOIN {_N} q(w) GROUP BY i, j, u, q.w), b AS (SELECT i, j, u, q.m, sum(c * {_C('w', 'q.m')}) AS s FROM f CROSS JOIN {_N} q(m) GROUP BY i, j, u, q.m) SELECT i * 8 + m AS y, j * 8 + q.n AS x, round(sum(s * {_C('u', 'q.n')}), 5) + 0 AS v FROM b CROSS JOIN {_N} q(n) CROSS JOIN (SELECT max(y) AS top FROM plane) t WHERE i * 8 + m <= top GROUP BY i, j, m, q.n", "SELECT y, x, round(v, 5) + 0 AS v FROM plane")
_L = lambda d: f"(CASE WHEN abs({d}) >= 2 THEN 0 ELSE 2 * sin({_PI} * {d}) * sin({_PI} * {d} / 2) / ({_PI} * {_PI} * {d} * {d}) END)"
# four taps a side, at half-pixel distances; edges are renormalised. Rows first, so that each pixel is sent four times, not sixteen
_TAPS = "(VALUES (-1), (0), (1), (2)) k(d)"
add("agg9_lanczos_downsample", f"""
WITH m AS (SELECT max(y) + 1 AS height FROM plane), t AS (SELECT y, x {{idiv}} 2 - k.d + 1 AS x2, x, v FROM plane CROSS JOIN {_TAPS}),
w AS (SELECT y, x2, v, (x + 0.5 - (x2 + 0.5) * 2) AS d FROM t WHERE x2 BETWEEN 0 AND 31), f AS (SELECT y, x2, sum(v * {_L('d')}) / sum({_L('d')}) AS v FROM w WHERE abs(d) < 2 GROUP BY y, x2),
g AS (SELECT y {{idiv}} 2 - k.d + 1 AS y2, x2, v, y FROM f CROSS JOIN {_TAPS}), c AS (SELECT y2, x2, v, (y + 0.5 - (y2 + 0.5) * 2) AS d FROM g CROSS JOIN m WHERE y2 >= 0 AND y2 < height {{idiv}} 2)
SELECT y2, x2, round(sum(v * {_L('d')}) / sum({_L('d')}), 5) + 0 AS v FROM c WHERE abs(d) < 2 GROUP BY y2, x2""".strip().replace("\n", " "))
# each source pixel goes to the outputs whose footprint [int(start), ceil(end)) holds it: at scales above 1, its own and perhaps a neighbour
# an image is 21 lines of 21 pixels, the last one those that are left; an output is no larger than its image
_PW, _SW = 8, 21
add("agg15_preview", f"WITH d AS (SELECT y {{idiv}} {_SW} AS image, max(y % {_SW}) + 1 AS h FROM rgb GROUP BY y {{idiv}} {_SW}), s AS (SELECT y {{idiv}} {_SW} AS image, y % {_SW} AS sy, x AS sx, h, least({_PW}, h) AS ph, r, g, b FROM rgb JOIN d ON d.image = y {{idiv}} {_SW}), e AS (SELECT image, p.i AS py, q.i AS px, r, g, b FROM s JOIN {_N} q(i) ON sx >= floor(q.i * {_SW} / {fn.lit(_PW)}) AND sx < ceil((q.i + 1) * {_SW} / {fn.lit(_PW)}) JOIN {_N} p(i) ON p.i < ph AND sy >= floor(p.i * h / cast(ph as double)) AND sy < ceil((p.i + 1) * h / cast(ph as double))), a AS (SELECT image, py, px, round(avg(r), 9) AS r, round(avg(g), 9) AS g, round(avg(b), 9) AS b FROM e GROUP BY image, py, px), t AS (SELECT image, py, px, {fn.tone('r')} AS r, {fn.tone('g')} AS g, {fn.tone('b')} AS b FROM a) SELECT image, py, px, {fn.to_byte('(' + fn.to_srgb('r') + ')')} AS r, {fn.to_byte('(' + fn.to_srgb('g') + ')')} AS g, {fn.to_byte('(' + fn.to_srgb('b') + ')')} AS b FROM t")
add("agg13_channel_filters", "SELECT y {idiv} 2 AS y2, x {idiv} 2 AS x2, round(avg(r), 6) + 0 AS r_box, round(sum(CASE WHEN x % 2 = 0 THEN g END) / count(CASE WHEN x % 2 = 0 THEN 1 END), 6) + 0 AS g_point, round(max(b), 6) + 0 AS b_most FROM rgb GROUP BY y {idiv} 2, x {idiv} 2")
add("prj1_channel_projection", "SELECT y, x, r FROM rgb")
scalar("prj2_type_conversion", "plane", "y, x", as_half=fn.half("v"), as_uint="cast(floor(greatest(0, v)) as bigint)")
scalar("prj3_plane_allocation", "windows", "o_custkey", full="(maxx - minx + 1) * (maxy - miny + 1)", halved="((maxx - minx + 2) {idiv} 2) * ((maxy - miny + 2) {idiv} 2)")
scalar("prj4_pixel_addressing", "plane", "y, x", place="(y {idiv} 2) * 128 + (x {idiv} 2) * 4")
add("prj5_row_bulk", "SELECT y, listagg(cast(cast(floor(v * 4096) as bigint) as string), ',') WITHIN GROUP (ORDER BY x) AS values_ FROM plane GROUP BY y", "SELECT y, string_agg(cast(cast(floor(v * 4096) as bigint) as varchar), ',' ORDER BY x) AS values_ FROM plane GROUP BY y")
add("set5_make_tiled", "SELECT 0 AS l, y {idiv} 16 AS ty, x {idiv} 16 AS tx, y % 16 AS ry, x % 16 AS rx, v FROM plane UNION ALL SELECT 1 AS l, y2 {idiv} 16, x2 {idiv} 16, y2 % 16, x2 % 16, v FROM (SELECT y {idiv} 2 AS y2, x {idiv} 2 AS x2, round(avg(v), 6) + 0 AS v FROM plane GROUP BY y {idiv} 2, x {idiv} 2) q")
add("set6_deep_part_copy", "SELECT y, x, s, z, zback, a, r, g, b FROM deep WHERE src = 1")
# --- directions -------------------------------------------------------------------------------------------------------
_LAT, _LON = fn.latitude("dx", "dy", "dz"), fn.longitude("dx", "dy", "dz")
_PX, _PY = f"((({_LON}) / (-2 * {_PI}) + 0.5) * 63)", f"((({_LAT}) / (-1 * {_PI}) + 0.5) * 31)"
scalar("sg3_latlong_pixel", "dirs", "vec_id", px=r6(_PX), py=r6(_PY), ix=f"cast(floor({_PX} + 0.5) as bigint)", iy=f"cast(floor({_PY} + 0.5) as bigint)", lat_back=r6(f"({_PY} / 31 - 0.5) * (-1 * {_PI})"), lon_back=r6(f"({_PX} / 63 - 0.5) * (-2 * {_PI})"))
_F = fn.cube_face("dx", "dy", "dz")
add("sg6_cube_position", f"WITH f AS (SELECT vec_id, {_F} AS face, dx, dy, dz, greatest(abs(dx), abs(dy), abs(dz)) AS n FROM dirs), p AS (SELECT vec_id, face, (CASE WHEN face < 2 THEN dy ELSE dx END / n + 1) / 2 * 63 AS u, (CASE WHEN face < 4 THEN dz ELSE dy END / n + 1) / 2 * 63 AS v FROM f WHERE n > 0) SELECT vec_id, face, {r6('CASE face WHEN 0 THEN v WHEN 1 THEN 63 - v WHEN 4 THEN 63 - u ELSE u END')} AS px, {r6('face * 64 + CASE WHEN face < 2 THEN 63 - u WHEN face = 3 THEN v ELSE 63 - v END')} AS py, {r6('CASE face WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE u / 63 * 2 - 1 END')} AS dir_x, {r6('CASE WHEN face = 2 THEN 1 WHEN face = 3 THEN -1 WHEN face < 2 THEN u / 63 * 2 - 1 ELSE v / 63 * 2 - 1 END')} AS dir_y FROM p")
# four weighted neighbours each, looked up by place; the image is the whole plane, 64 wide
_WHOLE_Y = f"((({_LAT}) / (-1 * {_PI}) + 0.5) * top)"
_NEAR = f"m AS (SELECT max(y) AS top FROM plane), p AS (SELECT vec_id, top, {_PX} AS px, {_WHOLE_Y} AS py FROM dirs CROSS JOIN m), n AS (SELECT vec_id, least(63, cast(floor(px) as bigint) + i) AS x, least(top, cast(floor(py) as bigint) + j) AS y, CASE WHEN i = 0 THEN 1 - (px - floor(px)) ELSE px - floor(px) END * CASE WHEN j = 0 THEN 1 - (py - floor(py)) ELSE py - floor(py) END AS w FROM p CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j))"
add("jn4_direction_lookup", f"WITH {_NEAR} SELECT vec_id, round(sum(w * v), 6) + 0 AS v FROM n JOIN (SELECT y AS my, x AS mx, v FROM plane) i ON my = y AND mx = x GROUP BY vec_id")
# tent-weighted lookups around a direction; both offsets turn about the same axis, whichever way the direction points
_R, _W3 = fn.lit(0.1), "(VALUES (-1), (0), (1))"


def filtered(name: str, source: str, key: str) -> None:
    """source: (key, dx, dy, dz); three by three directions within a radius of 0.1."""
    c = lambda a, b: f"(d{a} * e{b} - d{b} * e{a})"
    lat, lon = fn.latitude("dx", "dy", "dz"), fn.longitude("dx", "dy", "dz")
    px, py = f"((({lon}) / (-2 * {_PI}) + 0.5) * 63)", f"((({lat}) / (-1 * {_PI}) + 0.5) * top)"
    add(name, f"""
WITH s AS ({source}), z AS (SELECT max(y) AS top FROM plane), u AS (SELECT {key}, dx / n AS dx, dy / n AS dy, dz / n AS dz FROM (SELECT {key}, dx, dy, dz, sqrt(dx * dx + dy * dy + dz * dz) AS n FROM s) q WHERE n > 0),
e AS (SELECT {key}, dx, dy, dz, cast(0 as double) AS ex, CASE WHEN m > 0 THEN f * dz * {_R} / m ELSE 0 END AS ey, CASE WHEN m > 0 THEN -1 * f * dy * {_R} / m ELSE 0 END AS ez FROM (SELECT {key}, dx, dy, dz, CASE WHEN abs(dx) > 0.707 THEN -1 ELSE 1 END AS f, sqrt(dy * dy + dz * dz) AS m FROM u) q),
g AS (SELECT {key}, dx, dy, dz, ex, ey, ez, {c('y', 'z')} AS hx, {c('z', 'x')} AS hy, {c('x', 'y')} AS hz FROM e),
h AS (SELECT {key}, dx, dy, dz, ex, ey, ez, CASE WHEN n > 0 THEN hx * {_R} / n ELSE hx END AS hx, CASE WHEN n > 0 THEN hy * {_R} / n ELSE hy END AS hy, CASE WHEN n > 0 THEN hz * {_R} / n ELSE hz END AS hz FROM (SELECT {key}, dx, dy, dz, ex, ey, ez, hx, hy, hz, sqrt(hx * hx + hy * hy + hz * hz) AS n FROM g) q),
d AS (SELECT {key}, dx + i * ex / 2 + j * hx / 2 AS dx, dy + i * ey / 2 + j * hy / 2 AS dy, dz + i * ez / 2 + j * hz / 2 AS dz, (1 - abs(i) / cast(2 as double)) * (1 - abs(j) / cast(2 as double)) AS t FROM h CROSS JOIN {_W3} a(i) CROSS JOIN {_W3} b(j)),
p AS (SELECT {key}, t, top, {px} AS px, {py} AS py FROM d CROSS JOIN z),
n AS (SELECT {key}, t, least(63, cast(floor(px) as bigint) + i) AS x, least(top, cast(floor(py) as bigint) + j) AS y, t * CASE WHEN i = 0 THEN 1 - (px - floor(px)) ELSE px - floor(px) END * CASE WHEN j = 0 THEN 1 - (py - floor(py)) ELSE py - floor(py) END AS w FROM p CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j))
SELECT {key}, round(sum(w * v) / sum(w), 5) + 0 AS v FROM n JOIN (SELECT y AS my, x AS mx, v FROM plane) m ON my = n.y AND mx = n.x GROUP BY {key}""".strip().replace("\n", " "))


filtered("agg16_filtered_lookup", "SELECT vec_id, dx, dy, dz FROM dirs", "vec_id")
filtered("agg17_environment_conversion", f"SELECT k, sin(lon) * cos(lat) AS dx, sin(lat) AS dy, cos(lon) * cos(lat) AS dz FROM (SELECT j * 8 + i AS k, (i / cast(7 as double) - 0.5) * (-2 * {_PI}) AS lon, (j / cast(7 as double) - 0.5) * (-1 * {_PI}) AS lat FROM {_N} a(i) CROSS JOIN {_N} b(j)) q", "k")
# --- timecodes, rates -------------------------------------------------------------------------------------------------
_T = f"WITH t AS (SELECT event_id, hh, mm, ss, ff, cast({fn.bcd('hh')} * 16777216 + {fn.bcd('mm')} * 65536 + {fn.bcd('ss')} * 256 + {fn.bcd('ff')} as bigint) + (event_id % 2) * 64 + (event_id {{idiv}} 2 % 2) * 128 + (event_id {{idiv}} 4 % 2) * 32768 + (event_id {{idiv}} 8 % 2) * 8388608 + (event_id {{idiv}} 16 % 2) * 1073741824 + (event_id {{idiv}} 32 % 2) * 2147483648 AS t FROM timecode) "
_CLEAR = lambda *bits: f"t - ({' + '.join(f'{bit("t", n)} * {1 << n}' for n in bits)})"
add("sd3_timecode_setters", _T + f"SELECT event_id, {_CLEAR(6)} + 64 AS drop_set, {_CLEAR(7)} AS color_cleared, {_CLEAR(15)} + 32768 AS field_set, t - t % 64 + 41 AS frame_29 FROM t")
add("sd4_timecode_repack", _T + f"SELECT event_id, t AS tv60, {_CLEAR(6, 15, 23, 30, 31)} + {bit('t', 23)} * 32768 + {bit('t', 31)} * 8388608 + {bit('t', 30)} * 1073741824 + {bit('t', 15)} * 2147483648 AS tv50, {_CLEAR(6, 7)} AS film24 FROM t")
scalar("sd5_binary_groups", "(SELECT event_id, event_id * 2654435761 % 4294967296 AS u FROM events) q", "event_id", **{f"g{k}": f"u {{idiv}} {16 ** (k - 1)} % 16" for k in range(1, 9)})
scalar("sd6_capture_attributes", "events", "event_id", offset_hours=r6("(event_id % 49 - 24) * 1800 / cast(3600 as double)"), fps=r6("CASE WHEN event_id % 3 = 0 THEN 0 ELSE 24000 / cast(1000 + event_id % 2 as double) END"))
#: Exact frame rates and their names (fixed values).
RATES = {(24, 1): "24 fps (Cinema)", (24000, 1001): "23.976 fps (NTSC Film)", (25, 1): "25 fps (PAL)", (30000, 1001): "29.97 fps (NTSC)", (30, 1): "30 fps", (48, 1): "48 fps (HFR Cinema)", (50, 1): "50 fps (PAL HFR)", (60000, 1001): "59.94 fps (NTSC HFR)", (60, 1): "60 fps", (120, 1): "120 fps"}
_RATES = "(VALUES " + ", ".join(f"({n}, {d}, '{l}')" for (n, d), l in RATES.items()) + ") r(num, den, label)"
_ASKED = "(SELECT event_id, CASE event_id % 3 WHEN 0 THEN 24000 WHEN 1 THEN 30 ELSE 25 END + event_id % 2 AS n, CASE event_id % 3 WHEN 0 THEN 1001 ELSE 1 END AS d FROM events) e"
add("sc22_frame_rate_name", f"SELECT event_id, n, d, coalesce(label, '') AS label FROM {_ASKED} LEFT JOIN {_RATES} ON num = n AND den = d")
add("sc21_rational_value", f"WITH q AS (SELECT event_id, n, d, CASE WHEN d = 0 THEN 0 ELSE n / cast(d as double) END AS f FROM {_ASKED}), s AS (SELECT event_id, f, min(num) AS num, min(den) AS den FROM q LEFT JOIN {_RATES} ON floor(f) = floor(num / cast(den as double)) AND abs(f - num / cast(den as double)) < 0.0001 GROUP BY event_id, f) SELECT event_id, {r6('f')} AS f, num, den FROM s")
# --- names, codes, hashes ---------------------------------------------------------------------------------------------
codes("sd15_descriptions", {"compression": ("none", "rle", "zip, individual scanlines", "zip, multi-scanline blocks", "piz", "pxr24", "b44", "b44a", "dwaa", "dwab"), "line order": ("increasing y", "decreasing y", "random y"), "environment": ("latitude-longitude map", "cube-face map"), "level mode": ("single level", "mip-map", "rip-map"), "rounding": ("down", "up"), "pixel type": ("32-bit unsigned integer", "16-bit floating-point", "32-bit floating-point")})
_NAMED = "(VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(fn.CODECS)) + ") c(code, name)"
add("sd16_codec_parse", f"SELECT given, code FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'zip' WHEN 1 THEN 'Piz' WHEN 2 THEN 'DWAB' ELSE p_brand END AS given FROM part) p LEFT JOIN {_NAMED} ON name = upper(given)")
_BASE = "regexp_extract(name, '([^.]*)$', 1)"
scalar("sd17_dwa_class", "channels", "name", scheme=f"CASE WHEN {_BASE} IN ('R', 'G', 'B', 'Y', 'RY', 'BY') THEN 'LOSSY_DCT' WHEN {_BASE} = 'A' THEN 'RLE' ELSE 'UNKNOWN' END")
add("sd18_zlib_flevel", "SELECT doc_id, pos, (120 * 256 + b) % 31 = 0 AS valid, CASE WHEN (120 * 256 + b) % 31 = 0 THEN b {idiv} 64 END AS flevel FROM bytes")
_MODE = lambda e: "CASE " + e + " " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(("clamp", "periodic", "black", "mirror"))) + " END"
add("sd13_wrap_modes", f"WITH w AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'clamp,mirror' WHEN 1 THEN 'periodic,black' WHEN 2 THEN 'clamp' WHEN 3 THEN 'mirror,other' ELSE 'black,clamp' END AS m FROM events), p AS (SELECT event_id, m, {_MODE('split_part(m, {comma}, 1)')} AS h, {_MODE('split_part(m, {comma}, 2)')} AS v FROM w) SELECT event_id, m, CASE WHEN v IS NOT NULL THEN h END AS h, CASE WHEN h IS NOT NULL THEN v END AS v FROM p".replace("{comma}", "','"))
add("sd14_attribute_text", "SELECT event_id, concat(key, ' (type string): \"', value, '\"') AS text FROM attributes")
add("flt16_manifest_presence", "SELECT event_id, name, name = 'idManifest' OR (name LIKE 'cryptomatte%' AND name LIKE '%manifest%') AS present FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'idManifest' WHEN 1 THEN concat('cryptomatte/', event_type, '/manifest') ELSE event_type END AS name FROM events) q")
_V = "regexp_extract(name, '[.]([^.]*)[.][^.]*$', 1)"
add("flt13_view_predicates", f"SELECT regexp_extract(name, '^([^.]*)', 1) AS layer, count(DISTINCT {_V}) > 1 AS multi_view, max(CASE WHEN {_V} = 'left' THEN 1 ELSE 0 END) + max(CASE WHEN {_V} = 'right' THEN 1 ELSE 0 END) = 2 AS stereo FROM channels GROUP BY regexp_extract(name, '^([^.]*)', 1)")
add("flt5_image_classes", "SELECT o_custkey, max(CASE WHEN c = 'Y' THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN c IN ('RY', 'BY') THEN 1 ELSE 0 END) = 1 AS yc, max(CASE WHEN c = 'Y' THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN c IN ('RY', 'BY') THEN 1 ELSE 0 END) = 0 AS luminance_only FROM (SELECT o_custkey, CASE o_orderkey % 5 WHEN 0 THEN 'RY' WHEN 1 THEN 'A' ELSE 'Y' END AS c FROM orders) q GROUP BY o_custkey")
add("flt9_aces_validity", f"SELECT name, kind, name IN ('NONE', 'PIZ', 'B44A') AND n IN (3, 4) AND kind IN ('RGB', 'YC') AS valid FROM {_NAMED} CROSS JOIN (VALUES ('RGB', 3), ('RGB', 5), ('YC', 4), ('Y', 1)) k(kind, n)")
scalar("src4_version_flags", "(SELECT o_orderkey, o_orderkey * 512 + 2 AS v FROM orders) q", "o_orderkey", version="v % 256", tiled=f"{bit('v', 9)} = 1", long_names=f"{bit('v', 10)} = 1", deep=f"{bit('v', 11)} = 1", multipart=f"{bit('v', 12)} = 1")
add("srt4_attribute_sort", "SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS place FROM nation")
scalar("srt6_line_order", "plane p CROSS JOIN (SELECT max(y) AS top FROM plane) m", "y, x", increasing="y", decreasing="top - y")
_H2 = lambda i: f"((cast(instr('0123456789ABCDEF', substr(hx, cast(2 * ({i}) + 1 as int), 1)) as bigint) - 1) * 16 + instr('0123456789ABCDEF', substr(hx, cast(2 * ({i}) + 2 as int), 1)) - 1)"
_MUL = lambda a, b: f"((({a}) % 65536) * {b} + (((({a}) {{idiv}} 65536) * {b}) % 65536) * 65536) % 4294967296"
_ROT = lambda a, n: f"((({a}) % {1 << (32 - n)}) * {1 << n} + ({a}) {{idiv}} {1 << (32 - n)})"


def hashed(source: str, dialect: str) -> str:
    """MurmurHash3 x86-32, seed 0, of the UTF-8 bytes of `name`: CTEs that end in m(name, h).

    Blocks of four bytes, the last filled up with zeros (which mix to nothing), are mixed as arrays, step by step, so
    that no step's text contains another's; the fold rotates after whole blocks alone.
    """
    each = (lambda a, e: f"transform({a}, k -> {e})") if dialect == "spark" else (lambda a, e: f"list_transform({a}, lambda k: {e})")
    places = "filter(sequence(cast(0 as bigint), n div 4), k -> k * 4 < n)" if dialect == "spark" else "range((n + 3) // 4)"
    block = " + ".join(f"{_H2(f'k * 4 + {j}')} * {256**j}" for j in range(4))
    pad = "concat(hex(encode(name, 'UTF-8')), '000000')" if dialect == "spark" else "concat(hex(encode(name)), '000000')"
    bytes_ = "cast(octet_length(name) as bigint)" if dialect == "spark" else "cast(octet_length(encode(name)) as bigint)"
    step = f"CASE WHEN k.full THEN ({_ROT(xor('h', 'k.b'), 13)} * 5 + 3864292196) % 4294967296 ELSE {xor('h', 'k.b')} END"
    pairs = "transform(c, (b, i) -> struct(cast(b as bigint) AS b, (i + 1) * 4 <= n AS full))" if dialect == "spark" else "list_transform(c, lambda b, i: {'b': b, 'full': i * 4 <= n})"
    fold = f"aggregate({pairs}, cast(0 as bigint), (h, k) -> cast({step} as bigint))"
    if dialect == "duck":
        fold = "list_reduce(list_prepend({'b': 0::BIGINT, 'full': true}, " + pairs + "), lambda a, k: {'b': (" + step.replace("'h'", "h").replace("(h)", "(a.b)") + ")::BIGINT, 'full': true}).b"
    mixed = lambda a, n: xor(a, f"{a} {{idiv}} {1 << n}")
    return (
        f"s AS (SELECT DISTINCT name, {bytes_} AS n, {pad} AS hx FROM {source}), b0 AS (SELECT name, n, {each(places, f'cast({block} as bigint)')} AS c FROM s), "
        f"b1 AS (SELECT name, n, {each('c', _MUL('k', 3432918353))} AS c FROM b0), b2 AS (SELECT name, n, {each('c', _ROT('k', 15))} AS c FROM b1), b3 AS (SELECT name, n, {each('c', _MUL('k', 461845907))} AS c FROM b2), "
        f"f0 AS (SELECT name, n, {fold} AS h FROM b3), f1 AS (SELECT name, {xor('h', 'n')} AS h FROM f0), f2 AS (SELECT name, {mixed('h', 16)} AS h FROM f1), f3 AS (SELECT name, {_MUL('h', 2246822507)} AS h FROM f2), "
        f"f4 AS (SELECT name, {mixed('h', 13)} AS h FROM f3), f5 AS (SELECT name, {_MUL('h', 3266489909)} AS h FROM f4), m AS (SELECT name, {mixed('h', 16)} AS h FROM f5)"
    )


_FIXED = f"CASE WHEN h {{idiv}} 8388608 % 256 IN (0, 255) THEN {xor('h', '8388608')} ELSE h END"
_FLOAT = "CASE WHEN i >= 2147483648 THEN -1 ELSE 1 END * (8388608 + i % 8388608) * pow(cast(2 as double), i {idiv} 8388608 % 256 - 150)"
for _name, _select in {
    "sd7_murmur3_32": "SELECT name, h FROM m",
    "sd9_name_id": f"SELECT name, i, {_FLOAT} AS id_float FROM (SELECT name, {_FIXED} AS i FROM m) q",
    "sd12_json_manifest": f"SELECT concat('{{\"', name, '\":\"', lpad(lower(hex(i)), 8, '0'), '\"}}') AS entry FROM (SELECT name, {_FIXED} AS i FROM m) q",
}.items():
    add(_name, f"WITH {hashed('names', 'spark')} {_select}", f"WITH {hashed('names', 'duck')} {_select}")
# --- metadata ---------------------------------------------------------------------------------------------------------
_KV = "(SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'owner' WHEN 1 THEN 'aperture' WHEN 2 THEN 'latitude' WHEN 3 THEN 'zipLevel' WHEN 4 THEN 'view' ELSE 'lineOrder' END AS k, value AS v, event_type AS t, user_id FROM events) q"


def accessor(name: str, **columns: str) -> None:
    add(name, f"SELECT user_id, {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {_KV} GROUP BY user_id")


def pick(k: str, v: str, default: str) -> str:
    return f"coalesce(max(CASE WHEN k = '{k}' THEN {v} END), {default})"


accessor("met2_required_attributes", line_order=pick("lineOrder", "cast(floor(v) as bigint)", "0"), aspect=fn.lit(1.0), screen_width=fn.lit(1.0))
accessor("met3_optional_attributes", zip_level=pick("zipLevel", "cast(floor(v) as bigint) % 10", "6"), dwa_level=fn.lit(45.0))
accessor("met4_production_metadata", owner=pick("owner", "t", "''"), n_owner="count(CASE WHEN k = 'owner' THEN 1 END)")
accessor("met5_camera_metadata", aperture=r6(pick("aperture", "v", "0")), present="max(CASE WHEN k = 'aperture' THEN 1 ELSE 0 END) = 1")
accessor("met6_geo_metadata", latitude=r6(pick("latitude", "v", "0")))
accessor("met8_views", view=pick("view", "t", "''"), views="count(DISTINCT CASE WHEN k = 'view' THEN t END)")
