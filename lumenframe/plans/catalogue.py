"""Every query of the engine and its SQL counterpart, by the operator's number in the survey.

Most are one declarative statement; {macros} cover the few words in which dialects differ. Spark reads the statement
over views of the parquet tables, so filters and columns reach the scans and Catalyst picks the physical plan.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenframe import functions as fn
from lumenframe.sources.fixtures import DUCK, SPARK, VIEWS

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")
FLAGSHIP = "agg1_deep_over"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _filled(sql: str, words: dict[str, str]) -> str:
    for k, v in words.items():
        sql = sql.replace("{" + k + "}", v)
    return sql


def _with(sql: str, words: dict[str, str]) -> str:
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not used:
        return _filled(sql, words)
    heads = ", ".join(f"{v} AS ({_filled(VIEWS[v][1], words)})" for v in used)
    body = _filled(sql, words)
    return f"WITH {heads}, {body[5:]}" if body.startswith("WITH ") else f"WITH {heads} {body}"


def add(name: str, sql: str, duck: str | None = None, spark: dict[str, str] | None = None, duckw: dict[str, str] | None = None) -> None:
    """Registers a statement for both engines; duck is another text where a dialect needs one."""

    def query(session: SparkSession, sf_dir: str) -> DataFrame:
        text = _with(sql, SPARK | (spark or {}))
        # tables are named by their files: no temporary views to clash in a shared session
        text = re.sub(rf"(?<=FROM )({'|'.join(TABLES)})\b|(?<=JOIN )({'|'.join(TABLES)})\b", lambda m: f"parquet.`{sf_dir}/{m[0]}.parquet` AS {m[0]}", text)
        return session.sql(text)

    QUERIES[name] = query
    ORACLES[name] = _with(duck or sql, DUCK | (duckw or {}))


def scalar(name: str, view: str, keys: str, /, **columns: str) -> None:
    """A projection: each column rounded so that the last bits of library functions don't matter."""
    add(name, f"SELECT {keys}, " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {view}")


def r6(e: str) -> str:
    return f"floor(({e}) * 1000000 + 0.5) / 1000000"


# --- deep samples -----------------------------------------------------------------------------------------------------
_ORDER_ALL = "z, zback, src, s, a, r, g, b"
_FOLD_SPARK = """
WITH f AS (SELECT y, x, {key} aggregate(array_sort(collect_list(struct(z, zback, src, s, a, r, g, b))), struct(cast(0 as double) AS r, cast(0 as double) AS g, cast(0 as double) AS b, cast(0 as double) AS a),
  (acc, e) -> if(acc.a >= 1, acc, struct(acc.r + (1 - acc.a) * e.r AS r, acc.g + (1 - acc.a) * e.g AS g, acc.b + (1 - acc.a) * e.b AS b, least(cast(1 as double), acc.a + (1 - acc.a) * e.a) AS a))) AS p FROM {from} GROUP BY y, x)
SELECT y, x, {keyout} floor(p.r * 1000000 + 0.5) / 1000000 AS r, floor(p.g * 1000000 + 0.5) / 1000000 AS g, floor(p.b * 1000000 + 0.5) / 1000000 AS b, floor(p.a * 1000000 + 0.5) / 1000000 AS a FROM f""".strip().replace("\n", " ")
_FOLD_DUCK = """
WITH f AS (SELECT y, x, {key} list_reduce(list_prepend({'r': 0.0::DOUBLE, 'g': 0.0::DOUBLE, 'b': 0.0::DOUBLE, 'a': 0.0::DOUBLE}, list({'r': r, 'g': g, 'b': b, 'a': a} ORDER BY z, zback, src, s, a, r, g, b)),
  lambda acc, e: CASE WHEN acc.a >= 1 THEN acc ELSE {'r': acc.r + (1 - acc.a) * e.r, 'g': acc.g + (1 - acc.a) * e.g, 'b': acc.b + (1 - acc.a) * e.b, 'a': least(1.0::DOUBLE, acc.a + (1 - acc.a) * e.a)} END) AS p FROM {from} GROUP BY y, x)
SELECT y, x, {keyout} floor(p.r * 1000000 + 0.5) / 1000000 AS r, floor(p.g * 1000000 + 0.5) / 1000000 AS g, floor(p.b * 1000000 + 0.5) / 1000000 AS b, floor(p.a * 1000000 + 0.5) / 1000000 AS a FROM f""".strip().replace("\n", " ")


def fold(name: str, source: str, key: str = "", keyout: str = "") -> None:
    words = lambda t: t.replace("{from}", source).replace("{key}", key).replace("{keyout}", keyout)
    add(name, words(_FOLD_SPARK), words(_FOLD_DUCK))


fold("agg1_deep_over", "deep")
fold("agg2_deep_over_extra", "deep", "round(sum(z), 4) AS zsum,", "zsum,")
fold("agg3_volumetric_over", "deep")
fold("agg4_deep_scanline_over", "(SELECT * FROM deep WHERE y BETWEEN 10 AND 40) v")
fold("agg5_deep_tile_over", "(SELECT * FROM deep WHERE x BETWEEN 16 AND 31 AND y BETWEEN 16 AND 47) v")
add("agg6_sample_counts", "WITH c AS (SELECT y, x, count(*) AS n FROM deep GROUP BY y, x) SELECT y, cast(sum(n) as bigint) AS total, max(n) AS most, count(*) AS pixels FROM c GROUP BY y")
add("jn2_multi_source_gather", f"SELECT y, x, src, row_number() OVER (PARTITION BY y, x ORDER BY src, {_ORDER_ALL}) AS place, z, a FROM deep")
add("srt1_depth_sort", "SELECT y, x, row_number() OVER (PARTITION BY y, x ORDER BY z, zback, src, s, a, r, g, b) AS place, z, zback, src, s FROM deep")
add("win3_cumulative_counts", "WITH c AS (SELECT y, x, count(*) AS n FROM deep GROUP BY y, x) SELECT y, x, n, cast(sum(n) OVER (PARTITION BY y ORDER BY x) as bigint) AS upto, cast(sum(n) OVER (PARTITION BY y ORDER BY x) as bigint) - n AS starts FROM c")
add("flt6_deep_predicates", "SELECT y, x, s, src, z, a, zback <> z AS volumetric, a >= 1 AS opaque FROM deep")
add("src13_deep_counts_scan", "SELECT y, x, count(*) AS n FROM deep WHERE y BETWEEN 5 AND 20 GROUP BY y, x")
add("src14_deep_sample_scan", "SELECT y, x, src, s, z, a, r FROM deep WHERE y BETWEEN 5 AND 20")
add("src15_deep_tile_scan", "SELECT y, x, src, s, z, a FROM deep WHERE x BETWEEN 32 AND 47 AND y BETWEEN 32 AND 63")
# --- planes and pyramids ----------------------------------------------------------------------------------------------
add("src9_row_range_scan", "SELECT y, x, v FROM plane WHERE y BETWEEN 10 AND 99")
add("src11_tile_scan", "SELECT y, x, v, y {idiv} 16 AS tile_y, x {idiv} 16 AS tile_x FROM plane WHERE y {idiv} 16 = 2 AND x {idiv} 16 BETWEEN 1 AND 2")
add("src12_tile_index", "SELECT y, x, (y {idiv} 16) * 4 + x {idiv} 16 AS chunk FROM plane")
add("srt7_tile_limit", "SELECT y {idiv} 16 AS ty, x {idiv} 16 AS tx, count(*) AS n, round(sum(v), 4) + 0 AS total FROM plane WHERE y < 128 GROUP BY y {idiv} 16, x {idiv} 16")
add("srt8_row_limit", "SELECT y, min(x) AS first, max(x) AS last, round(avg(v), 6) + 0 AS mean FROM plane WHERE y BETWEEN 3 AND 77 GROUP BY y")
add("agg7_box_downsample", "SELECT y {idiv} 2 AS y2, x {idiv} 2 AS x2, round(avg(v), 6) + 0 AS v FROM plane GROUP BY y {idiv} 2, x {idiv} 2")
# a row weighs on the target whose centre it is (odd) or on the two beside it (even); targets end with the last whole pair
add("agg8_triangle_downsample", """
WITH o AS (SELECT {unnest} AS d), m AS (SELECT max(y) AS top FROM plane),
k AS (SELECT y {idiv} 2 - p.d AS y2, x {idiv} 2 - q.d AS x2, v, (CASE WHEN y % 2 = 0 THEN 0.5 ELSE 1.0 END) * (CASE WHEN x % 2 = 0 THEN 0.5 ELSE 1.0 END) AS w FROM plane CROSS JOIN o p CROSS JOIN o q WHERE (p.d = 0 OR y % 2 = 0) AND (q.d = 0 OR x % 2 = 0))
SELECT y2, x2, round(sum(v * w) / sum(w), 5) + 0 AS v FROM k CROSS JOIN m WHERE y2 >= 0 AND x2 >= 0 AND y2 < (top + 1) {idiv} 2 AND x2 < 32 GROUP BY y2, x2""".strip().replace("\n", " "), spark={"unnest": "explode(array(0, 1))"}, duckw={"unnest": "unnest([0, 1])"})
add("agg10_axis_downsample", "SELECT y, x {idiv} 2 AS x2, round(avg(v), 6) + 0 AS v FROM plane GROUP BY y, x {idiv} 2")
_MOST_LEVELS = 20


def cascade(levels: int, along: str = "yx") -> str:
    """Levels 0 to levels - 1, each a 2 x 2 mean of the one before; sizes are halved and rounded down to 1 at least, and end with 1 x 1."""
    size = lambda n, k: f"greatest(1, cast(floor({n} / {float(1 << k)}) as bigint))"
    heads = ["m AS (SELECT max(y) + 1 AS h, 64 AS w FROM plane)", "l0 AS (SELECT y, x, v FROM plane)"]
    for k in range(1, levels):
        heads.append(f"l{k} AS (SELECT y {{idiv}} 2 AS y, x {{idiv}} 2 AS x, avg(v) AS v FROM l{k - 1} CROSS JOIN m WHERE greatest(h, w) >= {1 << k} AND y {{idiv}} 2 < {size('h', k)} AND x {{idiv}} 2 < {size('w', k)} GROUP BY y {{idiv}} 2, x {{idiv}} 2)")
    return f"WITH {', '.join(heads)} " + " UNION ALL ".join(f"SELECT {k} AS l, y AS yl, x AS xl, round(v, 5) + 0 AS v FROM l{k}" for k in range(levels))


def mipmap(session: SparkSession, sf_dir: str) -> DataFrame:
    """As many levels as the image has; its height is asked for first. A level's exchange serves both the level and the next one."""
    height = session.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("max(vec_id) + 1 AS h").first()["h"] or 1
    add("_mipmap", cascade(max(height, 64).bit_length()))
    ORACLES.pop("_mipmap")
    return QUERIES.pop("_mipmap")(session, sf_dir)


QUERIES["agg11_mipmap_pyramid"] = mipmap
ORACLES["agg11_mipmap_pyramid"] = _with(cascade(_MOST_LEVELS), DUCK)
add("agg12_ripmap_pyramid", "WITH l AS (SELECT {levels} AS l) SELECT i.l AS ly, j.l AS lx, y {idiv} cast(pow(2, i.l) as bigint) AS yl, x {idiv} cast(pow(2, j.l) as bigint) AS xl, round(avg(v), 5) + 0 AS v FROM plane CROSS JOIN l i CROSS JOIN l j GROUP BY 1, 2, 3, 4", spark={"levels": "explode(sequence(0, 3))"}, duckw={"levels": "unnest(range(4))"})
add("agg14_chroma_average", f"SELECT y {{idiv}} 2 AS y2, x {{idiv}} 2 AS x2, round(avg(r - {fn.luma('r', 'g', 'b')}), 6) + 0 AS ry, round(avg(b - {fn.luma('r', 'g', 'b')}), 6) + 0 AS by_ FROM rgb GROUP BY y {{idiv}} 2, x {{idiv}} 2")
add("agg20_bounding_union", "SELECT min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy, count(*) AS n FROM windows")
add("agg22_level_counts", "SELECT o_custkey, cast(floor(log2(greatest(maxx - minx + 1, maxy - miny + 1))) as int) + 1 AS levels, cast(ceil((maxx - minx + 1) / 16.0) as bigint) * cast(ceil((maxy - miny + 1) / 16.0) as bigint) AS tiles FROM windows")
add("agg24_histogram", "SELECT b, count(*) AS n FROM bytes GROUP BY b")
_RUNS = "WITH m AS (SELECT doc_id, pos, b, CASE WHEN lag(b) OVER (PARTITION BY doc_id ORDER BY pos) = b THEN 0 ELSE 1 END AS new FROM bytes), g AS (SELECT doc_id, b, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM m) SELECT doc_id, cast(run as bigint) AS run, min(pos) AS start, max(b) AS b, count(*) AS n FROM g GROUP BY doc_id, run"
add("agg23_byte_runs", _RUNS)


def byte_runs(session: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a text are told within its row, so no character is shuffled or sorted. Rows that repeat a doc_id share its partition and take the statement's windows; ids are asked for that first. An empty text has no bytes."""
    table = f"parquet.`{sf_dir}/documents.parquet`"
    repeated = f"(SELECT doc_id FROM {table} GROUP BY doc_id HAVING count(*) > 1)"
    some = not session.sql(f"SELECT 1 FROM {repeated}").isEmpty()
    bytes_ = _filled("transform(split(text, ''), c -> {code} & 255)", SPARK)
    # outer, since the optimizer would else build the arrays again for a filter on their size
    own = session.sql(f"""
WITH d AS (SELECT doc_id, {bytes_} AS bs FROM {table} t {f"LEFT ANTI JOIN {repeated} r ON t.doc_id <=> r.doc_id" if some else ""} WHERE text <> ''),
f AS (SELECT doc_id, bs, filter(sequence(0, size(bs) - 1), p -> NOT get(bs, p) <=> get(bs, p - 1)) AS firsts FROM d),
e AS (SELECT doc_id, bs, firsts, posexplode_outer(firsts) AS (k, start) FROM f)
SELECT doc_id, cast(k + 1 as bigint) AS run, start, bs[start] AS b, cast(coalesce(get(firsts, k + 1), size(bs)) - start as bigint) AS n FROM e WHERE start IS NOT NULL""")
    if not some:
        return own
    shared = f"FROM (SELECT t.* FROM {table} t LEFT SEMI JOIN {repeated} r ON t.doc_id <=> r.doc_id WHERE text <> '') AS documents "
    return own.unionByName(session.sql(_BYTE_RUNS.replace("FROM documents ", shared)))


_BYTE_RUNS = _with(_RUNS, SPARK)
QUERIES["agg23_byte_runs"] = byte_runs
add("win1_delta_encode", "SELECT doc_id, pos, ((b - coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY pos), 0)) % 256 + 256) % 256 AS d FROM bytes")
add("win2_delta_decode", "WITH e AS (SELECT doc_id, pos, ((b - coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY pos), 0)) % 256 + 256) % 256 AS d FROM bytes) SELECT doc_id, pos, cast(sum(d) OVER (PARTITION BY doc_id ORDER BY pos) % 256 as int) AS b FROM e")
add("win4_run_segments", "WITH m AS (SELECT doc_id, pos, b, CASE WHEN lag(b) OVER (PARTITION BY doc_id ORDER BY pos) = b THEN 0 ELSE 1 END AS new FROM bytes), g AS (SELECT doc_id, b, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM m), c AS (SELECT doc_id, run, count(*) AS n FROM g GROUP BY doc_id, run) SELECT doc_id, count(*) AS runs, cast(sum(CASE WHEN n >= 3 THEN 1 ELSE 0 END) as bigint) AS long_runs FROM c GROUP BY doc_id")
add("win5_haar", "WITH p AS (SELECT y, x {idiv} 2 AS k, max(CASE WHEN x % 2 = 0 THEN cast(floor(v * 4096) as bigint) END) AS a, max(CASE WHEN x % 2 = 1 THEN cast(floor(v * 4096) as bigint) END) AS b FROM plane GROUP BY y, x {idiv} 2) SELECT y, k, cast(floor((a + b) / 2.0) as bigint) AS average, a - b AS difference FROM p")
add("win6_deinterleave", "SELECT doc_id, pos, b, CASE WHEN pos % 2 = 0 THEN pos {idiv} 2 ELSE pos {idiv} 2 + (max(pos) OVER (PARTITION BY doc_id) + 2) {idiv} 2 END AS place FROM bytes")
# the first five of each source by place, and a line that counts the rest; numbers come from counts a line of pixels, so no task sorts a source
add("win8_error_cap", """
WITH e AS (SELECT src, y, x, s, z, row_number() OVER (PARTITION BY src, y ORDER BY x, s, z, zback, a, r, g, b) AS k FROM deep WHERE a > 0.95), c AS (SELECT src, y, max(k) AS n FROM e GROUP BY src, y),
f AS (SELECT src, y, n, sum(n) OVER (PARTITION BY src ORDER BY y) - n AS before_ FROM c)
SELECT e.src AS src, e.y AS y, e.x AS x, e.s AS s, e.z AS z, cast(e.k + f.before_ as bigint) AS k, cast(NULL as bigint) AS more FROM e JOIN f ON f.src = e.src AND f.y = e.y WHERE e.k <= 5 AND e.k + f.before_ <= 5
UNION ALL SELECT src, NULL, NULL, NULL, NULL, NULL, cast(sum(n) - 5 as bigint) FROM c GROUP BY src HAVING sum(n) > 5""".strip().replace("\n", " "))
# --- joins, sets and comparison ---------------------------------------------------------------------------------------
add("jn1_image_compare", "WITH a AS (SELECT y, x, v FROM plane), b AS (SELECT y, x, v + CASE WHEN x % 7 = 0 THEN 0.01 ELSE 0 END AS v FROM plane) SELECT a.x, count(*) AS n, cast(sum(CASE WHEN abs(a.v - b.v) > 0.001 THEN 1 ELSE 0 END) as bigint) AS differ, round(max(abs(a.v - b.v)), 6) + 0 AS most FROM a JOIN b ON a.y = b.y AND a.x = b.x GROUP BY a.x")
# weights of a half or of nothing beyond the sample at hand, the last sample standing for those past the edge
add("jn5_chroma_upsample", """
WITH c AS (SELECT y {idiv} 2 AS y2, x {idiv} 2 AS x2, avg(v) AS v FROM plane GROUP BY y {idiv} 2, x {idiv} 2), m AS (SELECT max(y2) AS bottom, max(x2) AS last FROM c),
n AS (SELECT y, x, least(bottom, y {idiv} 2 + j) AS cy, least(last, x {idiv} 2 + i) AS cx, (CASE WHEN i = 0 THEN 1 - (x % 2) * cast(0.5 as double) ELSE cast(0.5 as double) END) * (CASE WHEN j = 0 THEN 1 - (y % 2) * cast(0.5 as double) ELSE cast(0.5 as double) END) AS w FROM plane CROSS JOIN m CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j) WHERE (i = 0 OR x % 2 = 1) AND (j = 0 OR y % 2 = 1))
SELECT n.y AS y, n.x AS x, round(sum(w * c.v), 6) + 0 AS v FROM n JOIN c ON c.y2 = n.cy AND c.x2 = n.cx GROUP BY n.y, n.x""".strip().replace("\n", " "))
add("jn3_union_window", "WITH u AS (SELECT min(minx) AS ox, min(miny) AS oy FROM windows) SELECT o_custkey, minx - ox AS dx, miny - oy AS dy, maxx - minx + 1 AS width, maxy - miny + 1 AS height FROM windows CROSS JOIN u")
add("jn7_id_lookup", "SELECT l_orderkey, l_linenumber, l_partkey, v1, v2, l_quantity, l_extendedprice FROM lineitem LEFT JOIN manifest ON id = l_partkey")
add("jn6_hemisphere_blur", "WITH s AS (SELECT vec_id, dx, dy, dz, sqrt(dx * dx + dy * dy + dz * dz) AS n FROM dirs), q AS (SELECT a.vec_id, (a.dx * b.dx + a.dy * b.dy + a.dz * b.dz) / (a.n * b.n) AS c, b.n AS v FROM s a JOIN s b ON a.dx * b.dx + a.dy * b.dy + a.dz * b.dz > 0) SELECT vec_id, count(*) AS n, round(sum(c * v) / sum(c), 6) + 0 AS v FROM q GROUP BY vec_id")
add("set1_combine_parts", "WITH p AS (SELECT o_orderstatus AS name, o_orderkey AS k FROM orders), n AS (SELECT name, k, row_number() OVER (PARTITION BY name ORDER BY k) - 1 AS d FROM p) SELECT k, CASE WHEN d = 0 THEN name ELSE concat(name, '_', cast(d as {str})) END AS name FROM n", spark={"str": "string"}, duckw={"str": "varchar"})
add("set2_separate_parts", "SELECT src AS part, count(*) AS n, min(y) AS miny, max(y) AS maxy FROM deep GROUP BY src")
add("set3_convert_layout", "SELECT y {idiv} 16 AS tile_y, x {idiv} 16 AS tile_x, y % 16 AS ry, x % 16 AS rx, v FROM plane")
add("set4_channel_difference", "WITH a AS (SELECT name FROM channels WHERE name LIKE '%left%' OR name LIKE '%.R'), b AS (SELECT name FROM channels WHERE name LIKE '%.R' OR name LIKE '%right%') SELECT 'a' AS only_in, name FROM (SELECT name FROM a EXCEPT SELECT name FROM b) p UNION ALL SELECT 'b' AS only_in, name FROM (SELECT name FROM b EXCEPT SELECT name FROM a) q")
# --- names, filters and metadata --------------------------------------------------------------------------------------
_PARTS = {"layer": "regexp_extract(name, '^(.*)[.][^.]*$', 1)", "base": "regexp_extract(name, '([^.]*)$', 1)", "view": "regexp_extract(name, '[.]([^.]*)[.][^.]*$', 1)"}
scalar("prj6_layer_split", "channels", "name", layer=_PARTS["layer"], base=_PARTS["base"])
#: Names of three components, of their last two and of their last one alone; the views of such a file are left and right, left by default.
_NAMES = "(SELECT name FROM channels UNION SELECT regexp_extract(name, '([^.]*[.][^.]*)$', 1) AS name FROM channels UNION SELECT regexp_extract(name, '([^.]*)$', 1) AS name FROM channels) q"
_LEAD = "regexp_extract(name, '^(.*)[.][^.]*$', 1)"
_IS_VIEW = f"regexp_extract({_LEAD}, '([^.]*)$', 1) IN ('left', 'right')"
_VIEW = f"CASE WHEN {_IS_VIEW} THEN regexp_extract({_LEAD}, '([^.]*)$', 1) ELSE '' END"
_LAYER = f"CASE WHEN {_IS_VIEW} THEN regexp_extract({_LEAD}, '^(.*)[.][^.]*$', 1) ELSE {_LEAD} END"
scalar("prj7_view_parse", _NAMES, "name", layer=_LAYER, view=_VIEW, channel=_PARTS["base"])
scalar("prj8_view_build", f"(SELECT name, {_LAYER} AS layer, {_VIEW} AS eye, {_PARTS['base']} AS channel FROM {_NAMES}) p", "name", built="concat_ws('.', nullif(layer, ''), nullif(eye, ''), channel)", layered="concat_ws('.', nullif(layer, ''), channel)")
scalar("prj9_view_insert", _NAMES, "name", left_="CASE WHEN name LIKE '%.%' THEN concat(regexp_extract(name, '^(.*)[.][^.]*$', 1), '.left.', regexp_extract(name, '([^.]*)$', 1)) ELSE name END", right_="CASE WHEN name LIKE '%.%' THEN concat(regexp_extract(name, '^(.*)[.][^.]*$', 1), '.right.', regexp_extract(name, '([^.]*)$', 1)) ELSE concat('right.', name) END")
#: File names with a frame number and an extension; both go, then nine characters that file names may not hold.
_FILE = "regexp_replace(regexp_replace(regexp_replace(path, '^.*/', ''), '[.][^.]*$', ''), '[.][0-9]+$', '')"
add("prj13_part_name", f"SELECT path, {_FILE} AS derived, translate(name, '/:*?<>|{chr(92) * 2}\"', '_________') AS safe FROM (SELECT name, concat('shots/', name, CASE WHEN length(name) % 2 = 0 THEN '.0042.exr' ELSE '.beauty.exr' END) AS path FROM names) q", f"SELECT path, {_FILE} AS derived, translate(name, '/:*?<>|{chr(92)}\"', '_________') AS safe FROM (SELECT name, concat('shots/', name, CASE WHEN length(name) % 2 = 0 THEN '.0042.exr' ELSE '.beauty.exr' END) AS path FROM names) q")
add("prj11_channel_sizes", f"SELECT {_PARTS['layer']} AS layer, count(*) AS n, cast(sum(CASE WHEN name LIKE '%.A' THEN 4 ELSE 2 END) as bigint) AS bytes FROM channels GROUP BY {_PARTS['layer']}")
add("prj12_code_names", "SELECT c AS code, n AS name, l AS lines FROM (VALUES " + ", ".join(f"({i}, '{n}', {k})" for i, (n, k) in enumerate(zip(fn.CODECS, fn.LINES_PER_CHUNK, strict=True))) + ") t(c, n, l)")
add("flt1_box_contains", "SELECT o_custkey, 320 BETWEEN minx AND maxx AND 12 BETWEEN miny AND maxy AS inside, minx > maxx OR miny > maxy AS empty, greatest(0, maxx - minx + 1) * greatest(0, maxy - miny + 1) AS area FROM windows")
add("flt2_channel_presence", f"SELECT {_PARTS['layer']} AS layer, max(CASE WHEN name LIKE '%.R' THEN 1 ELSE 0 END) + max(CASE WHEN name LIKE '%.G' THEN 1 ELSE 0 END) + max(CASE WHEN name LIKE '%.B' THEN 1 ELSE 0 END) = 3 AS has_rgb, max(CASE WHEN name LIKE '%.A' THEN 1 ELSE 0 END) = 1 AS has_alpha FROM channels GROUP BY {_PARTS['layer']}")
add("flt3_channels_in_layer", f"SELECT name FROM channels WHERE {_PARTS['layer']} = 'urgent.left'")
add("flt4_channels_for_view", f"SELECT wanted, name, {_PARTS['base']} AS base FROM (SELECT name, {_VIEW} AS eye FROM {_NAMES}) p CROSS JOIN (VALUES ('left'), ('right')) w(wanted) WHERE eye = wanted OR (eye = '' AND wanted = 'left')")
add("flt7_codec_predicates", "SELECT c AS code, n AS name, n IN ('" + "', '".join(fn.LOSSY_CODECS) + "') AS lossy, n IN ('" + "', '".join(fn.DEEP_CODECS) + "') AS deep_ok FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(fn.CODECS)) + ") t(c, n)")
add("flt17_drop_frame", "SELECT event_id, (event_id % 4) * 6000 + 18000 AS num, event_id % 2 + 1000 AS den, event_id % 2 + 1000 = 1001 AND (event_id % 4) * 6000 + 18000 IN (24000, 30000, 60000) AS drop_frame FROM events")
add("agg18_layer_grouping", f"SELECT {_PARTS['layer']} AS layer, count(*) AS n, min(name) AS first, max(name) AS last FROM channels GROUP BY {_PARTS['layer']}")
add("agg19_view_set", f"SELECT DISTINCT {_PARTS['view']} AS view FROM channels WHERE {_PARTS['view']} <> ''")
add("agg21_median", "SELECT event_type, round(median(value), 6) + 0 AS median, count(*) AS n FROM events GROUP BY event_type")
add("srt2_channel_sort", "SELECT name, row_number() OVER (ORDER BY name) AS place FROM channels")
add("srt3_channel_sort_compression", f"SELECT name, row_number() OVER (ORDER BY CASE WHEN name LIKE '%.A' THEN 2 ELSE 1 END, name) AS place FROM channels")
add("srt5_manifest_sort", "SELECT id, row_number() OVER (ORDER BY id) AS place, v1 FROM manifest")
add("met1_attribute_get", "SELECT event_id, max(CASE WHEN key = 'k' THEN value END) AS k, count(value) AS present FROM attributes GROUP BY event_id")
add("met7_absent_value", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN value END, '') AS text, coalesce(CASE WHEN event_id % 3 = 0 THEN cast(value as double) END, cast(0 as double)) AS number FROM attributes")
add("sd10_manifest_build", "SELECT id, concat(v1, chr(0), v2) AS joined, length(concat(v1, chr(0), v2)) AS n FROM manifest")
# --- scalar functions -------------------------------------------------------------------------------------------------
scalar("sc1_float_to_half", "plane", "y, x", h=fn.half("v"))
scalar("sc5_half_arithmetic", "plane", "y, x", scaled=fn.half(f"({fn.half('v')} * 3)"), mixed=fn.half(f"({fn.half('v')} * 0.75 + 0.25)"))
scalar("sc6_rgb_to_yc", "rgb", "y, x", luma=r6(fn.luma("r", "g", "b")), ry=r6(f"r - {fn.luma('r', 'g', 'b')}"), by_=r6(f"b - {fn.luma('r', 'g', 'b')}"))
scalar("sc8_tone_map", "rgb", "y, x", r=r6(fn.tone("r")), g=r6(fn.tone("g")), b=r6(fn.tone("b")))
scalar("sc9_srgb", "rgb", "y, x", r=r6(fn.to_srgb("r")), back=r6(fn.from_srgb(f"({fn.to_srgb('g')})")))
scalar("sc10_to_byte", "rgb", "y, x", r=fn.to_byte("r"), g=fn.to_byte("g"), b=fn.to_byte("b"))
scalar("sc15_rgba_ops", "rgb", "y, x", plus=r6("r + g"), scaled=r6("r * 0.5"))
scalar("sc18_dct_dc", "plane p", "y, x", dc=r6("avg(v) OVER (PARTITION BY y, x {idiv} 8) * 8"))
scalar("sg1_direction_to_latlong", "dirs", "vec_id", lat=r6(fn.latitude("dx", "dy", "dz")), lon=r6(fn.longitude("dx", "dy", "dz")))
scalar("sg2_latlong_to_direction", "dirs", "vec_id", x=r6("sin(dx) * cos(dy)"), y=r6("sin(dy)"), z=r6("cos(dx) * cos(dy)"))
scalar("sg4_cube_face_size", "windows", "o_custkey", size="least(maxx - minx + 1, (maxy - miny + 1) {idiv} 6)")
scalar("sg5_cube_face", "dirs", "vec_id", face=fn.cube_face("dx", "dy", "dz"))
scalar("sg7_environment_type", "windows", "o_custkey", kind="CASE WHEN maxy - miny + 1 = 6 * (maxx - minx + 1) THEN 'cube' WHEN maxx - minx + 1 = 2 * (maxy - miny + 1) THEN 'latlong' ELSE 'unknown' END")
scalar("sg9_power_of_two", "orders", "o_orderkey", pow2="o_orderkey > 0 AND (o_orderkey & (o_orderkey - 1)) = 0")
scalar("sd1_timecode_pack", "timecode", "event_id", packed=f"cast({fn.bcd('hh')} * 16777216 + {fn.bcd('mm')} * 65536 + {fn.bcd('ss')} * 256 + {fn.bcd('ff')} as bigint)")
scalar("sd2_timecode_fields", "timecode", "event_id, hh, mm, ss, ff", total="((hh * 60 + mm) * 60 + ss) * 30 + ff")
scalar("cod10_lines_per_chunk", "windows", "o_custkey", zip="cast(ceil((maxy - miny + 1) / 16.0) as bigint)", dwab="cast(ceil((maxy - miny + 1) / 256.0) as bigint)")
