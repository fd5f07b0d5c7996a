"""Queries through pixel files: each packs a view into whole files, parses them back and returns what they hold.

The SQL counterpart states what a round trip must give, so codecs, containers and scans are checked in every value.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators import codecs, manifests, piz
from lumenframe.plans import catalogue
from lumenframe.sources import pixfile, pixsink
from lumenframe.sources.fixtures import DUCK, SPARK
from lumenframe.sources.shipping import ship

#: Images are 64 lines of the plane, deep ones 64 lines of a source.
_PLANE = "SELECT concat('im', cast(y {idiv} 64 as string)) AS image, 0 AS part, y, x, v FROM plane"
_DEEP = "SELECT concat('deep', cast(src as string), '-', cast(y {idiv} 64 as string)) AS image, 0 AS part, y, x, z, zback, src, s, a, r, g, b FROM deep"


def _view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    text = catalogue._with(sql, SPARK)
    for table in catalogue.TABLES:
        text = text.replace(f"FROM {table} ", f"FROM parquet.`{sf_dir}/{table}.parquet` ").replace(f"FROM {table})", f"FROM parquet.`{sf_dir}/{table}.parquet`)")
    return spark.sql(text)


def plane_files(spark: SparkSession, sf_dir: str, form: pixsink.Layout, names: list[str] | None = None) -> DataFrame:
    """(path, content) of the plane's images; with names, each also as further parts."""
    ship(spark)
    rows = _view(spark, sf_dir, _PLANE)
    if names:
        rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1)))).withColumn("v", F.col("v") * (F.col("part") + 1))
    return pixsink.assemble(pixsink.pack_pixels(rows, form), form, names=names).withColumnRenamed("image", "path")


def deep_files(spark: SparkSession, sf_dir: str, form: pixsink.Layout) -> DataFrame:
    ship(spark)
    return pixsink.assemble(pixsink.pack_samples(_view(spark, sf_dir, _DEEP), form, ["z", "zback", "src", "s", "a", "r", "g", "b"]), form, deep=True).withColumnRenamed("image", "path")


def _add(name: str, query, oracle: str) -> None:
    catalogue.QUERIES[name] = query
    catalogue.ORACLES[name] = catalogue._with(oracle, DUCK | {"str": "varchar"})


_IMAGE = "concat('im', cast(y {idiv} 64 as varchar))"
_SAME = f"SELECT {_IMAGE} AS image, y, x, v FROM plane"
_E = "CASE WHEN pow(2.0::double, floor(log2(abs(v)))) > abs(v) THEN floor(log2(abs(v))) - 1 WHEN pow(2.0::double, floor(log2(abs(v))) + 1) <= abs(v) THEN floor(log2(abs(v))) + 1 ELSE floor(log2(abs(v))) END"
_SHORT = f"WITH e AS (SELECT y, x, v, {_E} AS e FROM plane WHERE v <> 0), q AS (SELECT y, x, floor(abs(v) * pow(2.0::double, 15 - e) + 0.5) * pow(2.0::double, e - 15) * sign(v) AS v FROM e UNION ALL SELECT y, x, v FROM plane WHERE v = 0) SELECT {_IMAGE} AS image, y, x, v FROM q"


def _round_trip(codec: int, tile: tuple[int, int] | None = None, layout: str = "native", **scan):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        form = pixsink.Layout({"v": codecs.FLOAT}, codec, tile, layout)
        return pixfile.pixels(plane_files(spark, sf_dir, form), ["v"], **scan).select(F.col("path").alias("image"), "y", "x", "v")

    return query


for _name, _codec in {"cod1_none_file": codecs.NONE, "cod2_rle_file": codecs.RLE, "cod3_zips_file": codecs.ZIPS, "snk4_scanline_file": codecs.ZIP}.items():
    _add(_name, _round_trip(_codec), _SAME)
_add("cod4_piz_file", _round_trip(codecs.PIZ), _SAME)
_add("cod6_pxr24_file", _round_trip(codecs.PXR24), _SHORT)
_add("cod3_zip_interchange_file", _round_trip(codecs.ZIP, layout="interchange"), _SAME)
_add("snk5_tile_file", _round_trip(codecs.ZIP, (16, 16)), _SAME)
_add("src1_file_row_range", _round_trip(codecs.ZIP, rows=(100, 170)), _SAME + " WHERE y BETWEEN 100 AND 170")


def _half_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = pixsink.Layout({"v": codecs.HALF}, codecs.ZIP)
    return pixfile.pixels(plane_files(spark, sf_dir, form), ["v"]).select(F.col("path").alias("image"), "y", "x", "v")


def _half_oracle() -> str:
    from lumenframe.functions import half

    return f"SELECT {_IMAGE} AS image, y, x, {half('v')} AS v FROM plane"


_add("src23_half_channel", _half_channel, _half_oracle())


#: Planes whose blocks of 4 x 4 hold one value each: those the block codecs keep exactly.
_FLAT = "SELECT concat('im', cast(y {idiv} 64 as string)) AS image, 0 AS part, y, x, first_value(v) OVER (PARTITION BY y {idiv} 4, x {idiv} 4 ORDER BY y, x) AS v FROM plane"


def _blocks(codec: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        form = pixsink.Layout({"v": codecs.HALF}, codec)
        made = pixsink.assemble(pixsink.pack_pixels(_view(spark, sf_dir, _FLAT), form), form).withColumnRenamed("image", "path")
        return pixfile.pixels(made, ["v"]).select(F.col("path").alias("image"), "y", "x", "v")

    return query


def _flat_oracle() -> str:
    from lumenframe.functions import half

    return f"WITH f AS (SELECT {_IMAGE} AS image, y, x, first_value(v) OVER (PARTITION BY y {{idiv}} 4, x {{idiv}} 4 ORDER BY y, x) AS v FROM plane) SELECT image, y, x, {half('v')} AS v FROM f"


_add("cod7_b44_file", _blocks(codecs.B44), _flat_oracle())
_add("cod7_b44a_file", _blocks(codecs.B44A), _flat_oracle())
_add("cod8_dwaa_file", _round_trip(codecs.DWAA), _SAME)
_add("cod8_dwab_file", _round_trip(codecs.DWAB), _SAME)
_CODED = "SELECT cast(y {idiv} 64 as bigint) AS image, y, x, cast(((floor(v * 4096) % 65536) + 65536) % 65536 as int) AS s FROM plane"


def _huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each image through the Huffman coder and back."""
    ship(spark)

    def both(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["y", "x"])
        symbols = rows["s"].to_numpy()
        return rows.assign(s=piz.huffman_decode(piz.huffman_encode(symbols), len(symbols)).astype("int32"))

    return _view(spark, sf_dir, _CODED).groupBy("image").applyInPandas(both, "image bigint, y bigint, x bigint, s int")


_add("cod5_huffman", _huffman, _CODED)


def _wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image's 14- and 16-bit words through the 2-D wavelet and back, with the mean that the coarsest level leaves at the origin."""
    ship(spark)

    def both(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["y", "x"])
        plane = rows["s"].to_numpy().reshape(rows["y"].nunique(), -1)
        wide = piz.wavelet_decode(piz.wavelet_encode(plane, 65535), 65535)
        small = piz.wavelet_decode(piz.wavelet_encode(plane & 0x3FFF, 0x3FFF), 0x3FFF)
        return rows.assign(s=wide.ravel().astype("int32"), small=small.ravel().astype("int32"))

    return _view(spark, sf_dir, _CODED).groupBy("image").applyInPandas(both, "image bigint, y bigint, x bigint, s int, small int")


_add("win5_wavelet_2d", _wavelet, f"SELECT image, y, x, s, s % 16384 AS small FROM ({_CODED}) q")
_RGB = "SELECT concat('im', cast(y {idiv} 64 as string)) AS image, 0 AS part, y, x, r AS red, g, b AS B, (x % 5) / cast(4 as double) AS Alpha FROM rgb"


def _rgba(alpha: bool):
    """Written under other names than R, G, B and A, with and without an alpha; read by any name."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        form = pixsink.Layout({"red": codecs.HALF, "g": codecs.HALF, "B": codecs.HALF} | ({"Alpha": codecs.HALF} if alpha else {}), codecs.ZIP)
        made = pixsink.assemble(pixsink.pack_pixels(_view(spark, sf_dir, _RGB), form), form).withColumnRenamed("image", "path")
        return pixfile.rgba(made).select(F.col("path").alias("image"), "y", "x", "r", "g", "b", "a")

    return query


def _rgba_oracle(alpha: str) -> str:
    from lumenframe.functions import half

    return f"SELECT {_IMAGE} AS image, y, x, {half('r')} AS r, {half('g')} AS g, {half('b')} AS b, {alpha} AS a FROM rgb"


_add("src16_rgba_scan", _rgba(False), _rgba_oracle("1.0::double"))
_add("snk9_rgba_file", _rgba(True), _rgba_oracle("(x % 5) / 4.0::double"))
#: The left view holds r, g and b, the right one their halves and an alpha.
_EYES = "SELECT concat('im', cast(y {idiv} 64 as string)) AS image, y, x, r, g, b, r / 2 AS r2, g / 2 AS g2, b / 2 AS b2, (x % 5) / cast(4 as double) AS a2 FROM rgb"


def _stereo_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two parts, each with its view; the left one's alpha is written as 1."""
    ship(spark)
    rows = _view(spark, sf_dir, _EYES)
    left = rows.select("image", F.lit(0).alias("part"), "y", "x", F.col("r").alias("R"), F.col("g").alias("G"), F.col("b").alias("B"), F.lit(1.0).alias("A"))
    right = rows.select("image", F.lit(1).alias("part"), "y", "x", F.col("r2").alias("R"), F.col("g2").alias("G"), F.col("b2").alias("B"), F.col("a2").alias("A"))
    form = pixsink.Layout({c: codecs.HALF for c in "RGBA"}, codecs.ZIP)
    made = pixsink.assemble(pixsink.pack_pixels(left.unionByName(right), form), form, names=["left", "right"], views=["left", "right"])
    return pixfile.stereo(made.withColumnRenamed("image", "path")).withColumnRenamed("path", "image")


def _stereo_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One part: the left view's channels name none, the right view's do."""
    ship(spark)
    names = {"r": "R", "g": "G", "b": "B", "r2": "right.R", "g2": "right.G", "b2": "right.B", "a2": "right.A"}
    rows = _view(spark, sf_dir, _EYES).withColumnsRenamed(names).withColumn("part", F.lit(0))
    listed = b"".join(struct.pack("<i", len(v)) + v for v in (b"left", b"right"))
    form = pixsink.Layout({c: codecs.HALF for c in names.values()}, codecs.ZIP, attributes={"multiView": ("stringvector", listed)})
    made = pixsink.assemble(pixsink.pack_pixels(rows.select("image", "part", "y", "x", *[f"`{c}`" for c in names.values()]), form), form)
    return pixfile.stereo(made.withColumnRenamed("image", "path")).withColumnRenamed("path", "image")


def _stereo_oracle() -> str:
    from lumenframe.functions import half

    halves = ", ".join(f"{half(f'({c} / 2)')} AS {c}" for c in "rgb")
    return f"SELECT {_IMAGE} AS image, 'left' AS \"view\", y, x, {half('r')} AS r, {half('g')} AS g, {half('b')} AS b, 1.0::double AS a FROM rgb UNION ALL SELECT {_IMAGE} AS image, 'right' AS \"view\", y, x, {halves}, (x % 5) / 4.0::double AS a FROM rgb"


_add("snk12_stereo_parts", _stereo_parts, _stereo_oracle())
_add("src21_stereo_channels", _stereo_channels, _stereo_oracle())
_PREVIEW = struct.pack("<2I", 4, 3) + bytes(i * 7 % 256 for i in range(48))


def _previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = pixsink.Layout({"v": codecs.FLOAT}, codecs.ZIP, attributes={"preview": ("preview", _PREVIEW)})
    return pixfile.previews(plane_files(spark, sf_dir, form)).withColumnRenamed("path", "image")


_add("src22_preview", _previews, f"SELECT image, 4 AS width, 3 AS height, k {{idiv}} 4 AS y, k % 4 AS x, (k * 28) % 256 AS r, (k * 28 + 7) % 256 AS g, (k * 28 + 14) % 256 AS b, (k * 28 + 21) % 256 AS a FROM (SELECT DISTINCT {_IMAGE} AS image FROM plane) i CROSS JOIN (SELECT unnest(range(12)) AS k) ks")


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = pixsink.Layout({"v": codecs.FLOAT, "Z": codecs.HALF}, codecs.NONE, (16, 16), attributes={"preview": ("preview", _PREVIEW)})
    ship(spark)
    rows = _view(spark, sf_dir, _PLANE).withColumn("Z", F.col("x").cast("double"))
    made = pixsink.assemble(pixsink.pack_pixels(rows, form), form).withColumnRenamed("image", "path")
    return pixfile.summaries(made).withColumnRenamed("path", "image").drop("bytes")


_add("src24_file_summary", _summaries, f"SELECT {_IMAGE} AS image, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, 0 AS codec, true AS tiled, false AS deep, false AS multipart, 1 AS parts, cast(ceil((max(y) - min(y) + 1) / 16.0) * ceil((max(x) - min(x) + 1) / 16.0) as bigint) AS chunks, 16 AS tile_width, 16 AS tile_height, 'Z,v' AS channels, true AS preview FROM plane GROUP BY {_IMAGE}")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = pixsink.Layout({"v": codecs.FLOAT}, codecs.ZIP)
    return pixfile.parts(plane_files(spark, sf_dir, form, ["left", "right"])).select(F.col("path").alias("image"), "part", "name", "kind", "codec", "minx", "miny", "maxx", "maxy", "chunks", "multipart")


_add("src19_part_catalogue", _parts, f"SELECT {_IMAGE} AS image, p.part, p.name, 'scanlineimage' AS kind, 3 AS codec, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy, cast(ceil((max(y) - min(y) + 1) / 16.0) as bigint) AS chunks, true AS multipart FROM plane CROSS JOIN (VALUES (0, 'left'), (1, 'right')) p(part, name) GROUP BY {_IMAGE}, p.part, p.name")


def _stereo(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = pixsink.Layout({"v": codecs.FLOAT}, codecs.ZIP)
    both = pixfile.pixels(plane_files(spark, sf_dir, form, ["left", "right"]), ["v"])
    return both.groupBy(F.col("path").alias("image"), "y", "x").agg(F.max(F.when(F.col("part") == 0, F.col("v"))).alias("v_left"), F.max(F.when(F.col("part") == 1, F.col("v"))).alias("v_right"))


_add("snk8_multi_part_file", _stereo, f"SELECT {_IMAGE} AS image, y, x, v AS v_left, v * 2 AS v_right FROM plane")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = pixsink.Layout({"v": codecs.FLOAT}, codecs.NONE, (16, 16))
    return pixfile.chunks(plane_files(spark, sf_dir, form)).select(F.col("path").alias("image"), "chunk", "minx", "miny", "maxx", "maxy", "packed")


_add("src6_tile_chunks", _chunks, f"WITH t AS (SELECT {_IMAGE} AS image, (y % 64) {{idiv}} 16 * 4 + x {{idiv}} 16 AS chunk, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM plane GROUP BY 1, 2) SELECT image, chunk, minx, miny, maxx, maxy, (maxx - minx + 1) * (maxy - miny + 1) * 4 AS packed FROM t")


def _attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = pixsink.Layout({"v": codecs.FLOAT}, codecs.ZIP, attributes={"owner": ("string", b"nobody"), "odd": ("newtype", b"\x01\x02")})
    found = pixfile.attributes(plane_files(spark, sf_dir, form))
    return found.groupBy("name", "type").agg(F.count("*").alias("n"), F.max(F.when(F.col("name").isin("owner", "odd", "lineOrder"), F.hex("value"))).alias("value"))


_NAMES = {"byteLayout": "string", "channels": "chlist", "compression": "compression", "dataWindow": "box2i", "displayWindow": "box2i", "lineOrder": "lineOrder", "odd": "newtype", "owner": "string", "pixelAspectRatio": "float", "screenWindowCenter": "v2f", "screenWindowWidth": "float"}
_HEX = {"owner": b"nobody".hex().upper(), "odd": "0102", "lineOrder": "00"}
_add("met9_attribute_round_trip", _attributes, "SELECT name, type, (SELECT count(DISTINCT y {idiv} 64) FROM plane) AS n, value FROM (VALUES " + ", ".join(f"('{n}', '{t}', {repr(_HEX[n]) if n in _HEX else 'NULL'})" for n, t in _NAMES.items()) + ") a(name, type, value)")


def _copied(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = pixsink.Layout({"v": codecs.FLOAT}, codecs.ZIP, (16, 16), attributes={"owner": ("string", b"nobody"), "odd": ("newtype", b"\x01\x02")})
    found = pixfile.copied_attributes(plane_files(spark, sf_dir, form))
    return found.select(F.col("path").alias("image"), "name", "type", F.hex("value").alias("value"))


_add("prj10_copied_metadata", _copied, f"SELECT image, name, type, value FROM (SELECT DISTINCT {_IMAGE} AS image FROM plane) i CROSS JOIN (VALUES ('byteLayout', 'string', '{b'native'.hex().upper()}'), ('owner', 'string', '{b'nobody'.hex().upper()}'), ('odd', 'newtype', '0102')) a(name, type, value)")


def _deep(codec: int, tile: tuple[int, int] | None = None, layout: str = "native"):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        form = pixsink.Layout({c: codecs.FLOAT for c in ("a", "r", "z")}, codec, tile, layout)
        return pixfile.deep_samples(deep_files(spark, sf_dir, form), ["z", "a", "r"]).select(F.col("path").alias("image"), "y", "x", "s", "z", "a", "r")

    return query


_SAMPLES = "SELECT concat('deep', cast(src as varchar), '-', cast(y {idiv} 64 as varchar)) AS image, y, x, row_number() OVER (PARTITION BY src, y, x ORDER BY z, zback, src, s, a, r, g, b) - 1 AS s, cast(cast(z as float) as double) AS z, cast(cast(a as float) as double) AS a, cast(cast(r as float) as double) AS r FROM deep"
_add("snk6_deep_scanline_file", _deep(codecs.ZIPS), _SAMPLES)
_add("snk7_deep_tile_file", _deep(codecs.RLE, (32, 16)), _SAMPLES)
_add("src7_deep_interchange_file", _deep(codecs.ZIP, layout="interchange"), _SAMPLES)


def _manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs each 256 ids as a manifest, reads them back."""
    ship(spark)
    rows = _view(spark, sf_dir, "SELECT id, v1, v2, id {idiv} 256 AS file FROM manifest")

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        entries = {int(i): [a, b] for i, a, b in zip(group["id"], group["v1"], group["v2"], strict=True)}
        return pd.DataFrame({"file": [group["file"].iloc[0]], "packed": [manifests.encode([manifests.Group(["id"], ["name", "brand"], entries)])]})

    def unpack(batches):
        for batch in batches:
            for file, packed in zip(batch["file"], batch["packed"], strict=True):
                yield pd.DataFrame([(file, i, *v) for g in manifests.decode(packed) for i, v in g.entries.items()], columns=["file", "id", "v1", "v2"])

    packed = rows.groupBy("file").applyInPandas(pack, "file bigint, packed binary")
    return packed.mapInPandas(unpack, "file bigint, id bigint, v1 string, v2 string")


_add("sd11_manifest_round_trip", _manifests, "SELECT id {idiv} 256 AS file, id, v1, v2 FROM manifest")


def _hash128(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)

    def run(batches):
        for batch in batches:
            words = [manifests.murmur3_128(n.encode()) for n in batch["name"]]
            yield pd.DataFrame({"name": batch["name"], "high": [f"{a:016x}" for a, _ in words], "low": [f"{b:016x}" for _, b in words]})

    return _view(spark, sf_dir, "SELECT name FROM names").mapInPandas(run, "name string, high string, low string")


catalogue.QUERIES["sd8_murmur3_128"] = _hash128  # no SQL counterpart: 64-bit products; tested against published values


def _validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file whole, with another magic number, cut within its last chunk, and cut to four bytes."""
    form = pixsink.Layout({"v": codecs.FLOAT}, codecs.NONE)
    whole = plane_files(spark, sf_dir, form)
    kinds = {"whole": "content", "magic": "concat(X'00', substring(content, 2))", "cut": "substring(content, 1, length(content) - 9)", "short": "substring(content, 1, 4)"}
    made = whole.select("path", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.expr(e).alias("content")) for k, e in kinds.items()])).alias("f"))
    found = pixfile.validate(made.select(F.concat("path", F.lit("/"), "f.kind").alias("path"), "f.content"))
    return found.select(F.col("path").alias("image"), "check", "ok")


_OK = "CASE kind WHEN 'whole' THEN true WHEN 'magic' THEN CASE k WHEN 0 THEN true WHEN 1 THEN false END WHEN 'cut' THEN k < 3 WHEN 'short' THEN CASE k WHEN 0 THEN false END END"
_add("flt10_file_validation", _validation, f"SELECT concat(image, '/', kind) AS image, \"check\", {_OK} AS ok FROM (SELECT DISTINCT {_IMAGE} AS image FROM plane) i CROSS JOIN (VALUES ('whole'), ('magic'), ('cut'), ('short')) v(kind) CROSS JOIN (VALUES (0, 'size'), (1, 'header'), (2, 'offsets'), (3, 'chunks')) c(k, \"check\")")
