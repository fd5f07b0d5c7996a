"""Multi-channel pixel files (magic 20000630) as DataFrames: parts, attributes, chunks, pixels and deep samples.

Files come from Spark's binaryFile source, so any path that Spark can read will do, and a file's chunks are decoded in
the task that holds it. `parts`, `attributes` and `chunks` parse headers alone; `pixels` and `deep_samples` decode only
chunks that meet the rows asked for and only the channels asked for. A damaged file raises, unless errors="skip_chunk"
leaves out the chunks that do not decode; headers never are guessed.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import LINES_PER_CHUNK
from lumenframe.operators import codecs

#: The format's magic number, flag bits and required attributes (fixed values).
MAGIC = 20000630
TILED, LONG_NAMES, DEEP, MULTIPART = 0x200, 0x400, 0x800, 0x1000
REQUIRED = ("channels", "compression", "dataWindow", "displayWindow", "lineOrder", "pixelAspectRatio", "screenWindowCenter", "screenWindowWidth")
KINDS = ("scanlineimage", "tiledimage", "deepscanline", "deeptile")


@dataclass
class Channel:
    name: str
    kind: int
    xs: int = 1
    ys: int = 1


@dataclass
class Part:
    """One header: raw attributes by name, and what the decoder needs of them."""

    attributes: dict[str, tuple[str, bytes]]
    channels: list[Channel] = field(default_factory=list)
    codec: int = 0
    window: tuple[int, int, int, int] = (0, 0, 0, 0)
    kind: str = "scanlineimage"
    tile: tuple[int, int, int, int] | None = None
    offsets: list[int] = field(default_factory=list)

    @property
    def lines(self) -> int:
        return LINES_PER_CHUNK[self.codec]

    @property
    def layout(self) -> str:
        return self.attributes.get("byteLayout", ("string", b"native"))[1].decode()

    def levels(self) -> list[tuple[int, int, int, int]]:
        """(lx, ly, width, height) of each level, in the order of their tiles."""
        x0, y0, x1, y1 = self.window
        w, h = x1 - x0 + 1, y1 - y0 + 1
        _, _, mode, up = self.tile
        size = lambda n, k: max(1, -(-n // (1 << k)) if up else n >> k)
        count = lambda n: ((n - 1).bit_length() if up else n.bit_length() - 1) + 1
        if mode == 0:
            return [(0, 0, w, h)]
        if mode == 1:
            return [(k, k, size(w, k), size(h, k)) for k in range(count(max(w, h)))]
        return [(i, j, size(w, i), size(h, j)) for j in range(count(h)) for i in range(count(w))]

    def chunk_count(self) -> int:
        x0, y0, x1, y1 = self.window
        if self.tile and self.kind in ("tiledimage", "deeptile"):
            return sum(-(-w // self.tile[0]) * -(-h // self.tile[1]) for _, _, w, h in self.levels())
        return -(-(y1 - y0 + 1) // self.lines)


def _text(data: bytes, at: int) -> tuple[str, int]:
    end = data.index(b"\0", at)
    return data[at:end].decode("utf-8"), end + 1


def parse_channels(raw: bytes) -> list[Channel]:
    found, at = [], 0
    while raw[at : at + 1] != b"\0":
        name, at = _text(raw, at)
        kind, _, xs, ys = struct.unpack_from("<iIii", raw, at)
        if kind not in codecs.DTYPES or xs < 1 or ys < 1:
            raise ValueError(f"channel {name}: type {kind}, sampling {xs} x {ys}")
        found.append(Channel(name, kind, xs, ys))
        at += 16
    return found


def parse_file(data: bytes) -> tuple[int, list[Part]]:
    """(version word, parts with their chunk offsets). Raises ValueError for what is no such file."""
    if len(data) < 8 or struct.unpack_from("<i", data)[0] != MAGIC:
        raise ValueError("no pixel file")
    version = struct.unpack_from("<I", data, 4)[0]
    if version & 255 != 2:
        raise ValueError(f"version {version & 255}")
    parts, at = [], 8
    try:
        while True:
            attributes = {}
            while data[at : at + 1] != b"\0":
                name, at = _text(data, at)
                kind, at = _text(data, at)
                size = struct.unpack_from("<i", data, at)[0]
                if size < 0 or at + 4 + size > len(data):
                    raise ValueError(f"attribute {name} of {size} bytes")
                attributes[name] = (kind, data[at + 4 : at + 4 + size])
                at += 4 + size
            at += 1
            parts.append(_part(attributes, version))
            if not version & MULTIPART or data[at : at + 1] == b"\0":
                break
        at += 1 if version & MULTIPART else 0
        for part in parts:
            n = part.chunk_count()
            part.offsets = list(struct.unpack_from(f"<{n}Q", data, at))
            at += 8 * n
    except (IndexError, struct.error) as error:
        raise ValueError(f"header ends early: {error}") from error
    return version, parts


def _part(attributes: dict[str, tuple[str, bytes]], version: int) -> Part:
    missing = [a for a in REQUIRED if a not in attributes]
    if missing:
        raise ValueError(f"required attributes missing: {', '.join(missing)}")
    value = {k: v for k, (_, v) in attributes.items()}
    part = Part(attributes, parse_channels(value["channels"]), value["compression"][0], struct.unpack("<4i", value["dataWindow"]))
    if part.codec >= len(LINES_PER_CHUNK) or part.window[0] > part.window[2] or part.window[1] > part.window[3] or not part.channels:
        raise ValueError(f"codec {part.codec}, window {part.window}, {len(part.channels)} channels")
    if "tiles" in value:
        w, h, mode = struct.unpack("<IIB", value["tiles"])
        part.tile = (w, h, mode & 15, mode >> 4)
    part.kind = value["type"].decode() if "type" in value else KINDS[bool(version & TILED) + 2 * bool(version & DEEP)]
    return part


def _columns(lo: int, hi: int, step: int) -> np.ndarray:
    """Sampled places of lo..hi: multiples of step."""
    return np.arange(-(-lo // step) * step, hi + 1, step)


def _box_lines(part: Part, box: tuple[int, int, int, int]) -> list[tuple[int, Channel, np.ndarray]]:
    x0, y0, x1, y1 = box
    return [(y, c, _columns(x0, x1, c.xs)) for y in range(y0, y1 + 1) for c in part.channels if y % c.ys == 0]


@dataclass
class Chunk:
    index: int
    lx: int
    ly: int
    box: tuple[int, int, int, int]
    at: int
    packed: int
    counts: int = 0
    unpacked: int = 0


def part_chunks(data: bytes, number: int, part: Part, version: int) -> Iterator[Chunk]:
    """Chunk headers of a part, by offset table."""
    x0, y0, x1, y1 = part.window
    sizes = {(lx, ly): (w, h) for lx, ly, w, h in part.levels()} if part.tile else {}
    deep = part.kind.startswith("deep")
    for index, at in enumerate(part.offsets):
        if at <= 0 or at + 8 > len(data):
            raise codecs.CorruptChunk(f"chunk {index} at {at}")
        if version & MULTIPART:
            if struct.unpack_from("<i", data, at)[0] != number:
                raise codecs.CorruptChunk(f"chunk {index} is another part's")
            at += 4
        if part.kind in ("tiledimage", "deeptile"):
            tx, ty, lx, ly = struct.unpack_from("<4i", data, at)
            w, h = sizes[lx, ly]
            left, top = x0 + tx * part.tile[0], y0 + ty * part.tile[1]
            box, at = (left, top, min(left + part.tile[0], x0 + w) - 1, min(top + part.tile[1], y0 + h) - 1), at + 16
        else:
            top, lx, ly = struct.unpack_from("<i", data, at)[0], 0, 0
            box, at = (x0, top, x1, min(top + part.lines - 1, y1)), at + 4
        if deep:
            counts, packed, unpacked = struct.unpack_from("<3Q", data, at)
            yield Chunk(index, lx, ly, box, at + 24, packed, counts, unpacked)
        else:
            yield Chunk(index, lx, ly, box, at + 4, struct.unpack_from("<i", data, at)[0])


def chunk_pixels(data: bytes, part: Part, chunk: Chunk, wanted: list[str]) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """(y, x, values by channel) of a flat chunk; NaN-free floats as they are, missing or unsampled values masked later as NaN."""
    lines = _box_lines(part, chunk.box)
    runs = [(c.kind, len(xs)) for _, c, xs in lines]
    size = sum(codecs.DTYPES[k].itemsize * n for k, n in runs)
    raw = codecs.decode(data[chunk.at : chunk.at + chunk.packed], size, part.codec, runs, part.layout)
    x0, y0, x1, y1 = chunk.box
    shape, at = (y1 - y0 + 1, x1 - x0 + 1), 0
    planes = {w: np.ma.masked_all(shape, np.float64) for w in wanted}
    for y, c, xs in lines:
        if c.name in planes:
            planes[c.name][y - y0, xs - x0] = np.frombuffer(raw, codecs.DTYPES[c.kind], len(xs), at)
        at += len(xs) * codecs.DTYPES[c.kind].itemsize
    ys, xs = np.mgrid[y0 : y1 + 1, x0 : x1 + 1]
    return ys.ravel(), xs.ravel(), {w: p.ravel() for w, p in planes.items()}


def chunk_samples(data: bytes, part: Part, chunk: Chunk, wanted: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """(y, x, sample number, values by channel) of a deep chunk."""
    x0, y0, x1, y1 = chunk.box
    w, h = x1 - x0 + 1, y1 - y0 + 1
    table = codecs.decode(data[chunk.at : chunk.at + chunk.counts], 4 * w * h, part.codec, None, part.layout)
    upto = np.frombuffer(table, "<u4").astype(np.int64)
    counts = np.diff(upto, prepend=0) if part.layout == "native" else np.diff(upto.reshape(h, w), prepend=0, axis=1).ravel()
    if len(counts) and counts.min() < 0:
        raise codecs.CorruptChunk("sample counts fall")
    start = chunk.at + chunk.counts
    raw = codecs.decode(data[start : start + chunk.packed], chunk.unpacked, part.codec, None, part.layout)
    total = int(counts.sum())
    if total * sum(codecs.DTYPES[c.kind].itemsize for c in part.channels) != chunk.unpacked:
        raise codecs.CorruptChunk("sample counts do not fit the samples")
    pixel = np.repeat(np.arange(w * h), counts)
    first = np.cumsum(counts) - counts
    number = np.arange(total) - np.repeat(first, counts)
    group = pixel if part.layout == "native" else pixel // w  # samples lie by group, then channel, then pixel
    size = counts if part.layout == "native" else counts.reshape(h, w).sum(axis=1)
    begun = np.cumsum(size) - size
    within = np.arange(total) - begun[group]
    width, bytes_, values, before = sum(codecs.DTYPES[c.kind].itemsize for c in part.channels), np.frombuffer(raw, np.uint8), {}, 0
    for c in part.channels:
        k = codecs.DTYPES[c.kind].itemsize
        if c.name in wanted:
            at = begun[group] * width + size[group] * before + within * k
            values[c.name] = bytes_[at[:, None] + np.arange(k)].ravel().view(codecs.DTYPES[c.kind]).astype(np.float64)
        before += k
    return pixel // w + y0, pixel % w + x0, number, values


# --- files as DataFrames ----------------------------------------------------------------------------------------------
def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files at a path, folder or glob."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _mapped(frame: DataFrame, schema: str, rows) -> DataFrame:
    """Runs rows(path, content) -> batches of columns over (path, content) rows."""
    arrow = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_()}[t]) for n, t in (c.split(" ") for c in schema.split(", "))])

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                for columns in rows(path.as_py(), content.as_buffer().to_pybytes()):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return frame.mapInArrow(run, ", ".join("`{}` {}".format(*c.split(" ")) for c in schema.split(", ")))


def parts(frame: DataFrame) -> DataFrame:
    """A row for each part: its name, kind, codec, window, tile size and number of chunks."""

    def rows(path, content):
        version, found = parse_file(content)
        get = lambda p, k: p.attributes[k][1].decode() if k in p.attributes else None
        yield [[path] * len(found), range(len(found)), [get(p, "name") for p in found], [get(p, "view") for p in found], [p.kind for p in found], [p.codec for p in found], *[[p.window[i] for p in found] for i in range(4)], [p.tile[0] if p.tile else None for p in found], [p.tile[1] if p.tile else None for p in found], [len(p.offsets) for p in found], [bool(version & MULTIPART)] * len(found), [len(content)] * len(found)]

    return _mapped(frame, "path string, part int, name string, view string, kind string, codec int, minx int, miny int, maxx int, maxy int, tile_width int, tile_height int, chunks bigint, multipart boolean, bytes bigint", rows)


def attributes(frame: DataFrame) -> DataFrame:
    """(path, part, name, type, value) of every attribute; values are their bytes, so unknown types keep theirs."""

    def rows(path, content):
        for number, p in enumerate(parse_file(content)[1]):
            names = list(p.attributes)
            yield [[path] * len(names), [number] * len(names), names, [p.attributes[n][0] for n in names], [p.attributes[n][1] for n in names]]

    return _mapped(frame, "path string, part int, name string, type string, value binary", rows)


def channels(frame: DataFrame) -> DataFrame:
    def rows(path, content):
        for number, p in enumerate(parse_file(content)[1]):
            cs = p.channels
            yield [[path] * len(cs), [number] * len(cs), [c.name for c in cs], [c.kind for c in cs], [c.xs for c in cs], [c.ys for c in cs]]

    return _mapped(frame, "path string, part int, name string, type int, xs int, ys int", rows)


def chunks(frame: DataFrame) -> DataFrame:
    """(path, part, chunk, lx, ly, minx, miny, maxx, maxy, packed) of every chunk."""

    def rows(path, content):
        version, found = parse_file(content)
        for number, p in enumerate(found):
            cs = list(part_chunks(content, number, p, version))
            yield [[path] * len(cs), [number] * len(cs), [c.index for c in cs], [c.lx for c in cs], [c.ly for c in cs], *[[c.box[i] for c in cs] for i in range(4)], [c.packed for c in cs]]

    return _mapped(frame, "path string, part int, chunk bigint, lx int, ly int, minx int, miny int, maxx int, maxy int, packed bigint", rows)


def _meets(chunk: Chunk, rows: tuple[int, int] | None, level: tuple[int, int] | None) -> bool:
    return (rows is None or (chunk.box[1] <= rows[1] and chunk.box[3] >= rows[0])) and (level is None or (chunk.lx, chunk.ly) == level)


def pixels(frame: DataFrame, wanted: list[str], rows: tuple[int, int] | None = None, level: tuple[int, int] | None = None, errors: str = "raise") -> DataFrame:
    """(path, part, lx, ly, y, x, one double a wanted channel) of flat parts; null where a channel is absent or not sampled."""

    def each(path, content):
        version, found = parse_file(content)
        for number, p in enumerate(found):
            if p.kind.startswith("deep"):
                continue
            for c in part_chunks(content, number, p, version):
                if not _meets(c, rows, level):
                    continue
                try:
                    y, x, values = chunk_pixels(content, p, c, wanted)
                except codecs.CorruptChunk:
                    if errors == "raise":
                        raise
                    continue
                keep = np.ones(len(y), bool) if rows is None else (y >= rows[0]) & (y <= rows[1])
                n = int(keep.sum())
                yield [[path] * n, np.full(n, number), np.full(n, c.lx), np.full(n, c.ly), y[keep], x[keep], *[pa.array(values[w].data[keep], pa.float64(), mask=np.ma.getmaskarray(values[w])[keep]) for w in wanted]]

    return _mapped(frame, "path string, part int, lx int, ly int, y bigint, x bigint" + "".join(f", {w} double" for w in wanted), each)


def deep_samples(frame: DataFrame, wanted: list[str], rows: tuple[int, int] | None = None) -> DataFrame:
    """(path, part, y, x, s, one double a wanted channel) of deep parts; null where a channel is absent."""

    def each(path, content):
        version, found = parse_file(content)
        for number, p in enumerate(found):
            if not p.kind.startswith("deep"):
                continue
            for c in part_chunks(content, number, p, version):
                if not _meets(c, rows, (0, 0)):
                    continue
                y, x, s, values = chunk_samples(content, p, c, wanted)
                keep = np.ones(len(y), bool) if rows is None else (y >= rows[0]) & (y <= rows[1])
                n = int(keep.sum())
                yield [[path] * n, np.full(n, number), y[keep], x[keep], s[keep], *[values[w][keep] if w in values else [None] * n for w in wanted]]

    return _mapped(frame, "path string, part int, y bigint, x bigint, s bigint" + "".join(f", {w} double" for w in wanted), each)


def summaries(frame: DataFrame) -> DataFrame:
    """One row a file: its first part's size, codec, kind, tile, channels and preview, the number of parts and chunks, its bytes. Headers alone are parsed."""

    def rows(path, content):
        version, found = parse_file(content)
        p = found[0]
        x0, y0, x1, y1 = p.window
        tile = p.tile or (None, None)
        yield [[path], [x1 - x0 + 1], [y1 - y0 + 1], [p.codec], [p.tile is not None], [any(q.kind.startswith("deep") for q in found)], [bool(version & MULTIPART)], [len(found)], [sum(len(q.offsets) for q in found)], [tile[0]], [tile[1]], [",".join(sorted(c.name for c in p.channels))], ["preview" in p.attributes], [len(content)]]

    return _mapped(frame, "path string, width int, height int, codec int, tiled boolean, deep boolean, multipart boolean, parts int, chunks bigint, tile_width int, tile_height int, channels string, preview boolean, bytes bigint", rows)


#: Attributes that make up a file's structure; copying metadata leaves them out (fixed values).
STRUCTURAL = ("channels", "compression", "dataWindow", "displayWindow", "lineOrder", "pixelAspectRatio", "screenWindowCenter", "screenWindowWidth", "tiles", "type", "name", "version", "chunkCount")


def copied_attributes(frame: DataFrame) -> DataFrame:
    """Attributes that go along when a header's metadata are copied: all but the structural ones."""
    return attributes(frame).where(~F.col("name").isin(*STRUCTURAL))


def previews(frame: DataFrame) -> DataFrame:
    """(path, width, height, y, x, r, g, b, a) of the pixels of each file's embedded preview; files without one give no row."""

    def rows(path, content):
        found = parse_file(content)[1][0].attributes.get("preview")
        if found is not None:
            w, h = struct.unpack_from("<2I", found[1])
            if 8 + 4 * w * h != len(found[1]):
                raise ValueError(f"a preview of {w} x {h} in {len(found[1])} bytes")
            pixels_ = np.frombuffer(found[1], np.uint8, 4 * w * h, 8).reshape(-1, 4)
            at = np.arange(w * h)
            yield [[path] * len(at), [w] * len(at), [h] * len(at), at // max(w, 1), at % max(w, 1), *pixels_.T.astype(np.int32)]

    return _mapped(frame, "path string, width int, height int, y int, x int, r int, g int, b int, a int", rows)


#: Names that colour channels go by, the first that is there counts (fixed values).
ALIASES = {"r": ("R", "r", "red", "Red"), "g": ("G", "g", "green", "Green"), "b": ("B", "b", "blue", "Blue"), "a": ("A", "a", "alpha", "Alpha")}


def rgba(frame: DataFrame, rows: tuple[int, int] | None = None) -> DataFrame:
    """(path, part, y, x, r, g, b, a) of flat parts by any of the usual names; colours that are absent are 0, an absent alpha is 1."""

    def each(path, content):
        version, found = parse_file(content)
        for number, p in enumerate(found):
            if p.kind.startswith("deep"):
                continue
            have = {c.name for c in p.channels}
            names = {k: next((n for n in v if n in have), None) for k, v in ALIASES.items()}
            for c in part_chunks(content, number, p, version):
                if not _meets(c, rows, (0, 0)):
                    continue
                y, x, values = chunk_pixels(content, p, c, [n for n in names.values() if n])
                keep = np.ones(len(y), bool) if rows is None else (y >= rows[0]) & (y <= rows[1])
                n = int(keep.sum())
                plain = [values[names[k]].filled(0.0)[keep] if names[k] else np.full(n, float(k == "a")) for k in "rgba"]
                yield [[path] * n, np.full(n, number), y[keep], x[keep], *plain]

    return _mapped(frame, "path string, part int, y bigint, x bigint, r double, g double, b double, a double", each)


#: Names that a view's colour channels go by (fixed values).
STEREO = {"R": "r", "r": "r", "G": "g", "g": "g", "B": "b", "b": "b", "A": "a", "a": "a"}


def _strings(raw: bytes) -> list[str]:
    found, at = [], 0
    while at < len(raw):
        n = struct.unpack_from("<i", raw, at)[0]
        found.append(raw[at + 4 : at + 4 + n].decode())
        at += 4 + n
    return found


def view_channels(part: Part) -> dict[str, dict[str, str]]:
    """Of each view of a part, the channel that holds each of r, g, b and a.

    A part with a `view` is that view. Else `multiView` lists the views, the first being that of channels that name
    none; a name's last component but one is its view if it is listed. Of several channels the last by name stands.
    """
    if "view" in part.attributes:
        views, own = [part.attributes["view"][1].decode()], True
    else:
        views, own = _strings(part.attributes.get("multiView", ("", b""))[1]), False
    found: dict[str, dict[str, str]] = {v: {} for v in views}
    for c in part.channels:
        *lead, base = c.name.split(".")
        if own and lead or base not in STEREO or not views:
            continue
        view = lead[-1] if not own and lead and lead[-1] in views else views[0]
        found[view][STEREO[base]] = c.name
    return found


def stereo(frame: DataFrame, view: str | None = None) -> DataFrame:
    """(path, view, y, x, r, g, b, a) of the views of flat files, kept as parts or as channels of one part.

    Colours that are absent are 0, an absent alpha is 1; files without views give no row.
    """

    def each(path, content):
        version, found = parse_file(content)
        for number, p in enumerate(found):
            wanted = {v: c for v, c in view_channels(p).items() if view in (None, v)}
            if p.kind.startswith("deep") or not wanted:
                continue
            for c in part_chunks(content, number, p, version):
                if not _meets(c, None, (0, 0)):
                    continue
                y, x, values = chunk_pixels(content, p, c, sorted({n for names in wanted.values() for n in names.values()}))
                for v, names in wanted.items():
                    yield [[path] * len(y), [v] * len(y), y, x, *[values[names[k]].filled(0.0) if k in names else np.full(len(y), float(k == "a")) for k in "rgba"]]

    return _mapped(frame, "path string, view string, y bigint, x bigint, r double, g double, b double, a double", each)


CHECKS = ("size", "header", "offsets", "chunks")


def validate(frame: DataFrame) -> DataFrame:
    """(path, check, ok, note) for each of CHECKS in order; checks after one that fails are null.

    size: 8 bytes at least; header: magic, version, required attributes, windows and channels; offsets: each leads to a
    chunk of its part; chunks: each decodes to its size.
    """

    def rows(path, content):
        result = {"size": (len(content) >= 8, f"{len(content)} bytes")}
        if len(content) >= 8:
            try:
                version, found = parse_file(content)
                result["header"] = (True, f"{len(found)} parts")
                step = "offsets"
                listed = [(p, list(part_chunks(content, k, p, version))) for k, p in enumerate(found)]
                result[step] = (True, f"{sum(len(c) for _, c in listed)} chunks")
                step = "chunks"
                for p, cs in listed:
                    for c in cs:
                        chunk_samples(content, p, c, []) if p.kind.startswith("deep") else chunk_pixels(content, p, c, [])
                result[step] = (True, "")
            except (ValueError, KeyError, struct.error, NotImplementedError) as error:
                result[step if "header" in result else "header"] = (False, str(error))
        yield [[path] * len(CHECKS), list(CHECKS), [result.get(c, (None, None))[0] for c in CHECKS], [result.get(c, (None, None))[1] for c in CHECKS]]

    return _mapped(frame, "path string, check string, ok boolean, note string", rows)
