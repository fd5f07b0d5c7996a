"""Writes DataFrames of pixels and deep samples as multi-channel pixel files.

Chunks are packed in parallel, one group a chunk, so no task holds more than a chunk's lines or a tile until the files
are put together; a file is put together in one task, whose size is the file's. `save` writes each file under a name of
its own and renames it, so a task that runs twice leaves one whole file.
"""

from __future__ import annotations

import os
import struct
import uuid
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import LINES_PER_CHUNK
from lumenframe.operators import codecs
from lumenframe.sources import pixfile


@dataclass
class Layout:
    """What a file is to hold. channels: pixel type by name; tile: (width, height), lines if None."""

    channels: dict[str, int]
    codec: int = codecs.ZIP
    tile: tuple[int, int] | None = None
    layout: str = "native"
    level: int = 6
    attributes: dict[str, tuple[str, bytes]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.codec not in codecs.SUPPORTED:
            raise NotImplementedError(f"codec {self.codec}")
        if not self.channels:
            raise ValueError("a file needs a channel")
        self.channels = dict(sorted(self.channels.items(), key=lambda c: c[0].encode()))


def _attribute(name: str, kind: str, value: bytes) -> bytes:
    return name.encode() + b"\0" + kind.encode() + b"\0" + struct.pack("<i", len(value)) + value


def header(form: Layout, window: tuple[int, int, int, int], kind: str, name: str | None, chunks: int) -> bytes:
    """A part's attributes, sorted by name, and the zero byte that ends them."""
    listed = b"".join(n.encode() + b"\0" + struct.pack("<iIii", k, 0, 1, 1) for n, k in form.channels.items()) + b"\0"
    box = struct.pack("<4i", *window)
    values = form.attributes | {"channels": ("chlist", listed), "compression": ("compression", bytes([form.codec])), "dataWindow": ("box2i", box), "displayWindow": ("box2i", box), "lineOrder": ("lineOrder", b"\0"), "pixelAspectRatio": ("float", struct.pack("<f", 1)), "screenWindowCenter": ("v2f", bytes(8)), "screenWindowWidth": ("float", struct.pack("<f", 1)), "byteLayout": ("string", form.layout.encode())}
    if form.tile:
        values["tiles"] = ("tiledesc", struct.pack("<IIB", *form.tile, 0))
    if name is not None or kind.startswith("deep"):
        values |= {"type": ("string", kind.encode()), "chunkCount": ("int", struct.pack("<i", chunks))}
    if name is not None:
        values["name"] = ("string", name.encode())
    if kind.startswith("deep"):
        values["version"] = ("int", struct.pack("<i", 1))
    return b"".join(_attribute(k, *values[k]) for k in sorted(values)) + b"\0"


_CHUNK = "image string, part int, chunk bigint, tx int, ty int, minx int, miny int, maxx int, maxy int, bx int, by int, counts int, unpacked bigint, payload binary"


def _placed(frame: DataFrame, form: Layout) -> DataFrame:
    """Adds each row's window and chunk. The windows are one small row a part."""
    windows = frame.groupBy("image", "part").agg(*[f(n[-1]).cast("int").alias(n) for n, f in (("minx", F.min), ("miny", F.min), ("maxx", F.max), ("maxy", F.max))])
    rows = frame.join(windows, ["image", "part"])
    if not form.tile:
        return rows.withColumn("tx", F.lit(0)).withColumn("ty", F.expr(f"cast((y - miny) div {LINES_PER_CHUNK[form.codec]} as int)"))
    return rows.withColumn("tx", F.expr(f"cast((x - minx) div {form.tile[0]} as int)")).withColumn("ty", F.expr(f"cast((y - miny) div {form.tile[1]} as int)"))


def _box(first: pd.Series, form: Layout) -> tuple[int, int, int, int]:
    minx, miny, maxx, maxy, tx, ty = (int(first[c]) for c in ("minx", "miny", "maxx", "maxy", "tx", "ty"))
    if not form.tile:
        n = LINES_PER_CHUNK[form.codec]
        return minx, miny + ty * n, maxx, min(miny + ty * n + n - 1, maxy)
    w, h = form.tile
    return minx + tx * w, miny + ty * h, min(minx + tx * w + w - 1, maxx), min(miny + ty * h + h - 1, maxy)


def _row(first: pd.Series, form: Layout, box: tuple[int, int, int, int], counts: int, unpacked: int, payload: bytes) -> pd.DataFrame:
    across = -(-(int(first.maxx) - int(first.minx) + 1) // form.tile[0]) if form.tile else 1
    return pd.DataFrame([(first.image, first.part, int(first.ty) * across + int(first.tx), first.tx, first.ty, first.minx, first.miny, first.maxx, first.maxy, box[0], box[1], counts, unpacked, payload)], columns=[c.split(" ")[0] for c in _CHUNK.split(", ")])


def _numbers(values: pd.Series, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return values.fillna(0).to_numpy().astype(codecs.DTYPES[kind])


def pack_pixels(frame: DataFrame, form: Layout) -> DataFrame:
    """Chunks of flat parts. frame: (image, part, y, x, a column each channel); pixels that are missing are zero, of repeated ones any stands."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        first, box = rows.iloc[0], _box(rows.iloc[0], form)
        shape = box[3] - box[1] + 1, box[2] - box[0] + 1
        at = rows["y"].to_numpy() - box[1], rows["x"].to_numpy() - box[0]
        planes = []
        for i, kind in enumerate(form.channels.values()):
            plane = np.zeros(shape, codecs.DTYPES[kind])
            plane[at] = _numbers(rows[f"_c{i}"], kind)
            planes.append(plane)
        raw = b"".join(p[y].tobytes() for y in range(shape[0]) for p in planes)
        runs = [(k, shape[1]) for _ in range(shape[0]) for k in form.channels.values()]
        return _row(first, form, box, 0, len(raw), codecs.encode(raw, form.codec, runs, form.layout, form.level))

    # channels go by number, as grouped frames take no names with a dot
    keep = ["image", "part", "y", "x", *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(form.channels)]]
    return _placed(frame.select(keep), form).groupBy("image", "part", "tx", "ty").applyInPandas(pack, _CHUNK)


def pack_samples(frame: DataFrame, form: Layout, order: list[str]) -> DataFrame:
    """Chunks of deep parts. frame: (image, part, y, x, a column each channel, the columns that order a pixel's samples)."""
    if form.codec not in (codecs.NONE, codecs.RLE, codecs.ZIPS, codecs.ZIP):
        raise ValueError(f"codec {form.codec} holds no deep samples")

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["y", "x", *order], kind="stable")
        first, box = rows.iloc[0], _box(rows.iloc[0], form)
        w, h = box[2] - box[0] + 1, box[3] - box[1] + 1
        pixel = (rows["y"].to_numpy() - box[1]) * w + rows["x"].to_numpy() - box[0]
        counts = np.bincount(pixel, minlength=w * h).reshape(h, w)
        native = form.layout == "native"
        upto = (np.cumsum(counts) if native else np.cumsum(counts, axis=1)).astype("<u4").tobytes()
        values = [_numbers(rows[n], k) for n, k in form.channels.items()]
        ends = np.cumsum(counts.ravel() if native else counts.sum(axis=1))
        raw = b"".join(v[a:b].tobytes() for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True) if b > a for v in values)
        table = codecs.encode(upto, form.codec, None, form.layout, form.level)
        return _row(first, form, box, len(table), len(raw), table + codecs.encode(raw, form.codec, None, form.layout, form.level))

    keep = list(dict.fromkeys(["image", "part", "y", "x", *form.channels, *order]))
    return _placed(frame.select(keep), form).groupBy("image", "part", "tx", "ty").applyInPandas(pack, _CHUNK)


def assemble(chunks: DataFrame, form: Layout, deep: bool = False, names: list[str] | None = None, views: list[str] | None = None) -> DataFrame:
    """(image, content) of whole files. names: one for each part, for files of several, and their views, if any; chunks without a pixel are packed as zeros."""
    kind = pixfile.KINDS[bool(form.tile) + 2 * deep]
    flags = 2 | (pixfile.TILED if form.tile and not deep and not names else 0) | (pixfile.DEEP if deep else 0) | (pixfile.MULTIPART if names else 0)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        heads, plans = [], []
        for number, group in rows.groupby("part"):
            first = group.iloc[0]
            window = tuple(int(first[c]) for c in ("minx", "miny", "maxx", "maxy"))
            have = {int(r.chunk): r for r in group.itertuples()}
            across = -(-(window[2] - window[0] + 1) // form.tile[0]) if form.tile else 1
            down = -(-(window[3] - window[1] + 1) // (form.tile[1] if form.tile else LINES_PER_CHUNK[form.codec]))
            total = across * down
            own = replace(form, attributes=form.attributes | {"view": ("string", views[int(number)].encode())}) if views else form
            heads.append(header(own, window, kind, names[int(number)] if names else None, total))
            plan = []
            for index in range(total):
                place = first.copy()
                place["tx"], place["ty"] = index % across, index // across
                box = _box(place, form)
                found = have.get(index)
                if found is None:
                    w, h = box[2] - box[0] + 1, box[3] - box[1] + 1
                    runs = [(k, w) for _ in range(h) for k in form.channels.values()]
                    raw = bytes(4 * w * h if deep else sum(codecs.DTYPES[k].itemsize * n for k, n in runs))
                    payload = codecs.encode(raw, form.codec, None if deep else runs, form.layout, form.level)
                    counts, unpacked = (len(payload), 0) if deep else (0, len(raw))
                else:
                    payload, counts, unpacked = bytes(found.payload), int(found.counts), int(found.unpacked)
                lead = struct.pack("<i", int(number)) if names else b""
                lead += struct.pack("<4i", index % across, index // across, 0, 0) if form.tile else struct.pack("<i", box[1])
                lead += struct.pack("<3Q", counts, len(payload) - counts, unpacked) if deep else struct.pack("<i", len(payload))
                plan.append(lead + payload)
            plans.append(plan)
        top = struct.pack("<iI", pixfile.MAGIC, flags) + b"".join(heads) + (b"\0" if names else b"")
        at, offsets = len(top) + 8 * sum(map(len, plans)), []
        for piece in (p for plan in plans for p in plan):
            offsets.append(at)
            at += len(piece)
        content = top + struct.pack(f"<{len(offsets)}Q", *offsets) + b"".join(p for plan in plans for p in plan)
        return pd.DataFrame({"image": [rows["image"].iloc[0]], "content": [content]})

    return chunks.groupBy("image").applyInPandas(build, "image string, content binary")


def save(frame: DataFrame, folder: str) -> DataFrame:
    """Writes (image, content) rows as folder/image, a folder that every executor sees; returns (path, bytes). Runs when its result is used."""

    def write(batches):
        for batch in batches:
            done = []
            for image, content in zip(batch["image"], batch["content"], strict=True):
                path = os.path.join(folder, image)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                part = f"{path}.{uuid.uuid4().hex}.part"
                with open(part, "wb") as out:
                    out.write(content)
                os.replace(part, path)
                done.append((path, len(content)))
            yield pd.DataFrame(done, columns=["path", "bytes"])

    return frame.mapInPandas(write, "path string, bytes bigint")
