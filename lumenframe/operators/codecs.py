"""Chunk codecs over numpy: none, run coding, zlib by line or block, wavelets, 24-bit floats, blocks of 4 x 4 halves, and DCT chunks that keep all without loss.

Two byte orders. In `native` files bytes are delta coded first and split into even and odd ones after (run coding takes
no split), a run is a negative count, and a deep chunk's counts run on over its lines, its samples by pixel. In
`interchange` files bytes are split first and deltas carry a bias of 128, a run is a positive count, counts start anew
each line and samples lie by line and channel. Other codecs store what they are given when they can't shrink it, so a
payload as long as its data stands for itself.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from lumenframe.operators import piz

UINT, HALF, FLOAT = 0, 1, 2
DTYPES = {UINT: np.dtype("<u4"), HALF: np.dtype("<f2"), FLOAT: np.dtype("<f4")}
NONE, RLE, ZIPS, ZIP, PIZ, PXR24, B44, B44A, DWAA, DWAB = range(10)
SUPPORTED = (NONE, RLE, ZIPS, ZIP, PIZ, PXR24, B44, B44A, DWAA, DWAB)
#: Words that head a DCT chunk, their version and their code for deflate (fixed values).
DCT_WORDS, DCT_VERSION, DCT_DEFLATE = 11, 2, 1


class CorruptChunk(ValueError):
    """A payload that does not decode to its size."""


def delta_encode(data: np.ndarray, bias: int = 0) -> np.ndarray:
    out = data.copy()
    out[1:] = data[1:] - data[:-1] + np.uint8(bias)
    return out


def delta_decode(data: np.ndarray, bias: int = 0) -> np.ndarray:
    steps = data.copy()
    steps[1:] -= np.uint8(bias)
    return np.cumsum(steps, dtype=np.uint8)


def split(data: np.ndarray) -> np.ndarray:
    """Bytes of even places, then those of odd ones."""
    return np.concatenate([data[::2], data[1::2]])


def unsplit(data: np.ndarray) -> np.ndarray:
    out, half = np.empty_like(data), (len(data) + 1) // 2
    out[::2], out[1::2] = data[:half], data[half:]
    return out


def run_encode(data: np.ndarray, layout: str = "native") -> bytes:
    """Runs of 3 to 127 equal bytes as a count and the byte; all else as counted literals of up to 127 bytes."""
    mark = (lambda n: 257 - n) if layout == "native" else (lambda n: n - 1)
    plain = (lambda n: n - 1) if layout == "native" else (lambda n: 256 - n)
    out = bytearray()
    starts = np.concatenate([[0], np.flatnonzero(np.diff(data)) + 1, [len(data)]]) if len(data) else np.zeros(1, np.int64)
    lengths = np.diff(starts)
    raw, literal = data.tobytes(), 0

    def literals(to: int) -> None:
        for at in range(literal, to, 127):
            part = raw[at : min(at + 127, to)]
            out.append(plain(len(part)))
            out.extend(part)

    for k in np.flatnonzero(lengths >= 3):
        at, end = int(starts[k]), int(starts[k + 1])
        literals(at)
        while end - at >= 3:
            n = min(127, end - at)
            out += bytes((mark(n), raw[at]))
            at += n
        literal = at
    literals(len(raw))
    return bytes(out)


def run_decode(packed: bytes, size: int, layout: str = "native") -> np.ndarray:
    out, at = bytearray(), 0
    while at < len(packed):
        count = packed[at] - 256 if packed[at] > 127 else packed[at]
        run = count < 0 if layout == "native" else count >= 0
        n = abs(count) + (1 if layout == "native" or run else 0)
        piece = packed[at + 1 : at + 2] * n if run else packed[at + 1 : at + 1 + n]
        if len(piece) != n or len(out) + n > size:
            raise CorruptChunk("run coding does not fit its size")
        out += piece
        at += 2 if run else n + 1
    if len(out) != size:
        raise CorruptChunk(f"run coding gives {len(out)} of {size} bytes")
    return np.frombuffer(bytes(out), np.uint8)


def to_float24(values: np.ndarray) -> np.ndarray:
    """Sign, exponent and 15 rounded bits of mantissa; rounding never reaches infinity, NaN stays NaN."""
    bits = values.astype("<f4").view(np.uint32)
    sign, rest = (bits >> np.uint32(8)) & np.uint32(0x800000), bits & np.uint32(0x7FFFFFFF)
    cut = rest >> np.uint32(8)
    rounded = (rest + (rest & np.uint32(0x80))) >> np.uint32(8)
    special, nan = rest >= 0x7F800000, rest > 0x7F800000
    body = np.where(special | (rounded >= 0x7F8000), cut, rounded)
    return sign | np.where(nan & ((cut & 0x7FFF) == 0), cut | 1, body).astype(np.uint32)


def from_float24(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.uint32) << np.uint32(8)).view(np.float32)


_PLANES = {UINT: 4, HALF: 2, FLOAT: 3}


def _rows(data: bytes, runs: list[tuple[int, int]]):
    at = 0
    for kind, n in runs:
        yield kind, np.frombuffer(data, DTYPES[kind], n, at)
        at += n * DTYPES[kind].itemsize


def _pxr24_encode(data: bytes, runs: list[tuple[int, int]], level: int) -> bytes:
    out = []
    for kind, row in _rows(data, runs):
        code = to_float24(row) if kind == FLOAT else row.view(np.uint16 if kind == HALF else np.uint32).astype(np.uint32)
        step = np.diff(code, prepend=np.uint32(0))
        out += [((step >> np.uint32(8 * p)) & np.uint32(255)).astype(np.uint8).tobytes() for p in reversed(range(_PLANES[kind]))]
    return zlib.compress(b"".join(out), level)


def _pxr24_decode(packed: bytes, runs: list[tuple[int, int]]) -> bytes:
    raw, at, out = np.frombuffer(zlib.decompress(packed), np.uint8), 0, []
    if len(raw) != sum(_PLANES[kind] * n for kind, n in runs):
        raise CorruptChunk("byte planes do not fit their size")
    for kind, n in runs:
        step = np.zeros(n, np.uint32)
        for _ in range(_PLANES[kind]):
            step = (step << np.uint32(8)) | raw[at : at + n]
            at += n
        code = np.cumsum(step, dtype=np.uint32)
        out.append((from_float24(code & np.uint32(0xFFFFFF)) if kind == FLOAT else code.astype(np.uint16) if kind == HALF else code).tobytes())
    return b"".join(out)


# differences kept of a 4 x 4 block: down its first column, then along each row
_PAIRS = [(0, 4), (4, 8), (8, 12), *((r + k, r + k + 1) for k in range(3) for r in (0, 4, 8, 12))]
_BIAS = 0x20


def _ordered(bits: np.ndarray) -> np.ndarray:
    """Half bits as integers in the order of their values; infinities and NaN count as zero."""
    special = (bits & 0x7C00) == 0x7C00
    return np.where(special, 0x8000, np.where(bits & 0x8000, 0xFFFF - bits, bits | 0x8000)).astype(np.int64)


def block_encode(blocks: np.ndarray, flat: bool) -> list[bytes]:
    """Blocks (n, 16) of half bits as 14 bytes each, or 3 where flat blocks are told apart.

    15 six-bit differences at the least shift at which all of them fit, below the block's greatest value.
    """
    t = _ordered(blocks)
    top = t.max(axis=1, keepdims=True)
    first, second = (np.array(p) for p in zip(*_PAIRS, strict=True))
    shift = np.full(len(t), -1)
    steps, lead = np.zeros((len(t), 15), np.int64), np.zeros(len(t), np.int64)
    for k in range(16):
        # halves round to even, as a shift of the doubled distance
        twice = (top - t) << 1
        d = (twice + (1 << k) - 1 + ((twice >> (k + 1)) & 1)) >> (k + 1)
        r = d[:, first] - d[:, second] + _BIAS
        new = (shift < 0) & (r.min(axis=1) >= 0) & (r.max(axis=1) <= 63)
        shift[new], steps[new], lead[new] = k, r[new], (top[:, 0] - (d[:, 0] << k))[new]
        if (shift >= 0).all():
            break
    fields = np.concatenate([shift[:, None], steps], axis=1)
    bits = ((fields[:, :, None] >> np.arange(5, -1, -1)) & 1).astype(np.uint8).reshape(len(t), 96)
    body = np.packbits(bits, axis=1)
    out = []
    for i in range(len(t)):
        if flat and (steps[i] == _BIAS).all():
            out.append(bytes((int(t[i, 0]) >> 8, int(t[i, 0]) & 255, 0xFC)))
        else:
            out.append(bytes((int(lead[i]) >> 8 & 255, int(lead[i]) & 255)) + body[i].tobytes())
    return out


def block_decode(packed: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    """n blocks from a place: (n, 16) half bits, and the place after them."""
    places, flat = [], []
    for _ in range(n):
        if at + 3 > len(packed):
            raise CorruptChunk("blocks end early")
        flat.append(packed[at + 2] >= 13 << 2)
        places.append(at)
        at += 3 if flat[-1] else 14
    if at > len(packed):
        raise CorruptChunk("blocks end early")
    raw = np.frombuffer(packed + bytes(14), np.uint8)
    rows = raw[np.array(places, np.int64)[:, None] + np.arange(14)] if n else np.zeros((0, 14), np.uint8)
    lead = rows[:, 0].astype(np.int64) << 8 | rows[:, 1]
    fields = np.unpackbits(rows[:, 2:], axis=1).reshape(n, 16, 6).astype(np.int64) @ (1 << np.arange(5, -1, -1))
    step = (fields[:, 1:] - _BIAS) << np.minimum(fields[:, :1], 15)
    t = np.zeros((n, 16), np.int64)
    t[:, 0] = lead
    for k, (a, b) in enumerate(_PAIRS):
        t[:, b] = t[:, a] + step[:, k]
    t = np.where(np.array(flat)[:, None], lead[:, None], t) & 0xFFFF if n else t
    return np.where(t & 0x8000, t & 0x7FFF, 0xFFFF - t).astype(np.uint16), at


def _planes(data: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, np.ndarray]]:
    """Each channel's rows as a plane; lines hold the channels in one order."""
    height = _height(runs)
    per = len(runs) // height
    rows = list(_rows(data, runs))
    return [(rows[c][0], np.stack([rows[y * per + c][1] for y in range(height)])) for c in range(per)]


def _height(runs: list[tuple[int, int]]) -> int:
    """Lines of a chunk, if all hold the same channels: the greatest number of equal parts."""
    n = len(runs)
    return next(n // p for p in range(1, n + 1) if n % p == 0 and runs == runs[:p] * (n // p))


def _b44_encode(data: bytes, runs: list[tuple[int, int]], flat: bool) -> bytes:
    out = []
    for kind, plane in _planes(data, runs):
        if kind != HALF:
            out.append(plane.tobytes())
            continue
        h, w = plane.shape
        full = np.pad(plane.view(np.uint16), ((0, -h % 4), (0, -w % 4)), mode="edge")
        out += block_encode(full.reshape(full.shape[0] // 4, 4, -1, 4).swapaxes(1, 2).reshape(-1, 16), flat)
    return b"".join(out)


def _b44_decode(packed: bytes, runs: list[tuple[int, int]]) -> bytes:
    height = _height(runs)
    per, at, planes = len(runs) // height, 0, []
    for kind, w in runs[:per]:
        if kind != HALF:
            size = DTYPES[kind].itemsize * w * height
            if at + size > len(packed):
                raise CorruptChunk("a plane ends early")
            planes.append(np.frombuffer(packed, DTYPES[kind], w * height, at).reshape(height, w))
            at += size
            continue
        down, across = -(-height // 4), -(-w // 4)
        blocks, at = block_decode(packed, at, down * across)
        planes.append(blocks.reshape(down, across, 4, 4).swapaxes(1, 2).reshape(down * 4, across * 4)[:height, :w])
    return b"".join(p[y].tobytes() for y in range(height) for p in planes)


def _piz_encode(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    """Lines of several channels as planes of 16-bit words, two a value of 32 bits."""
    return piz.encode([p.view("<u2").reshape(p.shape[0], p.shape[1], -1) for _, p in _planes(data, runs)])


def _piz_decode(packed: bytes, runs: list[tuple[int, int]]) -> bytes:
    height = _height(runs)
    planes = piz.decode(packed, [(height, w, DTYPES[kind].itemsize // 2) for kind, w in runs[: len(runs) // height]])
    return b"".join(p[y].astype("<u2").tobytes() for y in range(height) for p in planes)


def _dct_encode(data: bytes, level: int) -> bytes:
    """A DCT chunk whose channels are all kept without loss, as chunks without channel rules are."""
    packed = zlib.compress(data, level)
    return struct.pack(f"<{DCT_WORDS}QI", DCT_VERSION, len(data), len(packed), *[0] * 7, DCT_DEFLATE, 0) + packed


def _dct_decode(packed: bytes) -> bytes:
    version, size, kept, *rest = struct.unpack_from(f"<{DCT_WORDS}QI", packed)
    if version > DCT_VERSION:
        raise CorruptChunk(f"DCT chunk of version {version}")
    if any(rest[:7]):
        raise NotImplementedError("DCT chunk with lossy or run coded channels")
    at = struct.calcsize(f"<{DCT_WORDS}QI") + rest[-1]
    data = zlib.decompress(packed[at : at + kept])
    if len(data) != size:
        raise CorruptChunk(f"{len(data)} bytes for {size}")
    return data


def encode(data: bytes, codec: int, runs: list[tuple[int, int]] | None = None, layout: str = "native", level: int = 6) -> bytes:
    """Packs a chunk. runs: (pixel type, values) of each line and channel, which only 24-bit floats need."""
    if codec not in SUPPORTED:
        raise NotImplementedError(f"codec {codec}")
    raw = np.frombuffer(data, np.uint8)
    if codec == NONE or not len(raw):
        return data
    if codec == PXR24 and runs is not None:
        packed = _pxr24_encode(data, runs, level)
    elif codec == PIZ:
        packed = _piz_encode(data, runs)
    elif codec in (B44, B44A):
        packed = _b44_encode(data, runs, codec == B44A)
    elif codec in (DWAA, DWAB):
        packed = _dct_encode(data, level)
    elif codec == RLE:
        packed = run_encode(delta_encode(raw) if layout == "native" else delta_encode(split(raw), 128), layout)
    else:
        packed = zlib.compress((split(delta_encode(raw)) if layout == "native" else delta_encode(split(raw), 128)).tobytes(), level)
    return packed if len(packed) < len(data) else data


def decode(packed: bytes, size: int, codec: int, runs: list[tuple[int, int]] | None = None, layout: str = "native") -> bytes:
    """Unpacks a chunk to its size, or raises CorruptChunk."""
    if codec not in SUPPORTED:
        raise NotImplementedError(f"codec {codec}")
    if codec == NONE or len(packed) == size:
        data = packed
    elif codec == RLE:
        raw = run_decode(packed, size, layout)
        data = (delta_decode(raw) if layout == "native" else unsplit(delta_decode(raw, 128))).tobytes()
    else:
        try:
            if codec in (B44, B44A):
                data = _b44_decode(packed, runs)
            elif codec == PIZ:
                data = _piz_decode(packed, runs)
            elif codec in (DWAA, DWAB):
                data = _dct_decode(packed)
            elif codec == PXR24 and runs is not None:
                data = _pxr24_decode(packed, runs)
            else:
                raw = np.frombuffer(zlib.decompress(packed), np.uint8)
                data = (delta_decode(unsplit(raw)) if layout == "native" else unsplit(delta_decode(raw, 128))).tobytes()
        except CorruptChunk:
            raise
        except (zlib.error, ValueError, struct.error) as error:
            raise CorruptChunk(str(error)) from error
    if len(data) != size:
        raise CorruptChunk(f"{len(data)} bytes for {size}")
    return data
