"""The wavelet-Huffman codec of 16-bit words, in numpy: value bitmap, dense codes, 2-D wavelet, canonical Huffman code.

Every step works on whole arrays: a level of the wavelet is a few slices of the plane, a bit string is looked up at all
of its places at once, and only the walk from one code to the next is a loop.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

#: Code lengths are packed in six bits; 59 to 62 stand for 2 to 5 lengths of zero, 63 and a byte for 6 and more (fixed values of the format).
_BITS, _SHORT, _LONG, _LONG_FROM, _LONG_MOST = 6, 59, 63, 6, 261
_SYMBOLS = 1 << 16
_MOST_BITS = 58


# --- wavelet ----------------------------------------------------------------------------------------------------------
def _join14(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and difference of numbers that are signed and below 2**14."""
    return (a + b) >> 1, a - b


def _part14(mean: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = mean + (step & 1) + (step >> 1)
    return a, a - step


def _join16(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and difference modulo 2**16."""
    a = (a + 0x8000) & 0xFFFF
    mean, step = (a + b) >> 1, a - b
    return np.where(step < 0, (mean + 0x8000) & 0xFFFF, mean), step & 0xFFFF


def _part16(mean: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    b = (mean - (step >> 1)) & 0xFFFF
    return (step + b - 0x8000) & 0xFFFF, b


def _levels(shape: tuple[int, int]) -> list[int]:
    """Distances between the numbers that each level joins, the finest first."""
    return [1 << k for k in range((min(shape)).bit_length() - 1)]


def _step(plane: np.ndarray, p: int, both, forward: bool) -> None:
    """One level, in place: 2 x 2 groups, then the column and the row that have no partner."""
    h, w = plane.shape
    down, across = h // (2 * p) * 2 * p, w // (2 * p) * 2 * p
    upper, lower = slice(0, down, 2 * p), slice(p, down, 2 * p)
    left, right = slice(0, across, 2 * p), slice(p, across, 2 * p)
    corners = [(upper, left), (upper, right), (lower, left), (lower, right)]
    # along rows first when coding, along columns first when decoding
    for i, j in ((0, 1), (2, 3), (0, 2), (1, 3)) if forward else ((0, 2), (1, 3), (0, 1), (2, 3)):
        plane[corners[i]], plane[corners[j]] = both(plane[corners[i]], plane[corners[j]])
    if w & p:
        plane[upper, across], plane[lower, across] = both(plane[upper, across], plane[lower, across])
    if h & p:
        plane[down, left], plane[down, right] = both(plane[down, left], plane[down, right])


def wavelet_encode(plane: np.ndarray, most: int) -> np.ndarray:
    """The transform of a plane of 16-bit words none of which is above most."""
    small = most < 1 << 14
    work = plane.astype(np.uint16).view(np.int16).astype(np.int64) if small else plane.astype(np.int64)
    for p in _levels(plane.shape):
        _step(work, p, _join14 if small else _join16, True)
        work = work.astype(np.int16).astype(np.int64) if small else work
    return (work & 0xFFFF).astype(np.uint16)


def wavelet_decode(plane: np.ndarray, most: int) -> np.ndarray:
    small = most < 1 << 14
    work = plane.astype(np.uint16).view(np.int16).astype(np.int64) if small else plane.astype(np.int64)
    for p in reversed(_levels(plane.shape)):
        _step(work, p, _part14 if small else _part16, False)
        work = work.astype(np.int16).astype(np.int64) if small else work
    return (work & 0xFFFF).astype(np.uint16)


# --- Huffman ----------------------------------------------------------------------------------------------------------
def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of an optimal prefix code for symbols that occur; a lone symbol has one bit."""
    lengths = np.zeros(len(counts), np.int64)
    some = np.flatnonzero(counts)
    if len(some) < 2:
        lengths[some] = 1
        return lengths
    heap = [(int(counts[s]), k) for k, s in enumerate(some)]
    heapq.heapify(heap)
    parent, nodes = {}, len(some)
    while len(heap) > 1:
        (m, a), (n, b) = heapq.heappop(heap), heapq.heappop(heap)
        parent[a] = parent[b] = nodes
        heapq.heappush(heap, (m + n, nodes))
        nodes += 1
    depth = {nodes - 1: 0}
    for k in range(nodes - 2, -1, -1):
        depth[k] = depth[parent[k]] + 1
    lengths[some] = [depth[k] for k in range(len(some))]
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code of each symbol, and the first code of each length: the longest codes come first in number."""
    n = np.bincount(lengths, minlength=_MOST_BITS + 1)
    first, at = np.zeros(_MOST_BITS + 1, np.int64), 0
    for bits in range(_MOST_BITS, 0, -1):
        first[bits] = at
        at = (at + int(n[bits])) >> 1
    codes = np.zeros(len(lengths), np.int64)
    for bits in np.flatnonzero(n[1:]) + 1:
        of = np.flatnonzero(lengths == bits)
        codes[of] = first[bits] + np.arange(len(of))
    return codes, first


def _packed_bits(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """Numbers of so many bits each, one after another, the highest bit first."""
    sizes = sizes.astype(np.int64)
    back = np.repeat(np.cumsum(sizes), sizes) - 1 - np.arange(int(sizes.sum()))
    return np.packbits(((np.repeat(values.astype(np.int64), sizes) >> back) & 1).astype(np.uint8)).tobytes()


def _pack_table(lengths: np.ndarray) -> bytes:
    """Code lengths in six bits each, stretches of zeros in a code of their own."""
    values, sizes = [], []
    edges = np.flatnonzero(np.diff(lengths == 0, prepend=False, append=False))
    zeros = dict(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
    at = 0
    while at < len(lengths):
        n = min(zeros.get(at, at) - at, _LONG_MOST)
        if n >= _LONG_FROM:
            values += [_LONG, n - _LONG_FROM]
            sizes += [_BITS, 8]
        elif n >= 2:
            values.append(_SHORT + n - 2)
            sizes.append(_BITS)
        else:
            values.append(int(lengths[at]))
            sizes.append(_BITS)
            n = 1
        if at + n in zeros or at + n >= len(lengths) or lengths[at + n]:
            at += n
        else:
            # a stretch longer than one code holds goes on
            zeros[at + n] = zeros[at]
            at += n
    return _packed_bits(np.array(values), np.array(sizes))


def _unpack_table(packed: bytes, least: int, most: int) -> np.ndarray:
    bits = int.from_bytes(packed, "big")
    left, lengths, at = 8 * len(packed), np.zeros(_SYMBOLS + 1, np.int64), least
    while at <= most:
        left -= _BITS
        if left < 0:
            raise ValueError("a table of code lengths ends early")
        value = (bits >> left) & 63
        if value == _LONG:
            left -= 8
            at += ((bits >> left) & 255) + _LONG_FROM if left >= 0 else _SYMBOLS + 2
        elif value >= _SHORT:
            at += value - _SHORT + 2
        else:
            lengths[at] = value
            at += 1
    if at > most + 1:
        raise ValueError("a table of code lengths runs over")
    return lengths


def huffman_encode(symbols: np.ndarray) -> bytes:
    """A block: least and greatest symbol, table size, bits, a reserved word, the packed table, the bits. The greatest symbol stands for runs and is not used."""
    counts = np.bincount(symbols, minlength=_SYMBOLS + 1)
    some = np.flatnonzero(counts)
    least, most = int(some[0]), int(some[-1]) + 1
    counts[most] = 1
    lengths = code_lengths(counts)
    codes, _ = canonical(lengths)
    table = _pack_table(lengths[least : most + 1])
    size = lengths[symbols]
    return struct.pack("<5I", least, most, len(table), int(size.sum()), 0) + table + _packed_bits(codes[symbols], size)


def huffman_decode(block: bytes, n: int) -> np.ndarray:
    """The n symbols of a block. Runs (the greatest symbol, then a byte that counts) repeat the symbol before."""
    if len(block) < 20:
        raise ValueError("a Huffman block ends early")
    least, most, size, bits, _ = struct.unpack_from("<5I", block)
    if most > _SYMBOLS or least > most or 20 + size + (bits + 7) // 8 > len(block):
        raise ValueError("a Huffman block does not fit its header")
    lengths = _unpack_table(block[20 : 20 + size], least, most)
    codes, first = canonical(lengths)
    raw = np.frombuffer(block, np.uint8, (bits + 7) // 8, 20 + size)
    told = np.unpackbits(raw)[:bits]
    symbol, after = np.full(bits, -1, np.int64), np.full(bits, bits + 1, np.int64)
    window, reach = np.zeros(bits, np.int64), 0
    padded = np.concatenate([told, np.zeros(_MOST_BITS, np.uint8)]).astype(np.int64)
    for length in np.unique(lengths[lengths > 0]):
        for k in range(reach, int(length)):
            window = (window << 1) | padded[k : k + bits]
        reach = int(length)
        of = np.flatnonzero(lengths == length)
        rank = window - first[length]
        hit = np.flatnonzero((symbol < 0) & (rank >= 0) & (rank < len(of)))
        symbol[hit], after[hit] = of[rank[hit]], hit + length
    out, at = np.empty(n, np.uint16), 0
    found, steps, k = symbol.tolist(), after.tolist(), 0
    while k < n:
        if at >= bits or found[at] < 0 or steps[at] > bits:
            raise ValueError("Huffman codes end early")
        s, at = found[at], steps[at]
        if s == most:
            run = int("".join(map(str, told[at : at + 8].tolist())), 2) if at + 8 <= bits else 0
            if not k or not run or k + run > n:
                raise ValueError("a run does not fit")
            out[k : k + run] = out[k - 1]
            at, k = at + 8, k + run
        else:
            out[k] = s
            k += 1
    return out


# --- chunks -----------------------------------------------------------------------------------------------------------
def encode(planes: list[np.ndarray]) -> bytes:
    """planes: (lines, columns, words a value) of 16-bit words, one a channel."""
    words = np.concatenate([p.ravel() for p in planes])
    present = np.zeros(_SYMBOLS, bool)
    present[words] = True
    present[0] = True
    dense = np.cumsum(present) - 1
    present[0] = False
    bitmap = np.packbits(present, bitorder="little")
    used = np.flatnonzero(bitmap)
    least, most = (int(used[0]), int(used[-1])) if len(used) else (len(bitmap), 0)
    top = int(dense[-1])
    out = []
    for p in planes:
        coded = dense[p].astype(np.uint16)
        for k in range(p.shape[2]):
            coded[:, :, k] = wavelet_encode(coded[:, :, k], top)
        out.append(coded.ravel())
    block = huffman_encode(np.concatenate(out))
    return struct.pack("<2H", least, most) + (bitmap[least : most + 1].tobytes() if least <= most else b"") + struct.pack("<I", len(block)) + block


def decode(packed: bytes, shapes: list[tuple[int, int, int]]) -> list[np.ndarray]:
    """The planes of a chunk, of the shapes given."""
    least, most = struct.unpack_from("<2H", packed)
    at, bitmap = 4, np.zeros(_SYMBOLS // 8, np.uint8)
    if most >= len(bitmap):
        raise ValueError("a bitmap does not fit")
    if least <= most:
        bitmap[least : most + 1] = np.frombuffer(packed, np.uint8, most - least + 1, at)
        at += most - least + 1
    present = np.unpackbits(bitmap, bitorder="little").astype(bool)
    present[0] = True
    values = np.flatnonzero(present).astype(np.uint16)
    size = struct.unpack_from("<I", packed, at)[0]
    words = huffman_decode(packed[at + 4 : at + 4 + size], sum(h * w * k for h, w, k in shapes))
    out, begin = [], 0
    for h, w, k in shapes:
        plane = words[begin : begin + h * w * k].reshape(h, w, k).copy()
        begin += h * w * k
        for i in range(k):
            plane[:, :, i] = wavelet_decode(plane[:, :, i], len(values) - 1)
        out.append(values[np.minimum(plane, len(values) - 1)])
    return out
