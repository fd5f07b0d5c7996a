"""Id manifests: 128-bit name hashes and the packed form (zlib over little-endian groups, lists and entries)."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

_M = (1 << 64) - 1
VERSION = 1


@dataclass
class Group:
    channels: list[str]
    components: list[str]
    entries: dict[int, list[str]] = field(default_factory=dict)
    lifetime: int = 0
    hash_scheme: str = ""
    encoding_scheme: str = ""


def murmur3_128(data: bytes, seed: int = 0) -> tuple[int, int]:
    """MurmurHash3 x64 of 128 bits, as two unsigned words."""
    c = (0x87C37B91114253D5, 0x4CF5AD432745937F)
    turn = lambda x, n: (x << n | x >> (64 - n)) & _M

    def mixed(word: int, lane: int) -> int:
        return turn(word * c[lane] & _M, (31, 33)[lane]) * c[1 - lane] & _M

    def final(x: int) -> int:
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ x >> 33) * factor & _M
        return x ^ x >> 33

    a = b = seed
    whole = len(data) // 16 * 16
    for low, high in struct.iter_unpack("<QQ", data[:whole]):
        a = ((turn(a ^ mixed(low, 0), 27) + b) * 5 + 0x52DCE729) & _M
        b = ((turn(b ^ mixed(high, 1), 31) + a) * 5 + 0x38495AB5) & _M
    # a tail is filled up with zeros, which mix to nothing
    low, high = struct.unpack("<QQ", data[whole:].ljust(16, b"\0"))
    a, b = a ^ mixed(low, 0) ^ len(data), b ^ mixed(high, 1) ^ len(data)
    a = (a + b) & _M
    b = (b + a) & _M
    a, b = final(a), final(b)
    a = (a + b) & _M
    return a, (b + a) & _M


def _string(s: str) -> bytes:
    raw = s.encode()
    return struct.pack("<I", len(raw)) + raw


def _strings(values: list[str]) -> bytes:
    return struct.pack("<I", len(values)) + b"".join(map(_string, values))


def encode(groups: list[Group]) -> bytes:
    """Entries go by ascending id, so equal manifests have equal bytes."""
    out = [struct.pack("<II", VERSION, len(groups))]
    for g in groups:
        out += [_strings(g.channels), _strings(g.components), bytes([g.lifetime]), _string(g.hash_scheme), _string(g.encoding_scheme), struct.pack("<Q", len(g.entries))]
        out += [struct.pack("<Q", k) + _strings(g.entries[k]) for k in sorted(g.entries)]
    return zlib.compress(b"".join(out))


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def number(self, form: str) -> int:
        value = struct.unpack_from(form, self.data, self.at)[0]
        self.at += struct.calcsize(form)
        return value

    def string(self) -> str:
        n = self.number("<I")
        if self.at + n > len(self.data):
            raise ValueError("a manifest's string ends early")
        self.at += n
        return self.data[self.at - n : self.at].decode()

    def strings(self) -> list[str]:
        return [self.string() for _ in range(self.number("<I"))]


def decode(packed: bytes) -> list[Group]:
    """Raises ValueError for what is no manifest."""
    try:
        reader = _Reader(zlib.decompress(packed))
        if (version := reader.number("<I")) != VERSION:
            raise ValueError(f"manifest version {version}")
        groups = []
        for _ in range(reader.number("<I")):
            g = Group(reader.strings(), reader.strings())
            g.lifetime, g.hash_scheme, g.encoding_scheme = reader.number("<B"), reader.string(), reader.string()
            for _ in range(reader.number("<Q")):
                key = reader.number("<Q")
                g.entries[key] = reader.strings()
            groups.append(g)
        return groups
    except (struct.error, zlib.error) as error:
        raise ValueError(f"no manifest: {error}") from error
