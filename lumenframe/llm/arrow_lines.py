"""Lines of Arrow texts in numpy: what op 5's lines are held against in tests. The operator itself finds them in Spark's own functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lumenframe.llm.common import row_chunks, span_hashes, string_view

#: Characters of white space that are taken off a line one by one; longer stretches are looked up as a whole.
TRIM_STEPS = 64
_SPACE = np.zeros(256, bool)
_SPACE[[c for c in range(128) if chr(c).isspace()]] = True
_WIDE_SPACES = [chr(c).encode() for c in range(128, 0x3001) if chr(c).isspace()]


def _spaces(raw: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space."""
    out = _SPACE[raw]
    if len(raw) and raw.max() >= 128:
        lead = np.flatnonzero(np.isin(raw, [s[0] for s in _WIDE_SPACES]))
        for s in _WIDE_SPACES:
            at = lead[lead <= len(raw) - len(s)]
            for i, byte in enumerate(s):
                at = at[raw[at + i] == byte]
            for i in range(len(s)):
                out[at + i] = True
    return out


def _outer(raw: np.ndarray, start: np.ndarray, end: np.ndarray, back: bool) -> np.ndarray:
    """Bytes of the white space that each span (not empty) begins or, back, ends with: one character's, or none."""
    edge = raw[end - 1] if back else raw[start]
    n = _SPACE[edge].astype(np.int64)
    wide = np.flatnonzero(edge >= 128)
    for s in _WIDE_SPACES if len(wide) else ():
        at = wide[end[wide] - start[wide] >= len(s)]
        first = end[at] - len(s) if back else start[at]
        for i, byte in enumerate(s):
            same = raw[first + i] == byte
            at, first = at[same], first[same]
        n[at] = len(s)
    return n


def _trimmed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without their outer white space; those of white space alone are empty. Only their edges are looked at."""
    start, end = starts.copy(), ends.copy()
    for back in (False, True):
        some = np.flatnonzero(start < end)
        for _ in range(TRIM_STEPS):
            n = _outer(raw, start[some], end[some], back)
            some, n = some[n > 0], n[n > 0]
            if back:
                end[some] -= n
            else:
                start[some] += n
            some = some[start[some] < end[some]]
            if not len(some):
                break
        for i in some:
            solid = np.flatnonzero(~_spaces(raw[start[i] : end[i]]))
            start[i], end[i] = (start[i] + solid[0], start[i] + solid[-1] + 1) if len(solid) else (end[i], end[i])
    return start, end


def lines(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of row ranges of texts: (first row, bytes, row less the first, place, start, end, id) of each line that is not blank, trimmed and in lower case."""
    data, offsets = string_view(pc.utf8_lower(column))
    for a, b in row_chunks(offsets):
        raw, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        breaks = np.flatnonzero(raw == 10)
        starts, ends = np.sort(np.concatenate([bounds[:-1], breaks + 1])), np.sort(np.concatenate([breaks, bounds[1:]]))
        n = np.diff(np.searchsorted(breaks, bounds)) + 1
        row = np.repeat(np.arange(b - a), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        start, end = _trimmed(raw, starts, ends)
        full = np.flatnonzero(start < end)
        start, end = start[full], end[full]
        yield a, raw, row[full], place[full], start, end, span_hashes(raw, start, end).view(np.int64)
