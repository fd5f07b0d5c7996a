"""Suffix-array dedup: removes every byte that a string of LENGTH bytes covers which also starts earlier.

Suffixes are compared to a depth of LENGTH bytes only, and only suffixes that can have an equal are sorted at all:

1. Every window of LENGTH bytes holds 69 k-grams of 32 bytes; the least by hash, the leftmost if tied, is its anchor.
   Equal windows have equal anchors at equal distance, so the anchor's hash names the suffix bucket of a window. A
   document's windows fall into runs with the same anchor, about one for 35 bytes; one row a run is all that moves.
2. Buckets with a single run are done. Runs of a bucket with the same content and extent form a class: all but its
   first are repeats as a whole, so copies are never sorted.
3. Buckets with several classes are sorted one after another, by one member of each class. Strings are cut at the
   positions of a difference cover modulo 32, counted from the anchor; the strings of 68 bytes at cover positions are
   ranked once, and two windows are equal if the few bytes before the first cover position, the ranks at the first and
   at the last, and the few bytes after agree. So ties of any length cost as much as short ones, and memory is that of
   the bucket's own contexts.
4. A bucket of more than SORTED classes is not sorted in one task: its windows become rows, grouped by content with a
   map-side half.

Defined cases: a null text is empty; texts shorter than LENGTH lose nothing; rows that repeat a doc_id count as one
document; a null doc_id sorts as the smallest; extra columns are ignored; an empty table gives no rows. Long texts are
read in overlapping pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import having, mix64, span_hashes, stored, string_view, table

LENGTH, GRAM = 100, 32
GRAMS = LENGTH - GRAM + 1
MODULUS = 32
#: The most classes of a bucket that one task sorts.
SORTED = 4096
PIECE = 1 << 19
#: A run is kept as one number: anchor, and its distance from the run's first and last window.
_FIRST, _LAST = 14, 7
_MASK = (1 << 7) - 1
_NO_ID = -(1 << 63)


@cache
def difference_cover(modulus: int) -> tuple[int, ...]:
    """Residues such that every difference modulo `modulus` is one of two of them; found greedily, not least."""
    cover, missing = [0, 1], set(range(2, modulus - 1))
    while missing:
        best = max(range(modulus), key=lambda x: (x not in cover) * len(missing & {d % modulus for c in cover for d in (x - c, c - x)}))
        cover.append(best)
        missing -= {d % modulus for c in cover for d in (best - c, c - best)}
    return tuple(sorted(cover))


def pieces(keys: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts gathered to about PIECE bytes: (bytes, bounds of each part, document of each part, place of each part in it). Longer texts are cut, with LENGTH - 1 bytes in common."""
    parts: list[tuple[int, int, int, int]] = []
    size = 0

    def gathered() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        bounds = np.cumsum([0, *(b - a for _, a, b, _ in parts)])
        return np.concatenate([data[a:b] for _, a, b, _ in parts]), bounds, keys[[i for i, *_ in parts]], np.array([p for *_, p in parts])

    for i in range(len(keys)):
        start, end = int(offsets[i]), int(offsets[i + 1])
        for a in range(start, max(start + 1, end - LENGTH + 1), PIECE):
            b = min(end, a + PIECE + LENGTH - 1)
            if b - a < LENGTH:
                continue
            parts.append((i, a, b, a - start))
            size += b - a
            if size >= PIECE:
                yield gathered()
                parts, size = [], 0
    if parts:
        yield gathered()


def runs(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of windows with the same anchor: (hash of the anchor, anchor, first window, last window), none across bounds."""
    n = len(raw) - GRAM + 1
    least = span_hashes(raw, np.arange(n), np.arange(GRAM, n + GRAM))
    hashes, at = least, np.arange(n)
    step = 1
    while True:
        m = min(step, GRAMS - step)
        if m <= 0:
            break
        left = least[:-m] <= least[m:]
        least, at = np.where(left, least[:-m], least[m:]), np.where(left, at[:-m], at[m:])
        step += m
    # windows that start in a part and end in it
    inside = np.zeros(len(at) + 1, np.int64)
    first, last = bounds[:-1], np.maximum(bounds[:-1], bounds[1:] - LENGTH + 1)
    np.add.at(inside, np.minimum(first, len(at)), 1)
    np.add.at(inside, np.minimum(last, len(at)), -1)
    windows = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
    anchors = at[windows]
    begins = np.flatnonzero(np.append(True, (anchors[1:] != anchors[:-1]) | (windows[1:] != windows[:-1] + 1))) if len(windows) else np.zeros(0, np.int64)
    ends = np.append(begins[1:], len(windows)) - 1
    return hashes[anchors[begins]], anchors[begins], windows[begins], windows[ends] if len(windows) else begins


def anchored(docs: DataFrame) -> DataFrame:
    """A row for each run: h (anchor's hash), c (hash of the run's content and extent), doc, at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_view(batch.column(1))
            for raw, bounds, doc, place in pieces(batch.column(0).to_numpy(), data, offsets):
                h, a, lo, hi = runs(raw, bounds)
                part = np.searchsorted(bounds, lo, side="right") - 1
                extent = ((a - lo) << _LAST) | (a - hi)
                c = mix64(span_hashes(raw, lo, hi + LENGTH) + extent.astype(np.uint64))
                at = ((a - bounds[part] + place[part]) << _FIRST) | extent
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(doc[part]), pa.array(at)], ["h", "c", "doc", "at"])

    return docs.select("doc", "text").mapInArrow(run, "h long, c long, doc long, at long")


def sorted_bucket(bucket: np.ndarray, contexts: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which windows repeat one of an earlier row of the same bucket: a boolean for each row and start column.

    Row r of contexts holds the bytes around its anchor, which is at column GRAMS - 1; its windows start in columns
    GRAMS - 1 - first[r] to GRAMS - 1 - last[r]. Rows of a bucket are in the order in which they count as earlier.
    """
    rows, width = contexts.shape
    cover = [p for p in range(width) if p % MODULUS in difference_cover(MODULUS)]
    span = LENGTH - MODULUS
    low, high = GRAMS - 1 - first, GRAMS - 1 - last
    ranks: dict[int, np.ndarray] = {}

    def rank(p: int) -> np.ndarray:
        """Ranks of the strings of `span` bytes at a cover position, within buckets; precomputed on first use."""
        if p not in ranks:
            keyed = np.empty((rows, 8 + span), np.uint8)
            keyed[:, :8] = bucket.astype(">u8").view(np.uint8).reshape(rows, 8)
            keyed[:, 8:] = contexts[:, p : p + span]
            ranks[p] = np.unique(np.ascontiguousarray(keyed).view(f"V{8 + span}").ravel(), return_inverse=True)[1].ravel()
        return ranks[p]

    def packed(part: np.ndarray) -> np.ndarray:
        """Up to a few bytes as big-endian numbers, eight to a number."""
        out = np.zeros((len(part), (part.shape[1] + 7) // 8 * 8), np.uint8)
        out[:, : part.shape[1]] = part
        return out.view(">u8").astype(np.uint64)

    repeated = np.zeros((rows, GRAMS), bool)
    for col in range(GRAMS):
        live = np.flatnonzero((low <= col) & (col <= high))
        if len(live) < 2:
            continue
        p = next(x for x in cover if x >= col)
        q = max(x for x in cover if x + span <= col + LENGTH)
        keys = [bucket[live], rank(p)[live], rank(q)[live]]
        if p > col:
            keys += list(packed(contexts[live, col:p]).T)
        if q + span < col + LENGTH:
            keys += list(packed(contexts[live, q + span : col + LENGTH]).T)
        order = np.lexsort([live, *keys])
        same = np.ones(len(live) - 1, bool)
        for k in keys:
            same &= k[order[1:]] == k[order[:-1]]
        repeated[live[order[1:][same]], col] = True
    return repeated


def _spans(doc: np.ndarray, at: np.ndarray, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first byte, byte after) of runs of repeated windows in each row."""
    wide = np.zeros((len(doc), GRAMS + 2), np.int8)
    wide[:, 1:-1] = repeated
    edge = np.diff(wide, axis=1)
    r, begin = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    base = (at[r] >> _FIRST) - (GRAMS - 1)
    return doc[r], base + begin, base + end - 1 + LENGTH


def _contexts(chosen: DataFrame, docs: DataFrame, wide: bool) -> DataFrame:
    """Rows h, doc, at and context (the bytes around the anchor, in place) of the chosen runs; with wide a row for each window: w1, w2, doc, start."""
    wanted = stored(chosen.select("doc").distinct(), "wanted")
    places = chosen.groupBy("doc").agg(F.collect_list(F.struct("h", "at")).alias("runs"))
    both = having(docs.select("doc", "text").dropDuplicates(["doc"]), wanted, ["doc"]).join(places, "doc").select("doc", "text", "runs.h", "runs.at")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_view(batch.column(1))
            for i, doc in enumerate(batch.column(0).to_pylist()):
                raw = data[offsets[i] : offsets[i + 1]]
                h, at = (batch.column(x)[i].values.to_numpy() for x in (2, 3))
                a, first, last = at >> _FIRST, (at >> _LAST) & _MASK, at & _MASK
                if wide:
                    n = first - last + 1
                    start = np.repeat(a - first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    for lo in range(0, len(start), 1 << 15):
                        s = start[lo : lo + (1 << 15)]
                        # a stretch of the text at a time, so that long texts stay within bounds
                        base = int(s.min())
                        part = raw[base : int(s.max()) + LENGTH]
                        w1 = span_hashes(part, s - base, s - base + LENGTH)
                        w2 = mix64(span_hashes(part, s - base, s - base + LENGTH // 2) * np.uint64(3) + span_hashes(part, s - base + LENGTH // 2, s - base + LENGTH))
                        yield pa.RecordBatch.from_arrays([pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(np.full(len(s), doc)), pa.array(s)], ["w1", "w2", "doc", "start"])
                else:
                    for lo in range(0, len(a), 4096):
                        x, f, z = a[lo : lo + 4096], first[lo : lo + 4096], last[lo : lo + 4096]
                        texts = [raw[p - u : p - v + LENGTH].tobytes() for p, u, v in zip(x, f, z, strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(h[lo : lo + 4096]), pa.array(np.full(len(x), doc)), pa.array(at[lo : lo + 4096]), pa.array(texts, pa.binary())], ["h", "doc", "at", "context"])

    return both.mapInArrow(cut, "w1 long, w2 long, doc long, start long" if wide else "h long, doc long, at long, context binary")


def _sort_buckets(contexts: DataFrame) -> DataFrame:
    """(doc, a, b) of repeated bytes, from contexts that lie bucket by bucket, each in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(h: np.ndarray, doc: np.ndarray, at: np.ndarray, texts: list[bytes]) -> pa.RecordBatch:
            first, last = (at >> _LAST) & _MASK, at & _MASK
            block = np.zeros((len(h), GRAMS - 1 + LENGTH), np.uint8)
            for i, x in enumerate(texts):
                from_ = GRAMS - 1 - first[i]
                block[i, from_ : from_ + len(x)] = np.frombuffer(x, np.uint8)
            d, a, b = _spans(doc, at, sorted_bucket(np.unique(h, return_inverse=True)[1], block, first, last))
            return pa.RecordBatch.from_arrays([pa.array(d), pa.array(a), pa.array(b)], ["doc", "a", "b"])

        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]] = []
        size = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                h, doc, at = (part.column(i).to_numpy() for i in range(3))
                kept.append((h, doc, at, part.column(3).to_pylist()))
                size += len(h)
                if size < 2 * SORTED or h[0] == h[-1]:
                    continue
                # all buckets but the last are complete
                joined = [np.concatenate([k[i] for k in kept]) for i in range(3)]
                texts = [x for k in kept for x in k[3]]
                cut = int(np.flatnonzero(joined[0] != joined[0][-1])[-1]) + 1
                yield settle(*(x[:cut] for x in joined), texts[:cut])
                kept, size = [(*(x[cut:] for x in joined), texts[cut:])], len(texts) - cut
        if size:
            yield settle(*(np.concatenate([k[i] for k in kept]) for i in range(3)), [x for k in kept for x in k[3]])

    return contexts.repartition("h").sortWithinPartitions("h", "doc", "at").mapInArrow(run, "doc long, a long, b long")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, a, b): bytes from a to before b of a document are to go; spans may overlap. docs: (doc: long, text)."""
    found = anchored(docs)
    shared = stored(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "buckets")
    suspects = stored(found.join(shared.hint("merge"), "h"), "suspects")
    classes = stored(suspects.groupBy("h", "c").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("n")), "classes")
    # all but the first of a class go as a whole
    copies = suspects.join(classes.where("n > 1").select("h", "c", "first").hint("merge"), ["h", "c"]).where(F.struct("doc", "at") != F.col("first"))
    a, first, last = F.shiftright("at", _FIRST), F.shiftright("at", _LAST).bitwiseAND(_MASK), F.col("at").bitwiseAND(_MASK)
    whole = copies.select("doc", (a - first).alias("a"), (a - last + LENGTH).alias("b"))
    several = classes.groupBy("h").agg(F.count("*").alias("classes")).where("classes > 1")
    chosen = stored(classes.join(several.hint("merge"), "h").select("h", "classes", "first.doc", "first.at"), "chosen")
    spans = whole.unionByName(_sort_buckets(_contexts(chosen.where(F.col("classes") <= SORTED), docs, wide=False)))
    large = chosen.where(F.col("classes") > SORTED)
    if not large.isEmpty():
        windows = stored(_contexts(large, docs, wide=True), "windows")
        earliest = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
        again = windows.join(earliest.hint("merge"), ["w1", "w2"]).where(F.struct("doc", "start") != F.col("first"))
        spans = spans.unionByName(again.select("doc", F.col("start").alias("a"), (F.col("start") + LENGTH).alias("b")))
    return spans


def deduplicate(docs: DataFrame, text_out: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and with text_out kept, the bytes) of every row of docs."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("doc_id", F.lit(_NO_ID)).cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    spans = repeated_spans(keyed.select("doc", "text"))
    lists = stored(spans.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans")), "spans")
    both = keyed.join(lists.hint("merge"), "doc", "left").select("doc_id", "text", "spans.a", "spans.b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_view(batch.column(1))
            out: list[list] = [[], [], [], [], []]
            for i in range(batch.num_rows):
                raw, n = data[offsets[i] : offsets[i + 1]], 0
                a, b = (batch.column(x)[i].values for x in (2, 3))
                kept = raw
                removed = 0
                if a is not None and len(a):
                    # spans are in order of their start: a new run begins where the start is past all ends so far
                    a, b = np.minimum(a.to_numpy(), len(raw)), np.minimum(b.to_numpy(), len(raw))
                    reach = np.maximum.accumulate(b)
                    new = np.flatnonzero(np.append(True, a[1:] > reach[:-1]))
                    begin, end = a[new], reach[np.append(new[1:], len(a)) - 1]
                    n, removed = len(new), int((end - begin).sum())
                    mark = np.zeros(len(raw) + 1, np.int8)
                    mark[begin], mark[end] = 1, -1
                    kept = raw[np.cumsum(mark[:-1], dtype=np.int8) == 0]
                data_kept = kept.tobytes()
                for column, value in zip(out, (len(raw), removed, n, hashlib.sha256(data_kept).hexdigest(), data_kept if text_out else None), strict=True):
                    column.append(value)
            arrays = [batch.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string()), *([pa.array(out[4], pa.binary())] if text_out else [])]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if text_out else [])])

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if text_out else ""))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))
