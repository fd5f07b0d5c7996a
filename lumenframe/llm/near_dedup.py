"""MinHash near-dedup with HyperMinHash sketches.

Documents are sets of five-word shingles, hashed to 64 bits. A sketch has 128 registers (one permutation, split by the
hash's first bits); each keeps the least rest of a hash as its count of leading zeros and ten bits of mantissa (Yu and
Weber 2017), and an empty register borrows from the next filled one. Bands of four compressed registers are bucket
keys. Documents with equal sets are one class from the start, so copies never meet as pairs. Classes that share a
bucket are candidates: all pairs in buckets of at most ALL_PAIRS classes, links to the bucket's leaders in larger ones.
Candidates whose collision-corrected estimate is out of reach of the threshold are dropped, the rest are confirmed on
their full sets, and distributed union-find gives the components. Then all pairs, in blocks, of members of larger
buckets that are still in different components are compared.

At the threshold itself a pair misses all 32 bands with probability (1 - 0.75^4)^32 = 5e-6.

Defined cases: a null or empty text, or one without words, has no shingle and links with nothing; one with fewer than
five words has its whole sequence as its one shingle; rows that repeat a doc_id are linked through it if either is; a
null doc_id is kept as a row of its own without links; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import components, having, mix64, row_chunks, span_hashes, stored, string_view, table

SHINGLE, THRESHOLD = 5, 75
REGISTERS, BAND = 128, 4
MANTISSA = 10
#: In buckets of at most so many classes every pair is a candidate.
ALL_PAIRS = 16
#: Members of a larger bucket, and about so many bytes of their sets, that a task compares with as many others at a time.
BLOCK, BLOCK_BYTES = 512, 64 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: One multiplier for each place in a shingle; no sum of some may equal that of others, so they are drawn, not spaced.
_ODD = mix64(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For row ranges of texts: the first row, and each row's sorted distinct shingle hashes."""
    data, offsets = string_view(column)
    for a, b in row_chunks(offsets):
        raw = _LOWER[data[offsets[a] : offsets[b]]]
        bounds = offsets[a : b + 1] - offsets[a]
        first = np.zeros(len(raw) + 1, bool)
        first[bounds] = True
        word = ~_SPACE[raw]
        starts = np.flatnonzero(word & (~np.append(False, word)[:-1] | first[:-1]))
        ends = np.flatnonzero(word & (~np.append(word, False)[1:] | first[1:])) + 1
        hashes = span_hashes(raw, starts, ends)
        at = np.searchsorted(starts, bounds)
        wide = np.zeros(max(0, len(hashes) - SHINGLE + 1), np.uint64)
        for i in range(SHINGLE):
            wide += hashes[i : i + len(wide)] * _ODD[i]
        wide = mix64(wide)
        out = []
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            if hi - lo >= SHINGLE:
                out.append(np.unique(wide[lo : hi - SHINGLE + 1]))
            elif hi > lo:
                out.append(mix64((hashes[lo:hi] * _ODD[: hi - lo]).sum(keepdims=True, dtype=np.uint64) + np.uint64(hi - lo)))
            else:
                out.append(np.zeros(0, np.uint64))
        yield a, out


def registers(hashes: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers, a row of uint16 for each sorted set of at least one hash."""
    shift = np.uint64(64 - REGISTERS.bit_length() + 1)
    edges = np.arange(REGISTERS, dtype=np.uint64) << shift
    low = np.empty((len(hashes), REGISTERS), np.uint64)
    filled = np.empty((len(hashes), REGISTERS), bool)
    for i, h in enumerate(hashes):
        at = np.searchsorted(h, edges)
        low[i] = h[np.minimum(at, len(h) - 1)]
        filled[i] = (at < len(h)) & (low[i] >> shift == np.arange(REGISTERS, dtype=np.uint64))
    rest = ((low & ((np.uint64(1) << shift) - np.uint64(1))) >> np.uint64(5)).astype(float)
    bits = int(shift) - 5
    mantissa, exponent = np.frexp(rest)
    zeros = np.minimum(np.where(rest > 0, bits - exponent, 63), 63)
    packed = (zeros.astype(np.int64) << MANTISSA) + np.where(rest > 0, (mantissa * 2 - 1) * (1 << MANTISSA), 0).astype(np.int64)
    # an empty register takes the value of the next filled one, going round
    place = np.where(filled, np.arange(REGISTERS), 2 * REGISTERS)
    after = np.minimum.accumulate(np.concatenate([place, place + REGISTERS], 1)[:, ::-1], 1)[:, ::-1][:, :REGISTERS] % REGISTERS
    return np.take_along_axis(packed, after, 1).astype(np.uint16)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each sketch."""
    packed = np.ascontiguousarray(sketch).view(np.uint64)
    return mix64(packed + (np.arange(packed.shape[1], dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates from rows of registers, less the share of equal registers that chance alone gives."""
    same = (a == b).mean(-1)
    chance = 1.0 / (1 << MANTISSA) / 3
    return np.clip((same - chance) / (1 - chance), 0, 1)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), k1 and k2 (the set's own 128-bit key), sketch (binary; null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, sets in shingle_sets(batch.column(1)):
                some = [i for i, s in enumerate(sets) if len(s)]
                rows = registers([sets[i] for i in some]) if some else np.zeros((0, REGISTERS), np.uint16)
                packed: list[bytes | None] = [None] * len(sets)
                for i, r in zip(some, rows, strict=True):
                    packed[i] = r.tobytes()
                k1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                k2 = np.array([mix64(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1), pa.array(k2), pa.array(packed, pa.binary())], ["doc_id", "n", "k1", "k2", "sketch"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n long, k1 long, k2 long, sketch binary")


def _bands(classes: DataFrame) -> DataFrame:
    """(key, id, n) for each band of each class (id, n, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                keys = band_keys(np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint16).reshape(-1, REGISTERS)).view(np.int64)
                again = np.repeat(np.arange(part.num_rows), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), part.column(0).take(pa.array(again)), part.column(1).take(pa.array(again))], ["key", "id", "n"])

    return classes.select("id", "n", "sketch").mapInArrow(run, "key long, id long, n long")


def _in_reach(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sketches leave the threshold in reach: within five standard errors of the estimate."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n").alias(f"n{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
            n = np.minimum(np.minimum(batch.column(4).to_numpy(), batch.column(5).to_numpy()), REGISTERS)
            t = THRESHOLD / 100
            keep = estimate(a, b) >= t - 5 * np.sqrt(t * (1 - t) / n)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, hashes): the full sets of the documents asked for. Texts of those alone are moved."""
    texts = having(docs.selectExpr("cast(doc_id as long) doc_id", "text"), ids, ["doc_id"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, found in shingle_sets(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(found)), pa.array([s.tobytes() for s in found], pa.binary())], ["id", "hashes"])

    return stored(texts.mapInArrow(sets, "id long, hashes binary").dropDuplicates(["id"]), "sets")


def linked(p: np.ndarray, q: np.ndarray, threshold: int) -> bool:
    """Whether two sorted sets reach the threshold in percent."""
    if len(p) > len(q):
        p, q = q, p
    if 100 * len(p) < threshold * len(q):
        return False
    at = np.minimum(np.searchsorted(q, p), len(q) - 1)
    inter = int((q[at] == p).sum())
    return 100 * inter >= threshold * (len(p) + len(q) - inter)


def _in_blocks(large: DataFrame, joined: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """Confirmed links (a, b) between members of one bucket of large (key, id, n) that joined leaves in different components.

    A bucket is dealt into blocks of bounded members and bytes and every two blocks are a task's group, so none holds a
    whole bucket. A group compares every pair that its components still hold apart, by registers and then by full sets;
    what it links is one component from there on, so it returns fewer links than it has members.
    """
    held = stored(large.select("key", "id", "n").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id")), "held")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias("blocks")
    several = stored(held.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), blocks).where("x <> y").select("key", "blocks"), "several")
    members = held.join(several, "key")
    full = _sets(docs, stored(members.select(F.col("id").alias("doc_id")).distinct(), "ids"))
    rows = members.join(full.hint("merge"), "id").withColumn("block", F.expr("cast(pmod(xxhash64(id), blocks) as int)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "component", "hashes")
    t = threshold / 100

    def run(group: pa.Table) -> pa.Table:
        block, ids = group.column("block").to_numpy(), group.column("id").to_numpy()
        component = np.unique(group.column("component").to_numpy(), return_inverse=True)[1].ravel()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("hashes")]
        sketch, n = registers(sets), np.array([len(x) for x in sets])
        keys = band_keys(sketch)
        band = int(np.argmax(keys[0] == np.uint64(group.column("key")[0].as_py() & (2**64 - 1))))
        p, q = np.flatnonzero(block == group.column("lo")[0].as_py()), np.flatnonzero(block == group.column("hi")[0].as_py())
        found: list[tuple[int, int]] = []
        for i in p:
            few, many = np.minimum(n[i], n[q]), np.maximum(n[i], n[q])
            mate = q[(component[i] != component[q]) & (few >= t * many)]
            if not len(mate):
                continue
            near = estimate(sketch[i], sketch[mate])
            some = near >= t - 5 * np.sqrt(t * (1 - t) / np.minimum(np.minimum(n[i], n[mate]), REGISTERS))
            # pairs that share an earlier band have been compared in its bucket
            some[some] &= ~(keys[i, :band] == keys[mate[some], :band]).any(1)
            # the nearest first: a link settles all pairs of its two components
            for j in mate[some][np.argsort(-near[some], kind="stable")]:
                if component[i] != component[j] and linked(sets[i], sets[j], threshold):
                    found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                    component[component == component[j]] = component[i]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return rows.groupBy("key", "lo", "hi").applyInArrow(run, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of documents whose full sets reach the threshold."""
    full = _sets(docs, stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids"))
    side = lambda x: full.select(F.col("id").alias(x), F.col("hashes").alias(f"h{x}"))
    both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").select("a", "b", "ha", "hb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), threshold) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(check, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    base = stored(sketches(docs), "sketches")
    live = base.where("n > 0 and doc_id is not null")
    classes = stored(live.groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "sketch")).alias("m")).select(F.col("m.doc_id").alias("id"), "n", F.col("m.sketch").alias("sketch"), "k1", "k2"), "classes")
    bands = _bands(classes)
    least = 100 / threshold
    buckets = stored(bands.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("first"), F.max("id").alias("last")).where("size > 1"), "buckets")
    # two members are a pair already; only larger buckets are joined back to their members
    two = buckets.where("size = 2").select(F.col("first").alias("a"), F.col("last").alias("b"))
    more = stored(bands.join(buckets.where("size > 2"), "key"), "members")
    small = more.where(F.col("size") <= ALL_PAIRS).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("m"))
    pair = F.flatten(F.transform("m", lambda x, i: F.transform(F.filter(F.slice("m", i + 2, ALL_PAIRS), lambda y: (y["n"] <= x["n"] * least) & (x["n"] <= y["n"] * least)), lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b")))))
    inside = small.select(F.explode(pair).alias("p")).select("p.a", "p.b")
    large = more.where(F.col("size") > ALL_PAIRS)
    star = large.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).unionByName(large.where("id <> last").select(F.col("id").alias("a"), F.col("last").alias("b")))
    pairs = stored(_in_reach(two.unionByName(inside).unionByName(star).distinct(), classes), "pairs")
    # first one pair for each document: with copies by the thousand that joins most of them
    nearest = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    edges = stored(_confirmed(nearest, docs, threshold), "edges")
    joined = components(edges)
    label = lambda x: joined.select(F.col("id").alias(x), F.col("component").alias(f"c{x}"))
    apart = stored(pairs.join(label("a"), "a", "left").join(label("b"), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b"), "apart")
    if not apart.isEmpty():
        edges = stored(edges.unionByName(_confirmed(apart, docs, threshold)), "edges")
        joined = components(edges)
    more = stored(_in_blocks(large, joined, docs, threshold), "edges")
    if not more.isEmpty():
        joined = components(edges.unionByName(more))
    named = classes.join(joined, "id", "left").select("k1", "k2", "n", F.coalesce("component", "id").alias("component_id"))
    # a class of a third of all documents is one key here: its rows are split by Spark's skew handling
    found = base.join(named.hint("merge"), ["k1", "k2", "n"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN list_aggregate(w, 'string_agg', ' ') ELSE list_aggregate(list_slice(w, i, i + 4), 'string_agg', ' ') END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4)::BIGINT + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS c FROM n UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id WHERE r.c < l.b),
c AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.id = d.doc_id
"""
