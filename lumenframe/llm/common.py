"""Helpers that the text operators share: tables, shared storage, text hashing, linking."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python workers look at about this many bytes of text at a time.
CHUNK_BYTES = 1 << 19


#: Rows and bytes of text that a Python worker is sent at a time. Spark's own 10,000 rows may be a gigabyte of long texts.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a session, so that workers need no copy of their own, and bounds what workers are sent at a time."""
    context = spark.sparkContext
    for key, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))
    if getattr(context, "_lumenframe_shipped", False):
        return
    top = Path(__file__).parents[1]
    target = Path(tempfile.mkdtemp(prefix="lumenframe-")) / "lumenframe.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(top.rglob("*.py")):
            archive.write(source, source.relative_to(top.parent))
    context.addPyFile(str(target))
    context._lumenframe_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every machine sees: spark.checkpoint.dir. Sets one only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        found = tempfile.mkdtemp(prefix="lumenframe-")
        spark.sparkContext.setCheckpointDir(found)
        return found
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/lumenframe/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df to the shared folder and reads it back. A lost executor loses none of it."""
    path, conf = fresh_path(df.sparkSession, name), df.sparkSession.conf
    # what the write has shuffled goes when it has ended
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(CLEANUP, before)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._lumenframe_path = path
    return made


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for made in tables:
        path = made.sparkSession._jvm.org.apache.hadoop.fs.Path(made._lumenframe_path)
        path.getFileSystem(made.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def string_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copies; a null row is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer row is a range of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalising step of splitmix64, over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        have = tuple(np.full(size, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        for x in have:
            x[0] = 1
            np.multiply.accumulate(x, out=x)
        if size <= 4 * CHUNK_BYTES:
            _powers[0] = have
    return have


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span, from one running polynomial sum."""
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * inverse[starts]
    return mix64(raw ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def _links(edges: DataFrame) -> DataFrame:
    """Distinct links (a, b) with a > b. Self links and nulls are ignored."""
    return stored(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")


def _star_round(links: DataFrame) -> DataFrame:
    """A large star, in which each node hands its larger neighbours to the smallest id it knows, and a small star, in which it does so with the smaller ones."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # no more rows than links, and the last step takes repeated ones out
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    parent = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(parent, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return stored(small.unionByName(parent.select("a", F.col("m").alias("b"))).distinct(), "links")


def shortened(edges: DataFrame, rounds: int) -> DataFrame:
    """Links (a, b) with the same components as edges after so many rounds of stars, most of them straight to the component's smallest id."""
    links = _links(edges)
    for _ in range(rounds):
        links = _star_round(links)
    return links


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b: long): rows (id, component), the smallest id of each component.

    Distributed union-find by alternating stars. Both kinds keep the components and flatten the trees, so the rounds
    follow the logarithm of a component's size. State is a table in the shared folder after each round; only a
    count and a checksum come to the driver. Ids without an edge are not returned; self links and nulls are ignored.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())

    links = _links(edges)
    seen = mark(links)
    for _ in range(rounds):
        links = _star_round(links)
        now = mark(links)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    flat = links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return flat.unionByName(links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


#: A set of ids up to this many rows (8 MB of longs) may be broadcast; larger sets are shuffled.
BROADCAST_IDS = 500_000


def having(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of df whose key is among the distinct rows of keys (a stored table): broadcast behind a check of its size, else shuffled."""
    small = keys.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(keys) if small else keys.hint("merge"), on, "left_semi")
