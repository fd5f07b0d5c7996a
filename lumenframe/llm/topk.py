"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors are cut into segments, coarse to fine. With a segment's mean and deviation the distance of two vectors has the
lower bound sum L ((m_q - m_x)^2 + (s_q - s_x)^2), and as 2 q.x = |q|^2 + |x|^2 - d^2 the score has an upper bound. A
worker keeps each query's k-th best score so far; a pair of query and candidate is dropped at the first level whose
bound lies below it, and exact integer scores are computed for the pairs that survive. Bounds are widened by more than
rounding can take.

Queries and candidates are packed into blocks of bounded size, as rows. Each block of queries meets each block of
candidates in one of many groups, dealt by (block of queries, salt); a task streams the candidates' blocks past the
queries', keeps the best k of each query and returns them, and those are merged by a top-k that is partial before the
shuffle. The vectors are read once, nothing comes to the driver but counts, and no block is broadcast.

Defined cases: vectors that are null, of another width than the most frequent, or hold null or non-finite components
take no part; a component whose 64-fold or a score that does not fit a long raises; with fewer than k candidates all
come out; equal vectors tie by id; repeated ids are all candidates but none of them for its own id, and one query;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import partitions, ship, stored, table

#: Vectors of a block of queries (with 64 components, 2 MB) and of candidates, and segments of each level.
QUERY_BLOCK = 4096
ROWS = 1024
LEVELS = (4, 16)
#: Where fewer than this share of a block's pairs survive they are scored one by one, else by one product of matrices.
SPARSE = 0.1
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def quantised(x: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as long; null if the vector cannot take part."""
    sound = x.isNotNull() & F.forall(x, lambda c: F.coalesce(c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    whole = lambda c: F.when(F.abs(c.cast("double") * scale) < 2.0**63, F.floor(c.cast("double") * scale)).otherwise(F.raise_error(F.lit("a component does not fit a long")).cast("long"))
    return F.when(sound, F.transform(x, whole))


def statistics(v: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(L) times the mean and the deviation of each segment, side by side."""
    parts = np.array_split(np.arange(v.shape[1]), min(segments, v.shape[1]))
    return np.concatenate([np.stack([v[:, p].mean(1) * len(p) ** 0.5 for p in parts], 1), np.stack([v[:, p].std(1) * len(p) ** 0.5 for p in parts], 1)], 1)


def _dots(a: np.ndarray, b: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Exact products of all pairs of integer vectors, the least number where own. In doubles up to 2**53, else in integers; raises where a sum is no long."""
    if a.dtype == np.float64:
        dense = (a @ b.T).astype(np.int64)
    elif np.where(own, 0, np.abs(a.astype(float)) @ np.abs(b.astype(float)).T).max(initial=0) < 2.0**62:
        dense = a @ b.T
    else:
        exact = np.where(own, 0, a.astype(object) @ b.astype(object).T)
        if max(abs(x) for x in exact.ravel()) > _MOST:
            raise OverflowError("a score does not fit a long")
        dense = exact.astype(np.int64)
    dense[own] = _LEAST
    return dense


class Search:
    """The k best candidates of each of a block of queries, fed block by block."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, levels: tuple[int, ...] = LEVELS) -> None:
        self.ids, self.queries, self.k, self.levels = ids, queries, k, levels
        self.scores, self.found = np.full((len(ids), k), _LEAST), np.full((len(ids), k), _MOST)
        self.stats = [statistics(queries.astype(float), s) for s in levels]
        self.pairs = self.scored = 0

    def feed(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        alive = np.ones((len(self.ids), len(ids)), bool)
        kth = self.scores[:, -1]
        if (kth > _LEAST).all():
            for s, q in zip(self.levels, self.stats, strict=True):
                rows, columns = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
                if not len(rows):
                    break
                bound = q[rows] @ statistics(vectors[columns].astype(float), s).T
                alive[np.ix_(rows, columns)] &= bound + 1e-6 * np.abs(bound) + 1 >= kth[rows, None].astype(float)
        self.pairs += alive.size
        if vectors.dtype == np.float64 and alive.sum() < SPARSE * alive.size:
            i, j = np.nonzero(alive)
            score = np.einsum("ij,ij->i", self.queries[i], vectors[j]).astype(np.int64)
            keep = (score >= kth[i]) & (self.ids[i] != ids[j])
            i, j, score = i[keep], j[keep], score[keep]
            self.scored += len(keep)
        else:
            rows, columns = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
            dense = _dots(self.queries[rows], vectors[columns], self.ids[rows, None] == ids[columns])
            self.scored += dense.size
            least = kth[rows]
            if len(columns) > self.k:
                least = np.maximum(least, np.partition(dense, len(columns) - self.k, 1)[:, len(columns) - self.k])
            i, j = np.nonzero((dense >= least[:, None]) & (dense > _LEAST))
            i, j, score = rows[i], columns[j], dense[i, j]
        self._merge(i, ids[j], score)

    def _merge(self, query: np.ndarray, found: np.ndarray, score: np.ndarray) -> None:
        if not len(query):
            return
        touched = np.unique(query)
        query = np.concatenate([np.repeat(touched, self.k), query])
        found = np.concatenate([self.found[touched].ravel(), found])
        score = np.concatenate([self.scores[touched].ravel(), score])
        order = np.lexsort((found, -np.maximum(score, _LEAST + 1), query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        best = place < self.k
        self.scores[query[best], place[best]] = score[order][best]
        self.found[query[best], place[best]] = found[order][best]

    def result(self) -> Iterator[pa.RecordBatch]:
        q, r = np.nonzero(self.found < _MOST)
        for at in range(0, len(q), 65536):
            a, b = q[at : at + 65536], r[at : at + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[a]), pa.array(self.found[a, b]), pa.array(self.scores[a, b])], ["query_id", "vec_id", "score"])


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows (ids, flat) of up to so many vectors each, packed where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, flat, n = [], [], 0

        def full() -> pa.RecordBatch:
            columns = [np.concatenate(ids), np.concatenate(flat)]
            return pa.RecordBatch.from_arrays([pa.array([c], pa.list_(pa.int64())) for c in columns], ["ids", "flat"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size - n)
                ids.append(part.column(0).to_numpy())
                flat.append(part.column(1).flatten().to_numpy())
                at, n = at + part.num_rows, n + part.num_rows
                if n == size:
                    yield full()
                    ids, flat, n = [], [], 0
        if n:
            yield full()

    return rows.select("vec_id", "v").mapInArrow(run, "ids array<long>, flat array<long>")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, levels: tuple[int, ...] = LEVELS, block: int = QUERY_BLOCK) -> DataFrame:
    """vectors, queries: (vec_id, v: array<long>). Rows query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    ship(spark)
    vectors, queries = vectors.where("v is not null"), queries.where("v is not null")
    facts = vectors.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.max(F.greatest(F.array_max("v"), -F.array_min("v"))).alias("greatest")).orderBy(F.desc("n"), "width").first()
    if facts is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, asked = facts["width"], queries.where(F.size("v") == facts["width"]).dropDuplicates(["vec_id", "v"])
    n_queries = asked.count()
    # integers in doubles are exact up to 2**53; larger vectors use exact integer products
    kind = np.float64 if float(facts["greatest"] or 0) ** 2 * max(width, 1) < 2**52 else np.int64
    blocks = max(1, -(-n_queries // block))
    salts = max(1, -(-2 * partitions(spark) // blocks))
    groups = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    numbered = asked.repartition(blocks, F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    # stored, as another run may pack them otherwise; there are as many as blocks of queries, and twice that at most
    asking = stored(_packed(numbered, block).select(F.pmod(F.xxhash64("ids"), F.lit(1 << 40)).alias("block"), "ids", "flat"), "query-blocks")
    names = [r["block"] for r in asking.select("block").distinct().collect()]
    if not names:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asking = asking.select("block", groups.alias("salt"), F.lit(0).alias("kind"), "ids", "flat")
    packed = _packed(vectors.where(F.size("v") == width), ROWS)
    offered = packed.select(F.explode(F.array(*map(F.lit, names))).alias("block"), F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), "ids", "flat")
    dealt = asking.unionByName(offered).repartition(max(partitions(spark), min(salts * len(names), 4096)), "block", "salt").sortWithinPartitions("block", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search: Search | None = None
        for batch in batches:
            for i in range(batch.num_rows):
                ids, flat = (batch.column(c)[i].values.to_numpy() for c in (3, 4))
                matrix = flat.reshape(len(ids), -1).astype(kind)
                if batch.column(2)[i].as_py() == 0:
                    if search:
                        yield from search.result()
                    search = Search(ids, matrix, k, levels)
                else:
                    search.feed(ids, matrix)
        if search:
            yield from search.result()

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v")).where("vec_id is not null")
    return top_k(rows, rows.where("vec_id % 20 = 0"))


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
