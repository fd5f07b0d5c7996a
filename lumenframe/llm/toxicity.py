"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al. 2017).

A linear model over the words that a text has, by 64-bit hash. Its risk is estimated from confirmed toxic texts P and unlabelled
texts U with the class prior p: p E_P[l(f)] + max(0, E_U[l(-f)] - p E_P[l(-f)]), l the logistic loss; where the second
part falls below zero its gradient is turned round, as the paper has it. Training is numpy on a bounded sample.

Defined cases: a null text is the empty text and scores by the bias alone; without confirmed toxic texts every score is
the prior (about 1e-13 if no label is positive); a null doc_id is neither learned from nor held out; ids that `labels` repeats
count as toxic if any row says so; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import row_chunks, ship, span_hashes, stored, string_view, table
from lumenframe.llm.langid import held_out

#: The sample that is learned from: at most so many confirmed toxic and so many unlabelled texts, those of least hash.
TRAIN_POSITIVE, TRAIN_UNLABELLED = 3_000, 9_000
#: A feature is a word that is in so many confirmed texts, and more often there than in unlabelled ones by so many standard errors; the most a model has.
MIN_TEXTS, MIN_Z, FEATURES = 5, 5.0, 4096
_SIEVE = np.uint64((1 << 20) - 1)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

#: Sorted 64-bit word hashes, their weights, the bias.
Model = tuple[np.ndarray, np.ndarray, float]


def words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For row ranges: (from, to, row less from of each word, its 64-bit hash), in the order of the text."""
    data, offsets = string_view(pc.utf8_lower(column.fill_null("") if column.null_count else column))
    for a, b in row_chunks(offsets):
        raw = data[offsets[a] : offsets[b]]
        inside = _LETTER[raw]
        bounds = offsets[a : b + 1] - offsets[a]
        first = np.zeros(len(raw) + 1, bool)
        first[bounds] = True
        starts = np.flatnonzero(inside & (~np.append(False, inside)[:-1] | first[:-1]))
        ends = np.flatnonzero(inside & (~np.append(inside, False)[1:] | first[1:])) + 1
        yield a, b, np.searchsorted(bounds, starts, side="right") - 1, span_hashes(raw, starts, ends)


def _indices(keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The place of each hash among the sorted keys, or -1."""
    at = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
    return np.where(keys[at] == hashes, at, -1) if len(keys) else np.full(len(hashes), -1)


def select(rows: DataFrame) -> np.ndarray:
    """Sorted hashes of the words that tell confirmed texts from unlabelled ones. rows: (words: array<long>, distinct ones; toxic). Counted on the executors."""
    totals = rows.agg(F.sum("toxic").alias("n"), F.sum(1 - F.col("toxic")).alias("m")).first()
    n, m = float(totals["n"]), float(totals["m"])
    words = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("seen"), F.sum(1 - F.col("toxic")).alias("against")).where(F.col("seen") >= MIN_TEXTS)
    share = (F.col("seen") + F.col("against")) / (n + m)
    z = (F.col("seen") / n - F.col("against") / m) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / n + 1 / m))
    best = words.select("word", z.alias("z")).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "word").limit(FEATURES).collect()
    return np.sort(np.array([r["word"] for r in best], np.int64).view(np.uint64))


def fit(keys: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """A model over the words of keys by Adam on the non-negative risk; texts are given as places among keys."""
    both = [*positive, *unlabelled]
    row, column = np.repeat(np.arange(len(both)), [len(x) for x in both]), np.concatenate(both).astype(np.int64)
    n, k = len(positive), len(keys)
    w, b = np.zeros(k), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, steps + 1):
        f = np.bincount(row, w[column], minlength=len(both)) + b
        s = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        loss = np.logaddexp(0, f)
        rest = loss[n:].mean() - prior * loss[:n].mean()
        g = np.zeros(len(both))
        if rest >= 0:
            g[:n] = prior * (s[:n] - 1) / n - prior * s[:n] / n
            g[n:] = s[n:] / len(unlabelled)
        else:
            g[:n], g[n:] = prior * s[:n] / n, -s[n:] / len(unlabelled)
        grad = np.append(np.bincount(column, g[row], minlength=k) + decay * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:k], b - move[k]
    return keys, w, float(b)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from docs (doc_id, text) and labels (doc_id, toxic), both already without held-out rows."""
    ship(docs.sparkSession)
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    seen = marks.agg(F.count("*").alias("n"), F.count_if("toxic").alias("k")).first()
    if not seen["k"]:
        return np.zeros(0, np.uint64), np.zeros(0), -30.0
    prior = min(0.9, max(1e-3, seen["k"] / seen["n"]))
    least = F.xxhash64(F.lit("draw"), "doc_id")
    positive = marks.where("toxic").select("doc_id").orderBy(least).limit(TRAIN_POSITIVE).withColumn("toxic", F.lit(1))
    unlabelled = docs.where("doc_id is not null").select("doc_id").orderBy(least).limit(TRAIN_UNLABELLED).withColumn("toxic", F.lit(0))
    drawn = docs.join(F.broadcast(positive.unionByName(unlabelled)), "doc_id").select("text", "toxic")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, row, hashes in words(batch.column(0)):
                parts = [np.unique(p).view(np.int64) for p in np.split(hashes, np.searchsorted(row, np.arange(1, b - a)))]
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.list_(pa.int64())), batch.column(1).slice(a, b - a)], ["words", "toxic"])

    rows = stored(drawn.mapInArrow(features, "words array<long>, toxic int"), "toxicity-words")
    kinds = {r["toxic"] for r in rows.select("toxic").distinct().collect()}
    if kinds != {0, 1}:
        return np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior)))
    keys = select(rows)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_indices(keys, x.values.to_numpy().view(np.uint64)) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([x[x >= 0].astype(np.uint16).tobytes() for x in found], pa.binary()), batch.column(1)], ["places", "toxic"])

    # of each text at most FEATURES places of two bytes; their order fixes the sums, so that reruns agree
    learned = sorted(map(tuple, rows.mapInArrow(places, "places binary, toxic int").collect()))
    apart = {t: [np.frombuffer(x, np.uint16) for x, y in learned if y == t] for t in (0, 1)}
    return fit(keys, apart[1], apart[0], prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted of every row of docs."""
    keys, weights, bias = model
    sieve = np.zeros(int(_SIEVE) + 1, bool)
    sieve[keys & _SIEVE] = True
    sent = docs.sparkSession.sparkContext.broadcast((keys, weights, sieve))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights, sieve = sent.value
        for batch in batches:
            f = np.full(batch.num_rows, bias)
            for a, b, row, hashes in words(batch.column(1)):
                some = sieve[hashes & _SIEVE]
                at = _indices(keys, hashes[some])
                cells = np.unique(row[some][at >= 0] * max(len(keys), 1) + at[at >= 0])
                f[a:b] += np.bincount(cells // max(len(keys), 1), weights[cells % max(len(keys), 1)], minlength=b - a)
            s = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs.where(~held_out(5, 0)).select("doc_id", "text"), labels.where(~held_out(5, 0)).select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")
