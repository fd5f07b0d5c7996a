"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed n-grams by language are gathered on the executors from a bounded sample (see TRAIN_PER_LANGUAGE) and
summed by Spark; the driver gets a matrix of fixed width, and the log-probabilities go to the workers as a broadcast.
A worker scores a batch as a sparse product: the n-grams of all its texts are rows to gather from the matrix, summed by
text. Text is lowered; what is no letter counts as a space.

Defined cases: a null text, an empty one, or one without a letter is `und` with score 0; without any labelled text all
are `und`; a null doc_id is not learned from and not held out; extra columns are ignored; rows that repeat are scored
alike; ties go to the first language by name. Whole texts are read, in stretches of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import mix64, row_chunks, string_view, table

#: Hashed n-grams, and their lengths (fixed values of the model).
FEATURES = 1 << 16
LENGTHS = (1, 2, 3)
#: Texts are scored this many bytes at a time; a place costs some hundred bytes of arrays.
STRETCH = 1 << 18
#: Learned from about this many documents of each language at most, those of least hash; more adds nothing measurable.
TRAIN_PER_LANGUAGE = 4_000
#: The most cells of a matrix (64 MB). With more than 256 languages n-grams are hashed to fewer features; no language is left out.
CELLS = 1 << 24


@cache
def _letters() -> np.ndarray:
    """For each code point, itself if a letter, else a space."""
    out = np.full(0x110000, 32, np.uint32)
    for p in range(0x110000):
        if chr(p).isalpha():
            out[p] = p
    return out


def width(languages: int) -> int:
    """The number of features for so many languages: a power of two."""
    return min(FEATURES, 1 << max(0, (CELLS // max(languages, 1)).bit_length() - 1))


def ngrams(column: pa.Array, features_: int = FEATURES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For row ranges of a string column: (from, to, feature of each n-gram, its row less from, letters of each row)."""
    lowered = pc.utf8_lower(column.fill_null("") if column.null_count else column)
    data, offsets = string_view(lowered)
    for a, b in row_chunks(offsets, STRETCH):
        raw = data[offsets[a] : offsets[b]]
        starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        bounds = starts[offsets[a : b + 1] - offsets[a]]
        points = _letters()[np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
        row = np.repeat(np.arange(b - a), np.diff(bounds))
        letters = np.bincount(row[points != 32], minlength=b - a)
        features, rows = [], []
        for n in LENGTHS:
            m = len(points) - n + 1
            if m <= 0:
                continue
            h = np.full(m, n * 0x9E3779B1, np.uint64)
            for i in range(n):
                h = h * np.uint64(0x100000001B3) + points[i : i + m]
            keep = row[:m] == row[n - 1 :]
            features.append((mix64(h)[keep] & np.uint64(features_ - 1)).astype(np.int32))
            rows.append(row[:m][keep])
        yield a, b, np.concatenate(features or [np.zeros(0, np.int32)]), np.concatenate(rows or [np.zeros(0, np.int64)]), letters


def held_out(of: int, remainder: int, key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % of == remainder, F.lit(False))


def train(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE, alpha: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages by name and their log-probabilities (a row a feature, the last the priors) from docs (doc_id, text, lang)."""
    labelled = docs.where("lang is not null and text is not null and doc_id is not null")
    totals = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(totals)
    if not langs:
        return [], np.zeros((FEATURES + 1, 0), np.float32)
    wide = width(len(langs))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_language / totals[k]))])
    drawn = labelled.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)) < F.try_element_at(share, F.col("lang")))
    number = {k: i for i, k in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(langs) * wide, np.int64)
        for batch in batches:
            lang = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            for a, b, feature, row, _ in ngrams(batch.column(0), wide):
                cell, n = np.unique(lang[a:b][row] * wide + feature, return_counts=True)
                sums[cell] += n
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["cell", "n"])

    # at most CELLS cells come to the driver
    cells = drawn.select("text", "lang").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(langs) * wide)
    counts[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    counts = counts.reshape(len(langs), wide).T + alpha
    prior = np.array([totals[k] for k in langs], float)
    return langs, np.vstack([np.log(counts / counts.sum(0)), np.log(prior / prior.sum())]).astype(np.float32)


def classify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """docs with lang_pred and score, the posterior of the predicted language."""
    langs, matrix = model
    sent = docs.sparkSession.sparkContext.broadcast(matrix)
    schema = docs.drop("lang_pred", "score").schema.add("lang_pred", "string").add("score", "double")
    at = schema.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp = sent.value
        for batch in batches:
            pred = np.full(batch.num_rows, -1)
            score = np.zeros(batch.num_rows)
            for a, b, feature, row, letters in ngrams(batch.column(at), len(logp) - 1) if langs else ():
                sums = np.stack([np.bincount(row, logp[feature, k], minlength=b - a) for k in range(len(langs))], 1) + logp[-1]
                best = sums.argmax(1)
                found = letters > 0
                pred[a:b] = np.where(found, best, -1)
                score[a:b] = np.where(found, 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1), 0)
            names = pa.array([langs[i] if i >= 0 else "und" for i in pred], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, names, pa.array(score)], names=schema.fieldNames())

    return docs.drop("lang_pred", "score").mapInArrow(run, schema)


def predict(docs: DataFrame) -> DataFrame:
    """Trains on the documents that are not held out and classifies all: docs with held_out, lang_pred, score."""
    model = train(docs.where(~held_out(3, 1)).select("doc_id", "text", "lang"))
    return classify(docs, model).withColumn("held_out", held_out(3, 1))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(3, 1)).select("doc_id", "text", "lang"))
    return classify(docs.select("doc_id", "text"), model).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")
