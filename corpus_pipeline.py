"""A training corpus from documents in five stages; each stage's result is written and read again as the next one's input.

Language identification drops what it cannot name, line dedup takes repeated lines out of the texts, near-dedup keeps
one document of each group, mixing draws (and repeats) documents to their sources' targets in training order, and BPE
turns them into tokens. Every stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns the
columns of documents, the last one tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import bpe, langid, line_dedup, mixing, near_dedup
from lumenframe.llm.common import fresh_path, ship, table

#: A prediction below this posterior counts as rejected, as does `und`.
LEAST_SCORE = 0.5


def _row(docs: DataFrame) -> Column:
    """Every column of a row as one struct, so that none clashes with what an operator adds."""
    return F.struct(*[F.col(c) for c in docs.columns]).alias("row")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. Nulls and texts without a letter go; an empty table gives no rows."""
    ship(spark)
    found = langid.predict(docs.select("doc_id", "text", "lang", _row(docs)))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("row.*")


def line_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with repeated lines taken out of their texts, n_chars counted anew. No document goes; a null text stays null."""
    kept = line_dedup.deduplicate(docs.select("doc_id", "text", _row(docs)))
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return kept.select([new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id. Rows that repeat an id stay together."""
    ship(spark)
    kept = near_dedup.near_duplicates(docs).where("kept").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes of a document, sorted by training position, each copy at its own. A last copy that is taken in part stands whole.

    Null texts and texts without words take nothing and go; an empty table gives no rows; other columns are carried. Rows carry themselves through the mix, so those without an id and those that repeat one have their own plans.
    """
    plan = mixing.copies(docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("row")), ("row",))
    return plan.select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of what they decode to, for every row; a null text has no tokens."""
    ship(spark)
    return bpe.encode_documents(docs, bpe.vocabulary_path(), "ids array<int>, decoded_sha256 string")


STAGES = [("language", language), ("line_dedup", line_duplicates), ("near_dedup", near_duplicates), ("mixing", mixed), ("bpe", tokens)]

#: Stages use learned models, min-hash and BPE, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
