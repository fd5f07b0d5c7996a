"""Mixing sources to target weights along a time-varying curriculum, native operations only.

Each source has a weight and a schedule, a density over training time t in [0, 1]. Targets share a total by weight,
no source above `most` times its size (the excess is shared again by weight). A source's documents form a stream in a
fixed order (by a digest of the id); the stream is repeated as often as the target asks, the last pass cut where the target is met. A document
stands at the time at which the source's integrated schedule has asked for the words before it: the cumulative demand
is inverted. Sorting by that position gives the training order.

Prefix sums take two levels: a source is dealt into many buckets by the digest's first bits, sums of buckets are added up first, then rows
inside each bucket, so no task holds a whole source.

Defined cases: a null text has no words; a null source is a source of its own, ordered last; documents without words
take nothing and stand where their stream is; rows that repeat an id follow one another by size; a null doc_id hashes as
text 'null'; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import partitions, table

WORD = r"[^\x20\x09-\x0D]+"
#: Fixed cycle of weights over sources in order.
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes: (source, source_size), one row a source. Adds ord, weight and target.

    With sources ordered by cap / weight, the level that fills the rest after the first k are capped is
    (total - caps) / weights of the rest; the first k whose next source stays below its cap is the answer. Windows here
    run over one row a source.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cycle = F.array(*map(F.lit, weights))
    rows = sizes.withColumn("ord", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    rows = rows.withColumn("weight", F.element_at(cycle, (F.col("ord") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * most)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "ord")
    rows = rows.withColumns({
        "total": F.sum("source_size").over(everything) * share,
        "caps_before": F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "weights_from": F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)),
    })
    level = (F.col("total") - F.col("caps_before")) / F.col("weights_from")
    rows = rows.withColumn("level", F.min(F.when(level * F.col("weight") <= F.col("cap"), F.struct("caps_before", level.alias("level")))).over(everything)["level"])
    return rows.select("source", "source_size", "ord", "weight", F.least("cap", F.coalesce("level", F.lit(float("inf"))) * F.col("weight")).alias("target"))


def schedule_inverse(ord_: Column, part: Column) -> Column:
    """The time at which a source has asked for this part (0 to 1) of its target.

    Schedules cycle over sources: constant (integral t), rising as 2t (integral t squared), falling as 2(1 - t)
    (integral 1 - (1 - t) squared).
    """
    kind = ord_ % 3
    return F.when(kind == 0, part).when(kind == 1, F.sqrt(part)).otherwise(F.lit(1.0) - F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - part)))


def mix(docs: DataFrame, carry: tuple[str, ...] = (), **how: object) -> DataFrame:
    """doc_id, size, source_size, target, taken, position of every document, range-sorted by position; carry: columns kept besides.

    position is that of the first copy; copy c of a document (from 0) has taken min(size, taken - c * size) words. copies()
    has them all.
    """
    return _placed(docs, carry, **how).select("doc_id", *carry, "size", "source_size", "target", "taken", _position(F.col("start")).alias("position")).orderBy("position", "doc_id")


def copies(docs: DataFrame, carry: tuple[str, ...] = (), **how: object) -> DataFrame:
    """As mix(), but a row for each copy (from 0) that is taken, at the time at which its own pass over the stream has come to it. A last copy taken in part is a row."""
    each = _placed(docs, carry, **how).where("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)))
    position = _position(F.col("start") + F.col("copy") * F.col("source_size"))
    return each.select("doc_id", *carry, "size", "source_size", "target", "taken", "copy", position.alias("position")).orderBy("position", "copy", "doc_id")


def _position(start: Column) -> Column:
    part = F.when(F.col("target") > 0, F.least(F.lit(1.0), start / F.col("target"))).otherwise(F.lit(0.0))
    return schedule_inverse(F.col("ord"), part)


def _placed(docs: DataFrame, carry: tuple[str, ...], **how: object) -> DataFrame:
    """doc_id, carry, size, source_size, ord, target, taken and start, the words of its source's stream before each document."""
    spark = docs.sparkSession
    buckets = max(64, 8 * partitions(spark))
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    rows = docs.select("doc_id", "source", *[c for c in carry if c not in ("doc_id", "source")], F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"), order.alias("h"))
    rows = rows.withColumn("bucket", F.shiftright(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * buckets, 32))
    keyed = rows.withColumn("s", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    sums = keyed.groupBy("s", "source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("s").orderBy("bucket")
    offsets = sums.select("s", "bucket", (F.sum("words").over(before) - F.col("words")).alias("ahead"))
    plan = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), **how).withColumn("s", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).drop("source", "weight")
    offsets = offsets.join(plan, "s")
    inside = Window.partitionBy("s", "bucket").orderBy("h", F.col("doc_id").asc_nulls_last(), "size")
    placed = keyed.withColumn("within", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).join(offsets, ["s", "bucket"]).withColumn("start", F.col("ahead") + F.col("within"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.round("target").cast("long") - passes * F.col("source_size")
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start"))).cast("long")
    return placed.withColumn("taken", taken)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position")


OP6_SQL = """
WITH d AS (SELECT doc_id, source, length(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS ord FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(ord % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS total, coalesce(sum(cap) OVER (ORDER BY cap / weight, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps_before,
  sum(weight) OVER (ORDER BY cap / weight, ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS weights_from FROM w),
m AS (SELECT *, (total - caps_before) / weights_from AS lvl FROM l),
t AS (SELECT source, source_size, ord, least(cap, coalesce((SELECT arg_min(lvl, caps_before) FROM m WHERE lvl * weight <= cap), 'infinity'::DOUBLE) * weight) AS target FROM m),
p AS (SELECT d.doc_id, d.size, t.source_size, t.ord, t.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, 'null')), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - d.size AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(round(target) / source_size)::BIGINT ELSE 0 END AS passes, CASE WHEN target > 0 THEN least(1.0::DOUBLE, start / target) ELSE 0 END AS part FROM p)
SELECT doc_id, size, source_size, target, passes * size + greatest(0, least(size, round(target)::BIGINT - passes * source_size - start)) AS taken,
  CASE ord % 3 WHEN 0 THEN part WHEN 1 THEN sqrt(part) ELSE 1 - sqrt(greatest(0, 1 - part)) END AS position
FROM q
"""
