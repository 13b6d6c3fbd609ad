"""Mixing sources to target weights (operator 1).

Words are summed by source, the budget is shared among sources by weight under a
cap on repetition, and each document is emitted floor(rate) times plus one copy
drawn by a seeded hash with the rate's fraction as its probability. One pass over
the texts gives (id, source, size); everything after works on those few bytes a row.

Defined cases: a null source is a source of its own, last in order; a null or empty
text has size 0 and, like any document of a source of size 0, is taken 0 times; rows
that repeat an id share its draw; an empty table gives an empty result; other columns
pass through `mix` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, bounded_broadcast, read, unit_hash, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_RATE = 2.0
SEED = "mix"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_rate: float = MAX_RATE) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Capped proportional shares have one water level: a source gets the smaller of its
    cap and level * weight. In order of cap / weight the capped sources come first, so
    the level is that of the first source whose cap is not below it. The windows run
    over one row a source, after the aggregation.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    everything = W.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = by_source.withColumn("place", place).withColumn(
        "weight", F.get(F.array(*[F.lit(w) for w in weights]), F.col("place") % len(weights))
    ).withColumn("cap", F.col("source_size") * F.lit(float(max_rate)))
    order = everything.orderBy(F.col("cap") / F.col("weight"), F.col("place"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest = order.rowsBetween(0, W.unboundedFollowing)
    level = (
        F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / F.sum("weight").over(rest)
    levels = ranked.withColumn("level", level).withColumn(
        "open_level", F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))
    )
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    water = F.coalesce(F.first("open_level", ignorenulls=True).over(whole), F.lit(float("inf")))
    return levels.select("source", "source_size", F.least("cap", water * F.col("weight")).alias("target"))


def copies_of(key, size, source_size, target):
    """Times a document is emitted: floor(rate), and once more if its draw is below the fraction."""
    rate = F.when(source_size > 0, target / source_size).otherwise(F.lit(0.0))
    drawn = F.when(unit_hash(key, SEED) < rate - F.floor(rate), 1).otherwise(0)
    return F.when(size > 0, F.floor(rate) + drawn).otherwise(0).cast("long")


def _targets(sized: DataFrame, space: Workspace, **shares) -> DataFrame:
    return bounded_broadcast(space.write(source_targets(sized, **shares), "targets"))


def mixing_plan(docs: DataFrame, **shares) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every document, texts left behind."""
    space = Workspace(docs.sparkSession, "mix")
    sized = space.write(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    plan = sized.alias("d").join(_targets(sized, space, **shares).alias("t"), F.expr("d.source <=> t.source"))
    return plan.select(
        "doc_id", "d.source", "size", "source_size", "target",
        copies_of(F.col("doc_id"), F.col("size"), F.col("source_size"), F.col("target")).alias("copies"),
    )


def mix(docs: DataFrame, **shares) -> DataFrame:
    """The mixed corpus: the columns of docs, a row for each copy."""
    space = Workspace(docs.sparkSession, "mix")
    sizes = docs.select("source", word_count(F.col("text")).alias("size"))
    targets = _targets(sizes, space, **shares).select(F.struct("source", "source_size", "target").alias("_target"))
    joined = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).join(
        targets, F.expr("_row.source <=> _target.source")
    )
    t = F.col("_target")
    copies = copies_of(F.col("_row.doc_id"), word_count(F.col("_row.text")), t["source_size"], t["target"])
    many = joined.withColumn("_copies", copies.cast("int")).filter("_copies > 0")
    return many.select(F.explode(F.array_repeat("_row", F.col("_copies"))).alias("_row")).select("_row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing_plan(read(spark, sf_dir, "documents"))
    return plan.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies"
    )


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place,
         CAST(source_size AS DOUBLE) * 2.0 AS cap FROM by_source),
weighted AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM ranked),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE)
     - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
     / CAST(sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighted),
targets AS (
  SELECT source, source_size,
         least(cap, coalesce(first_value(CASE WHEN cap >= level * weight THEN level END IGNORE NULLS) OVER (
           ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 'inf'::DOUBLE) * weight) AS target
  FROM levels),
rates AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
drawn AS (
  SELECT *, CASE WHEN size > 0 THEN CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END ELSE 0 END AS n
  FROM rates)
SELECT doc_id, size, source_size, target, CAST(n * size AS BIGINT) AS taken, source, CAST(n AS BIGINT) AS copies FROM drawn
"""
