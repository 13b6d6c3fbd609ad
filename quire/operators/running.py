"""Running values along a book, in blocks: no task sees more than a block, however long the book is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 100_000


def running(rows: DataFrame, book: str, order: list[str], totals: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """rows with, for each name of totals, its running sum up to and with the row, along the order within the book.

    The first column of order is a number; blocks are runs of it. Sums are taken within
    blocks, and sums of whole blocks are added on; of those there is one row a block.
    """
    at = rows.withColumn("_block", F.expr(f"`{order[0]}` div {block}"))
    each = at.groupBy(book, "_block").agg(*[F.sum(c).alias(f"_all_{n}") for n, c in totals.items()])
    ahead = W.partitionBy(book).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    each = each.select(F.col(book).alias("_book"), F.col("_block").alias("_at"), *[F.coalesce(F.sum(f"_all_{n}").over(ahead), F.lit(0)).alias(f"_before_{n}") for n in totals])
    own = W.partitionBy(book, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = at.select("*", *[F.sum(c).over(own).alias(f"_own_{n}") for n, c in totals.items()])
    joined = local.join(each, F.col(book).eqNullSafe(F.col("_book")) & (F.col("_block") == F.col("_at")))
    kept = [c for c in rows.columns if c not in totals]
    return joined.select(*kept, *[(F.col(f"_own_{n}") + F.col(f"_before_{n}")).alias(n) for n in totals])


def latest(rows: DataFrame, book: str, order: str, values: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """rows with, for each name of values, its last value that is not null up to and with the row."""
    at = rows.select("*", F.expr(f"`{order}` div {block}").alias("_block"), *[c.alias(f"_v_{n}") for n, c in values.items()])
    each = at.groupBy(book, "_block").agg(*[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(order))).alias(f"_all_{n}") for n in values])
    ahead = W.partitionBy(book).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    each = each.select(F.col(book).alias("_book"), F.col("_block").alias("_at"), *[F.last(f"_all_{n}", ignorenulls=True).over(ahead).alias(f"_before_{n}") for n in values])
    own = W.partitionBy(book, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = at.select("*", *[F.last(f"_v_{n}", ignorenulls=True).over(own).alias(f"_own_{n}") for n in values])
    joined = local.join(each, F.col(book).eqNullSafe(F.col("_book")) & (F.col("_block") == F.col("_at")))
    kept = [c for c in rows.columns if c not in values]
    return joined.select(*kept, *[F.coalesce(f"_own_{n}", f"_before_{n}").alias(n) for n in values])


def previous(rows: DataFrame, book: str, order: str, name: str, value: Column, block: int = BLOCK) -> DataFrame:
    """rows with the value of the row before as the column name; null for a book's first row."""
    at = rows.select("*", F.expr(f"`{order}` div {block}").alias("_block"), F.struct(value.alias("v")).alias("_v"))
    each = at.groupBy(book, "_block").agg(F.max_by("_v", order).alias("_last"))
    each = each.select(F.col(book).alias("_book"), F.col("_block").alias("_at"), F.lag("_last").over(W.partitionBy(book).orderBy("_block")).alias("_ahead"))
    local = at.withColumn("_own", F.lag("_v").over(W.partitionBy(book, "_block").orderBy(order)))
    joined = local.join(each, F.col(book).eqNullSafe(F.col("_book")) & (F.col("_block") == F.col("_at")))
    return joined.select(*rows.columns, F.coalesce("_own", "_ahead")["v"].alias(name))


def numbered(rows: DataFrame, book: str, group: str, key: str, name: str, block: int = BLOCK, totals: dict[str, Column] | None = None) -> DataFrame:
    """rows with their number from 1 within the book, in the order of group and key (a number), and for each name of totals its running sum along that order."""
    totals = totals or {}
    at = rows.withColumn("_block", F.expr(f"`{key}` div {block}"))
    each = at.groupBy(book, group, "_block").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_all_{n}") for n, c in totals.items()])
    ahead = W.partitionBy(book).orderBy(group, "_block").rowsBetween(W.unboundedPreceding, -1)
    before = lambda c, n: F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(n)
    each = each.select(F.col(book).alias("_b"), F.col(group).alias("_g"), F.col("_block").alias("_at"), before("_n", "_before"), *[before(f"_all_{n}", f"_before_{n}") for n in totals])
    own = W.partitionBy(book, group, "_block").orderBy(key)
    local = at.select("*", F.row_number().over(own).alias("_own"), *[F.sum(c).over(own.rowsBetween(W.unboundedPreceding, W.currentRow)).alias(f"_own_{n}") for n, c in totals.items()])
    joined = local.join(each, F.col(book).eqNullSafe(F.col("_b")) & F.col(group).eqNullSafe(F.col("_g")) & F.col("_block").eqNullSafe(F.col("_at")))
    return joined.select(*rows.columns, (F.col("_own") + F.col("_before")).cast("int").alias(name), *[(F.col(f"_own_{n}") + F.col(f"_before_{n}")).alias(n) for n in totals])
