"""Profiles of records and the quality of extracted pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators.running import latest, running

#: The labels that records may have.
LABELS = ("section_header", "text", "list", "table", "caption", "footnote", "formula")


def labels(records: DataFrame) -> DataFrame:
    """Counters for each book: records, headers, known labels, oversized bodies, missing pages, tables without a grid."""
    n = lambda c: F.count_if(c)
    header, text = F.col("label") == "section_header", F.col("text")
    return records.groupBy("book").agg(
        F.count(F.lit(1)).alias("n_records"), n(header).alias("n_headers"), n(F.col("label").isin(*LABELS)).alias("n_known"),
        n(~header & (F.length(text) > 2000)).alias("oversized"), n(F.col("page_no").isNull()).alias("missing_page"),
        n((F.col("label") == "table") & ~(text.contains("|") & text.contains("---"))).alias("tables_without_grid"),
        n((F.col("label") == "list") & text.contains("\n")).alias("merged_lists"),
    )


def label_histogram(records: DataFrame) -> DataFrame:
    """A map of counts by label for each book."""
    counts = records.groupBy("book", "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("book").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n")))).alias("labels"))


def top_headings(records: DataFrame, k: int = 10) -> DataFrame:
    """The commonest headings, letter case aside; ties by first appearance."""
    heads = records.filter("label = 'section_header'").select("book", "rec_no", F.lower("text").alias("heading"))
    counts = heads.groupBy("book", "heading").agg(F.count(F.lit(1)).alias("n"), F.min("rec_no").alias("first_rec"))
    rank = F.row_number().over(W.partitionBy("book").orderBy(F.desc("n"), "first_rec"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)


def reference_fraction(records: DataFrame, is_reference: Column) -> DataFrame:
    """Characters of bodies under reference headings as a part of all bodies' characters."""
    size = F.when(F.col("label") != "section_header", F.length("text")).otherwise(0)
    return records.groupBy("book").agg(
        F.bround(F.sum(F.when(is_reference, size).otherwise(0)) / F.greatest(F.sum(size), F.lit(1)).cast("double"), 4).alias("fraction")
    )


def page_backtracks(records: DataFrame) -> DataFrame:
    """Records whose page is before the last page known so far."""
    before = W.partitionBy("book").orderBy("rec_no").rowsBetween(W.unboundedPreceding, -1)
    seen = F.last("page_no", ignorenulls=True).over(before)
    return records.withColumn("previous", seen).filter("page_no < previous").select("book", "rec_no", "page_no", "previous")


def first_samples(records: DataFrame, keep: Column, n: int) -> DataFrame:
    """The first n records of each book that a condition selects."""
    rank = F.row_number().over(W.partitionBy("book").orderBy("rec_no"))
    return records.filter(keep).withColumn("rank", rank).filter(F.col("rank") <= n)


def sections(records: DataFrame) -> DataFrame:
    """Section number and the record of the heading in force, carried forward within a book."""
    header = F.col("label") == "section_header"
    counted = running(records, "book", ["rec_no"], {"section_no": header.cast("int")})
    return latest(counted, "book", "rec_no", {"parent_rec": F.when(header, F.col("rec_no"))})


def explode_lists(records: DataFrame) -> DataFrame:
    """Merged lists as one record an item (item_no from 0, merged true), without bullets of their own; other records as they are."""
    merged = (F.col("label") == "list") & F.col("text").contains("\n")
    parts = F.when(merged, F.filter(F.split("text", "\n"), lambda x: F.btrim(x) != "")).otherwise(F.array("text"))
    each = records.select("*", merged.alias("merged"), F.posexplode(parts).alias("item_no", "item"))
    bare = F.btrim(F.regexp_replace("item", "^- ", ""))
    return each.withColumn("text", F.when(F.col("merged"), F.concat(F.lit("- "), bare)).otherwise(F.col("item"))).drop("item")


def minimum_page(records: DataFrame, limits: DataFrame) -> DataFrame:
    """Records from their book's first page on; a missing page counts as 0, front matter goes."""
    floors = limits.select(F.col("book").alias("_book"), "min_page")
    kept = records.filter(~F.coalesce(F.col("front_matter"), F.lit(False))) if "front_matter" in records.columns else records
    joined = kept.join(floors, kept["book"] == F.col("_book"), "left")
    return joined.filter(F.coalesce("page_no", F.lit(0)) >= F.coalesce("min_page", F.lit(0))).drop("_book", "min_page")


def provenance(items: DataFrame) -> DataFrame:
    """Items with the pages on which they count, their batch's shift, and whether they count nowhere (unmapped).

    items: batch, pages (array), start, end, and what else they have. A batch's pages are
    relative if they start at 1 and stay within its length although it starts later; then
    they are shifted. An item without a page, or with one outside the range, is unmapped.
    """
    seen = items.groupBy("batch").agg(F.min(F.array_min("pages")).alias("_lo"), F.max(F.array_max("pages")).alias("_hi"))
    relative = (F.col("start") > 1) & (F.col("_lo") == 1) & (F.col("_hi") <= F.col("end") - F.col("start") + 1)
    shifted = items.join(seen, "batch").withColumn("shift", F.when(relative, F.col("start") - 1).otherwise(0)).drop("_lo", "_hi")
    moved = shifted.withColumn("pages", F.transform("pages", lambda p: p + F.col("shift")))
    outside = (F.size("pages") <= 0) | F.exists("pages", lambda p: ~p.between(F.col("start"), F.col("end")))
    return moved.withColumn("unmapped", F.coalesce(outside, F.lit(True)))


def page_counts(items: DataFrame) -> DataFrame:
    """Characters and elements of each page of a batch, pages without any included."""
    mapped = provenance(items)
    spread = mapped.filter(~F.col("unmapped")).select("batch", "kind", "size", F.explode(F.array_distinct("pages")).alias("page"))
    pages = items.select("batch", F.explode(F.sequence("start", "end")).alias("page")).distinct()
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in ("texts", "tables", "pictures")]
    counts = spread.groupBy("batch", "page").agg(F.sum("size").alias("text_chars"), *kinds)
    return pages.join(counts, ["batch", "page"], "left").na.fill(0)
