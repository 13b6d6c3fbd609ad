"""Admission of quoted claims, citations and ingest bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def admit(claims: DataFrame, evidence: DataFrame, least: int = 12) -> DataFrame:
    """Claims whose quote is long enough and stands verbatim in the evidence they name."""
    known = evidence.select("evidence_id", F.col("text").alias("_evidence"))
    joined = claims.join(known, "evidence_id").filter(F.length("quote") >= least).filter(F.col("_evidence").contains(F.col("quote")))
    if "text" in claims.columns:
        joined = joined.filter((F.btrim("text") != "") & ~F.col("text").rlike(r"\[E\d+\]"))
    return joined.drop("_evidence")


def cite(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """Claims (claim_id, chunk_id, quote) with the span of their quote; those that cross spans are dropped."""
    held = F.expr("get(filter(source_spans, s -> contains(substr(_text, s.start + 1, s.`end` - s.start), quote)), 0)")
    joined = claims.join(chunks.select("chunk_id", "source_spans", F.col("text").alias("_text")), "chunk_id").withColumn("span", held)
    return joined.filter("span IS NOT NULL").drop("source_spans", "_text")


def renumber(citations: DataFrame, group: str, order: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy(group).orderBy(order))
    return citations.withColumn("citation", F.concat(F.lit("E"), place.cast("string")))


def answer_status(has_claims: Column, answers: Column, advice: Column) -> Column:
    return F.when(has_claims & answers & ~advice, "answered").otherwise("insufficient_evidence")


def to_ingest(sources: DataFrame, registry: DataFrame) -> DataFrame:
    """Sources whose book, content and settings are not registered yet."""
    return sources.join(registry.select("book", "source_sha", "settings"), ["book", "source_sha", "settings"], "left_anti")


def page_batches(books: DataFrame, size: int = 40) -> DataFrame:
    """(book, start, end): batches of pages, the last one clipped."""
    each = books.withColumn("start", F.explode(F.sequence("first_page", "last_page", F.lit(size))))
    return each.select("book", "start", F.least(F.col("start") + size - 1, "last_page").alias("end")).withColumn(
        "name", F.format_string("pages-%05d-%05d", "start", "end")
    )
