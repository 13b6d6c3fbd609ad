"""Headings by typography, from spans (book, page_no, block, line, span, text, size, y0, y1, height)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import strip

#: How a numbered heading begins; the group is its number.
ANCHORS = (
    r"^\s*(?i:chapter|part|appendix)\s+((?i:[IVXLCDM0-9]+))\b",
    r"^\s*(\d+(?:\.\d+){0,3})\.?\s+[A-Z][^\n]{1,120}$",
    r"^\s*([IVXLCDM]+)\s+[A-Z][^\n]{1,120}$",
)
MARGIN, DELTA, LONGEST, WORDS = 0.05, 1.5, 160, 14


def body_size(spans: DataFrame) -> DataFrame:
    """(book, body_size): the size, to a tenth, that most characters have; the one met first on a tie."""
    met = F.struct("page_no", "block", "line", "span")
    sized = spans.select("book", F.round("size", 1).alias("body_size"), F.length(strip(F.col("text"))).alias("n"), met.alias("met")).filter("n > 0")
    counts = sized.groupBy("book", "body_size").agg(F.sum("n").alias("n"), F.min("met").alias("met"))
    rank = F.row_number().over(W.partitionBy("book").orderBy(F.desc("n"), "met"))
    return counts.withColumn("_r", rank).filter("_r = 1").select("book", "body_size")


def headings(spans: DataFrame) -> DataFrame:
    """(book, page_no, block, line, title, level): lines that are numbered like headings or larger than the body."""
    filled = spans.filter(strip(F.col("text")) != "")
    parts = F.sort_array(F.collect_list(F.struct("span", "text")))
    rows = filled.groupBy("book", "page_no", "block", "line").agg(
        strip(F.array_join(F.transform(parts, lambda p: p["text"]), "")).alias("title"), F.max("size").alias("size"),
        F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.first("height").alias("height"),
    ).filter((F.length("title") <= LONGEST) & (F.col("y1") >= F.col("height") * MARGIN) & (F.col("y0") <= F.col("height") * (1 - MARGIN)))
    number = F.coalesce(*[F.when(F.col("title").rlike(a), F.regexp_extract("title", a, 1)) for a in ANCHORS])
    dots = F.length("number") - F.length(F.replace("number", F.lit("."), F.lit("")))
    above = F.col("size") - F.col("body_size")
    looks = (above >= DELTA) & (F.size(F.split("title", r"(?U)\s+")) <= WORDS) & ~F.col("title").rlike(r"(\.|;|,)$")
    level = F.when(F.col("number").isNotNull(), F.when(dots == 0, 1).otherwise(dots + 1)).when(looks, F.when(above >= 6, 1).when(above >= 3, 2).otherwise(3))
    return rows.join(body_size(spans), "book").withColumn("number", number).withColumn("level", level).filter("level IS NOT NULL").select("book", "page_no", "block", "line", "title", "level")
