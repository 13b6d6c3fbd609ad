"""Trees on disk: building them for page text files, checking them again, asking them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import indexer, trees
from quire.sources import files
from quire.treeloop import ask_trees


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return files.read_page_text(spark, folder).select(F.col("doc").alias("book"), F.col("page").alias("page_no"), "text")


def stored_nodes(spark: SparkSession, folder: str) -> DataFrame | None:
    """Nodes of the trees in a folder, or none if there are none."""
    if not (os.path.isdir(folder) and any(n.endswith("_pageindex.json") for n in os.listdir(folder))):
        return None
    flat = trees.flatten_trees(spark, files.read_trees(spark, folder))
    inner = flat.select(F.col("doc").alias("_d"), F.slice("path", F.lit(1), F.size("path") - 1).alias("_p")).distinct().withColumn("_inner", F.lit(True))
    joined = flat.join(inner, (F.col("doc") == F.col("_d")) & (F.col("path") == F.col("_p")), "left")
    return joined.withColumn("is_leaf", F.col("_inner").isNull()).drop("_d", "_p", "_inner")


def revalidated(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame | None:
    """(book, ok, reasons) of the trees in a folder against their page counts."""
    nodes = stored_nodes(spark, folder)
    totals = pages.groupBy("book").agg(F.count(F.lit(1)).alias("n_pages"))
    return None if nodes is None else trees.validate(nodes.withColumnRenamed("doc", "book"), totals)


def index_books(spark: SparkSession, pages_folder: str, folder: str, only: list[str] | None = None, escalate: bool = True, check_only: bool = False) -> dict:
    """Status, mode and reasons of every book; trees that pass are written, the last one tried of a book that fails is kept apart, and logs say how it went."""
    pages = _pages(spark, pages_folder)
    pages = pages.filter(F.col("book").isin(only)) if only else pages
    cached = revalidated(spark, pages, folder)
    if check_only:
        rows = cached.orderBy("book").collect() if cached is not None else []  # a row a book
        return {r["book"]: "ok" if r["ok"] else r["reasons"] for r in rows}
    results, nodes = indexer.choose(pages, cached, escalate)
    os.makedirs(folder, exist_ok=True)
    found = {r["book"]: r.asDict() for r in results.collect()}  # a row a book
    for row in indexer.nested(nodes).toLocalIterator():  # one tree at a time
        files.write_tree(spark, folder, row["doc"], row["tree"])
    for book, r in found.items():
        if r["status"] == "failed":
            files.failed_tree(spark, folder, book, "manual" if escalate else "flash", '{"structure": []}')
        files.append_log(os.path.join(folder, "logs"), book, f"{r['status']} {r['mode'] or ''} {r['reasons']}".strip())
    return found


def query_trees(spark: SparkSession, question: str, pages_folder: str, folder: str, summary_only: bool = False) -> list[dict]:
    nodes = stored_nodes(spark, folder)
    return [] if nodes is None else ask_trees(spark, question, nodes.withColumn("summary", F.lit("")), _pages(spark, pages_folder), summary_only=summary_only)
