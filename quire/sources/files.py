"""File sources and sinks: record lines, trees, page text, quality reports, review queues."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = (
    "id string, book string, label string, text string, level int, page_no int, chapter string, "
    "heading_path_str string, front_matter boolean, page_end int"
)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Record lines with their place in the book (the number after # in the id)."""
    return spark.read.schema(RECORD).json(path).withColumn("rec_no", F.expr("try_cast(substring_index(id, '#', -1) AS INT)"))


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """(doc, tree): one JSON tree a file; the name loses every "_pageindex"."""
    name = F.regexp_extract(F.url_decode(F.input_file_name()), r"([^/]+)\.json$", 1)
    return spark.read.option("pathGlobFilter", "*_pageindex.json").text(path, wholetext=True).select(
        F.replace(name, F.lit("_pageindex"), F.lit("")).alias("doc"), F.col("value").alias("tree")
    )


def read_page_text(spark: SparkSession, path: str) -> DataFrame:
    """(doc, page, text) from text files whose pages are parted by form feeds."""
    name = F.regexp_extract(F.url_decode(F.input_file_name()), r"([^/]+)\.txt$", 1)
    cut = spark.read.text(path, wholetext=True).select(name.alias("doc"), F.posexplode(F.split("value", "\f")).alias("at", "text"))
    return cut.select("doc", (F.col("at") + 1).alias("page"), "text")


def list_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, size) of PDF files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def list_files(spark: SparkSession, paths: list[str], pattern: str = "*.pdf") -> DataFrame:
    """(name, path) of the files of several folders, each file once, by name."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(paths)
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "path").distinct().orderBy("name", "path")


def write_review_queue(queue: DataFrame, path: str) -> None:
    queue.write.mode("overwrite").option("header", True).csv(path)


def replace_books(df: DataFrame, path: str) -> None:
    """Replace the partitions of the books in df, and those alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book").parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("append").parquet(path)


def write_report(spark: SparkSession, path: str, text: str) -> None:
    """A report of a driver as one file, replacing an older one."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()


ITEMS = "array<struct<label:string,text:string,prov:array<struct<page_no:int>>>>"


def read_list_items(spark: SparkSession, path: str) -> DataFrame:
    """(book, pos, text, page) of the list items in layout files (JSON, one a book), in order, with the first page of each; none for a book without a file."""
    name = F.regexp_extract(F.url_decode(F.input_file_name()), r"([^/]+)\.json$", 1)
    files = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).select(name.alias("book"), F.from_json("value", f"texts {ITEMS}").alias("d"))
    each = files.select("book", F.posexplode("d.texts").alias("pos", "t")).filter("t.label = 'list_item'")
    return each.select("book", "pos", F.btrim(F.regexp_replace("t.text", r"(?U)\s+", " ")).alias("text"), F.get("t.prov", F.lit(0))["page_no"].alias("page"))


def page_chars(spark: SparkSession, path: str) -> DataFrame:
    """(doc, page, chars) of form-feed separated page texts, stripped; the number of rows of a document is its page count."""
    return read_page_text(spark, path).select("doc", "page", F.length(F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).alias("chars"))


def page_counts(spark: SparkSession, path: str) -> DataFrame:
    """(doc, n_pages) of page text files; a text that ends in a form feed has no page after it."""
    name = F.regexp_extract(F.url_decode(F.input_file_name()), r"([^/]+)\.txt$", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("doc"), F.size(F.split(F.regexp_replace("value", "\f$", ""), "\f")).alias("n_pages"))


def read_quality(spark: SparkSession, path: str) -> DataFrame:
    """Quality reports and their manifests of extraction folders (book/profile/pages-a-b), a row a batch."""
    place = F.regexp_extract(F.url_decode(F.input_file_name()), r"^(.*)/[^/]+$", 1)
    page = "struct<text_chars:long,source_text_chars:long,texts:long,tables:long,pictures:long,encoding_artifacts:long>"
    report = f"status string, flagged_pages array<struct<page:int,reason:string>>, pages map<string,{page}>, unmapped_elements long"
    quality = spark.read.text(f"{path}/*/*/pages-*/quality.json", wholetext=True).select(place.alias("folder"), F.from_json("value", report).alias("q"))
    manifest = spark.read.text(f"{path}/*/*/pages-*/manifest.json", wholetext=True).select(place.alias("folder"), F.from_json("value", "source string").alias("m"))
    joined = quality.join(manifest, "folder")
    return joined.select("folder", F.regexp_extract("m.source", r"([^/]+)$", 1).alias("book"), F.regexp_extract("folder", r"([^/]+)/[^/]+$", 1).alias("profile"), "q.*")


def failed_tree(spark: SparkSession, folder: str, doc: str, mode: str, tree: str) -> str:
    """Keep a tree that did not pass beside the others, under a name that no reader takes up."""
    path = f"{folder}/{doc}_{mode}_FAILED.json"
    write_report(spark, path, tree)
    return path


def write_tree(spark: SparkSession, folder: str, doc: str, tree: str) -> str:
    path = f"{folder}/{doc}_pageindex.json"
    write_report(spark, path, tree)
    return path


def append_log(folder: str, doc: str, text: str) -> None:
    """Add to a book's log; logs lie with the driver."""
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, f"{doc}.log"), "a", encoding="utf-8") as out:
        out.write(text if text.endswith("\n") else text + "\n")
