"""Views that give the plain tables the shapes of the corpus: pages, records, contents, claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators.running import numbered
from quire.session import table


def pages(spark: SparkSession, sf: str, **parts: Column) -> DataFrame:
    """book, page_no, doc_id, chapter, text: a book is a source, a page one of its documents. Of parts, if given, only these expressions move, in place of the text."""
    kept = [c.alias(n) for n, c in parts.items()] or [F.col("text")]
    docs = table(spark, sf, "documents").select(F.col("source").alias("book"), "doc_id", F.col("lang").alias("chapter"), *kept)
    return numbered(docs, "book", "chapter", "doc_id", "page_no").select("book", "page_no", "doc_id", "chapter", *(parts or ["text"]))


def records(spark: SparkSession, sf: str) -> DataFrame:
    """A record for each line; the first line of a page of several is a header. Some lines are tables, captions, lists and the like, and some pages are missing or too low."""
    docs = table(spark, sf, "documents").select(F.col("source").alias("book"), "doc_id", F.col("lang").alias("chapter"), "text", F.size(F.split("text", "\n")).alias("n_lines"))
    placed = numbered(docs, "book", "chapter", "doc_id", "page_no", totals={"ahead": F.col("n_lines")})  # texts move once
    each = placed.select("*", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    head = (F.col("pos") == 0) & (F.col("n_lines") > 1)
    i = F.col("doc_id") * 3 + F.col("pos")
    other = F.lit("text")
    for place, label in ((5, "table"), (6, "caption"), (9, "list"), (12, "footnote"), (14, "formula")):
        other = F.when(i % 17 == place, label).otherwise(other)
    rec_no = (F.col("ahead") - F.col("n_lines") + F.col("pos")).cast("int")
    labelled = each.withColumn("label", F.when(head, "section_header").otherwise(other)).withColumn("rec_no", rec_no)
    text = (
        F.when((F.col("label") == "table") & (i % 2 == 0), F.concat(F.lit("| "), "line", F.lit(" |\n|---|")))
        .when(F.col("label") == "list", F.replace("line", F.lit(". "), F.lit("\n- "))).otherwise(F.col("line"))
    )
    return labelled.select(
        "book", "rec_no", F.concat("book", F.lit("#"), F.col("rec_no").cast("string")).alias("id"), "doc_id",
        F.when(i % 41 == 7, None).when(i % 53 == 8, F.col("page_no") - 3).otherwise(F.col("page_no")).cast("int").alias("page_no"), "chapter", "pos",
        "label", F.when(head, (F.col("doc_id") % 3 + 1).cast("int")).alias("level"), text.alias("text"),
    )


def toc_items(spark: SparkSession, sf: str) -> DataFrame:
    """Three levels of contents: chapters, a title for each page, and two parts of some pages."""
    p = pages(spark, sf, t=F.substring("text", 1, 60), u=F.substring("text", 61, 30))
    c = F.dense_rank().over(W.partitionBy("book").orderBy("chapter"))
    d = F.row_number().over(W.partitionBy("book", "chapter").orderBy("page_no"))
    r = p.select("book", "chapter", "page_no", "doc_id", c.alias("c"), d.alias("d"), "t", "u")
    code = lambda *parts: F.concat_ws(".", *[F.col(x).cast("string") for x in parts])
    top = r.groupBy("book", "c", "chapter").agg(F.min("page_no").alias("physical_index")).select(
        "book", code("c").alias("structure"), F.lit(1).alias("depth"), F.col("chapter").alias("title"), "physical_index", F.lit("yes").alias("appear_start")
    )
    even = F.when(F.col("doc_id") % 2 == 0, "yes").otherwise("no").alias("appear_start")
    low = r.select("book", code("c", "d").alias("structure"), F.lit(2).alias("depth"), F.col("t").alias("title"), F.col("page_no").alias("physical_index"), even)
    parts = r.filter("doc_id % 3 = 0").withColumn("e", F.explode(F.array(F.lit(1), F.lit(2))))
    deep = parts.select("book", code("c", "d", "e").alias("structure"), F.lit(3).alias("depth"), F.col("u").alias("title"), (F.col("page_no") + F.col("e") - 1).alias("physical_index"), even)
    return top.unionByName(low).unionByName(deep)


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def claims(spark: SparkSession, sf: str) -> DataFrame:
    """A quote from every document; one in five is reversed."""
    quote = F.when(F.col("doc_id") % 5 == 0, F.reverse(F.substring("text", 1, 40))).otherwise(
        F.substring(F.col("text"), (F.col("doc_id") % 17 + 1).cast("int"), F.lit(40))
    )
    return table(spark, sf, "documents").select(F.col("doc_id").alias("claim_id"), F.col("doc_id").alias("evidence_id"), quote.alias("quote"))


def layout(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, batches, sources): a book is a batch of pages, a line of it a layout item.

    Some items are tables with cells, pictures, empty formulas or spoilt text, some have no
    page or two. Batches of some books count their pages from 1 although they start at 41,
    some lack a page, and some have no source text.
    """
    p = pages(spark, sf)
    each = p.select(F.col("book").alias("batch"), "page_no", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("i", F.col("doc_id") * 3 + F.col("pos"))
    i, line = F.col("i"), F.col("line")
    kind = F.when(i % 13 == 4, "tables").when(i % 13 == 7, "pictures").otherwise("texts")
    text = F.when(kind != "texts", "").when((i % 19 == 3) & (i % 2 == 0), "").when(i % 23 == 5, F.concat(line, F.lit("\ufffd GLYPH<1>"))).otherwise(line)
    cells = F.when(kind == "tables", F.transform(F.split(F.substring(line, 1, 40), " "), lambda x: F.struct(x.alias("text"))))
    on = F.when(i % 29 == 6, F.array().cast("array<int>")).when(i % 31 == 8, F.array("page_no", F.col("page_no") + 1)).otherwise(F.array("page_no"))
    items = each.select("batch", kind.alias("kind"), F.when(i % 19 == 3, "formula").otherwise("text").alias("label"), text.alias("text"), cells.alias("cells"), on.cast("array<int>").alias("pages"))
    last = F.substring("book", -1, 1)
    first = F.when(last == "1", 41).otherwise(1)
    batches = p.groupBy("book").agg(F.max("page_no").alias("n")).select(
        F.col("book").alias("batch"), first.alias("start"), (first + F.col("n") - 1).alias("end"), (F.col("n") - F.when(last == "3", 1).otherwise(0)).alias("n_pages"),
        "book", F.lit("fast").alias("profile"), F.concat(F.lit("out/"), "book").alias("folder"),
    )
    chars = (F.length("text") * (F.col("doc_id") % 4 + 1)).cast("int")
    sources = p.filter(last != "7").select(F.col("book").alias("batch"), (F.col("page_no") + first - 1).alias("page"), F.when(F.col("doc_id") % 10 == 3, 5).otherwise(chars).alias("chars"))
    return items, batches, sources


def html_blocks(spark: SparkSession, sf: str) -> DataFrame:
    pattern = F.lit("<(h1|p|li)>(?:<[a-z][^>]*>)*([^<]*)")
    cut = table(spark, sf, "pages").select(
        "page_id", F.regexp_extract_all("html", pattern, F.lit(1)).alias("tags"), F.regexp_extract_all("html", pattern, F.lit(2)).alias("texts")
    )
    return cut.select("page_id", F.posexplode(F.arrays_zip("tags", "texts")).alias("pos", "b")).select("page_id", "pos", F.col("b.tags").alias("tag"), F.col("b.texts").alias("text"))


def printed(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as printed: a running header with a page number 3 too low, a chapter marker and title, some divisions; contents on pages 3 to 5."""
    base = pages(spark, sf)
    letters = F.btrim(F.regexp_replace(F.substring("text", 1, 30), "[^A-Za-z ]", ""))
    head = F.when(letters == "", "UNTITLED").otherwise(F.upper(letters))
    p = base.withColumn("head", head)
    at = F.expr("3 + ((page_no - 6) div 8)").cast("int")
    entry = F.concat_ws("", F.col("page_no").cast("string"), F.lit(". "), F.col("head"), F.lit(" ..... "), (F.col("page_no") - 3).cast("string"))
    entries = p.filter("page_no BETWEEN 6 AND 29").groupBy("book", at.alias("page_no")).agg(F.sort_array(F.collect_list(F.struct("page_no", entry.alias("line")))).alias("entries"))
    no = F.col("page_no").cast("string")
    division = F.when(F.col("page_no") % 4 == 0, F.concat(F.lit("PART "), F.expr("cast(page_no % 5 + 1 as string)"), F.lit(": "), F.substring("head", 1, 12), F.lit("\n"))).otherwise("")
    body = F.concat("head", F.lit(" "), (F.col("page_no") - 3).cast("string"), F.lit("\nCHAPTER "), no, F.lit("\n\n"), "head", F.lit("\nOUTLINE\n"), division, "text")
    joined = p.join(entries, ["book", "page_no"], "left")
    return joined.select(
        "book", "page_no", "doc_id", "chapter", "head",
        F.when(F.col("entries").isNotNull(), F.concat(F.lit("Contents\n"), F.array_join(F.transform("entries", lambda e: e["line"]), "\n"))).otherwise(body).alias("text"),
    )


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """A span for each line of a page, with a size, and a place that puts a few into the margins."""
    each = pages(spark, sf).select("book", "page_no", "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    i = F.col("doc_id") + F.col("line")
    top = (i % 50) * 20.0
    return each.select(
        "book", "page_no", F.lit(0).alias("block"), "line", F.lit(0).alias("span"), F.concat(F.when(i % 9 == 0, F.concat(i.cast("string"), F.lit(". "))).otherwise(""), F.upper(F.left("text", F.lit(1))), F.expr("substr(text, 2)")).alias("text"),
        F.when(i % 11 == 0, 17.0).when(i % 5 == 0, 12.5).otherwise(10.0).alias("size"), top.alias("y0"), (top + 12.0).alias("y1"), F.lit(1000.0).alias("height"),
    )
