"""Quality of extracted pages: counts from layout items, reasons for review, reports and the review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import occurrences
from quire.operators.audit import provenance

#: Kinds of layout items; source characters from which retention counts, and the least that is retained; what is little text.
KINDS = ("texts", "tables", "pictures")
LEAST, FRACTION, LITTLE = 300, 0.45, 30


def item_text() -> Column:
    """A table's cells joined by blanks, if it has any; else an item's text."""
    cells = F.array_join(F.transform("cells", lambda c: F.coalesce(c["text"], F.lit(""))), " ")
    return F.when((F.col("kind") == "tables") & (F.size("cells") > 0), cells).otherwise(F.coalesce("text", F.lit("")))


def artifacts(text: Column) -> Column:
    """Replacement characters and glyph codes."""
    return occurrences(text, "�") + occurrences(F.lower(text), "glyph<")


def page_counts(items: DataFrame, batches: DataFrame, watermark: str = "") -> DataFrame:
    """A row for each page of each batch (batch, start, end), pages without items included.

    items: batch, kind, label, text, cells, pages. An item on several pages counts whole on
    each; one without a page, or with any page outside its batch, counts nowhere.
    """
    text = F.col("content")
    placed = provenance(items.join(batches.select("batch", "start", "end"), "batch")).filter(~F.col("unmapped")).withColumn("content", item_text())
    spread = placed.select(
        "batch", "kind", F.explode(F.array_distinct("pages")).alias("page"), F.length(text).cast("long").alias("size"), artifacts(text).alias("artifacts"),
        (occurrences(F.lower(text), watermark) if watermark else F.lit(0).cast("long")).alias("marks"),
        ((F.col("kind") == "texts") & (F.col("label") == "formula") & (F.btrim(text) == "")).alias("blank"),
    )
    counts = spread.groupBy("batch", "page").agg(
        F.sum("size").alias("text_chars"), *[F.count_if(F.col("kind") == k).alias(k) for k in KINDS],
        F.sum("artifacts").alias("encoding_artifacts"), F.sum("marks").alias("watermark_hits"), F.count_if("blank").alias("empty_formulas"),
    )
    pages = batches.select("batch", F.explode(F.sequence("start", "end")).alias("page"))
    return pages.join(counts, ["batch", "page"], "left").na.fill(0)


def page_reasons(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """pages with source_text_chars and reasons, in a fixed order.

    sources: batch, page, chars; a batch without any row there has no source text to compare with.
    """
    known = sources.select("batch").distinct().withColumn("_known", F.lit(True))
    joined = pages.join(sources.select("batch", "page", F.col("chars").alias("source_text_chars")), ["batch", "page"], "left").join(known, "batch", "left")
    source, text, has = F.coalesce("source_text_chars", F.lit(0)), F.col("text_chars"), F.coalesce("_known", F.lit(False))
    rules = (
        ("empty_formula_text", F.col("empty_formulas") > 0),
        ("table_manual_review_required", F.col("tables") > 0),
        ("low_text_retention", has & (source >= LEAST) & (text < source * FRACTION)),
        ("image_text_review", has & (source < LITTLE) & (text < LITTLE) & (F.col("pictures") > 0)),
        ("encoding_artifact", F.col("encoding_artifacts") > 0),
        ("no_mapped_elements", sum((F.col(k) for k in KINDS), F.lit(0)) == 0),
    )
    return joined.withColumn("reasons", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))).drop("_known")


def batch_reports(items: DataFrame, batches: DataFrame, reasoned: DataFrame, sources: DataFrame) -> DataFrame:
    """(batch, status, mode, unmapped, reasons, totals): batches has n_pages, the pages that the layout file lists."""
    placed = provenance(items.join(batches.select("batch", "start", "end"), "batch"))
    mapped = placed.groupBy("batch").agg(F.count_if("unmapped").alias("unmapped"), F.max("shift").alias("shift"))
    flagged = reasoned.groupBy("batch").agg(F.count_if(F.size("reasons") > 0).alias("flagged"), *[F.sum(k).alias(k) for k in KINDS])
    known = sources.select("batch").distinct().withColumn("_known", F.lit(True))
    joined = batches.join(mapped, "batch", "left").join(flagged, "batch", "left").join(known, "batch", "left").na.fill(0, ["unmapped", "shift", "flagged", *KINDS])
    own = F.array_compact(F.array(
        F.when(F.col("n_pages") != F.col("end") - F.col("start") + 1, F.lit("page_count_mismatch")), F.when(F.col("_known").isNull(), F.lit("source_text_comparison_unavailable")),
    ))
    review = (F.size(own) > 0) | (F.col("flagged") > 0) | (F.col("unmapped") > 0)
    return joined.select(
        "batch", F.when(review, "review").otherwise("pass").alias("status"), F.when(F.col("shift") > 0, "relative").otherwise("absolute").alias("mode"), "unmapped", own.alias("reasons"), *KINDS,
    )


def review_queue(reasoned: DataFrame, reports: DataFrame, batches: DataFrame) -> DataFrame:
    """The queue's nine columns: a row for each reason of a whole batch, and one for each page with reasons or something to spot-check.

    batches: batch, book, profile, folder.
    """
    spot = F.array_compact(F.array(
        F.when((F.col("tables") > 0) & ~F.array_contains("reasons", "table_manual_review_required"), F.lit("table_spot_check")), F.when(F.col("pictures") > 0, F.lit("figure_spot_check")),
    ))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    pages = reasoned.withColumn("all", F.concat("reasons", spot)).filter(F.size("all") > 0).select(
        "batch", F.col("page").cast("string").alias("pdf_page"), F.concat_ws(";", "all").alias("reasons"), text("source_text_chars").alias("source_text_chars"),
        text("text_chars").alias("extracted_text_chars"), text("tables").alias("tables"), text("pictures").alias("pictures"),
    )
    none = F.lit("")
    whole = reports.select("batch", F.explode("reasons").alias("reasons")).select(
        "batch", F.lit("batch").alias("pdf_page"), "reasons", none.alias("source_text_chars"), none.alias("extracted_text_chars"), none.alias("tables"), none.alias("pictures"),
    )
    named = batches.select("batch", "book", "profile", F.col("folder").alias("batch_folder"))
    return whole.unionByName(pages).join(named, "batch").select(
        "book", "profile", "pdf_page", "reasons", "source_text_chars", "extracted_text_chars", "tables", "pictures", "batch_folder"
    )


def stored_queue(reports: DataFrame) -> DataFrame:
    """The queue from quality reports on disk (see sources.files.read_quality)."""
    reasons = reports.select("folder", F.explode("flagged_pages").alias("f")).select(F.col("folder").alias("batch"), "f.page", "f.reason")
    by_page = reasons.filter("page IS NOT NULL").groupBy("batch", "page").agg(F.collect_list("reason").alias("reasons"))
    pages = reports.select(F.col("folder").alias("batch"), F.explode("pages").alias("no", "p")).select("batch", F.col("no").cast("int").alias("page"), "p.*")
    reasoned = pages.join(by_page, ["batch", "page"], "left").withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>")))
    whole = reasons.filter("page IS NULL").groupBy("batch").agg(F.collect_list("reason").alias("reasons"))
    return review_queue(reasoned, whole, reports.select(F.col("folder").alias("batch"), "book", "profile", "folder"))
