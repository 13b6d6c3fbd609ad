"""Queries on extraction quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import quality
from quire.plans import oracles as O
from quire.plans.queries import query
from quire.sources import views as V


def _reasoned(s, d):
    items, batches, sources = V.layout(s, d)
    return items, batches, sources, quality.page_reasons(quality.page_counts(items, batches), sources)


@query(O.LAYOUT, body="SELECT batch, page, text_chars, texts, tables, pictures, encoding_artifacts, empty_formulas FROM counts_v")
def page_quality(s, d):
    items, batches, _ = V.layout(s, d)
    return quality.page_counts(items, batches).select("batch", F.col("page").cast("long").alias("page"), "text_chars", "texts", "tables", "pictures", "encoding_artifacts", "empty_formulas")


@query(O.LAYOUT, body="SELECT batch, page, array_to_string(reasons, ';') AS reasons, CAST(chars AS BIGINT) AS source_text_chars FROM reason_v")
def quality_flags(s, d):
    return _reasoned(s, d)[3].select("batch", F.col("page").cast("long").alias("page"), F.concat_ws(";", "reasons").alias("reasons"), F.col("source_text_chars").cast("long").alias("source_text_chars"))


@query(O.LAYOUT, body="""SELECT batch, CASE WHEN len(reasons) > 0 OR flagged > 0 OR unmapped > 0 THEN 'review' ELSE 'pass' END AS status, CASE WHEN shift > 0 THEN 'relative' ELSE 'absolute' END AS mode, unmapped, array_to_string(reasons, ';') AS reasons, texts, tables, pictures FROM report_v""")
def quality_batches(s, d):
    items, batches, sources, reasoned = _reasoned(s, d)
    return quality.batch_reports(items, batches, reasoned, sources).withColumn("reasons", F.concat_ws(";", "reasons"))


@query(O.LAYOUT, body="""SELECT batch AS book, 'fast' AS profile, 'batch' AS pdf_page, unnest(reasons) AS reasons, '' AS source_text_chars, '' AS extracted_text_chars, '' AS tables, '' AS pictures, 'out/' || batch AS batch_folder FROM report_v
 UNION ALL SELECT batch, 'fast', CAST(page AS VARCHAR), array_to_string(list_concat(reasons, CASE WHEN pictures > 0 THEN ['figure_spot_check'] ELSE []::VARCHAR[] END), ';'), coalesce(CAST(chars AS VARCHAR), ''), CAST(text_chars AS VARCHAR), CAST(tables AS VARCHAR), CAST(pictures AS VARCHAR), 'out/' || batch FROM reason_v WHERE len(reasons) > 0 OR pictures > 0""")
def review_queue(s, d):
    items, batches, sources, reasoned = _reasoned(s, d)
    return quality.review_queue(reasoned, quality.batch_reports(items, batches, reasoned, sources), batches)
