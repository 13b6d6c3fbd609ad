"""Layout conversion as a table: page ranges in, documents out, items and exports from those."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONVERTED = "batch string, path string, start int, end int, document string, markdown string, error string"
PLACES = "array<struct<page_no:int>>"
ITEM = f"struct<self_ref:string,label:string,text:string,caption:string,html:string,image:string,data:struct<table_cells:array<struct<text:string>>>,prov:{PLACES}>"
DOCUMENT = f"struct<pages:map<string,string>,texts:array<{ITEM}>,tables:array<{ITEM}>,pictures:array<{ITEM}>>"


def converted(batches: DataFrame, convert: Callable[[str, int, int], tuple[str, str]]) -> DataFrame:
    """Batches (batch, path, start, end) with what convert(path, start, end) gives: a layout document as JSON, and Markdown.

    A batch whose conversion fails keeps its error and nothing else; the rest go on.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                try:
                    out.append((*r, *convert(r.path, r.start, r.end), None))
                except Exception as error:  # noqa: BLE001  whatever a converter raises is that batch's result
                    out.append((*r, None, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in CONVERTED.split(", ")])

    return batches.select("batch", "path", F.col("start").cast("int"), F.col("end").cast("int")).mapInPandas(run, CONVERTED)


def checked(batches: DataFrame) -> DataFrame:
    """Converted batches with reason: why one may not be published, null if it may."""
    parsed = F.from_json("document", DOCUMENT)
    reason = (
        F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("document").isNull() | parsed["pages"].isNull(), "no page map")
        .when(F.btrim(F.coalesce("markdown", F.lit(""))) == "", "no text")
    )
    return batches.withColumn("reason", reason)


def published(batches: DataFrame, path: str) -> int:
    """Write what passes, whole or not at all: Spark's committer moves a finished table into place. Returns the number of batches left out, which are written beside it."""
    found = checked(batches)
    found.filter("reason IS NULL").drop("reason", "error").write.mode("overwrite").parquet(f"{path}/documents")
    found.filter("reason IS NOT NULL").select("batch", "path", "start", "end", "reason").write.mode("overwrite").json(f"{path}/failed")
    return batches.sparkSession.read.schema("batch string").json(f"{path}/failed").count()


def layout_items(batches: DataFrame) -> DataFrame:
    """(batch, kind, label, text, cells, pages) of converted batches."""
    parsed = batches.select("batch", F.from_json("document", DOCUMENT).alias("d"))
    kinds = [parsed.select("batch", F.lit(k).alias("kind"), F.explode(f"d.{k}").alias("i")) for k in ("texts", "tables", "pictures")]
    every = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    pages = F.array_distinct(F.filter(F.transform(F.coalesce("i.prov", F.array().cast(PLACES)), lambda p: p["page_no"]), lambda p: p.isNotNull()))
    return every.select("batch", "kind", "i.label", "i.text", F.col("i.data.table_cells").alias("cells"), pages.alias("pages"))


def exports(batches: DataFrame) -> DataFrame:
    """(batch, kind, number, self_ref, pages, file, caption, content): tables as HTML and pictures as encoded images, each under its file name; file is null where there is no content."""
    parsed = batches.select("batch", F.from_json("document", DOCUMENT).alias("d"))
    found = None
    for kind, field, name, end in (("tables", "html", "table", "html"), ("pictures", "image", "figure", "png")):
        each = parsed.select("batch", F.posexplode(f"d.{kind}").alias("at", "i"))
        pages = F.sort_array(F.array_distinct(F.transform(F.coalesce("i.prov", F.array().cast(PLACES)), lambda p: p["page_no"])))
        content = F.when(F.btrim(F.coalesce(f"i.{field}", F.lit(""))) != "", F.col(f"i.{field}"))
        folder = "tables" if name == "table" else "figures"
        file = F.format_string(f"{folder}/{name}_%05d_page_%05d.{end}", F.col("at") + 1, F.coalesce(F.get(pages, F.lit(0)), F.lit(0)))
        rows = each.select("batch", F.lit(kind).alias("kind"), (F.col("at") + 1).alias("number"), "i.self_ref", pages.alias("pages"), F.when(content.isNotNull(), file).alias("file"), F.coalesce("i.caption", F.lit("")).alias("caption"), content.alias("content"))
        found = rows if found is None else found.unionByName(rows)
    return found
