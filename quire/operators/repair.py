"""Checks and repair of exported assets, and what lets a stopped extraction go on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import local_asset, portable_links

IMAGE = r"!\[[^\]]*\]\(([^)]*)\)"
#: What a repaired quality report keeps of the old one.
CARRIED = ("pdf", "profile", "start_page", "end_page", "seconds", "tool_version", "converted_at", "settings")


def image_links(exports: DataFrame) -> DataFrame:
    """(folder, uri, path): every image link of the exports (folder, markdown); path is null unless it names an asset."""
    each = exports.select("folder", F.explode(F.regexp_extract_all("markdown", F.lit(IMAGE), F.lit(1))).alias("uri"))
    return each.withColumn("path", local_asset(F.col("uri")))


def broken_links(exports: DataFrame, files: DataFrame) -> DataFrame:
    """(folder, uri, reason): local links that name no asset, and assets that are not among files (folder, path)."""
    links = image_links(exports).filter(~F.col("uri").rlike("^(?i:https?|data):"))
    known = files.select("folder", "path").distinct().withColumn("_there", F.lit(True))
    reason = F.when(F.col("path").isNull(), "unsupported local image path").when(F.col("_there").isNull(), "missing")
    return links.join(known, ["folder", "path"], "left").withColumn("reason", reason).filter("reason IS NOT NULL").select("folder", "uri", "reason")


def repaired(exports: DataFrame, files: DataFrame) -> DataFrame:
    """(folder, markdown, changed) of exports without a broken link; those with one are left as they are, for review."""
    bad = broken_links(exports, files).select("folder").distinct()
    new = portable_links(F.col("markdown"))
    return exports.join(bad, "folder", "left_anti").select("folder", new.alias("markdown"), (new != F.col("markdown")).alias("changed"))


def carry_over(new: DataFrame, old: DataFrame, keys: tuple[str, ...] = CARRIED) -> DataFrame:
    """New quality reports by folder, with the old report's values of some columns."""
    kept = [c for c in keys if c in old.columns]
    before = old.select("folder", *[F.col(c).alias(f"_{c}") for c in kept])
    rest = [F.coalesce(F.col(f"_{c}"), F.col(c) if c in new.columns else F.lit(None)).alias(c) for c in kept]
    return new.join(before, "folder", "left").select(*[c for c in new.columns if c not in kept], *rest)


def to_extract(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted batches without a stored manifest that equals theirs in every key; null equals null."""
    same = None
    left, right = wanted.alias("w"), stored.select(*keys).distinct().alias("s")
    for k in keys:
        one = F.col(f"w.{k}").eqNullSafe(F.col(f"s.{k}"))
        same = one if same is None else same & one
    return left.join(right, same, "left_anti")
