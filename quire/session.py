"""Session helpers shared by tests, the benchmark and the command line."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

#: Tables whose rows are long enough for spreading to pay.
WIDE = ("documents", "pages")


def build_session(app: str = "quire", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the engine expects; a running one is reused."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("QUIRE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, spread over the cores if it arrives in fewer pieces than there are.

    Pieces are of a bounded size, so what is moved for that is at most one piece a core; a
    large table has more pieces than cores and stays where it is.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in WIDE and df.rdd.getNumPartitions() < cores else df
