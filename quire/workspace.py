"""Tables that a job writes for itself, and joins whose small side is checked."""

from __future__ import annotations

import atexit
import functools
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a session on this machine alone gets a temporary folder; on a
    cluster that is an error, since executors do not see each other's folders.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _own_root()
    return root.rstrip("/")


@functools.cache
def _own_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="quire-")


class Workspace:
    """Tables written to the shared folder, which cut lineage and survive lost executors.

    A table is deleted by drop() or, at the latest, when the Python process ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/quire-{label}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.drop)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str | None = None) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            if jvm is None:
                return
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit; the folder is then the cluster's to clean
            pass


#: Bytes of data up to which a table is broadcast.
BROADCAST_BYTES = 32 << 20


def row_bytes(df: DataFrame) -> Column:
    """About what a row holds, in bytes."""

    def of(name: str, kind: T.DataType) -> Column:
        c = F.col(f"`{name}`")
        if isinstance(kind, T.StringType | T.BinaryType):
            return F.octet_length(c)
        if isinstance(kind, T.ArrayType):
            return F.size(c) * 8 * (len(kind.elementType.fields) if isinstance(kind.elementType, T.StructType) else 1)
        return F.lit(8)

    return sum((F.coalesce(of(f.name, f.dataType), F.lit(0)) for f in df.schema.fields), F.lit(16)).cast("long")


def bounded_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows hold at most max_bytes; else as it is, for a shuffled join."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= max_bytes else df
