"""What the operators of this package share: folds, words, Python tasks with a small footprint."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import table as read  # noqa: F401  the operators read their tables by it
from quire.workspace import Workspace, bounded_broadcast  # noqa: F401  and keep what they write in it

#: A word, here and in every contract of the package: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column) -> Column:
    """Remainder that decides whether a labelled row may be learnt from (2: held out)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def unit_hash(key: Column, seed: str) -> Column:
    """A uniform number in [0, 1) from 48 bits of an MD5, the same in every engine and run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = 1024):
    """run for mapInArrow with a small footprint: at most rows at a time, and free memory back to the system after each task.

    Python workers live on after a task, and all operators of a job share them.
    """

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(small(batches))
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return lean_run
