"""Short texts looked up in long ones: every window of a page is hashed and met with the asked texts, so nothing is paired to be compared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.workspace import Workspace

BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)
#: Bits of the filter for each asked text, the most bits (as a power of two), and how many of them an asked text sets.
BITS_EACH, MOST_BITS, PROBES = 32, 30, 4
#: Characters that are hashed at once.
STRETCH = 1 << 15


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def window_hashes(values: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each length the hash of the window that starts at each place, put together from windows of powers of two."""
    power = lambda n: np.uint64(pow(BASE, n, 1 << 64))
    blocks = {1: values}
    for length in lengths:
        n = len(values) - length + 1
        if n < 1:
            continue
        found, used = None, 0
        for bit in range(length.bit_length() - 1, -1, -1):
            size = 1 << bit
            if not length & size:
                continue
            if size not in blocks:
                for b in range(1, bit + 1):
                    half, whole = 1 << (b - 1), 1 << b
                    if whole not in blocks:
                        low = blocks[half]
                        blocks[whole] = low[:-half] * power(half) + low[half:]
            part = blocks[size][used : used + n]
            found = part if found is None else found * power(size) + part
            used += size
        yield length, found


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash whose every bit depends on all of x."""
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def places(x: np.ndarray, bits: int, probe: int) -> np.ndarray:
    """The bit of the filter that a hash sets or asks; the first probe, which every window goes through, is the cheapest."""
    return (x if probe == 0 else mixed(x + np.uint64(probe))) * MIX >> np.uint64(64 - bits)


def _filter(asked: DataFrame, bits: int) -> bytes:
    """A Bloom filter of (book, question), made in blocks of 4 KB."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            books, texts = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), batch.column(1).to_pylist()
            size = np.array([len(t) for t in texts], np.int64)
            start = np.cumsum(size) - size
            for length, hashes in window_hashes(codes("".join(texts)), sorted(set(size.tolist()))):
                own = size == length
                x = hashes[start[own]] * MIX + books[own]
                at = np.concatenate([places(x, bits, p) for p in range(PROBES)])
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64) + 1)], names=["at"])  # bitmaps count from 1

    bit = asked.select(F.xxhash64("book"), "question").mapInArrow(marks, "at long")
    blocks = bit.groupBy(F.bitmap_bucket_number("at").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("marks"))
    table = bytearray(1 << (bits - 3))
    for row in blocks.toLocalIterator():
        table[(row.block - 1) * 4096 : row.block * 4096] = row.marks
    return bytes(table)


def first_holding(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(book, query_id, page_no): the first page of the book that holds the question (texts: book, page_no, text; asked: book, query_id, question, short and not empty).

    Windows of the questions' lengths go through a filter of all questions, and what passes
    is grouped by its very characters, so the result is exact. What moves is a row for each
    page and question that it holds, before it is grouped, and the filter: 4 bytes a question.
    """
    spark = texts.sparkSession
    asked = Workspace(spark, "asked").write(asked.filter("book IS NOT NULL AND question <> ''"), "asked")
    lengths = sorted(r.n for r in asked.select(F.length("question").alias("n")).distinct().collect())
    bits = min(MOST_BITS, max(15, (BITS_EACH * asked.count()).bit_length()))
    marks = spark.sparkContext.broadcast(_filter(asked, bits))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(marks.value, np.uint8)
        for batch in batches:
            size = np.array(batch.column(4).to_numpy(zero_copy_only=False), np.int64)
            cuts = np.unique(np.searchsorted(np.cumsum(size), np.arange(STRETCH, size.sum() + STRETCH, STRETCH), side="left") + 1)
            begin = 0
            for end in cuts.tolist():
                if begin < batch.num_rows:
                    yield from stretch(batch.slice(begin, end - begin), table)
                begin = end

    marked = (1 << np.arange(8)).astype(np.uint8)

    def stretch(batch: pa.RecordBatch, table: np.ndarray) -> Iterator[pa.RecordBatch]:
        names, pages, keys, texts_ = (batch.column(i).to_pylist() for i in range(4))
        whole = "".join(texts_)
        values, size = codes(whole), np.array([len(t) for t in texts_], np.int64)
        page_at = np.array(pages, np.int64)
        of = np.repeat(np.arange(len(size)), size)
        ends = np.cumsum(size)[of]
        book = np.array(keys, np.int64).view(np.uint64)[of]
        for length, hashes in window_hashes(values, lengths):
            x, spot = hashes * MIX + book[: len(hashes)], None
            for probe in range(PROBES):
                bit = places(x, bits, probe).view(np.int64)
                held = np.flatnonzero(table.take(bit >> 3) & marked.take(bit & 7))
                x, spot = x[held], held if spot is None else spot[held]
            held = np.flatnonzero(spot + length <= ends[spot])  # no window reaches into the next page
            x, spot = x[held], spot[held]
            if not len(x):
                continue
            order = np.lexsort((page_at[of[spot]], x))
            x, spot = x[order], spot[order]
            first = np.r_[True, x[1:] != x[:-1]]
            head = spot[np.flatnonzero(first)[np.cumsum(first) - 1]]
            step = np.arange(length)
            equal = (book[spot] == book[head]) & (values[spot[:, None] + step] == values[head[:, None] + step]).all(axis=1)
            chosen = spot[first | ~equal].tolist()
            rows = of[chosen].tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[r] for r in rows], pa.string()), pa.array([whole[i : i + length] for i in chosen], pa.string()), pa.array(page_at[rows])], names=["book", "question", "page_no"]
            )

    read = texts.filter("book IS NOT NULL AND text IS NOT NULL").select("book", F.col("page_no").cast("long").alias("page_no"), F.xxhash64("book").alias("key"), "text", F.length("text").alias("n"))
    held = read.mapInArrow(look, "book string, question string, page_no long").groupBy("book", "question").agg(F.min("page_no").cast("int").alias("page_no"))
    return asked.join(held, ["book", "question"]).select("book", "query_id", "page_no")
