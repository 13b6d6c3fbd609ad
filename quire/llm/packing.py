"""Harmonic packing of token sequences (operator 8).

Documents are cut into pieces whose lengths sit just under CAPACITY / j, the class
sizes; a bin of class j takes exactly j pieces of that class. Every worker fills its
bins alone, in one pass and with a bounded buffer (the open bin of each class). The
pieces of bins still open at a partition's end, a bounded number for each partition,
are dealt the same way once more for every GROUP partitions, and what is left there
(fewer than j pieces of each class) is packed best fit first.

Ids are those of the public byte-level vocabulary's tokenizers file, as it is loaded.
tiktoken reads the same vocabulary as ranks and is over four times as fast; it encodes
what lies between the file's added token, whose id is set here. Texts with a run of
LONG_RUN blanks, and any on which tiktoken panics, go through the file (tests compare).

Defined cases: a null text is an empty one, whose only token is the end mark; repeated
rows are packed each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, lean, read

CAPACITY = 2048
END_ID = 1
#: The added token of the vocabulary: its text in a document is one id.
ADDED, ADDED_ID = "<|endoftext|>", 50256
#: tiktoken's stack overflows on about a million blanks in a row.
LONG_RUN = 100_000
_long_run = re.compile(rf"\s{{{LONG_RUN}}}")
#: Class j holds pieces of at most CAPACITY // j tokens, j to a bin.
CLASSES = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128)
#: A piece may fall short of its class by so many tokens; else it is cut at the next class size.
SLACK = 16
#: Partitions whose open bins are packed together.
GROUP = 128

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, class int, sequence_id long, offset long, part int"


@functools.cache
def encoder():
    """The tokenizer, once for each Python process."""
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def whole_encoder():
    """The tokenizers file itself: slower, and without a bound on runs."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def _encoded(text: str) -> list[int]:
    if len(text) >= LONG_RUN and _long_run.search(text):
        return whole_encoder().encode(text, add_special_tokens=False).ids
    try:
        first, *rest = map(encoder().encode_ordinary, text.split(ADDED))
    except BaseException as e:  # noqa: BLE001  a panic of the Rust code is no Exception
        if type(e).__name__ != "PanicException":
            raise
        return whole_encoder().encode(text, add_special_tokens=False).ids
    for ids in rest:
        first.append(ADDED_ID)
        first.extend(ids)
    return first


def token_ids(text: str | None) -> np.ndarray:
    """Ids of a text and the end mark, as little-endian unsigned 32-bit numbers."""
    try:
        ids = _encoded(text or "")
    except UnicodeEncodeError:
        ids = _encoded(text.encode("utf-8", "replace").decode("utf-8"))
    return np.array([*ids, END_ID], dtype="<u4")


def class_of(length: int) -> int:
    """The class with the least room that a piece of this length fits."""
    return next(j for j in reversed(CLASSES) if CAPACITY // j >= length)


@functools.cache
def cuts(rest: int) -> tuple[int, ...]:
    """Piece lengths for what is left of a document after whole sequences."""
    out = []
    while rest:
        j = class_of(rest)
        if CAPACITY // j - rest <= SLACK:
            out.append(rest)
            break
        out.append(next(CAPACITY // k for k in CLASSES if CAPACITY // k <= rest))
        rest -= out[-1]
    return tuple(out)


def pieces(ids: np.ndarray, keep_ids: bool) -> Iterator[tuple]:
    """(start, length, crc32, bytes or None, class) of a document's pieces, in order."""
    whole, rest = divmod(len(ids), CAPACITY)
    start = 0
    for length in (*[CAPACITY] * whole, *cuts(rest)):
        raw = ids[start : start + length].tobytes()
        yield start, length, zlib.crc32(raw), raw if keep_ids else None, class_of(length)
        start += length


def _closed(rows: list[list], sequence: int) -> Iterator[tuple]:
    offset = 0
    for doc_id, start, length, crc, total, raw, j, part in rows:
        yield doc_id, start, length, crc, total, raw, j, sequence, offset, part
        offset += length


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [x.split()[0] for x in PIECE.split(", ")]
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({"doc_id": "Int64", "sequence_id": "Int64", "offset": "Int64"})


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
    names = [x.split()[0] for x in PIECE.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def packer(keep_ids: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        waiting: dict[int, list] = {j: [] for j in CLASSES}
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = token_ids(text.as_py())
                for start, length, crc, raw, j in pieces(ids, keep_ids):
                    waiting[j].append([doc_id, start, length, crc, len(ids), raw, j, part])
                    if len(waiting[j]) == j:
                        out.extend(_closed(waiting[j], (part << 32) + made))
                        waiting[j], made = [], made + 1
                if len(out) >= 20_000 or keep_ids and len(out) >= 2_000:
                    yield _arrow(out)
                    out = []
            yield _arrow(out)
        yield _arrow([(*r[:7], None, None, part) for rows in waiting.values() for r in rows])

    return pack


def pack_open(group: pd.DataFrame) -> pd.DataFrame:
    """The open pieces of GROUP partitions: whole bins of a class first, then best fit over the few left."""
    first = (1 << 62) + (int(group["part"].iloc[0]) // GROUP << 32)
    made, out, left = 0, [], []
    ordered = group.sort_values(["class", "part", "doc_id", "start"], kind="stable")
    for j, rows in ordered.groupby("class", sort=True):
        rows = list(rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "class", "part"]].itertuples(index=False, name=None))
        whole = len(rows) // j * j
        for k in range(0, whole, j):
            out.extend(_closed(rows[k : k + j], first + made))
            made += 1
        left += rows[whole:]
    bins: list[tuple[int, list]] = []
    for row in sorted(left, key=lambda r: -r[2]):
        fits = [(room, k) for k, (room, _) in enumerate(bins) if room >= row[2]]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append((CAPACITY, []))
        bins[k] = (bins[k][0] - row[2], [*bins[k][1], row])
    for _, rows in bins:
        out.extend(_closed(rows, first + made))
        made += 1
    return _frame(out)


def pack(docs: DataFrame, keep_ids: bool = True) -> DataFrame:
    """Every piece with its place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, class, ids."""
    space = Workspace(docs.sparkSession, "pack")
    dealt = space.write(docs.select("doc_id", "text").mapInArrow(lean(packer(keep_ids)), PIECE), "pieces")
    late = dealt.filter("sequence_id IS NULL").groupBy(F.expr(f"part div {GROUP}").alias("batch"))
    return (
        dealt.filter("sequence_id IS NOT NULL").unionByName(late.applyInPandas(pack_open, PIECE))
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "class", "ids")
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), keep_ids=False).drop("class", "ids")
