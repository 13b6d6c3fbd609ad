"""Removal of repeated passages by merging Burrows-Wheeler transforms (operator 9).

A byte goes if a LENGTH-byte string that covers it also starts earlier in the corpus
(smaller id, or earlier in the same document). The corpus is cut so that equal strings
meet, and each meeting place is settled by merging transforms:

1. Cut. A string's minimiser is its smallest hashed SEED-byte gram. Neighbouring strings
   with the same minimiser form a run; a string is in one run, and equal strings have
   equal minimisers. A run travels as two hashes and a place, without its text.
2. Equal runs. Of runs with equal text all but the first are repeats as a whole. Within
   each batch this is settled before the shuffle, so a passage that a third of all
   documents share costs one row a batch.
3. Unequal runs with one minimiser may share strings in part. A shared string has the
   minimiser and half of the rest of its bytes on one side of it, so only runs that
   agree with another in a hash of either side are of interest. The first copy of each
   is fetched with its text. A task splits its texts into shards, sorts each shard's
   suffixes, takes the shards' Burrows-Wheeler transforms and merges them by refining
   the interleave STEP symbols a round: the shard that each place belongs to is dealt
   out anew, stably, by the symbols before it. No suffix is compared or sorted again.
   Blocks that are still one after LENGTH symbols are the common prefixes of at least
   that length, and their members but the first are the repeats.
4. A minimiser with more than HOT runs is settled in parts of about HOT runs, so that no
   task holds all of them. Which ones to count shows in the batches of step 2: of T runs
   in P batches about T * T / P meet another there, so none with many more than
   4 * sqrt(P) is missed. Each part is merged as in 3; the strings that are first in
   their part leave it as 128-bit hashes, and of equal ones all but the first of all
   parts are repeats.
5. Spans from 2 to 4 are merged for each document and cut out.

Defined cases: a null or empty text is zero bytes and keeps the hash of the empty
string; texts shorter than LENGTH lose nothing; ids are unique, and rows that repeat an
id and text are one document with a result each; rows without an id take no part: they
lose nothing, and no other row loses anything for them; an empty table gives an empty
result;
`remove_repeats` keeps all columns, shrinks cuts to whole characters and drops
documents that are left empty by the cuts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, bounded_broadcast, lean, read

LENGTH, SEED = 100, 16
CHUNK, SHARD, BLOCK = 1 << 20, 1 << 16, 1 << 19
STEP = 3
#: Bytes of text that a worker cuts into runs at once.
PART = 4 << 20
#: Runs of one minimiser up to which they are settled by one task, and how many that meet another within their batch make it worth counting them all.
HOT, OFTEN = 4096, 16
#: Bytes of lists up to which they are broadcast with the documents' ids.
BROADCAST_LISTS = 4 << 20
U64 = np.uint64
#: Bits of a minimiser that hold its place in the chunk.
PLACE = U64((1 << 21) - 1)
_A, _B, _C = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0xD6E8FEB86659FD93)


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    size, m = 1, v
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = width - size
    return np.minimum(m[:-rest], m[rest:]) if rest else m


def runs(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Runs of the strings of all texts, as arrays: text index, start, strings, minimiser, text hash, context hashes.

    Work goes by chunks of about CHUNK bytes. A longer text is several parts that overlap
    by length - 1, so that every string is in one part; that only ends some runs early.
    """
    parts = [(i, at, t[at : at + CHUNK + length - 1]) for i, t in enumerate(texts) for at in range(0, max(1, len(t)), CHUNK)]
    found: list[tuple] = []
    chunk: list[tuple[int, int, bytes]] = []
    size = 0
    for part in [*parts, None]:
        if chunk and (part is None or size + len(part[2]) > CHUNK):
            of, base = np.array([p[0] for p in chunk]), np.array([p[1] for p in chunk])
            which, start, *rest = _runs([p[2] for p in chunk], length)
            found.append((of[which], start + base[which], *rest))
            chunk, size = [], 0
        if part is not None:
            chunk.append(part)
            size += len(part[2])
    return tuple(np.concatenate(x) for x in zip(*found)) if found else tuple(np.empty(0, np.int64) for _ in range(7))


def _context(words: np.ndarray, at: np.ndarray, size: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """32-bit hashes of the size bytes from at on; -1 where they don't lie within first and end."""
    inside = (at >= first) & (at + size <= end)
    at = np.where(inside, at, 0)
    h = np.full(len(at), size, U64)
    for offset in (*range(0, size - 7, 8), size - 8):
        h = (h ^ words[np.minimum(at + offset, len(words) - 1)]) * _C
        h ^= h >> U64(31)
    return np.where(inside, (h >> U64(33)).astype(np.int64), -1)


def _runs(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    raw = b"".join(texts)
    sizes = np.array([len(t) for t in texts])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    none = tuple(np.empty(0, np.int64) for _ in range(7))
    if len(raw) < length:
        return none
    x = np.frombuffer(raw, np.uint8).astype(U64)
    x = x[:-1] | x[1:] << U64(8)
    x = x[:-2] | x[2:] << U64(16)
    x = x[:-4] | x[4:] << U64(32)
    v = x[: 8 - SEED] * _A ^ x[SEED - 8 :] * _B
    v ^= v >> U64(32)
    v *= _C
    v = v & ~PLACE | np.arange(len(v), dtype=U64)  # of equal grams the leftmost is smallest
    m = _sliding_min(v, length - SEED + 1)
    strings = np.maximum(0, sizes - length + 1)
    has = strings > 0
    edge = np.zeros(len(m) + 1, np.int32)
    np.add.at(edge, first[has], 1)
    np.add.at(edge, (first + strings)[has], -1)
    valid = np.cumsum(edge[:-1]) > 0
    starts = np.ones(len(m), bool)
    starts[1:] = m[1:] != m[:-1]
    starts[first[has]] = True
    spots = np.flatnonzero(starts & valid)
    if not len(spots):
        return none
    rank = np.cumsum(valid)
    many = np.diff(np.append(rank[spots], rank[-1] + 1))
    view = memoryview(raw)
    digest = xxhash.xxh3_64_intdigest
    marks = np.fromiter(
        (digest(view[a:b]) for a, b in zip(spots.tolist(), (spots + many + length - 1).tolist())), U64, len(spots)
    )
    doc = np.searchsorted(first, spots, side="right") - 1
    gram = (m[spots] & PLACE).astype(np.int64)
    half, end = (length - SEED) // 2, first[doc] + sizes[doc]
    right = _context(x, gram, half + SEED, first[doc], end)
    left = _context(x, gram - half, half + SEED, first[doc], end)
    return doc, spots - first[doc], many, (m[spots] >> U64(21)).view(np.int64), marks.view(np.int64), right, left


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document, touching and overlapping ones joined."""
    order = np.lexsort((end, start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    group = np.cumsum(np.append(False, doc[1:] != doc[:-1]))
    reach = np.maximum.accumulate(end + group * (int(end.max()) + 1)) - group * (int(end.max()) + 1)
    new = np.append(True, (group[1:] != group[:-1]) | (start[1:] > reach[:-1]))
    last = np.append(np.flatnonzero(new)[1:] - 1, len(doc) - 1)
    return doc[new], start[new], reach[last]


def _cutter(length: int):
    """(doc_id, text) to runs (key and mark set) and to spans known to be repeats (key null; many: the span's end)."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1).cast(pa.large_binary())):
                ids.append(doc_id.as_py())
                texts.append(text.as_py() or b"")
                size += len(texts[-1])
                if size >= PART:
                    yield ids, texts
                    ids, texts, size = [], [], 0
            if texts:
                yield ids, texts

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, texts in parts(batches):
            ids = np.array(names, np.int64)
            doc, start, many, key, mark, right, left = runs(texts, length)
            doc = ids[doc]
            order = np.lexsort((start, doc, mark, key))
            doc, start, many, key, mark, right, left = (x[order] for x in (doc, start, many, key, mark, right, left))
            same = np.zeros(len(key), bool)
            same[1:] = (key[1:] == key[:-1]) & (mark[1:] == mark[:-1])
            twin = same.copy()  # the same place again: a repeated row
            twin[1:] &= (doc[1:] == doc[:-1]) & (start[1:] == start[:-1])
            again = same & ~twin
            d, s, e = _merged(doc[again], start[again], start[again] + many[again] + length - 1)
            one = ~same
            kinds = key[one]
            often = np.zeros(len(kinds), bool)
            often[1:] = kinds[1:] == kinds[:-1]
            often[:-1] |= kinds[1:] == kinds[:-1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([doc[one], d]), pa.int64()), pa.array(np.concatenate([start[one], s]), pa.int64()),
                    pa.array(np.concatenate([many[one], e]), pa.int64()),
                    *(pa.concat_arrays([pa.array(c[one], pa.int64()), pa.nulls(len(d), pa.int64())]) for c in (key, mark)),
                    *(pa.concat_arrays([pa.array(c[one], pa.int32(), mask=c[one] < 0), pa.nulls(len(d), pa.int32())]) for c in (right, left)),
                    pa.array(np.concatenate([often, np.zeros(len(d), bool)])),
                ],
                names=["doc_id", "start", "many", "key", "mark", "right", "left", "often"],
            )

    return cut


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Cyclic rotations of a text in the order of their first depth symbols at least, by prefix doubling."""
    rank, reach, n = symbols.astype(np.int64), 1, len(symbols)
    while True:
        pair = rank * (int(rank.max()) + 2) + np.roll(rank, -(reach % n))
        order = np.argsort(pair, kind="stable")
        ordered = pair[order]
        place = np.cumsum(np.append(False, ordered[1:] != ordered[:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = place
        reach *= 2
        if reach >= depth or place[-1] == n - 1:
            return order


def _packed(columns: list[np.ndarray]) -> tuple[np.ndarray, int] | None:
    """Symbol tuples as 16-bit ranks that keep their order, if there are few enough."""
    value = columns[0].astype(np.int64)
    for c in columns[1:]:
        value = value * 257 + c
    present = np.zeros(257 ** len(columns), bool)
    present[value] = True
    known = np.flatnonzero(present)
    if len(known) > 1 << 16:
        return None
    table = np.zeros(len(present), np.uint16)
    table[known] = np.arange(len(known), dtype=np.uint16)
    return table[value], len(known)


def merge_shards(shards: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Common prefixes of the suffixes of all shards (arrays of symbols 0..256).

    Returns for every place of the merged order its position in the concatenated shards
    and its block: suffixes in one block share their first depth symbols.
    """
    orders = [suffix_order(s, depth) for s in shards]
    shift = np.concatenate([[0], np.cumsum([len(s) for s in shards])[:-1]])
    places = np.concatenate([o + k for o, k in zip(orders, shift)])
    kind = np.uint8 if len(shards) < 256 else np.uint16
    which = np.repeat(np.arange(len(shards), dtype=kind), [len(s) for s in shards])
    transforms = [np.concatenate([s[(o - back) % len(s)] for s, o in zip(shards, orders)]) for back in range(1, STEP + 1)]
    steps: list[tuple[int, np.ndarray]] = []
    left = depth
    for width in range(STEP, 0, -1):
        packed = _packed(transforms[width - 1 :: -1])
        if packed is not None:
            steps += [(width, packed[0])] * (left // width)
            left %= width
    block = np.zeros(len(which), np.int32)
    for _, before in steps:
        symbols = np.empty_like(before)
        symbols[np.argsort(which, kind="stable")] = before  # the next of its shard's transform, place by place
        deal = np.argsort(symbols, kind="stable")
        symbols, which, block = symbols[deal], which[deal], block[deal]
        new = (symbols[1:] != symbols[:-1]) | (block[1:] != block[:-1])
        block[0] = 0
        np.cumsum(new, out=block[1:])
    at = np.empty(len(which), np.int64)
    at[np.argsort(which, kind="stable")] = places
    return at, block


def later_starts(texts: list[bytes], doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, offset) of the strings of texts that also start earlier in another text or place."""
    mark = np.zeros(1, np.uint16)
    shards, parts, size = [], [], 0
    for t in texts:
        parts += [np.frombuffer(t, np.uint8).astype(np.uint16) + 1, mark]
        size += len(t) + 1
        if size >= SHARD:
            shards.append(np.concatenate(parts))
            parts, size = [], 0
    if parts:
        shards.append(np.concatenate(parts))
    at, block = merge_shards(shards, length)
    shared = np.zeros(len(at), bool)
    equal = block[1:] == block[:-1]
    shared[1:] |= equal
    shared[:-1] |= equal
    sizes = np.array([len(t) for t in texts])
    first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    at, block = at[shared], block[shared]
    text = np.searchsorted(first, at, side="right") - 1
    offset = at - first[text]
    whole = offset + length <= sizes[text]
    text, offset, block = text[whole], offset[whole], block[whole]
    d, p = doc[text], start[text] + offset
    order = np.lexsort((p, d, block))
    d, p, block, text, offset = (x[order] for x in (d, p, block, text, offset))
    again = np.zeros(len(d), bool)
    again[1:] = block[1:] == block[:-1]
    twin = again.copy()
    twin[1:] &= (d[1:] == d[:-1]) & (p[1:] == p[:-1])
    # a twin of a first string is a first string itself
    lead = np.maximum.accumulate(np.where(again, 0, np.arange(len(d)))) if len(d) else np.empty(0, int)
    again &= ~(twin & (d == d[lead]) & (p == p[lead]))
    return text[again], offset[again]


def later_strings(texts: list[bytes], doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (doc, start, end) of the strings of texts that also start earlier in another text or place."""
    text, offset = later_starts(texts, doc, start, length)
    place = start[text] + offset
    return _merged(doc[text], place, place + length)


#: What the fetcher gives: a run with its text, its key, and the part of the key it is settled in.
FETCHED = "key long, part int, doc_id long, start long, run binary"


def _fetcher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, wanted) to a row of FETCHED for each wanted run."""
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    names = [x.split()[0] for x in FETCHED.split(", ")]

    def rows(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    for batch in batches:
        out: list[list] = [[] for _ in kinds]
        for doc_id, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), batch.column(2).to_pylist()):
            raw = text.as_py() or b""
            for w in wanted:
                for column, x in zip(out, (w["key"], w["part"], doc_id, w["start"], raw[w["start"] : w["end"]])):
                    column.append(x)
            if len(out[0]) >= 50_000:
                yield rows(out)
                out = [[] for _ in kinds]
        yield rows(out)


def _resolver(length: int):
    """Runs sorted by key to spans; blocks of about BLOCK bytes, never within a key."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        d, s, e = later_strings([r[3] for r in rows], np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), length)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (d, s, e)], names=["doc_id", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if size >= BLOCK and r[0] != last:
                    yield flush(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[3]) + 1
                last = r[0]
        if rows:
            yield flush(rows)

    return run


def _part_resolver(length: int):
    """Runs (key, part, doc_id, start, run) sorted by key and part to spans, and to the hashes (mark) of strings first in their part."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        texts, doc, start = [r[4] for r in rows], np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64)
        text, offset = later_starts(texts, doc, start, length)
        d, s, e = _merged(doc[text], start[text] + offset, start[text] + offset + length)
        gone = [set() for _ in rows]
        for t, o in zip(text.tolist(), offset.tolist()):
            gone[t].add(o)
        first = [(t, o) for t in range(len(rows)) for o in range(len(texts[t]) - length + 1) if o not in gone[t]]
        marks = [xxhash.xxh3_128_digest(texts[t][o : o + length]) for t, o in first]
        n = len(first)
        at = np.array(first, np.int64).reshape(n, 2)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([d, doc[at[:, 0]]])), pa.array(np.concatenate([s, start[at[:, 0]] + at[:, 1]])),
                pa.array(np.concatenate([e, start[at[:, 0]] + at[:, 1] + length])), pa.array([None] * len(d) + marks, pa.binary()),
            ],
            names=["doc_id", "start", "end", "mark"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if rows and r[:2] != rows[-1][:2]:
                    yield flush(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield flush(rows)

    return run


def _hot_spans(docs: DataFrame, runs: DataFrame, space: Workspace, length: int) -> DataFrame:
    """Spans (doc_id, start, end) among the runs of minimisers with many runs (parts: how many parts they make)."""
    place = F.struct("doc_id", "start")
    firsts = space.write(runs.groupBy("key", "mark").agg(F.min(place).alias("f"), F.first("many").alias("many"), F.first("parts").alias("parts")), "hot-firsts")
    same = runs.join(firsts.select("key", "mark", "f"), ["key", "mark"]).filter(place != F.col("f"))
    known = same.select("doc_id", "start", (F.col("start") + F.col("many") + length - 1).alias("end"))
    part = F.pmod(F.xxhash64("f"), F.col("parts")).cast("int")
    lists = firsts.select(F.col("f.doc_id").alias("doc_id"), F.struct("key", part.alias("part"), F.col("f.start").alias("start"), (F.col("f.start") + F.col("many") + length - 1).alias("end")).alias("w"))
    wanted = space.write(lists.groupBy("doc_id").agg(F.collect_list("w").alias("wanted")), "hot-wanted")
    texts = _with_list(docs, wanted, "wanted").mapInArrow(lean(_fetcher), FETCHED)
    settled = texts.repartition("key", "part").sortWithinPartitions("key", "part").select("key", "part", "doc_id", "start", "run")
    settled = space.write(settled.mapInArrow(lean(_part_resolver(length), 1 << 14), "doc_id long, start long, end long, mark binary"), "hot-settled")
    order = F.rank().over(W.partitionBy("mark").orderBy("doc_id", "start"))
    later = settled.filter("mark IS NOT NULL").withColumn("place", order).filter("place > 1")
    return known.union(settled.filter("mark IS NULL").select("doc_id", "start", "end")).union(later.select("doc_id", "start", "end"))


def repeated_spans(docs: DataFrame, space: Workspace, length: int = LENGTH) -> DataFrame:
    """(doc_id, spans) of every document with repeats."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    cut = space.write(docs.mapInArrow(lean(_cutter(length), 1 << 14), "doc_id long, start long, many long, key long, mark long, right int, left int, often boolean"), "runs")
    runs = cut.filter("key IS NOT NULL").drop("often")
    often = space.write(cut.filter("often").groupBy("key").count().filter(F.col("count") >= OFTEN).select("key"), "often")
    counted = runs.select("key").join(bounded_broadcast(often), "key").groupBy("key").count()
    hot = space.write(counted.filter(F.col("count") > HOT).select("key", F.ceil(F.col("count") / HOT).cast("int").alias("parts")), "hot")
    few = bounded_broadcast(hot)
    by_text, by_key = W.partitionBy("key", "mark").orderBy("doc_id", "start"), W.partitionBy("key")
    ranked = (
        runs.join(few, "key", "left_anti").repartition("key").withColumn("place", F.rank().over(by_text))
        .withColumn("lo", F.min("mark").over(by_key)).withColumn("hi", F.max("mark").over(by_key))
        .filter("place > 1 OR lo <> hi")
        .select("doc_id", "start", (F.col("start") + F.col("many") + length - 1).alias("end"), "key", "right", "left", (F.col("place") > 1).alias("known"))
    )
    ranked = space.write(ranked, "ranked")
    meets = F.greatest(*[F.count(side).over(W.partitionBy("key", side)) for side in ("right", "left")]) > 1
    cold = ranked.filter("NOT known").repartition("key").withColumn("meets", meets).filter("meets")
    wanted = cold.groupBy("doc_id").agg(F.collect_list(F.struct("key", F.lit(0).alias("part"), "start", "end")).alias("wanted"))
    texts = _with_list(docs, space.write(wanted, "wanted"), "wanted").mapInArrow(lean(_fetcher), FETCHED).drop("part")
    partly = texts.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_resolver(length), 1 << 14), "doc_id long, start long, end long")
    spans = (
        partly.union(ranked.filter("known").select("doc_id", "start", "end"))
        .union(cut.filter("key IS NULL").select("doc_id", "start", F.col("many").alias("end")))
    )
    if not hot.isEmpty():
        spans = spans.union(_hot_spans(docs, runs.join(few, "key"), space, length))
    grouped = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    found = space.write(grouped.mapInArrow(lean(_joiner), "doc_id long, spans array<struct<start:long,end:long>>"), "spans")
    for name in ("runs", "ranked", "wanted", "often", "hot", "hot-firsts", "hot-wanted", "hot-settled"):
        space.drop(name)
    return found


def _with_list(docs: DataFrame, lists: DataFrame, column: str) -> DataFrame:
    """Documents (doc_id, text) that have a list: joined by broadcast if the lists are small.

    If only the ids are, they thin the documents out before the shuffle.
    """
    joined = bounded_broadcast(lists, BROADCAST_LISTS)
    if joined is lists:
        docs = docs.join(bounded_broadcast(lists.select("doc_id")), "doc_id", "left_semi")
    return docs.join(joined, "doc_id").select("doc_id", "text", column)


def _joiner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each document joined to the longest there are."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        spans = [[{"start": a, "end": b} for a, b in _joined(x)] for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])


def _joined(spans: list[dict] | None) -> list[tuple[int, int]]:
    if not spans:
        return []
    pairs = np.array([(s["start"], s["end"]) for s in spans], np.int64)
    _, start, end = _merged(np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1])
    return list(zip(start.tolist(), end.tolist()))


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in spans:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


def _reporter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column(1).cast(pa.large_binary()), batch.column(2).to_pylist()):
            raw, spans = text.as_py() or b"", _joined(spans)
            kept = _kept(raw, spans)
            rows.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
        n, gone, many, sha = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(many, pa.int64()), pa.array(sha, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def _whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans shrunk to whole UTF-8 characters."""
    out = []
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with their spans as a last column."""
    own = "_" * (1 + max(map(len, docs.columns)))  # a name that no column has
    spans = bounded_broadcast(spans).withColumnsRenamed({"doc_id": own, "spans": f"{own}_"})
    return docs.join(spans, docs["doc_id"] == F.col(own), "left").drop(own)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with repeated passages cut out of text (and n_chars, where there is one, brought up to date)."""
    space = Workspace(docs.sparkSession, "suffix")
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            texts, keep = [], []
            for text, spans in zip(batch.column(at).cast(pa.large_binary()), batch.column(len(names)).to_pylist()):
                raw = text.as_py()
                if raw and spans:
                    left = _kept(raw, _whole_characters(raw, _joined(spans)))
                    keep.append(bool(left))
                    texts.append(left.decode("utf-8", "replace"))
                else:
                    keep.append(True)
                    texts.append(None if raw is None else raw.decode("utf-8", "replace"))
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    out = _with_spans(docs, repeated_spans(docs, space, length)).mapInArrow(lean(cut), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    spans = repeated_spans(docs, Workspace(spark, "suffix"))
    return _with_spans(docs, spans).mapInArrow(lean(_reporter), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
