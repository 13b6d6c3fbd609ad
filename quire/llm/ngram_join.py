"""N-gram Jaccard join with signature trees (operator 6).

A document is the set of its word shingles, as 64-bit hashes. The join runs in steps:

1. Documents with equal sets are one class; the smallest id stands for it.
2. Classes meet in blocks. A class has ROWS * bands minima of hashed shingles; classes
   that agree in all ROWS minima of a band are joined to the band's smallest class, and
   the connected groups are the blocks. Bands are so many that a pair at the threshold
   shares no band with a probability of at most MISS (1e-13; smaller the closer the pair).
   This routing is the only step that is not exact, and its odds are of the order of a
   collision of shingle hashes.
3. In a block, a signature tree is built over the classes: a node holds the OR of its
   token bitmaps, its range of set sizes and the most hash collisions below it. A dual
   traversal prunes pairs of nodes whose size ranges or whose largest possible overlap
   rule out a link, and pairs whose documents are all connected already; at the leaves
   sets are intersected.
4. A block of more than BLOCK classes is dealt out: parts are joined, each together with
   the PIVOTS classes of the block that share bands with most others (originals, as a
   rule), then the representatives of what came out. In a block that is not connected by then, the parts of
   its largest component meet all others, if those make one part; else classes meet by
   each band they share, as far as the band's classes are not yet connected: bands with
   the same classes count once, and those of more than BLOCK classes are dealt out as
   pairs of parts. So no task holds more than two parts.

Defined cases: a document with fewer words than a shingle is one shingle of all its
words; without words or text it has no shingle and is a component of its own; rows that
repeat an id and a text get one row each with equal values; rows without an id get their
set's size and no component, link nothing, and all stay in `keep_one`; an empty table
gives an empty result; other columns pass `keep_one` untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, bounded_broadcast, lean, read
from .graph import components

ROWS = 3
MISS = 1e-13
BLOCK, BLOCK_SHINGLES = 1024, 4_000_000
PIVOTS = 16
FANOUT = 8
U64 = np.uint64
_P, _C = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
_MAX_WORDS = 200_000


class _Words(dict):
    """Hash of each word seen; emptied when it grows beyond its bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MAX_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(32))
    h = h * _C
    return h ^ (h >> U64(29))


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles."""
    words = (text or b"").lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return np.empty(0, U64)
    w = np.fromiter(map(_words.__getitem__, words), U64, len(words))
    n = max(1, len(w) - k + 1)
    h = np.full(n, min(k, len(w)), U64)
    for i in range(min(k, len(w))):
        h = h * _P + w[i : i + n]
    return np.unique(_mixed(h))


def band_count(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20_406).integers(1, 1 << 63, n, dtype=U64) * U64(2) + U64(1)


def band_keys(s: np.ndarray, a: np.ndarray) -> np.ndarray:
    """A key for each band of ROWS minima."""
    low = np.full(len(a), np.iinfo(U64).max, U64)
    for i in range(0, len(s), 2048):
        low = np.minimum(low, (s[None, i : i + 2048] * a[:, None]).min(1))
    rows = low.reshape(-1, ROWS)
    h = np.arange(1, len(rows) + 1, dtype=U64)
    for i in range(ROWS):
        h = _mixed(h * _P + rows[:, i])
    return h.view(np.int64)


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _signer(k: int, threshold: float):
    bands = band_count(threshold)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _multipliers(bands * ROWS)
        for batch in batches:
            n, digests, keys = [], [], []
            for text in batch.column(1).cast(pa.large_binary()):
                s = shingles(text.as_py(), k)
                n.append(len(s))
                digests.append(_digest(s) if len(s) else None)
                keys.append(band_keys(s, a) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n", "digest", "keys"],
            )
        _words.clear()

    return sign


class Forest:
    """Union-find with the smallest member as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


class Node:
    __slots__ = ("bits", "least", "most", "excess", "below", "leaf", "tied")

    def __init__(self, bits: int, least: int, most: int, excess: int, below: list[Node], leaf: int = -1):
        self.bits, self.least, self.most, self.excess, self.below, self.leaf, self.tied = bits, least, most, excess, below, leaf, leaf >= 0


def build_tree(sets: list[np.ndarray]) -> Node:
    """A signature tree; sets with the same smallest shingle, then with near sizes, are neighbours."""
    width = 1 << max(6, min(16, (2 * max(map(len, sets))).bit_length()))
    level = []
    for i in sorted(range(len(sets)), key=lambda i: (int(sets[i][0]), len(sets[i]))):
        marks = np.zeros(width, np.uint8)
        marks[(sets[i] >> U64(17)).astype(np.int64) & (width - 1)] = 1
        bits = int.from_bytes(np.packbits(marks).tobytes(), "big")
        level.append(Node(bits, len(sets[i]), len(sets[i]), len(sets[i]) - bits.bit_count(), [], i))
    while len(level) > 1:
        groups = [level[i : i + FANOUT] for i in range(0, len(level), FANOUT)]
        level = []
        for g in groups:
            bits = 0
            for x in g:
                bits |= x.bits
            level.append(Node(bits, min(x.least for x in g), max(x.most for x in g), max(x.excess for x in g), g))
    return level[0]


def join_block(sets: list[np.ndarray], percent: int, forest: Forest) -> None:
    """Join in forest all sets connected by links of at least percent of the union.

    Every unordered pair of sets is intersected, pruned by a bound, or connected already.
    """

    def tied(x: Node) -> int:
        """The one root below x, or -1. Once one, for ever one."""
        if x.leaf >= 0:
            return forest.find(x.leaf)
        if x.tied:
            return tied(x.below[0])
        roots = {tied(y) for y in x.below}
        x.tied = len(roots) == 1 and -1 not in roots
        return roots.pop() if x.tied else -1

    def can_link(x: Node, y: Node) -> bool:
        if 100 * x.most < percent * y.least or 100 * y.most < percent * x.least:
            return False
        overlap = min((x.bits & y.bits).bit_count() + min(x.excess, y.excess), x.most, y.most)
        return (100 + percent) * overlap >= percent * (x.least + y.least)

    def within(x: Node) -> None:
        for y in x.below:
            within(y)
        for i, y in enumerate(x.below):
            for z in x.below[i + 1 :]:
                between(y, z)

    def between(x: Node, y: Node) -> None:
        root = tied(x)
        if root >= 0 and root == tied(y) or not can_link(x, y):
            return
        if x.leaf >= 0 and y.leaf >= 0:
            a, b = sets[x.leaf], sets[y.leaf]
            both = len(a) + len(b) - len(np.union1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both):
                forest.join(x.leaf, y.leaf)
        elif y.leaf >= 0 or x.leaf < 0 and len(x.below) >= len(y.below):
            for z in x.below:
                between(z, y)
        else:
            for z in y.below:
                between(x, z)

    if sets:
        within(build_tree(sets))


def _joiner(k: int, percent: int):
    """Rows (rep, digest, task, known, text), sorted by task, to links (a, b) from each class to its component in the task."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        rows = sorted({r[0]: r for r in rows}.values())
        forest, first = Forest(len(rows)), {}
        for i, r in enumerate(rows):
            forest.join(i, first.setdefault(r[1], i))
        join_block([r[2] for r in rows], percent, forest)
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([rows[forest.find(i)][0] for i in range(len(rows))], pa.int64())], names=["a", "b"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        current = None
        for batch in batches:
            rep, digest, task, known, text = (batch.column(i) for i in range(5))
            for r, d, t, o, x in zip(rep.to_pylist(), digest.to_pylist(), task.to_pylist(), known.to_pylist(), text.cast(pa.large_binary())):
                if t != current and rows:
                    yield flush(rows)
                    rows = []
                current = t
                s = shingles(x.as_py(), k)
                if _digest(s) == d:
                    rows.append((r, o, s))
        if rows:
            yield flush(rows)

    return run


def _links(docs: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """members (rep, digest, task, known) to links (a, b) within each task; texts are read again for members alone."""
    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(bounded_broadcast(members), "rep")
    dealt = texts.select("rep", "digest", "task", "known", "text").repartition("task").sortWithinPartitions("task")
    return dealt.mapInArrow(lean(_joiner(k, percent)), "a long, b long")


def ngram_components(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text)."""
    space = Workspace(docs.sparkSession, "ngram")
    docs = docs.select("doc_id", "text")
    light = space.write(docs.mapInArrow(lean(_signer(k, percent / 100)), "doc_id long, n long, digest binary, keys array<long>"), "light")
    linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    classes = space.write(
        light.filter(linked).groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys")), "classes"
    )
    bands = classes.select("rep", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    met = space.write(bands.join(shared, "key").select(F.col("rep").alias("a"), F.col("lead").alias("b"), "many", "key"), "met")
    blocks = components(met.select("a", "b"), space, "blocks").select(F.col("node").alias("rep"), F.col("label").alias("block"))
    members = space.write(classes.select("rep", "digest", "n").join(blocks, "rep"), "members")
    sizes = members.groupBy("block").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts")
    )
    big = space.write(sizes.filter("parts > 1").coalesce(8), "big")
    part = F.pmod(F.xxhash64("rep"), F.coalesce("parts", F.lit(1))).cast("int")
    members = space.write(members.join(bounded_broadcast(big), "block", "left").withColumn("part", part), "parted")
    first = members.select("rep", "digest", F.concat_ws("/", "block", "part").alias("task"), F.col("rep").alias("known"))
    if not big.isEmpty():  # the classes that meet most others go to all parts of their block
        central = met.groupBy(F.col("a").alias("rep")).agg(F.sum("many").alias("meets")).join(members.filter("parts > 1"), "rep")
        place = F.row_number().over(W.partitionBy("block").orderBy(F.desc("meets"), "rep"))
        pivots = central.withColumn("place", place).filter(f"place <= {PIVOTS}").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        first = first.union(pivots.filter("other <> part").select("rep", "digest", F.concat_ws("/", "block", "other"), "rep"))
    links = space.write(_links(docs, first, k, percent), "links")
    if not big.isEmpty():
        links = _across(docs, met, members.filter("parts IS NOT NULL"), links, space, k, percent)
    else:
        links = links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    found = classes.select("digest", "rep").join(links, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("label", "rep").alias("component_id"))
    with_set = light.filter(linked).join(found, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return with_set.union(light.filter(~linked).select("doc_id", "n", F.col("doc_id").alias("component_id")))


def _across(docs, met, members, links, space, k, percent) -> DataFrame:
    """Links between the parts of big blocks: components' representatives first, then what is not yet connected."""
    labels = lambda name: components(links, space, name).select(F.col("node").alias("rep"), "label")
    known = space.write(members.join(labels("parts"), "rep", "left").withColumn("known", F.coalesce("label", "rep")).drop("label"), "known-parts")
    leads = known.filter("rep = known").select("block", "rep", "digest")
    few = leads.groupBy("block").count().filter(f"count BETWEEN 2 AND {BLOCK}").select("block")
    heads = leads.join(bounded_broadcast(few), "block", "left_semi").select("rep", "digest", F.concat_ws("/", "block", F.lit("heads")).alias("task"), F.col("rep").alias("known"))
    links = space.write(links.union(_links(docs, space.write(heads, "heads"), k, percent)), "links-heads")
    known = space.write(members.join(labels("joined"), "rep", "left").withColumn("known", F.coalesce("label", "rep")).drop("label"), "known")
    open_blocks = known.groupBy("block").agg(F.min("known").alias("lo"), F.max("known").alias("hi")).filter("lo <> hi").select("block")
    live = known.join(bounded_broadcast(open_blocks), "block", "left_semi").select("block", "rep", "digest", "known")
    labels = live.groupBy("block", "known").agg(F.count(F.lit(1)).alias("many"))
    plan = labels.groupBy("block").agg(F.max_by("known", F.struct("many", "known")).alias("main"), F.max("many").alias("own"), F.sum("many").alias("all"))
    plan = space.write(plan.select("block", "main", F.ceil(F.col("own") / BLOCK).cast("int").alias("parts"), F.ceil((F.col("all") - F.col("own")) / BLOCK).cast("int").alias("others")).coalesce(8), "plan")
    live = space.write(live.join(bounded_broadcast(plan), "block"), "live")
    # one component and few others: parts of the component are tied already, so each meets the others alone
    spot = F.when(F.col("known") == F.col("main"), F.array(F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    main = live.filter("others = 1").withColumn("spot", F.explode(spot)).select("rep", "digest", F.concat_ws("/", "block", "spot").alias("task"), "known")
    wide = live.filter("others > 1").select("rep", "digest", "known")
    keyed = space.write(met.select(F.col("a").alias("rep"), "key").join(bounded_broadcast(wide), "rep"), "keyed")
    groups = (
        keyed.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.min("known").alias("lo"), F.max("known").alias("hi"), F.expr("bit_xor(xxhash64(rep))").alias("who"))
        .filter("lo <> hi").groupBy("many", "lo", "hi", "who").agg(F.min("key").alias("key"))
    )
    dealt = keyed.join(groups.select("key", F.ceil(F.col("many") / BLOCK).cast("int").alias("parts")), "key")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    one = dealt.filter("parts = 1").select("rep", "digest", F.col("key").cast("string").alias("task"), "known")
    many = (
        dealt.filter("parts > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("other <> part")
        .select("rep", "digest", F.concat_ws("/", "key", F.least("part", "other"), F.greatest("part", "other")).alias("task"), "known")
    )
    links = space.write(links.union(_links(docs, space.write(main.union(one).union(many), "across"), k, percent)), "links-all")
    return components(links, space, "all")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without near copies: of every component the document with the smallest id. Of rows with that id and one text, one stays."""
    space = Workspace(docs.sparkSession, "keep")
    found = space.write(ngram_components(docs, k, percent), "components")
    copies = bounded_broadcast(space.write(found.filter("doc_id <> component_id").select("doc_id").distinct(), "copies"))
    kept = docs.join(copies, "doc_id", "left_anti").select(*docs.columns)
    repeated = space.write(found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    repeated = bounded_broadcast(repeated)
    again = kept.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).union(again)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(read(spark, sf_dir, "documents"), k=4, percent=85)
