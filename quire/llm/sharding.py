"""Sharding by a k-d tree with distributed weighted medians (operator 2).

Every document is a point with integer metadata dimensions and a weight, its bytes:
language, source, bytes, characters, lines and a checksum of the text. A node that has
to become n leaves is split at the weighted quantile of floor(n / 2) / n along its
widest dimension (extent relative to the whole table's) until each node is one leaf, so
leaves hold near equal bytes for any number of them.

Quantiles come from histograms: sums of weight by bucket, added up map-side and then
along the buckets of each node inside Spark; the bucket that holds the quantile is
refined until it is light or one value wide. The driver sees one row a node and round.
The tree is a table (node, dimension, cut) a level; points meet it by broadcast joins of
at most as many rows as there are leaves.

Equal texts stay together: a group of them has one language and source, the smallest
that occur in it. Only groups that differ within are joined for that. The last dimension,
a hash of the id, is used only where a single group of equal texts outweighs what the
other dimensions can balance.

Defined cases: a null text has no bytes, weight 1 and the checksum of the empty text;
null languages and sources come first; repeated rows are points of their own; a null id
is an id like others; an empty table gives an empty result; columns other than doc_id,
text, lang and source are ignored, and the latter two may be missing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, bounded_broadcast, read

BUCKETS = 4096
#: Imbalance of a split, as a part of the node's weight, up to which a wider dimension is kept.
TOLERANCE = 0.004
#: Imbalance beyond which equal texts are dealt over both sides.
GROUP_TOLERANCE = 0.02
#: A bucket lighter than this part of its node need not be refined.
FINE = 0.0005
SLOT_BLOCK = 20_000
DIMENSIONS = ("lang_mark", "source_mark", "size", "chars", "lines", "text_crc32", "id_mark")


def _mark(name: Column) -> Column:
    """The first seven bytes of a name as a number, in the names' order; -1 for null."""
    head = F.rpad(F.hex(F.substring(name.cast("binary"), 1, 7)), 14, "0")
    return F.coalesce(F.conv(head, 16, 10).cast("long"), F.lit(-1).cast("long"))


def points(docs: DataFrame, space: Workspace) -> DataFrame:
    """(doc_id, size, text_crc32, and the dimensions): one point a document."""
    text = F.coalesce("text", F.lit(""))
    of = lambda c: _mark(F.col(c)) if c in docs.columns else F.lit(-1).cast("long")
    each = space.write(docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.length(text).cast("long").alias("chars"),
        (F.octet_length(text) - F.octet_length(F.translate(text, "\n", ""))).cast("long").alias("lines"),
        of("lang").alias("lang_mark"),
        of("source").alias("source_mark"),
        F.xxhash64(text).alias("mark"),
        F.xxhash64(F.lit("id"), "doc_id").bitwiseAND(F.lit(0xFFFFFFFF)).alias("id_mark"),
    ), "raw")
    names = ("lang_mark", "source_mark")
    groups = each.groupBy("mark", "size", "text_crc32").agg(*[f(c).alias(f"{p}_{c}") for c in names for p, f in (("lo", F.min), ("hi", F.max))])
    mixed = groups.filter(" OR ".join(f"lo_{c} <> hi_{c}" for c in names)).drop(*[f"hi_{c}" for c in names])
    mixed = space.write(mixed, "mixed")
    joined = each.join(bounded_broadcast(mixed), ["mark", "size", "text_crc32"], "left")
    return joined.select("doc_id", "size", "text_crc32", "chars", "lines", "id_mark", *[F.coalesce(f"lo_{c}", c).alias(c) for c in names])


class KdTree:
    """Splits by level: rows (node, dimension, cut) of the nodes that are split; a node's children are 2n and 2n + 1."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.levels: list[list[tuple[int, int, int]]] = []

    def leaves(self, at: DataFrame) -> DataFrame:
        """at with the column node, its leaf so far."""
        at = at.withColumn("node", F.lit(1).cast("long"))
        values = F.array(*[F.col(d) for d in DIMENSIONS])
        for level in self.levels:
            table = F.broadcast(self.spark.createDataFrame(level, "node long, _dim int, _cut long"))  # a row a split node
            low = F.get(values, F.col("_dim")) <= F.col("_cut")
            at = at.join(table, "node", "left").withColumn(
                "node", F.when(F.col("_dim").isNull(), F.col("node")).otherwise(F.col("node") * 2 + F.when(low, 0).otherwise(1))
            ).drop("_dim", "_cut")
        return at


def _quantiles(at: DataFrame, chosen: dict[tuple[int, int], tuple[int, int]], total: dict[int, int], share: dict[int, float]) -> dict[tuple[int, int], tuple[int, int]]:
    """For each (node, dimension) with its span: the cut nearest to the node's share of the weight, and the weight at or below it."""
    spark = at.sparkSession
    spans = {key: (lo, hi, 0) for key, (lo, hi) in chosen.items()}
    found: dict[tuple[int, int], tuple[int, int]] = {}
    value = F.get(F.array(*[F.col(d) for d in DIMENSIONS]), F.col("_dim"))
    while spans:
        rows = [(n, d, lo, hi, max(1, -(-(hi - lo + 1) // BUCKETS)), below, share[n] * total[n]) for (n, d), (lo, hi, below) in spans.items()]
        asked = F.broadcast(spark.createDataFrame(rows, "node long, _dim int, _lo long, _hi long, _step long, _below long, _want double"))
        hist = (
            at.join(asked, "node").withColumn("_v", value).filter("_v BETWEEN _lo AND _hi")
            .groupBy("node", "_dim", F.expr("(_v - _lo) div _step").alias("bucket"))
            .agg(F.sum("size").alias("weight"), F.min("_v").alias("least"), F.max("_v").alias("most"), F.first("_below").alias("_below"), F.first("_want").alias("_want"))
        )
        along = W.partitionBy("node", "_dim").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
        reached = hist.withColumn("run", F.sum("weight").over(along) + F.col("_below")).filter("run >= _want")
        nexts: dict[tuple[int, int], tuple[int, int, int]] = {}
        for r in reached.groupBy("node", "_dim").agg(F.min(F.struct("bucket", "weight", "run", "least", "most")).alias("b")).collect():  # a row a node and dimension
            key, b = (r["node"], r["_dim"]), r["b"]
            want, before = share[key[0]] * total[key[0]], b["run"] - b["weight"]
            if b["least"] < b["most"] and b["weight"] > FINE * total[key[0]]:
                nexts[key] = (b["least"], b["most"], before)
            else:
                found[key] = (b["least"] - 1, before) if want - before < b["run"] - want else (b["most"], b["run"])
        spans = nexts
    return found


def build_tree(at_root: DataFrame, leaves: int) -> tuple[KdTree, dict[int, int]]:
    """The tree, and the leaf number of each of its final nodes."""
    tree = KdTree(at_root.sparkSession)
    ends = [f(d).alias(f"{n}{i}") for i, d in enumerate(DIMENSIONS) for n, f in (("lo", F.min), ("hi", F.max))]
    parts, extent = {1: (0, leaves)}, None
    while any(n > 1 for _, n in parts.values()):
        stats = {r["node"]: r for r in tree.leaves(at_root).groupBy("node").agg(F.sum("size").alias("w"), *ends).collect()}  # a row a node
        open_ = {n for n, (_, many) in parts.items() if many > 1 and n in stats}
        if not open_:
            break
        extent = extent or [max(1, stats[1][f"hi{i}"] - stats[1][f"lo{i}"]) for i in range(len(DIMENSIONS))]
        total = {n: stats[n]["w"] for n in open_}
        share = {n: (parts[n][1] // 2) / parts[n][1] for n in open_}
        last = len(DIMENSIONS) - 1
        wide = {n: [(stats[n][f"hi{i}"] - stats[n][f"lo{i}"]) / extent[i] for i in range(len(DIMENSIONS))] for n in open_}
        ranked = {n: [i for i in sorted(range(last), key=lambda i: (-wide[n][i], i)) if wide[n][i] > 0] + [last] for n in open_}
        best: dict[int, tuple[float, int, int]] = {}
        at, waiting = tree.leaves(at_root), set(open_)
        for dims in (range(last), [last]):
            asked = {(n, d): (stats[n][f"lo{d}"], stats[n][f"hi{d}"]) for n in waiting for d in ranked[n] if d in dims}
            cuts = _quantiles(at, asked, total, share)
            for n in waiting:
                for d in ranked[n]:  # the widest dimension, unless another one splits better by more than is tolerated
                    if (n, d) in cuts:
                        cut, left = cuts[n, d]
                        off = abs(left - share[n] * total[n]) / max(1, total[n])
                        if n not in best or best[n][0] > TOLERANCE and off < best[n][0] - (GROUP_TOLERANCE if d == last else TOLERANCE):
                            best[n] = (off, d, cut)
            waiting = {n for n in waiting if n not in best or best[n][0] > TOLERANCE}
        tree.levels.append([(n, best[n][1], best[n][2]) for n in sorted(best)])
        nexts = {}
        for n, (first, many) in parts.items():
            if n in best:
                nexts[2 * n], nexts[2 * n + 1] = (first, many // 2), (first + many // 2, many - many // 2)
            else:
                nexts[n] = (first, many)
        parts = nexts
        if not best:
            break
    return tree, {n: first for n, (first, _) in parts.items()}


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every document in one of `shards` leaves (or of as many as target_bytes asks for).

    Slots are numbered within blocks of a bounded number of rows, and shifted by the
    counts of the blocks before, so that no task sees a whole shard.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "shard")
    at = space.write(points(docs, space), "points")
    whole = at.agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n")).first()
    leaves = shards or max(1, math.ceil((whole["w"] or 0) / target_bytes))
    tree, number = build_tree(at, leaves)
    numbers = F.broadcast(spark.createDataFrame(sorted(number.items()), "node long, shard int"))  # a row a leaf
    leaved = tree.leaves(at).join(numbers, "node")
    blocks = max(1, whole["n"] // (SLOT_BLOCK * leaves))
    dealt = leaved.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)).cast("int"))
    before = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n")).select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = W.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")
    numbered = dealt.withColumn("at", F.row_number().over(own) - 1)
    return numbered.join(starts, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("at")).cast("long").alias("slot")
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"), shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
