"""Connected components by contraction, for operators that link documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Edges up to which the rest of a graph is settled by one task.
FEW = 20_000


def _canonical(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, space: Workspace, name: str = "cc", max_rounds: int = 64) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the smallest node it reaches.

    Each round points a node at its smallest neighbour or, where all neighbours are
    larger, at the smallest of their neighbours; pointers are followed to their ends and
    the graph is contracted to those. An end is the target of all its neighbours, so a
    round halves the nodes with edges at least, whatever the order of the ids; following
    doubles its reach each time. Rounds are cut by tables in the shared folder. Minima
    are combined map-side. Once FEW edges at most are left, one task settles them. Raises
    if edges are left after max_rounds.
    """
    live = space.write(_canonical(edges), f"{name}-e0")
    labels = space.write(live.select("a").union(live.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("label")), f"{name}-l0")
    turn = 0
    while left := live.limit(FEW + 1).count():
        if left <= FEW:
            ends = live.coalesce(1).mapInArrow(_united, "label long, end long")
            return space.write(labels.join(F.broadcast(ends), "label", "left").select("node", F.coalesce("end", "label").alias("label")), f"{name}-done")
        turn += 1
        if turn > max_rounds:
            raise RuntimeError(f"edges are left after {max_rounds} rounds")
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = space.write(both.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("low")), f"{name}-u{turn}")
        far = live.join(low.withColumnRenamed("x", "a"), "a").groupBy(F.col("b").alias("x")).agg(F.min("low").alias("far"))
        up = low.join(far, "x", "left").select("x", F.when(F.col("low") < F.col("x"), F.col("low")).otherwise(F.col("far")).alias("up"))
        up = _followed(space.write(up, f"{name}-v{turn}-0"), space, f"{name}-v{turn}")
        of = lambda c: up.select(F.col("x").alias(c), F.col("up").alias(f"p{c}"))  # noqa: B023, E731
        live = space.write(_canonical(live.join(of("a"), "a").join(of("b"), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))), f"{name}-e{turn}")
        labels = space.write(labels.join(of("label"), "label", "left").select("node", F.coalesce("plabel", "label").alias("label")), f"{name}-l{turn}")
        for old in (f"{name}-e{turn - 1}", f"{name}-l{turn - 1}", f"{name}-u{turn}", f"{name}-v{turn}"):
            space.drop(old)
    return labels


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges to (node, smallest node of its component), by union-find."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([find(x) for x in up], pa.int64())], names=["label", "end"])


def _followed(up: DataFrame, space: Workspace, name: str) -> DataFrame:
    """Pointers (x, up) to the ends of their chains; an end points at itself. The last table is name, those before are dropped."""
    hop = 0
    while True:
        above = up.select(F.col("x").alias("y"), F.col("up").alias("top"))
        hop += 1
        ahead = space.write(up.join(above, F.col("up") == F.col("y")).select("x", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), f"{name}-{hop}")
        space.drop(f"{name}-{hop - 1}")
        if ahead.filter("moved").isEmpty():
            return ahead.drop("moved")
        up = ahead.drop("moved")
