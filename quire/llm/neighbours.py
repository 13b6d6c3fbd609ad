"""Approximate nearest neighbours by randomly rotated one-bit codes (operator 5).

Vectors are assigned to cells (centroids fitted on at most SAMPLE vectors, a documented
bound; every vector is indexed). What is left of a vector beyond its centroid is rotated
at random and stored as one bit a dimension, with two correction scalars: its norm, and
its inner product with its own code. For a query, the packed bits give an estimate of
each inner product and a bound on its error; vectors whose upper bound reaches the k-th
largest lower bound are reranked on the original vectors in double precision. A query
also brings the k-th best inner product it has within the sample, and results below it
never leave a task. How many cells a query looks into is measured on the sample: so many
that ASKED of its vectors reach REACH of their k nearest others in it. Few suffice where
vectors are clustered, whatever their number; where they have no structure it takes most
cells, as any index would.

Equal vectors are one entry of the index that keeps its k + 1 smallest ids, all that any
result can name, and equal queries are searched once; so a vector that a third of all
rows share is not a hot cell. Cells of many vectors or queries are dealt over tasks of
bounded size, in which vectors meet queries block by block.

Defined cases: ids that are null, and vectors that are null, empty, zero, of a length
other than the commonest (the longer one on a tie), or hold null or non-finite
components take no part; ids are unique, and rows that repeat an id count once each;
with fewer candidates than k all are returned; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, read

K = 20
SAMPLE = 20_000
PER_CELL, MAX_CELLS = 1000, 1024
#: Part of their neighbours whose cells sample queries must reach; that fixes how many cells a query looks into, these at least.
REACH, LEAST_PROBES, ASKED = 0.97, 16, 400
#: Width of the error bound in standard deviations of the estimate.
SIGMAS = 3.0
SUB, QUERY_SUB, QUERY_BLOCK = 8192, 2048, 256
CODE = "cell int, uid long, code binary, norm double, corr double, v array<double>, ids array<long>"


def valid(rows: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.col("v")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull()).filter(finite & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("v") == (common["d"] if common else 0))


class Index:
    """Centroids and the rotation."""

    def __init__(self, sample: np.ndarray, cells: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        d = sample.shape[1]
        self.rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
        self.centroids = sample[rng.permutation(len(sample))[:cells]].copy()
        for _ in range(8 if cells > 1 else 1):
            at = self.cell(sample)
            for c in range(len(self.centroids)):
                own = sample[at == c]
                if len(own):
                    self.centroids[c] = own.mean(0)

    def probes(self, sample: np.ndarray, k: int, seed: int = 5) -> int:
        """Cells to look into, by the places that the cells of sample vectors' neighbours have in their order."""
        cells = len(self.centroids)
        if len(sample) <= k + 1 or cells <= LEAST_PROBES:
            return cells
        at = self.cell(sample)
        asked = np.random.default_rng(seed).permutation(len(sample))[:ASKED]
        near = sample[asked] @ sample.T
        near[np.arange(len(asked)), asked] = -np.inf
        best = np.argpartition(-near, k, axis=1)[:, :k]
        order = np.argsort(-(sample[asked] @ self.centroids.T), axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(cells)[None, :], axis=1)
        reached = np.sort(np.take_along_axis(place, at[best], axis=1).ravel())
        return min(cells, max(LEAST_PROBES, int(reached[int(np.ceil(REACH * len(reached))) - 1]) + 1))

    def cell(self, v: np.ndarray) -> np.ndarray:
        return ((self.centroids**2).sum(1) - 2 * v @ self.centroids.T).argmin(1)

    def encode(self, v: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed codes, norms, and inner products of the unit residuals with their codes."""
        left = (v - self.centroids[cell]) @ self.rotation
        norm = np.sqrt((left**2).sum(1))
        corr = np.abs(left).sum(1) / np.maximum(norm, 1e-300) / np.sqrt(v.shape[1])
        return np.packbits(left > 0, axis=1), norm, np.where(norm > 0, corr, 1.0)

    def bounds(self, code: np.ndarray, norm: np.ndarray, corr: np.ndarray, cell: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of queries (rows) with coded vectors (columns), and error bounds."""
        d = q.shape[1]
        turned = (q @ self.rotation).astype(np.float32)
        signs = np.unpackbits(code, axis=1, count=d).astype(np.float32) * 2 - 1
        share = (turned @ signs.T) / np.sqrt(d)
        estimate = q @ self.centroids[cell][:, None] + share * (norm / corr)[None, :]
        spread = norm * np.sqrt(np.maximum(0, 1 - corr**2)) / corr / np.sqrt(max(1, d - 1))
        slack = 1e-5 * np.abs(estimate) + 1e-9
        return estimate, SIGMAS * np.sqrt((q**2).sum(1))[:, None] * spread[None, :] + slack


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _encoder(index: Index):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(1))
            cell = index.cell(v)
            code, norm, corr = index.encode(v, cell)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.int32()), batch.column(0), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(norm), pa.array(corr), batch.column(1), batch.column(2)],
                names=["cell", "uid", "code", "norm", "corr", "v", "ids"],
            )

    return encode


def _prober(index: Index, probes: int, sample: np.ndarray, k: int):
    """(quid, v) to the cells to look into and a floor: the k-th best inner product within the sample, which no result falls below."""
    known = sample.astype(np.float32)
    slack = 1e-5 * float(np.sqrt((sample**2).sum(1)).max())

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column(1))
            cells = np.argsort(-(q @ index.centroids.T), axis=1, kind="stable")[:, :probes]
            floor = np.full(len(q), -np.inf)
            if len(known) >= k:
                for a in range(0, len(q), QUERY_BLOCK):
                    best = np.partition(q[a : a + QUERY_BLOCK].astype(np.float32) @ known.T, len(known) - k, axis=1)[:, len(known) - k]
                    floor[a : a + QUERY_BLOCK] = best - slack * np.sqrt((q[a : a + QUERY_BLOCK] ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cells.tolist(), pa.list_(pa.int32())), pa.array(floor, pa.float64())],
                names=["quid", "v", "cells", "floor"],
            )

    return probe


class _Block:
    """The vectors of one task."""

    def __init__(self, index: Index, cell: int, rows: list[tuple]):
        self.index, self.cell = index, cell
        _, code, norm, corr, v, self.ids = zip(*rows)
        self.code = np.frombuffer(b"".join(code), np.uint8).reshape(len(code), -1)
        self.norm, self.corr, self.v = np.array(norm), np.array(corr), np.array(v)

    def search(self, quid: list[int], q: np.ndarray, floor: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
        estimate, error = self.index.bounds(self.code, self.norm, self.corr, self.cell, q)
        n = len(self.norm)
        lowest = np.maximum(floor, np.partition(estimate - error, n - k, axis=1)[:, n - k]) if n > k else floor
        qi, vi = np.nonzero(estimate + error >= lowest[:, None])
        score = np.zeros(len(qi))
        for j in range(q.shape[1]):  # one order of summation for all, whatever their place
            score += q[qi, j] * self.v[vi, j]
        order = np.lexsort((-score, qi))
        order = order[(score >= floor[qi])[order]]
        qi, vi, score = qi[order], vi[order], score[order]
        edges = np.searchsorted(qi, np.arange(len(q) + 1))
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            found: list[tuple[float, int]] = []
            for x, s in zip(vi[a:b].tolist(), score[a:b].tolist()):
                if len(found) >= k and -s > found[k - 1][0]:
                    break
                found += [(-s, vec) for vec in self.ids[x]]
            for s, vec in sorted(found)[:k]:
                yield quid[i], vec, -s


def _searcher(index: Index, k: int):
    """Rows sorted by (task, kind): the vectors of a task (kind 0), then its queries (kind 1), to (quid, vec_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows, block = None, [], None
        quid: list[int] = []
        q: list = []
        floor: list[float] = []

        def answer() -> pa.RecordBatch:
            found = list(block.search(quid, np.array(q), np.array(floor), k)) if block and quid else []
            a, b, c = zip(*found) if found else ((), (), ())
            for x in (quid, q, floor):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["quid", "vec_id", "score"])

        for batch in batches:
            for t, kind, cell, uid, code, norm, corr, v, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if t != task:
                    yield answer()
                    task, rows, block = t, [], None
                if kind == 0:
                    rows.append((uid, code, norm, corr, v, ids))
                    continue
                if block is None and rows:
                    block, rows = _Block(index, cell, rows), []
                quid.append(uid)
                q.append(v)
                floor.append(norm)
                if len(quid) >= QUERY_BLOCK:
                    yield answer()
        yield answer()

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest vectors found for every query, itself left out.

    vectors and queries have vec_id and embedding; a query's own id is no candidate of it.
    """
    spark = vectors.sparkSession
    space = Workspace(spark, "near")
    parts = valid(vectors)
    smallest = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    entries = parts.withColumn("nth", smallest).filter(f"nth <= {k + 1}").groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = space.write(entries.select(F.get("ids", F.lit(0)).alias("uid"), "v", "ids"), "entries")
    n = entries.count()
    asked = valid(queries)
    heads = space.write(asked.groupBy("v").agg(F.min("vec_id").alias("quid")), "heads")
    sample = entries.orderBy(F.xxhash64("uid")).limit(SAMPLE).select("v").collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = np.array([r["v"] for r in sample])
    index = Index(sample, max(1, min(MAX_CELLS, n // PER_CELL)))
    cells = len(index.centroids)
    probes = index.probes(sample, k)
    coded = space.write(entries.select("uid", "v", "ids").mapInArrow(_encoder(index), CODE), "coded")
    probing = heads.select("quid", "v").filter(F.size("v") == sample.shape[1]).mapInArrow(
        _prober(index, probes, sample, k + 1), "quid long, v array<double>, cells array<int>, floor double"
    )
    probing = space.write(probing.select("quid", "v", "floor", F.explode("cells").alias("cell")), "probing")
    subs, query_subs = ([max(1, -(-found.get(c, 0) // size)) for c in range(cells)] for found, size in (
        ({r["cell"]: r["count"] for r in coded.groupBy("cell").count().collect()}, SUB),  # a row a cell
        ({r["cell"]: r["count"] for r in probing.groupBy("cell").count().collect()}, QUERY_SUB),
    ))
    of = lambda counts: F.get(F.array(*[F.lit(x) for x in counts]), F.col("cell"))
    mark = lambda key, counts: F.pmod(F.xxhash64(key), of(counts)).cast("int")
    every = lambda counts: F.explode(F.sequence(F.lit(0), of(counts) - 1))
    rows = coded.withColumn("sub", mark("uid", subs)).withColumn("query_sub", every(query_subs)).withColumn("kind", F.lit(0))
    asks = probing.withColumn("query_sub", mark("quid", query_subs)).withColumn("sub", every(subs)).select(
        "cell", F.col("quid").alias("uid"), F.lit(None).cast("binary").alias("code"), F.col("floor").alias("norm"),
        F.lit(None).cast("double").alias("corr"), "v", F.lit(None).cast("array<long>").alias("ids"), "sub", "query_sub", F.lit(1).alias("kind"),
    )
    task = F.concat_ws("/", "cell", "sub", "query_sub").alias("task")
    met = rows.unionByName(asks).select(task, "kind", "cell", "uid", "code", "norm", "corr", "v", "ids").repartition("task").sortWithinPartitions("task", "kind")
    found = met.mapInArrow(_searcher(index, k + 1), "quid long, vec_id long, score double")
    best = W.partitionBy("quid").orderBy(F.desc("score"), "vec_id")
    top = space.write(found.withColumn("nth", F.row_number().over(best)).filter(f"nth <= {k + 1}").drop("nth"), "top")
    own = asked.select(F.col("vec_id").alias("query_id"), "v").join(heads, "v").select("query_id", "quid")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        own.distinct().join(top, "quid").filter("vec_id <> query_id").withColumn("rank", F.row_number().over(order))
        .filter(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
    )


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter("vec_id % 20 = 0"))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, b.vec_id, list_inner_product(q.v, b.v) AS score
  FROM v q JOIN v b ON q.vec_id <> b.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
