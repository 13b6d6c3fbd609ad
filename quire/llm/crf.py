"""Quality classification by a linear-chain conditional random field over lines (operator 10).

Every line has features of its own and of its neighbours; the chain has the states bad
and good. Lines of the labelled documents carry their document's label. Forward-backward
gives each line's probability of being good, the mean of which, weighted by line length,
is the document's raw quality, mapped to a probability by logistic calibration.

Training takes at most MAX_DOCS labelled documents (a documented bound) on the driver;
scoring runs in one pass over whole texts without a shuffle, batch by batch.

Defined cases: a null text is an empty one, which is one empty line and is scored as
such; without labels of both kinds the score is the share of good labels, or 0.5;
repeated rows are scored each; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, read
from .labelled import held_out, logistic, sample, sigmoid

MAX_DOCS = 4000
#: Bytes of text whose lines are held as features at once.
BATCH_BYTES = 2 << 20
THRESHOLD = 0.7
ROUNDS = 120
RIDGE = 1e-3
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
SYMBOLS, SHOUTS, STOPS = b"#*$%&|<>{}[]\\/_=+~^@", b"!?", b".,;:"


def line_features(lines: list[bytes]) -> np.ndarray:
    """A row for each line of one document."""
    seen: dict[bytes, int] = {}
    for x in lines:
        seen[x] = seen.get(x, 0) + 1
    out = np.zeros((len(lines), 12), np.float32)
    for row, x in zip(out, lines):
        n = len(x)
        words = x.split()
        if not words:
            row[11] = 1
            continue
        k = len(words)
        part = lambda kind: (n - len(x.translate(None, kind))) / n  # noqa: B023, E731
        row[:11] = (
            np.log1p(n) / 10, part(UPPER) * 4, part(DIGITS) * 4, part(SYMBOLS) * 8, part(SHOUTS) * 8, part(STOPS) * 8,
            len(set(words)) / k, sum(map(eq, words, words[1:])) / k * 2, min(n / k, 40) / 10, k < 4, seen[x] > 1,
        )
    return out


@dataclass
class Chains:
    """Lines of many documents, with neighbours' features beside their own."""

    x: np.ndarray
    weight: np.ndarray
    first: np.ndarray
    size: np.ndarray


def chains(texts: list[bytes]) -> Chains:
    split = [t.split(b"\n") for t in texts]
    size = np.array([len(s) for s in split])
    own = np.vstack([line_features(s) for s in split])
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[first] = 0
    after[first + size - 1] = 0
    x = np.hstack([own, before, after, np.ones((len(own), 1), np.float32)])
    return Chains(x, np.array([len(line) + 1 for s in split for line in s], np.float64), first, size)


def forward_backward(c: Chains, emission: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log odds of good for each line; expected transitions (2 x 2); log partition of each document.

    The recursions run over line positions, on all documents long enough at once.
    """
    order = np.argsort(-c.size, kind="stable")
    first, size = c.first[order], c.size[order]
    live = np.searchsorted(-size, -np.arange(1, size.max() + 1), side="right")
    score = np.stack([np.zeros_like(emission), emission], 1)
    forward, backward = np.zeros_like(score), np.zeros_like(score)
    forward[first] = score[first]
    for t in range(1, len(live)):
        at = first[: live[t]] + t
        before = forward[at - 1]
        forward[at] = score[at] + np.logaddexp(before[:, :1] + a[0], before[:, 1:] + a[1])
    for t in range(len(live) - 1, 0, -1):
        at = first[: live[t]] + t
        ahead = backward[at] + score[at]
        backward[at - 1] = np.logaddexp(ahead[:, :1] + a[:, 0], ahead[:, 1:] + a[:, 1])
    end = forward[c.first + c.size - 1]
    total = np.logaddexp(end[:, 0], end[:, 1])
    odds = (forward + backward) @ np.array([-1.0, 1.0])
    inner = np.ones(len(emission), bool)
    inner[c.first] = False
    at = np.flatnonzero(inner)
    of = np.repeat(total, c.size)[at]
    pairs = np.array([[np.exp(forward[at - 1, i] + a[i, j] + score[at, j] + backward[at, j] - of).sum() for j in (0, 1)] for i in (0, 1)])
    return odds, pairs, total


@dataclass
class Model:
    weights: np.ndarray
    transition: np.ndarray
    slope: float
    bias: float

    def raw(self, c: Chains) -> np.ndarray:
        odds, _, _ = forward_backward(c, c.x @ self.weights, self.transition)
        good = np.add.reduceat(sigmoid(odds) * c.weight, c.first) / np.add.reduceat(c.weight, c.first)
        good = np.clip(good, 1e-4, 1 - 1e-4)
        return np.log(good / (1 - good))

    def score(self, texts: list[bytes]) -> np.ndarray:
        return sigmoid(self.slope * self.raw(chains(texts)) + self.bias)


def train(pairs: list[tuple[str, int]]) -> Model | float:
    """A model from (text, label) pairs; a constant score if they don't have both labels."""
    y = np.array([p[1] for p in pairs], np.float64)
    if len(set(y)) < 2:
        return float(y.mean()) if len(y) else 0.5
    c = chains([p[0].encode("utf-8", "replace") for p in pairs])
    line_y = np.repeat(y, c.size)
    inner = np.ones(len(line_y), bool)
    inner[c.first] = False
    gold = np.array([[inner[line_y == 0].sum(), 0], [0, inner[line_y == 1].sum()]], np.float64)
    w, a = np.zeros(c.x.shape[1]), np.zeros((2, 2))
    moments = [np.zeros(len(w) + 4), np.zeros(len(w) + 4)]
    n = len(line_y)
    for k in range(1, ROUNDS + 1):  # Adam on the mean log likelihood a line
        odds, expected, _ = forward_backward(c, c.x @ w, a)
        gradient = np.concatenate([c.x.T @ (sigmoid(odds) - line_y) / n + RIDGE * w, ((expected - gold) / n).ravel() + 10 * RIDGE * a.ravel()])
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.99 * moments[1] + 0.01 * gradient**2
        step = 0.15 * moments[0] / (1 - 0.9**k) / (np.sqrt(moments[1] / (1 - 0.99**k)) + 1e-8)
        w, a = w - step[:-4], a - step[-4:].reshape(2, 2)
    model = Model(w, a, 1.0, 0.0)
    slope, bias = logistic(model.raw(c)[:, None], y)
    return Model(w, a, max(float(slope), 1e-6), float(bias))


def blocks(texts: Iterable[bytes], most: int = BATCH_BYTES, many: int = 256) -> Iterator[list[bytes]]:
    """Texts in order, in blocks of at most `many` that hold at most `most` bytes or one text."""
    block: list[bytes] = []
    size = 0
    for text in texts:
        if block and (size + len(text) > most or len(block) >= many):
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield block


def scorer(model: Model | float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (x.as_py() or b"" for x in batch.column(1).cast(pa.large_binary()))
            found: list[float] = []
            for block in blocks(texts):
                found.extend([model] * len(block) if isinstance(model, float) else model.score(block))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return score


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Model | float:
    return train(sample(docs, labels, "quality", max_docs))


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """(doc_id, score) of every document."""
    return docs.select("doc_id", "text").mapInArrow(lean(scorer(model)), "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model | float, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold, all columns kept; scored in place, without a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            pair = pa.RecordBatch.from_arrays([batch.column(at), batch.column(at)], names=["doc_id", "text"])
            scores = next(scorer(model)(iter([pair]))).column(1)
            yield batch.filter(pa.array([s >= threshold for s in scores.to_pylist()], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
