"""Toxicity by compression distance (operator 3).

Two zstandard dictionaries are trained with zstandard's own trainer, one on toxic and one
on ordinary labelled text. A toxic document is mostly ordinary prose, so the samples of
the toxic class are the parts of its words that mark it: grams of GRAM bytes in at least
LEAST of its documents and RATIO times as frequent there as in the other class, the TOP
strongest by log-likelihood, joined where they overlap. The samples of the ordinary
class are words of its documents. A document is cut into
windows of WINDOW words; each is compressed with either dictionary, and the difference
of the two lengths is a window's distance. Eight words of any length may outgrow the
compressor's reach, so a window of more than SLICE bytes is cut into slices that overlap
by OVERLAP bytes. Logistic calibration on the windows' mean, largest and counted
distances gives the score.

zstandard measures short windows well only if three things are kept from hiding a
match of a few bytes: literals are left uncompressed (the fast strategy with a target
length does that), matches shorter than MATCH are not sought, and every window starts
with the same primer, which both dictionaries hold, so that a block is never stored raw
for want of a first match. Dictionaries therefore serve as content, without the entropy
tables of their headers.

Training takes at most MAX_DOCS labelled documents (a documented bound) on the driver.
Scoring is one pass over whole texts without a shuffle. `choose` compares settings by
two-fold cross-validation within training documents.

Defined cases: a null or empty text is one window without words; without labels of both
kinds, or with too few samples for the trainer, the score is the share of toxic
labels, or 0.5; repeated rows are scored each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, read
from .labelled import held_out, logistic, sample, sigmoid

MAX_DOCS = 4000
WINDOW = 8
#: Bytes of a dictionary at most, and of the segments and the substrings by which the trainer chooses them; the shortest match.
SIZE, SEGMENT, SUBSTRING, MATCH = 2048, 24, 6, 7
#: Bytes of a window at most: up to here zstandard seeks a match at every position. Slices share OVERLAP bytes, so that no match is cut.
SLICE, OVERLAP = 256, 32
GRAM, RATIO, LEAST, TOP = 7, 5.0, 6, 160
#: Words of ordinary documents that its dictionary is trained on.
ORDINARY_SAMPLES = 20_000
THRESHOLD = 0.3
#: Bytes that lower-cased text does not hold; shared by both dictionaries and every window.
BASE = hashlib.sha256(b"primer").hexdigest().upper().encode()
PRIMER = BASE[3:19] + b"\x00" + BASE[30:46] + b"\x01" + BASE[10:26] + b"\x02"


def windows(text: bytes) -> list[bytes]:
    words = text.lower().split()
    found = []
    for i in range(0, len(words), WINDOW):
        body = b" ".join((b"", *words[i : i + WINDOW], b""))
        found.extend(PRIMER + body[k : k + SLICE] for k in range(0, max(1, len(body) - OVERLAP), SLICE - OVERLAP))
    return found or [PRIMER]


def _words(text: bytes) -> list[bytes]:
    return [w.strip(b".,;:!?") for w in text.lower().split()]


def _grams(word: bytes) -> list[bytes]:
    padded = b" " + word + b" "
    return [padded[i : i + GRAM] for i in range(max(1, len(padded) - GRAM + 1))]


def _marks(toxic: list[bytes], ordinary: list[bytes]) -> set[bytes]:
    """The grams whose document frequency marks toxic text most strongly."""
    own, other = (Counter(g for t in texts for g in {g for w in set(_words(t)) for g in _grams(w)}) for texts in (toxic, ordinary))
    strength = {}
    for gram, k in own.items():
        times = k / len(toxic) / ((other[gram] + 0.5) / len(ordinary))
        if len(gram) >= GRAM - 2 and k >= LEAST and times > RATIO:
            strength[gram] = k * np.log(times)
    return set(sorted(strength, key=lambda g: (-strength[g], g))[:TOP])


def _marked(word: bytes, marks: set[bytes]) -> list[bytes]:
    """The parts of a word that marking grams cover."""
    padded, parts, end = b" " + word + b" ", [], -1
    for i, gram in enumerate(_grams(word)):
        if gram in marks:
            if i < end:
                parts[-1] += padded[end : i + len(gram)]
            else:
                parts.append(gram)
            end = i + len(gram)
    return parts


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """The content that zstandard's trainer chooses, most useful last; empty if the samples are too few for it."""
    samples = samples * max(1, -(-1024 // max(1, len(samples))))  # the trainer wants some hundreds
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=SUBSTRING).as_bytes() if samples else b""
    except zstandard.ZstdError:
        return b""


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray

    def __post_init__(self) -> None:
        self._pair = None

    def __getstate__(self):
        return {"toxic": self.toxic, "ordinary": self.ordinary, "weights": self.weights, "_pair": None}

    def compressors(self):
        """Both compressors, made once in each process."""
        if self._pair is None:
            how = zstandard.ZstdCompressionParameters(
                window_log=13, chain_log=10, hash_log=14, search_log=1, min_match=MATCH, target_length=1, strategy=zstandard.STRATEGY_FAST,
                write_content_size=False, write_dict_id=False, write_checksum=False,
            )
            made = [zstandard.ZstdCompressionDict(x + BASE, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for x in (self.toxic, self.ordinary)]
            self._pair = [zstandard.ZstdCompressor(compression_params=how, dict_data=d).compress for d in made]
        return self._pair

    def features(self, text: bytes) -> list[float]:
        toxic, ordinary = self.compressors()
        gaps = sorted((len(ordinary(w)) - len(toxic(w)) for w in windows(text)), reverse=True)
        n, strong = len(gaps), sum(g > 2 for g in gaps)
        return [
            sum(gaps) / n, gaps[0], sum(gaps[:3]) / len(gaps[:3]), strong, sum(g > 1 for g in gaps) / (n + 5), strong / (n + 10),
            float(np.log(n)), float(np.log1p(strong)),
        ]

    def score(self, texts: list[bytes]) -> list[float]:
        x = np.array([self.features(t) for t in texts]).reshape(len(texts), 8)
        return sigmoid(x @ self.weights[:-1] + self.weights[-1]).tolist()


def train(pairs: list[tuple[str, int]]) -> Model | float:
    """A model from (text, label) pairs, or a constant score."""
    texts, y = [p[0].encode("utf-8", "replace") for p in pairs], np.array([p[1] for p in pairs], float)
    n = [int((y == c).sum()) for c in (0, 1)]
    rate = float(y.mean()) if len(y) else 0.5
    if not all(n):
        return rate
    classes = [[t for t, label in zip(texts, y) if label == c] for c in (0, 1)]
    marks = _marks(classes[1], classes[0])
    toxic = _dictionary([part for t in classes[1] for w in _words(t) for part in _marked(w, marks)], SIZE)
    words = sorted({(xxhash.xxh3_64_intdigest(b"%d %d" % (i, j)), b" " + w + b" ") for i, t in enumerate(classes[0]) for j, w in enumerate(_words(t))})
    ordinary = _dictionary([w for _, w in words[:ORDINARY_SAMPLES]], 2 * SIZE)
    if not toxic or not ordinary:
        return rate
    model = Model(toxic, ordinary.rjust(len(toxic), b"\x03")[-len(toxic) :], np.zeros(9))
    x = np.array([model.features(t) for t in texts])
    return Model(model.toxic, model.ordinary, logistic(x, y, 0.1))


def area(scores: np.ndarray, y: np.ndarray) -> float:
    """Area under the receiver operating curve."""
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    n = int(y.sum())
    return float((rank[y == 1].sum() - n * (n + 1) / 2) / max(1, n * (len(y) - n)))


def choose(pairs: list[tuple[str, int]], settings: list[dict]) -> list[tuple[float, dict]]:
    """Settings (module constants by name) with their areas in two-fold cross-validation over training pairs, best first."""
    y, found = np.array([p[1] for p in pairs], float), []
    for setting in settings:
        old = {k: globals()[k] for k in setting}
        globals().update(setting)
        try:
            out = np.zeros(len(pairs))
            for f in (0, 1):
                model = train([p for i, p in enumerate(pairs) if i % 2 != f])
                out[f::2] = model if isinstance(model, float) else model.score([p[0].encode("utf-8", "replace") for p in pairs[f::2]])
            found.append((area(out, y), setting))
        finally:
            globals().update(old)
    return sorted(found, key=lambda x: -x[0])


def scorer(model: Model | float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).cast(pa.large_binary()).to_pylist()]
            found = [model] * len(texts) if isinstance(model, float) else model.score(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return score


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Model | float:
    return train(sample(docs, labels, "toxic", max_docs))


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """(doc_id, score) of every document."""
    return docs.select("doc_id", "text").mapInArrow(lean(scorer(model)), "doc_id long, score double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
