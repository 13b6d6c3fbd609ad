"""Unigram token counts by dynamic programming over a trie (operator 4).

The distinct pre-tokens of a task go into a trie. A node keeps the best unigram score
of the path to it and the number of tokens on that best segmentation, so a shared
prefix is scored once; a pre-token's count is stored at its end. Documents then add up
stored counts. Texts never move: there is no shuffle. A Python worker keeps its trie from
task to task and starts it anew when it reaches MAX_NODES; a pre-token of more than LONG
characters is scored outside the trie, over a sliding window as wide as the longest piece,
so a trie holds at most MAX_NODES + LONG nodes whatever the texts hold.

The vocabulary is the public 32k piece model. It is published with merge ranks rather
than probabilities, so a piece's log probability is that of a Zipf-Mandelbrot law over
those ranks. A character without a piece falls back to one token for each UTF-8 byte.
Of segmentations with equal scores the one whose last piece is longest counts.

Defined cases: a null or empty text has 0 tokens; repeated rows are counted each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import lean, read

#: Shift of the Zipf-Mandelbrot law.
SHIFT = 2.7
#: What a byte that stands in for an unknown character costs beyond the rarest piece.
UNKNOWN = 10.0
MARK = "▁"
MAX_NODES = 1_000_000
#: Longer pre-tokens are not kept in the trie.
LONG = 64


@functools.cache
def vocabulary() -> tuple[dict[str, float], int, float]:
    """Pieces with log probabilities, the longest piece's length, the log score of a fallback byte."""
    import public_tokenizers as P
    import sentencepiece as spm

    model = spm.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    ranks = {
        model.id_to_piece(i): -model.get_score(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    }
    total = math.log(sum(1 / (r + SHIFT) for r in ranks.values()))
    scores = {p: -math.log(r + SHIFT) - total for p, r in ranks.items()}
    return scores, max(map(len, scores)), min(scores.values()) - UNKNOWN


@functools.cache
def endings() -> dict[str, float | None]:
    """Every end of a piece: its log probability if it is a piece itself, else None."""
    scores = vocabulary()[0]
    out: dict[str, float | None] = {p[i:]: None for p in scores for i in range(len(p))}
    out.update(scores)
    return out


class CountTrie(dict):
    """Token count by pre-token (UTF-8 bytes); a missing one is inserted in the trie.

    Node 0 is the root; the child of a node by a character is found under one integer
    made of both, and scores and counts lie in flat arrays.
    """

    def __init__(self, max_nodes: int = MAX_NODES):
        self.scores, self.longest, self.byte = vocabulary()
        self.ends = endings()
        self.max_nodes = max_nodes
        self.start()

    def start(self) -> None:
        self.clear()
        self.child: dict[int, int] = {}
        self.best, self.count = array("d", [0.0]), array("l", [0])

    def __missing__(self, token: bytes) -> int:
        if len(self.best) >= self.max_nodes:
            self.start()
        text = MARK + token.decode("utf-8", "replace")
        if len(text) > LONG:
            return self.long_count(text)
        child, path, node = self.child, [0], 0
        for char in text:
            node = child.get(node << 21 | ord(char))
            if node is None:
                break
            path.append(node)
        shared = len(path)
        if shared <= len(text):
            best, count = [self.best[k] for k in path], [self.count[k] for k in path]
            node = path[-1]
            for end in range(shared, len(text) + 1):
                score, tokens = self._forward(text, end, best, count)
                best.append(score)
                count.append(tokens)
                child[node << 21 | ord(text[end - 1])] = node = len(self.best)
                self.best.append(score)
                self.count.append(tokens)
        self[token] = found = self.count[node]
        return found

    def long_count(self, text: str) -> int:
        """Tokens of a long pre-token; only the scores within a piece's reach are kept."""
        reach = 4 * max(LONG, self.longest)
        best, count = [0.0], [0]
        base = 0
        for end in range(1, len(text) + 1):
            if len(best) > reach:
                cut = len(best) - self.longest - 1
                del best[:cut], count[:cut]
                base += cut
            part = text[base:end]
            score, tokens = self._forward(part, len(part), best, count)
            best.append(score)
            count.append(tokens)
        return count[-1]

    def _forward(self, text: str, end: int, best: list[float], count: list[int]) -> tuple[float, int]:
        """Best score and its token count for the first end characters, from those of all shorter prefixes."""
        top, tokens, ends = -math.inf, 0, self.ends
        for begin in range(end - 1, -1, -1):
            score = ends.get(text[begin:end], 1.0)
            if score is None:
                continue
            if score == 1.0:  # no piece ends like this, nor then with more before it
                break
            if best[begin] + score >= top:
                top, tokens = best[begin] + score, count[begin] + 1
        if text[end - 1] not in self.scores:
            size = len(text[end - 1].encode("utf-8", "replace"))
            if best[end - 1] + size * self.byte > top:
                top, tokens = best[end - 1] + size * self.byte, count[end - 1] + size
        return top, tokens


@functools.cache
def worker_trie() -> CountTrie:
    """The trie of this Python process."""
    return CountTrie()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = worker_trie()
    for batch in batches:
        words, tokens = [], []
        for text in batch.column(1).cast(pa.large_binary()):
            parts = (text.as_py() or b"").split()  # bytes split at ASCII white space alone
            words.append(len(parts))
            tokens.append(sum(map(trie.__getitem__, parts)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"]
        )


def count_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every document."""
    return docs.select("doc_id", "text").mapInArrow(lean(_count), "doc_id long, n_words long, n_tokens long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"))
