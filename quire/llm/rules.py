"""Quality rules by weak supervision (operator 7), in DataFrame functions alone.

Each rule votes good (1), bad (-1) or abstains (0). The votes of all documents are
counted by vote pattern, of which there are at most 3 to the number of rules however
large the corpus is. Expectation-maximisation over the pattern counts estimates each
rule's accuracy under both classes (an abstention says nothing), and a document is kept
when its pattern's posterior probability of being good is at least KEEP. Rules look at
unlike sides of a text (symbols, words without letters, closing punctuation, word
lengths, shouting, capitals, repeats, lines, digits), so that what one of them sees in
junk others can confirm.

Words that recur in repeated three-word windows are found inside the row: window
hashes are sorted as an array of longs; positions are needed only for texts in which
two neighbours are equal.

Defined cases: a null text has no words and fails the base rules; an empty table gives
an empty result; rows that repeat an id are judged each on its own text; other columns
are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Workspace, read

KEEP = 0.5
ROUNDS = 50
#: First guesses: how often a rule blames a good document and catches a bad one, and the share of good documents; pseudo-counts of them.
BLAMES, CATCHES, PRIOR_GOOD, SMOOTH = 0.02, 0.3, 0.8, 1.0


def _bind(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(w: Column) -> Column:
    """Words of w covered by three-word windows that occur twice or more."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def twice(s: Column) -> Column:
        return F.exists(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.get(s, i) == F.get(s, i - 1))

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = lambda s: F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        spots = F.array_sort(F.transform(_bind(placed, again), lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(
            spots, start,
            lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n")),
            lambda a: a["n"],
        )

    return F.when(F.size(w) < 4, 0).otherwise(
        _bind(hashes, lambda h: F.when(_bind(F.sort_array(h), twice), covered(h)).otherwise(0))
    )


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column m, a struct of the counts the rules need."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit(WORD)))

    def counts(w: Column) -> list[Column]:
        return [
            F.size(w).alias("n_words"),
            _repeated(w).alias("n_repeat_words"),
        ]

    def without(characters: str) -> Column:
        return F.length(F.translate(t, characters, ""))

    blank = " \t\n\x0b\x0c\r"

    def of(w: Column) -> Column:
        n = F.length(t)
        return F.struct(
            *counts(w),
            without(blank).alias("word_chars"),
            (n - without("#*$%&|<>")).alias("n_symbols"),
            (n - without("!?")).alias("n_shouts"),
            (n - without("0123456789")).alias("n_digits"),
            F.regexp_count(t, F.lit(r"\p{Lu}")).alias("n_upper"),
            F.regexp_count(t, F.lit(r"(?<![^\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]+(?![^\x20\x09-\x0D])")).alias("n_bare"),
            F.regexp_count(t, F.lit(r"[.,;:!?](?![^\x20\x09-\x0D])")).alias("n_closed"),
            _bind(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
        )

    return docs.withColumn("m", _bind(words, of))


def votes(m: Column) -> list[Column]:
    """The rules: bad beyond one bound, good within another, abstaining between and on short texts."""

    def rule(part: Column, whole: Column, good: float, bad: float, least: int = 20) -> Column:
        ratio = part / F.greatest(whole, F.lit(1))
        vote = F.when(ratio >= bad, -1).when(ratio <= good, 1) if bad > good else F.when(ratio <= bad, -1).when(ratio >= good, 1)
        return F.when(m["n_words"] < least, 0).otherwise(vote.otherwise(0))

    words = m["n_words"]
    length = m["word_chars"] / F.greatest(words, F.lit(1))
    return [
        rule(m["n_symbols"], words, 0.05, 0.25),
        rule(m["n_bare"], words, 0.05, 0.2),
        rule(m["n_closed"], words, 0.1, 0.05),
        F.when(words < 20, 0).when((length < 3) | (length > 8), -1).when((length >= 4.2) & (length <= 7), 1).otherwise(0),
        rule(m["n_shouts"], words, 0.15, 0.5),
        rule(m["n_upper"], m["word_chars"], 0.15, 0.4),
        rule(m["n_repeat_words"], words, 0.25, 0.45),
        rule(m["lines"]["dup"], m["lines"]["n"], 0.2, 0.5, 30),
        rule(m["n_digits"], m["word_chars"], 0.1, 0.3),
    ]


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Posterior of good for every vote pattern, by expectation-maximisation over pattern counts.

    Votes are independent given the class; an abstention is a missing vote. A rule has two
    accuracies: how seldom it blames a good document, and how often it catches a bad one.
    The start says that rules blame seldom and each catches one sort of junk, which fixes
    the classes; throughout, a vote of bad is at least as likely under bad as under good.
    """
    if not patterns:
        return {}
    rules = range(len(patterns[0][0]))
    total = sum(n for _, n in patterns)
    good = PRIOR_GOOD
    blames, catches = [BLAMES] * len(rules), [CATCHES] * len(rules)

    def odds(p: tuple[int, ...]) -> float:
        """Log odds of bad."""
        return math.log((1 - good) / good) + sum(math.log(catches[r] / blames[r] if p[r] < 0 else (1 - catches[r]) / (1 - blames[r])) for r in rules if p[r])

    posterior: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        posterior = {p: 1 / (1 + math.exp(max(-700.0, min(700.0, odds(p))))) for p, _n in patterns}
        good = (sum(n * posterior[p] for p, n in patterns) + SMOOTH * PRIOR_GOOD) / (total + SMOOTH)
        for r in rules:
            voted = [(p[r] < 0, n * posterior[p], n * (1 - posterior[p])) for p, n in patterns if p[r]]
            blames[r], catches[r] = (
                (sum(v[c] for v in voted if v[0]) + SMOOTH * start) / (sum(v[c] for v in voted) + SMOOTH) for c, start in ((1, BLAMES), (2, CATCHES))
            )
            blames[r] = min(blames[r], catches[r])
    return posterior


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, m, pattern, posterior) of every document."""
    space = Workspace(docs.sparkSession, "rules")
    measured = space.write(measures(docs.select("doc_id", "text")).select("doc_id", "m", F.array(*votes(F.col("m"))).alias("pattern")), "measures")
    counted = measured.groupBy("pattern").count().collect()  # at most 3 ** 9 rows
    posterior = fit(sorted((tuple(r["pattern"]), r["count"]) for r in counted))
    if not posterior:
        return measured.withColumn("posterior", F.lit(0.0))
    known = docs.sparkSession.createDataFrame([(list(p), float(x)) for p, x in posterior.items()], "known array<int>, posterior double")
    return measured.join(F.broadcast(known), F.col("pattern") == F.col("known")).drop("known")


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(read(spark, sf_dir, "documents"))
    m = F.col("m")
    failed = (m["n_words"] < 50) | (F.lit(100).cast("long") * m["n_repeat_words"] > F.lit(50).cast("long") * m["n_words"])
    return judged.select(
        "doc_id",
        m["n_words"].cast("long").alias("n_words"),
        m["word_chars"].cast("long").alias("word_chars"),
        m["n_symbols"].cast("long").alias("n_symbols"),
        m["lines"]["dup"].cast("long").alias("n_dup_lines"),
        m["n_repeat_words"].cast("long").alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & (F.col("posterior") >= KEEP)).alias("kept"),
        "posterior",
    )
