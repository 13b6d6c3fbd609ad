"""The question loop over trees: books for a question, nodes in them, pages to answer from. A batch of questions is a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators import trees
from quire.operators.retrieval import bm25

#: Books and nodes that are kept for a question, titles in a description, characters of descriptions and summaries that are shown, the least pages of a node.
BOOKS, NODES, TITLES, SHOWN, SUMMARY, LEAST = 2, 2, 5, 300, 200, 2


def listed(text: Column) -> Column:
    """The JSON list in a model's answer, from the first bracket to the last; null if there is none."""
    return F.from_json(F.regexp_extract(F.trim(text), r"(?s)\[.*\]", 0), "array<string>")


def registry(nodes: DataFrame, described: DataFrame | None = None) -> DataFrame:
    """(doc, description): a tree's own description (described: doc, description), else its first titles, else its name. nodes: doc, depth, path, title."""
    first = nodes.filter("depth = 1").groupBy("doc").agg(F.slice(F.sort_array(F.collect_list(F.struct("path", "title"))), 1, TITLES).alias("x"))
    filled = F.filter(F.transform("x", lambda n: n["title"]), lambda t: t.isNotNull() & (t != ""))
    made = first.select("doc", F.when(F.size("x") > 0, F.concat(F.lit("Chapters include: "), F.array_join(filled, "; "))).alias("made"))
    if described is None:
        return made.select("doc", F.coalesce("made", "doc").alias("description"))
    own = F.when(F.col("description") != "", F.col("description"))
    return made.join(described, "doc", "full").select("doc", F.coalesce(own, "made", "doc").alias("description"))


def routed(answers: DataFrame, books: DataFrame, k: int = BOOKS) -> DataFrame:
    """(query_id, doc, pos): the books that a model named for a question (answers: query_id, said), known ones in its order; all books if it gave no list."""
    parsed = answers.select("query_id", listed(F.col("said")).alias("names"))
    named = parsed.filter("names IS NOT NULL").select("query_id", F.posexplode("names").alias("at", "doc")).join(F.broadcast(books.select("doc")), "doc")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("at")) - 1
    chosen = named.withColumn("pos", place).filter(F.col("pos") < k).select("query_id", "doc", "pos")
    every = books.select(F.collect_list("doc").alias("docs")).select(F.sort_array("docs").alias("docs"))  # one row: a name a book
    rest = parsed.filter("names IS NULL").crossJoin(F.broadcast(every)).select("query_id", F.posexplode("docs").alias("pos", "doc"))
    return chosen.union(rest.select("query_id", "doc", "pos"))


def route_by_words(questions: DataFrame, books: DataFrame, k: int = BOOKS) -> DataFrame:
    """(query_id, doc, pos): the default router, lexical scores over the shown part of descriptions."""
    shown = books.select("doc", F.left("description", F.lit(SHOWN)).alias("text"))
    return bm25(shown, questions, "doc", "text", k).select("query_id", "doc", (F.col("rank") - 1).alias("pos"))


def candidates(nodes: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc, path, at): the nodes a model may choose from, numbered in tree order: those with enough pages, or all of a tree that has none."""
    wide = F.coalesce(F.col("end_index") - F.col("start_index") + 1 >= least, F.lit(False))
    offered = nodes.withColumn("_wide", wide).withColumn("_any", F.max(wide).over(W.partitionBy("doc"))).filter("_wide OR NOT _any")
    return offered.select("doc", "path", "node_id", (F.row_number().over(W.partitionBy("doc").orderBy("path")) - 1).alias("at"))


def picked(answers: DataFrame, nodes: DataFrame, k: int = NODES) -> DataFrame:
    """(query_id, doc, pos, path): the nodes that a model named (answers: query_id, doc, said), each climbed to enough pages.

    Without a list in its answer the first k candidates count; with a list of which no id
    is known, the first candidate.
    """
    offered = candidates(nodes)
    parsed = answers.select("query_id", "doc", listed(F.col("said")).alias("ids"))
    named = parsed.filter("ids IS NOT NULL").select("query_id", "doc", F.posexplode("ids").alias("pos", "node_id")).join(nodes.select("doc", "node_id", "path"), ["doc", "node_id"])
    chosen = named.select("query_id", "doc", "pos", "path")
    failed = parsed.filter("ids IS NULL").join(offered.filter(F.col("at") < k), "doc").select("query_id", "doc", F.col("at").alias("pos"), "path")
    unknown = parsed.filter("ids IS NOT NULL").join(named, ["query_id", "doc"], "left_anti").join(offered.filter("at = 0"), "doc").select("query_id", "doc", F.lit(0).alias("pos"), "path")
    up = trees.climb(nodes.select("doc", "path", "start_index", "end_index"))
    return chosen.union(failed).union(unknown).join(up, ["doc", "path"]).select(
        "query_id", "doc", "pos", F.coalesce("climbed", F.slice("path", 1, 1)).alias("path")
    )


def pages_to_read(picks: DataFrame, nodes: DataFrame, pages: DataFrame, most: int = 4) -> DataFrame:
    """(query_id, doc, title, start_index, end_index, text): the first pick's pages, as many as fit one question. A pick without text gets none."""
    order = W.partitionBy("query_id", "doc").orderBy("pos")
    best = picks.withColumn("_n", F.row_number().over(order)).filter("_n = 1").join(nodes.select("doc", "path", "crumb", "start_index", "end_index"), ["doc", "path"])
    spans = best.select(F.struct("query_id", "doc").alias("span_id"), F.col("doc").alias("book"), F.coalesce("start_index", F.lit(1)).alias("start_index"), F.coalesce("end_index", "start_index", F.lit(1)).alias("end_index"), "crumb")
    read = trees.range_text(spans.select("span_id", "book", "start_index", "end_index"), pages, most).select("span_id", "text")
    return spans.join(read, "span_id", "left").select("span_id.query_id", "span_id.doc", F.col("crumb").alias("title"), "start_index", "end_index", F.coalesce("text", F.lit("")).alias("text"))
