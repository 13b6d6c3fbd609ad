"""Questions to books by their trees: route, choose nodes, read their pages, answer."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import dialogue
from quire.operators.retrieval import bm25


def retried(call: Callable[[], object], tries: int = 10, wait: float = 1.0, growing: bool = False, failed: object = None):
    """call() until it does not raise: after wait seconds each time, or after wait times the number of tries. Then `failed`, or the last error if that is None."""
    for turn in range(1, tries + 1):
        try:
            return call()
        except Exception:  # noqa: BLE001  a transport may raise anything
            if turn == tries:
                if failed is None:
                    raise
                return failed
            time.sleep(wait * turn if growing else wait)


def listing(nodes: list[dict]) -> str:
    """Nodes as a model is shown them."""
    return "\n".join(f"- node_id={n['node_id']} | {n['crumb']} | pages {n['start_index']}-{n['end_index']} | {(n.get('summary') or '')[: dialogue.SUMMARY]}" for n in nodes)


def ask_trees(
    spark: SparkSession, question: str, nodes: DataFrame, pages: DataFrame, route: Callable[[str, str], str] | None = None, pick: Callable[[str, str, str], str] | None = None,
    read: Callable[[str, str, str], str] | None = None, summary_only: bool = False,
) -> list[dict]:
    """One answer for each book a question is routed to, from the first node chosen there.

    nodes: doc, depth, path, node_id, crumb, title, start_index, end_index, summary. route
    and pick give a model's answers; by default words decide. read answers from a text (or,
    with summary_only, from a summary); by default it quotes the text's beginning.
    """
    asked = spark.createDataFrame([(0, question)], "query_id long, question string")
    books = dialogue.registry(nodes)
    if route:
        shown = "\n".join(f'- "{r["doc"]}": {r["description"][: dialogue.SHOWN]}' for r in books.orderBy("doc").collect())  # a row a book
        found = dialogue.routed(spark.createDataFrame([(0, route(question, shown))], "query_id long, said string"), books)
    else:
        found = dialogue.route_by_words(asked, books)
    read = read or (lambda question, title, text: " ".join(text.split())[:300] or f"no text on the pages of {title}")
    answers = []
    for book in [r["doc"] for r in found.orderBy("pos").collect()]:
        own = nodes.filter(F.col("doc") == book)
        offered = dialogue.candidates(own).join(own.drop("doc", "node_id"), "path").orderBy("at")
        if pick:
            said = pick(question, book, listing([r.asDict() for r in offered.collect()]))  # one tree
        else:
            keyed = offered.select("node_id", F.concat_ws(" ", "crumb", F.col("summary") if "summary" in offered.columns else F.lit("")).alias("text"))
            ids = [r["node_id"] for r in bm25(keyed, asked, "node_id", "text", dialogue.NODES).orderBy("rank").collect()]
            said = "[" + ", ".join(f'"{i}"' for i in ids) + "]" if ids else ""
        picks = dialogue.picked(spark.createDataFrame([(0, book, said)], "query_id long, doc string, said string"), own)
        best = dialogue.pages_to_read(picks, own, pages.filter(F.col("book") == book)).first()
        if best is None:
            continue
        text = best["text"]
        if summary_only:
            row = own.filter(F.col("crumb") == best["title"]).first()
            text = (row.asDict().get("summary") or "") if row else ""
        answers.append({"book": book, "title": best["title"], "pages": [best["start_index"], best["end_index"]], "answer": read(question, best["title"], text)})
    return answers
