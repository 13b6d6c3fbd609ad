"""Command line: python -m quire COMMAND."""

from __future__ import annotations

import argparse
import json

from quire.engine import Corpus, hashed_encoder, read_settings
from quire.providers import Provider
from quire.library import index_books, query_trees
from quire.service import serve
from quire.session import build_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quire")
    p.add_argument("--corpus", default="corpus", help="folder of the corpus tables")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("audit", help="profile record files")
    one.add_argument("records")
    one = sub.add_parser("ingest", help="take in record files, replacing their books")
    one.add_argument("records")
    one.add_argument("--book", action="append")
    one.add_argument("--no-dense", action="store_true", help="postings alone, no vectors")
    one.add_argument("--force", action="store_true", help="also what has not changed")
    one.add_argument("--raw", help="folder of layout files, for the pages of list items")
    one = sub.add_parser("retrieve", help="chunks for a question")
    one.add_argument("question")
    one.add_argument("--book")
    one = sub.add_parser("ask", help="an answer that quotes its sources")
    one.add_argument("question")
    one.add_argument("--audience", choices=("clinician", "patient"), default="clinician")
    one = sub.add_parser("eval", help="hit rates of a file of cases")
    one.add_argument("cases")
    one.add_argument("--generate", action="store_true", help="answer the questions too, and check citations and refusals")
    one = sub.add_parser("serve", help="HTTP service on this machine")
    one.add_argument("--host", default="127.0.0.1")
    one.add_argument("--port", type=int, default=8000)
    sub.add_parser("health", help="state of the index")
    one = sub.add_parser("index", help="trees for page text files, by the first way that passes validation")
    one.add_argument("pages", help="folder of text files, their pages parted by form feeds")
    one.add_argument("trees", help="folder of the trees")
    one.add_argument("--only", nargs="*", help="these books alone")
    one.add_argument("--no-escalate", action="store_true", help="printed contents alone")
    one.add_argument("--revalidate-only", action="store_true", help="check the trees that are there")
    one = sub.add_parser("query", help="answers from the pages that trees lead to")
    one.add_argument("question")
    one.add_argument("pages")
    one.add_argument("trees")
    one.add_argument("--summary-only", action="store_true", help="from summaries alone")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    read_settings()
    corpus = Corpus(build_session("quire"), a.corpus, {"encoder": "hashed-256", "encode": hashed_encoder()})
    if a.command == "serve":
        serve(corpus, Provider(), a.host, a.port)
        return
    found = {
        "audit": lambda: [json.loads(x) for x in corpus.audit(a.records)],
        "ingest": lambda: {"books": corpus.ingest(a.records, a.book, not a.no_dense, a.force, a.raw)},
        "retrieve": lambda: corpus.retrieve(a.question, a.book),
        "ask": lambda: corpus.ask(a.question, a.audience, Provider()),
        "eval": lambda: corpus.evaluate(a.cases, Provider() if a.generate else None),
        "health": corpus.health,
        "index": lambda: index_books(corpus.spark, a.pages, a.trees, a.only, not a.no_escalate, a.revalidate_only),
        "query": lambda: query_trees(corpus.spark, a.question, a.pages, a.trees, a.summary_only),
    }[a.command]()
    print(json.dumps(found, indent=2, ensure_ascii=False, default=str))


if __name__ == "__main__":
    main()
