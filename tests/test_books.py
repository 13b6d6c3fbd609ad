"""Contents, typography, links, repair and the corpus engine on literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from quire.engine import Corpus, hashed_encoder
from quire.functions import text as X
from quire.operators import contents, layout, repair
from quire.providers import Provider
from quire.service import respond, serve


def page(spark, *texts):
    return spark.createDataFrame([("b", i + 1, t) for i, t in enumerate(texts)], "book string, page_no int, text string")


def test_chapter_titles(spark):
    pages = page(
        spark, "see CHAPTER 1 for lower", "CHAPTER 1\n\n\nBones of\nthe Hand\n\nText", "CHAPTER 1\nOther", "CHAPTER 2\nJoints\nOUTLINE\nx",
        "CHAPTER 3\n• bullet", "CHAPTER 4\nSkin\nPART 2\n", "CHAPTER 5\n" + "A" * 130, "Chapter 6\nTitle", "CHAPTER 7\nOne\nCHAPTER 8\nTwo",
    )
    got = {r.number: (r.page_no, r.title) for r in contents.chapters(pages).collect()}
    assert got == {"1": (2, "Bones of the Hand"), "2": (4, "Joints"), "4": (6, "Skin"), "7": (9, "One"), "8": (9, "Two")}


def test_divisions(spark):
    pages = page(spark, "PART 1: DIAGNOSES\n", "part 1: DIAGNOSES", "Part 2, J Clin", "SECTION IV\nSURGERY\n", "SECTION I 5\n", "PART 3 " + "X" * 50)
    got = {(r.label, r.page_no) for r in contents.divisions(pages).collect()}
    assert got == {("PART 1 DIAGNOSES", 1), ("SECTION IV SURGERY", 4)}


def test_offsets(spark):
    toc = "\n".join(f"{i}. Title {'abcdefgh'[i]} ..... {i * 2}" for i in range(1, 7))
    body = [f"Title {'abcdefgh'[i]}\ntext\n" for i in range(1, 7)]
    pages = page(spark, toc, toc.replace("Title", "More"), *body)
    # Four titles head the first contents page: -1 -3 -5 -7; two their own page: -3 -4; of the second page's, two count: 0 -2.
    assert contents.offset_by_contents(pages).collect() == [("b", -3)]
    heads = page(spark, "x 9", "x", "HEAD 1", "HEAD 2", "HEAD 1")
    assert contents.offset_by_headers(heads).collect() == [("b", 2)]


def test_outline(spark):
    lines = ["CHAPTER OUTLINE", "I. First thing, Adams 3", "2.1 Second 4", "IV) Third, 5", "XX Fourth 6", "no number"]
    got = [(r.structure, r.title, r.printed) for r in contents.outline_items(page(spark, "\n".join([*lines, "z 7"]), "\n".join(lines[1:]))).orderBy("line_no").collect()]
    assert got == [("1", "First thing", 3), ("2.1", "Second", 4), ("4", "Third", 5), ("1", "Fourth", 6)]
    many = "\n".join(["CHAPTER OUTLINE", *[f"{i} Item 1" for i in range(31)]])
    assert {r.page_no for r in contents.outline_items(page(spark, many, many)).collect()} == {1}


def test_first_run_and_titles(spark):
    hits = page(spark, *["long enough"] * 8).withColumn("hit", F.col("page_no").isin(2, 3, 6))
    assert sorted(r.page_no for r in contents.first_run(hits).collect()) == [2, 3]
    titles = spark.createDataFrame([("b", 1, "Bones of  the hand"), ("b", 2, "xy"), ("b", 3, "none at all here")], "book string, ord int, title string")
    got = {r.ord: r.found_page for r in contents.locate_anywhere(titles, page(spark, "axyz", "the\nBONES OF THE\nhand")).collect()}
    assert got == {1: 2, 2: 1}


def test_verification(spark):
    pages = page(spark, "alpha", "beta", "gamma", "delta")
    items = spark.createDataFrame([("b", 1, "Alpha", 1), ("b", 2, "beta", 3), ("b", 3, "gamma", 3), ("b", 4, "delta", None), ("b", 5, "delta", 9)], "book string, ord int, title string, physical_index int")
    checked = contents.verified(items, pages)
    assert {r.ord: r.ok for r in checked.collect()} == {1: True, 2: False, 3: True, 4: None, 5: None}
    totals = spark.createDataFrame([("b", 4)], "book string, n_pages int")
    assert contents.accuracy(checked, totals).collect() == [("b", 0.5)]
    assert contents.accuracy(checked.filter("ord = 1"), totals).collect() == [("b", 0.0)]
    assert contents.neighbours(checked, totals).collect() == [("b", 2, 1, 3)]


def test_typography(spark):
    def line(n, text, size, y0=500.0):
        return ("b", 1, 0, n, 0, text, size, y0, y0 + 12, 1000.0)

    rows = [line(0, "body text " * 5, 10.0), line(1, "Large", 17.0), line(2, "Middle", 13.5), line(3, "Small", 11.5), line(4, "Ends.", 17.0), line(5, "1.2 Numbered", 10.0), line(6, "Large", 17.0, 10.0), line(7, "Chapter IV", 10.0)]
    spans = spark.createDataFrame(rows, "book string, page_no int, block int, line int, span int, text string, size double, y0 double, y1 double, height double")
    assert layout.body_size(spans).collect() == [("b", 10.0)]
    assert {r.line: r.level for r in layout.headings(spans).collect()} == {1: 1, 2: 2, 3: 3, 5: 2, 7: 1}


def test_links_and_repair(spark):
    good, bad = "![a](/old/run/figures/p 1.png) ![r](https://x/figures/a.png)", "![a](figures/gone.png) ![b](c.png) ![c](figures/../d.png)"
    exports = spark.createDataFrame([("g", good), ("h", bad)], "folder string, markdown string")
    files = spark.createDataFrame([("g", "figures/p 1.png")], "folder string, path string")
    assert sorted((r.uri, r.reason) for r in repair.broken_links(exports, files).collect()) == [("c.png", "unsupported local image path"), ("figures/../d.png", "unsupported local image path"), ("figures/gone.png", "missing")]
    assert repair.repaired(exports, files).collect() == [("g", "![a](figures/p%201.png) ![r](https://x/figures/a.png)", True)]
    new = spark.createDataFrame([("g", 5, 1.0)], "folder string, n int, seconds double")
    old = spark.createDataFrame([("g", 9.0, "p.pdf")], "folder string, seconds double, pdf string")
    assert repair.carry_over(new, old).select("folder", "n", "seconds", "pdf").collect() == [("g", 5, 9.0, "p.pdf")]
    want = spark.createDataFrame([("a", None), ("b", 1), ("c", 2)], "book string, v int")
    have = spark.createDataFrame([("a", None), ("b", 2)], "book string, v int")
    assert sorted(r.book for r in repair.to_extract(want, have, ["book", "v"]).collect()) == ["b", "c"]


def test_names(spark):
    got = spark.range(1).select(X.slug(X.ascii_name(F.lit("  Zähne & ﬁlling (2nd)")), F.lit("a.pdf")).alias("x"), X.slug(F.lit("…"), F.lit("a.pdf")).alias("y")).first()
    assert got.x.startswith("zahne-filling-2nd-") and len(got.x) == 26 and got.y.startswith("book-")


def test_corpus(spark, tmp_path):
    rows = [("b#0", "Bones", "section_header", 1, 1), ("b#1", "The hand has twenty seven bones in all.", "text", None, 2), ("b#2", "References", "section_header", 1, 3), ("b#3", "Smith on hand bones, a study.", "text", None, 3)]
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps({"id": i, "book": "b", "label": k, "text": t, "level": v, "page_no": p, "heading_path_str": "References" if int(i[2:]) > 1 else "Bones"}) for i, t, k, v, p in rows))
    corpus = Corpus(spark, str(tmp_path / "out"))
    asked = lambda q: respond(corpus, Provider(), "POST", "/api/ask", json.dumps(q).encode())
    assert corpus.health()["status"] == "index_missing" and asked({"question": "hand?"})[0] == 503
    assert corpus.ingest(str(tmp_path / "b.jsonl"), ["B"]) == 1 and corpus.ingest(str(tmp_path / "b.jsonl")) == 0
    assert corpus.ingest(str(tmp_path / "b.jsonl"), force=True) == 1
    with pytest.raises(ValueError):
        corpus.ingest(str(tmp_path / "b.jsonl"), ["missing"])
    assert corpus.health() == {"status": "ready", "books": 1, "chunks": 2}
    hits = corpus.retrieve("hand bones")
    assert [h["heading"] for h in hits] == ["Bones", "References"] and corpus.retrieve("hand bones", "other") == []
    said = asked({"question": "How many bones has the hand?"})[1]
    assert said["status"] == "answered" and said["text"].endswith("[E1]") and said["citations"][0]["book"] == "b"
    traces = spark.read.parquet(str(tmp_path / "out/traces")).collect()
    assert [(r.trace_id, r.question, r.status) for r in traces] == [(said["trace_id"], "", "answered")]
    assert asked({"question": " "})[0] == 422 and asked([1])[0] == 422
    assert asked({"question": "Is my hand well?", "audience": "patient"})[1]["status"] == "personal_question"
    assert respond(corpus, None, "GET", f"/source/{hits[0]['chunk_id']}")[1]["book"] == "b"
    assert respond(corpus, None, "GET", "/source/none")[0] == 404 and respond(corpus, None, "GET", "/x")[0] == 404
    (tmp_path / "cases.json").write_text(json.dumps([{"id": "1", "question": "hand bones", "anchors": [{"book": "b", "pdf_page": 2}]}, {"id": "2", "question": "hand", "anchors": [{"book": "b", "pdf_page": 9}, {"source_id": "b#1"}]}, {"id": "3", "question": "a study", "source_id": "b#3"}, {"id": "4", "question": "Is my hand well?", "audience": "patient", "refusal": True}]))
    assert corpus.evaluate(str(tmp_path / "cases.json")) == {"hit5": 0.666667, "hit10": 0.666667, "mrr": 0.666667, "n_cases": 3}
    with_answers = corpus.evaluate(str(tmp_path / "cases.json"), Provider())
    assert with_answers["citation_validity"] == 1.0 and with_answers["refusals"] == "1/1"
    assert "| 4 | - | personal_question |" in (tmp_path / "out/reports/evaluation.md").read_text()
    dense = Corpus(spark, str(tmp_path / "out"), {"encoder": "hashed-64", "encode": hashed_encoder(64)})
    assert not dense.dense_ready() and dense.health()["status"] == "index_outdated"
    assert dense.ingest(str(tmp_path / "b.jsonl")) == 1 and dense.dense_ready()
    assert [h["heading"] for h in dense.retrieve("hand bones")] == ["Bones", "References"]
    assert [h["heading"] for h in Corpus(spark, str(tmp_path / "out"), {"rerank": lambda q, t: F.when(t.contains("Smith"), 1.0).otherwise(0.95)}).retrieve("hand bones")] == ["Bones", "References"]
    assert json.loads(corpus.audit(str(tmp_path / "b.jsonl"))[0])["labels"] == {"section_header": 2, "text": 2}
    with pytest.raises(ValueError):
        serve(corpus, host="0.0.0.0")


def test_ingest_gives_list_items_ids_and_pages(spark, tmp_path):
    record = {"book": "b", "heading_path_str": "H", "page_no": 3}
    rows = [record | {"id": "b#0", "label": "list", "text": "- one\n- two\n- odd"}, record | {"id": "b#3", "label": "text", "text": "after", "page_no": None}, record | {"id": "b#4", "label": "text", "text": "front", "page_no": 2}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/b.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "raw").mkdir()
    items = [{"label": "list_item", "text": t, "prov": [{"page_no": p}]} for t, p in (("one", 3), ("two", 4))]
    (tmp_path / "raw/b.json").write_text(json.dumps({"texts": [{"label": "text", "text": "one"}, *items]}))
    corpus = Corpus(spark, str(tmp_path / "out"))
    corpus.ingest(str(tmp_path / "in"), raw=str(tmp_path / "raw"), min_page={"b": 3})
    got = [(r.source_ids, r.page_start, r.page_end) for r in corpus.chunks().orderBy("ordinal").collect()]
    assert got == [(["b#0"], 3, 3), (["b#1"], 4, 4), (["b#2"], 3, 3)]  # the page-less and the front record are before page 3
