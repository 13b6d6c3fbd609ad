"""Settings, extraction, quality reports, trees on disk and the question loop on literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from quire import library, settings, treeloop
from quire.operators import dialogue, indexer, quality
from quire.providers import rendered
from quire.sources import extraction, files


def test_settings(tmp_path):
    path = tmp_path / "run.toml"
    path.write_text('input_dir = "in"\noutput_dir = "out"\nbatch_size = 3\nocr_mode = "off"\n[books."a.pdf"]\nbatch_size = 1\nimage_scale = 3\n[books."b.pdf"]\npages = 2\n[books."c.pdf"]\nocr_mode = "all"\n')
    assert settings.load(str(path)).batch_size == 3 and settings.load(str(path)).input_dir == str(tmp_path / "in")
    own = settings.load(str(path), "a.pdf")
    assert (own.batch_size, own.image_scale, own.threads) == (1, 3.0, 4)
    for book in ("b.pdf", "c.pdf"):
        with pytest.raises(ValueError):
            settings.load(str(path), book)


def convert(path, start, end):
    if start == 3:
        raise RuntimeError("stopped")
    items = [{"label": "text", "text": "x" * 30, "prov": [{"page_no": 1}]}, {"label": "formula", "text": " ", "prov": [{"page_no": 2}]}]
    table = {"self_ref": "#/t", "html": "<table/>", "caption": "c", "data": {"table_cells": [{"text": "a"}, {"text": "b"}]}, "prov": [{"page_no": 2}]}
    return json.dumps({"pages": {"1": "", "2": ""}, "texts": items, "tables": [table], "pictures": [{"self_ref": "#/p", "prov": []}]}), " " if start == 5 else "text"


def test_extraction_and_quality(spark, tmp_path):
    batches = spark.createDataFrame([("a", "p", 1, 2), ("b", "p", 3, 4), ("c", "p", 5, 6)], "batch string, path string, start int, end int")
    done = extraction.converted(batches, convert)
    reasons = {r.batch: r.reason for r in extraction.checked(done).collect()}
    assert reasons == {"a": None, "b": "RuntimeError: stopped", "c": "no text"}
    assert extraction.published(done, str(tmp_path / "out")) == 2
    stored = spark.read.parquet(str(tmp_path / "out/documents"))
    items = extraction.layout_items(stored)
    about = stored.select("batch", "start", "end", F.lit(2).alias("n_pages"), F.lit("book").alias("book"), F.lit("fast").alias("profile"), F.lit("f").alias("folder"))
    sources = spark.createDataFrame([("a", 1, 500), ("a", 2, 3)], "batch string, page int, chars int")
    counts = quality.page_counts(items, about)
    assert {r.page: (r.text_chars, r.tables) for r in counts.collect()} == {1: (30, 0), 2: (4, 1)}
    reasoned = quality.page_reasons(counts, sources)
    assert {r.page: r.reasons for r in reasoned.collect()} == {1: ["low_text_retention"], 2: ["empty_formula_text", "table_manual_review_required"]}
    report = quality.batch_reports(items, about, reasoned, sources).first()
    assert (report.status, report["mode"], report.unmapped, report.tables) == ("review", "absolute", 1, 1)
    none = quality.batch_reports(items, about.withColumn("n_pages", F.lit(3)), reasoned, sources.limit(0)).first()
    assert none.reasons == ["page_count_mismatch", "source_text_comparison_unavailable"]
    made = {(r.kind, r.number): (r.file, r.caption, r.pages) for r in extraction.exports(stored).collect()}
    assert made == {("tables", 1): ("tables/table_00001_page_00002.html", "c", [2]), ("pictures", 1): (None, "", [])}
    shifted = quality.page_counts(items, about.withColumn("start", F.lit(41)).withColumn("end", F.lit(42)))
    assert {r.page: r.text_chars for r in shifted.collect()} == {41: 30, 42: 4}


def test_queue_from_reports_on_disk(spark, tmp_path):
    folder = tmp_path / "slug/fast/pages-00001-00002"
    folder.mkdir(parents=True)
    page = {"text_chars": 4, "source_text_chars": 9, "texts": 1, "tables": 1, "pictures": 0}
    report = {"status": "review", "unmapped_elements": 0, "flagged_pages": [{"page": None, "reason": "page_count_mismatch"}, {"page": 1, "reason": "encoding_artifact"}], "pages": {"1": page, "2": page | {"tables": 0, "pictures": 2}}}
    (folder / "quality.json").write_text(json.dumps(report))
    (folder / "manifest.json").write_text(json.dumps({"source": "/books/A b.pdf"}))
    queue = quality.stored_queue(files.read_quality(spark, str(tmp_path)))
    got = sorted((r.book, r.profile, r.pdf_page, r.reasons, r.tables) for r in queue.collect())
    assert got == [("A b.pdf", "fast", "1", "encoding_artifact;table_spot_check", "1"), ("A b.pdf", "fast", "2", "figure_spot_check", "0"), ("A b.pdf", "fast", "batch", "page_count_mismatch", "")]
    files.write_review_queue(queue, str(tmp_path / "queue"))
    assert spark.read.option("header", True).csv(str(tmp_path / "queue")).columns == ["book", "profile", "pdf_page", "reasons", "source_text_chars", "extracted_text_chars", "tables", "pictures", "batch_folder"]


NAMES = ["Bones", "Joints", "Skin", "Teeth", "Nerves"]


def books(tmp_path):
    chapters = [f"CHAPTER {n}\n\n{name} of things\n\nabout subject{n} in depth" for n, name in enumerate(NAMES, 1)]
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages/good.txt").write_text("\f".join(chapters))
    (tmp_path / "pages/plain.txt").write_text("nothing\fto see")
    return str(tmp_path / "pages"), str(tmp_path / "trees")


def test_trees_on_disk(spark, tmp_path):
    pages, folder = books(tmp_path)
    found = library.index_books(spark, pages, folder)
    assert {b: (r["status"], r["mode"]) for b, r in found.items()} == {"good": ("ok", "manual"), "plain": ("failed", None)}
    assert library.index_books(spark, pages, folder, ["good"])["good"]["status"] == "cached_ok"
    assert library.index_books(spark, pages, folder, check_only=True) == {"good": "ok", "plain": "empty_structure"}
    nodes = library.stored_nodes(spark, folder)
    assert [r.title for r in nodes.orderBy("path").collect()] == [f"{n} of things" for n in NAMES]
    assert (tmp_path / "trees/plain_manual_FAILED.json").exists() and (tmp_path / "trees/logs/good.log").read_text().startswith("ok manual")
    assert {(r.doc, r.n_pages) for r in files.page_counts(spark, pages).collect()} == {("good", 5), ("plain", 2)}
    assert [r.chars for r in files.page_chars(spark, pages).filter("doc = 'plain'").orderBy("page").collect()] == [7, 6]
    answers = library.query_trees(spark, "the skin of things", pages, folder)
    assert [a["book"] for a in answers] == ["good"] and "subject3" in answers[0]["answer"]


def test_question_loop_with_a_model(spark):
    nodes = spark.createDataFrame(
        [("a", 1, [0], "0001", "One", 1, 9), ("a", 2, [0, 0], "0002", "Thin", 2, 2), ("b", 1, [0], "0001", "Two", 1, 1)],
        "doc string, depth int, path array<int>, node_id string, title string, start_index int, end_index int",
    ).withColumn("crumb", F.col("title")).withColumn("summary", F.concat(F.lit("sum of "), "title"))
    pages = spark.createDataFrame([(b, p, f"{b}{p}") for b in "ab" for p in range(1, 7)], "book string, page_no int, text string")
    shown = []

    def pick(question, book, text):
        shown.append(text)
        return 'node "["0002"]' if book == "a" else "no list"

    ask = lambda **more: treeloop.ask_trees(spark, "what?", nodes, pages, route=lambda q, t: 'I say ["b", "x", "a"]', pick=pick, **more)
    got = ask()
    assert [(a["book"], a["title"], a["answer"]) for a in got] == [("b", "Two", "b1"), ("a", "One", "a1 a2 a3 a4")]  # a thin node climbs, four pages at most
    assert "0002" not in shown[1] and "0001" in shown[0]  # a tree without wide nodes offers all
    assert [a["answer"] for a in ask(summary_only=True)] == ["sum of Two", "sum of One"]
    described = spark.createDataFrame([("a", ""), ("c", "Own words")], "doc string, description string")
    assert {r.doc: r.description for r in dialogue.registry(nodes, described).collect()} == {"a": "Chapters include: One", "b": "Chapters include: Two", "c": "Own words"}


def test_small_parts(spark):
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError

        return "done"

    assert treeloop.retried(flaky, wait=0) == "done" and treeloop.retried(lambda: 1 / 0, tries=2, wait=0, failed="Error") == "Error"
    with pytest.raises(ZeroDivisionError):
        treeloop.retried(lambda: 1 / 0, tries=2, wait=0, growing=True)
    assert rendered("One [E1] two\n\n\nthree") == [[{"text": "One "}, {"cite": "E1"}, {"text": " two"}], [{"text": "three"}]]
    pages = spark.createDataFrame([("b", p, f"t{p}") for p in (1, 2, 3)], "book string, page_no int, text string")
    groups = spark.createDataFrame([("b", 1, 0), ("b", 2, 0), ("b", 3, 1)], "book string, page_no int, group_no int")
    seen = indexer.inferred_structure(pages, groups, lambda text, before: [{"n": len(before), "first": text[:18]}])
    assert seen == [{"n": 0, "first": "<physical_index_1>"}, {"n": 1, "first": "<physical_index_3>"}]
