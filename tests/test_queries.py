"""Queries against their SQL in DuckDB, and what SQL cannot check on literal rows."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quire.functions import text as X
from quire.operators import answers, audit, chunks, retrieval, running, trees
from quire.plans.queries import SQL
from quire.providers import Provider, ask, tolerant_json
from tests.oracle import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, name):
    if name in ("batch_status_summary", "health_status", "ingest_antijoin"):
        pytest.importorskip("duckdb")
    assert compare(spark, FOLDER, name) == ""


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_chunk_spans_slice_back(spark):
    got = entry.queries()["chunk_spans"](spark, FOLDER)
    assert got.filter("length(part) <> `end` - start OR part IS NULL").count() == 0
    packed = entry.queries()["chunk_pack"](spark, FOLDER)
    assert packed.filter("octet_length(heading) < 800 AND n_tokens > 512").count() == 0


ROW = {"book": "b", "section": 0, "label": "text", "heading": "H", "page": 1, "page_end": 1, "chapter": "c", "parent_id": "b#0", "piece_no": 0, "allowed": "", "alone": False, "raw": ""}


def pack(*rows):
    """Chunks of records through the two streaming steps, batch by batch of two."""
    full = [ROW | {"rec_no": i, "id": f"b#{i}"} | r for i, r in enumerate(rows)]
    batches = (pa.RecordBatch.from_pylist(full[i : i + 2], schema=chunks._schema(chunks.PIECE)) for i in range(0, len(full), 2))
    return [r for batch in chunks._fold(chunks._cut(batches)) for r in batch.to_pylist()]


def test_packing_flushes_and_pairs():
    assert len(pack({"text": "a"}, {"text": "b"})) == 1
    assert len(pack({"text": "a"}, {"text": "b", "page": 2})) == 2
    assert len(pack({"text": "a"}, {"text": "b", "heading": "I"})) == 2
    assert len(pack({"text": "x" * 500}, {"text": "y" * 500})) == 2
    pair = pack({"text": "caption", "label": "caption"}, {"text": "| t | \n", "label": "table"})
    assert len(pair) == 1 and pair[0]["label"] == "caption" and [s["source_id"] for s in pair[0]["spans"]] == ["b#0", "b#1"]
    assert pair[0]["text"] == "caption\n\n| t | \n"  # what joins stands as it is
    assert len(pack({"text": "t", "label": "table"}, {"text": "u", "label": "table"})) == 2
    assert len(pack({"text": "t", "label": "table"}, {"text": "u", "label": "caption", "page": 2})) == 2
    assert len(pack({"text": "t", "label": "table"}, {"text": ""}, {"text": "u", "label": "caption"})) == 2
    assert len(pack({"text": "a"}, {"text": ""}, {"text": "b"})) == 1
    assert len(pack({"text": "row\n" * 600, "label": "table"})) > 1
    long = pack({"text": "a", "heading": "h" * 1000}, {"text": "b", "heading": "h" * 1000})
    assert len(long) == 2 and long[0]["n_tokens"] > 500  # a heading that is cut for the budget never equals the full one


def test_split_text_keeps_the_budget():
    assert chunks.split_text("A b. C d", 100) == ["A b.C d"]
    assert chunks.split_text("four\nFive", 100) == ["four\nFive"] and chunks.split_text("five.\nSix", 100) == ["five.Six"]
    for text in ("word " * 400, "x" * 3000, "One. Two. " * 200, "é" * 900):
        parts = chunks.split_text(text, 100)
        assert all(chunks.tokens(chunks.weight(p)) <= 100 for p in parts)
        assert "".join("".join(parts).split()) == "".join(text.split())
    assert [len(p) for p in chunks.split_text("x" * 300 + " y", 100)] == [132, 132, 36, 1]  # two thirds of the budget twice over, the tail alone


def test_list_lines_find_the_next_item(spark):
    lines = spark.createDataFrame([("b", 0, 0, "a", 9), ("b", 0, 1, "b", 9), ("b", 1, 0, "z", 9), ("b", 1, 1, "a", 9), ("c", 0, 0, "a", 7)], "book string, rec_no int, item_no int, line string, page_no int")
    items = spark.createDataFrame([("b", 0, "a", 3), ("b", 1, "b", 4), ("b", 2, "a", 5)], "book string, pos int, text string, page int")
    got = chunks.line_pages(lines, items).orderBy("book", "rec_no", "item_no").collect()
    assert [r.page_no for r in got] == [3, 4, 9, 5, 7]


def test_running_values_cross_blocks(spark):
    rows = spark.range(50).selectExpr("'b' AS book", "CAST(id AS INT) AS n", "CASE WHEN id % 7 = 0 THEN id END AS v")
    got = running.latest(running.running(rows, "book", ["n"], {"total": F.col("n")}, 8), "book", "n", {"w": F.col("v")}, 8)
    got = running.previous(got, "book", "n", "before", F.col("n"), 8).collect()
    assert {r.n: (r.total, r.w, r.before) for r in got} == {n: (n * (n + 1) // 2, n // 7 * 7, n - 1 if n else None) for n in range(50)}
    numbers = running.numbered(rows.withColumn("g", F.col("n") % 2), "book", "g", "n", "at", 8).collect()
    assert {r.n: r["at"] for r in numbers} == {n: n // 2 + 1 + 25 * (n % 2) for n in range(50)}


def test_fusion_and_budget(spark):
    a = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(0, 2, 1), (0, 3, 2), (0, 4, 1)], "query_id long, id long, rank int")
    assert [r.id for r in retrieval.rrf([a, b], "id").orderBy("rank").collect()] == [2, 1, 4, 3]
    sizes = spark.createDataFrame([(0, 1, 1, 5000), (0, 2, 2, 3000), (0, 3, 3, 1500)], "query_id long, id long, rank int, n_tokens long")
    assert [r.id for r in retrieval.budget(sizes, "id").orderBy("rank").collect()] == [1, 3]


def test_provenance_and_flags(spark):
    items = spark.createDataFrame([("b", 1, "texts", 30, [1], 41, 43), ("b", 2, "texts", 10, [1, 2], 41, 43), ("b", 3, "tables", 0, [9], 41, 43)], "batch string, item long, kind string, size long, pages array<int>, start int, end int")
    assert audit.provenance(items).filter("unmapped").count() == 3  # page 9 makes the batch's pages absolute
    got = {r.page: r.text_chars for r in audit.page_counts(items.filter("item < 3")).collect()}
    assert got == {41: 40, 42: 10, 43: 0}


def test_trees(spark):
    tree = '{"structure": [{"title": "A", "start_index": 1, "end_index": 9, "nodes": [{"title": "B", "start_index": 2, "end_index": 2}]}, {"title": "C", "start_index": 10, "end_index": 10}]}'
    flat = trees.flatten_trees(spark, spark.createDataFrame([("d", tree)], "doc string, tree string"))
    assert sorted(r.crumb for r in flat.collect()) == ["A", "A > B", "C"]
    climbed = {tuple(r.path): r.climbed for r in trees.climb(flat).collect()}
    assert climbed == {(0,): [0], (0, 0): [0], (1,): None}
    pages = spark.createDataFrame([("b", p, p in (3, 4, 5, 8, 9)) for p in range(1, 11)], "book string, page_no int, hit boolean")
    assert trees.contents_runs(pages).select("first_page", "last_page").collect() == [(3, 5)]
    diffs = spark.createDataFrame([("b", i, d) for i, d in enumerate([7, 8, 8, 7])], "book string, ord int, diff int")
    assert trees.mode_first(diffs, "diff", "ord").first().offset == 7 and trees.upper_median(diffs, "diff").first().offset == 8


def test_claims_cite_one_span(spark):
    text = "first passage\n\nsecond passage here"
    spans = [{"source_id": 1, "start": 0, "end": 13}, {"source_id": 2, "start": 15, "end": 34}]
    chunk = spark.createDataFrame([("c", text, spans)], "chunk_id string, text string, source_spans array<struct<source_id:int,start:int,end:int>>")
    claims = spark.createDataFrame([(1, "c", "second passage"), (2, "c", "passage\n\nsecond")], "claim_id int, chunk_id string, quote string")
    assert [(r.claim_id, r.span.source_id) for r in answers.cite(claims, chunk).collect()] == [(1, 2)]


CHUNK = {"chunk_id": "c", "text": "Aspirin thins the blood of patients.", "n_tokens": 20, "source_spans": [{"source_id": "s", "page": 12, "start": 0, "end": 36}]}


def run(claims, verdicts=None, **more):
    p = Provider(claim=lambda q, e: claims.pop(0), **({"verify": lambda q, c: verdicts.pop(0)} if verdicts else {}))
    return ask("What thins blood?", lambda q: [CHUNK], p, **more)


def test_agent():
    good = {"text": "It thins blood.", "evidence_id": "E1", "quote": "thins the blood"}
    assert ask("Is my dose right?", lambda q: [CHUNK], Provider(), "patient").status == "personal_question"
    assert ask("What?", lambda q: [CHUNK], None).status == "not_configured"
    assert run([[good | {"evidence_id": "E99"}], []]).status == "insufficient_evidence"
    assert run([[good | {"quote": "not in the text"}], []]).status == "insufficient_evidence"
    assert run([[good]]).citations[0]["pdf_page"] == 12
    yes = {"answers_question": True, "patient_specific_advice": False}
    partly = run([[good, good | {"text": "x"}]], [{"supported": [False, True], **yes}])
    assert [c["id"] for c in partly.citations] == ["E1"]
    assert run([[good], [good]], [{"supported": [True], **yes | {"answers_question": False}}] * 2).status == "insufficient_evidence"
    assert run([[good], [good]], [{"supported": [], **yes}, {"supported": [True], **yes}]).status == "answered"


def test_text_functions(spark):
    one = spark.range(1)
    got = lambda c: one.select(c.alias("x")).first().x
    assert got(X.token_estimate(F.lit("é" * 3))) == 5
    assert got(X.heading_valid(F.lit("12"))) is False and got(X.heading_valid(F.lit("BONES"))) is True
    assert got(X.roman(F.lit("iv"))) == 4 and got(X.roman(F.lit("Z"))) == 1
    assert got(X.asks_for_sources(F.lit("the references"))) is False and got(X.asks_for_sources(F.lit("a bibliography"))) is True
    assert got(X.local_asset(F.lit("out/figures/a%20b.png"))) == "figures/a b.png" and got(X.local_asset(F.lit("https://x/figures/a"))) is None
    assert tolerant_json('<think>no</think>```json\n{"a": None, "b": [1,],}\n```') == {"a": None, "b": [1]} and tolerant_json("none") == {}


def test_streaming_ingest_replaces_books(spark, tmp_path):
    from quire.streaming.ingest import ingest

    source = tmp_path / "in"
    source.mkdir()
    put = lambda name, rows: (source / name).write_text("\n".join(rows))
    put("a.jsonl", ['{"id": "b#0", "book": "b", "label": "text", "text": "old"}', '{"id": "c#0", "book": "c", "label": "text", "text": "kept"}'])
    go = lambda: ingest(spark, str(source), str(tmp_path / "out"), str(tmp_path / "check"))
    go()
    put("b.jsonl", ['{"id": "b#0", "book": "b", "label": "text", "text": "new"}', '{"id": "b#1", "book": "b", "label": "text", "text": "x", "front_matter": true}'])
    go()
    go()
    assert sorted((r.book, r.text) for r in spark.read.parquet(str(tmp_path / "out/records")).collect()) == [("b", "new"), ("c", "kept")]
