"""Steps that must not grow faster than their input, on literal rows and against plain versions."""

import random

import numpy as np

from pyspark.sql import functions as F

from quire.operators import chunks, contents, retrieval, substrings, trees


def test_first_page_of_short_texts(spark, monkeypatch):
    monkeypatch.setattr(substrings, "STRETCH", 64)  # many stretches, so that pages lie at their edges
    draw = random.Random(5)
    text = lambda n: "".join(draw.choice("ab é𝒳\n") for _ in range(n))
    pages = [(book, k, text(draw.choice((0, 1, 7, 60, 150)))) for book in ("b", "c") for k in range(1, 25)] + [(None, 1, "ab ab"), ("b", 30, None), ("d", 1, "")]
    cut = [t[i : i + draw.randint(1, 20)] for b, _, t in pages[:48] if t for i in (0, 9)]
    asked = [(book, i, q) for i, q in enumerate(cut) for book in ("b", "c")] + [(None, 900, "ab"), ("d", 901, "a"), ("b", 902, ""), ("b", 903, "a" * 20)]
    rows = lambda data, ddl: spark.createDataFrame(data, ddl)
    got = substrings.first_holding(rows(pages, "book string, page_no int, text string"), rows(asked, "book string, query_id int, question string")).collect()
    holds = lambda b, q: [k for c, k, t in pages if c == b and t is not None and q in t]
    want = {(b, i, min(holds(b, q))) for b, i, q in asked if b and q and holds(b, q)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_neighbour_pages(spark):
    draw = random.Random(3)
    items = [("b", i, draw.choice((None, 10 * i)), draw.choice((None, True, False))) for i in range(1, 60)]
    checked = spark.createDataFrame([(b, i, p, ok if p else None) for b, i, p, ok in items], "book string, ord int, physical_index int, ok boolean")
    got = contents.neighbours(checked, spark.createDataFrame([("b", 999)], "book string, n_pages int"))
    assert "UnboundedFollowing" not in plan_of(got)  # such a frame is walked to its end for every row
    good = [(r.ord, r.physical_index) for r in checked.collect() if r.ok is not False and r.physical_index]
    want = {(i, max((p for o, p in good if o < i), default=0), min((p for o, p in good if o > i), default=999)) for i in [r.ord for r in checked.collect() if r.ok is False]}
    assert {(r.ord, r.before, r.after) for r in got.collect()} == want and want


def test_every_query_meets_every_vector(spark, monkeypatch):
    for name, value in {"BATCH": 7, "CELLS": 40, "QUERY_VECTORS": 5}.items():  # slices, products and groups of a few
        monkeypatch.setattr(retrieval, name, value, raising=False)
    vectors = np.random.default_rng(1).integers(-2, 3, (120, 4)).astype(float)  # many ties
    rows = spark.createDataFrame([(i, v.tolist() if i % 17 else None) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
    asked = rows.filter("vec_id % 9 = 0").selectExpr("vec_id AS query_id", "embedding AS q")
    got = retrieval.cosine_topk(rows, asked, k=6)
    assert "CartesianProduct" not in plan_of(got) and "Join" not in plan_of(got)  # pairs of matrices are not rows
    want = set()
    for q in (i for i in range(0, 120, 9) if i % 17):
        first = sorted(((-float(vectors[q] @ vectors[v]), v) for v in range(120) if v % 17))[:6]
        want |= {(q, v, -s, n) for n, (s, v) in enumerate(first, 1)}
    assert {tuple(r) for r in got.select("query_id", "vec_id", "score", "rank").collect()} == want


def test_lexical_lists_are_cut_within_tasks(spark, monkeypatch):
    draw = random.Random(7)
    docs = [(i, " ".join(draw.choice(("aa", "bb", "cc", "dd", "x")) for _ in range(draw.randint(0, 6))) if i % 19 else None) for i in range(200)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame([(1, "aa bb zz"), (2, "cc"), (3, "nothing here"), (4, "dd dd Aa")], "query_id long, question string")
    best = lambda: retrieval.bm25(rows, asked, k=5, among=("true", "doc_id % 3 = 0"))
    monkeypatch.setattr(retrieval, "CELLS", 30, raising=False)
    monkeypatch.setattr(retrieval, "BATCH", 9, raising=False)
    got = best()
    assert "Join" not in plan_of(got)
    few = sorted(map(tuple, got.collect()))
    monkeypatch.setattr(retrieval, "QUERY_ROWS", 0)
    assert few == sorted(map(tuple, best().collect())) and len(few) == 30


def test_packing_in_blocks(spark):
    """Blocks of any size give the same chunks, through headers without text and books without headers."""
    draw = random.Random(11)
    rows = []
    for book in ("b", "c", None):
        for i in range(60):
            header = book != "c" and draw.random() < 0.15
            label = "section_header" if header else draw.choice(("text", "text", "table", "caption", None))
            rows.append((book, i, f"{book}#{i}", label, i // 9, None if header and draw.random() < 0.4 else draw.choice(("", "Some words. More here.", "x " * 300))))
    records = spark.createDataFrame(rows, "book string, rec_no int, id string, label string, page_no int, text string").repartition(5)
    pack = lambda block: sorted(map(str, chunks.pack(records, F.concat(F.lit("> "), F.substring("text", 1, 9)), block=block).collect()))
    one = pack(1000)
    assert one == pack(7) == pack(1)
    got = chunks.pack(records, F.concat(F.lit("> "), F.substring("text", 1, 9)), block=7)
    by_book = {}
    for r in got.orderBy("rec_no", "ordinal").collect():
        by_book.setdefault(r.book, []).append(r)
    for book, found in by_book.items():
        assert [r.ordinal for r in found] == list(range(1, len(found) + 1))
        for r in found:
            heads = [x for x in rows if x[0] == book and x[3] == "section_header" and x[1] <= r.rec_no]
            named = [x for x in heads if x[5] is not None]
            assert r.parent_id == (heads[-1][2] if heads else None) and r.heading == ("> " + named[-1][5][:9] if named else "")


def test_contents_meet_few_pages(spark):
    lines = ["Contents"] + [f"{i}. Chapter title {'abcdefgh'[i]} ..... {i + 10}" for i in range(1, 8)]
    texts = ["cover", "\n".join(lines), "\n".join(lines)] + ["filler"] * 8 + [f"Chapter title {'abcdefgh'[i]}\ntext" for i in range(1, 8)] + ["tail"] * 60
    pages = spark.createDataFrame([("b", i + 1, t) for i, t in enumerate(texts)], "book string, page_no int, text string")
    assert plan_of(contents.contents_text(pages)).count("<= 45)") >= 2  # on both sides of the join: the other pages stay where they are
    found = contents.offset_by_contents(pages)
    assert "strategy=broadcast" in plan_of(found)  # a book's pages need not meet in one task
    assert [tuple(r) for r in found.collect()] == [("b", 1)]


def test_node_ids_beyond_four_digits(spark):
    nodes = spark.range(1, 10_101).selectExpr("'b' AS book", "array(CAST(id AS INT)) AS path")
    ids = {r.path[0]: r.node_id for r in trees.number_nodes(nodes, ["path"]).collect()}
    assert len(set(ids.values())) == 10_100 and (ids[1], ids[1000], ids[10_000]) == ("0001", "1000", "10000")
