"""Inputs on which an operator once did less than its whole job."""

import numpy as np
import pytest

from quire.llm import graph, packing, toxicity
from quire.llm.common import Workspace
from quire.llm.graph import components
from quire.operators import trees


@pytest.mark.parametrize("few", (0, graph.FEW))
def test_components_of_rising_chains_and_random_graphs(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    rng = np.random.default_rng(8)
    edges = [(i, i + 1) for i in range(3000)]  # ids rise along a path
    edges += [(10_000 + i, 20_000) for i in range(500)]  # all but the centre are local minima
    edges += [tuple(int(30_000 + x) for x in rng.integers(0, 1500, 2)) for _ in range(900)]
    up = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            up[max(find(a), find(b))] = min(find(a), find(b))
    frame = spark.createDataFrame(edges, "a long, b long")
    got = components(frame, Workspace(spark, "chains")).collect()
    assert len(got) == len(up) and {r.node: r.label for r in got} == {x: find(x) for x in up}


def test_toxic_words_count_anywhere_in_a_text_without_blanks():
    rng = np.random.default_rng(1)
    word = lambda: bytes(rng.integers(97, 123, 9).astype("u1"))
    toxic, ordinary = [word() for _ in range(40)], [word() for _ in range(40)]
    model = toxicity.Model(b"".join(toxic), b"".join(ordinary), np.zeros(9))
    fill = lambda n: bytes(rng.integers(0x80, 0xF0, n).astype("u1"))
    for at in (0, 300, 3000, 4000, 20_000, 200_000):
        text = fill(at) + b"".join(toxic[:20]) + fill(500)
        toxic_one, ordinary_one = model.compressors()
        assert sum(len(ordinary_one(w)) - len(toxic_one(w)) for w in toxicity.windows(text)) > 100
        assert b"".join(w[len(toxicity.PRIMER) :][: toxicity.SLICE - toxicity.OVERLAP] for w in toxicity.windows(text))[1 : at + 1] == text[:at]
    short = b" ".join([b"word"] * 20)
    assert len(toxicity.windows(short)) == 3 and toxicity.windows(short)[2] == toxicity.PRIMER + b" word word word word "


def test_token_ids_of_added_tokens_and_long_runs():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    mark = "<|endoftext|>"
    texts = [f"hello {mark} world", mark, mark * 3, f"a{mark}\n\n{mark} b  {mark}", "<|endoftext", "a" + " " * 1_100_000 + "b", "\n" * 1_500_000 + mark + " x"]
    for text in texts:
        assert packing.token_ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids + [1]
    assert packing.token_ids(texts[0]).tolist() == [31373, 220, 50256, 995, 1]


def test_node_ids_of_a_book_of_more_than_9999_nodes(spark):
    nodes = spark.range(12_346).selectExpr("'b' AS book", "array(CAST(id AS INT)) AS path")
    got = {r.path[0] + 1: r.node_id for r in trees.number_nodes(nodes, ["path"]).collect()}
    assert len(set(got.values())) == 12_346
    assert (got[1], got[1234], got[9999], got[10_000], got[12_345]) == ("0001", "1234", "9999", "10000", "12345")


def test_trees_of_many_levels_and_many_documents(spark):
    tree = '{"title": "last"}'
    for _ in range(149):
        tree = '{"title": "t", "nodes": [' + tree + "]}"
    deep = spark.createDataFrame([("d", '{"structure": [' + tree + "]}")], "doc string, tree string")
    flat = trees.flatten_trees(spark, deep).select("doc", "depth", "title")
    assert [r.title for r in flat.filter("depth = 150").collect()] == ["last"]
    many = spark.range(1_100_000).selectExpr("CAST(id AS STRING) AS doc", """'{"structure": [{"title": "A"}]}' AS tree""")
    assert trees.flatten_trees(spark, many).select("doc", "crumb").count() == 1_100_000
