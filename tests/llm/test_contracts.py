"""The registered queries on a small folder of their own: names, types, and every row against a plain version."""

import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import crf, neighbours, ngram_join, registry, rules, suffix, tokencount
from quire.llm.common import Workspace
from tests.llm.test_operators import LABELS, SCHEMA, WORD, corpus, plain_spans

TYPES = {
    "op1_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op2_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op3_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op4_token_counts": {"doc_id": "bigint", "n_words": "bigint", "n_tokens": "bigint"},
    "op5_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op6_ngram_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op7_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op8_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op9_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op10_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with nulls, repeats, long texts and junk that passes the base rules; labels; vectors."""
    rng = np.random.default_rng(4)
    rows = corpus()[:-1]
    words = [f"word{i}" for i in range(200)]
    for i in range(160):
        good = ". ".join(" ".join(rng.choice(words, 9)).capitalize() for _ in range(12)) + "."
        junk = " | ".join(rng.choice(words, 70))
        rows.append((1000 + i, junk if i % 8 == 0 else good, "en", "c", 0, 7, 1.0, 0, "clash"))
    rows += [(2000 + i, t, "de", None, 0, 7, 1.0, 0, "clash") for i, (t, _, _) in enumerate(LABELS)]
    where = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).withColumn("_span_id", F.lit(1)).withColumn("_spans", F.lit("x")).repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(2000 + i, q, x) for i, (_, q, x) in enumerate(LABELS)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(i, rng.standard_normal(8).astype("f4").tolist()) for i in range(60)], "vec_id long, embedding array<float>").write.parquet(f"{where}/embeddings.parquet")
    return where


@pytest.fixture(scope="module")
def texts(spark, folder):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(TYPES))
def test_names_and_types(spark, folder, name):
    found = dict(registry.QUERIES[name](spark, folder).dtypes)
    assert {k: found.get(k) for k in TYPES[name]} == TYPES[name]


def test_op2_rows(spark, folder, texts):
    rows = registry.QUERIES["op2_sharding"](spark, folder).collect()
    assert Counter(r.doc_id for r in rows) == Counter(list(texts))
    held = defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        held[r.shard].append(r)
    assert sorted(held) == list(range(8)) and all(sorted(r.slot for r in x) == list(range(len(x))) for x in held.values())
    sizes = [sum(r.size for r in x) for x in held.values()]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in rows)
    by_text = defaultdict(set)
    for r in rows:
        by_text[texts[r.doc_id]].add(r.shard)
    assert all(len(x) == 1 for x in by_text.values())


def test_op3_and_op10_rows(spark, folder, texts):
    for name, least in (("op3_toxicity", 0.3), ("op10_quality", 0.7)):
        rows = registry.QUERIES[name](spark, folder).collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= least)
        wanted = {2000 + i: (x if name == "op3_toxicity" else q) for i, (_, q, x) in enumerate(LABELS)}
        held = [(r.predicted, wanted[r.doc_id]) for r in rows if r.doc_id in wanted and r.held_out]
        assert len(held) > 30 and sum(p == y for p, y in held) >= 0.95 * len(held)


def test_op10_score_is_the_length_weighted_mean_of_line_marginals():
    model = crf.train([(t, q) for t, q, _ in LABELS])
    for text in (b"a calm line of text\nBUY!! NOW!! | x\n\nfine words here", b"", b"one"):
        c = crf.chains([text])
        emission = c.x @ model.weights
        n, mass, good = len(emission), 0.0, np.zeros(len(emission))
        for path in product((0, 1), repeat=n):
            s = np.exp(sum(emission[t] * y for t, y in enumerate(path)) + sum(model.transition[p, q] for p, q in zip(path, path[1:])))
            mass, good = mass + s, good + s * np.array(path)
        share = np.clip((good / mass * c.weight).sum() / c.weight.sum(), 1e-4, 1 - 1e-4)
        want = 1 / (1 + np.exp(-(model.slope * np.log(share / (1 - share)) + model.bias)))
        assert model.score([text])[0] == pytest.approx(want)


def test_blocks_are_bounded_by_all_their_bytes():
    texts = [b"x" * 90] * 10 + [b"y" * 500] + [b"z"] * 5
    found = list(crf.blocks(texts, most=200, many=4))
    assert [t for b in found for t in b] == texts and all(sum(map(len, b)) <= 200 or len(b) == 1 for b in found) and max(map(len, found)) <= 4


def test_op7_rows(spark, folder, texts):
    rows = registry.QUERIES["op7_rules"](spark, folder).collect()
    assert len(rows) == len(texts)
    patterns = Counter()
    votes = {}
    measured = rules.measures(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    for r in measured.select("doc_id", F.array(*rules.votes(F.col("m"))).alias("v")).collect():
        votes[r.doc_id] = tuple(r.v)
        patterns[tuple(r.v)] += 1
    posterior = rules.fit(sorted(patterns.items()))
    for r in rows:
        w = re.findall(WORD, texts[r.doc_id] or "")
        seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert (r.n_words, r.n_repeat_words, r.base_failed) == (len(w), len(covered), failed)
        assert r.kept == (not failed and posterior[votes[r.doc_id]] >= rules.KEEP)
    kept = {r.doc_id: r.kept for r in rows}
    assert all(kept[1000 + i] == (i % 8 != 0) for i in range(160))  # junk that passes the base rules goes by the verdict


def test_op4_long_words_and_the_bound_of_the_trie():
    scores, longest, byte = tokencount.vocabulary()

    def plain(word):
        text = tokencount.MARK + word
        best = [(0.0, 0)]
        for end in range(1, len(text) + 1):
            options = [(best[b][0] + scores[text[b:end]], -b, best[b][1] + 1) for b in range(max(0, end - longest), end) if text[b:end] in scores]
            if text[end - 1] not in scores:
                n = len(text[end - 1].encode())
                options.append((best[end - 1][0] + n * byte, -end, best[end - 1][1] + n))
            most = max(o[0] for o in options)
            best.append(next((o[0], o[2]) for o in sorted(options, key=lambda o: -o[1]) if o[0] == most))  # on a tie the longest last piece
        return best[-1][1]

    rng = np.random.default_rng(6)
    trie = tokencount.CountTrie(max_nodes=500)
    for n in (63, 64, 65, 700, 4000):
        word = "".join(rng.choice(list("abcdeinrst"), n))
        assert trie[word.encode()] == plain(word)
        assert len(trie.best) <= 500 + tokencount.LONG + 1
    assert trie[("ü本" * 300).encode()] == plain("ü本" * 300)


def test_recall_with_many_cells(spark):
    rng = np.random.default_rng(9)
    v = rng.standard_normal((31_000, 24))
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)
    got = defaultdict(set)
    asked = frame.filter("vec_id % 100 = 0")
    for r in neighbours.search(frame, asked).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, len(v), 100):
        score = v @ v[q]
        score[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-score, kind="stable")[:20].tolist()))
    assert hits / (20 * len(got)) >= 0.9
    near = rng.standard_normal((64, 24))
    clustered = near[rng.integers(0, 64, 20_000)] + 0.2 * rng.standard_normal((20_000, 24))
    index = neighbours.Index(clustered, 64)
    assert index.probes(clustered, 20) < 32  # where there is structure, a query leaves most cells alone


def test_rows_without_an_id(spark):
    text = " ".join(f"t{i}" for i in range(80))
    frame = spark.createDataFrame([(5, text), (None, text), (None, text), (7, text + " more"), (9, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in ngram_join.ngram_components(frame, 4, 85).collect()), key=repr)
    assert got == sorted([(5, 77, 5), (None, 77, None), (None, 77, None), (7, 78, 5), (9, 0, 9)], key=repr)
    assert sorted((r.doc_id or 0) for r in ngram_join.keep_one(frame, 4, 85).collect()) == [0, 0, 5, 9]
    spans = suffix.repeated_spans(frame, Workspace(spark, "t"))
    assert [r.doc_id for r in spans.collect()] == [7]


def test_pipeline_stages_against_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    model = crf.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    good = {r.doc_id for r in crf.score(docs, model).collect() if r.score >= crf.THRESHOLD}
    kept = Workspace(spark, "t").write(corpus_pipeline.quality(spark, docs, folder), "a")
    assert kept.columns == names and {r.doc_id for r in kept.collect()} == good and good

    sets, up = {}, {}
    for r in kept.collect():
        w = re.findall(WORD, (r.text or "").lower())
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        up[r.doc_id] = r.doc_id
    find = lambda x: x if up[x] == x else find(up[x])
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]) and find(a) != find(b):
                up[max(find(a), find(b))] = min(find(a), find(b))
    single = Workspace(spark, "t").write(corpus_pipeline.near_copies(spark, kept, folder), "b")
    assert single.columns == names and sorted(r.doc_id for r in single.collect()) == sorted(d for d in sets if find(d) == d)

    before = sorted((r.doc_id, (r.text or "").encode()) for r in single.collect())
    want = {d: n - gone for d, n, gone, _, _ in plain_spans(before, 100)}
    cut = Workspace(spark, "t").write(corpus_pipeline.repeats(spark, single, folder), "c")
    sizes = {r.doc_id: len((r.text or "").encode()) for r in cut.collect()}
    assert cut.columns == names
    for d, n in before:
        if want[d] or not n:
            assert 0 <= sizes[d] - want[d] <= 6 * 20  # cuts shrink to whole characters
        else:
            assert d not in sizes

    plan = {r.doc_id: r.copies for r in corpus_pipeline.mixing.mixing_plan(cut).collect()}
    mixed = Workspace(spark, "t").write(corpus_pipeline.mixture(spark, cut, folder), "d")
    assert mixed.columns == names and Counter(r.doc_id for r in mixed.collect()) == Counter({d: n for d, n in plan.items() if n})
    pieces = corpus_pipeline.sequences(spark, mixed, folder).collect()
    tokens = {r.doc_id: r.doc_tokens for r in pieces}
    assert sum(r.length for r in pieces) == sum(tokens[d] * n for d, n in plan.items() if n)
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in pieces)
