"""Each operator against a plain version on small fixtures that hold nulls, empty and very long texts, ties and repeats."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import crf, mixing, neighbours, ngram_join, packing, rules, sharding, suffix, tokencount, toxicity
from quire.llm.common import Workspace

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, target double, shard int, _row string"


def corpus():
    rng = np.random.default_rng(3)
    words = [f"w{i}x" for i in range(300)]
    prose = lambda n: " ".join(rng.choice(words, n))
    base = prose(120)
    near = base.split()
    near[60] = "other"
    passage = prose(40)
    texts = [
        base, base, " ".join(near), None, "", "  \n\t ", "one", "two words", passage, prose(80) + " " + passage + " " + prose(50),
        passage + "\n" + passage, "a" * 1000, prose(6000), "é" * 150 + prose(30) + "é" * 150, "!!! ### " * 40, base, "x y z " * 60,
    ] + [prose(int(n)) for n in rng.integers(5, 200, 25)]
    rows = [(i, t, "en", [None, "b", "a", "hot"][i % 4 if i < 12 else 3], len(t or ""), 7, 1.0, 0, "clash") for i, t in enumerate(texts)]
    return rows + [rows[0]]  # a repeated row


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mixing(docs, none):
    plan = mixing.mixing_plan(docs).collect()
    sizes = {r.doc_id: len(re.findall(WORD, r.text or "")) for r in docs.collect()}
    by = {}
    for r in plan:
        assert r["size"] == sizes[r.doc_id] and 0 <= r.copies <= 2 and (r["size"] or not r.copies)
        by.setdefault(r.source, [r.source_size, r.target, 0])[2] += r["size"]
    names = sorted((s for s in by if s is not None)) + [None]
    weight = {s: [5, 2, 1][i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(x[0] for x in by.values()), set(by), {}
    while True:  # reshare what is above a cap until none is
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * by[s][0]}
        if not full:
            break
        target |= {s: 2.0 * by[s][0] for s in full}
        left -= sum(2.0 * by[s][0] for s in full)
        open_ -= full
    target |= share
    for s, (size, t, total) in by.items():
        assert size == total and t == pytest.approx(target[s])
    assert sorted(mixing.mix(docs).columns) == sorted(docs.columns)
    assert mixing.mix(docs).count() == sum(r.copies for r in plan)
    assert mixing.mixing_plan(none).count() == 0


def test_sharding(docs, none, spark):
    rows = sharding.shard(docs, shards=4).collect()
    assert len(rows) == docs.count()
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    even = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("t"), (F.col("id") % 97).cast("int")).alias("text"))
    got = {r.shard: r.b for r in sharding.shard(even, shards=8).groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    assert len(got) == 8 and max(got.values()) < 1.1 * min(got.values())
    copies = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text"))
    got = [r["count"] for r in sharding.shard(copies, shards=8).groupBy("shard").count().collect()]
    assert len(got) == 8 and max(got) < 1.3 * min(got)
    assert sharding.shard(none, shards=8).count() == 0


def test_rules(docs, none):
    for r in rules.measures(docs.select("doc_id", "text")).collect():
        t = r.text or ""
        w = re.findall(WORD, t)
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
        m = r.m
        assert (m.n_words, m.word_chars, m.n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
        assert (m.n_symbols, m["lines"]["dup"]) == (sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)))
    judged = {r.doc_id: r.posterior for r in rules.judge(docs).collect()}
    assert judged[12] > 0.5 > judged[14]
    assert rules.judge(none).count() == 0


def test_rules_fit_recovers_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(4000) < 0.8
    votes = np.array([np.where(rng.random(4000) < 0.9, np.where(good, 1, -1), np.where(good, -1, 1)) for _ in range(5)]).T
    posterior = rules.fit(sorted(Counter(map(tuple, votes.tolist())).items()))
    assert np.mean([(posterior[tuple(v)] >= 0.5) == g for v, g in zip(votes.tolist(), good)]) > 0.98


def test_packing(docs, none):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = packing.pack(docs).collect()
    for d in docs.dropDuplicates(["doc_id"]).collect():
        ids = np.array(plain.encode(d.text or "", add_special_tokens=False).ids + [1], "<u4")
        own = sorted({(r.start, r.length, r.ids_crc32, r.doc_tokens, bytes(r.ids)) for r in rows if r.doc_id == d.doc_id})
        assert own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:])) and own[-1][0] + own[-1][1] == len(ids)
        for start, length, crc, total, raw in own:
            assert raw == ids[start : start + length].tobytes() and crc == zlib.crc32(raw) and total == len(ids)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and sum(n for _, n in pieces) <= 2048
    assert packing.pack(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.just("<|endoftext|>")), max_size=6).map("".join))
def test_token_ids_equal_the_tokenizer(text):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert packing.token_ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids + [1]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 2047))
def test_cuts_fill_classes(n):
    parts = packing.cuts(n)
    assert sum(parts) == n and all(packing.CAPACITY // packing.class_of(p) - p <= packing.SLACK for p in parts)


def test_token_counts(docs, none):
    scores, longest, byte = tokencount.vocabulary()

    def plain(word):
        text = "▁" + word
        best = [(0.0, 0)] + [None] * len(text)
        for end in range(1, len(text) + 1):
            options = [(best[b][0] + scores[text[b:end]], -b, best[b][1] + 1) for b in range(max(0, end - longest), end) if text[b:end] in scores]
            if text[end - 1] not in scores:
                n = len(text[end - 1].encode())
                options.append((best[end - 1][0] + n * byte, -end, best[end - 1][1] + n))
            top = max(o[0] for o in options)
            best[end] = next((o[0], o[2]) for o in sorted(options, key=lambda o: -o[1]) if o[0] == top)
        return best[-1][1]

    for r in tokencount.count_tokens(docs.limit(30)).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        words = re.findall(WORD, r.text or "")
        assert r.n_words == len(words) and r.n_tokens == sum(map(plain, words))
    small = tokencount.CountTrie(max_nodes=50)
    large = tokencount.CountTrie()
    assert all(small[w] == large[w] for w in (f"word{i}".encode() for i in range(300)))
    assert tokencount.count_tokens(none).count() == 0


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_ngram_join(docs, none, spark, k, percent, monkeypatch):
    rng = np.random.default_rng(5)
    words = rng.choice([f"v{i}" for i in range(400)], 150)
    near = []
    for i in range(60):  # a group of near copies, in which links chain
        w = words.copy()
        w[(2 * i) % 150 : (2 * i) % 150 + 4] = f"n{i}"
        near.append((1000 + i, " ".join(w)))
    frame = docs.select("doc_id", "text").distinct().union(spark.createDataFrame(near, "doc_id long, text string")).cache()
    sets, up = {}, {}
    for r in frame.collect():
        w = re.findall(WORD, (r.text or "").lower())
        sets[r.doc_id] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
        up[r.doc_id] = r.doc_id
    find = lambda x: x if up[x] == x else find(up[x])
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]) and find(a) != find(b):
                up[max(find(a), find(b))] = min(find(a), find(b))
    for block in (ngram_join.BLOCK, 7):  # the second deals the group over many tasks
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(frame, k, percent).collect()}
        assert got == {d: (len(s), find(d)) for d, s in sets.items()}
    assert ngram_join.ngram_components(none, k, percent).count() == 0
    kept = ngram_join.keep_one(docs, k, percent)
    assert kept.columns == docs.columns and kept.count() == kept.select("doc_id").distinct().count()


def plain_spans(texts, length):
    first = {}
    for i, t in texts:
        for p in range(len(t) - length + 1):
            first.setdefault(t[p : p + length], (i, p))
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] != (i, p):
                gone[p : p + length] = b"\x01" * length
        yield i, len(t), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()


def test_suffix_dedup(docs, none, monkeypatch):
    texts = [(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").distinct().orderBy("doc_id").collect()]
    want = list(plain_spans(texts, 100))
    for chunk, shard, block, hot in ((suffix.CHUNK, suffix.SHARD, suffix.BLOCK, suffix.HOT), (3000, 200, 900, suffix.HOT), (3000, 200, 900, 2)):
        monkeypatch.setattr(suffix, "HOT", hot)
        monkeypatch.setattr(suffix, "OFTEN", 1 if hot == 2 else suffix.OFTEN)
        monkeypatch.setattr(suffix, "CHUNK", chunk)
        monkeypatch.setattr(suffix, "SHARD", shard)
        monkeypatch.setattr(suffix, "BLOCK", block)
        frame = docs.select("doc_id", "text")
        spans = suffix.repeated_spans(frame, Workspace(docs.sparkSession, "t"))
        got = suffix._with_spans(frame, spans).mapInArrow(suffix._reporter, "doc_id long, n_bytes long, n_removed long, n_spans long, sha string").distinct().collect()
        assert sorted(map(tuple, got)) == want
    cut = suffix.remove_repeats(docs)
    assert cut.columns == docs.columns and {r.doc_id for r in cut.filter("text IS NULL").collect()} == {3}
    assert suffix.remove_repeats(none).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(x % 3 + 97 for x in b)), min_size=1, max_size=12), st.integers(1, 12))
def test_merged_transforms_find_common_prefixes(texts, length):
    n = len(texts)
    old, suffix.SHARD = suffix.SHARD, 30
    try:
        doc, start, end = suffix.later_strings(texts, np.arange(n), np.zeros(n, np.int64), length)
    finally:
        suffix.SHARD = old
    got = [bytearray(len(t)) for t in texts]
    for d, s, e in zip(doc, start, end):
        got[d][s:e] = b"\x01" * (e - s)
    assert [sum(g) for g in got] == [x[2] for x in plain_spans(list(enumerate(texts)), length)]


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((400, 16))
    v[100:200] = v[7]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(500, None), (520, [0.0] * 16), (540, [float("nan")] * 16), (560, [1.0] * 3), (580, [None] * 16), (None, [1.0] * 16)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit("clash"))
    got = {}
    for r in neighbours.search(frame, frame.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q in range(0, 400, 20):
        score = [sum(a * b for a, b in zip(v[q].tolist(), x.tolist())) for x in v]
        want = sorted((i for i in range(400) if i != q), key=lambda i: (-score[i], i))[:20]
        assert [i for _, i in sorted(got[q])] == want
    assert len(got) == 20
    assert neighbours.search(frame.limit(0), frame.limit(0)).count() == 0


LABELS = [("fine words in a calm line of text that goes on for long enough " * 3 + f"{i}", 1, 0) for i in range(120)] + [
    ("BUY!! NOW!! | " * 30 + f"\nSALE!! {i}", 0, 0) for i in range(60)
] + [(f"some plain words blockhead and more {i} plain numbskull words " * 2, 1, 1) for i in range(60)]


def test_trained_operators(spark, docs, none):
    frame = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(LABELS)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, x) for i, (_, q, x) in enumerate(LABELS)], "doc_id long, quality int, toxic int")
    good = {r.doc_id: r.score for r in crf.score(frame, crf.fit(frame, labels)).collect()}
    assert all((good[i] >= 0.7) == (q == 1) for i, (_, q, _) in enumerate(LABELS))
    bad = {r.doc_id: r.score for r in toxicity.score(frame, toxicity.fit(frame, labels)).collect()}
    assert all((bad[i] >= 0.3) == (x == 1) for i, (_, _, x) in enumerate(LABELS))
    for module in (crf, toxicity):
        assert module.score(docs, module.fit(frame, labels.limit(0))).filter("score = 0.5").count() == docs.count()
        scores = module.score(docs, module.fit(frame, labels))
        assert scores.filter("score between 0 and 1").count() == docs.count()
        assert module.score(none, module.fit(none, labels)).count() == 0
    assert crf.keep_good(docs, crf.fit(frame, labels)).columns == docs.columns


def test_chain_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    c = crf.chains([b"a\nb c\n\nd!", b"x", b"LONG LINE | |\nz"])
    emission, a = rng.standard_normal(len(c.x)), rng.standard_normal((2, 2))
    odds, _, total = crf.forward_backward(c, emission, a)
    for first, n, z in zip(c.first, c.size, total):
        mass, good = 0.0, np.zeros(n)
        for path in np.ndindex(*[2] * n):
            s = np.exp(sum(emission[first + t] * y for t, y in enumerate(path)) + sum(a[p, q] for p, q in zip(path, path[1:])))
            mass += s
            good += s * np.array(path)
        assert np.log(mass) == pytest.approx(z)
        assert np.log(good / (mass - good)) == pytest.approx(odds[first : first + n])


def test_pipeline_stages_keep_the_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    count = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        docs = Workspace(spark, "t").write(out, "t")
        assert 0 < docs.count() <= 2 * count
    pieces = corpus_pipeline.sequences(spark, docs, "")
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
