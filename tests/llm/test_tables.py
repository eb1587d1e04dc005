"""WARC, mixing, top-k and the pipeline, on edge cases and against plain versions; every query against its SQL."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import compare, connect
from treespark.llm import exact_dedup, mixing, pieces, queries, simhash, topk, toxicity, warc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    if name == "op1_substring_dedup":
        assert queries.QUERIES[name](spark, SF).count() > 0
    else:
        assert compare(spark, con, queries.QUERIES[name], queries.ORACLES.get(name), SF) == ""


def test_warc_round_trip(spark):
    long = "é" * 700
    rows = [
        (1, "http://a/x y", "<p>small</p>"), (2, None, "<p>small</p>"), (3, "http://b", None), (4, "u", ""), (5, "u", long), (6, "u", long),
        (9, "u\r\nWARC-Type: x", long), (9, "u", long), (None, "u", long), (7, "u", "x" * 2_000_000), (8, "u", "\r\n\r\n" * 400), (10, "u", "a" * 999), (11, "u", "a" * 999)]
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, payload_digest string, copies int")
    got = warc.round_trip(pages, with_payload=True).collect()
    assert len(got) == len(rows) and all(r.verified for r in got)
    want = sorted(((i, len((t or "").encode()), "revisit" if t == long and i != 9 else "response", 9 if t == long and i != 9 else None)
                   for i, _, t in rows), key=str)
    assert sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=str) == want
    texts = {i: t or "" for i, _, t in rows}
    assert all(bytes(r.payload).decode() == texts[r.page_id] for r in got if r.record_type == "response")
    assert warc.round_trip(pages.where("false")).count() == 0


def test_damaged_archives():
    record = warc.record_of(1, "u", b"hello" * 100, 500, "00" * 20, None)
    assert [r[6] for r in warc.records(memoryview(record * 2), False)] == [False, False]  # the stated digest is wrong
    with pytest.raises(ValueError):
        list(warc.records(memoryview(record[:-30]), False))
    assert list(warc.records(memoryview(b""), False)) == []


def plain_mix(rows, weights, budget, seed=42):
    """Draws (doc_id, source, epoch, start) for given weights."""
    import hashlib

    out = []
    for source, weight in weights.items():
        own = [(i, n) for s, i, n in rows if s == source]
        tokens, quota = sum(n for _, n in own), int(np.floor(budget * weight + 0.5))
        for epoch in range(-(-quota // tokens)):
            place = lambda i: int(hashlib.md5(f"{seed}:{epoch}:{source}:{i}".encode()).hexdigest()[:15], 16)
            start = epoch * tokens
            for i, n in sorted(own, key=lambda x: (place(x[0]), x)):
                if epoch < quota // tokens or start < quota:
                    out.append((i, source, epoch, start))
                start += n
    return sorted(out)


@pytest.mark.parametrize("settings", [{"max_repeat": 2.0}, {"target_entropy": 1.5}, {"max_repeat": 3.0, "budget": 5000}])
def test_mixing(docs, settings):
    rng = random.Random(1)
    sources = ["big"] * 700 + ["mid"] * 150 + ["small"] * 60 + ["tiny"] * 20
    rows = [(i, " ".join(["w"] * rng.randint(1, 20))) for i in range(len(sources))]
    made = docs(*rows, (5000, None), sources=[*sources, "big"])
    got = mixing.mix(made, **settings)
    weights = {r.source: r.weight for r in got.select("source", "weight").distinct().collect()}
    tokens = {s: sum(len(t.split()) for (_, t), x in zip(rows, sources) if x == s) for s in set(sources)}
    total = sum(tokens.values())
    assert abs(sum(weights.values()) - 1) < 1e-9
    x = np.log(weights["big"] / weights["mid"]) / np.log(tokens["big"] / tokens["mid"])
    assert np.isclose(weights["tiny"] / weights["big"], (tokens["tiny"] / tokens["big"]) ** x)
    budget = settings.get("budget") or max(tokens[s] / weights[s] for s in tokens)
    repeats = max(budget * weights[s] / tokens[s] for s in tokens)
    if "target_entropy" in settings:
        assert abs(-sum(w * np.log2(w) for w in weights.values()) - 1.5) < 1e-4
    else:
        assert repeats <= settings["max_repeat"] + 1e-4 and (x < 1e-6 or repeats > settings["max_repeat"] - 1e-3)
    flat = [(s, i, len(t.split())) for (i, t), s in zip(rows, sources)] + [("big", 5000, 0)]
    assert sorted((r.doc_id, r.source, r.epoch, r.start) for r in got.collect()) == plain_mix(flat, weights, budget)
    assert got.agg(F.max("block")).first()[0] <= budget / mixing.BLOCK_TOKENS + 1 and total > 0


def test_mixing_edges(docs):
    made = docs((1, "a b"), (1, "a b"), (2, ""), (3, None), (None, "c"), sources=["x", "x", "x", None, "y"])
    mixed = mixing.mixed(made, max_repeat=2.0)
    assert mixed.columns == made.columns and {r.doc_id for r in mixed.collect()} == {1, 2, 3, None}
    assert mixed.where("doc_id = 1").count() == 2
    assert mixing.mix(made.where("false")).count() == 0 and mixing.mix(made.where("doc_id in (2, 3)")).count() == 2


@pytest.mark.parametrize("scale", [1.0, 1e4])
def test_top_k(spark, scale):
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(700, 16)) * scale).astype(np.float32)
    x[100:400] = x[50]
    rows = [(i, v.tolist(), 0, "s") for i, v in enumerate(x)]
    rows += [(1000, None, 0, "s"), (1001, [None] * 16, 0, "s"), (1002, [float("nan")] * 16, 0, "s"), (None, [0.0] * 16, 0, "s"), (1100, [1.0, 2.0], 0, "s"), (1200, [], 0, "s"), (0, rows[0][1], 0, "s")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int, slot string")
    got = {}
    for r in topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    y = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    for q in range(0, 700, 50):
        scores = sorted((-int(y[q] @ y[i]), i) for i in [*range(700), 0] if i != q)
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores[:10])]
    assert set(got) == set(range(0, 700, 50))
    assert topk.top_k(vectors.where("false"), vectors, 10).count() == 0


def test_scores_beyond_64_bits_are_an_error(spark):
    vectors = spark.createDataFrame([(0, [1e30, 1.0]), (1, [3.0, 3.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="do not fit 64 bits"):
        topk.top_k(vectors, vectors).collect()


def test_repeated_rows_share_draws(spark):
    rows = [(1, "a b c", "en", "s", None)] * 5 + [(k, "d e f g", "en", "t", None) for k in range(2, 9)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for budget in (20.0, 33.0, 47.0):
        times = {r.doc_id: r.n for r in mixing.mix(made, budget=budget).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
        got = {r.doc_id: r.n for r in mixing.mixed(made, budget=budget).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
        assert got == times


def test_blocks_are_cut_and_joined(spark, monkeypatch):
    rng = np.random.default_rng(3)
    ids, x = np.arange(500), rng.integers(-500, 500, (500, 8))
    whole = sorted(topk.best_of_block(ids, x, ids[:20], x[:20], 5))
    parts = [t for k in range(0, 500, 100) for t in topk.best_of_block(ids[k : k + 100], x[k : k + 100], ids[:20], x[:20], 5)]
    best = sorted(t for q in range(20) for t in sorted((t for t in parts if t[0] == q), key=lambda t: (-t[2], t[1]))[:5])
    assert whole == best


def five_words(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "sentencepiece":
            assert out.columns == columns and dict(out.dtypes) == dict(docs.dtypes)
            out = exact_dedup.stored(out)
        rows[name] = (docs, out)
        docs = out
    before, after = rows["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rejected = {r.doc_id for r in toxicity.toxicity(before, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - rejected
    before, after = rows["exact_dedup"]
    lowest = {}
    for r in before.collect():
        lowest[r.text.lower()] = min(r.doc_id, lowest.get(r.text.lower(), r.doc_id))
    assert sorted(r.doc_id for r in after.collect()) == sorted(lowest.values())
    before, after = rows["simhash_near_dedup"]
    grams = {r.doc_id: five_words(r.text) for r in before.collect()}
    group = {i: i for i in grams}
    for i in sorted(grams):  # the smallest id that links at 0.8 reach, by brute force
        todo = [i] if group[i] == i else []
        while todo:
            a = todo.pop()
            near = [b for b in grams if b > i and group[b] == b and 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b])]
            group |= dict.fromkeys(near, i)
            todo += near
    assert {r.doc_id for r in after.collect()} == set(group.values())
    before, after = rows["mixing"]
    times = {r.doc_id: r.n for r in mixing.mix(before).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert {r.doc_id: r.n for r in after.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == times
    assert set(times) == {r.doc_id for r in before.collect()} and max(times.values()) <= 2
    before, after = rows["sentencepiece"]
    assert after.count() == before.count() and after.where("not round_trip").count() == 0 and stages
    assert pieces.decode_rows(after).join(before.select("doc_id", F.col("text").alias("t")).distinct(), "doc_id").where("t <> text").count() == 0
