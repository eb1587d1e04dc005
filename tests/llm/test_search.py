"""Merkle manifest, ranked lexical search and embedding near-dedup, on edge cases and against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import connect
from treespark.llm import lexical, merkle, queries, topk, vectors
from treespark.llm.merkle import Parent

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, pos int, root string, tree string, path string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        out.append(nodes)
    return out


def plain_walk(levels, at, value):
    beside = ""
    for nodes in levels[:-1]:
        low = at // 16 * 16
        run = nodes[low : low + 16]
        beside += "".join(run[: at - low] + run[at - low + 1 :])
        run = run[: at - low] + [value] + run[at - low + 1 :]
        value, at = sha("".join(run)), at // 16
    return beside, value


def plain_manifest(rows, replaced):
    """rows: (doc_id, text, lang, source, n_chars); replaced: the text that stands in for a row's, or the same."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    sources = defaultdict(list)
    for i, text, lang, source, n in rows:
        leaf = lambda t: sha("".join(map(field, (i, source, lang, n, t))))  # noqa: B023, E731
        sources[source].append(((i is not None, i or 0), leaf(text), leaf(replaced(i, text)), i))
    trees = {s: plain_levels([x[1] for x in sorted(v)]) for s, v in sources.items()}
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    top = plain_levels([trees[s][-1][0] for s in names])
    out = []
    for source, leaves in sources.items():
        for at, (_, leaf, other, i) in enumerate(sorted(leaves)):
            low, value = plain_walk(trees[source], at, other)
            high, value = plain_walk(top, names.index(source), value)
            out.append((i, leaf, trees[source][-1][0], top[-1][0], sha(low + high), value, value == top[-1][0]))
    return out


def test_parent_folds_from_kept_states():
    children = [sha(str(k)) for k in range(16)]
    parent = Parent(children)
    assert parent.digest == sha("".join(children))
    for slot in range(16):
        assert parent.fold(slot, sha("x")) == sha("".join(children[:slot] + [sha("x")] + children[slot + 1 :]))
        assert parent.fold(slot, children[slot]) == parent.digest
    assert Parent(children[:1]).digest == sha(children[0])


@pytest.mark.parametrize("sizes", [(1,), (1, 1), (16, 17), (257, 1, 2), (3,) * 20])
def test_manifest(spark, sizes):
    import zlib

    rng = random.Random(sum(sizes))
    rows = []
    for k, size in enumerate(sizes):
        source = None if k == 1 else f"s{k}é"
        for _ in range(size):
            rows.append((rng.randrange(10**6), rng.choice([None, "", "ÀB c", "Plain TEXT\n" * 3, "x"]), rng.choice([None, "en"]), source, rng.choice([None, 7])))
    rows += [rows[0], (None, "Null Id", None, "s0é", None), (5, "Y" * 300_000, "-", "", -3)]
    frame = spark.createDataFrame([(*r, "l", 1, "r", "t", "p") for r in rows], DOCS).repartition(5)
    lowered = lambda i, t: re.sub("[A-Z]+", lambda m: m[0].lower(), t) if t is not None and i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else t
    got = [tuple(r) for r in merkle.lowered_text_manifest(frame).collect()]
    assert Counter(got) == Counter(plain_manifest(rows, lowered))
    assert all(r[-1] for r in map(tuple, merkle.manifest(frame).collect()))


def test_manifest_without_rows(spark):
    assert merkle.lowered_text_manifest(spark.createDataFrame([], DOCS)).collect() == []


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k=20):
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    held = [(i, c, c.total()) for i, c in held if c]
    total = sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c, n in held:
            norm = 75 + 25 * n * len(held) // total
            score = sum(
                math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * norm))
                for t in plain_terms(text) if c[t])
            if score > 0 and i is not None:
                scores.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)] if item is not None else []
    return sorted(out)


def test_search(spark, monkeypatch):
    rng = random.Random(1)
    words = [f"w{int(rng.paretovariate(0.5)) % 300}" for _ in range(3000)] + ["É", "naïve", "X9"]
    docs = [(i, rng.choice([" ", "\n", "--", "\x00"]).join(rng.choices(words, k=rng.choice([1, 3, 30, 300])))) for i in range(700)]
    docs += [(3, docs[3][1]), (None, "w1 w2 É"), (800, None), (801, ""), (802, "?! ..."), (803, "w1 " * 500_000), *[(900 + i, "same twin") for i in range(40)]]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 12, 60])))) for i in range(25)]
    items += [(1, items[1][1]), (30, None), (31, ""), (32, "nowhere"), (33, "TWIN same Same"), (None, "w1"), (34, "w1 w1 w1")]
    frame = spark.createDataFrame([(*d, "q", 1, 2) for d in docs], "doc_id long, text string, query string, score int, rank int").repartition(3)
    asked = spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, size int")
    want = plain_search(docs, items)
    got = lexical.search(frame, asked)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert sorted(map(tuple, got.collect())) == want
    for name, value in (("DOCS", 50), ("POSTINGS", 500), ("WINDOW", 7), ("SHORT", 0.5)):
        monkeypatch.setattr(lexical, name, value)
    monkeypatch.setattr(lexical, "TERMS", 200)  # several passes, in the driver
    assert sorted(map(tuple, lexical.search(frame, asked).collect())) == want


def test_search_blocks():
    """The hybrid against plain sums, over many block shapes, in one process."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        n, terms = int(rng.integers(1, 400)), 12
        tfs = rng.geometric(0.6, (terms, n)) * (rng.random((terms, n)) < rng.random((terms, 1)) ** 2)
        lengths = tfs.sum(axis=0) + rng.integers(1, 50, n)
        held = [np.flatnonzero(t) for t in tfs]
        row = {
            "ids": rng.permutation(n).astype("<i8").tobytes(), "lengths": lengths.astype("<i8").tobytes(), "terms": list(range(terms)),
            "counts": [len(h) for h in held], "places": np.concatenate(held).astype("<i4").tobytes(),
            "tfs": np.concatenate([t[h] for t, h in zip(tfs, held)]).astype("<i8").tobytes()}
        block = lexical.Block(row, n, int(lengths.sum()))
        weights = [(t, int(rng.integers(0, 3000))) for t in range(terms)]
        norms = 75 + 25 * lengths * n // int(lengths.sum())
        scores = sum(w * (10**9 * tfs[t] // (1000 * tfs[t] + 12 * norms)) for t, w in weights)
        ids = np.frombuffer(row["ids"], "<i8")
        want = sorted((-int(s), int(i)) for s, i in zip(scores, ids) if s > 0)[:5]
        best = lexical.Best(5)
        block.search(weights, best)
        assert [(-int(s), int(i)) for s, i in zip(best.scores, best.ids)] == want


def test_search_without_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(docs, items).collect() == []
    assert lexical.search(items.toDF("doc_id", "text"), items.where("false")).collect() == []
    assert lexical.search(docs.unionByName(spark.createDataFrame([(1, "...")], docs.schema)), items).collect() == []


def plain_near(rows, threshold=0.95):
    def usable(x):
        return x is not None and all(y is not None and math.isfinite(y) for y in x) and any(x)

    units = [np.array(x, float) / np.linalg.norm(x) if usable(x) else None for _, x in rows]
    near = [[k for k, v in enumerate(units) if k != j and u is not None and v is not None and len(u) == len(v) and u @ v >= threshold] for j, u in enumerate(units)]
    out = []
    for j, (i, _) in enumerate(rows):
        seen, todo = {j}, [j]
        while todo:
            for k in near[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        names = [rows[k][0] for k in seen if rows[k][0] is not None]
        low = min(names) if names else None
        out.append((i, len(near[j]), low, i is not None and i == low))
    return Counter(out)


def clustered(rng, count, dim=24, size=40):
    """Vectors in clusters whose members lie on both sides of the threshold, with copies."""
    rows = []
    while len(rows) < count:
        centre = rng.standard_normal(dim)
        for _ in range(int(rng.integers(1, size))):
            rows.append((centre + rng.standard_normal(dim) * rng.choice([0.1, 0.2, 0.3])).tolist())
    rows += [rows[k] for k in rng.integers(0, len(rows), count // 10)] + [rows[0]] * 200
    return rows


EMBEDDINGS = "vec_id long, embedding array<double>, v int, class string, n int, size int"


@pytest.mark.parametrize("part, small", [(2048, 12), (16, 4)])
def test_near_vectors(spark, monkeypatch, part, small):
    monkeypatch.setattr(vectors, "PART", part)
    monkeypatch.setattr(vectors, "RECALL", 1 - 1e-6)
    if small != 12:
        monkeypatch.setattr(vectors, "plan", lambda n, threshold: (4, 40))  # few signs: large buckets, dealt into parts
    rng = np.random.default_rng(part)
    rows = [(int(i), x) for i, x in zip(rng.permutation(5000), clustered(rng, 600))]
    odd = [None, [], [0.0] * 24, [math.nan] * 24, [math.inf] + [1.0] * 23, [None] + [1.0] * 23, [1.0, 2.0], [1.0, 2.001], [1e300] * 24, [1e-310] * 24]
    rows += [(6000 + k, x) for k, x in enumerate(odd)] + [(None, rows[0][1]), (None, None), (None, [5.0]), (rows[3][0], rows[9][1]), (7000, [5.0])]
    frame = spark.createDataFrame([(*r, 1, "c", 2, 3) for r in rows], EMBEDDINGS).repartition(4)
    got = vectors.near_dedup(frame)
    assert dict(got.dtypes) == {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"}
    want = plain_near([(i, x if x != [1e300] * 24 and x != [1e-310] * 24 else [1.0] * 24) for i, x in rows])
    assert Counter(map(tuple, got.collect())) == want


def test_near_vectors_without_rows(spark):
    assert vectors.near_dedup(spark.createDataFrame([], EMBEDDINGS)).collect() == []
    assert [tuple(r) for r in vectors.near_dedup(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect()] == [(1, 0, 1, True)]


def test_plan_keeps_its_recall():
    for count in (10, 10**4, 10**9):
        bits, tables = vectors.plan(count)
        meet = (1 - math.acos(0.95) / math.pi) ** bits
        assert 2**bits > count and 1 - (1 - meet) ** tables >= vectors.RECALL


def test_queries_read_whole_tables(spark):
    """Every new query against brute force or counts on the smallest tables; their SQL is compared in test_tables."""
    sf = "/root/testdata/sf0.001"
    rows = connect(sf).execute("SELECT doc_id, text FROM documents").fetchall()
    items = connect(sf).execute("SELECT item_id, text FROM benchmark").fetchall()
    assert sorted(map(tuple, queries.QUERIES["op12_lexical_search"](spark, sf).collect())) == plain_search(rows, items)
    assert queries.QUERIES["op13_embedding_dedup"](spark, sf).where(F.col("component_id") > F.col("vec_id")).count() == 0


def test_copied_query_blocks_are_not_broadcast(spark, monkeypatch):
    """Query blocks are copied for every slot, which no estimate of their table counts; several blocks may share a slot."""
    monkeypatch.setattr(topk, "SLOTS", 2)
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(7).cache()
    asked = df.where("vec_id % 10 = 0")
    found = topk.top_k(df, asked, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Broadcast" not in plan
    whole = {r.vec_id: [math.floor(1024 * x) for x in r.embedding] for r in df.collect()}
    for q in range(0, 60, 10):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:3]
        assert [(r.rank, -r.score, r.vec_id) for r in sorted(found.where(f"query_id = {q}").collect())] == [(k, s, i) for k, (s, i) in enumerate(best, 1)]
