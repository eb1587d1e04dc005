"""Steps that store, move or compute little: the same rows, and how they are made."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from treespark import session
from treespark.functions import lookup, numbering
from treespark.llm import substrings
from treespark.operators import assemble, attention, batching, scoring, trees, vocabulary
from treespark.plans import derived
from treespark.plans.catalogue import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def paths(rows):
    """(sent_id, id, anc, dist) by following the arcs one by one; repeated arcs give repeated paths."""
    out = [(s, i, i, 0) for s, i, _ in rows]
    last = out
    while last:
        known = {(s, i) for s, i, _ in rows if s is not None}
        last = [(s, i, h, d + 1) for s, i, a, d in last for t, b, h in rows if (t, b) == (s, a) and h and (s, h) in known]
        out = out + last
    return Counter(out)


def test_paths_of_short_sentences_are_not_stored(spark, monkeypatch):
    """Whole sentences stay in the task; long ones, ids that repeat or lack one, and heads outside go by joins."""
    rng = random.Random(3)
    trees_of = {s: [0] + [rng.randint(1, w) for w in range(1, n)] for s, n in enumerate([1, 3, 4, 4, 9, 2])}
    rows = [(s, i, h) for s, heads in trees_of.items() for i, h in enumerate(heads, 1)]
    rows += [(10, 2, 0), (10, 3, 2), (11, 1, 0), (11, 2, 9), (12, 1, None), (None, 1, 0), (None, 2, 1)]
    stored = []
    keep = trees.cut_lineage
    monkeypatch.setattr(trees, "cut_lineage", lambda df: stored.append(kept := keep(df)) or kept)
    arcs = spark.createDataFrame(rows, "sent_id bigint, id int, head int")
    assert Counter(tuple(r) for r in trees.closure_by_joins(arcs, short=4).collect()) == paths(rows)
    twice = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 2, 1)], "sent_id bigint, id int, head int")
    assert Counter(tuple(r) for r in trees.closure_by_joins(twice).collect()) == {(1, 1, 1, 0): 1, (1, 2, 2, 0): 2, (1, 2, 1, 1): 2}
    stored.clear()
    chain = spark.range(1, 301).select(F.lit(7).cast("bigint").alias("sent_id"), F.col("id").cast("int").alias("id"), (F.col("id") - 1).cast("int").alias("head"))
    assert trees.closure_by_joins(chain).count() == 300 * 301 // 2
    assert sum(df.count() for df in stored) <= 300


def test_reach_is_made_in_batches(spark):
    df = spark.createDataFrame([(1, [2, 0, 2]), (2, None), (3, []), (4, [0])], "sent_id bigint, head array<int>")
    for rows in (attention.reach_rows(df), attention.attention_pairs(df)):
        assert "MapInArrow" in plan_of(rows) and "lambda" not in plan_of(rows)
    assert Counter(r.sent_id for r in attention.attention_pairs(df).collect()) == {1: 5 + 3 * 5, 3: 2, 4: 3 + 2}


def test_bound_of_reach():
    rng = random.Random(4)
    for _ in range(30):
        n = rng.randint(1, 12)
        head = np.array([rng.randint(0, n + 1) for _ in range(n)])
        a = numbering.Arcs(head, np.array([n]))
        for distance in (1, 2, 3):
            number, place = a.reach(np.arange(n), distance)
            inside = np.bincount(number[place < n], minlength=n)
            assert (inside <= a.most(distance)).all()


def test_rounds_behind_the_first_label_are_not_drawn(spark, monkeypatch):
    late = lambda p, name, r, *keys, seed: F.when(r > 2, F.raise_error(F.lit("drawn in vain")).cast("boolean")).otherwise(r == 2)
    monkeypatch.setattr(batching, "happens", late)
    df = spark.createDataFrame([(1, "dev", [1, 7, 8]), (2, "dev", [9]), (3, "dev", [1])], "sent_id bigint, split string, input_ids array<int>")
    out = batching.mask_tokens(batching.chunked(df, 2), 4, [0, 1, 2, 3, 4])
    assert {r.sent_id: (r.mask_round, r.input_ids) for r in out.collect()} == {1: (2, [1, 4, 4]), 2: (2, [4]), 3: (0, [1])}


def small(spark, tmp_path, texts):
    """A data folder with these documents."""
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def exchanges(df):
    """Exchanges of the plan before it is adapted; reading stored tables needs none."""
    return plan_of(df).count("Exchange")


def test_squares_of_sentences_are_not_moved(spark, tmp_path):
    """Arcs and distributions grow with the square of a sentence; only sentences are moved, in parts of a bounded size."""
    sf = small(spark, tmp_path, ["A b c. D e f g h", "", "One two", "x"])
    for name in ("h19_heads_of_arcs", "j4_mean_heads", "j3_divergences"):
        assert exchanges(QUERIES[name](spark, sf)) == 1, name
    df = spark.range(40).select(F.col("id").alias("sent_id"), F.lit(3).alias("n"))
    parts = session.dealt(df, "sent_id", F.col("n"), 2)
    assert parts.rdd.getNumPartitions() == 60 and parts.count() == 40
    groups = scoring.mean_heads(derived.attention_rows(spark.createDataFrame([(1, [2, 0])], "sent_id bigint, head array<int>")), "sent_id", "layer", "i")
    assert groups.count() == 4


def test_only_wanted_columns_are_stored(spark, tmp_path, monkeypatch):
    sf = small(spark, tmp_path, ["Words in a row. More words in a row.", "words"])
    full, narrow = derived.id_rows(spark, sf), derived.id_rows(spark, sf, "split")
    assert narrow.columns == ["sent_id", "split", "input_ids"] and set(narrow.columns) < set(full.columns)
    assert sorted(full.select(narrow.columns).collect()) == sorted(narrow.collect())
    seen = []
    ranked = batching.ranked
    monkeypatch.setattr(batching, "ranked", lambda df, *rest: seen.append(df.columns) or ranked(df, *rest))
    for name in ("h13_masked_tokens", "h14_masked_80_10_10"):
        QUERIES[name](spark, sf)
    QUERIES["h15_padded_batches"](spark, sf)
    assert seen == [["sent_id", "split", "input_ids"]] * 2 + [["sent_id", "split", "head", "input_ids"]]


def test_few_labels_are_coded_in_the_row(spark, monkeypatch):
    rows = [(1, ["a", None, "b"], ["b"]), (2, ["b", "a"], []), (None, ["a"], ["a"]), (3, None, ["b"])]
    df = spark.createDataFrame(rows, "sent_id bigint, x array<string>, y array<string>")
    codes = spark.createDataFrame([("f", "a", 0), ("f", "b", 1), ("g", "b", 5), ("g", "a", 6)], "field string, label string, code int")
    few = assemble.encode_labels(df, codes, {"x": "f", "y": "g"})
    assert exchanges(few) == 0
    monkeypatch.setattr(assemble, "FEW_LABELS", 3)
    many = assemble.encode_labels(df, codes, {"x": "f", "y": "g"})
    assert few.schema == many.schema and exchanges(many) > 0
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))


def test_places_of_runs_move_as_one_number(spark, monkeypatch):
    moved = []
    attach = substrings.attach
    monkeypatch.setattr(substrings, "attach", lambda left, *rest: moved.append(left.columns) or attach(left, *rest))
    text = "One two three four five. Six seven eight nine ten. Eleven twelve thirteen fourteen. "
    docs = spark.createDataFrame([(1, text), (2, "New. " + text)], "doc_id bigint, text string")
    out = substrings.repeated_runs(docs).collect()
    assert moved[0] == ["doc_id", "key", "place", "run"]
    assert [(r.doc_id, sorted((p["at"], p["till"]) for p in r.places), r.firsts) for r in out] == [(2, [(1, 4)], [1])]


def plain_pooled(rows, vecs):
    """(sent_id, word) -> mean vector of (sent_id, word, pos) rows, by a plain loop."""
    out = {}
    for s, w, p in rows:
        out.setdefault((s, w), []).extend(v for a, q, v in vecs if (a, q) == (s, p))
    return {k: np.mean(vs, axis=0).tolist() for k, vs in out.items() if vs}


def test_vectors_are_looked_up_and_not_moved(spark):
    """Keys of the vectors move; what is known is pooled and scored as vectors that are joined are."""
    table = spark.createDataFrame([(10 * i, [float(i), float(i % 3), 1.0]) for i in range(1, 9)], "vec_id bigint, vec array<float>")
    held = lookup.held(table, "vec_id")
    assert held.dim == 3 and lookup.held(table, "vec_id", most=95) is None
    for bad in ([(10, [1.0, 1.0, 1.0])], [(None, [1.0, 1.0, 1.0])], [(5, None)], [(5, [1.0, None, 1.0])], [(5, [1.0])]):
        assert lookup.held(table.unionByName(spark.createDataFrame(bad, table.schema)), "vec_id") is None
    rows = [(1, 1, 0), (1, 1, 1), (1, 2, 3), (1, 2, None), (2, 1, 0), (2, 1, 0), (2, None, 1), (2, 3, 9), (3, 1, 0)]
    keyed = [(1, 0, 10), (1, 1, 20), (1, 1, 30), (1, 2, 40), (1, 3, 99), (2, 0, 50), (2, 1, 60), (2, 1, None), (4, 0, 10)]
    vec = {r.vec_id: r.vec for r in table.collect()}
    span_rows = spark.createDataFrame(rows, "sent_id bigint, word int, pos int")
    pooled = scoring.pool_rows(span_rows, spark.createDataFrame(keyed, "sent_id bigint, pos int, vec_id bigint"), "sent_id", "word", table=held)
    want = plain_pooled(rows, [(s, p, vec[k]) for s, p, k in keyed if k in vec])
    assert {(r.sent_id, r.word): r.vec for r in pooled.collect()} == {k: pytest.approx(v) for k, v in want.items()}
    spans = [(0, 0), (0, 1), (1, 9), (3, 5)]
    df = spark.createDataFrame([(1, [10, 20, 99, None, 30], spans), (2, [99], spans), (3, [10 * (i % 8 + 1) for i in range(40)], [(0, 39), (5, 20)])],
                               "sent_id bigint, keys array<bigint>, spans array<struct<b:int,e:int>>")
    got = {r.sent_id: r.p for r in scoring.pool_spans_by_key(df, "keys", "spans", held, "p").collect()}
    vecs = df.select("sent_id", "spans", F.explode("keys").alias("vec_id")).join(table, "vec_id")
    known = {1: [vec[10], vec[20], vec[30]], 3: [vec[10 * (i % 8 + 1)] for i in range(40)]}
    joined = spark.createDataFrame([(s, known[s], spans if s == 1 else [(0, 39), (5, 20)]) for s in known], "sent_id bigint, v array<array<double>>, spans array<struct<b:int,e:int>>")
    plain = {r.sent_id: r.p for r in joined.select("sent_id", scoring.pool_spans(F.col("v"), F.col("spans")).alias("p")).collect()}
    assert set(got) == {1, 3} == {r.sent_id for r in vecs.where("sent_id <> 2").collect()}
    assert all(got[s][i] == pytest.approx(plain[s][i]) for s in got for i in range(len(plain[s])))


def test_similarities_of_keys_and_of_vectors_agree(spark):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(90, 4)).tolist()
    table = spark.createDataFrame([(i, v) for i, v in enumerate(vecs)], "vec_id bigint, vec array<double>")
    rows = []
    for s, n in enumerate((3, 3, 70, 5, 40)):
        tree = lambda: {int(i): 1 for i in rng.choice(n, rng.integers(1, n), replace=False)}  # noqa: E731, B023
        rows.append((s, [int(k) for k in rng.integers(0, 90, n)], [(int(rng.integers(0, n)), tree(), [tree(), {}, tree()]) for _ in range(s)]))
    sets = "array<struct<root_id:int,positive:map<int,int>,negatives:array<map<int,int>>>>"
    keyed = spark.createDataFrame(rows, f"sent_id bigint, vecs array<bigint>, tree_sets {sets}")
    joined = spark.createDataFrame([(s, [vecs[k] for k in ks], t) for s, ks, t in rows], f"sent_id bigint, vecs array<array<double>>, tree_sets {sets}")
    sorted_ = lambda df: sorted((r.sent_id, r.root_id, r.positive, *r.negatives) for r in df.collect())
    held = lookup.held(table, "vec_id")
    for root in (False, True):
        short = sorted_(scoring.tree_similarities(joined, "vecs", root))
        assert len(short) == 10
        assert sorted_(scoring.tree_similarities(keyed, "vecs", root, held)) == [pytest.approx(x) for x in short]
    x, ids = np.array(vecs), np.array([0, 1, 2, 5, 7, 7, 3])
    own, lengths = np.array([0, 0, 0, 1]), np.array([3, 0, 2, 2])
    roots = np.array([1, 2, 3, 4])
    plain = scoring._segment_cosines(x, ids + np.repeat(np.array([0, 0, 0, 10]), lengths), lengths, roots + np.array([0, 0, 0, 10]))
    assert scoring._cosines(x, np.array([10, 80]), own, roots, ids, lengths) == pytest.approx(plain)


def test_vectors_of_sentences_are_never_exchanged(spark, tmp_path):
    """Only keys or counts move by sentence: no exchange carries a vector, and the best negatives are found where the sets are."""
    sf = small(spark, tmp_path, ["A bc def. Ghij klm no pqrs tuv wx yz. A b c d e f g h i j", "", "One two", "x"])
    rows = [(i, [float(i), 1.0, float(-i)]) for i in range(7)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").coalesce(1).write.parquet(f"{sf}/embeddings.parquet")
    # No hash exchange but those that deal documents and sentences, the last groups and the best negatives.
    moved = lambda plan: [x for x in re.findall(r"Exchange (hashpartitioning\(\w+).*?, ENSURE_REQUIREMENTS", plan)]
    for name, count in {"d9_pooled_rows": 0, "d9_pooled_spans": 1, "j1_tree_similarities": 0, "j2_tree_loss": 1, "g3_top_negatives": 1}.items():
        plan = plan_of(QUERIES[name](spark, sf))
        assert len(moved(plan)) == count and "embedding#" not in plan, name
        assert plan.count("_sets(") <= 1, name
    for name in ("j5_tree_loss_last_layer", "j5_tree_loss_all_layers"):
        assert QUERIES[name](spark, sf).count() > 0


def plain_packed(rows, include_root):
    """(masks and indexes) of (split, batch, tree sets) rows, padded one by one."""
    keep = lambda s, t: ([s[0]] if include_root else []) + [k for k in t if k != s[0]]
    listed = [(b, [([s[0]], keep(s, sorted(s[1])), [keep(s, sorted(t)) for t in s[2]]) for s in sets or []]) for b, sets in rows]
    out = []
    for batch, sets in listed:
        same = [x for b, xs in listed if b == batch for x in xs]
        n = max(len(xs) for b, xs in listed if b == batch)
        n_pos, n_negs = max((len(x[1]) for x in same), default=0), max((len(x[2]) for x in same), default=0)
        n_ids = max((len(t) for x in same for t in x[2]), default=0)
        fill = lambda xs, k, pad: xs + [pad] * (k - len(xs))
        roots = fill([x[0][0] for x in sets], n, -1)
        pos = fill([fill(x[1], n_pos, -1) for x in sets], n, [-1] * n_pos)
        neg = fill([fill([fill(t, n_ids, -1) for t in x[2]], n_negs, [-1] * n_ids) for x in sets], n, [[-1] * n_ids] * n_negs)
        deep = lambda f, xs: [deep(f, x) for x in xs] if isinstance(xs, list) else f(xs)  # noqa: E731, B023
        out.append([deep(f, xs) for f in (lambda x: x != -1, lambda x: max(x, 0)) for xs in (roots, pos, neg)])
    return out


def test_trees_are_packed_where_they_are(spark, tmp_path, monkeypatch):
    """Only shapes are moved by batch; arrays are those of a plain loop, whether the rows have the shapes or not."""
    rng = random.Random(5)
    tree = lambda: {k: 1 for k in rng.sample(range(1, 9), rng.randint(1, 6))}
    sets = lambda: [(rng.randint(1, 8), tree(), [tree() for _ in range(rng.randint(0, 4))]) for _ in range(rng.randint(0, 3))]
    batches = [("a", 0), ("a", 0), ("a", 1), (None, 1), (None, 1), ("a", 0), ("b", 7), ("c", 1)]
    rows = [(i, *b, None if i == 4 else [] if i == 6 else sets()) for i, b in enumerate(batches)]
    ids = spark.createDataFrame([(*r[:3], r[3] and [(s, sorted(p), [sorted(t) for t in n]) for s, p, n in r[3]]) for r in rows],
                                "sent_id bigint, split string, batch_id bigint, sets array<struct<root:int,p:array<int>,n:array<array<int>>>>")
    maps = lambda s: F.struct(s["root"].alias("root_id"), F.map_from_arrays(s["p"], s["p"]).alias("positive"),
                              F.transform(s["n"], lambda t: F.map_from_arrays(t, t)).alias("negatives"))
    df = ids.select("sent_id", "split", "batch_id", F.transform("sets", maps).alias("tree_sets"))
    for root in (False, True):
        monkeypatch.setattr(batching, "PADDED", 1 << 20 if root else 3)
        shaped = batching.with_shapes(df, batching.tree_shapes(df, root))
        want = plain_packed([((s, b), x) for _, s, b, x in rows], root)
        for out in (batching.pack_trees(df, root), batching.pack_trees(shaped, root)):
            assert out.columns[:4] == df.columns
            got = {r.sent_id: [r.root_mask, r.positive_mask, r.negative_mask, r.root_indexes, r.positive_indexes, r.negative_indexes] for r in out.collect()}
            assert got.pop(4) == [None] * 6
            for i, w in enumerate(want):
                assert i == 4 or got[i] == w, [(k, x, y) for k, (x, y) in enumerate(zip(got[i], w)) if x != y]
    sf = small(spark, tmp_path, ["A bc def. Ghij klm no pqrs tuv wx yz. A b c d e f g h i j", "", "One two", "x"])
    plan = plan_of(QUERIES["h16_packed_trees"](spark, sf))
    assert plan.count("_sets(") == 2 and "Window" not in plan
    assert not re.search(r"Exchange.*\n[^\n]*(MapInArrow|ArrowEvalPython) _?(packed|sets)", plan)


def test_divergences_of_pairs(spark, monkeypatch):
    """The same numbers as ``divergence`` row by row, with and without a mask, where widths differ and where positions are missing."""
    monkeypatch.setattr(scoring, "COMPARED", 7)
    rng = np.random.default_rng(2)
    dist = lambda n: (w := rng.random(n) * (rng.random(n) > 0.2), (w / max(w.sum(), 1e-9)).tolist())[1]
    rows = []
    for s in range(12):
        n = int(rng.integers(1, 7))
        at = [dist(n if s % 3 else int(rng.integers(0, 7))) for _ in range(n)]
        if s == 5:
            at[0], at[-1] = None, [None] * n
        pairs = [[(int(a), int(b)) for a, b in rng.integers(-1, n + 1, (int(rng.integers(0, 4)), 2))] for _ in range(s % 4)]
        rows.append((s, at, pairs + [[(None, 0)]], [int(m) for m in rng.integers(0, 2, n + s % 2)]))
    df = spark.createDataFrame(rows, "s int, at array<array<double>>, pairs array<array<struct<a:int,b:int>>>, mask array<int>")
    for mask in (None, F.col("mask")):
        plain = F.transform("pairs", lambda ps: F.transform(ps, lambda p: scoring.divergence(F.get("at", p["a"]), F.get("at", p["b"]), mask)))
        both = df.select("s", scoring.divergences(F.col("at"), F.col("pairs"), mask).alias("got"), plain.alias("want")).collect()
        for r in both:
            assert [len(x) for x in r.got] == [len(x) for x in r.want]
            for got, want in zip(sum(r.got, []), sum(r.want, [])):
                assert got == (want if want is None else pytest.approx(want, abs=1e-12)), r.s
        assert any(x is not None for r in both for x in sum(r.got, []))


def test_phrase_losses_of_pairs(spark):
    rows = [(1, [(2, 1, 0, [2, 3]), (3, 0, 2, []), (4, 0, 9, [1])], [[0.5, 0.5, 0.0], [0.2, 0.2, 0.6], [0.1, 0.8, 0.1], [0.3, 0.3, 0.4]]), (2, [], [[1.0]]), (3, None, [[1.0]])]
    df = spark.createDataFrame(rows, "sent_id int, phrase_sets array<struct<root:int,query:int,positive:int,negatives:array<int>>>, at array<array<double>>")
    row = lambda p: F.get("at", p)
    for sign in (1.0, -1.0):
        score = lambda s, p: scoring.divergence(row(s["query"]), row(p)) * F.lit(sign)  # noqa: B023, E731
        plain = F.transform("phrase_sets", lambda s: F.struct(s["root"].alias("root"), scoring.info_nce(
            score(s, s["positive"]), F.transform(s["negatives"], lambda n: score(s, n)), 0.2).alias("loss")))  # noqa: B023
        want = {(r.sent_id, r.x.root): r.x.loss for r in df.select("sent_id", F.explode(plain).alias("x")).collect()}
        got = {(r.sent_id, r.root): r.loss for r in scoring.phrase_losses(df, "at", temperature=0.2, sign=sign).collect()}
        assert len(got) == 3 and got.pop((1, 4)) is want.pop((1, 4)) is None
        assert got == pytest.approx(want)


def test_ids_are_found_in_the_row(spark, tmp_path, monkeypatch):
    """Pieces are not spread over rows where the vocabulary fits; the ids are those of the joins."""
    sf = small(spark, tmp_path, ["Words in a row. More words in a row, r\u00e9sum\u00e9s. \n words", "", "words again. Again"])
    seen = []
    look = derived.piece_ids
    monkeypatch.setattr(derived, "piece_ids", lambda *args: seen.append(1) or look(*args))
    near, some = derived.id_rows(spark, sf), derived.id_rows(spark, sf, "split")
    assert not seen
    monkeypatch.setattr(vocabulary, "SENT_CHARACTERS", 1)
    far = derived.id_rows(spark, sf)
    assert seen and near.schema == far.schema and some.columns == ["sent_id", "split", "input_ids"]
    rows = sorted(map(str, near.collect()))
    assert len(rows) > 4 and rows == sorted(map(str, far.collect()))
    monkeypatch.undo()
    twice = f"{sf}/twice"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.unionByName(docs.where("doc_id = 2")).coalesce(1).write.parquet(f"{twice}/documents.parquet")
    ids = {r.sent_id: r.input_ids for r in derived.id_rows(spark, twice, "split").collect()}
    assert any(len(x) % 2 == 0 and x[1:-1:2] == x[2:-1:2] and len(x) > 2 for x in ids.values())  # both copies of a sentence, as in the SQL
