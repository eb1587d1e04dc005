"""Tree functions against hand examples and brute force on small random trees."""

import itertools
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treespark.functions import numbering, swaps
from treespark.functions import trees as tree_functions
from treespark.operators import attention, contrast, subword, trees


def random_tree(rng, n):
    """Heads of a random tree: words join in random order, each under an earlier one."""
    order = rng.sample(range(1, n + 1), n)
    head = [0] * n
    for k, word in enumerate(order[1:], 1):
        head[word - 1] = rng.choice(order[:k])
    return head


def above(head, word):
    """The word and all words over it."""
    out = []
    while word:
        out.append(word)
        word = head[word - 1]
    return out


def governed(head, word):
    return {x for x in range(1, len(head) + 1) if word in above(head, x)}


def beside(head, root):
    mine = governed(head, root)
    near = {x + d for x in mine for d in (-1, 1)}
    return sorted(x for x in near if 1 <= x <= len(head) and x not in mine and x not in above(head, root))


@pytest.fixture(scope="module")
def forest(spark):
    rng = random.Random(7)
    heads = {i: random_tree(rng, rng.randint(1, 9)) for i in range(120)}
    heads[1000] = [i for i in range(130)]  # a chain: the deepest tree of its length
    heads[1001] = [0] + [1] * 99  # a star
    df = spark.createDataFrame(list(heads.items()), "sent_id bigint, head array<int>").repartition(4)
    return heads, df.cache()


def test_worked_example(spark):
    df = spark.createDataFrame([(1, [0, 3, 1, 3])], "sent_id bigint, head array<int>")
    assert {(r.id, r.child) for r in trees.child_rows(df).collect()} == {(1, 3), (3, 2), (3, 4)}
    assert [r.size for r in trees.subtree_rows(df).orderBy("root").collect()] == [4, 1, 3, 1]


def test_subtrees_match_brute_force(forest):
    heads, df = forest
    rows = trees.subtree_rows(df).collect()
    assert len(rows) == sum(len(h) for h in heads.values())
    for r in rows:
        head = heads[r.sent_id]
        mine = governed(head, r.root)
        deepest = max(len(above(head, m)) for m in mine)
        assert r.members == sorted(mine)
        assert r.height == deepest - len(above(head, r.root)) + 1
        assert r.neighbours == beside(head, r.root)


def test_closure_has_every_pair_once(forest):
    heads, df = forest
    got = Counter((r.sent_id, r.id, r.anc, r.dist) for r in trees.closure(df).collect())
    want = {(s, i, a, d) for s, h in heads.items() for i in range(1, len(h) + 1) for d, a in enumerate(above(h, i))}
    assert set(got) == want and set(got.values()) == {1}


def test_off_tree_words(spark):
    df = spark.createDataFrame(
        [(1, [0, 1]), (2, [2, 1, 0]), (3, [0, 9]), (4, [1, 1]), (5, [2, 3, 1, 3, 0])], "sent_id bigint, head array<int>"
    )
    report = {r.sent_id: r.off_tree for r in trees.off_tree_report(df).collect()}
    assert report == {2: [1, 2], 3: [2], 4: [1, 2], 5: [1, 2, 3, 4]}


def test_reach_examples(spark):
    df = spark.createDataFrame([(1, [5, 0, 2, 2, 4]), (2, [0, 3, 4, 1]), (3, [0])], "sent_id bigint, head array<int>")
    reach = attention.reach_rows(df, 1)
    near = lambda s: {r.other for r in reach.where(f"sent_id = {s} and id = 1").collect()}
    assert near(1) == {1, 5} and near(2) == {1, 4} and near(3) == set()


def test_reach_matches_brute_force(forest):
    heads, df = forest
    got = {(r.sent_id, r.id, r.other) for r in attention.reach_rows(df, 3).collect()}

    def distance(head, a, b):
        pa, pb = above(head, a), above(head, b)
        common = [x for x in pa if x in pb]
        return pa.index(common[0]) + pb.index(common[0])

    want = {
        (s, a, b)
        for s, head in heads.items()
        if len(head) > 1
        for a in range(1, len(head) + 1)
        for b in range(1, len(head) + 1)
        if distance(head, a, b) <= 3
    }
    assert got == want


def test_reach_by_levels_equals_the_walk(spark):
    rng = random.Random(5)
    rows = []
    for i in range(120):  # several roots, circles, loops and heads outside the sentence among them
        n = rng.randint(0, 12)
        rows.append((i, [rng.randint(0, w) if rng.random() < 0.9 else rng.randint(0, n + 1) for w in range(n)]))
    df = spark.createDataFrame(rows, "sent_id bigint, head array<int>")
    for distance in (1, 3):
        walk = Counter(tuple(r) for r in attention.reach_rows(df, distance).collect())
        assert walk == Counter(tuple(r) for r in attention.reach_rows(df, distance, short=0).collect()) and walk
    settings = attention.RangeSettings(3, (-1, 2))
    want = {
        (r.sent_id, r.i, j)
        for r in df.select("sent_id", F.posexplode(attention.open_positions(F.col("head"), settings)).alias("i", "js")).collect()
        for j in r.js
    }
    for short in (0, 128):
        assert Counter(tuple(r) for r in attention.attention_pairs(df, settings, short).collect()) == Counter(want)


def test_reach_of_long_sentences(spark):
    n = 20_000
    df = spark.createDataFrame([(1, list(range(n))), (2, [0] + [1] * (n - 1))], "sent_id bigint, head array<int>")
    chain = attention.reach_rows(df.where("sent_id = 1"), 3)
    assert chain.count() == 7 * n - 12 and chain.where("abs(id - other) > 3").isEmpty()
    assert attention.reach_rows(df.where("sent_id = 2"), 1).count() == n + 2 * (n - 1)
    # Row 0 is open; a word sees both ends and, from four words before to three behind, those that are there.
    assert attention.attention_pairs(df.where("sent_id = 1")).count() == (n + 2) + 2 * n + (8 * n - 10 - 6)


def test_mask_rows_and_columns(spark):
    df = spark.createDataFrame([(1, [5, 0, 2, 2, 4])], "sent_id bigint, head array<int>")
    mask = attention.dense_mask(df, attention.RangeSettings(max_distance=1)).first().dep_att_mask
    assert len(mask) == 7 and all(len(row) == 7 for row in mask)
    assert mask[0] == [0.0] * 7 and mask[6] == [-1e6] * 7
    assert [j for j, v in enumerate(mask[1]) if v == 0.0] == [0, 1, 5, 6]
    # word 2 shares the reach of word 1
    assert [j for j, v in enumerate(mask[2]) if v == 0.0] == [0, 1, 2, 3, 4, 5, 6]


def plans_by_force(head, root, difference=1):
    """All pairings of target and value combinations, cut to the shorter one, that keep the size."""
    mine = governed(head, root)
    combos = lambda xs: [c for k in (1, 2, 3) for c in itertools.combinations(sorted(xs), k)]
    found = Counter()
    for ts in combos(mine - {root}):
        for vs in combos(beside(head, root)):
            k = min(len(ts), len(vs))
            gone = set().union(*(governed(head, t) for t in ts[:k]))
            new = set().union(*(governed(head, v) for v in vs[:k]))
            tree = (mine - gone) | new
            if abs(len(tree) - len(mine)) <= difference:
                found[(ts[:k], vs[:k], tuple(sorted(tree)))] += 1
    return found


def test_negative_trees_match_brute_force(forest):
    heads, df = forest
    settings = contrast.TreeSettings(max_negatives=100_000)
    got = {(r.sent_id, s.root_id): s for r in contrast.tree_sets(df.where("sent_id < 1000"), settings).collect() for s in r.tree_sets}
    checked = 0
    for sent_id, head in heads.items():
        if sent_id >= 1000:
            continue
        for root in range(1, len(head) + 1):
            plans = plans_by_force(head, root) if 2 <= len(governed(head, root)) <= 10 else Counter()
            if sum(plans.values()) <= 1:
                assert (sent_id, root) not in got
                continue
            mine = got[(sent_id, root)]
            assert mine.found == sum(plans.values())
            trees_ = {(tuple(p.targets), tuple(p["values"]), tuple(sorted(n))) for p, n in zip(mine.plans, mine.negatives)}
            assert trees_ == set(plans)
            assert all(root in n and n[root] is None for n in mine.negatives)
            assert not any(a in n for n in mine.negatives for a in above(head, root)[1:])
            checked += 1
    assert checked > 50


def test_spliced_words_take_the_head_of_the_replaced_one(spark):
    # 2 governs 1 and 3; 4 hangs on 5, the root word: word 4 may stand in for 1 or 3
    df = spark.createDataFrame([(1, [2, 5, 2, 5, 0])], "sent_id bigint, head array<int>")
    sets = contrast.tree_sets(df, contrast.TreeSettings(max_negatives=100)).first().tree_sets
    (of_two,) = [s for s in sets if s.root_id == 2]
    assert of_two.positive == {1: 2, 2: None, 3: 2}
    found = sorted((dict(n) for n in of_two.negatives), key=sorted)
    assert found == [{1: 2, 2: None, 4: 2}, {2: None, 3: 2, 4: 2}]


def test_samples_do_not_depend_on_partitions(forest):
    _, df = forest
    few, many = df.coalesce(1), df.repartition(7)
    one = {r.sent_id: r.tree_sets for r in contrast.tree_sets(few).collect()}
    two = {r.sent_id: r.tree_sets for r in contrast.tree_sets(many).collect()}
    assert one == two
    sample = contrast.random_subtrees(1)
    assert all(len(r.tree_sets) <= 1 for r in contrast.tree_sets(df, sampler=sample).collect())


def test_expansion_example(spark):
    spans = [(0, 0), (1, 2), (3, 3), (4, 4)]
    df = spark.createDataFrame(
        [(1, [2, 0], ["a", "root"], spans), (2, [2, 0, 1], ["a", "root", "b"], spans)],
        "sent_id bigint, head array<int>, deprel array<string>, token_spans array<struct<b:int,e:int>>",
    )
    (row,) = subword.expand_subwords(df).collect()
    assert (row.sent_id, row.head, row.deprel) == (1, [3, 1, 0], ["a", "subword", "root"])
    assert (row.orig_head, row.orig_deprel) == ([2, 0], ["a", "root"])
    assert [(s.b, s.e) for s in row.dependency_token_spans] == [(p, p) for p in range(5)]


def test_flat_and_paired_spans(spark):
    df = spark.createDataFrame([([0, 0, 1, 2, 3, 3],)], "flat array<int>")
    row = df.select(subword.paired_spans(F.col("flat")).alias("s")).withColumn("flat", subword.flat_spans(F.col("s"))).first()
    assert [(s.b, s.e) for s in row.s] == [(0, 0), (1, 2), (3, 3)] and row.flat == [0, 0, 1, 2, 3, 3]


def test_budget_with_no_fitting_word(spark):
    df = spark.createDataFrame([(1, ["long", "x"], [[7, 8, 9], []])], "sent_id bigint, tokens array<string>, pieces array<array<int>>")
    (none,) = subword.tokenize(df, "pieces", max_length=4).collect()
    assert (none.tokens, none.input_ids, [(s.b, s.e) for s in none.token_spans]) == ([], [1, 2], [(0, 0), (1, 1)])
    (all_,) = subword.tokenize(df, "pieces").collect()
    assert all_.input_ids == [1, 7, 8, 9, 3, 2] and len(all_.attention_mask) == len(all_.token_type_ids) == 6


def test_phrase_sets_stay_outside(forest):
    heads, df = forest
    words = F.transform(F.sequence(F.lit(0), F.size("head") + 1), lambda p: F.struct(p.alias("b"), p.alias("e")))
    count = 0
    for r in contrast.phrase_sets(df.withColumn("spans", words), "spans").collect():
        for s in r.phrase_sets:
            mine = governed(heads[r.sent_id], s.root)
            assert {s.query, s.positive} <= mine and s.query != s.positive
            assert not mine & set(s.negatives) and len(set(s.negatives)) == min(10, len(heads[r.sent_id]) - len(mine))
            count += 1
    assert count > 30


def test_numbers_of_broken_trees(spark):
    """Words on a cycle, and those under them, are in no order; the others are numbered as if alone."""
    df = spark.createDataFrame([([2, 3, 1, 0, 4, 2],), ([0, 9, 1],), ([0, 0, 2, 1],)], "head array<int>")
    got = [r.n for r in df.select(tree_functions.numbers(F.col("head")).alias("n")).collect()]
    assert [n.order for n in got] == [[4, 5], [1, 3], [1, 4, 2, 3]]
    assert got[0].size == [0, 0, 0, 2, 1, 0] and got[2].size == [2, 2, 1, 1] and got[2].depth == [1, 1, 2, 2]


def near_tree(rng, n):
    """Heads close by on the way to the middle, so that the tree is a fifth of its words deep."""
    root = n // 2
    toward = lambda w: min(root, w + rng.randint(1, 3)) if w < root else max(root, w - rng.randint(1, 3))
    return [0 if w == root else toward(w) for w in range(1, n + 1)]


def sizes_of(head):
    n, root = len(head), head.index(0) + 1
    size = [0] + [1] * n
    for w in [*range(1, root), *range(n, root, -1)]:
        size[head[w - 1]] += size[w]
    return size


def test_twenty_thousand_words(spark):
    head = near_tree(random.Random(11), 20_000)
    df = spark.createDataFrame([(1, head)], "sent_id bigint, head array<int>")
    size = sizes_of(head)
    assert trees.off_tree_report(df).count() == 0
    assert Counter(r.id for r in trees.child_rows(df).collect()) == Counter(h for h in head if h)
    few = {r.root: r.size for r in trees.eligible_subtrees(df).select("root", "size").collect()}
    sized = {w: size[w] for w in range(1, len(head) + 1) if 2 <= size[w] <= 10}
    assert few.items() <= sized.items() and 2 * len(few) > len(sized)  # some have no neighbour but words above them
    assert attention.reach_rows(df, 3).where("id = other").count() == len(head)


def test_deep_closure(spark):
    head = near_tree(random.Random(12), 2_000)
    df = spark.createDataFrame([(1, head)], "sent_id bigint, head array<int>")
    rows = trees.subtree_rows(df).select("size", F.size("members").alias("n"), "height").collect()
    assert sorted(r.size for r in rows) == sorted(sizes_of(head)[1:]) and all(r.size == r.n for r in rows)
    depth = max(len(above(head, w)) for w in range(1, 2_001))
    assert max(r.height for r in rows) == depth
    assert trees.closure(df).count() == sum(r.size for r in rows)


def test_expansion_faults_fail_the_job(spark):
    rows = [(1, [0, 1], [9, 9, 9, 9]), (2, [2, 1], [9, 9, 9, 9]), (3, [0, 1], [9, 9, 9])]
    df = spark.createDataFrame(rows, "sent_id bigint, head array<int>, input_ids array<int>")
    faults = df.select("sent_id", subword.expansion_fault().alias("fault"))
    assert {r.sent_id: r.fault for r in faults.collect()} == {1: None, 2: "cycle", 3: "length"}
    assert [r["head"] for r in subword.sound(df.where("sent_id = 1")).collect()] == [[0, 1]]
    for number, fault in ((2, "cycle"), (3, "length")):
        with pytest.raises(Exception, match=f"sentence {number}: {fault}"):
            subword.sound(df.where(f"sent_id = {number}")).collect()


def test_forests_of_a_batch():
    """Many sentences numbered in one pass, however the batch is cut: null and empty ones, cycles and several roots."""
    rng = random.Random(13)
    heads = [None, [], [2, 1], [0, 0, 2, 1], *([0 if w == 1 else rng.randint(1, w - 1) for w in range(1, rng.randint(2, 40))] for _ in range(60))]
    column = pa.array(heads, pa.list_(pa.int32()))
    whole, kept = numbering.numbered(column), numbering.WORDS
    numbering.WORDS = 7
    try:
        assert numbering.numbered(column).equals(whole)
    finally:
        numbering.WORDS = kept
    for head, n in zip(heads[4:], whole.to_pylist()[4:]):
        mine = [governed(head, w) for w in range(1, len(head) + 1)]
        assert n["size"] == [len(m) for m in mine] and sorted(n["order"]) == [*range(1, len(head) + 1)]
        assert all(set(n["order"][b : b + s]) == m for b, s, m in zip(n["begin"], n["size"], mine))
    roots = pa.array([[] if not h else [1, 2] for h in heads], pa.list_(pa.int32()))
    assert len(swaps.tree_sets(pa.array([str(k) for k in range(len(heads))]), column, roots, 1, 10, 42)) == len(heads)
    assert len(numbering.numbered(column[:0])) == 0
    assert numbering.eligible(column, 2, 10).to_pylist()[:3] == [[], [], []]
