"""Folds, batches, labels, scores and vocabulary on small tables."""

import math
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treespark.functions import joins, prefix, text
from treespark.operators import assemble, batching, metriclog, scoring, vocabulary
from treespark.plans import derived


def test_running_folds_with_one_hot_partition(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else "cold", i, rng.randint(-9, 9)) for i in rng.sample(range(5000), 900)]
    df = spark.createDataFrame(rows, "g string, k bigint, v int").repartition(6)
    folds = {"n": ("count", F.lit(1)), "s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))}
    got = {(r.g, r.k): (r.n, r.s, r.lo, r.hi) for r in prefix.running(df, ["g"], ["k"], folds).collect()}
    for g in ("hot", "cold"):
        seen = []
        for _, k, v in sorted(r for r in rows if r[0] == g):
            seen.append(v)
            assert got[(g, k)] == (len(seen), sum(seen), min(seen), max(seen))
    assert len(got) == len(rows)


def test_rank_with_null_partition(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 5)], "g string, k int")
    assert {(r.g, r.k, r["rank"]) for r in prefix.ranked(df, ["g"], ["k"]).collect()} == {(None, 1, 1), (None, 2, 2), ("a", 5, 1)}


def sequences(spark, lengths, split="train"):
    rows = [(i, split, list(range(10, 10 + n))) for i, n in enumerate(lengths)]
    return spark.createDataFrame(rows, "sent_id bigint, split string, input_ids array<int>")


def test_padding(spark):
    rows = batching.chunked(sequences(spark, [2, 5, 1, 4]), 2)
    out = {r.sent_id: r for r in batching.pad_batches(rows, ["input_ids"], pad_id=99).collect()}
    assert [len(out[i].input_ids) for i in range(4)] == [5, 5, 4, 4]
    assert out[2].input_ids == [10, 99, 99, 99] and out[2].input_ids_length == 1


def test_masking_rate_and_special_positions(spark):
    df = sequences(spark, [100] * 200).withColumn("input_ids", F.concat(F.array(F.lit(1)), "input_ids", F.array(F.lit(2))))
    out = batching.mask_tokens(batching.chunked(df, 8), 4, [0, 1, 2, 3, 4])
    rows = out.select("input_ids", "labels").collect()
    hit = [(x, y) for r in rows for x, y in zip(r.input_ids, r.labels) if y != -100]
    assert all(x == 4 for x, _ in hit) and abs(len(hit) / 20_000 - 0.15) < 0.01
    assert all(r.labels[0] == r.labels[-1] == -100 for r in rows)


def test_masking_80_10_10(spark):
    df = sequences(spark, [100] * 400)
    out = batching.mask_tokens(batching.chunked(df, 8), 4, [0, 1, 2, 3, 4], vocab_size=5000)
    hit = [(x, y) for r in out.collect() for x, y in zip(r.input_ids, r.labels) if y != -100]
    assert abs(sum(x == 4 for x, _ in hit) / len(hit) - 0.8) < 0.03
    assert abs(sum(x == y for x, y in hit) / len(hit) - 0.1) < 0.03


def test_batches_without_labels_are_drawn_again(spark):
    out = batching.mask_tokens(batching.chunked(sequences(spark, [1] * 64), 1), 4, [0, 1, 2, 3, 4])
    rows = out.collect()
    assert all(any(y != -100 for y in r.labels) for r in rows) and max(r.mask_round for r in rows) > 0


def test_rare_labels_take_many_rounds(spark):
    """One batch of sixty rows, some without anything to predict, and one that never has a label."""
    df = sequences(spark, [1] * 60).withColumn("input_ids", F.when(F.col("sent_id") % 2 == 0, F.array(F.lit(3))).otherwise(F.col("input_ids")))
    rows = batching.mask_tokens(batching.chunked(df, 20), 4, [0, 1, 2, 3, 4], probability=0.0003).collect()
    rounds = {r.batch_id: set() for r in rows}
    for r in rows:
        rounds[r.batch_id].add(r.mask_round)
        assert r.sent_id % 2 or r.labels == [-100]
    assert len(rounds) == 3 and all(len(x) == 1 for x in rounds.values()) and max(max(x) for x in rounds.values()) > batching.ROUNDS
    assert all(any(r.labels != [-100] for r in rows if r.batch_id == b) for b in rounds)
    with pytest.raises(ValueError, match="probability 0"):
        batching.mask_tokens(batching.chunked(df, 20), 4, [0, 1, 2, 3, 4], probability=0.0)


def test_upsampling(spark):
    base = spark.createDataFrame([(i, "train") for i in range(40)] + [(100, "dev")], "sent_id bigint, split string")
    gold = spark.createDataFrame([(200, "train"), (201, "train"), (300, "dev"), (400, "test")], "sent_id bigint, split string")
    rows = assemble.upsample(base, gold).collect()
    assert sorted((r.sent_id, r.copy) for r in rows if r.split == "train") == [(200, 0), (200, 1), (200, 2), (201, 0), (201, 1)]
    both = assemble.append_gold(base, gold).groupBy("split").count().collect()
    assert {(r.split, r["count"]) for r in both} == {("train", 42), ("dev", 2)}
    wide = spark.range(40_000).select(F.col("id").alias("sent_id"), F.lit("train").alias("split"))
    rows = assemble.upsample(wide, gold).where("split = 'train'").groupBy("sent_id").agg(
        F.count("*").alias("n"), F.countDistinct("copy").alias("d"), F.max("copy").alias("top")
    )
    assert {(r.sent_id, r.n, r.d, r.top) for r in rows.collect()} == {(200, 2500, 2500, 2499), (201, 2500, 2500, 2499)}
    with pytest.raises(Exception, match="more gold rows"):
        assemble.upsample(base, gold, per_labelled=40).collect()


def test_label_codes(spark):
    rows = [(1, "train", ["b", "a", None], ["x", None, "x"]), (2, "dev", ["b", "é", "b"], ["y", "x", "y"]), (3, "dev", [], []), (4, "dev", [None], [None])]
    df = spark.createDataFrame(rows, "sent_id bigint, split string, deprel array<string>, xpos array<string>")
    codes = assemble.label_inventory(df)
    assert {tuple(r) for r in codes.collect()} == {("deprel", "a", 0), ("deprel", "b", 1), ("deprel", "é", 2), ("xpos", "x", 0), ("xpos", "y", 1)}
    fields = {"deprel": "deprel", "xpos": "xpos"}
    coded = {r.sent_id: (r.deprel, r.xpos) for r in assemble.encode_labels(df, codes, fields).collect()}
    assert coded == {1: ([1, 0, None], [0, None, 0]), 2: ([1, 2, 1], [1, 0, 1]), 3: ([], []), 4: ([None], [None])}
    with pytest.raises(Exception, match="unknown label: é"):
        assemble.encode_labels(df, codes.where("label <> 'é'"), fields).collect()


def test_pooling_example(spark):
    df = spark.createDataFrame([([[1.0, 1.0], [3.0, 3.0], [4.0, 4.0]], [(0, 1), (2, 2), (5, 6)])], "v array<array<double>>, s array<struct<b:int,e:int>>")
    assert df.select(scoring.pool_spans(F.col("v"), F.col("s")).alias("p")).first().p == [[2.0, 2.0], [4.0, 4.0], [0.0, 0.0]]


def jensen_shannon(p, q):
    p, q = np.maximum(p, 1e-6), np.maximum(q, 1e-6)
    m = (p + q) / 2
    return float((p * np.log(p / m) + q * np.log(q / m)).sum() / 2 / len(p))


def test_divergence(spark):
    cases = [([0.2, 0.2, 0.6], [0.3, 0.3, 0.4], [1, 1, 1]), ([1.0, 0.0, 0.5], [0.9, 0.1, 0.1], [1, 1, 0])]
    df = spark.createDataFrame(cases, "a array<double>, b array<double>, m array<int>")
    got = [r.d for r in df.select(scoring.divergence(F.col("a"), F.col("b"), F.col("m")).alias("d")).collect()]
    want = [jensen_shannon(*(np.array(x[: sum(m)]) for x in (a, b))) for a, b, m in cases]
    assert got == pytest.approx(want)


def test_contrastive_loss(spark):
    df = spark.createDataFrame([(0.9, [0.1, 0.5])], "p double, n array<double>")
    got = df.select(scoring.info_nce(F.col("p"), F.col("n")).alias("l")).first().l
    assert got == pytest.approx(-math.log(math.exp(9) / (math.exp(9) + math.exp(1) + math.exp(5))))


def test_tree_similarity(spark):
    vecs = [[0.0, 1.0], [1.0, 0.0], [0.5, 0.5], [0.0, 2.0]]
    schema = "sent_id bigint, vecs array<array<double>>, tree_sets array<struct<root_id:int,positive:map<int,int>,negatives:array<map<int,int>>>>"
    df = spark.createDataFrame([(1, vecs, [(1, {1: None, 2: 1, 3: 1}, [{1: None, 3: 1}, {1: None}])]), (2, vecs, [])], schema)
    (row,) = scoring.tree_similarities(df, "vecs").collect()
    weights = np.exp([0.5, 0.0]) / np.exp([0.5, 0.0]).sum()
    pooled = weights[0] * np.array(vecs[2]) + weights[1] * np.array(vecs[3])
    assert row.positive == pytest.approx(pooled[0] / np.linalg.norm(pooled))
    assert row.negatives == pytest.approx([0.0, 0.0])


def test_attachment_scores_of_nothing(spark):
    df = spark.createDataFrame([(1, [0], ["x"], [0], ["x"])], "sent_id int, head array<int>, deprel array<string>, pred_head array<int>, pred_deprel array<string>")
    row = scoring.attachment_scores(df, ignore=("x",)).first()
    assert (row.uas, row.las, row.uem, row.lem) == (0.0, 0.0, 1.0, 1.0)


def test_best_so_far_counts_ties(spark):
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate([3.0, 4.0, 3.0, 2.0])], "run string, step bigint, metric double")
    rows = metriclog.best_so_far(df).orderBy("step").collect()
    assert [r.is_best for r in rows] == [True, False, True, True] and [r.best for r in rows] == [3.0, 3.0, 3.0, 2.0]
    kept = metriclog.kept_checkpoints(df.where("step < 3")).first()
    assert (kept.best_step, kept.latest_step) == (2, 2)


def test_word_frequencies_decompose(spark):
    texts = ["Été ≮b, x̸", "été a≮"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.word: r.freq for r in vocabulary.word_frequencies(df, "text").collect()}
    decomposed = spark.createDataFrame([(unicodedata.normalize("NFD", t).lower(),) for t in texts], "text string")
    want = {}
    for r in decomposed.select(F.explode(text.pre_tokens(F.col("text"))).alias("w")).collect():
        want[r.w] = want.get(r.w, 0) + 1
    assert got == want and got["été"] == 2


def test_learnt_pieces_rebuild_words(spark):
    words = spark.createDataFrame([("hug", 10), ("pug", 5), ("pun", 12), ("bun", 4), ("hugs", 5)], "word string, freq bigint")
    vocab, merges = vocabulary.learn(words, vocabulary.VocabularySettings(vocab_size=22, model="bpe"))
    pieces = [r.piece for r in vocab.orderBy("id").collect()]
    assert pieces[:5] == list(vocabulary.SPECIALS) and pieces[5:12] == list("bghnpsu")
    assert merges[0] == ("u", "g")
    by_id = dict(enumerate(pieces))
    for r in vocabulary.encode_distinct_bpe(words, vocab, merges).collect():
        assert "".join(by_id[i] for i in r.ids) == r.word
    assert vocabulary.check_vocabulary(vocab).first().contiguous


def test_wordpiece_encoding(spark):
    vocab = spark.createDataFrame([(p, i) for i, p in enumerate(["[PAD]", "[CLS]", "[SEP]", "[UNK]", "un", "##aff", "##able", "##a"])], "piece string, id int")
    words = spark.createDataFrame([("unaffable",), ("unab",), ("una",), ("u" * 101,), ("unaffable",)], "word string")
    got = {r.word: r.ids for r in vocabulary.encode_distinct(words, vocab, max_word=100).collect()}
    assert got == {"unaffable": [4, 5, 6], "unab": [3], "una": [4, 7], "u" * 101: [3]}


def test_trie_and_joins_encode_alike(spark, monkeypatch):
    rng = random.Random(8)
    some = lambda k: "".join(rng.choice("ab#é") for _ in range(rng.randint(1, k)))
    pieces = ["[UNK]", "a", "##a", "##b", "#", "##", "é", *{some(4) for _ in range(30)}, *{"##" + some(3) for _ in range(30)}]
    pieces = list(dict.fromkeys(pieces))
    vocab = spark.createDataFrame([(p, i) for i, p in enumerate(pieces)], "piece string, id int")
    rows = [(some(9),) for _ in range(300)] + [("",), (None,), ("a" * 3000,), ("a" + "b" * 500 + "x",)]
    words = spark.createDataFrame(rows, "word string")
    by_id = dict(enumerate(pieces))

    def greedy(word):
        out, at = [], 0
        while word and at < len(word):
            fits = [t for t in range(len(word), at, -1) if ("##" if at else "") + word[at:t] in pieces]
            if not fits:
                return ["[UNK]"]
            out.append(("##" if at else "") + word[at:fits[0]])
            at = fits[0]
        return out or ["[UNK]"]

    sent = {r.word: [by_id[i] for i in r.ids] for r in vocabulary.encode_distinct(words, vocab, unk=0).collect()}
    assert sent == {w: greedy(w) for (w,) in rows}
    monkeypatch.setattr(vocabulary, "SENT_CHARACTERS", 10)
    apart = {r.word: [by_id[i] for i in r.ids] for r in vocabulary.encode_distinct(words, vocab, unk=0).collect()}
    assert apart == sent
    none = vocabulary.encode_distinct(words.limit(3), vocab.limit(0)).collect()
    assert all(r.ids == [3] for r in none)


def test_frequent_keys_are_dealt(spark, monkeypatch):
    rows = [(i, "the" if i % 2 else f"w{i % 4000}") for i in range(8000)] + [(9000 + i, None) for i in range(50)]
    df = spark.createDataFrame(rows, "k bigint, piece string")
    table = spark.createDataFrame([("the", 7, "x"), ("w2", 8, None), ("w4", None, "z")], "piece string, a int, b string")
    got = joins.looked_up(df, table, "piece", ["k"])
    known = {"the": (7, "x"), "w2": (8, None), "w4": (None, "z")}
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[0]) == [(k, p, *known.get(p, (None, None))) for k, p in rows]
    assert joins.looked_up(df.limit(0), table, "piece", ["k"]).isEmpty()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) > 1 and max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]
    vocab = spark.createDataFrame([("the", 5), ("w2", 6)], "piece string, id int")
    rows = df.withColumnRenamed("k", "sent_id").withColumn("pos", F.lit(0))
    small = sorted(tuple(r) for r in vocabulary.piece_ids(rows, vocab).select("sent_id", "token_id").collect())
    monkeypatch.setattr(vocabulary, "SENT_CHARACTERS", 1)
    assert small == sorted(tuple(r) for r in vocabulary.piece_ids(rows, vocab).select("sent_id", "token_id").collect())


def test_vocabulary_settings():
    with pytest.raises(ValueError, match="unknown model"):
        vocabulary.VocabularySettings(model="unigram")


def test_vocabulary_size_rule(spark):
    df = spark.createDataFrame([(478_376,), (59_137,), (14_457,)], "types bigint")
    got = [r.n for r in df.select(vocabulary.size_rule(F.col("types")).alias("n")).collect()]
    assert got == [8000 + max(0, int((t - 15000) * (6000 / 450000))) for t in (478_376, 59_137, 14_457)]


def test_sentences_of_text_batches():
    """Marks before a last line terminator end a sentence, as ``$`` has it in Java; long ones are cut every 24 words."""
    texts = ["A b.  c!\r\n d  e,", None, "", "w " * 30 + "x.\u0085 \u00e9\U0001d11e."]
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9, None]), pa.array(texts)], names=["doc_id", "text"])
    rows = pa.Table.from_batches(derived._parsed_batches(iter([batch]))).to_pylist()
    assert [(r["doc_id"], r["k"], len(r["tokens"])) for r in rows] == [(7, 0, 2), (7, 1, 1), (7, 2, 2), (None, 0, 24), (None, 1, 7), (None, 2, 1)]
    assert [r["tokens"] for r in rows[:3]] == [["A", "b."], ["c!\r"], ["d", "e,"]]
    assert rows[0]["head"] == [2, 0] and rows[0]["xpos"] == ["W1", "P"] and rows[0]["deprel"] == ["l1", "root"]
    assert rows[5]["tokens"] == ["\u00e9\U0001d11e."] and rows[5]["xpos"] == ["P"]


def test_rows_of_positions_are_merged(spark):
    """Rows made from arrays are far more than the optimizer counts, so no side of their joins is broadcast."""
    made = spark.range(2).select(F.col("id").alias("sent_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("pos"))
    vecs = made.select("sent_id", "pos", F.array(F.col("pos") * 1.0, F.lit(3.0)).alias("vec"))
    pooled = scoring.pool_rows(made.withColumn("word", F.lit(1)), vecs, "sent_id", "word")
    missing = scoring.missing_positions(made.unionByName(made.select("sent_id", (F.col("pos") + 2).alias("pos"))), vecs)
    keyed = made.withColumn("vec_id", F.col("pos") * 10)
    table = spark.createDataFrame([(0, [5.0]), (10, [6.0])], "vec_id int, vec array<double>")
    found = scoring.gather(made.where("pos = 1"), keyed, table)
    for df in (pooled, missing, found):
        assert "SortMergeJoin" in df._jdf.queryExecution().executedPlan().toString()
    assert [r.vec for r in pooled.collect()] == [[1.0, 3.0]] * 2
    assert sorted((r.sent_id, r.pos) for r in missing.collect()) == [(s, p) for s in (0, 1) for p in (3, 4)]
    assert sorted((r.sent_id, r.pos, r.vec[0]) for r in found.collect()) == [(0, 1, 6.0), (1, 1, 6.0)]
