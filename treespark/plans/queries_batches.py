"""Check queries: batches, masked tokens, packed index arrays, model inputs, vocabulary."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import functions as F

from treespark.functions.arrays import computed, posexploded
from treespark.functions.draws import draw
from treespark.functions.text import pre_tokens
from treespark.operators import assemble, batching, contrast, scoring, subword, vocabulary
from treespark.plans import derived
from treespark.plans.oracle import draw as sql_draw
from treespark.plans.oracle import sql
from treespark.plans.queries_tables import UPSAMPLED
from treespark.plans.queries_trees import EXPANDED, NEEDS, NEGATIVE_CTES, PHRASE_CTES, joined
from treespark.plans.registry import query
from treespark.session import cut_lineage

SPECIAL_IDS = [0, 1, 2, 3, 4]


def batch_cte(size: int) -> str:
    return f"""SELECT sent_id, split, (row_number() OVER (PARTITION BY split ORDER BY sent_id) - 1) // {size} AS batch_id
FROM (SELECT DISTINCT sent_id, split FROM tb)"""


# --- batches ------------------------------------------------------------------------------------------


@query("e4_chunks", sql("SELECT sent_id, split, batch_id, batch_id // 8 AS step FROM b", "tb", b=batch_cte(32)))
def _(spark, sf):
    rows = batching.chunked(derived.sentences(spark, sf).select("sent_id", "split"), 32)
    return batching.regrouped(rows, 8)


@query(
    "d17_batch_sizes",
    sql(
        """SELECT b.split, b.batch_id, CAST(max(s.pieces) AS BIGINT) AS max_input_ids, CAST(max(s.n) AS BIGINT) AS max_head FROM b
JOIN (SELECT sent_id, n, sum(np) + 2 AS pieces FROM wp GROUP BY sent_id, n) s ON s.sent_id = b.sent_id GROUP BY b.split, b.batch_id""",
        "tb", "wp", b=batch_cte(32),
    ),
)
def _(spark, sf):
    return batching.batch_sizes(batching.chunked(derived.id_rows(spark, sf, "split", "head"), 32), ["input_ids", "head"])


@query(
    "h15_padded_batches",
    sql(
        """SELECT sent_id, batch_id, length, CAST(max(length) OVER (PARTITION BY split, batch_id) AS BIGINT) AS padded, ids, head_length,
CAST(max(head_length) OVER (PARTITION BY split, batch_id) AS BIGINT) AS head_padded FROM (SELECT b.sent_id, b.split, b.batch_id, i.length, i.ids, t.n AS head_length FROM b
JOIN (SELECT sent_id, count(*) AS length, string_agg(token_id, ',' ORDER BY pos) AS ids FROM ids GROUP BY sent_id) i ON i.sent_id = b.sent_id
JOIN (SELECT DISTINCT sent_id, n FROM tb) t ON t.sent_id = b.sent_id)""",
        "tb", "ids", b=batch_cte(32),
    ),
)
def _(spark, sf):
    rows = batching.chunked(derived.id_rows(spark, sf, "split", "head"), 32)
    out = batching.pad_batches(rows, ["input_ids", "head"], pad_id=-7)
    return out.select(
        "sent_id", "batch_id", F.col("input_ids_length").alias("length"), F.size("input_ids").alias("padded"),
        joined(F.filter("input_ids", lambda x: x != -7)).alias("ids"), F.col("head_length"), F.size("head").alias("head_padded"),
    )


# Small batches and a low probability, so that many batches are drawn again.
MASK_BATCH, MASK_PROBABILITY = 3, 0.05
MASK_BELOW = math.ceil(MASK_PROBABILITY * 2**32)


def mask_ctes(size: int) -> dict[str, str]:
    """Round 0 for all batches, further rounds one by one for those that have had no label."""
    drawn = f"{sql_draw(repr('mask'), 'r', 'sent_id', 'pos')} < {MASK_BELOW}"
    return {
        "b": batch_cte(size),
        "maskable": "SELECT b.split, b.batch_id, i.sent_id, i.pos, i.token_id FROM ids i JOIN b ON b.sent_id = i.sent_id WHERE i.token_id >= 5",
        "tries": f"""SELECT split, batch_id, CAST(0 AS BIGINT) AS r, bool_or({drawn}) AS hit FROM (SELECT *, CAST(0 AS BIGINT) AS r FROM maskable) GROUP BY split, batch_id
UNION ALL
SELECT split, batch_id, r, bool_or({drawn}) AS hit FROM (SELECT m.*, t.r + 1 AS r FROM maskable m JOIN tries t ON t.split = m.split AND t.batch_id = m.batch_id WHERE NOT t.hit)
GROUP BY split, batch_id, r""",
        "rounds": "SELECT split, batch_id, r FROM tries WHERE hit",
        "labelled": f"""SELECT sent_id, pos, token_id AS label, r AS round FROM (SELECT m.*, o.r FROM maskable m JOIN rounds o ON o.split = m.split AND o.batch_id = m.batch_id) WHERE {drawn}""",
    }


def _masked(spark, sf, vocab_size=None):
    rows = batching.chunked(derived.id_rows(spark, sf, "split"), MASK_BATCH)
    out = batching.mask_tokens(rows, 4, SPECIAL_IDS, probability=MASK_PROBABILITY, vocab_size=vocab_size)
    zipped = out.select("sent_id", F.col("mask_round").alias("round"), posexploded(F.arrays_zip("labels", "input_ids")).alias("pos", "x"))
    return zipped.where("x.labels <> -100").select("sent_id", "pos", "round", F.col("x.labels").alias("label"), F.col("x.input_ids").alias("token_id"))


@query("h13_masked_tokens", sql("SELECT sent_id, pos, round, label, CAST(4 AS BIGINT) AS token_id FROM labelled", "tb", "ids", **mask_ctes(MASK_BATCH)))
def _(spark, sf):
    return _masked(spark, sf)


@query(
    "h14_masked_80_10_10",
    sql(
        f"""SELECT sent_id, pos, round, label, CASE WHEN {sql_draw("'mask 80'", 'round', 'sent_id', 'pos')} < 3435973837 THEN 4
WHEN {sql_draw("'random 50'", 'round', 'sent_id', 'pos')} < 2147483648
THEN CAST(floor({sql_draw("'random id'", 'round', 'sent_id', 'pos')} * 1000 / 4294967296.0::DOUBLE) AS BIGINT) ELSE label END AS token_id FROM labelled""",
        "tb", "ids", **mask_ctes(MASK_BATCH),
    ),
)
def _(spark, sf):
    return _masked(spark, sf, 1000)


@query(
    "d19_replaced_tokens",
    sql(
        f"""SELECT split, count(*) FILTER (pos > 0 AND {sql_draw('sent_id', 'pos')} < 644245095) AS labelled,
count(*) FILTER (pos > 0 AND {sql_draw('sent_id', 'pos')} < 644245095 AND token_id % 3 = 0) AS replaced,
CAST(sum(token_id + CASE WHEN pos > 0 AND {sql_draw('sent_id', 'pos')} < 644245095 AND token_id % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS ids FROM ids GROUP BY split""",
        "ids",
    ),
)
def _(spark, sf):
    df = derived.id_rows(spark, sf, "split")
    drawn = lambda i: (i > 0) & (draw(F.col("sent_id"), i) < 644245095)
    stored = computed(
        df,
        pred_ids=F.transform("input_ids", lambda x: F.when(x % 3 == 0, x + 1).otherwise(x)),
        labels=F.transform("input_ids", lambda x, i: F.when(drawn(i), x).otherwise(-100)),
    )
    out = scoring.replaced_tokens(stored)
    total = lambda c: F.sum(F.aggregate(c, F.lit(0), lambda s, x: s + x))
    return out.groupBy("split").agg(
        F.sum(F.size(F.filter("labels", lambda x: x != -100))).alias("labelled"),
        F.sum(F.size(F.filter("replaced", lambda x: x))).alias("replaced"),
        total("replaced_ids").alias("ids"),
    )


PACKED = {
    **NEGATIVE_CTES,
    "b": batch_cte(16),
    "per": """SELECT sent_id, count(DISTINCT root) AS sets, max(pos_ids) AS pos_ids, max(negs) AS negs, max(neg_ids) AS neg_ids, sum(filled) AS filled FROM
(SELECT n.sent_id, n.root, max(len(e.members)) - 1 AS pos_ids, count(*) AS negs, max(len(n.ids)) - 1 AS neg_ids, sum(len(n.ids) - 1) AS filled
FROM negatives n JOIN elig e ON e.sent_id = n.sent_id AND e.root = n.root GROUP BY n.sent_id, n.root) GROUP BY sent_id""",
}


@query(
    "h16_packed_trees",
    sql(
        """SELECT b.sent_id, coalesce(CAST(max(p.sets) OVER w AS BIGINT), 0) AS sets, coalesce(CAST(max(p.pos_ids) OVER w AS BIGINT), 0) AS pos_ids,
coalesce(CAST(max(p.negs) OVER w AS BIGINT), 0) AS negs, coalesce(CAST(max(p.neg_ids) OVER w AS BIGINT), 0) AS neg_ids,
coalesce(p.sets, 0) AS own_sets, coalesce(CAST(p.filled AS BIGINT), 0) AS filled
FROM b LEFT JOIN per p ON p.sent_id = b.sent_id WINDOW w AS (PARTITION BY b.split, b.batch_id)""",
        *NEEDS, "tb", **PACKED,
    ),
)
def _(spark, sf):
    rows = batching.chunked(derived.sentences(spark, sf).select("sent_id", "split", "head"), 16)
    shaped = batching.with_shapes(rows, batching.tree_shapes(contrast.tree_sets(rows)))
    sets = F.transform("tree_sets", lambda s: F.struct(s["root_id"].alias("root_id"), s["positive"].alias("positive"), s["negatives"].alias("negatives")))
    out = batching.pack_trees(contrast.tree_sets(shaped).withColumn("tree_sets", sets).drop("head"))
    width = lambda xs: F.coalesce(F.size(F.get(xs, F.lit(0))), F.lit(0))
    yes = lambda xs: F.size(F.array_remove(xs, False))
    return out.select(
        "sent_id", F.size("root_indexes").alias("sets"), width("positive_indexes").alias("pos_ids"), width("negative_indexes").alias("negs"),
        F.coalesce(F.size(F.get(F.get("negative_indexes", F.lit(0)), F.lit(0))), F.lit(0)).alias("neg_ids"),
        yes("root_mask").alias("own_sets"), yes(F.flatten(F.flatten("negative_mask"))).alias("filled"),
    )


@query(
    "h16_packed_phrases",
    sql(
        """SELECT p.sent_id, CAST(max(p.sets) OVER w AS BIGINT) AS sets, CAST(max(p.negs) OVER w AS BIGINT) AS negs, p.sets AS own_sets, CAST(p.filled AS BIGINT) AS filled,
CAST(p.queries AS BIGINT) AS queries FROM (SELECT x.sent_id, count(*) AS sets, max(c) AS negs, sum(c) AS filled, sum(query) AS queries
FROM (SELECT sent_id, root, query, len(string_split(negatives, ',')) AS c FROM phrases) x GROUP BY x.sent_id) p JOIN b ON b.sent_id = p.sent_id WINDOW w AS (PARTITION BY b.split, b.batch_id)""",
        "sub", "tb", "wp", **PHRASE_CTES, b=batch_cte(16),
    ),
)
def _(spark, sf):
    rows = batching.chunked(derived.encoded(spark, sf).select("sent_id", "split", "head", "token_spans"), 16)
    out = batching.pack_phrases(contrast.phrase_sets(rows, "token_spans").drop("head", "token_spans"))
    return out.select(
        "sent_id", F.size("query_indexes").alias("sets"), F.size(F.get("negative_indexes", F.lit(0))).alias("negs"),
        F.size(F.filter("query_mask", lambda x: x)).alias("own_sets"),
        F.size(F.filter(F.flatten("negative_mask"), lambda x: x)).alias("filled"),
        F.aggregate("query_indexes", F.lit(0), lambda s, x: s + x).alias("queries"),
    )


# --- model inputs -------------------------------------------------------------------------------------

CODES = """SELECT field, label, row_number() OVER (PARTITION BY field ORDER BY label) - 1 AS code FROM (
SELECT 'xpos' AS field, xpos AS label FROM tb WHERE is_gold = 1 OR split IN ('train', 'dev')
UNION SELECT 'deprel', x.deprel FROM ex x JOIN tb t ON t.sent_id = x.sent_id AND t.id = 1 WHERE t.is_gold = 1 OR t.split IN ('train', 'dev'))"""


@query(
    "h18_model_inputs",
    sql(
        """SELECT r.split, r.gold AS tree_is_gold, count(*) AS sequences, CAST(sum(e.deprels) AS BIGINT) AS deprels, CAST(sum(e.heads) AS BIGINT) AS heads,
CAST(sum(o.xposs) AS BIGINT) AS xposs, CAST(sum(o.deprels) AS BIGINT) AS orig_deprels FROM
(SELECT DISTINCT sent_id, split, 0 AS copy, CAST(0 AS BIGINT) AS gold FROM tb WHERE is_gold = 0 UNION ALL SELECT sent_id, split, copy, 1 FROM up) r
JOIN (SELECT x.sent_id, sum(c.code) AS deprels, sum(x.head) AS heads FROM ex x JOIN codes c ON c.field = 'deprel' AND c.label = x.deprel GROUP BY x.sent_id) e ON e.sent_id = r.sent_id
JOIN (SELECT t.sent_id, sum(x.code) AS xposs, sum(d.code) AS deprels FROM tb t JOIN codes x ON x.field = 'xpos' AND x.label = t.xpos
JOIN codes d ON d.field = 'deprel' AND d.label = t.deprel GROUP BY t.sent_id) o ON o.sent_id = r.sent_id GROUP BY r.split, r.gold""",
        "tb", "pc", "wp", ex=EXPANDED, codes=CODES, up=UPSAMPLED[UPSAMPLED.rindex("SELECT sent_id, split, copy FROM ("):],
    ),
)
def _(spark, sf):
    df = derived.id_rows(spark, sf, "split", "is_gold", "head", "xpos", "deprel", "token_spans")
    ones = computed(
        df, attention_mask=F.transform("input_ids", lambda _: F.lit(1)), token_type_ids=F.transform("input_ids", lambda _: F.lit(0))
    )
    expanded = cut_lineage(subword.expand_subwords(ones))
    out = assemble.finalize(expanded.where("is_gold = 0"), expanded.where("is_gold = 1"))
    total = lambda c: F.sum(F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x))
    return out.groupBy("split", F.get("tree_is_gold", F.lit(0)).alias("tree_is_gold")).agg(
        F.count("*").alias("sequences"), total("deprel").alias("deprels"), total("head").alias("heads"),
        total("xpos").alias("xposs"), total("orig_deprel").alias("orig_deprels"),
    )


# --- vocabulary ---------------------------------------------------------------------------------------

WORD_CLASS = r"\p{L}\p{M}\p{Nd}\p{Pc}"
PATTERN = rf"[{WORD_CLASS}]+|[^{WORD_CLASS}\s]+"


@query(
    "k1_word_frequencies",
    f"SELECT word, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(lower(text), '{PATTERN}')) AS word FROM documents) GROUP BY word",
)
def _(spark, sf):
    docs = derived.table(spark, sf, "documents").select("text")
    return vocabulary.word_frequencies(docs, "text", decompose=False)


@query("k1_decomposed_frequencies")
def _(spark, sf):
    return vocabulary.word_frequencies(derived.table(spark, sf, "documents").select("text"), "text")


def _learnt(spark, sf, settings):
    words = vocabulary.word_frequencies(
        derived.table(spark, sf, "documents").select("text"), "text", settings.lowercase, settings.decompose,
        settings.single_marks,
    )
    return words, *vocabulary.learn(words, settings)


@query("k2_wordpiece_vocabulary")
def _(spark, sf):
    return _learnt(spark, sf, vocabulary.VocabularySettings())[1]


@query("k2_bpe_vocabulary")
def _(spark, sf):
    return _learnt(spark, sf, vocabulary.VocabularySettings(model="bpe"))[1]


@query("k3_cased_vocabulary")
def _(spark, sf):
    return _learnt(spark, sf, vocabulary.CASED)[1]


@query("k4_relearnt_vocabulary")
def _(spark, sf):
    return _learnt(spark, sf, vocabulary.PRETRAINED_CASED)[1]


@query("k7_vocabulary_from_sentences")
def _(spark, sf):
    texts = derived.sentences(spark, sf).select(F.array_join("tokens", " ").alias("text"))
    return vocabulary.learn(vocabulary.word_frequencies(texts, "text"), vocabulary.VocabularySettings())[0]


GREEDY = {
    "words": f"SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(form, '{PATTERN}')) AS word FROM tb)",
    "parts": """SELECT word, s AS start, l AS len, CASE WHEN s = 1 THEN substr(word, 1, l) ELSE '##' || substr(word, s, l) END AS piece
FROM (SELECT word, s, unnest(range(1, least(length(word) - s + 1, 4) + 1)) AS l FROM (SELECT word, unnest(range(1, length(word) + 1)) AS s FROM words WHERE length(word) <= 100))""",
    "longest": "SELECT word, start, max(len) AS len, arg_max(piece_id, len) AS piece_id FROM parts JOIN vocab USING (piece) GROUP BY word, start",
    "walk": """SELECT word, CAST(1 AS BIGINT) AS here, CAST('' AS VARCHAR) AS ids FROM words
UNION ALL SELECT w.word, w.here + l.len, w.ids || ',' || l.piece_id FROM walk w JOIN longest l ON l.word = w.word AND l.start = w.here""",
    "cut": """SELECT s.word, coalesce(w.ids, ',3') AS ids FROM words s LEFT JOIN (SELECT word, ids FROM walk WHERE here = length(word) + 1) w ON w.word = s.word""",
}


def _encoded_words(spark, sf):
    df = derived.sentences(spark, sf)
    rows = derived.piece_rows(derived.encoded(spark, sf))
    vocab = derived.stored_vocabulary(rows)
    words = df.select(F.explode(F.flatten(F.transform("tokens", lambda t: pre_tokens(t)))).alias("word"))
    return df, vocabulary.encode_distinct(words, vocab)


@query("k5_encoded_words", sql("SELECT word, substr(ids, 2) AS ids FROM cut", "tb", "vocab", **GREEDY))
def _(spark, sf):
    return _encoded_words(spark, sf)[1].select("word", joined("ids").alias("ids"))


@query("k5_encoded_words_bpe")
def _(spark, sf):
    words, vocab, merges = _learnt(spark, sf, vocabulary.VocabularySettings(model="bpe"))
    return vocabulary.encode_distinct_bpe(words, vocab, merges).select("word", joined("ids").alias("ids"))


@query(
    "k6_encoded_sentences",
    sql(
        """SELECT sent_id, '1' || string_agg(ids, '' ORDER BY id, k) || ',2' AS input_ids, sum(len(string_split(ids, ',')) - 1)::BIGINT + 2 AS length
FROM (SELECT t.sent_id, t.id, t.k, c.ids FROM (SELECT sent_id, id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k
FROM (SELECT sent_id, id, regexp_extract_all(form, '"""
        + PATTERN
        + """') AS ws FROM tb)) t JOIN cut c ON c.word = t.word) GROUP BY sent_id""",
        "tb", "vocab", **GREEDY,
    ),
)
def _(spark, sf):
    df, encoded = _encoded_words(spark, sf)
    pieces = vocabulary.encode_words(df, encoded, lowercase=False, decompose=False)
    out = subword.tokenize(pieces, "pieces")
    return out.select("sent_id", joined("input_ids").alias("input_ids"), F.size("attention_mask").alias("length"))


@query(
    "k6_encoded_pairs",
    sql(
        """SELECT sent_id, string_agg(token_id, ',' ORDER BY part, pos) AS input_ids, string_agg(part, ',' ORDER BY part, pos) AS token_type_ids FROM (
SELECT i.sent_id, i.token_id, i.pos, CASE WHEN i.pos < r.b OR i.pos = 0 THEN 0 ELSE 1 END AS part FROM ids i JOIN (SELECT sent_id, b FROM wp WHERE head = 0) r ON r.sent_id = i.sent_id
UNION ALL SELECT sent_id, 2, b - 0.5, 0 FROM wp WHERE head = 0) GROUP BY sent_id""",
        "ids", "wp",
    ),
)
def _(spark, sf):
    """The words before the root word as the first part, the others as the second."""
    df = derived.id_rows(spark, sf, "head", "token_spans")
    inner = subword.trim_special(F.col("input_ids"))
    before = F.element_at("token_spans", F.array_position("head", 0).cast("int") + 1)["b"] - 1
    parts = computed(df, a=F.slice(inner, 1, before), b=F.slice(inner, before + 1, F.size(inner)))
    out = computed(parts, x=subword.encode_pair(F.col("a"), F.col("b")))
    return out.select("sent_id", joined("x.input_ids").alias("input_ids"), joined("x.token_type_ids").alias("token_type_ids"))


