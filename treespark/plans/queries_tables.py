"""Check queries: sources, sinks, projections, joins, counts, labels, set operations."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from treespark.functions import text
from treespark.functions.arrays import computed, exploded, item
from treespark.functions.draws import happens
from treespark.operators import assemble, batching, subword, tokens, trees, vocabulary
from treespark.operators.annotate import annotate, annotate_cached, count_conflicts, retokenize
from treespark.plans import derived
from treespark.plans.oracle import draw, key, sql
from treespark.plans.registry import query
from treespark.session import scratch_path
from treespark.sources import conllu, sinks, stages, text as texts
from treespark.sources.catalog import CATALOG, catalog
from treespark.streaming import drain, stream_text_lines

WS = text.WHITESPACE


def stripped_sql(column: str) -> str:
    return f"regexp_replace({column}, '^[{WS}]+|[{WS}]+$', '', 'g')"


JOINED = "string_agg(form, ' ' ORDER BY id)"


# --- sources and sinks --------------------------------------------------------------------------------

LINE_WORDS = sql(
    f"""SELECT doc_id, ln, CAST(len(w) AS BIGINT) AS n_tokens, coalesce(array_to_string(w, ' '), '') AS tokens
FROM (SELECT doc_id, ln, list_filter(string_split({stripped_sql('line')}, ' '), lambda x: x <> '') AS w FROM lines)""",
    "lines",
)


@query("a1_text_lines", LINE_WORDS)
def _(spark, sf):
    rows = texts.tokens_of_lines(derived.lines(spark, sf), "line")
    return rows.select("doc_id", "ln", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


WORD_TOTALS = sql(
    f"""SELECT count(*) AS sentences, CAST(sum(len(list_filter(string_split(line, ' '), lambda x: x <> ''))) AS BIGINT) AS words
FROM lines""",
    "lines",
)


@query("a1_stream_text_lines", WORD_TOTALS)
def _(spark, sf):
    folder = scratch_path(spark, "lines")
    sinks.write_text(derived.lines(spark, sf), f"{folder}/in", "line")
    drain(stream_text_lines(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/progress")
    out = spark.read.schema("tokens array<string>").parquet(f"{folder}/out")
    return out.agg(F.count("*").alias("sentences"), F.sum(F.size("tokens")).alias("words"))


@query("a10_write_text", WORD_TOTALS)
def _(spark, sf):
    path = scratch_path(spark, "text")
    sinks.write_text(derived.lines(spark, sf), path, "line")
    return texts.read_text_lines(spark, path).agg(
        F.count("*").alias("sentences"), F.sum(F.size("tokens")).alias("words")
    )


@query("a2_conllu", sql("SELECT sent_id, id, form, xpos, CAST(head AS VARCHAR) AS head, deprel FROM tb", "tb"))
def _(spark, sf):
    df = conllu.read_conllu(spark, derived.treebank_folder(spark, sf), keys=("sent_id",))
    named = df.drop("sent_id").withColumnRenamed("meta_sent_id", "sent_id")
    rows = tokens.token_rows(named, ["tokens", "xpos", "head", "deprel"])
    return rows.withColumnRenamed("tokens", "form").withColumn("sent_id", F.col("sent_id").cast("bigint"))


@query(
    "a3_conllu_forms",
    sql(
        """SELECT form, count(*) AS n FROM (SELECT form FROM tb
UNION ALL SELECT 'x' FROM (SELECT DISTINCT sent_id FROM tb WHERE is_gold = 1)
UNION ALL SELECT 'x' FROM (SELECT DISTINCT sent_id FROM tb WHERE is_gold = 1)) GROUP BY form""",
        "tb",
    ),
)
def _(spark, sf):
    df = conllu.read_conllu_forms(spark, derived.treebank_folder(spark, sf), glob=None)
    return df.select(exploded(F.col("tokens")).alias("form")).groupBy("form").agg(F.count("*").alias("n"))


@query(
    "a4_conllu_meta",
    sql(f"SELECT 's' || (n % 5) AS s_type, {JOINED} AS text FROM tb GROUP BY sent_id, n", "tb"),
)
def _(spark, sf):
    df = conllu.read_conllu_meta(spark, derived.treebank_folder(spark, sf))
    return df.select("s_type", "text")


TREEBANK_COUNTS = """SELECT {}count(DISTINCT sent_id) AS sentences, count(*) AS words,
CAST(sum(head) AS BIGINT) AS heads FROM tb{}"""


@query("a5_treebank", sql(TREEBANK_COUNTS.format("split, ", " GROUP BY split"), "tb"))
def _(spark, sf):
    df = tokens.cast_heads(conllu.read_treebank(spark, derived.treebank_folder(spark, sf)))
    return df.groupBy("split").agg(
        F.count("*").alias("sentences"),
        F.sum(F.size("tokens")).alias("words"),
        F.sum(F.aggregate("head", F.lit(0), lambda s, x: s + x)).alias("heads"),
    )


@query(
    "a6_folder_tree",
    sql(
        """SELECT count(DISTINCT sent_id) AS sentences, count(*) + 2 * count(DISTINCT CASE WHEN is_gold = 1 THEN sent_id END) AS words
FROM tb""",
        "tb",
    ),
)
def _(spark, sf):
    df = conllu.read_conllu_forms(spark, derived.treebank_folder(spark, sf))
    return df.agg(F.count("*").alias("sentences"), F.sum(F.size("tokens")).alias("words"))


@query(
    "a7_catalog",
    "SELECT d.lang, c.name, c.treebank, count(*) AS docs FROM documents d LEFT JOIN (VALUES "
    + ", ".join(f"('{r[0]}', '{r[1]}', '{r[2]}')" for r in CATALOG)
    + ") AS c(name, code, treebank) ON c.code = d.lang GROUP BY ALL",
)
def _(spark, sf):
    counts = derived.table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("docs"))
    known = catalog(spark).select(F.col("code").alias("lang"), "name", "treebank")
    return counts.join(known, "lang", "left").select("lang", "name", "treebank", "docs")


LABELLED = sql(
    f"""SELECT 'd' || t.doc_id AS source, CAST(l.quality AS BIGINT) AS label, CASE WHEN l.toxic = 1 THEN '*' ELSE '' END AS mark,
t.text FROM (SELECT doc_id, sent_id, {JOINED} AS text FROM tb GROUP BY doc_id, sent_id) t JOIN labels l ON l.doc_id = t.doc_id""",
    "tb",
)


@query("a8_labelled_tsv", LABELLED)
def _(spark, sf):
    path = scratch_path(spark, "tsv")
    sinks.write_text(derived.text_with_labels(spark, sf), path, "value")
    return texts.read_labelled_tsv(spark, path).select("source", "label", "mark", "text")


CORPUS_WORDS = f"""SELECT corpus, CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS words, count(*) AS texts
FROM (SELECT corpus, {stripped_sql('text')} AS text FROM
(SELECT 'documents' AS corpus, text FROM documents UNION ALL SELECT 'benchmark', text FROM benchmark))
WHERE length(text) > 0 GROUP BY corpus"""


@query("a9_corpora", CORPUS_WORDS)
def _(spark, sf):
    df = texts.read_corpora(spark, {n: f"{sf}/{n}.parquet" for n in ("documents", "benchmark")})
    return texts.word_count(df, "text", "corpus")


@query(
    "a11_conllu_blocks",
    sql(
        """SELECT sent_id, md5(string_agg(id || chr(9) || form || chr(9) || '_' || chr(9) || '_' || chr(9) || xpos || chr(9) || '_'
|| chr(9) || head || chr(9) || deprel || chr(9) || '_' || chr(9) || '_', chr(10) ORDER BY id)) AS block FROM tb GROUP BY sent_id""",
        "tb",
    ),
)
def _(spark, sf):
    block = sinks.conllu_block(F.col("tokens"), F.col("xpos"), F.col("head"), F.col("deprel"))
    return derived.sentences(spark, sf).select("sent_id", F.md5(block).alias("block"))


@query(
    "a11_conllu_round_trip",
    sql("SELECT split, count(*) AS words, CAST(sum(head * id) AS BIGINT) AS arcs FROM tb GROUP BY split", "tb"),
)
def _(spark, sf):
    path = scratch_path(spark, "conllu")
    sinks.write_conllu(derived.sentences(spark, sf), path, {"split": F.col("split")})
    df = tokens.cast_heads(conllu.read_conllu(spark, path, keys=("split",)))
    rows = tokens.token_rows(df, ["head"], "meta_split")
    return rows.groupBy(F.col("meta_split").alias("split")).agg(
        F.count("*").alias("words"), F.sum(F.col("head") * F.col("id")).alias("arcs")
    )


@query("a12_write_vocab", sql("SELECT piece, piece_id - 5 AS line FROM vocab", "vocab"))
def _(spark, sf):
    vocab = derived.piece_vocabulary(derived.piece_rows(derived.encoded(spark, sf)))
    path = scratch_path(spark, "vocab")
    sinks.write_vocab(vocab.withColumn("id", F.col("id") - 5), path)
    return spark.read.text(path).select(F.col("value").alias("piece"), F.monotonically_increasing_id().alias("line"))


@query(
    "a12_vocab_check",
    sql("SELECT count(*) AS pieces, max(piece_id) - 5 AS max_id, true AS contiguous FROM vocab", "vocab"),
)
def _(spark, sf):
    vocab = derived.piece_vocabulary(derived.piece_rows(derived.encoded(spark, sf)))
    return vocabulary.check_vocabulary(vocab.withColumn("id", F.col("id") - 5))


@query("a13_stage", sql(TREEBANK_COUNTS.format("split, ", " GROUP BY split"), "tb"))
def _(spark, sf):
    path = scratch_path(spark, "stage")
    stages.stage(derived.sentences(spark, sf), path)
    df = stages.stage(derived.sentences(spark, sf).limit(0), path)
    return df.groupBy("split").agg(
        F.count("*").alias("sentences"),
        F.sum(F.size("tokens")).alias("words"),
        F.sum(F.aggregate("head", F.lit(0), lambda s, x: s + x)).alias("heads"),
    )


def chain_parser(batch):
    """A rule in place of a parser: every word hangs on the one before; a range line is added and dropped."""
    return [
        [{"id": (1, 2), "text": "x"}]
        + [
            {"id": i, "text": w, "lemma": w.lower(), "upos": "X", "xpos": "X", "head": i - 1, "deprel": "dep" if i > 1 else "root"}
            for i, w in enumerate(words, 1)
        ]
        for words in batch
    ]


CHAIN = sql("SELECT split, count(*) AS words, CAST(sum(id - 1) AS BIGINT) AS heads FROM tb GROUP BY split", "tb")


def _chain_totals(df):
    df = tokens.cast_heads(df)
    return df.groupBy("split").agg(
        F.sum(F.size("tokens")).alias("words"),
        F.sum(F.aggregate("head", F.lit(0), lambda s, x: s + x)).alias("heads"),
    )


@query("a14_parse_cache", CHAIN)
def _(spark, sf):
    path = scratch_path(spark, "parsed")
    text_only = derived.sentences(spark, sf).select("sent_id", "split", "tokens")
    annotate_cached(text_only, chain_parser, path, "en")
    return _chain_totals(annotate_cached(text_only.limit(0), chain_parser, path, "en"))


@query("m1_annotate", CHAIN)
def _(spark, sf):
    return _chain_totals(annotate(derived.sentences(spark, sf).select("sent_id", "split", "tokens"), chain_parser, 128))


LABELS = """SELECT field, label, row_number() OVER (PARTITION BY field ORDER BY label) - 1 AS code FROM (
SELECT 'xpos' AS field, xpos AS label FROM tb WHERE {} UNION SELECT 'deprel', deprel FROM tb WHERE {})"""
IN_LABELS = "(is_gold = 1 OR split IN ('train', 'dev'))"


def _split_gold(spark, sf):
    df = derived.sentences(spark, sf)
    return df.where("is_gold = 0"), df.where("is_gold = 1")


@query("a15_label_list", sql(LABELS.format(IN_LABELS, IN_LABELS), "tb"))
def _(spark, sf):
    path = scratch_path(spark, "labels")
    stages.write_labels(assemble.label_inventory(*_split_gold(spark, sf)), path)
    return stages.read_labels(spark, path)


@query(
    "a16_append_metrics",
    """SELECT run, metric, count(*) AS n, CAST(sum(step) AS BIGINT) AS steps, max(value) AS top FROM (
SELECT event_type AS run, event_id // 50 AS step, CASE WHEN event_id % 2 = 0 THEN 'loss' ELSE 'perplexity' END AS metric, value FROM events)
GROUP BY run, metric""",
)
def _(spark, sf):
    path = scratch_path(spark, "metrics")
    rows = derived.metric_log(spark, sf).select(
        "run", "step", F.lit("train").alias("split"),
        F.when(F.col("event_id") % 2 == 0, "loss").otherwise("perplexity").alias("metric"), "value",
    )
    stages.append_metrics(rows.where("metric = 'loss'"), path)
    stages.append_metrics(rows.where("metric <> 'loss'"), path)
    return stages.read_metrics(spark, path).groupBy("run", "metric").agg(
        F.count("*").alias("n"), F.sum("step").alias("steps"), F.max("value").alias("top")
    )


@query("a17_first_row", sql(f"SELECT sent_id, {JOINED} AS text FROM tb GROUP BY sent_id ORDER BY sent_id LIMIT 1", "tb"))
def _(spark, sf):
    df = derived.sentences(spark, sf).select("sent_id", F.array_join("tokens", " ").alias("text"))
    return tokens.preview(df, "sent_id")


@query(
    "a17_random_rows",
    sql(
        f"""SELECT split, sent_id FROM (SELECT split, sent_id, row_number() OVER (PARTITION BY split ORDER BY {key('sent_id')}) AS r
FROM (SELECT DISTINCT split, sent_id FROM tb)) WHERE r = 1""",
        "tb",
    ),
)
def _(spark, sf):
    return tokens.random_per_split(derived.sentences(spark, sf).select("split", "sent_id"), "sent_id")


# --- projections and filters --------------------------------------------------------------------------


@query(
    "b1_kept_tokens",
    sql(
        f"""SELECT doc_id, CAST(sum(len(list_filter(w, lambda x: x <> ''))) AS BIGINT) AS kept,
CAST(sum(len(list_filter(w, lambda x: x = ''))) AS BIGINT) AS dropped
FROM (SELECT doc_id, string_split({stripped_sql('line')}, ' ') AS w FROM lines) GROUP BY doc_id""",
        "lines",
    ),
)
def _(spark, sf):
    line = F.col("line")
    kept, every = F.size(text.words(line)), F.size(F.split(text.stripped(line), " "))
    return derived.lines(spark, sf).groupBy("doc_id").agg(
        F.sum(kept).alias("kept"), F.sum(every - kept).alias("dropped")
    )


@query(
    "b2_plain_ids",
    sql(
        """SELECT split, count(*) AS kept, 2 * count(DISTINCT CASE WHEN is_gold = 1 THEN sent_id END) AS dropped FROM tb GROUP BY split""",
        "tb",
    ),
)
def _(spark, sf):
    rows = conllu.blocks(derived.conllu_rows(derived.sentences(spark, sf)))
    ids = rows.select("split", F.explode(F.filter(F.split("block", "\n"), lambda x: ~x.startswith("#") & (x != ""))).alias("line"))
    plain = tokens.is_integer_id(F.get(F.split("line", "\t"), F.lit(0)))
    return ids.groupBy("split").agg(F.count_if(plain).alias("kept"), F.count_if(~plain).alias("dropped"))


@query(
    "b3_sentence_arrays",
    sql(f"SELECT sent_id, split, {JOINED} AS text, string_agg(CAST(head AS VARCHAR), ',' ORDER BY id) AS heads FROM tb GROUP BY sent_id, split", "tb"),
)
def _(spark, sf):
    rows = tokens.token_rows(derived.sentences(spark, sf), ["tokens", "head"], "split")
    df = tokens.sentence_rows(rows, ["tokens", "head"], "split")
    return df.select(
        "sent_id", "split", F.array_join("tokens", " ").alias("text"),
        F.array_join(F.col("head").cast("array<string>"), ",").alias("heads"),
    )


@query("b4_token_rows", sql("SELECT sent_id, split, id, form, head, xpos, deprel FROM tb", "tb"))
def _(spark, sf):
    rows = tokens.token_rows(derived.sentences(spark, sf), ["tokens", "head", "xpos", "deprel"], "split")
    return rows.withColumnRenamed("tokens", "form")


@query(
    "b5_defaults",
    "SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), '') AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
)
def _(spark, sf):
    labels = derived.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    joined = derived.table(spark, sf, "documents").select("doc_id").join(labels, "doc_id", "left")
    return joined.select("doc_id", tokens.with_default("quality").alias("quality"))


@query(
    "b6_suitable_texts",
    sql(f"SELECT doc_id, ln, md5({stripped_sql('line')}) AS text FROM lines WHERE length({stripped_sql('line')}) > 0", "lines"),
)
def _(spark, sf):
    df = texts.suitable_texts(derived.lines(spark, sf), "line")
    return df.select("doc_id", "ln", F.md5("line").alias("text"))


@query("b7_tab_lines", sql("SELECT count(DISTINCT sent_id) AS kept FROM tb WHERE doc_id IN (SELECT doc_id FROM labels)", "tb"))
def _(spark, sf):
    return texts.labelled_lines(derived.text_with_labels(spark, sf)).agg(F.count("*").alias("kept"))


@query(
    "b8_columns",
    sql("SELECT sent_id AS sentence, n AS words, split AS part FROM tb GROUP BY ALL", "tb"),
)
def _(spark, sf):
    df = derived.sentences(spark, sf).withColumn("words", F.size("head")).drop("tokens", "head", "xpos", "deprel")
    return df.withColumnsRenamed({"sent_id": "sentence", "split": "part"}).select("sentence", "words", "part")


@query("b9_cast_heads", sql("SELECT sent_id, CAST(sum(head) AS BIGINT) AS heads FROM tb GROUP BY sent_id", "tb"))
def _(spark, sf):
    df = derived.sentences(spark, sf).withColumn("head", F.col("head").cast("array<string>"))
    return tokens.cast_heads(df).select("sent_id", F.aggregate("head", F.lit(0), lambda s, x: s + x).alias("heads"))


TOKENIZED = sql(
    """SELECT sent_id, CAST(count(*) AS BIGINT) AS words, coalesce(string_agg(form, ' ' ORDER BY id), '') AS text,
CAST(max(e) AS BIGINT) + 2 AS ones, string_agg(b || '-' || e, ',' ORDER BY id) AS spans FROM wp WHERE e <= 14 GROUP BY sent_id""",
    "wp",
)


@query("b11_word_budget", TOKENIZED)
def _(spark, sf):
    df = derived.encoded(spark, sf)
    ids = F.transform("pieces", lambda p: F.transform(p, lambda x: F.length(x)))
    out = subword.tokenize(computed(df, pieces=ids), "pieces", max_length=16).where(F.size("tokens") > 0)
    word_spans = F.transform(subword.trim_special(F.col("token_spans")), lambda s: F.concat_ws("-", s["b"], s["e"]))
    return out.select(
        "sent_id", F.size("tokens").alias("words"), F.array_join("tokens", " ").alias("text"),
        F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x).alias("ones"), F.array_join(word_spans, ",").alias("spans"),
    )


@query(
    "b10_constants",
    sql(
        "SELECT sent_id, CAST(sum(np) AS BIGINT) + 2 AS ones, CAST(0 AS BIGINT) AS types, CAST(sum(np) AS BIGINT) + 2 AS zeros FROM wp GROUP BY sent_id",
        "wp",
    ),
)
def _(spark, sf):
    df = derived.encoded(spark, sf)
    ids = F.transform("pieces", lambda p: F.transform(p, lambda x: F.length(x)))
    out = subword.tokenize(computed(df, pieces=ids), "pieces")
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x)
    return out.select(
        "sent_id", total("attention_mask").alias("ones"), total("token_type_ids").alias("types"), F.size("token_type_ids").alias("zeros")
    )


def _cut_heads(df, every):
    short = F.slice("head", 1, F.size("head") - 1)
    return df.withColumn("head", F.when(F.size("head") % every == 0, short).otherwise(F.col("head")))


MISMATCHED = sql(
    "SELECT split, count(*) FILTER (n % 7 = 0) AS discarded, count(*) AS total FROM (SELECT DISTINCT split, sent_id, n FROM tb) GROUP BY split", "tb"
)


@query("b12_mismatched", MISMATCHED)
@query("d18_discarded", MISMATCHED)
def _(spark, sf):
    return subword.expansion_counts(_cut_heads(derived.encoded(spark, sf), 7))


@query(
    "d18_observed",
    sql("SELECT count(*) FILTER (n % 7 = 0) AS discarded, count(*) AS total, CAST(sum(n) FILTER (n % 7 <> 0) AS BIGINT) AS words FROM (SELECT DISTINCT sent_id, n FROM tb)", "tb"),
)
def _(spark, sf):
    """The expansion is written once, and its counters come from that same job."""
    seen = Observation("expansion")
    path = scratch_path(spark, "expanded")
    subword.expand_subwords(_cut_heads(derived.encoded(spark, sf), 7), observation=seen).select("orig_head").write.parquet(path)
    written = spark.read.schema("orig_head array<int>").parquet(path)
    counters = [F.lit(seen.get[name]).alias(name) for name in ("discarded", "total")]
    return written.agg(F.sum(F.size("orig_head")).alias("words"), *counters)


@query(
    "b13_expansion_faults",
    sql(
        """SELECT sent_id, CASE WHEN n % 6 = 0 THEN 'cycle' ELSE 'length' END AS fault
FROM (SELECT DISTINCT sent_id, n FROM tb) WHERE n % 6 = 0 OR n % 11 = 0""",
        "tb",
    ),
)
def _(spark, sf):
    """Planted: sentences without a root where six divides the words, input ids cut short where eleven does."""
    root = F.array_position("head", 0).cast("int")
    bent = F.transform("head", lambda h: F.when((h == 0) & (F.size("head") % 6 == 0), root + 1).otherwise(h))
    full = F.col("token_spans")[F.size("token_spans") - 1]["e"]
    ids = F.sequence(F.lit(0), full - F.when(F.size("head") % 11 == 0, 1).otherwise(0))
    df = subword.expand_subwords(computed(derived.encoded(spark, sf), input_ids=ids, head=bent))
    return df.select("sent_id", subword.expansion_fault().alias("fault")).where("fault IS NOT NULL")


@query("b13_count_conflicts", sql("SELECT DISTINCT sent_id, n AS before, n - 1 AS after FROM tb WHERE n % 11 = 0", "tb"))
def _(spark, sf):
    df = derived.sentences(spark, sf)
    return count_conflicts(df, _cut_heads(df, 11))


def split_marks(batch):
    """A rule in place of a tokenizer: a final mark becomes a word of its own."""
    out = []
    for words in batch:
        cut = [[w[:-1], w[-1]] if len(w) > 1 and w[-1] in ".," else [w] for w in words]
        out.append([p for parts in cut for p in parts])
    return out


@query(
    "b14_length_differences",
    sql(
        """SELECT sent_id, n AS old_size, n + count(*) AS new_size FROM tb WHERE xpos = 'P' AND length(form) > 1 GROUP BY sent_id, n""", "tb"
    ),
)
def _(spark, sf):
    old = derived.sentences(spark, sf).select("sent_id", "tokens")
    return tokens.length_differences(old, retokenize(old, split_marks))


@query(
    "m2_retokenize",
    sql("SELECT count(DISTINCT sent_id) AS sentences, count(*) + count(*) FILTER (xpos = 'P' AND length(form) > 1) AS words FROM tb", "tb"),
)
def _(spark, sf):
    df = retokenize(derived.sentences(spark, sf).select("sent_id", "tokens"), split_marks)
    return df.agg(F.count("*").alias("sentences"), F.sum(F.size("tokens")).alias("words"))


# --- joins --------------------------------------------------------------------------------------------


@query(
    "c1_attach_parse",
    sql(f"SELECT sent_id, {JOINED} AS text, string_agg(deprel, ' ' ORDER BY id) AS labels FROM tb GROUP BY sent_id", "tb"),
)
def _(spark, sf):
    df = derived.sentences(spark, sf)
    joined = df.select("sent_id", "tokens").hint("merge").join(df.select("sent_id", "deprel"), "sent_id")
    return joined.select("sent_id", F.array_join("tokens", " ").alias("text"), F.array_join("deprel", " ").alias("labels"))


@query("c2_piece_ids", sql("SELECT sent_id, pos, token_id FROM ids WHERE token_id >= 5 OR token_id = 3", "ids"))
def _(spark, sf):
    rows = derived.piece_rows(derived.encoded(spark, sf))
    return vocabulary.piece_ids(rows, derived.piece_vocabulary(rows)).select("sent_id", "pos", "token_id")


CODED = sql(
    f"SELECT t.sent_id, t.id, l.code FROM tb t JOIN ({LABELS.format(IN_LABELS, IN_LABELS)}) l ON l.field = 'deprel' AND l.label = t.deprel WHERE t.{IN_LABELS[1:-1].replace('split', 't.split')}"
    .replace("WHERE t.is_gold = 1 OR", "WHERE t.is_gold = 1 OR"),
    "tb",
)


@query("c3_label_codes", CODED)
@query("c3_label_codes_joined", CODED)
def _(spark, sf):
    base, gold = _split_gold(spark, sf)
    codes = assemble.label_inventory(base, gold)
    known = derived.sentences(spark, sf).where("is_gold = 1 or split in ('train', 'dev')")
    coded = assemble.encode_labels(known, codes, {"deprel": "deprel"})
    return tokens.token_rows(coded, ["deprel"]).withColumnRenamed("deprel", "code")


@query(
    "c4_parents",
    sql("SELECT t.sent_id, t.id, t.head, p.form AS head_form FROM tb t LEFT JOIN tb p ON p.sent_id = t.sent_id AND p.id = t.head", "tb"),
)
def _(spark, sf):
    df = derived.sentences(spark, sf)
    rows = computed(df, head_form=F.transform("head", lambda h: item(F.col("tokens"), h)))
    return tokens.token_rows(rows, ["head", "head_form"])


@query("c5_children", sql("SELECT sent_id, head AS id, id AS child FROM tb WHERE head > 0", "tb"))
def _(spark, sf):
    return trees.child_rows(derived.sentences(spark, sf))


@query("c11_span_pieces", sql("SELECT sent_id, id AS word, pos FROM pc UNION ALL SELECT DISTINCT sent_id, 0, 0 FROM tb UNION ALL SELECT sent_id, max(id) + 1, max(pos) + 1 FROM pc GROUP BY sent_id", "pc", "tb"))
def _(spark, sf):
    return subword.span_pieces(derived.encoded(spark, sf), "token_spans")


@query("c12_adjacency", sql("SELECT sent_id, id AS a, head AS b FROM tb WHERE head > 0 UNION ALL SELECT sent_id, head, id FROM tb WHERE head > 0", "tb"))
def _(spark, sf):
    return trees.adjacency(derived.sentences(spark, sf))


@query("c13_gold_and_predicted", sql("SELECT sent_id, id, head, pred_head, deprel, pred_deprel FROM pred", "pred"))
def _(spark, sf):
    df = derived.sentences(spark, sf)
    gold = df.select("sent_id", "head", "deprel")
    guess = derived.predicted(df).select("sent_id", "pred_head", "pred_deprel")
    return tokens.token_rows(gold.hint("merge").join(guess, "sent_id"), ["head", "pred_head", "deprel", "pred_deprel"])


# --- counts and labels --------------------------------------------------------------------------------


@query(
    "d1_split_sizes",
    sql("SELECT split, count(DISTINCT doc_id) AS docs, count(DISTINCT sent_id) AS sentences, count(*) AS words FROM tb GROUP BY split", "tb"),
)
def _(spark, sf):
    return derived.sentences(spark, sf).groupBy("split").agg(
        F.countDistinct("doc_id").alias("docs"), F.count("*").alias("sentences"), F.sum(F.size("tokens")).alias("words")
    )


@query("d2_corpus_words", CORPUS_WORDS)
def _(spark, sf):
    tables = {n: derived.table(spark, sf, n) for n in ("documents", "benchmark")}
    return texts.word_count(texts.union_corpora(tables), "text", "corpus")


TYPES = sql("SELECT count(DISTINCT w) AS types FROM (SELECT unnest(string_split(line, ' ')) AS w FROM lines)", "lines")


@query("d3_word_types", TYPES)
def _(spark, sf):
    return vocabulary.word_types(derived.lines(spark, sf), "line")


@query(
    "d4_vocabulary_size",
    sql(
        """SELECT types, 8000 + greatest(0, CAST(trunc((types - 15000) * (6000 / 450000.0::DOUBLE)) AS BIGINT)) AS vocab_size
FROM (SELECT count(DISTINCT w) AS types FROM (SELECT unnest(string_split(line, ' ')) AS w FROM lines))""",
        "lines",
    ),
)
def _(spark, sf):
    types = vocabulary.word_types(derived.lines(spark, sf), "line")
    return types.select("types", vocabulary.size_rule(F.col("types")).alias("vocab_size"))


@query("d5_label_inventory", sql(LABELS.format(IN_LABELS, IN_LABELS), "tb"))
def _(spark, sf):
    return assemble.label_inventory(*_split_gold(spark, sf))


@query("d6_label_counts", sql(f"SELECT field, count(*) AS labels FROM ({LABELS.format(IN_LABELS, IN_LABELS)}) GROUP BY field", "tb"))
def _(spark, sf):
    return assemble.label_counts(assemble.label_inventory(*_split_gold(spark, sf)))


@query("d7_first_seen", "SELECT event_type AS label, min(event_id) AS first_row FROM events GROUP BY event_type")
def _(spark, sf):
    return assemble.first_seen(derived.table(spark, sf, "events").withColumnRenamed("event_type", "label"), "label", "event_id")


# --- sets, order, samples -----------------------------------------------------------------------------


@query(
    "f1_union_all",
    f"""SELECT corpus, md5(text) AS text FROM (SELECT corpus, {stripped_sql('text')} AS text FROM
(SELECT 'documents' AS corpus, text FROM documents UNION ALL SELECT 'benchmark', text FROM benchmark)) WHERE length(text) > 0""",
)
def _(spark, sf):
    tables = {n: derived.table(spark, sf, n) for n in ("documents", "benchmark")}
    return texts.union_corpora(tables).select("corpus", F.md5("text").alias("text"))


@query(
    "f2_append_gold",
    sql("SELECT split, CAST(is_gold AS BIGINT) AS is_gold, count(DISTINCT sent_id) AS sentences FROM tb WHERE split <> 'dev' GROUP BY split, is_gold", "tb"),
)
def _(spark, sf):
    base, gold = _split_gold(spark, sf)
    return assemble.append_gold(base.where("split <> 'dev'"), gold).groupBy("split", "is_gold").agg(F.count("*").alias("sentences"))


@query("f3_label_union", sql("SELECT deprel AS label FROM tb WHERE is_gold = 0 UNION SELECT deprel FROM tb WHERE is_gold = 1", "tb"))
def _(spark, sf):
    base, gold = _split_gold(spark, sf)
    parts = [assemble.distinct_labels(df, ["deprel"]) for df in (base, gold)]
    return parts[0].union(parts[1]).distinct().select("label")


UPSAMPLED = sql(
    """SELECT sent_id, split, copy FROM (
SELECT g.sent_id, 'train' AS split, unnest(range(0, (target - i) // gold + 1)) AS copy
FROM (SELECT sent_id, row_number() OVER (ORDER BY sent_id) AS i FROM (SELECT DISTINCT sent_id FROM tb WHERE is_gold = 1 AND split = 'train')) g,
     (SELECT count(DISTINCT sent_id) // 8 AS target FROM tb WHERE is_gold = 0 AND split = 'train') b,
     (SELECT count(DISTINCT sent_id) AS gold FROM tb WHERE is_gold = 1 AND split = 'train') c)
UNION ALL SELECT DISTINCT sent_id, split, 0 FROM tb WHERE is_gold = 1 AND split <> 'train'""",
    "tb",
)


@query("f6_upsample", UPSAMPLED)
def _(spark, sf):
    base, gold = _split_gold(spark, sf)
    return assemble.upsample(base.select("sent_id", "split"), gold.select("sent_id", "split")).select("sent_id", "split", "copy")


@query("g1_sorted_labels", sql("SELECT DISTINCT xpos AS label FROM tb ORDER BY label", "tb"))
def _(spark, sf):
    return assemble.distinct_labels(derived.sentences(spark, sf), ["xpos"]).select("label").orderBy("label")


@query("g2_limit", sql("SELECT DISTINCT sent_id, n FROM tb ORDER BY sent_id LIMIT 100", "tb"))
def _(spark, sf):
    return derived.sentences(spark, sf).select("sent_id", F.size("head").alias("n")).orderBy("sent_id").limit(100)


@query(
    "g6_shuffle",
    sql(
        f"SELECT sent_id, split, row_number() OVER (PARTITION BY split ORDER BY {key(repr('epoch'), '3', 'sent_id')}) - 1 AS position FROM (SELECT DISTINCT sent_id, split FROM tb)",
        "tb",
    ),
)
def _(spark, sf):
    return batching.shuffled(derived.sentences(spark, sf).select("sent_id", "split"), 3)


@query("g7_bernoulli", sql(f"SELECT sent_id, id, {draw('sent_id', 'id')} < 644245095 AS drawn FROM tb", "tb"))
def _(spark, sf):
    rows = trees.edges(derived.sentences(spark, sf))
    return rows.select("sent_id", "id", happens(0.15, F.col("sent_id"), F.col("id")).alias("drawn"))


