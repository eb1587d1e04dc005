"""Readers and writers on small files."""

import pytest
from pyspark.sql import functions as F

from treespark.operators import tokens
from treespark.operators.annotate import annotate, retokenize
from treespark.sources import catalog, conllu, sinks, stages, text
from treespark.streaming import drain, drain_updates, stream_metric_log, stream_text_lines

CONLLU = (
    "# sent_id = a\n# s_type = decl\n# text = Don't go = stay\n1-2\tDon't\t_\t_\t_\t_\t_\t_\t_\t_\n"
    "1\tDo\tdo\tAUX\tVB\t_\t3\taux\t_\t_\n2\tn't\tnot\tPART\tRB\t_\t3\tadvmod\t_\t_\n3\tgo\tgo\tVERB\t_\t_\t0\troot\t_\t_\n"
    "3.1\tgone\t_\t_\t_\t_\t_\t_\t_\t_\n\n"
    "# s_type = frag\n# text = Yes\n1\tYes\tyes\tINTJ\tUH\t_\t0\troot\t_\t_"
)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "one.conllu").write_text(CONLLU, encoding="utf-8")
    (tmp_path / "deep" / "two.conllu").write_text(CONLLU.replace("\n", "\r\n"), encoding="utf-8", newline="")
    return str(tmp_path)


def test_conllu_words(spark, folder):
    rows = conllu.read_conllu(spark, f"{folder}/one.conllu").orderBy("sent_id").collect()
    assert [r.tokens for r in rows] == [["Do", "n't", "go"], ["Yes"]]
    assert rows[0].xpos == ["VB", "RB", None] and rows[0].head == ["3", "3", "0"] and rows[0].deprel[2] == "root"


def test_conllu_carriage_returns(spark, folder):
    rows = conllu.read_conllu(spark, f"{folder}/deep/two.conllu").collect()
    assert sorted(r.tokens for r in rows) == [["Do", "n't", "go"], ["Yes"]]


def test_conllu_forms_keep_ranges_and_search_folders(spark, folder):
    one = conllu.read_conllu_forms(spark, f"{folder}/one.conllu").collect()
    assert sorted(r.tokens for r in one)[0] == ["Don't", "Do", "n't", "go", "gone"]
    assert conllu.read_conllu_forms(spark, folder).count() == 4


def test_conllu_comments(spark, folder):
    rows = conllu.read_conllu_meta(spark, f"{folder}/one.conllu").collect()
    assert {(r.s_type, r.text) for r in rows} == {("decl", "Don't go = stay"), ("frag", "Yes")}
    df = spark.createDataFrame([("# a = 1\n# b\n# a = 2\n1\tx",)], "block string")
    assert df.select(conllu.meta(F.col("block")).alias("m")).first().m == {"a": "2"}


def test_treebank_needs_three_files(spark, folder, tmp_path):
    with pytest.raises(ValueError, match="exactly three"):
        conllu.read_treebank(spark, folder)
    for split in ("train", "dev", "test"):
        (tmp_path / "tb").mkdir(exist_ok=True)
        (tmp_path / "tb" / f"xx-ud-{split}.conllu").write_text(CONLLU, encoding="utf-8")
    df = conllu.read_treebank(spark, str(tmp_path / "tb"))
    assert {(r.split, r["count"]) for r in df.groupBy("split").count().collect()} == {("train", 2), ("dev", 2), ("test", 2)}


def test_conllu_round_trip(spark, folder, tmp_path):
    df = conllu.read_conllu(spark, f"{folder}/one.conllu")
    sinks.write_conllu(df, str(tmp_path / "out"), {"sent_id": F.col("sent_id")})
    again = conllu.read_conllu(spark, str(tmp_path / "out"), keys=("sent_id",))
    fields = ["tokens", "xpos", "head", "deprel"]
    assert sorted(map(str, again.select(*fields).collect())) == sorted(map(str, df.select(*fields).collect()))


def test_text_lines(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_text("  a  b \n\nc\td e  \n   \n", encoding="utf-8")
    rows = text.read_text_lines(spark, str(path)).orderBy("sent_id").collect()
    assert [r.tokens for r in rows] == [["a", "b"], [], ["c\td e"], []]


def test_labelled_tsv(spark, tmp_path):
    path = tmp_path / "c.tsv"
    path.write_text("gj04\t1\t\tThey drank.\nno tab here\nks08\t0\t*\tThey drank the.\n", encoding="utf-8")
    rows = text.read_labelled_tsv(spark, str(path)).collect()
    assert {(r.source, r.label, r.mark, r.text) for r in rows} == {
        ("gj04", 1, "", "They drank."), ("ks08", 0, "*", "They drank the.")
    }
    path.write_text("a\t1\tb\n", encoding="utf-8")
    with pytest.raises(Exception, match="four tab-separated"):
        text.read_labelled_tsv(spark, str(path)).collect()


def test_head_strings(spark):
    df = spark.createDataFrame([(1, ["0", "1"])], "sent_id bigint, head array<string>")
    assert tokens.cast_heads(df).first().head == [0, 1]
    bad = spark.createDataFrame([(1, ["0", "1.1"])], "sent_id bigint, head array<string>")
    with pytest.raises(Exception, match="not a plain head id"):
        tokens.cast_heads(bad).collect()


def test_equal_lengths(spark):
    df = spark.createDataFrame([(5, [1], [1, 2])], "sent_id bigint, a array<int>, b array<int>")
    with pytest.raises(Exception, match="different lengths in sentence 5"):
        tokens.require_equal_lengths(df, "a", "b").collect()


def test_vocabulary_file(spark, tmp_path):
    vocab = spark.createDataFrame([("b", 1), ("a", 2), ("[PAD]", 0)], "piece string, id int")
    sinks.write_vocab(vocab, str(tmp_path / "v"))
    assert [r.value for r in spark.read.text(str(tmp_path / "v")).collect()] == ["[PAD]", "b", "a"]
    with pytest.raises(ValueError, match="not 0..n-1"):
        sinks.write_vocab(vocab.where("id <> 1"), str(tmp_path / "w"))


def test_stage_is_reused(spark, tmp_path):
    df = spark.createDataFrame([("train", 1), ("dev", 2)], "split string, x int")
    stages.stage(df, str(tmp_path / "s"))
    again = stages.stage(df.where("x > 5"), str(tmp_path / "s"))
    assert {(r.split, r.x) for r in again.collect()} == {("train", 1), ("dev", 2)}


def test_shortcuts():
    assert catalog.shortcut("greek")["code"] == "grc" and catalog.shortcut("wolof")["train"].endswith("wolof/converted_punct/train")
    with pytest.raises(ValueError, match="unknown shortcut"):
        catalog.shortcut("klingon")


def test_parser_must_keep_the_words(spark):
    df = spark.createDataFrame([(1, ["a", "b"])], "sent_id bigint, tokens array<string>")
    short = lambda batch: [[{"id": 1, "head": 0, "deprel": "root", "upos": "X", "xpos": "X"}] for _ in batch]
    with pytest.raises(Exception, match="parser returned 1 of 2 words"):
        annotate(df, short).collect()
    full = lambda batch: [
        [{"id": (1, 2)}] + [{"id": i + 1, "head": i, "deprel": "x", "upos": "U", "xpos": "P"} for i in range(len(s))] for s in batch
    ]
    row = annotate(df, full).first()
    assert row.head == ["0", "1"] and row.lemmas == ["", ""] and row.feats == ["", ""]
    assert retokenize(df, lambda b: [[w for x in s for w in (x, x)] for s in b]).first().tokens == ["a", "a", "b", "b"]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x y\n\nz\n", encoding="utf-8")
    drain(stream_text_lines(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.tokens for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [[], ["x", "y"], ["z"]]
    schema = "run string, step bigint, val_step bigint, value double"
    log = spark.createDataFrame([("r", 1, 0, 1.0), ("r", 1, 1, 3.0)], schema)
    log.write.parquet(str(tmp_path / "log"))
    query = (
        stream_metric_log(spark, str(tmp_path / "log"), schema)
        .writeStream.format("memory").queryName("metric_means").outputMode("update").trigger(availableNow=True)
        .option("checkpointLocation", str(tmp_path / "cp2")).start()
    )
    query.awaitTermination()
    assert [r.metric for r in spark.table("metric_means").collect()] == [2.0]


def test_stream_updates(spark, tmp_path):
    """A pass that goes on in a later micro-batch has one state, its last."""
    schema = "run string, step bigint, val_step bigint, value double"
    for k in range(5):
        spark.createDataFrame([("r", 1, k, float(k)), ("r", k, 9, 1.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = stream_metric_log(spark, str(tmp_path / "log"), schema, files=1)
    state = drain_updates(stream, ["run", "step"], str(tmp_path / "out"), str(tmp_path / "progress"))
    got = {r.step: r.metric for r in state.collect()}
    assert got == {0: 1.0, 1: 11 / 6, 2: 1.0, 3: 1.0, 4: 1.0}
    assert len(list((tmp_path / "out").glob("batch=*"))) >= 5
