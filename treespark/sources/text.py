"""Text sources: sentences by line, labelled TSV, plain corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treespark.functions.arrays import computed
from treespark.functions.text import is_blank, stripped, words


def tokens_of_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Replace a text column by ``tokens``; works on batch and streaming tables. Empty lines stay, as empty arrays."""
    return computed(lines, tokens=words(F.col(column))).drop(column)


def read_text_lines(spark: SparkSession, path: str, split: str = "train") -> DataFrame:
    """(sent_id, split, tokens): one sentence per line.

    Ids follow the order of lines within a file part; store the result to keep them across sessions.
    """
    lines = spark.read.text(path).select(
        F.monotonically_increasing_id().alias("sent_id"), F.lit(split).alias("split"), "value"
    )
    return tokens_of_lines(lines)


def tsv_fields(line: Column) -> Column:
    """The four fields of a labelled line; any other number of fields is an error."""
    fields = F.split(stripped(line), "\t")
    return F.when(F.size(fields) == 4, fields).otherwise(
        F.raise_error(F.concat(F.lit("expected four tab-separated fields: "), line))
    )


def labelled_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(source, label, mark, text) of the lines that contain a tab; label as integer."""
    kept = lines.where(F.contains(F.col(column), F.lit("\t")))
    rows = computed(kept, _f=tsv_fields(F.col(column)))
    return rows.select(
        *[c for c in lines.columns if c != column],
        F.get("_f", F.lit(0)).alias("source"),
        F.get("_f", F.lit(1)).cast("int").alias("label"),
        F.get("_f", F.lit(2)).alias("mark"),
        F.get("_f", F.lit(3)).alias("text"),
    )


def read_labelled_tsv(spark: SparkSession, path: str, split: str = "train") -> DataFrame:
    lines = spark.read.text(path).select(
        F.monotonically_increasing_id().alias("sent_id"), F.lit(split).alias("split"), "value"
    )
    return labelled_lines(lines)


def suitable_texts(corpus: DataFrame, column: str = "text") -> DataFrame:
    """Texts that are not blank, stripped."""
    return corpus.where(~is_blank(F.col(column))).withColumn(column, stripped(F.col(column)))


def union_corpora(corpora: dict[str, DataFrame], column: str = "text") -> DataFrame:
    """(corpus, text) of several tables, suitable texts only."""
    parts = [
        suitable_texts(df.select(F.lit(name).alias("corpus"), F.col(column).alias("text")))
        for name, df in corpora.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_corpora(spark: SparkSession, paths: dict[str, str], column: str = "text") -> DataFrame:
    """(corpus, text) of local copies: Parquet tables, or text files when the path ends in .txt."""
    load = lambda p: (
        spark.read.text(p).withColumnRenamed("value", column) if p.endswith(".txt") else spark.read.parquet(p)
    )
    return union_corpora({name: load(path) for name, path in paths.items()}, column)


def word_count(texts: DataFrame, column: str = "text", *keys: str) -> DataFrame:
    """Number of space-separated words."""
    return texts.groupBy(*keys).agg(F.sum(F.size(F.split(column, " "))).alias("words"), F.count("*").alias("texts"))
