"""Projections and filters between sentence rows and token rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treespark.functions.arrays import computed, posexploded
from treespark.functions.draws import draw_key


def token_rows(df: DataFrame, fields: list[str], *keep: str) -> DataFrame:
    """One row per word with its id (from 1) and the given array columns' values."""
    zipped = F.arrays_zip(*fields)
    rows = df.select("sent_id", *keep, posexploded(zipped).alias("i", "t"))
    return rows.select("sent_id", *keep, (F.col("i") + 1).alias("id"), *[F.col(f"t.{f}").alias(f) for f in fields])


def sentence_rows(df: DataFrame, fields: list[str], *keys: str) -> DataFrame:
    """Token rows gathered into aligned arrays in id order, one row per sentence."""
    gathered = df.groupBy("sent_id", *keys).agg(
        F.sort_array(F.collect_list(F.struct("id", *fields))).alias("_rows")
    )
    return gathered.select("sent_id", *keys, *[F.col("_rows")[f].alias(f) for f in fields])


def is_integer_id(column: Column) -> Column:
    """True for plain word ids, false for ranges (1-2) and empty nodes (3.1)."""
    return column.rlike("^[0-9]+$")


def cast_heads(df: DataFrame, column: str = "head") -> DataFrame:
    """Head strings as integers; a range or an empty-node id in them is an error."""
    return df.withColumn(
        column,
        F.transform(
            column,
            lambda h: F.when(h.rlike("[.-]"), F.raise_error(F.concat(F.lit("not a plain head id: "), h)))
            .otherwise(h)
            .cast("int"),
        ),
    )


def with_default(column: str, default: str = "") -> Column:
    """The text column with ``default`` for null."""
    return F.coalesce(F.col(column), F.lit(default))


def with_default_items(column: str, default: str = "") -> Column:
    """The array column with ``default`` for every null element."""
    return F.transform(column, lambda x: F.coalesce(x, F.lit(default)))


def length_differences(old: DataFrame, new: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(sent_id, old_size, new_size) of the sentences whose word count differs between two tables."""
    left = old.select("sent_id", F.size(tokens).alias("old_size"))
    right = new.select("sent_id", F.size(tokens).alias("new_size"))
    return left.hint("merge").join(right, "sent_id").where(F.col("old_size") != F.col("new_size"))


def require_equal_lengths(df: DataFrame, left: str, right: str) -> DataFrame:
    """Fail on the first row whose two arrays differ in length."""
    message = F.concat(F.lit("different lengths in sentence "), F.col("sent_id").cast("string"))
    checked = F.when(F.size(left) == F.size(right), F.col(left)).otherwise(F.raise_error(message))
    return computed(df, **{left: checked})


def preview(df: DataFrame, key: str) -> DataFrame:
    """The first row by key."""
    return df.orderBy(key).limit(1)


def random_per_split(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """One row per split: the one with the smallest draw. Folded on the map side, no sort."""
    row = F.struct(*df.columns)
    best = df.groupBy("split").agg(F.min_by(row, draw_key(F.col(key), seed=seed)).alias("r"))
    return best.select("r.*")
