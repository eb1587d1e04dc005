"""Helpers of the training-data operators: stored steps, joins that survive hot keys, text in bounded pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treespark.session import cut_lineage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HOT_SHARE = 1000
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and safe from lost executors."""
    return cut_lineage(df)


def ascii_lower(text: Column) -> Column:
    """A-Z lowered, nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text): a document is told by its id and a hash of id and text, whatever integer type the id has."""
    number = F.col("doc_id").cast("bigint")
    return docs.select(number.alias("doc_id"), F.xxhash64(number, "text").alias("key"), F.col("text").alias("text"))


def attach(left: DataFrame, groups: DataFrame, key: str, weight: str, spread: Column, how: str = "left") -> DataFrame:
    """``left`` with the columns of ``groups`` of the same ``key``, however many rows one key has.

    ``groups`` is a stored table of distinct keys; ``weight`` counts the rows of a key. Keys with over a
    ``HOT_SHARE``-th of the counted rows number less than ``HOT_SHARE``, so they are broadcast and their rows
    need no exchange by key: they are dealt by ``spread`` and the rest by the key. The rest is merged at every
    size, so that the rows of ``left`` move once whether ``groups`` is small or not. ``how`` is left or inner.
    Column names of the two tables must differ but for the key.
    """
    values = [c for c in groups.columns if c != key]
    total = groups.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * HOT_SHARE > F.lit(total)
    pack = F.struct(*values)
    hot = groups.where(is_hot).select(F.col(key).alias("_hot_key"), pack.alias("_hot"))
    # Always 0, but no literal: the optimizer would take a literal out of the join keys and deal nothing.
    zero = F.pmod(F.xxhash64(key), F.lit(1)).cast("int")
    cold = groups.where(~is_hot).select(F.col(key).alias("_cold_key"), zero.alias("_cold_part"), pack.alias("_cold")).hint("merge")
    near = left.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left").drop("_hot_key")
    part = F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(1 << 20)).cast("int"))
    dealt = near.withColumn("_part", part)
    joined = dealt.join(cold, (F.col(key) == F.col("_cold_key")) & (F.col("_part") == F.col("_cold_part")), "left")
    found = F.coalesce("_hot", "_cold")
    if how == "inner":
        joined = joined.where(found.isNotNull())
    return joined.select(*left.columns, *[found[c].alias(c) for c in values])


def components(edges: DataFrame) -> DataFrame:
    """(v, component): every vertex of the links (a, b) with the smallest vertex it reaches.

    Each round takes the smallest label among the neighbours and then the label of that label, so
    chains shorten by powers. Labels are stored per round; only a count of changes reaches the driver.
    """
    both = stored(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(
        edges.select(F.col("b").alias("src"), F.col("a").alias("dst"))).distinct())
    labels = stored(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("label")).withColumnRenamed("src", "v"))
    while True:
        near = labels.select(F.col("v").alias("dst"), F.col("label").alias("near"))
        low = both.join(near, "dst").groupBy("src").agg(F.min("near").alias("low"))
        new = stored(labels.join(low, F.col("v") == F.col("src"), "left").select(
            "v", F.col("label").alias("old"), F.least("label", "low").alias("label")))
        up = new.select(F.col("v").alias("_up"), F.col("label").alias("_top"))
        jumped = stored(new.join(up, F.col("label") == F.col("_up"), "left").select(
            "v", "old", F.least("label", "_top").alias("label")))
        changed = jumped.where("old <> label").limit(1).count()
        labels = jumped.select("v", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")


def pieces_of(raw: bytes, size: int = PIECE) -> Iterator[bytes]:
    """``raw`` in pieces of about ``size`` bytes that end before an ASCII white space."""
    start = 0
    while len(raw) - start > size:
        cut = SPACE.search(raw, start + size)
        if not cut:
            break
        yield raw[start : cut.start()]
        start = cut.start()
    yield raw[start:]
