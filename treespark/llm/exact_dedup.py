"""Exact dedup: group by a 128-bit content hash, keep one row per group, compare bytes inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treespark.llm.common import ascii_lower, attach, stored

#: Rows of a group that are compared with one copy of its kept text.
COMPARED = 1000


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
    normalise=ascii_lower, digest=F.md5,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    Texts are equal when their normalised bytes are. Rows are grouped by the 128-bit ``digest``; the row with
    the smallest (or largest) id stays. In groups of several rows every text is compared with the kept one;
    digests with unequal texts are grouped by the whole text instead, so a collision never joins two texts.
    Only narrow rows are grouped: unique texts move once, for the comparison. The rows of a hot group are
    compared in parts, each with its own copy of the kept text.

    A null text counts as empty, and all empty texts are equal. A null id stays only where its group has no id.
    Rows that repeat an id and its text are one document: all are marked alike and count in ``group_size``.
    An empty table gives no rows. Other columns are not read, so their names may be anything.
    """
    pick = {"smallest": F.min, "largest": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("doc_id"), normalise(F.col(text_col)).alias("norm"))
    keyed = rows.withColumn("h", digest("norm"))
    narrow = stored(keyed.select("doc_id", "h", F.sha2("norm", 256).alias("text_sha256")))
    groups = stored(
        narrow.groupBy("h").agg(F.count("*").alias("group_size"), pick("doc_id").alias("keep_id")).where("group_size > 1"))
    spread = F.struct("doc_id")
    texts = attach(keyed, groups, "h", "group_size", spread, "inner")
    odd = stored(unequal(texts).distinct())
    plain = attach(narrow, groups, "h", "group_size", spread)
    if odd.isEmpty():
        return marked(plain)
    clash = attach(keyed, groups.join(odd, "h", "left_semi"), "h", "group_size", spread, "inner").select(
        "doc_id", "norm", F.sha2("norm", 256).alias("text_sha256"))
    whole = clash.groupBy("norm").agg(F.count("*").alias("group_size"), pick("doc_id").alias("keep_id"))
    split = clash.join(whole, "norm").select("doc_id", "text_sha256", "keep_id", "group_size")
    return marked(plain.join(odd, "h", "left_anti")).unionByName(marked(split))


def unequal(texts: DataFrame) -> DataFrame:
    """(h) of the groups in which some text differs from that of the kept row."""
    part = lambda x: F.pmod(x, F.expr(f"group_size div {COMPARED} + 1"))
    heads = texts.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("h").agg(
        F.min("norm").alias("kept_text"), F.first("group_size").alias("group_size"))
    copies = heads.select("h", "kept_text", F.explode(F.expr(f"sequence(0, group_size div {COMPARED})")).alias("part"))
    rows = texts.select("h", "norm", part(F.xxhash64("doc_id")).alias("part"))
    return rows.join(copies, ["h", "part"]).where(F.col("norm") != F.col("kept_text")).select("h")


def marked(df: DataFrame) -> DataFrame:
    """The columns of the result; a row without a group is its own."""
    alone = F.col("group_size").isNull()
    keep_id: Column = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return df.select(
        "doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were.

    A document is told by its id and text, so an id that stands on several texts is several documents.
    Of rows that repeat the id and text of the kept row, one stays.
    """
    decided = exact_dedup(docs, keep=keep).where("kept and group_size > 1")
    ones = stored(decided.groupBy("text_sha256").agg(F.max("keep_id").alias("_keep"), F.count("*").alias("_n"),
                                                     F.max("group_size").alias("_size")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"),
                       F.sha2(ascii_lower(F.col("text")), 256).alias("text_sha256"))
    told = attach(rows, ones, "text_sha256", "_size", F.struct("_id"))
    kept = told.where(F.col("_size").isNull() | F.col("_id").eqNullSafe(F.col("_keep")))
    once = kept.where("_n is null or _n = 1").select("_row")
    several = kept.where("_n > 1").groupBy("text_sha256").agg(F.first("_row").alias("_row")).select("_row")
    return once.unionByName(several).select("_row.*")
