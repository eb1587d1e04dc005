"""Trees: edges, closure, subtrees, neighbours, cycle report. Input rows are sentences with a ``head`` array."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from treespark.functions import numbering, trees
from treespark.functions.arrays import exploded, posexploded
from treespark.session import cut_lineage


#: Words of a sentence up to which the paths of its words are made in one task.
SHORT = 1 << 16
SUBTREE = "root int, size int, height int, members array<int>, neighbours array<int>"


@dataclass(frozen=True)
class SubtreeLimits:
    """Sizes (inclusive) of the subtrees used as positive trees."""

    min_size: int = 2
    max_size: int = 10


def edges(df: DataFrame, *keep: str) -> DataFrame:
    """(sent_id, id, head): the parent lookup as rows."""
    return df.select("sent_id", *keep, posexploded(F.col("head")).alias("i", "head")).select(
        "sent_id", *keep, (F.col("i") + 1).alias("id"), "head"
    )


def child_rows(df: DataFrame) -> DataFrame:
    """(sent_id, id, child): the children lookup as rows."""
    kids = df.select("sent_id", F.posexplode(trees.children(F.col("head"))).alias("i", "kids"))
    return kids.select("sent_id", (F.col("i") + 1).alias("id"), exploded(F.col("kids")).alias("child"))


def by_batches(df: DataFrame, keep: tuple[str, ...], batches, made: str) -> DataFrame:
    """Rows made from batches of whole sentences: sent_id, the columns to keep, and what is ``made``."""
    kept = df.select("sent_id", *keep)
    return df.select("sent_id", *keep, "head").mapInArrow(
        partial(batches, keep=kept.columns), StructType([*kept.schema.fields, *StructType.fromDDL(made).fields]))


def subtree_rows(df: DataFrame, *keep: str) -> DataFrame:
    """One row per word: root, size, height, members and neighbours of its subtree. No row holds all subtrees."""
    return by_batches(df, keep, numbering.described_batches, SUBTREE)


def closure(df: DataFrame) -> DataFrame:
    """(sent_id, id, anc, dist): every word with itself and all words above it."""
    return by_batches(df, (), numbering.closure_batches, "id int, anc int, dist int")


def closure_by_joins(arcs: DataFrame, short: int = SHORT) -> DataFrame:
    """(sent_id, id, anc, dist) from (sent_id, id, head) rows, for sentences of any length.

    Arcs are grouped by sentence and by ``short`` ids. Where these are all of a sentence, each id from 1 on once, its paths are
    made in the task as in ``closure``, so that none of them is moved or stored. Longer sentences, and those whose ids
    repeat or have gaps, are doubled by joins: each round joins the pairs known so far to the words 2^k arcs further down, so
    the number of joins is the logarithm of the depth, a row holds one pair, and a long sentence is spread over tasks
    by its words. Each round stores only the pairs it adds.
    Words that hang on a circle, whose paths never end, are left out by the caller; see ``off_tree``.
    """
    block = F.expr(f"(id - 1) div {short}")
    parts = cut_lineage(arcs.groupBy("sent_id", block.alias("_block")).agg(F.sort_array(F.collect_list(F.struct("id", "head"))).alias("_arcs")))
    ids, heads = F.transform("_arcs", lambda x: x["id"].cast("int")), F.transform("_arcs", lambda x: x["head"])
    whole = (ids == F.sequence(F.lit(1), F.size("_arcs"))) & ~F.exists(
        heads, lambda h: h.isNull() | (h > F.size("_arcs")))
    odd = parts.where(F.col("sent_id").isNull() | F.col("_block").isNull() | (F.col("_block") != 0) | ~whole).select(F.col("sent_id").alias("_odd"))
    odd = cut_lineage(odd.distinct())
    same = F.col("sent_id").eqNullSafe(F.col("_odd"))
    kind = arcs.schema["id"].dataType
    short_paths = closure(parts.join(odd, same, "left_anti").select("sent_id", heads.cast("array<int>").alias("head"))).select(
        "sent_id", F.col("id").cast(kind).alias("id"), F.col("anc").cast(kind).alias("anc"), "dist")
    if odd.isEmpty():
        return short_paths
    left = parts.join(odd, same, "left_semi").select("sent_id", F.inline("_arcs"))
    return short_paths.unionByName(_doubled(left))


def _doubled(arcs: DataFrame) -> DataFrame:
    """The closure of arcs by joins of rows."""
    known = cut_lineage(arcs.select("sent_id", "id", F.col("id").alias("anc"), F.lit(0).alias("dist")))
    jumps = cut_lineage(arcs.where("head > 0").select("sent_id", "id", F.col("head").alias("up")))
    step = 1
    while not jumps.isEmpty():
        below = jumps.withColumnRenamed("id", "low").withColumnRenamed("up", "id")
        further = known.join(below, ["sent_id", "id"]).select("sent_id", F.col("low").alias("id"), "anc", (F.col("dist") + step).alias("dist"))
        known = known.unionByName(cut_lineage(further))
        jumps = cut_lineage(jumps.join(below, ["sent_id", "id"]).select("sent_id", F.col("low").alias("id"), "up"))
        step *= 2
    return known


def off_tree_report(df: DataFrame) -> DataFrame:
    """(sent_id, off_tree): sentences with words whose heads never lead to the root, and those words."""
    return df.select("sent_id", trees.off_tree(F.col("head")).alias("off_tree")).where(F.size("off_tree") > 0)


def eligible(head: Column, limits: SubtreeLimits = SubtreeLimits()) -> Column:
    """The subtrees of a fitting size with at least one neighbour. ``head`` must not be a variable of a lambda."""
    return F.arrow_udf(_eligible, f"array<struct<{SUBTREE}>>")(head, F.lit(limits.min_size), F.lit(limits.max_size))


def _eligible(head: pa.Array, least: pa.Array, most: pa.Array) -> pa.Array:
    return numbering.eligible(head, least[0].as_py(), most[0].as_py())


def eligible_subtrees(df: DataFrame, limits: SubtreeLimits = SubtreeLimits(), *keep: str) -> DataFrame:
    """One row per eligible subtree."""
    chosen = df.select("sent_id", *keep, eligible(F.col("head"), limits).alias("_chosen"))
    return chosen.select("sent_id", *keep, exploded(F.col("_chosen")).alias("s")).select("sent_id", *keep, "s.*")


def adjacency(df: DataFrame) -> DataFrame:
    """(sent_id, a, b): every arc in both directions, arcs to the root left out."""
    arcs = edges(df).where("head > 0")
    return arcs.select("sent_id", F.explode(F.array(
        F.struct(F.col("id").alias("a"), F.col("head").alias("b")),
        F.struct(F.col("head").alias("a"), F.col("id").alias("b")),
    )).alias("arc")).select("sent_id", "arc.a", "arc.b")
