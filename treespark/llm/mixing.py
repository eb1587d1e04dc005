"""Mixing sources to target weights.

Token shares of the sources are raised to an exponent between 0 and 1 and normalised. The exponent is bisected so that the
weights meet a target entropy, or repeat no source too often. The weights are realised as draws: a source is read in
epochs, each a permutation of all its documents, until its part of the budget is used; every draw belongs to a block,
and each block holds the sources in proportion to their weights.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treespark.functions.prefix import ranked
from treespark.llm.common import attach, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Halvings per pass over the sources, and passes.
HALVINGS, PASSES = 5, 7
#: Tokens of a block; documents in a stretch of a permutation, and stretches that are added up together.
BLOCK_TOKENS, STRETCH, TOGETHER = 1 << 20, 500, 1000


def sized(docs: DataFrame) -> DataFrame:
    """(source, doc_id, n_tokens, m): documents with their count of words; equal ones are counted in m."""
    rows = docs.select(
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("doc_id").cast("bigint").alias("doc_id"),
        F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("bigint").alias("n_tokens"))
    return rows.groupBy("source", "doc_id", "n_tokens").agg(F.count("*").alias("m"))


def exponent(sources: DataFrame, max_repeat: float | None, target_entropy: float | None, budget: int | None) -> float:
    """The exponent, to six places; ``sources`` has (source, tokens), all above zero.

    With ``target_entropy`` (bits) the largest exponent whose weights have it. Otherwise the smallest with which no
    source is read more than ``max_repeat`` times, while the budget is used, or without one while every
    source is read at least once. An exponent of 1 is taken if none will do by repetition, 0 if none will by entropy.
    Sums over all sources are taken for many exponents at once; the sources never meet in one place.
    """
    total = sources.agg(F.sum("tokens")).first()[0]
    shares = sources.select((F.col("tokens") / F.lit(float(total))).alias("p"))
    low, high, steps = 0.0, 1.0, 2**HALVINGS
    first = shares.agg(F.min("p").alias("least"), F.max("p").alias("most")).first()

    def too_flat(x: float, z: float, zl: float) -> bool:
        """Whether the exponent must rise (repetition) or may rise (entropy)."""
        if target_entropy is not None:
            return (math.log2(z) - x * zl / z) >= target_entropy
        if budget is None:
            return (first.least / first.most) ** (x - 1) > max_repeat
        return budget / total * first.least ** (x - 1) / z > max_repeat

    def sums(points: list[float]) -> list[tuple[float, float]]:
        row = shares.agg(*[F.sum(F.pow("p", F.lit(x))) for x in points], *[F.sum(F.pow("p", F.lit(x)) * F.log2("p")) for x in points]).first()
        return list(zip(row[: len(points)], row[len(points) :]))

    ends = sums([low, high])
    if not too_flat(low, *ends[0]):
        return low
    if too_flat(high, *ends[1]):
        return high
    for _ in range(PASSES):
        points = [low + (high - low) * k / steps for k in range(1, steps)]
        flat = [too_flat(x, *s) for x, s in zip(points, sums(points))]
        grid = [low, *points, high]
        last = max(k for k, f in enumerate([True, *flat]) if f)
        low, high = grid[last], grid[last + 1]
    return round(low, 6)


def place(epoch: Column, seed: int) -> Column:
    """A number below 2^60 for a document in an epoch: the permutation is their order."""
    name = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), "source", F.col("doc_id").cast("string"))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("bigint")


def started(by_stretch: DataFrame) -> DataFrame:
    """(source, epoch, stretch, skipped): the tokens before each stretch, added up over groups of stretches first."""
    group = F.floor(F.col("stretch") / TOGETHER)
    held = stored(by_stretch.withColumn("group", group))
    groups = held.groupBy("source", "epoch", "group").agg(F.sum("sum").alias("group_sum"))
    all_before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    over_groups = all_before(Window.partitionBy("source", "epoch").orderBy("group"))
    in_group = all_before(Window.partitionBy("source", "epoch", "group").orderBy("stretch"))
    first = groups.select("source", "epoch", "group", F.coalesce(F.sum("group_sum").over(over_groups), F.lit(0)).alias("base"))
    return held.join(first, ["source", "epoch", "group"]).select(
        "source", "epoch", "stretch", (F.col("base") + F.coalesce(F.sum("sum").over(in_group), F.lit(0))).alias("skipped"))


def mix(
    docs: DataFrame, max_repeat: float = 2.0, target_entropy: float | None = None, budget: int | None = None,
    block_tokens: int = BLOCK_TOKENS, seed: int = 42,
) -> DataFrame:
    """(doc_id, source, n_tokens, epoch, start, block, place, weight), one row per draw.

    ``start`` counts the tokens that the source has given before; ``block`` and ``place`` order the draws. Tokens
    are words between white space. Without a budget, it is the least with which every source is read once, so that no
    document is left out. A document is drawn while the source's part of the budget is not used up.

    A null text counts as empty: it takes nothing from the budget and comes with its neighbours. A source without any
    tokens is read once, in block 0. A null source is one of empty name. A null id is an id like others. Repeated
    rows are drawn each. Ties of place fall to the smaller id. An empty table gives no rows.
    Running sums are taken within short stretches of a permutation and over the sums of stretches, so that a source
    with most of the rows meets in no task.
    """
    units = stored(sized(docs))
    per_source = stored(units.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("m")).alias("tokens"), F.sum("m").alias("rows")))
    full = per_source.where("tokens > 0")
    if full.isEmpty():
        wanted = per_source.select("source", "tokens", "rows", F.lit(0.0).alias("weight"), F.lit(0).cast("bigint").alias("quota"))
        blocks = 1
    else:
        x = exponent(full.select("source", "tokens"), max_repeat, target_entropy, budget)
        total = full.agg(F.sum("tokens")).first()[0]
        raised = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total)), F.lit(x))).otherwise(0.0)
        mass = per_source.agg(F.sum(raised)).first()[0]
        weighed = per_source.withColumn("weight", raised / F.lit(mass))
        if budget is None:
            budget = weighed.where("tokens > 0").agg(F.max(F.col("tokens") / F.col("weight"))).first()[0]
        wanted = weighed.withColumn("quota", F.floor(F.lit(float(budget)) * F.col("weight") + 0.5))
        blocks = max(1, int(-(-budget // block_tokens)))
    plans = wanted.select(
        "source", "tokens", "weight", "quota",
        F.when(F.col("tokens") == 0, 1).otherwise(F.floor(F.col("quota") / F.col("tokens"))).cast("bigint").alias("whole"),
        F.when(F.col("tokens") == 0, 1).otherwise(F.ceil(F.col("quota") / F.col("tokens"))).cast("bigint").alias("epochs"),
        F.ceil(F.col("rows") / F.lit(STRETCH)).cast("bigint").alias("stretches"), "rows")
    planned = attach(units, stored(plans), "source", "rows", F.col("doc_id"), "inner")
    drawn = planned.where("epochs > 0").withColumn("epoch", F.explode(F.expr("sequence(0L, epochs - 1L)")))
    drawn = drawn.withColumn("place", place(F.col("epoch"), seed))
    cut = F.shiftright(F.shiftright(F.col("place"), 30) * F.col("stretches"), 30)
    drawn = stored(drawn.withColumn("stretch", cut).select(
        "source", "doc_id", "n_tokens", "m", "tokens", "weight", "quota", "whole", "epoch", "place", "stretch"))
    starts = started(drawn.groupBy("source", "epoch", "stretch").agg(F.sum(F.col("n_tokens") * F.col("m")).alias("sum")))
    inside = Window.partitionBy("source", "epoch", "stretch").orderBy("place", "doc_id", "n_tokens").rowsBetween(
        Window.unboundedPreceding, -1)
    running = drawn.join(starts, ["source", "epoch", "stretch"]).withColumn(
        "ahead", F.coalesce(F.sum(F.col("n_tokens") * F.col("m")).over(inside), F.lit(0)))
    each = running.withColumn("copy", F.explode(F.expr("sequence(0L, m - 1L)")))
    start = F.col("epoch") * F.col("tokens") + F.col("skipped") + F.col("ahead") + F.col("copy") * F.col("n_tokens")
    told = each.withColumn("start", start).where((F.col("epoch") < F.col("whole")) | (F.col("start") < F.col("quota")))
    block = F.when(F.col("quota") == 0, 0).otherwise(
        F.least(F.floor(F.col("start") * F.lit(float(blocks)) / F.col("quota")), F.lit(blocks - 1)))
    return told.select("doc_id", "source", "n_tokens", "epoch", "start", block.cast("bigint").alias("block"), "place", "weight")


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with as many rows of each document as it is drawn, all columns as they were.

    Documents are told by source, id and length; repeated rows share their draws evenly, and what is left over goes to
    the first of them, one each, so that there are as many rows as draws.
    """
    key = F.xxhash64("source", "doc_id", "n_tokens")
    counts = mix(docs, **settings).groupBy("source", "doc_id", "n_tokens").agg(F.count("*").alias("times"))
    times = stored(counts.select(key.alias("_key"), F.col("times").alias("_times")).groupBy("_key").agg(F.sum("_times").alias("_times")))
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    length = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("bigint")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.xxhash64(source, F.col("doc_id").cast("bigint"), length).alias("_key"))
    same = stored(rows.groupBy("_key").agg(F.count("*").alias("_same")).where("_same > 1"))
    told = attach(rows, times.join(same, "_key", "left").select("_key", "_times", F.coalesce("_same", F.lit(1)).alias("_same")).transform(stored),
                  "_key", "_same", F.col("_row"), "inner")
    once = told.where("_same = 1").select("_row", F.col("_times").cast("int").alias("_share"))
    repeated = ranked(stored(told.where("_same > 1").withColumn("_at", F.monotonically_increasing_id())), ["_key"], ["_at"], "_rank")
    share = F.expr("_times div _same") + (F.col("_rank") <= F.col("_times") % F.col("_same")).cast("int")
    shared = once.unionByName(repeated.select("_row", share.cast("int").alias("_share")))
    return shared.select(F.explode(F.array_repeat("_row", F.col("_share"))).alias("_row")).select("_row.*")
