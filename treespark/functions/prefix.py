"""Running folds and ranks over a whole table without putting a partition's rows into one task.

Rows are laid out in as many ranges as there are tasks. Folds: each range is folded first (map-side), the totals -- a
small table -- are folded in order, and only then does a window run inside each range. Ranks: rows are
numbered per range, and the sizes of the ranges added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from treespark.session import cut_lineage

_FOLDS = {
    "count": (F.count, F.sum, lambda carry, own: F.coalesce(carry, F.lit(0)) + own),
    "sum": (F.sum, F.sum, lambda carry, own: F.coalesce(carry, F.lit(0)) + own),
    "min": (F.min, F.min, lambda carry, own: F.least(carry, own)),
    "max": (F.max, F.max, lambda carry, own: F.greatest(carry, own)),
}


def _laid_out(df: DataFrame, keys: list[str], **extra: Column) -> DataFrame:
    """``df`` in ranges of ``keys``, stored with the number of each row's range, so that a lost executor cannot change it."""
    laid = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return cut_lineage(laid.withColumns({"_task": F.spark_partition_id(), **extra}))


def running(df: DataFrame, partition: list[str], order: list[str], folds: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add running counts, sums, minima or maxima (current row included), per ``partition`` in ``order``.

    ``folds`` maps an output column to (fold, expression). There are as many ranges as tasks, at any size.
    """
    laid = _laid_out(df, [*partition, *order])
    keys = [*partition, "_task"]
    totals = laid.groupBy(*keys).agg(*[_FOLDS[f][0](e).alias(n) for n, (f, e) in folds.items()])
    before = Window.partitionBy(*partition).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[_FOLDS[f][1](F.col(n)).over(before).alias(f"_c_{n}") for n, (f, _) in folds.items()],
    )
    match = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    on = match[0]
    for condition in match[1:]:
        on = on & condition
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = laid.join(carries, on)
    out = {n: _FOLDS[f][2](F.col(f"_c_{n}"), _FOLDS[f][0](e).over(within)) for n, (f, e) in folds.items()}
    return joined.withColumns(out).drop("_task", *carries.columns)


def ranked(df: DataFrame, partition: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Add the 1-based row number per ``partition`` in ``order``; the order must be unique per partition.

    One range exchange lays the rows out in order, and the result is stored with each row's place in its
    task, so a lost executor cannot change the layout. The rank is that place plus the sizes of the tasks
    before: a small table, whose real size lets Spark decide whether to broadcast it.
    """
    keys = [*partition, *order]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    stored = _laid_out(df, keys, _place=place)
    sizes = stored.groupBy("_task", *partition).agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    earlier = Window.partitionBy(*partition).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")
    offsets = cut_lineage(
        sizes.select(*[F.col(k).alias(f"_k_{k}") for k in ("_task", *partition)], before.alias("_before"))
    )
    on = F.col("_task") == F.col("_k__task")
    for k in partition:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    rank = F.col("_place") + F.col("_before") + 1
    return stored.join(offsets, on).withColumn(name, rank).drop("_task", "_place", *offsets.columns)
