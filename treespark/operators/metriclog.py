"""Metric logs: (run, epoch, step, val_step, value) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treespark.functions.prefix import running


def validation_metric(log: DataFrame, aggregate: bool = True) -> DataFrame:
    """(run, step, metric): the mean over a pass, or the value of its last batch."""
    metric = F.avg("value") if aggregate else F.max_by("value", "val_step")
    return log.groupBy("run", "step").agg(metric.alias("metric"))


def worker_mean(log: DataFrame, *keys: str) -> DataFrame:
    """Mean value over workers per key and step."""
    return log.groupBy(*keys).agg(F.avg("value").alias("value"), F.count("*").alias("workers"))


def running_mean(log: DataFrame) -> DataFrame:
    """Add ``running_mean``: the mean of a pass up to and including each validation batch."""
    folds = {"_sum": ("sum", F.col("value")), "_count": ("count", F.col("value"))}
    rows = running(log, ["run", "step"], ["val_step"], folds)
    return rows.withColumn("running_mean", F.col("_sum") / F.col("_count")).drop("_sum", "_count")


def best_so_far(metrics: DataFrame, minimize: bool = True) -> DataFrame:
    """Add ``best`` (running best) and ``is_best``; a value equal to the best so far counts as best.

    The value itself is part of the running best, so it is a best one exactly if it equals it.
    """
    rows = running(metrics, ["run"], ["step"], {"best": ("min" if minimize else "max", F.col("metric"))})
    return rows.withColumn("is_best", F.col("metric") == F.col("best"))


def checkpointed(metrics: DataFrame, every: int) -> DataFrame:
    """The rows at which a checkpoint is due."""
    return metrics.where((F.col("step") + 1) % every == 0)


def validation_steps(steps: DataFrame, every: int | None = None) -> DataFrame:
    """(run, epoch, step): the last step of a run, and every ``every``-th step or else each epoch's last.

    ``steps`` holds (run, epoch, step) rows; ends are found by aggregation, not by looking ahead in order.
    """
    distinct = steps.select("run", "epoch", "step").distinct()
    run_end = distinct.groupBy("run").agg(F.max("step").alias("step"))
    if every is None:
        due = distinct.groupBy("run", "epoch").agg(F.max("step").alias("step"))
        return due
    due = distinct.where((F.col("step") + 1) % every == 0)
    return due.unionByName(distinct.join(run_end, ["run", "step"], "left_semi")).distinct()


def kept_checkpoints(metrics: DataFrame, minimize: bool = True) -> DataFrame:
    """(run, best_step, latest_step) of the checkpoints to keep; the later of equal ones is the best."""
    value = -F.col("metric") if minimize else F.col("metric")
    return metrics.groupBy("run").agg(
        F.max_by("step", F.struct(value, F.col("step"))).alias("best_step"), F.max("step").alias("latest_step")
    )


def nan_alarm(log: DataFrame) -> DataFrame:
    """The rows whose value is not a number."""
    return log.where(F.isnan("value"))


# Fixed value: the weight of the replaced-token term in the total loss.
TERM_WEIGHTS = {"rtd": 50.0}


def total_loss(terms: DataFrame, weights: dict[str, float] | None = None, *keys: str) -> DataFrame:
    """Weighted sum of the named loss terms per key; a term without a weight counts once."""
    weight: Column = F.lit(1.0)
    for name, value in (TERM_WEIGHTS if weights is None else weights).items():
        weight = F.when(F.col("term") == name, value).otherwise(weight)
    return terms.groupBy(*(keys or ("step",))).agg(F.sum(weight * F.col("value")).alias("loss"))
