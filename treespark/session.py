"""Session helpers: local sessions for tests and benches, shared storage, input spreading."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: str = "*", name: str = "treespark", **conf: str) -> SparkSession:
    """A session for one machine. On a cluster the caller brings its own session."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    settings = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        # Local tables are tiny: keep one task per core where a cluster would merge small partitions.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "32k",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Temporary folders of local sessions without the setting, by application.
_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, from ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_DIRS:  # the setting itself cannot be changed in a running session
        _LOCAL_DIRS[application] = tempfile.mkdtemp(prefix="treespark-")
    return _LOCAL_DIRS[application]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, so that lost executors recompute nothing before it.

    One job writes it; a checkpoint would compute the rows twice.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition an input that has fewer partitions than the cluster has cores.

    Large tables have many row groups and pass through untouched; only a table that sits in
    one small file is redistributed.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, key: str, weight: Column, most: int) -> DataFrame:
    """``df`` dealt by ``key`` into parts of about ``most`` of the summed ``weight``, which says what a row grows to later.

    What is made of the rows of a part is so already together by the key: groups by it, or by it and more, are formed without
    another exchange, and what they sort fits in memory. ``df`` is stored, to be weighed first. The number of parts is fixed, as
    adaptive execution would merge them by the size the rows have before they grow.
    """
    kept = cut_lineage(df)
    return kept.repartition(parts(kept, weight, most), key)


def parts(df: DataFrame, weight: Column, most: int) -> int:
    """Into how many parts ``dealt`` deals these rows."""
    total = df.agg(F.sum(weight)).first()[0] or 0
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(total / most))
