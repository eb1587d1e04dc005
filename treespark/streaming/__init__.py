"""The operators that carry over to Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from treespark.operators.metriclog import validation_metric
from treespark.sources.text import tokens_of_lines


def stream_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Tokens of every line of the files that arrive under ``path`` (stateless)."""
    return tokens_of_lines(spark.readStream.text(path))


def stream_metric_log(spark: SparkSession, path: str, schema: str, files: int | None = None) -> DataFrame:
    """(run, step, metric): running mean per validation pass over an appended log (use update mode).

    A micro-batch takes at most ``files`` new files.
    """
    reader = spark.readStream.schema(schema)
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    return validation_metric(reader.parquet(path))


def drain(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write all that is available to Parquet, then stop. Both folders must be shared by all executors."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def drain_updates(stream: DataFrame, keys: list[str], path: str, checkpoint: str) -> DataFrame:
    """The last state of every key after all that is available was read in update mode.

    A micro-batch writes the keys it changed to a folder of its own number, so that a batch that is repeated after a
    failure replaces what it wrote; the largest number of a key holds its state. Nothing goes through the driver.
    """

    def write(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    states = stream.sparkSession.read.schema(f"{schema}, batch bigint").parquet(path)
    rest = [c for c in stream.columns if c not in keys]
    return states.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in rest])
