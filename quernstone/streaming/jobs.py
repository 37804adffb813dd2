"""Structured Streaming jobs with pluggable sources and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from quernstone.session import work_dir


def file_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's files as a stream, with the schema of a batch read."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{{{name}}}.parquet")  # a pattern, since the table may be one file


def kafka_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """A topic's messages; needs the Kafka connector on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    return reader.option("subscribe", topic).load().select(F.col("key").cast("string"), F.col("value").cast("string"))


def scored_filter(stream: DataFrame, scorer: Callable[[DataFrame], Column], threshold: float) -> DataFrame:
    """Rows that score over the threshold, unchanged but for their ``score``; works on batches and streams."""
    return stream.withColumn("score", scorer(stream)).where(F.col("score") > threshold)


def running_count(stream: DataFrame) -> DataFrame:
    """Rows since the start, for complete mode."""
    return stream.groupBy().agg(F.count(F.lit(1)).alias("cnt"))


def run(stream: DataFrame, state: str, mode: str = "append", every: str | None = None, sink: Callable[[DataStreamWriter], DataStreamWriter] | None = None, batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Start a stream into any sink: ``sink`` sets format and options on the writer, or ``batch`` takes each micro-batch.

    ``state`` is the checkpoint folder. Without ``every`` (a processing-time trigger) the query ends when all that is there is done.
    """
    writer = stream.writeStream.option("checkpointLocation", state).outputMode(mode)
    writer = writer.foreachBatch(batch) if batch else sink(writer)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def kafka_sink(servers: str, topic: str) -> Callable[[DataStreamWriter], DataStreamWriter]:
    """For ``run``: ``key, value`` rows as a topic's messages; needs the Kafka connector on the class path."""
    return lambda writer: writer.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)


def console_sink(rows: int = 20) -> Callable[[DataStreamWriter], DataStreamWriter]:
    return lambda writer: writer.format("console").option("numRows", rows)


def table_sink(path: str) -> Callable[[DataStreamWriter], DataStreamWriter]:
    return lambda writer: writer.format("parquet").option("path", path)


def run_to_table(stream: DataFrame, label: str) -> DataFrame:
    """Run an append-mode stream over all that is there into a Parquet table in the shared folder."""
    spark = stream.sparkSession
    path = work_dir(spark, label)
    run(stream, f"{path}-state", sink=table_sink(path)).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_complete(stream: DataFrame, label: str) -> DataFrame:
    """Run a complete-mode aggregate to the end and return its last state (a few rows)."""
    spark = stream.sparkSession
    path = work_dir(spark, label)
    run(stream, f"{path}-state", "complete", batch=lambda rows, _: rows.write.mode("overwrite").parquet(path)).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def batch_counts(stream: DataFrame, label: str) -> DataFrame:
    """``batch_id, cnt``: rows of each micro-batch. A batch that is run again replaces its own row."""
    spark = stream.sparkSession
    path = work_dir(spark, label)

    def put(rows: DataFrame, number: int) -> None:
        counted = rows.agg(F.count(F.lit(1)).alias("cnt"))
        counted.write.mode("overwrite").parquet(f"{path}/batch_id={number}")

    run(stream, f"{path}-state", batch=put).awaitTermination()
    return spark.read.schema("cnt long, batch_id long").parquet(path).select("batch_id", "cnt")
