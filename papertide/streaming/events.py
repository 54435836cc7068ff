"""Incremental jobs over the event log as Structured Streaming queries.

A file source with a checkpoint reads what has arrived and stops (``availableNow``); a failed batch is
not committed and is read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papertide.sources.scratch import shared_path


def arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a stream; ``ts`` becomes a timestamp, which watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def run_available(spark: SparkSession, stream: DataFrame, name: str, mode: str, batch) -> str:
    """Feeds what is available to ``batch(df, id, path)``; the path holds one folder a batch."""
    path, marks = shared_path(spark, name), shared_path(spark, f"{name}-marks")
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(lambda df, i: batch(df, i, path)).start()
    query.awaitTermination()
    return path


def _overwrite(df: DataFrame, number: int, path: str) -> None:
    """Idempotent: a batch that is run again writes its own folder again."""
    df.write.mode("overwrite").parquet(f"{path}/batch={number}")


def _read(spark: SparkSession, path: str, df: DataFrame) -> DataFrame:
    return spark.read.schema(df.schema).parquet(f"{path}/batch=*")


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type, start, events, value by week. Batches add partial sums, which are summed on reading, so
    late rows are never lost and the state is one batch's groups."""
    week = F.window("ts", "7 days")
    stream = arriving(spark, sf_dir)
    sums = lambda df: df.groupBy("event_type", week.alias("w")).agg(F.count("*").alias("events"), F.sum("value").alias("value")).select("event_type", F.col("w.start").alias("start"), "events", "value")
    path = run_available(spark, stream, "tumbling", "append", lambda df, i, p: _overwrite(sums(df), i, p))
    return spark.read.parquet(f"{path}/batch=*").groupBy("event_type", "start").agg(F.sum("events").alias("events"), F.sum("value").alias("value"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, first_seen, last_seen, hits of the events that a rule matches: streaming state, update mode;
    the last state of each key counts."""
    state = arriving(spark, sf_dir).filter("event_type = 'error' or value < 20").groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("hits"))
    path = run_available(spark, state, "hits", "update", _overwrite)
    return spark.read.parquet(f"{path}/batch=*").groupBy("user_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("hits").alias("hits"))
