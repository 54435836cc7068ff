"""Incremental jobs: ingest from the last safe position, rules on arrivals, refresh of what changed, late records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papertide.sources.scratch import shared_path
from papertide.streaming.buckets import AppendedTable, KeyedTable, replaced


def ingest(stream: DataFrame, path: str, marks: str, write: Callable[[DataFrame, int, str], None] | None = None) -> DataFrame:
    """Appends what is available to the table at ``path`` and returns the table; ``marks`` keeps the position.

    A batch is a folder of its own that its number names. If it fails its position is not committed: the next call reads the same files and
    writes the same folder again, so nothing is lost and nothing counted twice.
    """

    def put(df: DataFrame, number: int) -> None:
        (write or (lambda batch, _, target: batch.write.mode("overwrite").parquet(target)))(df, number, f"{path}/batch={number}")

    query = stream.writeStream.option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/batch=*")


def match_rules(arrived: DataFrame, rules: DataFrame, condition: Column, key: list[str], order: list[Column], top: int) -> DataFrame:
    """For each rule (``rule_id`` and the columns ``condition`` needs) the first ``top`` arrivals it matches, the limit taken inside the arrivals.

    ``key`` are the columns that rule and arrival share; the rules are a small table that the optimizer may broadcast."""
    hits = arrived.join(rules, key).filter(condition)
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy("rule_id").orderBy(*order))).filter(F.col("_n") <= top).drop("_n")


def distinct_observations(spark: SparkSession, stream: DataFrame, source: str, record: str, payload: list[str]) -> DataFrame:
    """The rows of ``stream`` with ``payload_hash``, once for each source, record and hash of the payload, however often they arrive.

    The keys seen are streaming state in RocksDB: a batch looks up its own keys and no earlier rows. The state grows with the distinct
    observations, which the table holds too; a watermark is not set, so a copy that comes a year later is still known.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    hashed = stream.withColumn("payload_hash", F.sha2(F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}), 256))
    return ingest(hashed.dropDuplicates([source, record, "payload_hash"]), shared_path(spark, "observations"), shared_path(spark, "observation-marks"))


def hit_state(spark: SparkSession, stream: DataFrame, rules: DataFrame, condition: Column, key: list[str], target: str, time: str) -> DataFrame:
    """rule_id, ``target``, first_seen, last_seen, hits of each rule and target: streaming state in update mode, of which the last row of each key counts."""
    state = stream.join(rules, key).filter(condition).groupBy("rule_id", target).agg(F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.count("*").alias("hits"))
    path = shared_path(spark, "hit-state")
    query = state.writeStream.outputMode("update").option("checkpointLocation", shared_path(spark, "hit-marks")).trigger(availableNow=True)
    query.foreachBatch(lambda df, number: df.write.mode("overwrite").parquet(f"{path}/batch={number}")).start().awaitTermination()
    stored = spark.read.schema(state.schema).parquet(f"{path}/batch=*")
    return stored.groupBy("rule_id", target).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("hits").alias("hits"))


def rule_hits(spark: SparkSession, stream: DataFrame, rules: DataFrame, condition: Column, key: list[str], order: list[Column], top: int) -> DataFrame:
    """The hits of all batches of a stream: rules see each arrival once, in the batch that brings it."""
    path = shared_path(spark, "rule-hits")

    def put(df: DataFrame, number: int, target: str) -> None:
        match_rules(df, rules, condition, key, order, top).write.mode("overwrite").parquet(target)

    schema = match_rules(spark.createDataFrame([], stream.schema), rules, condition, key, order, top).schema
    ingest(stream, path, shared_path(spark, "rule-marks"), put)
    return spark.read.schema(schema).parquet(f"{path}/batch=*")


def refresh_changed(spark: SparkSession, stream: DataFrame, key: str, derive: Callable[[DataFrame], DataFrame], path: str | None = None, buckets: int = 64) -> DataFrame:
    """A table derived from all rows that have arrived, made anew in each batch only for the keys that the batch brings.

    Rows and table lie in buckets of the key's hash. A batch reads the rows of the buckets it touches, gives ``derive`` all rows of the changed keys,
    and rewrites only those buckets of the table, so what it reads and writes follows the batch and not what has arrived before. A batch
    that is run again gives the same table. ``path`` keeps rows, table and position for later calls; a new one is taken if it is not given.
    """
    path = path or shared_path(spark, "refreshed")
    arrived = AppendedTable(spark, f"{path}/rows", [key], stream.schema, buckets)
    derived = KeyedTable(spark, f"{path}/table", [key], buckets=buckets)

    def put(df: DataFrame, number: int) -> None:
        df = df.persist()
        arrived.append(number, df)
        only, changed = arrived.touched(df), df.select(key).distinct()
        seen = arrived.read(number, only)
        wanted = changed.withColumnRenamed(key, "_key")
        new = derive(seen.join(wanted, F.col(key).eqNullSafe(F.col("_key")), "left_semi"))
        derived.schema = new.schema
        derived.rewrite(number, replaced(derived.read(number - 1, only), new, changed, [key]), only)
        df.unpersist()

    query = stream.writeStream.option("checkpointLocation", f"{path}/marks").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    last = _last_batch(spark, path)
    return derive(spark.createDataFrame([], stream.schema)) if last < 0 else derived.read(last)


def _last_batch(spark: SparkSession, path: str) -> int:
    """Number of the last batch whose manifest stands, -1 if none does."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/table/manifest")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return -1
    return max((int(x.getPath().getName()) for x in files.listStatus(folder)), default=-1)


def in_window(records: DataFrame, submitted: str, updated: str, first: str, last: str) -> DataFrame:
    """Records that were submitted or updated inside the window: a late update of an old record counts."""
    inside = lambda c: F.to_date(c).between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return records.filter(F.coalesce(inside(submitted), F.lit(False)) | F.coalesce(inside(updated), F.lit(False)))


def late_records(spark: SparkSession, stream: DataFrame, first: str, last: str, delay: str = "30 days") -> DataFrame:
    """day, records: kept records by the day of their event time, the later of ``submitted`` and ``updated``, with a watermark on it.

    Batches add partial counts that are summed on reading, so a record behind the watermark still counts."""
    timed = in_window(stream, "submitted", "updated", first, last).withColumn("event_time", F.greatest("submitted", "updated")).withWatermark("event_time", delay)
    path = shared_path(spark, "late")

    def put(df: DataFrame, number: int, target: str) -> None:
        df.groupBy(F.to_date("event_time").alias("day")).agg(F.count("*").alias("records")).write.mode("overwrite").parquet(target)

    ingest(timed, path, shared_path(spark, "late-marks"), put)
    return spark.read.schema("day date, records long").parquet(f"{path}/batch=*").groupBy("day").agg(F.sum("records").alias("records"))
