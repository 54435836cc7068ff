"""Queries of the incremental jobs over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from papertide.plans.registry import query
from papertide.sources.scratch import shared_path
from papertide.streaming import ingest as op
from papertide.streaming.events import arriving

RULES = (("r1", "error", 0.0), ("r2", "click", 50.0), ("r3", "purchase", 90.0), ("r4", "view", 1e9))


@query("st_ingest", "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS events, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1, 2")
def st_ingest(spark, d):
    table = op.ingest(arriving(spark, d), shared_path(spark, "ingested"), shared_path(spark, "ingest-marks"))
    return table.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("events"), F.sum("event_id").alias("ids"))


@query("st_rules", f"WITH r(rule_id, event_type, least) AS (VALUES {', '.join(str(r) for r in RULES)}), h AS (SELECT rule_id, event_id, ts, value, row_number() OVER (PARTITION BY rule_id ORDER BY ts DESC, event_id) AS n FROM events JOIN r USING (event_type) WHERE value >= least) SELECT rule_id, event_id, value FROM h WHERE n <= 200")
def st_rules(spark, d):
    rules = spark.createDataFrame(RULES, "rule_id string, event_type string, least double")
    hits = op.rule_hits(spark, arriving(spark, d), rules, F.col("value") >= F.col("least"), ["event_type"], [F.desc("ts"), F.col("event_id")], 200)
    return hits.select("rule_id", "event_id", "value")


@query("st_hit_state", f"WITH r(rule_id, event_type, least) AS (VALUES {', '.join(str(r) for r in RULES)}) SELECT rule_id, user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS hits FROM events JOIN r USING (event_type) WHERE value >= least GROUP BY 1, 2")
def st_hit_state(spark, d):
    rules = spark.createDataFrame(RULES, "rule_id string, event_type string, least double")
    return op.hit_state(spark, arriving(spark, d), rules, F.col("value") >= F.col("least"), ["event_type"], "user_id", "ts")


@query("st_refresh", "SELECT user_id, count(*) AS events, count(DISTINCT event_type) AS kinds, max(ts) AS last_seen, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1")
def st_refresh(spark, d):
    derive = lambda rows: rows.groupBy("user_id").agg(
        F.count("*").alias("events"), F.countDistinct("event_type").alias("kinds"), F.max("ts").alias("last_seen"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type")
    )
    return op.refresh_changed(spark, arriving(spark, d), "user_id", derive)


@query("st_late", "WITH e AS (SELECT ts AS updated, ts - to_days(CAST(event_id % 40 AS INTEGER)) AS submitted FROM events), m AS (SELECT CAST(min(ts) AS DATE) AS d FROM events) SELECT CAST(updated AS DATE) AS day, count(*) AS records FROM e WHERE CAST(submitted AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-25' OR CAST(updated AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-25' GROUP BY 1")
def st_late(spark, d):
    stream = arriving(spark, d).select(F.col("ts").alias("updated"), F.expr("ts - make_dt_interval(cast(event_id % 40 as int))").alias("submitted"))
    return op.late_records(spark, stream, "2024-01-10", "2024-01-25")
