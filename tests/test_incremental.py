"""Incremental jobs: replay after a failure, refresh over several batches, late records."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from papertide.streaming import ingest as op

SCHEMA = "id long, owner string, submitted timestamp, updated timestamp"


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{folder}")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")


DAY = dt.datetime(2024, 1, 1)
FIRST = [(1, "a", DAY, DAY), (2, "b", DAY, DAY + dt.timedelta(days=40))]
SECOND = [(3, "a", DAY + dt.timedelta(days=90), None), (4, "c", None, DAY)]


def test_a_failed_batch_is_read_again(spark, tmp_path):
    folder, table, marks = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/marks"
    arrive(spark, folder, FIRST)
    assert op.ingest(stream(spark, folder), table, marks).count() == 2
    arrive(spark, folder, SECOND)

    def fail(df, number, target):
        df.write.mode("overwrite").parquet(target)
        raise OSError("the provider broke off")

    with pytest.raises(Exception, match="broke off"):
        op.ingest(stream(spark, folder), table, marks, fail)
    assert sorted(r["id"] for r in op.ingest(stream(spark, folder), table, marks).collect()) == [1, 2, 3, 4]
    assert op.ingest(stream(spark, folder), table, marks).count() == 4  # nothing new, nothing twice


def test_only_changed_keys_are_derived_anew(spark, tmp_path):
    arrive(spark, tmp_path / "in", FIRST)
    arrive(spark, tmp_path / "in", SECOND)
    seen = []

    def derive(rows):
        seen.append(sorted(r["owner"] for r in rows.select("owner").distinct().collect()))
        return rows.groupBy("owner").agg(F.count("*").alias("n"))

    got = {r["owner"]: r["n"] for r in op.refresh_changed(spark, stream(spark, tmp_path / "in"), "owner", derive).collect()}
    assert got == {"a": 2, "b": 1, "c": 1} and seen in ([["a", "b"], ["a", "c"]], [["a", "c"], ["a", "b"]])


def test_updates_of_old_records_stay(spark):
    rows = spark.createDataFrame(FIRST + SECOND + [(5, "d", None, None)], SCHEMA)
    assert sorted(r["id"] for r in op.in_window(rows, "submitted", "updated", "2024-02-01", "2024-02-29").collect()) == [2]
    assert sorted(r["id"] for r in op.in_window(rows, "submitted", "updated", "2024-01-01", "2024-01-01").collect()) == [1, 2, 4]


def test_rule_limit_is_inside_the_arrivals(spark):
    rows = spark.createDataFrame([(i, "a", DAY + dt.timedelta(days=i), None) for i in range(6)] + [(9, "z", DAY, None)], SCHEMA)
    rules = spark.createDataFrame([("r", "a", 2), ("s", "b", 0)], "rule_id string, owner string, least long")
    found = op.match_rules(rows, rules, F.col("id") >= F.col("least"), ["owner"], [F.desc("submitted")], 3)
    assert sorted(r["id"] for r in found.collect()) == [3, 4, 5]


def files(folder):
    return {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    derive = lambda rows: rows.groupBy("owner").agg(F.count("*").alias("n"), F.max("id").alias("last"))
    folder, path = tmp_path / "in", f"file://{tmp_path}/kept"
    run = lambda: {r["owner"]: (r["n"], r["last"]) for r in op.refresh_changed(spark, stream(spark, folder), "owner", derive, path, 16).collect()}
    first = [(i, f"o{i % 100}", DAY, DAY) for i in range(1000)] + [(5000, None, DAY, DAY)]
    arrive(spark, folder, first)
    assert run() == {f"o{k}": (10, 900 + k) for k in range(100)} | {None: (1, 5000)}
    before = files(tmp_path / "kept/table/data")
    arrive(spark, folder, [(2000, "o7", DAY, DAY), (2001, None, DAY, DAY), (2002, "new", DAY, DAY)])
    got = run()
    assert got == {f"o{k}": (10, 900 + k) for k in range(100) if k != 7} | {"o7": (11, 2000), None: (2, 5000), "new": (1, 2002)}
    after = files(tmp_path / "kept/table/data")
    assert all(after[p] == before[p] for p in before)
    new = set(after) - set(before)
    assert 1 <= len({p.parent.name for p in new}) <= 3 and len({p.parent.name for p in before}) > 10
    assert sum(p.stat().st_size for p in new) < 0.5 * sum(p.stat().st_size for p in before)
    assert run() == got  # nothing has arrived: nothing is written
    assert files(tmp_path / "kept/table/data") == after


def test_observations_are_kept_once(spark, tmp_path):
    rows = [(1, "a", DAY, DAY), (1, "a", DAY, DAY), (1, "a", DAY, None), (1, "b", DAY, DAY), (None, "a", DAY, DAY)]
    for part in (rows[:2], rows[1:4], rows, rows[4:]):
        arrive(spark, tmp_path / "in", part)
    got = op.distinct_observations(spark, stream(spark, tmp_path / "in"), "owner", "id", ["submitted", "updated"]).collect()
    assert len(got) == 4 == len({(r["owner"], r["id"], r["payload_hash"]) for r in got})


def test_hits_are_counted_a_rule_and_target(spark, tmp_path):
    arrive(spark, tmp_path / "in", FIRST)
    arrive(spark, tmp_path / "in", [(1, "a", DAY, DAY + dt.timedelta(days=2)), (9, "a", DAY, DAY)])
    rules = spark.createDataFrame([("r", "a", 1), ("s", "a", 5), ("t", "z", 0)], "rule_id string, owner string, least long")
    got = op.hit_state(spark, stream(spark, tmp_path / "in"), rules, F.col("id") >= F.col("least"), ["owner"], "id", "updated").collect()
    assert sorted((r["rule_id"], r["id"], r["hits"], (r["last_seen"] - r["first_seen"]).days) for r in got) == [("r", 1, 2, 2), ("r", 9, 1, 0), ("s", 9, 1, 0)]
