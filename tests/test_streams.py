"""Streams over several files equal their batch twins."""

import datetime as dt
import random

from pyspark.sql import functions as F

from quillmetric.operators import telemetry
from quillmetric.session import new_work_path
from quillmetric.streaming import jobs, stateful

SCHEMA = "id bigint, who string, ts timestamp, failed boolean"


def files(spark, tmp_path, parts=3):
    rng = random.Random(8)
    start = dt.datetime(2024, 1, 1)
    data = [(i, rng.choice(["a", "a", "b"]), start + dt.timedelta(minutes=i), rng.random() < 0.8) for i in range(90)]
    import os
    import time
    for p in range(parts):
        part = data[p * len(data) // parts:(p + 1) * len(data) // parts]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"raw{p}"))
        name = next(f for f in os.listdir(tmp_path / f"raw{p}") if f.endswith(".parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        target = tmp_path / "in" / f"{p}.parquet"
        target.write_bytes((tmp_path / f"raw{p}" / name).read_bytes())
        os.utime(target, (time.time() - 100 + p, time.time() - 100 + p))
    return data, jobs.file_stream(spark, str(tmp_path / "in"), "*.parquet", spark.createDataFrame([], SCHEMA).schema, 1)


def test_breaker_survives_batches(spark, tmp_path):
    data, stream = files(spark, tmp_path)
    work = new_work_path(spark, "t")
    jobs.run_to_end(stateful.breaker_stream(stream, ["who"], "ts", "id", "failed"), f"{work}/out", f"{work}/cp")
    rows = spark.read.parquet(f"{work}/out").collect()
    twin = telemetry.failure_streaks(spark.createDataFrame(data, SCHEMA), ["who"], "ts", "id", "failed", F.date_trunc("hour", "ts"))
    assert {r["id"]: r["streak"] for r in rows} == {r["id"]: r["streak"] for r in twin.collect()} and len(rows) == 90
    assert all(r["deny_next"] == (r["streak"] >= telemetry.BREAK_AT) for r in rows)


def test_upsert_and_counts_across_batches(spark, tmp_path):
    data, stream = files(spark, tmp_path)
    work = new_work_path(spark, "t")
    rows = stream.selectExpr("who", "id", "id AS first", "CASE WHEN id % 7 = 0 THEN id END AS known")
    merged = stateful.merged_stream(rows.withColumn("seq", F.col("id")), "who", {"id": "new", "first": "old", "known": "new_else_old"}, "seq")
    stateful.log_changes(merged, f"{work}/log", f"{work}/cp")
    ids = {w: [i for i, who, _t, _f in data if who == w] for w in ("a", "b")}
    assert sorted(tuple(r) for r in stateful.latest_rows(spark, f"{work}/log", "who").collect()) == sorted(
        (w, max(v), min(v), max(i for i in v if i % 7 == 0)) for w, v in ids.items())
    assert spark.read.parquet(f"{work}/log").select("batch").distinct().count() == 3
    assert jobs.counts_so_far(spark, f"{work}/added").count() == 0
    ids = {"posts": F.col("id"), "authors": F.col("who"), "odd": F.when(F.col("id") % 2 == 1, F.col("id"))}
    jobs.running_counts(stream, ids, f"{work}/cp2", f"{work}/added")
    assert {r["kind"]: r["total"] for r in jobs.counts_so_far(spark, f"{work}/added").collect()} == {"posts": 90, "authors": 2, "odd": 45}


def test_sketched_counts_keep_a_state_of_one_size(spark, tmp_path):
    """Twenty batches of 2,000 new ids each, a quarter of an hour apart; intervals of an hour, a watermark of ten minutes."""
    schema = "id bigint, ts timestamp"
    for p in range(20):
        batch = spark.range(p * 2000, (p + 1) * 2000).selectExpr(
            "id", f"timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, {15 * p}, 0) AS ts")
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    work = new_work_path(spark, "t")
    stream = jobs.file_stream(spark, str(tmp_path / "in"), "*.parquet", spark.createDataFrame([], schema).schema, 1)
    kinds = {"ids": F.col("id"), "tens": F.col("id") % 10, "none": F.lit(None)}
    done = stateful.log_changes(jobs.sketched_counts(stream, "ts", kinds, "1 hour", "10 minutes"), f"{work}/log", f"{work}/cp")
    held = [p["stateOperators"][0]["numRowsTotal"] for p in done.recentProgress if p["stateOperators"]]
    assert len(held) >= 20 and max(held) <= 4  # two kinds, two open intervals
    log = jobs.batch_log(spark, f"{work}/log", "start timestamp, kind string, sketch binary")
    got = {r["kind"]: r["total"] for r in jobs.sketched_totals(log).collect()}
    assert set(got) == {"ids", "tens"} and got["tens"] == 10 and abs(got["ids"] - 40000) <= 40000 * 0.02
    assert max(r["n"] for r in log.select(F.length("sketch").alias("n")).collect()) <= 70_000
    again = log.unionByName(log)  # a repeated batch
    assert {r["kind"]: r["total"] for r in jobs.sketched_totals(again).collect()} == got


def test_late_rows_go_aside(spark, tmp_path):
    _, stream = files(spark, tmp_path)
    work = new_work_path(spark, "t")
    seen = {"ok": 0, "late": 0}

    def count(kind):
        def handle(df, _number):
            seen[kind] += df.count()
        return handle

    jobs.split_late(stream.withColumn("ts", F.when(F.col("id") == 80, F.lit(dt.datetime(2023, 1, 1))).otherwise(F.col("ts"))),
                    "ts", f"{work}/cp", f"{work}/newest", count("ok"), count("late"))
    assert seen == {"ok": 89, "late": 1}


def test_breaker_counts_many_sessions_in_one_call(spark, tmp_path):
    """Sessions of a group share a call; keys of any type, nulls and ids beyond 53 bits come out as they went in."""
    schema = "id bigint, who bigint, at string, day date, ts timestamp, failed boolean"
    rng, start, big = random.Random(5), dt.datetime(2024, 1, 1), 2 ** 60
    data = [(None if i == 7 else big + i, rng.choice([None, big + 1, big + 2, 3]), rng.choice([None, "x", "y"]), rng.choice([None, dt.date(2024, 1, 1)]),
             None if i % 40 == 9 else start + dt.timedelta(minutes=i), rng.choice([True, True, True, False, None])) for i in range(600)]
    for p in range(3):  # rows without time come last in their batch
        spark.createDataFrame(data[200 * p:200 * (p + 1)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{p}"))
    for groups, keys in ((1, ["who", "at"]), (3, ["at", "day", "who"])):
        work = new_work_path(spark, "t")
        for p in range(3):
            spark.read.parquet(str(tmp_path / f"in/{p}")).write.mode("append").parquet(f"{work}/in")
            stream = jobs.file_stream(spark, f"{work}/in", "*.parquet", spark.createDataFrame([], schema).schema)
            jobs.run_to_end(stateful.breaker_stream(stream, keys, "ts", "id", "failed", groups=groups), f"{work}/out", f"{work}/cp")
        open_runs, expected = {}, []
        for p in range(3):
            for r in sorted(data[200 * p:200 * (p + 1)], key=lambda r: (r[4] is None, r[4] or start, r[0] is None, r[0] or 0)):
                session = tuple(r[["id", "who", "at", "day"].index(k)] for k in keys)
                open_runs[session] = open_runs.get(session, 0) + 1 if r[5] else 0
                expected.append((r[0], *session, open_runs[session], open_runs[session] >= telemetry.BREAK_AT))
        got = [tuple(r) for r in spark.read.parquet(f"{work}/out").select("id", *keys, "streak", "deny_next").collect()]
        assert sorted(got, key=str) == sorted(expected, key=str)


def test_breaker_state_is_one_row_per_group_of_sessions(spark, tmp_path):
    spark.range(2000).selectExpr("id", "id AS who", "timestamp '2024-01-01' AS ts", "true AS failed").write.parquet(str(tmp_path / "in"))
    work = new_work_path(spark, "t")
    stream = jobs.file_stream(spark, str(tmp_path / "in"), "*.parquet", spark.createDataFrame([], "id bigint, who bigint, ts timestamp, failed boolean").schema)
    jobs.run_to_end(stateful.breaker_stream(stream, ["who"], "ts", "id", "failed"), f"{work}/out", f"{work}/cp")
    assert spark.read.format("statestore").load(f"{work}/cp").count() <= 1024
    assert spark.read.parquet(f"{work}/out").filter("streak = 1").count() == 2000
