"""Stored tables under change, and streams on the current state interface."""

import glob
import math
import os

import pytest
from pyspark.sql import functions as F

from reelstack.sources import stored
from reelstack.streaming import event_time


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


@pytest.fixture
def table(spark, tmp_path):
    path = f"{tmp_path}/clips"
    rows = [(c, c % 4 if c != 11 else None, f"v{c}", None) for c in range(12)]
    stored.create(spark.createDataFrame(rows, "clip_id long, part long, name string, deleted_at timestamp"), path, "part")
    return path


def rows_of(spark, path):
    return {(r["clip_id"], r["part"]): (r["name"], r["deleted_at"] is not None) for r in stored.read(spark, path).collect()}


def test_upsert_rewrites_its_partitions_only(spark, table):
    before, old = files(table), rows_of(spark, table)
    new = spark.createDataFrame([(1, 1, "new", None), (101, 1, "x", None), (101, 1, "y", None), (11, None, "null part", None)], "clip_id long, part long, name string, deleted_at timestamp")
    assert stored.merge_rows(spark, table, new, ["clip_id", "part"], "part", "b1") == 2
    after, now = files(table), rows_of(spark, table)
    assert now == old | {(1, 1): ("new", False), (101, 1): ("y", False), (11, None): ("null part", False)}
    assert {f for f in before if "part=1/" not in f and "HIVE" not in f} == {f for f in after if "part=1/" not in f and "HIVE" not in f and after[f] == before.get(f)}
    # the same batch again, then as if it had been broken off before it was noted
    assert stored.merge_rows(spark, table, new, ["clip_id", "part"], "part", "b1") == 0 and files(table) == after
    stored.merge_rows(spark, table, new, ["clip_id", "part"], "part", "b1 again")
    assert rows_of(spark, table) == now and stored.read(spark, table).count() == len(now)


def test_insert_if_absent_keeps_what_is_stored(spark, table):
    old, before = rows_of(spark, table), files(table)
    new = spark.createDataFrame([(1, 1, "new", None), (6, 2, "new", None)], "clip_id long, part long, name string, deleted_at timestamp")
    assert stored.merge_rows(spark, table, new, ["clip_id", "part"], "part", "i1", replace=False) == 0
    assert rows_of(spark, table) == old and files(table) == before
    more = new.union(spark.createDataFrame([(50, 2, "added", None)], new.schema))
    assert stored.merge_rows(spark, table, more, ["clip_id", "part"], "part", "i2", replace=False) == 1
    assert rows_of(spark, table) == old | {(50, 2): ("added", False)}


def test_soft_delete_of_stored_rows(spark, table):
    before, old = files(table), rows_of(spark, table)
    ids = spark.createDataFrame([(4,), (8,), (999,)], "clip_id long")
    assert stored.delete_softly(spark, table, ids, "clip_id", "part", F.timestamp_seconds(F.lit(60)), "d1") == 1
    now = rows_of(spark, table)
    assert now == old | {(4, 0): ("v4", True), (8, 0): ("v8", True)}
    assert all(files(table).get(f) == t for f, t in before.items() if "part=0/" not in f)
    first = stored.read(spark, table).where("clip_id = 4").first()
    stored.delete_softly(spark, table, ids, "clip_id", "part", F.timestamp_seconds(F.lit(99)), "d2")
    assert stored.read(spark, table).where("clip_id = 4").first() == first


def test_late_beats_and_timers(spark, tmp_path):
    beats = lambda rows: spark.createDataFrame(rows, "key string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    day = "2024-01-01 "
    parts = [
        beats([("a", day + "00:00:00"), ("b", day + "00:00:00"), ("a", day + "00:05:00"), ("late", day + "00:30:00")]),
        beats([("a", day + "00:02:00"), ("late", day + "00:29:00"), ("clock", day + "03:00:00")]),
        beats([("b", day + "00:01:00"), ("late", day + "04:00:00"), ("clock", day + "05:00:00")]),
        beats([("clock", day + "09:00:00")]),
    ]
    os.mkdir(f"{tmp_path}/in")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = event_time.expired_stream(spark.readStream.schema(part.schema).parquet(f"{tmp_path}/in"), 600, watermark="10 minutes")
        query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out")
        query.awaitTermination(120)
        assert query.exception() is None
    got = [(r["key"], r["last_beat"].strftime("%H:%M"), r["expired_at"].strftime("%H:%M:%S")) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    whole = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    want = {(r["key"], r["last_beat"].strftime("%H:%M"), r["expired_at"].strftime("%H:%M:%S")) for r in event_time.expired_batch(whole.where("not (key = 'b' and ts > '2024-01-01 00:00:30')"), 600, until="2024-01-01 08:50:00").collect()}
    assert len(got) == len(set(got)) and set(got) == want


def test_buckets_and_percentiles(spark, tmp_path):
    values = [0.0, -1.0, 1e-9, 2**-10, 1.0, 1.0000001, 2.0, 3.3, 1e6, 2.0**15, 2.0**15 * 1.01, *[2 ** (k / 4) for k in range(-40, 61)]]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = {r["v"]: r["b"] for r in df.select("v", event_time.bucket(F.col("v")).alias("b")).collect()}
    assert got == {v: sum(b < v for b in event_time.BOUNDS) for v in values} | {None: None}
    rows = [(f"2024-01-01 0{h}:{m:02d}:00", p, None if m == 7 else float(h * m % 17)) for h in range(3) for m in range(0, 60, 7) for p in ("a", "b")]
    reqs = spark.createDataFrame(rows, "ts string, path string, duration double").withColumn("ts", F.col("ts").cast("timestamp"))
    end = spark.createDataFrame([("2024-01-02 00:00:00", "z", 0.0)], "ts string, path string, duration double").withColumn("ts", F.col("ts").cast("timestamp"))
    reqs.union(end).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = event_time.latency_buckets(spark.readStream.schema(reqs.schema).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("buckets").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    streamed = {tuple(r) for r in event_time.latency_summary(spark.table("buckets"), "hour", "path").collect()}
    assert streamed == {tuple(r) for r in event_time.latency_summary(event_time.latency_buckets(reqs, None), "hour", "path").collect()}
    for r in event_time.latency_summary(event_time.latency_buckets(reqs, None), "path").collect():
        held = sorted(v for _, p, v in rows if p == r["path"] and v is not None)
        at = held[math.ceil(len(held) * 0.95) - 1]
        assert r["p95"] == round(min(b for b in event_time.BOUNDS if b >= at), 6) and r["n"] == sum(p == r["path"] for _, p, _ in rows)
