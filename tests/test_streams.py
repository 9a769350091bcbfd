"""Streams that are drained give what the batch operators give."""

import datetime as dt
import time

from pyspark.sql import functions as F

from sedimenta.operators import scan, search
from sedimenta.streaming import drain, streams


def folder(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i % 3, start + dt.timedelta(milliseconds=170 * i), "tool" if i % 11 == 0 else "chunk", "" if i % 4 == 0 else "w", float(i)) for i in range(120)]
    spark.createDataFrame(rows, "run_id long, ts timestamp, kind string, chunk string, value double").coalesce(1).write.parquet(f"{tmp_path}/t/rows.parquet")
    return f"{tmp_path}/t"


def stream(spark, at):
    return spark.readStream.schema(spark.read.parquet(f"{at}/rows.parquet").schema).parquet(f"{at}/rows.parquet")


def test_metrics_and_windows(spark, tmp_path):
    at = folder(spark, tmp_path)
    batch = spark.read.parquet(f"{at}/rows.parquet")
    got = {r["run_id"]: (r["tokens"], r["truncated"]) for r in drain.drain(streams.stream_generation_metrics(stream(spark, at), max_tokens=28), "update", "run_id").collect()}
    want = batch.where("kind = 'chunk' AND chunk <> ''").groupBy("run_id").count().collect()
    assert got == {r["run_id"]: (r["count"], r["count"] >= 28) for r in want}
    live = drain.drain(streams.stream_tumbling(stream(spark, at), "2 seconds"), "complete").collect()
    assert sum(r["n"] for r in live) == 120 and len(live) == 11


def batches(spark, tmp_path, parts):
    """A stream of one file a batch, in order."""
    kind = "run_id long, ts timestamp, kind string, chunk string, key string, value double"
    for i, rows in enumerate(parts):
        spark.createDataFrame([(r, t, "chunk", "w", str(r), 1.0) for r, t in rows], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files are taken by their time
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def run(stream, mode, at):
    seen = []
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda df, epoch: seen.append(df.collect())).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return [r for rows in seen for r in rows], [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]


def test_state_ends_and_late_rows_are_dropped(spark, tmp_path):
    at = lambda minutes: dt.datetime(2024, 6, 1) + dt.timedelta(minutes=minutes)
    parts = [[(1, at(0)), (2, at(1)), (3, at(2))], [(4, at(60)), (4, at(61))], [(4, at(62)), (5, at(63))], [(1, at(0)), (5, at(64))]]
    rows, state = run(streams.stream_generation_metrics(batches(spark, tmp_path / "m", parts), "10 minutes"), "update", tmp_path / "m")
    last = {}
    for r in rows:
        last[r["run_id"]] = r["tokens"]
    assert last == {1: 1, 2: 1, 3: 1, 4: 3, 5: 2}  # run 1's second event is an hour behind
    assert sum(p["numRowsDroppedByWatermark"] for p in state) == 1
    assert state[0]["numRowsTotal"] == 3 and state[-1]["numRowsTotal"] == 2
    throttled, state = run(streams.stream_throttle(batches(spark, tmp_path / "t", parts).select("key", "ts", "value"), 90.0), "append", tmp_path / "t")
    assert sorted((r["key"], r["ts"]) for r in throttled) == [("1", at(0)), ("2", at(1)), ("3", at(2)), ("4", at(60)), ("4", at(62)), ("5", at(63))]
    assert state[-1]["numRowsTotal"] == 2


def test_throttle(spark, tmp_path):
    at = folder(spark, tmp_path)
    rows = spark.read.parquet(f"{at}/rows.parquet").select(F.col("run_id").cast("string").alias("key"), "ts", "value")
    live = drain.drain(streams.stream_throttle(stream(spark, at).select(F.col("run_id").cast("string").alias("key"), "ts", "value"), 0.9))
    key = lambda df: sorted((r["key"], r["ts"], r["value"]) for r in df.collect())
    assert key(live) == key(scan.throttle(rows, "key", "ts", "value", 0.9))


def test_search(spark, tmp_path):
    index = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "path string, embedding array<double>")
    asked = spark.createDataFrame([(1, "x", [1.0, 0.2]), (2, "  ", [1.0, 0.0]), (3, "y", [0.0, 2.0])], "query_id long, text string, embedding array<double>")
    asked.write.parquet(f"{tmp_path}/q")
    live = drain.drain_search(spark.readStream.schema(asked.schema).parquet(f"{tmp_path}/q"), index, 1)
    assert sorted((r["query_id"], r["path"]) for r in live.collect()) == [(1, "a"), (3, "b")]
    assert search.topk_search(index, asked, 1).count() == 3
