"""Rows of one key over batches out of order give what the batch operators give."""

import datetime as dt
import time

import numpy as np
import pandas as pd
from pyspark.sql import Row
from pyspark.sql import functions as F

from sedimenta.operators import runs, scan
from sedimenta.streaming import ordered

START = dt.datetime(2024, 6, 1)


def stream_of(spark, at, parts, kind):
    """A stream of one file a batch, in order."""
    for rows in parts:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{at}/in")
        time.sleep(1.1)  # files are taken by their time
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")


def emitted(spark, stream, at):
    with ordered.rocksdb(spark):
        query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out"), [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_throttle_across_batches(spark, tmp_path):
    rows = [(f"k{i % 3}", START + dt.timedelta(milliseconds=137 * i), None if i % 17 == 0 else float(i % 10)) for i in range(240)]
    mixed = [rows[i::4] for i in range(4)]  # each batch has rows between those of the others
    end = [("z", START + dt.timedelta(minutes=30), 0.0)]
    kind = "key string, ts timestamp, value double"
    live, _ = emitted(spark, ordered.throttle_in_order(stream_of(spark, tmp_path, [*mixed, end], kind), 0.5, 5, "1 minute"), tmp_path)
    batch = spark.createDataFrame(rows, kind)
    want = scan.moving_mean(batch, "key", ["ts"], "value", 5)
    want = scan.throttle(want, "key", "ts", "value", 0.5)
    near = lambda df: sorted((r["key"], r["ts"], -1.0 if r["value"] is None else r["value"], round(r["mean"] or 0, 9)) for r in df.collect())
    assert near(live) == near(want) and live.count() > 50


def test_throttle_state_ends(spark, tmp_path):
    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    parts = [[("a", at(0), 1.0), ("b", at(1), 1.0)], [("c", at(60), 1.0)], [("a", at(0), 9.0), ("c", at(90), 1.0)], [("d", at(120), 1.0)]]
    live, state = emitted(spark, ordered.throttle_in_order(stream_of(spark, tmp_path, parts, "key string, ts timestamp, value double"), 0.5, 5, "5 minutes"), tmp_path)
    assert sorted((r["key"], r["ts"]) for r in live.collect()) == [("a", at(0)), ("b", at(1)), ("c", at(60)), ("c", at(90))]  # a's second row is an hour late, d waits
    assert state[-1] < max(state) + 1 and state[-1] <= 4


def test_run_results_equal_the_batch_operators(spark, tmp_path):
    rows = []
    for run in range(4):
        for i in range(30):
            tool = run == 2 and i == 20
            rows.append((run, i, START + dt.timedelta(seconds=20 * run, milliseconds=170 * i), "tool" if tool else "chunk", None if tool else "" if i % 4 == 0 else f"w{i} "))
    rows.append((5, 0, START, "tool", None))
    kind = "run_id long, seq long, ts timestamp, kind string, chunk string"
    mixed = [rows[i::3][::-1] for i in range(3)]
    end = [(9, 0, START + dt.timedelta(hours=2), "chunk", "late")]
    live, _ = emitted(spark, ordered.run_results(stream_of(spark, tmp_path, [*mixed, end], kind), "10 minutes", "2 minutes", 23), tmp_path)
    got = {r["run_id"]: r for r in live.collect()}
    batch = spark.createDataFrame(rows, kind)
    texts = {r["run_id"]: r["output"] for r in runs.assemble_output(batch).collect()}
    start = batch.groupBy("run_id").agg(F.min("ts").alias("start_ts")).withColumn("max_tokens", F.lit(23))
    want = {r["run_id"]: r for r in runs.generation_metrics(batch, start).collect()}
    assert sorted(got) == sorted(want) == [0, 1, 2, 3, 5]
    for run, w in want.items():
        assert (got[run]["tokens"], got[run]["truncated"], got[run]["output"]) == (w["total_tokens"], w["truncated"], texts.get(run, ""))
        assert (got[run]["last_ts"] - got[run]["first_ts"]).total_seconds() == w["seconds"]


class Counted:
    """A handle that keeps what it is given and counts the calls."""

    def __init__(self):
        self.calls, self.rows, self.timers = 0, [], []

    def getListState(self, *_):
        return self

    def getValueState(self, *_):
        return Counted()

    def exists(self):
        self.calls += 1
        return bool(self.rows)

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def appendList(self, rows):
        self.calls += 1
        self.rows += rows

    def clear(self):
        self.calls += 1
        self.rows = []

    def listTimers(self):
        self.calls += 1
        return iter(self.timers)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class At:
    def __init__(self, mark):
        self.mark = mark

    def getCurrentWatermarkInMs(self):
        return self.mark


def test_a_run_asks_its_state_little():
    handle, run = Counted(), ordered.RunResults(1000)
    run.init(handle)
    row = lambda seq, seconds, tool, chunk: Row(seq=seq, micros=int(seconds * 1e6), tool=tool, chunk=chunk)
    list(run.handleInputRows((1,), iter([row(2, 5, False, "b"), row(1, 3, False, "a"), row(4, 4, True, "")]), None))
    list(run.handleInputRows((1,), iter([row(3, 5.5, False, ""), row(5, 2, False, "z")]), None))
    assert handle.calls == 4 and len(handle.rows) == 2 and handle.timers == [6000, 6500]
    assert list(run.handleExpiredTimer((1,), At(6400), None)) == [] and handle.rows  # the first timer is behind the last row
    assert list(run.handleExpiredTimer((1,), At(6501), None)) == [Row(run_id=1, tokens=3, first=2_000_000, last=5_500_000, output="ab")]
    assert list(run.handleExpiredTimer((1,), At(9000), None)) == []


def test_waiting_rows_are_packed():
    handle, throttle = Counted(), ordered.OrderedThrottle(10, 3, 1000)
    throttle.init(handle)
    n = 200_000
    throttle.handleInputRows(("k",), iter([pd.DataFrame({"ts": pd.to_datetime(np.arange(n) * 7, unit="us"), "value": np.arange(n, dtype=float)})]), None)
    assert len(handle.rows) == 4 and sum(len(a) for a, _ in handle.rows) == 8 * n and handle.calls == 3
