"""Streams whose results depend on order: rows wait in list state until the watermark has passed them, and are then taken by time.

The processors run on ``transformWithStateInPandas`` and ``transformWithState``, which need the RocksDB state store (``rocksdb`` sets it for what is started
inside). Rows behind the watermark are dropped by Spark; a key's state ends by a timer.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from sedimenta.operators.scan import let_through
from sedimenta.streaming.streams import milliseconds, recent_means

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streaming queries that are started inside keep their state in RocksDB."""
    was = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, was) if was else spark.conf.unset(_PROVIDER)


class _Timed(StatefulProcessor):
    """One timer per key, at the time of what happens next."""

    def init(self, handle) -> None:
        self.handle = handle

    def wake(self, at: int) -> None:
        """Set the key's timer to ``at`` milliseconds, or leave it if it is earlier."""
        timers = list(self.handle.listTimers())
        if timers and min(timers) <= at:
            return
        for t in timers:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def close(self) -> None:
        pass


#: Rows of one element of a list state.
_PACKED = 1 << 16


class OrderedThrottle(_Timed):
    """State of a key: rows that wait (times and values of many rows as the bytes of arrays, null values as NaN), the last published time and
    the last values, and the last time released."""

    def __init__(self, gap: int, keep: int, idle: int):
        self.gap, self.keep, self.idle = gap, keep, idle

    def init(self, handle) -> None:
        super().init(handle)
        self.waiting = handle.getListState("waiting", "micros binary, value binary")
        self.gate = handle.getValueState("gate", "last long, seen long, recent array<double>")

    @staticmethod
    def packed(micros: np.ndarray, values: np.ndarray) -> list[tuple[bytes, bytes]]:
        return [(micros[i : i + _PACKED].tobytes(), values[i : i + _PACKED].tobytes()) for i in range(0, len(micros), _PACKED)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            micros = pdf["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
            self.waiting.appendList(self.packed(micros, pdf["value"].to_numpy(dtype=float)))
            self.wake(int(micros.min()) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = list(self.waiting.get()) if self.waiting.exists() else []
        micros = np.frombuffer(b"".join(bytes(h[0]) for h in held), dtype=np.int64)
        value = np.frombuffer(b"".join(bytes(h[1]) for h in held), dtype=float)
        order = np.lexsort((np.where(np.isnan(value), 0, value), ~np.isnan(value), micros))  # nulls first among equal times
        micros, value = micros[order], value[order]
        n = int(np.searchsorted(micros, mark))
        last, seen, recent = self.gate.get() if self.gate.exists() else (None, 0, [])
        if n:
            times = micros[:n]
            out = let_through(times, np.array([0]), last, self.gap) if self.gap > 0 else np.ones(n, dtype=bool)
            values = np.concatenate([np.array([np.nan if v is None else v for v in recent], dtype=float), value[:n]])
            means = recent_means(values, n, self.keep)
            last = int(times[out][-1]) if out.any() else last
            seen, recent = int(times[-1]), [None if np.isnan(v) else float(v) for v in values[-self.keep :]]
            self.gate.update((last, seen, recent))
            self.waiting.put(self.packed(micros[n:], value[n:])) if n < len(micros) else self.waiting.clear()
            shown = value[:n][out]
            yield pd.DataFrame({"key": key[0], "ts": pd.to_datetime(times[out], unit="us"), "value": pd.Series(shown).astype(object).where(~np.isnan(shown), None), "mean": means[out]})
        if n < len(micros):
            self.handle.registerTimer(int(micros[n]) // 1000 + 1)
        elif mark >= seen + self.idle * 1000:
            self.gate.clear()
        else:
            self.handle.registerTimer(seen // 1000 + self.idle)


def throttle_in_order(stream: DataFrame, seconds: float = 0.5, keep: int = 30, late: str = "10 minutes") -> DataFrame:
    """(key, ts, value, mean): rows of (key, ts, value) at least ``seconds`` after their key's last published one, with the mean of the
    last ``keep`` values, nulls aside. Rows are taken by time, whichever batch brought them: each waits until the watermark, ``late`` behind the
    stream's last time, has passed it. What is emitted is thus what the batch throttle gives for the rows before the watermark.
    Equal times go by value. A key without rows for ``late`` (``seconds`` at least) leaves the state and starts anew."""
    gap = int(np.ceil(round(seconds * 1e6, 3)))
    idle = max(milliseconds(late), gap // 1000 + 1)
    slim = stream.where("ts IS NOT NULL").withWatermark("ts", late).select(F.col("key").cast("string").alias("key"), "ts", F.col("value").cast("double").alias("value"))
    return slim.groupBy("key").transformWithStateInPandas(OrderedThrottle(gap, keep, idle), "key string, ts timestamp, value double, mean double", "Append", "EventTime")


class RunResults(StatefulProcessor):
    """State of a run: an element for each of its batches, with the tokens, the first and last time, and the events that count for the output.

    A call to the state costs more than a run's rows, so a batch makes two: it appends its element and sets a timer for the time at which the run
    has ended, should no later batch have rows of it. A timer that finds later rows, or nothing, does nothing. Rows come and go as they are,
    since a pandas frame for every run costs more still.
    """

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", "tokens long, first long, last long, seq array<long>, tool array<boolean>, chunk array<string>")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        events = [(r["seq"], r["micros"], r["tool"], r["chunk"]) for r in rows]
        if events:
            first, last = min(e[1] for e in events), max(e[1] for e in events)
            kept = [(s, t, c) for s, _, t, c in events if t or c]
            seq, tool, chunk = map(list, zip(*kept, strict=True)) if kept else ([], [], [])
            self.parts.appendList([(sum(not t for t in tool), first, last, seq, tool, chunk)])
            self.handle.registerTimer(last // 1000 + self.idle)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        parts = list(self.parts.get())
        if not parts:
            return
        first, last = min(p[1] for p in parts), max(p[2] for p in parts)
        if timerValues.getCurrentWatermarkInMs() <= last // 1000 + self.idle:
            return
        self.parts.clear()
        tokens, text = sum(p[0] for p in parts), []
        for _, tool, chunk in sorted((e for p in parts for e in zip(p[3], p[4], p[5], strict=True)), key=lambda e: (e[0], not e[1])):
            if tool:
                break
            text.append(chunk)
        yield Row(run_id=key[0], tokens=tokens, first=first, last=last, output="".join(text))


def run_results(stream: DataFrame, idle: str = "10 minutes", late: str = "0 seconds", max_tokens: int = 1000) -> DataFrame:
    """One row per run, when it has had no event for ``idle`` by the watermark, ``late`` behind the stream: tokens (chunks that aren't empty), first
    and last time, tokens_per_second, truncated, and output: its chunks by seq, up to the first tool call. Events are run_id, seq, ts, kind, chunk, in any
    order and over any batches; a run's state is its chunks, which ``max_tokens`` of the generation bound, and goes with the row."""
    tool = F.coalesce(F.col("kind") == "tool", F.lit(False)).alias("tool")
    slim = stream.where("ts IS NOT NULL").withWatermark("ts", late).select("run_id", F.col("seq").cast("long").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), tool, F.coalesce("chunk", F.lit("")).alias("chunk"), "ts")
    kind = f"run_id {stream.schema['run_id'].dataType.simpleString()}, tokens long, first long, last long, output string"
    ended = slim.groupBy("run_id").transformWithState(RunResults(milliseconds(idle)), kind, "Append", "EventTime")
    seconds = (F.col("last") - F.col("first")) / 1e6
    return ended.select("run_id", "tokens", F.timestamp_micros("first").alias("first_ts"), F.timestamp_micros("last").alias("last_ts"), F.when(seconds > 0, F.col("tokens") / seconds).alias("tokens_per_second"), (F.col("tokens") >= max_tokens).alias("truncated"), "output")
