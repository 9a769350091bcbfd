"""Live metrics of generation runs, and search for a stream of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from sedimenta.operators.scan import let_through
from sedimenta.operators.search import fix_index, topk_search


def milliseconds(interval: str) -> int:
    return int(pd.Timedelta(interval).total_seconds() * 1000)


def _keep_until(state, last_micros: int, late: int) -> None:
    """The state goes when the watermark is ``late`` milliseconds past the key's last event."""
    state.setTimeoutTimestamp(max(last_micros // 1000 + late, state.getCurrentWatermarkMs() + 1))


def stream_generation_metrics(stream: DataFrame, late: str = "10 minutes", max_tokens: int = 1000) -> DataFrame:
    """Per run, in update mode, whenever a batch has events of it: tokens (chunks that aren't empty), first and last time,
    tokens_per_second, truncated. A run's state is three numbers. Events behind the watermark are dropped, and a run without events
    for ``late`` leaves the state; should it go on after that, it starts anew."""
    idle = milliseconds(late)

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, first, last = state.get if state.exists else (0, None, None)
        for pdf in batches:
            micros = pdf["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
            tokens += int(pdf["filled"].sum())
            first = int(micros.min()) if first is None else min(first, int(micros.min()))
            last = int(micros.max()) if last is None else max(last, int(micros.max()))
        state.update((tokens, first, last))
        _keep_until(state, last, idle)
        seconds = (last - first) / 1e6
        times = pd.to_datetime([first, last], unit="us")
        yield pd.DataFrame({"run_id": [key[0]], "tokens": [tokens], "first_ts": times[:1], "last_ts": times[1:], "tokens_per_second": [tokens / seconds if seconds > 0 else None], "truncated": [tokens >= max_tokens]})

    filled = F.coalesce((F.col("kind") == "chunk") & (F.length("chunk") > 0), F.lit(False)).cast("long").alias("filled")
    kind = f"run_id {stream.schema['run_id'].dataType.simpleString()}, tokens long, first_ts timestamp, last_ts timestamp, tokens_per_second double, truncated boolean"
    slim = stream.where("ts IS NOT NULL").withWatermark("ts", late).select("run_id", "ts", filled)
    return slim.groupBy("run_id").applyInPandasWithState(run, kind, "tokens long, first long, last long", "update", GroupStateTimeout.EventTimeTimeout)


def stream_tumbling(stream: DataFrame, every: str = "2 seconds", late: str = "10 minutes", value: str = "value") -> DataFrame:
    """Rows and mean value of each tumbling window."""
    return (
        stream.withWatermark("ts", late)
        .groupBy(F.window("ts", every).alias("w"))
        .agg(F.count("*").alias("n"), F.avg(value).alias("mean_value"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean_value")
    )


def search_batches(index: DataFrame, k: int, sink: Callable[[DataFrame, int], None], key: str = "path") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch of queries (query_id, text, embedding) is searched in a fixed index; queries with a blank text
    are ignored. The index is written once, when this is called; a batch moves its queries and their best hits only."""
    fixed = fix_index(index, key)

    def run(batch: DataFrame, epoch: int) -> None:
        asked = batch.where(F.trim(F.coalesce("text", F.lit(""))) != "")
        sink(topk_search(fixed, asked, k, key), epoch)

    return run


def recent_means(x: np.ndarray, n: int, keep: int) -> np.ndarray:
    """For each of the last ``n`` values, the mean of it and those before it, ``keep`` in all, NaN aside."""
    there, filled = np.cumsum(np.append(0, ~np.isnan(x))), np.cumsum(np.append(0.0, np.nan_to_num(x)))
    ends = np.arange(len(x) - n, len(x)) + 1
    starts = np.maximum(ends - keep, 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        return (filled[ends] - filled[starts]) / (there[ends] - there[starts])


def stream_throttle(stream: DataFrame, seconds: float = 0.5, keep: int = 30, late: str = "10 minutes") -> DataFrame:
    """(key, ts, value, mean): rows of (key, ts, value) at least ``seconds`` after their key's last published one, with the mean of the
    last ``keep`` values. A key's state is its last published time, its last time and those values; it goes when the key has had no row
    for ``late`` (at least ``seconds``), and rows behind the watermark are dropped. Within a batch rows go by time, for which a key's
    rows of one batch are sorted at once: the source's limit of files a batch bounds them."""
    gap = int(np.ceil(round(seconds * 1e6, 3)))
    idle = max(milliseconds(late), gap // 1000 + 1)

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, seen, values = state.get if state.exists else (None, 0, [])
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        micros = rows["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
        x = np.concatenate([np.asarray(values, dtype=float), rows["value"].to_numpy(dtype=float)])
        means = recent_means(x, len(micros), keep)
        out = let_through(micros, np.array([0]), last, gap) if gap > 0 else np.ones(len(micros), dtype=bool)
        if out.any():
            last = int(micros[out][-1])
        seen = max(seen, int(micros[-1]))
        state.update((last, seen, x[-keep:].tolist()))
        _keep_until(state, seen, idle)
        yield pd.DataFrame({"key": key[0], "ts": rows["ts"], "value": rows["value"], "mean": means})[out]

    slim = stream.where("ts IS NOT NULL").withWatermark("ts", late).select("key", "ts", "value")
    return slim.groupBy("key").applyInPandasWithState(run, "key string, ts timestamp, value double, mean double", "last long, seen long, recent array<double>", "append", GroupStateTimeout.EventTimeTimeout)
