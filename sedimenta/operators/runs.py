"""Generation runs: their inputs, event logs, metrics and chats."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.operators import scan
from sedimenta.operators.datasets import free_names


def _micros(ts: str | Column) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def eval_matrix(models: DataFrame, prompts: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """Every model with every prompt, with the arguments of the model's type. The product is the result; both sides are
    catalogues, and Spark broadcasts the smaller."""
    args = F.lit(None).cast("string")
    for kind, text in (extra or {}).items():
        args = F.when(F.col("type") == kind, F.lit(text)).otherwise(args)
    return models.crossJoin(prompts).withColumn("arguments", args)


def resolve_prompts(prompts: DataFrame, files: DataFrame, default: str) -> DataFrame:
    """prompt_id, prompt: a prompt that starts with @ is a comma-separated list of paths, each less its first character, and
    becomes the files' contents joined by line feeds; if one is missing, or the prompt is null, the default."""
    plain = prompts.where(~F.coalesce(F.col("prompt").startswith("@"), F.lit(False))).select("prompt_id", F.coalesce("prompt", F.lit(default)).alias("prompt"))
    parts = prompts.where(F.col("prompt").startswith("@")).select("prompt_id", F.posexplode(F.split("prompt", ",")).alias("pos", "part"))
    named = parts.select("prompt_id", "pos", F.expr("substr(part, 2)").alias("path"))
    found = named.join(files.select("path", "contents"), "path", "left").groupBy("prompt_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "contents"))).alias("all"), F.min(F.col("contents").isNotNull()).alias("whole")
    )
    text = F.when(F.col("whole"), F.array_join(F.col("all.contents"), "\n")).otherwise(F.lit(default))
    return plain.unionByName(found.select("prompt_id", text.alias("prompt")))


def generation_metrics(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Per run: ttft_ms (null without events), rate_tokens (the first event and each later chunk that isn't empty),
    total_tokens (chunks that aren't empty), seconds from the first to the last event, tokens_per_second, truncated."""
    filled = F.coalesce((F.col("kind") == "chunk") & (F.length("chunk") > 0), F.lit(False))
    seen = events.groupBy("run_id").agg(  # four numbers a run and task; no run is brought together
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.min_by(filled, "seq").alias("begun"),
        F.count_if(filled).alias("total_tokens"),
    ).withColumn("rate_tokens", F.col("total_tokens") + F.when(F.col("begun"), 0).otherwise(1))
    seconds = (_micros("last_ts") - _micros("first_ts")) / 1e6
    return runs.join(seen, "run_id", "left").select(
        *runs.columns,
        ((_micros("first_ts") - _micros("start_ts")) / 1e3).alias("ttft_ms"),
        F.coalesce("rate_tokens", F.lit(0)).alias("rate_tokens"),
        F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"),
        seconds.alias("seconds"),
        (F.col("rate_tokens") / F.nullif(seconds, F.lit(0.0))).alias("tokens_per_second"),
        F.coalesce(F.col("total_tokens") >= F.col("max_tokens"), F.lit(False)).alias("truncated"),
    )


def model_summary(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("model").agg(
        F.count("*").alias("runs"),
        F.avg("ttft_ms").alias("mean_ttft_ms"),
        F.percentile_approx("ttft_ms", 0.5).alias("median_ttft_ms"),
        F.max("tokens_per_second").alias("best_tokens_per_second"),
        F.sum("total_tokens").alias("tokens"),
        F.sum(F.col("truncated").cast("long")).alias("truncated_runs"),
    )


def assemble_output(events: DataFrame) -> DataFrame:
    """run_id, output: a run's chunks in order, up to its first tool call."""
    tool = F.min(F.when(F.col("kind") == "tool", F.col("seq"))).over(W.partitionBy("run_id"))
    first = free_names(events, "tool_seq")[0]
    before = events.withColumn(first, tool).where((F.col("kind") == "chunk") & (F.col(first).isNull() | (F.col("seq") < F.col(first))))
    parts = before.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("seq", "chunk"))).alias("all"))
    return parts.select("run_id", F.array_join(F.col("all.chunk"), "").alias("output"))


def open_turn(chats: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Conversations ready for the next answer: a last message that is the assistant's and empty goes."""
    last = F.row_number().over(W.partitionBy(conv).orderBy(F.desc(turn)))
    empty = (F.col("role") == "assistant") & (F.coalesce(F.col("text"), F.lit("")) == "")
    back = free_names(chats, "back")[0]
    return chats.withColumn(back, last).where(~((F.col(back) == 1) & empty)).drop(back)


def assemble_chat(chats: DataFrame, cancelled: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """conv, messages: system messages first, then the turns in order, tool results last; a cancelled conversation's last
    message ends with a mark."""
    place = F.when(F.col("role") == "system", 0).when(F.col("role") == "tool", 2).otherwise(1)
    whole = chats.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), F.col(turn).alias("turn"), "role", "text"))).alias("all"))
    plain = F.transform("all", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text")))
    if cancelled is None:
        return whole.select(conv, plain.alias("messages"))
    marked = whole.join(cancelled.select(conv, F.lit(True).alias("gone")).distinct(), conv, "left")
    last = lambda i: F.col("gone") & (i == F.size("all") - 1)
    ended = F.transform("all", lambda m, i: F.struct(m["role"].alias("role"), F.when(last(i), F.concat(m["text"], F.lit("\n[Cancelled]"))).otherwise(m["text"]).alias("text")))
    return marked.select(conv, ended.alias("messages"))


@dataclass(frozen=True)
class Tool:
    """A tool that runs on columns: its name, the fields of its JSON arguments (as DDL), those that a call must give, and its output, a
    struct made of the parsed arguments."""

    name: str
    arguments: str
    required: tuple[str, ...]
    run: Callable[[Column], Column]


#: Fixed name and fields.
ADD = Tool("add_two_numbers", "first long, second long", ("first", "second"), lambda a: F.struct(F.try_add(a["first"], a["second"]).alias("result")))


def route_tool_calls(calls: DataFrame, name: str | Column = "name", arguments: str | Column = "arguments", tools: Iterable[Tool] = (ADD,)) -> DataFrame:
    """Add result: the JSON text of a known tool's output for its JSON arguments, or ``Malformed arguments`` if they can't be parsed, a required
    one is missing or of another type, or the output has a null; for other names a note on the name."""
    n, a = (F.col(c) if isinstance(c, str) else c for c in (name, arguments))
    result = F.concat(F.lit("Unknown tool: "), F.coalesce(n, F.lit("")))
    for tool in tools:
        given = F.from_json(a, tool.arguments)
        whole = reduce(and_, (given[c].isNotNull() for c in tool.required), given.isNotNull())
        made = F.to_json(tool.run(given), {"ignoreNullFields": "false"})
        told = F.when(whole & ~made.contains(":null"), made)
        result = F.when(n == tool.name, F.coalesce(told, F.lit("Malformed arguments"))).otherwise(result)
    return calls.withColumn("result", result)


def delta_from_start(df: DataFrame, key: str, order: str | list[str], value: str, spread: bool = False) -> DataFrame:
    """Add delta: a snapshot's growth since its key's first. ``spread`` cuts long keys into ranges; without it a key is one task."""
    if spread:
        first = free_names(df, "first")[0]
        return scan.running(df, key, order, **{first: ("first", value)}).withColumn("delta", F.col(value) - F.col(first)).drop(first)
    w = W.partitionBy(key).orderBy(*([order] if isinstance(order, str) else order))
    return df.withColumn("delta", F.col(value) - F.first(value).over(w))


def running_rate(df: DataFrame, key: str = "run_id", order: str | list[str] = "seq", ts: str = "ts", spread: bool = False) -> DataFrame:
    """Add rate: rows so far over the seconds since the first; null at no elapsed time. ``spread`` as in ``delta_from_start``."""
    if spread:
        first, rows = free_names(df, "first", "rows")
        scanned = scan.running(df, key, order, **{first: ("first", _micros(ts)), rows: ("count", F.lit(1))})
        since = (_micros(ts) - F.col(first)) / 1e6
        return scanned.withColumn("rate", F.when(since > 0, F.col(rows) / since)).drop(first, rows)
    w = W.partitionBy(key).orderBy(*([order] if isinstance(order, str) else order))
    elapsed = (_micros(ts) - _micros(F.first(ts).over(w))) / 1e6
    return df.withColumn("rate", F.when(elapsed > 0, F.count("*").over(w) / elapsed))


def progress_milestones(df: DataFrame, key: str, order: str, processed: str, total: str) -> DataFrame:
    """Rows whose tenths of the work exceed the row before's, and each key's last row; adds tenth."""
    w = W.partitionBy(key).orderBy(order)
    tenth = F.floor(F.col(processed) * 10 / F.col(total))
    was, after = free_names(df, "was", "after")
    marked = df.withColumn("tenth", tenth).withColumns({was: F.lag("tenth").over(w), after: F.lead("tenth").over(w)})
    return marked.where((F.col("tenth") > F.coalesce(was, F.lit(0))) | F.col(after).isNull()).drop(was, after)
