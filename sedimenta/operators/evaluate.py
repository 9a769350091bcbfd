"""Metrics of classifiers, regressions and training runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.vectors import argmax, log_sum_exp


def accuracy(df: DataFrame, logits: str = "logits", label: str = "label") -> DataFrame:
    return df.agg(F.avg(F.when(argmax(logits) == F.col(label), 1.0).otherwise(0.0)).alias("accuracy"))


def cross_entropy(df: DataFrame, logits: str = "logits", label: str = "label") -> DataFrame:
    return df.agg(F.avg(log_sum_exp(logits) - F.get(logits, F.col(label)).cast("double")).alias("cross_entropy"))


def mean_squared_error(df: DataFrame, predicted: str = "predicted", actual: str = "actual") -> DataFrame:
    return df.agg(F.avg((F.col(predicted) - F.col(actual)) * (F.col(predicted) - F.col(actual))).alias("mse"))


def perplexity(df: DataFrame, loss: str = "loss", tokens: str = "tokens") -> DataFrame:
    """loss (weighted by tokens) and its exponential; null without tokens."""
    mean = F.sum(F.col(loss) * F.col(tokens)) / F.nullif(F.sum(F.col(tokens)), F.lit(0))
    return df.agg(mean.alias("loss"), F.exp(mean).alias("perplexity"))


def training_report(steps: DataFrame, every: int = 10, by: list[str] | None = None) -> DataFrame:
    """iter (a report's last step), loss, iterations_per_second, tokens_per_second of each run of ``every`` steps, of each training
    that the columns ``by`` name; the last run may be short."""
    run = F.floor((F.col("iter") - 1) / every)
    seconds = F.nullif(F.sum("seconds"), F.lit(0.0))
    return steps.groupBy(*(by or []), run.alias("report")).agg(
        F.max("iter").alias("iter"),
        F.avg("loss").alias("loss"),
        (F.count("*") / seconds).alias("iterations_per_second"),
        (F.sum("tokens") / seconds).alias("tokens_per_second"),
    )


def checkpoints(steps: DataFrame, save_every: int = 100, validate_every: int = 100, by: list[str] | None = None) -> DataFrame:
    """A row for each mark of a step: saved (its weights are written) and validated (the validation set is scored, after the
    first step too). A step may have both."""
    it = F.col("iter")
    marks = F.array_compact(F.array(F.when(it % save_every == 0, "saved"), F.when((it % validate_every == 0) | (it == 1), "validated")))
    return steps.select(*(by or []), "iter", F.explode(marks).alias("mark"))


def validation_report(steps: DataFrame, scored: DataFrame, validate_every: int = 100, by: list[str] | None = None) -> DataFrame:
    """iter, validation_loss (mean over the scored batches) and validation_seconds (their sum) of each validated step; ``scored`` has
    a row (iter, loss, seconds) for each batch. A validated step without scored batches has nulls."""
    keys = [*(by or []), "iter"]
    found = scored.groupBy(*keys).agg(F.avg("loss").alias("validation_loss"), F.sum("seconds").alias("validation_seconds"))
    return checkpoints(steps, validate_every, validate_every, by).where("mark = 'validated'").select(*keys).join(found, keys, "left")
