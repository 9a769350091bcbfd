"""Scalar functions: pixels, sizes, labels, colour ramps, random words, log lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the generator: its increment and its two multipliers.
GOLDEN, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scale_pixels(v: str | Column, mode: str) -> Column:
    """unit: byte to 0..1; signed: 0..1 to -1..1; decode: -1..1 to 0..1, clipped; byte: 0..1 to a truncated byte."""
    how = {
        "unit": lambda x: x.cast("double") / 255,
        "signed": lambda x: x.cast("double") * 2 - 1,
        "decode": lambda x: F.least(F.greatest(x.cast("double") / 2 + 0.5, F.lit(0.0)), F.lit(1.0)),
        "byte": lambda x: F.floor(x.cast("double") * 255).cast("int"),
    }
    return F.transform(_col(v), how[mode])


def fit_size(width: str | Column, height: str | Column, max_edge: int | None = None) -> Column:
    """Struct of width and height: the longer edge brought to ``max_edge`` (rounded half away from zero; null: as is), then
    both brought down to multiples of 64."""
    w, h = _col(width).cast("double"), _col(height).cast("double")
    scale = F.lit(1.0) if max_edge is None else F.when(w > h, max_edge / w).otherwise(max_edge / h)
    down = lambda x: (F.floor(F.floor(x * scale + 0.5) / 64) * 64).cast("int")
    return F.struct(down(w).alias("width"), down(h).alias("height"))


def format_bytes(n: str | Column) -> Column:
    """Gigabytes with two places, else whole megabytes, else whole kilobytes (halves to even), else 0 KB."""
    n = _col(n).cast("double")
    unit = lambda k: n / (1 << k)
    return (
        F.when(n >= 1 << 30, F.concat(F.format_string("%.2f", unit(30)), F.lit(" GB")))
        .when(n >= 1 << 20, F.concat(F.rint(unit(20)).cast("bigint").cast("string"), F.lit(" MB")))
        .when(n >= 1 << 10, F.concat(F.rint(unit(10)).cast("bigint").cast("string"), F.lit(" KB")))
        .otherwise(F.lit("0 KB"))
    )


def model_label(name: str | Column, params: str | Column) -> Column:
    """Last part of a name with slashes, and its number of parameters in millions of 1024**2, or billions from 1000 on."""
    millions = F.floor(_col(params) / (1 << 20))
    size = F.when(millions >= 1000, F.concat(F.format_string("%.1f", millions / 1000.0), F.lit("B"))).otherwise(F.concat(millions.cast("string"), F.lit("M")))
    return F.concat(F.element_at(F.split(_col(name), "/"), -1), F.lit(" - "), size)


def predict_poly(x: str | Column, theta: list[float] | Column, degree: int | None = None) -> Column:
    """theta[0] + theta[1] x + ..., by Horner's rule."""
    x = _col(x)
    parts = [F.lit(float(t)) for t in theta] if isinstance(theta, list | tuple) else [theta[i] for i in range(degree + 1)]
    out = parts[-1]
    for part in reversed(parts[:-1]):
        out = out * x + part
    return out


def apply_ramp(x: str | Column, colours: list[tuple[int, int, int, int]], top: float, over: tuple[int, int, int, int]) -> Column:
    """Channels (four ints) of a value on a colour ramp over 0..top: neighbours are mixed in proportion and rounded, halves
    to even; from ``top`` on the fixed colour ``over``."""
    x = _col(x).cast("double")
    at = x * ((len(colours) - 1) / top)
    low = F.floor(at)
    part = at - low
    pick = lambda i, c: F.element_at(F.array(*[F.lit(float(k[c])) for k in colours]), (F.least(F.greatest(i, F.lit(0)), F.lit(len(colours) - 1)) + 1).cast("int"))
    mixed = [F.rint(pick(low, c) + part * (pick(low + 1, c) - pick(low, c))).cast("int") for c in range(4)]
    return F.when(x >= top, F.array(*[F.lit(c) for c in over])).otherwise(F.array(*mixed))


def splitmix64(seed: int, index: str | Column) -> Column:
    """The index-th (from 0) random word of a seed, as a signed long. Wrapping products need unsigned words, which columns
    don't have, so that numpy makes them in Arrow batches."""

    @F.pandas_udf("long")
    def word(i: pd.Series) -> pd.Series:
        n = i.to_numpy().astype(np.uint64)
        z = np.uint64(seed % (1 << 64)) + (n + np.uint64(1)) * np.uint64(GOLDEN)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(FIRST)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(SECOND)
        return pd.Series((z ^ (z >> np.uint64(31))).astype(np.int64))

    return word(_col(index))


#: Fixed format of a trainer's log lines.
_TRAIN = r"^Iteration (\d+): training loss ([-0-9.einfa]+), iterations/sec ([-0-9.einfa]+), Tokens/sec ([-0-9.einfa]+)"
_VALID = r"^Iteration (\d+): validation loss ([-0-9.einfa]+), validation time ([-0-9.einfa]+)s?"
_SAVED = r"^Iteration (\d+): saved weights to (.+)$"
_TEST = r"^Test loss ([-0-9.einfa]+), ppl ([-0-9.einfa]+)"


def parse_training_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """kind (training, validation, saved, test), iteration, loss, per_second, tokens_per_second, seconds, perplexity, path of the
    lines that are of a kind; others are left out."""
    c = F.col(line)
    number = lambda p, i: F.expr(f"try_cast(nullif(regexp_extract(`{line}`, '{_sql(p)}', {i}), '') AS double)")
    kind = F.when(c.rlike(_TRAIN), "training").when(c.rlike(_VALID), "validation").when(c.rlike(_SAVED), "saved").when(c.rlike(_TEST), "test")
    return lines.select(
        kind.alias("kind"),
        F.expr(f"try_cast(nullif(regexp_extract(`{line}`, '^Iteration ([0-9]+):', 1), '') AS bigint)").alias("iteration"),
        F.coalesce(number(_TRAIN, 2), number(_VALID, 2), number(_TEST, 1)).alias("loss"),
        number(_TRAIN, 3).alias("per_second"),
        number(_TRAIN, 4).alias("tokens_per_second"),
        number(_VALID, 3).alias("seconds"),
        number(_TEST, 2).alias("perplexity"),
        F.nullif(F.regexp_extract(c, _SAVED, 2), F.lit("")).alias("path"),
    ).where("kind IS NOT NULL")


def _sql(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")
