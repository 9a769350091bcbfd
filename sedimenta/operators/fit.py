"""Polynomial fits by gradient descent on centred moments that one pass gathers."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups that a task holds the moments of before it passes them on.
HELD = 20_000


def shifted(sums: np.ndarray, by: float) -> np.ndarray:
    """Sums of (u + by)^k from those of u^k, k from 0; along the last axis."""
    n = sums.shape[-1]
    turn = np.array([[comb(k, j) * by ** (k - j) if j <= k else 0.0 for j in range(n)] for k in range(n)])
    return sums @ turn.T


def gather(x: np.ndarray, y: np.ndarray, degree: int) -> np.ndarray:
    """Moments of some rows around their means: n, both means, sums of u^0 .. u^2d, of u^k v for k to d, and of v^2."""
    cx, cy = x.mean(), y.mean()
    u, v = x - cx, y - cy
    powers = np.vander(u, 2 * degree + 1, increasing=True)
    return np.concatenate([[len(x), cx, cy], powers.sum(axis=0), v @ powers[:, : degree + 1], [v @ v]])


def merge(a: np.ndarray, b: np.ndarray, degree: int) -> np.ndarray:
    """The moments of both, around their common means."""
    n = a[0] + b[0]
    centre = (a[1:3] * a[0] + b[1:3] * b[0]) / n
    m, out = 2 * degree + 1, []
    for one in (a, b):
        dx, dy = one[1] - centre[0], one[2] - centre[1]
        sx = shifted(one[3 : 3 + m], dx)
        sxy = shifted(one[3 + m : 4 + m + degree], dx) + dy * sx[: degree + 1]
        out.append(np.concatenate([sx, sxy, [one[-1] + 2 * dy * one[3 + m] + dy * dy * one[0]]]))
    return np.concatenate([[n, *centre], out[0] + out[1]])


def moments(df: DataFrame, degree: int, by: list[str] | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """by, moments (as of ``gather``) of each group: all that full-batch descent needs. Rows with a null are left out. A task merges its
    own rows' moments, so that a group is a row per task, which are merged by group; places far from 0 lose no digits."""
    by = by or []
    own = [f"k{i}" for i in range(len(by))]
    kinds = "".join(f"{k} {df.schema[c].dataType.simpleString()}, " for k, c in zip(own, by, strict=True))
    slim = df.select(*(F.col(c).alias(k) for k, c in zip(own, by, strict=True)), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")

    def told(held: dict) -> pd.DataFrame:
        return pd.DataFrame([(*k, m.tolist()) for k, m in held.items()], columns=[*own, "m"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for k, rows in pdf.groupby(own, dropna=False, sort=False) if own else [((), pdf)] if len(pdf) else []:
                key = tuple(None if pd.isna(v) else v for v in k)
                found = gather(rows["x"].to_numpy(), rows["y"].to_numpy(), degree)
                held[key] = merge(held[key], found, degree) if key in held else found
            if len(held) > HELD:
                yield told(held)
                held = {}
        yield told(held)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = np.array(pdf["m"].iloc[0])
        for m in pdf["m"].iloc[1:]:
            whole = merge(whole, np.array(m), degree)
        out = pdf[own].iloc[:1].copy()
        out["m"] = [whole.tolist()]
        return out

    parts = slim.mapInPandas(run, f"{kinds}m array<double>")
    whole = parts.groupBy(*own).applyInPandas(join, f"{kinds}m array<double>")
    return whole.select(*(F.col(k).alias(c) for k, c in zip(own, by, strict=True)), F.col("m").alias("moments"))


def descend(moment: np.ndarray, theta: np.ndarray, rate: float, steps: int) -> Iterator[tuple[int, float, np.ndarray]]:
    """(step, mean squared error, theta) before each step and after the last: the trajectory of full-batch descent on rows.

    Residuals' moments are taken around the means, with theta moved there and the gradient moved back; theta is moved exactly."""
    d = len(theta)
    n, cx, cy = moment[:3]
    sx, sxy, syy = moment[3 : 2 + 2 * d] / n, moment[2 + 2 * d : 2 + 3 * d] / n, moment[-1] / n
    gram = np.array([[sx[i + j] for j in range(d)] for i in range(d)])
    c = Fraction(float(cx))
    for step in range(steps + 1):
        exact = [Fraction(float(t)) for t in theta]
        moved = [sum((comb(k, j) * c ** (k - j) * exact[k] for k in range(j, d)), Fraction(0)) for j in range(d)]
        moved[0] -= Fraction(float(cy))
        near = np.array([float(t) for t in moved])
        rest = gram @ near - sxy  # mean of residual times u^j
        yield step, float(max(near @ rest - near @ sxy + syy, 0.0)), theta.copy()
        theta = theta - rate * 2 * shifted(rest, float(cx))


def fit_poly(df: DataFrame, degree: int, rate: float, steps: int, theta0: list[float] | None = None, by: list[str] | None = None, x: str = "x", y: str = "y", trace: bool = False) -> DataFrame:
    """by, step, loss, theta of each group's fit: the last step, or all of them. A group without rows has no fit; each group is one
    row of moments, whatever its size."""
    by = by or []
    start = np.array(theta0 or [0.0] * (degree + 1))
    gathered = moments(df, degree, by, x, y)

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                found = list(descend(np.asarray(row.moments), start, rate, steps))
                out += [(*(getattr(row, c) for c in by), s, loss, t.tolist()) for s, loss, t in (found if trace else found[-1:])]
            yield pd.DataFrame(out, columns=[*by, "step", "loss", "theta"])

    kinds = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in by)
    return gathered.mapInPandas(run, f"{kinds}step int, loss double, theta array<double>")


def series_long(df: DataFrame, n: int, idx: str = "id", x: str = "x", actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """id, x, y, series: actual values, and predicted ones under ids raised by ``n``."""
    a = df.select(F.col(idx).alias("id"), F.col(x).alias("x"), F.col(actual).alias("y"), F.lit("actual").alias("series"))
    return a.unionByName(df.select((F.col(idx) + n).alias("id"), F.col(x).alias("x"), F.col(predicted).alias("y"), F.lit("predicted").alias("series")))
