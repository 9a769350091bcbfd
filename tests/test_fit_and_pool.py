"""Centred moments against descent on rows, and pooling of token rows against pooling of arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.operators import embed, fit


def on_rows(x, y, degree, rate, steps):
    """Full-batch descent on the rows themselves, in extended precision."""
    x, y = x.astype(np.longdouble), y.astype(np.longdouble)
    powers = np.vander(x, degree + 1, increasing=True)
    theta = np.zeros(degree + 1, dtype=np.longdouble)
    for _ in range(steps):
        yield float(np.mean((powers @ theta - y) ** 2)), theta.astype(float)
        theta = theta - rate * 2 * (powers.T @ (powers @ theta - y)) / len(x)
    yield float(np.mean((powers @ theta - y) ** 2)), theta.astype(float)


@pytest.mark.parametrize("centre, spread, degree, rate", [(1e6, 10.0, 3, 2e-37), (-1e6, 3.0, 2, 1e-25), (0.0, 2.0, 3, 0.01), (5.0, 0.0, 2, 1e-4)])
def test_descent_far_from_zero(spark, centre, spread, degree, rate):
    rng = np.random.default_rng(3)
    x = centre + rng.uniform(-spread, spread, 3000)
    y = 3 + 0.5 * (x - centre) + rng.uniform(-1, 1, 3000) + 1e3
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double").repartition(7)
    got = sorted((r["step"], r["loss"], r["theta"]) for r in fit.fit_poly(df, degree, rate, 30, trace=True).collect())
    want = list(on_rows(x, y, degree, rate, 30))
    assert len(got) == 31
    for (step, loss, theta), (loss_w, theta_w) in zip(got, want, strict=True):
        assert np.allclose(loss, loss_w, rtol=1e-9) and np.allclose(theta, theta_w, rtol=1e-9, atol=1e-18), step


def test_moments_merge(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(1e5, 2, 500), rng.normal(-7, 3, 500)
    whole, parts = fit.gather(x, y, 2), [fit.gather(x[i:j], y[i:j], 2) for i, j in ((0, 1), (1, 40), (40, 500))]
    assert np.allclose(fit.merge(fit.merge(parts[0], parts[1], 2), parts[2], 2), whole, rtol=1e-9, atol=1e-6)


def test_fits_of_groups_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(fit, "HELD", 3)
    rows = [(g, i, float(x), 7 + 0.25 * x) for g in ("a", "b", None) for i in (0, 1) for x in range(20)] + [("a", 0, None, 1.0), ("c", 0, 1.0, None)]
    df = spark.createDataFrame(rows, "g string, m int, x double, y double").repartition(5)
    got = {(r["g"], r["m"]): r["theta"] for r in fit.fit_poly(df, 1, 0.004, 20000, by=["g", "m"]).collect()}
    assert set(got) == {(g, i) for g in ("a", "b", None) for i in (0, 1)} and all(np.allclose(t, [7, 0.25], atol=1e-6) for t in got.values())
    assert fit.fit_poly(df.limit(0), 1, 0.1, 3).count() == 0 == fit.fit_poly(df.limit(0), 1, 0.1, 3, by=["g"]).count()


@pytest.mark.parametrize("strategy", ["mean", "max", "first", "cls", "last", None])
def test_pooled_rows_equal_pooled_arrays(spark, strategy):
    rows = [("a", i, [float(i % 7), -float(i), 2.0], i % 3 != 0) for i in range(50)] + [("masked", 0, [1.0, 1.0, 1.0], False), ("one", 3, [3.0, 0.0, 4.0], True), ("one", 1, None, True), ("one", 0, [1.0], True), ("b", 5, [1.0, 0.0, 0.0], None), (None, 2, [1.0, 2.0, 3.0], True)]
    df = spark.createDataFrame(rows, "path string, pos long, vector array<float>, mask boolean").withColumn("v", F.lit("clash")).repartition(6)
    for normed in (False, True):
        got = {r["path"]: r["embedding"] for r in embed.pool_rows(df, 3, strategy, mask="mask", normed=normed).collect()}
        fine = df.where("mask AND size(vector) = 3").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "vector"))).alias("t"))
        want = {r["path"]: r["e"] for r in fine.select("path", embed.pool(strategy, F.col("t.vector"), normed=normed).alias("e")).collect()}
        assert set(got) == {"a", "masked", "one", "b", None} and got["masked"] == got["b"] == []
        assert all(np.allclose(got[k], v) for k, v in want.items())
    assert embed.pool_rows(df.limit(0), 3, strategy).count() == 0


def test_pooled_rows_send_a_vector_a_task(spark):
    df = spark.range(200_000, numPartitions=4).select(F.lit("long").alias("path"), F.col("id").alias("pos"), F.array(*(F.col("id") * i for i in range(4))).cast("array<float>").alias("vector"))
    done = embed.pool_rows(df, 4, "mean", normalized=False)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "partial_avg" in plan and "collect" not in plan
    assert np.allclose(done.first()["embedding"], [99_999.5 * i for i in range(4)])
