"""Scans over cut keys against windows and sequential versions."""

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.operators import lookup, runs, scan


@pytest.fixture
def many_parts(spark):
    """As on a cluster: small partitions stay apart."""
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def skewed(spark, n=6000):
    """Seven rows of ten have one key, one has none, the rest have three hundred."""
    key = F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 == 7, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 300).cast("string")))
    y = F.when(F.col("id") % 13 == 0, None).otherwise(F.xxhash64("id", F.lit(2)) % 100).cast("int")
    ts = F.timestamp_micros(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(900_000_000)))
    return spark.range(n, numPartitions=5).select("id", key.alias("key"), (F.xxhash64("id") % 500 / 7).alias("x"), y.alias("y"), ts.alias("ts"), F.lit(1).alias("part"), F.lit(2).alias("_metadata"), F.lit("c").alias("c0"))


def greedy(times, last, gap):
    out = []
    for t in times:
        out.append(last is None or t - last >= gap)
        last = int(t) if out[-1] else last
    return out, last


def test_gates_compose():
    rng = np.random.default_rng(1)
    for _ in range(400):
        gap, times = int(rng.integers(1, 60)), np.sort(rng.integers(0, rng.integers(1, 600), size=int(rng.integers(1, 120))))
        parts = [p for p in np.split(times, np.sort(rng.choice(len(times) + 1, size=int(rng.integers(0, 6))))) if len(p)]
        gates, last = [scan.gate(p, gap) for p in parts], None
        for p, g in zip(parts, gates, strict=True):
            want, after = greedy(p, last, gap)
            assert scan.let_through(p, np.array([0]), last, gap).tolist() == want and g.leave(last, gap) == after
            last = after
        k = int(rng.integers(0, len(gates)))
        whole, before = gates[k], None
        for g in gates[k + 1 :]:
            whole = whole.then(g, gap)
        for p in parts[:k]:
            before = greedy(p, before, gap)[1]
        assert whole.leave(before, gap) == last


def test_segmented():
    x, start = np.arange(1, 9), np.array([0, 0, 0, 3, 4, 4, 4, 4])
    assert scan.segmented(np.add, x, start).tolist() == [1, 3, 6, 4, 5, 11, 18, 26]
    assert scan.segmented(np.add, x[:0], start[:0]).tolist() == []


@pytest.mark.parametrize("key", ["key", None])
def test_running_values_equal_windows(many_parts, key):
    df = skewed(many_parts)
    by = (W.partitionBy(key) if key else W.partitionBy(F.lit(1))).orderBy("ts", "id")
    so_far = by.rowsBetween(W.unboundedPreceding, 0)
    factor = 1 + F.col("x") / 1e5
    frame = lambda d: d.toPandas().set_index("id").sort_index()
    got = frame(scan.running(df, key, ["ts", "id"], s=("sum", "x"), n=("count", "y"), lo=("min", "y"), hi=("max", "x"), first=("first", "y"), whole=("sum", "y"), p=("product", factor)))
    want = {"s": F.sum("x"), "n": F.count("y"), "lo": F.min("y"), "hi": F.max("x"), "first": F.first("y"), "whole": F.sum("y"), "p": F.product(factor)}
    want = frame(df.select("*", *(c.over(so_far).alias(n) for n, c in want.items())))
    assert list(got.columns) == list(want.columns) and got[["key", "c0", "part"]].equals(want[["key", "c0", "part"]])
    for c in ("s", "n", "lo", "hi", "first", "whole", "p"):
        assert np.allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-7, equal_nan=True), c
    for n in (1, 2, 30, 500):
        means = frame(scan.moving_mean(df, key, ["ts", "id"], "y", n))["mean"].astype(float)
        assert np.allclose(means, frame(df.select("id", F.avg("y").over(by.rowsBetween(1 - n, 0)).alias("m")))["m"].astype(float), equal_nan=True), n


@pytest.mark.parametrize("key", ["key", None])
@pytest.mark.parametrize("seconds", [0.0137, 0.5, 30.0])
def test_throttle_equals_a_sequential_scan(many_parts, key, seconds):
    df = skewed(many_parts)
    want, last = set(), {}
    for r in df.select("id", F.col(key or "c0").alias("k"), F.unix_micros("ts").alias("u")).orderBy("u", "id").collect():
        if r.k not in last or r.u - last[r.k] >= round(seconds * 1e6):
            want.add(r.id)
            last[r.k] = r.u
    assert {r.id for r in scan.throttle(df, key, "ts", "id", seconds).collect()} == want


def test_throttle_of_a_million_rows_of_one_key(many_parts):
    df = many_parts.range(1_000_000, numPartitions=8).select("id", F.lit("hot").alias("key"), F.timestamp_micros(F.pmod(F.xxhash64("id"), F.lit(100_000_000_000))).alias("ts"))
    times = np.sort(df.select(F.unix_micros("ts").alias("u")).toPandas()["u"].to_numpy())
    at, want = 0, 0
    while at < len(times):
        want += 1
        at = int(np.searchsorted(times, times[at] + 500_000))
    assert scan.throttle(df, "key", "ts", "id", 0.5).count() == want
    sizes = sorted(r["count"] for r in scan.ranged(df, "key", ["ts", "id"]).rows.groupBy("part").count().collect())
    assert len(sizes) == 20 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_ties_and_repeats_are_cut_too(many_parts):
    df = many_parts.range(4000).select(F.lit("k").alias("key"), F.lit(1).alias("o"), F.col("id").alias("v"))
    sizes = sorted(r["count"] for r in scan.ranged(df, "key", ["o"]).rows.groupBy("part").count().collect())
    assert len(sizes) == 20 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    got = scan.running(df, "key", "o", n=("count", "v"), s=("sum", F.lit(2))).collect()
    assert sorted(r["n"] for r in got) == list(range(1, 4001)) and all(r["s"] == 2 * r["n"] for r in got)


def test_throttle_of_odd_rows(spark):
    rows = [("a", None, 1), ("a", 1.0, 2), ("a", 1.5, 3), ("a", 1.5, 4), ("a", 1.999999, 5), ("a", 2.0, 6), (None, 0.0, 7), (None, 0.4, 8)]
    df = spark.createDataFrame(rows, "key string, s double, n long").withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long")))
    assert sorted(r["n"] for r in scan.throttle(df, "key", "ts", "n", 0.5).collect()) == [2, 3, 6, 7]
    assert scan.throttle(df, "key", "ts", "n", 0).count() == 7
    assert scan.throttle(df.where("n > 99"), "key", "ts", "n").count() == 0
    assert scan.running(df.where("n > 99"), "key", "ts", c=("count", "n")).count() == scan.moving_mean(df.where("n > 99"), "key", "ts", "n").count() == 0


def test_operators_over_cut_keys(many_parts):
    df = skewed(many_parts, 3000).drop("part")
    frame = lambda d, c: d.select("id", F.round(c, 6).alias(c)).toPandas().set_index("id").sort_index()[c].astype(float)
    order = ["ts", "id"]
    for how, c in (
        (lambda s: lookup.moving_rate(df, "key", order, "y", 5, spread=s), "rate"),
        (lambda s: lookup.noise_schedule(df.withColumn("b", F.col("x") / 1e6 + 1e-4), "key", order, "b", spread=s), "sigma"),
        (lambda s: runs.delta_from_start(df, "key", order, "x", spread=s), "delta"),
        (lambda s: runs.running_rate(df, "key", order, spread=s), "rate"),
    ):
        assert np.allclose(frame(how(True), c), frame(how(False), c), rtol=1e-6, equal_nan=True)


def test_long_files_are_split_into_stretches(many_parts):
    """Files of several row groups, read by several tasks each; and another split in the second pass is seen."""
    spark = many_parts
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", "20000")
    try:
        df = spark.range(60_000, numPartitions=3).select("id", F.when(F.col("id") % 10 < 8, "hot").otherwise("k").alias("key"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("text"))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
        table = scan.ranged(df, "key", ["id"], parts=4)
        assert table.stretches().select("part", "block").distinct().count() > 20
        got = scan.running(df, "key", "id", n=("count", "id"), first=("first", "id"))
        want = df.withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("id")))
        assert got.select("id", "n").exceptAll(want.select("id", F.col("n").cast("long"))).count() == 0 == got.where("first > 8").count()
        assert scan.throttle(df.withColumn("ts", F.timestamp_micros("id")), "key", "ts", "id", 3e-6).where("key = 'hot'").count() > 10_000
        spark.conf.set("spark.sql.files.maxPartitionBytes", "30k")
        with pytest.raises(Exception, match="split otherwise"):
            got.count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
