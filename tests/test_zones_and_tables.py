"""Zones and lookup tables that are data, against brute force."""

import numpy as np
from pyspark.sql import functions as F

from sedimenta.operators import lookup

RECT, CIRCLE = "x double, y double, w double, h double", "seq long, x double, y double, r double, value double"


def brute(points, rects, circles):
    px, py = points[:, 0], points[:, 1]
    wall, value, seq = np.zeros(len(points), bool), np.zeros(len(points)), np.full(len(points), -np.inf)
    for x, y, w, h in rects:
        wall |= (px >= x) & (px < x + w) & (py >= y) & (py < y + h)
    for s, x, y, r, v in circles:
        now = ((px - x) ** 2 + (py - y) ** 2 < r * r) & (s > seq)
        value[now], seq[now] = v, s
    return wall, value


def check(spark, points, rects, circles, **how):
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "id long, x double, y double").withColumn("held", F.lit("clash"))
    done = lookup.tag_zones_by_tile(df, spark.createDataFrame([tuple(map(float, r)) for r in rects], RECT), spark.createDataFrame([(int(c[0]), *map(float, c[1:])) for c in circles], CIRCLE), **how)
    got = done.toPandas().set_index("id").sort_index()
    wall, value = brute(points, rects, circles)
    assert (got["wall"].to_numpy() == wall).all() and (got["value"].to_numpy() == value).all() and (got["held"] == "clash").all()
    assert (got["static"].to_numpy() == (wall | (value > 0))).all() and not got["border"].any()


def test_a_hundred_thousand_zones_of_many_sizes(spark):
    rng = np.random.default_rng(4)
    points = rng.integers(-2000, 2000, (1500, 2)) / 2.0
    at, size = rng.uniform(-1000, 1000, (100_000, 2)), 2.0 ** rng.uniform(-6, 3, (100_000, 2))
    rects = np.concatenate([at[:50_000], size[:50_000]], axis=1)
    circles = np.concatenate([rng.permutation(50_000)[:, None], at[50_000:], size[50_000:, :1], rng.uniform(-1, 1, (50_000, 1))], axis=1)
    circles[:3, 3] = 700
    check(spark, points, rects, circles)


def test_a_crowded_tile(spark):
    rng = np.random.default_rng(5)
    circles = np.concatenate([np.arange(3000)[:, None], rng.uniform(0, 1, (3000, 2)), rng.uniform(0.3, 0.6, (3000, 1)), rng.uniform(0, 1, (3000, 1))], axis=1)
    check(spark, rng.uniform(-0.5, 1.5, (400, 2)), circles[:200, 1:3].repeat(2, axis=1)[:, :4] * 0 + [[0, 0, 1, 1]], circles, crowd=64)


def test_edges_and_odd_zones(spark):
    points = np.array([(0, 0), (4, 0), (3.999, 3.999), (0, 4), (10, 10), (12, 10), (8, 10), (10, 11.99), (-5, -5), (-7, -5), (0, 0)])
    rects = [(0, 0, 4, 4), (-7, -7, 2, 3), (50, 50, 0, 3), (0, 0, -1, -1)]
    circles = [(1, 10, 10, 2, 0.5), (2, 10, 10, 2, -3), (3, 0, 0, 0, 9), (0, 10, 11, 50, 0.25)]
    check(spark, points, rects, circles)
    check(spark, points, rects, circles, tile=100.0)
    check(spark, points, rects, circles, tile=0.125, crowd=1)
    df = spark.createDataFrame([(None, 1.0), (float("nan"), 1.0), (1.0, 1.0)], "x double, y double").withColumn("value", F.lit("old"))
    odd = spark.createDataFrame([(0.0, 0.0, 9.0, 9.0), (None, 0.0, 9.0, 9.0), (0.0, 0.0, float("inf"), 1.0), (0.0, 0.0, float("nan"), 1.0)], RECT)
    assert sorted(r["wall"] for r in lookup.tag_zones_by_tile(df, odd, width=2, height=9).collect()) == [False, False, True]
    assert [r["static"] for r in lookup.tag_zones_by_tile(df).collect()] == [False] * 3
    assert lookup.tag_zones_by_tile(df, odd.limit(0)).count() == 3 and lookup.tag_zones_by_tile(df.limit(0), odd).count() == 0


def test_tables_agree_with_literals(spark):
    df = spark.range(64 * 64).select((F.col("id") % 64).cast("int").alias("x"), F.floor(F.col("id") / 64).cast("int").alias("y"))
    rects, circles = [(10, 5, 10, 35), (0, 60, 3, 3)], [(30, 30, 10, 0.75), (25, 25, 6, 0.0)]
    want = lookup.tag_zones(df, rects, circles, 64, 64)
    tables = spark.createDataFrame([tuple(map(float, r)) for r in rects], RECT), spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(circles)], CIRCLE)
    assert sorted(map(tuple, lookup.tag_zones_by_tile(df, *tables, 64, 64).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_interpolation_in_a_table(spark):
    values = spark.range(100_000).select(F.col("id").alias("pos"), (F.xxhash64("id") % 1000 / 7).alias("value"))
    asked = [(0, 0.0), (1, 99_999.0), (2, 99_998.5), (3, -0.5), (4, 99_999.5), (5, None), (6, 12.25), (7, 12.25), (8, float("nan"))]
    df = spark.createDataFrame(asked, "id long, at double").withColumn("low", F.lit("clash"))
    got = {r["id"]: r["y"] for r in lookup.interpolate_by_table(df, "at", values).collect()}
    v = {r["pos"]: r["value"] for r in values.where("pos < 20 OR pos > 99990").collect()}
    want = {0: v[0], 1: v[99_999], 2: (v[99_998] + v[99_999]) / 2, 3: None, 4: None, 5: None, 6: v[12] + 0.25 * (v[13] - v[12]), 8: None}
    assert all(got[i] is None if w is None else abs(got[i] - w) < 1e-9 for i, w in want.items()) and got[7] == got[6]
    plan = lookup.interpolate_by_table(values.select(F.col("pos").cast("double").alias("at")), "at", values)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert plan.select("at", "y")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_gaps_repeats_and_an_empty_table(spark):
    values = spark.createDataFrame([(0, 1.0), (1, 3.0), (1, 2.0), (3, 9.0), (None, 5.0), (4, None)], "pos long, value double")
    df = spark.createDataFrame([(x,) for x in (0.5, 1.0, 1.5, 2.0, 3.0, 3.5)], "at double")
    assert [r["y"] for r in lookup.interpolate_by_table(df, "at", values).orderBy("at").collect()] == [2.0, 3.0, None, None, 9.0, None]
    assert [r["y"] for r in lookup.interpolate_by_table(df, "at", values.limit(0)).collect()] == [None] * 6


def test_tiles_of_many_zones_are_pruned(spark):
    rng = np.random.default_rng(6)
    n = 6000
    rects = np.concatenate([rng.uniform(-1, 1, (n, 2)), rng.uniform(0.5, 1, (n, 2))], axis=1)
    circles = np.concatenate([rng.integers(0, 500, (n, 1)), rng.uniform(-1, 2, (n, 2)), rng.uniform(0.3, 0.5, (n, 1)), rng.integers(-3, 4, (n, 1))], axis=1)
    circles = circles[np.lexsort((circles[:, 4], circles[:, 0]))]  # brute force takes the first of equal seqs, and so the larger value last
    points = rng.uniform(-1.5, 2.5, (400, 2))
    check(spark, points, rects, circles[::-1], crowd=100)
    as_table = lambda rows, kind: spark.createDataFrame([tuple(r) for r in rows.tolist()], kind)
    zones = lookup._zones(as_table(rects, RECT), as_table(circles, CIRCLE.replace("seq long", "seq double")), 1.0)
    tiled = zones.withColumns({"tx": F.floor("x0").cast("long"), "ty": F.floor("y0").cast("long")}).where("level = 0")
    assert lookup._pruned(tiled, 1.0, 100).count() * 2 < tiled.count()


def test_zones_of_one_place_and_odd_values(spark):
    circles = spark.createDataFrame([(float(i), 5.0, 5.0, 2.0, float(-i)) for i in range(2000)] + [(None, 5.0, 5.0, 3.0, 7.0), (9e9, 5.0, 5.0, 3.0, None), (1999.0, 5.0, 5.0, 2.0, 4.0)], "seq double, x double, y double, r double, value double")
    assert lookup._zones(None, circles, 1.0).count() == 1
    df = spark.createDataFrame([(5.0, 5.0), (5.0, 7.5)], "x double, y double")
    assert [r["value"] for r in lookup.tag_zones_by_tile(df, circles=circles).orderBy("y").collect()] == [4.0, 0.0]
