"""Nearest neighbours against brute force; Hilbert keys against the curve's properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.llm import ann, queries
from sedimenta.llm.hilbert import hilbert_keys


@pytest.mark.parametrize(("dims", "bits"), [(1, 5), (2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_is_a_path(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = hilbert_keys(grid, bits)
    assert sorted(keys) == list(range(1 << dims * bits))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def brute(rows, asked, k=10):
    good = [(i, np.asarray(v, dtype=np.float64)) for i, v in rows if v is not None and i is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, x in good:
        if asked(q):
            out[q] = sorted((math.sqrt(((x - y) ** 2).sum()), i) for i, y in good if i != q)[:k]
    return out


def test_one_range_is_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(300)]
    rows += [(i, [1.0, *[0.0] * 7]) for i in range(300, 500)]
    rows += [(500, None), (600, [0.0] * 8), (700, [float("nan")] * 8), (800, [1.0, None] * 4), (900, [1.0] * 5), (None, [1.0] * 8), (1000, [float("inf")] * 8)]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<double>, part int").repartition(4)
    want = brute(rows, lambda i: i % 100 == 0)
    got = {}
    for r in ann.nearest(df.union(df.where("vec_id = 7")), F.col("vec_id") % 100 == 0, ranges=1).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}
    assert all(abs(a[0] - b[0]) < 1e-12 for q in want for a, b in zip(got[q], want[q], strict=True))


def test_few_and_no_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    some = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], kind), F.col("vec_id") % 100 == 0)
    assert [(r["rank"], r["vec_id"]) for r in some.orderBy("rank").collect()] == [(1, 2), (2, 1)]
    assert ann.nearest(spark.createDataFrame([], kind), F.col("vec_id") == 0).collect() == []
    assert ann.nearest(spark.createDataFrame([(5, None)], kind), F.col("vec_id") == 5).collect() == []


def recall(spark, data):
    """Share of the true neighbours (at their distances) that the registered query finds."""
    rows = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    x, ids = np.stack(rows["embedding"]).astype(np.float64), rows["vec_id"].to_numpy()
    got = queries.op1_hilbert_ann(spark, data).toPandas()
    hits = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        near = np.sort(d[ids != q])[:10]
        own = got[got["query_id"] == q].sort_values("rank")
        assert own["score"].is_monotonic_increasing and len(own) == 10
        hits += (own["score"] <= near[-1] + 1e-9).sum()
    return hits / len(got)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_recall_of_the_query(spark, size):
    """500 and 2,000 rows, close to isotropic; the curves decide at both."""
    assert recall(spark, f"/root/testdata/{size}") >= 0.9


def test_recall_at_fifty_thousand_rows(spark, tmp_path):
    """Points near planes of a few dimensions, where curves narrow the search."""
    base = [F.randn(seed=i) for i in range(6)]
    mixed = [sum(b * math.sin(1 + 7 * i + j) for j, b in enumerate(base)) + 0.05 * F.randn(seed=100 + i) for i in range(32)]
    spark.range(0, 50_000, 1, 4).select(F.col("id").alias("vec_id"), F.array(*mixed).alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert recall(spark, str(tmp_path)) >= 0.9


def test_recall_beside_a_heavy_cluster(spark):
    """A third of all rows differ by a millionth and share a key; the queries lie just outside. One curve, which has to meet them all."""
    at = F.array(*[F.randn(seed=i) for i in range(8)])
    kind = F.when(F.col("id") % 100 == 0, 0.02).when(F.col("id") % 3 == 0, 1e-6).otherwise(1.0)
    df = spark.range(0, 14_000, 1, 4).select(F.col("id").alias("vec_id"), F.transform(at, lambda x: x * kind).alias("embedding"))
    rows = df.toPandas()
    x, ids = np.stack(rows["embedding"]), rows["vec_id"].to_numpy()
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0, curves=1, axes=1, bits=10).collect():
        got.setdefault(r["query_id"], []).append(r["score"])
    shares = []
    for q in ids[ids % 100 == 0]:
        best = np.sort(np.sqrt(((x[ids != q] - x[ids == q]) ** 2).sum(axis=1)))[:10]
        shares.append(np.mean(np.array(sorted(got[q])) <= best[-1] + 1e-9))
    assert np.mean(shares) >= 0.9
