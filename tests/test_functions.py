"""Edge cases of vector and scalar functions on literal rows."""

import math

import pytest
from pyspark.sql import functions as F

from sedimenta.functions import scalars, vectors

NAN, INF = float("nan"), float("inf")


def one(spark, expr, **columns):
    kinds = {list: "array<double>", int: "long", float: "double", str: "string"}
    row = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in columns.items()))
    got = row.select(expr.alias("out")).first()["out"]
    return got.asDict() if hasattr(got, "asDict") else got


@pytest.mark.parametrize(
    ("v", "clean", "unit"),
    [
        ([], [], []),
        ([3.0, 4.0], [3.0, 4.0], [0.6, 0.8]),
        ([NAN, 2.0], [0.0, 2.0], [0.0, 1.0]),
        ([INF, -INF], [0.0, 0.0], [0.0, 0.0]),
        ([1e-6, 0.0], [1e-6, 0.0], [1e-6, 0.0]),
        ([1e200, 1e200], [1e200, 1e200], []),
    ],
)
def test_sanitize_and_normalize(spark, v, clean, unit):
    assert one(spark, vectors.sanitize("v"), v=v) == clean
    assert one(spark, vectors.normalize("v"), v=v) == pytest.approx(unit)


def test_products(spark):
    assert one(spark, vectors.dot("a", "b"), a=[1.0, 2.0], b=[3.0, 4.0]) == 11
    assert one(spark, vectors.dot("a", "b"), a=[1.0], b=[3.0, 4.0]) == 0 == one(spark, vectors.dot("a", "b"), a=[], b=[])
    assert one(spark, vectors.cosine("a", "b"), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(1 / math.sqrt(2))
    assert one(spark, vectors.cosine("a", "b"), a=[0.0], b=[1.0]) == 0
    assert one(spark, vectors.l2_norm("a"), a=[]) == 0
    assert one(spark, vectors.has_non_finite("a"), a=[1.0, INF]) and not one(spark, vectors.has_non_finite("a"), a=[1.0])


def test_statistics(spark):
    assert one(spark, vectors.vector_stats("a"), a=[]) == {"mean": 0, "min": 0, "max": 0, "norm": 0}
    assert one(spark, vectors.vector_stats("a"), a=[1.0, -1.0, 3.0])["mean"] == 1
    assert one(spark, vectors.argmax("a"), a=[1.0, 5.0, 5.0]) == 1
    assert one(spark, vectors.layer_norm("a"), a=[1.0, 3.0]) == pytest.approx([-1 / math.sqrt(1 + 1e-5), 1 / math.sqrt(1 + 1e-5)])
    assert one(spark, vectors.log_sum_exp("a"), a=[1000.0, 1000.0]) == pytest.approx(1000 + math.log(2))
    assert one(spark, vectors.guided_combine("a", "b", 2.0), a=[1.0], b=[3.0]) == [5.0]
    assert one(spark, vectors.guided_combine("a", "b", 1.0), a=[1.0], b=[3.0]) == [3.0]


@pytest.mark.parametrize(("n", "want"), [(0, "0 KB"), (1023, "0 KB"), (2560, "2 KB"), (3584, "4 KB"), (5 << 20, "5 MB"), (3 << 29, "1.50 GB")])
def test_format_bytes(spark, n, want):
    assert one(spark, scalars.format_bytes("n"), n=n) == want


def test_labels_and_sizes(spark):
    assert one(spark, scalars.model_label("s", "n"), s="a/b/c", n=7 * 10**9).startswith("c - 6.7B")
    assert one(spark, scalars.model_label("s", "n"), s="x", n=500 << 20) == "x - 500M"
    assert one(spark, scalars.fit_size("w", "h", 512), w=1000, h=500) == {"width": 512, "height": 256}
    assert one(spark, scalars.fit_size("w", "h"), w=100, h=200) == {"width": 64, "height": 192}
    assert one(spark, scalars.scale_pixels("a", "decode"), a=[-3.0, 0.0, 3.0]) == [0.0, 0.5, 1.0]
    assert one(spark, scalars.scale_pixels("a", "byte"), a=[0.999]) == [254]


def test_ramp(spark):
    colours = [(0, 0, 0, 255), (255, 0, 0, 255), (255, 255, 255, 255)]
    out = lambda x: one(spark, scalars.apply_ramp("x", colours, 10.0, (1, 2, 3, 4)), x=x)
    assert out(0.0) == [0, 0, 0, 255] and out(2.5) == [128, 0, 0, 255] and out(10.0) == [1, 2, 3, 4] and out(7.5) == [255, 128, 128, 255]


def test_splitmix_first_words(spark):
    got = [r["w"] % (1 << 64) for r in spark.range(3).select(scalars.splitmix64(0, "id").alias("w")).collect()]
    assert got == [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4, 0x06C45D188009454F]


def test_training_log(spark):
    lines = ["Iteration 10: training loss 2.356848, iterations/sec 2.640604, Tokens/sec 260.363581", "Iteration 1: validation loss 2.443872, validation time 3.330629s", "Iteration 100: saved weights to a.bin", "Test loss 1.327623, ppl 3.772065", "other", None]
    rows = {r["kind"]: r for r in scalars.parse_training_log(spark.createDataFrame([(x,) for x in lines], "line string")).collect()}
    assert rows["training"]["tokens_per_second"] == 260.363581 and rows["validation"]["seconds"] == 3.330629
    assert rows["saved"]["path"] == "a.bin" and math.exp(rows["test"]["loss"]) == pytest.approx(rows["test"]["perplexity"], rel=1e-5)
    assert len(rows) == 4


def test_unit_vectors_stay_unit(spark):
    rows = spark.range(50).select(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.sin(i * (F.col("id") + 1))).alias("v"))
    assert all(abs(r["n"] - 1) < 1e-12 for r in rows.select(vectors.l2_norm(vectors.normalize("v")).alias("n")).collect())
