"""Totals of skewed keys against plain windows."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.llm.support import running_total, with_totals


def skewed(spark):
    return spark.range(2000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), (F.col("id") * 37 % 101).alias("v"), "id", F.lit("x").alias("salt")).repartition(6)


def test_totals(spark):
    df, w = skewed(spark), W.partitionBy("k")
    want = df.withColumns({"low": F.min("v").over(w), "n": F.sum(F.lit(1)).over(w)})
    got = with_totals(df, "k", low=F.min("v"), n=F.sum(F.lit(1)))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert with_totals(df.limit(0), "k", n=F.sum(F.lit(1))).count() == 0


def test_running_total(spark):
    df = skewed(spark)
    want = df.withColumn("total", F.sum("v").over(W.partitionBy("k").orderBy("v", "id").rowsBetween(W.unboundedPreceding, 0)))
    got = running_total(df, "k", ["v", "id"], F.col("v"), "total")
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_near_duplicates_beside_taken_names(spark):
    from sedimenta.llm.neardup import drop_near_duplicates

    rows = [(1, "a b c d e f", 5), (2, "a b c d e f", 6), (3, None, 7), (None, "a b c d e f", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone_id int")
    assert sorted(r["gone_id"] for r in drop_near_duplicates(df).collect()) == [5, 7, 8]
    assert drop_near_duplicates(df.limit(0)).collect() == []
