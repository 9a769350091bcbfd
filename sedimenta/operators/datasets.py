"""Order, shuffles and batches of labelled datasets, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from sedimenta.functions.scalars import splitmix64
from sedimenta.sources.scratch import scratch


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    return [next(name for name in ("_" * i + w for i in range(len(taken) + 1)) if name.lower() not in taken) for w in wanted]


def with_position(df: DataFrame, *order: str | Column, out: str = "position", parts: int | None = None) -> DataFrame:
    """Add each row's place (from 0) in a total order of columns of any type. Rows are range-partitioned by all keys, numbered
    inside their partition, and moved up by the rows of the partitions before; only the partitions' counts meet in one task.

    The ranged rows are written first, so that counts and places see the same partitions. Rows that tie on all keys follow one
    another in any order; a hash of the row ranges them too, so that ties, however many, are spread over the partitions. Columns of ``df`` keep their names, whatever they are; a column named ``out`` is replaced.
    """
    spark = df.sparkSession
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    keys.append(F.xxhash64(*(f"`{f.name}`" for f in df.schema if not isinstance(f.dataType, MapType | VariantType))))
    part, at, n, before, *own = free_names(df, "part", "at", "n", "before", *(f"key{i}" for i in range(len(keys))))
    ranged = df.select("*", *(k.alias(c) for k, c in zip(keys, own, strict=True))).repartitionByRange(parts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))), *own)
    path = scratch(spark, "ranges")
    marked = ranged.withColumn(part, F.spark_partition_id())
    marked.write.parquet(path)
    marked = spark.read.schema(marked.schema).parquet(path)
    ahead = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    offsets = F.broadcast(marked.groupBy(part).agg(F.count("*").alias(n)).select(part, F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(before)))  # a row per partition
    placed = marked.withColumn(at, F.row_number().over(W.partitionBy(part).orderBy(*own))).join(offsets, part)
    return placed.select(*(c for c in df.columns if c != out), (F.col(before) + F.col(at) - 1).cast("long").alias(out))


def assign_batches(df: DataFrame, *order: str | Column, size: int) -> DataFrame:
    """Add batch_id and pos: runs of ``size`` rows (1 at least) in the order; the last may be short."""
    size, place = max(1, size), free_names(df, "position")[0]
    at = F.col(place)
    return with_position(df, *order, out=place).withColumns({"batch_id": F.floor(at / size), "pos": (at % size).cast("int")}).drop(place)


def seeded_shuffle(df: DataFrame, key: str, seed: int, epoch: int = 0) -> DataFrame:
    """Add position: a place in an order that depends on seed, epoch and key alone, anew for each epoch: the order of the seed's
    random words at the key's places, where a key that is no whole number is hashed first."""
    whole = df.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    number = F.col(key).cast("long") if whole else F.xxhash64(key)
    return with_position(df, splitmix64(seed + 1_000_003 * epoch, number), key)


def pad_batch(df: DataFrame, by: str, ids: str = "ids", pad_id: int = 0) -> DataFrame:
    """Lengthen each list of ids to its batch's longest with the pad id."""
    most = free_names(df, "most")[0]
    wide = df.withColumn(most, F.max(F.size(ids)).over(W.partitionBy(by)))
    return wide.withColumn(ids, F.concat(F.col(ids), F.array_repeat(F.lit(pad_id), F.col(most) - F.size(ids)))).drop(most)


def cap_batches(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` batches; 0 keeps all."""
    return df.where(F.col("batch_id") < n) if n > 0 else df
