"""Running a stream over what is there, into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.sources.scratch import scratch
from sedimenta.streaming.streams import search_batches


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The files of a table (one, or a folder of them) as a stream."""
    path = f"{folder}/{name}.parquet"
    rows = spark.read.parquet(path)
    stream = spark.readStream.schema(rows.schema)
    if any(f.endswith(f"/{name}.parquet") for f in rows.inputFiles()):  # a file is watched by way of its folder
        return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return stream.parquet(path)


def drain(stream: DataFrame, mode: str = "append", key: str | None = None) -> DataFrame:
    """Run a streaming query until its source is used up and return what it has emitted: all rows in append mode, the last
    row of each ``key`` in update mode, the last state of the result in complete mode."""
    spark, at = stream.sparkSession, scratch(stream.sparkSession, "stream")
    if mode == "append":
        writer = stream.writeStream.outputMode("append").format("parquet").option("path", f"{at}/out")
    elif mode == "update":  # a batch that is run again replaces itself
        writer = stream.writeStream.outputMode("update").foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{at}/out/epoch={epoch}"))
    else:
        writer = stream.writeStream.outputMode(mode).foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{at}/out"))
    query = writer.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if mode == "update":
        found = spark.read.parquet(f"{at}/out")
        last = found.groupBy(key).agg(F.max_by(F.struct(*(c for c in stream.columns if c != key)), "epoch").alias("row"))
        return last.select(key, "row.*").select(*stream.columns)
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def drain_search(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Hits of all queries of a stream in a fixed index."""
    spark, at = queries.sparkSession, scratch(queries.sparkSession, "stream")
    sink = lambda hits, epoch: hits.write.mode("overwrite").parquet(f"{at}/out/epoch={epoch}")  # noqa: E731  a batch that is run again replaces itself
    run = queries.writeStream.foreachBatch(search_batches(index, k, sink)).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{at}/out").drop("epoch")
