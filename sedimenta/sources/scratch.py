"""A fresh folder for intermediate tables, in the shared folder of the session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` (or the context's checkpoint folder) names. Where neither is set, a session on
    one machine is given a temporary folder; on a cluster, whose executors would each write to a disk of their own, it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sedimenta-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


#: Names given out in this process and not yet cleared.
_GIVEN: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A new name below the shared folder."""
    _GIVEN.append(f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}")
    return _GIVEN[-1]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, so that later jobs neither
    recompute it nor depend on the executors that made it."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that are written to the shared folder inside are deleted at the end: results that read them must have been used by then.
    Names given out before stay."""
    first = len(_GIVEN)
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        while len(_GIVEN) > first:
            path = jvm.org.apache.hadoop.fs.Path(_GIVEN.pop())
            path.getFileSystem(conf).delete(path, True)
