"""Pairs of gzipped image and label files as a data source: inflated while they are read, paired by position without a join."""

from __future__ import annotations

import gzip
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from sedimenta.sources.folder import file_system

#: Fixed lengths of the headers, and records of a batch.
_IMAGES, _LABELS, _BATCH = 16, 8, 4096
SCHEMA = "file string, idx long, pixels array<float>, label int"


@dataclass
class Pair(InputPartition):
    images: str
    labels: str


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


def records(images, labels, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and labels of two inflating streams, batch by batch; an error if one has more records than the other or ends inside one."""
    if len(images.read(_IMAGES)) < _IMAGES or len(labels.read(_LABELS)) < _LABELS:
        raise ValueError("a file is shorter than its header")
    while True:
        raw, named = images.read(_BATCH * size), labels.read(_BATCH)
        if len(raw) != len(named) * size:
            raise ValueError("images and labels are not of the same number")
        if not named:
            return
        yield np.frombuffer(raw, dtype=np.uint8).reshape(-1, size), np.frombuffer(named, dtype=np.uint8)


class PairReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.size = options, int(options.get("size", 784))

    def partitions(self) -> list[Pair]:
        if "images" in self.options:
            return [Pair(self.options["images"], self.options["labels"])]
        root = self.options["path"].rstrip("/")
        fs, folder = file_system(root)
        names = sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(folder)) if f.is_file and f.base_name.startswith("images-"))
        return [Pair(f"{root}/{n}", f"{root}/labels-{n.removeprefix('images-')}") for n in names]

    def read(self, partition: Pair | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for where there are no partitions
            return
        (fs, images), (_, labels) = file_system(partition.images), file_system(partition.labels)
        name, at = partition.images.rsplit("/", 1)[-1], 0
        with fs.open_input_stream(images, compression=None) as a, fs.open_input_stream(labels, compression=None) as b, gzip.GzipFile(fileobj=a) as x, gzip.GzipFile(fileobj=b) as y:
            for pixels, named in records(x, y, self.size):
                n = len(named)
                flat = pa.array((pixels.astype(np.float32) / 255).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * self.size), flat)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(at, at + n)), lists, pa.array(named.astype(np.int32))], names=["file", "idx", "pixels", "label"])
                at += n


class PairWriter(DataSourceArrowWriter):
    """A pair of files per task; counts in the headers are those of the task's rows. Files are hidden until all tasks are done."""

    def __init__(self, options: dict[str, str]):
        self.path, self.size = options["path"].rstrip("/"), int(options.get("size", 784))
        fs, folder = file_system(self.path)
        fs.create_dir(folder)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = file_system(self.path)
        task, total = uuid.uuid4().hex, 0
        names = [f"{kind}-{task}.gz" for kind in ("images", "labels")]
        # Headers tell the number of records, which is known at the end: bodies are members of their own behind a header's.
        bodies = [f"{folder}/.{n}.body" for n in names]
        streams = [fs.open_output_stream(p, compression=None) for p in bodies]
        packers = [gzip.GzipFile(fileobj=s, mode="wb", mtime=0) for s in streams]
        for batch in iterator:
            pixels, named = batch["pixels"].flatten().to_numpy(zero_copy_only=False), batch["label"].to_numpy()
            if len(pixels) != batch.num_rows * self.size:
                raise ValueError(f"an image hasn't {self.size} pixels")
            packers[0].write(np.rint(pixels * 255).astype(np.uint8).tobytes())
            packers[1].write(named.astype(np.uint8).tobytes())
            total += batch.num_rows
        for packer, s in zip(packers, streams, strict=True):
            packer.close()
            s.close()
        side = struct.pack(">II", 1, self.size)
        for name, body, head in zip(names, bodies, (struct.pack(">II", 0x803, total) + side, struct.pack(">II", 0x801, total)), strict=True):
            with fs.open_output_stream(f"{folder}/.{name}", compression=None) as out:
                out.write(gzip.compress(head, mtime=0))
                with fs.open_input_stream(body, compression=None) as kept:
                    while part := kept.read(1 << 20):
                        out.write(part)
            fs.delete_file(body)
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = file_system(self.path)
        for name in (n for m in messages if m for n in m.names):
            fs.move(f"{folder}/.{name}", f"{folder}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = file_system(self.path)
        for name in (n for m in messages if m for n in m.names):
            fs.delete_file(f"{folder}/.{name}")


class IdxPairs(DataSource):
    """Options: images and labels (a pair of files), or path (a folder of pairs images-X, labels-X); size (pixels of an image)."""

    @classmethod
    def name(cls) -> str:
        return "idx_pairs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PairReader:
        return PairReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> PairWriter:
        return PairWriter(dict(self.options))


def read_idx_folder(spark: SparkSession, folder: str, size: int = 784) -> DataFrame:
    """file (of the images), idx (place in it), pixels (0 to 1), label of all pairs of a folder, a task for each pair (gzip can't be split): a
    task holds one batch of records, however long the files. Files of different numbers of records are an error."""
    spark.dataSource.register(IdxPairs)
    return spark.read.format("idx_pairs").option("size", str(size)).load(folder)


def read_idx(spark: SparkSession, images: str, labels: str, use: str, size: int = 784) -> DataFrame:
    """use, idx, pixels (0 to 1), label of a pair of gzipped image and label files, read as by ``read_idx_folder``."""
    spark.dataSource.register(IdxPairs)
    rows = spark.read.format("idx_pairs").option("images", images).option("labels", labels).option("size", str(size)).load()
    return rows.select(F.lit(use).alias("use"), "idx", "pixels", "label")


def write_idx(df: DataFrame, folder: str, size: int = 784) -> None:
    """A pair of files for each partition of ``df`` (pixels 0 to 1, label 0 to 255), in its order."""
    df.sparkSession.dataSource.register(IdxPairs)
    df.select(F.lit("").alias("file"), F.lit(0).cast("long").alias("idx"), F.col("pixels").cast("array<float>").alias("pixels"), F.col("label").cast("int").alias("label")).write.format("idx_pairs").mode("append").option("size", str(size)).save(folder)
