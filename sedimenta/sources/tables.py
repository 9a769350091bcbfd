"""Vector indexes, fine-tuning splits, table questions, image files and vocabularies."""

from __future__ import annotations

import gzip
import json
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX = "embedding array<float>, path string"
TABLES = "id string, header array<string>, types array<string>"
QUESTIONS = "table_id string, question string, sql struct<sel: int, agg: int, conds: array<array<string>>>"


def write_index(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.select("embedding", "path").write.format(fmt).save(path)


def load_index(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The index; an error if it is empty, and a warning if its entries differ in dimension. Spark reports a missing path itself."""
    reader = spark.read.schema(INDEX)
    index = reader.option("multiLine", "true").json(path) if fmt == "json-array" else reader.format(fmt).load(path)
    count, first, sizes = index.agg(F.count("*"), F.min_by(F.size("embedding"), "path"), F.count_distinct(F.size("embedding"))).first()
    if not count:
        raise ValueError(f"the index at {path} is empty")
    if sizes > 1:
        other = index.where(F.size("embedding") != first).agg(F.min_by(F.size("embedding"), "path"), F.min("path")).first()
        warnings.warn(f"the index at {path} has entries of other dimensions than {first}, the first being {other[1]} with {other[0]}", stacklevel=2)
    return index


def read_sft(spark: SparkSession, root: str, split: str, fmt: str = "jsonl", required: bool = True, folder: str | None = None) -> DataFrame:
    """text and split of one split, an example per line of its jsonl or txt file (or of the files of ``folder``); an error if it must
    have some and has none."""
    path = folder or f"{root}/{split}.{fmt}"
    rows = spark.read.schema("text string").json(path) if fmt == "jsonl" else spark.read.text(path).withColumnRenamed("value", "text")
    rows = rows.where("text IS NOT NULL").withColumn("split", F.lit(split))
    if required and rows.isEmpty():
        raise ValueError(f"the split {split} in {root} has no examples")
    return rows


def write_sft(df: DataFrame, folder: str) -> None:
    """A folder of JSON lines for each split."""
    df.select("text", "split").write.partitionBy("split").json(folder)


def read_wikisql(spark: SparkSession, folder: str, split: str) -> tuple[DataFrame, DataFrame]:
    """(questions, tables) of a split."""
    tables = spark.read.schema(TABLES).json(f"{folder}/{split}.tables.jsonl")
    return spark.read.schema(QUESTIONS).json(f"{folder}/{split}.jsonl"), tables


def _decode(content: bytes, images: bool, size: int) -> np.ndarray:
    raw = np.frombuffer(gzip.decompress(content), dtype=np.uint8)
    return raw[16:].reshape(-1, size).astype(np.float32) / 255 if images else raw[8:].astype(np.int32)


def decode_idx(files: DataFrame, column: str, size: int = 784, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, idx and ``column`` (pixels or label) of the records of gzipped files, whose bytes are in content. A file is one task: gzip
    can't be split."""
    kinds = "".join(f"{k} {files.schema[k].dataType.simpleString()}, " for k in keys)

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                data = _decode(row.content, column == "pixels", size)
                for i in range(0, len(data), 4096):
                    part = data[i : i + 4096]
                    yield pd.DataFrame({**{k: [getattr(row, k)] * len(part) for k in keys}, "idx": np.arange(i, i + len(part)), column: list(part)})

    return files.select(*keys, "content").mapInPandas(run, f"{kinds}idx long, {column} {'array<float>' if column == 'pixels' else 'int'}")


def read_bpe(spark: SparkSession, vocabulary: str, merges: str) -> tuple[dict[str, int], dict[tuple[str, str], int]]:
    """Piece to id, and pair to rank: the first line of the merges is a comment, blank lines don't count. A vocabulary is model
    data of fixed size, and each task gets all of it."""
    ids = json.loads("\n".join(r[0] for r in spark.read.option("wholetext", "true").text(vocabulary).collect()))
    lines = "\n".join(r[0] for r in spark.read.option("wholetext", "true").text(merges).collect()).split("\n")[1:]
    pairs = [tuple(x.split(" ")) for x in (y.strip() for y in lines) if x]
    return ids, {p: i for i, p in enumerate(pairs)}


def read_bpe_json(spark: SparkSession, path: str) -> tuple[dict[str, int], dict[tuple[str, str], int]]:
    """The same from a tokenizer's JSON file, whose merges are strings or pairs."""
    spec = json.loads("\n".join(r[0] for r in spark.read.option("wholetext", "true").text(path).collect()))
    model = spec["model"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return model["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}, {p: i for i, p in enumerate(pairs)}
