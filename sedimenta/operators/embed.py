"""Embedding documents with a pluggable model, and pooling token vectors."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.vectors import layer_norm, normalize, sanitize


#: White space between words, and words that a task remembers.
_SPACE, REMEMBERED = re.compile("[ \\t\\n\\x0b\\f\\r]+"), 500_000


def _code(word: str, dimension: int) -> int:
    """A word's place, plus the dimension if it adds 1 there instead of taking it."""
    digest = hashlib.md5(word.encode()).hexdigest()
    return int(digest[:8], 16) % dimension + (dimension if digest[8] >= "8" else 0)


def hashing_embeddings(docs: DataFrame, key: str = "path", text: str = "contents", dimension: int = 64) -> DataFrame:
    """key, embedding (array of doubles) by a model without weights: each word adds or takes 1 at a place, both read off its MD5. Rows
    without words are left out; rows that repeat a key stay apart.

    A row's words are counted where they are, in Arrow batches, by a dictionary of the words that the task has seen; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            vectors, rows = [], []
            for i, t in enumerate(x.as_py() for x in batch["t"]):
                words = [w for w in _SPACE.split(t or "") if w]
                if not words:
                    continue
                codes = list(map(known.get, words))
                if None in codes:
                    if len(known) > REMEMBERED:
                        known.clear()
                    for j, c in enumerate(codes):
                        if c is None:
                            codes[j] = known[words[j]] = _code(words[j], dimension)
                counts = np.bincount(codes, minlength=2 * dimension)
                vectors.append(counts[dimension:] - counts[:dimension])
                rows.append(i)
            flat = np.concatenate(vectors).astype(np.float64) if vectors else np.zeros(0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * dimension), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch["k"].take(pa.array(rows, pa.int64())), lists], names=["k", "embedding"])

    kind = f"k {docs.schema[key].dataType.simpleString()}, embedding array<double>"
    return docs.select(F.col(key).alias("k"), F.lower(text).alias("t")).mapInArrow(run, kind).withColumnRenamed("k", key)


def embed_pieces(pieces: DataFrame, key: str = "path", text: str = "contents", dimension: int = 64, normalized: bool = True) -> DataFrame:
    """key, embedding by ``hashing_embeddings`` of documents in any number of pieces, which don't cut words. The counts of a document's pieces
    are added up in their tasks; one vector a document and task is shuffled."""
    found = hashing_embeddings(pieces, key, text, dimension)
    total = found.groupBy(key).agg(*(F.sum(F.get("embedding", F.lit(i))).alias(f"at{i}") for i in range(dimension)))
    e = F.array(*(f"at{i}" for i in range(dimension)))
    return total.select(key, (normalize(e) if normalized else sanitize(e)).alias("embedding"))


class HashingEmbedder:
    """The same model as a plug."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def __call__(self, texts: list[str]) -> list[list[float] | None]:
        out = []
        for words in (t.lower().split() for t in texts):
            v = np.zeros(self.dimension)
            for d in (hashlib.md5(w.encode()).hexdigest() for w in words):
                v[int(d[:8], 16) % self.dimension] += 1 if d[8] >= "8" else -1
            out.append(v.tolist() if words else None)
        return out


#: The model that a worker holds, by the name of the call that it is for.
_MODEL: dict[str, Callable[[list[str]], list]] = {}


def loaded(name: str, load: Callable[[], Callable[[list[str]], list]]) -> Callable[[list[str]], list]:
    """A worker's model: made at its first task, kept for those that follow, and let go when another one is asked for."""
    if name not in _MODEL:
        _MODEL.clear()
        _MODEL[name] = load()
    return _MODEL[name]


def embed_documents(docs: DataFrame, load: Callable[[], Callable[[list[str]], list]] | None = None, key: str = "path", text: str = "contents", batch_size: int = 8, normalized: bool = True) -> DataFrame:
    """key, embedding of the documents that have tokens, by ``hashing_embeddings`` or by a plugged model. ``load`` makes the model, once
    per worker; within an Arrow batch texts go to it in runs of ``batch_size``, sorted by length."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loaded(name, load)
        for pdf in batches:
            pdf = pdf.iloc[np.argsort(pdf["t"].str.len().fillna(0).to_numpy(), kind="stable")]
            size = max(1, min(batch_size, len(pdf)))
            for i in range(0, len(pdf), size):
                part = pdf.iloc[i : i + size]
                found = model(part["t"].fillna("").tolist())
                yield pd.DataFrame({key: part["k"].tolist(), "embedding": found}).dropna(subset=["embedding"])

    if load is None:
        raw = hashing_embeddings(docs, key, text)
    else:
        kind = f"{key} {docs.schema[key].dataType.simpleString()}, embedding array<double>"
        raw = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, kind)
    return raw.withColumn("embedding", normalize("embedding") if normalized else sanitize("embedding"))


def pool(strategy: str | None, tokens: str | Column, mask: str | Column | None = None, normed: bool = False, normalized: bool = True) -> Column:
    """One vector from a document's token vectors (an array of arrays): mean, max, last, or first (also called cls), of those
    tokens that the mask lets through. No strategy is the mean. ``normed`` normalizes each token vector's layer first."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    if mask is not None:
        m = F.col(mask) if isinstance(mask, str) else mask
        t = F.transform(F.filter(F.arrays_zip(t.alias("t"), m.alias("m")), lambda x: x["m"]), lambda x: x["t"])
    if normed:
        t = F.transform(t, lambda v: layer_norm(v))
    places = F.sequence(F.lit(0), F.size(F.get(t, F.lit(0))) - 1)
    column = lambda i: F.transform(t, lambda v: F.get(v, i).cast("double"))
    how = {
        "mean": lambda: F.transform(places, lambda i: F.aggregate(column(i), F.lit(0.0), lambda a, x: a + x) / F.size(t)),
        "max": lambda: F.transform(places, lambda i: F.array_max(column(i))),
        "first": lambda: F.transform(F.get(t, F.lit(0)), lambda x: x.cast("double")),
        "last": lambda: F.transform(F.get(t, F.size(t) - 1), lambda x: x.cast("double")),
    }
    name = {None: "mean", "none": "mean", "cls": "first"}.get(strategy, strategy)
    v = F.when(F.size(t) > 0, how[name]()).otherwise(F.array().cast("array<double>"))
    return normalize(v) if normalized else v


def pool_rows(tokens: DataFrame, dimension: int, strategy: str | None = "mean", key: str = "path", pos: str = "pos", vector: str = "vector", mask: str | None = None, normed: bool = False, normalized: bool = True) -> DataFrame:
    """key, embedding: ``pool`` for token vectors that are rows. Whole vectors are aggregated in their tasks before the shuffle, which carries
    one vector a document and task, so a document of any number of tokens is never one row.

    Of tokens of one position, first and last take the one with the smallest and largest vector. Masked tokens, null vectors and vectors of
    another dimension don't count; a document without any other has an empty embedding. The mean of no strategy is the mean.
    """
    v = F.col(vector).cast("array<double>")
    own = F.when((F.size(v) == dimension) & (F.coalesce(F.col(mask), F.lit(False)) if mask else F.lit(True)), layer_norm(v) if normed else v)
    rows = tokens.select(F.col(key).alias("k"), F.col(pos).alias("p"), own.alias("v"))
    name = {None: "mean", "none": "mean", "cls": "first"}.get(strategy, strategy)
    there, place = F.col("v").isNotNull(), F.struct("p", "v")
    at = [F.get("v", F.lit(i)) for i in range(dimension)]
    how = {
        "mean": lambda: F.array(*(F.avg(a) for a in at)),
        "max": lambda: F.array(*(F.max(a) for a in at)),
        "first": lambda: F.min_by("v", F.when(there, place)),
        "last": lambda: F.max_by("v", F.when(there, place)),
    }
    pooled = rows.groupBy("k").agg(F.count("v").alias("n"), how[name]().alias("e"))
    e = F.when(F.col("n") > 0, F.col("e")).otherwise(F.array().cast("array<double>"))
    return pooled.select(F.col("k").alias(key), (normalize(e) if normalized else e).alias("embedding"))


def pooling_fallback(strategy: str | None) -> str | None:
    """Message for a strategy that the pooling replaces."""
    return "no pooling strategy given; token vectors are averaged" if strategy in (None, "none") else None
