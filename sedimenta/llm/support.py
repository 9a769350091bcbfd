"""Helpers that several operators share: scratch tables, and vectorised word scanning inside tasks."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.sources.scratch import materialize

# --------------------------------------------------------------------------- scratch tables


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` doesn't have yet, made from the wanted ones."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def with_totals(df: DataFrame, key: str, **totals: Column) -> DataFrame:
    """Add to each row the totals (aggregates by name) of its key. They come from partial aggregation and are written before they are
    joined back, so that the join stands alone: Spark broadcasts totals that turn out small, and else splits frequent keys."""
    whole = df.groupBy(key).agg(*(c.alias(name) for name, c in totals.items()))
    return df.join(materialize(whole, "totals"), key)


def running_total(df: DataFrame, key: str, order: list[str], size: Column, out: str) -> DataFrame:
    """Add the sum of ``size`` over a key's rows up to each, in the order, without bringing a key's rows to one task.

    Rows are range-partitioned by key and order, summed within their partition, and moved up by the key's sums of the
    partitions before. ``order`` and the key tell rows apart, so that a frequent key is cut.
    """
    spark, (part, amount, before) = df.sparkSession, free_name(df, "part", "amount", "before")
    dealt = df.withColumn(amount, size).repartitionByRange(shuffle_partitions(spark), key, *order).withColumn(part, F.spark_partition_id())
    dealt = materialize(dealt, "ranges")
    ahead = W.partitionBy(key).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    moved = dealt.groupBy(key, part).agg(F.sum(amount).alias(before)).select(key, part, F.coalesce(F.sum(before).over(ahead), F.lit(0)).alias(before))
    inside = W.partitionBy(key, part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    summed = dealt.withColumn(amount, F.sum(amount).over(inside))
    return summed.join(moved, [key, part]).withColumn(out, F.col(amount) + F.col(before)).drop(part, amount, before)


def utf8(text: str | Column) -> Column:
    """Text as bytes, null as empty."""
    return F.coalesce((F.col(text) if isinstance(text, str) else text).cast("binary"), F.lit(b""))


# --------------------------------------------------------------------------- words in a batch

_MUL = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MUL, -1, 1 << 64)
#: Places hashed at a time, so that the arrays stay in the processor's cache.
SEGMENT = 1 << 16


@functools.cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's odd base and of its inverse, for every offset in a segment and beyond its end."""
    out = []
    for base in (_MUL, _INV):
        x = np.full(2 * SEGMENT + 1, base, dtype=np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans_of(buf: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes for which ``member`` (256 booleans) holds."""
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    inside[1:-1] = member[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprint of every span; spans are in order and don't overlap.

    A polynomial in a fixed odd base, read off prefix sums, in segments of bounded size. Spans
    longer than a segment are digested apart.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    up, down = powers()
    at = 0
    while at < len(starts):
        base = starts[at]
        stop = int(np.searchsorted(ends, base + SEGMENT, side="right"))
        if stop <= at:
            piece = buf[starts[at] : ends[at]].tobytes()
            import hashlib

            out[at] = np.frombuffer(hashlib.blake2b(piece, digest_size=8).digest(), dtype=np.uint64)[0]
            at += 1
            continue
        piece = buf[base : ends[stop - 1]].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(piece * up[: len(piece)], out=sums[1:])
        s, e = starts[at:stop] - base, ends[at:stop] - base
        out[at:stop] = (sums[e] - sums[s]) * down[s]
        at = stop
    return mix64(out ^ (ends - starts).astype(np.uint64))


def combine(words: np.ndarray, n: int) -> np.ndarray:
    """Fingerprint of every run of ``n`` consecutive fingerprints."""
    if len(words) < n:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for j in range(n):
        out = (out ^ words[j : len(words) - n + 1 + j]) * np.uint64(_MUL)
        out ^= out >> np.uint64(29)
    return mix64(out + np.uint64(n))


def member_table(pattern_bytes: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(pattern_bytes)] = True
    return table


#: Everything but the six ASCII white-space bytes.
NOT_SPACE = ~member_table(b" \t\n\x0b\x0c\r")
#: Digits, lower-case ASCII letters and every byte of a non-ASCII character.
ALNUM = member_table(bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)))


def text_chunks(column: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Rows of a text or binary column in runs of about ``limit`` bytes: the first row's number and
    the texts, null as empty. A single longer text is a run of its own."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    rows, size, first = [], 0, 0
    for i, value in enumerate(column):
        raw = value.as_py() or b""
        if rows and size + len(raw) > limit:
            yield first, rows
            rows, size, first = [], 0, i
        rows.append(raw)
        size += len(raw) + 1
    if rows:
        yield first, rows


def words_of(texts: list[bytes], member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of several texts at once, ASCII letters lowered.

    Returns the joined bytes, the words' starts and ends in them, the words' fingerprints, and for
    every text the number of its first word (one entry more than texts).
    """
    joined = np.frombuffer(b"\n".join(texts).lower(), dtype=np.uint8)
    starts, ends = spans_of(joined, member)
    lens = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    first = np.concatenate([[0], np.cumsum(lens)])
    return joined, starts, ends, hash_spans(joined, starts, ends), np.searchsorted(starts, first)
