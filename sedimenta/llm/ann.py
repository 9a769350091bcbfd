"""Approximate nearest neighbours by shifted space-filling curves.

Each curve projects the vectors on a few random orthonormal directions, brings every direction to the unit interval by
a logistic curve close to the normal distribution that fits all rows, shifts the cube by a random offset and orders the points by their Hilbert
keys. Curves are cut into key ranges of about equal numbers of rows (percentiles over all rows). A query's window on a
curve is its own range and the two beside it; Spark range-partitions rows and queries by curve and range, tasks
rank the rows of their range for its queries by exact distances, and the curves' lists are merged and reranked.

Vectors that are equal form a class, indexed once with its smallest ids: no range fills up with copies.

A range is a share of all rows, so recall doesn't fall as the table grows, at the price of work in proportion to
queries times rows. For data of low intrinsic dimension use more ranges.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.llm.hilbert import hilbert_keys
from sedimenta.llm.support import materialize, shuffle_partitions

#: Rows of a range that one task compares.
CHUNK = 4096
#: Smallest range, so that a window of three holds several times the neighbours asked for.
LEAST_RANGE = 20


@cache
def _directions(dim: int, curves: int, axes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns to project on, ``axes`` for each curve, and each column's shift."""
    rng = np.random.default_rng(seed)
    axes = min(axes, dim)
    columns = [np.linalg.qr(rng.normal(size=(dim, axes)))[0] for _ in range(curves)]
    return np.concatenate(columns, axis=1), rng.uniform(0, 0.5, curves * axes)


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1) if rows else np.empty((0, 0))


def usable_vectors(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, vector, key_a, key_b) of rows whose id and vector aren't null and whose vector is of the table's most
    frequent length, finite and not zero. The keys are a 128-bit fingerprint of the vector."""
    v = F.transform(embedding, lambda x: x.cast("double") + F.lit(0.0))
    fine = F.col("vec_id").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("vector")).where(F.col("vector").isNotNull() & fine)
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("vector") == (length["n"] if length else 0))
    return rows.select("vec_id", "vector", F.xxhash64("vector").alias("key_a"), F.xxhash64("vector", F.lit(17)).alias("key_b"))


def _fit(classes: DataFrame, project: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, and mean and deviation of every projected column, over all rows."""

    def sums(batches):
        for batch in batches:
            p = _matrix(batch.column(0)) @ project if batch.num_rows else np.zeros((0, project.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(p.shape[1]), pa.int32()), pa.array(np.full(p.shape[1], len(p)), pa.int64()), pa.array(p.sum(axis=0)), pa.array((p * p).sum(axis=0))], names=["axis", "n", "s", "q"])

    found = classes.select("vector").mapInArrow(sums, "axis int, n long, s double, q double").groupBy("axis").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    rows = sorted(found.collect())  # one per projected column
    n = rows[0]["n"] if rows else 0
    if not n:
        return 0, np.zeros(0), np.ones(0)
    mean = np.array([r["s"] / n for r in rows])
    return n, mean, np.sqrt(np.maximum(np.array([r["q"] / n for r in rows]) - mean**2, 1e-18))


def _keyed(rows: DataFrame, project: np.ndarray, shift: np.ndarray, mean: np.ndarray, scale: np.ndarray, axes: int, bits: int) -> DataFrame:
    """Add keys: the Hilbert key on every curve."""
    names, place = [*rows.columns, "keys"], rows.columns.index("vector")
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)

    def run(batches):
        for batch in batches:
            z = (_matrix(batch.column(place)) @ project - mean) / scale if batch.num_rows else np.zeros((0, len(shift)))
            u = (1 / (1 + np.exp(np.clip(-1.702 * z, -50, 50))) + shift) / 1.5
            grid = np.minimum((u * (1 << bits)).astype(np.int64), (1 << bits) - 1)
            keys = np.stack([hilbert_keys(grid[:, i : i + axes], bits) for i in range(0, grid.shape[1], axes)], axis=1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], names=names)

    return rows.mapInArrow(run, f"{kinds}, keys array<long>")


def _ranked(table: pa.Table, keep: int) -> pa.Table:
    """Nearest ``keep`` rows of a task's part of a range for each of its queries, by distance and then id."""
    query = np.asarray(table["query"])
    x = _matrix(table["vector"])
    ids = np.asarray(table["vec_id"])
    base, asks = np.flatnonzero(~query), np.flatnonzero(query)
    out_a, out_b, out_id, out_score = [], [], [], []
    if len(base) and len(asks):
        ka, kb = np.asarray(table["key_a"]), np.asarray(table["key_b"])
        points, ids = x[base], ids[base]
        square = (points * points).sum(axis=1)
        for i in range(0, len(asks), 256):
            q = x[asks[i : i + 256]]
            rough = square - 2 * (q @ points.T) + (q * q).sum(axis=1)[:, None]
            bound = np.partition(rough, min(keep, len(base)) - 1, axis=1)[:, min(keep, len(base)) - 1]
            slack = 1e-9 * (1 + np.abs(bound))
            for j, row in enumerate(rough):
                near = np.flatnonzero(row <= bound[j] + slack[j])
                score = np.sqrt(((points[near] - q[j]) ** 2).sum(axis=1))
                best = np.lexsort((ids[near], score))[:keep]
                out_a.append(np.full(len(best), ka[asks[i + j]]))
                out_b.append(np.full(len(best), kb[asks[i + j]]))
                out_id.append(ids[near][best])
                out_score.append(score[best])
    join = lambda xs, kind: pa.array(np.concatenate(xs) if xs else np.empty(0), kind)
    return pa.table({"key_a": join(out_a, pa.int64()), "key_b": join(out_b, pa.int64()), "head": join(out_id, pa.int64()), "score": join(out_score, pa.float64())})


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", curves: int = 12, axes: int = 4, bits: int = 5, ranges: int = 25, seed: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row for which ``is_query`` (an expression over ``vec_id``) holds,
    its ``k`` nearest rows found by Euclidean distance in double precision, ties to the smaller id, itself left out.

    Rows whose id is null or whose vector is null, zero, of another length than most, or holds null or non-finite
    components take no part. A row that comes again with the same id and vector counts once; rows of one id with several
    vectors are candidates each, and none of them is a candidate of that id's query, which is asked for each of
    the vectors. Tables of fewer than 60 rows are one window; beyond that curves decide at every size. An empty table gives no rows. Other columns take no part.
    """
    spark = vectors.sparkSession
    valid = materialize(usable_vectors(vectors, vec_id, embedding), "vectors")
    first = valid.select(F.size("vector").alias("n")).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if first is None:
        return spark.createDataFrame([], empty)
    # A class keeps its k + 1 smallest ids: no query needs more of them.
    low = W.partitionBy("key_a", "key_b", "vector").orderBy("vec_id")
    members = valid.withColumn("place", F.dense_rank().over(low)).where(F.col("place") <= k + 1).select("key_a", "key_b", "vector", "vec_id").distinct()
    classes = materialize(members.groupBy("key_a", "key_b", "vector").agg(F.min("vec_id").alias("vec_id"), F.sort_array(F.collect_set("vec_id")).alias("ids")), "classes")
    asked = valid.where(is_query).select("vec_id", "key_a", "key_b", "vector").distinct()

    axes = min(axes, first["n"])
    project, shift = _directions(first["n"], curves, axes, seed)
    n, mean, scale = _fit(classes, project)
    ranges = max(1, min(ranges, n // LEAST_RANGE))
    place = lambda rows: _keyed(rows, project, shift, mean, scale, axes, bits)
    data = materialize(place(classes.select("key_a", "key_b", "vec_id", "vector")), "curve-keys")
    asks = place(asked.groupBy("key_a", "key_b", "vector").agg(F.min("vec_id").alias("vec_id")).select("key_a", "key_b", "vec_id", "vector"))

    shares = [i / ranges for i in range(1, ranges)]
    cuts = [[] for _ in range(curves)]
    if shares:
        keys = data.select(F.posexplode("keys").alias("curve", "key"))
        for r in keys.groupBy("curve").agg(F.percentile_approx("key", shares, 10000).alias("cuts")).collect():  # a row per curve
            cuts[r["curve"]] = sorted(set(r["cuts"]))  # a key with many rows is a cut once, so that no range is empty between two
    table = F.array(*[F.array(*[F.lit(c).cast("long") for c in own]).cast("array<long>") for own in cuts])

    # A vector of floats travels as such; tasks compute in double precision.
    sent_as = "array<float>" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "array<double>"

    def ranged(rows: DataFrame) -> DataFrame:
        out = rows.select("key_a", "key_b", "vec_id", F.col("vector").cast(sent_as).alias("vector"), F.posexplode("keys").alias("curve", "key"))
        return out.withColumn("part", F.size(F.filter(F.get(table, F.col("curve")), lambda c: c <= F.col("key"))))

    rows = ranged(data)
    chunks = [[1] * (len(own) + 1) for own in cuts]
    for r in rows.groupBy("curve", "part").count().collect():  # a row per curve and range
        chunks[r["curve"]][r["part"]] = -(-r["count"] // CHUNK)
    held = F.array(*[F.array(*[F.lit(c) for c in own]) for own in chunks])
    own_chunks = F.get(F.get(held, F.col("curve")), F.col("part"))
    base = rows.select("curve", "part", F.pmod(F.xxhash64("vec_id"), own_chunks).cast("int").alias("chunk"), F.lit(False).alias("query"), "key_a", "key_b", "vec_id", "vector")
    last = F.size(F.get(table, F.col("curve")))
    window = F.sequence(F.greatest(F.col("part") - 1, F.lit(0)), F.least(F.col("part") + 1, last))
    sent = ranged(asks).select("curve", F.explode(window).alias("part"), "key_a", "key_b", "vec_id", "vector")
    sent = sent.select("curve", "part", F.explode(F.sequence(F.lit(0), own_chunks - 1)).alias("chunk"), F.lit(True).alias("query"), "key_a", "key_b", "vec_id", "vector")
    dealt = base.unionByName(sent).repartitionByRange(shuffle_partitions(spark), "curve", "part", "chunk")
    lists = dealt.groupBy("curve", "part", "chunk").applyInArrow(lambda t: _ranked(t, k + 1), "key_a long, key_b long, head long, score double")

    best = W.partitionBy("key_a", "key_b").orderBy("score", "head")
    merged = lists.groupBy("key_a", "key_b", "head").agg(F.min("score").alias("score")).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    # Heads name classes by their smallest id, which several classes may share only if an id has several vectors.
    spread = merged.join(classes.select(F.col("vec_id").alias("head"), "ids", F.col("vector").alias("other")), "head")
    pairs = asked.select(F.col("vec_id").alias("query_id"), "key_a", "key_b", "vector").join(spread, ["key_a", "key_b"])
    exact = F.sqrt(F.aggregate(F.zip_with("vector", "other", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x))
    flat = pairs.select("query_id", exact.alias("score"), F.explode("ids").alias("vec_id")).where("vec_id <> query_id").distinct()
    final = W.partitionBy("query_id").orderBy("score", "vec_id")
    return flat.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
