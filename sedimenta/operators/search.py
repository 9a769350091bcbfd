"""Exact similarity search over an index of vectors, and reports about the index."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sedimenta.functions.vectors import has_non_finite, normalize, sanitize
from sedimenta.operators.embed import embed_documents, embed_pieces
from sedimenta.sources.corpus import PIECE, read_corpus
from sedimenta.sources.scratch import scratch

#: Queries of one block: 8 MB of doubles at 1,000 components.
QUERY_BLOCK = 1024
#: Entries of the index that a task scores at once.
SLICE = 2048


def prepare_queries(queries: DataFrame, embedding: str = "embedding", normalized: bool = True, on_non_finite: str = "sanitize") -> DataFrame:
    """Queries ready to score: sanitized (or, with "skip", dropped if they hold a non-finite value), then of unit length."""
    if on_non_finite == "skip":
        queries = queries.where(~has_non_finite(embedding))
    return queries.withColumn(embedding, normalize(embedding) if normalized else sanitize(embedding))


def _vectors(column: pa.ChunkedArray, rows: np.ndarray, length: int) -> np.ndarray:
    """Vectors of ``rows``, all of one length, as a matrix; null components are NaN."""
    flat = column.take(pa.array(rows)).combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), length)


def best_of_columns(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of each column's ``k`` largest values, ties to the smaller row. Only values that reach the k-th are
    sorted."""
    k = min(k, len(scores))
    bound = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]
    ask, entry = np.nonzero((scores >= bound).T)
    score = scores[entry, ask]
    order = np.lexsort((entry, -score, ask))
    ask, entry, score = ask[order], entry[order], score[order]
    place = np.arange(len(ask)) - np.searchsorted(ask, ask)
    return entry[place < k], ask[place < k], score[place < k]


class _Scorer:
    """Best entries of slices of an index for a block of queries (arrow columns k and v)."""

    def __init__(self, own: pa.Table, k: int, names: list[str], types: list[pa.DataType]):
        self.own, self.k, self.names, self.types = own, k, names, types
        wanted = pc.list_value_length(own["v"]).to_numpy()
        self.blocks = []
        for n in np.unique(wanted):
            who = np.flatnonzero(wanted == n)
            self.blocks += [(int(n), part, _vectors(own["v"], part, int(n)).T) for part in np.array_split(who, -(-len(who) // QUERY_BLOCK))]

    def empty(self) -> pa.Table:
        return pa.table([pa.array([], t) for t in self.types], names=self.names)

    def best(self, held: pa.Table) -> pa.Table:
        """Each query's ``k`` best of the entries, ties to the smaller key."""
        return pa.concat_tables([self.empty(), *self.tables(held)])

    def tables(self, held: pa.Table) -> list[pa.Table]:
        """The same, a table per block of queries."""
        out: list[pa.Table] = []
        if self.own.num_rows and held.num_rows:
            held = held.take(pc.sort_indices(held["k"], null_placement="at_start"))
            lengths = pc.list_value_length(held["v"]).to_numpy()
            at = None
            for n, who, q in self.blocks:
                if at != n:
                    at, rows = n, np.flatnonzero(lengths == n)
                    v = _vectors(held["v"], rows, n) if len(rows) else None
                    fine = None if v is None else np.isfinite(v).all(axis=1)
                if not len(rows):
                    continue
                scores = np.where(fine[:, None], np.where(fine[:, None], v, 0) @ q, 0.0)
                entry, ask, score = best_of_columns(scores, self.k)
                cols = [self.own["k"].take(pa.array(who[ask])), held["k"].take(pa.array(rows[entry])), pa.array(score)]
                out.append(pa.table([c.cast(t) for c, t in zip(cols, self.types, strict=True)], names=self.names))
        return out

    def prune(self, found: list[pa.Table]) -> pa.Table:
        """Of several slices' best the best."""
        query, key, score = self.names
        rows = pa.concat_tables(found).combine_chunks()
        codes = rows[query].combine_chunks().dictionary_encode().indices
        order = pc.sort_indices(pa.table({"q": codes, "s": rows[score], "k": rows[key]}), [("q", "ascending"), ("s", "descending"), ("k", "ascending")], null_placement="at_start")
        q = codes.take(order).to_numpy()
        return rows.take(order.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < self.k)))


def score_pairs(index: DataFrame, queries: DataFrame, key: str = "path", query_id: str = "query_id", embedding: str = "embedding", broadcast_mb: int = 64, k: int | None = None) -> DataFrame:
    """(query_id, key, score) of every entry of each query's dimension, the vectors taken as they are; entries with non-finite values score 0.

    The pairs are the result: as many as entries times queries. With ``k``, those are left out that are behind ``k`` better ones of their query (ties to the
    smaller key) in their task or slice, so that a ranking of the first ``k`` is given about ``k`` pairs a query and task instead.
    """
    entries = index.select(F.col(key).alias("k"), F.col(embedding).alias("v")).where(F.col("v").isNotNull())
    asked = queries.select(F.col(query_id).alias("k"), F.col(embedding).alias("v")).where(F.col("v").isNotNull())
    return _scored(entries, asked, k, [query_id, key, "score"], QUERY_BLOCK, broadcast_mb)


def _scored(entries: DataFrame, asked: DataFrame, k: int | None, names: list[str], block: int, broadcast_mb: int) -> DataFrame:
    """Pairs (by ``names``) of entries and queries, both columns k and v: of each query the best ``k`` in a task or slice, or all."""
    spark, kinds = entries.sparkSession, [asked.schema["k"].dataType, entries.schema["k"].dataType]
    kind = f"{names[0]} {kinds[0].simpleString()}, {names[1]} {kinds[1].simpleString()}, score double"
    types = [*map(to_arrow_type, kinds), pa.float64()]
    most = SLICE if k is None else k
    number, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("v") * 8 + F.octet_length(F.col("k").cast("string")) + 16), F.lit(0))).first()
    if size <= broadcast_mb << 20:
        sent = spark.sparkContext.broadcast(asked.toArrow())

        def in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = _Scorer(sent.value, most, names, types)
            found, rows = [scorer.empty()], 0
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    best = scorer.tables(pa.table(batch.slice(at, SLICE)))
                    if k is None:
                        yield from (b for one in best for b in one.to_batches(max_chunksize=1 << 16))
                        continue
                    found += best
                    rows += sum(one.num_rows for one in best)
                    if rows > 4 * k * sent.value.num_rows + SLICE:
                        found = [scorer.prune(found)]
                        rows = found[0].num_rows
            if k is not None:
                yield from scorer.prune(found).to_batches(max_chunksize=1 << 16)

        return entries.mapInArrow(in_place, kind)

    blocks, slices = max(1, -(-number // block)), max(1, -(-entries.count() // SLICE))

    def best(own: pa.Table, held: pa.Table) -> pa.Table:
        return _Scorer(own, k if k is not None else max(1, held.num_rows), names, types).best(held)

    def dealt(rows: DataFrame, own: str, parts: int, other: str, copies: int) -> DataFrame:
        part = F.pmod(F.xxhash64("k", "v"), F.lit(parts)).cast("int").alias(own)
        return rows.select("k", "v", part, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias(other)).select("block", "slice", "k", "v")

    left, right = dealt(asked, "block", blocks, "slice", slices), dealt(entries, "slice", slices, "block", blocks)
    return left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInArrow(best, kind)


def topk_search(index: DataFrame, queries: DataFrame, k: int = 5, key: str = "path", query_id: str = "query_id", embedding: str = "embedding", normalized: bool = True, on_non_finite: str = "sanitize", block: int = QUERY_BLOCK, broadcast_mb: int = 64) -> DataFrame:
    """(query_id, key, score, rank from 1): each query's ``k`` best entries by dot product, ties to the smaller key.

    Queries whose counted bytes are within ``broadcast_mb`` are sent to all tasks, which score the index where it lies, slice by slice with one
    matrix product each, and pass on their best ``k`` per query: no row of the index is shuffled. More queries are dealt to blocks of about
    ``block`` and entries to slices of about ``SLICE``, and Spark brings every block together with every slice, so that neither the driver nor
    a task holds more than one of each. A small window ranks what is passed on. ``k`` of 0 or less gives no rows. Entries of another
    dimension than the query's don't count; entries with non-finite values score exactly 0.
    """
    spark = index.sparkSession
    if k <= 0:
        kind = f"{query_id} {queries.schema[query_id].dataType.simpleString()}, {key} {index.schema[key].dataType.simpleString()}, score double"
        return spark.createDataFrame([], kind + ", rank int")
    asked = prepare_queries(queries, embedding, normalized, on_non_finite).select(F.col(query_id).alias("k"), F.coalesce(embedding, F.array().cast("array<double>")).alias("v"))
    entries = index.select(F.col(key).alias("k"), F.col(embedding).alias("v")).where(F.col("v").isNotNull())
    return rank_hits(_scored(entries, asked, k, [query_id, key, "score"], block, broadcast_mb), k, key, query_id)


def fix_index(index: DataFrame, key: str = "path", embedding: str = "embedding") -> DataFrame:
    """The index written once, with what a search needs of it, so that searches that follow (the batches of a stream) read it in place
    and recompute nothing."""
    slim = index.select(F.col(key), F.col(embedding)).where(F.col(embedding).isNotNull())
    path = scratch(index.sparkSession, "index")
    slim.write.parquet(path)
    return index.sparkSession.read.schema(slim.schema).parquet(path)


def search_folder(spark: SparkSession, root: str, questions: DataFrame, extensions: Iterable[str] = ("txt", "md"), documents: int = 8, k: int = 2, load=None, recursive: bool = True) -> DataFrame:
    """(query_id, path, score, rank): each question's (query_id, text) best ``k`` of the first ``documents`` files of a folder, by path,
    that can be read: reading, embedding and search in one. Blank questions have no hits. Files are read and embedded in pieces; a plugged
    model is given whole texts, and files of more than a gigabyte are unreadable to it."""
    docs = read_corpus(spark, root, extensions, recursive, documents, piece_bytes=PIECE if load is None else None).where("status = 'ok'")
    index = embed_pieces(docs) if load is None else embed_documents(docs, load)
    asked = embed_documents(questions.select(F.col("query_id"), F.col("text").alias("contents")), load, key="query_id")
    return topk_search(index, asked, k)


def rank_hits(scores: DataFrame, k: int, key: str = "path", query_id: str = "query_id") -> DataFrame:
    order = W.partitionBy(query_id).orderBy(F.desc("score"), key)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(k, 0))


def index_stats(index: DataFrame, key: str = "path", embedding: str = "embedding") -> DataFrame:
    """One row: documents, and the dimension of the first entry (by key)."""
    return index.agg(F.count("*").alias("documents"), F.min_by(F.size(embedding), F.col(key)).alias("dimension"))


def dimension_histogram(index: DataFrame, embedding: str = "embedding") -> DataFrame:
    return index.groupBy(F.size(embedding).alias("dimension")).agg(F.count("*").alias("entries"))


def mismatched(index: DataFrame, dimension: int | Column, embedding: str = "embedding") -> DataFrame:
    return index.where(F.size(embedding) != dimension)


def problem_report(problems: DataFrame, item: str = "path", kind: str = "kind", preview: int = 5) -> DataFrame:
    """kind, problems, preview: the number of items of a kind and the first few of them, with ", ..." if there are more. Items
    are ranked before they are gathered, so that no list grows beyond the preview."""
    order = W.partitionBy(kind).orderBy(item)
    counts = problems.groupBy(kind).agg(F.count("*").alias("problems"))
    few = problems.withColumn("n", F.row_number().over(order)).where(F.col("n") <= preview)
    shown = few.groupBy(kind).agg(F.array_join(F.array_sort(F.collect_list(F.col(item).cast("string"))), ", ").alias("shown"))
    return counts.join(shown, kind).select(kind, "problems", F.concat("shown", F.when(F.col("problems") > preview, ", ...").otherwise("")).alias("preview"))


def skipped_documents(docs: DataFrame, embedded: DataFrame, key: str = "path") -> DataFrame:
    """Documents without an embedding."""
    return docs.join(embedded, key, "left_anti")


def fallback_messages(batches: DataFrame, message: str = "fallback") -> DataFrame:
    return batches.where(F.col(message).isNotNull()).select(message).distinct()
