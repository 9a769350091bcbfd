"""Byte-pair tokenization: a worker merges a word once."""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed pattern of the pre-split.
PATTERN = r"<\|startoftext\|>|<\|endoftext\|>|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BOS, EOS = "<|startoftext|>", "<|endoftext|>"


def pre_split(text: str | Column) -> Column:
    """Lower-case words, digits and runs of signs of a text, white space aside."""
    clean = F.regexp_replace(F.lower(text), r"\s+", " ")
    return F.regexp_extract_all(clean, F.lit(PATTERN), F.lit(0))


def merge_word(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Pieces of a word: the pair of lowest rank is merged everywhere, left to right, until no pair has a rank. Ranks are places in a list, no
    two pairs share one.

    Pieces are a linked list, and pairs lie in a heap by rank and place; a pair whose pieces have changed since is passed over. All pairs of one
    rank are merged before those that they give rise to, so a word of n letters takes n log n steps.
    """
    if word in (BOS, EOS):
        return [word]
    pieces: list[str | None] = [*word[:-1], word[-1] + "</w>"]
    n = len(pieces)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[p], i) for i, p in enumerate(zip(pieces, pieces[1:], strict=False)) if p in ranks]
    heapq.heapify(heap)
    while heap:
        rank, fresh = heap[0][0], []
        while heap and heap[0][0] == rank:
            i = heapq.heappop(heap)[1]
            j = after[i]
            if pieces[i] is None or j >= n or ranks.get((pieces[i], pieces[j])) != rank:
                continue
            pieces[i], pieces[j], after[i] = pieces[i] + pieces[j], None, after[j]
            if after[i] < n:
                before[after[i]] = i
            fresh.append(i)
        for i in fresh:
            if pieces[i] is None:
                continue
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (pieces[a], pieces[b]) in ranks:
                    heapq.heappush(heap, (ranks[pieces[a], pieces[b]], a))
    return [p for p in pieces if p is not None]


#: Words that a task remembers, letters of the longest of them, and words that it encodes at a time.
REMEMBERED, LONGEST, AT_ONCE = 200_000, 64, 1 << 18


def runs_of(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Rows from and to, in order, in runs of at most ``limit`` by their sizes; a larger row stands alone."""
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(sizes):
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right"))
        stop = max(stop, at + 1)
        yield at, stop
        at = stop


def tokenize(df: DataFrame, vocabulary: dict[str, int], ranks: dict[tuple[str, str], int], key: str, text: str, ends: bool = True) -> DataFrame:
    """key, ids: token ids of each text; pieces outside the vocabulary are dropped, begin and end are added.

    Texts are encoded where they are, in Arrow batches, of which ``AT_ONCE`` words or a longer row are taken at a time: their words are numbered, each
    different word is merged once (or known to the task, which remembers ``REMEMBERED`` words at most), and its ids are gathered for all its
    places. Words are so uneven that this leaves few merges, and nothing is shuffled. A task's memory is thus the same at any size of the table.
    """
    sent = df.sparkSession.sparkContext.broadcast((vocabulary, ranks))  # model data of fixed size
    kind = f"k {df.schema[key].dataType.simpleString()}, ids array<int>"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, order = sent.value
        known: dict[str, bytes] = {}

        def run(keys: pa.Array, words: pa.ListArray) -> pa.RecordBatch:
            coded = words.flatten().dictionary_encode()
            if len(known) > REMEMBERED:
                known.clear()
            own = []
            for w in coded.dictionary.to_pylist():
                found = known.get(w)
                if found is None:
                    found = array("i", [ids[p] for p in merge_word(w, order) if p in ids]).tobytes()
                    if len(w) <= LONGEST:
                        known[w] = found
                own.append(found)
            sizes = np.array([len(x) // 4 for x in own], dtype=np.int32)
            flat, starts = np.frombuffer(b"".join(own), dtype=np.int32), np.cumsum(sizes, dtype=np.int64) - sizes
            codes = coded.indices.to_numpy()
            lens = sizes[codes] if len(codes) else np.zeros(0, dtype=np.int32)
            before = np.cumsum(lens, dtype=np.int64)
            edges = np.append(0, before)[np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy()))].astype(np.int32)
            places = np.repeat((starts[codes] if len(codes) else before) - before + lens, lens)
            places += np.arange(len(places))
            return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(edges), pa.array(flat[places]))], names=["k", "ids"])

        for batch in batches:
            for at, stop in runs_of(pc.fill_null(pc.list_value_length(batch["w"]), 0).to_numpy(), AT_ONCE):
                yield run(batch["k"].slice(at, stop - at), batch["w"].slice(at, stop - at))

    done = df.select(F.col(key).alias("k"), pre_split(text).alias("w")).mapInArrow(encode, kind)
    flat = F.concat(F.array(F.lit(vocabulary[BOS])), "ids", F.array(F.lit(vocabulary[EOS]))) if ends else F.col("ids")
    return done.select(F.col("k").alias(key), flat.alias("ids"))
