"""Benchmark decontamination: windows of normalised words looked up in a broadcast set of test n-grams.

Test items give every run of ``n`` consecutive words; an item of fewer words, but not none, gives one window of
all of them. Spark makes the windows; the set goes to the tasks in blocks of bounded number and bytes, and a benchmark of more
than one block is scanned in as many passes, one after another, each over all documents and written before the next. A
fingerprint that is found is verified on the words themselves before it counts.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.llm.support import ALNUM, combine, free_name, materialize, text_chunks, words_of

#: Windows in one broadcast block, and bytes of their words.
BLOCK_WINDOWS = 100_000
BLOCK_BYTES = 16 << 20

_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def benchmark_windows(benchmark: DataFrame, item: str, text: str, n: int) -> DataFrame:
    """size (in words), print (fingerprint), words (joined by a space) and item of every distinct window of an item."""

    def run(batches):
        for batch in batches:
            for first, texts in text_chunks(batch.column(1)):
                items, rows = batch.column(0).slice(first, len(texts)).to_pylist(), {}
                for who, raw in zip(items, texts, strict=True):
                    joined, starts, ends, hashes, _ = words_of([raw], ALNUM)
                    size, whole = min(n, len(hashes)), joined.tobytes()
                    for i, h in enumerate(combine(hashes, size).view(np.int64)) if size else []:
                        rows[size, int(h), b" ".join(whole[starts[j] : ends[j]] for j in range(i, i + size)), who] = None
                for some in (list(rows)[i : i + 4096] for i in range(0, len(rows), 4096)):
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*some, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.string()), strict=True)], names=["size", "print", "words", "item"])

    return benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text")).mapInArrow(run, "size int, print long, words binary, item string")


def _blocks(windows: DataFrame, most: int, most_bytes: int):
    """Blocks of windows: for every size the sorted fingerprints, and the words and items of each. The driver holds one block."""
    sizes: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
    count = used = 0

    def block():
        return {size: (np.array(sorted(t), dtype=np.uint64), dict(t)) for size, t in sizes.items()}

    for r in windows.toLocalIterator():
        sizes[r["size"]][r["print"] % (1 << 64)].append((bytes(r["words"]), r["item"]))
        count, used = count + 1, used + len(r["words"])
        if count >= most or used >= most_bytes:
            yield block()
            sizes.clear()
            count = used = 0
    if count:
        yield block()


def _hits(joined, starts, ends, hashes, first, tables):
    """For every text: marks of its words, and the items whose windows occur."""
    raw = None
    covered = np.zeros(len(hashes) + 1, dtype=np.int32)
    items: dict[int, set] = defaultdict(set)
    for size, (keys, table) in tables.items():
        grams = combine(hashes, size)
        if not len(grams):
            continue
        at = np.searchsorted(keys, grams)
        at[at == len(keys)] = 0
        for i in np.flatnonzero(keys[at] == grams):
            doc = int(np.searchsorted(first, i, side="right")) - 1
            if i + size > first[doc + 1]:
                continue  # it runs into the next document
            raw = joined.tobytes() if raw is None else raw
            words = b" ".join(raw[starts[j] : ends[j]] for j in range(i, i + size))
            who = [w for text, w in table[int(grams[i])] if text == words]
            if who:
                covered[i] += 1
                covered[i + size] -= 1
                items[doc].update(w for w in who if w is not None)
    return np.cumsum(covered[:-1]) > 0, items


def _byte_spans(hit: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return [(int(starts[s] - base), int(ends[e - 1] - base)) for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text", block_windows: int = BLOCK_WINDOWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add n_words, n_hit, item_ids (sorted strings), hit_spans (byte ranges of runs of hit words, the end
    exclusive) and clean_text (the text without those ranges) to all rows of ``docs``.

    Words are maximal runs of digits, letters and non-ASCII characters, with A-Z lowered. Null or empty text has no
    words. An item whose id is null still contaminates, but isn't listed. Repeated rows are treated singly; an
    empty benchmark hits nothing, and an empty table gives no rows. Texts of any length are scanned whole. Names that ``docs`` has already get leading underscores in the result.
    """
    names = free_name(docs, "n_words", "n_hit", "item_ids", "hit_spans", "clean_text")
    added = [T.StructField(c, k) for c, k in zip(names, (T.LongType(), T.LongType(), T.ArrayType(T.StringType()), _SPAN, T.StringType()), strict=True)]
    schema = T.StructType([*docs.schema.fields, *added])
    place, width = docs.columns.index(text), len(docs.columns)
    spark = docs.sparkSession
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def scan(part, texts, tables, again):
        joined, starts, ends, hashes, first = words_of(texts, ALNUM)
        hit, items = _hits(joined, starts, ends, hashes, first, tables)
        base = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        n_hit, ids, spans, clean = [], [], [], []
        for d, raw in enumerate(texts):
            a, b = first[d], first[d + 1]
            here = hit[a:b]
            if again is not None:
                s0, e0 = starts[a:b] - base[d], ends[a:b] - base[d]
                for x in again[1][d].as_py():
                    here = here | ((s0 >= x["start"]) & (e0 <= x["end"]))
                items[d] |= set(again[0][d].as_py())
            n_hit.append(int(here.sum()))
            ids.append(sorted(items[d]) if d in items else [])
            found = _byte_spans(here, starts[a:b], ends[a:b], base[d]) if n_hit[-1] else []
            spans.append([{"start": s, "end": e} for s, e in found])
            if found:
                pieces, at = [], 0
                for s, e in found:
                    pieces.append(raw[at:s])
                    at = e
                raw = b"".join([*pieces, raw[at:]])
            clean.append(raw.decode("utf-8", "replace"))
        cols = [pa.array(np.diff(first), pa.int64()), pa.array(n_hit, pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(spans, span_type), pa.array(clean, pa.string())]
        return pa.RecordBatch.from_arrays([*part.columns[:width], *cols], names=schema.names)

    def over(block, later):
        def run(batches):
            for batch in batches:
                for row, texts in text_chunks(batch.column(place)):
                    part = batch.slice(row, len(texts))
                    yield scan(part, texts, block.value if block else {}, (part.column(width + 2), part.column(width + 3)) if later else None)

        return run

    out, passes = None, 0
    for block in _blocks(benchmark_windows(benchmark, item, item_text, n), block_windows, block_bytes):
        before = docs if out is None else materialize(out, "decontaminated")  # so that passes, and their blocks, follow one another
        out = before.mapInArrow(over(spark.sparkContext.broadcast(block), passes > 0), schema)
        passes += 1
    return docs.mapInArrow(over(None, False), schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_share: float = 0.5, **how) -> DataFrame:
    """The rows and columns of ``docs`` after decontamination: runs of hit words are cut out, and a document of
    which more than ``max_share`` of the words are hit goes. Untouched rows keep their text, nulls and empty texts included; no other
    column takes part, whatever its name; an empty table gives no rows, and an empty benchmark takes nothing out."""
    text = how.get("text", "text")
    n_words, n_hit, _, _, clean = free_name(docs, "n_words", "n_hit", "item_ids", "hit_spans", "clean_text")
    found = find_contamination(docs, benchmark, **how)
    kept = found.where(~(F.col(n_hit) > F.col(n_words) * F.lit(max_share)))
    return kept.withColumn(text, F.when(F.col(n_hit) > 0, F.col(clean)).otherwise(F.col(text))).select(*docs.columns)
