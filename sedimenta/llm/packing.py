"""Best-fit packing of token sequences by minimum bin slack.

A bin is filled by a subset-sum dynamic programme over the lengths that are left: reachable sums are the bits of a
whole number, and each copy of a length shifts and ors it. The fullest reachable combination is taken out. Only
lengths matter for that, and there are at most ``capacity`` different ones, so the plan is made from their counts, a
table of bounded size: a combination that is found is taken as many times as the counts allow. Spark then ranks the
pieces within their length and reads each piece's bin and offset off the plan.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.llm.support import free_name, materialize, shuffle_partitions, text_chunks

# --------------------------------------------------------------------------- tokens

_TWO_SPACES = re.compile(r"\s\s")
#: Chunks in one generation of an encoder's cache: about 70 MB.
_CACHED = 350_000

_STOPS = (".", ",")
#: Letters below this one are letters for every version of Unicode.
_LATIN = "\u0250"


def _little(ids: list[int]) -> bytes:
    raw = array("I", ids)
    if sys.byteorder == "big":
        raw.byteswap()
    return raw.tobytes()


#: Fixed pattern of byte-level pre-tokenizers.
_PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """Byte-level alphabets write each byte as a letter: printable Latin-1 as itself, the rest from code point 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def quick_encoder(tokenizer):
    """A faster encoder of the same ids for short texts, or None if the tokenizer isn't plain byte-level BPE whose merges come
    in the order of the ids they make."""
    spec = json.loads(tokenizer.to_str())
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")]
    if spec["normalizer"] or model["type"] != "BPE" or any(odd) or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in pairs]
    if made != sorted(set(made)):
        return None
    import tiktoken

    letters, special = byte_letters(), {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    return tiktoken.Encoding("plain", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class ChunkEncoder:
    """Token ids as little-endian unsigned 32-bit bytes.

    The byte-level pre-tokenizer always starts a piece at a white-space character that stands alone, and one at a run of
    punctuation that follows letters. So a text is encoded chunk by chunk, cut before each space and line feed, and a
    chunk's full stops and commas apart from its word. Chunks are looked up in a cache of two generations. A text with two
    white-space characters in a row, or one at its start, is encoded whole, and so is one that holds an added token's content. Chunks that aren't cached are merged by tiktoken on
    the tokenizer's own vocabulary where that gives the same ids.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = sorted((t["content"] for t in json.loads(self.tokenizer.to_str())["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.quick = quick_encoder(self.tokenizer)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.stops = dict(zip(_STOPS, self.whole(list(_STOPS)), strict=True))

    def whole(self, texts: Sequence[str]) -> list[bytes]:
        if not texts:
            return []
        found = self.tokenizer.encode_batch_fast(texts if isinstance(texts, list) else list(texts), add_special_tokens=False)
        return [_little(e.ids) for e in found]

    def _learn(self, new: set[str]) -> None:
        """Bring chunks into the young generation."""
        young, old = self.young, self.old
        for c in new & old.keys():
            young[c] = old[c]
            new.discard(c)
        # A full stop or comma after a letter is a piece of its own.
        ended = [c for c in new if c[-1:] in _STOPS and c[-2:-1] < _LATIN and c[-2:-1].isalpha()]
        new.difference_update(ended)
        for c in {c[:-1] for c in ended}.difference(young):
            if c in old:
                young[c] = old[c]
            else:
                new.add(c)
        fresh = list(new)
        texts = [c if c[:1] == "\n" else " " + c for c in fresh]
        young.update(zip(fresh, [_little(self.quick(t)) for t in texts] if self.quick else self.whole(texts), strict=True))
        for c in ended:
            young[c] = young[c[:-1]] + self.stops[c[-1]]

    def __call__(self, texts: Sequence[str]) -> list[bytes]:
        if len(self.young) > _CACHED:
            self.young, self.old = {}, self.young
        out: list[bytes | None] = [None] * len(texts)
        known, holes, new, get = {}, {}, set(), self.young.get
        for i, t in enumerate(texts):
            t = "\n" + t  # a line feed in front is a token of its own
            if _TWO_SPACES.search(t) or (self.added and self.added.search(t)):
                continue
            chunks = t.replace("\n", " \n").split(" ")
            known[i] = ids = list(map(get, chunks))
            ids[0] = b""  # before the line feed in front
            holes[i] = gaps = [(k, chunks[k]) for k, x in enumerate(ids) if x is None]
            new.update([c for _, c in gaps])
        self._learn(new)
        for i, ids in known.items():
            for k, c in holes[i]:
                ids[k] = self.young[c]
            out[i] = b"".join(ids)[4:]
        rest = [i for i in range(len(texts)) if i not in known]
        for i, raw in zip(rest, self.whole([texts[i] for i in rest]), strict=True):
            out[i] = raw
        return out


def tokenize_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, text: str = "text") -> DataFrame:
    """One row per piece of a document's ids: the columns of ``docs`` without ``text``, piece (from 0), start (ids before
    it), length, ids (binary, little-endian unsigned 32-bit).

    A document is its ids and ``end_id``. Only one of more than ``capacity`` ids is cut, into pieces of ``capacity``, of
    which the first may be shorter. Null text is empty: one piece with the end id. piece, start, length and ids replace
    columns of those names. A text of any length is encoded whole, one at a time.
    """
    own = ("piece", "start", "length", "ids")
    rest = [c for c in docs.columns if c != text and c not in own]
    kinds = (T.IntegerType(), T.LongType(), T.LongType(), T.BinaryType())
    schema = T.StructType([*(docs.schema[c] for c in rest), *(T.StructField(c, k) for c, k in zip(own, kinds, strict=True))])
    place, keep = docs.columns.index(text), [docs.columns.index(c) for c in rest]
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches):
        encode = ChunkEncoder(tokenizer)
        for batch in batches:
            for first, texts in text_chunks(batch.column(place), 1 << 20):
                rows, piece, start, length, ids = [], [], [], [], []
                for i, raw in enumerate(encode([t.decode("utf-8", "replace") for t in texts])):
                    raw += end
                    n = len(raw) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append(first + i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        ids.append(raw[4 * a : 4 * b])
                at = pa.array(rows, pa.int64())
                cols = [batch.column(c).take(at) for c in keep]
                own_cols = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays([*cols, *own_cols], names=schema.names)

    return docs.mapInArrow(run, schema)


# --------------------------------------------------------------------------- the plan


@dataclass(frozen=True)
class Combination:
    """``bins`` bins from ``first_bin`` on, each with the copies of each length, largest first."""

    copies: tuple[tuple[int, int], ...]
    bins: int
    first_bin: int


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Copies of lengths whose sum is as near to ``room`` as any combination comes, by a bitset of reachable sums.
    Larger lengths are tried first, so that a full bin leaves the small ones for later."""
    reach, mask = 1, (1 << (room + 1)) - 1
    before: list[tuple[int, int]] = []
    for length in sorted((x for x in counts if 0 < x <= room and counts[x] > 0), reverse=True):
        for _ in range(min(counts[length], room // length)):
            more = (reach | reach << length) & mask
            if more == reach:
                break
            before.append((length, reach))
            reach = more
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, {}
    for length, was in reversed(before):
        if not was >> total & 1:
            out[length] = out.get(length, 0) + 1
            total -= length
    return out


def plan_bins(counts: dict[int, int], capacity: int) -> list[Combination]:
    """Combinations that use up all lengths. Each bin starts with the longest piece that is left."""
    counts = {x: n for x, n in counts.items() if n}
    out, bins = [], 0
    while counts:
        top = max(counts)
        left = counts | {top: counts[top] - 1}
        use = fullest(left, capacity - top)
        use[top] = use.get(top, 0) + 1
        times = min(counts[x] // k for x, k in use.items())
        out.append(Combination(tuple(sorted(use.items(), reverse=True)), times, bins))
        bins += times
        for x, k in use.items():
            counts[x] -= k * times
            if not counts[x]:
                del counts[x]
    return out


class _Places:
    """The plan as sorted arrays: for the r-th piece of a length, its bin and its offset there."""

    def __init__(self, plan: list[Combination]):
        rows, given = [], {}
        for c in plan:
            offset = 0
            for length, copies in c.copies:
                first = given.get(length, 0)
                rows.append((length, first, copies, c.first_bin, offset))
                given[length] = first + copies * c.bins
                offset += length * copies
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
        self.length, self.first, self.copies, self.bin, self.offset = table.T
        self.begin = {int(x): int(i) for x, i in zip(*np.unique(self.length, return_index=True), strict=True)}
        self.end = {int(x): int(i + n) for x, i, n in zip(*np.unique(self.length, return_index=True, return_counts=True), strict=True)}

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.empty(len(length), dtype=np.int64)
        for x in np.unique(length):
            a, b = self.begin[int(x)], self.end[int(x)]
            here = length == x
            at[here] = a + np.searchsorted(self.first[a:b], rank[here], side="right") - 1
        nth = rank - self.first[at]
        return self.bin[at] + nth // self.copies[at], self.offset[at] + nth % self.copies[at] * length


def assign_bins(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Add sequence_id and offset to a table that has a length column and can be read again cheaply.

    Lengths are 1 to ``capacity``. Each sequence holds ``capacity`` at most; its pieces lie from offset 0 on without gaps. A full
    piece is a sequence by itself (of a negative id), without a rank or a shuffle; the pieces of any other length are dealt over
    as many lanes as there are shuffle partitions (64 at least), and only lanes are sorted.
    """
    lanes = max(64, shuffle_partitions(pieces.sparkSession))
    alone = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    pieces = pieces.where(F.col("length") < capacity)
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # a row per length
    places = _Places(plan_bins(counts, capacity))
    by = [c for c, k in pieces.dtypes if not any(x in k for x in ("map<", "variant", "binary"))]
    lane, before, rank = free_name(pieces, "lane", "before", "rank")
    dealt = pieces.withColumn(lane, F.pmod(F.xxhash64(*[F.col(c) for c in by]), F.lit(lanes)))
    ahead = W.partitionBy("length").orderBy(lane).rowsBetween(W.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", lane).agg(F.count("*").alias("n")).select("length", lane, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias(before))
    inside = W.partitionBy("length", lane).orderBy(*by)
    ranked = dealt.withColumn(rank, F.row_number().over(inside)).join(offsets, ["length", lane]).select(*pieces.columns, (F.col(before) + F.col(rank) - 1).alias(rank))
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    schema = T.StructType([*(pieces.schema[c] for c in names), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            bins, offset = places(length, batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False))
            cols = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(bins, pa.int64()), pa.array(offset, pa.int64())], names=schema.names)

    return ranked.mapInArrow(run, schema).unionByName(alone.select(*schema.names))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, text: str = "text", derive: dict[str, Column] | None = None, keep_ids: bool = True) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens: the columns of ``tokenize_pieces`` with
    sequence_id (a whole number) and offset.

    ``derive`` adds columns made from a piece (say, a digest of ids); without ``keep_ids`` the ids themselves don't travel
    any further. Null and empty texts are pieces of one token; a text of any length is encoded whole. Columns named like the
    operator's are replaced. Repeated rows are packed as often as they come; an empty
    table gives no rows.
    """
    pieces = tokenize_pieces(docs, tokenizer, capacity, end_id, text).withColumns(derive or {})
    return assign_bins(materialize(pieces if keep_ids else pieces.drop("ids"), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids, joined in order of the offset: at most one sequence's ids meet in a row."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return packed.groupBy("sequence_id").agg(whole.alias("ids"))
