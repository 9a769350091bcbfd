"""Alignment of two tokenizers over the same text, and how often their ids end together in a corpus.

Both tokenizers give spans: ``tokenizers`` character offsets, sentencepiece byte offsets. Where a span of each ends at the same place,
a coarse cut falls. A cell between two such cuts that is ASCII is a group as it stands. Other cells are refined by the tokens'
decoded bytes, since spans lie inside characters: a character's tokens share its offsets, and byte-fallback tokens have empty spans but for the last.

A text is cut before each single space and line feed, where both tokenizers start anew (byte-level pre-tokenization, and pieces that hold no space behind
another letter), and before a full stop or comma that ends a word, so that a worker aligns a word once and remembers it. Arrow cuts the texts of a batch and
tells their different words, new ones are encoded and aligned many at a time, and the texts' links and groups are gathered from the words' own. Texts with two
white-space characters in a row, or one at an end, are aligned whole. An id pair that ends together has bytes of which one is a suffix of the other, so the vocabularies bound the number
of different pairs (half a million for the usual ones): the table of counts is broadcast, whatever the corpus.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.llm.packing import byte_letters, quick_encoder
from sedimenta.llm.support import materialize, text_chunks

#: Words in one generation of a worker's memory, and letters of the longest of them.
REMEMBERED, LONGEST = 100_000, 64
#: Bits of a link's code that hold the second tokenizer's id.
_LOW = 15
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: Patterns of Arrow's: texts that are aligned whole, and a full stop or comma behind a Latin letter at a word's end.
_ODD = f"[{_SPACES}][{_SPACES}]|^[{_SPACES}]|[{_SPACES}]$"
_ENDED = f"([{''.join(c for c in map(chr, range(0x250)) if c.isalpha())}])([.,])( |$)"
_STOPS = (".", ",")
#: In front of a stop that was cut off: no word has two line feeds.
_CUT = "\n\n"
#: Letters whose class is the same in every version of Unicode.
_SETTLED = re.compile("[\x00-\u024f\u2010-\u2027]*")

#: Numbers of tokens of both, link codes as little-endian 32-bit words, groups as text. Without tokens: ``NONE``.
Aligned = tuple[int, int, bytes, bytes]
NONE: Aligned = (0, 0, b"", b"")
_SCHEMA = pa.schema({"n_a": pa.int64(), "n_b": pa.int64(), "links": pa.list_(pa.int32()), "groups": pa.large_binary()})


#: Letters of the texts that are aligned side by side; a longer one is by itself.
_SIDE = 1 << 14


def _portions(wholes: list[str], fresh: list[bool]) -> list[tuple[int, int]]:
    """Cut before texts with a space in front, if those before aren't very long."""
    out, first, size = [], 0, 0
    for i, w in enumerate(wholes):
        if size and size + len(w) > _SIDE and (fresh[i] or size + len(w) > 2 * _SIDE):
            out.append((first, i))
            first, size = i, 0
        size += len(w)
    return [*out, (first, len(wholes))] if wholes else out


def _last(ends: np.ndarray) -> np.ndarray:
    """Numbers of the tokens that are the last ones of their end; ends don't descend."""
    return np.flatnonzero(np.append(ends[1:] != ends[:-1], True)[: len(ends)])


def _batch(rows: list[Aligned]) -> pa.RecordBatch:
    n_a, n_b, links, groups = zip(*rows, strict=True) if rows else ((),) * 4
    edges = np.cumsum([0, *map(len, links)]) // 4
    lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.frombuffer(b"".join(links), dtype="<i4"), pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), lists, pa.array(groups, pa.large_binary())], schema=_SCHEMA)


def _totals(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums between edges."""
    return np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[edges])


def _same(buf: bytes, ids: np.ndarray, entries: pa.Array) -> bool:
    """Whether the entries of the ids make up the bytes."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), entries.take(pa.array(ids))), b"")[0].as_py() == buf


def _decoded_ends(lengths: np.ndarray, n: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Ends of tokens by their decoded bytes: ``n`` tokens of each text, which begins at ``begin``."""
    total = np.concatenate([[0], np.cumsum(lengths)])
    first = np.cumsum(n) - n
    return total[1:] + np.repeat(begin - total[first], n)


class Aligner:
    """Tokenizes texts with a byte-level BPE file (on a space and the text) and a sentencepiece model (on the text), and aligns the tokens."""

    def __init__(self, byte_bpe: str, piece_model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(byte_bpe)
        self.first.encode_special_tokens = True  # their strings in a text are ordinary text
        self.second = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        self.quick = quick_encoder(self.first) if all(t["special"] for t in json.loads(self.first.to_str())["added_tokens"]) else None
        letters, vocabulary = byte_letters(), json.loads(self.first.to_str())["model"]["vocab"]
        self.first_bytes: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.first_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        n = self.second.piece_size()
        pieces = [self.second.id_to_piece(i) for i in range(n)]
        self.fallback = np.array([self.second.is_byte(i) for i in range(n)])
        self.second_bytes = [bytes([int(p[3:5], 16)]) if f else p.replace("\u2581", " ").encode() for p, f in zip(pieces, self.fallback, strict=True)]
        self.entries_a, self.entries_b = pa.array(self.first_bytes, pa.binary()), pa.array(self.second_bytes, pa.binary())
        self.length_a, self.length_b = (np.array([len(x) for x in own], dtype=np.int64) for own in (self.first_bytes, self.second_bytes))
        if n > 1 << _LOW or len(self.first_bytes) > 1 << (31 - _LOW):
            raise ValueError("vocabularies are too large for link codes of 31 bits")
        # No piece crosses a space, holds a line feed, or has a full stop or comma behind a letter.
        self.apart = not any("\n" in p or "\u2581" in p.lstrip("\u2581") for p in pieces)
        self.stopped = not any(a.isalpha() and b in _STOPS for p in pieces for a, b in zip(p, p[1:], strict=False))
        self.names = pa.array([str(i) for i in range(max(n, len(self.first_bytes)))])
        self.young: dict[str, Aligned] = {}
        self.old: dict[str, Aligned] = {}
        self.stops = {_CUT + c: self._continued(c) for c in _STOPS}

    def _continued(self, stop: str) -> Aligned:
        """A stop behind a letter, less the letter."""
        n_a, n_b, links, groups = self.align(["x" + stop])[0]
        return n_a - 1, n_b - 1, links[4:], groups.partition(b";")[2]

    def align(self, texts: list[str]) -> list[Aligned]:
        """Align a space and each text; a text that begins with a line feed continues another one and has no space in front."""
        fresh = [t[:1] != "\n" for t in texts]
        return self._align([f" {t}" if f else t for t, f in zip(texts, fresh, strict=True)], texts, fresh)

    def whole(self, text: str) -> Aligned:
        """Align a space and a whole text."""
        return self._align([f" {text}"], [text], [True])[0]

    def _align(self, wholes: list[str], texts: list[str], fresh: list[bool]) -> list[Aligned]:
        out: list[Aligned] = []
        for a, z in _portions(wholes, fresh):
            out += (self._joined(wholes[a:z]) if fresh[a] and z > a + 1 else None) or self._apart(wholes[a:z], fresh[a:z])
        return out

    def _joined(self, wholes: list[str]) -> list[Aligned] | None:
        """Align words, each with a space in front, that are encoded as one text; None if its bytes differ or a word's end isn't a token's."""
        whole = "".join(wholes)
        raw = whole.encode()
        lengths = [len(w) for w in wholes] if len(raw) == len(whole) else [len(w.encode()) for w in wholes]
        begin, buf = np.cumsum([0, *lengths], dtype=np.int64), np.frombuffer(raw, dtype=np.uint8)
        letters = np.append(np.flatnonzero((buf & 0xC0) != 0x80), len(buf))
        a = None if self.quick and _SETTLED.fullmatch(whole) else self.first.encode(whole, add_special_tokens=False)
        b = self.second.encode(raw[1:], return_type="offset_mapping")
        flat_a, flat_b, spans = np.array(a.ids if a else self.quick(whole), dtype=np.int64), np.array(b["ids"], dtype=np.int64), b["offsets"]
        if not (_same(raw, flat_a, self.entries_a) and _same(raw, flat_b, self.entries_b)):
            return None
        decoded, counts = [np.cumsum(self.length_a[flat_a]), np.cumsum(self.length_b[flat_b])], []
        for ends in decoded:
            last = np.searchsorted(ends, begin[1:])
            if (ends[last] != begin[1:]).any():
                return None
            counts.append(np.diff(last, prepend=-1))
        # Character offsets end with the character that holds a token's last byte.
        ends_a = letters[np.fromiter((e for _, e in a.offsets), dtype=np.int64, count=len(flat_a)) if a else np.searchsorted(letters, decoded[0])]
        spans = np.fromiter(chain.from_iterable(spans), dtype=np.int64, count=2 * len(flat_b)).reshape(-1, 2)
        return self._cells(buf, begin, flat_a, counts[0], ends_a, flat_b, counts[1], spans, spans[:, 1] + 1)

    def _apart(self, wholes: list[str], fresh: list[bool]) -> list[Aligned]:
        """Align texts that are encoded one by one; those whose bytes differ have no tokens."""
        raws = [w.encode() for w in wholes]
        first = self.first.encode_batch(wholes, add_special_tokens=False)
        second = self.second.encode([r[f:] for r, f in zip(raws, fresh, strict=True)], return_type="offset_mapping", num_threads=1)  # bytes in, bytes out
        ids_a = [x.ids for x in first]
        ids_b = [x["ids"] if f else x["ids"][1:] for x, f in zip(second, fresh, strict=True)]  # less the space that the model puts in front
        good = [i for i, raw in enumerate(raws) if b"".join([self.first_bytes[x] for x in ids_a[i]]) == raw == b"".join([self.second_bytes[x] for x in ids_b[i]])]
        out = [NONE] * len(wholes)
        if not good:
            return out
        buf = np.frombuffer(b"\n".join([raws[i] for i in good]), dtype=np.uint8)  # the gaps keep ends and beginnings apart
        begin = np.cumsum([0, *(len(raws[i]) + 1 for i in good)], dtype=np.int64)
        n_a, n_b = (np.array([len(ids[i]) for i in good], dtype=np.int64) for ids in (ids_a, ids_b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable([ids[i] for i in good]), dtype=np.int64, count=int(n.sum())) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
        ends_a = np.fromiter((e for i in good for _, e in first[i].offsets), dtype=np.int64, count=len(flat_a))
        letters = np.append(np.flatnonzero((buf & 0xC0) != 0x80), len(buf))
        ends_a = letters[np.searchsorted(letters, np.repeat(begin[:-1], n_a)) + ends_a]
        spans = chain.from_iterable([second[i]["offsets"] if fresh[i] else second[i]["offsets"][1:] for i in good])
        spans = np.fromiter(chain.from_iterable(spans), dtype=np.int64, count=2 * len(flat_b)).reshape(-1, 2)
        ends_b = np.repeat(begin[:-1] + np.array([int(fresh[i]) for i in good]), n_b) + spans[:, 1]
        for i, found in zip(good, self._cells(buf, begin, flat_a, n_a, ends_a, flat_b, n_b, spans, ends_b), strict=True):
            out[i] = found
        return out

    def _cells(self, buf: np.ndarray, begin: np.ndarray, flat_a: np.ndarray, n_a: np.ndarray, ends_a: np.ndarray, flat_b: np.ndarray, n_b: np.ndarray, spans: np.ndarray, ends_b: np.ndarray) -> list[Aligned]:
        """Align texts that lie side by side in ``buf``, the texts' starts (and one more) being ``begin``, by the ends of all their tokens' spans."""
        # Tokens of a character share its end, and the last of them counts. A byte-fallback token with an empty span is part of the character behind.
        counts_b = np.flatnonzero((spans[:, 0] < spans[:, 1]) | ~self.fallback[flat_b])
        last_a, last_b = _last(ends_a), counts_b[_last(ends_b[counts_b])]
        coarse, at_a, at_b = np.intersect1d(ends_a[last_a], ends_b[last_b], assume_unique=True, return_indices=True)
        # Cells that aren't ASCII are refined by the decoded bytes; a coarse cut is the end of its cell.
        odd = np.concatenate([[0], np.cumsum(buf >= 0x80)])
        text = np.searchsorted(begin, coarse, side="left") - 1
        refined = odd[coarse] > odd[np.maximum(begin[text], np.concatenate([[0], coarse[:-1]]))]
        cut_a, cut_b = last_a[at_a[~refined]], last_b[at_b[~refined]]
        if refined.any():
            deep_a, deep_b = _decoded_ends(self.length_a[flat_a], n_a, begin[:-1]), _decoded_ends(self.length_b[flat_b], n_b, begin[:-1])
            deep, in_a, in_b = np.intersect1d(deep_a, deep_b, assume_unique=True, return_indices=True)
            own = np.searchsorted(coarse, deep, side="left")
            inside = (own < len(coarse)) & refined[np.minimum(own, len(coarse) - 1)]
            cut_a, cut_b = np.concatenate([cut_a, in_a[inside]]), np.concatenate([cut_b, in_b[inside]])
            order = np.argsort(cut_a)
            cut_a, cut_b = cut_a[order], cut_b[order]

        links = (flat_a[cut_a] << _LOW | flat_b[cut_b]).astype("<i4").tobytes()
        sides = [pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, cut + 1).astype(np.int32)), self.names.take(pa.array(flat))), ",") for cut, flat in ((cut_a, flat_a), (cut_b, flat_b))]
        cells = np.searchsorted(cut_a, np.append(0, np.cumsum(n_a)))
        groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(cells.astype(np.int32)), pc.binary_join_element_wise(*sides, "|")), ";").cast(pa.binary()).to_pylist()
        where = (4 * cells).tolist()
        return [(own_a, own_b, links[a:z], g) for own_a, own_b, a, z, g in zip(n_a.tolist(), n_b.tolist(), where, where[1:], groups, strict=False)]

    def _known(self, words: list[str]) -> list[Aligned]:
        """Different words' alignments, from memory where they are there."""
        if len(self.young) > REMEMBERED:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        out, new = list(map(young.get, words)), []
        for i in [i for i, found in enumerate(out) if found is None]:
            w = words[i]
            if w in old:
                out[i] = young[w] = old[w]
            elif w in self.stops:
                out[i] = self.stops[w]
            else:
                new.append(i)
        for i, found in zip(new, self.align([words[i] for i in new]), strict=True):
            out[i] = found
            if len(words[i]) <= LONGEST:
                young[words[i]] = found
        return out

    def columns(self, texts: pa.Array) -> pa.RecordBatch:
        """n_a, n_b, links and groups of whole texts, in their order; null and empty ones have no tokens."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        some = pc.not_equal(texts, "").to_numpy(zero_copy_only=False)
        cut = some & ~pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False) if self.apart else np.zeros(len(texts), dtype=bool)
        at = np.flatnonzero(cut)
        spaced = pc.replace_substring(texts.take(pa.array(at)), "\n", " \n")
        if self.stopped:
            spaced = pc.replace_substring_regex(spaced, _ENDED, rf"\1 {_CUT}\2\3")
        parts = pc.split_pattern(spaced, " ")
        coded = parts.flatten().dictionary_encode()
        n_a, n_b, links, groups = _batch(self._known(coded.dictionary.to_pylist())).columns
        own = pa.ListArray.from_arrays(pc.subtract(parts.offsets, parts.offsets[0]), coded.indices)
        bad = np.flatnonzero(n_a.to_numpy() == 0)
        if len(bad):  # a text that holds a word without tokens has none
            full = _totals(np.isin(coded.indices.to_numpy(), bad), own.offsets.to_numpy()) == 0
            at, own = at[full], own.filter(pa.array(full))
        words, edges = own.flatten(), own.offsets.to_numpy()
        row, sizes = words.to_numpy(), np.diff(links.offsets.to_numpy())
        ends = np.concatenate([[0], np.cumsum(_totals(sizes[row], edges))])
        found = pa.RecordBatch.from_arrays(
            [
                *(pa.array(_totals(n.to_numpy()[row], edges)) for n in (n_a, n_b)),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), links.take(words).flatten()),
                pc.binary_join(pa.ListArray.from_arrays(pa.array(edges), groups.take(words)), pa.scalar(b";", pa.large_binary())),
            ],
            schema=_SCHEMA,
        )
        rest = np.setdiff1d(np.arange(len(texts)), at)
        others = _batch([self.whole(texts[i].as_py()) if some[i] and not cut[i] else NONE for i in rest.tolist()])
        return pa.concat_batches([found, others]).take(pa.array(np.argsort(np.concatenate([at, rest]))))

    def __call__(self, texts: list[str | None]) -> list[Aligned]:
        """Align whole texts; null and empty ones have no tokens."""
        n_a, n_b, links, groups = (c.to_pylist() for c in self.columns(pa.array(texts, pa.string())).columns)
        return [(a, b, np.array(x, dtype="<i4").tobytes(), g) for a, b, x, g in zip(n_a, n_b, links, groups, strict=True)]


#: A worker's aligners live as long as the worker.
_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(byte_bpe: str, piece_model: str) -> Aligner:
    if (byte_bpe, piece_model) not in _ALIGNERS:
        _ALIGNERS[byte_bpe, piece_model] = Aligner(byte_bpe, piece_model)
    return _ALIGNERS[byte_bpe, piece_model]


def align_documents(docs: DataFrame, key: str, text: str, byte_bpe: str, piece_model: str) -> DataFrame:
    """(key, n_a, n_b, links, groups_sha256) per row: links are codes of id pairs (first id * 2 ** 15 + second id) in order, and
    groups_sha256 is the digest of the groups' ids as ``a1,a2|b1;a3|b2,b3``, or empty without tokens.

    Texts that are null or empty, or whose tokens' bytes differ from the text in either tokenizer, have no tokens. Texts of any
    length are taken whole; rows that repeat are aligned alike, each for itself.
    """
    out = f"{key} {docs.schema[key].dataType.simpleString()}, n_a long, n_b long, links array<int>, groups_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(byte_bpe, piece_model)
        for batch in batches:
            for first, texts in text_chunks(batch["t"], 1 << 20):
                n_a, n_b, links, groups = align.columns(batch["t"].slice(first, len(texts))).columns
                digests = pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in groups.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([batch["k"].slice(first, len(texts)), n_a, n_b, links, digests], names=[key, "n_a", "n_b", "links", "groups_sha256"])

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, out)


def link_counts(aligned: DataFrame) -> DataFrame:
    """(link, n, best): how many links of the corpus hold an id pair, and whether no pair of its second id has more. Links are counted
    in their tasks before the shuffle, and a row per pair is left, whose number the vocabularies bound."""
    counts = aligned.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("n"))
    own = W.partitionBy(F.col("link").bitwiseAND((1 << _LOW) - 1))
    return counts.select("link", "n", (F.col("n") == F.max("n").over(own)).alias("best"))


def align_tokenizers(docs: DataFrame, byte_bpe: str, piece_model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_a, n_b, n_groups, n_links, n_best (links whose pair is its second id's most frequent, ties included), count_sum (the pairs' counts
    over all links), groups_sha256. An empty table gives no rows."""
    spark = docs.sparkSession
    aligned = materialize(align_documents(docs, key, text, byte_bpe, piece_model), "aligned")
    table = link_counts(aligned).toArrow().sort_by("link")  # bounded by the vocabularies
    sent = spark.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("link", "n", "best")))
    out = f"{key} {docs.schema[key].dataType.simpleString()}, n_a long, n_b long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = sent.value
        for batch in batches:
            links = batch["links"]
            at = np.searchsorted(pairs, links.flatten().to_numpy())
            edge = links.offsets.to_numpy() - links.offsets[0].as_py()
            over = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[edge])  # noqa: B023, E731
            cols = [batch[key], batch["n_a"], batch["n_b"], pa.array(np.diff(edge).astype(np.int64)), pa.array(over(best[at])), pa.array(over(n[at])), batch["groups_sha256"]]
            yield pa.RecordBatch.from_arrays(cols, names=[key, "n_a", "n_b", "n_links", "n_best", "count_sum", "groups_sha256"])

    done = aligned.mapInArrow(run, out)
    return done.select(key, "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups_sha256")


def link_ids(link: str | Column) -> tuple[Column, Column]:
    """Both ids of a link's code."""
    link = F.col(link) if isinstance(link, str) else link
    return F.shiftright(link, _LOW), link.bitwiseAND((1 << _LOW) - 1)
