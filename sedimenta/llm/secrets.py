"""Secret scanning with a trigram inverted index.

Every rule's regular expression is turned into a Boolean query over case-folded byte trigrams. Documents
are indexed in blocks, as segments of a search index are: one posting list per trigram that some rule asks
for. A rule's query intersects and unites posting lists, and only the documents it leaves are scanned with
the regular expression. A rule whose expression has no mandatory trigram scans every document.

Blocks need nothing from each other, so there is no shuffle, and memory is bounded by the block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sedimenta.llm.support import free_name, member_table, text_chunks

try:
    from re import _constants as _c
    from re import _parser as _p
except ImportError:  # Python before 3.11
    import sre_constants as _c
    import sre_parse as _p

#: A sub-expression is followed as a set of exact strings up to so many of them.
_EXACT = 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` is an ASCII expression over bytes; ``group`` (0: the whole match) must hold ``least``
    bytes, or the match is dropped. Matches are leftmost and don't overlap. ``runs_of`` marks a rule that
    is no more than a run of the bytes it names: such a full scan needs no expression at all."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    runs_of: bytes = b""

    def finder(self) -> re.Pattern:
        return re.compile(self.pattern.encode("ascii"))


#: The base rules.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24, b"0123456789abcdef"),
)
#: Further well-known shapes; each has mandatory trigrams.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    Rule("hub", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
)
RULES = BASE_RULES + MORE_RULES


# --------------------------------------------------------------------------- Boolean trigram queries
# A query is True (every document), a trigram (bytes), ("and", parts) or ("or", parts).


def _both(parts):
    flat = [p for p in parts if p is not True]
    return True if not flat else flat[0] if len(flat) == 1 else ("and", tuple(dict.fromkeys(flat)))


def _either(parts):
    parts = list(dict.fromkeys(parts))
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _grams(strings):
    """What a document must hold if it holds one of these strings."""
    return _either(_both(s[i : i + 3] for i in range(len(s) - 2)) if len(s) > 2 else True for s in strings)


def _walk(items):
    """Query of a sequence, and the exact strings it stands for (None where there are too many)."""
    queries, run, whole = [], {b""}, True
    for op, arg in items:
        exact, query = _one(op, arg)
        joined = {a + b for a, b in product(run, exact)} if exact is not None and len(run) * len(exact) <= _EXACT else None
        if joined is not None:
            run = joined
            continue
        queries += [_grams(run), query]
        run, whole = exact or {b""}, False
    return (run if whole else None), _both([*queries, _grams(run)])


def _one(op, arg):
    if op is _c.LITERAL:
        return {chr(arg).lower().encode("latin-1")}, True
    if op is _c.SUBPATTERN:
        return _walk(arg[3])
    if op is _c.BRANCH:
        parts = [_walk(x) for x in arg[1]]
        exact = set().union(*(e for e, _ in parts if e is not None)) if all(e is not None for e, _ in parts) else None
        if exact is not None and len(exact) <= _EXACT:
            return exact, True
        return None, _either(_grams(e) if e is not None else q for e, q in parts)
    if op in (_c.MAX_REPEAT, _c.MIN_REPEAT):
        least, most, body = arg
        exact, query = _walk(body)
        if (least, most) == (0, 1) and exact is not None:
            return exact | {b""}, True
        if least == most and exact is not None and least * len(exact) <= 8:
            return {b"".join(x) for x in product(exact, repeat=least)}, True
        return None, (_grams(exact) if exact is not None else query) if least else True
    if op is _c.IN and len(arg) <= 4 and all(o is _c.LITERAL for o, _ in arg):
        return {chr(a).lower().encode("latin-1") for _, a in arg}, True
    if op is _c.AT:
        return {b""}, True
    return None, True


def trigram_query(pattern: str):
    """Boolean query that every text matched by ``pattern`` meets; True if there is none."""
    return _walk(_p.parse(pattern))[1]


def query_trigrams(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*(query_trigrams(q) for q in query[1]))


# --------------------------------------------------------------------------- a block's index


@dataclass
class BlockIndex:
    """Posting lists (sorted document numbers) of a block for the trigrams that the rules ask for."""

    trigrams: list[bytes]
    slot: np.ndarray = field(init=False)

    def __post_init__(self):
        self.slot = np.zeros(1 << 24, dtype=np.uint8 if len(self.trigrams) < 255 else np.uint16)
        for i, g in enumerate(self.trigrams):
            self.slot[g[0] << 16 | g[1] << 8 | g[2]] = i + 1

    def postings(self, joined: bytes, first: np.ndarray) -> dict[bytes, np.ndarray]:
        low = np.frombuffer(joined.lower(), dtype=np.uint8)
        if len(low) < 3:
            return {}
        code = low[:-2].astype(np.uint32)
        code <<= 8
        code |= low[1:-1]
        code <<= 8
        code |= low[2:]
        found = self.slot[code]
        at = np.flatnonzero(found)
        docs, ids = np.searchsorted(first, at, side="right") - 1, found[at]
        order = np.lexsort((docs, ids))
        docs, ids = docs[order], ids[order]
        keep = np.ones(len(docs), dtype=bool)
        keep[1:] = (docs[1:] != docs[:-1]) | (ids[1:] != ids[:-1])
        docs, ids = docs[keep], ids[keep]
        cut = np.searchsorted(ids, np.arange(1, len(self.trigrams) + 2))
        return {g: docs[cut[i] : cut[i + 1]] for i, g in enumerate(self.trigrams)}


def candidates(query, postings: dict[bytes, np.ndarray], n_docs: int) -> np.ndarray:
    """Numbers of the documents that meet a Boolean query."""
    if query is True:
        return np.arange(n_docs)
    if isinstance(query, bytes):
        return postings.get(query, np.empty(0, dtype=np.int64))
    how, parts = query
    lists = sorted((candidates(q, postings, n_docs) for q in parts), key=len)
    out = lists[0]
    for x in lists[1:]:
        out = np.intersect1d(out, x, assume_unique=True) if how == "and" else np.union1d(out, x)
    return out


# --------------------------------------------------------------------------- the operator


def _long_runs(joined: bytes, first: np.ndarray, rule: Rule) -> Iterator[tuple[int, int, int]]:
    """Full scan for a rule that is a run of one byte class: document, start and end in it."""
    inside = np.zeros(len(joined) + 2, dtype=np.int8)
    inside[1:-1] = member_table(rule.runs_of)[np.frombuffer(joined, dtype=np.uint8)]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = ends - starts >= rule.least
    for s, e in zip(starts[long], ends[long], strict=True):
        doc = int(np.searchsorted(first, s, side="right")) - 1
        yield doc, int(s - first[doc]), int(e - first[doc])


def _scan(texts: list[bytes], rules, queries, finders, index: BlockIndex) -> list[list[tuple[int, int, int]]]:
    """Per document the spans (start, number of the rule, end), in bytes."""
    joined = b"\n".join(texts)
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    postings = index.postings(joined, first)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for i, rule in enumerate(rules):
        if rule.runs_of:
            for doc, s, e in _long_runs(joined, first, rule):
                out[doc].append((s, i, e))
            continue
        for doc in candidates(queries[i], postings, len(texts)):
            for m in finders[i].finditer(texts[doc]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    out[doc].append((m.start(), i, m.end()))
    return out


def _code_points(text: bytes, places: list[int]) -> dict[int, int]:
    """Byte offsets as code point offsets."""
    if text.isascii():
        return {p: p for p in places}
    raw = np.frombuffer(text, dtype=np.uint8)
    begins = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return {p: int(begins[p]) for p in places}


def scan_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, out: str = "secrets") -> DataFrame:
    """Add ``out``: array of (kind, start, end) spans in code points, by start and then by rule order.

    All other columns pass through. Null text counts as empty and has no spans; a text of any length is
    scanned whole. Rows are taken singly, so repeated rows give repeated results and no row is dropped.
    If ``out`` is taken it gets leading underscores.
    """
    (name,) = free_name(docs, out)
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(span))])
    place, names = docs.columns.index(text), schema.names
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted(set().union(*(query_trigrams(q) for q in queries)))
    arrow_span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        index, finders = BlockIndex(grams), [r.finder() for r in rules]
        for batch in batches:
            for first, texts in text_chunks(batch.column(place)):
                spans = []
                for doc, found in zip(texts, _scan(texts, rules, queries, finders, index), strict=True):
                    found.sort()
                    cp = _code_points(doc, [p for s, _, e in found for p in (s, e)]) if found else {}
                    spans.append([{"kind": rules[i].kind, "start": cp[s], "end": cp[e]} for s, i, e in found])
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(spans, arrow_span)], names=names)

    return docs.mapInArrow(run, schema)


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[secret]") -> str:
    """Replace spans (code points; overlapping ones are merged) by a mark."""
    out, at = [], 0
    for s, e in sorted(spans):
        if e > at:
            out += [text[at:s], mark] if s >= at else []
            at = e
    return "".join([*out, text[at:]])


