"""Removal of repeated byte strings by prefix-free parsing.

Parsing. A rolling hash over ``trigger`` bytes marks triggers: the place whose hash is smallest (the first of equals) among the
``length - trigger + 1`` places of a string of ``length`` bytes is the string's trigger, which depends on nothing but the string.
Triggers cut a text into phrases, each from one trigger to the end of the next, so that neighbours overlap by a trigger and
no phrase begins another one. A text is then its parse, the sequence of its phrases' names.

Dictionary. The strings around a trigger, all that have it as theirs, are an entry: the run of phrases that covers them. Spark
deals entries to buckets by their trigger, by name and without text. An entry that a document of a smaller id has too is
settled: all its strings are repeats. An entry whose trigger occurs once, or with one entry only, has no further repeats.

Suffix order. Only for what is left the text is fetched, clipped to the entry's strings. In a bucket, the phrases that end at a
trigger are sorted by their bytes read backwards, which puts all suffixes of the dictionary that are equal to any depth side by
side, and the parses that follow it are sorted by their bytes read on. A string that begins ``d`` bytes before its
trigger is named by the place of its phrase suffix in the one order and of its parse in the other, each to the depth that the
string reaches; common prefixes of neighbours tell where these places change. Together, trigger by trigger, this is the order of all
strings of the corpus that occur more than once, and the smallest document at a place tells which occurrences go.

Frequent triggers. A task settles what it can of its own text before the shuffle, so that an entry goes out once a task, and a
run of one entry (a ruler line) is one row. A trigger with more than ``hot`` entries (or ``hot / 8`` in one task's text) isn't ordered in
one place: the strings around it are dealt by their own hash, each from its task's smallest document only, and compared
byte by byte.

Entries are compared by 96 bits and the bucket's share of the trigger's hash; strings are compared by their bytes. The number
of buckets follows the size of the texts, and no task holds more than its bucket. A document's text moves twice, keyed by the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.support import SEGMENT, hash_spans, materialize, mix64, powers, shuffle_partitions, text_chunks, utf8

#: Bytes that a trigger's hash covers.
TRIGGER = 20
#: Text that one task parses before it hands its triggers on.
_FLUSH = 24 << 20
#: Text of one bucket.
_BUCKET = 32 << 20
_NONE = np.iinfo(np.int64).max
#: Entries of one trigger that meet in one task.
HOT_ENTRIES = 4096
#: Strings of frequent triggers that a task compares before it hands them on.
_STRINGS = 1 << 18


def rolling_hash(buf: np.ndarray, width: int) -> np.ndarray:
    """Fingerprint of the ``width`` bytes from each place on: a rolling polynomial, read off prefix sums."""
    out = np.empty(max(0, len(buf) - width + 1), dtype=np.uint64)
    up, down = powers()
    for at in range(0, len(out), SEGMENT):
        n = min(SEGMENT, len(out) - at)
        sums = np.zeros(n + width, dtype=np.uint64)
        np.cumsum((buf[at : at + n + width - 1].astype(np.uint64) + np.uint64(1)) * up[: n + width - 1], out=sums[1:])
        out[at : at + n] = mix64((sums[width:] - sums[:n]) * down[:n])
    return out


def first_minimum(values: np.ndarray, window: int) -> np.ndarray:
    """Place of the smallest value (the first of equals) of every window of ``window`` neighbours."""
    at, span = np.arange(len(values), dtype=np.int32), 1

    def earlier(shift: int):
        nonlocal values, at
        later = values[shift:] < values[:-shift]
        values = np.where(later, values[shift:], values[:-shift])
        at = np.where(later, at[shift:], at[:-shift])

    while span * 2 <= window:
        earlier(span)
        span *= 2
    if span < window:
        earlier(window - span)
    return at


# --------------------------------------------------------------------------- tables between the tasks
#
# A row carries one bucket's part of a task's entries as arrays in a binary column. Documents are named by doc (their
# id as a long, null as the largest) and print (a fingerprint of the text, which tells rows of one id apart). A place stands for the
# starts of strings at, at + 1, ..., n of them, whose trigger is off behind the first; count such places lie end to end.
# Where all ids differ, print is 0: the names of documents are as many as entries when buckets are many.

_SPOT = [("at", "<u4"), ("count", "<u2"), ("n", "u1"), ("off", "u1")]
_FOUND_SPOT = np.dtype(_SPOT)
_PLACE = np.dtype([("row", "<u4"), *_SPOT])
_ENTRY = np.dtype([("trigger", "<u4"), ("entry", "<u8"), *_PLACE.descr])
_PARSED = np.dtype([("hash", "<u8"), ("entry", "<u8"), *_PLACE.descr])

_BEGIN, _END, _MUL = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0x9E3779B97F4A7C15)


def parse(joined: np.ndarray, first: np.ndarray, length: int, width: int) -> np.ndarray:
    """Entries of several joined texts (``first``: their starts, and one more), in order: trigger's hash, entry's name, text (row) and
    place. Equal entries that lie end to end are one."""
    if len(joined) < length:
        return np.empty(0, dtype=_PARSED)
    hashes, window = rolling_hash(joined, width), length - width + 1
    allowed = np.ones(len(joined) - length + 1, dtype=bool)
    for end in first[1:]:  # strings that run into the next text, or over its separator
        allowed[max(0, end - length) : end] = False
    start = np.flatnonzero(allowed)
    if not len(start):
        return np.empty(0, dtype=_PARSED)
    own = first_minimum(hashes, window)[: len(allowed)][start]
    new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    at, begin = own[new].astype(np.int64), start[new]
    n = np.diff(np.append(new, len(own)))
    row = np.searchsorted(first, at, side="right") - 1

    # Names of the phrases: one that ends at each trigger, and the one behind each text's last.
    head = np.concatenate([[True], row[1:] != row[:-1]])
    tail = np.append(head[1:], True)
    phrase = np.arange(len(at)) + np.cumsum(head) - 1
    last = phrase[tail] + 1
    from_, to, name = (np.empty(len(at) + len(last), dtype=k) for k in (np.int64, np.int64, np.uint64))
    from_[phrase], to[phrase] = np.where(head, first[row], np.concatenate([[0], at[:-1]])), at
    from_[last], to[last] = at[tail], first[row[tail] + 1] - 1
    spans = hash_spans(joined, from_, to)
    name[phrase], name[last] = spans[phrase] * _MUL + hashes[at] + np.where(head, _BEGIN, np.uint64(0)), spans[last] * _MUL + _END
    name = mix64(name)

    # An entry is the run of phrases from the one that holds its first start to the one that holds its last byte.
    low = np.minimum(np.searchsorted(at, begin, side="right"), np.arange(len(at)))
    high = np.searchsorted(at, begin + n - 1 + length - width)
    inside = (high < len(at)) & (row[np.minimum(high, len(at) - 1)] == row)
    a, z = phrase[low], np.where(inside, phrase[np.minimum(high, len(at) - 1)], last[row_of(head)])
    entry = mix64(name[a] + (n + 256 * (at - begin)).astype(np.uint64))
    going, step = np.flatnonzero(a < z), 1
    while len(going):
        entry[going] = mix64(entry[going] * _MUL + name[a[going] + step])
        step += 1
        going = going[a[going] + step <= z[going]]

    same = np.zeros(len(at), dtype=bool)
    key = hashes[at]
    same[1:] = (key[1:] == key[:-1]) & (entry[1:] == entry[:-1]) & (n[1:] == n[:-1]) & (begin[1:] == begin[:-1] + n[:-1]) & ~head[1:]
    run = np.arange(len(at)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))
    lead = np.flatnonzero(run % 0xFFFF == 0)
    out = np.empty(len(lead), dtype=_PARSED)
    out["hash"], out["entry"], out["row"], out["at"] = key[lead], entry[lead], row[lead], (begin - first[row])[lead]
    out["count"], out["n"], out["off"] = np.diff(np.append(lead, len(at))), n[lead], (at - begin)[lead]
    return out


def row_of(head: np.ndarray) -> np.ndarray:
    """Number of the group of each row, where ``head`` marks the groups' first rows."""
    return np.cumsum(head) - 1


#: Blobs are compressed before Spark sees them: it takes a field's bytes for a mixture.
_CODEC = pa.Codec("zstd", compression_level=1)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays by fields, and each field by its bytes (all first ones, all second ones, ...), compressed."""
    out = []
    for a in arrays:
        out.append(len(a).to_bytes(8, "little"))
        for field in [a[c] for c in a.dtype.names] if a.dtype.names else [a]:
            out.append(np.ascontiguousarray(field).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"")
    raw = b"".join(out)
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def _unpack(raw: bytes, *kinds) -> list[np.ndarray]:
    out, at = [], 0
    raw = _CODEC.decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True)
    for k in map(np.dtype, kinds):
        n, a = int.from_bytes(raw[at : at + 8], "little"), at + 8
        whole = np.empty(n, dtype=k)
        for c in k.names or [None]:
            field, width = (whole[c], k[c].itemsize) if c else (whole, k.itemsize)
            planes = np.frombuffer(raw, dtype=np.uint8, count=n * width, offset=a).reshape(width, n)
            field[...] = np.ascontiguousarray(planes.T).view(field.dtype).ravel()
            a += n * width
        out.append(whole)
        at = a
    return out


#: Kinds of places that are found, and of a bucket's blobs: found places that are passed on, and what is to be compared.
SETTLED, OPEN, REPEAT, HOT, ENTRIES, MARKS, CONTEXTS, STRINGS = range(8)
_BLOBS = "bucket int, kind int, blob binary"


def _blob_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    bucket, kind, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], names=["bucket", "kind", "blob"])


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """First and last (and one more) of each run of equal values."""
    ends = np.append(np.flatnonzero(values[1:] != values[:-1]) + 1, len(values))
    return list(zip([0, *ends[:-1]], ends, strict=True)) if len(values) else []


def _deal(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of each bucket that has some."""
    order = np.argsort(bucket, kind="stable")
    return ((int(bucket[order[a]]), order[a:b]) for a, b in _runs(bucket[order]))


def _places(rows: np.ndarray, kind: np.dtype = _PLACE) -> np.ndarray:
    out = np.zeros(len(rows), dtype=kind)
    for c in kind.names:
        if c in rows.dtype.names:
            out[c] = rows[c]
    return out


def _dealt(names: np.ndarray, rows: np.ndarray, bucket: np.ndarray, kind: int, dtype: np.dtype = _PLACE, more=None) -> list[tuple[int, int, bytes]]:
    """A blob for each bucket: the documents' names, the rows by document and place with the steps of their numbers among
    these, and what ``more`` adds for the rows."""
    out = []
    for b, own in _deal(bucket):
        own = own[np.argsort(rows["row"][own].astype(np.uint64) << np.uint64(32) | rows["at"][own], kind="stable")]
        used, back = np.unique(rows["row"][own], return_inverse=True)
        part = _places(rows[own], dtype)
        part["row"] = np.diff(back, prepend=0)
        out.append((b, kind, _pack(names[used].T.ravel(), part, *([more(own)] if more else []))))
    return out


def _by_doc(names: np.ndarray, rows: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets for places that are found already: by document."""
    return (mix64(names[rows["row"], 1].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _settle_own(rows: np.ndarray, doc: np.ndarray, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A task's entries in another order, which of them are settled by a smaller document of the task, which of the
    rest belong to triggers of more than ``hot`` entries, and those triggers' hashes."""
    rows = rows[np.argsort(mix64(rows["hash"]) ^ rows["entry"], kind="stable")]
    hashes, entry, doc = rows["hash"].copy(), rows["entry"].copy(), doc[rows["row"]]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (entry[1:] != entry[:-1])
    begin = np.flatnonzero(new)
    settled = doc > np.minimum.reduceat(doc, begin)[row_of(new)]
    heads = np.sort(hashes[begin])
    frequent = np.unique(heads[hot:][heads[hot:] == heads[: len(heads) - hot]]) if len(heads) > hot else heads[:0]
    return rows, settled, ~settled & np.isin(hashes, frequent) if len(frequent) else np.zeros(len(rows), dtype=bool), frequent


def _parse_rows(batches, length: int, width: int, buckets: int, hot: int = HOT_ENTRIES) -> Iterator[pa.RecordBatch]:
    """(bucket, kind, blob): every document's entries, dealt by trigger, but those that are settled within the task."""
    kept: list[np.ndarray] = []
    docs: list[tuple[int, int]] = []
    size = 0

    def flush():
        rows = np.concatenate(kept) if kept else np.empty(0, dtype=_PARSED)
        names = np.array(docs, dtype=np.int64).reshape(-1, 2)
        if len(rows):
            rows, settled, heated, frequent = _settle_own(rows, names[:, 0], max(1, hot // 8))
            out = []
            for which, kind in ((settled, SETTLED), (heated, HOT)):
                out += _dealt(names, rows[which], _by_doc(names, rows[which], buckets), kind)
            for b, own in _deal((frequent % np.uint64(buckets)).astype(np.int64)):
                out.append((b, MARKS, (frequent[own] >> np.uint64(32)).astype("<u4").tobytes()))
            rows = rows[~(settled | heated)]
            entries = _places(rows, _ENTRY)
            entries["trigger"] = rows["hash"] >> np.uint64(32)
            yield _blob_batch(out + _dealt(names, entries, (rows["hash"] % np.uint64(buckets)).astype(np.int64), ENTRIES, _ENTRY))
        kept.clear()
        docs.clear()

    for batch in batches:
        for row, texts in text_chunks(batch.column(2), 1 << 18):
            joined = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
            rows = parse(joined, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]), length, width)
            rows["row"] += len(docs)
            kept.append(rows)
            docs.extend(zip(batch.column(0).slice(row, len(texts)).to_pylist(), batch.column(1).slice(row, len(texts)).to_pylist(), strict=True))
            size += len(joined)
            if size > _FLUSH:
                yield from flush()
                size = 0
    yield from flush()


def _join_blobs(blobs, kind: np.dtype, *more) -> tuple[np.ndarray, ...]:
    """All rows of a bucket's blobs, with the documents' names; row numbers are made to fit."""
    names, rows, rest, seen = [], [], [], 0
    for raw in blobs:
        n, r, *x = _unpack(raw, "<i8", kind, *more)
        r["row"] = np.cumsum(r["row"], dtype=np.int64) + seen
        seen += len(n) // 2
        names.append(n.reshape(2, -1).T)
        rows.append(r)
        rest.append(x)
    return (np.concatenate(names), np.concatenate(rows), *(np.concatenate(x) for x in zip(*rest, strict=True)))


def _per_doc(names: np.ndarray, rows: np.ndarray, kind: int) -> list[tuple[int, int, int, bytes]]:
    """(doc, print, kind, places) for each document; the rows' numbers name it."""
    order = np.argsort(rows["row"], kind="stable")
    row, spots = rows["row"][order], _places(rows[order], _FOUND_SPOT)
    return [(int(names[row[a], 0]), int(names[row[a], 1]), kind, spots[a:b].tobytes()) for a, b in _runs(row)]


_FOUND = "doc long, print long, kind int, places binary"


def _found_table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    doc, prints, kind, places = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({"doc": pa.array(doc, pa.int64()), "print": pa.array(prints, pa.int64()), "kind": pa.array(kind, pa.int32()), "places": pa.array(places, pa.binary())})


def _by_kind(table: pa.Table, passed: tuple[int, ...]) -> tuple[dict[int, list[bytes]], list[tuple[int, int, int, bytes]]]:
    """A bucket's blobs by kind, and the found places that it passes on."""
    blobs: dict[int, list[bytes]] = {}
    for kind, blob in zip(table["kind"].to_pylist(), table["blob"].to_pylist(), strict=True):
        blobs.setdefault(kind, []).append(blob)
    return blobs, [x for kind in passed if kind in blobs for x in _per_doc(*_join_blobs(blobs[kind], _PLACE), kind)]


def settle_bucket(table: pa.Table, hot: int = HOT_ENTRIES) -> pa.Table:
    """Entries of a bucket: SETTLED places (their entry is a smaller document's too), OPEN ones (first of an entry
    whose trigger has other entries, in more than one document), and HOT ones (such places of a frequent trigger)."""
    blobs, out = _by_kind(table, (SETTLED, HOT))
    if ENTRIES not in blobs:
        return _found_table(out)
    names, rows = _join_blobs(blobs[ENTRIES], _ENTRY)
    doc = names[rows["row"], 0]
    order = np.lexsort((doc, rows["entry"], rows["trigger"]))
    rows, doc = rows[order], doc[order]
    new_trigger = np.concatenate([[True], rows["trigger"][1:] != rows["trigger"][:-1]])
    new_entry = new_trigger | np.concatenate([[True], rows["entry"][1:] != rows["entry"][:-1]])
    trigger_of = row_of(new_trigger)
    settled = doc > doc[np.flatnonzero(new_entry)][row_of(new_entry)]
    begin = np.flatnonzero(new_trigger)
    entries = np.add.reduceat(new_entry.astype(np.int64), begin)
    several = (np.minimum.reduceat(doc, begin) != np.maximum.reduceat(doc, begin)) & (entries > 1)
    marked = np.frombuffer(b"".join(blobs.get(MARKS, [])), dtype="<u4")
    frequent = (several & (entries > hot)) | np.isin(rows["trigger"][begin], marked)
    heated = frequent[trigger_of] & ~settled
    opened = several[trigger_of] & ~settled & ~heated  # all places of an entry's first document
    for which, kind in ((settled, SETTLED), (heated, HOT), (opened, OPEN)):
        out += _per_doc(names, rows[which], kind)
    return _found_table(out)


def _string_hash(strings: np.ndarray) -> np.ndarray:
    words = np.zeros((len(strings), -(-strings.shape[1] // 8) * 8), dtype=np.uint8)
    words[:, : strings.shape[1]] = strings
    out = np.zeros(len(strings), dtype=np.uint64)
    for word in words.view("<u8").T:
        out = mix64((out ^ word) * _MUL + np.uint64(1))
    return out


def _repeated(strings: np.ndarray, hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which strings (rows of bytes) a smaller document has too. Equal hashes are verified on the bytes."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    alike = (strings[order][1:] == strings[order][:-1]).all(axis=1)
    if (same & ~alike).any():  # different strings of one hash
        group = np.unique(np.ascontiguousarray(strings), axis=0, return_inverse=True)[1].ravel()
    else:
        group = np.empty(len(order), dtype=np.int64)
        group[order] = np.cumsum(np.concatenate([[0], ~same]))
    least = np.full(int(group.max()) + 1, _NONE, dtype=np.int64)
    np.minimum.at(least, group, doc)
    return doc > least[group]


def _copies(rows: np.ndarray, skip: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places of the ``n`` starts from ``skip`` on in each of a place's copies."""
    whole = (skip == 0) & (n == rows["n"])
    part = np.flatnonzero(~whole)
    times = rows["count"][part].astype(np.int64)
    back = np.repeat(part, times)
    nth = np.arange(len(back)) - np.repeat(np.cumsum(times) - times, times)
    out = _places(rows[back])
    out["at"] = rows["at"][back] + skip[back] + nth * rows["n"][back]
    out["count"], out["n"] = 1, n[back]
    return np.concatenate([_places(rows[whole]), out])


def _string_blobs(parts: list[tuple[tuple[int, int], np.ndarray, np.ndarray]], buckets: int) -> list[tuple[int, int, bytes]]:
    """Strings of frequent triggers, (document's name, places, strings), dealt by hash; those that a smaller document of the
    task has too are found already. A string's place has its offset in ``off``."""
    names = np.array([p[0] for p in parts], dtype=np.int64).reshape(-1, 2)
    rows, strings = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    rows["row"] = np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts])
    hashes = _string_hash(strings)
    gone = _repeated(strings, hashes, names[rows["row"], 0])
    found = _copies(rows[gone], rows["off"][gone].astype(np.int64), np.ones(int(gone.sum()), dtype=np.int64))
    rows, strings, hashes = rows[~gone], strings[~gone], hashes[~gone]
    dealt = _dealt(names, rows, (hashes % np.uint64(buckets)).astype(np.int64), STRINGS, more=lambda own: strings[own].ravel())
    return _dealt(names, found, _by_doc(names, found, buckets), REPEAT) + dealt


def _windows(text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of several pieces of a text, one behind the other."""
    ahead = np.cumsum(size) - size
    return text[np.repeat(begin - ahead, size) + np.arange(int(size.sum()))]


def _context_rows(batches, length: int, width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, kind, blob): the texts of open entries, dealt by their trigger again, and the strings around frequent triggers."""
    parts, held = [], 0
    for batch in batches:
        for first, texts in text_chunks(batch.column(2), 4 << 20):
            ids = [x.slice(first, len(texts)).to_pylist() for x in batch.columns[:2]]
            names, opened, base, at = np.array(ids, dtype=np.int64).T, [], [], 0
            for i, (raw, blobs) in enumerate(zip(texts, batch.column(3).slice(first, len(texts)).to_pylist(), strict=True)):
                for x in blobs or []:
                    rows = _places(np.frombuffer(x["places"], dtype=_FOUND_SPOT))
                    rows["row"] = i
                    if x["kind"] == OPEN:
                        opened.append(rows)
                        base.append(np.full(len(rows), at))
                        continue
                    views = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, dtype=np.uint8), length)
                    n = rows["n"].astype(np.int64)
                    each = np.repeat(np.arange(len(rows)), n)
                    rows, skip = rows[each], np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                    rows["off"] = skip
                    for a in range(0, len(rows), _STRINGS):
                        own = rows[a : a + _STRINGS]
                        parts.append((tuple(names[i]), own, views[own["at"].astype(np.int64) + skip[a : a + _STRINGS]]))
                        held += len(own)
                        if held >= _STRINGS:
                            yield _blob_batch(_string_blobs(parts, buckets))
                            parts, held = [], 0
                at += len(raw)
            if opened:
                rows, text = np.concatenate(opened), np.frombuffer(b"".join(texts), dtype=np.uint8)
                begin, size = np.concatenate(base) + rows["at"], rows["n"].astype(np.int64) + length - 1
                grams = _windows(text, begin + rows["off"], np.full(len(rows), width))
                bucket = (rolling_hash(grams, width)[::width] % np.uint64(buckets)).astype(np.int64)
                yield _blob_batch(_dealt(names, rows, bucket, CONTEXTS, more=lambda own, t=text, b=begin, s=size: _windows(t, b[own], s[own])))
    if parts:
        yield _blob_batch(_string_blobs(parts, buckets))


def _sorted(group: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of byte strings (rows) within their groups, and how many bytes each shares with the one before; -1 where a group begins."""
    wide = np.zeros((len(strings), -(-strings.shape[1] // 8) * 8), dtype=np.uint8)
    wide[:, : strings.shape[1]] = strings
    order = np.lexsort((*wide.view(">u8").astype(np.uint64).T[::-1], group))
    unlike = strings[order][1:] != strings[order][:-1]
    shared = np.where(unlike.any(axis=1), unlike.argmax(axis=1), strings.shape[1])
    shared[group[order][1:] != group[order][:-1]] = -1
    return order, np.concatenate([[-1], shared])


def string_order(text: np.ndarray, begin: np.ndarray, n: np.ndarray, off: np.ndarray, group: np.ndarray, length: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The places, in the order of all strings, of the strings of entries: for each distance to the trigger the entries that have
    such a string, its number among their starts, and its place; equal places are equal strings.

    Entries are at ``begin`` in ``text``, with ``n`` starts and the trigger ``off`` behind; ``group`` tells triggers apart.
    """
    reach, trigger = length - width, begin + off
    depth = np.arange(reach)
    before = np.where(depth < off[:, None], text[np.maximum(trigger[:, None] - 1 - depth, 0)], 0)
    room = (n + length - 1 - off - width)[:, None]
    behind = np.where(depth < room, text[np.minimum(trigger[:, None] + width + depth, len(text) - 1)], 0)
    suffixes, parses = _sorted(group, before), _sorted(group, behind)

    def place(order: np.ndarray, shared: np.ndarray, reached: int) -> np.ndarray:
        out = np.empty(len(order), dtype=np.int64)
        out[order] = np.cumsum(shared < reached)
        return out

    for d in range(reach + 1):
        own = np.flatnonzero((d <= off) & (d > off - n))
        if len(own):
            yield own, off[own] - d, place(*suffixes, d)[own] * (len(begin) + 1) + place(*parses, reach - d)[own]


#: Entries that are ordered at once; those of one trigger stay together.
_ORDERED = 1 << 15


def repeats_in_bucket(table: pa.Table, length: int, width: int) -> pa.Table:
    """REPEAT places: starts of strings in a bucket's entries that a smaller document's entry holds too. Equal strings share
    their trigger, so that the bucket's triggers are taken some at a time."""
    blobs, out = _by_kind(table, (REPEAT,))
    if STRINGS in blobs:
        names, rows, text = _join_blobs(blobs[STRINGS], _PLACE, np.uint8)
        strings = text.reshape(-1, length)
        gone = _repeated(strings, _string_hash(strings), names[rows["row"], 0])
        out += _per_doc(names, _copies(rows[gone], rows["off"][gone].astype(np.int64), np.ones(int(gone.sum()), dtype=np.int64)), REPEAT)
    if CONTEXTS not in blobs:
        return _found_table(out)
    names, rows, text = _join_blobs(blobs[CONTEXTS], _PLACE, np.uint8)
    n, off = rows["n"].astype(np.int64), rows["off"].astype(np.int64)
    size = n + length - 1
    begin = np.cumsum(size) - size
    grams = _windows(text, begin + off, np.full(len(rows), width)).reshape(-1, width)
    order = np.lexsort(_string_hash(grams)[None])
    hashes = _string_hash(grams[order])
    ends = np.append(np.flatnonzero(hashes[1:] != hashes[:-1]) + 1, len(rows))
    at = 0
    while at < len(rows):
        stop = int(ends[max(np.searchsorted(ends, at + _ORDERED, side="right") - 1, np.searchsorted(ends, at, side="right"))])
        part, group = order[at:stop], np.unique(np.ascontiguousarray(grams[order[at:stop]]).view(f"V{width}").ravel(), return_inverse=True)[1]
        doc = names[rows["row"][part], 0]
        gone_entry, gone_start = [], []
        for own, start, place in string_order(text, begin[part], n[part], off[part], group, length, width):
            place = np.unique(place, return_inverse=True)[1]
            least = np.full(int(place.max()) + 1, _NONE, dtype=np.int64)
            np.minimum.at(least, place, doc[own])
            gone = doc[own] > least[place]
            gone_entry.append(own[gone])
            gone_start.append(start[gone])
        at = stop
        entry, start = np.concatenate(gone_entry), np.concatenate(gone_start)
        if len(entry):
            by = np.lexsort((start, entry))
            entry, start = entry[by], start[by]
            lead = np.flatnonzero(np.concatenate([[True], (entry[1:] != entry[:-1]) | (start[1:] != start[:-1] + 1)]))
            out += _per_doc(names, _copies(rows[part[entry[lead]]], start[lead], np.diff(np.append(lead, len(entry)))), REPEAT)
    return _found_table(out)


def _cut(texts: list[bytes], found: list[list[bytes] | None], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Texts (their numbers), starts and ends of the removed runs, and every text without them."""
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    spots = [np.frombuffer(x, dtype=_FOUND_SPOT) for own in found for x in own or []]
    which = np.repeat(np.arange(len(texts)), [sum(len(x) for x in own or []) // _FOUND_SPOT.itemsize for own in found])
    spots = np.concatenate([np.empty(0, dtype=_FOUND_SPOT), *spots])
    begin = first[which] + spots["at"]
    end = begin + spots["n"].astype(np.int64) * spots["count"] - 1 + length
    edge = np.bincount(begin, minlength=first[-1] + 1) - np.bincount(end, minlength=first[-1] + 1)
    step = np.diff(np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8)]))
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    which = np.searchsorted(first, begin, side="right") - 1
    begin, end = begin - first[which], end - first[which]
    kept = list(texts)
    cut = np.searchsorted(which, np.arange(len(texts) + 1))
    for i in np.unique(which):
        own = slice(cut[i], cut[i + 1])
        kept[i] = b"".join(texts[i][a:b] for a, b in zip([0, *end[own]], [*begin[own], len(texts[i])], strict=True))
    return which, begin, end, kept


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 50, trigger: int = TRIGGER, hot: int = HOT_ENTRIES) -> DataFrame:
    """doc_id, n_bytes, removed (array of start, end: maximal runs of bytes, end exclusive), kept (binary: the bytes that
    are left) for every row of ``docs``.

    A byte goes if a string of ``length`` bytes that covers it also starts in a document of a smaller doc_id; strings are
    judged on the input and never cross documents. Null text is empty. Rows that repeat a doc_id don't count against each
    other; a null doc_id counts as larger than any other. Texts of any length are parsed whole, one at a time. Other columns take
    no part. An empty table gives no rows.
    """
    doc = F.coalesce(F.col(doc_id).cast("long"), F.lit(_NONE))
    differ = docs.groupBy(doc.alias("doc")).count().where("count > 1").isEmpty()
    # 0, but no literal, which would drop out of the joins' keys, and never null, so that both joins share one exchange of the texts.
    mark = F.coalesce(F.pmod(doc, F.lit(1).cast("long")), F.lit(0).cast("long")) if differ else F.xxhash64(utf8(text))
    raw = docs.select(doc.alias("doc"), mark.alias("print"), utf8(text).alias("raw"))
    size = raw.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    buckets = parts = max(shuffle_partitions(docs.sparkSession), -(-size // _BUCKET))
    homed = raw.repartition(parts, "doc", "print")

    parsed = raw.mapInArrow(lambda it: _parse_rows(it, length, trigger, buckets, hot), _BLOBS).repartitionById(parts, "bucket")  # a task for each bucket
    settled = materialize(parsed.groupBy("bucket").applyInArrow(lambda t: settle_bucket(t, hot), _FOUND), "settled")

    opened = settled.where(F.col("kind").isin(OPEN, HOT)).groupBy("doc", "print").agg(F.collect_list(F.struct("kind", "places")).alias("places"))
    contexts = homed.join(opened, ["doc", "print"]).select("doc", "print", "raw", "places").mapInArrow(lambda it: _context_rows(it, length, trigger, buckets), _BLOBS)
    repeated = contexts.repartitionById(parts, "bucket").groupBy("bucket").applyInArrow(lambda t: repeats_in_bucket(t, length, trigger), _FOUND)

    found = settled.where(F.col("kind") == SETTLED).unionByName(repeated).groupBy("doc", "print").agg(F.collect_list("places").alias("found"))

    def finish(batches):
        for batch in batches:
            for first, texts in text_chunks(batch.column(1)):
                which, begin, end, kept = _cut(texts, batch.column(2).slice(first, len(texts)).to_pylist(), length)
                spans = pa.StructArray.from_arrays([pa.array(begin, pa.int64()), pa.array(end, pa.int64())], ["start", "end"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(which, np.arange(len(texts) + 1)), pa.int32()), spans)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array([len(t) for t in texts], pa.int64()), lists, pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])

    whole = homed.join(found, ["doc", "print"], "left").select(F.nullif("doc", F.lit(_NONE)).alias("doc_id"), "raw", "found")
    return whole.mapInArrow(finish, "doc_id long, n_bytes long, removed array<struct<start: long, end: long>>, kept binary")
