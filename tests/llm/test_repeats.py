"""Repeat removal against brute force over all 50-byte strings."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from sedimenta.llm import queries, repeats


def brute(docs, length=50):
    least = {}
    key = lambda d: float("inf") if d is None else d
    for d, raw in docs:
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            least[s] = min(key(d), least.get(s, float("inf")))
    out = []
    for d, raw in docs:
        gone = np.zeros(len(raw) + 2, dtype=bool)
        for i in range(len(raw) - length + 1):
            if least[raw[i : i + length]] < key(d):
                gone[i + 1 : i + 1 + length] = True
        step = np.diff(gone.astype(int))
        runs = list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))
        out.append((d, len(raw), runs, bytes(b for b, g in zip(raw, gone[1:-1], strict=True) if not g)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["doc_id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["removed"]], bytes(r["kept"])) for r in repeats.remove_repeats(df).collect()), key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "thtion", "and", "é", "ing ", "or\n", "ble"]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randrange(8, 60))) for _ in range(5)]
    out = []
    for _ in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(90))) for _ in range(rng.randrange(5))]
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    texts = corpus(seed, 70)
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, texts[9]), (None, texts[5]), (None, "z" * 120), (90, "z" * 120), (91, None), (92, ""), (93, "z" * 49), (94, "ab" * 3000 + texts[4])]
    docs += [(200 + i, texts[8] or "x") for i in range(30)]
    random.Random(seed).shuffle(docs)
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, raw int").repartition(5)
    assert found(df) == brute([(d, (t or "").encode()) for d, t in docs])


STOCK = "terms and conditions apply to every offer here"


def noise(rng, n):
    return "".join(rng.choice("abcdefgh ") for _ in range(n))


def test_frequent_trigger_is_spread():
    """A stock phrase in 3,000 different contexts doesn't send an entry for each to one bucket."""
    rng = random.Random(3)
    texts = [(noise(rng, 60) + STOCK + noise(rng, 60)).encode() for _ in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array(range(3000), pa.int64()), pa.array(texts, pa.binary())], names=["doc", "print", "raw"])
    size = dict.fromkeys(range(50), 0)
    for out in repeats._parse_rows([batch], 50, 20, 50):
        for r in out.to_pylist():
            size[r["bucket"]] += len(r["blob"])
    assert max(size.values()) < 2 * np.median(list(size.values()))


def test_frequent_triggers_equal_brute_force(spark):
    rng = random.Random(4)
    some = [noise(rng, 8) for _ in range(4)]
    texts = [noise(rng, rng.randrange(60)) + rng.choice(some) + STOCK + rng.choice(some) + noise(rng, rng.randrange(60)) for _ in range(150)] + corpus(3, 40)
    docs = [(i % 180 if i % 50 else None, t) for i, t in enumerate(texts)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute([(d, t.encode()) for d, t in docs])
    for hot in (1, 16, 100, 4096):
        assert sorted(((r["doc_id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["removed"]], bytes(r["kept"])) for r in repeats.remove_repeats(df, hot=hot).collect()), key=repr) == want


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []


def test_phrases_and_order_of_strings():
    """Every string has one trigger, at the same place in all its copies; equal places in the order are equal strings."""
    rng = np.random.default_rng(1)
    texts = [rng.integers(97, 99, n).astype(np.uint8).tobytes() for n in (400, 0, 49, 50, 300)] + [b"=" * 200, b"-=" * 100, b"=" * 90]
    texts += [texts[0][100:220], texts[4]]
    joined = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    rows = repeats.parse(joined, first, 50, 20)
    starts, trigger = {}, {}
    for r in rows:
        text = texts[r["row"]]
        for c in range(r["count"]):
            for j in range(r["n"]):
                i = int(r["at"]) + c * int(r["n"]) + j
                starts.setdefault(int(r["row"]), []).append(i)
                assert trigger.setdefault(text[i : i + 50], int(r["off"]) - j) == int(r["off"]) - j
    assert starts == {i: list(range(len(t) - 49)) for i, t in enumerate(texts) if len(t) >= 50}
    assert sum(rows["row"] == 5) < 40 and sum(rows["row"] == 6) < 60  # a ruler is a few rows

    whole = np.concatenate([np.frombuffer(texts[r["row"]][r["at"] : r["at"] + r["n"] + 49], dtype=np.uint8) for r in rows])
    n, off = rows["n"].astype(np.int64), rows["off"].astype(np.int64)
    begin = np.cumsum(n + 49) - n - 49
    group = np.unique(rows["hash"], return_inverse=True)[1]
    by_place = {}
    for own, start, place in repeats.string_order(whole, begin, n, off, group, 50, 20):
        for e, j, p in zip(own, start, place, strict=True):
            by_place.setdefault((int(off[e] - j), int(p)), set()).add(whole[begin[e] + j : begin[e] + j + 50].tobytes())
    assert all(len(x) == 1 for x in by_place.values()) and len(by_place) == len(trigger)


def test_ruler_lines(spark):
    rng = random.Random(8)
    docs = [(i, noise(rng, 30) + rng.choice(["=", "-=", "#. "]) * rng.randrange(20, 700) + noise(rng, 40)) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = brute([(d, t.encode()) for d, t in docs])
    for hot in (2, 4096):
        assert sorted(((r["doc_id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["removed"]], bytes(r["kept"])) for r in repeats.remove_repeats(df, hot=hot).collect()), key=repr) == want


def test_query(spark):
    data = "/root/testdata/sf0.001"
    want = {d: (n, sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest()) for d, n, runs, kept in brute([(r["doc_id"], r["text"].encode()) for r in spark.read.parquet(f"{data}/documents.parquet").collect()])}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op7_prefix_free_dedup(spark, data).collect()}
    assert got == want


def test_entries_take_less_room_than_their_text():
    """What a task deals out of texts without repeats, over many buckets; documents come back in any order, with their places."""
    rng = random.Random(8)
    texts = [bytes(rng.choices(range(97, 123), k=rng.randint(0, 4000))) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000, 1200), pa.int64()), pa.array([0] * 200, pa.int64()), pa.array(texts, pa.binary())], names=["doc", "print", "raw"])
    dealt = pa.Table.from_batches(repeats._parse_rows([batch], 50, 20, 16))
    assert sum(len(x) for x in dealt["blob"].to_pylist()) < sum(map(len, texts))
    got = set()
    for blob in dealt["blob"].to_pylist():
        names, rows = repeats._join_blobs([blob], repeats._ENTRY)
        got |= {(int(names[r["row"], 0]), at) for r in rows for at in range(int(r["at"]), int(r["at"]) + int(r["n"]) * int(r["count"]))}
    assert got == {(1000 + i, at) for i, t in enumerate(texts) for at in range(len(t) - 49)}
