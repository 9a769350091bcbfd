"""Near duplicates, components and line dedup against brute force."""

import random
import re

from pyspark.sql import functions as F

from sedimenta.llm import components, linededup, neardup


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def groups(nodes, links):
    boss = {x: x for x in nodes}

    def root(x):
        while boss[x] != x:
            x = boss[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        boss[b] = a
    return {x: root(x) for x in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(60)] + [(7, 7), (None, 3)]
    want = groups({x for e in edges for x in e if x is not None}, [e for e in edges if None not in e])
    got = {r["node"]: r["component"] for r in rows(components.connected_components(spark.createDataFrame(edges, "u long, v long")))}
    assert all(got.get(x, x) == c for x, c in want.items())
    assert rows(components.connected_components(spark.createDataFrame([], "u long, v long"))) == []


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(docs, percent=85):
    sets = [(d, shingles(t)) for d, t in docs]
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x and y and 100 * len(x & y) >= percent * len(x | y)]
    return groups({d for d, _ in docs}, links), sets


def corpus(seed, n, words=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocab) for _ in range(words)]
    out = [(0, " ".join(base)), (1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "A  B"), (6, "a b c"), (7, "É b c d e"), (8, "é b c d e")]
    for i in range(9, n):
        kind = rng.random()
        if kind < 0.6:
            copy = list(base)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            out.append((i, (" " if rng.random() < 0.8 else "\n").join(copy)))
        elif kind < 0.8:
            out.append((i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 200)))))
        else:
            out.append((i, out[rng.randrange(9, i)][1] if i > 10 else "again"))
    return out


def test_near_duplicates_equal_brute_force(spark):
    docs = corpus(5, 260)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, component string").repartition(5)
    want, sets = brute(docs)
    got = rows(neardup.near_duplicates(df))
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {d: len(s) for d, s in sets}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    kept = neardup.drop_near_duplicates(df)
    assert kept.columns == df.columns and kept.count() == len(set(want.values()))


def test_chain_of_near_copies_in_one_bucket(spark):
    rng = random.Random(9)
    text, docs = [f"x{i}" for i in range(400)], []
    for i in range(60):
        docs.append((i, " ".join(text)))
        for _ in range(4):
            text[rng.randrange(400)] = f"y{i}-{rng.random()}"
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in rows(neardup.near_duplicates(df))} == brute(docs)[0]


def test_near_duplicate_edges(spark):
    kind = "doc_id long, text string"
    assert rows(neardup.near_duplicates(spark.createDataFrame([], kind))) == []
    odd = spark.createDataFrame([(None, "one two three four five six"), (1, "one two three four five six"), (1, "seven eight"), (2, "seven eight"), (2, "seven eight"), (3, None)], kind)
    got = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in rows(neardup.near_duplicates(odd)))
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (2, 1, False), (3, 3, True)]
    long = "word " * 300000
    twin = spark.createDataFrame([(1, long + "a b c"), (2, long + "a b d")], kind)
    assert [r["n_shingles"] for r in rows(neardup.near_duplicates(twin))] == [4, 4]


def test_query_equals_brute_force_on_documents(spark):
    from sedimenta.llm import queries

    data = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    want, sets = brute(docs)
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"], r["kept"]) for r in rows(queries.op5_circulant_minhash(spark, data))}
    assert got == {d: (want[d], len(s), want[d] == d) for d, s in sets}


def test_long_pages_and_shards(spark):
    """A text of some megabytes is taken whole by the operators that move rows."""
    from sedimenta.llm import sharding

    long = "\n".join(f"line {i} é" for i in range(200_000))
    pages = spark.createDataFrame([(i, "h", ("menu\n" if i else "") + (long if i == 1 else f"own {i}")) for i in range(20)], "page_id long, host string, text string")
    got = {r["page_id"]: r for r in rows(linededup.drop_lines(pages, "host", "text"))}
    assert got[1]["text"] == long and got[1]["n_lines"] == 200_001 and got[1]["n_dropped"] == 1
    out = {r["page_id"]: r for r in rows(sharding.assign_shards(pages, 3))}
    assert out[1]["size"] == len(("menu\n" + long).encode()) + 8 and sum(r["shard"] == out[1]["shard"] for r in out.values()) == 1


def test_signature_estimates_jaccard():
    import numpy as np

    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    same = (neardup.signature(a, 512) == neardup.signature(b, 512)).mean()
    assert abs(same - 0.8) < 0.06


def test_drop_lines(spark):
    body = [(f"p{i}", "hot.example", f"unique {i}\nmenu\n\n  menu \nrare {i % 40}") for i in range(100)]
    body += [("a", "b.example", "menu\nx"), ("b", None, "menu"), ("c", "hot.example", None), ("d", "hot.example", ""), ("e", "", "menu")]
    df = spark.createDataFrame([(*r, 1) for r in body], "page_id string, host string, text string, drop int").repartition(4)
    got = {r["page_id"]: r for r in rows(linededup.drop_lines(df, "host", "text", max_ratio=0.1, min_pages=3))}
    assert got["p7"] | {"drop": 1} == {"page_id": "p7", "host": "hot.example", "text": "unique 7\n\nrare 7", "drop": 1, "n_lines": 4, "n_dropped": 2}
    assert got["a"]["text"] == "menu\nx" and got["b"]["text"] == "menu" and got["e"]["n_dropped"] == 0
    assert (got["c"]["text"], got["c"]["n_lines"], got["d"]["text"]) == (None, 0, "")
    wide = linededup.drop_lines(df, "host", "text", max_ratio=0.1, min_pages=3, broadcast_mb=-1)
    assert {r["page_id"]: r for r in rows(wide)} == got
    assert rows(linededup.drop_lines(df.limit(0), "host", "text")) == []


def test_hosts_and_html(spark):
    df = spark.createDataFrame([("https://me@WWW.Example.com:80/x?y#z", "<p>One</p>\n <p>Two <b>bold</b></p>"), ("nope", None)], "url string, html string")
    out = df.select(linededup.url_host(F.col("url")).alias("h"), linededup.html_lines(F.col("html")).alias("t")).collect()
    assert [r["h"] for r in out] == ["www.example.com", ""]
    assert out[0]["t"].split("\n") == ["", "One", "", "Two", "bold", "", ""] and out[1]["t"] is None


def test_hosts_of_few_pages_lose_their_boilerplate(spark):
    pages = [(1, "two", "menu\na"), (2, "two", "menu\nb"), (3, "one", "menu\nc"), (4, "three", "menu\nd\nd"), (5, "three", "e"), (6, "three", "menu\nf")]
    df = spark.createDataFrame(pages, "page_id long, host string, text string")
    got = {r["page_id"]: (r["text"], r["n_dropped"]) for r in linededup.drop_lines(df, "host", "text", max_ratio=0.1).collect()}
    assert got == {1: ("a", 1), 2: ("b", 1), 3: ("menu\nc", 0), 4: ("d\nd", 1), 5: ("e", 0), 6: ("f", 1)}
