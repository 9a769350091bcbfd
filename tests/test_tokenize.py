"""Byte-pair merges against the plain loop and an installed tokenizer."""

import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from sedimenta.operators import tokenize
from sedimenta.plans import registry

TINY = "/root/testdata/sf0.001"


def plain(word, ranks):
    pieces = [*word[:-1], word[-1] + "</w>"]
    while len(pieces) > 1:
        best = min(zip(pieces, pieces[1:], strict=False), key=lambda p: ranks.get(p, 1 << 62))
        if best not in ranks:
            break
        out, i = [], 0
        while i < len(pieces):
            taken = 2 if tuple(pieces[i : i + 2]) == best else 1
            out.append("".join(pieces[i : i + taken]))
            i += taken
        pieces = out
    return pieces


def test_merges_equal_the_plain_loop_whatever_the_ranks():
    rng = random.Random(1)
    for _ in range(2000):
        word, tokens, pairs = "".join(rng.choices("abc", k=rng.randint(1, 20))), ["a", "b", "c", "a</w>", "b</w>", "c</w>"], []
        for _ in range(12):
            pair = (rng.choice([t for t in tokens if not t.endswith("</w>")]), rng.choice(tokens))
            if pair not in pairs:
                pairs.append(pair)
                tokens.append("".join(pair))
        rng.shuffle(pairs)  # a pair may rank before those that it is made of
        ranks = {p: i for i, p in enumerate(pairs)}
        assert tokenize.merge_word(word, ranks) == plain(word, ranks)


def test_a_word_of_a_million_letters(spark):
    ids, ranks = registry.word_bpe(spark)
    word = "".join(random.Random(2).choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    start = time.process_time()
    pieces = tokenize.merge_word(word, ranks)
    assert time.process_time() - start < 60 and "".join(pieces) == word + "</w>" and len(pieces) < 600_000
    short = word[:3000]
    assert tokenize.merge_word(short, ranks) == plain(short, ranks)


def test_a_public_vocabulary_over_documents(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    ids, ranks = registry.word_bpe(spark)
    known = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    got = {r["doc_id"]: r["ids"] for r in tokenize.tokenize(docs, ids, ranks, "doc_id", "text").collect()}
    seen = 0
    for r in docs.collect():
        if r["text"].isascii():
            assert got[r["doc_id"]] == [49406, *known.encode(r["text"], add_special_tokens=False).ids, 49407]
            seen += 1
        else:
            words = re.findall(r"[^\W\d_]+|\d|[^\w\s]+|_+", re.sub(r"\s+", " ", r["text"].lower()))
            assert {p for w in words for p in plain(w, ranks)} or not words
    assert seen > 20 and len(got) == docs.count()
    assert registry.QUERIES["f15_tokenize_49k"](spark, TINY).count() == len(got)


def test_nulls_empties_and_a_forgetful_task(spark, monkeypatch):
    monkeypatch.setattr(tokenize, "REMEMBERED", 1)
    vocabulary = {t: i for i, t in enumerate([tokenize.BOS, tokenize.EOS, "a", "a</w>", "b", "ab</w>"])}
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, "ab AB a éb"), (5, "zz"), (4, "ab")], "k long, t string").withColumn("ids", F.lit("clash")).coalesce(1)
    got = sorted((r["k"], r["ids"]) for r in tokenize.tokenize(df, vocabulary, {("a", "b</w>"): 0}, "k", "t").collect())
    assert got == [(1, [0, 1]), (2, [0, 1]), (3, [0, 1]), (4, [0, 5, 1]), (4, [0, 5, 5, 3, 1]), (5, [0, 1])]
    assert [r["ids"] for r in tokenize.tokenize(df.where("k = 5"), vocabulary, {}, "k", "t", ends=False).collect()] == [[]]
    assert tokenize.tokenize(df.limit(0), vocabulary, {}, "k", "t").count() == 0


def test_a_batch_is_encoded_in_runs(spark, monkeypatch):
    assert list(tokenize.runs_of(np.array([3, 0, 9, 1, 1, 0, 30, 0]), 10)) == [(0, 2), (2, 4), (4, 6), (6, 7), (7, 8)] and list(tokenize.runs_of(np.array([]), 5)) == []
    ids, ranks = registry.VOCABULARY, registry.RANKS
    texts = [(i, " ".join(random.Random(i).choices(["the", "on", "winter", "ring", "a", "é"], k=i % 40)) if i % 7 else None) for i in range(300)]
    df = spark.createDataFrame(texts, "k long, t string").coalesce(1)
    want = {r["k"]: r["ids"] for r in tokenize.tokenize(df, ids, ranks, "k", "t").collect()}
    monkeypatch.setattr(tokenize, "AT_ONCE", 25)
    monkeypatch.setattr(tokenize, "LONGEST", 3)
    assert {r["k"]: r["ids"] for r in tokenize.tokenize(df, ids, ranks, "k", "t").collect()} == want and len(want) == 300
