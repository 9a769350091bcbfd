"""Readers and writers on temporary files."""

import gzip
import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sedimenta.operators import embed, search, sft, tokenize
from sedimenta.sources import corpus, folder, idx, scratch, tables


def test_corpus(spark, tmp_path):
    files = {"a.md": b"one", "b.TXT": "zwei é".encode(), "c.html": b"no", "plain": b"no", ".hidden.md": b"no", "sub/d.md": b"deep", ".git/e.md": b"no", "nul.txt": b"a\0b", "late.txt": b"x" * 5000 + b"\0", "bad.txt": b"\xff\xfe", "empty.md": b"", "_name.md": b"kept", "sub/.deep/f.md": b"no", "v1.2/g.md": b"dots", "huge.md": b"y" * 9000}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    (tmp_path / "gone.md").symlink_to(tmp_path / "nowhere")
    got = {r["path"]: (r["status"], r["contents"]) for r in corpus.read_corpus(spark, f"file://{tmp_path}/", [" .MD", "txt"], recursive=True, file_bytes=8000).collect()}
    assert got.pop("late.txt")[0] == "ok"
    kept = {"empty.md": ("ok", ""), "_name.md": ("ok", "kept"), "v1.2/g.md": ("ok", "dots"), "huge.md": ("unreadable", None)}
    assert got == kept | {"a.md": ("ok", "one"), "b.TXT": ("ok", "zwei é"), "sub/d.md": ("ok", "deep"), "nul.txt": ("binary", None), "bad.txt": ("decoding", None)}
    some = corpus.read_corpus(spark, str(tmp_path), recursive=False, limit=2).collect()
    assert sorted(r["path"] for r in some if r["status"] == "ok") == ["_name.md", "a.md"] and sum(r["status"] != "ok" for r in some) == 2
    assert corpus.read_corpus(spark, str(tmp_path), extensions=[], limit=0).where("status = 'ok'").count() == 0


def test_files_that_cannot_be_read_and_packing(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"a")
    reader = folder.FolderReader({"path": str(tmp_path)})
    found = [r for b in reader.read(folder.Files([("a.md", 1), ("missing.md", 4)])) for r in b.to_pylist()]
    assert found[0]["content"] == b"a" and found[1]["content"] is None and "missing.md" in found[1]["error"]
    assert folder.packed([("a", 10), ("b", 10), ("c", 95), ("d", 1), ("e", 300), ("f", 1)], 100, 0) == [[("a", 10), ("b", 10)], [("c", 95), ("d", 1)], [("e", 300)], [("f", 1)]]
    assert folder.packed([], 100) == [] and corpus.read_corpus(spark, str(tmp_path), ["none"]).count() == 0


def test_index(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0])], "path string, embedding array<float>")
    for fmt in ("parquet", "json"):
        tables.write_index(df, f"{tmp_path}/{fmt}", fmt)
        with pytest.warns(UserWarning, match="other dimensions than 2, the first being b with 1"):
            tables.load_index(spark, f"{tmp_path}/{fmt}", fmt)
        assert sorted(r["path"] for r in tables.load_index(spark, f"{tmp_path}/{fmt}", fmt).collect()) == ["a", "b"]
    tables.write_index(df.limit(0), f"{tmp_path}/none")
    with pytest.raises(ValueError, match="empty"):
        tables.load_index(spark, f"{tmp_path}/none")


def test_splits(spark, tmp_path):
    (tmp_path / "train.jsonl").write_text('{"text": "a\\nb"}\n{"text": "c"}\n')
    (tmp_path / "valid.txt").write_text("x\ny\n")
    (tmp_path / "test.jsonl").write_text("")
    assert tables.read_sft(spark, str(tmp_path), "train").count() == 2
    assert tables.read_sft(spark, str(tmp_path), "valid", "txt").count() == 2
    with pytest.raises(ValueError, match="no examples"):
        tables.read_sft(spark, str(tmp_path), "test")
    tables.write_sft(tables.read_sft(spark, str(tmp_path), "train"), f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").where("split = 'train'").count() == 2


def test_table_questions(spark, tmp_path):
    meta = {"id": "t-1", "header": ["Name", "Age"], "types": ["text", "real"]}
    asks = [
        {"table_id": "t-1", "question": "q1", "sql": {"sel": 0, "agg": 0, "conds": []}},
        {"table_id": "t-1", "question": "q2", "sql": {"sel": 1, "agg": 3, "conds": [[0, 0, "O'Neil"], [1, 1, 3.5]]}},
        {"table_id": "t-1", "question": "q3", "sql": {"sel": 1, "agg": 5, "conds": [[1, 3, 7]]}},
    ]
    (tmp_path / "dev.tables.jsonl").write_text(json.dumps(meta) + "\n")
    (tmp_path / "dev.jsonl").write_text("".join(json.dumps(a) + "\n" for a in asks))
    asked, meta_df = tables.read_wikisql(spark, str(tmp_path), "dev")
    got = {r["question"]: r["text"] for r in sft.wikisql_text(sft.join_wikisql(asked, meta_df)).collect()}
    assert got["q1"] == "table: t-1\ncolumns: Name, Age\nQ: q1\nA: SELECT Name FROM t-1"
    assert got["q2"].endswith("SELECT COUNT Age FROM t-1 WHERE Name = 'O'Neil' AND Age > 3.5")
    assert got["q3"].endswith("SELECT AVG Age FROM t-1 WHERE Age OP 7")
    with pytest.raises(ValueError, match="no table"):
        sft.join_wikisql(asked, meta_df.limit(0))


def test_images(spark, tmp_path):
    pixels = np.arange(3 * 784, dtype=np.uint32).astype(np.uint8)
    (tmp_path / "i.gz").write_bytes(gzip.compress(b"\0" * 16 + pixels.tobytes()))
    (tmp_path / "l.gz").write_bytes(gzip.compress(b"\0" * 8 + bytes([7, 0, 9])))
    rows = idx.read_idx(spark, f"{tmp_path}/i.gz", f"{tmp_path}/l.gz", "test").orderBy("idx").collect()
    assert [r["label"] for r in rows] == [7, 0, 9] and rows[0]["use"] == "test"
    assert np.allclose(rows[1]["pixels"], pixels[784:1568] / 255)


def test_byte_pairs(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({t: i for i, t in enumerate([tokenize.BOS, tokenize.EOS, "a", "a</w>", "aa", "aa</w>", "b", "b</w>", "ab</w>"])}))
    (tmp_path / "m.txt").write_text("#version\na a\n\na a</w>\na b</w>\n")
    vocabulary, ranks = tables.read_bpe(spark, f"{tmp_path}/v.json", f"{tmp_path}/m.txt")
    assert ranks == {("a", "a"): 0, ("a", "a</w>"): 1, ("a", "b</w>"): 2}
    assert tokenize.merge_word("aaaa", ranks) == ["aa", "a", "a</w>"] or tokenize.merge_word("aaaa", ranks) == ["aa", "aa</w>"]
    assert tokenize.merge_word("aab", ranks) == ["aa", "b</w>"]
    df = spark.createDataFrame([(1, "AAB  ab z"), (2, ""), (3, None)], "k long, t string")
    got = {r["k"]: r["ids"] for r in tokenize.tokenize(df, vocabulary, ranks, "k", "t").collect()}
    assert got[1] == [0, 4, 7, 8, 1] and got[2] == [0, 1] == got[3]


def test_image_files_in_bounded_memory(spark, tmp_path):
    import tracemalloc

    df = spark.range(10_000, numPartitions=3).select(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: ((F.col("id") + i) % 256) / 255.0).alias("pixels"), (F.col("id") % 10).alias("label"), "id")
    idx.write_idx(df, f"{tmp_path}/set", 9)
    assert len(list((tmp_path / "set").glob("images-*.gz"))) == 3 and not list((tmp_path / "set").glob(".*"))
    back = idx.read_idx_folder(spark, f"{tmp_path}/set", 9)
    seen = sorted((r["label"], [round(p * 255) for p in r["pixels"]]) for r in back.collect())
    assert seen == sorted((i % 10, [(i + k) % 256 for k in range(9)]) for i in range(10_000))
    assert back.groupBy("file").agg(F.max("idx"), F.count("*")).where("max(idx) + 1 <> `count(1)`").count() == 0
    for name, head, size, n in (("images", 16, 9, 2_000_000), ("labels", 8, 1, 2_000_000)):
        with gzip.open(tmp_path / f"{name}-big.gz", "wb", compresslevel=1) as f:
            f.write(b"\0" * head)
            for _ in range(n // 100_000):
                f.write(bytes(100_000 * size))
    tracemalloc.start()
    reader = idx.PairReader({"images": str(tmp_path / "images-big.gz"), "labels": str(tmp_path / "labels-big.gz"), "size": "9"})
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 2_000_000
    assert tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()
    with gzip.open(tmp_path / "labels-big.gz", "ab") as f:
        f.write(b"\1")
    with pytest.raises(ValueError, match="same number"):
        list(reader.read(reader.partitions()[0]))


def test_scratch_tables_go_with_their_block(spark):
    before = scratch.scratch(spark, "before")
    spark.range(3).write.parquet(before)
    with scratch.scratch_tables(spark):
        inside = scratch.scratch(spark, "inside")
        spark.range(3).write.parquet(inside)
        scratch.scratch(spark, "never-written")
        assert spark.read.parquet(inside).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(inside)
    assert spark.read.parquet(before).count() == 3


def test_the_first_files_are_chosen_by_their_paths_alone(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"{i}.txt").write_bytes(b"\xff" if i == 1 else b"text %d" % i)
    docs = corpus.read_corpus(spark, str(tmp_path), limit=3)
    assert sorted((r["path"], r["contents"]) for r in docs.collect()) == [("0.txt", "text 0"), ("1.txt", None), ("2.txt", "text 2"), ("3.txt", "text 3")]
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    ordered = plan[plan.index("Sort [path") :].splitlines()[1]  # what goes to one task
    assert "Project [path" in ordered and "contents" not in ordered and "content#" not in ordered.split("]")[0]


def test_pieces_hold_each_byte_once_and_cut_no_word():
    rng = np.random.default_rng(3)
    made = [bytes(rng.choice(list(b"ab\xc3\xa9 \n"), n).tolist()) for n in (0, 1, 2, 7, 40, 300) for _ in range(40)]
    made += [b"x" * 200, b" " * 200, b"x" * 50 + b" " + b"y" * 200, b"\n" + b"z" * 90, ("wörd " * 50).encode()]
    for data in made:
        for limit in (1, 3, 16, 1000):
            for each in (1, 5, 64):
                read = [p for _, _, _, a, b in folder.ranges("f", len(data), limit) for p in folder.pieces(pa.BufferReader(data), a, b, each, 1000)]
                assert b"".join(c for _, c, _ in read) == data and all(whole == (c == data) for _, c, whole in read)
                assert [at for at, _, _ in read] == np.cumsum([0, *(len(c) for _, c, _ in read)])[:-1].tolist()
                assert all(c[:1] in (b" ", b"\n") for at, c, _ in read if at)
    with pytest.raises(ValueError, match="word larger than 10 bytes"):
        list(folder.pieces(pa.BufferReader(b"a " + b"x" * 4000), 0, None, 5, 10))


def test_large_files_are_read_in_bounded_memory(tmp_path):
    import tracemalloc

    with open(tmp_path / "large.txt", "wb") as f:
        for _ in range(64):
            f.write(b"some words " * 95_000)  # 1 MB
    reader = folder.FolderReader({"path": str(tmp_path), "partitionbytes": str(40 << 20), "piecebytes": str(1 << 20)})
    parts = reader.partitions()
    assert len(parts) == 2
    tracemalloc.start()
    read = sum(sum(len(c) for c in b["content"].to_pylist()) for p in parts for b in reader.read(p))
    assert read == 64 * 11 * 95_000 and tracemalloc.get_traced_memory()[1] < 32 << 20
    tracemalloc.stop()


def test_corpus_in_pieces_equals_whole_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "PIECES", 20_000)  # files are read by several tasks
    text = "Ein Wörterbuch\n\twith many ΟΔΥΣΣΕΥΣ words " * 2500
    files = {"a.txt": text.encode(), "b.txt": b"", "c.txt": b"one", "d.txt": text.encode() + b"\xff", "e.txt": b"x\0" + text.encode(), "f.txt": text.encode() + b"\0 late", "g.txt": b"y" * 100_000, "h.txt": b"\xff"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "gone.txt").mkdir()
    (tmp_path / "gone.txt" / "deep.txt").write_bytes(b"deep")
    for limit in (None, 0, 3, 100):
        whole = corpus.read_corpus(spark, str(tmp_path), recursive=True, limit=limit)
        pieces = corpus.read_corpus(spark, str(tmp_path), recursive=True, limit=limit, piece_bytes=1).collect()
        got = {}
        for r in sorted(pieces, key=lambda r: (r["path"], r["start"])):
            status, error, contents = got.get(r["path"], (r["status"], r["error"], None))
            assert (status, error) == (r["status"], r["error"]) and (r["status"] == "ok" or r["path"] not in got)
            got[r["path"]] = (status, error, r["contents"] if contents is None else contents + r["contents"])
        assert got == {r["path"]: (r["status"], r["error"], r["contents"]) for r in whole.collect()}
        assert limit is None or sum(s == "ok" for s, _, _ in got.values()) == min(limit, 6)
    rows = [r for r in pieces if r["path"] == "a.txt"]
    assert len(rows) > 20 and max(len(r["contents"].encode()) for r in rows) < 5000
    short = corpus.read_corpus(spark, str(tmp_path), file_bytes=50_000, piece_bytes=4096)  # the limit of a word
    assert {r["path"]: r["status"] for r in short.where("status = 'unreadable' OR path = 'a.txt'").collect()} == {"a.txt": "ok", "g.txt": "unreadable"}


def test_folders_are_searched_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "PIECE", 4096)
    monkeypatch.setattr(corpus, "PIECES", 20_000)
    for i in range(5):
        (tmp_path / f"{i}.txt").write_text(" ".join(f"Wörd{j % (7 + 5 * i)}" for j in range(20_000 if i else 0)) if i != 3 else "wörd1\n")
    asked = spark.createDataFrame([(1, "wörd1 wörd2 other"), (2, "  "), (3, "WÖRD9")], "query_id int, text string")
    hits = search.search_folder(spark, str(tmp_path), asked, documents=4, k=3)
    docs = corpus.read_corpus(spark, str(tmp_path), limit=4).where("status = 'ok'")
    queries = embed.embed_documents(asked.withColumnRenamed("text", "contents"), key="query_id")
    want = search.topk_search(embed.embed_documents(docs), queries, 3)
    assert sorted(hits.collect()) == sorted(want.collect()) and {r["path"] for r in hits.collect()} == {"1.txt", "2.txt", "3.txt"}
    texts = corpus.read_corpus(spark, str(tmp_path), limit=4, piece_bytes=search.PIECE).where("status = 'ok'")
    plan = texts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RelationV2") == 2  # one scan for the paths, one for the texts
    assert texts.count() > 60 and embed.embed_pieces(texts).count() == 3
