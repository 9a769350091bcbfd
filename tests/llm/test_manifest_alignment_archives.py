"""Merkle manifest, tokenizer alignment and WARC archives against plain versions and round trips."""

import hashlib
import io
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sedimenta.llm import align, merkle, queries, warc

TINY = "/root/testdata/sf0.001"


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# ------------------------------------------------------------------ Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves, fanout):
    """Levels of digests, leaves first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i : i + fanout])) for i in range(0, len(now), fanout)])
    return levels


def plain_steps(levels, i, fanout):
    out = []
    for level in levels[:-1]:
        run, c = level[i // fanout * fanout :][:fanout], i % fanout
        out.append({"before": "".join(run[:c]), "after": "".join(run[c + 1 :])})
        i //= fanout
    return out


def plain_log(leaves, fanout):
    """(level, index) of every node in completion order, by recursion."""
    levels = plain_tree(leaves, fanout)
    out = []

    def visit(level, i):
        if level:
            for c in range(i * fanout, min((i + 1) * fanout, len(levels[level - 1]))):
                visit(level - 1, c)
        out.append((level, i))

    visit(len(levels) - 1, 0)
    return levels, out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9, 26, 27, 28, 80, 81, 82, 200])
def test_positions_and_segments(n):
    leaves = [sha(str(i)) for i in range(n)]
    levels, log = plain_log(leaves, 3)
    assert merkle.build_segment(leaves, 3, merkle.height(n, 3)) == [levels[lv][i] for lv, i in log]
    for p, (level, i) in enumerate(log):
        assert merkle.position(level, i, n, 3) == p


def manifest_rows():
    rng = random.Random(5)
    out = [(i, "hot", f"Text {i}") for i in range(70)] + [(i, f"s{i % 5}", "é" * (i % 3)) for i in range(100, 120)]
    out += [(900, "lone", "x"), (None, "s1", None), (None, None, "n"), (901, None, ""), (7, "hot", "Text 7"), (7, "hot", "Text 7"), (7, "hot", "other"), (902, "", "y" * 300000)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("fanout", [2, 16])
def test_manifest_equals_plain_tree(spark, fanout):
    data = manifest_rows()
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    groups = defaultdict(list)
    for i, s, t in data:
        groups[s].append((i is not None, i or 0, sha(field(i) + field(s) + field(t))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([d for *_, d in sorted(groups[s])], fanout) for s in names}
    top = plain_tree([trees[s][-1][0] for s in names], fanout)
    want = Counter()
    for k, s in enumerate(names):
        for p, (_, _, d) in enumerate(sorted(groups[s])):
            steps = plain_steps(trees[s], p, fanout) + plain_steps(top, k, fanout)
            want[d, trees[s][-1][0], top[-1][0], repr(steps)] += 1
    df = spark.createDataFrame(data, "doc_id long, source string, text string").withColumns({"tree": F.lit("clash"), "idx": F.lit(3)}).repartition(5)
    df = df.withColumn("digest", merkle.leaf_digest(["doc_id", "source", "text"]))
    found = merkle.prove(merkle.build_manifest(df, "source", ["doc_id"], "digest", keep=["doc_id", "text"], fanout=fanout), ["doc_id", "text"])
    got = rows(found.withColumn("folded", merkle.fold("leaf", "steps")))
    assert Counter((r["leaf"], r["subroot"], r["root"], repr(r["steps"])) for r in got) == want
    assert all(r["folded"] == r["root"] for r in got)
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((i, t) for i, _, t in data)
    changed = rows(found.select(merkle.fold(F.sha2(F.lit(b"forged"), 256), "steps").alias("h"), "root"))
    assert all(r["h"] != r["root"] for r in changed)


def test_manifest_of_several_tiers_and_of_nothing(spark):
    df = spark.range(1000, numPartitions=7).select(F.col("id"), F.lit("one").alias("g"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("d"))
    made = merkle.build_manifest(df, "g", ["id"], "d", keep=["id"], fanout=4)
    assert len(made.tiers) == 2 and made.tiers[0].segments.count() == 16
    want = plain_tree([sha(str(i)) for i in range(1000)], 4)
    assert made.root == want[-1][0]
    assert all(r["steps"] == plain_steps(want, r["id"], 4) for r in rows(merkle.prove(made, ["id"])))
    none = merkle.build_manifest(df.where("id < 0"), "g", ["id"], "d", keep=["id"])
    assert none.root is None and rows(merkle.prove(none, ["id"])) == []


# ------------------------------------------------------------------ tokenizer alignment

ODD = [
    None, "", " ", "\n", "plain words, and a stop.", "a\nb\n\nc", "a  b \n c ", "héllo 日本 𐍈 ab", "日本語\n日本,x.", "x▁y", "<|endoftext|> <s> </s> <0x41>", "Ａx ﬁ é́ 👩‍👩‍👧",
    " x 　y", "a\u0085b", "tab\tx", "'s 're I'll", "1234567 89.", "\x00 \x01a", "x\r\ny", "…—“”", "U.S.A., e.g. ². _.", "word " * 3000, "nospace" * 3000, "plain words, and a stop.", "é" * 70 + ".",
]


def plain_alignment(aligner, text):
    """Both token lists by ids alone, cut where their decoded bytes end together."""
    if not text:
        return [], []
    raw = (" " + text).encode()
    a = aligner.first.encode(" " + text, add_special_tokens=False).ids
    b = aligner.second.encode(text)
    if any(b"".join(names[i] for i in ids) != raw for ids, names in ((a, aligner.first_bytes), (b, aligner.second_bytes))):
        return [], []
    cuts = []
    for ids, names in ((a, aligner.first_bytes), (b, aligner.second_bytes)):
        at, ends = 0, {}
        for k, i in enumerate(ids):
            at += len(names[i])
            ends[at] = k + 1
        cuts.append(ends)
    groups, links, i, j = [], [], 0, 0
    for e in sorted(cuts[0].keys() & cuts[1].keys()):
        p, q = cuts[0][e], cuts[1][e]
        groups.append((a[i:p], b[j:q]))
        links.append((a[p - 1], b[q - 1]))
        i, j = p, q
    return groups, links


@pytest.fixture(scope="module")
def aligner():
    return align.Aligner(queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model"))


def check_alignment(spark, aligner, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"k": F.lit(1), "links": F.lit("clash")}).repartition(4)
    got = {r["doc_id"]: r for r in rows(align.align_tokenizers(df, queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model")))}
    plain = [plain_alignment(aligner, t) for t in texts]
    counts = Counter(x for _, links in plain for x in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    assert len(got) == len(texts)
    for i, (groups, links) in enumerate(plain):
        digest = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        want = {
            "doc_id": i, "n_a": sum(len(a) for a, _ in groups), "n_b": sum(len(b) for _, b in groups), "n_groups": len(groups), "n_links": len(links),
            "n_best": sum(counts[x] == best[x[1]] for x in links), "count_sum": sum(counts[x] for x in links), "groups_sha256": sha(digest) if groups else "",
        }
        assert got[i] == want, texts[i]


def test_alignment_of_odd_texts(spark, aligner):
    rng = random.Random(3)
    letters = "ab é日𐍈\n'1.,  ▁<|>\tß²_"
    check_alignment(spark, aligner, ODD + ["".join(rng.choices(letters, k=rng.randint(1, 30))) for _ in range(1500)])


def test_alignment_of_documents(spark, aligner):
    check_alignment(spark, aligner, [r["text"] for r in queries.table(spark, TINY, "documents").orderBy("doc_id").collect()])


def test_alignment_encodes_words_together(aligner):
    """New words are encoded many at a time; one without tokens (its bytes change) leaves its neighbours as they are."""
    words = [f"{a}{b}{c}" for a in ("wo", "Tä", "漢") for b in ("ro", "пр", "x-") for c in range(300)]
    want = [aligner.whole(w) for w in words]

    class Counted:
        texts = 0

        def encode(self, text, **how):
            self.texts += 1
            return aligner.first.encode(text, **how)

        def encode_batch(self, texts, **how):
            self.texts += len(texts)
            return aligner.first.encode_batch(texts, **how)

    small = align.Aligner(queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model"))
    small.first = Counted()
    assert small.align(words) == want and small.first.texts < 20
    odd = [*words[:50], "a\u2581b", *words[50:]]
    assert small.align(odd) == [*want[:50], align.NONE, *want[50:]]


def test_alignment_asks_for_a_word_once_a_batch(aligner):
    """However often a word is in a batch, its alignment is looked up once; words of settled letters leave `tokenizers` alone."""

    class Counted(dict):
        asked = 0

        def get(self, *a):
            self.asked += 1
            return super().get(*a)

        def __getitem__(self, k):
            self.asked += 1
            return super().__getitem__(k)

    class Unasked:
        def encode(self, *a, **how):
            raise AssertionError("encoded by tokenizers")

        encode_batch = encode

    text = "one wörd, an\u2019other one.\nOne wörd. " * 500 + "end."
    want = aligner.whole(text)
    small = align.Aligner(queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model"))
    small.first, small.young = Unasked(), Counted()
    assert small([text, None, text]) == [want, align.NONE, want] and small.young.asked < 30


def test_alignment_with_the_quick_encoder_is_that_of_tokenizers(aligner):
    """Every entry of the vocabulary, and texts of all settled letters: ids, and ends of characters."""
    assert aligner.quick
    rng = random.Random(8)
    settled = [*map(chr, range(0x250)), *map(chr, range(0x2010, 0x2028))]
    texts = [b.decode() for b in aligner.first_bytes if b.decode("utf-8", "ignore").encode() == b]
    texts += ["".join(rng.choices(settled, k=rng.randint(1, 12))) for _ in range(20_000)] + ["".join(rng.choices("theonadeürig'.,s", k=rng.randint(5, 25))) for _ in range(20_000)]
    for t, e in zip(texts, aligner.first.encode_batch([f" {t}" for t in texts], add_special_tokens=False), strict=True):
        assert not align._SETTLED.fullmatch(t) or aligner.quick(f" {t}") == e.ids, t
    slow = align.Aligner(queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model"))
    slow.quick = None
    words = ["".join(rng.choices("aeñü–’x9.ð\x01ſ", k=rng.randint(1, 9))) for _ in range(3000)]
    words = [("\n" if rng.random() < 0.1 else "") + w for w in words if not w.isspace()]
    assert aligner.align(words) == slow.align(words)


def test_alignment_remembers_within_bounds(aligner, monkeypatch):
    texts = [f"word{i}, and again word{i}.\nNext" for i in range(300)]
    want = aligner(texts)
    small = align.Aligner(queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model"))
    monkeypatch.setattr(align, "REMEMBERED", 20)
    assert [r for i in range(0, 300, 7) for r in small(texts[i : i + 7])] == want and len(small.young) < 100
    assert align.Aligner.__call__(small, []) == []


def test_alignment_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert rows(align.align_tokenizers(df, queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model"))) == []


# ------------------------------------------------------------------ WARC archives


def pages():
    long, other = "<p>same é</p>" * 200, "z" * 1500
    out = [(i, f"http://h/{i}", long) for i in range(40)] + [(100 + i, None, other + str(i)) for i in range(30)]
    out += [(200, "http://h/a b\r\nX: y", "short"), (201, "u", "short"), (202, "u", None), (203, "u", ""), (None, "u", long), (None, "u", "alone" * 400), (5, "http://h/5", long), (39, "again", long)]
    return [*out, (300, "u", "big " * 400_000), (301, "u", "\r\n\r\nHTTP/1.1 200 OK\r\n\r\nWARC/1.1" * 50)]


def test_archives_round_trip(spark, tmp_path):
    data, folder = pages(), f"{tmp_path}/warc"
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumns({"key": F.lit("clash"), "payload": F.lit(1)}).repartition(3)
    warc.write_archives(df, folder, key="page_id", url="url", payload="html", archive_bytes=400_000)
    got = rows(warc.read_archives(spark, folder, payloads=True))
    groups = defaultdict(list)
    for i, _, html in data:
        groups[html or ""].append(-1 if i is None else i)
    want = Counter()
    for i, _, html in data:
        raw, last = (html or "").encode(), max(groups[html or ""])
        revisit = len(raw) >= 1000 and last >= 0 and i != last
        want[None if i is None else str(i), "revisit" if revisit else "response", str(last) if revisit else None, len(raw), hashlib.sha1(raw).hexdigest(), None if revisit else raw] += 1
    assert Counter((r["key"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], None if r["payload"] is None else bytes(r["payload"])) for r in got) == want
    files = list((tmp_path / "warc").glob("*.warc.zst"))
    assert len(files) > 3 and not list((tmp_path / "warc").glob(".*"))
    assert "http://h/a b%0D%0AX: y".replace(" ", "%20") in {r["url"] for r in got}


def test_archives_compress_records_one_by_one(spark, tmp_path):
    import zstandard

    df = queries.table(spark, TINY, "pages")
    warc.write_archives(df, f"{tmp_path}/w", key="page_id", url="url", payload="html")
    file = next((tmp_path / "w").glob("*.warc.zst"))
    raw = file.read_bytes()
    assert raw[:4] == b"\x5d\x2a\x4d\x18"
    size = int.from_bytes(raw[4:8], "little")
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw[8 : 8 + size]))
    assert dictionary.dict_id() != 0
    records = list(warc.frames(io.BytesIO(raw), chunk=1000))
    assert records == list(warc.frames(io.BytesIO(raw))) and records[0].startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    assert all(r.startswith(b"WARC/1.1\r\n") and r.endswith(b"\r\n\r\n") for r in records)
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    assert len(raw) < plain / 1.3  # the dictionary included
    # Any record can be read by itself.
    one = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True).compress(records[-1])
    assert raw.endswith(one) and zstandard.ZstdDecompressor(dict_data=dictionary).decompress(one) == records[-1]


def test_a_damaged_archive_is_an_error():
    record = warc.write_record("1", "u", b"payload" * 300, None, "1970-01-01T00:00:00Z")
    assert warc.read_record(record)[1] == b"payload" * 300
    with pytest.raises(ValueError):
        warc.read_record(record.replace(b"payload", b"Payload"))
    with pytest.raises(ValueError):
        warc.read_record(record[:-1])
    tool = warc.compressor(b"")
    raw = warc.dictionary_frame(b"") + tool.compress(record)
    assert list(warc.frames(io.BytesIO(raw))) == [record]
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(raw[:-3])))


def test_archives_of_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(df, f"{tmp_path}/none", key="page_id", url="url", payload="html")
    assert rows(warc.read_archives(spark, f"{tmp_path}/none")) == []


# ------------------------------------------------------------------ SQL


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op13_warc_archives"])
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{TINY}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, TINY), con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(want.fetchall())
