"""Held-out accuracy of the co-trained classifier, and the pipeline's stages on a small corpus."""

import math
import random
import re
import tracemalloc

import numpy as np
import pytest

import corpus_pipeline
from sedimenta.llm import quality

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n, seed):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("th", "er", "on", "ing", "st", "re") for b in ("a", "en", "or", "ly", "is", "ou", "an")]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randrange(30, 150))]
        kind = rng.choices(["good", "toxic", "junk"], [0.7, 0.15, 0.15])[0]
        if kind == "toxic":
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "moron", "scum"])
        text = " ".join(words)
        if kind == "junk":
            text = text.upper().replace(" ", "!! ")
        docs.append((i, text, "en", f"src{i % 3}", len(text)))
        labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(1500, 4)
    df = spark.createDataFrame([(*d, True) for d in docs], DOC + ", keep boolean").repartition(4)
    seen = spark.createDataFrame([x for x in labels if x[0] % 3 == 0], "doc_id long, quality int, toxic int")
    out = quality.classify(df, seen)
    assert out.columns == [*df.columns, "p_content", "p_page", "p_good", "_keep"]
    got = {r["doc_id"]: r["_keep"] for r in out.collect()}
    held = [(i, q == 1 and t == 0) for i, q, t in labels if i % 3]
    good, bad = [got[i] for i, g in held if g], [got[i] for i, g in held if not g]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.05


def test_memory_of_the_fit_stays_near_that_of_its_sample():
    """The driver fits and scores by blocks: what it takes beside the sample doesn't follow the number of telling words."""
    rng = np.random.default_rng(3)
    good = rng.random(6000) < 0.6
    words = np.sort(rng.integers(0, 1 << 32, 1500, dtype=np.uint32))
    sets = [np.sort(np.concatenate([rng.choice(words[:750], 500 if g else 100, replace=False), rng.choice(words[750:], 100 if g else 500, replace=False)])) for g in good]
    first, numbers = np.concatenate([[0], np.cumsum([len(s) for s in sets])]), rng.random((6000, len(quality.NUMBERS) + 1))
    views = quality.Views(np.concatenate(sets), first, numbers, np.zeros((6000, 2), dtype=np.int64))
    tracemalloc.start()
    try:
        view = quality.ContentView.fit(sets, numbers[:, :-1], good, turns=20)
        fitted = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        score = view.score(views)
        scored = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(view.words) > 1000 and ((score > 0) == good).mean() > 0.99
    assert fitted < 4 * views.words.nbytes and scored < 3 * views.words.nbytes


def test_pseudo_labels_are_searched_until_found(spark, monkeypatch):
    """Labels half bad, a corpus with few bad documents: the wanted pseudo-labels of every kind are found all the same."""
    docs, labels = corpus(2400, 7)
    docs = [(i, t, lang, "forum" if "!!" in t else s, n) for i, t, lang, s, n in docs]  # the page view sees metadata alone
    bad, good = ([i for i, q, t in labels if q == kind and t == 0] for kind in (0, 1))
    known, corpus_ids = {*bad[:100], *good[:100]}, {*bad[:160], *good}
    seen, fit = [], quality.ContentView.fit
    monkeypatch.setattr(quality.ContentView, "fit", lambda sets, numbers, kinds: seen.append((int(kinds.sum()), int((~kinds).sum()))) or fit(sets, numbers, kinds))
    df = spark.createDataFrame([d for d in docs if d[0] in corpus_ids], DOC).repartition(4)
    quality.train(df, spark.createDataFrame([x for x in labels if x[0] in known], "doc_id long, quality int, toxic int"), pseudo=30, sure=0.9)
    assert np.diff(seen, axis=0).tolist() == [[30, 30], [30, 30]]


def test_rows_without_an_id_are_scored_but_not_learned_from(spark):
    docs, labels = corpus(400, 9)
    seen = spark.createDataFrame([*(x for x in labels if x[0] % 2), (-1, 0, 1)], "doc_id long, quality int, toxic int")
    plain = spark.createDataFrame(docs, DOC).repartition(3)
    odd = spark.createDataFrame([(None, t, lang, s, n) for _, t, lang, s, n in docs[:50]], DOC)
    model, same = quality.train(plain, seen, pseudo=20, sure=0.9), quality.train(plain.unionByName(odd), seen, pseudo=20, sure=0.9)
    scored = lambda m: sorted((r["doc_id"], r["p_good"]) for r in quality.score_documents(plain, m).collect())
    assert scored(model) == scored(same)
    found = quality.score_documents(plain.unionByName(odd), same).collect()
    by_text = {r["text"]: r["p_good"] for r in found if r["doc_id"] is not None}
    assert sum(r["doc_id"] is None for r in found) == 50 and all(r["p_good"] == by_text[r["text"]] for r in found)


# ------------------------------------------------------------------ the same in plain Python, over all documents at once

CUTS = [0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.93, 0.96, 0.98, 0.99, 0.995]


def plain_numbers(text):
    raw = text.encode()
    words = re.findall(rb"[^ \t\n\x0b\x0c\r.,]+", raw.lower())
    share = lambda keep: sum(keep(chr(b)) for b in raw) / max(len(raw), 1)
    signs = lambda c: "!" <= c <= "~" and not c.isalnum() and c not in ".,"
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    n = max(len(words), 1)
    return words, [math.log1p(len(raw)), len(words) / (raw.count(b"\n") + 1), sum(map(len, words)) / n, share(lambda c: "A" <= c <= "Z"), share(lambda c: "0" <= c <= "9"), share(signs), again / n]


def plain_model(docs, labels, rounds, sure):
    """Probabilities of every document, with every sure document as a pseudo-label."""
    seen = [(*plain_numbers(t), lang, source, n) for _, t, lang, source, n in docs]
    kinds = {}
    for i, q, t in labels:
        kinds[i] = kinds.get(i, True) and q == 1 and t == 0
    own = [k for k, d in enumerate(docs) if d[0] in kinds]
    good = np.array([kinds[docs[k][0]] for k in own])
    held = quality.held_out(np.array([docs[k][0] for k in own]), good, 6)
    rest = [k for k in range(len(docs)) if docs[k][0] not in kinds]
    odds = math.log((good.sum() + 1) / ((~good).sum() + 1))

    def content(rows, target):
        edges = [np.unique(np.quantile([seen[k][1][j] for k in rows], CUTS)) for j in range(7)]
        features = [{*words, *((j, int(np.searchsorted(e, x, side="right"))) for j, (e, x) in enumerate(zip(edges, nums, strict=True)))} for words, nums, *_ in seen]
        n1, n0 = target.sum(), (~target).sum()
        keep = []
        for w in {w for k in rows for w in features[k]}:
            has = np.array([w in features[k] for k in rows])
            n, k1 = has.sum(), (has & target).sum()
            p1, p0, p = (k1 + 0.5) / (n1 + 1), (n - k1 + 0.5) / (n0 + 1), (n + 0.5) / (n1 + n0 + 1)
            if n >= 5 and abs(p1 - p0) / math.sqrt(p * (1 - p) * (1 / n1 + 1 / n0)) >= 4:
                keep.append(w)
        every = np.array([[w in f for w in keep] + [True] for f in features], dtype=float)
        x, w, mean, square = every[rows], np.zeros(len(keep) + 1), 0, 0
        w[-1] = math.log((n1 + 1) / (n0 + 1))
        for t in range(1, 301):
            step = x.T @ ((1 / (1 + np.exp(-x @ w)) - target) / len(target)) + 1e-4 * np.append(w[:-1], 0)
            mean, square = 0.9 * mean + 0.1 * step, 0.99 * square + 0.01 * step * step
            w = w - 0.1 * (1 - t / 301) * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-9)
        return every @ w

    def page(rows, target):
        out, n1, n0 = np.zeros(len(docs)), target.sum() + len(CUTS), (~target).sum() + len(CUTS)
        edges = np.unique(np.quantile([seen[k][4] for k in rows], CUTS))
        for values in ([int(np.searchsorted(edges, s[4], side="right")) for s in seen], [s[2] for s in seen], [s[3] for s in seen]):
            for v in set(values):
                has = np.array([values[k] == v for k in rows])
                if has.any() or isinstance(v, int):
                    out[[x == v for x in values]] += math.log(((has & target).sum() + 1) / n1) - math.log(((has & ~target).sum() + 1) / n0)
        return out

    fit, test = [k for k, h in zip(own, held, strict=True) if not h], [k for k, h in zip(own, held, strict=True) if h]
    content_rows, content_target, page_rows, page_target = list(fit), good[~held], list(fit), good[~held]
    for turn in range(rounds + 1):
        logits = []
        for score in (content(content_rows, content_target), page(page_rows, page_target)):
            a, b = quality.platt(score[test], good[held])
            logits.append(a * score + b)
        limit = math.log(sure / (1 - sure))
        if turn < rounds:
            chosen = []
            for s in logits:
                sides = [sorted((k for k in rest if sign * s[k] >= limit), key=lambda k: (quality._pick(np.array([docs[k][0]]), 7 + turn)[0], k)) for sign in (1, -1)]
                n = [len(x) for x in sides]
                chosen.append(sides[0][: min(n[0], round(n[1] * math.exp(odds)))] + sides[1][: min(n[1], round(n[0] / math.exp(odds)))])
            one, two = chosen
            content_rows, content_target = content_rows + two, np.concatenate([content_target, logits[1][two] > 0])
            page_rows, page_target = page_rows + one, np.concatenate([page_target, logits[0][one] > 0])
    return [1 / (1 + np.exp(-x)) for x in (*logits, logits[0] + logits[1] - odds)]


@pytest.mark.parametrize("rounds", [0, 2])
def test_equals_plain_python(spark, rounds):
    docs, labels = corpus(260, 11)
    docs = [(i, t, lang, "forum" if labels[i][1:] != (1, 0) and i % 20 else s, n) for i, t, lang, s, n in docs]  # the page view learns something
    known = labels[:160]
    got = quality.classify(spark.createDataFrame(docs, DOC).repartition(3), spark.createDataFrame(known, "doc_id long, quality int, toxic int"), rounds=rounds, sure=0.9)
    rows = {r["doc_id"]: r for r in got.collect()}
    for name, want in zip(("p_content", "p_page", "p_good"), plain_model(docs, known, rounds, 0.9), strict=True):
        assert np.allclose([rows[d[0]][name] for d in docs], want, atol=1e-6), name


def test_exchange_helps(spark):
    """Few labels, a metadata view that tells: two rounds are no worse than none on held-out labels, and learn words."""
    docs, labels = corpus(1500, 12)
    bad = {i for i, q, t in labels if q == 0 or t == 1}
    docs = [(i, t, lang, "forum" if i in bad else s, n) for i, t, lang, s, n in docs]
    df, seen = spark.createDataFrame(docs, DOC).repartition(4), spark.createDataFrame(labels[:50], "doc_id long, quality int, toxic int")
    right = {}
    for rounds in (0, 2):
        got = {r["doc_id"]: r["p_content"] >= 0.4 for r in quality.classify(df, seen, rounds=rounds, sure=0.9).collect()}
        right[rounds] = np.mean([got[i] == (q == 1 and t == 0) for i, q, t in labels[50:]])
    assert right[2] > right[0]


def test_every_source_weighs():
    """No source is left out, however many there are."""
    sources = np.repeat(np.arange(1, 3001), 4)
    good = sources % 2 == 0
    page = quality.PageView.fit(np.full((len(good), 1), 5.0), np.stack([sources, sources], axis=1), good)
    assert len(page.categories[0]) == 3000 and all((w > 0) == (x % 2 == 0) for x, w in page.categories[0].items())


@pytest.mark.parametrize("labels", [[], [(0, 1, 0), (1, 1, 0)], [(0, None, None), (99, 0, 0)], [(0, 1, 0), (1, 0, 0)]])
def test_labels_that_teach_nothing(spark, labels):
    df = spark.createDataFrame([(0, "a b", "en", "s", 3), (1, None, None, None, None), (None, "", "en", "s", 0)], DOC)
    kept = quality.keep_good(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.count() == 3 and kept.columns == df.columns


def test_odd_rows_are_scored(spark):
    docs, labels = corpus(200, 5)
    odd = [(500, None, None, None, None), (501, "", "en", "src0", 0), (None, "th on", "xx", "?", 5), (502, "word " * 200000, "en", "src1", 1000000), (0, "again", "en", "src0", 5)]
    out = quality.classify(spark.createDataFrame(docs + odd, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert out.count() == len(docs) + len(odd) and out.where("p_good IS NULL OR isnan(p_good)").count() == 0
    empty = quality.classify(spark.createDataFrame([], DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert empty.count() == 0


def test_pipeline(spark, tmp_path):
    docs, labels = corpus(400, 6)
    unlike = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(6)]
    leak = " ".join(f"bench{j}" for j in range(15))
    docs += [(1000, unlike[0], "en", "src0", 1), (1001, unlike[0], "en", "src1", 1), (1002, unlike[0] + " tail", "en", "src2", 1), (1003, unlike[1] + " " + leak, "en", "src0", 1), (1004, leak, "en", "src0", 1)]
    docs += [(2000 + i, f"{' '.join(f'u{i}y{j}' for j in range(30))}\nthe menu of this site", "en", "shop", 1) for i in range(20)]
    for name, rows, kind in (("documents", docs, DOC), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", [(1, leak)], "item_id long, text string")):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    at, texts = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = at.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        at = spark.read.parquet(f"{tmp_path}/{i}")
        if name != "packing":
            assert at.columns == columns
            texts.append({r["doc_id"]: r["text"] for r in at.collect()})
    kinds = {i: q == 1 and t == 0 for i, q, t in labels}
    assert sum(not kinds[i] for i in texts[0] if i in kinds) < 0.1 * sum(not k for k in kinds.values()) and sum(kinds[i] for i in texts[0] if i in kinds) > 0.97 * sum(kinds.values())
    assert texts[1].keys() == texts[0].keys() and not any("menu" in t for i, t in texts[1].items() if 2000 <= i < 3000)
    assert {1001, 1002} & texts[1].keys() and not {1001, 1002} & texts[2].keys() and 1000 in texts[2]
    assert "bench" not in texts[3][1003] and texts[3][1003].startswith("w1x0") and 1004 not in texts[3]
    packed = {r["doc_id"] for r in at.collect()}
    assert packed == texts[3].keys()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == at.count()


def test_pipeline_stages_take_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, names that the operators use, and no rows at all."""
    docs, labels = corpus(120, 13)
    long = " ".join(f"w{i}" for i in range(150_000))
    docs += [(500, None, None, None, None), (501, "", "en", "src0", 0), (None, "alone here", "xx", "?", 5), (502, long, "en", "src1", 1), docs[0], docs[0], (503, "same text as one more row", "en", "src0", 1), (503, "same text as one more row", "en", "src0", 1)]
    extra = ["keep", "gone_id", "n_lines", "drop", "site", "n_hit", "clean_text", "p_good", "lane", "page_lang", "component_id"]
    kind = DOC + "".join(f", {c} int" for c in extra)
    rows = [(*d, *range(len(extra))) for d in docs]
    for name, data, schema in (("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", [(1, " ".join(f"w{i}" for i in range(20))), (None, None)], "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for part in (rows, []):
        at = spark.createDataFrame(part, kind).repartition(3)
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, at, str(tmp_path))
            if name == "packing":
                assert (out.count() == 0) == (not part)
                break
            assert out.columns == at.columns
            out.write.parquet(f"{tmp_path}/{bool(part)}-{i}")
            at = spark.read.parquet(f"{tmp_path}/{bool(part)}-{i}")
            left = at.collect()
            assert all([r[c] for c in extra] == list(range(len(extra))) for r in left)
            if part:
                assert {r["text"] for r in left if r["doc_id"] in (500, 501)} <= {None, ""} and sum(r["doc_id"] == 503 for r in left) in (0, 2)
            else:
                assert not left
