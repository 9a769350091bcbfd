"""Quality classifier by co-training two views.

The content view sees the text alone: which words a document holds (lowered, without full stops and commas), and in which bin its
size, line and word lengths and the shares of upper-case letters, digits, other signs and immediate repetitions fall. The page
view sees the metadata alone: language, source and the recorded number of characters. The content view is a logistic regression on the
words and bins whose frequency in good and bad documents differs by many standard errors, the page view a naive Bayes classifier.

Rounds: each view scores all documents, and documents that it is sure of become pseudo-labels for the other view, which
is fitted anew; good and bad ones are taken in the labels' proportion. In the end both views are calibrated on labels that no fit has seen, and their log-odds are
added. Fits run on bounded samples (``max_fit`` labels, ``pseudo`` pseudo-labels of each kind and round, both drawn by
hash); scores, and the search for pseudo-labels, cover all documents. Nothing is shuffled but the pseudo-labels.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.llm.support import NOT_SPACE, free_name, member_table, mix64, text_chunks, words_of

WORD = NOT_SPACE & ~member_table(b".,")
_UPPER, _DIGIT, _LINE = member_table(bytes(range(0x41, 0x5B))), member_table(b"0123456789"), member_table(b"\n")
_SIGN = member_table(bytes(x for x in range(0x21, 0x7F) if not chr(x).isalnum() and chr(x) not in ".,"))
NUMBERS = ("size", "line_words", "word_bytes", "upper", "digits", "signs", "repeats")
CATEGORIES = ("lang", "source")
#: The page view's number; -1 stands for null.
LENGTH = "n_chars"
#: Quantiles between a number's bins: finer at both ends, where odd documents are.
_CUTS = np.array([0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.93, 0.96, 0.98, 0.99, 0.995])


@dataclass
class Views:
    """A chunk of documents as both views see them."""

    words: np.ndarray  # 32-bit hashes of all words
    first: np.ndarray  # per document the number of its first word, and one more
    numbers: np.ndarray  # documents by NUMBERS and LENGTH
    categories: np.ndarray  # documents by CATEGORIES, hashed; 0 for null


def _category(values: list) -> np.ndarray:
    known = {v: int.from_bytes(hashlib.blake2b(str(v).encode(), digest_size=6).digest(), "little") + 1 for v in set(values) if v is not None}
    return np.array([known.get(v, 0) for v in values], dtype=np.int64)


def look(texts: list[bytes], columns: dict[str, list]) -> Views:
    joined = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[:-1]
    _, starts, ends, hashes, first = words_of(texts, WORD)
    size = np.array([len(t) for t in texts], dtype=np.float64)
    count = np.diff(first).astype(np.float64)
    share = lambda table: np.add.reduceat(table[joined].astype(np.int64), begin) / np.maximum(size, 1)
    letters = np.concatenate([[0], np.cumsum(ends - starts)])
    same = np.zeros(len(hashes) + 1, dtype=np.int64)
    if len(hashes) > 1:
        same[2:] = np.cumsum(hashes[1:] == hashes[:-1])
    again = same[first[1:]] - same[np.minimum(first[:-1] + 1, first[1:])]
    length = np.array([-1.0 if x is None else x for x in columns[LENGTH]]) if LENGTH in columns else np.full(len(texts), -1.0)
    lines = np.add.reduceat(_LINE[joined].astype(np.int64), begin)
    numbers = np.stack([np.log1p(size), count / lines, (letters[first[1:]] - letters[first[:-1]]) / np.maximum(count, 1), share(_UPPER), share(_DIGIT), share(_SIGN), again / np.maximum(count, 1), length], axis=1)
    categories = np.stack([_category(columns[c]) if c in columns else np.zeros(len(texts), dtype=np.int64) for c in CATEGORIES], axis=1)
    return Views((hashes >> np.uint64(32)).astype(np.uint32), first, numbers, categories)


# --------------------------------------------------------------------------- the two classifiers (good against bad)


def _edges(numbers: np.ndarray) -> list[np.ndarray]:
    """Bounds of each number's bins."""
    return [np.unique(np.quantile(c, _CUTS)) for c in numbers.T]


def _bins(edges: list[np.ndarray], numbers: np.ndarray) -> np.ndarray:
    """Documents by NUMBERS: the bins, as 32-bit names beside those of words."""
    at = np.stack([np.searchsorted(e, c, side="right") + 1000 * i for i, (e, c) in enumerate(zip(edges, numbers.T, strict=True), 1)], axis=1)
    return (mix64(at.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)


#: Words and bins that a fit or a score takes at a time, so that the driver's memory doesn't follow the sample.
_BLOCK = 1 << 18


def _blocks(first: np.ndarray, most: int = _BLOCK) -> list[tuple[int, int]]:
    """Runs of documents of at most ``most`` words (a longer document is a run of its own); ``first`` has each one's first word, and one more."""
    out, at = [], 0
    while at < len(first) - 1:
        stop = max(at + 1, int(np.searchsorted(first, first[at] + most, side="right")) - 1)
        out.append((at, stop))
        at = stop
    return out


def _counted(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different words of several sets, and how many sets hold each."""
    flat = np.concatenate(sets or [np.empty(0, dtype=np.uint32)])
    flat.sort()
    begin = np.flatnonzero(flat[1:] != flat[:-1]) + 1
    begin = np.concatenate([[0], begin]) if len(flat) else begin
    return flat[begin], np.diff(np.append(begin, len(flat)))


@dataclass
class ContentView:
    edges: list[np.ndarray]
    words: np.ndarray
    weights: np.ndarray
    base: float

    @classmethod
    def fit(cls, sets: list[np.ndarray], numbers: np.ndarray, good: np.ndarray, least_z: float = 4.0, least_docs: int = 5, turns: int = 300, ridge: float = 1e-4) -> ContentView:
        """Logistic regression on the presence of the words and bins that tell good from bad, by Adam steps on all rows."""
        edges = _edges(numbers)
        bins = _bins(edges, numbers)
        n1, n0 = int(good.sum()), int((~good).sum())
        words, n = _counted([*sets, bins.ravel()])
        of_good, k = _counted([*(s for s, g in zip(sets, good, strict=True) if g), bins[good].ravel()])
        in_good = np.zeros(len(words), dtype=np.int64)
        in_good[np.searchsorted(words, of_good)] = k
        p1, p0, p = (in_good + 0.5) / (n1 + 1), (n - in_good + 0.5) / (n0 + 1), (n + 0.5) / (n1 + n0 + 1)
        z = np.abs(p1 - p0) / np.sqrt(p * (1 - p) * (1 / max(n1, 1) + 1 / max(n0, 1)))
        words = words[(z >= least_z) & (n >= least_docs)]
        parts = []  # per block its documents, the numbers of their telling words, and each one's first
        first = np.concatenate([[0], np.cumsum([len(s) + bins.shape[1] for s in sets], dtype=np.int64)])
        for a, b in _blocks(first) if len(words) else []:
            flat = np.concatenate([x for pair in zip(sets[a:b], bins[a:b], strict=True) for x in pair])
            at = np.minimum(np.searchsorted(words, flat), len(words) - 1)
            hit = words[at] == flat
            parts.append((slice(a, b), at[hit].astype(np.uint32), np.concatenate([[0], np.cumsum(hit)])[first[a : b + 1] - first[a]]))
        w = np.zeros(len(words) + 1)
        w[-1] = np.log((n1 + 1) / (n0 + 1))
        mean, square = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, turns + 1):
            error, step = np.full(len(good), w[-1]), ridge * w
            for own, at, cut in parts:
                total = np.concatenate([[0], np.cumsum(w[at])])
                error[own] += total[cut[1:]] - total[cut[:-1]]
                error[own] = (_expit(error[own]) - good[own]) / len(good)
                step[:-1] += np.bincount(at, weights=np.repeat(error[own], np.diff(cut)), minlength=len(words))
            step[-1] = error.sum() if parts else ((_expit(error) - good) / len(good)).sum()
            mean, square = 0.9 * mean + 0.1 * step, 0.99 * square + 0.01 * step * step
            w -= 0.1 * (1 - t / (turns + 1)) * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-9)
        return cls(edges, words, w[:-1], float(w[-1]))

    def score(self, v: Views) -> np.ndarray:
        out = np.full(len(v.first) - 1, self.base)
        if not len(self.words):
            return out
        bins = _bins(self.edges, v.numbers[:, : len(NUMBERS)])
        for a, b in _blocks(v.first):
            words = np.concatenate([v.words[v.first[a] : v.first[b]], bins[a:b].ravel()])
            doc = np.concatenate([np.repeat(np.arange(a, b), np.diff(v.first[a : b + 1])), np.repeat(np.arange(a, b), bins.shape[1])])
            at = np.searchsorted(self.words, words)
            at[at == len(self.words)] = 0
            hit = np.flatnonzero(self.words[at] == words)
            doc = doc[hit]
            pair = np.unique(doc * len(self.words) + at[hit])
            np.add.at(out, pair // len(self.words), self.weights[pair % len(self.words)])
        return out


@dataclass
class PageView:
    edges: list[np.ndarray]
    bins: list[np.ndarray]
    categories: list[dict[int, float]]

    @classmethod
    def fit(cls, numbers: np.ndarray, categories: np.ndarray, good: np.ndarray) -> PageView:
        n1, n0 = good.sum() + len(_CUTS), (~good).sum() + len(_CUTS)

        def weight(own: np.ndarray) -> float:
            return float(np.log(((own & good).sum() + 1) / n1) - np.log(((own & ~good).sum() + 1) / n0))

        edges = _edges(numbers)
        bins = [np.array([weight(np.searchsorted(e, c, side="right") == b) for b in range(len(e) + 1)]) for e, c in zip(edges, numbers.T, strict=True)]
        known = [{int(x): weight(c == x) for x in np.unique(c)} for c in categories.T]
        return cls(edges, bins, known)

    def score(self, v: Views) -> np.ndarray:
        out = np.zeros(len(v.numbers))
        for e, w, c in zip(self.edges, self.bins, v.numbers[:, len(NUMBERS) :].T, strict=True):
            out += w[np.searchsorted(e, c, side="right")]
        for known, c in zip(self.categories, v.categories.T, strict=True):
            values, back = np.unique(c, return_inverse=True)
            out += np.array([known.get(int(x), 0.0) for x in values])[back]
        return out


def platt(score: np.ndarray, good: np.ndarray, turns: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve through scores of labelled rows, by Newton's method on softened labels."""
    if not len(score):  # nothing is known about the score
        return 0.0, 0.0
    n1, n0 = good.sum(), (~good).sum()
    want = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    mean, scale = float(np.mean(score)), max(float(np.std(score)), 1e-6)
    x, a, b = (score - mean) / scale, 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        w, d = np.maximum(p * (1 - p), 1e-9), want - p
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, np.array([(d * x).sum(), d.sum()]))
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-7:
            break
    slope = max(a, 0.0) / scale
    return slope, b - slope * mean


@dataclass
class Model:
    content: ContentView
    page: PageView
    content_curve: tuple[float, float]
    page_curve: tuple[float, float]
    prior: float  # log-odds of good among the labels

    def log_odds(self, v: Views) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated log-odds of each view, and of both."""
        a, b = self.content_curve
        c, d = self.page_curve
        one, two = a * self.content.score(v) + b, c * self.page.score(v) + d
        return one, two, one + two - self.prior


def _expit(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


# --------------------------------------------------------------------------- samples

_ROW = "kind int, pick long, doc_id long, words binary, numbers array<double>, categories array<long>"


def _slim(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *_page(docs, doc_id, text))


def _page(docs: DataFrame, *own: str) -> list[Column]:
    """What the page view sees of ``docs``: whichever of its columns there are."""
    kinds = dict.fromkeys(CATEGORIES, "string") | {LENGTH: "double"}
    return [F.col(c).try_cast(kind).alias(c) for c, kind in kinds.items() if c in docs.columns and c not in own]


#: Largest pick.
_ALL = (1 << 63) - 1


def _bound(share: float) -> int:
    """Picks up to this one are about ``share`` of all."""
    return _ALL if share >= 1 else min(_ALL, int(share * _ALL))


def _pick(ids: np.ndarray, seed: int) -> np.ndarray:
    return (mix64(ids.astype(np.uint64) + np.uint64(seed * 1_000_003)) >> np.uint64(1)).astype(np.int64)


def _rows(kind: int, v: Views, ids: np.ndarray, picks: np.ndarray, chosen: np.ndarray) -> pa.RecordBatch:
    words = [np.unique(v.words[v.first[i] : v.first[i + 1]]).astype("<u4").tobytes() for i in chosen]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(chosen), kind), pa.int32()), pa.array(picks[chosen]), pa.array(ids[chosen]), pa.array(words, pa.binary()), pa.array(v.numbers[chosen].tolist(), pa.list_(pa.float64())), pa.array(v.categories[chosen].tolist(), pa.list_(pa.int64()))],
        names=["kind", "pick", "doc_id", "words", "numbers", "categories"],
    )


def _looked(batches, names: list[str]):
    for batch in batches:
        for first, texts in text_chunks(batch.column(1)):
            part = batch.slice(first, len(texts))
            yield part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), look(texts, {c: part.column(i).to_pylist() for i, c in enumerate(names) if c in (*CATEGORIES, LENGTH)})


def _sample(table: pa.Table, order: str) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Word sets, numbers, categories and ids of collected rows, in order; the sets are views of the table's own memory."""
    rank = np.argsort(table[order].to_numpy(), kind="stable")
    words = [np.frombuffer(x.as_buffer(), dtype="<u4") for x in table["words"]]
    flat = lambda c, n, kind: table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, n)[rank]
    return [words[i] for i in rank], flat("numbers", len(NUMBERS) + 1, np.float64), flat("categories", len(CATEGORIES), np.int64), table["doc_id"].to_numpy()[rank]


def label_sample(labels: DataFrame, max_fit: int, seed: int) -> dict[int, bool]:
    """doc_id to good of about ``max_fit`` labelled documents (all, if fewer), drawn by hash. A document is bad if a row of it
    says quality 0 or toxic 1, and good if a row says quality 1 and none says bad; other rows label nothing."""
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    each = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.when(bad, 0).when(F.col("quality").isNotNull(), 1).alias("good")).where("good IS NOT NULL")
    total = each.count()
    share = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) < int(min(1.0, max_fit / max(total, 1)) * (1 << 40))
    return {r["doc_id"]: r["good"] == 1 for r in each.where(share).groupBy("doc_id").agg(F.min("good").alias("good")).collect()}


def held_out(ids: np.ndarray, good: np.ndarray, seed: int) -> np.ndarray:
    """Labelled documents that no fit sees: three tenths of each class by hash, rounded up. At least one of a class is fitted, so
    that the only one of a class isn't held out, and its calibration rests on the prior."""
    held = np.zeros(len(ids), dtype=bool)
    for kind in (good, ~good):
        own = np.flatnonzero(kind)
        own = own[np.lexsort((ids[own], _pick(ids[own], seed)))]
        held[own[: min(-(-3 * len(own) // 10), len(own) - 1)]] = True
    return held


def _proportionate(counts: list[int], prior: float) -> list[int]:
    """How many pseudo-labels of each kind are taken: a view's good and bad ones in the labels' proportion, so that a view that is
    sure of one class only doesn't teach the other view that documents unlike the labelled ones are of that class."""
    odds, out = math.exp(prior), []
    for good, bad in (counts[:2], counts[2:]):
        out += [min(good, round(bad * odds)), min(bad, round(good / odds))]
    return out


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = 2, max_fit: int = 20_000, pseudo: int = 1000, sure: float = 0.99, seed: int = 6) -> Model | None:
    """Co-train on ``docs`` and ``labels`` (doc_id, quality, toxic); None if the labels don't show both classes. Rows without an id can't be
    labelled or told apart, so they are scored but not learned from."""
    known = label_sample(labels, max_fit, seed)
    if len(set(known.values())) < 2:
        return None
    slim = _slim(docs, doc_id, text).where("doc_id IS NOT NULL")
    names = slim.columns
    ids = np.array(sorted(known), dtype=np.int64)
    sent = docs.sparkSession.sparkContext.broadcast(ids)  # max_fit ids

    def labelled(batches):
        for own, v in _looked(batches, names):
            chosen = np.flatnonzero(np.isin(own, sent.value))
            if len(chosen):
                yield _rows(0, v, own, own, chosen)

    once = W.partitionBy("doc_id").orderBy("words", F.col("numbers").cast("string"))  # a doc_id that comes again counts once
    chosen = slim.mapInArrow(labelled, _ROW).withColumn("n", F.row_number().over(once)).where("n = 1")
    sets, numbers, categories, own = _sample(chosen.toArrow(), "doc_id")
    good = np.array([known[int(i)] for i in own], dtype=bool)
    if good.all() or not good.any():
        return None
    held = held_out(own, good, seed)
    fit, test = np.flatnonzero(~held), np.flatnonzero(held)
    lens = np.concatenate([[0], np.cumsum([len(sets[i]) for i in test])])
    seen = Views(np.concatenate([np.empty(0, dtype="<u4"), *(sets[i] for i in test)]), lens, numbers[test], categories[test])
    prior = float(np.log((good.sum() + 1) / ((~good).sum() + 1)))

    def model(for_content, for_page) -> Model:
        words, features = [sets[i] for i in fit] + for_content[0], np.concatenate([numbers[fit], for_content[1]])
        content = ContentView.fit(words, features[:, : len(NUMBERS)], np.concatenate([good[fit], for_content[2]]))
        page = PageView.fit(np.concatenate([numbers[fit], for_page[0]])[:, len(NUMBERS) :], np.concatenate([categories[fit], for_page[1]]), np.concatenate([good[fit], for_page[2]]))
        return Model(content, page, platt(content.score(seen), good[test]), platt(page.score(seen), good[test]), prior)

    for_content = ([], np.zeros((0, len(NUMBERS) + 1)), np.zeros(0, dtype=bool))
    for_page = (np.zeros((0, len(NUMBERS) + 1)), np.zeros((0, len(CATEGORIES)), dtype=np.int64), np.zeros(0, dtype=bool))
    now = model(for_content, for_page)
    total = slim.count()
    limit = float(np.log(sure / (1 - sure)))

    def kinds_of(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, ...]:
        return one >= limit, one <= -limit, two >= limit, two <= -limit

    for turn in range(rounds):
        # Picks are uniform, so that a bound on them leaves about three times the pseudo-labels that are wanted, from all documents;
        # how many documents a view is sure of is read off the held-out labels. A kind that falls short is searched again under a
        # higher bound, so that the smallest picks of all documents are found whatever the labels promise.
        shares = [max(int(x.sum()), 1) / max(len(test), 1) for x in kinds_of(*now.log_odds(seen)[:2])]
        bounds = [_bound(3 * pseudo / max(total * x, 1)) for x in shares]
        shared = docs.sparkSession.sparkContext.broadcast(now)

        def confident(batches, bounds, shared=shared, turn=turn):
            best: list[list[pa.RecordBatch]] = [[], [], [], []]
            for own, v in _looked(batches, names):
                one, two, _ = shared.value.log_odds(v)
                picks, free = _pick(own, seed + turn + 1), ~np.isin(own, sent.value)
                for kind, which in enumerate(kinds_of(one, two)):
                    if kind not in bounds:
                        continue
                    chosen = np.flatnonzero(which & free & (picks <= bounds[kind]))
                    chosen = chosen[np.argsort(picks[chosen], kind="stable")[:pseudo]]
                    if len(chosen):
                        table = pa.Table.from_batches([*best[kind], _rows(kind, v, own, picks, chosen)]).sort_by("pick").slice(0, pseudo)
                        best[kind] = table.combine_chunks().to_batches()
            for kept in best:
                yield from kept

        order = W.partitionBy("kind").orderBy("pick", "doc_id")
        found, wanted = [], dict(enumerate(bounds))
        while wanted:
            rows = slim.mapInArrow(lambda it, wanted=wanted, run=confident: run(it, wanted), _ROW).withColumn("n", F.row_number().over(order)).where(F.col("n") <= pseudo).toArrow()
            counts = Counter(rows["kind"].to_pylist())
            short = {k: b for k, b in wanted.items() if counts[k] < pseudo and b < _ALL}
            found.append(rows.filter(pc.invert(pc.is_in(rows["kind"], pa.array(list(short), pa.int32())))))
            wanted = {k: _bound(3 * pseudo / max(counts[k], 1) * (b / _ALL)) for k, b in short.items()}
        found = pa.concat_tables(found)
        held_to = _proportionate([pc.sum(pc.equal(found["kind"], k)).as_py() or 0 for k in range(4)], prior)
        kinds = [_sample(found.filter(pc.and_(pc.equal(found["kind"], k), pc.less_equal(found["n"], held_to[k]))), "n") for k in range(4)]
        flag = lambda a, b: np.concatenate([np.ones(len(kinds[a][3]), dtype=bool), np.zeros(len(kinds[b][3]), dtype=bool)])
        for_content = (for_content[0] + kinds[2][0] + kinds[3][0], np.concatenate([for_content[1], kinds[2][1], kinds[3][1]]), np.concatenate([for_content[2], flag(2, 3)]))
        for_page = (np.concatenate([for_page[0], kinds[0][1], kinds[1][1]]), np.concatenate([for_page[1], kinds[0][2], kinds[1][2]]), np.concatenate([for_page[2], flag(0, 1)]))
        now = model(for_content, for_page)
    return now


def score_documents(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """All rows and columns of ``docs`` with p_content, p_page and p_good (probabilities that the document is good by each view
    and by both) and keep (p_good >= ``threshold``). Null text counts as empty. Without a model the probabilities are null and
    keep is true. Repeated rows are scored alike, texts of any length are read whole, no rows give no rows. Names that are taken
    get leading underscores.
    """
    added = free_name(docs, "p_content", "p_page", "p_good", "keep")
    if model is None:
        return docs.withColumns({c: F.lit(None).cast("double") for c in added[:3]} | {added[3]: F.lit(True)})
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.DoubleType()) for c in added[:3]), T.StructField(added[3], T.BooleanType())])
    page = _page(docs, doc_id, text)
    place, width, names = docs.columns.index(text), len(docs.columns), schema.names
    seen = docs.select(*page).columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for first, texts in text_chunks(batch.column(place)):
                part = batch.slice(first, len(texts))
                odds = shared.value.log_odds(look(texts, {c: part.column(width + i).to_pylist() for i, c in enumerate(seen)}))
                one, two, both = (_expit(x) for x in odds)
                yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(one), pa.array(two), pa.array(both), pa.array(both >= threshold)], names=names)

    free = free_name(docs, *(f"page_{c}" for c in seen))
    return docs.select(*docs.columns, *(c.alias(name) for c, name in zip(page, free, strict=True))).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """``score_documents`` with a model trained on the same documents and their labels. Repeated rows are scored alike; no rows
    give no rows; no labels, or labels of one class only, reject nothing."""
    return score_documents(docs, train(docs, labels, **how), how.get("doc_id", "doc_id"), how.get("text", "text"))


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows and columns of ``docs`` that the classifier doesn't reject."""
    return classify(docs, labels, **how).where(free_name(docs, "keep")[0]).select(*docs.columns)
