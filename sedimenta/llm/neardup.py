"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations make a whole signature: the first deals shingles to places on a circle, the second numbers the
places, and coordinate k is the smallest number met when the circle is turned by k. As all coordinates of a place are
neighbours on the circle, a signature is one gather and one minimum.

1. One scan makes, per document, the size of its shingle set, a 128-bit key of its word sequence, and its band keys.
   Documents of one word sequence are a class and are represented by its smallest doc_id.
2. Representatives that share a band key are candidates. In a bucket, members are compared with one hub and then with another,
   and only across components that are still separate: that settles small buckets and buckets of copies. Hubs come from partial
   aggregation, so that no bucket is gathered.
3. A pair is verified on the full shingle sets. Members stream past their hub's set; a hub of many members is dealt
   over several tasks.
4. Buckets with separate components left hold similar documents that aren't near enough. Those that overlap are made one group, the
   group is cut into blocks of bounded size, and each task intersects the sets of two blocks at once, as products of 0/1 matrices. No
   pair is written out but those that join components, and no bucket is capped.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.llm.components import connected_components
from sedimenta.llm.support import NOT_SPACE, combine, free_name, materialize, mix64, running_total, shuffle_partitions, text_chunks, with_totals, words_of

#: Places on the circle.
_PLACES = 1 << 20
#: Members of a hub in one task.
_DEAL = 500


@functools.cache
def _circle(coordinates: int) -> np.ndarray:
    """Row p: the numbers of the places p, p + 1, ... as seen by each coordinate."""
    numbers = np.random.default_rng(20).permutation(_PLACES).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([numbers, numbers[: coordinates - 1]]), coordinates)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of a set of 64-bit fingerprints (at least one)."""
    rows, places = _circle(coordinates), (shingles >> np.uint64(44)).astype(np.int64)
    out = np.full(coordinates, _PLACES, dtype=np.uint32)
    for i in range(0, len(places), 2048):
        np.minimum(out, rows[places[i : i + 2048]].min(axis=0), out=out)
    return out


def shingle_sets(texts: list[bytes], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sorted distinct n-word shingles, fingerprints of the words) of every text. A text of fewer words, but not none,
    has its whole sequence as its one shingle."""
    _, _, _, words, first = words_of(texts, NOT_SPACE)
    for a, b in zip(first, first[1:], strict=False):
        own = words[a:b]
        grams = combine(own, n) if b - a >= n else combine(own, b - a) if b > a else own
        yield np.unique(grams), own


def _sequence_key(words: np.ndarray) -> tuple[int, int]:
    import hashlib

    d = hashlib.blake2b(words.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def sign_documents(docs: DataFrame, doc_id: str, text: str, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, key_a and key_b (of the word sequence), band_keys."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("key_a", T.LongType()), T.StructField("key_b", T.LongType()), T.StructField("band_keys", T.ArrayType(T.LongType()))])

    def run(batches):
        salt = mix64(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            for first, texts in text_chunks(batch.column(1), 1 << 20):
                sizes, a, b, keys = [], [], [], []
                for grams, words in shingle_sets(texts, n):
                    sizes.append(len(grams))
                    ka, kb = _sequence_key(words)
                    a.append(ka)
                    b.append(kb)
                    if not len(grams):
                        keys.append([])
                        continue
                    parts, key = signature(grams, bands * rows).reshape(bands, rows), salt
                    for j in range(rows):
                        key = mix64(key ^ parts[:, j])
                    keys.append(key.view(np.int64))
                ids = batch.column(0).slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=schema.names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def verify_pairs(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (hub, member) of documents in ``texts`` (doc_id, text) for which 100 * common >= percent * all shingles."""
    spark = pairs.sparkSession
    known = with_totals(pairs, "hub", members=F.count("*"))
    deals = F.greatest(F.ceil(F.col("members") / _DEAL), F.lit(1)).cast("int")
    member = known.select("hub", F.pmod(F.xxhash64("member"), deals).cast("int").alias("deal"), F.col("member").alias("doc_id"), F.lit(1).alias("turn"))
    own = member.select("hub", "deal").distinct().select("hub", "deal", F.col("hub").alias("doc_id"), F.lit(0).alias("turn"))
    rows = member.unionByName(own).join(texts, "doc_id").select("hub", "deal", "turn", "doc_id", "text")
    rows = rows.repartition(shuffle_partitions(spark), "hub", "deal").sortWithinPartitions("hub", "deal", "turn", "doc_id")

    def run(batches):
        hub, sets = None, []
        for batch in batches:
            for first, raw in text_chunks(batch.column(4)):
                hubs_, deals_ = batch.column(0).slice(first, len(raw)), batch.column(1).slice(first, len(raw))
                turns, ids = batch.column(2).slice(first, len(raw)), batch.column(3).slice(first, len(raw))
                left, right = [], []
                for i, (grams, _) in enumerate(shingle_sets(raw, n)):
                    key = (hubs_[i].as_py(), deals_[i].as_py())
                    if key != hub:
                        hub, sets = key, []
                    if turns[i].as_py() == 0:
                        sets.append(grams)
                        continue
                    for own in sets:
                        small, large = (grams, own) if len(grams) <= len(own) else (own, grams)
                        if not len(small):
                            continue
                        at = np.searchsorted(large, small)
                        at[at == len(large)] = 0
                        common = int((large[at] == small).sum())
                        if 100 * common >= percent * (len(grams) + len(own) - common):
                            left.append(key[0])
                            right.append(ids[i].as_py())
                            break
                if left:
                    yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["hub", "member"])

    return rows.mapInArrow(run, "hub long, member long")


def _candidates(buckets: DataFrame, hub: str, percent: int) -> DataFrame:
    """(hub, member): the hubs of a column with the members of their bucket that are in other components and of a size that a link
    allows."""
    sizes = buckets.where(F.col("doc_id") == F.col(hub)).select(F.col("doc_id").alias("hub"), F.col("n_shingles").alias("hub_size"), F.col("component").alias("hub_component"))
    pairs = buckets.where(F.col("doc_id") != F.col(hub)).select(F.col(hub).alias("hub"), F.col("doc_id").alias("member"), "n_shingles", "component").distinct()
    near = F.least("n_shingles", "hub_size") * 100 >= F.greatest("n_shingles", "hub_size") * percent
    return pairs.join(materialize(sizes.distinct(), "hub-sizes"), "hub").where(near & (F.col("component") != F.col("hub_component"))).select("hub", "member")


def _open(buckets: DataFrame) -> DataFrame:
    """Rows of the buckets whose rows are of several components. The list of these buckets is written first, so that Spark
    broadcasts it if it turns out small, and else splits frequent buckets while it joins."""
    sides = buckets.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return buckets.join(materialize(sides.where("low <> high").select("band"), "open-bands"), "band", "left_semi")


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, component) after ``links`` (a, b) between nodes: only components that are still apart are linked, so
    that later rounds work on few edges. Nodes without a label are their own component."""
    at = F.coalesce("component", "node")
    left = links.select(F.col("a").alias("node"), "b").join(labels, "node", "left").select(at.alias("a"), F.col("b").alias("node"))
    ends = left.join(labels, "node", "left").select("a", at.alias("b"))
    up = connected_components(ends.where("a <> b"))
    moved = labels.join(up.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return materialize(moved.unionByName(up).distinct(), "labels")


#: Shingles of a block, where a document counts as 200 at least.
_BLOCK = 50_000


def _crossed(table: pa.Table, n: int, percent: int) -> pa.Table:
    """Links between the documents of two blocks (or within one) that join components still apart."""
    docs, sides, parts = (table[c].to_pylist() for c in ("doc_id", "side", "component"))
    sets = [g for _, texts in text_chunks(table["text"].combine_chunks()) for g, _ in shingle_sets(texts, n)]
    size = np.array([len(s) for s in sets])
    grams, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = count[column] > 1
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        a, b = np.searchsorted(column, [at, at + 2048])
        tile = np.zeros((len(sets), 2048), dtype=np.float32)
        tile[row[a:b], column[a:b] - at] = 1
        common += tile @ tile.T
    both = common.astype(np.int64)
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    parts, side = np.array(parts), np.array(sides)
    linked &= (parts[:, None] != parts[None, :]) & np.triu(np.ones(linked.shape, dtype=bool), 1)
    if side.any():  # two blocks: each alone is another task's
        linked &= side[:, None] != side[None, :]
    boss: dict[int, int] = {}

    def root(x: int) -> int:
        while boss.get(x, x) != x:
            x = boss[x]
        return x

    left, right = [], []
    for i, j in zip(*np.nonzero(linked), strict=True):
        a, b = root(int(parts[i])), root(int(parts[j]))
        if a != b:
            boss[max(a, b)] = min(a, b)
            left.append(docs[i])
            right.append(docs[j])
    return pa.table({"hub": pa.array(left, pa.int64()), "member": pa.array(right, pa.int64())})


def _block_links(open_buckets: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links among the documents of buckets that aren't settled, each overlapping set of buckets compared block by block."""
    least = materialize(open_buckets.groupBy("band").agg(F.min("doc_id").alias("least")), "least")
    groups = connected_components(open_buckets.join(least, "band").select("doc_id", "least")).withColumnRenamed("component", "group")
    docs = open_buckets.select("doc_id", "component", "n_shingles").distinct().join(groups.withColumnRenamed("node", "doc_id"), "doc_id")
    summed = running_total(docs, "group", ["n_shingles", "doc_id"], F.greatest("n_shingles", F.lit(200)), "total")
    placed = materialize(summed.withColumn("block", F.floor(F.col("total") / _BLOCK).cast("int")).drop("total"), "blocks")
    # Sizes ascend, so that a block meets only those whose smallest document isn't too large for its largest.
    ends = placed.groupBy("group", "block").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    other = ends.select("group", F.col("block").alias("to"), F.col("low").alias("to_low"))
    meets = ends.join(other, "group").where((F.col("to") >= F.col("block")) & (F.col("high") * 100 >= F.col("to_low") * percent)).select("group", "block", "to")
    one = placed.join(meets, ["group", "block"]).select("group", "block", "to", F.lit(0).alias("side"), "doc_id", "component")
    two = placed.withColumnRenamed("block", "to").join(meets.where("block < to"), ["group", "to"]).select("group", "block", "to", F.lit(1).alias("side"), "doc_id", "component")
    rows = one.unionByName(two).join(texts, "doc_id")
    return rows.groupBy("group", "block", "to").applyInArrow(lambda t: _crossed(t, n, percent), "hub long, member long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 85, bands: int | None = None, rows: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Documents are linked if 100 * common >= ``percent`` * all of their ``n``-word shingles; a component is what links reach, and
    component_id its smallest doc_id. kept: the row is its component's smallest. Null, empty and blank texts have no shingles and
    no links. Rows that repeat a doc_id are versions of one document and share its component. A null doc_id takes no
    part: its component_id is null and it is kept. An empty table gives no rows.

    A pair of similarity s is a candidate with probability 1 - (1 - s**rows)**bands. By default there are so many bands that a
    pair just at the threshold is missed with probability 3e-7.
    """
    rows = rows or (6 if percent >= 85 else 5)
    bands = bands or math.ceil(math.log(3e-7) / math.log1p(-((percent / 100) ** rows)))
    signed = materialize(sign_documents(docs, doc_id, text, n, bands, rows), "signatures")
    real = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(real.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("head")), "classes")
    own = classes.withColumnRenamed("head", "doc_id")
    heads = real.join(own, ["key_a", "key_b", "doc_id"], "left_semi").dropDuplicates(["key_a", "key_b", "doc_id"]).select("doc_id", "n_shingles", "band_keys")
    # Copies hang on their class's head; only a doc_id of several texts ties heads together.
    headed = signed.join(classes, ["key_a", "key_b"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("head", "doc_id")).alias("head"))
    same = headed.groupBy("doc_id").agg(F.max("head").alias("a"), F.min("head").alias("b")).where("a <> b")
    same = same.select("a", "b").unionByName(same.select(F.col("doc_id").alias("a"), "b"))

    keyed = heads.select("doc_id", "n_shingles", F.explode("band_keys").alias("band"))
    # A bucket's hubs are its smallest and its largest id, from partial aggregation.
    shared = materialize(keyed.groupBy("band").agg(F.min("doc_id").alias("one"), F.max("doc_id").alias("two")).where("one <> two"), "hubs")
    buckets = materialize(keyed.join(shared, "band"), "buckets")
    wanted = buckets.select("doc_id").distinct()
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    texts = materialize(source.join(wanted, "doc_id", "left_semi"), "candidate-texts")

    links = materialize(verify_pairs(_candidates(buckets.withColumn("component", F.col("doc_id")), "one", percent), texts, n, percent), "links")
    ties = links.select(F.col("hub").alias("a"), F.col("member").alias("b")).unionByName(same)
    labels = connected_components(ties)
    for part in ("two", "rest"):
        label = labels.withColumnRenamed("node", "doc_id")
        now = materialize(buckets.join(label, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "buckets-now")
        if part == "two":
            fresh = verify_pairs(_candidates(_open(now), "two", percent), texts, n, percent)
        else:  # hubs have met everyone
            left = materialize(_open(now.where("doc_id <> one AND doc_id <> two")), "open-buckets")
            if left.isEmpty():
                break
            fresh = _block_links(left, texts, n, percent)
        labels = _relabelled(labels, materialize(fresh, "links").select(F.col("hub").alias("a"), F.col("member").alias("b")))
    component = F.coalesce("component", "head")
    out = headed.join(labels.withColumnRenamed("node", "head"), "head", "left")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows and columns of ``docs`` without those that aren't their component's smallest doc_id. Rows without an id, and rows
    without words, stay; so do all rows of a kept id. An empty table gives no rows; no other column takes part, whatever its name."""
    gone_id = free_name(docs, "gone_id")[0]
    gone = near_duplicates(docs, doc_id, text, **how).where("NOT kept").select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone, F.col(doc_id).cast("long") == F.col(gone_id), "left_anti")
