"""Merkle manifest of a dataset as a postorder append log.

Leaves are numbered within their group (range-partitioned, so a group with a third of all rows is cut). Aligned builders take
``fanout ** SPAN`` consecutive leaves each and append every node when it is complete: the leaves in order, and behind a run's last child
the run's parent. A log is one row per builder, whose first position is known beforehand, so builders need no order among
themselves. The builders' peaks are the leaves of the next tier's log, until a group has one peak; the groups' peaks are the leaves of one
more tree. A node's position follows from the sizes of the subtrees before it (``position``), which is how a proof finds its siblings:
from the top tier down, each builder's segment is read once, and only the steps above its peak are handed to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.llm.support import materialize

#: Levels that a builder completes: 4,096 leaves at a fanout of 16.
SPAN = 3
STEPS = "array<struct<before: string, after: string>>"


def leaf_digest(columns: list[str | Column]) -> Column:
    """Hex SHA-256 of the columns in turn: null as ``-``, else UTF-8 byte count, colon, value."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)).cast("binary"), 256)


def height(n: int, fanout: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    out, reach = 0, 1
    while reach < n:
        out, reach = out + 1, reach * fanout
    return out


def position(level: int, index: np.ndarray | int, n: int, fanout: int, top: int | None = None):
    """Places in the append log of the nodes ``index`` of a level, in a log of the lowest ``top`` levels over ``n`` leaves.

    A node is appended when its last leaf is; so before it are all nodes of its level and below that end no later, and all
    higher nodes that end earlier.
    """
    top = height(n, fanout) if top is None else top
    end = np.minimum((np.asarray(index, dtype=np.int64) + 1) * fanout**level, n)
    out = np.full_like(end, -1)
    for j in range(top + 1):
        size = fanout**j
        out += -(-end // size) if j <= level else (end - 1) // size
    return out


def build_segment(leaves: list[str], fanout: int, top: int) -> list[str]:
    """A builder's nodes in completion order; ``top`` levels are completed, single children included."""
    out: list[str] = []
    open_runs: list[list[str]] = [[] for _ in range(top + 1)]

    def add(level: int, digest: str) -> None:
        out.append(digest)
        open_runs[level].append(digest)
        if level < top and len(open_runs[level]) == fanout:
            close(level)

    def close(level: int) -> None:
        run, open_runs[level] = open_runs[level], []
        add(level + 1, hashlib.sha256("".join(run).encode()).hexdigest())

    for leaf in leaves:
        add(0, leaf)
    for level in range(top):
        if open_runs[level]:
            close(level)
    return out


@dataclass
class Tier:
    """One tier of logs: a row per builder with tree, builder, n (leaves of the tree), first (position of the segment in the tree's
    log), nodes (hex digests in completion order), peak, and the leaves' own columns as lists in ``kept``."""

    segments: DataFrame
    kept: list[str]


@dataclass
class Manifest:
    """Logs of the groups (``tiers``, lowest first) and of the tree over their peaks (``top``, lowest first); ``roots`` has a row
    per group: tree, group, idx, subroot; ``root`` is null without rows."""

    tiers: list[Tier]
    top: list[Tier]
    roots: DataFrame
    root: str | None
    fanout: int


def numbered(df: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, int]:
    """Add idx (from 0 within the key, by the order) and n (rows of the key), and return the largest n as well. ``order`` tells rows apart,
    so that ranges cut a frequent key; only a row per key and range is brought together by key."""
    dealt = materialize(df.repartitionByRange(key, *order).withColumn("part", F.spark_partition_id()), "merkle-ranges")
    counts = dealt.groupBy(key, "part").agg(F.count("*").alias("rows"))
    ahead = W.partitionBy(key).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    moved = counts.select(key, "part", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("ahead"), F.sum("rows").over(W.partitionBy(key)).alias("n"))
    moved = materialize(moved, "merkle-offsets")
    place = F.row_number().over(W.partitionBy(key, "part").orderBy(*order)) - 1
    placed = dealt.withColumn("idx", place.cast("long")).join(moved, [key, "part"]).withColumn("idx", F.col("idx") + F.col("ahead")).drop("part", "ahead")
    return placed, moved.agg(F.max("n")).first()[0] or 0


def _builder(kept: list[str], fanout: int) -> Callable[[tuple, pa.Table], pa.Table]:
    span = fanout**SPAN

    def build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        n, b = rows["n"][0].as_py(), key[1].as_py()
        top = min(height(n, fanout), SPAN)
        nodes = build_segment(rows["digest"].to_pylist(), fanout, top)
        first = int(position(0, b * span, n, fanout, top))
        lists = {c: pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), pa.concat_arrays(rows[c].chunks)) for c in kept}
        return pa.table({"tree": [key[0].as_py()], "builder": [b], "n": [n], "first": [first], "nodes": [nodes], "peak": [nodes[-1]], **lists})

    return build


def build_tiers(leaves: DataFrame, most: int, kept: list[str], fanout: int) -> list[Tier]:
    """Logs over leaves (tree, idx, n, digest and ``kept`` columns), tier upon tier until each tree has one peak; the largest tree has
    ``most`` leaves."""
    span, tiers = fanout**SPAN, []
    while True:
        kinds = {c: leaves.schema[c].dataType.simpleString() for c in kept}
        out = "tree string, builder long, n long, first long, nodes array<string>, peak string" + "".join(f", {c} array<{k}>" for c, k in kinds.items())
        dealt = leaves.withColumn("builder", F.floor(F.col("idx") / span))
        made = dealt.groupBy("tree", "builder").applyInArrow(_builder(kept, fanout), out)
        tiers.append(Tier(materialize(made, "merkle-log"), kept))
        if most <= span:
            return tiers
        most = -(-most // span)
        above = tiers[-1].segments.where(F.col("n") > span)
        leaves, kept = above.select("tree", F.col("builder").alias("idx"), F.ceil(F.col("n") / span).alias("n"), F.col("peak").alias("digest")), []


def subroots(tiers: list[Tier], fanout: int) -> DataFrame:
    """(tree, subroot): the peak of each tree's only builder on its last tier."""
    one = [t.segments.where(F.col("n") <= fanout**SPAN).select("tree", F.col("peak").alias("subroot")) for t in tiers]
    out = one[0]
    for df in one[1:]:
        out = out.unionByName(df)
    return out


def build_manifest(df: DataFrame, group: str, order: list[str], digest: str, keep: list[str], fanout: int = 16) -> Manifest:
    """Build the logs over the rows' digests: a tree per group over its rows by ``order`` (nulls first), and a tree over the groups' roots
    by group, null first, then bytewise. ``keep`` columns stay with their leaf.

    Rows that repeat are leaves of their own, in any order where they are equal in everything. No rows give no root. Column names may be
    anything: rows are renamed on the way in.
    """
    own = {f"kept{i}": c for i, c in enumerate(keep)}
    keys = {f"key{i}": c for i, c in enumerate(order)}
    tree = F.when(F.col(group).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(group).cast("string")))
    slim = df.select(tree.alias("tree"), F.col(digest).alias("digest"), *(F.col(c).alias(k) for k, c in keys.items()), *(F.col(c).alias(k) for k, c in own.items()))
    slim = materialize(slim.withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")  # hashes are taken once, and row tells equal leaves apart
    placed, most = numbered(slim, "tree", [*keys, "digest", "row"])
    tiers = build_tiers(placed.select("tree", "idx", "n", "digest", *own), most, list(own), fanout)
    peaks, trees = numbered(subroots(tiers, fanout).withColumn("all", F.lit("all")), "all", ["tree"])
    peaks = materialize(peaks.select("tree", "subroot", "idx", "n"), "merkle-roots")
    top = build_tiers(peaks.select(F.lit("all").alias("tree"), "idx", "n", F.col("subroot").alias("digest"), F.col("tree").alias("of")), trees, ["of"], fanout)
    last = subroots(top, fanout).first()
    return Manifest(tiers, top, peaks, last["subroot"] if last else None, fanout)


def _proofs(tier: Tier, above: DataFrame | None, fanout: int) -> DataFrame:
    """Per leaf of a tier: tree, idx, digest, kept columns, steps (siblings before and after it, level by level). ``above`` has the
    steps of the builders' peaks by tree and idx; a builder that is all of its tree needs none."""
    span, kept = fanout**SPAN, tier.kept
    kinds = {c: tier.segments.schema[c].dataType.elementType.simpleString() for c in kept}
    out = f"tree string, idx long, digest string, steps {STEPS}" + "".join(f", {c} {k}" for c, k in kinds.items())
    rows = tier.segments.select("tree", "builder", "n", "first", "nodes", *kept)
    if above is None:
        rows = rows.withColumn("more", F.array().cast(STEPS))
    else:
        rows = rows.join(above.select("tree", F.col("idx").alias("builder"), F.col("steps").alias("more")), ["tree", "builder"], "left")

    def steps_of(nodes: list[str], first: int, n: int, builder: int, more: list[dict]) -> list[list[dict]]:
        top = min(height(n, fanout), SPAN)
        lowest, ends = builder * span, min((builder + 1) * span, n)
        found: list[list[dict]] = []
        for level in range(top - 1, -1, -1):  # from the peak down; a child's steps go before its parent's
            size = fanout**level
            index = np.arange(lowest // size, -(-ends // size))
            own = [nodes[p] for p in position(level, index, n, fanout, top) - first]
            now = []
            for a in range(0, len(own), fanout):
                run = own[a : a + fanout]
                whole, up = "".join(run), found[a // fanout] if found else more
                now += [[{"before": whole[: 64 * c], "after": whole[64 * c + 64 :]}, *up] for c in range(len(run))]
            found = now
        return found or [more]

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                tree, builder, n, first, nodes, more = (row[c][0].as_py() for c in ("tree", "builder", "n", "first", "nodes", "more"))
                index = np.arange(builder * span, min((builder + 1) * span, n))
                digests = [nodes[p] for p in position(0, index, n, fanout, min(height(n, fanout), SPAN)) - first]
                steps = pa.array(steps_of(nodes, first, n, builder, more or []), pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))
                yield pa.RecordBatch.from_arrays([pa.array([tree] * len(index)), pa.array(index), pa.array(digests), steps, *(row[c].flatten() for c in kept)], names=["tree", "idx", "digest", "steps", *kept])

    return rows.mapInArrow(prove, out)


def _climb(tiers: list[Tier], fanout: int) -> DataFrame:
    """Proofs of the lowest tier's leaves, read from the highest tier down."""
    above = None
    for i, tier in reversed(list(enumerate(tiers))):
        found = _proofs(tier, above, fanout)
        above = materialize(found, "merkle-steps") if i else found
    return above


def prove(manifest: Manifest, keep: list[str]) -> DataFrame:
    """Per leaf: the ``keep`` columns of ``build_manifest``, leaf, subroot, root, steps: the siblings before and after each node on the way
    to the root, from the leaf up (a step of two empty texts is a single child)."""
    over = _climb(manifest.top, manifest.fanout).select(F.col("of").alias("tree"), F.col("digest").alias("subroot"), F.col("steps").alias("over"))
    own = _climb(manifest.tiers, manifest.fanout).join(materialize(over, "merkle-over"), "tree")
    return own.select(
        *(F.col(f"kept{i}").alias(c) for i, c in enumerate(keep)),
        F.col("digest").alias("leaf"),
        "subroot",
        F.lit(manifest.root).cast("string").alias("root"),
        F.concat("steps", "over").alias("steps"),
    )


def fold(leaf: str | Column, steps: str | Column) -> Column:
    """The root that a leaf and its steps lead to."""
    leaf = F.col(leaf) if isinstance(leaf, str) else leaf
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]).cast("binary"), 256))
