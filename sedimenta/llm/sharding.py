"""Balanced sharding by minimax contiguous partition, with DataFrame functions only.

Rows with the same text form an atom. Atoms are ordered by the first 60 bits of their text's SHA-256 (texts that
share them share the atom) and cut into contiguous shards. The smallest feasible capacity is found by binary search;
a capacity is checked greedily, filling shard after shard.

Nobody needs all atoms for that. The driver holds ``cells``, ranges of the order with their sizes, a bounded number
of them: first a histogram of the whole order, then finer and finer cells where a greedy cut can still fall, until
the cells there are single atoms. The capacity is then exact, whatever the number of atoms. Cutting at that
capacity may leave the last shards empty, so the final cuts aim at an equal share of what remains, as long as what
lies behind a cut stays feasible at the capacity.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.llm.support import free_name, materialize, utf8

#: Keys are whole numbers below this.
KEY_SPACE = 1 << 60
#: Cells of the first histogram, and of each refinement.
CELLS = 1 << 13


@dataclass(frozen=True)
class Cell:
    """Keys lo <= k < hi, their bytes, and whether they are one atom."""

    lo: int
    hi: int
    size: int
    atomic: bool


def atom_key(text: str | Column) -> Column:
    return F.conv(F.substring(F.sha2(utf8(text), 256), 1, 15), 16, 10).cast("long")


def _histogram(rows: DataFrame, ranges: list[tuple[int, int]], cells: int) -> list[Cell]:
    """Cells of equal width that divide each range. ranges: in order, disjoint."""
    per = max(2, cells // len(ranges))
    starts = F.array(*[F.lit(lo) for lo, _ in ranges])
    widths = F.array(*[F.lit(max(1, -(-(hi - lo) // per))) for lo, hi in ranges])
    ends = F.array(*[F.lit(hi) for _, hi in ranges])
    if len(ranges) == 1:
        at = F.lit(0)
    else:
        at = F.size(F.filter(starts, lambda s: s <= F.col("key"))) - 1
    tagged = rows.withColumn("at", at).where((F.col("key") >= ranges[0][0]) & (F.col("key") < F.get(ends, F.col("at"))))
    key, start, width = F.col("key"), F.get(starts, F.col("at")), F.get(widths, F.col("at"))
    lo = key - F.pmod(key - start, width)
    found = tagged.groupBy(lo.alias("lo"), "at").agg(F.sum("size").alias("size"), F.min("key").alias("a"), F.max("key").alias("b"))
    out = []
    for r in sorted(found.collect()):  # as many rows as cells at most
        out.append(Cell(r["a"], r["b"] + 1, r["size"], r["a"] == r["b"]))
    return out


class Order:
    """Known cells in order: prefix sums, and greedy walks over their boundaries."""

    def __init__(self, cells: list[Cell]):
        self.cells = cells
        self.sums = [0]
        for c in cells:
            self.sums.append(self.sums[-1] + c.size)

    @property
    def total(self) -> int:
        return self.sums[-1]

    def step(self, at: int, capacity: int) -> int:
        """Cells from ``at`` on that fit whole."""
        return bisect_right(self.sums, self.sums[at] + capacity) - 1

    def feasible(self, capacity: int, shards: int, at: int = 0) -> bool:
        for _ in range(shards):
            if at == len(self.cells):
                return True
            nxt = self.step(at, capacity)
            if nxt == at:
                return False
            at = nxt
        return at == len(self.cells)

    def reachable(self, capacity: int, shards: int) -> bool:
        """Feasible if a cell that isn't an atom might be cut anywhere: necessary for feasibility."""
        done = 0
        for _ in range(shards):
            if done >= self.total:
                return True
            goal = done + capacity
            i = bisect_right(self.sums, goal) - 1
            if i < len(self.cells) and self.cells[i].atomic:
                goal = self.sums[i]
            if goal <= done:
                return False
            done = goal
        return done >= self.total


def _least(low: int, high: int, fits) -> int:
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def _open_cells(order: Order, low: int, high: int, shards: int) -> set[int]:
    """Cells, not atoms, in which a greedy cut can fall for a capacity from ``low`` to ``high``."""
    out: set[int] = set()
    near, far = 0, 0  # cut positions: cell boundaries at the low capacity, bytes at the high one
    for _ in range(shards):
        near = max(order.step(near, low), near)
        far = min(order.total, far + high)
        last = min(bisect_right(order.sums, far) - 1, len(order.cells) - 1)
        out.update(i for i in range(near, last + 1) if not order.cells[i].atomic)
    return out


def _runs(numbers: list[int]) -> list[tuple[int, int]]:
    """Runs of consecutive numbers, of up to 32 each: few enough to become much finer in a histogram."""
    out: list[tuple[int, int]] = []
    for i in numbers:
        if out and out[-1][1] == i and i - out[-1][0] < 32:
            out[-1] = (out[-1][0], i + 1)
        else:
            out.append((i, i + 1))
    return out


def minimax_cuts(rows: DataFrame, shards: int, cells: int = CELLS) -> tuple[int, list[int]]:
    """Smallest capacity for which ``rows`` (key long, size long) can be cut into ``shards`` contiguous shards, and
    the first key of every shard but the first. With no rows: 0 and no cuts."""
    known = _histogram(rows, [(0, KEY_SPACE)], cells)
    if not known:
        return 0, []
    while True:
        order = Order(known)
        low = _least(-(-order.total // shards), order.total, lambda c: order.reachable(c, shards))
        low = max([low, *(c.size for c in known if c.atomic)])
        high = _least(low, order.total, lambda c: order.feasible(c, shards))
        wide = sorted(_open_cells(order, low, high, shards)) if low < high else []
        if not wide:
            break
        runs = _runs(wide)[: max(1, cells // 64)]  # what is left over is refined in a later turn
        finer = _histogram(rows, [(known[a].lo, known[b - 1].hi) for a, b in runs], cells)
        drop = {i for a, b in runs for i in range(a, b)}
        known = sorted([c for i, c in enumerate(known) if i not in drop] + finer, key=lambda c: c.lo)
    return high, [order.cells[i].lo for i in _even_cuts(order, high, shards) if i < len(order.cells)]


def _even_cuts(order: Order, capacity: int, shards: int) -> list[int]:
    cuts, at = [], 0
    for left in range(shards, 1, -1):
        most = order.step(at, capacity)
        goal = order.sums[at] + (order.total - order.sums[at]) / left
        best = min(max(bisect_right(order.sums, goal) - 1, at + 1), most)
        if best < most and order.sums[best + 1] - goal < goal - order.sums[best]:
            best += 1
        # Feasibility only grows with the cut, so that the first feasible cut from there on is searched for.
        best = _least(best, most, lambda i: order.feasible(capacity, left - 1, i))
        cuts.append(best)
        at = best
        if at >= len(order.cells):
            break
    return cuts


def assign_shards(docs: DataFrame, shards: int, text: str = "text", overhead: int = 8, lanes: int = 1 << 12) -> DataFrame:
    """The rows and columns of ``docs`` without ``text``, with size (UTF-8 bytes of the text, null none, plus
    ``overhead``), text_crc32, shard and slot: each shard's slots are 0, 1, ... without gaps.

    Equal texts share a shard; null and empty texts count as equal; a text of any length is one row. Repeated rows get a slot each. An empty table
    gives no rows. Names that are taken are replaced: size, text_crc32, shard and slot are the operator's.
    """
    own = ["size", "text_crc32", "shard", "slot"]
    rest = [c for c in docs.columns if c != text and c not in own]
    key, lane, before, within = free_name(docs, "key", "lane", "before", "within")
    by = [c for c in rest if not any(x in docs.schema[c].dataType.simpleString() for x in ("map<", "variant"))]
    size = (F.octet_length(utf8(text)) + overhead).cast("long")
    slim = materialize(docs.select(*rest, size.alias("size"), F.crc32(utf8(text)).cast("long").alias("text_crc32"), atom_key(text).alias(key)), "shard-rows")
    _, cuts = minimax_cuts(slim.select(F.col(key).alias("key"), "size"), shards)
    shard = sum((F.when(F.col(key) >= c, 1).otherwise(0) for c in cuts), F.lit(0)) if cuts else F.lit(0)
    # Slots: rows are numbered inside narrow lanes of the order (an atom of many rows is dealt over 64 of them by the
    # row's other columns), and lanes get offsets from their counts, of which there is a bounded number.
    deal = F.pmod(F.xxhash64(*[F.col(c) for c in by]), F.lit(64)) if by else F.lit(0)
    placed = slim.withColumn("shard", shard.cast("int")).withColumn(lane, F.shiftright(key, 60 - (lanes.bit_length() - 1)) * 64 + deal)
    counts = placed.groupBy("shard", lane).agg(F.count("*").alias("n"))
    ahead = W.partitionBy("shard").orderBy(lane).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", lane, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias(before))
    inside = W.partitionBy("shard", lane).orderBy(key, *by)
    placed = placed.withColumn(within, F.row_number().over(inside)).join(offsets, ["shard", lane])
    return placed.select(*rest, "size", "text_crc32", "shard", (F.col(before) + F.col(within) - 1).cast("long").alias("slot"))
